"""Projects and their workspaces: resources, views, sessions; which project a folder belongs to."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import spread
from ..functions.text import identity
from ..state import State
from .records import upsert


#: Parts over which the resources of one identity are dealt.
SALTS = 32


class Ambiguous(ValueError):
    """More than one project answers."""


def registered(projects: DataFrame, project: tuple[str, str, str], at: int) -> DataFrame:
    """The projects with one (id, name, root) saved, or taken back in."""
    if not project[0].strip() or not project[1].strip():
        raise ValueError("a project has an id and a name")
    return upsert(projects, projects.sparkSession.createDataFrame([(*project, True, at)], projects.schema), ["id"])


def removed(projects: DataFrame, project: str, at: int) -> DataFrame:
    """The projects with one left out of lists; what it has stays."""
    hit = F.col("id") == project
    return projects.withColumn("registered", F.when(hit, F.lit(False)).otherwise(F.col("registered"))).withColumn("updated_at", F.when(hit, F.lit(at)).otherwise(F.col("updated_at")).cast("long")).select(*projects.columns)


def listed(projects: DataFrame) -> DataFrame:
    return projects.where("registered").orderBy(F.desc("updated_at"), "name", "id")


def of_resources(resources: DataFrame, projects: DataFrame) -> DataFrame:
    """(project_id, resource columns): observed resources of the projects that know them by provider and identity.

    An identity that very many share is met by as many tasks as others: its resources are dealt over SALTS parts, to
    each of which its projects are copied.
    """
    keys = ["provider", "identity", "_salt"]
    dealt = spread(resources.withColumn("_salt", F.pmod(F.xxhash64(*resources.columns), F.lit(SALTS)).cast("int")), *keys)
    known = projects.select("project_id", "provider", "identity", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    return dealt.join(spread(known, *keys).hint("shuffle_hash"), keys).drop("_salt")


def owners(resources: DataFrame, projects: DataFrame, key: str) -> DataFrame:
    """(key, project_id), each once: which projects know the resource of a key by any provider and identity it has.

    A key with one identity meets a project once, so only the pairs of the others are compared with each other.
    """
    known = projects.select("project_id", "provider", "identity").distinct()
    each = resources.select(key, "provider", "identity").distinct()
    named = each.groupBy(key).agg(F.min(F.struct("provider", "identity")).alias("x"), F.count("*").alias("n"))
    one = of_resources(named.where("n = 1").select(key, "x.provider", "x.identity"), known).select(key, "project_id")
    more = each.join(named.where("n > 1").select(F.col(key).alias("_key")), F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    return one.unionByName(of_resources(more, known).select(key, "project_id").distinct())


def deepest_roots(paths: DataFrame, roots: DataFrame, path: str = "path", root: str = "root", owner: str = "project_id") -> DataFrame:
    """For each path the deepest root that holds it: root, the owners of that root in order, none for no root.

    A path's ancestors are few, so they are exploded and met by equality. More than one owner is for the caller to
    refuse.
    """
    parts = F.split(path, "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.coalesce(F.nullif(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("")), F.lit("/")))
    above = paths.select(path).distinct().withColumn("at", F.explode(ancestors))
    known = roots.select(F.coalesce(F.nullif(F.regexp_replace(root, "/+$", ""), F.lit("")), F.lit("/")).alias("at"), F.col(owner).alias("owner")).distinct()
    best = above.join(known, "at").groupBy(path, "at").agg(F.array_sort(F.collect_set("owner")).alias("owners")).groupBy(path).agg(F.max_by(F.struct("at", "owners"), F.length("at")).alias("x"))
    return paths.join(best, path, "left").select(*paths.columns, F.col("x.at").alias(root), F.coalesce("x.owners", F.array().cast("array<string>")).alias("owners"))


def of_folder(state: State, folder: str, observed: tuple[str, str] | None = None, given: str | None = None, known: DataFrame | None = None) -> str | None:
    """The project of a folder: the one given, else that of its observed resource (provider, identity), else of the deepest root.

    known(project_id, provider, identity) tells whose resources are whose. More than one answer is an error; None: no
    project.
    """
    projects = state["projects"].where("registered")
    if given:
        if projects.where(F.col("id") == given).isEmpty():
            raise LookupError(f"no project {given!r}")
        return given
    if observed and known is not None:
        mine = known.where((F.col("provider") == observed[0]) & (F.col("identity") == observed[1])).join(projects.select(F.col("id").alias("project_id")), "project_id", "left_semi")
        owners = sorted(r.project_id for r in mine.select("project_id").distinct().limit(2).collect())
        if owners:
            return _one(owners)
    spark = projects.sparkSession
    row = deepest_roots(spark.createDataFrame([(folder.rstrip("/") or "/",)], "path string"), projects.select("root", F.col("id").alias("project_id"))).first()
    return _one(row.owners) if row.owners else None


def _one(owners: list[str]) -> str:
    if len(owners) > 1:
        raise Ambiguous(f"more than one project: {', '.join(owners)}")
    return owners[0]


def observed_worktrees(listing: str) -> list[dict]:
    """The worktrees of a porcelain listing: root, revision, branch (none if detached), bare ones left out."""
    out = []
    for block in listing.split("\n\n"):
        found = dict(line.partition(" ")[::2] for line in block.splitlines() if line)
        if "worktree" in found and "bare" not in found:
            out.append({"root": found["worktree"], "revision": found.get("HEAD", ""), "branch": found.get("branch", "").removeprefix("refs/heads/")})
    return out


def observe(spark: SparkSession, folder: str, at: int) -> tuple[DataFrame, DataFrame]:
    """The resource that a folder is, one row, and its views: a plain folder, or the worktrees of its repository.

    The driver asks; there are as many rows as worktrees.
    """
    folder = os.path.realpath(folder)

    def git(where: str, *args: str) -> str | None:
        done = subprocess.run(["git", "-C", where, *args], capture_output=True, text=True, timeout=10, check=False)
        return done.stdout if done.returncode == 0 else None

    common = git(folder, "rev-parse", "--path-format=absolute", "--git-common-dir")
    if common is None:
        kind, place, views = "local", folder, [(folder, None, None, False, os.path.isdir(folder))]
    else:
        kind, place = "git", (git(folder, "config", "--get", "remote.origin.url") or common).strip()
        views = []
        for w in observed_worktrees(git(folder, "worktree", "list", "--porcelain") or ""):
            there = os.path.isdir(w["root"])
            views.append((w["root"], w["branch"] or None, w["revision"], bool(there and (git(w["root"], "status", "--porcelain") or "").strip()), there))
    resource = spark.createDataFrame([(kind, os.path.basename(folder) or folder, place)], "provider string, label string, identity string")
    resource = resource.select(identity("resource", F.col("provider"), F.col("identity")).alias("id"), "provider", "label", "identity")
    rows = spark.createDataFrame(views, "root string, branch string, revision string, dirty boolean, available boolean").crossJoin(resource.select(F.col("id").alias("resource_id")))  # one resource
    return resource, rows.select(identity("view", F.col("resource_id"), F.col("root")).alias("id"), "resource_id", "root", "branch", "revision", "dirty", "available", F.lit(at).cast("long").alias("observed_at"))


def workspace_saved(state: State, resources: DataFrame, views: DataFrame) -> dict[str, DataFrame]:
    return {"resources": upsert(state["resources"], resources.select(*state["resources"].columns), ["id"]), "views": upsert(state["views"], views.select(*state["views"].columns), ["id"])}


def observations_saved(state: State, seen: DataFrame) -> dict[str, DataFrame]:
    """Resources that no project has yet, the last sight of each."""
    return {"observations": upsert(state["observations"], seen.select(*state["observations"].columns), ["id"])}


def assigned(state: State, observation: str) -> dict[str, DataFrame]:
    """An observation as a resource of the project with a view of its root."""
    one = state["observations"].where(F.col("id") == observation)
    if one.isEmpty():
        raise LookupError(f"no observation {observation!r}")
    view = one.select(identity("view", F.col("id"), F.col("root")).alias("id"), F.col("id").alias("resource_id"), "root", F.lit(False).alias("dirty"), F.lit(True).alias("available"), "observed_at", F.lit(None).cast("string").alias("branch"), F.lit(None).cast("string").alias("revision"))
    return workspace_saved(state, one, view) | {"observations": state["observations"].where(F.col("id") != observation)}


def unassigned(state: State, resource: str) -> dict[str, DataFrame]:
    """A resource and its views go; sessions in them stay, without a view."""
    gone = state["views"].where(F.col("resource_id") == resource).select(F.col("id").alias("view_id"), F.lit(True).alias("gone"))
    sessions = state["sessions"].join(gone, "view_id", "left").withColumn("view_id", F.when(F.col("gone").isNull(), F.col("view_id"))).select(*state["sessions"].columns)
    return {"resources": state["resources"].where(F.col("id") != resource), "views": state["views"].where(F.col("resource_id") != resource), "sessions": sessions}


def nested(parents: DataFrame, children: DataFrame, key: str, parent: str, name: str, order: list[str]) -> DataFrame:
    """parents(id, …) with an array of their children's rows, in order, empty where there are none."""
    rest = [c for c in children.columns if c not in (parent, *order)]
    rows = children.groupBy(parent).agg(F.sort_array(F.collect_list(F.struct(*order, *rest))).alias(name)).withColumnRenamed(parent, "_parent")
    out = parents.join(rows, F.col(key) == F.col("_parent"), "left").drop("_parent")
    return out.withColumn(name, F.coalesce(name, F.array().cast(rows.schema[name].dataType)))


def without_parent(children: DataFrame, parents: DataFrame, parent: str, key: str) -> DataFrame:
    """Children whose parent is null or not known."""
    return children.join(parents.select(F.col(key).alias(parent)), parent, "left_anti")


def workspace(state: State) -> tuple[DataFrame, DataFrame]:
    """Resources with their views, sessions and deliveries as one nested row each, and the sessions of no known view."""
    sessions = nested(state["sessions"], state["deliveries"], "id", "session_id", "deliveries", ["delivered_at", "key", "hash"])
    views = nested(state["views"], sessions, "id", "view_id", "sessions", ["updated_at", "id"])
    return nested(state["resources"], views, "id", "resource_id", "views", ["observed_at", "root"]), without_parent(sessions, state["views"], "view_id", "id")
