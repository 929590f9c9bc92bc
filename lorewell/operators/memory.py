"""Durable memories: validation, saving in batches, reconciling, reviews. Each change takes a state and gives the tables that it changes."""

from __future__ import annotations

import json
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import memory_hash, node_id, trim_space
from ..state import State
from .graph import RELATIONS, link
from .records import upsert

# What a key looks like, and the kind of node that each kind of memory becomes.
KEY = r"^[A-Za-z0-9][A-Za-z0-9_-]*(\.[A-Za-z0-9][A-Za-z0-9_-]*)*$"
#: The same with white space of any script around it and 255 characters at most, all ASCII; a longer run fails where it is too long.
TRIMMED_KEY = r"(?U)^\s*+(?=[A-Za-z0-9_.-]{1,255}+(?![A-Za-z0-9_.-]))" + KEY.strip("^$") + r"\s*+\z"
NODE_KINDS = {"note": "knowledge", "decision": "intent", "reference": "reference"}
#: Proposals of one reconciliation.
MOST = 20


class Conflict(ValueError):
    """A memory is not what the change expects; nothing was changed."""


def valid_key(key: Column) -> Column:
    """Whether a key, trimmed, is a dotted address of at most 255 bytes."""
    return F.coalesce(key.rlike(TRIMMED_KEY), F.lit(False))


def checked_key(key: str) -> str:
    key = key.strip()
    if len(key.encode()) > 255 or not re.fullmatch(KEY.strip("^$"), key):
        raise ValueError("a key is a dotted address of letters, digits, dashes and underscores, 255 bytes at most")
    return key


def node_kind(kind: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for memory, node in NODE_KINDS.items():
        out = out.when(kind == memory, F.lit(node))
    return out


def memories(entries: DataFrame) -> DataFrame:
    """entries(key, kind, value, source) trimmed, kind note by default, with hash and error: null, or why an entry is none."""
    e = entries.select(trim_space(F.col("key")).alias("key"), F.coalesce(F.nullif("kind", F.lit("")), F.lit("note")).alias("kind"), trim_space(F.col("value")).alias("value"), trim_space(F.col("source")).alias("source"))
    error = (
        F.when(~valid_key(F.col("key")), "key is not a dotted address")
        .when(~F.col("kind").isin(*NODE_KINDS), "unsupported kind")
        .when(F.col("value").isNull() == F.col("source").isNull(), "exactly one of value and source is required")
        .when(F.coalesce("value", "source") == "", "value or source is empty")
    )
    return e.withColumn("hash", memory_hash(F.col("kind"), F.col("value"), F.col("source"))).withColumn("error", error)


def _refuse(entries: DataFrame) -> None:
    bad = entries.where("error IS NOT NULL").select("key", "error").first()
    if bad:
        raise ValueError(f"memory {bad.key!r}: {bad.error}")


def under(df: DataFrame, prefix: str) -> DataFrame:
    """Rows whose key is a prefix or lies below it; all for an empty one. Below it case does not count, as is usual in LIKE."""
    if not prefix:
        return df
    return df.where((F.col("key") == prefix) | F.startswith(F.lower("key"), F.lit(prefix.lower() + ".")))


def save(state: State, entries: DataFrame, at: int) -> tuple[DataFrame, dict[str, DataFrame]]:
    """entries(key, kind, value, source), one for each key: (key, action, number), and the tables changed.

    action is created, updated or unchanged, by hash; number is the new version's. What is unchanged still refreshes
    its node. A memory of another kind of node than before loses the old node with its edges.
    """
    made = memories(entries)
    _refuse(made)
    now = state["memories"].select("key", F.col("kind").alias("old_kind"), F.col("hash").alias("old_hash"))
    before = state["versions"].groupBy("key").agg(F.max("number").alias("last"))
    met = made.drop("error").join(now, "key", "left").join(before, "key", "left")
    met = met.withColumn("action", F.when(F.col("old_hash").isNull(), "created").when(F.col("old_hash") == F.col("hash"), "unchanged").otherwise("updated"))
    met = met.withColumn("number", F.when(F.col("action") != "unchanged", F.coalesce("last", F.lit(0)) + 1))
    changed = met.where("action <> 'unchanged'")
    kind = node_kind(F.col("kind"))
    fresh = met.select(
        node_id(kind, F.col("key")).alias("id"), F.col("key").alias("label"), kind.alias("kind"), F.col("kind").alias("subkind"), F.col("key").alias("ref"), F.lit("durable").alias("owner"), F.lit("active").alias("state"),
        F.lit("memory").alias("provenance"), F.coalesce("value", "source", F.lit("")).alias("content"),
    )
    old = state["nodes"].select("id", "material_id", "material_uri", "locator")
    fresh = fresh.join(old, "id", "left").select(*state["nodes"].columns)
    moved = met.where(node_kind(F.col("old_kind")) != kind).select(node_id(node_kind(F.col("old_kind")), F.col("key")).alias("id"))
    return met.select("key", "action", "number"), {
        "memories": upsert(state["memories"], changed.select("key", "kind", "value", "source", "hash", F.lit(at).cast("long").alias("updated_at")), ["key"]),
        "versions": state["versions"].unionByName(changed.select("key", "number", "kind", "value", "source", "hash", F.lit(at).cast("long").alias("created_at"))),
        "nodes": upsert(state["nodes"].join(moved, "id", "left_anti"), fresh, ["id"]),
        "edges": without_nodes(state["edges"], moved),
    }


def without_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """edges but for those that touch a node of gone(id)."""
    return edges.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti").select(*edges.columns)


def history(state: State, key: str) -> DataFrame:
    """The versions of a memory, newest first."""
    return state["versions"].where(F.col("key") == key).orderBy(F.desc("number"))


class Link(NamedTuple):
    relation: str
    ref: str


class Proposal(NamedTuple):
    """A memory to save: what hash it must have now (None: it must not exist), evidence and links to materials."""

    key: str
    kind: str | None = None
    value: str | None = None
    source: str | None = None
    expected: str | None = None
    evidence: tuple[str, ...] = ()
    links: tuple[Link, ...] = ()


def reconcile(state: State, session: str, proposals: list[Proposal], at: int) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Save 1 to MOST proposals and their links, all or, if the hash of any is not as expected (Conflict), none.

    What changed is written down as one row of the audit table, with the evidence; nothing changed, no row.
    """
    if not session.strip() or not 1 <= len(proposals) <= MOST:
        raise ValueError(f"a session and 1 to {MOST} proposals are required")
    if len({p.key for p in proposals}) < len(proposals):
        raise ValueError("proposals must have different keys")
    for p in proposals:
        if p.links and not p.evidence:
            raise ValueError("links need evidence")
        if p.links and p.kind != "decision" or any(x.relation not in RELATIONS or not x.ref.strip() for x in p.links):
            raise ValueError("links lead from a decision to material by a known relation")
    spark = state["memories"].sparkSession
    entries = spark.createDataFrame([(p.key, p.kind, p.value, p.source, p.expected) for p in proposals], "key string, kind string, value string, source string, expected string")
    now = state["memories"].select("key", F.col("hash").alias("now"))
    if not entries.join(now, "key", "left").where(~F.col("expected").eqNullSafe(F.col("now"))).isEmpty():
        raise Conflict("a memory has changed since it was read")
    results, changes = save(state, entries, at)
    rows = {r.key: r for r in results.collect()}  # MOST at most
    after = {**state, **changes}
    links = []
    for p in proposals:
        for x in p.links:
            created, changed = link(after, ("intent", p.key), ("material", x.ref), x.relation, f"reconcile:{session}")
            after |= changed
            if created:
                links.append({"source": p.key, "relation": x.relation, "target": x.ref, "evidence": p.evidence})
    new = [{"key": p.key, "action": rows[p.key].action, "version": rows[p.key].number, "expected": p.expected, "evidence": p.evidence} for p in proposals if rows[p.key].action != "unchanged"]
    if new or links:
        row = spark.createDataFrame([(session, json.dumps({"changes": new, "links": links}, ensure_ascii=False), at)], "session_id string, changes string, created_at long")
        after["audit"] = state["audit"].unionByName(row)
    return results, {k: v for k, v in after.items() if v is not state.get(k)}


def batch(changes: str) -> list[dict]:
    """The changes of a JSON document {"changes": [...]} or a list, 1 MiB at most; expectedHash null and absent are told apart."""
    if len(changes.encode()) > 1 << 20:
        raise ValueError("a batch has 1 MiB at most")
    found = json.loads(changes)
    rows = found["changes"] if isinstance(found, dict) else found
    return [{k: x.get(k) for k in ("key", "kind", "value", "source")} | {"expected": x.get("expectedHash"), "expected_set": "expectedHash" in x} for x in rows]


def preview(state: State, changes: DataFrame, apply: bool = False) -> DataFrame:
    """changes(key, kind, value, source, expected, expected_set) against the memories: key, action, current_hash, proposed_hash.

    Where they are to be applied, a change whose expectation is not there or not met is a conflict.
    """
    made = memories(changes)
    _refuse(made)
    if not made.groupBy("key").count().where("count > 1").isEmpty():
        raise ValueError("a batch names a key twice")
    asked = changes.select(trim_space(F.col("key")).alias("key"), "expected", F.coalesce("expected_set", F.lit(False)).alias("expected_set"))
    met = made.join(asked, "key").join(state["memories"].select("key", F.col("hash").alias("current_hash")), "key", "left")
    action = F.when(F.col("current_hash").isNull(), "created").when(F.col("current_hash") == F.col("hash"), "unchanged").otherwise("updated")
    if apply:
        action = F.when(~F.col("expected_set") | ~F.col("expected").eqNullSafe(F.col("current_hash")), "conflict").otherwise(action)
    return met.select("key", action.alias("action"), "current_hash", F.col("hash").alias("proposed_hash"))


def apply_batch(state: State, changes: DataFrame, at: int) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The preview of an application, and the tables changed: none if there is a conflict."""
    shown = preview(state, changes, apply=True)
    if not shown.where("action = 'conflict'").isEmpty():
        return shown, {}
    return shown, save(state, changes, at)[1]


def retried(folder, session: str, make, at: int) -> DataFrame:
    """reconcile() of what make(state) proposes, saved; after a conflict the state is read and the proposals made once more."""
    for last in (False, True):
        version = folder.version()
        state = folder.load(version)
        try:
            results, changes = reconcile(state, session, make(state), at)
            folder.save(changes, version)
            return results
        except Conflict:
            if last:
                raise


def delete(state: State, key: str) -> tuple[bool, dict[str, DataFrame]]:
    """A memory without its node, the node's edges and its record; versions stay. False if there is none."""
    gone = state["memories"].where(F.col("key") == key)
    if gone.isEmpty():
        return False, {}
    nodes = gone.select(node_id(node_kind(F.col("kind")), F.col("key")).alias("id"))
    return True, {"memories": state["memories"].where(F.col("key") != key), "nodes": state["nodes"].join(nodes, "id", "left_anti"), "edges": without_nodes(state["edges"], nodes)}


def confirm(state: State, key: str, at: int) -> tuple[bool, dict[str, DataFrame]]:
    """A memory counts as looked at now, and its open reviews are resolved as kept. False if there is none."""
    if state["memories"].where(F.col("key") == key).isEmpty():
        return False, {}
    touched = F.when(F.col("key") == key, F.lit(at)).otherwise(F.col("updated_at")).cast("long")
    return True, {"memories": state["memories"].withColumn("updated_at", touched), "reviews": _resolved(state["reviews"], (F.col("key") == key), "keep", None, at)}


def _resolved(reviews: DataFrame, which: Column, outcome: str, version: int | None, at: int) -> DataFrame:
    hit = which & (F.col("status") == "open")
    put = {"status": "resolved", "outcome": outcome, "version": version, "resolved_at": at}
    return reviews.select(*[F.when(hit, F.lit(put[c]).cast(reviews.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in put else F.col(c) for c in reviews.columns])


REVIEW = ["key", "source_type", "source_id", "content_hash"]
#: The longest texts that name a review, in bytes.
LIMITS = {"source_type": 64, "source_id": 1024, "content_hash": 128, "reason": 4096}


def ask_reviews(state: State, asked: DataFrame, at: int) -> dict[str, DataFrame]:
    """Open reviews for asked(key, source_type, source_id, content_hash, reason) of memories that exist.

    A review that is there already is neither added nor opened again. An empty or overlong text, or a memory that
    does not exist, is an error.
    """
    new = asked.select(trim_space(F.col("key")).alias("key"), *[trim_space(F.col(c)).alias(c) for c in LIMITS])
    bad = F.lit(False)
    for c, n in LIMITS.items():
        bad = bad | (F.coalesce(F.octet_length(c), F.lit(0)) == 0) | (F.octet_length(c) > n)
    if not new.where(bad).isEmpty():
        raise ValueError("a review needs source type, source, content hash and reason within their limits")
    if not new.join(state["memories"], "key", "left_anti").isEmpty():
        raise ValueError("a review needs a memory that exists")
    return {"reviews": state["reviews"].unionByName(first_of(new, REVIEW, "reason").join(state["reviews"], REVIEW, "left_anti").select(*new.columns, F.lit("open").alias("status"), F.lit(at).cast("long").alias("created_at")), allowMissingColumns=True)}


def first_of(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(value).alias(value)).select(*df.columns)


def resolve_review(state: State, review: tuple[str, str, str, str], outcome: str, version: int | None, at: int) -> tuple[bool, dict[str, DataFrame]]:
    """An open review (REVIEW) resolved as keep or change; change names a version of the same memory. False if none is open."""
    if outcome not in ("keep", "change") or outcome == "change" and version is None:
        raise ValueError("an outcome is keep, or change with a version")
    which = F.lit(True)
    for c, x in zip(REVIEW, review, strict=True):
        which = which & (F.col(c) == x)
    if state["reviews"].where(which & (F.col("status") == "open")).isEmpty():
        return False, {}
    if version is not None and state["versions"].where((F.col("key") == review[0]) & (F.col("number") == version)).isEmpty():
        raise ValueError("the version is none of this memory")
    return True, {"reviews": _resolved(state["reviews"], which, outcome, version, at)}


def of_status(df: DataFrame, status: str, newest: str = "created_at") -> DataFrame:
    """Requests or reviews of a status (open, resolved, or empty for all), newest first."""
    status = status.strip().lower()
    if status not in ("", "open", "resolved"):
        raise ValueError("a status is open or resolved")
    rest = [c for c in df.columns if c != newest]
    return (df.where(F.col("status") == status) if status else df).orderBy(F.desc(newest), *rest)
