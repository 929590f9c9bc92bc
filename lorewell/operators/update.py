"""Keeping a project's graph up to date with its files: what changed is read again, the rest is kept."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import kept
from ..functions.text import identity, material_id, node_id
from ..sources import files
from ..state import State
from .graph import EDGE, given, resolve_claims
from .records import snapshot_diff, upsert

#: What of a material tells that it must be read again.
COMPARED = ["content_hash", "media_type", "processor"]
# The reader of each media type, by version; a new version reads all its files again.
READERS = {"text/markdown": "markdown/v1", "text/x-go": "go/v1"}
AS_TEXT = ("application/json", "application/yaml", "application/xml")


def processor(media_type: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for kind, name in READERS.items():
        out = out.when(media_type == kind, F.lit(name))
    out = out.when(media_type.isin([k for k in files.DECLARATIONS if k not in READERS]), F.lit("source-declarations/v1"))
    return out.when(F.startswith(media_type, F.lit("text/")) | media_type.isin(*AS_TEXT), F.lit("text/v1")).otherwise("catalog/v1")


#: What an observed node has beside the columns that publishing sets.
NODE = ["material_id", "id", "label", "kind", "subkind", "ref", "material_uri", "locator", "content"]


def facts(materials: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and claims of materials(id, uri, media_type, processor) with texts(material_id, text), each read by its processor.

    Every material is a node itself, named after its file; Markdown adds sections, sources add declarations and, in
    Go, calls: these are knowledge. A material without a text, or with one that cannot be read, is that node only. A
    section and another of the same label and occurrence in a deeper or higher level share an id: the last one stays.
    """
    # A file's scan says nothing of how large the texts are that are made of it: they are never sent to the driver.
    met = kept(materials.select(F.col("id").alias("material_id"), "uri", "media_type", "processor").join(texts.hint("merge"), "material_id", "left"))
    own = node_id(F.lit("material"), F.col("uri"))
    marked = kept(files.markdown(met.where("processor = 'markdown/v1' AND text IS NOT NULL").select("material_id", "text")))
    before = marked.where("line = 0").select("material_id", F.col("content").alias("before"))
    whole = F.when(F.col("processor") == "text/v1", F.coalesce("text", F.lit(""))).otherwise(F.coalesce("before", F.lit("")))
    label = F.regexp_replace(F.regexp_replace(F.substring_index("uri", "/", -1), "^resource:.*?/file:", ""), "^file:", "")
    root = met.join(before, "material_id", "left").select("material_id", own.alias("id"), label.alias("label"), F.lit("material").alias("kind"), F.lit("").alias("subkind"), F.col("uri").alias("ref"), F.col("uri").alias("material_uri"), F.lit("").alias("locator"), whole.alias("content"))
    address = met.select("material_id", F.col("uri").alias("material_uri"), own.alias("root")).hint("merge")
    claim = lambda rows, source, target, name, relation: rows.select("material_id", source.alias("source_id"), target.alias("target_id"), name.alias("target"), F.lit(relation).alias("relation"))

    def known(rows: DataFrame, subkind, text) -> DataFrame:
        """Knowledge of rows(material_id, material_uri, ref, label, line): its last line counts where it stands twice."""
        last = F.max_by(F.struct("label", subkind.alias("subkind"), F.concat(F.lit("line:"), F.col("line").cast("string")).alias("locator"), text.alias("content")), "line")
        made = rows.groupBy("material_id", "material_uri", "ref").agg(last.alias("x"))
        return made.select("material_id", node_id(F.lit("knowledge"), F.col("ref")).alias("id"), "x.label", F.lit("knowledge").alias("kind"), "x.subkind", "ref", "material_uri", "x.locator", "x.content")

    heads = files.occurrence(marked.where("line > 0"), ["material_id", "level", "label"], "line")
    heads = heads.withColumn("ref", identity("entity", F.col("material_id"), "section", F.col("label"), F.col("occurrence"))).join(address, "material_id")
    parents = heads.select("material_id", F.col("line").alias("parent_line"), node_id(F.lit("knowledge"), F.col("ref")).alias("parent"))
    inside = claim(heads.join(parents, ["material_id", "parent_line"], "left"), F.coalesce("parent", "root"), node_id(F.lit("knowledge"), F.col("ref")), F.lit(""), "contains")
    code = met.where("processor IN ('source-declarations/v1', 'go/v1') AND text IS NOT NULL").select("material_id", "media_type", "text")
    found = kept(files.declarations(code).join(address, "material_id"))
    self = node_id(F.lit("knowledge"), F.col("ref"))
    holds = claim(found, F.col("root"), self, F.lit(""), "contains")
    calls = claim(found.select("*", F.explode("calls").alias("call")), self, F.lit(""), F.col("call"), "calls")
    nodes = root.unionByName(known(heads, F.lit("section"), F.col("content"))).unionByName(known(found, F.col("kind"), F.lit("")))
    return nodes, inside.unionByName(holds).unionByName(calls).distinct()


def warnings(materials: DataFrame, texts: DataFrame) -> DataFrame:
    """(uri, reason) of the materials, as facts() takes them, that should have been read and could not be."""
    met = materials.where("processor <> 'catalog/v1'").select(F.col("id").alias("material_id"), "uri", "media_type").join(texts, "material_id", "left")
    return files.unreadable(met).join(met.select("material_id", "uri"), "material_id").select("uri", "reason")


def publish(state: State, materials: DataFrame, nodes: DataFrame, claims: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """The tables after a snapshot of what is observed.

    Observed nodes that a durable edge touches stay as durable and missing, without their place and content; other
    observed ones go with their edges. New nodes are observed and active, also where they were missing. Durable edges
    stay and win over new ones of the same ends and relation. Materials and claims are replaced.
    """
    durable = state["edges"].where("owner = 'durable'")
    touched = durable.select(F.col("source_id").alias("id")).unionByName(durable.select(F.col("target_id").alias("id"))).distinct()
    blank = {"owner": "durable", "state": "missing", "provenance": "durable-link", "material_id": "", "locator": "", "content": ""}
    held = state["nodes"].where("owner = 'observed'").join(touched, "id", "left_semi").withColumns({c: F.lit(v) for c, v in blank.items()})
    fresh = nodes.select("id", "label", "kind", "subkind", F.coalesce(F.nullif("ref", F.lit("")), "id").alias("ref"), F.lit("observed").alias("owner"), F.lit("active").alias("state"), F.col("material_uri").alias("provenance"), "material_id", "material_uri", "locator", "content")
    now = kept(upsert(state["nodes"].where("owner = 'durable'").unionByName(held.select(*state["nodes"].columns)), fresh, ["id"]))  # its ids are needed twice more
    new = edges.select(*EDGE).distinct().join(durable, EDGE, "left_anti").select(*EDGE, F.lit("observed").alias("owner"), F.lit("update").alias("provenance"))
    ids = now.select("id")
    links = durable.unionByName(new).join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return {"materials": materials.select(*state["materials"].columns), "nodes": now, "claims": claims.select(*state["claims"].columns), "edges": links.select(*state["edges"].columns)}


def update(state: State, observed: DataFrame, texts: DataFrame) -> tuple[dict[str, int], dict[str, DataFrame]]:
    """The counts of added, modified, unchanged and removed materials, and the tables after an update.

    observed has the materials that are there now (as files.discover gives them), texts(material_id, text) the texts
    of those that changed at least. Facts of unchanged ones are kept, others are read; claims are resolved anew where
    what changed can have changed their end.
    """
    now = observed.withColumn("processor", processor(F.col("media_type"))).select(*state["materials"].columns)
    diff = kept(snapshot_diff(state["materials"], now, "id", COMPARED))
    counts = {s: 0 for s in ("added", "modified", "unchanged", "removed")} | {r.status: r["count"] for r in diff.groupBy("status").count().collect()}
    changed = now.join(diff.where("status IN ('added', 'modified')"), "id", "left_semi")
    nodes, claims = map(kept, facts(changed, texts))
    claims = claims.select(*state["claims"].columns)
    same = diff.where("status = 'unchanged'").select(F.col("id").alias("material_id"), F.lit(True).alias("same")).hint("merge")
    parted = lambda df: kept(df.join(same, "material_id", "left").withColumn("same", F.col("same").isNotNull()))
    observed_nodes = state["nodes"].where("owner = 'observed'").select(*NODE)
    all_nodes = observed_nodes.join(same, "material_id", "left_semi").unionByName(nodes.select(*NODE))
    bare, before = parted(observed_nodes.select("material_id", "id", "label")), parted(state["claims"].select(*claims.columns))
    of = lambda df, kind: df.where("same" if kind else "NOT same").drop("same")
    fresh = nodes.select("id", "label")
    stand, gone = (of(bare, x).select("id", "label") for x in (True, False))
    old_claims = of(before, True)
    edges = resolved_again(state["edges"], stand.unionByName(fresh), gone.unionByName(fresh), old_claims, of(before, False), claims)
    return counts, publish(state, now, all_nodes, old_claims.unionByName(claims), edges)


def resolved_again(edges: DataFrame, nodes: DataFrame, touched: DataFrame, old: DataFrame, lost: DataFrame, new: DataFrame) -> DataFrame:
    """The edges of claims old and new, as resolve_claims() gives them for all nodes, worked out for what changed only.

    edges are those of claims old and lost; touched are the nodes that came or went. A source is done again if it
    lost or got a claim, or if one of its claims names a touched label, what follows the last point of one, or a
    touched id: all its claims are then resolved. The other sources keep their observed edges.
    """
    tail = F.when(F.contains("label", F.lit(".")), F.substring_index("label", ".", -1))
    ways = lambda *pairs: F.explode(F.array(*[F.struct(F.lit(by_id).alias("by_id"), name.alias("name")) for by_id, name in pairs])).alias("way")
    named = touched.select(ways((False, F.col("label")), (False, tail), (True, F.col("id")))).select("way.*").where("name IS NOT NULL").distinct()
    asked = old.select("source_id", ways((False, F.when(~given(), F.col("target"))), (True, F.col("source_id")), (True, F.when(given(), F.col("target_id"))))).select("source_id", "way.*").where("name IS NOT NULL")
    hit = asked.join(named, ["by_id", "name"], "left_semi").select("source_id")
    sources = kept(hit.unionByName(lost.select("source_id")).unionByName(new.select("source_id")).distinct())
    again = kept(old.unionByName(new).join(sources, "source_id", "left_semi"))
    still = edges.where("owner = 'observed'").join(sources, "source_id", "left_anti").select(*EDGE)
    return still.unionByName(resolve_claims(nodes, again))


def update_folder(state: State, root: str, resource: str | None = None) -> tuple[dict[str, int], dict[str, DataFrame]]:
    """update() from the files below root, which tasks must be able to read; addresses are scoped by the resource, if any."""
    spark = state["nodes"].sparkSession
    found = kept(files.discover(spark, root))  # what was seen, whatever becomes of the files
    paths = F.regexp_replace("uri", "^file:", "")
    if resource:
        uri = files.scoped(F.col("uri"), F.lit(resource))
        found = found.withColumn("path", paths).withColumn("uri", uri).withColumn("id", material_id(uri))
    else:
        found = found.withColumn("path", paths)
    now = found.withColumn("processor", processor(F.col("media_type")))
    diff = snapshot_diff(state["materials"], now.select(*state["materials"].columns), "id", COMPARED).where("status IN ('added', 'modified')")
    wanted = now.join(diff, "id", "left_semi").where("processor <> 'catalog/v1'").select(F.col("id").alias("material_id"), "path", "processor")
    return update(state, found.drop("path"), files.read_texts(wanted, os.path.realpath(root)))
