"""The property graph: resolving claims, neighborhoods, shortest paths, topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import kept
from ..functions.text import node_id, topic_path

EDGE = ["source_id", "target_id", "relation"]
# Kinds of nodes that links may join, and relations from an intent to material.
LINK_KINDS = ("intent", "material", "knowledge", "reference")
RELATIONS = ("applies_to", "realized_by", "verified_by", "contradicted_by")


def context(nodes: DataFrame) -> DataFrame:
    """nodes with path, the dotted address of durable ones and the material's address of others; missing ones stay."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return nodes.withColumn("path", topic_path(F.col("owner"), F.col("kind"), F.col("ref"), blank("material_uri"), blank("locator")))


def in_order(nodes: DataFrame) -> DataFrame:
    """A graph's nodes: intents first, then by label."""
    return nodes.orderBy((F.col("kind") != "intent"), "label", "id")


def find(nodes: DataFrame, query: str) -> DataFrame:
    """The node of a context that a query names, one row at most, with its tier.

    The tiers: 1 id, label or path; 2 a material's address; 3 an address with a place in it; 4 text within label,
    kind, address, place or content, whatever its case. In the first tier that has any, the first node in order.
    """
    q = query.strip()
    if not q:
        return nodes.withColumn("tier", F.lit(0)).limit(0)
    c = lambda name: F.coalesce(F.col(name), F.lit(""))
    hay = F.lower(F.concat_ws(" ", *map(c, ("label", "kind", "material_uri", "locator", "content"))))
    tier = (
        F.when((F.col("id") == q) | (c("label") == q) | (c("path") == q), 1)
        .when((c("kind") == "material") & (c("material_uri") == q), 2)
        .when((c("material_uri") != "") & (c("locator") != "") & (F.concat_ws("#", "material_uri", "locator") == q), 3)
        .when(F.contains(hay, F.lit(q.lower())), 4)
    )
    return nodes.withColumn("tier", tier).where("tier IS NOT NULL").orderBy("tier", (c("kind") != "intent"), "label", "id").limit(1)


def link(state, source: tuple[str, str], target: tuple[str, str], relation: str, provenance: str) -> tuple[bool, dict[str, DataFrame]]:
    """A durable edge between two nodes (kind, ref) of a state; whether it is new, and the tables changed.

    An end that is not there becomes a durable node that is missing; an observed edge is promoted.
    """
    if any(k not in LINK_KINDS or not r.strip() for k, r in (source, target)) or not relation.strip():
        raise ValueError("a link needs two kinds, two references and a relation")
    if (source[0], target[0]) == ("intent", "material") and relation not in RELATIONS:
        raise ValueError("no relation of an intent to material")
    nodes, edges, spark = state["nodes"], state["edges"], state["nodes"].sparkSession
    ends = spark.createDataFrame([(i, *e) for i, e in enumerate((source, target))], "end int, kind string, ref string")
    met = ends.join(nodes.select("kind", "ref", "id"), ["kind", "ref"], "left").groupBy("end", "kind", "ref").agg(F.min("id").alias("id"))
    rows = {r.end: r for r in met.withColumn("own", node_id(F.col("kind"), F.col("ref"))).collect()}
    ids = [rows[i].id or rows[i].own for i in (0, 1)]
    new = list({(rows[i].own, rows[i].kind, rows[i].ref) for i in (0, 1) if rows[i].id is None})
    changes = {}
    if new:
        fresh = spark.createDataFrame([(i, r, k, r, "durable", "missing", provenance) for i, k, r in new], "id string, label string, kind string, ref string, owner string, state string, provenance string")
        changes["nodes"] = nodes.unionByName(fresh, allowMissingColumns=True)
    same = (F.col("source_id") == ids[0]) & (F.col("target_id") == ids[1]) & (F.col("relation") == relation)
    owners = {r.owner for r in edges.where(same).select("owner").collect()}
    if "durable" in owners:
        return False, changes
    row = spark.createDataFrame([(*ids, relation, "durable", provenance)], edges.schema)
    changes["edges"] = (edges.where(~same) if owners else edges).unionByName(row)
    return True, changes


def given() -> Column:
    """Whether a claim gives the id of its target; only if not, the target's name counts."""
    return F.coalesce("target_id", F.lit("")) != ""


def resolve_claims(nodes: DataFrame, claims: DataFrame) -> DataFrame:
    """Edges from claims (source_id, target_id or target, relation): an id given, or a label that one node alone has.

    Only a label that no node has is tried as what follows the last point of a label. Loops and unknown ends go.
    Labels are looked for once for each name, however many claims have it, and only by claims that give no id.
    """
    named = claims.where(~given())
    tail = F.when(F.contains("label", F.lit(".")), F.substring_index("label", ".", -1))
    bearers = nodes.select("id", F.posexplode(F.array("label", tail)).alias("place", "target")).join(named.select("target").distinct(), "target", "left_semi")
    # an id that is both the least and the greatest is the only one; place 0 is the label
    ends = lambda place: [end(F.when(F.col("place") == place, F.col("id"))).alias(f"{name}{place}") for name, end in (("least", F.min), ("most", F.max))]
    by_name = bearers.groupBy("target").agg(F.min("place").alias("place"), *ends(0), *ends(1))
    only = lambda place: F.when(F.col(f"least{place}") == F.col(f"most{place}"), F.col(f"least{place}"))
    one = by_name.select("target", F.when(F.col("place") == 0, only(0)).otherwise(only(1)).alias("target_id")).where("target_id IS NOT NULL")
    ids = lambda end: nodes.select(F.col("id").alias(end))
    edges = claims.where(given()).select(*EDGE).join(ids("target_id"), "target_id", "left_semi").select(*EDGE)
    edges = edges.unionByName(named.select("source_id", "target", "relation").join(one, "target").select(*EDGE))
    return edges.where("source_id <> target_id").join(ids("source_id"), "source_id", "left_semi").select(*EDGE).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """(at, next, edge): each edge from either end; edge orders neighbours by source, target and relation."""
    edge = F.struct(*EDGE).alias("edge")
    return edges.select(F.col("source_id").alias("at"), F.col("target_id").alias("next"), edge).unionByName(edges.select(F.col("target_id").alias("at"), F.col("source_id").alias("next"), edge))


def hop_distances(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(id, hops) of every node within depth hops of seeds(id), edges read both ways; one join and one anti join a hop."""
    ways = both_ways(edges).select("at", "next").distinct()
    seen = frontier = kept(seeds.select("id").distinct().withColumn("hops", F.lit(0)))
    for level in range(1, depth + 1):
        frontier = frontier.join(ways, frontier["id"] == ways["at"]).select(F.col("next").alias("id")).distinct()
        frontier = kept(frontier.join(seen, "id", "left_anti").withColumn("hops", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def neighborhood(edges: DataFrame, seeds: list[str], depth: int, limit: int) -> list[str]:
    """Ids in the order in which they are selected, limit at most: each seed with its neighbours, then level by level.

    What is selected is bounded by limit, so its ids are literals that a scan of the edges filters on; dedup, order
    and limit of what is found next stay in Spark, however many neighbours a node has.
    """
    ways, ordered = both_ways(edges), []

    def found(frontier: list[str], room: int, own: list[str]) -> list[str]:
        spot = F.create_map(*[F.lit(x) for i, n in enumerate(frontier) for x in (n, i)])
        hits = ways.where(F.col("at").isin(frontier)).select(F.col("next").alias("id"), F.struct(spot[F.col("at")].alias("p"), F.lit(1).alias("q"), F.col("edge").alias("edge")).alias("place"))
        none = F.lit(None).cast(ways.schema["edge"].dataType)
        if own:
            rows = edges.sparkSession.createDataFrame([(n, i) for i, n in enumerate(own)], "id string, p int")
            hits = hits.unionByName(rows.select("id", F.struct("p", F.lit(0).alias("q"), none.alias("edge")).alias("place")))
        if ordered:
            hits = hits.where(~F.col("id").isin(ordered))
        return [r.id for r in hits.groupBy("id").agg(F.min("place").alias("place")).orderBy("place").limit(room).collect()]

    if not seeds or limit <= 0:
        return []
    seeds = list(dict.fromkeys(seeds))[:limit]
    ordered = frontier = found(seeds, limit, seeds)
    for _ in range(1, depth):
        if not frontier or len(ordered) >= limit:
            break
        frontier = found(frontier, limit - len(ordered), [])
        ordered = ordered + frontier
    return ordered


def induced(edges: DataFrame, ids: list[str]) -> DataFrame:
    """The edges whose two ends are among ids, a bounded selection."""
    return edges.where(F.col("source_id").isin(ids) & F.col("target_id").isin(ids))


def shortest_path(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(step, source_id, target_id, relation): the first shortest path in breadth-first order, edges read both ways.

    However long it is; no rows if there is none. Nodes are found level by level from both ends, always at the end whose
    last level is smaller, until the last levels meet: a node with very many neighbours at one end is only read if the
    other end has more. Breadth-first order takes of all shortest paths the one whose edges come first, step by step, so
    the path is then read off: of each level the nodes that lead on, and at each step the first edge to one of them.
    """
    if source == target:
        raise ValueError("a path needs two different nodes")
    ways, spark = both_ways(edges), edges.sparkSession
    neighbours = ways.select("at", "next").distinct()
    start = lambda x: kept(spark.createDataFrame([(x,)], "id string"))
    levels, seen, size = ([start(source)], [start(target)]), [None, None], [1, 1]
    while True:
        meeting = kept(levels[0][-1].join(levels[1][-1], "id", "left_semi"))
        if not meeting.isEmpty():
            break
        end = 0 if size[0] <= size[1] else 1
        last = levels[end][-1]
        seen[end] = last if seen[end] is None else seen[end].unionByName(last)
        if len(levels[end]) % 8 == 0:
            seen[end] = kept(seen[end])
        ahead = last.join(neighbours, last["id"] == neighbours["at"]).select(F.col("next").alias("id")).distinct()
        levels[end].append(kept(ahead.join(seen[end], "id", "left_anti")))
        size[end] = levels[end][-1].count()
        if not size[end]:
            return spark.createDataFrame([], "step int, source_id string, target_id string, relation string")
    # nodes that lead on, from the source's side: back from where the levels met
    on = [meeting]
    for level in reversed(levels[0][:-1]):
        back = on[0].join(neighbours, on[0]["id"] == neighbours["at"]).select(F.col("next").alias("id")).distinct()
        on.insert(0, kept(level.join(back, "id", "left_semi")))
    rows, here = [], source
    for step, level in enumerate([*on[1:], *reversed(levels[1][:-1])]):
        leads = ways.where(F.col("at") == here).join(level.select(F.col("id").alias("next")), "next", "left_semi")
        first = leads.agg(F.min(F.struct("edge", "next")).alias("x")).first().x
        rows.append((step, *first.edge))
        here = first.next
    return spark.createDataFrame(rows, "step int, source_id string, target_id string, relation string")


def path(nodes: DataFrame, edges: DataFrame, source: str, target: str) -> tuple[DataFrame, list[str] | None]:
    """The shortest path between two nodes of a context that queries name, and the bridge of their topics.

    Either may be missing, the path as no rows, the bridge as None; both missing is an error, as is a node not found.
    """
    ends = [find(nodes, q).first() for q in (source, target)]
    if None in ends:
        raise LookupError("no such node")
    steps = shortest_path(edges, ends[0].id, ends[1].id)
    pair = edges.sparkSession.createDataFrame([(ends[0].path or "", ends[1].path or "")], "source string, target string")
    bridge = topic_bridge(pair.where("source <> '' AND target <> ''")).first()
    bridge = bridge and bridge.bridge
    if bridge is None and steps.isEmpty():
        raise LookupError("no path between the two nodes")
    return steps, bridge


def connections(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """What a node is linked with, by direction: the other node's id and label; a loop is out; edges to unknown nodes go."""
    out = edges.where(F.col("source_id") == node).select(F.lit("out").alias("direction"), "relation", F.col("target_id").alias("id"))
    into = edges.where((F.col("target_id") == node) & (F.col("source_id") != node)).select(F.lit("in").alias("direction"), "relation", F.col("source_id").alias("id"))
    return out.unionByName(into).join(nodes.select("id", "label"), "id").select("direction", "relation", "id", "label")


def explanation(nodes: DataFrame, edges: DataFrame, node: str, siblings: int = 12) -> tuple[DataFrame, list[str]]:
    """A node's connections in order, and up to so many branches of the topic that its path lies in."""
    order = F.concat("direction", "relation", "label")
    met = connections(nodes, edges, node).orderBy(order, "id")
    own = nodes.where(F.col("id") == node).select("path").first()
    parent = (own and own.path or "").rpartition(".")[0]
    return met, [r.branch for r in branches(nodes.select("path"), parent, siblings).collect()] if parent else []


def clamped(limit: int, usual: int, most: int) -> int:
    """A limit within 1 and most, or else the usual one."""
    return limit if 0 < limit <= most else usual


def subgraph(nodes: DataFrame, edges: DataFrame, scope: str, limit: int = 0) -> dict:
    """The nodes around those whose text holds scope (all nodes for an empty one): ids in order, edges, totals, truncated.

    No node matches: an empty graph. limit: 80 nodes if it is not within 1 and 200.
    """
    limit = clamped(limit, 80, 200)
    seeds = [r.id for r in in_order(seeded(nodes, scope)).select("id").limit(limit).collect()]
    ids = neighborhood(edges, seeds, 2, limit)
    known = {r.id for r in nodes.where(F.col("id").isin(ids)).select("id").collect()} if ids else set()
    ids = [i for i in ids if i in known]
    total = nodes.count()
    return {"ids": ids, "edges": induced(edges, ids), "nodes_total": total, "edges_total": edges.count(), "truncated": len(ids) < total}


#: The parts of a node in which a query is looked for.
HAY = ("id", "path", "label", "kind", "material_uri", "locator", "content")


def seeded(nodes: DataFrame, query: str) -> DataFrame:
    """The nodes of a context in whose parts a query stands, whatever its case, missing ones too; all for an empty query."""
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in HAY]))
    return nodes.where(F.contains(hay, F.lit(query.strip().lower())))


def branches(paths: DataFrame, prefix: str, limit: int) -> DataFrame:
    """The next step below a dotted prefix of every path(path) at or under it, distinct and in order."""
    prefix = prefix.strip().removesuffix(".")
    rest = F.substr("path", F.lit(len(prefix) + 2))
    branch = F.when((F.col("path") != prefix) & F.contains(rest, F.lit(".")), F.concat(F.lit(prefix + "."), F.substring_index(rest, ".", 1))).otherwise(F.col("path"))
    under = paths.where((F.col("path") != "") & ((F.col("path") == prefix) | F.startswith("path", F.lit(prefix + "."))))
    return under.select(branch.alias("branch")).distinct().orderBy("branch").limit(limit)


def topic_bridge(pairs: DataFrame) -> DataFrame:
    """pairs(source, target) with bridge: dotted paths up to the common ancestor and down; null without one."""
    a, b = F.split("source", r"\."), F.split("target", r"\.")
    n = F.size(F.filter(F.sequence(F.lit(1), F.least(F.size(a), F.size(b))), lambda i: F.slice(a, 1, i) == F.slice(b, 1, i)))
    up = F.transform(F.sequence(F.size(a), n, F.lit(-1)), lambda i: F.array_join(F.slice(a, 1, i), "."))
    down = F.when(F.size(b) > n, F.transform(F.sequence(n + 1, F.greatest(F.size(b), n + 1)), lambda i: F.array_join(F.slice(b, 1, i), "."))).otherwise(F.array().cast("array<string>"))
    return pairs.withColumn("bridge", F.when(n > 0, F.concat(up, down)))
