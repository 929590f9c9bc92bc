"""Full-text and vector ranking, their fusion, and hints within a budget."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import kept
from ..functions.text import lexical_tokens


def half_away(x: Column, digits: int = 6) -> Column:
    """Rounded at so many digits, halves away from zero, as the scores are compared."""
    scale = float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def query_terms(df: DataFrame, query: str, keywords: Iterable[str] = ()) -> list[str]:
    text = F.lit(" ".join([query, *keywords]))
    return df.sparkSession.range(1).select(F.array_sort(F.array_distinct(lexical_tokens(text)))).first()[0]


def bm25(candidates: DataFrame, fields: list[str], query: str, keywords: Iterable[str] = ()) -> DataFrame:
    """candidates with a score that matches the query (k1 = 1.2, b = 0.75), those without a match left out.

    The statistics cover all candidates, also those without tokens. A text is tokenized once: tokens fold into a
    length and the counts of the query's terms, and only rows with a term keep their columns for the projection that
    scores them. The corpus is never exploded, and no text is read a second time.
    """
    terms = query_terms(candidates, query, keywords)
    if not terms:
        return candidates.withColumn("score", F.lit(0.0)).limit(0)
    tokens = F.concat(*[lexical_tokens(F.col(f)) for f in fields])
    at = F.map_from_arrays(F.array(*map(F.lit, terms)), F.array(*[F.lit(i) for i in range(len(terms))]))
    # places of the query's terms among the tokens, worked out once: transform() binds its result to one variable
    counts = F.transform(F.array(tokens), lambda t: F.struct(F.size(t).alias("dl"), F.transform(F.filter(t, lambda w: w.isin(terms)), lambda w: F.element_at(at, w)).alias("hits")))[0]
    # the row number keeps the optimizer from copying the tokens into each use of them
    row, bm = "_bm_row", "_bm"
    counted = kept(candidates.withColumn(bm, counts).withColumn(row, F.monotonically_increasing_id()).where(f"{row} >= 0").drop(row).select(*[F.when(F.size(f"{bm}.hits") > 0, F.col(f"`{c}`")).alias(c) for c in candidates.columns], bm))
    stats = counted.agg(F.count("*").alias("n"), F.avg(f"{bm}.dl").alias("avg"), *[F.count_if(F.array_contains(f"{bm}.hits", i)).alias(f"d{i}") for i in range(len(terms))]).first()
    times = lambda i: F.size(F.filter(f"{bm}.hits", lambda h: h == i)).cast("double")
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = times(i), float(stats[f"d{i}"])
        idf = F.log(1 + (F.lit(float(stats.n)) - df + 0.5) / (F.lit(df) + 0.5))
        score = score + F.when(tf > 0, idf * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * F.col(f"{bm}.dl") / (stats.avg or 1.0)))).otherwise(F.lit(0.0))
    return counted.where(F.size(f"{bm}.hits") > 0).withColumn("score", half_away(score)).where("score > 0").drop(bm)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths or without length."""
    total = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda t, z: t + z)
    norm = F.sqrt(total(a, a)) * F.sqrt(total(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), F.lit(0.0)).otherwise(total(a, b) / norm)


def semantic_top(vectors: DataFrame, query: list[float], k: int, key: str = "node_id", vector: str = "vector") -> DataFrame:
    """The k rows whose vectors are most like the query's, no threshold; ties by key."""
    at = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("score", half_away(cosine(F.col(vector), at))).orderBy(F.desc("score"), key).limit(k)


def text_seeds(nodes: DataFrame, fields: list[str], query: str) -> DataFrame:
    """Nodes in which the query stands literally, whatever its case, active or not."""
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]))
    return nodes.where(F.contains(hay, F.lit(query.strip().lower())))


def fuse(lanes: list[tuple[str, DataFrame]], key: str, order: list[Column], limit: int) -> DataFrame:
    """One row for each key of the lanes (name, rows ordered by order): its place in the lane order, and its signals."""
    placed = None
    for i, (name, lane) in enumerate(lanes):
        one = lane.select(key, F.struct(F.lit(i).alias("lane"), *[o.alias(f"o{j}") for j, o in enumerate(order)]).alias("place"), F.lit(name).alias("signal"))
        placed = one if placed is None else placed.unionByName(one)
    merged = placed.groupBy(key).agg(F.min("place").alias("place"), F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("place.lane", "signal"))), lambda x: x["signal"]), ",").alias("signals"))
    return merged.orderBy("place", key).limit(limit).select(key, "signals", F.col("place.lane").alias("lane"))


#: Lines around a hint map; with their line ends they have a fixed number of bytes, which a budget counts.
HEAD = ["[PROJECT MEMORY MAP — CONTENT NOT LOADED]", "Addresses, not evidence. Open just the nodes the task at hand needs", "Nodes:"]
TAIL = [
    'Open nodes by address: `lorewell explain "<path or node ID>" ["<path or node ID>" ...]`',
    'Search or list a branch: `lorewell query "<path prefix or question>"`',
    'How two nodes connect: `lorewell path "<path or node ID>" "<path or node ID>"`',
]


def render_hints(nodes: list[dict], edges: list[tuple[str, str, str]]) -> str:
    """The text of a hint map: aliases, addresses and what kind of node each is, never content."""
    if not nodes:
        return ""
    alias = {n["id"]: f"N{i}" for i, n in enumerate(nodes, 1)}
    lines = [*HEAD]
    for n in nodes:
        kind = f"{n['kind']}/{n['subkind']}" if n.get("subkind") else n["kind"]
        state = n.get("state") if n.get("state") != "active" else None
        about = "; ".join(str(x) for x in (kind, n.get("match"), state, n.get("source")) if x)
        lines.append(f"- {alias[n['id']]} `{n.get('path') or n['id']}` [{about}] {n['label']}")
    if edges:
        lines += ["Paths:"] + [f"- {alias[s]} --{r}--> {alias[t]}" for s, t, r in edges if s in alias and t in alias]
    return "\n".join([*lines, *TAIL])


def choose_hints(semantic: list[dict], lexical: list[dict] | DataFrame, opened: set[str], budget: int, edges: Iterable[tuple[str, str, str]] | Callable = (), order: Iterable[Column] = ()) -> tuple[list[dict], list[tuple[str, str, str]]]:
    """At most three nodes of two ranked lanes, within a budget of tokens.

    First of each lane, then one of a branch not seen yet (durable nodes before others), then whatever fits. The
    lexical lane has no limit: as a data frame (id, key, label, kind, path, owner; ranked by order) it stays in Spark,
    and each step takes from it the one row that comes first of all that may be added. edges may be a function of the
    chosen ids.
    """
    chosen: list[dict] = []
    cost = lambda nodes, links: max(1, (len(render_hints(nodes, links).encode()) + 3) // 4)
    branch = lambda n: (n.get("path") or "").split(".")[0]

    def first(lane: list[dict] | DataFrame, match: str, durable: bool, met: set[str]) -> dict | None:
        taken = {c["id"] for c in chosen} | opened
        if isinstance(lane, DataFrame):
            # the bytes that path or id, label and kind of one more node may have
            room = 4 * budget - len(render_hints([*chosen, {"id": "", "label": "", "kind": "", "match": match}], []).encode())
            path, shown = F.coalesce("path", F.lit("")), [F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in ("label", "kind")]
            for c, sign in (("subkind", "/"), ("state", "; "), ("source", "; ")):
                if c in lane.columns:
                    none = (F.coalesce(F.col(c), F.lit("")) == "") | (F.col(c) == "active" if c == "state" else F.lit(False))
                    shown.append(F.when(none, F.lit("")).otherwise(F.concat(F.lit(sign), F.col(c))))
            fits = F.octet_length(F.concat(F.when(path == "", F.col("id")).otherwise(path), *shown)) <= room
            may = fits & ~F.col("id").isin(list(taken)) & ~F.coalesce(F.col("key").isin(list(opened)), F.lit(False)) & ~F.substring_index(path, ".", 1).isin(list(met))
            row = lane.where(may & F.col("owner").eqNullSafe("durable") if durable else may).orderBy(*order).first()
            return row and row.asDict()
        for n in lane:
            if n["id"] not in taken and n.get("key") not in opened and (n.get("owner") == "durable" or not durable) and branch(n) not in met and cost([*chosen, n | {"match": match}], []) <= budget:
                return n
        return None

    def add(lane: list[dict] | DataFrame, match: str, durable: bool = False, fresh: bool = False) -> bool:
        node = first(lane, match, durable, {branch(c) for c in chosen} if fresh else set()) if len(chosen) < 3 else None
        if node:
            chosen.append(node | {"match": match})
        return bool(node)

    lanes = (("semantic", semantic), ("bm25", lexical))
    add(semantic[:1], "semantic")
    add(lexical, "bm25")
    any(add(lane, f"{name}:alternate-branch", durable, True) for durable in (True, False) for name, lane in lanes)
    for name, lane in lanes:
        while add(lane, name):
            pass
    links: list[tuple[str, str, str]] = []
    ids = {c["id"] for c in chosen}
    for e in edges(list(ids)) if callable(edges) and ids else () if callable(edges) else edges:
        if e[0] in ids and e[1] in ids and cost(chosen, [*links, e]) <= budget:
            links.append(e)
    return chosen, links
