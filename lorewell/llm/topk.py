"""Exact top-k search with a vector-approximation file.

A grid parts the range of each dimension into CELLS cells. The file holds one byte for each dimension of each vector,
its cell; only the file meets the queries, block by block, and bounds every inner product from both sides. What may be
among the k best of a query by these bounds is then read exactly, in their order: the best upper bounds first, and
after them only what may still reach the last exact score. Equal vectors are one in all of this: a class of them is
found once, and only its smallest ids are ever listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, table

#: Cells of each dimension; queries and candidates of a block; the most tasks that blocks are dealt over.
CELLS, QUERIES, CANDIDATES, TASKS = 256, 1024, 8192, 10_000


def _matrix(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(np.float64) if len(v) else np.empty((0, 0))


def grid(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of the vectors the lowest corner and the width of the cells of each dimension.

    The driver gets two numbers for each dimension of each length that vectors have.
    """

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n, part in batch["v"].groupby(batch["v"].map(len)):
                if n:
                    x = _matrix(part)
                    yield pd.DataFrame({"n": n, "at": np.arange(n), "low": x.min(0), "high": x.max(0)})

    found = vectors.select("v").mapInPandas(ranges, "n int, at int, low double, high double").groupBy("n", "at").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    rows = found.toPandas().sort_values(["n", "at"])
    return {int(n): (x["low"].to_numpy(), np.maximum((x["high"] - x["low"]).to_numpy() / CELLS, 1e-9)) for n, x in rows.groupby("n")}


def cells(x: np.ndarray, low: np.ndarray, width: np.ndarray) -> np.ndarray:
    return np.clip((x - low) / width, 0, CELLS - 1).astype(np.uint8)


def bounds(queries: np.ndarray, codes: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The inner product with each cell's middle, one row for each query, and how far the exact one may be from it."""
    q = queries.astype(np.float64)
    middle = q @ (low + (codes + 0.5) * width).T
    most = np.abs(low).max(initial=0) + CELLS * width.max(initial=0)
    return middle, np.abs(q) @ width / 2 * (1 + 1e-9) + np.abs(q).sum(1) * most * 1e-12 + 1e-6


def candidates(queries: np.ndarray, query_ids: np.ndarray, codes: np.ndarray, ids: np.ndarray, low: np.ndarray, width: np.ndarray, k: int) -> pd.DataFrame:
    """What may be among the k best of each query in a block: whose upper bound reaches the kth best lower bound."""
    middle, slack = bounds(queries, codes, low, width)
    kth = np.full(len(queries), -np.inf) if len(ids) < k else np.partition(middle, len(ids) - k, axis=1)[:, len(ids) - k]
    i, j = np.nonzero(middle + slack[:, None] >= (kth - slack)[:, None])
    return pd.DataFrame({"query": query_ids[i], "class": ids[j], "upper": middle[i, j] + slack[i], "lower": middle[i, j] - slack[i]})


def classes(vectors: DataFrame, k: int) -> DataFrame:
    """(class, v, members) of vectors (vec_id, v): one row for each distinct v, with the k smallest ids that have it and how often each does.

    Rows of an id are counted before they are shuffled, and each task passes on only the k smallest ids of a vector.
    """
    counted = vectors.groupBy("v", "vec_id").agg(F.count("*").alias("n"))
    smallest = counted.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("place") <= k)
    made = smallest.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("vec_id", "n"))).alias("members"))
    return keep(made.select(F.monotonically_increasing_id().alias("class"), "v", "members"))


def best_classes(asked: DataFrame, stored: DataFrame, k: int) -> DataFrame:
    """(query, class, score): for each of asked (query, v) the k best of stored (class, v, members) by inner product, ties to the smaller first id.

    Every query meets every block of the file, which is what a search of all rows asks for; exact vectors go only where
    the bounds leave them in, which the best lower bounds over all blocks decide.
    """
    of_length = grid(stored)

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [cells(np.asarray(v, np.float64), *of_length[len(v)]).tobytes() if len(v) else b"" for v in batch["v"]]
            yield pd.DataFrame({"id": batch["class"], "dim": batch["v"].map(len), "code": made})

    codes = stored.select("class", "v").mapInPandas(file, "id long, dim int, code binary")
    sought = asked.select(F.col("query").alias("id"), F.size("v").alias("dim"), "v")
    count = lambda df: df.groupBy("dim").agg(F.count("*").alias("n"))
    blocks = count(codes).join(count(sought).withColumnRenamed("n", "m"), "dim")
    blocks = keep(blocks.select("dim", F.ceil(F.col("n") / CANDIDATES).cast("int").alias("cb"), F.ceil(F.col("m") / QUERIES).cast("int").alias("qb")))
    met = blocks.agg(F.sum(F.col("cb") * F.col("qb"))).first()[0] or 1
    tasks = max(2, min(TASKS, int(met)))

    def dealt(df: DataFrame, own: str, other: str, *payload) -> DataFrame:
        near = df.join(F.broadcast(blocks), "dim").withColumn(own, F.pmod(F.xxhash64("id"), F.col(f"{own}b")).cast("int"))
        return near.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}b") - 1))).select("dim", "c", "q", "id", *payload)

    sides = dealt(sought, "q", "c", F.lit(None).cast("binary").alias("code"), "v").unionByName(dealt(codes, "c", "q", "code", F.lit(None).cast("array<long>").alias("v")))

    def of(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["v"].notna().to_numpy()
        q, c, n = group[asks], group[~asks], int(group["dim"].iloc[0])
        x = _matrix(q["v"]).reshape(len(q), n)
        coded = np.frombuffer(b"".join(c["code"]), np.uint8).reshape(len(c), n)
        return candidates(x, q["id"].to_numpy(np.int64), coded, c["id"].to_numpy(np.int64), *of_length.get(n, (np.zeros(n), np.ones(n))), k)

    left = sides.repartition(tasks, "dim", "c", "q").groupBy("dim", "c", "q").applyInPandas(of, "query long, class long, upper double, lower double")
    place = lambda *order: F.row_number().over(Window.partitionBy("query").orderBy(*order))
    left = left.withColumn("place", place(F.desc("lower"), "class"))
    least = F.max(F.when(F.col("place") == k, F.col("lower"))).over(Window.partitionBy("query"))
    left = keep(left.withColumn("least", least).where("least IS NULL OR upper >= least").select("query", "class", "upper"))

    def exact(pairs: DataFrame) -> DataFrame:
        """The inner products of pairs (query, class), with the class's first id."""
        product = F.aggregate(F.zip_with("x", "v", lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)
        both = pairs.join(asked.select("query", F.col("v").alias("x")), "query").join(stored, "class")
        return both.select("query", "class", product.alias("score"), F.col("members")[0]["vec_id"].alias("first"))

    first = keep(exact(left.withColumn("place", place(F.desc("upper"), "class")).where(F.col("place") <= k).select("query", "class")))
    certain = first.withColumn("place", place(F.desc("score"), "first", "class")).where(F.col("place") == k).select("query", F.col("score").alias("kth"))
    rest = left.join(first.select("query", "class"), ["query", "class"], "left_anti").join(certain, "query", "left")
    rest = rest.where(F.col("kth").isNull() | (F.col("upper") >= F.col("kth"))).select("query", "class")
    best = first.unionByName(exact(rest)).withColumn("place", place(F.desc("score"), "first", "class"))
    return best.where(F.col("place") <= k).select("query", "class", "score")


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each query (vec_id, v) its k best by inner product among vectors (vec_id, v).

    v is an array of long. Vectors of another length than the query's are no candidates for it. Rows that repeat an
    id are candidates each, except for the query of that id; queries that repeat an id share its k ranks.

    Queries and vectors that are equal are searched once. The k + 1 best classes of a query hold its k best rows, as
    only its own class can be without another row, and of a class its k + 1 smallest ids are enough.
    """
    stored = classes(vectors, k + 1)
    asks = queries.groupBy("v", "vec_id").agg(F.count("*").alias("asked"))
    distinct = keep(asks.select("v").distinct().select(F.monotonically_increasing_id().alias("query"), "v"))
    found = best_classes(distinct, stored, k + 1)
    rows = found.join(stored.select("class", F.explode("members").alias("m")), "class").select("query", "score", "m.vec_id", "m.n")
    rows = rows.join(asks.join(distinct, "v").select("query", F.col("vec_id").alias("query_id"), "asked"), "query").where("vec_id <> query_id")
    times = F.least(F.col("n") * F.col("asked"), F.lit(k)).cast("int")
    each = rows.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1), times)))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): floor(256 * x) of each component as long; rows with a null id or a null or non-finite component go."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("v")
    )


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id and score: the 5 best of all other vectors for each vec_id divisible by 50."""
    rows = integers(table(spark, sf_dir, "embeddings"))
    return top_k(rows.where(F.col("vec_id") % 50 == 0), rows)


OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
