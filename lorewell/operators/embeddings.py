"""Stored vectors of a graph's nodes: which are current, which are pending, and bringing them up to date."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash
from .ranking import semantic_top
from .records import upsert

#: Numbers in a vector, and texts that a model gets at a time.
DIMENSIONS, BATCH = 512, 32
#: Texts to vectors.
Model = Callable[[list[str]], list[list[float]]]


def candidates(nodes: DataFrame) -> DataFrame:
    """(node_id, text, content_hash) of active intents and knowledge, their content empty or not.

    The text has label, kind, finer kind, address, place and content, each on a line; columns that nodes lack are empty.
    """
    parts = [F.coalesce(F.col(c), F.lit("")) if c in nodes.columns else F.lit("") for c in ("label", "kind", "subkind", "material_uri", "locator", "content")]
    kept = nodes.where((F.col("state") == "active") & F.col("kind").isin("intent", "knowledge"))
    return kept.select(F.col("id").alias("node_id"), F.concat_ws("\n", *parts).alias("text"), content_hash(*parts).alias("content_hash"))


def current(stored: DataFrame, wanted: DataFrame, model: str) -> DataFrame:
    """Stored vectors of a model whose node is still wanted with the same hash."""
    return stored.where(F.col("model") == model).join(wanted.select("node_id", "content_hash"), ["node_id", "content_hash"], "left_semi").select(*stored.columns)


def pending(stored: DataFrame, wanted: DataFrame, model: str) -> DataFrame:
    """What is wanted and has no current vector of a model."""
    return wanted.join(stored.where(F.col("model") == model).select("node_id", "content_hash"), ["node_id", "content_hash"], "left_anti").select(*wanted.columns)


def status(stored: DataFrame, wanted: DataFrame, model: str) -> DataFrame:
    """One row: total, current and pending."""
    have = stored.where(F.col("model") == model).select("node_id", F.col("content_hash").alias("stored_hash"))
    same = F.coalesce(F.col("stored_hash") == F.col("content_hash"), F.lit(False))
    return wanted.join(have, "node_id", "left").agg(F.count("*").alias("total"), F.count_if(same).alias("current"), F.count_if(~same).alias("pending"))


def embedded(texts: DataFrame, model: Model, dimensions: int = DIMENSIONS, batch: int = BATCH) -> DataFrame:
    """texts(…, text) with vector in place of text: tasks hand the model so many texts at a time.

    No more texts than that are Python objects at once; the others stay in Arrow.

    An empty text, or an answer of another number, length or with numbers that are not finite, is an error.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                asked = part.column("text").to_pylist()
                if not all(x and x.strip() for x in asked):
                    raise ValueError("a text to embed is empty")
                made = model(asked)
                if len(made) != len(asked) or any(len(v) != dimensions for v in made) or any(x != x or x in (float("inf"), float("-inf")) for v in made for x in v):
                    raise ValueError("the model's vectors are not as many, as long or as finite as asked")
                vectors = pa.array([[float(x) for x in v] for v in made], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], vectors], names=[*names, "vector"])

    rest = [f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name != "text"]
    names = [f.name for f in texts.schema if f.name != "text"]
    return texts.mapInArrow(of, ", ".join([*rest, "vector array<double>"]))


def backfilled(stored: DataFrame, wanted: DataFrame, name: str, model: Model, most: int | None = None, dimensions: int = DIMENSIONS) -> DataFrame:
    """stored with vectors for what is pending, most at most, the first by node; others stay pending for the next call."""
    todo = pending(stored, wanted, name).where(F.trim("text") != "")
    todo = todo.orderBy("node_id").limit(most) if most else todo
    new = embedded(todo, model, dimensions).select("node_id", "content_hash", F.lit(name).alias("model"), "vector")
    return upsert(stored, new, ["node_id"])


def matches(spark: SparkSession, stored: DataFrame, nodes: DataFrame, query: str, name: str, model: Model | None, k: int) -> DataFrame:
    """(node_id, score): the k current vectors most like the query's. No rows without a model, with the default one's
    name, with nothing current, or if the model fails: a search goes on without this lane."""
    none = spark.createDataFrame([], "node_id string, score double")
    if model is None or name == "default":
        return none
    now = current(stored, candidates(nodes), name)
    if now.isEmpty():
        return none
    try:
        vector = model([query])[0]
    except Exception:  # noqa: BLE001  whatever a model raises, the other lanes answer
        return none
    return semantic_top(now, vector, k).select("node_id", "score")


def setting(settings: DataFrame, name: str) -> str | None:
    row = settings.where(F.col("name") == name).first()
    return row and row.value


def with_setting(settings: DataFrame, name: str, value: str) -> DataFrame:
    return upsert(settings, settings.sparkSession.createDataFrame([(name, value)], "name string, value string"), ["name"])
