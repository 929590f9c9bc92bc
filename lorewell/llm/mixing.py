"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, unused, words


def source_rates(sizes: DataFrame, weights: tuple[int, ...], epochs: float, most: float) -> DataFrame:
    """One row for each source of sizes(source, size): source_size, target and rate = target / source_size.

    Sources stand by code point, null last, and take the weights in turn. The mix holds epochs times all words.
    Words are shared by weight; a source stops at most times its size and its excess goes to the others by weight,
    until none is above. That fixed point is a water level: in order of size / weight the first sources stop, the
    others get level * weight, where level = (what is left) / (weight that is left). Two running sums find it, so
    only this table of sources, already aggregated, meets in one sort.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    full = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    after = full.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (F.lit(epochs) * F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)
    return (
        total.withColumn("weight", weight)
        .withColumn("ratio", F.col("source_size") / F.col("weight"))
        .withColumn("level", level)
        # a source stops if even the level at its own place would fill it; after the first that does not, none does
        .withColumn("stops", F.col("level") * F.col("weight") >= most * F.col("source_size"))
        .withColumn("water", F.min(F.when(~F.col("stops"), F.struct("ratio", "level"))).over(every)["level"])
        .withColumn("target", F.when(F.col("stops"), most * F.col("source_size")).otherwise(F.col("water") * F.col("weight")).cast("double"))
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
        .select("source", "source_size", "target", "rate")
    )


def chance(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the document's id and the seed only: 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def with_copies(docs: DataFrame, weights=(5, 2, 1), epochs: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """docs with a struct _mix: size, source_size, target, rate and copies, which is floor(rate) plus one with the rate's fraction as probability.

    Null text has size 0; a null source is a source of its own, last in order. Rows that repeat an id draw the same
    number, as do all rows without id. No rows give no rows. Other columns pass through untouched, but for a column
    _mix of the input. The table of sources meets in one sort, so sources must be few against documents.
    """
    named, mine = unused(docs, "mixed", "mine")
    size = F.size(words(F.col("text"))).cast("long")
    rates = source_rates(docs.select("source", size.alias("size")), weights, epochs, most).select(F.struct("*").alias(named))
    others = [c for c in docs.columns if c != "_mix"]
    joined = docs.select(*[F.col(f"`{c}`") for c in others], size.alias(mine)).join(rates, F.col("source").eqNullSafe(F.col(f"{named}.source")))
    rate = F.col(f"{named}.rate")
    extra = (chance(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("long")
    made = F.struct(F.col(mine).alias("size"), f"{named}.source_size", f"{named}.target", f"{named}.rate", (F.floor(rate) + extra).alias("copies"))
    return joined.select(*[F.col(f"`{c}`") for c in others], made.alias("_mix"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row of docs as often as the mix takes it, with the columns of docs (_mix, if any, left out)."""
    copies = F.array_repeat(F.lit(0), F.col("_mix.copies").cast("int"))
    (copy,) = unused(docs, "copy")
    return with_copies(docs, **options).withColumn(copy, F.explode(copies)).drop(copy, "_mix")


def op3_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes, repeats counted) of every document."""
    out = with_copies(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    m = F.col("_mix")
    return out.select("doc_id", m["size"].alias("size"), m["source_size"].alias("source_size"), m["target"].alias("target"), (m["size"] * m["copies"]).alias("taken"))


OP3_SQL = r"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM t),
r AS (SELECT *, source_size::DOUBLE / weight AS ratio FROM w),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT
        - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
        / (sum(weight) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level FROM r),
g AS (SELECT *, level * weight >= 2.0::DOUBLE * source_size AS stops FROM l),
x AS (SELECT *, min_by(level, ratio) FILTER (WHERE NOT stops) OVER () AS water FROM g),
y AS (SELECT source, source_size, (CASE WHEN stops THEN 2.0::DOUBLE * source_size ELSE water * weight END)::DOUBLE AS target FROM x),
z AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM y)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + CASE WHEN ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM s JOIN z ON s.source IS NOT DISTINCT FROM z.source
"""
