"""State over change logs and snapshots: materials, memories, sessions, projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import kept, spread


def latest(log: DataFrame, keys: list[str], seq: Column) -> DataFrame:
    """The last row of each key."""
    return log.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in log.columns if c not in keys]), seq).alias("_row")).select(*keys, "_row.*")


def upsert(current: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """current with the rows of delta in place of those of the same keys; delta has one row for each key."""
    return current.join(delta, keys, "left_anti").unionByName(delta)


def versions(log: DataFrame, key: str = "key", seq: str = "seq", digest: str = "hash") -> DataFrame:
    """log with action: created, updated or unchanged, against the row before of the same key."""
    before = F.lag(digest).over(Window.partitionBy(key).orderBy(seq))
    return log.withColumn("action", F.when(before.isNull(), "created").when(before != F.col(digest), "updated").otherwise("unchanged"))


def snapshot_diff(before: DataFrame, now: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """(key, status): added, removed, modified or unchanged between two snapshots."""
    one = lambda df, name: df.select(key, F.struct(*compared).alias(name))
    both = one(before, "a").join(one(now, "b"), key, "full_outer")
    return both.select(key, F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "unchanged").otherwise("modified").alias("status"))


#: Bits of the filter of perhaps_among: at least, at most (32 MB), and for each value.
FILTER_BITS, MOST_FILTER_BITS, BITS_PER_VALUE = 1 << 15, 1 << 28, 16


def perhaps_among(df: DataFrame, values: DataFrame, key: str, n: int) -> DataFrame:
    """The rows of df whose key is among the n of values, and a few others: an exact join must follow, which moves no more than these.

    A bitmap of hashes decides, small enough to be broadcast however many values there are. Rows without key go.
    """
    bits = FILTER_BITS
    while bits < min(MOST_FILTER_BITS, BITS_PER_VALUE * n):
        bits *= 2
    spot = F.pmod(F.xxhash64(key), F.lit(bits))
    held = values.select(spot.alias("_spot")).groupBy(F.bitmap_bucket_number("_spot").alias("_number")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_spot")).alias("_held"))
    place = F.bitmap_bit_position(spot).cast("int")
    byte = F.conv(F.hex(F.substr("_held", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = df.where(F.col(key).isNotNull()).withColumn("_number", F.bitmap_bucket_number(spot)).join(F.broadcast(kept(held)), "_number")
    return met.where(F.getbit(byte, place % 8) == 1).select(*df.columns)


def reusable(facts: DataFrame, before: DataFrame, now: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """Facts of materials that are still there unchanged."""
    same = snapshot_diff(before, now, key, compared).where("status = 'unchanged'")
    return facts.join(same, key, "left_semi")


def namespace_counts(keys: DataFrame, key: str, limit: int = 32) -> DataFrame:
    return keys.groupBy(F.substring_index(key, ".", 1).alias("name")).count().orderBy(F.desc("count"), "name").limit(limit)


#: Characters by whose run, at most, a needle of few words is looked up.
GRAM = 6


def mentioned(texts: DataFrame, needles: DataFrame, text: str, needle: str, words: int = 3) -> DataFrame:
    """Pairs of texts and needles that stand in them literally. Null and empty ones meet nothing.

    A needle's second and following words, if another follows them, are whole words of any text that holds it; so
    candidates come from an equality join on such runs of words, and the literal test follows. Needles of fewer words
    are looked up by their first GRAM characters, or all if they have fewer, among the runs of as many characters of
    the texts. No join compares every text with every needle.
    """
    w = F.split(F.col(needle), " ")
    long = F.size(w) > words + 1
    size = F.least(F.length(needle), F.lit(GRAM))
    # a needle's key, and how many characters it has (0: it is a run of words)
    key = F.when(long, F.concat_ws(" ", F.slice(w, 2, words))).otherwise(F.left(F.col(needle), size))
    keyed = needles.where(F.col(needle) != "").withColumns({"_key": key, "_size": F.when(long, 0).otherwise(size)})
    sizes = [r[0] for r in keyed.select("_size").distinct().collect()]  # GRAM and one at most
    # A text is split once and its words are bound to a name: written into the inner lambda, split would run for each word.
    split = F.array(F.split(F.col(text), " "))
    starts = lambda tw: F.sequence(F.lit(1), F.greatest(F.size(tw) - words + 1, F.lit(1)))
    runs = {0: F.transform(split, lambda tw: F.transform(starts(tw), lambda i: F.concat_ws(" ", F.slice(tw, i, words))))[0]}
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substr(F.col(text), i, F.lit(n)))
    runs |= {n: grams(n) for n in range(1, GRAM + 1)}
    # Texts are dealt once: their rows' numbers meet the needles by key, and come back for the literal test.
    rows = kept(spread(texts.where(F.col(text).isNotNull()).withColumn("_row", F.monotonically_increasing_id()), "_row"))
    needs = kept(keyed.withColumn("_needle", F.monotonically_increasing_id()))
    pairs = None
    for n in sizes:
        one = rows.select("_row", F.explode(F.array_distinct(runs[n])).alias("_key")).join(needs.where(F.col("_size") == n).select("_key", "_needle"), "_key").select("_row", "_needle")
        pairs = one if pairs is None else pairs.unionByName(one)
    if pairs is None:
        return rows.drop("_row").join(needs.drop("_key", "_size", "_needle"), F.lit(False), "inner")
    # Texts never go to the driver, however small their files are.
    met = pairs.distinct().join(needs.drop("_key", "_size"), "_needle").join(rows.hint("merge"), "_row").drop("_row", "_needle")
    return met.where(F.contains(F.col(text), F.col(needle)))


def mentioned_refs(texts: DataFrame, materials: DataFrame, text: str, key: str, most: int = 64) -> DataFrame:
    """(key, uri): for each text the materials(uri, path) whose path it holds, the first most by address; more is no use to a model."""
    found = mentioned(texts.select(key, text), materials.select("uri", "path"), text, "path").select(key, "uri").distinct()
    return found.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy("uri"))).where(F.col("_place") <= most).drop("_place")
