"""Sharding by minimax contiguous partition over ordered atomic groups."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, table

#: Groups stand in order of (CRC-32, MD5) of their text; a cell is a range of CRC-32 values.
CELL_BITS = 16
#: Ranges that one round parts, each in 256.
PARTED = 256


def greedy(ends: list[int], capacity: int, shards: int) -> list[int] | None:
    """The indices where greedy packing of the ordered sizes (running sums in ends) cuts, or None if capacity fails."""
    cuts, start, at = [], 0, 0
    for _ in range(shards):
        at = bisect_right(ends, start + capacity)
        if at == len(ends):
            return cuts
        cuts.append(at)
        start = ends[at - 1] if at else 0
    return None


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The smallest largest shard over contiguous partitions of sizes, by binary search."""
    ends = list(accumulate(sizes))
    low, high = max([0, *sizes, -(-sum(sizes) // shards)]), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if greedy(ends, mid, shards) is not None else (mid + 1, high)
    return low


def _walk(ends: list[int], single: list[bool] | None, capacity: int, shards: int) -> list[int]:
    """Where each of so many greedy shards ends: at a border of items, or, with single, anywhere in an item not single."""
    out, at = [], 0
    for _ in range(shards):
        i = bisect_right(ends, at + capacity)
        at = ends[-1] if i == len(ends) else at + capacity if single and not single[i] else ends[i - 1] if i else 0
        out.append(at)
    return out


def _least(ends: list[int], single: list[bool] | None, low: int, high: int, shards: int) -> int:
    """The smallest capacity from low to high with which _walk reaches the end; high must do."""
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if _walk(ends, single, mid, shards)[-1] == ends[-1] else (mid + 1, high)
    return low


def _ranges(rows: DataFrame, of: dict[int, list[str]]) -> list[tuple[str, int, bool]]:
    """(first digits, bytes, whether it is one group) of the parts of ranges, given by their number of digits, in order."""
    key = F.concat(F.lpad(F.lower(F.hex("crc")), 8, "0"), F.col("md5"))
    part = F.lit(None).cast("string")
    for digits, names in of.items():
        part = F.when(F.substring(key, 1, digits).isin(names), F.substring(key, 1, digits + 2)).otherwise(part) if digits else F.substring(key, 1, CELL_BITS // 4)
    parts = rows.select(part.alias("part"), key.alias("key"), "size").where("part IS NOT NULL").groupBy("part")
    found = parts.agg(F.sum("size").alias("size"), (F.min("key") == F.max("key")).alias("single"))
    return sorted((r.part, r["size"], r.single) for r in found.toLocalIterator())


def _exact_cuts(rows: DataFrame, shards: int, parted: int = PARTED) -> list[str]:
    """The first key (hex digits of crc and md5) of each shard but the first.

    Sums of ranges bound the capacity and every cut: from above by cuts at borders of ranges only, from below by cuts
    anywhere but in a range known to be one group. A cut can only be in a range where a shard can fill up between the
    two bounds; each round the largest of these ranges are parted, until all of them are single groups. The others
    join with their neighbours, so the driver holds a fixed number of sums, whatever the sizes of the groups.
    """
    items = _ranges(rows, {0: []})
    low, high = 0, sum(s for _, s, _ in items)
    while items:
        ends, single = list(accumulate(s for _, s, _ in items)), [one for _, _, one in items]
        low, high = _least(ends, single, low, high, shards), _least(ends, None, low, high, shards)
        starts, stops = _walk(ends, None, low, shards), _walk(ends, single, high, shards)
        near: set[int] = set()
        for a, b in zip([0, *starts], [0, *stops[:-1]], strict=False):
            near.update(range(bisect_right(ends, a + low), min(bisect_right(ends, b + high), len(ends) - 1) + 1))
        wide = sorted((i for i in near if not single[i]), key=lambda i: -items[i][1])[:parted]
        if not wide:
            return [items[i][0] for i in greedy(ends, high, shards) or []]
        of: dict[int, list[str]] = {}
        for i in wide:
            of.setdefault(len(items[i][0]), []).append(items[i][0])
        kept: list[tuple[str, int, bool]] = []
        gone, last = set(wide), -2
        for i, (name, size, one) in enumerate(items):
            if i in gone:
                continue
            if i not in near and last == i - 1:
                kept[-1] = (kept[-1][0], kept[-1][1] + size, False)
            else:
                kept.append((name, size, one))
            last = i if i not in near else -2
        items = sorted([*kept, *_ranges(rows, of)])
    return []


def shards(docs: DataFrame, n: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot: documents dealt over n shards, equal texts together, bytes near equal.

    Size is the text's UTF-8 bytes plus 1; null text counts as empty text. A group of equal texts that outweighs an
    even share of what is left gets a shard of its own (there can be at most n - 1), as no contiguous partition can
    do better; the other groups, in order, are cut at the smallest feasible capacity. Shards at the end may stay
    empty if there are fewer groups than shards. Slots number a shard's rows from 0 without gaps, in order of a hash
    of the id, then of the id (null first); rows that repeat an id and text share what differs arbitrarily.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = keep(
        docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), F.md5(text).alias("md5")).withColumn(
            "cell", F.shiftright("crc", 32 - CELL_BITS).cast("int")
        )
    )
    cells = {r.cell: r.total for r in rows.groupBy("cell").agg(F.sum("size").alias("total")).collect()}
    heavy: list[tuple[int, str]] = []
    left, rest = sum(cells.values()), n
    while rest > 1 and (large := [k for k, v in cells.items() if v * rest > left]):  # fewer than rest cells
        big = rows.where(F.col("cell").isin(large)).groupBy("crc", "md5").agg(F.sum("size").alias("size")).where(F.col("size") * rest > left)
        found = sorted(((-r.size, r.crc, r.md5) for r in big.collect() if (r.crc, r.md5) not in heavy))
        for size, crc, md5 in found:
            if rest > 1 and -size * rest > left:
                heavy.append((crc, md5))
                cells[crc >> (32 - CELL_BITS)] += size
                left, rest = left + size, rest - 1
        if not found:
            break
    light = rows
    for crc, md5 in heavy:
        light = light.where(~((F.col("crc") == crc) & (F.col("md5") == md5)))
    key, shard = F.concat(F.lpad(F.lower(F.hex("crc")), 8, "0"), F.col("md5")), F.lit(len(heavy))
    for cut in _exact_cuts(light, rest):
        shard = shard + (key >= cut).cast("int")
    for i, (crc, md5) in enumerate(heavy):
        shard = F.when((F.col("crc") == crc) & (F.col("md5") == md5), F.lit(i)).otherwise(shard)
    return numbered(rows.select("doc_id", "size", F.col("crc").alias("text_crc32"), "md5", shard.cast("int").alias("shard")))


def numbered(rows: DataFrame, parts: int = 4096) -> DataFrame:
    """rows with slot, their number within the shard: counted by parts of each shard, so no task meets a whole one."""
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "md5"), F.lit(parts)).cast("int"))
    starts = (
        rows.groupBy("shard", "part")
        .agg(F.count("*").alias("n"))
        .withColumn("start", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("n")
    )
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "md5"))
    return rows.withColumn("inside", inside).join(starts, ["shard", "part"]).withColumn("slot", (F.col("start") + F.col("inside") - 1).cast("long")).drop("part", "inside", "start", "md5")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law (`bytes`), shard, slot and grown_shard (null under this law) of every document.

    A null text counts as an empty one. Equal texts, repeated rows among them, share a shard; a group of them heavier
    than an even share has one of its own. Rows without an id are dealt as others are. No documents give no rows.
    """
    out = shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
