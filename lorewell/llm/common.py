"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"
WORD_RE = re.compile(WORD)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; empty for null or blank text."""
    parts = F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE)), r"[\x20\x09-\x0D]+")
    return F.array_remove(parts, "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


#: Bits of the filter that keeps most rows with other ids out of costly steps: at least, at most, and for each id.
FILTER_BITS, MOST_FILTER_BITS, BITS_PER_ID = 1 << 20, 1 << 28, 16


def perhaps_among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is among ids, and some others: an exact join must follow.

    A bitmap of hashed ids decides, with BITS_PER_ID bits for each and MOST_FILTER_BITS (32 MB) at most, so it may be
    broadcast. Beyond 2**28 ids it lets more and more other rows pass. Rows without id go. ids is read twice: keep it.
    """
    n_bits = FILTER_BITS
    most = min(MOST_FILTER_BITS, BITS_PER_ID * ids.count())
    while n_bits < most:
        n_bits *= 2
    named = docs.where("doc_id IS NOT NULL")
    spot, number, held, place = unused(docs, "spot", "number", "held", "place")
    at = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(n_bits))
    bits = ids.select(at("doc_id").alias(spot)).groupBy(F.bitmap_bucket_number(spot).alias(number)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias(held))
    byte = F.conv(F.hex(F.substr(F.col(held), F.floor(F.col(place) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    named = named.withColumn(spot, at("doc_id")).withColumn(number, F.bitmap_bucket_number(spot)).withColumn(place, F.bitmap_bit_position(F.col(spot)))
    return named.join(F.broadcast(keep(bits)), number).where(F.getbit(byte, (F.col(place) % 8).cast("int")) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, whatever the case of its letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


#: Seconds between two collections of the driver's unused frames.
RELEASE_EVERY = 15.0
_released = [0.0]


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that are done, at most once in RELEASE_EVERY seconds.

    Spark's cleaner deletes them when the driver's JVM finds that no frame needs them, which it looks for when its
    memory runs low or every half hour. Many short steps with large shuffles would fill the disks before.
    """
    if time.monotonic() - _released[0] >= RELEASE_EVERY:
        spark.sparkContext._jvm.System.gc()
        _released[0] = time.monotonic()


def keep(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage with a reliable checkpoint in the folder the cluster names.

    Spark deletes the files when the frame is no longer used, if spark.cleaner.referenceTracking.cleanCheckpoints
    is on. A folder of our own is set only on a local master whose session names none, as in tests; a cluster has to name one.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lorewell-"))
    out = df.checkpoint(eager=True)
    del df  # what its plan has shuffled may go
    release(out.sparkSession)
    return out
