"""Document fingerprints by winnowing, in Spark's own functions alone.

A text is a sequence of tokens. Each run of K tokens has a hash; each window of W neighbouring hashes chooses its least
one, the rightmost of equal ones, and the chosen hashes with their places are the fingerprint. So two texts that share
W + K - 1 tokens in a row share a fingerprint, whatever stands around them, and nothing shorter than K tokens matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from .common import SPACE, keep, let, table, unused

#: Tokens of a hashed run, and hashes of a window.
K, W = 4, 8
#: Words are parted by white space; a text with a longer word than this has each such word taken character by character,
#: so that scripts without spaces have tokens too.
LONGEST = 32
SPACES, LONG = r"[\x20\x09-\x0D]+", rf"[^\x20\x09-\x0D]{{{LONGEST + 1}}}"
#: A print is 32 bits of hash above 31 bits that hold LAST - place, so that the least print has the least hash and of
#: equal ones the last place.
LAST = (1 << 31) - 1
HASH = ((1 << 63) - 1) ^ LAST
#: Documents of a block that is put in order by one task, and the most blocks.
BLOCK, MOST_BLOCKS = 2_000, 20_000


def tokens(text: Column) -> Column:
    words = F.split(F.btrim(text, F.lit(SPACE)), SPACES)
    cut = F.flatten(F.transform(words, lambda x: F.when(F.length(x) > LONGEST, F.split(x, "")).otherwise(F.array(x))))
    return F.when(F.length(F.btrim(text, F.lit(SPACE))) == 0, F.array().cast("array<string>")).when(F.rlike(text, F.lit(LONG)), cut).otherwise(words)


def prints(text: Column, k: int = K, w: int = W) -> Column:
    """The chosen prints of a text in order of their places, as array<long>.

    A text of fewer than k tokens has one run of all of them; fewer than w runs are one window; null and blank texts
    have no print. Work and memory grow with the length of the text: elements are read by their place, as slices of an
    array would copy it.
    """
    last = lambda n, size: F.greatest(n - size, F.lit(0))
    packed = lambda t: F.transform(
        F.sequence(F.lit(0), last(F.size(t), k)), lambda i: F.xxhash64(*[F.get(t, i + j) for j in range(k)]).bitwiseAND(F.lit(HASH)).bitwiseOR((LAST - i).cast("long"))
    )
    chosen = lambda p: F.array_distinct(F.transform(F.sequence(F.lit(0), last(F.size(p), w)), lambda i: F.least(*[F.get(p, i + j) for j in range(w)])))
    return let(tokens(F.coalesce(text, F.lit(""))), lambda t: F.when(F.size(t) == 0, F.array().cast("array<long>")).otherwise(let(packed(t), chosen)))


def hash_of(p: Column) -> Column:
    return F.shiftright(p, 31)


def place_of(p: Column) -> Column:
    return LAST - p.bitwiseAND(F.lit(LAST))


def shown(chosen: Column) -> Column:
    """A fingerprint as text: hash:place of each print, the hash as eight hexadecimal digits, joined by spaces."""
    return F.concat_ws(" ", F.transform(chosen, lambda p: F.concat(F.lpad(F.lower(F.hex(hash_of(p))), 8, "0"), F.lit(":"), place_of(p).cast("string"))))


def hashes(chosen: Column) -> Column:
    return F.array_distinct(F.transform(chosen, hash_of))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes of two sets of hashes over all of theirs; 1 if both are empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def in_order(docs: DataFrame) -> tuple[DataFrame, str, str, WindowSpec]:
    """docs dealt to blocks by doc_id, the names of the columns block and guest, and the order of a block's rows.

    A row with guest = 1 is the first document of the following block (of the first block behind the last), so that
    lead() over the order finds the next document of each; guests are to be dropped afterwards. Documents of one id
    follow each other by text. Rows without an id, guest = 2, stand behind all others and follow nobody. Ids alone are shuffled to
    find where blocks of about BLOCK documents begin; then each row is shuffled once, to its block, which is found by
    binary search in the array of first ids, MOST_BLOCKS long at most.
    """
    block, guest, firsts, at, begin = unused(docs, "block", "guest", "firsts", "at", "begin")
    ids = docs.select("doc_id").where("doc_id IS NOT NULL")
    n = max(1, min(MOST_BLOCKS, -(-ids.count() // BLOCK)))
    begins = keep(ids.repartitionByRange(n, "doc_id").groupBy(F.spark_partition_id().alias(at)).agg(F.min("doc_id").alias(begin)))
    bounds = begins.agg(F.sort_array(F.collect_list(begin)).alias(firsts))
    size = F.size(firsts)
    halves = F.array(*[F.lit(1 << i) for i in reversed(range(MOST_BLOCKS.bit_length()))])

    def further(low: Column, step: Column) -> Column:
        return F.when((low + step < size) & (F.get(F.col(firsts), low + step) <= F.col("doc_id")), low + step).otherwise(low)

    found = docs.crossJoin(F.broadcast(bounds)).withColumn(block, F.when(F.col("doc_id").isNotNull(), F.aggregate(halves, F.lit(0), further)))
    first = F.get(F.col(firsts), F.col(block)) == F.col("doc_id")
    own = F.struct(F.coalesce(F.col(block), F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")).alias(block), F.when(F.col("doc_id").isNull(), 2).otherwise(0).alias(guest))
    other = F.struct(F.pmod(F.col(block) - 1, size).cast("int").alias(block), F.lit(1).alias(guest))
    dealt = found.withColumn(at, F.explode(F.when(first, F.array(own, other)).otherwise(F.array(own)))).select(*[F.col(f"`{c}`") for c in docs.columns], f"{at}.*")
    return dealt, block, guest, Window.partitionBy(block).orderBy(guest, "doc_id", "text")


def with_next(docs: DataFrame, name: str) -> DataFrame:
    """docs with the text of the document that follows by doc_id (after the last the first) in the column name; null without an id."""
    dealt, block, guest, order = in_order(docs)
    return dealt.withColumn(name, F.when(F.col("doc_id").isNotNull(), F.lead("text").over(order))).where(F.col(guest) != 1).drop(guest, block)


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every document.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many of the next document.
    Null texts count as empty; with no document the result is empty; a document without an id has no next one: its
    edited text loses its half and near_next is its likeness to an empty text.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt, block, guest, order = in_order(docs)
    named = F.col("doc_id").isNotNull()
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("following", F.lit(1), half))
    keys = ["doc_id", "text", block, guest]
    rows = dealt.select(*keys, F.coalesce(F.when(named, F.lead("text").over(order)), F.lit("")).alias("following"))
    rows = rows.select(*keys, n.cast("long").alias("n_chars"), edited.alias("edited"))
    rows = rows.select(*keys, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), prints(F.col("text")).alias("own"), prints(F.col("edited")).alias("changed"))
    rows = rows.select("*", hashes(F.col("own")).alias("a"), hashes(F.col("changed")).alias("b"))
    rows = rows.select("*", F.coalesce(F.when(named, F.lead("a").over(order)), F.array().cast("array<long>")).alias("c")).where(F.col(guest) != 1)
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", shown(F.col("own")).alias("fingerprint"), shown(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"),
    )
