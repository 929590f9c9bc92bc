"""Phrase collocation mining with position bitmaps.

A task numbers the words of its texts, an empty place behind each piece, and keeps for each word a bitmap of its places,
compressed to the bytes that hold a bit. A phrase's bitmap has a bit at its last word. Shifted by one place and met with
the bitmap of another word, byte by byte, it becomes the bitmap of the phrase that is longer by that word; what is left
is counted by popcount. A batch of phrases is extended down to its last words before the next one begins. Counts of all
tasks' shards are summed by phrase, so they are those of the whole corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import wordhash
from .common import keep, table

#: Words of a phrase at most, its least count, the share of its count at which a longer one covers it, phrases of a language.
LONGEST, LEAST, COVERED, TOP, SCALE = 4, 30, (80, 100), 2000, 2_000_000
#: Words of a shard, pairs of bitmap bytes that meet at a time, bytes of text that are split at a time.
SHARD, MEETING, SLICE = 250_000, 1 << 19, 1 << 22
#: How many times as many words a shard has where whole phrases are counted.
LONG = 2
#: Bits of the filter of frequent phrases: at least, at most, and for each phrase.
FILTER_BITS, MOST_FILTER_BITS, BITS_PER_PHRASE = 1 << 20, 1 << 28, 256
#: Numbers that pairs are counted by at first, for each word there is; pairs that share one are told apart afterwards.
KEYS_PER_WORD = 16
#: Parts that longer phrases are dealt over by their first two words.
PARTS = 1024
#: Parts the languages of a top list are cut into before they meet.
SALTS = 64
UNKNOWN = "und"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_FOUND, _KEYED, _DEALT = "lang string, phrase string, f long", "key long, f long", "part int, lang string, phrases string, counts array<int>"


def slices(raw: bytes) -> Iterator[bytes]:
    """raw in parts of about SLICE bytes, cut behind the ends of pieces; a longer piece stays whole."""
    while len(raw) > SLICE:
        ends = np.flatnonzero(_KIND[np.frombuffer(raw, np.uint8)[SLICE:]] == 2)
        if not len(ends):
            break
        yield raw[: SLICE + ends[0] + 1]
        raw = raw[SLICE + ends[0] + 1 :]
    yield raw


def places(raw: bytes) -> tuple[pa.Array, np.ndarray]:
    """The words of some text and the place of each: one further than the last, two if a piece ends between them."""
    kind = _KIND[np.frombuffer(raw, np.uint8)]
    of_word = kind == 0
    starts = np.flatnonzero(of_word & np.append(True, ~of_word[:-1])) if len(raw) else np.empty(0, np.int64)
    if not len(starts):
        return pa.array([], pa.binary()), starts
    ends = np.flatnonzero(of_word & np.append(~of_word[1:], True)) + 1
    offsets = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.frombuffer(raw, np.uint8)[of_word].tobytes())])
    borders = np.append(0, np.cumsum(kind == 2))[starts]
    return words, np.arange(len(starts)) + np.cumsum(np.append(0, np.diff(borders) > 0))


class Bitmaps:
    """Bitmaps of several items: entries (item, byte, mask) for each byte that holds a bit, in the order of bytes."""

    def __init__(self, item: np.ndarray, byte: np.ndarray, mask: np.ndarray):
        self.item, self.byte, self.mask = item, byte, mask

    @classmethod
    def of(cls, item: np.ndarray, place: np.ndarray) -> Bitmaps:
        """From the places at which items stand, in order."""
        return cls(item, place >> 3, np.uint8(1) << (place & 7).astype(np.uint8)).merged()

    def merged(self) -> Bitmaps:
        """Entries of one item and byte as one."""
        order = np.lexsort((self.item, self.byte))
        item, byte, mask = self.item[order], self.byte[order], self.mask[order]
        first = np.flatnonzero(np.append(True, (np.diff(item) != 0) | (np.diff(byte) != 0))) if len(item) else order
        return Bitmaps(item[first], byte[first], np.bitwise_or.reduceat(mask, first) if len(first) else mask)

    def shifted(self) -> Bitmaps:
        """Every bit one place on; the last bit of a byte goes to the first of the next."""
        over = self.mask >= 128
        left = (self.mask << np.uint8(1)).astype(np.uint8)
        return Bitmaps(np.append(self.item[left > 0], self.item[over]), np.append(self.byte[left > 0], self.byte[over] + 1), np.append(left[left > 0], np.ones(over.sum(), np.uint8))).merged()

    def part(self, keep: np.ndarray) -> Bitmaps:
        return Bitmaps(self.item[keep], self.byte[keep], self.mask[keep])

    def met(self, words: Bitmaps) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(item, word, byte, mask) of all items and words that share a bit: the AND of entries with one byte."""
        low, high = np.searchsorted(words.byte, self.byte), np.searchsorted(words.byte, self.byte, "right")
        times = high - low
        a = np.repeat(np.arange(len(self.item), dtype=np.int32), times)
        b = (np.arange(len(a)) + np.repeat(low - (np.cumsum(times) - times), times)).astype(np.int32)
        mask = self.mask[a] & words.mask[b]
        hit = np.flatnonzero(mask)
        a, b = a[hit], b[hit]
        return self.item[a], words.item[b], self.byte[a], mask[hit]


def _filter_key(lang: str, hashes: np.ndarray) -> np.ndarray:
    """A number for each phrase of a language from the hashes of its words, one row for each phrase."""
    out = np.full(len(hashes), xxhash.xxh3_64_intdigest(lang.encode("utf-8")), np.uint64)
    for i in range(hashes.shape[1]):
        out = wordhash.mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[:, i])
    return out


class Frequent:
    """A bitmap of phrases that are frequent: it lets all of these pass, and few others."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def __call__(self, lang: str, hashes: np.ndarray) -> np.ndarray:
        return self.holds(_filter_key(lang, hashes))

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at = keys % np.uint64(len(self.bits) * 8)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def word_keys(words: DataFrame) -> DataFrame:
    """(key) of words (lang, phrase): the number that tasks know each of them by."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in pc.unique(batch["lang"]).to_pylist():
                found = batch["phrase"].filter(pc.equal(batch["lang"], lang)).to_pylist()
                at = _filter_key(lang, wordhash.hashes([x.encode("utf-8") for x in found])[:, None])
                yield pa.RecordBatch.from_arrays([pa.array((at % np.uint64(MOST_FILTER_BITS)).astype(np.int64))], ["key"])

    return words.select("lang", "phrase").mapInArrow(keys, "key long")


def frequent(keys: DataFrame) -> Frequent:
    """The filter of what has these keys; MOST_FILTER_BITS (32 MB) at most, whatever their number."""
    n_bits = FILTER_BITS
    most = min(MOST_FILTER_BITS, BITS_PER_PHRASE * keys.count())
    while n_bits < most:
        n_bits *= 2
    # Spark counts the bits of its bitmaps from 1.
    spot = keys.select((F.col("key") % n_bits + 1).alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("number"))
    bits = np.zeros(n_bits // 8, np.uint8)
    for r in spot.agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits")).toLocalIterator():
        bits[(r.number - 1) * 4096 : (r.number - 1) * 4096 + len(r.bits)] = np.frombuffer(bytes(r.bits), np.uint8)[: len(bits)]
    return Frequent(bits)


class Shard:
    """The words of one language that a task has gathered."""

    def __init__(self, lang: str):
        self.lang, self.words, self.places, self.end, self.size = lang, [], [], 0, 0

    def add(self, raw: bytes) -> None:
        words, at = places(raw)
        if len(words):
            self.words.append(words)
            self.places.append(at + self.end)
            self.end += int(at[-1]) + 2
            self.size += len(words)

    def coded(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The distinct words, and for each word its number among them and its place."""
        coded = pa.chunked_array(self.words, pa.binary()).combine_chunks().dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), np.concatenate(self.places)


def _rows(lang: str, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), phrases.cast(pa.string()), pa.array(counts.astype(np.int64))], ["lang", "phrase", "f"])


def _dealt(lang: str, words: pa.Array, first: np.ndarray, phrases: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A row for each part of phrases, given by the numbers of their words (-1: none), first the key of each one's first two.

    Phrases that begin alike stand next to each other, so that what is shuffled is compressed well. No word holds a line feed.
    """
    part = (first % np.uint64(PARTS)).astype(np.int32)
    order = np.lexsort((*phrases.T[::-1], part))
    part, phrases, counts = part[order], phrases[order], counts[order]
    size = (phrases >= 0).sum(1)
    ends = np.cumsum(size)
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), words.take(pa.array(phrases[phrases >= 0]))), b" ")
    starts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)).astype(np.int32)
    lists = lambda values: pa.ListArray.from_arrays(pa.array(starts), values)
    n = len(starts) - 1
    return pa.RecordBatch.from_arrays([pa.array(part[starts[:-1]]), pa.array([lang] * n, pa.string()), pc.binary_join(lists(text), b"\n").cast(pa.string()), lists(pa.array(counts.astype(np.int32)))], ["part", "lang", "phrases", "counts"])


def word_counts(shard: Shard) -> Iterator[pa.RecordBatch]:
    """The count of each word, and of all of them without a phrase."""
    words, codes, _ = shard.coded()
    yield _rows(shard.lang, words, np.bincount(codes, minlength=len(words)))
    yield _rows(shard.lang, pa.array([None], pa.binary()), np.array([len(codes)]))


def phrase_counts(shard: Shard, words_kept: Frequent, pairs_kept: Frequent | None, keys: int = 0) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases whose words and pairs are all frequent; without pairs_kept, of the numbers (below keys) of pairs of frequent words."""
    words, codes, place = shard.coded()
    hashes = wordhash.hashes(words.to_pylist())
    fine = words_kept(shard.lang, hashes[:, None])[codes]
    single = Bitmaps.of(codes[fine].astype(np.int64), place[fine])
    if not len(single.item):
        return
    each = np.searchsorted(single.byte, single.byte, "right") - np.searchsorted(single.byte, single.byte)
    # Batches of first words whose bytes meet about MEETING others.
    order = np.argsort(single.item, kind="stable")
    batch = np.empty(len(order), np.int64)
    batch[order] = np.cumsum(each[order]) // MEETING
    first_batch = np.full(len(words), np.iinfo(np.int64).max)
    np.minimum.at(first_batch, single.item, batch)
    batch = first_batch[single.item]
    found: list[tuple] = []
    for n in np.unique(batch):
        prefix = single.part(batch == n)
        phrases = np.arange(len(words))[:, None]
        for length in range(2, LONGEST + 1):
            item, word, byte, mask = prefix.shifted().met(single)
            if not len(item):
                break
            # Every phrase here ends in a word whose pair with the next one has to be frequent.
            pairs, of = np.unique(phrases[item, -1] * len(words) + word, return_inverse=True)
            named = _filter_key(shard.lang, np.stack([hashes[pairs // len(words)], hashes[pairs % len(words)]], 1))
            if pairs_kept is None:
                counts = np.bincount(of, np.bitwise_count(mask), len(pairs))
                yield pa.RecordBatch.from_arrays([pa.array((named % np.uint64(keys)).astype(np.int64)), pa.array(counts.astype(np.int64))], ["key", "f"])
                break
            fine = pairs_kept.holds(named)[of]
            item, word, byte, mask = item[fine], word[fine], byte[fine], mask[fine]
            if not len(item):
                break
            longer, of = np.unique(item * len(words) + word, return_inverse=True)
            phrases = np.column_stack([phrases[longer // len(words)], longer % len(words)])
            counts = np.bincount(of, np.bitwise_count(mask), len(longer))
            padded = np.full((len(longer), LONGEST), -1, np.int32)
            padded[:, :length] = phrases
            found.append((_filter_key(shard.lang, hashes[phrases[:, :2]]), padded, counts))
            prefix = Bitmaps(of.astype(np.int64), byte, mask)
    if found:
        yield _dealt(shard.lang, words, *(np.concatenate(x) for x in zip(*found, strict=True)))


def counted(docs: DataFrame, of_shard, schema: str = _FOUND) -> DataFrame:
    """What of_shard counts in the shards of docs (lang, text), summed over all of them: f by the other columns of schema."""

    # What is dealt is not summed before it is shuffled, so a larger shard shuffles less.
    words = SHARD * (LONG if schema == _DEALT else 1)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, Shard] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                shard = shards.setdefault(lang, Shard(lang))
                for raw in slices(text.encode("utf-8", "replace").translate(_LOWER)):
                    shard.add(raw)
                    if shard.size >= words:
                        yield from of_shard(shard)
                        shard = shards[lang] = Shard(lang)
        for shard in shards.values():
            if shard.size:
                yield from of_shard(shard)

    made = docs.mapInArrow(found, schema)
    if schema == _DEALT:
        each = F.explode(F.arrays_zip(F.split("phrases", "\n").alias("phrase"), F.col("counts").alias("f"))).alias("x")
        rows = made.repartition("part").select("part", "lang", each).select("part", "lang", "x.phrase", F.col("x.f").cast("long").alias("f"))
        return rows.groupBy("part", "lang", "phrase").agg(F.sum("f").alias("f")).drop("part")  # a part is whole where it is
    return made.groupBy(*[c for c in made.columns if c != "f"]).agg(F.sum("f").alias("f"))


def frequent_phrases(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all words and phrases that stand LEAST times or more, and (lang, n), the number of all words.

    Null languages are one, a null text has no words. Words are counted first. Then pairs of frequent words are counted
    by numbers, of which there are more than words, so that little is shuffled; a number may stand for several pairs,
    which lets a few more pass. Last, phrases of which all pairs pass are counted as they are, and these sums decide.
    """
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    sc = docs.sparkSession.sparkContext
    singles = keep(counted(texts, word_counts).where(f"phrase IS NULL OR f >= {LEAST}"))
    totals = singles.where("phrase IS NULL").select("lang", F.col("f").alias("n"))
    singles = singles.where("phrase IS NOT NULL")
    words_kept = sc.broadcast(frequent(word_keys(singles)))
    keys = MOST_FILTER_BITS
    most = KEYS_PER_WORD * (totals.agg(F.sum("n")).first()[0] or 0)
    while keys < most:
        keys *= 2
    pairs = keep(counted(texts, lambda shard: phrase_counts(shard, words_kept.value, None, keys), _KEYED).where(f"f >= {LEAST}").select("key"))
    pairs_kept = sc.broadcast(frequent(pairs))
    longer = keep(counted(texts, lambda shard: phrase_counts(shard, words_kept.value, pairs_kept.value), _DEALT).where(f"f >= {LEAST}"))
    return singles.unionByName(longer), totals


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: the best phrases of each language of docs (lang, text).

    Products are decimals, so they are exact. Ties go to the more frequent phrase, then to the first in byte order.
    """
    found, totals = frequent_phrases(docs)
    n_words = F.size(F.split("phrase", " "))
    candidates = found.where(n_words > 1).select("lang", "phrase", F.col("f").alias("a"))
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), n_words - 1)))
    cut = cut.withColumn("head", F.expr("substring_index(phrase, ' ', k)")).withColumn("tail", F.substr("phrase", F.length("head") + 2))
    side = lambda part, name: found.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    cut = cut.join(side("head", "l"), ["lang", "head"]).join(side("tail", "r"), ["lang", "tail"]).withColumn("product", exact("a") * F.lit(SCALE)).withColumn("both", exact("l") + exact("r"))
    scored = cut.withColumn("score", F.expr("product div both")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    words = F.split("phrase", " ")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), n_words - 1), lambda m: F.transform(F.sequence(F.lit(1), n_words - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))))
    covers = candidates.where(n_words > 2).select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    share, whole = COVERED
    left = scored.join(covers, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (exact("longer") * whole < exact("a") * share))
    left = left.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    some = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases over all documents.

    Repeated rows count each, a null text counts as empty and a null language as `und`; without any words there is no row.
    """
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


OP11_SQL = f"""
WITH pieces AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, phrase, f AS a, m, unnest(range(1, m)) AS k FROM f WHERE m > 1),
parts AS (SELECT *, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1 : m], ' ') AS tail FROM c),
cuts AS (SELECT p.lang, p.phrase, p.a, p.m, k, x.f AS l, y.f AS r, ({SCALE} * p.a) // (x.f + y.f) AS score FROM parts p JOIN f x ON x.lang = p.lang AND x.phrase = head JOIN f y ON y.lang = p.lang AND y.phrase = tail),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
covers AS (SELECT s.lang, s.phrase, max(g.f) AS longer FROM scored s JOIN f g ON g.lang = s.lang AND g.m > s.m AND contains(' ' || g.phrase || ' ', ' ' || s.phrase || ' ') GROUP BY ALL),
best AS (SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank FROM scored s LEFT JOIN covers c ON c.lang = s.lang AND c.phrase = s.phrase WHERE longer IS NULL OR {COVERED[1]} * longer < {COVERED[0]} * a)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM best JOIN totals USING (lang) WHERE rank <= {TOP}
"""
