"""Substring dedup by repeated-phrase automata.

Each window of 20 words has an anchor, the smallest hash among its runs of 10 words, so equal windows have equal
anchors. Anchors that several documents hold mark recurring passages; the smallest such document owns the anchor. A
shard is an owner: its windows at shared anchors, confirmed word by word, are compiled to an Aho-Corasick automaton,
through which every document that holds one of those anchors is streamed, dealt over as many tasks as the shard needs.
What the owner does not hold but several others may (windows at a shared anchor that the automaton did not find) is
met by a 128-bit hash of the window. Repeats inside one document are found in it alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, table
from .wordhash import digest, hashes, runs, split, text_hashes

#: Words of a window; words of the runs among which its anchor is chosen.
WINDOW, RUN = 20, 10
#: Documents that one task streams through an automaton before the next task of the shard takes over.
SHARE = 400


def anchors(h: np.ndarray, window: int, run: int) -> np.ndarray:
    """For each window of the word hashes h, the smallest hash of its runs."""
    x = runs(h, run)
    if len(h) < window:
        return x[:0]
    span, n = 1, window - run + 1
    while span < n:
        step = min(span, n - span)
        x = np.minimum(x[:-step], x[step:])
        span += step
    return x


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hs = [hashes(split(x)) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(h) for h in hs], pa.int64()), pa.array([digest(h, 1) for h in hs], pa.int64()), pa.array([digest(h, 2) for h in hs], pa.int64())],
            ["doc_id", "n_words", "d1", "d2"],
        )


def _anchors(window: int, run: int):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                found = [np.unique(anchors(hashes(split(x)), window, run)) for x in part["text"]]
                yield pd.DataFrame({"anchor": _signed(np.concatenate(found)), "doc_id": np.repeat(part["doc_id"].to_numpy(np.int64), [len(x) for x in found])})

    return of


def spans(flags: np.ndarray, window: int) -> list[int]:
    """Starts and ends, in turn, of the words that the flagged windows cover."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    gaps = np.flatnonzero(np.diff(at) > window)
    return np.ravel(np.column_stack([at[np.r_[0, gaps + 1]], at[np.r_[gaps, len(at) - 1]] + window])).tolist()


def _stream(window: int, run: int):
    """Rows of (owner, share) in order, the owner's own row first: spans found in the owner, and windows that were not."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, machine, ids, owned = None, None, {}, None
        for batch in batches:
            out: dict[str, list] = {"doc_id": [], "spans": [], "h1": [], "h2": [], "at": []}
            for owner, share, doc_id, text, marks in zip(batch["owner"], batch["share"], batch["doc_id"], batch["text"], batch["marks"], strict=True):
                words = split(text)
                h = hashes(words)
                flags = np.isin(_signed(anchors(h, window, run)), np.asarray(marks, np.int64))
                if now != (owner, share):
                    now, machine, ids, owned = (owner, share), ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), {}, None
                if doc_id == owner:
                    coded = [ids.setdefault(w, len(ids) + 1) for w in words]
                    for i in np.flatnonzero(flags):
                        machine.add_word(tuple(coded[i : i + window]), 1)
                    continue
                if owned is None:
                    owned = len(machine)
                    if owned:
                        machine.make_automaton()
                met = np.zeros(len(flags), bool)
                if owned:
                    met[[end - window + 1 for end, _ in machine.iter(tuple([ids.get(w, 0) for w in words]))]] = True
                out["doc_id"].append(doc_id)
                out["spans"].append(spans(met, window))
                rest = np.flatnonzero(flags & ~met)
                out["h1"].append(_signed(runs(h, window, 11)[rest]))
                out["h2"].append(_signed(runs(h, window, 13)[rest]))
                out["at"].append(rest)
            yield pd.DataFrame(out)

    return of


def _removed(window: int):
    """One row for each document: the words that repeats inside it and the spans given cover are dropped."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, gone = [], [], []
            for text, copy, cover in zip(batch.column("text").to_pylist(), batch.column("copy").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = split(text)
                n = len(words)
                drop = np.zeros(n, bool)
                if copy and n >= window:
                    drop[:] = True
                else:
                    for span in cover or []:
                        for a, e in zip(span[::2], span[1::2], strict=True):
                            drop[a:e] = True
                    for i in inner_repeats(words, window):
                        drop[i : i + window] = True
                texts.append(b" ".join([w for w, d in zip(words, drop.tolist(), strict=True) if not d]).decode("utf-8", "surrogatepass"))
                counts.append(n)
                gone.append(int(drop.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], ["row", "kept_text", "n_words", "n_removed"]
            )

    return of


def inner_repeats(words: list[bytes], window: int) -> list[int]:
    """The starts of the windows that also start earlier in the same document, confirmed word by word."""
    x = runs(hashes(words), window, 11)
    order = np.argsort(x, kind="stable")
    same = np.flatnonzero(x[order][1:] == x[order][:-1]) + 1
    out, first = [], {}
    for i in same:
        a, b = int(order[i - 1]), int(order[i])
        first[b] = a = first.get(a, a)
        if words[a : a + window] == words[b : b + window]:
            out.append(b)
    return out


def without_repeats(docs: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """docs with a struct _dedup: kept_text (words kept, joined by one space), n_words and n_removed.

    A word goes if a window of so many words covers it whose words also start earlier: in a smaller doc_id, or in
    the same document at an earlier start. Windows are judged on the input. Null text has no words. Rows of one
    doc_id count as one document, in which equal places do not precede each other; a row without id is compared with
    itself only. Other columns pass through, but for a column _dedup of the input.
    """
    run = min(run, window)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = plain.where("doc_id IS NOT NULL")
    base = keep(named.mapInArrow(_base, "doc_id long, n_words long, d1 long, d2 long"))
    same = ["n_words", "d1", "d2"]
    first = base.where(F.col("n_words") >= window).groupBy(*same).agg(F.min("doc_id").alias("first"))
    copies = keep(base.join(first, same).where("doc_id <> first").groupBy("doc_id").agg(F.lit(True).alias("copy")))

    marks = named.mapInPandas(_anchors(window, run), "anchor long, doc_id long")
    by_anchor = Window.partitionBy("anchor").orderBy("doc_id")
    held = marks.withColumn("owner", F.first("doc_id").over(by_anchor)).where("doc_id <> owner")
    held = keep(held.join(copies, "doc_id", "left_anti"))
    shared = keep(held.groupBy("owner", "doc_id").agg(F.collect_set("anchor").alias("marks")))  # of one document: no more than its words
    shares = shared.groupBy("owner").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    shares = keep(shares)
    guests = shared.join(shares, "owner").select("owner", F.pmod(F.xxhash64("doc_id"), F.col("shares")).cast("int").alias("share"), "doc_id", "marks")
    own_marks = held.select("owner", "anchor").distinct().groupBy("owner").agg(F.collect_set("anchor").alias("marks"))
    hosts = own_marks.join(shares, "owner").select("owner", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("owner").alias("doc_id"), "marks")
    routed = guests.unionByName(hosts).join(named, "doc_id").withColumn("guest", F.col("doc_id") != F.col("owner"))
    routed = routed.repartition("owner", "share").sortWithinPartitions("owner", "share", "guest", "doc_id").select("owner", "share", "doc_id", "text", "marks")
    streamed = keep(routed.mapInPandas(_stream(window, run), "doc_id long, spans array<int>, h1 array<long>, h2 array<long>, at array<int>"))
    rest = streamed.select("doc_id", F.explode(F.arrays_zip("h1", "h2", "at")).alias("w")).select("doc_id", "w.*").distinct()
    least = rest.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = rest.join(least, ["h1", "h2"]).where(F.struct("doc_id", "at") != F.col("first")).select("doc_id", F.array("at", F.col("at") + window).alias("spans"))
    cover = streamed.where(F.size("spans") > 0).select("doc_id", "spans").unionByName(later)
    cover = cover.groupBy("doc_id").agg(F.collect_list("spans").alias("spans"))
    known = cover.join(copies, "doc_id", "full_outer").withColumnRenamed("doc_id", "_known_id")

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "_dedup"])
    whole = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text"), row.alias("row"))
    ready = whole.join(known, F.col("_id") == F.col("_known_id"), "left").select("row", "text", "copy", "spans")
    kind = ready.schema["row"].dataType.simpleString()
    return ready.mapInArrow(_removed(window), f"row {kind}, kept_text string, n_words long, n_removed long").select("row.*", F.struct("kept_text", "n_words", "n_removed").alias("_dedup"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document, windows of 20 words."""
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_dedup.n_words").alias("n_words"), F.col("_dedup.n_removed").alias("n_removed"), F.sha2("_dedup.kept_text", 256).alias("kept_sha256"))
