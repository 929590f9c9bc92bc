"""Quality classifier: a convolutional network over bytes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, table

#: Bytes in a chunk and between the starts of chunks; bytes a filter spans and moves by; filters.
CHUNK, STEP, WIDTH, STRIDE, FILTERS = 512, 448, 6, 2, 16
#: Bounds of the sample of labelled rows that the network is fitted on: rows of each label, and bytes of all their texts.
ROWS, BYTES = 1500, 1 << 26


def chunks(text: str | None) -> np.ndarray:
    """All of a text's bytes in overlapping chunks, the last padded with zeros; none for an empty text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    starts = range(0, max(1, len(raw) - (CHUNK - STEP)), STEP) if raw else range(0)
    return np.frombuffer(b"".join([raw[i : i + CHUNK].ljust(CHUNK, b"\0") for i in starts]), np.uint8).reshape(-1, CHUNK)


@dataclass
class Network:
    """Filters as tables of weights by offset and byte, then two pooled features of each filter in a logistic sum."""

    filters: np.ndarray  # WIDTH, 256, FILTERS
    bias: np.ndarray  # FILTERS
    weights: np.ndarray  # 2 * FILTERS: of the mean and of the largest over the chunks
    rest: np.ndarray  # 1

    @classmethod
    def new(cls, seed: int = 0) -> Network:
        r = np.random.default_rng(seed)
        return cls(*[x.astype(np.float32) for x in (r.normal(0, 0.1, (WIDTH, 256, FILTERS)), np.zeros(FILTERS), r.normal(0, 0.1, 2 * FILTERS), np.zeros(1))])

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each chunk and filter the largest response, and where it is."""
        n = (CHUNK - WIDTH) // STRIDE + 1
        z = self.filters[0][x[:, : STRIDE * n : STRIDE]]
        for o in range(1, WIDTH):
            z += self.filters[o][x[:, o : o + STRIDE * n : STRIDE]]
        # places past the end of a padded chunk do not count, but for its first
        used = CHUNK - (x[:, ::-1] != 0).argmax(1)
        for i in np.flatnonzero(used < CHUNK):
            z[i, max(1, (used[i] - 1) // STRIDE + 1) :] = -np.inf
        at = z.argmax(1)
        return np.take_along_axis(z, at[:, None], 1)[:, 0], at

    def responses(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As pooled, some chunks at a time."""
        parts = [self.pooled(x[a : a + 512]) for a in range(0, len(x), 512)]
        return np.concatenate([m for m, _ in parts]), np.concatenate([at for _, at in parts])

    def score(self, texts: list[str | None]) -> np.ndarray:
        """One probability for each whole text."""
        cut = [chunks(t) for t in texts]
        sizes = np.array([len(c) for c in cut])
        out = np.zeros((len(texts), 2 * FILTERS), np.float32)
        first, held = 0, 0
        for i in range(len(cut) + 1):  # some texts at a time; a very long one in parts
            if i == len(cut) or held > 256:
                if held:
                    x = np.concatenate(cut[first:i])
                    h = np.maximum(self.responses(x)[0] + self.bias, 0)
                    some = first + np.flatnonzero(sizes[first:i])
                    starts = np.r_[0, np.cumsum(sizes[some])[:-1]]
                    out[some] = np.hstack([np.add.reduceat(h, starts) / sizes[some][:, None], np.maximum.reduceat(h, starts)])
                first, held = i, 0
            held += len(cut[i]) if i < len(cut) else 0
        return 1 / (1 + np.exp(-np.clip(out @ self.weights + self.rest[0], -30, 30).astype(np.float64)))

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, epochs: int = 10, batch: int = 48, rate: float = 0.01, decay: float = 1e-4, seed: int = 0) -> Network:
        """Adam on the log loss, labels weighing alike; the gradient of a maximum goes to where it was found."""
        r, params = np.random.default_rng(seed), [self.filters, self.bias, self.weights, self.rest]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
        t = 0
        for _ in range(epochs):
            order = r.permutation(len(rows))
            for a in range(0, len(order), batch):
                pick = order[a : a + batch]
                x, sizes = np.concatenate([rows[i] for i in pick]), np.array([len(rows[i]) for i in pick])
                starts, row = np.r_[0, np.cumsum(sizes)[:-1]], np.repeat(np.arange(len(pick)), sizes)
                m, at = self.responses(x)
                h = np.maximum(m + self.bias, 0)
                top = np.maximum.reduceat(h, starts)
                f = np.hstack([np.add.reduceat(h, starts) / sizes[:, None], top])
                d = ((1 / (1 + np.exp(-np.clip(f @ self.weights + self.rest[0], -30, 30))) - labels[pick]) * weight[pick] / len(pick)).astype(np.float32)
                dh = d[row, None] * self.weights[None, :FILTERS] / sizes[row, None] + d[row, None] * self.weights[None, FILTERS:] * (h == top[row])
                dm = (dh * (m + self.bias > 0)).astype(np.float32)
                grads = [np.zeros_like(self.filters), dm.sum(0), f.T @ d, d.sum(keepdims=True)]
                for o in range(WIDTH):
                    np.add.at(grads[0][o], (np.take_along_axis(x, at * STRIDE + o, 1), np.arange(FILTERS)[None]), dm)
                t += 1
                for p, g, (u, v) in zip(params, grads, moments, strict=True):
                    g = g + decay * p
                    u += 0.1 * (g - u)
                    v += 0.001 * (g * g - v)
                    p -= (rate * (u / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5))


def trained(docs: DataFrame, labels: DataFrame, rows: int = ROWS, most: int = BYTES) -> Network | None:
    """A network fitted on a sample of labelled rows whose fold is not 0, each with all chunks of its whole text.

    The sample holds at most rows of each quality, the first by a hash of the id, chosen from the labels alone, so
    texts are filtered by a broadcast list of at most twice as many ids; and of these, in that order, as many as
    have most bytes together (a row that would go beyond is left out). None without rows of both qualities.
    """
    ids = []
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != 0)).select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    for y in (0, 1):
        ids += [(r.doc_id, y) for r in usable.where(F.col("quality") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()]
    if {y for _, y in ids} != {0, 1}:
        return None
    sample = docs.sparkSession.createDataFrame(ids, "doc_id long, quality int")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    found = keep(found.withColumn("size", F.octet_length("text")).where("size > 0").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * rows))
    picked, held = set(), 0
    for r in found.select("doc_id", "size").orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if held + r.size <= most:
            picked.add(r.doc_id)
            held += r.size
    got = sorted((r.doc_id, r.quality, r.text) for r in found.where(F.col("doc_id").isin(list(picked))).collect()) if picked else []
    if {q for _, q, _ in got} != {0, 1}:
        return None
    return Network.new().fit([chunks(x) for *_, x in got], np.array([q for _, q, _ in got]))


def scored(docs: DataFrame, network: Network | None) -> DataFrame:
    """docs without text, with score: the network's probability for the whole text, 0.5 if there is none.

    Null and empty texts have no chunks: their score is the network's for nothing found. Other columns pass through,
    but for a column _score of the input.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(network)  # some 100 kB, whatever the data

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            score = np.full(len(texts), 0.5) if held.value is None else held.value.score(texts)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(score, pa.float64())], ["row", "score"])

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("text", "_score")]).alias("row")
    whole = docs.select(row, "text")
    return whole.mapInArrow(of, f"row {whole.schema['row'].dataType.simpleString()}, score double").select("row.*", F.col("score").alias("_score"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; labels of held-out rows are not learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, trained(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.3).cast("int").alias("predicted"))
