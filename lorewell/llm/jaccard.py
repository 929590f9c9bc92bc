"""N-gram Jaccard join: an index of count vectors, its tree descended from the top, verified links, components.

Exact for any pair of texts. Hash deals the shingles of a set over parts, more of them than shingles that two linked
sets of its size do not share, so some parts of both are alike. These parts, of about three shingles and more, are the
root level of the index: texts that meet by chance share a shingle now and then, a whole part hardly ever, however many
they are. Parts have one order for all texts, those with many rare shingles first, and only the first ones that must
hold an equal one are keys. The texts that share one form a group, named after the smallest of them, so the groups of
copies of one text are few. In a group, texts are points, their counts of shingles in DIMS hashed groups, packed into a
tree of boxes; the summed minima of two upper corners bound the overlap from above, and pairs of boxes are followed
down from the root while the bound allows a link. Texts that pairs which may link connect form a cell. A text is in one
cell at most, where it meets the others with its whole set, and only links that join two components leave the task.

At thresholds below PARTED parts would hold a shingle or none; the first shingles of each set, rare ones first, are the
keys there.

A tree over all texts alone would not do: boxes around unrelated texts bound nothing, so each text would visit all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, perhaps_among, table
from .components import components
from .wordhash import mixed, runs, text_hashes

#: Coordinates of a point, twice as many for each doubling of SMALL shingles; points in a leaf; children of an inner box.
DIMS, SMALL, LEAF, FAN = 128, 1024, 16, 8
#: Texts and shingles of a block, the most that one side of a search holds at a time.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 21
#: Characters of the texts that a task works on at a time; a longer text is a part of its own.
PART = 1 << 20
#: A counter that is full: its coordinate bounds nothing.
FULL = 255
#: Bits of a shingle's hash that name its counter; counters that may stand as frequent. Both shape the order of
#: shingles and parts, and with it the work, never the result.
COUNTER_BITS, FREQUENT = 20, 1 << 16
#: Parts beyond those that linked sets need, in percent; the threshold below which single shingles are keys.
SPARE, PARTED = 30, Fraction(3, 4)
#: Bits of a shingle's hash; the five above them hold how frequent it is.
HASH_BITS = 59


def _sets(texts: list[str | None], k: int, levels: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles of many texts in order, one text after another, and how many each has.

    A shingle is its 59-bit hash under its level, how frequent its counter is. A text of fewer than k words is one shingle.
    """
    h, n_words = text_hashes(texts, lower=True)
    begin = np.cumsum(n_words) - n_words
    made = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    starts = np.cumsum(made) - made
    x = np.empty(made.sum(), np.uint64)
    whole = np.flatnonzero(n_words >= k)
    if len(whole):
        within = np.arange(made[whole].sum()) - np.repeat(np.cumsum(made[whole]) - made[whole], made[whole])
        x[np.repeat(starts[whole], made[whole]) + within] = runs(h, k)[np.repeat(begin[whole], made[whole]) + within]
    for i in np.flatnonzero((n_words > 0) & (n_words < k)):
        x[starts[i]] = runs(h[begin[i] : begin[i] + n_words[i]], int(n_words[i]))[0]
    x >>= np.uint64(64 - HASH_BITS)
    if levels is not None:
        x |= levels[(x >> np.uint64(HASH_BITS - COUNTER_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(HASH_BITS)
    for a, n in zip(starts.tolist(), made.tolist(), strict=True):
        x[a : a + n].sort()
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    some = np.flatnonzero(made)
    new[starts[some]] = True
    sizes = np.zeros(len(texts), np.int64)
    if len(some):
        sizes[some] = np.add.reduceat(new.astype(np.int64), starts[some])
    return x[new], sizes


def _digests(s: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A signed 64-bit digest of each set, whatever the order of its shingles."""
    sums = np.zeros(len(sizes), np.uint64)
    np.add.at(sums, np.repeat(np.arange(len(sizes)), sizes), mixed(s & np.uint64((1 << HASH_BITS) - 1), 7))
    return mixed(sums ^ sizes.astype(np.uint64), 9).view(np.int64)


def prefix(n: np.ndarray, t: Fraction) -> np.ndarray:
    """How many of the first shingles of sets of n include the first one that a linked set shares."""
    return np.where(n > 0, n - -((-t.numerator * n) // t.denominator) + 1, 0)


def apart(n: np.ndarray, t: Fraction) -> np.ndarray:
    """The most shingles that a set of n and one that links with it do not share, both sides counted."""
    return (t.denominator - t.numerator) * n // t.numerator


def spans(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places starts, starts + 1, ... of ranges of n, one range after another."""
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())


def part_keys(s: np.ndarray, sizes: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Keys of sets and the index of the set that each is of: any two unlike sets that link share a key.

    For each range of sizes, up to twice the smallest, hash deals all shingles over more parts than linked sets in it
    differ in. What two linked sets do not share is in apart(n) parts at most, n the size of the smaller one; all other
    parts are alike. Parts have one order for all sets, those with many rare shingles first, so an equal one is among
    the first apart(n) + 1 of both. A set is dealt in the range of its size, and in those below where a smaller set that
    links with it can be.
    """
    keys, of = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    far, starts = apart(sizes, t), np.cumsum(sizes) - sizes
    power = lambda n: np.frexp(n.astype(np.float64))[1].astype(np.int64) - 1
    own, least = power(np.maximum(sizes, 1)), power(np.maximum(-((-t.numerator * sizes) // t.denominator), 1))
    h = mixed(s & np.uint64((1 << HASH_BITS) - 1), 11)
    g, rare = mixed(h, 13), s < np.uint64(1 << HASH_BITS)
    low, high = (g & np.uint64(0xFFFFFFFF)).astype(np.float64), (g >> np.uint64(32)).astype(np.float64)
    for down in range(int((own - least).max(initial=0)) + 1):
        at = np.flatnonzero((far > 0) & (own - down >= least))
        top = apart((2 << (own[at] - down)) - 1, t)
        m = top + 1 + np.maximum(3, top * SPARE // 100)
        n, begin = sizes[at], np.cumsum(m) - m
        x = spans(starts[at], n)
        cell = np.repeat(begin, n) + (((h[x] >> np.uint64(32)) * np.repeat(m.astype(np.uint64), n)) >> np.uint64(32)).astype(np.int64)
        sums = [np.bincount(cell, w[x], m.sum()).astype(np.uint64) for w in (low, high, rare)]
        name = mixed(spans(np.zeros(len(at), np.int64), m).astype(np.uint64) | np.repeat((own[at] - down).astype(np.uint64) << np.uint64(56), m), 15)
        name = mixed(mixed(sums[0], 17) ^ mixed(sums[1], 19) ^ name, 23)
        name = (np.uint64(255) - np.minimum(sums[2], np.uint64(255))) << np.uint64(56) | name >> np.uint64(8)
        for a, e in zip(begin.tolist(), (begin + m).tolist(), strict=True):
            name[a:e].sort()
        n = np.minimum(far[at], top) + 1
        keys.append(name[spans(begin, n)])
        of.append(np.repeat(at, n))
    return np.concatenate(keys), np.concatenate(of)


def first_keys(s: np.ndarray, sizes: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """As part_keys: the first shingles of each set. At low thresholds parts would have a shingle or none each."""
    n = prefix(sizes, t)
    return s[spans(np.cumsum(sizes) - sizes, n)], np.repeat(np.arange(len(sizes)), n)


def dims(n: np.ndarray) -> np.ndarray:
    """The coordinates of the points of sets of n shingles."""
    return DIMS << np.ceil(np.log2(np.maximum(n, SMALL) / SMALL)).astype(np.int64)


def count_vectors(s: np.ndarray, sizes: np.ndarray, d: int = DIMS) -> np.ndarray:
    """Points with d coordinates of sets: how many shingles each has in each of d groups, up to FULL."""
    at = np.repeat(np.arange(len(sizes)) * d, sizes) + (s % np.uint64(d)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=len(sizes) * d), FULL).astype(np.uint8).reshape(-1, d)


def folded(points: np.ndarray, d: int) -> np.ndarray:
    """The same sets' points with d coordinates, a smaller power of two."""
    while points.shape[1] > d:
        half = points.shape[1] // 2
        points = np.minimum(points[:, :half].astype(np.uint16) + points[:, half:], FULL).astype(np.uint8)
    return points


def overlap_needed(a, b, t: Fraction):
    """The smallest overlap of sets of sizes a and b that link."""
    p, q = t.numerator, t.numerator + t.denominator
    return -((-p * (a + b)) // q)


class Tree:
    """Points packed into boxes: levels[0] are the points in order, each level above bounds FAN (LEAF at first) of the one below."""

    def __init__(self, size: np.ndarray, points: np.ndarray) -> None:
        self.order = np.lexsort((points[:, 1], points[:, 0], size)) if len(size) else np.empty(0, np.int64)
        tops, least, most = points[self.order].astype(np.int32), size[self.order], size[self.order]
        tops[tops == FULL] = 1 << 20
        self.levels = [(tops, least, most)]
        while len(least) > LEAF:
            at = np.arange(0, len(least), FAN if len(self.levels) > 1 else LEAF)
            tops, least, most = np.maximum.reduceat(tops, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)
            self.levels.append((tops, least, most))


def _allowed(x: tuple, y: tuple, i: np.ndarray, j: np.ndarray, t: Fraction) -> np.ndarray:
    """Which pairs of boxes may hold a link, by sizes and by the summed minima of their upper corners."""
    (tops, least, most), (tops2, least2, most2) = x, y
    p, q = t.numerator, t.denominator
    ok = (q * most[i] >= p * least2[j]) & (q * most2[j] >= p * least[i])
    left, step = np.flatnonzero(ok), max(1, (1 << 20) // tops.shape[1])
    for a in range(0, len(left), step):
        part = left[a : a + step]
        bound = np.minimum(tops[i[part]], tops2[j[part]]).sum(1, dtype=np.int64)
        ok[part] = bound >= overlap_needed(least[i[part]], least2[j[part]], t)
    return ok


def tree_pairs(x: Tree, y: Tree, t: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of points of x and y whose bound allows a link, part by part; within one tree (x is y) each pair once."""
    top = max(len(x.levels), len(y.levels)) - 1
    level = lambda tree, n: min(n, len(tree.levels) - 1)
    a, b = len(x.levels[-1][1]), len(y.levels[-1][1])
    i, j = np.divmod(np.arange(a * b), b) if b else (np.empty(0, np.int64),) * 2
    stack = [(top, i, j)]
    while stack:
        n, i, j = stack.pop()
        if x is y:
            ok = i < j if n == 0 else i <= j
            i, j = i[ok], j[ok]
        ok = _allowed(x.levels[level(x, n)], y.levels[level(y, n)], i, j, t)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if n == 0:
            yield x.order[i], y.order[j]
            continue
        for at in range(0, len(i), 4096):
            below = []
            for tree, k in ((x, i[at : at + 4096]), (y, j[at : at + 4096])):
                if n < len(tree.levels):
                    fan = FAN if n > 1 else LEAF
                    below.append((k * fan, np.minimum(fan, len(tree.levels[n - 1][1]) - k * fan)))
                else:
                    below.append((k, np.ones(len(k), np.int64)))
            (a, m), (b, l) = below
            each = m * l
            within = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            stack.append((n - 1, np.repeat(a, each) + within // np.repeat(l, each), np.repeat(b, each) + within % np.repeat(l, each)))


class Forest:
    """The trees of a block of sets: one for each number of coordinates that their points have."""

    def __init__(self, sizes: np.ndarray, points: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        self.sizes, self.points, self.made = sizes, points, {}

    def tree(self, own: int, d: int) -> Tree:
        if (own, d) not in self.made:
            at, points = self.points[own]
            self.made[own, d] = Tree(self.sizes[at], folded(points, d))
        return self.made[own, d]


def forest_pairs(x: Forest, y: Forest, t: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As tree_pairs, for two blocks, or one (x is y); points of unlike numbers of coordinates meet in the smaller one."""
    for a in x.points:
        for b in y.points:
            if x is not y or a <= b:
                for i, j in tree_pairs(x.tree(a, min(a, b)), y.tree(b, min(a, b)), t):
                    yield x.points[a][0][i], y.points[b][0][j]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """doc_id and text of a batch, in parts of about PART characters."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        start = held = 0
        for i, x in enumerate(texts, 1):
            held += len(x or "")
            if held >= PART or i == len(texts):
                yield batch.column("doc_id").slice(start, i - start), texts[start:i]
                start, held = i, 0


BASE = "doc_id long, n_shingles long, d long, counter int, times long"


def _base(k: int):
    """Rows of texts, then of counters: those that fill in this task above what chance would do."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTER_BITS, np.int64)
        for ids, texts in _parts(batches):
            s, sizes = _sets(texts, k, None)
            counts += np.bincount((s >> np.uint64(HASH_BITS - COUNTER_BITS)).astype(np.int64), minlength=len(counts))
            none = lambda kind: pa.nulls(len(texts), kind)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(_digests(s, sizes)), none(pa.int32()), none(pa.int64())], ["doc_id", "n_shingles", "d", "counter", "times"])
        usual = counts.sum() / len(counts)
        often = np.flatnonzero(counts > usual + 6 * np.sqrt(usual) + 4)
        none = pa.nulls(len(often), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array(often.astype(np.int32)), pa.array(counts[often])], ["doc_id", "n_shingles", "d", "counter", "times"])

    return of


def frequent(base: DataFrame) -> np.ndarray:
    """The level of each counter: 0, or for the FREQUENT fullest 1 and up by the number of times."""
    sums = base.where("counter IS NOT NULL").groupBy("counter").agg(F.sum("times").alias("times"))
    rows = sums.orderBy(F.desc("times"), "counter").limit(FREQUENT).toArrow()
    levels = np.zeros(1 << COUNTER_BITS, np.uint8)
    levels[rows.column("counter").to_numpy()] = np.minimum(1 + np.log2(rows.column("times").to_numpy()), 31)
    return levels


def _keys(k: int, t: Fraction, levels: np.ndarray):
    """The keys of each set once a task, with its digest."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, texts in _parts(batches):
            s, sizes = _sets(texts, k, levels)
            d = _digests(s, sizes)
            new = np.array([not (x in seen or seen.add(x)) for x in d.tolist()], bool)
            s, sizes, d = s[np.repeat(new, sizes)], sizes[new], d[new]
            keys, at = (part_keys if t >= PARTED else first_keys)(s, sizes, t)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(d[at])], ["key", "d"])

    return of


def _payload(k: int, levels: np.ndarray, points: bool):
    """Each set once a task: its digest, its size and its point, or its shingles whole."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, texts in _parts(batches):
            s, sizes = _sets(texts, k, levels)
            d = _digests(s, sizes)
            new = [i for i, x in enumerate(d.tolist()) if not (x in seen or seen.add(x))]
            at = np.append(0, np.cumsum(sizes))
            load = [s[at[i] : at[i + 1]] for i in new]
            if points:
                load = [count_vectors(x, np.array([len(x)]), int(d))[0] for x, d in zip(load, dims(sizes[new]), strict=True)]
            load = [x.tobytes() for x in load]
            yield pa.RecordBatch.from_arrays([pa.array(d[new]), pa.array(sizes[new]), pa.array(load, pa.binary())], ["d", "n", "load"])

    return of


def _by_group(work: Callable[[list[np.ndarray], list[np.ndarray]], list[np.ndarray]], names: list[str]):
    """Rows in order of (pivot, low, high) in; for each such group what work makes of its blocks out.

    work gets pivot, block, d, n and load of one block and of the other, or twice the same if low is high.
    """

    def made(out: list[list[np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[list[np.ndarray]] = []
        now, out, held = None, [], 0

        def ended() -> None:
            nonlocal rest, held
            if rest:
                x = [np.concatenate(c) for c in zip(*rest, strict=True)]
                own = x[1] == x[1][0]
                one = [c[own] for c in x]
                out.append(work(one, [c[~own] for c in x] if now[1] != now[2] else one))
                held += len(out[-1][0])
            rest = []

        for batch in batches:
            key = [batch.column(c).to_numpy() for c in ("pivot", "low", "high")]
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("pivot", "block", "d", "n", "load")]
            change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in key], axis=0)) + 1
            for a, e in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows], strict=True):
                if a == e:
                    continue
                if now != (new := tuple(int(x[a]) for x in key)):
                    ended()
                    now = new
                rest.append([c[a:e] for c in cols])
            if held > 20_000:
                yield made(out)
                out, held = [], 0
        ended()
        if out:
            yield made(out)

    return of


def _grown(x: list[np.ndarray]) -> Forest:
    """The forest of a block whose loads are points."""
    d = dims(x[3])
    return Forest(x[3], {int(n): (np.flatnonzero(d == n), np.frombuffer(b"".join(x[4][d == n]), np.uint8).reshape(-1, n)) for n in np.unique(d)})


def united(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """labels, each the smallest index of a part, after the parts of every i and j are joined."""
    while True:
        low, high = np.minimum(labels[i], labels[j]), np.maximum(labels[i], labels[j])
        apart = low != high
        if not apart.any():
            return labels
        i, j = i[apart], j[apart]
        np.minimum.at(labels, high[apart], low[apart])
        while (labels != (up := labels[labels])).any():
            labels = up


def _near(t: Fraction):
    """Edges (a, b) that tie the texts of a group together which pairs allowed by the trees' bounds connect; no more than texts."""

    def work(x: list[np.ndarray], y: list[np.ndarray]) -> list[np.ndarray]:
        one = _grown(x)
        two = one if x is y else _grown(y)
        d = x[2] if x is y else np.concatenate([x[2], y[2]])
        labels = np.arange(len(d))
        for i, j in forest_pairs(one, two, t):
            labels = united(labels, i, j if x is y else j + len(x[2]))
        at = np.flatnonzero(labels != np.arange(len(d)))
        return [d[at], d[labels[at]]]

    return _by_group(work, ["a", "b"])


def _verify(t: Fraction):
    """Links between whole sets that join two parts of a group: a forest, no more edges than texts."""

    def work(x: list[np.ndarray], y: list[np.ndarray]) -> list[np.ndarray]:
        d = x[2] if x is y else np.concatenate([x[2], y[2]])
        sets = [np.frombuffer(b, np.uint64) for b in (x[4] if x is y else np.concatenate([x[4], y[4]]))]
        sizes = np.array([len(s) for s in sets], np.int64)
        m = len(x[2])

        def grown(a: int, e: int) -> Forest:
            d, out = dims(sizes[a:e]), {}
            for n in np.unique(d).tolist():
                at = np.flatnonzero(d == n)
                out[n] = at, count_vectors(np.concatenate([sets[a + i] for i in at.tolist()]), sizes[a:e][at], n)
            return Forest(sizes[a:e], out)

        one = grown(0, m)
        two = one if x is y else grown(m, len(d))
        of, a, b = np.arange(len(d)), [], []

        def top(i: int) -> int:
            while of[i] != i:
                of[i] = i = of[of[i]]
            return i

        for left, right in forest_pairs(one, two, t):
            right = right if x is y else right + m
            for at in range(0, len(left), 1024):
                i, j = left[at : at + 1024], right[at : at + 1024]
                open_ = of[i] != of[j]
                i, j = i[open_], j[open_]
                need = overlap_needed(sizes[i], sizes[j], t)
                for p, q, o in zip(i.tolist(), j.tolist(), need.tolist(), strict=True):
                    u, v = top(p), top(q)
                    if u != v and len(np.intersect1d(sets[p], sets[q], assume_unique=True)) >= o:
                        of[max(u, v)] = min(u, v)
                        a.append(d[p])
                        b.append(d[q])
        return [np.array(a, np.int64), np.array(b, np.int64)]

    return _by_group(work, ["a", "b"])


def dealt(members: DataFrame, load: DataFrame, t: Fraction) -> DataFrame:
    """Rows of members(pivot, d, n) with their loads(d, load), in order of (pivot, low, high), the blocks that meet.

    A group is one block unless it has more than BLOCK texts or BLOCK_SHINGLES shingles. Then each band of sizes, so
    wide that sets which link lie in one or in two next to each other, is dealt by hash over as many blocks as it
    needs, and a block meets the others of its band and of its neighbours. The work of a group thus grows with the
    square of its blocks; nothing grows with pairs of texts.
    """
    total = members.groupBy("pivot").agg(F.count("*").alias("texts"), F.sum("n").alias("shingles"))
    blocks = lambda a, b: F.greatest(F.ceil(F.col(a) / BLOCK), F.ceil(F.col(b) / BLOCK_SHINGLES), F.lit(1)).cast("int")
    large = keep(total.where(blocks("texts", "shingles") > 1).select("pivot"))
    sets = members.join(load, "d")
    if large.isEmpty():
        rows = sets.select("pivot", F.lit(0).alias("low"), F.lit(0).alias("high"), F.lit(0).alias("block"), "d", "n", "load")
    else:
        width = 1 << 16
        band = F.floor(F.log("n") / -F.log(F.lit(float(t))) + 1e-9).cast("int")
        bands = members.join(large, "pivot").groupBy("pivot", band.alias("band")).agg(F.count("*").alias("texts"), F.sum("n").alias("shingles"))
        bands = keep(bands.select("pivot", "band", blocks("texts", "shingles").alias("blocks")))
        beside = lambda by, name: bands.select("pivot", (F.col("band") - by).alias("band"), F.col("blocks").alias(name))
        plan = bands.join(beside(1, "above"), ["pivot", "band"], "left").join(beside(-1, "under"), ["pivot", "band"], "left")
        rows = sets.withColumn("band", band).join(plan, ["pivot", "band"], "left")
        own = F.when(F.col("blocks").isNull(), 0).otherwise(F.col("band") * width + F.pmod(F.xxhash64("d"), F.col("blocks")).cast("int"))
        of = lambda name, by: F.transform(F.sequence(F.lit(1), F.greatest(F.coalesce(name, F.lit(0)), F.lit(1))), lambda i: (F.col("band") + by) * width + i - 1)
        met = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(
            F.concat(of("blocks", 0), F.when(F.col("above").isNotNull(), of("above", 1)).otherwise(F.array().cast("array<int>")), F.when(F.col("under").isNotNull(), of("under", -1)).otherwise(F.array().cast("array<int>")))
        )
        rows = rows.withColumn("block", own).withColumn("other", F.explode(met))
        rows = rows.select("pivot", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "d", "n", "load")
    return rows.repartition("pivot", "low", "high").sortWithinPartitions("pivot", "low", "high", "block")


def near_duplicates(docs: DataFrame, k: int = 5, threshold: str = "0.8") -> DataFrame:
    """doc_id, n_shingles and component_id for each row of docs(doc_id, text).

    Two texts link if their sets of k-word shingles (words lower-cased in A-Z) have a Jaccard similarity of threshold
    or more; component_id is the smallest id that links reach. Null or blank texts have no shingles and link with
    nothing. Rows of one id count as one document, which links where any of them does. A row without id links with
    nothing and has a null component. Shingles are told apart by 59 bits of hash, sets by 64.
    """
    t = Fraction(threshold)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    read = keep(docs.mapInArrow(_base(k), BASE))
    levels = frequent(read)
    d = F.when(F.col("n_shingles") > 0, F.col("d")).otherwise(F.xxhash64("doc_id", F.lit("no text")))
    base = read.where("counter IS NULL").select("doc_id", "n_shingles", d.alias("d"))
    some = base.where("doc_id IS NOT NULL")
    texts = keep(some.groupBy("d").agg(F.min("doc_id").alias("first"), F.max("n_shingles").alias("n"), F.count("*").alias("times")))
    named = docs.where("doc_id IS NOT NULL")

    # groups: texts that share a key, named after the smallest of them
    keys = named.mapInArrow(_keys(k, t, levels), "key long, d long")
    pivot = F.first("d").over(Window.partitionBy("key").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    others = keep(keys.select(pivot.alias("pivot"), "d").where("pivot < d").distinct())
    members = others.unionByName(others.select("pivot", F.col("pivot").alias("d")).distinct())

    def loads(of: DataFrame, points: bool) -> DataFrame:
        ids = keep(texts.join(of.select("d").distinct(), "d", "left_semi").select(F.col("first").alias("doc_id")))
        return perhaps_among(named, ids).mapInArrow(_payload(k, levels, points), "d long, n long, load binary").groupBy("d").agg(F.min("load").alias("load"))

    sized = keep(members.join(texts.select("d", "n"), "d"))
    near = components(dealt(sized, loads(members, True), t).mapInArrow(_near(t), "a long, b long"))
    cells = keep(near.select(F.col("component").alias("pivot"), F.col("node").alias("d")).join(texts.select("d", "n"), "d"))
    links = dealt(cells, loads(cells, False), t).mapInArrow(_verify(t), "a long, b long")

    # an id with several texts joins them
    many = some.groupBy("doc_id").agg(F.min("d").alias("low"), F.max("d").alias("high")).where("low < high").select("doc_id", "low")
    links = links.unionByName(some.join(many, "doc_id").where("d <> low").select(F.col("d").alias("a"), F.col("low").alias("b")))
    joined = components(links)
    first = joined.join(texts, F.col("node") == F.col("d")).groupBy("component").agg(F.min("first").alias("label"))
    label = joined.join(first, "component").select(F.col("node").alias("d"), "label")
    known = texts.join(label, "d", "left").where("times > 1 OR label IS NOT NULL").select("d", F.coalesce("label", "first").alias("label"))
    out = base.join(keep(known), "d", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id")).alias("component_id"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id of every document: 4-word shingles, links at a similarity of 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, threshold="0.85")
