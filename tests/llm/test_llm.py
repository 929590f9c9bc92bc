"""Small tables with nulls, ties, repeats, empty and long texts, held against plain Python."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("lorewell.llm")

import public_tokenizers
from pyspark.sql import functions as F

from lorewell.llm import byte_network, html_text, jaccard, mixing, quality_rules, registry, sentencepieces, sharding, substrings, token_counts, topk

from ..conftest import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KIND = "doc_id long, text string, lang string, source string, n_chars long, row string, size long, shard string"


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(r.choices(vocabulary, k=r.randrange(0, 160))) for _ in range(n)]
    passage = " ".join(r.choices(vocabulary, k=60))
    for i in range(0, n, 4):
        texts[i] += " " + passage
    for i in range(1, n, 5):
        w = texts[i - 1].split()
        for _ in range(r.randrange(0, 4)):
            if w:
                w[r.randrange(len(w))] = r.choice(vocabulary)
        texts[i] = " ".join(w)
    texts += [texts[0]] * 5 + ["", None, "  \n\t", "one", "ONE", "ÄB äb x", ("long " + passage + "\n") * 40]
    return [(i, t, None, f"s{i % 3}" if i % 7 else None, None, "x", 1, None) for i, t in enumerate(texts)] + [(None, texts[0], None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), KIND).repartition(3)


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql_agrees(spark, same_rows, name):
    same_rows(registry.queries()[name](spark, DATA), registry.oracle_sql()[name])


def test_quality_counts(docs):
    out = quality_rules.with_stats(docs.where("doc_id IS NOT NULL")).collect()
    for r in out:
        w, s = WORD.findall(r.text or ""), r["_stats"]
        c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in (r.text or "").split("\n") if WORD.search(x)]
        assert (s.n_words, s.word_chars, s.n_dup_lines, s.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered))


def test_rules_learn_what_labels_tell(spark):
    rows = [(i, ("word " * 30) if i % 3 else "$$$ x " * 30) for i in range(300)]
    rows = [(i, " ".join(f"{t.split()[j % len(t.split())]}{j}x{i}" for j in range(40))) for i, t in rows]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(bool(i % 3))) for i in range(300)] + [(1, None), (None, 1)], "doc_id long, quality int")
    rules = quality_rules.learn(quality_rules.counted(d), labels)
    assert rules and {r.doc_id for r in quality_rules.good(d, rules).collect()} == {i for i in range(300) if i % 3}
    assert quality_rules.learn(quality_rules.counted(d), labels.limit(0)) == []


def brute_components(rows, k, t):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, x in rows:
        w = WORD.findall((x or "").translate(low))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    of = {i: i for i in sets}

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]) - 1e-12:
                a, b = sorted((top(i), top(j)))
                of[b] = a
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize(("k", "t"), [(4, "0.85"), (5, "0.8"), (1, "0.5")])
def test_near_duplicates(docs, k, t):
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs, k, t).collect()}
    none = out.pop(None)
    assert none[1] is None and out == brute_components([x for x in rows_of(docs) if x[0] is not None], k, float(t))


def test_near_duplicates_in_chains(spark):
    """Texts that drift word by word: links only between neighbours, one component."""
    base = [f"t{i}" for i in range(120)]
    rows = [(i, " ".join(base[:i] + [f"n{j}" for j in range(i)] + base[2 * i :])) for i in range(12)] + [(100 + i, " ".join(base[i:] + [f"z{i}"])) for i in range(30)]
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1, "0.85").collect()}
    assert out == brute_components(rows, 1, 0.85)


@pytest.mark.parametrize("n", [1, 17, 150, 700])
def test_tree_bound_loses_no_pair(n):
    """Within a tree and between two of unlike height: every linked pair is found once, and not all pairs are."""
    from fractions import Fraction

    r, t = np.random.default_rng(0), Fraction("0.6")
    sets = [np.unique(r.integers(0, 40, r.integers(5, 25)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(n)]
    size = np.array([len(s) for s in sets])
    points = jaccard.count_vectors(np.concatenate(sets), size)
    linked = {(a, b) for a in range(n) for b in range(a + 1, n) if 10 * len(np.intersect1d(sets[a], sets[b])) >= 6 * len(np.union1d(sets[a], sets[b]))}
    tree = jaccard.Tree(size, points)
    within = [tuple(sorted(p)) for x in jaccard.tree_pairs(tree, tree, t) for p in zip(*(y.tolist() for y in x), strict=True)]
    assert linked <= set(within) and len(within) == len(set(within)) <= n * (n - 1) / 4
    cut = n // 9
    one, two = jaccard.Tree(size[:cut], points[:cut]), jaccard.Tree(size[cut:], points[cut:])
    across = [(a, b + cut) for x in jaccard.tree_pairs(one, two, t) for a, b in zip(*(y.tolist() for y in x), strict=True)]
    assert {(a, b) for a, b in linked if a < cut <= b} <= set(across) and len(across) == len(set(across))


@pytest.mark.parametrize("t", ["0.75", "0.8", "0.85", "0.95", "1"])
def test_linked_sets_share_a_key(t):
    """Sets of all sizes with edits up to the threshold; strangers of a small universe share shingles but hardly a key."""
    from fractions import Fraction

    r, t = np.random.default_rng(2), Fraction(t)
    universe = np.unique(r.integers(0, 1 << jaccard.HASH_BITS, 5000).astype(np.uint64))
    universe[::9] |= np.uint64(3 << jaccard.HASH_BITS)
    for n in [1, 2, 3, 5, 6, 7, 8, 9, 15, 16, 17, 31, 33, 63, 64, 70, 127, 130, 255, 300, 511, 520, 1000]:
        sets = []
        for _ in range(20):
            a = r.choice(universe, n, replace=False)
            lost = r.integers(0, n - int(-(-t * n // 1)) + 1)
            b = np.concatenate([a[lost:], np.setdiff1d(r.choice(universe, n, replace=False), a)[: r.integers(0, lost + n // 5 + 1)]])
            sets += [np.sort(a), np.sort(b)]
        keys, of = jaccard.part_keys(np.concatenate(sets), np.array([len(x) for x in sets]), t)
        found = [set(keys[of == i].tolist()) for i in range(len(sets))]
        for i in range(len(sets)):
            assert len(found[i]) <= 2 * (jaccard.apart(np.array(len(sets[i])), t) + 1)
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if both < len(sets[i]) + len(sets[j]) - both and both >= t * (len(sets[i]) + len(sets[j]) - both):
                    assert found[i] & found[j], (n, i, j)
        if n >= 300 and t > Fraction("0.8"):
            meet = sum(bool(found[i] & found[j]) for i in range(0, len(sets), 2) for j in range(0, i, 2))
            assert meet <= 10  # of 190; first_keys lets all meet


def test_strangers_that_share_shingles_form_no_group(spark, monkeypatch):
    """Long texts of few words meet in a shingle each; only near copies are dealt, so points do not grow with chance."""
    r, dealt, members = random.Random(8), jaccard.dealt, []
    monkeypatch.setattr(jaccard, "dealt", lambda m, load, t: members.append(m.count()) or dealt(m, load, t))
    texts = [[f"w{r.randrange(20)}" for _ in range(r.randrange(380, 420))] for _ in range(60)]
    texts += [x[:200] + ["new"] + x[201:] for x in texts[:3]]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    out = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, "0.85").collect()}
    assert out == brute_components(rows, 4, 0.85) and [out[i][1] for i in (60, 61, 62)] == [0, 1, 2]
    assert members == [6, 6]


def test_parts_are_united():
    r = np.random.default_rng(5)
    for n in (2, 30, 200):
        i, j = r.integers(0, n, (2, n // 2))
        labels = jaccard.united(jaccard.united(np.arange(n), i[::2], j[::2]), i[1::2], j[1::2])
        of = brute_parts(n, zip(i.tolist(), j.tolist(), strict=True))
        assert labels.tolist() == of


def brute_parts(n, pairs):
    of = list(range(n))
    for a, b in pairs:
        x, y = sorted((of[a], of[b]))
        of = [x if v == y else v for v in of]
    return of


def test_large_groups_are_searched_block_by_block(spark, monkeypatch):
    """One phrase that all texts hold, near copies and strangers, with blocks of seven texts."""
    r = random.Random(4)
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    rows = []
    for i in range(90):
        w = ["same"] * 3 + [f"c{i % 3}x{j}" if i % 2 else f"u{i}x{j}" for j in range(r.randrange(4, 30))]
        rows.append((i, " ".join(w)))
    out = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1, "0.8").collect()}
    assert out == brute_components(rows, 1, 0.8)


def test_rows_of_one_id_join_their_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(5, a), (5, b), (5, b), (3, a), (9, b), (4, c), (8, None), (8, c), (7, None), (7, "")]
    out = {(x.doc_id, x.n_shingles, x.component_id) for x in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, "0.85").collect()}
    assert out == {(5, 27, 3), (3, 27, 3), (9, 27, 3), (4, 27, 4), (8, 0, 4), (8, 27, 4), (7, 0, 7)}


def test_substrings(docs):
    rows = sorted(x for x in rows_of(docs) if x[0] is not None)
    seen, want = set(), {}
    for i, t in rows:
        w = WORD.findall(t or "")
        drop = set()
        for j in range(len(w) - 19):
            if (x := tuple(w[j : j + 20])) in seen:
                drop |= set(range(j, j + 20))
            seen.add(x)
        want[i] = (len(w), len(drop), " ".join(x for j, x in enumerate(w) if j not in drop))
    out = substrings.without_repeats(docs)
    assert out.columns == [*docs.columns, "_dedup"]
    assert {r.doc_id: (r["_dedup"].n_words, r["_dedup"].n_removed, r["_dedup"].kept_text) for r in out.collect() if r.doc_id is not None} == want


def test_mix_takes_near_its_targets(spark):
    rows = [(i, "a b c", "big" if i < 2000 else f"s{i % 3}") for i in range(4000)] + [(9999, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.with_copies(d).groupBy("source").agg(F.sum(F.col("_mix.size") * F.col("_mix.copies")).alias("taken"), F.first("_mix.target").alias("target"), F.max("_mix.copies").alias("most")).collect()
    for r in out:
        assert r.most <= 2 and abs(r.taken - r.target) <= 0.1 * r.target + 1
    assert abs(sum(r.target for r in out) - 1.5 * 12000) < 1e-6
    assert mixing.mix(d).columns == d.columns and mixing.mix(d.limit(0)).count() == 0


def test_shards(spark, docs):
    for d in (docs.where("doc_id IS NOT NULL"), docs.limit(0), spark.createDataFrame([(i, "same" if i % 2 else f"t{i}") for i in range(400)], "doc_id long, text string")):
        rows = sharding.shards(d).join(d.select("doc_id", "text"), "doc_id").collect()
        by: dict = {}
        for r in rows:
            by.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
        assert len({(r.text or "", r.shard) for r in rows}) == len({r.text or "" for r in rows})


def test_cuts_are_exact_and_few_ranges_are_held(spark, monkeypatch):
    """One group somewhat below an even share, and others of many sizes, held against one list of all groups."""
    import zlib

    r = random.Random(8)
    seen, plain = [], sharding._ranges
    monkeypatch.setattr(sharding, "_ranges", lambda *a: seen.append(plain(*a)) or seen[-1])
    monkeypatch.setattr(sharding, "CELL_BITS", 8)
    for case, (shards, parted) in enumerate([(16, 4), (16, 16), (5, 1), (3, 256), (1, 4)]):
        n = 4000
        texts = [f"{case} {i}" for i in range(n)]
        size = [r.randrange(1, 9) for _ in texts]
        size[7] = sum(size) // 18  # 5 % of all
        size[9] = sum(size) // 400 if case % 2 else 3
        groups = [(zlib.crc32(t.encode()), hashlib.md5(t.encode()).hexdigest(), s) for t, s in zip(texts, size, strict=True)]
        rows = spark.createDataFrame(groups, "crc long, md5 string, size long").repartition(3).cache()
        groups.sort()
        seen.clear()
        got = sharding._exact_cuts(rows, shards, parted)
        sizes = [s for *_, s in groups]
        ends = [sum(sizes[: i + 1]) for i in range(n)]
        keys = [f"{c:08x}{m}" for c, m, _ in groups]
        assert [sum(k < x for k in keys) for x in got] == sharding.greedy(ends, sharding.smallest_capacity(sizes, shards), shards)
        assert max(map(len, seen)) <= max(256, 256 * parted) and sum(map(len, seen)) < n / 2
        rows.unpersist()
    assert sharding._exact_cuts(spark.createDataFrame([], "crc long, md5 string, size long"), 4) == []


def test_smallest_capacity_is_minimax():
    from itertools import combinations

    r = random.Random(3)
    for _ in range(30):
        sizes = [r.randrange(1, 30) for _ in range(r.randrange(1, 9))]
        n = r.randrange(1, 5)
        cuts = combinations(range(1, len(sizes)), min(n, len(sizes)) - 1)
        best = min(max(sum(sizes[a:b]) for a, b in zip((0, *c), (*c, len(sizes)), strict=True)) for c in cuts)
        assert sharding.smallest_capacity(sizes, n) == best


def test_classifier_on_held_out_rows(spark):
    out = registry.queries()["op5_quality_classifier"](spark, "/root/testdata/sf0.01").where("held_out")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = out.join(labels, "doc_id").select("predicted", "quality").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)


def test_classifier_learns_from_the_middle_of_long_texts(spark):
    """What tells good from bad stands far from either end; an empty table scores, and so does one without labels."""
    r = random.Random(6)
    noise = lambda n: " ".join(r.choices(["alpha", "beta", "gamma", "delta", "rho"], k=n))
    rows = [(i, noise(900) + (" zz%z%zz" * 60 if i % 2 else " ") + noise(900)) for i in range(160)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, 1 - i % 2) for i in range(160)], "doc_id long, quality int")
    net = byte_network.trained(docs, labels)
    score = {x.doc_id: x["_score"] for x in byte_network.scored(docs.withColumn("_score", F.lit("x")), net).collect()}
    assert sum((s >= 0.5) == (i % 2 == 0) for i, s in score.items()) >= 152
    assert byte_network.scored(docs.limit(0), net).count() == 0 and byte_network.trained(docs.limit(0), labels) is None
    few = byte_network.trained(docs, labels, most=40_000)
    assert few is not None and byte_network.trained(docs, labels, most=10) is None


def test_classifier_scores_whole_texts_in_any_batch(docs):
    net = byte_network.Network.new(3)
    texts = [t for _, t in rows_of(docs)] + ["x" * 200_000]
    both = net.score(texts)
    assert np.allclose(both, [net.score([t])[0] for t in texts]) and ((both > 0) & (both < 1)).all()
    assert byte_network.scored(docs, None).where("_score <> 0.5").count() == 0


def test_topk_against_brute_force(spark):
    r = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(r.integers(-3, 4, (300, 8)).astype(float) / 7)] + [(300, None), (301, [1.0, None] * 4), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (None, [1.0] * 8), (304, [1.0]), (350, [2.0]), (400, [])]
    v = topk.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {}
    for x in topk.top_k(v.where("vec_id % 50 = 0"), v).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    ints = {i: [int(np.floor(x * 256)) for x in e] for i, e in [*rows[:300], (304, [1.0]), (350, [2.0]), (400, [])]}
    for q in (0, 50, 250, 350):
        scores = sorted(((-sum(a * b for a, b in zip(ints[q], e, strict=True)), i) for i, e in ints.items() if i != q and len(e) == len(ints[q])))[:5]
        assert got[q] == [(i, -s) for s, i in scores]


def test_topk_of_many_equal_vectors(spark, monkeypatch):
    """Ties at the kth score, in blocks of a few vectors each; rows that repeat an id; no rows at all."""
    r = np.random.default_rng(2)
    for n, same, block in ((300, 200, 64), (64, 64, 9), (65, 0, 1000), (3, 3, 1)):
        monkeypatch.setattr(topk, "CANDIDATES", block)
        monkeypatch.setattr(topk, "QUERIES", 3)
        v = r.integers(-300, 300, (n, 6))
        v[:same] = v[0]
        v, ids = v[r.permutation(n)], r.permutation(n) * 7
        rows = spark.createDataFrame([(i, x) for i, x in zip(ids.tolist(), v.tolist(), strict=True)], "vec_id long, v array<long>")
        got = {}
        for x in topk.top_k(rows.where("vec_id < 63"), rows).orderBy("query_id", "rank").collect():
            got.setdefault(x.query_id, []).append((x.vec_id, x.score))
        for a, i in zip(v, ids.tolist(), strict=True):
            if i < 63:
                want = sorted((-x, j) for x, j in zip((v @ a).tolist(), ids.tolist(), strict=True) if j != i)[:5]
                assert got[i] == [(j, -x) for x, j in want]
    twice = spark.createDataFrame([(0, [1]), (0, [1]), (1, [5]), (1, [4]), (1, [5])], "vec_id long, v array<long>")
    assert [(x.vec_id, x.score) for x in topk.top_k(twice.where("vec_id = 0").limit(1), twice).orderBy("rank").collect()] == [(1, 5), (1, 5), (1, 4)]
    assert topk.top_k(twice.limit(0), twice).count() == topk.top_k(twice, twice.limit(0)).count() == 0


def test_topk_searches_equal_vectors_once(spark):
    r = np.random.default_rng(4)
    rows = [(i, [3, -2, 5]) for i in range(3000)] + [(i, r.integers(-9, 9, 3).tolist()) for i in range(3000, 3040)]
    v = spark.createDataFrame(rows, "vec_id long, v array<long>")
    stored = topk.classes(v, 6)
    asked = v.where("vec_id % 50 = 0").select("v").distinct().select(F.monotonically_increasing_id().alias("query"), "v")
    assert stored.count() <= 41 and topk.best_classes(asked, stored, 6).count() <= 6 * asked.count()
    out = {}
    for x in topk.top_k(v.where("vec_id % 50 = 0"), v).orderBy("query_id", "rank").collect():
        out.setdefault(x.query_id, []).append((x.vec_id, x.score))
    for q in (0, 50, 2950, 3000):
        own = np.array(dict(rows)[q])
        assert out[q] == [(i, -s) for s, i in sorted((-int(own @ np.array(e)), i) for i, e in rows if i != q)[:5]]


def test_bounds_hold_the_exact_products():
    r = np.random.default_rng(3)
    q, v = r.integers(-90, 90, (20, 12)), r.integers(-200, 200, (500, 12))
    low, width = v.min(0).astype(float), np.maximum((v.max(0) - v.min(0)) / topk.CELLS, 1e-9)
    middle, slack = topk.bounds(q, topk.cells(v, low, width), low, width)
    assert (np.abs(middle - q @ v.T) <= slack[:, None]).all() and slack.max() < np.abs(q @ v.T).max() / 20


HARD = ["", " ", "  a  b ", "\t\n\r\n x", "a▁b ▁ ▁▁", "<s>x</s> <0x41>", "<|endoftext|> a<|endoftext|>", "é€𝄞\x00z ﬁ", "it's we'll 'S don't", "aaaa" * 500, "-" * 999, "12 3456 ٣", "　全角 テスト x", "word " * 20_000]


def test_pieces_match_the_library():
    m = sentencepieces.Merger(sentencepieces.model())
    ids, texts = m.batch([*HARD, None])
    theirs = m.library.encode([*HARD, ""], add_bos=True, add_eos=True)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == theirs and texts == [m.library.decode(x) for x in theirs]


def test_token_counts_match_the_library(monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    r = random.Random(5)
    texts = HARD + ["".join(r.choices(" aet'\n\t sSé€-.!01ing", k=r.randrange(80))) for _ in range(800)]
    want = [len(e) for e in t.encode_batch(texts, add_special_tokens=False)]
    for size in (5, 40, 32_768):
        monkeypatch.setattr(token_counts, "CHUNK", size)
        assert [token_counts.Counter(path).count(x) for x in texts[:60]] == want[:60]
    c = token_counts.Counter(path)
    assert [c.count(x) for x in texts] == want


def test_operators_take_empty_and_clashing_tables(spark, docs):
    pages = spark.createDataFrame([(1, None, None, "x"), (2, "http://a/b", "", "y"), (2, "http://a/b", "<article><p>x &amp; y</article>", None)], "page_id long, url string, html string, text string")
    assert sorted(r["_main"].text for r in html_text.main_text(pages).collect()) == ["", "", "x & y"]
    assert html_text.main_text(pages.limit(0)).count() == 0
    clash = docs.select("*", *[F.lit("mine").alias(c) for c in ("_dedup", "_pieces", "_tokens", "_mix", "_size", "_copies", "_stats", "_words", "_row", "_copy", "stats", "words", "lines", "row_", "spot", "held")])
    for d in (clash, docs, docs.limit(0)):
        n = d.count()
        rules = [(quality_rules.Condition("n_words", False, 3.0),)]
        assert quality_rules.good(d, rules).columns == d.columns
        assert quality_rules.good(d, rules).where("text is null").count() == 0
        if "_stats" in d.columns:
            assert quality_rules.good(d, rules).select("_stats", "_words", "stats", "spot").distinct().collect() == [("mine",) * 4]
            assert mixing.with_copies(d).select("_size", "_copies").distinct().collect() == [("mine",) * 2]
        assert set(mixing.mix(d).columns) == set(d.columns) - {"_mix"}
        assert sentencepieces.encoded(d, sentencepieces.model()).count() == n
        assert token_counts.counted(d, public_tokenizers.path("byte_bpe_50k.json")).count() == n
        assert jaccard.near_duplicates(d).count() == n
        assert substrings.without_repeats(d).count() == n


def test_html_leaves_out_what_is_no_article():
    page = """<html><head><title>x</title></head><body><header><h1>Site</h1></header><nav>menu</nav><div class="cookie-notice">We use</div><main><article>
    <header><h1>Title &amp; x</h1></header><p>One<b> two</b><br>three<p>Four</p><ul><li>a<li>b</ul><aside>side</aside><form><input>go</form>
    <section class="comments"><p>nice</p></section><script>var x="</p>"</script></article></main><div id="sidebar">s</div><footer>f</footer></body>"""
    assert html_text.extract(page, html_text.article_path(html_text.skeleton(html_text.parse(page)))) == "Title & x\n\nOne two three\n\nFour\n\na\n\nb"


def test_html_takes_the_place_that_most_text_fills(spark):
    """Hosts without article or main: short lists, side boxes and copyright lines lose against the article's text."""
    side = '<div class="x0"><p>short</p></div><div class="x3"><p>copyright line</p></div>'
    parts = [f"Part {i} of a text that has more to say than its list." for i in range(12)]
    makes = {
        "list": ('<div class="x1"><p>teaser one</p><p>teaser two</p></div><div class="x2">' + "".join(f"<p>{x}</p>" for x in parts) + "</div>", parts),
        "br": (f'<div class="x2">{"<br>".join(parts)}</div>{side}', [" ".join(parts)]),
        "div": (f'{side}<div class="x2"><h2>Part title</h2>' + "".join(f"<div><div>{x}</div></div>" for x in parts) + "</div>", ["Part title", *parts]),
        "li": (f'{side}<div class="x2"><h2>Part title</h2><ul>' + "".join(f"<li>{x}" for x in parts) + "</ul></div>", ["Part title", *parts]),
        "td": (f'<table><tr><td class="x1"><p>menu</p></td><td class="x2">' + "".join(f"<p>{x}</p>" for x in parts) + "</td></tr></table>", parts),
        "title": (f'<h1 class="entry-title">Title</h1><div class="x2">{"<br>".join(parts)}</div>', [" ".join(parts)]),
    }
    rows = [(i, f"http://{name}/{i}", f"<html><body>{body.replace('Part', f'Part {i} ')}</body></html>") for name, (body, _) in makes.items() for i in range(3)]
    rows += [(9, "http://list/9", '<div class="y"><p>' + "Only this page is made so. " * 9 + '</p></div><div class="x2"><p>short</p></div>')]
    out = {(r.page_id, r.url): r["_main"].text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out.pop((9, "http://list/9")) == ("Only this page is made so. " * 9).strip() + "\n\nshort"
    for (i, url), text in out.items():
        assert text == "\n\n".join(x.replace("Part", f"Part {i} ").replace("  ", " ") for x in makes[url.split("/")[2]][1]), url


def test_html_leaves_out_what_a_host_puts_around_its_articles(spark):
    """Shared blocks around a place without a name go; in an article they stay, as do copies of one page and a host's only page."""
    page = lambda tag, *x: f"<{tag}>" + "".join(f"<p>{p}</p>" for p in x) + f"</{tag}>"
    say = lambda i: f"Page {i} tells a long story that no other page of this host tells."
    rows = [(i, "http://many/", page("div", "Welcome.", say(i), "Shared heading", say(i + 9), "Read on at our desk.")) for i in range(5)] + [(i, "http://same/", page("div", say(0), "Read on.")) for i in range(3)]
    rows += [(i, "http://near/", page("article", say(0), say(1), f"Change {i}")) for i in range(3)] + [(0, "http://one/", page("div", say(0), "Read on."))]
    rows += [(i, "http://intro/", f"<article><h2>Introduction</h2><p>{say(i)}</p></article>") for i in range(2)]
    got = {(r.page_id, r.url): r["_main"].text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    want = {(i, "http://many/"): f"{say(i)}\n\nShared heading\n\n{say(i + 9)}" for i in range(5)} | {(i, "http://same/"): f"{say(0)}\n\nRead on." for i in range(3)}
    want |= {(i, "http://near/"): f"{say(0)}\n\n{say(1)}\n\nChange {i}" for i in range(3)} | {(0, "http://one/"): f"{say(0)}\n\nRead on."}
    assert got == want | {(i, "http://intro/"): f"Introduction\n\n{say(i)}" for i in range(2)}


def test_html_keeps_what_stands_around_the_largest_part_and_named_parts_that_speak(spark):
    body = "<p>Opening {i} words.</p><div>" + "".join(f"<p>Part {k} of {{i}}.</p>" for k in range(40)) + "</div><p>Closing {i} words.</p>"
    named = '<article><p>Lead {i}</p><div class="navigation-history"><p>How maps of {i} were drawn</p></div><div class="alert">Storm {i} is near</div><div class="related"><a href="x">Other {i}</a></div><div class="notice">All rights reserved</div><section class="comments"><p>Nice {i}</p></section></article>'
    rows = [(i, "http://plain/", body.replace("{i}", str(i))) for i in range(4)] + [(i, "http://named/", named.replace("{i}", str(i))) for i in range(4)]
    got = {(r.page_id, r.url): r["_main"].text.split("\n\n") for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for i in range(4):
        assert got[i, "http://plain/"] == [f"Opening {i} words.", *[f"Part {k} of {i}." for k in range(40)], f"Closing {i} words."]
        assert got[i, "http://named/"] == [f"Lead {i}", f"How maps of {i} were drawn", f"Storm {i} is near"]


def test_html_wrappers_decide_where_names_say_nothing(spark):
    """Hosts made by chance: columns, menus of links and shared boxes without a telling name. The wrapper gives the text, pages read alone do not."""
    r = np.random.default_rng(5)
    word = lambda n: " ".join(f"w{x}" for x in r.integers(0, 10**6, n))
    rows, want = [], {}
    for h in range(6):
        box = "".join(f"<p>{word(30)}</p>" for _ in range(int(r.integers(2, 6))))
        for i in range(5):
            parts = [word(int(r.integers(3, 12))) for _ in range(int(r.integers(1, 6)))]
            links = "".join(f'<li><a href="/x">{word(6)}</a></li>' for _ in range(int(r.integers(3, 9))))
            columns = [f'<div class="q1">{box}</div>', f'<div class="q2"><ul>{links}</ul></div>', '<div class="q3">' + "".join(f"<p>{p}</p>" for p in parts) + "</div>"]
            rows.append((len(rows), f"http://h{h}/{i}", f"<html><body><div>{''.join(columns[(k + h) % 3] for k in range(3))}</div></body></html>"))
            want[rows[-1][0]] = "\n\n".join(parts)
    run = lambda some: {x.page_id: x["_main"].text for x in html_text.main_text(spark.createDataFrame(some, "page_id long, url string, html string")).collect()}
    assert run(rows) == want
    alone = run([(i, f"http://own{i}/", page) for i, _, page in rows])
    assert sum(alone[i] == want[i] for i in want) < len(want) / 2


@pytest.mark.parametrize("part", ["line{i}<br>", "<h2>h{i}</h2><p>p{i}</p>", "<i>a{i}</i><b>b</b><u>c</u>"])
def test_html_wrappers_of_long_pages_meet_in_time(part):
    import time
    import tracemalloc

    trees = [html_text.skeleton(html_text.parse("<div>" + "".join(part.replace("{i}", str(i * k)) for i in range(n)) + "</div>")) for k, n in ((1, 20_000), (2, 19_000))]
    start = time.process_time()
    tracemalloc.start()
    html_text.merged(*trees)
    assert time.process_time() - start < 20 and tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()


def test_html_alignment_keeps_order():
    r = np.random.default_rng(3)
    for _ in range(300):
        x, y = (list(r.integers(0, 6, int(r.integers(0, 30)))) for _ in range(2))
        pairs = html_text.aligned(x, y)
        assert all(x[i] == y[j] for i, j in pairs) and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:], strict=False))


def test_wrappers_align_pages_of_a_host():
    tree = lambda x: html_text.skeleton(html_text.parse(x))
    w = html_text.merged(tree("<div><p>a</p><p>b</p></div>"), tree("<div><h1>t</h1><p>a</p></div>"))
    assert [(c[0], c[2]) for c in w[3][0][3]] == [("h1", "?"), ("p", "+")]
    w = html_text.merged(tree("<p>same</p><i>one</i>"), tree("<p>same</p><i>two</i>"))
    assert [bool(c[3][0][1]) for c in w[3]] == [True, False]  # a constant and a slot


def test_html_keeps_all_parts_of_an_article_without_a_name(spark):
    """Paragraphs beside the largest container stay; sections whose class only sounds like another part stay too."""
    body = '<p>Intro {i} to what follows.</p><div class="x"><p>First {i} of it.</p><p>Second {i} of it.</p></div><div class="y"><p>Third {i} of it.</p></div><p>Share this story</p>'
    named = '<article><section class="social-history"><p>Old {i}</p></section><div class="share-price">Up {i}</div><div class="share-buttons">tweet {i}</div><div class="article__comments">No {i}</div></article>'
    rows = [(i, "http://plain/", body.replace("{i}", str(i))) for i in range(4)] + [(i, "http://named/", named.replace("{i}", str(i))) for i in range(4)]
    got = {(r.page_id, r.url): r["_main"].text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for i in range(4):
        assert got[i, "http://plain/"] == f"Intro {i} to what follows.\n\nFirst {i} of it.\n\nSecond {i} of it.\n\nThird {i} of it."
        assert got[i, "http://named/"] == f"Old {i}\n\nUp {i}"


def test_html_takes_deep_broken_and_long_pages_in_time(spark):
    import time

    deep = "<div>" * 5000 + "end" + "</div>" * 5000
    pages = [deep, "<b " * 350_000, '<a x="' * 150_000, "<!--" * 200_000, "</x>" * 250_000, "<i>" * 20_000 + "<hr>" * 20_000, "<p>a<" + "<" * 500_000, "<script>" * 90_000, "<a href='x" + "<p>y" * 60_000]
    for x in pages:
        start = time.process_time()
        root = html_text.parse(x)
        assert time.process_time() - start < 2, x[:9]
    rows = [(i, "http://deep/", x) for i, x in enumerate([deep, deep.replace("end", "other"), "<p>it's <b title='a > b'>a < b</b> &lt;c&gt;"])]
    got = [r["_main"].text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]
    assert got == ["end", "other", "it's a < b <c>"]
    assert root is not None


def test_pipeline_keeps_clean_documents_once(spark):
    import corpus_pipeline
    from lorewell.llm import pipeline

    assert corpus_pipeline.STAGES is pipeline.STAGES and len(pipeline.STAGES) == 5
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    good = pipeline.quality(spark, d, DATA)
    assert good.columns == d.columns and 0 < good.count() < d.count()
    one = pipeline.near_duplicates(spark, d, DATA)
    firsts = {c for _, c in brute_components([(r.doc_id, r.text) for r in d.collect()], 5, 0.8).values()}
    assert one.columns == d.columns and sorted(r.doc_id for r in one.collect()) == sorted(firsts)
    cut = pipeline.substring_dedup(spark, one, DATA)
    assert cut.columns == d.columns and cut.where("n_chars <> length(text)").count() == 0
    out = pipeline.sentencepiece(spark, cut, DATA)
    assert out.join(cut.select("doc_id", "text"), "doc_id").where("decoded <> text").count() == 0


def test_digest_columns(spark):
    r = registry.queries()["op8_sentencepiece"](spark, DATA).first()
    assert len(r.ids_sha256) == 64 and r.n_tokens > 2 and hashlib.sha256(b"").hexdigest() != r.ids_sha256
