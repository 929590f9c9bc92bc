"""Phrases, spelling variants and fingerprints against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("lorewell.llm")

import xxhash
from pyspark.sql import functions as F

from lorewell.llm import phrases, spelling, winnowing

KIND = "doc_id long, text string, lang string, block int, guest string, word string, n long"


def texts(seed=3, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(7)]
    out = [" ".join(r.choice(vocabulary) + r.choice([""] * 6 + [".", ",", "\n", ";", "\t"]) for _ in range(r.randrange(0, 300))) for _ in range(n)]
    return out + [out[0]] * 4 + ["", None, " \t\n", "one", "One. Two", "日本語のテキスト" * 9, "x" * 5000, ("the same four words " * 40)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, [None, "en", "de"][i % 3], 1, "g", "x", 2) for i, t in enumerate(texts())]
    rows += [(None, "no id", "en", 1, None, None, None), (None, None, None, None, None, None, None), (6, "an id again", "en", 1, None, None, None)]
    return spark.createDataFrame(rows, KIND).repartition(4)


def chosen(text, k=winnowing.K, w=winnowing.W):
    text = text or ""
    tokens = [t for word in text.strip(" \t\n\x0b\x0c\r").split() if word for t in (word if len(word) > winnowing.LONGEST else [word])]
    hashes = []
    for i in range(max(1, len(tokens) - k + 1) if tokens else 0):
        h = 42
        for t in tokens[i : i + k]:
            h = xxhash.xxh64_intdigest(t.encode(), h)
        hashes.append(h >> 31 & (1 << 32) - 1)
    out = []
    for i in range(max(1, len(hashes) - w + 1) if hashes else 0):
        window = hashes[i : i + w]
        at = i + max(j for j, h in enumerate(window) if h == min(window))
        if not out or out[-1] != at:
            out.append(at)
    return [(hashes[i], i) for i in out]


def test_fingerprints(spark, docs, monkeypatch, tmp_path):
    monkeypatch.setattr(winnowing, "BLOCK", 7)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = winnowing.op13_fingerprints(spark, str(tmp_path)).collect()
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect() if r.doc_id is not None))
    shown = lambda p: " ".join(f"{h:08x}:{i}" for h, i in p)
    expected = []
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        expected.append((i, text, edited, following))
    expected += [(None, "no id", "no ", ""), (None, "", "", "")]
    want = []
    for i, text, edited, following in expected:
        a, b, c = chosen(text), chosen(edited), chosen(following)
        x, y, z = ({h for h, _ in p} for p in (a, b, c))
        like = lambda p, q: len(p & q) / len(p | q) if p | q else 1.0
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), shown(a), shown(b), like(x, y), like(x, z)))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in out)


def test_shared_runs_share_a_fingerprint(spark):
    r = random.Random(5)
    word = lambda: f"v{r.randrange(10**6)}"
    rows = []
    for _ in range(60):
        run = [word() for _ in range(winnowing.K + winnowing.W - 1)]
        rows.append([" ".join([word() for _ in range(r.randrange(40))] + run + [word() for _ in range(r.randrange(40))]) for _ in range(2)])
    found = spark.createDataFrame(rows, "a string, b string").select(winnowing.likeness(winnowing.hashes(winnowing.prints(F.col("a"))), winnowing.hashes(winnowing.prints(F.col("b")))).alias("x")).collect()
    assert all(r.x > 0 for r in found)


def test_fingerprints_of_no_documents(spark, docs, tmp_path):
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert winnowing.op13_fingerprints(spark, str(tmp_path)).collect() == []
    assert spelling.op12_spelling_variants(spark, str(tmp_path)).collect() == []
    assert phrases.op11_phrase_collocations(spark, str(tmp_path)).collect() == []


def plain_phrases(rows, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + m])] += 1
    out = []
    for lang, c in f.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= 30}
        best = []
        for p, a in candidates.items():
            spans = lambda q: {q[i : i + len(p)] for i in range(len(q) - len(p) + 1)}
            if any(len(q) > len(p) and p in spans(q) and 100 * b >= 80 * a for q, b in candidates.items()):
                continue
            score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(best)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("sizes", [(400_000, 1 << 20, 1 << 22), (300, 50, 64)])
def test_phrases(docs, monkeypatch, sizes):
    """Also with shards, batches and slices of a few words."""
    for name, size in zip(("SHARD", "MEETING", "SLICE"), sizes, strict=True):
        monkeypatch.setattr(phrases, name, size)
    out = [tuple(r) for r in phrases.collocations(docs.select("lang", "text"), 40).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    want = plain_phrases([(r.lang, r.text) for r in docs.collect()], 40)
    assert len(want) > 60 and sorted(out) == want


def test_longer_phrases_are_dealt_in_rows_that_begin_alike():
    """A row holds many phrases, and all that begin with the same two words go to one part."""
    shard = phrases.Shard("en")
    text = b"a b c d e. a b c d. a b. b c x\ty " * 3
    shard.add(text)
    everything = phrases.Frequent(np.full(1 << 10, 255, np.uint8))
    made = [b for batch in phrases.phrase_counts(shard, everything, everything) for b in batch.to_pylist()]
    rows = [(r["part"], p, f) for r in made for p, f in zip(r["phrases"].split("\n"), r["counts"], strict=True)]
    want = Counter()
    for piece in text.decode().split("."):
        w = piece.split()
        want.update(" ".join(w[i : i + m]) for m in range(2, 5) for i in range(len(w) - m + 1))
    assert {p: f for _, p, f in rows} == want and len(rows) == len(want)
    heads = {}
    for part, p, _ in rows:
        heads.setdefault(tuple(p.split()[:2]), set()).add(part)
    assert all(len(parts) == 1 for parts in heads.values()) and len(made) == len({r["part"] for r in made}) < len(rows)


def test_bitmaps_shift_and_meet():
    r = np.random.default_rng(2)
    place = np.sort(r.choice(500, 200, replace=False))
    item = r.integers(0, 6, 200)
    one = phrases.Bitmaps.of(item, place)
    a, b, byte, mask = one.shifted().met(one)
    found = {(int(x), int(y), int(at) * 8 + bit) for x, y, at, m in zip(a, b, byte, mask, strict=True) for bit in range(8) if m >> bit & 1}
    at = dict(zip(place.tolist(), item.tolist(), strict=True))
    assert found == {(at[p], at[p + 1], p + 1) for p in at if p + 1 in at}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def test_variants(spark):
    r = random.Random(8)
    words = set()
    while len(words) < 500:
        words.add("".join(r.choice("abé") for _ in range(r.randrange(6, 10))))
    words |= {"a" * i for i in range(6, 12)} | {"aabbcc", "abbccc", "aabbccd", "a" * 300, "a" * 301, "zebras", "zebra" * 2}
    counts = {w: int(5 * 6 ** r.randrange(0, 6) + r.randrange(3)) for w in words}
    vocabulary = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    out = [tuple(x) for x in spelling.variants(vocabulary).collect()]
    assert sorted(out) == plain_variants(counts)


def test_words_with_slips(spark, docs):
    rows = [(i, "Straße lichter LICHTER lichterE éclairs×b " * 30 if i % 2 else "lichter12lichter_éclair kurz", None, 1, None, None, None) for i in range(300)] + [(None, "lichter", None, None, None, None, None), (4, None, None, None, None, None, None)]
    frame = spark.createDataFrame(rows, KIND)
    counts = Counter()
    for row in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", row[1] or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if row[0] is None else row[0]}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    want = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    assert {r.word: r.n for r in spelling.words(frame).collect()} == want and len(want) == 5
