"""Sources read by their syntax or in splits, and the graph that follows them, against plain Python and full recomputation."""

import json
import random
import threading
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from lorewell.functions.text import byte_prefix, shown_time
from lorewell.operators import embeddings, graph, postings, prepare, ranking, transcripts, update
from lorewell.sources import files, golang
from lorewell.state import new_state
from lorewell.streaming import jobs

GO = """// c
package p

import ( "fmt"; x "y" )

type ( A int; B = string
  C[T any] struct { f func(int) T; g interface{ M() } }
)
type D interface { Foo(); Bar(x int) error }
const k = "func bad() {"
var raw = `
func hidden() { nope() }
`
func (s *Lib[T]) Run(a func(b int), c ...int) (x int, err error) {
	fmt.Println("call()", '(', '\\'') // other()
	f[int](x); pkg.g[int, string](y); m[i][j](z)
	b := []byte(q); c := map[string]pkg.T(w); d := []*T(v); e := a[i] * Mul(v)
	(*T)(x); h()(); x.(T)(y); go func() { inner() }(); defer mu.Unlock()
	type L interface { Meth() }
	/* multi
	 block() */ after()
	ch := make(chan int); T{a: build(1)}
}
func one() { two(); two() }
func nobody(x int) int
func (T) V() struct{ a int } { return struct{a int}{deep()} }
func ((T)) W() {}
"""


def test_go_is_read_by_its_syntax():
    found = golang.Source(GO).facts()
    assert [f[:3] for f in found] == [("type", "A", 6), ("type", "B", 6), ("type", "C", 7), ("type", "D", 9), ("function", "Lib.Run()", 14), ("function", "one()", 24), ("function", "nobody()", 25), ("function", "T.V()", 26), ("function", "receiver.W()", 27)]
    assert found[4][3] == ["Println()", "f()", "g()", "m()", "Mul()", "h()", "inner()", "Unlock()", "after()", "make()", "build()"]
    assert found[5][3] == ["two()"] and found[6][3] == [] and found[7][3] == ["deep()"]


@pytest.mark.parametrize("text", ["func x() {}", "package p\nfunc x() {", "package p\nx := 1", 'package p\nvar s = "abc\n', "package p\n/* open", "package p\nfunc () {}", "package p;type ( 1 )", "", "package p\nvar a = []int{1)\n"])
def test_what_is_no_go_gives_a_warning_only(spark, text):
    with pytest.raises(golang.Unreadable):
        golang.Source(text).facts()


def test_unreadable_files_are_themselves_only(spark):
    rows = [("file:a.go", "package a\nfunc f() {", "text/x-go"), ("file:b.md", "# A\n" + "x" * (1 << 20), "text/markdown"), ("file:c.py", None, "text/x-python"), ("file:d.py", "def f(:", "text/x-python")]
    made = spark.createDataFrame(rows, "uri string, text string, media_type string").withColumn("id", F.col("uri")).withColumn("processor", update.processor(F.col("media_type")))
    texts = made.select(F.col("id").alias("material_id"), "text")
    nodes, claims = update.facts(made, texts)
    assert {r.label: r.kind for r in nodes.collect()} == {"a.go": "material", "b.md": "material", "c.py": "material", "d.py": "material", "f()": "knowledge"}
    assert {r.uri for r in update.warnings(made, texts).collect()} == {"file:a.go", "file:b.md", "file:c.py"}


def plain_content(lines):
    out = ""
    for line in lines:
        room, line = (32 << 10) - len(out.encode()), line.strip()
        if room <= 0 or not line:
            continue
        if out:
            room -= 1
            if room <= 0:
                continue
            out += "\n"
        out += line.encode()[:room].decode("utf-8", "ignore")
    return out


def test_section_content_is_cut_by_bytes(spark):
    cases = [["é" * 20_000], ["ab", "", "  한국  " * 3000, "c" * 40_000, "d"], ["x" * 32_766, "é", "y"], ["x" * 32_767, "y"], ["  a ", "\t", "b\r"], ["€" * 10_922, "zz", "z"]]
    rows = [(str(i), "before\n## H\n" + "\n".join(c)) for i, c in enumerate(cases)]
    found = {r.material_id: r.content for r in files.sections(spark.createDataFrame(rows, "material_id string, text string")).collect()}
    assert found == {str(i): plain_content(c) for i, c in enumerate(cases)}
    assert {r.content for r in files.markdown(spark.createDataFrame(rows, "material_id string, text string")).where("line = 0").collect()} == {"before"}


def test_byte_prefixes_and_times(spark):
    text = "aé€😀b"
    found = spark.range(0, 13).select("id", byte_prefix(F.lit(text), F.col("id").cast("int")).alias("x")).collect()
    assert [r.x for r in found] == [text.encode()[: r.id].decode("utf-8", "ignore") for r in found]
    times = spark.createDataFrame([(0,), (1_700_000_000,), (-1,), (None,)], "t long").select(shown_time(F.col("t")).alias("x")).collect()
    assert [r.x for r in times] == ["1970-01-01T00:00:00Z", "2023-11-14T22:13:20Z", "1969-12-31T23:59:59Z", None]


def test_text_of_files_keeps_what_is_valid():
    assert files.text_content("a��b".encode() + b"\xff\xfec\x80") == "a��b�c�" and files.text_content(b"a\0b") == ""


def test_parts_of_messages_are_told_by_their_types(spark):
    shapes = {
        '{"role": "user", "content": [5, "a"]}': "a", '{"role": "user", "content": [["x"], "b"]}': "b", '{"role": "user", "content": ["{\\"type\\": \\"image\\"}", "c"]}': '{"type": "image"}\nc',
        '{"role": "user", "content": [{"type": 3, "text": "d"}, {"type": "image", "text": "no"}, {"type": "text", "text": 4}, null, true]}': "d", '{"role": "user", "content": {"text": "no"}, "text": "e"}': "e",
        '{"role": "user", "content": 7, "text": " f "}': "f", '{"role": 1, "type": "USER_MESSAGE", "message": {"content": "g"}}': "g", '{"role": "user", "payload": ["x"], "message": "h"}': "h",
    }
    df = spark.createDataFrame([(k,) for k in shapes], "r string")
    found = {r.r: (r.role, r.text) for r in df.select("r", transcripts.message_role(F.col("r")).alias("role"), transcripts.message_text(F.col("r")).alias("text")).collect()}
    assert found == {k: ("user", v) for k, v in shapes.items()}


def test_a_transcript_is_read_in_splits(spark, tmp_path):
    r = random.Random(4)
    lines, want = [], []
    for i in range(3000):
        role, text = r.choice(["user", "assistant", "system"]), r.choice(["", " ", "x" * r.randrange(1, 300), "é\n\"q\""])
        lines.append(json.dumps({"role": role, "content": text}) + r.choice(["", "\r"]) if i % 9 else r.choice(["", "  "]))
        if i % 9 and role != "system" and text.strip():
            want.append((i + 1, len(want) + 1, f"{role[0].upper()}{len(want) + 1:06d}", role, text.strip()))
    (tmp_path / "t.jsonl").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = transcripts.read_transcript(spark, str(tmp_path / "t.jsonl"))
        assert sorted(map(tuple, found.collect())) == want
        assert spark.read.text(str(tmp_path / "t.jsonl")).rdd.getNumPartitions() > 10
        for bad in ("[1]", "{", '"text"'):
            (tmp_path / "bad.jsonl").write_text("\n".join([*lines[:2000], bad, *lines[2000:], "no json"]))
            with pytest.raises(ValueError, match="line 2001 "):
                transcripts.read_transcript(spark, str(tmp_path / "bad.jsonl"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_edits_resolve_to_the_same_edges_as_everything_anew(spark):
    r = random.Random(11)
    names = [f"{o}f{i}()" for o in ("", "A.", "B.") for i in range(6)]
    schema = "id string, label string, material_id string"
    claim = "material_id string, source_id string, target_id string, target string, relation string"

    def world(materials):
        nodes, claims = [], []
        for m, (labels, calls) in materials.items():
            nodes += [(f"{m}/{i}", label, m) for i, label in enumerate(labels)]
            claims += [(m, f"{m}/{i % len(labels)}", "", c, "calls") for i, c in enumerate(calls)] + [(m, f"{m}/0", f"{m}/{i}", "", "contains") for i in range(1, len(labels))]
        return spark.createDataFrame(nodes, schema), spark.createDataFrame(claims, claim).distinct()

    make = lambda: ([r.choice(names) for _ in range(r.randrange(1, 4))], [r.choice(names) for _ in range(r.randrange(0, 5))])
    before = {f"m{i}": make() for i in range(14)}
    for _ in range(3):
        after = {m: x if r.random() < 0.8 else make() for m, x in before.items() if r.random() < 0.9} | {f"n{r.randrange(99)}": make()}
        (n0, c0), (n1, c1) = world(before), world(after)
        same = spark.createDataFrame([(m,) for m in after if before.get(m) == after[m]], "material_id string")
        gone, stay = lambda df: df.join(same, "material_id", "left_anti"), lambda df: df.join(same, "material_id", "left_semi")
        edges = graph.resolve_claims(n0, c0).withColumn("owner", F.lit("observed"))
        found = update.resolved_again(edges, n1, gone(n0).unionByName(gone(n1)), stay(c1), gone(c0), gone(c1))
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, graph.resolve_claims(n1, c1).collect()))
        before = after


def documents(spark, rows):
    return spark.createDataFrame(rows, "id long, title string, body string")


def test_postings_score_as_a_scan_does_through_updates(spark, tmp_path):
    r = random.Random(2)
    words = [f"word{i}" for i in range(30)] + ["signed", "sessions", "the", "세션을"]
    text = lambda: " ".join(r.choices(words, k=r.randrange(0, 30)))
    rows = {i: (i, text(), text()) for i in range(120)} | {500: (500, None, ""), 501: (501, "", None)}
    index = postings.Index(spark, f"file://{tmp_path}/index", 16)
    assert index.search("signed").collect() == [] and index.manifest()["n"] == 0
    expected = [{"added": 122, "modified": 0, "unchanged": 0, "removed": 0}]
    assert index.update(documents(spark, list(rows.values())), "id", ["title", "body"]) == expected[0]
    for step in range(3):
        docs = documents(spark, list(rows.values()))
        for query in ("signed sessions word3", "세션을 the", "nothing here", "word1 word1"):
            scan = {str(x.id): x.score for x in ranking.bm25(docs, ["title", "body"], query).collect()}
            assert {x.id: x.score for x in index.search(query).collect()} == pytest.approx(scan, abs=1.1e-6)
        if step == 0:
            gone, new = r.sample(sorted(rows), 20), {i: (i, text(), text()) for i in (*r.sample(range(120), 15), 600, 601)}
            rows = {i: x for i, x in rows.items() if i not in gone} | new
            counts = index.update(documents(spark, list(rows.values())), "id", ["title", "body"])
            assert counts["removed"] == len([i for i in gone if i not in new]) and sum(counts.values()) - counts["removed"] == len(rows)
            assert index.update(documents(spark, list(rows.values())), "id", ["title", "body"])["unchanged"] == len(rows)
        if step == 1:
            state = index.compact()
            assert len(state["parts"]) == 1 and state["dead"] == [] and state["n"] == len(rows)
    index.update(documents(spark, []), "id", ["title", "body"])
    assert index.search("signed").collect() == [] and index.manifest()["tokens"] == 0


def test_a_question_reads_the_buckets_of_its_terms_only(spark, tmp_path):
    index = postings.Index(spark, f"file://{tmp_path}/index", 16)
    index.update(documents(spark, [(i, f"word{i}", "signed sessions") for i in range(50)]), "id", ["title", "body"])
    plan = index.matches(["signed", "word3"])._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "PartitionFilters: [bucket" in plan and "PushedFilters: [" in plan and "In(term" in plan


def plain_query(nodes, edges, text, limit):
    """The reference semantics on lists: nodes in order, all text seeds, words; then seeds with their neighbours, then by levels."""
    room = 4 * limit
    order = sorted(nodes, key=lambda n: (n["kind"] != "intent", n["label"], n["id"]))
    texts = [n["id"] for n in order if text.lower() in " ".join((n["id"], n["label"], n["content"])).lower()]
    near = {}
    for s, t in sorted(edges):
        near.setdefault(s, []).append(t)
        near.setdefault(t, []).append(s)
    out = {}

    def add(i):
        if len(out) < room:
            out.setdefault(i)

    frontier = []
    for s in dict.fromkeys(texts):
        add(s)
        for n in near.get(s, []):
            add(n)
    frontier = list(out)
    for i in frontier:
        for n in near.get(i, []):
            add(n)
    return list(out), [i for i in texts if i in out]


@pytest.mark.parametrize("seed", range(3))
def test_every_visible_match_is_given(spark, seed):
    r = random.Random(seed)
    rows = [{"id": f"n{i:02d}", "label": f"label {i % 7}", "kind": r.choice(["intent", "knowledge"]), "content": "an apple here" if r.random() < 0.7 else "nothing"} for i in range(80)]
    links = sorted({tuple(r.sample([x["id"] for x in rows], 2)) for _ in range(40)})
    nodes = spark.createDataFrame([(x["id"], x["label"], x["kind"], x["id"], "durable", "active", x["content"]) for x in rows], "id string, label string, kind string, ref string, owner string, state string, content string")
    edges = spark.createDataFrame([(s, t, "applies_to", "durable") for s, t in links], "source_id string, target_id string, relation string, owner string")
    found = prepare.query(new_state(spark, nodes=nodes, edges=edges), "an apple", 5)
    ids, texts = plain_query(rows, links, "an apple", 5)
    assert found["ids"] == ids and [i for i, s in found["matches"] if "text" in s] == texts
    apples = {x["id"] for x in rows if "apple" in x["content"]}
    assert {i for i, s in found["matches"] if "bm25" in s} == apples & set(ids)


def test_sections_can_be_found_by_meaning(spark):
    made = spark.createDataFrame([("file:a.md", "# Signed sessions\nhow they work", "text/markdown")], "uri string, text string, media_type string").withColumn("id", F.col("uri")).withColumns({"content_hash": F.col("text"), "size": F.lit(1).cast("long"), "modified_at": F.lit(0).cast("long")})
    _, changes = update.update(new_state(spark), made.drop("text"), made.select(F.col("id").alias("material_id"), "text"))
    wanted = embeddings.candidates(changes["nodes"]).collect()
    assert [x.text for x in wanted] == ["Signed sessions\nknowledge\nsection\nfile:a.md\nline:1\nhow they work"]
    stored = embeddings.backfilled(new_state(spark)["embeddings"], embeddings.candidates(changes["nodes"]), "stub", lambda texts: [[1.0, 0.0] for _ in texts], dimensions=2)
    assert [m.node_id for m in embeddings.matches(spark, stored, changes["nodes"], "any", "stub", lambda t: [[1.0, 0.0]], 8).collect()] == [wanted[0].node_id]


def queue(spark, tmp_path, n):
    for i in range(n):
        (tmp_path / f"t{i}.jsonl").write_text(json.dumps({"role": "user", "content": str(i)}))
        jobs.enqueue(spark, f"file://{tmp_path}/q", f"file://{tmp_path}/t{i}.jsonl", "agent", "s", "p", "/w", "end", i)
    return f"file://{tmp_path}/q"


def test_workers_at_once_work_each_job_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "ROUND", 3)
    top, seen, lock = queue(spark, tmp_path, 8), [], threading.Lock()

    def work(job):
        with lock:
            seen.append(job["id"])
        time.sleep(0.05)
        return "done"

    with ThreadPoolExecutor(3) as pool:
        counts = list(pool.map(lambda _: jobs.process(spark, top, work, 100), range(3)))
    assert len(seen) == len(set(seen)) == 8 == sum(c["completed"] for c in counts) and sum(c["failed"] for c in counts) == 0
    assert jobs.process(spark, top, work, 101)["completed"] == 0


def test_leases_end_and_are_taken_over(spark, tmp_path):
    top = queue(spark, tmp_path, 1)
    job = jobs.jobs_of(spark, top)[0].first().id
    assert jobs.lease(spark, top, job, "a", 100, 50).endswith("-000000.json")
    assert jobs.lease(spark, top, job, "b", 149, 50) is None
    assert jobs.process(spark, top, lambda j: "x", 149) == {"completed": 0, "failed": 0, "quarantined": 0, "held": 1}
    with ThreadPoolExecutor(4) as pool:
        taken = [x for x in pool.map(lambda w: jobs.lease(spark, top, job, str(w), 151, 50), range(4)) if x]
    assert len(taken) == 1 and taken[0].endswith("-000001.json")
    assert jobs.process(spark, top, lambda j: "x", 300)["completed"] == 1


def test_files_are_made_once(spark, tmp_path):
    place = f"file://{tmp_path}/made/once.json"
    with ThreadPoolExecutor(6) as pool:
        assert sum(pool.map(lambda i: jobs.write_once(spark, place, str(i)), range(12))) == 1
    assert len(list((tmp_path / "made").glob("*tmp*"))) == 0


def test_ids_are_worked_once_over_batches_and_restarts(spark, tmp_path):
    add = lambda *rows: spark.createDataFrame(rows, jobs.JOB).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    at = [f"{tmp_path}/{x}" for x in ("in", "out", "progress")]
    add(("1", "k", "queued", 1), ("2", "k", "queued", 2), ("1", "k", "queued", 3), (None, "k", "x", 4), (None, None, "x", 5))
    jobs.drain(spark, *at)
    add(("1", "k", "again", 6), ("3", "j", "queued", 7), ("4", None, "x", 8))
    jobs.drain(spark, *at, work=lambda batch: batch.withColumn("phase", F.lit("worked")))
    jobs.drain(spark, *at)
    rows = spark.read.parquet(at[1])
    assert sorted(r.id for r in rows.collect()) == ["1", "2", "3"] and {r.phase for r in rows.where("id = '3'").collect()} == {"worked"}
    assert sorted(r.seq for r in spark.read.parquet(f"{at[1]}-quarantine").collect()) == [4, 5, 8]
    state = [p for p in (tmp_path / "progress" / "state").rglob("*.delta")]
    assert state


def plain_path(links, source, target):
    near = {}
    for e in sorted(links):
        near.setdefault(e[0], []).append((e, e[1]))
        near.setdefault(e[1], []).append((e, e[0]))
    found, frontier = {source: []}, [source]
    while frontier and target not in found:
        nodes, frontier = frontier, []
        for i in nodes:
            for e, n in near.get(i, []):
                if n not in found:
                    found[n] = [*found[i], e]
                    frontier.append(n)
    return found.get(target)


@pytest.mark.parametrize("seed", range(4))
def test_shortest_paths_from_both_ends_are_the_first_in_order(spark, seed):
    r = random.Random(seed)
    n = 30
    links = {(f"n{r.randrange(n)}", f"n{r.randrange(n)}", r.choice("ab")) for _ in range([30, 45, 70, 26][seed])}
    links |= {("n0", f"hub{i}", "a") for i in range(60)}
    edges = spark.createDataFrame(sorted(links), "source_id string, target_id string, relation string")
    for source, target in [("n0", "n7"), ("n7", "n0"), ("n3", "hub5"), ("n1", "nowhere")]:
        want = plain_path(links, source, target)
        assert [tuple(x)[1:] for x in graph.shortest_path(edges, source, target).orderBy("step").collect()] == (want or [])


def test_rounds_join_candidates_as_one_after_the_other(spark):
    r = random.Random(6)
    kind = "key string, " + transcripts.CANDIDATE
    groups = {f"k{n}": [transcripts.Candidate(f"v{i}", (f"e{i}", f"e{r.randrange(3)}"), (("applies_to", f"m{r.randrange(3)}"),), (f"s{i}",)) for i in range(n)] for n in (1, 2, 3, 5, 8, 13)}
    rows = [(k, 10 * i, c.value, list(c.evidence), list(c.links), list(c.sources)) for k, x in groups.items() for i, c in enumerate(x)] + [(None, 1, "x", None, None, None), ("k1", None, "x", None, None, None)]
    frame = spark.createDataFrame(rows, kind).repartition(3)

    def merged(bad):
        def of(a, b):
            c = transcripts.Candidate(f"({a.value} {b.value})", (*a.evidence, *b.evidence), (*a.links, *b.links), ("left", "right"))
            if "v2" not in a.value:
                return c
            return {"none": None, "value": c._replace(value=" "), "evidence": c._replace(evidence=("other",)), "links": c._replace(links=(("x", "y"),)), "sources": c._replace(sources=("left", "left"))}.get(bad, c)

        return of

    for bad in ("nothing", "none", "value", "evidence", "links", "sources"):
        one = merged(bad)
        found = {x.key: (x.value, set(x.evidence), {tuple(y) for y in x.links}, set(x.sources)) for x in transcripts.consolidated_all(frame, "key", lambda pairs, one=one: [one(a, b) for a, b in pairs], 2).collect()}
        want = {k: transcripts.consolidated(x, one) for k, x in groups.items()}
        assert found == {k: (c.value, set(c.evidence), set(c.links), set(c.sources)) for k, c in want.items() if c is not None}
    assert transcripts.consolidated_all(frame.limit(0), "key", lambda pairs: []).count() == 0
