"""What keeps a step's work in proportion to its input: each case is small, and failed before the step was mended."""

import time

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lorewell.functions.text import lexical_tokens
from lorewell.operators import embeddings, graph, memory, postings, project, records, transcripts, update
from lorewell.plans.project_queries import key_validation
from lorewell.sources import golang


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_text_is_split_once_for_all_its_words(spark):
    long = " ".join(f"word{i}" for i in range(20_000))
    texts = spark.createDataFrame([(1, long)], "id long, text string").repartition(1)
    needles = spark.createDataFrame([("a", "word10 word11 word12 word13 word14"), ("b", "word10 word12 word13 word14 word15")], "item string, needle string")
    start = time.time()
    assert [(r.id, r.item) for r in records.mentioned(texts, needles, "text", "needle").collect()] == [(1, "a")]
    assert time.time() - start < 12
    assert "strategy=merge" in plan(records.mentioned(texts, needles, "text", "needle"))


def test_owners_meet_each_project_once_without_comparing_all_pairs(spark):
    resources = spark.createDataFrame([(1, "git", "a"), (1, "git", "b"), (2, "git", "a"), (2, "git", "a"), (3, "git", "z"), (4, "git", None)], "key long, provider string, identity string")
    projects = spark.createDataFrame([(10, "git", "a"), (10, "git", "b"), (11, "git", "b"), (11, "git", "b"), (12, "svn", "a")], "project_id long, provider string, identity string")
    found = project.owners(resources, projects, "key")
    assert sorted(map(tuple, found.collect())) == [(1, 10), (1, 11), (2, 10)]
    single = project.of_resources(resources, projects)
    assert sorted((r.key, r.project_id) for r in single.collect()) == [(1, 10), (1, 10), (1, 11), (1, 11), (2, 10), (2, 10)]


def test_go_files_of_one_partition_are_read_by_many_tasks(spark):
    sources = spark.createDataFrame([(f"m{i}", "package p\n\nfunc f() { g() }\n") for i in range(50)], "material_id string, text string").coalesce(1)
    found = golang.facts(sources)
    assert found.rdd.getNumPartitions() > 1
    assert found.where("label = 'f()' AND calls = array('g()')").count() == 50


def test_keys_are_told_apart_before_they_are_long(spark, tmp_path):
    rows = [(0, "u"), (1, "kkkkk"), (4, "x.y"), (7, None), (5, "u"), (2, "u"), (5, "u"), (None, "u"), (10, "x.y")]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    found = key_validation(spark, str(tmp_path))
    assert "Aggregate [repeat" not in plan(found) and "Aggregate [CASE" not in plan(found)
    want = [(" a.0-x ", True), ("kkkkk", True), ("x.y", True), (None, False), ("kk", True)]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    for key, valid in (("k" * 255, True), (" \u3000" + "k" * 255 + "\n", True), ("k" * 256, False), ("a..b", False), ("a b", False), ("", False), (".a", False), ("a.\n", False), ("é", False), ("a-_.b\r\n", True)):
        assert spark.createDataFrame([(key,)], "key string").select(memory.valid_key(F.col("key"))).first()[0] is valid, key


def test_texts_to_embed_stay_in_arrow(spark):
    texts = spark.createDataFrame([(str(i), "x" * i) for i in range(1, 70)], "node_id string, text string")
    made = embeddings.embedded(texts, lambda given: [[float(len(t)), 0.0] for t in given], 2)
    assert "MapInPandas" not in plan(made)
    assert {r.node_id: r.vector for r in made.collect()} == {str(i): [float(i), 0.0] for i in range(1, 70)}


def test_an_index_tokenizes_one_partition_by_many_tasks(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i} The 검색에서 x") for i in range(50)], "id long, text string").coalesce(1)
    index = postings.Index(spark, f"{tmp_path}/index", 4)
    index.update(docs, "id", ["text"])
    parts = [p for p in (tmp_path / "index").glob("part-*/documents/part-*.parquet") if pq.read_metadata(p).num_rows]
    assert len(parts) > 1
    assert sorted(r.id for r in index.matches(["검색"]).collect()) == sorted(map(str, range(50)))
    assert spark.createDataFrame([("A The x 검색에서 가 ab",), ("K The a-b",), (None,)], "text string").select(lexical_tokens(F.col("text"))).collect() == [(["검색에서", "검색", "ab"],), (["a-b"],), ([],)]


def test_pairs_of_candidates_are_not_joined_with_what_is_made_of_them(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(transcripts, "kept", lambda df: plans.append(plan(df)) or df)
    rows = spark.createDataFrame([("k", i, v, [f"E{i}"], [], [f"S{i}"]) for i, v in enumerate("abc")] + [("j", 0, "x", ["E0"], [], ["S0"]), ("j", 1, "y", None, None, None), ("bad", 0, "!", [], [], []), ("bad", 1, "!", [], [], [])], "key string, place long, value string, evidence array<string>, links array<struct<relation:string,ref:string>>, sources array<string>")
    merge = lambda pairs: [transcripts.Candidate(a.value + b.value, (*a.evidence, *b.evidence, *(("E9",) if a.value == "!" else ())), (), ("right", "left")) for a, b in pairs]
    found = {r.key: (r.value, r.evidence, r.sources) for r in transcripts.consolidated_all(rows, "key", merge).collect()}
    assert found == {"k": ("abc", ["E0", "E1", "E2"], ["S0", "S1", "S2"]), "j": ("xy", ["E0"], ["S0"])}
    assert not any("Join Inner" in p for p in plans)


def test_names_are_looked_up_once_and_only_by_claims_that_give_no_id(spark):
    nodes = spark.createDataFrame([("s", "S.go"), ("t", "T"), ("u", ""), ("v", "Lib.f()"), ("w", None), (None, "X"), ("a", "twice"), ("b", "twice"), ("c", "o.twice"), ("a", "twice")], "id string, label string")
    rows = [("s", "t", "", "contains"), ("s", "gone", "", "contains"), ("s", "", "f()", "calls"), ("s", None, "f()", "calls"), ("t", "", "", "calls"), ("s", "", "twice", "calls"), ("s", "", "X", "calls"), ("s", "", None, "calls"), ("s", "s", "T", "calls"), ("gone", "t", "", "calls"), ("t", "s", "T", "calls")]
    claims = spark.createDataFrame(rows, "source_id string, target_id string, target string, relation string")
    found = graph.resolve_claims(nodes, claims)
    want = [("s", "t", "contains"), ("s", "v", "calls"), ("t", "s", "calls"), ("t", "u", "calls")]
    assert sorted(map(tuple, found.collect())) == want
    assert "Join LeftOuter" not in plan(found)  # claims that give an id meet no names
    none = lambda df: df.where("false")
    edges = none(found).selectExpr("*", "'observed' AS owner")
    again = update.resolved_again(edges, nodes, nodes, none(claims), none(claims), claims)
    assert sorted(map(tuple, again.collect())) == want
    renamed = nodes.where("id <> 'u'")
    left = update.resolved_again(found.selectExpr("*", "'observed' AS owner"), renamed, nodes.where("id = 'u'").select("id", "label"), claims, none(claims), none(claims))
    assert sorted(map(tuple, left.collect())) == want[:3]


def test_texts_of_files_are_not_sent_to_the_driver(spark, monkeypatch, tmp_path):
    plans = []
    whole = update.kept
    monkeypatch.setattr(update, "kept", lambda df: plans.append(plan(df)) or whole(df))
    spark.createDataFrame([("file:a.go", "package p\nfunc f() { g() }\n")], "uri string, text string").write.parquet(f"{tmp_path}/files")
    read = spark.read.parquet(f"{tmp_path}/files").selectExpr("uri AS id", "uri", "'text/x-go' AS media_type", "'go/v1' AS processor", "text")
    nodes, claims = update.facts(read.drop("text"), read.selectExpr("id AS material_id", "text"))
    assert (nodes.count(), claims.count()) == (2, 2)
    assert sum("Join LeftOuter" in p and "strategy=merge" in p for p in plans) == 1
    assert sum("text#" in p and "Join LeftOuter" in p for p in plans) == 1  # and they are met once


def test_terms_of_a_text_are_packed_by_group_with_their_counts(spark):
    words = ["b", "a-1", "b", "가나", "c_", "b", "a-1", *(f"w{i}" for i in range(60))]
    texts = spark.createDataFrame([(0, words), (1, []), (2, ["x"])], "id int, tokens array<string>")
    for groups in (1, 4, 16):
        found = {r.id: r.rows for r in texts.select("id", postings.packed_terms(F.col("tokens"), 64, groups).alias("rows")).collect()}
        lines = [(r["group"], line.split("\t")) for r in found[0] for line in r.terms.split("\n")]
        assert {x[0]: int(x[1]) if x[1:] else 1 for _, x in lines} == {w: words.count(w) for w in words} and len(lines) == len(set(words))
        assert len({r["group"] for r in found[0]}) == len(found[0]) <= groups
        where = dict(spark.createDataFrame([(w,) for w in set(words)], "w string").select("w", postings.bucket(F.col("w"), 64) % groups).collect())
        assert all(where[x[0]] == g for g, x in lines)
        assert found[1] == [] and [r.terms for r in found[2]] == ["x"]


def test_an_index_keeps_no_tokens_and_moves_changed_texts_only(spark, tmp_path, monkeypatch):
    steps, written, whole, write = [], [], postings.kept, postings.Index._write
    monkeypatch.setattr(postings, "kept", lambda df: steps.append(plan(df)) or whole(df))
    monkeypatch.setattr(postings.Index, "_write", lambda self, texts, *a: written.append(plan(texts)) or write(self, texts, *a))
    make = lambda changed: spark.createDataFrame([(i, f"common word{i} " * (3 if i in changed else 2)) for i in range(400)] + [(None, "common")], "id long, text string").repartition(8)
    index = postings.Index(spark, f"{tmp_path}/index", 4)
    index.update(make(()), "id", ["text"])
    assert index.update(make((5, 7)), "id", ["text"]) == {"added": 0, "modified": 2, "unchanged": 398, "removed": 0}
    assert not any("regexp_extract_all" in p for p in steps)  # no tokens are stored
    first, second = written
    assert first.count("RepartitionByExpression") == 0  # texts that lie in many tasks stay there
    assert "getbit" in second[second.index("RepartitionByExpression") :] and "LeftSemi" not in second  # others leave before any shuffle
    state = index.manifest()
    assert (state["n"], state["tokens"]) == (400, 1604) and index.documents().count() == 400
    held = {r.id: (r.tf, r.dl) for r in index.matches(["common"]).collect()}
    assert held == {str(i): (3, 6) if i in (5, 7) else (2, 4) for i in range(400)}
    common = spark.range(1).select(postings.bucket(F.lit("common"), 4)).first()[0]
    files = [pq.read_table(p, columns=["term"])["term"].to_pylist() for p in (tmp_path / "index").glob(f"{state['parts'][0]}/postings/bucket={common}/*.parquet")]
    assert sum("common" in f for f in files) > 1 and all(f == sorted(f) for f in files)  # no term lies in one task
    assert index.update(make((5, 7)).where("id < 100"), "id", ["text"])["removed"] == 300
    assert index.manifest()["parts"] == state["parts"] and index.manifest()["n"] == 100 == len(index.search("common").collect())


def test_a_bitmap_lets_all_that_is_looked_for_pass_and_little_else(spark):
    rows = spark.createDataFrame([(str(i), i) for i in range(3000)] + [(None, -1)], "id string, x int")
    found = {r.x for r in records.perhaps_among(rows, rows.where("x % 100 = 7").select("id"), "id", 30).collect()}
    assert {x for x in range(3000) if x % 100 == 7} <= found and len(found) < 60 and -1 not in found
    assert records.perhaps_among(rows, rows.where("x < 1000").select("id"), "id", 1000).columns == ["id", "x"]
