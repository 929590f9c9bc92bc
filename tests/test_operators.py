import json
import os

from pyspark.sql import functions as F

from lorewell.functions.text import lexical_tokens, memory_hash
from lorewell.operators import graph, ranking, transcripts
from lorewell.sources import files
from lorewell.streaming import jobs


def test_korean_tokens_come_with_their_stem(spark):
    df = spark.createDataFrame([("세션에서 the Login_x a",)], "t string")
    assert df.select(lexical_tokens(F.col("t"))).first()[0] == ["세션에서", "세션", "login_x"]


def test_bm25_hits_and_misses(spark):
    c = spark.createDataFrame([("auth", "Signed browser sessions and cookies."), ("git", ".git")], "key string, content string")
    assert [r.key for r in ranking.bm25(c, ["key", "content"], "signed sessions").collect()] == ["auth"]
    assert ranking.bm25(c, ["key", "content"], "deployment").count() == 0


def test_claims_resolve_by_suffix_only_if_unique(spark):
    nodes = [("a", "run()"), ("b", "Service.help()")]
    claims = spark.createDataFrame([("a", "", "help()", "calls")], "source_id string, target_id string, target string, relation string")
    edges = lambda n: graph.resolve_claims(spark.createDataFrame(n, "id string, label string"), claims).collect()
    assert [(e.source_id, e.target_id) for e in edges(nodes)] == [("a", "b")]
    assert edges([*nodes, ("c", "Other.help()")]) == []


def test_topics(spark):
    paths = spark.createDataFrame([("game.lol.play-rule",), ("game.lol.items",), ("product.discovery",)], "path string")
    assert graph.branches(paths, "game.lol", 10).count() == 2
    pair = spark.createDataFrame([("game.lol.play-rule", "game.lol.items"), ("a.b", "c")], "source string, target string")
    assert [r.bridge for r in graph.topic_bridge(pair).collect()] == [["game.lol.play-rule", "game.lol", "game.lol.items"], None]


def test_hint_map_takes_an_alternate_branch():
    node = lambda i, path, owner="durable": {"id": i, "key": i, "label": i, "kind": "intent", "path": path, "owner": owner}
    rule, discovery, items = node("rule", "game.rule"), node("discovery", "product.discovery"), node("items", "game.items")
    nodes, edges = ranking.choose_hints([rule, discovery], [items], set(), 512, [("rule", "items", "relates")])
    assert [n["match"] for n in nodes] == ["semantic", "bm25", "semantic:alternate-branch"] and len(edges) == 1
    assert ranking.choose_hints([rule], [], {"rule"}, 512)[0] == []


def plain_hints(semantic, lexical, opened, budget):
    """The reference's choice, node by node over both whole lanes."""
    chosen = []

    def add(n, match):
        trial = [*chosen, n | {"match": match}]
        if len(chosen) == 3 or n["id"] in {c["id"] for c in chosen} | opened or n["key"] in opened or (len(ranking.render_hints(trial, []).encode()) + 3) // 4 > budget:
            return False
        chosen.append(trial[-1])
        return True

    if semantic:
        add(semantic[0], "semantic")
    for n in lexical:
        if add(n, "bm25"):
            break
    done = False
    for durable in (True, False):
        for name, lane in (("semantic", semantic), ("bm25", lexical)):
            for n in lane:
                if not done and (n["owner"] == "durable" or not durable) and n["path"].split(".")[0] not in {c["path"].split(".")[0] for c in chosen}:
                    done = add(n, name + ":alternate-branch")
    for name, lane in (("semantic", semantic), ("bm25", lexical)):
        for n in lane:
            add(n, name)
    return [(n["id"], n["match"]) for n in chosen]


def test_hints_come_from_the_whole_lexical_lane(spark):
    import random

    r = random.Random(4)
    for case in range(6):
        # one branch takes all places but the last two; many nodes are too long for the budget
        node = lambda i, b: {"id": str(i), "key": f"k{i}", "label": "가" * r.choice([1, 1, 60]), "kind": "intent", "path": f"{b}.{i}", "owner": r.choice(["observed", "durable"])}
        lane = [node(i, "hot") for i in range(40)] + [node(40, "cold"), node(41, "mild")]
        near, opened, budget = [node(i, "hot") for i in range(50, 50 + case % 3)], {"0", "k1"}, r.choice([140, 150, 170, 512])
        df = spark.createDataFrame([(*n.values(), p) for p, n in enumerate(lane)], "id string, key string, label string, kind string, path string, owner string, p int").repartition(3)
        want = plain_hints(near, lane, opened, budget)
        for lexical in (lane, df):
            assert [(n["id"], n["match"]) for n in ranking.choose_hints(near, lexical, opened, budget, order=[F.asc("p")])[0]] == want


def test_hint_map_finds_another_source_behind_a_hot_one(spark, tmp_path):
    from lorewell.plans.project_queries import QUERIES

    docs = [(i, "reading signed sessions thing", "hot", "en") for i in range(30)] + [(30, "thing " + "other words " * 30, "cold", "en")]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [1.0, float(i)]) for i in range(20)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = QUERIES["hint_map_top3"](spark, str(tmp_path)).orderBy("place").collect()
    assert [(r.path, r.match) for r in rows] == [("hot.0", "semantic"), ("hot.1", "bm25"), ("cold.30", "bm25:alternate-branch")]


def test_memory_hash_counts_null_as_empty(spark):
    import hashlib

    df = spark.createDataFrame([("note", "v", None)], "k string, v string, s string")
    assert df.select(memory_hash(F.col("k"), F.col("v"), F.col("s"))).first()[0] == hashlib.sha256(b"note\0v\0").hexdigest()


def test_markdown_fences_and_parents(spark):
    text = "# Guide\nintro\n```\n# Not a section\n```\n## Install\nsteps\n# End ##\n"
    rows = files.sections(spark.createDataFrame([("m", text)], "material_id string, text string")).orderBy("line").collect()
    assert [(r.label, r.level, r.parent_line, r.content) for r in rows] == [("Guide", 1, 0, "intro\n# Not a section"), ("Install", 2, 1, "steps"), ("End", 1, 0, "")]


def test_declarations_in_several_languages(spark):
    data = [
        ("j", "text/x-java", "public class A {\n  void run() {\n}"),
        ("k", "text/x-kotlin", "data class B(val x: Int)\nsuspend fun process() {}"),
        ("r", "text/x-rust", "pub struct S;\npub async fn go() {}"),
        ("g", "text/x-go", "package g\n\nfunc (s *S) Help() {}\ntype T struct {}"),
        ("t", "text/typescript", "export const f = async (x) => 1\nclass C {}"),
    ]
    rows = files.declarations(spark.createDataFrame(data, "material_id string, media_type string, text string")).collect()
    assert {(r.material_id, r.label) for r in rows} == {("j", "A"), ("j", "run()"), ("k", "B"), ("k", "process()"), ("r", "S"), ("r", "go()"), ("g", "S.Help()"), ("g", "T"), ("t", "f()"), ("t", "C")}


def test_discovery_leaves_out_ignored_and_sensitive_files(spark, tmp_path):
    for name in ("README.md", "src/main.java", "build/output.txt", ".env", ".hidden/x.py", "keys/a.PEM"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    os.symlink(tmp_path / "README.md", tmp_path / "link.md")
    rows = files.discover(spark, str(tmp_path)).collect()
    assert {(r.uri, r.media_type) for r in rows} == {("file:README.md", "text/markdown"), ("file:src/main.java", "text/x-java"), ("file:.hidden/x.py", "text/x-python")}


def test_transcript_records_in_every_shape(spark):
    data = [{"role": "user", "content": "a"}, {"message": {"role": "assistant", "content": [{"type": "text", "text": "b"}]}}, {"payload": {"role": "user", "text": "c"}}, {"role": "user", "content": [{"type": "tool_result", "text": "no"}]}]
    df = spark.createDataFrame([(json.dumps(x),) for x in data], "r string").select(transcripts.message_role(F.col("r")), transcripts.message_text(F.col("r")))
    assert [tuple(r) for r in df.collect()] == [("user", "a"), ("assistant", "b"), ("user", "c"), ("user", None)]


def test_chunks_keep_every_character():
    made = transcripts.packed([("U000001", "가" * 3000), ("A000002", "x")], 4000)
    assert len(made) >= 2 and sum(c.count("가") for c in made) == 3000 and max(len(c.encode()) for c in made) <= 4000


def test_drain_is_incremental_and_quarantines(spark, tmp_path):
    job = lambda *rows: spark.createDataFrame(rows, jobs.JOB).write.mode("append").parquet(str(tmp_path / "in"))
    at = [str(tmp_path / x) for x in ("in", "state", "progress")]
    job(("1", "k", "queued", 1), ("1", "k", "queued", 1), (None, "k", "queued", 2))
    jobs.drain(spark, *at)
    job(("2", "k", "completed", 3))
    jobs.drain(spark, *at)
    assert [(r.id, r.phase) for r in jobs.current(spark, at[1]).collect()] == [("2", "completed")]
    assert spark.read.parquet(at[1]).count() == 2 and spark.read.parquet(f"{at[1]}-quarantine").count() == 1
