"""A project's state from end to end: small cases with what each must give."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lorewell.operators import embeddings, graph, memory, prepare, project, records, transcripts, update
from lorewell.sources import files
from lorewell.state import TABLES, Folder, new_state
from lorewell.streaming import jobs

ENTRY = "key string, kind string, value string, source string"


def saved(spark, *rows, state=None, at=1):
    state = state or new_state(spark)
    results, changes = memory.save(state, spark.createDataFrame(list(rows), ENTRY), at)
    return {r.key: r.action for r in results.collect()}, {**state, **changes}


def test_memories_keep_versions_and_nodes(spark):
    done, state = saved(spark, ("a.b", None, " text ", None), ("c", "decision", "x", None))
    assert done == {"a.b": "created", "c": "created"}
    done, state = saved(spark, ("a.b", "note", "text", None), ("c", "reference", None, "file:x"), state=state, at=2)
    assert done == {"a.b": "unchanged", "c": "updated"}
    assert {(r.id, r.content) for r in state["nodes"].collect()} == {("knowledge:a.b", "text"), ("reference:c", "file:x")}
    assert [r.number for r in memory.history(state, "c").collect()] == [2, 1]
    for bad in (("a b", None, "x", None), ("k", "plan", "x", None), ("k", None, None, None), ("k", None, "x", "y"), ("k", None, " ", None)):
        with pytest.raises(ValueError):
            saved(spark, bad)
    gone, changes = memory.delete(state, "c")
    assert gone and changes["nodes"].count() == changes["memories"].count() == 1 and not memory.delete(state, "none")[0]
    assert [r.key for r in memory.under(state["memories"], "A").collect()] == ["a.b"]


def test_reconcile_is_all_or_nothing(spark):
    _, state = saved(spark, ("k", "decision", "old", None))
    now = state["memories"].first().hash
    link = memory.Link("verified_by", "file:x")
    good = memory.Proposal("k", "decision", "new", None, now, ("U000001",), (link,))
    results, changes = memory.reconcile(state, "s", [good, memory.Proposal("n", value="v")], 2)
    assert {r.key: r.action for r in results.collect()} == {"k": "updated", "n": "created"}
    assert [tuple(r) for r in changes["edges"].select("source_id", "target_id", "owner", "provenance").collect()] == [("intent:k", "material:file:x", "durable", "reconcile:s")]
    audit = json.loads(changes["audit"].first().changes)
    assert [c["key"] for c in audit["changes"]] == ["k", "n"] and audit["links"][0]["relation"] == "verified_by" and audit["links"][0]["evidence"] == ["U000001"]
    with pytest.raises(memory.Conflict):
        memory.reconcile(state, "s", [memory.Proposal("n", value="v"), memory.Proposal("k", value="x", expected="wrong")], 2)
    _, none = memory.reconcile(state, "s", [memory.Proposal("k", "decision", "old", None, now)], 2)
    assert "audit" not in none
    for bad in ([], [good] * 2, [good._replace(evidence=())], [good._replace(links=(memory.Link("likes", "x"),))], [memory.Proposal(f"k{i}", value="x") for i in range(21)]):
        with pytest.raises(ValueError):
            memory.reconcile(state, "s", bad, 2)


def test_batches_tell_absent_from_null(spark):
    _, state = saved(spark, ("k", None, "old", None))
    text = '{"changes": [{"key": "k", "value": "new"}, {"key": "n", "value": "v", "expectedHash": null}]}'
    rows = memory.batch(text)
    assert [r["expected_set"] for r in rows] == [False, True]
    kind = f"{ENTRY}, expected string, expected_set boolean"
    df = spark.createDataFrame([tuple(r.values()) for r in rows], kind)
    assert {r.key: r.action for r in memory.preview(state, df).collect()} == {"k": "updated", "n": "created"}
    shown, changes = memory.apply_batch(state, df, 2)
    assert {r.key: r.action for r in shown.collect()} == {"k": "conflict", "n": "created"} and changes == {}
    df = df.withColumn("expected_set", F.lit(True)).withColumn("expected", F.when(F.col("key") == "k", F.lit(state["memories"].first().hash)))
    assert memory.apply_batch(state, df, 2)[1]["memories"].count() == 2
    with pytest.raises(ValueError):
        memory.preview(state, df.union(df))


def test_reviews_requests_and_feedback(spark):
    _, state = saved(spark, ("k", None, "x", None))
    ask = spark.createDataFrame([("k", "file", "a", "h", "why")], "key string, source_type string, source_id string, content_hash string, reason string")
    state |= memory.ask_reviews(state, ask, 1)
    one = ("k", "file", "a", "h")
    for bad in (("keep!", None), ("change", None), ("change", 9)):
        with pytest.raises(ValueError):
            memory.resolve_review(state, one, *bad, 2)
    done, changes = memory.resolve_review(state, one, "change", 1, 2)
    state |= changes
    assert done and memory.resolve_review(state, one, "keep", None, 3) == (False, {})
    assert memory.ask_reviews(state, ask, 4)["reviews"].count() == 1 and memory.of_status(state["reviews"], "open").count() == 0
    for bad in (ask.withColumn("key", F.lit("none")), ask.withColumn("reason", F.lit(" ")), ask.withColumn("source_type", F.repeat(F.lit("x"), F.lit(65)))):
        with pytest.raises(ValueError):
            memory.ask_reviews(state, bad, 1)
    state["requests"] = prepare.asked(state["requests"], "s", " need ", 5)
    done, changes = prepare.resolved(state, "s", "need", "k", 6)
    state |= changes
    assert done and prepare.resolved(state, "s", "need", "k", 7) == (False, {}) and state["requests"].first().resolved_key == "k"
    again = prepare.asked(state["requests"], "s", "need", 8).first()
    assert (again.status, again.resolved_key, again.created_at, again.updated_at) == ("open", None, 5, 8)
    with pytest.raises(LookupError):
        prepare.resolved(state, "s", "need", "none", 9)


def test_prepare_searches_asks_and_skips(spark):
    _, state = saved(spark, ("auth.sessions", "decision", "Sessions are signed.", None), ("other.thing", None, "Unrelated words.", None))
    ask = lambda text, **kw: prepare.prepare(kw.pop("state", state), prepare.Request(text, "agent:1", **kw.pop("request", {})), 5, **kw)
    made, changes = ask("signed sessions")
    assert made.action == "retrieve" and [n["id"] for n in made.nodes] == ["intent:auth.sessions"] and "`auth.sessions`" in made.text and "signed." not in made.text
    assert changes["sessions"].first().agent == "agent" and changes["decisions"].first().action == "retrieve"
    assert ask("hello")[0].action == "skip" and ask("nothing like it")[0].action == "skip"  # without a gate nobody judges
    gate = lambda r, c: prepare.Proposal("search", "CONTEXT_SEARCH_REQUIRED", "nothing like it")
    made, changes = ask("what?", gate=gate)
    assert made.action == "ask" and made.clarification and changes["requests"].first().need == "nothing like it"
    bad = lambda r, c: prepare.Proposal("skip", "NO SUCH REASON")
    assert ask("signed sessions", gate=bad)[0].fallback and ask("signed sessions", gate=bad)[0].action == "retrieve"
    found, changes = prepare.explain(state, ["auth.sessions"], "agent:1", 6)
    assert found[0]["memory"].key == "auth.sessions" and found[0]["paths"] == ["auth.sessions"]
    assert ask("signed sessions", state={**state, **changes})[0].action == "skip"  # what is open is no hint
    with_decision = {**state, **ask("signed sessions")[1]}
    one = with_decision["decisions"].first().id
    given = prepare.feedback(with_decision, one, "incorrect", 7, "ask", ["b", "a", "b"], " note ")["feedback"].first()
    assert given.expected_keys == ["a", "b"] and given.note == "note"
    for wrong in ((one, "incorrect"), (one, "maybe")):
        with pytest.raises(ValueError):
            prepare.feedback(with_decision, *wrong, 7)
    with pytest.raises(LookupError):
        prepare.feedback(with_decision, "none", "correct", 7)


def test_requests_and_proposals_are_checked():
    ok = prepare.checked_request(prepare.Request(" m ", "s", paths=("a", "a", " ")))
    assert ok.message == "m" and ok.paths == ("a",)
    for bad in (prepare.Request("", "s"), prepare.Request("m", "s", budget=127), prepare.Request("m", "s", paths=tuple(map(str, range(33)))), prepare.Request("m", "s" * 256)):
        with pytest.raises(ValueError):
            prepare.checked_request(bad)
    assert prepare.checked_proposal(prepare.Proposal("Search", "gate_unavailable", " q ", ("a", "a "))).keywords == ("a",)
    P = prepare.Proposal
    for bad in (P("search", "GATE_UNAVAILABLE"), P("skip", "GATE_UNAVAILABLE", "q"), P("ask", "GATE_UNAVAILABLE"), P("search", "GATE_UNAVAILABLE", "q", ("x",) * 9), P("search", "GATE_UNAVAILABLE", "q", ("x" * 129,))):
        with pytest.raises(ValueError):
            prepare.checked_proposal(bad)


def test_queries_name_their_signals(spark):
    _, state = saved(spark, ("auth.sessions", "decision", "Sessions are signed.", None), ("auth.cookies", None, "Cookies hold them.", None))
    _, changes = graph.link(state, ("intent", "auth.sessions"), ("knowledge", "auth.cookies"), "uses", "test")
    state |= changes
    wanted = embeddings.candidates(state["nodes"])
    model = lambda texts: [[1.0, 0.0] if "ookies" in t else [0.0, 1.0] for t in texts]
    state["embeddings"] = embeddings.backfilled(state["embeddings"], wanted, "m", model, dimensions=2)
    got = prepare.query(state, "signed", name="m", model=model)
    assert got["matches"] == [("intent:auth.sessions", {"text": None, "semantic": 1.0, "bm25": pytest.approx(0.693, abs=0.1)}), ("knowledge:auth.cookies", {"semantic": 0.0})]
    assert got["edges"].count() == 1 and prepare.query(state, "auth", 5)["paths"] == ["auth.cookies", "auth.sessions"]
    broken = lambda texts: 1 / 0
    assert prepare.query(state, "signed", name="m", model=broken)["seeds"] == []
    for bad in (lambda t: [[1.0]] * len(t), lambda t: [[float("nan"), 1.0]] * len(t), lambda t: []):
        with pytest.raises(Exception, match="vectors"):
            embeddings.embedded(wanted, bad, 2).collect()


def chain(spark, n):
    return spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}", "next") for i in range(n)], "source_id string, target_id string, relation string")


def test_paths_have_no_bound(spark):
    steps = graph.shortest_path(chain(spark, 24), "n024", "n000").orderBy("step").collect()
    assert [s.source_id for s in steps] == [f"n{i:03d}" for i in range(23, -1, -1)]
    assert graph.shortest_path(chain(spark, 2), "n000", "elsewhere").count() == 0
    both = spark.createDataFrame([("a", "c", "z"), ("a", "b", "y"), ("b", "d", "x"), ("c", "d", "w")], "source_id string, target_id string, relation string")
    assert [(s.source_id, s.target_id) for s in graph.shortest_path(both, "a", "d").orderBy("step").collect()] == [("a", "b"), ("b", "d")]


def test_subgraphs_and_bridges(spark):
    _, state = saved(spark, ("game.lol.rule", "decision", "x", None), ("game.lol.items", None, "y", None), ("game.go", None, "z", None))
    nodes = graph.context(state["nodes"])
    shown = graph.subgraph(nodes, state["edges"], "lol")
    assert shown["ids"] == ["intent:game.lol.rule", "knowledge:game.lol.items"] and shown["truncated"] and shown["nodes_total"] == 3
    assert graph.subgraph(nodes, state["edges"], "none")["ids"] == [] and len(graph.subgraph(nodes, state["edges"], "")["ids"]) == 3
    steps, bridge = graph.path(nodes, state["edges"], "game.lol.rule", "game.go")
    assert steps.count() == 0 and bridge == ["game.lol.rule", "game.lol", "game", "game.go"]
    with pytest.raises(LookupError):
        graph.path(nodes, state["edges"], "game.lol.rule", "none")


def test_updates_read_only_what_changed(spark, tmp_path):
    (tmp_path / "README.md").write_text("# Guide\ntext\n```\n# no\n```\n## Install\n")
    (tmp_path / "Demo.java").write_text("class Demo {\n  void run() {}\n}\n")
    (tmp_path / "a.go").write_text('package a\n\nfunc run() {\n\thelper()\n\thelper() // other()\n\tlog("x()")\n}\n\nfunc (s *Service) helper() {\n}\n')
    state = new_state(spark)
    counts, changes = update.update_folder(state, str(tmp_path))
    state |= changes
    assert counts == {"added": 3, "modified": 0, "unchanged": 0, "removed": 0}
    labels = {r.label for r in state["nodes"].collect()}
    assert labels == {"README.md", "Demo.java", "a.go", "Guide", "Install", "Demo", "run()", "Service.helper()"}
    named = {r.id: r.label for r in state["nodes"].collect()}
    assert {(named[e.source_id], named[e.target_id]) for e in state["edges"].where("relation = 'calls'").collect()} == {("run()", "Service.helper()")}
    assert {(named[e.source_id], named[e.target_id]) for e in state["edges"].where("relation = 'contains'").collect()} >= {("README.md", "Guide"), ("Guide", "Install"), ("Demo.java", "Demo")}
    assert update.update_folder(state, str(tmp_path))[0]["unchanged"] == 3
    guide = next(i for i, x in named.items() if x == "README.md")
    state["edges"] = state["edges"].unionByName(spark.createDataFrame([("intent:k", guide, "applies_to", "durable", "x")], state["edges"].schema))
    state["nodes"] = state["nodes"].unionByName(spark.createDataFrame([("intent:k", "k", "intent", "durable", "active")], "id string, label string, kind string, owner string, state string"), allowMissingColumns=True)
    os.remove(tmp_path / "README.md")
    (tmp_path / "Demo.java").write_text("class Other {}\n")
    counts, changes = update.update_folder(state, str(tmp_path))
    assert counts == {"added": 0, "modified": 1, "unchanged": 1, "removed": 1}
    after = {r.label: (r.owner, r.state) for r in changes["nodes"].collect()}
    assert after["README.md"] == ("durable", "missing") and "Guide" not in after and "Other" in after and "Demo" not in after
    with pytest.raises(ValueError):
        files.full_path(str(tmp_path), "file:../secret")
    assert files.full_path(str(tmp_path), "resource:r/file:Demo.java").endswith("Demo.java")


def test_folders_keep_versions_for_one_writer(spark, tmp_path):
    folder = Folder(spark, f"file://{tmp_path}/p")
    assert folder.version() == 0 and {n: folder.load()[n].count() for n in TABLES} == dict.fromkeys(TABLES, 0)
    _, state = saved(spark, ("k", None, "x", None))
    assert folder.save({"memories": state["memories"]}) == 1
    assert folder.save({"settings": embeddings.with_setting(folder.load()["settings"], "model", "m")}) == 2
    assert folder.load()["memories"].first().key == "k" and folder.load(1)["settings"].count() == 0 and embeddings.setting(folder.load()["settings"], "model") == "m"
    with pytest.raises(Exception):  # noqa: B017, PT011  a file system's own error
        folder.save({"memories": state["memories"]}, 1)
    results = memory.retried(folder, "s", lambda s: [memory.Proposal("k", value="y", expected=s["memories"].first().hash)], 3)
    assert results.first().action == "updated" and folder.version() == 3


def test_workspaces(spark, tmp_path):
    seen = project.observed_worktrees("worktree /a\nHEAD 1\nbranch refs/heads/main\n\nworktree /b\nHEAD 2\ndetached\n\nworktree /c\nbare\n")
    assert [(w["root"], w["branch"]) for w in seen] == [("/a", "main"), ("/b", "")]
    resource, views = project.observe(spark, str(tmp_path), 1)
    assert resource.first().provider == "local" and views.first().root == os.path.realpath(tmp_path)
    state = new_state(spark)
    state |= project.workspace_saved(state, resource, views)
    view = views.first().id
    state["sessions"] = prepare.session_saved(state, "a:1", view, "active", 1)
    state["sessions"] = prepare.session_saved(state, "a:2", "unknown", "ended", 2)
    nested, rest = project.workspace(state)
    assert [s.id for s in nested.first().views[0].sessions] == ["a:1"] and [r.id for r in rest.collect()] == ["a:2"]
    state |= project.unassigned(state, resource.first().id)
    assert state["views"].count() == 0 and {r.id: r.view_id for r in state["sessions"].collect()} == {"a:1": None, "a:2": "unknown"}
    p = state["projects"]
    for one in (("p", "P", "/w"), ("q", "Q", "/w/deep"), ("r", "R", "/w/deep")):
        p = project.registered(p, one, 1)
    state["projects"] = p
    assert project.of_folder(state, "/w/x") == "p" and project.of_folder(state, "/elsewhere") is None and project.of_folder(state, "/w/deep/x", given="q") == "q"
    with pytest.raises(project.Ambiguous):
        project.of_folder(state, "/w/deep/x")
    state["projects"] = project.removed(p, "r", 2)
    assert project.of_folder(state, "/w/deep/x") == "q" and [r.id for r in project.listed(state["projects"]).collect()] == ["p", "q"]
    owned = spark.createDataFrame([("p", "git", "u")], "project_id string, provider string, identity string")
    assert project.of_folder(state, "/w/deep/x", ("git", "u"), known=owned) == "p"
    watch = spark.createDataFrame([("o", "git", "O", "u", "/o", 1)], TABLES["observations"])
    state |= project.observations_saved(state, watch)
    state |= project.assigned(state, "o")
    assert state["observations"].count() == 0 and state["resources"].first().id == "o" and state["views"].first().root == "/o"


def test_transcripts_are_read_line_by_line(spark, tmp_path):
    good = [{"type": "user_message", "content": "[TODO] fix it"}, {"role": "tool", "message": {"role": "assistant", "content": ["a", {"type": "text", "text": " b "}, {"type": "tool_result", "text": "no"}]}}, {"role": "user", "content": [{"type": "tool_result", "text": "x"}]}, {"role": "user", "content": "outer", "payload": {"text": "inner {x}"}}]
    path = tmp_path / "t.jsonl"
    path.write_text("\n".join([json.dumps(good[0]), "", *map(json.dumps, good[1:])]) + "\n")
    rows = transcripts.read_transcript(spark, str(path)).orderBy("seq").collect()
    assert [(r.line, r.id, r.text) for r in rows] == [(1, "U000001", "[TODO] fix it"), (3, "A000002", "a\nb"), (5, "U000003", "inner {x}")]
    path.write_text('{"role": "user", "content": "a"}\n\n[1]\n')
    with pytest.raises(ValueError, match="line 3"):
        transcripts.read_transcript(spark, str(path))


def test_consolidation_rests_on_its_pair(spark):
    C = transcripts.Candidate
    a, b, c = (C(x, (f"U{i}",), (("applies_to", x),), (x,)) for i, x in enumerate("abc"))
    both = lambda x, y: C(x.value + y.value, x.evidence + y.evidence, x.links, ("left", "right"))
    made = transcripts.consolidated([a, b, c], both)
    assert made.value == "abc" and made.evidence == ("U0", "U1", "U2") and made.sources == ("a", "b", "c")
    for wrong in (lambda x, y: both(x, y)._replace(evidence=("U9",)), lambda x, y: both(x, y)._replace(sources=("left",)), lambda x, y: both(x, y)._replace(links=(("x", "y"),)), lambda x, y: None):
        assert transcripts.consolidated([a, b], wrong) is None
    groups = spark.createDataFrame([("k", ["a|b", "c"]), ("n", [])], "key string, values array<string>")
    assert [tuple(r) for r in transcripts.reduced(groups, "key", lambda x, y: f"{x}+{y}").collect()] == [("k", "a|b+c")]


def test_queue_works_each_job_once(spark, tmp_path):
    top, source = f"file://{tmp_path}/q", tmp_path / "t.jsonl"
    source.write_text('{"role": "user", "content": "a"}')
    add = lambda: jobs.enqueue(spark, top, f"file://{source}", "agent", "s", "p", "/w", "end", 1)
    name = add()
    assert add() == name and jobs.jobs_of(spark, top)[0].count() == 1
    source.write_text("changed")
    assert "user" in spark.read.text(jobs.jobs_of(spark, top)[0].first().transcript, wholetext=True).first()[0]
    (tmp_path / "q/jobs/bad.json").write_text("{}")
    fail = lambda job: 1 / 0
    assert jobs.process(spark, top, fail, 10) == {"completed": 0, "failed": 1, "quarantined": 1, "held": 0}
    assert jobs.runs(spark, top).first().phase == "failed"
    assert jobs.process(spark, top, lambda job: "done", 11) == {"completed": 1, "failed": 0, "quarantined": 0, "held": 0}
    assert [(r.kind, r.detail) for r in jobs.runs(spark, top).collect()] == [("completed", "done")]
    assert jobs.process(spark, top, fail, 12) == {"completed": 0, "failed": 0, "quarantined": 0, "held": 0}


def test_mentions_of_short_names(spark):
    texts = spark.createDataFrame([(1, "see internal/app/service.go."), (2, "x"), (3, None), (4, "")], "id long, text string")
    names = spark.createDataFrame([("file:internal/app/service.go", "internal/app/service.go"), ("file:x", "x"), ("file:other.go", "other.go"), ("file:none", "")], "uri string, path string")
    assert {tuple(r) for r in records.mentioned_refs(texts, names, "text", "id").collect()} == {(1, "file:internal/app/service.go"), (2, "file:x")}
    many = spark.createDataFrame([(f"u{i:03d}", f"n{i:03d}") for i in range(80)], "uri string, path string")
    text = spark.createDataFrame([(1, " ".join(f"n{i:03d}" for i in range(80)))], "id long, text string")
    assert [r.uri for r in records.mentioned_refs(text, many, "text", "id").orderBy("uri").collect()] == [f"u{i:03d}" for i in range(64)]


def test_active_paths_are_compared_below_their_root(spark, tmp_path):
    (tmp_path / "real").mkdir()
    (tmp_path / "link").symlink_to(tmp_path / "real")
    given = ["Src/A.go", "@repo/b", "file:b", "../x", str(tmp_path / "c"), str(tmp_path / "link" / "new" / "D.go"), "/elsewhere/E"]
    want = ["src/a.go", "b", "../x", "c", "real/new/d.go", "elsewhere/e"]
    assert prepare.active_paths(str(tmp_path), given) == want
    told = []
    request = prepare.Request("a question", "agent:1", directory=str(tmp_path), paths=tuple(given))
    prepare.prepare(new_state(spark), request, 1, lambda r, catalog: told.append(r.paths) or prepare.Proposal("skip", "SELF_CONTAINED"))
    assert told == [tuple(want)]
