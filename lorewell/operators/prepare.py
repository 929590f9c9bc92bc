"""Answers from a project's graph: a query's matches and surroundings, and what a message should have at hand."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from hashlib import sha256
from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import identity, namespace, preview, trim_space
from ..state import State
from . import embeddings, graph
from .memory import checked_key
from .ranking import bm25, choose_hints, render_hints
from .records import upsert

# What a proposal may say, and messages that are only a greeting.
ACTIONS = ("skip", "search", "ask")
REASONS = (
    "SELF_CONTAINED CONTEXT_SEARCH_REQUIRED PRIOR_DECISION_REFERENCED PROJECT_CONTEXT_REQUIRED SESSION_HISTORY_REQUIRED CODE_CONTEXT_REQUIRED USER_INPUT_REQUIRED AMBIGUOUS_REQUEST GATE_UNAVAILABLE"
).split()
GREETINGS = ("hi", "hello", "hey", "안녕", "안녕하세요", "반가워")
#: The most characters of a message, a query, a clarification and a keyword; tokens of a budget; paths and keywords.
MESSAGE, QUERY, CLARIFICATION, KEYWORD = 1 << 20, 4096, 2048, 128
BUDGET, PATHS, KEYWORDS = (128, 32_768), 32, 8


def active(nodes: DataFrame) -> DataFrame:
    return nodes.where("state = 'active'")


def with_content(nodes: DataFrame) -> DataFrame:
    """Active nodes whose content is more than white space."""
    return active(nodes).where(F.coalesce(trim_space(F.col("content")), F.lit("")) != "")


def candidates(nodes: DataFrame) -> DataFrame:
    """What full-text search ranks of a context: id, key, label, kind (the finer one, if any), source, content, path, owner, state, subkind."""
    at = lambda c: F.coalesce(F.col(c), F.lit(""))
    source = F.when((at("material_uri") != "") & (at("locator") != ""), F.concat_ws("#", "material_uri", "locator")).otherwise(at("material_uri"))
    finer = F.coalesce(F.nullif("subkind", F.lit("")), "kind")
    return with_content(nodes).select("id", F.col("id").alias("key"), "label", finer.alias("kind"), source.alias("source"), "content", "path", "owner", "state", "subkind", F.col("kind").alias("node_kind"))


#: What of a candidate full-text search reads.
FIELDS = ["key", "label", "kind", "source", "content"]


def query(state: State, text: str, limit: int = 20, name: str = "default", model: embeddings.Model | None = None) -> dict:
    """matches (id, signals), nodes and edges around them, branches under the text.

    Matches come in the order text, semantic, full text, each node once with its kinds of signal. Around them lie at
    most four times limit nodes, two hops deep; only matches among these are given. limit: 20 if not within 1 and 100.
    """
    text = text.strip()
    if not text:
        raise ValueError("a query is empty")
    limit = graph.clamped(limit, 20, 100)
    nodes, edges = graph.context(state["nodes"]), state["edges"]
    near = embeddings.matches(nodes.sparkSession, state["embeddings"], nodes, text, name, model, limit)
    words = bm25(candidates(nodes), FIELDS, text)
    # Each seed that is taken is visible itself, so no more seeds than visible nodes are ever taken: the heads of the
    # lanes in order decide what is visible. Then every lane tells, whole, which of these nodes it matches.
    room = 4 * limit
    texts = graph.seeded(nodes, text)
    heads = [r.id for r in graph.in_order(texts).select("id").limit(room).collect()]
    likest = [(r.node_id, r.score) for r in near.orderBy(F.desc("score"), "node_id").collect()]
    heads += [i for i, _ in likest]
    if len(set(heads)) < room:
        heads += [r.id for r in words.orderBy(F.desc("score"), "key").select("id").limit(room).collect()]
    around = graph.neighborhood(edges, heads, 2, room)
    here = F.col("id").isin(around) if around else F.lit(False)
    lanes = [
        ("text", [(r.id, None) for r in graph.in_order(texts.where(here)).select("id").collect()]),
        ("semantic", [(i, score) for i, score in likest if i in set(around)]),
        ("bm25", [(r.id, r.score) for r in words.where(here).orderBy(F.desc("score"), "key").select("id", "score").collect()]),
    ]
    signals: dict[str, dict[str, float | None]] = {}
    for kind, lane in lanes:
        for i, score in lane:
            signals.setdefault(i, {}).setdefault(kind, score)
    return {
        "seeds": [i for i, _ in likest],
        "matches": list(signals.items()),
        "ids": around,
        "nodes": nodes.where(here),
        "edges": graph.induced(edges, around) if around else edges.limit(0),
        "paths": [r.branch for r in graph.branches(nodes.select("path"), text, limit).collect()],
    }


@dataclass(frozen=True)
class Request:
    message: str
    session: str
    directory: str = "."
    budget: int = 2000
    paths: tuple[str, ...] = ()
    keep_input: bool = False


@dataclass(frozen=True)
class Proposal:
    """What a gate thinks a message needs."""

    action: str
    reason: str
    query: str | None = None
    keywords: tuple[str, ...] = ()
    clarification: str | None = None


@dataclass(frozen=True)
class Prepared:
    action: str
    proposal: Proposal
    nodes: list[dict] = field(default_factory=list)
    edges: list[tuple[str, str, str]] = field(default_factory=list)
    text: str = ""
    clarification: str | None = None
    fallback: str | None = None
    decision: str = ""


def distinct(values) -> tuple:
    """Each value once, in order of first sight."""
    return tuple(dict.fromkeys(values))


def checked_request(r: Request) -> Request:
    r = replace(r, message=r.message.strip(), session=r.session.strip(), directory=r.directory.strip(), paths=distinct(p.strip() for p in r.paths if p.strip()))
    if not (r.message and r.session and r.directory):
        raise ValueError("message, session and directory are required")
    if len(r.message) > MESSAGE or len(r.session.encode()) > 255 or len(r.directory.encode()) > 1024 or any(len(p.encode()) > 1024 for p in r.paths):
        raise ValueError("message, session, directory or a path is too long")
    if not BUDGET[0] <= r.budget <= BUDGET[1]:
        raise ValueError(f"a token budget lies between {BUDGET[0]} and {BUDGET[1]}")
    if len(r.paths) > PATHS:
        raise ValueError(f"at most {PATHS} paths")
    return r


def checked_proposal(p: Proposal) -> Proposal:
    clean = lambda x: x if x is None else x.strip()
    p = replace(p, action=p.action.strip().lower(), reason=p.reason.strip().upper(), query=clean(p.query), clarification=clean(p.clarification), keywords=tuple(k.strip() for k in p.keywords))
    if p.action not in ACTIONS or p.reason not in REASONS:
        raise ValueError("no such action or reason")
    if p.query is not None and not 0 < len(p.query) <= QUERY or (p.action == "search") > (p.query is not None) or p.action == "skip" and p.query is not None:
        raise ValueError("a search has a query, a skip has none")
    if p.action == "ask" and not p.clarification or len(p.clarification or "") > CLARIFICATION:
        raise ValueError("an ask has a clarification within its limit")
    if len(p.keywords) > KEYWORDS or any(not 0 < len(k) <= KEYWORD for k in p.keywords):
        raise ValueError("too many keywords, or an empty or overlong one")
    return replace(p, keywords=distinct(p.keywords))


def greeting(message: str) -> bool:
    return message.strip().lower().strip("!?. ") in GREETINGS


def fallback(message: str) -> Proposal:
    """What is proposed without a gate: nothing for a greeting or an overlong message, else a search for the message."""
    if greeting(message):
        return Proposal("skip", "SELF_CONTAINED")
    if len(message) > QUERY:
        return Proposal("skip", "GATE_UNAVAILABLE")
    return Proposal("search", "GATE_UNAVAILABLE", message.strip())


def normal_path(path: Column) -> Column:
    """A path as it is compared: lower case, forward slashes, no root's name before it."""
    out = F.btrim(F.lower(F.regexp_replace(trim_space(path), r"\\", "/")), F.lit("/"))
    for head in ("@repo/", "@root/", "file:"):
        out = F.when(F.startswith(out, F.lit(head)), F.substr(out, F.lit(len(head) + 1))).otherwise(out)
    return F.btrim(out, F.lit("/"))


def active_paths(root: str, paths) -> list[str]:
    """Paths as they are compared, each once in order: those below root relative to it, links resolved as far as they exist."""
    top, out = os.path.realpath(root), []
    for p in paths:
        clean = os.path.normpath(p.strip())
        if os.path.isabs(clean):
            full = os.path.realpath(clean)
            clean = os.path.relpath(full, top) if os.path.commonpath([top, full]) == top else full
        name = clean.replace("\\", "/").lower().strip("/")
        for head in ("@repo/", "@root/", "file:"):
            name = name.removeprefix(head)
        out.append(name.strip("/"))
    return list(distinct(out))


def session_id(given: str | None = None) -> str:
    return (given or os.environ.get("LOREWELL_SESSION", "")).strip() or "local:default"


def session_agent(session: Column) -> Column:
    """What stands before the first colon of a session's id; unknown without one."""
    agent = F.substring_index(session, ":", 1)
    return F.when(F.contains(session, F.lit(":")) & (agent != ""), agent).otherwise("unknown")


def catalog(state: State, opened: int) -> dict:
    """Counts that a gate is told: memories by namespace, active nodes by kind, entities, open requests."""
    kinds = {r.kind: r["count"] for r in active(state["nodes"]).groupBy("kind").count().orderBy("kind").collect()}
    names = state["memories"].groupBy(namespace(F.col("key")).alias("name")).count().orderBy(F.desc("count"), "name").limit(32).collect()
    one = lambda df: df.count()
    return {
        "namespaces": {r.name: r["count"] for r in names}, "kinds": kinds, "resources": one(state["resources"]), "sessions": one(state["sessions"]), "opened": opened,
        "open_requests": one(state["requests"].where("status = 'open'")),
    }


def opened_keys(deliveries: DataFrame, session: str | None = None) -> DataFrame:
    """(session_id, key) of what sessions, or one of them, have opened."""
    rows = deliveries if session is None else deliveries.where(F.col("session_id") == session)
    return rows.select("session_id", "key").distinct()


ASKING = "There is not enough in the project's memory. Which decision or information applies here?"


def prepare(state: State, request: Request, at: int, gate: Callable[[Request, dict], Proposal] | None = None, name: str = "default", model: embeddings.Model | None = None) -> tuple[Prepared, dict[str, DataFrame]]:
    """What a message should have at hand, and the tables changed: a decision is written down, an ask is a request too.

    A gate proposes, told of the paths that are worked on as they are compared; where there is none, or it fails or proposes what is not valid, the message itself is searched.
    A search finds hints within the token budget, never what the session has opened. Without hints it is skipped if
    no gate was there to judge, else the user is asked.
    """
    request = checked_request(request)
    request = replace(request, paths=tuple(active_paths(request.directory, request.paths)))
    nodes, spark = graph.context(state["nodes"]), state["nodes"].sparkSession
    opened = {r.key for r in opened_keys(state["deliveries"], request.session).collect()}  # of one session
    proposal, why = fallback(request.message), None
    if not greeting(request.message):
        if gate is None:
            why = "there is no gate"
        else:
            try:
                proposal = checked_proposal(gate(request, catalog(state, len(opened))))
            except Exception as error:  # noqa: BLE001  whatever a gate raises, the message is searched
                why = str(error)
    out, changes = Prepared(proposal.action, proposal, fallback=why), {}
    if proposal.action == "search":
        text = proposal.query or request.message
        near = embeddings.matches(spark, state["embeddings"], nodes, text, name, model, 8)
        all_ = candidates(nodes)
        semantic = [r.asDict() for r in all_.join(near.withColumnRenamed("node_id", "id"), "id").orderBy(F.desc("score"), "id").collect()]
        lexical = bm25(all_, FIELDS, text, proposal.keywords)
        shown = lambda r: {**r, "kind": r["node_kind"]}
        lane = lexical.withColumn("kind", F.col("node_kind"))
        links = lambda ids: [tuple(r) for r in graph.induced(state["edges"], ids).select(*graph.EDGE).distinct().orderBy(*graph.EDGE).collect()]
        chosen, edges = choose_hints([shown(r) for r in semantic], lane, opened, request.budget, links, order=[F.desc("score"), F.asc("key")])
        if chosen:
            out = replace(out, action="retrieve", nodes=chosen, edges=edges, text=render_hints(chosen, edges))
            changes["sessions"] = session_saved(state, request.session, None, "active", at)
        else:
            out = replace(out, action="skip" if proposal.reason == "GATE_UNAVAILABLE" else "ask")
    need = None
    if out.action == "ask":
        need = proposal.query or request.message
        changes["requests"] = asked(state["requests"], request.session, need, at)
        out = replace(out, clarification=proposal.clarification or ASKING)
    digest = sha256(request.message.encode()).hexdigest()
    row = spark.createDataFrame(
        [(request.session, digest, request.message if request.keep_input else None, out.action, json.dumps(proposal.__dict__, ensure_ascii=False), out.text or None, why, need, at)],
        "session_id string, input_hash string, input_text string, action string, proposal string, hints string, fallback string, request string, created_at long",
    )
    row = row.withColumn("id", identity(F.col("session_id"), F.col("input_hash"), F.col("created_at"), F.lit(uuid4().hex)))
    row = spark.createDataFrame(row.collect(), row.schema)  # its id once and for all
    changes["decisions"] = state["decisions"].unionByName(row, allowMissingColumns=True)
    return replace(out, decision=row.first().id), changes


def session_saved(state: State, session: str, view: str | None, status: str, at: int) -> DataFrame:
    """The sessions with one more, or with its new status (active or ended)."""
    if status not in ("active", "ended"):
        raise ValueError("a session is active or ended")
    row = state["sessions"].sparkSession.createDataFrame([(session, view or None, status, at)], "id string, view_id string, status string, updated_at long")
    return upsert(state["sessions"], row.withColumn("agent", session_agent(F.col("id"))).select(*state["sessions"].columns), ["id"])


def deliveries_saved(state: State, session: str, nodes: DataFrame, at: int) -> DataFrame:
    """The deliveries with nodes of a context, by session, key and hash, a preview of each in place of its content."""
    new = nodes.select(
        F.lit(session).alias("session_id"), F.col("id").alias("key"), "kind", "label", F.col("path").alias("source"), preview(F.coalesce("content", F.lit(""))).alias("preview"),
        identity(F.col("id"), F.col("content")).alias("hash"), F.lit(at).cast("long").alias("delivered_at"),
    )
    return upsert(state["deliveries"], new, ["session_id", "key", "hash"])


def explain(state: State, queries: list[str], session: str, at: int) -> tuple[list[dict], dict[str, DataFrame]]:
    """What each query names: the node, its memory, connections and sibling branches; the session has opened them then."""
    if not queries:
        raise ValueError("a query is required")
    nodes, out = graph.context(state["nodes"]), []
    for q in queries:
        row = graph.find(nodes, q).first()
        if row is None:
            raise LookupError(f"no node {q!r}")
        met, paths = graph.explanation(nodes, state["edges"], row.id)
        memory = state["memories"].where((F.col("key") == row.ref)).first() if row.owner == "durable" else None
        out.append({"node": row, "memory": memory, "connections": met, "paths": paths})
    ids = distinct(x["node"].id for x in out)
    return out, {"sessions": session_saved(state, session, None, "active", at), "deliveries": deliveries_saved(state, session, nodes.where(F.col("id").isin(list(ids))), at)}


def asked(requests: DataFrame, session: str, need: str, at: int) -> DataFrame:
    """The requests with one of a session and a need: a new one, or the old one open again without its resolution."""
    need = need.strip()
    if not need:
        raise ValueError("a need is required")
    spark = requests.sparkSession
    old = requests.where((F.col("session_id") == session) & (F.col("need") == need)).select("session_id", "need", F.col("created_at").alias("first"))
    row = spark.createDataFrame([(session, need, "open", at, at)], "session_id string, need string, status string, created_at long, updated_at long").join(old, ["session_id", "need"], "left")
    row = row.withColumn("created_at", F.coalesce("first", "created_at")).drop("first").withColumn("resolved_key", F.lit(None).cast("string")).withColumn("resolved_at", F.lit(None).cast("long"))
    return upsert(requests, row.select(*requests.columns), ["session_id", "need"])


def asked_log(log: DataFrame) -> DataFrame:
    """The requests after a whole log (session_id, need, seq, resolved_key) of asking and, with a key, resolving.

    One row for each session and need: first_seq and last_seq, status and resolved_key after the last entry. Only an
    open request can be resolved, which any last entry with a key finds.
    """
    last = F.max_by(F.struct("resolved_key"), "seq")["resolved_key"]  # the last entry's, null or not
    return log.groupBy("session_id", "need").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.when(last.isNull(), "open").otherwise("resolved").alias("status"), last.alias("resolved_key"))


def resolved(state: State, session: str, need: str, key: str, at: int) -> tuple[bool, dict[str, DataFrame]]:
    """An open request resolved by a memory that exists. False if none is open."""
    key = checked_key(key)
    if state["memories"].where(F.col("key") == key).isEmpty():
        raise LookupError(f"no memory {key!r}")
    hit = (F.col("session_id") == session) & (F.col("need") == need.strip()) & (F.col("status") == "open")
    if state["requests"].where(hit).isEmpty():
        return False, {}
    put = {"status": "resolved", "resolved_key": key, "resolved_at": at, "updated_at": at}
    r = state["requests"]
    return True, {"requests": r.select(*[F.when(hit, F.lit(put[c]).cast(r.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in put else F.col(c) for c in r.columns])}


VERDICTS, EXPECTED = ("correct", "incorrect"), ("skip", "retrieve", "ask")


def feedback(state: State, decision: str, verdict: str, at: int, expected: str | None = None, keys=(), note: str | None = None) -> dict[str, DataFrame]:
    """Feedback on a decision that exists, in place of any before; incorrect names the action that was expected."""
    verdict, expected, note = verdict.strip().lower(), expected and expected.strip().lower(), (note or "").strip() or None
    if verdict not in VERDICTS or expected is not None and expected not in EXPECTED or verdict == "incorrect" and expected is None:
        raise ValueError("a verdict is correct, or incorrect with the action that was expected")
    if note and len(note.encode()) > 4096:
        raise ValueError("a note has 4096 bytes at most")
    row = (decision, verdict, expected, sorted({checked_key(k) for k in keys}), note, at)
    new = state["feedback"].sparkSession.createDataFrame([row], state["feedback"].schema)
    if new.join(state["decisions"].select(F.col("id").alias("decision_id")), "decision_id", "left_semi").isEmpty():
        raise LookupError(f"no decision {decision!r}")
    return {"feedback": upsert(state["feedback"], new, ["decision_id"])}


def with_feedback(decisions: DataFrame, given: DataFrame, key: str = "id", newest: str = "created_at", limit: int = 0) -> DataFrame:
    """Decisions with their feedback where there is one, newest first; 100 if limit is not within 1 and 1000."""
    return decisions.join(given, key, "left").orderBy(F.desc(newest), F.desc(key)).limit(graph.clamped(limit, 100, 1000))
