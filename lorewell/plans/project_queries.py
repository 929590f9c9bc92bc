"""A project's own operators over the tables of a folder: memories, links, requests, workspaces, updates, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import folder, kept, spread
from ..functions import text as tx
from ..operators import embeddings, graph, memory, postings, prepare, project, ranking, records, transcripts, update
from ..sources import files
from ..state import new_state
from ..streaming import jobs
from .queries import ASK, COS, QUERIES, TURNS, _bm25_sql, _round, query, table  # noqa: F401  QUERIES: with those added here

AT = 1_000


def _key(name: str, column: str):
    return F.concat(F.lit(f"{name}."), F.col(column).cast("string"))


# --- embeddings


def _wanted(spark, d) -> tuple[DataFrame, DataFrame]:
    """Documents as what should have a vector; every third has one, every ninth a stale one, every fifteenth of another model."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("active").alias("state"), F.lit("knowledge").alias("kind"), F.col("source").alias("label"), F.col("text").alias("content"))
    wanted = embeddings.candidates(docs)
    number = F.col("node_id").cast("long")
    stored = wanted.where(number % 3 == 0).select("node_id", F.when(number % 9 == 0, "stale").otherwise(F.col("content_hash")).alias("content_hash"), F.when(number % 15 == 0, "old").otherwise("stub").alias("model"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))
    return wanted, stored


NODES = """n AS (SELECT doc_id::VARCHAR AS node_id, doc_id AS i, sha256(coalesce(source, '') || chr(10) || 'knowledge' || repeat(chr(10), 4) || coalesce(text, '')) AS content_hash FROM documents),
s AS (SELECT node_id, CASE WHEN i % 9 = 0 THEN 'stale' ELSE content_hash END AS stored_hash FROM n WHERE i % 3 = 0 AND i % 15 <> 0)"""


@query(f"WITH {NODES} SELECT count(*) AS total, count(*) FILTER (WHERE stored_hash = content_hash) AS current, count(*) FILTER (WHERE stored_hash IS DISTINCT FROM content_hash) AS pending FROM n LEFT JOIN s USING (node_id)")
def embedding_status(spark, d):
    wanted, stored = _wanted(spark, d)
    return embeddings.status(stored, wanted, "stub")


@query(f"WITH {NODES} SELECT node_id, content_hash FROM n WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.node_id = n.node_id AND stored_hash = content_hash)")
def embedding_pending(spark, d):
    wanted, stored = _wanted(spark, d)
    return embeddings.pending(stored, wanted, "stub").select("node_id", "content_hash")


@query(f"WITH {NODES}, o AS (SELECT node_id, CASE WHEN i % 9 = 0 THEN 'stale' ELSE content_hash END AS h, CASE WHEN i % 15 = 0 THEN 'old' ELSE 'stub' END AS m, i FROM n WHERE i % 3 = 0) SELECT n.node_id, n.content_hash, 'stub' AS model, CASE WHEN o.h = n.content_hash AND o.m = 'stub' THEN 1.0::DOUBLE ELSE (length(coalesce(d.text, '')) + length(coalesce(d.source, '')) + 14)::DOUBLE END AS first FROM n JOIN documents d ON d.doc_id = n.i LEFT JOIN o ON o.node_id = n.node_id")
def embedding_backfill(spark, d):
    """All that is pending gets its vector from a model, here the length of the text."""
    wanted, stored = _wanted(spark, d)
    filled = embeddings.backfilled(stored, wanted, "stub", lambda texts: [[float(len(t)), 1.0] for t in texts], dimensions=2)
    return embeddings.current(filled, wanted, "stub").select("node_id", "content_hash", "model", F.col("vector")[0].alias("first"))


# --- memories

KINDS = "CASE event_type WHEN 'signup' THEN 'decision' WHEN 'click' THEN 'reference' ELSE 'note' END"
ENTRY = f"g AS (SELECT 'user.' || user_id AS key, event_id AS seq, {KINDS} AS kind, event_type || event_id % 3 AS value FROM events), e AS (SELECT *, sha256(kind || chr(0) || value || chr(0)) AS hash FROM g)"


def _entries(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "signup", "decision").when(F.col("event_type") == "click", "reference").otherwise("note")
    return e.select(_key("user", "user_id").alias("key"), F.col("event_id").alias("seq"), kind.alias("kind"), F.concat("event_type", (F.col("event_id") % 3).cast("string")).alias("value"), F.lit(None).cast("string").alias("source"))


def _halves(spark, d) -> tuple[dict, DataFrame]:
    """A state that has saved the last even entry of each key, and the last entry of each key."""
    log = _entries(spark, d)
    even = records.latest(log.where("seq % 2 = 0"), ["key"], F.col("seq"))
    return memory.save(new_state(spark), even, AT)[1] | {}, records.latest(log, ["key"], F.col("seq"))


HALVES = f"{ENTRY}, b AS (SELECT key, arg_max(hash, seq) AS h, arg_max(kind, seq) AS k FROM e WHERE seq % 2 = 0 GROUP BY key), l AS (SELECT key, arg_max(hash, seq) AS h, arg_max(kind, seq) AS k, arg_max(value, seq) AS v FROM e GROUP BY key)"
NODE_KIND = "CASE {} WHEN 'decision' THEN 'intent' WHEN 'reference' THEN 'reference' ELSE 'knowledge' END"


def _saved(spark, d):
    changed, last = _halves(spark, d)
    state = new_state(spark) | changed
    state["edges"] = state["nodes"].select(F.col("id").alias("source_id"), F.lit("material:x").alias("target_id"), F.lit("applies_to").alias("relation"), F.lit("durable").alias("owner"), F.lit("link").alias("provenance"))
    return state, last


@query(f"WITH {HALVES} SELECT l.key, CASE WHEN b.h IS NULL THEN 'created' WHEN b.h = l.h THEN 'unchanged' ELSE 'updated' END AS action, CASE WHEN b.h IS NULL THEN 1 WHEN b.h <> l.h THEN 2 END::BIGINT AS number FROM l LEFT JOIN b USING (key)")
def memory_saves(spark, d):
    state, last = _saved(spark, d)
    return memory.save(state, last, AT)[0]


@query(f"WITH {HALVES} SELECT {NODE_KIND.format('k')} || ':' || key AS id, key AS label, {NODE_KIND.format('k')} AS kind, k AS subkind, 'durable' AS owner, v AS content FROM l")
def memory_nodes(spark, d):
    state, last = _saved(spark, d)
    return memory.save(state, last, AT)[1]["nodes"].select("id", "label", "kind", "subkind", "owner", "content")


@query(f"WITH {HALVES} SELECT {NODE_KIND.format('b.k')} || ':' || key AS source_id FROM b JOIN l USING (key) WHERE {NODE_KIND.format('b.k')} = {NODE_KIND.format('l.k')}")
def memory_edges_after_kind_change(spark, d):
    """A memory that becomes another kind of node loses the old node's edges."""
    state, last = _saved(spark, d)
    return memory.save(state, last, AT)[1]["edges"].select("source_id")


EXPECT = "CASE WHEN length(l.key) % 3 = 0 THEN b.h WHEN length(l.key) % 3 = 1 THEN l.h END"


@query(f"WITH {HALVES} SELECT l.key, CASE WHEN {EXPECT} IS DISTINCT FROM b.h OR length(l.key) % 2 = 0 THEN 'conflict' WHEN b.h IS NULL THEN 'created' WHEN b.h = l.h THEN 'unchanged' ELSE 'updated' END AS action, b.h AS current_hash, l.h AS proposed_hash FROM l LEFT JOIN b USING (key)")
def batch_conflicts(spark, d):
    """A batch to apply: expectations that are met, wrong, null, and not there at all (keys of even length)."""
    state, last = _saved(spark, d)
    now = state["memories"].select("key", F.col("hash").alias("now"))
    n = F.length("key")
    own = tx.memory_hash(F.col("kind"), F.col("value"), F.col("source"))
    changes = last.join(now, "key", "left").select("key", "kind", "value", "source", F.when(n % 3 == 0, F.col("now")).when(n % 3 == 1, own).alias("expected"), (n % 2 != 0).alias("expected_set"))
    return memory.preview(state, changes, apply=True)


@query(f"WITH {HALVES} SELECT key, h AS hash FROM b WHERE key <> 'user.1' AND (lower(key) = 'user' OR starts_with(lower(key), 'user.'))")
def memory_delete(spark, d):
    state, _ = _saved(spark, d)
    deleted, changes = memory.delete(state, "user.1")
    return memory.under((state | changes)["memories"] if deleted else state["memories"], "USER").select("key", "hash")


REVIEWS = "a AS (SELECT 'user.' || user_id AS key, event_type AS source_type, CAST(user_id % 5 AS VARCHAR) AS source_id, min(event_id) AS i FROM events WHERE 'user.' || user_id IN (SELECT key FROM b) GROUP BY ALL)"


def _reviewed(spark, d):
    state, _ = _saved(spark, d)
    asked = table(spark, d, "events").select(_key("user", "user_id").alias("key"), F.col("event_type").alias("source_type"), (F.col("user_id") % 5).cast("string").alias("source_id"), F.lit("h").alias("content_hash"), F.lpad(F.col("event_id").cast("string"), 9, "0").alias("reason"))
    asked = asked.join(state["memories"].select("key"), "key", "left_semi")
    return state, memory.ask_reviews(state, asked, AT), asked


@query(f"WITH {HALVES}, {REVIEWS} SELECT key, source_type, source_id, lpad(i::VARCHAR, 9, '0') AS reason, CASE WHEN key = 'user.2' THEN 'resolved' ELSE 'open' END AS status, CASE WHEN key = 'user.2' THEN 'keep' END AS outcome FROM a")
def needs_reviews(spark, d):
    """Reviews of memories that exist, each once, asked twice; confirming a memory keeps its open ones."""
    state, changes, asked = _reviewed(spark, d)
    state = state | changes
    _, confirmed = memory.confirm(state, "user.2", AT + 1)
    state = state | confirmed
    again = memory.ask_reviews(state, asked, AT + 2)
    return memory.of_status((state | again)["reviews"], "").select("key", "source_type", "source_id", "reason", "status", "outcome")


@query("SELECT k AS key, regexp_full_match(trim(k), '[A-Za-z0-9][A-Za-z0-9_-]*(\\.[A-Za-z0-9][A-Za-z0-9_-]*)*') AND length(trim(k)) <= 255 AS valid FROM (SELECT DISTINCT CASE page_id % 3 WHEN 0 THEN ' a.' || page_id || '-x ' WHEN 1 THEN url ELSE repeat('k', page_id::INT) END AS k FROM pages)")
def key_validation(spark, d):
    """Keys as a text and how often it is repeated, so that each is told apart before it is long: `k` so many times, or once what it is."""
    n = F.col("page_id")
    text = F.when(n % 3 == 0, F.concat(F.lit(" a."), n.cast("string"), F.lit("-x "))).when(n % 3 == 1, F.col("url")).otherwise("k")
    made = table(spark, d, "pages").select(text.alias("text"), F.when(n % 3 < 2, 1).otherwise(n.cast("int")).alias("times"))
    run = F.col("text").rlike(r"^k*\z")
    times = F.when(F.col("times") < 0, 0).otherwise(F.col("times"))
    short = made.select(F.when(F.col("times").isNotNull(), F.when(run, "k").otherwise(F.col("text"))).alias("text"), F.coalesce(F.when(run, F.length("text") * times), F.lit(1)).alias("times"))
    keys = spread(short, "text", "times").distinct().select(F.repeat("text", F.col("times")).alias("key"))
    return keys.select("key", memory.valid_key(F.col("key")).alias("valid"))


# --- requests, decisions


@query("SELECT 's:' || user_id AS session_id, event_type AS need, min(event_id) AS first_seq, max(event_id) AS last_seq, CASE WHEN arg_max(value, event_id) > 50 THEN 'resolved' ELSE 'open' END AS status FROM events GROUP BY user_id, event_type")
def context_requests(spark, d):
    """Requests, one for each session and need: asked again they open again, answered they are resolved."""
    log = table(spark, d, "events").select(F.concat(F.lit("s:"), F.col("user_id").cast("string")).alias("session_id"), F.col("event_type").alias("need"), F.col("event_id").alias("seq"), F.when(F.col("value") > 50, F.lit("k")).otherwise("").alias("k"))
    return prepare.asked_log(log.withColumn("resolved_key", F.nullif("k", F.lit("")))).select("session_id", "need", "first_seq", "last_seq", "status")


@query("SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id) ORDER BY doc_id DESC LIMIT 100")
def decisions_feedback(spark, d):
    """Decisions with their feedback where there is one, newest first."""
    return prepare.with_feedback(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id", "doc_id", 5000).select("doc_id", "quality", "toxic")


@query("SELECT DISTINCT 's:' || user_id AS session_id, event_type AS key FROM events WHERE event_type <> 'signup'")
def session_opened_keys(spark, d):
    return prepare.opened_keys(table(spark, d, "events").where("event_type <> 'signup'").select(F.concat(F.lit("s:"), F.col("user_id").cast("string")).alias("session_id"), F.col("event_type").alias("key")))


@query("SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 'agent' WHEN user_id % 3 = 1 THEN 'unknown' ELSE 'unknown' END AS agent FROM (SELECT DISTINCT user_id FROM events)")
def session_agents(spark, d):
    n = F.col("user_id")
    users = table(spark, d, "events").select("user_id").distinct()
    session = F.when(n % 3 == 0, F.concat(F.lit("agent:x:"), n.cast("string"))).when(n % 3 == 1, n.cast("string")).otherwise(F.concat(F.lit(":"), n.cast("string")))
    return users.select("user_id", prepare.session_agent(session).alias("agent"))


# --- workspaces


@query(
    """SELECT c_custkey, count(o_orderkey) AS views, coalesce(string_agg(o_orderkey || '(' || n || ')', ' ' ORDER BY o_orderkey), '') AS document FROM customer
LEFT JOIN (SELECT o_custkey, o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) ON o_custkey = c_custkey GROUP BY c_custkey"""
)
def workspace_document(spark, d):
    """The nested document resource, view, session as one text for each resource."""
    o, li = table(spark, d, "orders").select("o_custkey", "o_orderkey"), table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    views = project.nested(o, li, "o_orderkey", "l_orderkey", "sessions", ["l_linenumber"]).select("o_custkey", "o_orderkey", F.size("sessions").alias("n"))
    all_ = project.nested(table(spark, d, "customer").select("c_custkey"), views, "c_custkey", "o_custkey", "views", ["o_orderkey"])
    doc = F.array_join(F.transform("views", lambda x: F.concat(x["o_orderkey"].cast("string"), F.lit("("), x["n"].cast("string"), F.lit(")"))), " ")
    return all_.select("c_custkey", F.size("views").cast("long").alias("views"), doc.alias("document"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0) GROUP BY l_orderkey")
def unmapped_sessions(spark, d):
    known = table(spark, d, "orders").where("o_orderkey % 5 <> 0")
    return project.without_parent(table(spark, d, "lineitem"), known, "l_orderkey", "o_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_custkey <> 1 THEN o_custkey::VARCHAR END AS view_id FROM orders")
def unassigned_sessions(spark, d):
    """The sessions after a resource, nation of customer 1 alone, goes: they stay, without the view that went."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    views = c.select(F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_custkey") == 1, "gone").otherwise("stays").alias("resource_id"))
    sessions = o.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("view_id"))
    return project.unassigned(new_state(spark, views=views, sessions=sessions), "gone")["sessions"].select("id", "view_id")


@query(
    """WITH r AS (SELECT DISTINCT regexp_extract(url, '^(https?://[^/]+)', 1) AS root, page_id % 3 AS p FROM pages UNION SELECT DISTINCT regexp_extract(url, '^(https?://[^/]+/[a-z]+)/', 1), page_id % 2 FROM pages WHERE page_id % 2 = 0),
m AS (SELECT url, max_by(root, len(root)) AS root FROM (SELECT DISTINCT url FROM pages) p LEFT JOIN (SELECT * FROM r WHERE root <> '') r ON url = root OR starts_with(url, root || '/') GROUP BY url)
SELECT url, root, (SELECT string_agg(DISTINCT p::VARCHAR, ',' ORDER BY p::VARCHAR) FROM r WHERE r.root = m.root) AS owners FROM m"""
)
def project_longest_prefix(spark, d):
    p = table(spark, d, "pages")
    roots = p.select(F.regexp_extract("url", "^(https?://[^/]+)", 1).alias("root"), (F.col("page_id") % 3).alias("p")).unionByName(p.where("page_id % 2 = 0").select(F.regexp_extract("url", "^(https?://[^/]+/[a-z]+)/", 1).alias("root"), (F.col("page_id") % 2).alias("p")))
    found = project.deepest_roots(p.select("url").distinct(), roots.where("root <> ''").select("root", F.col("p").cast("string").alias("project_id")), "url")
    return found.select("url", "root", F.array_join("owners", ",").alias("owners"))


@query("SELECT DISTINCT c_custkey, s_suppkey AS project_id FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_mktsegment = 'BUILDING'")
def projects_of_resources(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("provider"), F.col("c_nationkey").cast("string").alias("identity"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("project_id"), F.lit("BUILDING").alias("provider"), F.col("s_nationkey").cast("string").alias("identity"))
    return project.owners(c, s, "c_custkey")


# --- the graph


def _world(spark, d) -> dict:
    """Nations as intents, customers as material of them, every fourth customer without content, every tenth missing."""
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    number = F.col("c_custkey")
    intents = n.select(_key("intent:geo", "n_nationkey").alias("id"), F.col("n_name").alias("label"), F.lit("intent").alias("kind"), F.lit("decision").alias("subkind"), _key("geo", "n_nationkey").alias("ref"), F.lit("durable").alias("owner"), F.lit("active").alias("state"), F.concat(F.lit("all about "), "n_name").alias("content"))
    things = c.select(
        F.concat(F.lit("m"), number.cast("string")).alias("id"), F.col("c_name").alias("label"), F.lit("material").alias("kind"), F.lit("").alias("subkind"), F.lit("x").alias("ref"), F.lit("observed").alias("owner"), F.when(number % 10 == 0, "missing").otherwise("active").alias("state"),
        F.concat(F.lit("file:"), "c_mktsegment").alias("material_uri"), F.concat(F.lit("line:"), number.cast("string")).alias("locator"), F.when(number % 4 == 0, " ").otherwise(F.concat(F.lit("words on "), "c_name")).alias("content"),
    )
    edges = c.select(_key("intent:geo", "c_nationkey").alias("source_id"), F.concat(F.lit("m"), number.cast("string")).alias("target_id"), F.lit("applies_to").alias("relation"), F.lit("durable").alias("owner"))
    return new_state(spark, nodes=intents.unionByName(things, allowMissingColumns=True), edges=edges)


WORLD = """nodes AS (SELECT 'intent:geo.' || n_nationkey AS id, n_name AS label, 'intent' AS kind, 'decision' AS subkind, 'geo.' || n_nationkey AS path, '' AS uri, '' AS locator, 'all about ' || n_name AS content, 'active' AS state FROM nation
UNION ALL SELECT 'm' || c_custkey, c_name, 'material', '', 'file:' || c_mktsegment || '#line:' || c_custkey, 'file:' || c_mktsegment, 'line:' || c_custkey, CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE 'words on ' || c_name END, CASE WHEN c_custkey % 10 = 0 THEN 'missing' ELSE 'active' END FROM customer),
edges AS (SELECT 'intent:geo.' || c_nationkey AS s, 'm' || c_custkey AS t FROM customer)"""


@query(f"WITH {WORLD} SELECT id, path FROM nodes")
def graph_paths(spark, d):
    return graph.context(_world(spark, d)["nodes"]).select("id", "path")


TIERS = ["NATION_1", "geo.3", "file:BUILDING", "file:MACHINERY#line:7", "WORDS ON", "nothing of the kind"]
TIER = """CASE WHEN id = q OR label = q OR path = q THEN 1 WHEN kind = 'material' AND uri = q THEN 2 WHEN uri <> '' AND locator <> '' AND uri || '#' || locator = q THEN 3
WHEN contains(lower(label || ' ' || kind || ' ' || uri || ' ' || locator || ' ' || content), lower(q)) THEN 4 END"""


@query(f"WITH {WORLD}, q AS (SELECT unnest({TIERS!r}) AS q), t AS (SELECT q, id, {TIER} AS tier, row_number() OVER (PARTITION BY q ORDER BY {TIER}, kind <> 'intent', label, id) AS k FROM q, nodes WHERE {TIER} IS NOT NULL) SELECT q AS query, id, tier FROM t WHERE k = 1")
def tiered_find(spark, d):
    nodes, out = graph.context(_world(spark, d)["nodes"]), None
    for q in TIERS:
        one = graph.find(nodes, q).select(F.lit(q).alias("query"), "id", "tier")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {WORLD} SELECT id, CASE WHEN subkind <> '' THEN subkind ELSE kind END AS kind, CASE WHEN uri <> '' THEN uri || '#' || locator ELSE '' END AS source FROM nodes WHERE state = 'active' AND trim(content) <> ''")
def prepare_candidates(spark, d):
    return prepare.candidates(graph.context(_world(spark, d)["nodes"])).select("id", "kind", "source")


@query(f"WITH {WORLD} SELECT kind, count(*) AS n FROM nodes WHERE state = 'active' GROUP BY kind")
def node_kind_counts(spark, d):
    counts = prepare.catalog(_world(spark, d), 0)["kinds"]
    return spark.createDataFrame(list(counts.items()), "kind string, n long")


@query(f"WITH {WORLD} SELECT 'out' AS direction, 'applies_to' AS relation, t AS id FROM edges WHERE s = 'intent:geo.1'")
def explain_node(spark, d):
    """What a session opens: the node's connections; the node itself is a delivery then."""
    state = _world(spark, d)
    found, changes = prepare.explain(state, ["NATION_1"], "agent:1", AT)
    assert [r.key for r in changes["deliveries"].select("key").collect()] == ["intent:geo.1"]
    return found[0]["connections"].select("direction", "relation", "id")


@query(
    f"""WITH {WORLD}, seed AS (SELECT id FROM nodes WHERE contains(lower(id || ' ' || path || ' ' || label || ' ' || kind || ' ' || uri || ' ' || locator || ' ' || content), 'all about nation_2'))
SELECT DISTINCT id FROM (SELECT id FROM seed UNION SELECT t FROM edges JOIN seed ON s = id)"""
)
def graph_scope(spark, d):
    """The subgraph of a scope that the nodes around one or few intents fill."""
    state = _world(spark, d)
    nodes = graph.context(state["nodes"])
    edges = state["edges"].where(F.substring_index("source_id", ".", -1).cast("int") >= 0)
    found = graph.neighborhood(edges, [r.id for r in graph.in_order(graph.seeded(nodes, "all about NATION_2")).select("id").collect()], 1, 1_000_000)
    return spark.createDataFrame([(i,) for i in found], "id string")


@query(f"WITH {WORLD} SELECT s AS source_id, t AS target_id, 'applies_to' AS relation, 'durable' AS owner FROM edges UNION ALL SELECT 'intent:geo.1', 'material:file:new', 'verified_by', 'durable'")
def link_saved(spark, d):
    """A link to material that is not there yet; saved twice it is one."""
    state = _world(spark, d)
    for new in (True, False):
        created, changes = graph.link(state, ("intent", "geo.1"), ("material", "file:new"), "verified_by", "link")
        assert created is new
        state = state | changes
    return state["edges"].select("source_id", "target_id", "relation", "owner")


@query(
    """WITH c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT n_nationkey AS k, 'intent:geo.' || n_nationkey AS id, coalesce(c.n, 0) + 1 AS n FROM nation LEFT JOIN c ON c.k = n_nationkey),
o AS (SELECT id, row_number() OVER w AS place, coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM s WINDOW w AS (ORDER BY k <> 7, length(k::VARCHAR), id))
SELECT place, id, 'bm25' AS signal FROM o WHERE taken < 400 UNION ALL SELECT 1, 'intent:geo.7', 'text'"""
)
def query_context(spark, d):
    """One call for a question: all its matches in order, each with its signals, as far as the neighborhood reaches.

    The nation asked for comes first, then those whose words match, each with its customers, until 400 nodes are visible.
    """
    found = prepare.query(_world(spark, d), "all about NATION_7", 100)
    rows = [(place, i, k) for place, (i, s) in enumerate(found["matches"], 1) for k in s]
    return spark.createDataFrame(rows, "place long, id string, signal string")


@query(
    """WITH n AS (SELECT 'intent:geo.' || n_nationkey AS id, 'geo.' || n_nationkey AS path, n_name FROM nation ORDER BY length(id), id LIMIT 3),
p AS (SELECT row_number() OVER (ORDER BY length(id), id) AS place, id, path, n_name FROM n), l AS (SELECT place, id, '- N' || place || ' `' || path || '` [intent/decision; bm25] ' || n_name AS line FROM p)
SELECT 'retrieve' AS action, place, id, 'bm25' AS match, line, (355 + sum(strlen(line) + 1) OVER ())::BIGINT AS bytes FROM l"""
)
def prepare_message(spark, d):
    """One call for a message: its hints in order, the lines that show them and the bytes of the whole text, with the decision written down and the session known."""
    made, changes = prepare.prepare(_world(spark, d), prepare.Request("all about", "agent:1", budget=512), AT)
    assert changes["decisions"].count() == 1 and changes["sessions"].first().agent == "agent"
    lines = [x for x in made.text.split("\n") if x.startswith("- N")]
    rows = [(made.action, i, n["id"], n["match"], line, len(made.text.encode())) for i, (n, line) in enumerate(zip(made.nodes, lines, strict=True), 1)]
    return spark.createDataFrame(rows, "action string, place long, id string, match string, line string, bytes long")


def _hints(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("n"), "text", F.coalesce("source", F.lit("None")).alias("source"))
    vectors = table(spark, d, "embeddings")
    near = ranking.semantic_top(vectors, vectors.where("vec_id = 0").first().embedding, 8, "vec_id", "embedding").select(F.col("vec_id").alias("n"), "score")
    words = ranking.bm25(docs, ["text"], ASK).select("n", "source", "score")
    path = F.concat_ws(".", "source", "n")
    show = lambda df: df.select(F.col("n").cast("string").alias("id"), path.alias("key"), F.concat(F.lit("document "), F.col("n").cast("string")).alias("label"), F.lit("material").alias("kind"), path.alias("path"), F.lit("observed").alias("owner"), "score", "n")
    order = [F.desc("score"), F.asc("n")]
    semantic = [r.asDict() for r in show(near.join(docs.select("n", "source"), "n")).orderBy(*order).collect()]  # 8 at most
    return semantic, kept(show(words)), order


HINTS = f"""WITH RECURSIVE near AS (SELECT vec_id AS n, {_round(COS)} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, vec_id LIMIT 8),
d AS (SELECT doc_id AS n, split_part(coalesce(source, 'None'), '.', 1) AS b, coalesce(source, 'None') || '.' || doc_id AS path FROM documents),
l AS (SELECT 0 AS lane, n, score, b, path FROM near JOIN d USING (n) UNION ALL SELECT 1, doc_id, score, b, path FROM ({_bm25_sql(sorted({"reading", "signed", "sessions", "thing"}), 1000000000)}) JOIN d ON n = doc_id),
one AS (SELECT 0 AS place, n, b, path, 'semantic' AS match FROM l WHERE lane = 0 ORDER BY score DESC, n LIMIT 1),
two AS (SELECT 1 AS place, n, b, path, 'bm25' AS match FROM l WHERE lane = 1 AND n NOT IN (SELECT n FROM one) ORDER BY score DESC, n LIMIT 1),
first AS (SELECT * FROM one UNION ALL SELECT * FROM two),
alt AS (SELECT 2 AS place, n, b, path, CASE lane WHEN 0 THEN 'semantic' ELSE 'bm25' END || ':alternate-branch' AS match FROM l WHERE n NOT IN (SELECT n FROM first) AND b NOT IN (SELECT b FROM first) ORDER BY lane, score DESC, n LIMIT 1),
fill AS (SELECT 2 AS place, n, b, path, CASE lane WHEN 0 THEN 'semantic' ELSE 'bm25' END AS match FROM l WHERE n NOT IN (SELECT n FROM first) AND NOT EXISTS (SELECT 1 FROM alt) ORDER BY lane, score DESC, n LIMIT 1)
SELECT place::INT AS place, n::VARCHAR AS id, path, match FROM (SELECT * FROM first UNION ALL SELECT * FROM alt UNION ALL SELECT * FROM fill)"""


@query(HINTS)
def hint_map_top3(spark, d):
    semantic, lexical, order = _hints(spark, d)
    nodes, _ = ranking.choose_hints(semantic, lexical, set(), 512, order=order)
    return spark.createDataFrame([(i, n["id"], n["path"], n["match"]) for i, n in enumerate(nodes)], "place int, id string, path string, match string")


# --- updates


@query("SELECT media AS media_type, CASE media WHEN 'text/markdown' THEN 'markdown/v1' WHEN 'text/x-go' THEN 'go/v1' WHEN 'text/x-python' THEN 'source-declarations/v1' WHEN 'text/plain' THEN 'text/v1' WHEN 'application/json' THEN 'text/v1' ELSE 'catalog/v1' END AS processor, count(*) AS n FROM (SELECT CASE p_partkey % 7 WHEN 0 THEN 'text/markdown' WHEN 1 THEN 'text/x-go' WHEN 2 THEN 'text/x-python' WHEN 3 THEN 'text/plain' WHEN 4 THEN 'application/json' ELSE 'application/octet-stream' END AS media FROM part) GROUP BY media")
def processors(spark, d):
    ends = F.array(*map(F.lit, (".md", ".go", ".py", ".txt", ".json", ".bin", "")))
    media = files.media_type(F.concat(F.lit("dir/x"), F.get(ends, F.col("p_partkey") % 7)))
    return table(spark, d, "part").select(media.alias("media_type")).groupBy("media_type").agg(F.count("*").alias("n")).withColumn("processor", update.processor(F.col("media_type")))


@query("SELECT uri, CASE WHEN k < 2 THEN p END AS path FROM (SELECT page_id % 4 AS k, page_id || '/a.md' AS p, CASE page_id % 4 WHEN 0 THEN 'file:' WHEN 1 THEN 'resource:r' || page_id || '/file:' WHEN 2 THEN 'file:../' ELSE 'https://x/' END || page_id || '/a.md' AS uri FROM pages)")
def relative_paths(spark, d):
    n = F.col("page_id")
    head = F.when(n % 4 == 0, F.lit("file:")).when(n % 4 == 1, files.scoped(F.lit("file:"), F.concat(F.lit("r"), n.cast("string")))).when(n % 4 == 2, F.lit("file:../")).otherwise("https://x/")
    uri = F.concat(head, n.cast("string"), F.lit("/a.md"))
    return table(spark, d, "pages").select(uri.alias("uri"), files.relative_path(uri).alias("path"))


@query("SELECT p_partkey, lower(p_name) AS path FROM part")
def normalized_paths(spark, d):
    n = F.col("p_partkey")
    head = F.when(n % 3 == 0, "@repo/").when(n % 3 == 1, " @Root/").otherwise("file:/")
    return table(spark, d, "part").select("p_partkey", prepare.normal_path(F.concat(head, "p_name", F.lit("/ "))).alias("path"))


def _files(spark, d, mark: str, keep: str):
    """Customers as Go files with a function that calls its nation's helper; orders of the first days as notes."""
    c = table(spark, d, "customer").where(keep)
    n = F.col("c_custkey").cast("string")
    text = F.concat(F.lit("package p\n\nfunc run"), n, F.lit("() {\n\thelp"), F.col("c_nationkey").cast("string"), F.lit("()\n\thelp"), F.col("c_nationkey").cast("string"), F.lit("() // other()\n}\n"), F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("// "), F.lit(mark))).otherwise(""))
    lib = table(spark, d, "nation").select(F.concat(F.lit("file:lib"), F.col("n_nationkey").cast("string"), F.lit(".go")).alias("uri"), F.concat(F.lit("package p\n\nfunc (s *Lib) help"), F.col("n_nationkey").cast("string"), F.lit("() {\n}\n")).alias("text"))
    all_ = c.select(F.concat(F.lit("file:c"), n, F.lit(".go")).alias("uri"), text.alias("text")).unionByName(lib)
    ids = all_.withColumn("id", tx.material_id(F.col("uri")))
    observed = ids.select("id", "uri", files.media_type(F.col("uri")).alias("media_type"), F.sha2("text", 256).alias("content_hash"), F.length("text").cast("long").alias("size"), F.lit(0).cast("long").alias("modified_at"))
    return observed, ids.select(F.col("id").alias("material_id"), "text")


def _updated(spark, d):
    state = new_state(spark)
    _, changes = update.update(state, *_files(spark, d, "a", "c_custkey % 5 <> 0"))
    state = state | {k: kept(v) for k, v in changes.items()}
    return update.update(state, *_files(spark, d, "b", "c_custkey % 3 <> 0"))


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN NOT a THEN 'added' WHEN NOT b THEN 'removed' WHEN c_custkey % 7 = 0 THEN 'modified' ELSE 'unchanged' END AS status FROM (SELECT c_custkey, c_custkey % 5 <> 0 AS a, c_custkey % 3 <> 0 AS b FROM customer) WHERE a OR b UNION ALL SELECT 'unchanged' FROM nation) GROUP BY status")
def update_counts(spark, d):
    return spark.createDataFrame(list(_updated(spark, d)[0].items()), "status string, n long").where("n > 0")


@query("SELECT 'run' || c_custkey || '()' AS source, 'Lib.help' || c_nationkey || '()' AS target FROM customer WHERE c_custkey % 3 <> 0")
def update_call_edges(spark, d):
    """Calls between Go functions after an update, old files' facts kept and new ones read, resolved by what follows the point."""
    changes = _updated(spark, d)[1]
    label = lambda name: changes["nodes"].select(F.col("id").alias(f"{name}_id"), F.col("label").alias(name))
    return changes["edges"].where("relation = 'calls'").join(label("source"), "source_id").join(label("target"), "target_id").select("source", "target")


@query(
    """WITH f AS (SELECT CASE WHEN c_custkey % 3 <> 0 THEN 1 ELSE 0 END AS here FROM customer)
SELECT 'material' AS kind, '' AS subkind, (SELECT sum(here) FROM f) + (SELECT count(*) FROM nation) AS n, 0 AS wanted UNION ALL SELECT 'knowledge', 'function', (SELECT sum(here) FROM f) + (SELECT count(*) FROM nation), (SELECT sum(here) FROM f) + (SELECT count(*) FROM nation)"""
)
def update_kinds(spark, d):
    """Kinds of nodes after an update, and how many of them are to have a vector: files are material, what stands in them is knowledge."""
    nodes = _updated(spark, d)[1]["nodes"]
    wanted = embeddings.candidates(nodes).select(F.col("node_id").alias("id"), F.lit(1).alias("wanted"))
    return nodes.join(wanted, "id", "left").groupBy("kind", "subkind").agg(F.count("*").alias("n"), F.count("wanted").alias("wanted"))


@query(
    """SELECT 'c' || c_custkey AS material_id, 'function' AS kind, CASE WHEN c_custkey % 2 = 0 THEN 'Box.' ELSE '' END || 'run' || c_custkey || '()' AS label, 8 AS line,
CASE c_custkey % 3 WHEN 0 THEN 'Get()|f' || c_nationkey || '()|inner()|len()' WHEN 1 THEN 'Get()|after()|g' || c_nationkey || '()|inner()|len()' ELSE 'Get()|g' || c_nationkey || '()|inner()|len()' END AS calls FROM customer
UNION ALL SELECT 'c' || c_custkey, 'type', t, CASE t WHEN 'A' THEN 3 ELSE 4 END, '' FROM customer, (SELECT unnest(['A', 'Box']) AS t)
UNION ALL SELECT 'c' || c_custkey, 'function', 'one()', CASE c_custkey % 3 WHEN 0 THEN 16 ELSE 17 END, 'two()' FROM customer"""
)
def go_facts(spark, d):
    """Customers as Go files with raw strings, comments, grouped types, methods, type arguments, conversions and literals of functions."""
    n, k = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    receiver = F.when(F.col("c_custkey") % 2 == 0, "(b *Box[T]) ").otherwise("")
    call = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("f"), k, F.lit("[int](x)"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("/* gone()\n*/ g"), k, F.lit("(x); after(1)"))).otherwise(F.concat(F.lit("pkg.g"), k, F.lit("[int, string](\n\tx)")))
    text = F.concat(
        F.lit("package p\n\ntype ( A int; B_ = struct{ f func(int) }\n\tBox[T any] struct { T }\n)\n\nvar raw = `\nfunc hidden() { nope() }`; func "), receiver, F.lit("run"), n,
        F.lit("(f func(a int) int) (x []byte, err error) {\n\t// other()\n\tx = []byte(\"call()\"); y := map[string]p.T(x)\n\tgo func() { inner() }()\n\tdefer x.y.Get()\n\tif (len(x)) > '(' { return }\n\ttype I interface { Meth() }; "), call,
        F.lit("\n}\nfunc one() { two(); two() }\n"),
    )
    made = table(spark, d, "customer").select(F.concat(F.lit("c"), n).alias("material_id"), F.lit("text/x-go").alias("media_type"), text.alias("text"))
    return files.declarations(made).where("label <> 'B_'").select("material_id", "kind", "label", "line", F.array_join("calls", "|").alias("calls"))


@query(
    r"""WITH c AS (SELECT conv_id, turn, role, regexp_replace(text, '[#`~

]', ' ', 'g') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE text IS NOT NULL),
t AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS said FROM c)
SELECT 'conv' || conv_id AS material_id, 1 AS level, 'conv ' || conv_id AS label, 2 AS line, 0 AS parent_line, '' AS content FROM t GROUP BY conv_id
UNION ALL SELECT 'conv' || conv_id, 3, 'turn ' || turn || ' ' || role, (10 * i - 7)::INT, 2, concat_ws(chr(10), nullif(said, ''), '# no heading in a fence', '#hashtag', '##') FROM t
UNION ALL SELECT 'conv' || conv_id, 6, 'end', (10 * i + 1)::INT, (10 * i - 7)::INT, '####### seven' FROM t"""
)
def markdown_structure(spark, d):
    """Fences of either kind, indented and deep headings, closing signs, blank lines, and what looks like a heading and is none."""
    c = table(spark, d, "conversations").where("text IS NOT NULL").withColumn("text", F.regexp_replace("text", r"[#`~\n\r]", " "))
    turn = F.concat(F.lit("  ### turn "), F.col("turn").cast("string"), F.lit(" "), "role", F.lit(" ##\n\n  "), "text", F.lit("\n~~~\n  # no heading in a fence\n```\n#hashtag\n## \n###### end #\n####### seven"))
    made = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))), lambda x: x["t"]), "\n").alias("body"))
    docs = made.select(F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("material_id"), F.concat(F.lit("\n# conv "), F.col("conv_id").cast("string"), F.lit("\n"), "body").alias("text"))
    return files.sections(docs)


@query(
    r"""WITH l AS (SELECT conv_id, turn, role, text, row_number() OVER (ORDER BY conv_id, turn, role, text) AS i FROM conversations WHERE text IS NOT NULL),
m AS (SELECT 2 * i - 1 AS line, role, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM l WHERE role IN ('user', 'assistant') AND regexp_replace(text, '^\s+|\s+$', '', 'g') <> '')
SELECT line, row_number() OVER (ORDER BY line) AS seq, CASE role WHEN 'user' THEN 'U' ELSE 'A' END || lpad((row_number() OVER (ORDER BY line))::VARCHAR, 6, '0') AS id, role, text FROM m"""
)
def transcript_file(spark, d):
    """All turns as one file of JSON records, a blank line behind each, read by splits and numbered over all of it."""
    at = f"{folder(spark)}/transcript-{spark.range(1).select(F.expr('uuid()')).first()[0]}"
    record = F.concat(F.to_json(F.struct("role", F.col("text").alias("content"))), F.lit("\n"))
    table(spark, d, "conversations").where("text IS NOT NULL").repartitionByRange(1, "conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text").select(record.alias("value")).write.text(at)
    return transcripts.read_transcript(spark, at)


@query(_bm25_sql(sorted({"reading", "signed", "sessions", "thing"}), 20))
def bm25_indexed(spark, d):
    """Full-text search by postings: an index of an earlier state of the documents, brought up to date, answers as a scan does."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    before = docs.where("doc_id % 7 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" signed earlier"))).otherwise(F.col("text"))).unionByName(spark.createDataFrame([(-1, "signed sessions, gone since")], docs.schema))
    index = postings.Index(spark, f"{folder(spark)}/index-{spark.range(1).select(F.expr('uuid()')).first()[0]}", 64)
    index.update(before, "doc_id", ["text"])
    index.update(docs, "doc_id", ["text"])
    return index.search(ASK).select(F.col("id").cast("long").alias("doc_id"), "score").orderBy(F.desc("score"), "doc_id").limit(20)


PUBLISH = """WITH old AS (SELECT 'c:' || c_custkey AS id FROM customer), durable AS (SELECT DISTINCT 'o:' || o_orderkey AS s, 'c:' || o_custkey AS t FROM orders WHERE o_orderkey % 4 = 0),
fresh AS (SELECT id FROM old WHERE CAST(substr(id, 3) AS BIGINT) % 3 <> 0), new AS (SELECT DISTINCT 'o:' || o_orderkey AS s, 'c:' || o_custkey AS t FROM orders WHERE o_orderkey % 6 = 0),
now AS (SELECT id, 'observed' AS owner, 'active' AS state FROM fresh UNION ALL SELECT 'o:' || o_orderkey, 'durable', 'active' FROM orders UNION ALL SELECT id, 'durable', 'missing' FROM old WHERE id IN (SELECT t FROM durable) AND id NOT IN (SELECT id FROM fresh))"""


def _published(spark, d) -> dict:
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    person, order = F.concat(F.lit("c:"), F.col("c_custkey").cast("string")), F.concat(F.lit("o:"), F.col("o_orderkey").cast("string"))
    node = lambda df, key, label, owner: df.select(key.alias("id"), F.col(label).alias("label"), F.lit(owner).alias("owner"), F.lit("active").alias("state"), F.lit("material").alias("kind"), key.alias("ref"))
    links = lambda by, owner: o.where(f"o_orderkey % {by} = 0").select(order.alias("source_id"), F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("target_id"), F.lit("applies_to").alias("relation"), F.lit(owner).alias("owner")).distinct()
    state = new_state(spark, nodes=node(c, person, "c_name", "observed").unionByName(node(o, order, "o_orderpriority", "durable")), edges=links(4, "durable"))
    fresh = node(c.where("c_custkey % 3 <> 0"), person, "c_name", "observed").select("id", "label", "kind", F.lit("").alias("subkind"), "ref", F.lit("file:x").alias("material_uri"), F.lit("m").alias("material_id"), F.lit("").alias("locator"), F.lit("").alias("content"))
    return update.publish(state, state["materials"], fresh, state["claims"], links(6, "observed"))


@query(f"{PUBLISH} SELECT id, owner, state FROM now")
def publish_snapshot(spark, d):
    return _published(spark, d)["nodes"].select("id", "owner", "state")


@query(f"{PUBLISH} SELECT s AS source_id, t AS target_id, 'durable' AS owner FROM durable UNION ALL SELECT s, t, 'observed' FROM new WHERE t IN (SELECT id FROM now) AND NOT EXISTS (SELECT 1 FROM durable d WHERE d.s = new.s AND d.t = new.t)")
def publish_edges(spark, d):
    return _published(spark, d)["edges"].select("source_id", "target_id", "owner")


# --- transcripts and the queue


def _records():
    """Turns as JSON records in eight shapes, by turn and conversation."""
    text, role = F.col("text"), F.col("role")
    j = lambda **kw: F.to_json(F.struct(*[v.alias(k) for k, v in kw.items()]))
    part = lambda kind: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    shapes = [
        j(role=role, content=text), j(message=F.struct(role.alias("role"), text.alias("content"))), j(payload=F.struct(role.alias("role"), text.alias("text"))),
        j(payload=F.struct(F.struct(role.alias("role"), F.array(part("text"), part("tool_result")).alias("content")).alias("message"))),
        j(type=F.concat(role, F.lit("_message")), content=F.array(text)), j(role=F.lit("tool"), message=F.struct(role.alias("role"), F.concat(F.lit("[TODO] {"), text).alias("content"))),
        j(role=role, content=F.array(part("image"))), j(role=role, content=F.lit("outer"), message=F.struct(text.alias("text"))),
    ]
    n = (F.col("turn") + F.col("conv_id")) % len(shapes)
    out = F.when(F.lit(False), F.lit(""))
    for i, shape in enumerate(shapes):
        out = out.when(n == i, shape)
    return out


TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(
    f"""WITH r AS (SELECT conv_id, turn, role, {TRIM.format("text")} AS t, (turn + conv_id) % 8 AS k FROM conversations WHERE text IS NOT NULL AND role IN ('user', 'assistant')),
s AS (SELECT conv_id, turn, role, CASE WHEN k = 6 THEN '' WHEN k = 5 THEN {TRIM.format("('[TODO] {' || (SELECT c.text FROM conversations c WHERE c.conv_id = r.conv_id AND c.turn = r.turn))")} WHEN k = 7 AND t = '' THEN 'outer' ELSE t END AS text FROM r)
SELECT conv_id, turn, role, text FROM s WHERE text <> ''"""
)
def transcript_records(spark, d):
    rows = table(spark, d, "conversations").where("text IS NOT NULL").select("conv_id", "turn", _records().alias("record"))
    said = rows.select("conv_id", "turn", transcripts.message_role(F.col("record")).alias("role"), transcripts.message_text(F.col("record")).alias("text"))
    return said.where("role IS NOT NULL AND text IS NOT NULL")


@query(f"WITH {TURNS} SELECT conv_id, sum(length(text))::BIGINT AS characters FROM m GROUP BY conv_id")
def transcript_chunks(spark, d):
    """Chunks of about 2,000 bytes keep every character of every message, in its transcript."""
    made = transcripts.chunks(transcripts.numbered_messages(table(spark, d, "conversations"), "conv_id", "turn"), "conv_id", 2000)
    plain = F.length(F.regexp_replace(F.regexp_replace("text", r"\n\n(?=\[[UA]\d{6}\]\n)", ""), r"\[[UA]\d{6}\]\n", ""))
    return made.groupBy("conv_id").agg(F.sum(plain).alias("characters"))


@query(f"WITH {TURNS} SELECT left(text, 1) AS key, min(conv_id * 1000 + seq) AS first_seq, count(*) AS n, string_agg(role, '|' ORDER BY conv_id * 1000 + seq, role) AS values FROM m GROUP BY 1")
def candidate_groups(spark, d):
    m = transcripts.numbered_messages(table(spark, d, "conversations"), "conv_id", "turn")
    found = transcripts.candidate_groups(m.select(F.left("text", F.lit(1)).alias("key"), (F.col("conv_id") * 1000 + F.col("seq")).alias("seq"), "role"), "key", "seq", "role")
    return found.withColumn("values", F.array_join("values", "|"))


@query("SELECT user_id AS key, string_agg(event_type, '' ORDER BY event_id) AS value FROM events GROUP BY user_id HAVING NOT contains(string_agg(event_type, '' ORDER BY event_id), 'clickerror')")
def pairwise_reduce(spark, d):
    """Values joined pair by pair; a merge that gives nothing, here for a click before an error, drops its key."""
    groups = transcripts.candidate_groups(table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "event_type"), "key", "seq", "event_type")
    return transcripts.reduced(groups.select("key", "values"), "key", lambda a, b: None if a.endswith("click") and b.startswith("error") else a + b)


@query(
    """WITH k AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), g AS (SELECT user_id AS key, count(*) AS n, string_agg(event_type, '' ORDER BY event_id) AS value,
string_agg('E' || event_id, ' ' ORDER BY event_id) AS evidence, string_agg('S' || event_id, ' ' ORDER BY event_id) AS sources, (SELECT string_agg(DISTINCT x.event_type, ' ' ORDER BY x.event_type) FROM events x WHERE x.user_id = k.user_id) AS links FROM k GROUP BY user_id)
SELECT key, value, evidence, sources, links FROM g WHERE n = 1 OR key % 5 <> 0"""
)
def consolidated_candidates(spark, d):
    """Proposals of each user joined round by round with what they rest on; every fifth user's model invents evidence, which drops the key."""
    e = table(spark, d, "events")
    name = lambda letter: F.array(F.concat(F.lit(letter), F.col("event_id").cast("string")))
    links = F.array(F.struct(F.lit("applies_to").alias("relation"), F.col("event_type").alias("ref")))
    rows = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("place"), F.when(F.col("user_id") % 5 == 0, F.concat(F.lit("!"), "event_type")).otherwise(F.col("event_type")).alias("value"), name("E").alias("evidence"), links.alias("links"), name("S").alias("sources"))

    def merge(pairs):
        made = lambda a, b: transcripts.Candidate(a.value + b.value, (*a.evidence, *b.evidence, *(("E0",) if a.value.startswith("!") else ())), (*a.links, *b.links), ("left", "right"))
        return [made(a, b) for a, b in pairs]

    found = transcripts.consolidated_all(rows, "key", merge)
    numbers = lambda c: F.array_join(F.transform(F.array_sort(F.transform(c, lambda x: F.substr(x, F.lit(2)).cast("long"))), lambda n: F.concat(F.left(F.col(c)[0], F.lit(1)), n.cast("string"))), " ")
    listed = F.array_join(F.array_sort(F.array_distinct(F.transform("links", lambda x: x["ref"]))), " ")
    return found.select("key", F.regexp_replace("value", "^!", "").alias("value"), numbers("evidence").alias("evidence"), numbers("sources").alias("sources"), listed.alias("links"))


@query("SELECT 's' || user_id AS key, event_id::VARCHAR AS id, event_type AS phase, CASE WHEN event_type = 'purchase' THEN 'completed' ELSE 'pending' END AS kind FROM events ORDER BY event_id DESC LIMIT 100")
def reconcile_runs(spark, d):
    """Pending and completed runs together, newest first."""
    j = table(spark, d, "events").select(F.col("event_id").alias("n"), F.col("event_id").cast("string").alias("id"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("key"), F.col("event_type").alias("phase"))
    return jobs.newest_runs(j.where("phase <> 'purchase'"), j.where("phase = 'purchase'"), 100, "n").select("key", "id", "phase", "kind")
