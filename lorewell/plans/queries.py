"""The engine's operators applied to the tables of a folder, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import folder
from ..functions import text as tx
from ..operators import graph, ranking, records, transcripts
from ..sources import files
from ..streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
ASK = "the reading of signed sessions thing"
STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
TOKENS = f"list_filter(list_transform(regexp_extract_all(coalesce({{}}, ''), '[A-Za-z0-9_-]+|[가-힣]{{{{2,}}}}'), lambda t: lower(t)), lambda t: len(t) >= 2 AND t NOT IN ({STOP}))"


def tokens_sql(column: str) -> str:
    return TOKENS.replace("{{2,}}", "{2,}").replace("{}", column)


def query(sql: str | None = None):
    def of(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _round(x: str) -> str:
    return f"(sign({x}) * floor(abs({x}) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE)"


def _bm25_sql(terms: list[str], limit: int) -> str:
    counts = ", ".join(f"len(list_filter(k, lambda t: t = '{w}')) AS t{i}" for i, w in enumerate(terms))
    stats = ", ".join(f"count(*) FILTER (WHERE t{i} > 0)::DOUBLE AS d{i}" for i in range(len(terms)))
    parts = " + ".join(
        f"CASE WHEN t{i} > 0 THEN ln(1 + (n - d{i} + 0.5::DOUBLE) / (d{i} + 0.5::DOUBLE)) * (t{i}::DOUBLE * 2.2::DOUBLE) / (t{i}::DOUBLE + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / a)) ELSE 0.0::DOUBLE END" for i in range(len(terms))
    )
    return f"""WITH k AS (SELECT doc_id, {tokens_sql("text")} AS k FROM documents), c AS (SELECT doc_id, len(k)::DOUBLE AS dl, {counts} FROM k),
s AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS a, {stats} FROM c), r AS (SELECT doc_id, 0.0::DOUBLE + {parts} AS x FROM c, s)
SELECT doc_id, {_round("x")} AS score FROM r WHERE {_round("x")} > 0 ORDER BY score DESC, doc_id LIMIT {limit}"""


@query(_bm25_sql(sorted({"reading", "signed", "sessions", "thing"}), 20))
def bm25_documents(spark, d):
    return ranking.bm25(table(spark, d, "documents").select("doc_id", "text"), ["text"], ASK).orderBy(F.desc("score"), "doc_id").limit(20).select("doc_id", "score")


@query(f"SELECT token, count(*) AS n_docs, sum(n)::BIGINT AS n FROM (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS token FROM documents) GROUP BY ALL) GROUP BY token")
def lexical_token_counts(spark, d):
    """A token is marked where it stands first in its document, so tokens are shuffled once, summed before."""
    k = F.array(F.array_sort(tx.lexical_tokens(F.col("text"))))
    marked = F.transform(k, lambda k: F.transform(k, lambda t, i: F.struct(t.alias("token"), F.when((i > 0) & (F.get(k, i - 1) == t), 0).otherwise(1).alias("first"))))[0]
    tokens = table(spark, d, "documents").select(F.explode(marked).alias("x")).select("x.*")
    return tokens.groupBy("token").agg(F.sum("first").alias("n_docs"), F.count("*").alias("n"))


COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@query(f"SELECT e.vec_id, {_round(COS)} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, e.vec_id LIMIT 8")
def semantic_topk(spark, d):
    vectors = table(spark, d, "embeddings")
    ask = vectors.where("vec_id = 0").first()
    return ranking.semantic_top(vectors, ask.embedding, 8, "vec_id", "embedding").select("vec_id", "score")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'brand#1')")
def text_seeds(spark, d):
    return ranking.text_seeds(table(spark, d, "part"), ["p_name", "p_brand", "p_type"], "Brand#1").select("p_partkey", "p_name")


def _lanes(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    vectors = table(spark, d, "embeddings")
    near = ranking.semantic_top(vectors, vectors.where("vec_id = 0").first().embedding, 8, "vec_id", "embedding").select(F.col("vec_id").alias("id"), "score")
    words = ranking.bm25(docs, ["text"], ASK).select("id", "score", "source")
    text = ranking.text_seeds(docs, ["text"], "thing").select("id", F.lit(0.0).alias("score"))
    return text, near, words


HYBRID = f"""WITH l AS (SELECT doc_id AS id, 0 AS lane, 'text' AS signal, 0.0::DOUBLE AS o FROM documents WHERE contains(lower(text), 'thing')
UNION ALL SELECT vec_id, 1, 'semantic', -score FROM (SELECT e.vec_id, {_round(COS)} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, e.vec_id LIMIT 8)
UNION ALL SELECT doc_id, 2, 'bm25', -score FROM ({_bm25_sql(sorted({"reading", "signed", "sessions", "thing"}), 1000000000)}))
SELECT id, string_agg(signal, ',' ORDER BY lane) AS signals, min(lane)::INT AS lane FROM l GROUP BY id ORDER BY min(lane), arg_min(o, lane), id LIMIT 20"""


@query(HYBRID)
def hybrid_query(spark, d):
    text, near, words = _lanes(spark, d)
    return ranking.fuse([("text", text), ("semantic", near), ("bm25", words)], "id", [-F.col("score")], 20)


def _graph(spark, d) -> tuple[DataFrame, DataFrame]:
    """Regions, nations and customers as nodes with dotted paths; each is linked to what it lies in, regions to a world
    that is no node itself."""
    r, n, c = (table(spark, d, t) for t in ("region", "nation", "customer"))
    key = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    places = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    people = c.join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    nodes = (
        r.select(key("r:", "r_regionkey").alias("id"), F.col("r_name").alias("label"), F.col("r_name").alias("path"))
        .unionByName(places.select(key("n:", "n_nationkey").alias("id"), F.col("n_name").alias("label"), F.concat_ws(".", "r_name", "n_name").alias("path")))
        .unionByName(people.select(key("c:", "c_custkey").alias("id"), F.col("c_name").alias("label"), F.concat_ws(".", "r_name", "n_name", "c_name").alias("path")))
    )
    lies = lambda df, a, b: df.select(a.alias("source_id"), b.alias("target_id"), F.lit("in").alias("relation"))
    return nodes, lies(n, key("n:", "n_nationkey"), key("r:", "n_regionkey")).unionByName(lies(c, key("c:", "c_custkey"), key("n:", "c_nationkey"))).unionByName(lies(r, key("r:", "r_regionkey"), F.lit("w:0")))


GRAPH = """e AS (SELECT 'n:' || n_nationkey AS s, 'r:' || n_regionkey AS t FROM nation UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey FROM customer UNION ALL SELECT 'r:' || r_regionkey, 'w:0' FROM region),
w AS (SELECT s AS a, t AS b, s, t FROM e UNION ALL SELECT t, s, s, t FROM e),
nodes AS (SELECT 'r:' || r_regionkey AS id, r_name AS label, r_name AS path FROM region
  UNION ALL SELECT 'n:' || n_nationkey, n_name, r_name || '.' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'c:' || c_custkey, c_name, r_name || '.' || n_name || '.' || c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query(f"WITH RECURSIVE {GRAPH}, h AS (SELECT 'c:1' AS id, 0 AS hops UNION SELECT b, hops + 1 FROM h JOIN w ON a = id WHERE hops < 3) SELECT id, min(hops)::INT AS hops FROM h GROUP BY id")
def neighborhood_hops(spark, d):
    edges = _graph(spark, d)[1]
    return graph.hop_distances(edges, spark.createDataFrame([("c:1",)], "id string"), 3)


LIMITED = f"""WITH {GRAPH}, seed AS (SELECT * FROM (VALUES ('n:3', 0), ('n:1', 1)) v(id, p)),
one AS (SELECT id, p, 0 AS q, '' AS s, '' AS t FROM seed UNION ALL SELECT b, p, 1, w.s, w.t FROM seed JOIN w ON a = id),
f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p, q, s, t) AS k FROM one),
r1 AS (SELECT id, row_number() OVER (ORDER BY p, q, s, t) - 1 AS pos FROM f WHERE k = 1),
r1l AS (SELECT * FROM r1 WHERE pos < 150),
two AS (SELECT b AS id, pos AS p, w.s, w.t FROM r1l JOIN w ON a = id WHERE b NOT IN (SELECT id FROM r1l)),
f2 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p, s, t) AS k FROM two),
r2 AS (SELECT id, (SELECT count(*) FROM r1l) + row_number() OVER (ORDER BY p, s, t) - 1 AS pos FROM f2 WHERE k = 1)
SELECT pos::INT AS pos, id FROM (SELECT id, pos FROM r1l UNION ALL SELECT id, pos FROM r2) WHERE pos < 150"""


@query(LIMITED)
def neighborhood_limited(spark, d):
    chosen = graph.neighborhood(_graph(spark, d)[1], ["n:3", "n:1"], 2, 150)
    return spark.createDataFrame(list(enumerate(chosen)), "pos int, id string")


PATH = f"""WITH RECURSIVE {GRAPH}, p AS (SELECT 'c:1' AS id, []::STRUCT(source_id VARCHAR, target_id VARCHAR, relation VARCHAR)[] AS path, ['c:1'] AS met
UNION ALL SELECT b, list_append(path, {{'source_id': w.s, 'target_id': w.t, 'relation': 'in'}}), list_append(met, b) FROM p JOIN w ON a = id WHERE len(path) < 7 AND NOT list_contains(met, b)),
g AS (SELECT path FROM p WHERE id = 'c:2' ORDER BY len(path), path LIMIT 1), u AS (SELECT unnest(path) AS e, generate_subscripts(path, 1) - 1 AS step FROM g)
SELECT step::INT AS step, e.source_id AS source_id, e.target_id AS target_id, e.relation AS relation FROM u"""


@query(PATH)
def shortest_path(spark, d):
    return graph.shortest_path(_graph(spark, d)[1], "c:1", "c:2")


@query(f"WITH {GRAPH} SELECT 'out' AS direction, 'in' AS relation, id, label FROM e JOIN nodes ON id = t WHERE s = 'n:1' UNION ALL SELECT 'in', 'in', id, label FROM e JOIN nodes ON id = s WHERE t = 'n:1'")
def explain_connections(spark, d):
    return graph.connections(*_graph(spark, d), "n:1")


@query(f"WITH {GRAPH}, a AS (SELECT min(label) AS r FROM nodes WHERE id LIKE 'r:%') SELECT DISTINCT CASE WHEN path = r THEN path ELSE r || '.' || split_part(path, '.', 2) END AS branch FROM nodes, a WHERE path = r OR starts_with(path, r || '.') ORDER BY branch LIMIT 100")
def topic_branches(spark, d):
    first = table(spark, d, "region").agg(F.min("r_name")).first()[0]
    return graph.branches(_graph(spark, d)[0].select("path"), first, 100)


@query(
    f"""WITH {GRAPH}, c AS (SELECT path, split_part(path, '.', 1) AS r FROM nodes WHERE id LIKE 'c:%'), o AS (SELECT split_part(path, '.', 1) AS r, min(path) AS target FROM nodes WHERE id LIKE 'c:%' GROUP BY 1),
j AS (SELECT path AS source, target, string_split(path, '.') AS a, string_split(target, '.') AS b FROM c JOIN o USING (r)), k AS (SELECT *, CASE WHEN source = target THEN 3 WHEN a[2] = b[2] THEN 2 ELSE 1 END AS n FROM j)
SELECT source, target, array_to_string(list_concat(list_transform(range(len(a), n - 1, -1), lambda i: array_to_string(a[1:i], '.')), list_transform(range(n + 1, len(b) + 1), lambda i: array_to_string(b[1:i], '.'))), ' > ') AS bridge FROM k"""
)
def topic_bridge(spark, d):
    paths = _graph(spark, d)[0].where(F.startswith("id", F.lit("c:"))).select("path", F.substring_index("path", ".", 1).alias("r"))
    pairs = paths.join(paths.groupBy("r").agg(F.min("path").alias("target")), "r").select(F.col("path").alias("source"), "target")
    return graph.topic_bridge(pairs).withColumn("bridge", F.array_join("bridge", " > "))


def _snapshots(spark, d):
    before = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), "lang").where("doc_id % 11 <> 0")
    now = table(spark, d, "documents").where("doc_id % 7 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256)).alias("content_hash"), "lang")
    return before, now


SNAP = "b AS (SELECT doc_id, sha256(text) AS h, lang FROM documents WHERE doc_id % 11 <> 0), n AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS h, lang FROM documents WHERE doc_id % 7 <> 0)"


@query(f"WITH {SNAP} SELECT doc_id, CASE WHEN b.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' WHEN b.h = n.h THEN 'unchanged' ELSE 'modified' END AS status FROM b FULL JOIN n USING (doc_id)")
def material_diff(spark, d):
    return records.snapshot_diff(*_snapshots(spark, d), "doc_id", ["content_hash", "lang"])


@query(f"WITH {SNAP} SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM b JOIN n USING (doc_id) WHERE b.h = n.h)")
def fact_reuse(spark, d):
    return records.reusable(table(spark, d, "documents").select("doc_id", "source"), *_snapshots(spark, d), "doc_id", ["content_hash", "lang"])


CLAIMS = """WITH nodes AS (SELECT 'n:' || n_nationkey AS id, 'geo.' || n_name AS label FROM nation UNION ALL SELECT 'p:' || p_partkey, p_name FROM part),
l AS (SELECT label, count(DISTINCT id) AS n, min(id) AS one FROM nodes GROUP BY label), x AS (SELECT split_part(label, '.', -1) AS label, count(DISTINCT id) AS n, min(id) AS one FROM nodes WHERE contains(label, '.') GROUP BY 1),
c AS (SELECT 'p:' || p_partkey AS s, p_name AS target FROM part UNION ALL SELECT 'p:' || p_partkey, 'NATION_' || (p_partkey % 30) FROM part)
SELECT DISTINCT s AS source_id, coalesce(CASE WHEN l.n = 1 THEN l.one WHEN l.n IS NULL AND x.n = 1 THEN x.one END) AS target_id, 'calls' AS relation FROM c LEFT JOIN l ON l.label = target LEFT JOIN x ON x.label = target
WHERE coalesce(CASE WHEN l.n = 1 THEN l.one WHEN l.n IS NULL AND x.n = 1 THEN x.one END) <> s"""


@query(CLAIMS)
def resolve_claims(spark, d):
    n, p = table(spark, d, "nation"), table(spark, d, "part")
    own = F.concat(F.lit("p:"), F.col("p_partkey").cast("string"))
    nodes = n.select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("geo."), "n_name").alias("label")).unionByName(p.select(own.alias("id"), F.col("p_name").alias("label")))
    claim = lambda target: p.select(own.alias("source_id"), F.lit("").alias("target_id"), target.alias("target"), F.lit("calls").alias("relation"))
    claims = claim(F.col("p_name")).unionByName(claim(F.concat(F.lit("NATION_"), (F.col("p_partkey") % 30).cast("string"))))
    return graph.resolve_claims(nodes, claims)


def _log(spark, d):
    e = table(spark, d, "events")
    return e.select(F.concat(F.lit("user."), F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("seq"), tx.memory_hash(F.lit("note"), F.col("event_type"), F.lit("")).alias("hash"), F.col("event_type").alias("value"))


LOG = "g AS (SELECT 'user.' || user_id AS key, event_id AS seq, sha256('note' || chr(0) || coalesce(event_type, '') || chr(0)) AS hash, event_type AS value FROM events)"


@query(f"WITH {LOG}, p AS (SELECT *, lag(hash) OVER (PARTITION BY key ORDER BY seq) AS b FROM g) SELECT key, seq, hash, CASE WHEN b IS NULL THEN 'created' ELSE 'updated' END AS action FROM p WHERE b IS NULL OR b <> hash")
def memory_versions(spark, d):
    return records.versions(_log(spark, d)).where("action <> 'unchanged'").select("key", "seq", "hash", "action")


@query(f"WITH {LOG} SELECT key, max(seq) AS seq, arg_max(value, seq) AS value FROM g GROUP BY key")
def memory_current(spark, d):
    return records.latest(_log(spark, d), ["key"], F.col("seq")).select("key", "seq", "value")



@query("SELECT split_part(c_mktsegment || '.' || c_name, '.', 1) AS name, count(*) AS count FROM customer GROUP BY 1 ORDER BY count DESC, name LIMIT 32")
def catalog_namespaces(spark, d):
    keys = table(spark, d, "customer").select(F.concat_ws(".", "c_mktsegment", "c_name").alias("key"))
    return records.namespace_counts(keys, "key")


@query("SELECT user_id, event_type, sha256(coalesce(props, '')) AS value_hash, max(event_id) AS delivered FROM events GROUP BY ALL")
def delivery_upsert(spark, d):
    """Deliveries by session, key and hash, the last of each, in two rounds of an upsert."""
    e = table(spark, d, "events").select("user_id", "event_type", F.sha2(F.coalesce("props", F.lit("")), 256).alias("value_hash"), F.col("event_id").alias("delivered"))
    keys = ["user_id", "event_type", "value_hash"]
    half = lambda n: records.latest(e.where(F.col("delivered") % 2 == n).withColumn("s", F.col("delivered")), keys, F.col("s")).drop("s")
    both = half(0).unionByName(half(1))
    return records.upsert(half(0), records.latest(both.withColumn("s", F.col("delivered")), keys, F.col("s")).drop("s"), keys)


TURNS = r"m AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq FROM conversations WHERE role IN ('user', 'assistant') AND trim(text, E' \t\n\r\f\v') <> '')"


@query(f"WITH {TURNS} SELECT conv_id, turn, CASE role WHEN 'user' THEN 'U' ELSE 'A' END || lpad(seq::VARCHAR, 6, '0') AS id FROM m")
def transcript_messages(spark, d):
    return transcripts.numbered_messages(table(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", "id")


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON b.text <> '' AND contains(d.text, b.text)")
def mentioned_refs(spark, d):
    needles = table(spark, d, "benchmark").select("item_id", F.col("text").alias("needle"))
    return records.mentioned(table(spark, d, "documents").select("doc_id", "text"), needles, "text", "needle").select("doc_id", "item_id").distinct()


@query(
    r"""WITH c AS (SELECT conv_id, turn, role, regexp_replace(text, '[#`~\n\r]', ' ', 'g') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE text IS NOT NULL)
SELECT 'conv' || conv_id AS material_id, 1 AS level, 'conv ' || conv_id AS label, 1 AS line, 0 AS parent_line, '' AS content FROM c GROUP BY conv_id
UNION ALL SELECT 'conv' || conv_id, 2, 'turn ' || turn || ' ' || role, (2 * i)::INT, 1, trim(text, E' \t\f\v') FROM c"""
)
def markdown_sections(spark, d):
    c = table(spark, d, "conversations").where("text IS NOT NULL").withColumn("text", F.regexp_replace("text", r"[#`~\n\r]", " "))
    turn = F.concat(F.lit("## turn "), F.col("turn").cast("string"), F.lit(" "), "role", F.lit("\n"), "text")
    made = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))), lambda x: x["t"]), "\n").alias("body"))
    docs = made.select(F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("material_id"), F.concat(F.lit("# conv "), F.col("conv_id").cast("string"), F.lit("\n"), "body").alias("text"))
    return files.sections(docs)


@query("SELECT 'p' || p_partkey AS material_id, 'function' AS kind, 'f' || (p_partkey % 7) || '()' AS label, 2 AS line FROM part UNION ALL SELECT 'p' || p_partkey, 'type', 'T' || p_size, 4 FROM part")
def source_declarations(spark, d):
    code = F.concat(F.lit("import x\ndef f"), (F.col("p_partkey") % 7).cast("string"), F.lit("(a):\n    return a\nclass T"), F.col("p_size").cast("string"), F.lit(":\n    pass\n"))
    made = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("material_id"), F.lit("text/x-python").alias("media_type"), code.alias("text"))
    return files.declarations(made).select("material_id", "kind", "label", "line")


def _jobs(spark, d):
    return table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("key"), F.col("event_type").alias("phase"), F.col("event_id").alias("seq"))


@query("SELECT 's' || user_id AS key, max(event_id)::VARCHAR AS id, arg_max(event_type, event_id) AS phase, max(event_id) AS seq FROM events GROUP BY user_id")
def session_stream(spark, d):
    """The jobs drained through a stream from files; the last phase of each session."""
    at = f"{folder(spark)}/session-stream-{spark.range(1).select(F.expr('uuid()')).first()[0]}"
    _jobs(spark, d).write.parquet(f"{at}/in")
    jobs.drain(spark, f"{at}/in", f"{at}/state", f"{at}/progress")
    return jobs.current(spark, f"{at}/state").select("key", "id", "phase", "seq")
