"""Spelling variants by errata tries: pairs of words one edit apart, and the common word that each rare one stands for.

The words form a trie whose nodes are prefixes. At each node the child with most words is heavy, all others (and the
end of a word) are light, so a word leaves heavy paths at most log2 of all words times. Only there it is merged into
what lies beside it, the small into the large: with its character replaced by the heavy one, with the heavy one put in
before it, with its character skipped; and light children meet each other with their character left open. Two words
that are one edit apart part at one node, where at least one of them is light, so each pair coincides in one of these
terminals. The trie is a table of nodes, and terminals coincide by joins on whole words: nothing is gathered that grows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, table

#: Letters of a run, and how many a word has at least; a word's occurrences; how much commoner its form is.
LETTERS, LEAST_LENGTH, LEAST_COUNT, COMMONER = r"A-Za-z\x{C0}-\x{FF}", 6, 5, 5
#: One run in so many loses a character.
SLIPS = 199
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A node with more than this share of all steps is broadcast, so there are fewer than as many of them as this.
HOT_NODES = 10_000
#: Characters of words that a task turns into nodes at a time.
SLICE = 1 << 20


def words(docs: DataFrame) -> DataFrame:
    """(word, n): the lower-cased runs of letters of all texts, slips made, that are long and frequent enough.

    A null text has none; a null doc_id counts as empty.
    """
    run = F.explode(F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), F.lit(rf"[{LETTERS}]{{{LEAST_LENGTH},}}"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    slipped = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(F.col("h") % SLIPS == 0, slipped).otherwise(F.col("run")).alias("word")
    return runs.select(word).where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word and each of its prefixes: the word's id, the prefix's length and hash, and the character behind it (0: the end)."""
    for batch in batches:
        ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size + len(texts[last]) < SLICE):
                size += len(texts[last]) + 1
                last += 1
            part = texts[first:last]
            lengths = np.array([len(x) + 1 for x in part])
            chars = np.frombuffer("\0".join([*part, ""]).encode("utf-32-le"), np.uint32).astype(np.uint64)
            starts = np.cumsum(lengths) - lengths
            at = np.arange(len(chars)) - np.repeat(starts, lengths)
            powers = np.cumprod(np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64))
            sums = np.cumsum(chars * powers[at]) - chars * powers[at]
            node = (sums - np.repeat(sums[starts], lengths)) * np.uint64(0xBF58476D1CE4E5B9) + at.astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[first:last], lengths)), pa.array(at.astype(np.int32)), pa.array(node.astype(np.int64)), pa.array(chars.astype(np.int32))], ["id", "at", "node", "next"])
            first = last


def light_steps(vocabulary: DataFrame) -> DataFrame:
    """(word, n, at, next, heavy) for each place at where a word of vocabulary (word, n) leaves a heavy path.

    Nodes and words are known by 64-bit hashes here. Two that share one are merged, which only adds steps: what is
    found at a step is always compared as whole words.
    """
    named = vocabulary.withColumn("id", F.xxhash64("word"))
    steps = named.select("id", "word").mapInArrow(_steps, "id long, at int, node long, next int")
    children = keep(steps.groupBy("node", "next").agg(F.count("*").alias("held")))
    nodes = children.groupBy("node").agg(F.count("*").alias("children"), F.sum("held").alias("held"), F.max_by("next", F.struct("held", "next")).alias("heavy")).where("children > 1")
    nodes = keep(nodes.select("node", "held", "heavy"))
    total = children.agg(F.sum("held")).first()[0] or 0
    hot = F.broadcast(nodes.where(F.col("held") > total / HOT_NODES))
    light = lambda at: at.where("next <> heavy").select("id", "at", "next", "heavy")
    found = light(steps.join(hot, "node")).unionByName(light(steps.join(hot.select("node"), "node", "left_anti").join(nodes.where(F.col("held") <= total / HOT_NODES), "node")))
    return found.join(named, "id").select("word", "n", "at", "next", "heavy")


def near(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, best): how many words of vocabulary (word, n) are one edit from each, and of these struct(n, word)
    with the largest n, the first in code-point order among equals. Words without any are left out.
    """
    vocabulary = keep(vocabulary)
    light = keep(light_steps(vocabulary))
    head, tail, heavy = F.substr("word", F.lit(1), F.col("at")), F.substr("word", F.col("at") + 2), F.char("heavy")
    both = light.where("next <> 0 AND heavy <> 0")
    # Terminals: what a light word becomes beside its heavy sibling, and how it is shorter or longer there.
    made = lambda rows, terminal, kind: rows.select(terminal.alias("terminal"), "word", "n", F.lit(kind).alias("kind"))
    terminals = (
        made(both, F.concat(head, heavy, tail), "replaced")
        .unionByName(made(light.where("next <> 0"), F.concat(head, tail), "skipped"))
        .unionByName(made(light.where("heavy <> 0"), F.concat(head, heavy, F.substr("word", F.col("at") + 1)), "put in"))
    )
    met = keep(terminals.join(vocabulary.select(F.col("word").alias("terminal"), F.col("n").alias("m")), "terminal"))
    one = lambda a, m, b: F.struct(F.col(a).alias("word"), F.struct((-F.col(m)).alias("n"), F.col(b).alias("word")).alias("best"))
    replaced = met.where("kind = 'replaced'").select(F.explode(F.array(one("word", "m", "terminal"), one("terminal", "n", "word"))).alias("x")).select("x.*")
    # A doubled letter can be skipped at either place: such pairs are found twice.
    longer = met.where("kind <> 'replaced'").select(
        *[F.when(F.col("kind") == "skipped", F.col(a)).otherwise(F.col(b)).alias(c) for a, b, c in (("word", "terminal", "long"), ("n", "m", "n_long"), ("terminal", "word", "short"), ("m", "n", "n_short"))]
    ).distinct()
    longer = longer.select(F.explode(F.array(one("long", "n_short", "short"), one("short", "n_long", "long"))).alias("x")).select("x.*")
    # Light siblings with their character open: all of a terminal are near each other, at most one for each letter there is.
    openings = light.where("next <> 0").select(F.concat(head, F.lit("\0"), tail).alias("terminal"), F.struct((-F.col("n")).alias("n"), "word").alias("own"))
    openings = keep(openings.groupBy("terminal").agg(F.sort_array(F.collect_list("own")).alias("all")).where(F.size("all") > 1))
    siblings = openings.select(F.col("all")[0].alias("first"), F.col("all")[1].alias("second"), (F.size("all") - 1).alias("n_near"), F.explode("all").alias("own"))
    siblings = siblings.select("own.word", F.when(F.col("own.word") == F.col("first.word"), F.col("second")).otherwise(F.col("first")).alias("best"), F.col("n_near").cast("long"))
    pairs = replaced.unionByName(longer).withColumn("n_near", F.lit(1).cast("long")).unionByName(siblings)
    return pairs.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best")).select("word", "n_near", F.struct((-F.col("best.n")).alias("n"), F.col("best.word").alias("word")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each word of forms (word, form): the last word that forms lead to.

    A form is COMMONER times commoner than its word, so paths are short; each round doubles the steps that are taken.
    """
    at = keep(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = keep(at.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if at.where("moved").isEmpty():
            return at.select("word", "root")
        at = at.drop("moved")


def variants(vocabulary: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n for each word of vocabulary (word, n)."""
    vocabulary = keep(vocabulary)
    best = vocabulary.join(near(vocabulary), "word", "left")
    is_form = F.col("best.n") >= COMMONER * F.col("n")
    forms = keep(best.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, F.col("best.n")).alias("form_n")))
    lead = roots(forms.where("form IS NOT NULL"))
    return forms.join(lead, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near and form_n of all words of the documents, of which one occurrence in SLIPS has lost a character.

    Null texts and texts without such words give none; repeated rows count each; a null doc_id counts as empty.
    """
    return variants(words(table(spark, sf_dir, "documents").select("doc_id", "text")))


OP12_SQL = f"""
WITH RECURSIVE tbl AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(range(8)::BIGINT[], lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, b::BIGINT) AS c FROM range(256) r(b))),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[{LETTERS}]+')) AS run FROM documents),
long AS (SELECT id, run, count(*) AS times, hex(encode(id || ':' || run)) AS x FROM runs WHERE length(run) >= {LEAST_LENGTH} GROUP BY 1, 2),
hashed AS (SELECT run, times, xor(4294967295, list_reduce(list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT)) AS h FROM long, tbl),
v AS MATERIALIZED (SELECT CASE WHEN h % {SLIPS} = 0 THEN substr(run, 1, h % length(run)) || substr(run, (h % length(run) + 2)::BIGINT) ELSE run END AS word, sum(times)::BIGINT AS n FROM hashed
  GROUP BY 1 HAVING sum(times) >= {LEAST_COUNT} AND length(word) >= {LEAST_LENGTH}),
d AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
pairs AS (SELECT a.word, b.word AS other, b.n AS m FROM d a JOIN d b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.less = v.word UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.less = v.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM pairs GROUP BY word),
first AS (SELECT p.word, min(p.other) AS other FROM pairs p JOIN best b ON p.word = b.word AND p.m = b.m GROUP BY p.word),
forms AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= {COMMONER} * v.n THEN other END AS form, CASE WHEN m >= {COMMONER} * v.n THEN m END AS form_n
  FROM v LEFT JOIN best USING (word) LEFT JOIN first USING (word)),
walk AS (SELECT word, word AS root, 0 AS d FROM forms UNION ALL SELECT w.word, f.form, d + 1 FROM walk w JOIN forms f ON w.root = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT word, max_by(root, d) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""
