"""Quality rules: text statistics, and a decision list learned from them by sequential covering."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, let, table, unused, words

#: Words in a window of repeats.
WINDOW = 8
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(w: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows of so many words that occur twice or more in the array w.

    Windows are compared by a 64-bit hash. Only texts in which two hashes agree sort them with their positions; the
    words covered are then counted from the gaps between the repeated windows' starts.
    """

    def marked(s: Column) -> Column:
        n = F.size(s)
        same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
        pos = F.filter(F.transform(s, lambda x, i: F.when(((i > 0) & same(i, i - 1)) | ((i < n - 1) & same(i, i + 1)), x["p"])), lambda p: p.isNotNull())
        return let(
            F.array_sort(pos),
            lambda p: F.aggregate(
                F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(window)), F.lit(window))), F.lit(0), lambda t, x: t + x
            ),
        )

    def counted(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.array_sort(pairs), marked))

    starts = F.sequence(F.lit(1), F.size(w) - (window - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, window)))
    return F.when(F.size(w) <= window, F.lit(0)).otherwise(let(hashes, counted)).cast("long")


def with_stats(docs: DataFrame, name: str = "_stats") -> DataFrame:
    """docs with a struct of counts over the whole text (null text: as an empty one), in place of a column of that name."""
    parts, rows = unused(docs, "words", "lines")
    t = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    left = lambda pattern: F.length(F.regexp_replace(t, pattern, "")).cast("long")  # noqa: E731  code points left
    counts = F.struct(
        F.size(parts).cast("long").alias("n_words"),
        F.length(F.array_join(parts, "")).cast("long").alias("word_chars"),
        left(r"[^#*$%&|<>]+").alias("n_symbols"),
        (F.size(rows) - F.size(F.array_distinct(rows))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col(parts)).alias("n_repeat_words"),
        left(r"\P{Lu}+").alias("n_upper"),
        left(r"[^!?]+").alias("n_bangs"),
        F.size(rows).cast("long").alias("n_lines"),
    )
    return docs.withColumn(parts, words(F.col("text"))).withColumn(rows, lines).withColumn(name, counts).drop(parts, rows)


def features(of: Column) -> dict[str, Column]:
    """What a rule's conditions test, from a struct of stats(); never null or infinite."""
    s = of.getField
    per = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0)).cast("double")
    return {
        "n_words": s("n_words").cast("double"),
        "word_length": per(s("word_chars"), s("n_words")),
        "symbol_share": per(s("n_symbols"), s("word_chars")),
        "dup_line_share": per(s("n_dup_lines"), s("n_lines")),
        "repeat_share": per(s("n_repeat_words"), s("n_words")),
        "upper_share": per(s("n_upper"), s("word_chars")),
        "bang_share": per(s("n_bangs"), s("n_words")),
        "line_words": per(s("n_words"), s("n_lines")),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, of: Column) -> Column:
        x = features(of)[self.feature]
        return x > self.threshold if self.above else x <= self.threshold


Rule = tuple[Condition, ...]


def holds(rule: Rule, test) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & test(c)
    return out


def kept(rules: list[Rule], of: Column) -> Column:
    """The decision list as one conditional expression: the first rule that holds rejects, otherwise the text stays."""
    out = F.when(F.lit(False), F.lit(False))
    for rule in rules:
        out = out.when(holds(rule, lambda c: c.column(of)), F.lit(False))
    return out.otherwise(F.lit(True))


def learn(found: DataFrame, labels: DataFrame, bins: int = 32, most_conditions: int = 3, precision: float = 0.9, least: int = 10, patience: int = 6) -> list[Rule]:
    """Rules for label 0, by sequential covering over all labelled rows of found (doc_id, _stats) and labels (doc_id, quality).

    Each step counts, in one Spark aggregation over the rows that the rule so far holds for and no earlier rule
    covers, the labels in each bin of each feature (bins: quantiles of the labelled rows); the driver sees those
    counts only. A rule grows on two thirds of the rows, dealt by hash, by the condition of best information gain, to
    most_conditions at most, then loses conditions at its end while that serves it on the other third. It joins the
    list if its precision there reaches the bound; if not, covering goes on from the next best first condition. It
    ends when no condition gains anything, or after so many failures (patience) without a rule between them. Later
    starts need twice the support. Without labels of both kinds: no rules.
    """
    named = list(features(F.col("_stats")))
    truth = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("y"))
    rows = keep(
        found.select("doc_id", "_stats")
        .join(truth.where(F.col("doc_id").isNotNull()), "doc_id")
        .withColumn("grow", F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0)
        .select("y", "grow", *[x.alias(k) for k, x in features(F.col("_stats")).items()])
    )
    if rows.select("y").distinct().count() < 2:
        return []
    at = [i / bins for i in range(1, bins)]
    cuts = {k: sorted(set(v)) for k, v in zip(named, rows.agg(*[F.percentile_approx(k, at, 10000) for k in named]).first(), strict=True)}
    bin_of = {k: sum(((F.col(k) > t).cast("int") for t in cuts[k]), F.lit(0)) for k in named}
    binned = keep(rows.select("y", "grow", *[v.cast("int").alias(k) for k, v in bin_of.items()]).groupBy("y", "grow", *named).count())

    def test(c: Condition) -> Column:
        i = cuts[c.feature].index(c.threshold)
        return F.col(c.feature) > i if c.above else F.col(c.feature) <= i

    rules: list[Rule] = []
    failed: set[Condition] = set()
    open_rows = binned
    while len(failed) <= patience:
        rule: Rule = ()
        while len(rule) < most_conditions:
            cells = open_rows.where("grow").where(holds(rule, test)).select("y", "count", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("bin")) for k in named])).alias("c"))
            best = _best(cells.groupBy("c.k", "c.bin", "y").agg(F.sum("count").alias("n")).collect(), cuts, least, () if rule else failed)
            if best is None or best in rule:
                break
            rule += (best,)
        if not rule:
            break
        tries = [rule[:i] for i in range(1, len(rule) + 1)]
        sums = open_rows.where(~F.col("grow")).agg(*[F.coalesce(F.sum(F.when(holds(r, test) & (F.col("y") == y), F.col("count"))), F.lit(0)) for r in tries for y in (0, 1)]).first()
        worth = [(sums[2 * i] - sums[2 * i + 1]) / max(1, sums[2 * i] + sums[2 * i + 1]) for i in range(len(tries))]
        i = max(range(len(tries)), key=lambda i: (worth[i], -i))
        low, high = sums[2 * i], sums[2 * i + 1]
        if low < max(1, least if failed else least // 2) or low < precision * (low + high):
            failed.add(rule[0])
            continue
        failed.clear()
        rules.append(tries[i])
        open_rows = open_rows.where(~holds(tries[i], test))
    return rules


def _best(counts, cuts: dict[str, list[float]], least: int, but=()) -> Condition | None:
    """The condition of the highest FOIL gain for label 0, but for some; ties to the first in name and threshold."""
    from math import log2

    by: dict[str, dict[int, list[int]]] = {}
    for k, b, y, n in counts:
        by.setdefault(k, {}).setdefault(b, [0, 0])[y] += n
    best, most = None, 1e-9
    for k in sorted(by):
        low, high = (sum(v[y] for v in by[k].values()) for y in (0, 1))
        if not low or not high:
            return None
        before = log2(low / (low + high))
        a = b = 0
        for i, t in enumerate(cuts[k]):
            a, b = a + by[k].get(i, (0, 0))[0], b + by[k].get(i, (0, 0))[1]
            for above, p, q in ((False, a, b), (True, low - a, high - b)):
                if p + q >= least and p and p + q < low + high and (gain := p * (log2(p / (p + q)) - before)) > most and Condition(k, above, t) not in but:
                    best, most = Condition(k, above, t), gain
    return best


def base_failed(of: Column) -> Column:
    return (of.getField("n_words") < 20) | (100 * of.getField("n_repeat_words") > 30 * of.getField("n_words"))


def verdict(rules: list[Rule], of: Column) -> Column:
    """Whether a text stays, from its stats. Null or blank text has no words and fails the base rule; a row without
    id or label is judged all the same. In learning, rows of an id with two labels count as the lower one."""
    return ~base_failed(of) & kept(rules, of)


def counted(docs: DataFrame) -> DataFrame:
    """doc_id and _stats of docs, kept in the shared folder: texts are read once, only counts are joined to labels."""
    return keep(with_stats(docs.select("doc_id", "text")).select("doc_id", "_stats"))


def good(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of docs(…, text, …) that the base rules and the decision list keep, with all their columns."""
    # the row number keeps the optimizer from moving the filter below the counts, which would work them out for each use
    stats, row = unused(docs, "stats", "row")
    numbered = with_stats(docs, stats).withColumn(row, F.monotonically_increasing_id())
    return numbered.where((F.col(row) >= 0) & verdict(rules, F.col(stats))).drop(stats, row)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the counts of the base rules, base_failed and kept of every document."""
    found, of = counted(table(spark, sf_dir, "documents")), F.col("_stats")
    rules = learn(found, table(spark, sf_dir, "labels"))
    return found.select("doc_id", *[of.getField(k).alias(k) for k in STATS], base_failed(of).alias("base_failed"), verdict(rules, of).alias("kept"))
