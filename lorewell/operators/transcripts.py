"""Transcripts: messages, chunks for a model, and the proposals that come back."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoints import kept
from ..functions.text import trim_space


# Parts of a message that are text, and types of a record that tell who speaks.
PARTS = ("text", "input_text", "output_text")
SPEAKERS = {"user": "user", "user_message": "user", "assistant": "assistant", "assistant_message": "assistant"}
#: Where in a record a message may lie, as it is looked for a role; for a text from the last to the first.
PLACES = ("$", "$.payload", "$.payload.message", "$.message")


def _is(value: Column, kind: str) -> Column:
    """Whether a variant is of a JSON kind (STRING, ARRAY, OBJECT), told by its type, not by how it looks."""
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit(kind)), F.lit(False))


def _at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def _string(value: Column) -> Column:
    """A variant's string; null if it is anything else."""
    return F.when(_is(value, "STRING"), F.try_variant_get(value, "$", "string"))


def _text_at(record: Column, path: str) -> Column:
    value = _at(record, path)

    def part(p: Column) -> Column:
        shown = F.coalesce(_string(_at(p, "$.type")), F.lit("")).isin("", *PARTS)
        return trim_space(F.when(_is(p, "OBJECT"), F.when(shown, _string(_at(p, "$.text")))).otherwise(_string(p)))

    made = F.filter(F.transform(F.try_variant_get(value, "$", "array<variant>"), part), lambda p: p.isNotNull() & (p != ""))
    return F.nullif(F.when(_is(value, "STRING"), trim_space(_string(value))).when(_is(value, "ARRAY"), F.array_join(made, "\n")), F.lit(""))


def message_text(record: Column) -> Column:
    """The text of a JSON record in any of its shapes: a string, or parts that are strings or objects of a type of text.

    The innermost place that has one counts: message, then payload.message, payload and the record itself; in each,
    content before text before message. Each part is trimmed; null without text.
    """
    parsed = F.try_parse_json(record)
    return F.coalesce(*[F.when(_is(_at(parsed, at), "OBJECT"), _text_at(parsed, f"{at}.{field}")) for at in reversed(PLACES) for field in ("content", "text", "message")])


def message_role(record: Column) -> Column:
    """user or assistant: the first place whose role says so, else the last whose type does; null without."""
    parsed = F.try_parse_json(record)
    said = [_string(_at(parsed, f"{at}.role")) for at in PLACES]
    roles = [F.when(r.isin("user", "assistant"), r) for r in said]
    types = [F.element_at(F.create_map(*[F.lit(x) for kv in SPEAKERS.items() for x in kv]), F.lower(_string(_at(parsed, f"{at}.type")))) for at in reversed(PLACES)]
    return F.coalesce(*roles, *types)


#: The longest line of a transcript, in bytes.
LINE = 16 << 20


def numbered(rows: DataFrame, part: str, place: str, counted: dict[str, Column]) -> DataFrame:
    """rows with a running number for each name of counted, over the rows for which its condition holds, in the order of (part, place).

    Counts of parts are summed first, one row for each part, and rows are numbered within their part, so no task ever
    sees more of the rows than one part of them. Where a condition does not hold the number is null.
    """
    per_part = kept(rows.groupBy(part).agg(*[F.count_if(c).alias(f"_{name}") for name, c in counted.items()]))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    per_part = per_part.select(part, *[F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_{name}") for name in counted])
    here = Window.partitionBy(part).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    met = rows.withColumns({f"_at_{name}": F.when(c, F.count_if(c).over(here)) for name, c in counted.items()}).join(per_part, part)
    return met.select(*rows.columns, *[(F.col(f"_{name}") + F.col(f"_at_{name}")).cast("long").alias(name) for name in counted])


def read_transcript(spark: SparkSession, path: str) -> DataFrame:
    """(line, seq, id, role, text) of a transcript of JSON records, one a line; blank lines are passed over.

    A line that is no JSON object, or longer than LINE, is an error that names the first one's number. Messages without
    a role or a text are left out and not numbered. A file is read in splits by as many tasks; lines and messages are
    numbered from the counts of the splits before, whose first bytes order them.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"))
    record = F.regexp_replace("value", "\r$", "")
    filled = trim_space(F.col("record")) != ""
    fine = F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json("record")), F.lit("OBJECT")), F.lit(False)) & (F.octet_length("record") <= LINE)
    said = raw.select("split", "place", record.alias("record")).select("split", "place", (filled & ~fine).alias("bad"), F.when(filled & fine, F.struct(message_role(F.col("record")).alias("role"), message_text(F.col("record")).alias("text"))).alias("m"))
    said = kept(said)
    lined = numbered(said, "split", "place", {"line": F.lit(True), "seq": F.col("m.role").isNotNull() & F.col("m.text").isNotNull()})
    if not said.where("bad").isEmpty():
        first = lined.where("bad").agg(F.min("line")).first()[0]
        raise ValueError(f"line {first} of {path} is no JSON object, or too long")
    mark = F.when(F.col("m.role") == "user", "U").otherwise("A")
    return lined.where("seq IS NOT NULL").select("line", "seq", F.concat(mark, F.lpad(F.col("seq").cast("string"), F.greatest(F.lit(6), F.length(F.col("seq").cast("string"))), F.lit("0"))).alias("id"), "m.role", "m.text")


def numbered_messages(turns: DataFrame, group: str, order: str) -> DataFrame:
    """User and assistant turns with text, numbered in one sequence for each transcript: U000001, A000002, …"""
    said = turns.where(F.col("role").isin("user", "assistant") & (trim_space(F.col("text")) != ""))
    seq = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return said.withColumn("seq", seq).withColumn("id", F.concat(F.when(F.col("role") == "user", "U").otherwise("A"), F.lpad(F.col("seq").cast("string"), 6, "0")))


def packed(messages: list[tuple[str, str]], size: int) -> list[str]:
    """Texts of at most about size bytes: whole messages greedily, long ones split between characters under one header."""
    pieces = []
    for name, text in messages:
        head = f"[{name}]\n"
        room, now = max(4, size - len(head.encode())), ""
        used = 0
        for c in text:
            n = len(c.encode("utf-8", "surrogatepass"))
            if used + n > room:
                pieces.append(head + now)
                now, used = "", 0
            now, used = now + c, used + n
        pieces.append(head + now)
    out: list[str] = []
    for p in pieces:
        if out and len(out[-1].encode()) + 2 + len(p.encode()) <= size:
            out[-1] += "\n\n" + p
        else:
            out.append(p)
    return out


def chunks(messages: DataFrame, group: str, size: int) -> DataFrame:
    """(group, chunk, text): each transcript's messages (seq, id, text) packed in order, one transcript at a time in a task."""
    kind = messages.schema[group].dataType.simpleString()

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        made = packed(list(zip(pdf["id"], pdf["text"], strict=True)), size)
        return pd.DataFrame({group: [pdf[group].iloc[0]] * len(made), "chunk": range(len(made)), "text": made})

    return messages.select(group, "seq", "id", "text").groupBy(group).applyInPandas(of, f"{group} {kind}, chunk int, text string")


def candidate_groups(candidates: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """One row for each key in order of first sight: its values in order, as an array, and their number."""
    values = F.transform(F.array_sort(F.collect_list(F.struct(seq, value))), lambda x: x[value])
    return candidates.groupBy(key).agg(F.min(seq).alias("first_seq"), F.count("*").alias("n"), values.alias("values"))


class Candidate(NamedTuple):
    """A memory that a model proposes: its value, what it rests on, links to material, and the candidates it comes from."""

    value: str
    evidence: tuple[str, ...] = ()
    links: tuple[tuple[str, str], ...] = ()
    sources: tuple[str, ...] = ()


def same_set(a: Sequence, b: Sequence) -> bool:
    """Whether two lists have the same values, none of them twice."""
    return len(a) == len(b) == len(set(a)) == len(set(b)) and set(a) == set(b)


def sound(made: Candidate | None, pair: tuple[Candidate, Candidate]) -> bool:
    """Whether what a model made of two candidates rests on them alone: evidence and links within theirs, sources just these."""
    if made is None:
        return False
    evidence, links = ({x for c in pair for x in getattr(c, name)} for name in ("evidence", "links"))
    return bool(made.value.strip()) and set(made.evidence) <= evidence and set(made.links) <= links and same_set(made.sources, ("left", "right"))


def reduced(groups: DataFrame, key: str, merge: Callable[[str, str], str | None], values: str = "values") -> DataFrame:
    """Each key's array of values joined pair by pair, round by round, with merge; a key for which it gives None goes.

    The values of one key are few, those that one round of a model proposed; a key without any gives no row.
    """

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, level in zip(pdf[key], pdf[values], strict=True):
                level = list(level)
                while len(level) > 1 and None not in level:
                    level = [merge(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
                if level and None not in level:
                    rows.append((name, level[0]))
            yield pd.DataFrame(rows, columns=[key, "value"])

    return groups.mapInPandas(of, f"{key} {groups.schema[key].dataType.simpleString()}, value string")


#: Candidates as rows, beside the key: their place among those of a key, and the fields of a Candidate; joined ones with whether they are sound.
CANDIDATE = "place long, value string, evidence array<string>, links array<struct<relation:string,ref:string>>, sources array<string>"
JOINED = CANDIDATE.replace("place long, ", "place long, fine boolean, ")
#: Pairs that a model gets at a time.
PAIRS = 32
#: Pairs of candidates to what a model makes of each, in order; nothing for a pair that it cannot join.
Merge = Callable[[list[tuple[Candidate, Candidate]]], list[Candidate | None]]


def _asked(key: str, kind: str, merge: Merge, batch: int):
    """What a model makes of pairs (key, place, a, b), so many at a time, and whether it rests on the pair alone; no value where it makes nothing.

    Links and evidence stand once each; the sources are those of the two.
    """

    def tuples(lists: pa.ListArray, items: Callable[[pa.Array], list]) -> list[tuple]:
        ends = lists.offsets.to_pylist()
        flat = items(lists.values.slice(ends[0], ends[-1] - ends[0]))
        return [tuple(flat[a - ends[0] : b - ends[0]]) for a, b in zip(ends, ends[1:])]  # noqa: B905

    def read(side: pa.StructArray) -> list[Candidate]:
        """Column by column: an object for each row's nested fields would take most of the time."""
        texts = lambda c: c.to_pylist()
        named = lambda c: list(zip(texts(c.field("relation")), texts(c.field("ref")), strict=True))
        columns = [texts(side.field("value")), *[tuples(side.field(n), f) for n, f in (("evidence", texts), ("links", named), ("sources", texts))]]
        return [Candidate(*c) for c in zip(*columns, strict=True)]

    strings, linked = pa.list_(pa.string()), pa.list_(pa.struct([("relation", pa.string()), ("ref", pa.string())]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for all_ in batches:
            for at in range(0, all_.num_rows, batch):
                part = all_.slice(at, batch)
                pairs = list(zip(read(part.column("a")), read(part.column("b")), strict=True))
                made = merge(pairs)
                if len(made) != len(pairs):
                    raise ValueError("the model's answers are not as many as the pairs")
                rows = [c or Candidate("") for c in made]
                within = [all(set(getattr(c, name)) <= {*getattr(a, name), *getattr(b, name)} for name in ("evidence", "links")) and same_set(c.sources, ("left", "right")) for c, (a, b) in zip(rows, pairs, strict=True)]
                once = lambda name: [list(dict.fromkeys(getattr(c, name))) for c in rows]
                carried = [list(dict.fromkeys((*a.sources, *b.sources))) for a, b in pairs]
                links = [[{"relation": r, "ref": x} for r, x in c] for c in once("links")]
                columns = {"fine": pa.array(within, pa.bool_()), "value": pa.array([c.value for c in rows], pa.string()), "evidence": pa.array(once("evidence"), strings), "links": pa.array(links, linked), "sources": pa.array(carried, strings)}
                yield pa.RecordBatch.from_arrays([part.column(key), part.column("place"), *columns.values()], names=[key, "place", *columns])

    return of, f"{key} {kind}, {JOINED}"


def consolidated_all(candidates: DataFrame, key: str, merge: Merge, batch: int = PAIRS) -> DataFrame:
    """One row (key, value, evidence, links, sources) for each key of candidates(key, place, value, evidence, links, sources).

    Neighbours by place are joined pair by pair, in as many rounds as it takes to halve the longest key to one; every
    round hands all pairs of all keys to the model, batch at a time, wherever their rows lie. What it makes of a pair has
    to be sound(): a value, evidence and links of these two only, and as sources just `left` and `right`. Sources of the
    two are then carried on. A key with anything else is left out. Candidates without a place or key are no candidates.
    """
    kind = candidates.schema[key].dataType.simpleString()
    fields = ["value", "evidence", "links", "sources"]
    whole = [F.coalesce(F.col(c), F.array()).cast(t).alias(c) for c, t in (("evidence", "array<string>"), ("links", "array<struct<relation:string,ref:string>>"), ("sources", "array<string>"))]
    order = F.row_number().over(Window.partitionBy(key).orderBy("place")) - 1
    level = kept(candidates.where(F.col(key).isNotNull() & F.col("place").isNotNull()).select(key, order.cast("long").alias("place"), "value", *whole))
    while (level.agg(F.max("place")).first()[0] or 0) > 0:
        # Rows are dealt by pair once and met within it: both sides of a pair are never compared or joined with others.
        half, pair = F.struct(*fields), F.floor(F.col("place") / 2)
        sides = level.select(key, "place", half.alias("a"), F.lead(half).over(Window.partitionBy(key, pair).orderBy("place")).alias("b"))
        pairs = sides.where("place % 2 = 0").select(key, pair.alias("place"), "a", "b")
        of, schema = _asked(key, kind, merge, batch)
        made = pairs.where("b IS NOT NULL").mapInArrow(of, schema)
        fine = F.col("fine") & (F.coalesce(trim_space(F.col("value")), F.lit("")) != "")
        met = kept(made.withColumn("fine", fine))
        bad = met.where("NOT fine").select(key).distinct()
        single = pairs.where("b IS NULL").select(key, "place", "a.*")
        level = kept(met.where("fine").drop("fine").unionByName(single).join(bad, key, "left_anti"))
    return level.select(key, *fields)


def consolidated(candidates: list[Candidate], merge: Callable[[Candidate, Candidate], Candidate | None]) -> Candidate | None:
    """A key's candidates as one, pair by pair; None as soon as what merge gives is not sound. Links and evidence once each."""
    level = list(candidates)
    while len(level) > 1:
        made = []
        for i in range(0, len(level), 2):
            pair = tuple(level[i : i + 2])
            if len(pair) == 2:
                one = merge(*pair)
                if not sound(one, pair):
                    return None
                sources = tuple(dict.fromkeys(s for c in pair for s in c.sources))
                one = one._replace(evidence=tuple(dict.fromkeys(one.evidence)), links=tuple(dict.fromkeys(one.links)), sources=sources)
            else:
                one = pair[0]
            made.append(one)
        level = made
    return level[0] if level else None
