"""Text expressions: tokens, trimming, identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words and endings that lexical search leaves out.
STOP_WORDS = (
    "a an and are as at be by did do does for from how i in is it of on or our should that the this to we what when where which who why with you your"
).split()
KOREAN_SUFFIXES = "에서 에게 부터 까지 으로 은 는 이 가 을 를 과 와 의 에 로 도 만".split()
TOKEN_PATTERN = "[A-Za-z0-9_-]{2,}|[가-힣]{2,}"


def lexical_tokens(text: Column) -> Column:
    """Lower-cased tokens of two characters or more that are no stop words, each Korean one followed by its stem."""
    kept = F.filter(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN_PATTERN), F.lit(0)), F.lower), lambda t: ~t.isin(STOP_WORDS))

    def stem(t: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for s in KOREAN_SUFFIXES:
            out = out.when(F.endswith(t, F.lit(s)) & (F.length(t) - len(s) >= 2), F.left(t, F.length(t) - len(s)))
        return out

    # Endings are looked for only where a text has a Korean token at all, and in tokens that are Korean.
    stemmed = F.flatten(F.transform(kept, lambda t: F.when(t < "가", F.array(t)).otherwise(F.array_compact(F.array(t, stem(t))))))
    return F.when(F.coalesce(text, F.lit("")).rlike("[가-힣]{2}"), stemmed).otherwise(kept)


def trim_space(text: Column) -> Column:
    """Without white space, of any script, at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def identity(*parts: Column | str) -> Column:
    """SHA-256 in hex of parts joined by NUL; null counts as empty, plain strings are literals."""
    return F.sha2(F.concat_ws("\0", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def material_id(uri: Column) -> Column:
    return identity("material", uri)


def node_id(kind: Column, ref: Column) -> Column:
    return F.concat(kind, F.lit(":"), ref)


def memory_hash(kind: Column, value: Column, source: Column) -> Column:
    return identity(kind, value, source)


def content_hash(*parts: Column) -> Column:
    """SHA-256 in hex of an embedding's text: its parts on lines."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def topic_path(owner: Column, kind: Column, ref: Column, uri: Column, locator: Column) -> Column:
    """A durable node's key without its kind; an observed one's address."""
    own = F.when(F.startswith(ref, F.concat(kind, F.lit("."))), F.substr(ref, F.length(kind) + 2)).otherwise(ref)
    at = F.when((uri != "") & (locator != ""), F.concat(uri, F.lit("#"), locator)).otherwise(uri)
    return F.when(owner == "durable", own).otherwise(at)


def byte_prefix(text: Column, size: Column | int) -> Column:
    """The longest start of a text that has no more than so many bytes as UTF-8; whole characters only."""
    size = F.lit(size) if isinstance(size, int) else size
    raw = F.encode(text, "utf-8")
    # A character starts at each byte that is no continuation (10xxxxxx): the cut goes before one of them.
    inside = lambda back: (size - back >= 0) & F.hex(F.substr(raw, size + 1 - back, F.lit(1))).rlike("^[89AB]")
    cut = F.when(~inside(0), size).when(~inside(1), size - 1).when(~inside(2), size - 2).otherwise(size - 3)
    return F.when(F.octet_length(text) <= size, text).when(size <= 0, F.lit("")).otherwise(F.decode(F.substr(raw, F.lit(1), cut), "utf-8"))


def shown_time(seconds: Column) -> Column:
    """Seconds since 1970 as RFC 3339 text in UTC, to the second; null stays null."""
    days = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    rest = F.pmod(seconds, F.lit(86400))
    part = lambda n: F.lpad(n.cast("int").cast("string"), 2, "0")
    return F.concat(F.date_format(days, "yyyy-MM-dd"), F.lit("T"), part(F.floor(rest / 3600)), F.lit(":"), part(F.floor(rest / 60) % 60), F.lit(":"), part(rest % 60), F.lit("Z"))


def preview(text: Column, size: int = 320) -> Column:
    return F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit("…"))).otherwise(text)


def namespace(key: Column) -> Column:
    return F.substring_index(key, ".", 1)
