"""Facts of Go sources: functions, types and calls, read by a lexer and a walk over brackets.

Not a compiler: a file counts as unreadable if a literal or comment does not end, brackets do not match, or its top
level is no sequence of declarations after a package clause. Everything else is taken as it stands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..checkpoints import spread

# The words and signs of Go.
KEYWORDS = set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
ENDS_LINE = {"break", "continue", "fallthrough", "return", ")", "]", "}", "++", "--"}
OPENS, CLOSES = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}
#: What stands next at a place, in this order; a quote that none of them takes does not end.
TOKEN = re.compile(
    r"""(?P<space>[ \t\r]+)|(?P<line>\n)|(?P<remark>//[^\n]*|/\*.*?\*/)|(?P<literal>`[^`]*`|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.[^'\n]*)'|[0-9](?:[eEpP][+-]|[\w.])*)|(?P<name>[^\W\d]\w*)|(?P<sign>\+\+|--|<-|[^\w\s"'`])""",
    re.S,
)
FACTS = "kind string, label string, line int, calls array<string>"


class Unreadable(ValueError):
    """A source that is not Go."""


def lexed(text: str) -> list[tuple[str, str, int]]:
    """(kind, token, line) of a source; kinds are name, keyword, literal and sign. Ends of lines that end a statement are semicolons."""
    out: list[tuple[str, str, int]] = []
    at, line = 0, 1

    def ends_statement() -> bool:
        return bool(out) and (out[-1][0] in ("name", "literal") or out[-1][1] in ENDS_LINE)

    while at < len(text):
        m = TOKEN.match(text, at)
        if m is None or m.group() == "/" and text.startswith("/*", at):
            raise Unreadable(f"line {line}: {text[at]!r} does not end")
        kind, token = m.lastgroup, m.group()
        if kind == "line" or kind == "remark" and "\n" in token:
            if ends_statement():
                out.append(("sign", ";", line))
        elif kind not in ("space", "remark"):
            out.append(("keyword" if token in KEYWORDS else kind, token, line))
        line += token.count("\n")
        at = m.end()
    if ends_statement():
        out.append(("sign", ";", line))
    return out


def matched(tokens: list[tuple[str, str, int]]) -> dict[int, int]:
    """For each bracket the place of the one it belongs to."""
    pairs, open_ = {}, []
    for i, (kind, token, line) in enumerate(tokens):
        if kind == "sign" and token in OPENS:
            open_.append(i)
        elif kind == "sign" and token in CLOSES:
            if not open_ or tokens[open_[-1]][1] != CLOSES[token]:
                raise Unreadable(f"line {line}: {token!r} closes nothing")
            pairs[i] = open_.pop()
            pairs[pairs[i]] = i
    if open_:
        raise Unreadable(f"line {tokens[open_[-1]][2]}: {tokens[open_[-1]][1]!r} is not closed")
    return pairs


class Source:
    """The tokens of a file and the facts in them."""

    def __init__(self, text: str) -> None:
        self.tokens = lexed(text.removeprefix("﻿"))
        self.pairs = matched(self.tokens)

    def is_(self, i: int, *tokens: str) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i][0] in ("sign", "keyword") and self.tokens[i][1] in tokens

    def name(self, i: int) -> str | None:
        return self.tokens[i][1] if 0 <= i < len(self.tokens) and self.tokens[i][0] == "name" else None

    def is_operand(self, i: int) -> bool:
        """Whether a value can end at a token, so that a bracket behind it is an index and no type."""
        return 0 <= i < len(self.tokens) and (self.tokens[i][0] in ("name", "literal") or self.is_(i, ")", "]", "}"))

    def of_type(self, i: int) -> bool:
        """Whether the name at a place stands in an array, map or channel type, as in []byte(x), map[string]p.T(x), []*T(x)."""
        while self.is_(i - 1, ".") and self.name(i - 2) is not None:
            i -= 2
        if self.is_(i - 1, "chan", "]"):
            return True
        while self.is_(i - 1, "*"):
            i -= 1
        return self.is_(i - 1, "]") and not self.is_operand(self.pairs[i - 1] - 1)

    def called(self, i: int) -> str | None:
        """The name that the parenthesis at a place calls: a name, the last one of a chain, also before type arguments and indexes."""
        i -= 1
        while self.is_(i, "]"):
            i = self.pairs[i] - 1
        name = self.name(i)
        return None if name is None or self.of_type(i) else name

    def calls(self, start: int, end: int) -> list[str]:
        """The names that tokens from start to end call, each once; methods in an interface are no calls."""
        found, i = {}, start
        while i < end:
            if self.is_(i, "interface") and self.is_(i + 1, "{"):
                i = self.pairs[i + 1]
            elif self.is_(i, "("):
                name = self.called(i)
                if name is not None:
                    found[f"{name}()"] = None
            i += 1
        return list(found)

    def receiver(self, start: int, end: int) -> str:
        """The name of the type between the parentheses before a method; `receiver` for what is no plain name."""
        if self.name(start) is not None and (self.name(start + 1) is not None or self.is_(start + 1, "*", "(")):
            start += 1
        while self.is_(start, "*"):
            start += 1
        name = self.name(start)
        return name if name is not None and (start + 1 >= end or self.is_(start + 1, "[", ",")) else "receiver"

    def statement_end(self, i: int) -> int:
        """The semicolon that ends what stands at a place, brackets passed over."""
        while i < len(self.tokens) and not self.is_(i, ";"):
            i = self.pairs[i] + 1 if self.is_(i, *OPENS) else i + 1
        return i

    def function(self, i: int) -> tuple[int, tuple | None]:
        """The end and the fact of the declaration behind the word func at a place."""
        line, prefix = self.tokens[i][2], ""
        end = self.statement_end(i)
        i += 1
        if self.is_(i, "("):
            if self.pairs[i] > i + 1:
                prefix = self.receiver(i + 1, self.pairs[i]) + "."
            i = self.pairs[i] + 1
        name = self.name(i)
        if name is None:
            raise Unreadable(f"line {line}: a function without a name")
        i += 1
        for opening in ("[", "("):
            if self.is_(i, opening):
                i = self.pairs[i] + 1
        body = None
        while i < end:
            if self.is_(i, "{") and not self.is_(i - 1, "struct", "interface"):
                body = i
                break
            i = self.pairs[i] + 1 if self.is_(i, *OPENS) else i + 1
        return end, ("function", f"{prefix}{name}()", line, [] if body is None else self.calls(body, self.pairs[body]))

    def types(self, i: int) -> tuple[int, list[tuple]]:
        """The end and the facts of the declarations behind the word type at a place."""
        end = self.statement_end(i)
        grouped = self.is_(i + 1, "(")
        i, last, found = (i + 2, self.pairs[i + 1], []) if grouped else (i + 1, end, [])
        while i < last:
            name = self.name(i)
            if name is None:
                raise Unreadable(f"line {self.tokens[i][2]}: a type without a name")
            found.append(("type", name, self.tokens[i][2], []))
            i = min(self.statement_end(i), last) + 1
        return end, found

    def facts(self) -> list[tuple]:
        """(kind, label, line, calls) of the functions and types that the file declares at its top level."""
        if not (self.is_(0, "package") and self.name(1) and self.is_(2, ";")):
            raise Unreadable("line 1: no package clause")
        found, i = [], 3
        while i < len(self.tokens):
            if self.is_(i, "func"):
                i, one = self.function(i)
                found.append(one)
            elif self.is_(i, "type"):
                i, some = self.types(i)
                found += some
            elif self.is_(i, "import", "const", "var"):
                i = self.statement_end(i)
            elif not self.is_(i, ";"):
                raise Unreadable(f"line {self.tokens[i][2]}: {self.tokens[i][1]!r} is no declaration")
            i += 1
        return found


def facts(sources: DataFrame) -> DataFrame:
    """(material_id, kind, label, line, calls) of sources(material_id, text), one file at a time in tasks.

    A file that cannot be read gives one row of kind `error` whose label says why, and nothing else.
    """
    kind = sources.schema["material_id"].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, text in zip(batch["material_id"], batch["text"], strict=True):
                try:
                    rows += [(i, *one) for one in Source(text or "").facts()]
                except Unreadable as error:
                    rows.append((i, "error", str(error), 0, []))
            yield pd.DataFrame(rows, columns=["material_id", "kind", "label", "line", "calls"])

    return spread(sources.select("material_id", "text"), "material_id").mapInPandas(read, f"material_id {kind}, {FACTS}")
