"""Token counts of a byte-level BPE vocabulary, by a transducer that is compiled as texts need it.

A state is a prefix of a pre-token and knows the last token of that prefix's encoding; the transition on a byte is
annotated with the change in the number of tokens. Of all tokens that end a longer prefix, exactly one may follow the
last token of what stands before it: two tokens may stand side by side if no merge ever crosses their border. A text is
worked on in chunks. A chunk's map takes what is still open before it to what it leaves open, and a count: whatever
state it starts in, from its first certain border on the state is the same, so a map is (head, count, tail). Maps
compose associatively, pair by pair, as in a parallel prefix scan.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Characters in a chunk; states and pre-tokens that a worker remembers.
CHUNK, STATES, REMEMBERED = 32_768, 1_500_000, 500_000
#: Fixed value: the pattern of byte-level pre-tokens.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A pre-token never holds a space after another character, and what stands before never changes what follows.
BORDER = regex.compile(r"\S(?=\s)")
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in such vocabulary files: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Map(NamedTuple):
    """What a chunk does: head joins what is open before it; count counts between its borders; tail stays open."""

    head: str
    count: int
    tail: str | None  # None: the chunk has no certain border, all of it is head


class Counter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("not a byte-level BPE vocabulary without prefix space or normalizer")
        letter = byte_letters()
        raw = lambda s: bytes(letter[c] for c in s)
        self.token = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank, self.parts = {}, {}
        for r, (a, b) in enumerate(pairs):
            x, y = self.token[raw(a)], self.token[raw(b)]
            self.rank[x, y] = r
            self.parts.setdefault(self.token[raw(a + b)], (x, y, r))
        self.longest = max(map(len, self.token))
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.edges: tuple[dict, dict] = ({}, {})
        self.sound: dict[int, bool] = {}
        self.known: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        self.next: dict[int, int] = {}
        self.last, self.total = [-1], [0]

    def edge(self, side: int, t: int) -> tuple[tuple[int, int], ...]:
        """The tokens at the right (0) or left (1) edge of t as it is built, each with the rank at which it is merged away."""
        made = self.edges[side]
        if t not in made:
            p = self.parts.get(t)
            made[t] = ((*self.edge(side, p[1 - side])[:-1], (p[1 - side], p[2])) if p else ()) + ((t, NEVER),)
        return made[t]

    def beside(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border of a and b, each built as it is alone."""
        left, right, i, j = self.edge(0, a), self.edge(1, b), 0, 0
        while True:
            (x, gone_x), (y, gone_y) = left[i], right[j]
            r = self.rank.get((x, y))
            if r is not None and r < gone_x and r <= gone_y:
                return False
            if gone_x == gone_y == NEVER:
                return True
            if gone_x <= gone_y:
                i += 1
            else:
                j += 1

    def whole(self, t: int) -> bool:
        """Whether t's bytes are encoded as t: its parts are whole and only its own merge crosses their border."""
        if t not in self.sound:
            p = self.parts.get(t)
            if p is None:
                self.sound[t] = True
            else:
                x, y, r = p
                self.sound[t] = self.whole(x) and self.whole(y) and self._only_last(x, y)
        return self.sound[t]

    def _only_last(self, a: int, b: int) -> bool:
        left, right, i, j = self.edge(0, a), self.edge(1, b), 0, 0
        while (left[i][1], right[j][1]) != (NEVER, NEVER):
            r = self.rank.get((left[i][0], right[j][0]))
            if r is not None and r < left[i][1] and r <= right[j][1]:
                return False
            if left[i][1] <= right[j][1]:
                i += 1
            else:
                j += 1
        return True

    def pre_token(self, word: str) -> int:
        """The number of tokens of one pre-token: the sum of the annotations on its path."""
        raw = word.encode("utf-8", "surrogatepass")
        path, state, step = [0], 0, self.next
        for n, byte in enumerate(raw, 1):
            to = step.get(state << 8 | byte)
            if to is None:
                to = self.compile(raw, n, path, state << 8 | byte)
            state = to
            path.append(to)
        return self.total[state]

    def compile(self, raw: bytes, n: int, path: list[int], arc: int) -> int:
        for size in range(min(n, self.longest), 0, -1):
            t = self.token.get(raw[n - size : n])
            if t is None or not self.whole(t):
                continue
            before = path[n - size]
            if size == n or self.beside(self.last[before], t):
                self.last.append(t)
                self.total.append(self.total[before] + 1)
                self.next[arc] = len(self.last) - 1
                return len(self.last) - 1
        raise ValueError(f"no token ends {raw[:n]!r}")

    def stretch(self, text: str) -> int:
        """Tokens of a text between certain borders."""
        known, out = self.known, 0
        for word in PRE_TOKEN.findall(text):
            n = known.get(word)
            if n is None:
                known[word] = n = self.pre_token(word)
            out += n
        return out

    def map(self, chunk: str) -> Map:
        first = BORDER.search(chunk)
        if first is None:
            return Map(chunk, 0, None)
        last = max(chunk.rfind(" "), chunk.rfind("\n"))
        while last > first.end() and chunk[last - 1].isspace():
            last -= 1
        last = max(last, first.end())
        return Map(chunk[: first.end()], self.stretch(chunk[first.end() : last]), chunk[last:])

    def joined(self, a: Map, b: Map) -> Map:
        if a.tail is None:
            return Map(a.head + b.head, b.count, b.tail)
        if b.tail is None:
            return Map(a.head, a.count, a.tail + b.head)
        return Map(a.head, a.count + self.stretch(a.tail + b.head) + b.count, b.tail)

    def count(self, text: str) -> int:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if len(self.last) > STATES:
            self.reset()
        if self.special is None:
            return self.ordinary(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.ordinary, parts))

    def ordinary(self, text: str) -> int:
        maps = [self.map(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)] or [Map("", 0, None)]
        while len(maps) > 1:
            maps = [self.joined(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, inner, tail = maps[0]
        return self.stretch(head) + inner + self.stretch(tail or "")


_COUNTERS: dict[str, Counter] = {}


def counted(docs: DataFrame, path: str) -> DataFrame:
    """docs without text, with n_bytes and n_tokens in a struct _tokens. Null text counts as empty: no bytes, no tokens.

    Strings of special tokens inside a text count as that token, as is the library's default. Other columns pass
    through, but for a column _tokens of the input; path must be readable where tasks run.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _COUNTERS.get(path) or _COUNTERS.setdefault(path, Counter(path))
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            sizes = [len(x.encode("utf-8", "surrogatepass")) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sizes, pa.int64()), pa.array(map(counter.count, texts), pa.int64())], ["row", "n_bytes", "n_tokens"])

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("text", "_tokens")]).alias("row")
    whole = docs.select(row, "text")
    out = whole.mapInArrow(of, f"row {whole.schema['row'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.select("row.*", F.struct("n_bytes", "n_tokens").alias("_tokens"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document, counted as the library for byte_bpe_50k.json does."""
    import public_tokenizers

    out = counted(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "_tokens.*", (F.col("_tokens.n_tokens") > 512).alias("over_limit"))
