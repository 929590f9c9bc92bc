"""SentencePiece encoding and decoding for vocabularies of the merge type, by a score-ordered agenda of pairs."""

from __future__ import annotations

import heapq
import re
import string
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MARK = "▁"
#: Stretches that a worker remembers: so many new ones, and those used while as many before them were new.
REMEMBERED = 350_000


class _Known(dict):
    """Ids of stretches, as bytes; works out a stretch it does not know and notes it for the library's check."""

    def __init__(self, merger: Merger):
        super().__init__()
        self.merger, self.new, self.changed, self.older, self.was_changed = merger, {}, {}, {}, {}

    def __missing__(self, stretch: str) -> bytes:
        if (out := self.older.get(stretch)) is not None:
            self[stretch] = out
            if stretch in self.was_changed:
                self.changed[stretch] = self.was_changed[stretch]
            return out
        merger = self.merger
        self.new[stretch] = ids = merger.merge(stretch)
        self[stretch] = out = b"".join([merger.raw[i] for i in ids])
        if (shown := merger.unmerge(ids)) != stretch.replace(MARK, " "):
            self.changed[stretch] = shown
        return out

    def age(self) -> None:
        """Let go of what has not been used since the last time."""
        self.older, self.was_changed, self.changed = dict(self), self.changed, {}
        self.clear()


class Merger:
    """Encodes and decodes with a model's pieces and scores; remembers stretches and checks each new one."""

    def __init__(self, path: str):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(lib.vocab_size())
        self.pieces = [lib.id_to_piece(i) for i in every]
        self.special = {i for i in every if lib.is_control(i) or lib.is_unknown(i)}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in every if lib.is_byte(i)}
        self.of_byte = {i: b for b, i in self.bytes.items()}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in self.special and i not in self.of_byte}
        self.cost = {p: -lib.get_score(i) for p, i in self.ids.items()}
        if any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in self.ids) or MARK not in self.ids:
            raise ValueError("a piece of this model runs from one word or line into the next, or it has none for a mark")
        if lib.normalize("  Åﬁ x ") != f"{MARK * 3}Åﬁ{MARK}x{MARK}":
            raise ValueError("only models that keep the text's characters and put one mark before it are supported")
        # a stretch, which no merge leaves: marks, then other characters, up to a line feed or, after letters, up to a
        # sign that stands behind a letter in no piece
        joined = {c for p in self.ids for c in re.findall(r"[^\W\d_](?=(.))", p)}
        signs = "".join(re.escape(c) for c in string.punctuation if c != "_" and c not in joined)
        first = f"{MARK}?[^\\W\\d_{MARK}]+(?=[{signs}])|" if signs else ""
        self.cut = re.compile(f"{first}{MARK}*[^{MARK}\n]+|{MARK}+|\n").findall
        self.raw = [i.to_bytes(4, "little") for i in every]
        self.shown = [p.replace(MARK, " ") for p in self.pieces]
        self.plain = set(self.ids.values())
        self.known = _Known(self)

    def merge(self, stretch: str) -> list[int]:
        """Ids of one stretch: the best-scored adjacent pair merges first, of equals the leftmost, until none is left."""
        parts = list(stretch)
        before, after = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        cost, pop, push = self.cost.get, heapq.heappop, heapq.heappush
        agenda = [(c, i, i + 1, 2) for i, c in enumerate(map(cost, map(str.__add__, parts, parts[1:]))) if c is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, j, n = pop(agenda)
            left, right = parts[i], parts[j]
            if not left or after[i] != j or len(left) + len(right) != n:
                continue
            both, k = left + right, after[j]
            parts[i], parts[j], after[i] = both, "", k
            if k >= 0:
                before[k] = i
                if (c := cost(more := both + parts[k])) is not None:
                    push(agenda, (c, i, k, len(more)))
            if (k := before[i]) >= 0 and (c := cost(more := parts[k] + both)) is not None:
                push(agenda, (c, k, i, len(more)))
        out: list[int] = []
        for p in parts:
            if p:
                out += [self.ids[p]] if p in self.ids else [self.bytes[b] for b in p.encode("utf-8")]
        return out

    def unmerge(self, ids: list[int]) -> str:
        """The text of one stretch's ids, marks as spaces; runs of byte pieces are UTF-8."""
        if self.plain.issuperset(ids):
            return "".join([self.shown[i] for i in ids])
        out, raw = [], bytearray()
        for i in ids:
            if i in self.of_byte:
                raw.append(self.of_byte[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i not in self.special:
                out.append(self.pieces[i])
        return ("".join(out) + raw.decode("utf-8", "replace")).replace(MARK, " ")

    def stretches(self, text: str) -> list[str]:
        return self.cut(MARK + text.replace(" ", MARK)) if text else []

    def check(self) -> None:
        """Hold the stretches worked out since the last check against the library, all in one call."""
        new, self.known.new = self.known.new, {}
        # what stands after a line feed is asked for after one: the library puts a mark before a text
        theirs = self.library.encode([s[1:].replace(MARK, " ") if s[0] == MARK else f"\n{s}" for s in new])
        for (s, ids), their in zip(new.items(), theirs, strict=True):
            # the library puts no mark before an empty text, so a lone mark can't be asked for
            if ids != (their if s[0] == MARK else their[2:]) and s != MARK:
                raise ValueError(f"the library encodes {s!r} otherwise")

    def batch(self, texts: list[str | None]) -> tuple[list[bytes], list[str]]:
        """For each text its ids, begin and end included, as little-endian 32-bit numbers, and what they decode to."""
        known = self.known
        if len(known) > REMEMBERED:
            known.age()
        begin, end = (i.to_bytes(4, "little") for i in (self.library.bos_id(), self.library.eos_id()))
        ids, shown = [], []
        for t in texts:
            cut = self.stretches(t or "")
            ids.append(begin + b"".join(map(known.__getitem__, cut)) + end)
            # stretches decode to themselves with spaces for marks, but for those noted
            whole = cut if known.changed.keys().isdisjoint(cut) else [known.changed.get(s, s) for s in cut]
            shown.append("".join(whole).replace(MARK, " ")[1:])
            if len(known.new) > 50_000:
                self.check()
        self.check()
        return ids, shown


_MERGERS: dict[str, Merger] = {}


def _merger(path: str) -> Merger:
    if path not in _MERGERS:
        _MERGERS[path] = Merger(path)
    return _MERGERS[path]


def encoded(docs: DataFrame, model_path: str, rows: int = 256) -> DataFrame:
    """docs with ids (binary: little-endian unsigned 32-bit numbers, begin and end included) and decoded, in a struct _pieces.

    Null text is read as empty: begin and end only, decoded to an empty text. Texts are whole, of any length; other
    columns pass through, but for a column _pieces of the input. model_path must be readable where tasks run. A batch works on so many rows at a time.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _merger(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids, texts = merger.batch(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], ["row", "ids", "decoded"])

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("text", "_pieces")]).alias("row")
    whole = docs.select(row, "text")
    out = whole.mapInArrow(of, f"row {whole.schema['row'].dataType.simpleString()}, ids binary, decoded string")
    return out.select("row.*", F.struct("ids", "decoded").alias("_pieces"))


def model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document, encoded by piece_bpe_32k.model."""
    out = encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), model())
    return out.select(
        "doc_id", F.floor(F.octet_length("_pieces.ids") / 4).cast("long").alias("n_tokens"), F.sha2("_pieces.ids", 256).alias("ids_sha256"), F.sha2("_pieces.decoded", 256).alias("decoded_sha256")
    )
