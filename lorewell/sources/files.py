"""Materials: files of a tree as rows, and the facts in their texts."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import byte_prefix, identity, material_id, trim_space
from . import golang

# Folders that are left out, and media types by extension.
IGNORED = [".git", ".idea", ".vscode", "build", "dist", "node_modules", "vendor", "wailsjs"]
MEDIA_TYPES = {
    ".go": "text/x-go", ".java": "text/x-java", ".kt": "text/x-kotlin", ".kts": "text/x-kotlin", ".py": "text/x-python", ".rs": "text/x-rust",
    ".ts": "text/typescript", ".tsx": "text/tsx", ".js": "text/javascript", ".jsx": "text/jsx", ".md": "text/markdown", ".markdown": "text/markdown",
    ".txt": "text/plain", ".yaml": "application/yaml", ".yml": "application/yaml", ".json": "application/json", ".html": "text/html", ".xml": "text/xml", ".css": "text/css",
}
# How declarations of each language look; the name is the group.
JAVASCRIPT = [
    (r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*\(", "function", "()"),
    (r"^\s*(?:export\s+)?(?:default\s+)?class\s+([A-Za-z_$][A-Za-z0-9_$]*)\b", "type", ""),
    (r"^\s*(?:export\s+)?(?:const|let)\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][A-Za-z0-9_$]*)\s*=>", "function", "()"),
]
DECLARATIONS = {
    "text/x-python": [(r"^\s*(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(", "function", "()"), (r"^\s*class\s+([A-Za-z_][A-Za-z0-9_]*)\b", "type", "")],
    "text/javascript": JAVASCRIPT,
    "text/jsx": JAVASCRIPT,
    "text/typescript": JAVASCRIPT,
    "text/tsx": JAVASCRIPT,
    "text/x-java": [
        (r"^\s*(?:(?:public|protected|private|abstract|static|final|sealed|non-sealed|strictfp)\s+)*(?:class|interface|enum|record|@interface)\s+([A-Za-z_$][A-Za-z0-9_$]*)\b", "type", ""),
        (r"^\s*(?:(?:public|protected|private|abstract|static|final|synchronized|native|default)\s+)*(?:[A-Za-z_$][A-Za-z0-9_$.<>?\[\], ]*\s+)+([A-Za-z_$][A-Za-z0-9_$]*)\s*\(", "function", "()"),
    ],
    "text/x-kotlin": [
        (r"^\s*(?:(?:public|private|protected|internal|open|abstract|sealed|data|value|enum|annotation)\s+)*(?:class|interface|object)\s+([A-Za-z_][A-Za-z0-9_]*)\b", "type", ""),
        (
            r"^\s*(?:(?:public|private|protected|internal|open|abstract|override|suspend|inline|operator|infix|tailrec|external)\s+)*fun\s+(?:[A-Za-z_][A-Za-z0-9_<>?.]*\.)?([A-Za-z_][A-Za-z0-9_]*)\s*\(",
            "function",
            "()",
        ),
    ],
    "text/x-rust": [
        (r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(", "function", "()"),
        (r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+([A-Za-z_][A-Za-z0-9_]*)\b", "type", ""),
    ],
}


def ignored(path: Column) -> Column:
    """Whether a relative path is left out: outside the root, in an ignored folder or of that name, or sensitive."""
    name = F.lower(F.substring_index(path, "/", -1))
    parts = F.exists(F.split(path, "/"), lambda p: p.isin(IGNORED))
    return parts | (path == "..") | F.startswith(path, F.lit("../")) | name.rlike(r"^(\.env(\..*)?|id_rsa|id_ed25519|.*\.pem|.*\.key)$")


def media_type(path: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for extension, kind in MEDIA_TYPES.items():
        out = out.when(F.endswith(F.lower(path), F.lit(extension)), F.lit(kind))
    return out.otherwise(F.lit("application/octet-stream"))


def _prune(folders: list[str]) -> bool:
    """Folders in order, without those that are left out: a walk does not enter them."""
    folders[:] = sorted(f for f in folders if f not in IGNORED)
    return True


def discover(spark: SparkSession, root: str) -> DataFrame:
    """One row for each file under root that is not ignored: id, uri, media_type, size, modified_at, content_hash.

    The driver lists names only (Spark's file sources leave out names with a leading point); tasks read the bytes,
    so root must be readable where they run. Links are not followed.
    """
    names = [os.path.relpath(os.path.join(d, f), root).replace(os.sep, "/") for d, sub, files in os.walk(root) if _prune(sub) for f in files if not os.path.islink(os.path.join(d, f))]
    paths = spark.createDataFrame([(n,) for n in sorted(names)], "path string").where(~ignored(F.col("path")))

    def read(batches):
        import hashlib

        for pdf in batches:
            rows = []
            for n in pdf["path"]:
                digest, full = hashlib.sha256(), os.path.join(root, n)
                with open(full, "rb") as file:
                    while part := file.read(1 << 17):
                        digest.update(part)
                stat = os.stat(full)
                rows.append((n, stat.st_size, int(stat.st_mtime), digest.hexdigest()))
            import pandas as pd

            yield pd.DataFrame(rows, columns=["path", "size", "modified_at", "content_hash"])

    found = paths.mapInPandas(read, "path string, size long, modified_at long, content_hash string")
    uri = F.concat(F.lit("file:"), F.col("path"))
    return found.select(material_id(uri).alias("id"), uri.alias("uri"), media_type(F.col("path")).alias("media_type"), "size", "modified_at", "content_hash")


def scoped(uri: Column, resource: Column) -> Column:
    return F.concat(F.lit("resource:"), resource, F.lit("/"), uri)


def relative_path(uri: Column) -> Column:
    """The path in an address, with or without a resource; null if it would lead out of its root or is no file's."""
    path = F.regexp_extract(uri, r"^(?:resource:[^/]+/)?file:(.*)$", 1)
    out = F.exists(F.split(path, "/"), lambda p: p == "..") | F.startswith(path, F.lit("/")) | (path == "")
    return F.when(~out, path)


def full_path(root: str, uri: str) -> str:
    """Where the file of an address lies below root; an address that leads out of it, by links too, is an error."""
    m = re.fullmatch(r"(?:resource:[^/]+/)?file:(.+)", uri)
    top = os.path.realpath(root)
    full = os.path.realpath(os.path.join(top, m[1])) if m else ""
    if not m or m[1].startswith("/") or os.path.commonpath([top, full]) != top or full == top:
        raise ValueError(f"{uri!r} leads out of its root")
    return full


def read_texts(paths: DataFrame, root: str) -> DataFrame:
    """(material_id, text) of paths(material_id, path, processor) below root, read by tasks.

    Plain text is cut at 256 KiB, other texts come whole; a file that holds NUL or is gone has none.
    """

    def read(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for i, path, kind in zip(pdf["material_id"], pdf["path"], pdf["processor"], strict=True):
                try:
                    with open(os.path.join(root, path), "rb") as file:
                        raw = file.read((256 << 10) if kind == "text/v1" else -1)
                except OSError:
                    continue
                if kind == "text/v1":
                    rows.append((i, text_content(raw)))
                elif b"\0" not in raw:
                    rows.append((i, raw.decode("utf-8", "replace")))
            yield pd.DataFrame(rows, columns=["material_id", "text"])

    return paths.mapInPandas(read, "material_id string, text string")


def occurrence(rows: DataFrame, same: list[str], order: str) -> DataFrame:
    """rows with the number of each among those that are the same, in order."""
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*same).orderBy(order)))


def lines(files: DataFrame, text: str = "text") -> DataFrame:
    """files(material_id, …) with line, from 1, and its content in place of the text."""
    return files.select("material_id", F.posexplode(F.split(text, "\n")).alias("_at", "content")).withColumn("line", F.col("_at") + 1).drop("_at")


#: The longest line of a source that is read line by line, and the most bytes of a section's content.
LONGEST_LINE, CONTENT = 1 << 20, 32 << 10


def short_lines(text: Column) -> Column:
    """Whether no line of a text is too long to be read line by line."""
    return ~F.exists(F.split(text, "\n"), lambda line: F.octet_length(line) >= LONGEST_LINE)


def content(rows: Column) -> Column:
    """Lines as content: each trimmed, blank ones left out, together CONTENT bytes at most, cut between characters."""

    def more(made: Column, line: Column) -> Column:
        room = CONTENT - F.octet_length(made) - F.when(made == "", 0).otherwise(1)
        return F.when(room > 0, F.concat(made, F.when(made == "", "").otherwise("\n"), byte_prefix(line, room))).otherwise(made)

    return F.aggregate(F.filter(F.transform(rows, trim_space), lambda line: line != ""), F.lit(""), more)


def markdown(files: DataFrame) -> DataFrame:
    """(material_id, line, level, label, parent_line, content) of Markdown files(material_id, text).

    One row for each heading, and one of line 0 for what stands before the first. A line that begins a fence of either
    kind opens or closes one; inside, headings are text. A heading is up to six signs and a space on a line that may
    be indented; one without a label is no content either. Running aggregates over a file's lines find fences, the
    heading that a line stands under, and for each heading the last shallower one.
    """
    by_line = Window.partitionBy("material_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("material_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    t = lines(files.where(short_lines(F.col("text")))).withColumn("plain", trim_space(F.col("content")))
    t = t.withColumn("fence", F.col("plain").rlike("^(```|~~~)"))
    t = t.withColumn("inside", F.sum(F.col("fence").cast("int")).over(by_line) % 2 == 1)
    head = ~F.col("inside") & ~F.col("fence") & F.col("plain").rlike(r"^#{1,6} ")
    label = trim_space(F.regexp_replace(F.regexp_replace("plain", r"^#{1,6} ", ""), r"#+$", ""))
    t = t.withColumn("label", F.when(head, label)).where(~F.col("fence") & ((F.col("label") != "") | F.col("label").isNull()))
    t = t.withColumn("level", F.when(F.col("label").isNotNull(), F.length(F.regexp_extract("plain", r"^(#{1,6}) ", 1))))
    t = t.withColumn("under", F.coalesce(F.last(F.when(F.col("level").isNotNull(), F.col("line")), ignorenulls=True).over(by_line), F.lit(0)))
    # the nearest open shallower heading: of each level, the last one before
    last = [F.last(F.when(F.col("level") == n, F.col("line")), ignorenulls=True).over(before) for n in range(1, 7)]
    above = F.greatest(F.lit(0), *[F.when(F.col("level") > n, F.coalesce(at, F.lit(0))).otherwise(0) for n, at in enumerate(last, 1)])
    t = t.withColumn("above", F.when(F.col("level").isNotNull(), above))
    body = F.transform(F.array_sort(F.collect_list(F.when(F.col("level").isNull(), F.struct("line", F.col("content").alias("x"))))), lambda r: r["x"])
    made = t.groupBy("material_id", F.col("under").alias("line")).agg(F.max("level").alias("level"), F.max("label").alias("label"), F.max("above").alias("parent_line"), body.alias("body"))
    return made.select("material_id", "line", "level", "label", "parent_line", content(F.col("body")).alias("content"))


def sections(files: DataFrame) -> DataFrame:
    """Markdown sections of files(material_id, text): level, label, line, parent_line (0: the file), content."""
    return markdown(files).where("line > 0").select("material_id", "level", "label", "line", "parent_line", "content")


def declarations(files: DataFrame) -> DataFrame:
    """Functions and types that files(material_id, media_type, text) declare: line, kind, label, occurrence, ref, calls.

    In Go they are read by its syntax, with the names that each function calls; a file that cannot be read gives none,
    and names that stand twice are one. In other languages the first pattern that a line matches names it.
    """
    found = F.when(F.lit(False), F.struct(F.lit("").alias("kind"), F.lit("").alias("label")))
    for media, patterns in DECLARATIONS.items():
        for pattern, kind, suffix in patterns:
            name = F.regexp_extract("content", pattern, 1)
            found = found.when((F.col("media_type") == media) & F.col("content").rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.concat(name, F.lit(suffix)).alias("label")))
    by_lines = files.where((F.col("media_type") != "text/x-go") & short_lines(F.col("text")))
    rows = by_lines.select("material_id", "media_type", F.posexplode(F.split("text", "\n")).alias("_at", "content")).withColumn("d", found).where("d IS NOT NULL")
    out = occurrence(rows.select("material_id", (F.col("_at") + 1).alias("line"), "d.kind", "d.label"), ["material_id", "kind", "label"], "line").withColumn("calls", F.array().cast("array<string>"))
    go = golang.facts(files.where("media_type = 'text/x-go'")).where("kind <> 'error'")
    go = go.groupBy("material_id", "kind", "label").agg(F.min("line").alias("line"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("calls")))).alias("calls")).withColumn("occurrence", F.lit(1))
    out = out.unionByName(go.select(*out.columns))
    return out.withColumn("ref", identity("entity", F.col("material_id"), F.col("kind"), F.col("label"), F.col("occurrence")))


def unreadable(files: DataFrame) -> DataFrame:
    """(material_id, reason) of files(material_id, media_type, text) that give no more than themselves: no text, a line too long, no Go."""
    go = golang.facts(files.where("media_type = 'text/x-go' AND text IS NOT NULL")).where("kind = 'error'").select("material_id", F.col("label").alias("reason"))
    by_lines = F.col("media_type").isin("text/markdown", *DECLARATIONS)
    reason = F.when(F.col("text").isNull(), "its text cannot be read").when(by_lines & ~short_lines(F.col("text")), "a line is too long")
    return files.select("material_id", reason.alias("reason")).where("reason IS NOT NULL").unionByName(go)


def text_content(raw: bytes | None) -> str:
    """The text of a file's first 256 KiB: none if it holds NUL, each run of invalid bytes as one replacement character."""
    part = (raw or b"")[: 256 << 10]
    return "" if b"\0" in part else re.sub("[\udc80-\udcff]+", "\ufffd", part.decode("utf-8", "surrogateescape")).strip()
