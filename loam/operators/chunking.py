"""Line chunks with overlap, semantic boundaries, and greedy batches."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions.text import token_count

MOST, LEAST, OVERLAP, BACK = 120, 20, 5, 30
#: Beginnings of lines, white space aside, before which a window may end.
_STARTS = tuple("// MARK:|// TODO:|// FIXME:|// ---|// ===|struct |class |enum |protocol |extension |actor |func |public func |private func |internal func |@MainActor|@Observable|## |### |#### ".split("|"))
_AFTER_BLANK = ("//", "struct", "class", "func", "enum", "extension", "protocol")
_BLANK = " \t\xa0"


def fixed_windows(docs: DataFrame, text: str = "text", most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """docs with chunk, start_line, end_line (from 1, inclusive) and body of windows of at most `most` lines.

    The last window is the first that reaches the last line. NULL texts have no windows.
    """
    if not 0 <= overlap < most:
        raise ValueError("overlap must be 0..most-1")
    step = most - overlap
    lined = docs.where(F.col(text).isNotNull()).withColumn("__lines", F.split(text, "\n", -1))
    n = F.greatest(F.lit(0), F.ceil((F.size("__lines") - most) / step)).cast("int")
    # Each window takes its own lines out of the array, so that the whole of it isn't copied to every row.
    begin = lambda k: k * step + 1
    window = lambda k: F.struct(k.alias("chunk"), begin(k).alias("start_line"), F.least(k * step + most, F.size("__lines")).alias("end_line"), F.array_join(F.slice("__lines", begin(k), F.lit(most)), "\n").alias("body"))
    cut = lined.withColumn("__w", F.transform(F.sequence(F.lit(0), n), window)).select(*[F.col(f"`{c}`") for c in docs.columns], F.explode("__w").alias("__w"))
    return cut.select(*[F.col(f"`{c}`") for c in docs.columns], "__w.*")


def boundary(lines: list[str], start: int, end: int, least: int = LEAST, back: int = BACK) -> int:
    """Where a window that may go up to `end` ends: before the last line, at most `back` lines up, at which something begins."""
    for i in range(end - 1, max(start + least, end - back) - 1, -1):
        line = lines[i].strip(_BLANK)
        if line.startswith(_STARTS):
            return i
        if not line and i + 1 < len(lines) and lines[i + 1].strip(_BLANK).startswith(_AFTER_BLANK):
            return i + 1
    return end


def line_chunks(text: str, most: int = MOST, overlap: int = OVERLAP, least: int = LEAST) -> Iterator[tuple[int, int, str]]:
    """(first line, last line, body) of the windows of a text, lines from 1."""
    lines, start = text.split("\n"), 0
    while True:
        end = min(len(lines), start + most)
        if end < len(lines):
            end = boundary(lines, start, end, least)
        yield start + 1, end, "\n".join(lines[start:end])
        if end == len(lines):
            return
        start = max(start + 1, end - overlap)


def semantic(docs: DataFrame, key: str, text: str = "text", most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """(key, start_line, end_line, body, tokens): windows that end before a definition where one is near."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, body in zip(b.column(0), b.column(1)):  # a text at a time, however long
                starts, ends, bodies = zip(*line_chunks(body.as_py(), most, overlap))
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(starts), b.schema.field(0).type), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(bodies, pa.string())], names=[key, "start_line", "end_line", "body"])

    rows = docs.where(F.col(text).isNotNull()).select(key, text)
    return rows.mapInArrow(run, f"`{key}` {kind}, start_line int, end_line int, body string").withColumn("tokens", token_count(F.col("body")))


def batches(sizes: list[int], most_bytes: int = 32_000, most_items: int = 32) -> list[range]:
    """Greedy runs of items within both bounds; an item larger than the bound is alone."""
    out, start, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > start and (total + n > most_bytes or i - start >= most_items):
            out.append(range(start, i))
            start, total = i, 0
        total += n
    if sizes:
        out.append(range(start, len(sizes)))
    return out


SIGNATURE = "lines-120-20-5;ast:python;v1"
AST_MOST_BYTES = 500_000
AST_LANGUAGES = ("Python",)


def file_hash(text: Column) -> Column:
    """The hash of a file's text under the present way of chunking, so that a new way makes every file new."""
    return F.sha2(F.concat(F.lit(SIGNATURE + ":"), text), 256)


def python_chunks(text: str) -> list[tuple[int, int, str, str, str]]:
    """(first line, last line, body, construct type, name) of top-level definitions and methods of Python source; SyntaxError if it isn't."""
    tree, lines, out = ast.parse(text), text.split("\n"), []

    def add(node, kind: str, name: str) -> None:
        first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        out.append((first, node.end_lineno, "\n".join(lines[first - 1 : node.end_lineno]), kind, name))

    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            add(node, "function", node.name)
        elif isinstance(node, ast.ClassDef):
            add(node, "class", node.name)
            for own in node.body:
                if isinstance(own, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    add(own, "method", f"{node.name}.{own.name}")
    return out


def hybrid(files: DataFrame, failed: DataFrame | None = None, path: str = "path", text: str = "text", language: str = "language") -> DataFrame:
    """(path, start_line, end_line, body, construct_type, construct_name, error) of all files.

    Sources of AST_LANGUAGES up to AST_MOST_BYTES are cut by their syntax tree; other files, those that can't be
    parsed, that have no definitions, or that failed before with the same text (failed: path, hash, kind; time-outs
    are tried again) are cut by lines, with an error told once a file.
    """
    own = files.where(F.col(text).isNotNull()).select(path, F.col(text).alias("__text"), F.col(language).alias("__lang"), file_hash(F.col(text)).alias("hash"))
    if failed is not None:
        known = failed.where("kind != 'timeout'").select(path, "hash", F.lit(True).alias("__known")).distinct()
        own = own.join(known, [path, "hash"], "left")
    else:
        own = own.withColumn("__known", F.lit(None).cast("boolean"))
    schema = "path string, start_line int, end_line int, body string, construct_type string, construct_name string, error string"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 4]

    def one(body: str, lang: str | None, known: bool | None) -> list[tuple]:
        error = None
        if lang in AST_LANGUAGES and not known and len(body.encode()) <= AST_MOST_BYTES:
            try:
                found = python_chunks(body)
                if found:
                    return [(a, b, c, kind, name, None) for a, b, c, kind, name in found]
                error = "empty"
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                error = "parse"
        return [(a, b, c, None, None, error if k == 0 else None) for k, (a, b, c) in enumerate(line_chunks(body))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, body, lang, known in zip(*(b.column(k) for k in range(4))):
                cols = list(zip(*one(body.as_py(), lang.as_py(), known.as_py())))
                yield pa.RecordBatch.from_arrays([pa.array([p.as_py()] * len(cols[0]), pa.string()), *(pa.array(c, k) for c, k in zip(cols, kinds[1:]))], names=names)

    return own.select(F.col(path).cast("string").alias("path"), "__text", "__lang", "__known").mapInArrow(run, schema)


MOST_FAILURES = 500


def track_failures(known: DataFrame, files: DataFrame, chunks: DataFrame, at: Column) -> DataFrame:
    """(path, hash, kind, language, at): failures after a run over files (path, hash, language) that gave chunks with errors.

    A path that went well, or whose text changed, loses its old failure; the MOST_FAILURES latest stay, as the feature has it.
    """
    bad = chunks.where("error IS NOT NULL").groupBy("path").agg(F.first("error").alias("kind"))
    new = files.join(bad, "path").select("path", "hash", "kind", "language", at.alias("at"))
    old = known.join(files.select("path"), "path", "left_anti")
    return old.unionByName(new).orderBy(F.desc("at"), "path").limit(MOST_FAILURES)
