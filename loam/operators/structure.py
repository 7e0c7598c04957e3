"""Comment structure of source text, and regex audits.

Lines are classed with a small state machine (inside a block comment or not,
quotes respected): comment lines, code lines, the longest run of comment lines,
and whether comments hold code that was commented out, which takes one line that
can hardly be prose or two weak ones in a row. A comment behind code leaves a code
line. Languages without comments known here are unmeasured: all values NULL, never zero.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

Syntax = tuple[tuple[str, ...], tuple[tuple[str, str], ...]]
_SLASH: Syntax = (("//",), (("/*", "*/"),))
_HASH: Syntax = (("#",), ())
_ANGLE = ("<!--", "-->")
#: Line marks and block marks by language, in lower case.
SYNTAX: dict[str, Syntax] = {
    **dict.fromkeys("swift javascript typescript vue svelte astro rust go c c++ java kotlin scala groovy graphql prisma dart c# objective-c php zig css".split(), _SLASH),
    **dict.fromkeys(["glimmer typescript", "glimmer javascript"], _SLASH),
    **dict.fromkeys("shell powershell yaml toml perl r makefile dockerfile elixir".split(), _HASH),
    "ruby": (("#",), (("=begin", "=end"),)),
    "python": (("#",), (('"' * 3, '"' * 3), ("'" * 3, "'" * 3))),
    "sql": (("--",), (("/*", "*/"),)),
    "lua": (("--",), (("--[[", "]]"),)),
    **dict.fromkeys("html xml svg".split(), ((), (_ANGLE,))),
    "handlebars": ((), (("{{!--", "--}}"), ("{{!", "}}"))),
    "erb": ((), (("<%#", "%>"), _ANGLE)),
}
_BLANK = " \t\xa0     　"
_DIRECTIVES = tuple("codestyle coverage eslint fixme mark noqa note pragma prettier pylint rubocop swiftformat swiftlint todo type: warning".split())
_NAME, _DOTTED = r"[A-Za-z_$][\w$]*", r"[A-Za-z_$][\w$.]*"
_MODIFIER = "(?:(?:" + "|".join("abstract async class default export fileprivate final internal mutating nonisolated open override private public static throws @objc".split()) + r")\s+)*"
#: Shapes that prose doesn't take.
_STRONG = [
    re.compile("^" + p)
    for p in (
        rf"{_MODIFIER}(?:func|function|def|fn|sub)\s+{_NAME}\s*[<(]",
        rf"{_MODIFIER}(?:actor|class|enum|impl|interface|module|protocol|struct|trait)\s+{_NAME}\s*[(<{{:]",
        rf"(?:namespace|extension)\s+{_DOTTED}\s*[<{{:]",
        rf"{_NAME}(?:\.{_NAME})*\([^)]*\)\s*[,;{{]?\s*$",
        rf"{_MODIFIER}(?:const|let|val|var)\s+{_NAME}\s*:\s*\S",
        rf"{_MODIFIER}(?:const|final|let|val|var)?\s*[A-Za-z_$][\w$.\[\]]*\s*=\s*{_DOTTED}\([^)]*\)\s*;?\s*$",
        r"(?:catch|elif|elsif|for|foreach|if|match|switch|unless|until|while)\s*\(.*\)\s*[:{]?\s*$",
        rf"import\s+{_DOTTED}\s*;?\s*$",
        r"from\s+[./\w]+\s+import\s+\S",
        r"require(?:_relative)?\s*\(?[\"']",
        r"\#include\s*[\"<]",
        rf"[#@]\[?{_DOTTED}(?:\(.*\))?\]?\s*$",
    )
]
#: Shapes that also occur in prose.
_WEAK = [
    re.compile("^" + p)
    for p in (
        r"(?:(?:const|final|let|my|our|var)\s+)?[A-Za-z_$][\w$.\[\]\"']*\s*(?:[-+:]?=|\|\|=|\?\?=)\s*\S",
        r"(?:await|raise|return|throw|yield)\s+\S",
        r"(?:done|end|esac|fi)\s*$",
        r"[\])}][\]),;}]*\s*$",
        r"(?:for|if|unless|until|while)\s+.+\s+(?:then|do)\s*$",
        rf"{_NAME}\s*:\s*\S.*,\s*$",
        r"(?:[\"'].*[\"']|[._\d]+)\s*,\s*$",
        r"\S.*[\[({]\s*$",
        rf"case\s+{_NAME}\s*[(,:{{]?\s*$",
    )
]


def likelihood(body: str) -> str | None:
    """'strong', 'weak' or None: how much a comment line looks like code."""
    body = body.strip(_BLANK)
    if not 3 <= len(body) <= 400 or body.lower().startswith(_DIRECTIVES):
        return None
    if any(p.search(body) for p in _STRONG):
        return "strong"
    if body.endswith((".", "?", "!")):
        return None
    return "weak" if any(p.search(body) for p in _WEAK) else None


def _plain(body: str) -> str:
    """A comment without the rails of doc styles."""
    return body.lstrip("/*!#").strip(_BLANK)


def _scanner(syntax: Syntax) -> re.Pattern[str]:
    """Finds, outside of quotes, the first mark of a line: group 1 is an opener of a block."""
    marks = "|".join(re.escape(m) for m in syntax[0]) or r"(?!)"
    openers = "|".join(re.escape(o) for o, _ in syntax[1]) or r"(?!)"
    return re.compile(rf"""(?:"(?:\\.|[^"\\])*+(?:"|\\?$)|'(?:\\.|[^'\\])*+(?:'|\\?$)|`(?:\\.|[^`\\])*+(?:`|\\?$)|(?!{marks}|{openers})[^"'`])*+(?:(?:{marks})|({openers}))""", re.S)


_SCANNERS = {s: _scanner(s) for s in set(SYNTAX.values())}


def metrics(text: str | None, language: str | None) -> tuple[int, int, int, bool] | None:
    """(comment lines, code lines, longest block of comment lines, commented-out code), or None."""
    syntax = SYNTAX.get((language or "").lower())
    if text is None or syntax is None:
        return None
    marks, blocks = syntax
    scan, closers = _SCANNERS[syntax].match, dict(blocks)
    comments = code = longest = run = weak = 0
    until, has = None, False

    def note(body: str) -> None:
        nonlocal weak, has
        sure = likelihood(body)
        weak = weak + 1 if sure == "weak" else 0
        has = has or sure == "strong" or weak >= 2

    for line in text.split("\n"):
        body = line.strip(_BLANK)
        if until is not None:
            comments, run = comments + 1, run + 1
            longest = max(longest, run)
            head, found, tail = line.partition(until)
            if found:
                until = None
                code += bool(tail.strip(_BLANK))
            else:
                mark = next((m for m in marks if body.startswith(m)), "")
                note(_plain(body[len(mark) :]))
            continue
        if not body:
            run = weak = 0
            continue
        mark = next((m for m in marks if body.startswith(m)), None)
        opener = None if mark else next((o for o, _ in blocks if body.startswith(o)), None)
        if mark:
            said = _plain(body[len(mark) :])
        elif opener:
            said, found, tail = body[len(opener) :].partition(closers[opener])
            if not found:
                until = closers[opener]
            elif tail.strip(_BLANK):
                mark = opener = None
        if mark or opener:
            comments, run = comments + 1, run + 1
            longest = max(longest, run)
            note(said)
            continue
        code, run, weak = code + 1, 0, 0
        m = scan(line) if any(o in line for o in closers) else None
        if m and m[1] and closers[m[1]] not in line[m.end() :]:
            until = closers[m[1]]
    return comments, code, longest, has


_FIELDS = (("comment_lines", "int", pa.int32()), ("code_lines", "int", pa.int32()), ("max_block", "int", pa.int32()), ("has_code", "boolean", pa.bool_()))


def measure(rows: DataFrame, key: str, text: str, language: str | Column) -> DataFrame:
    """(key, comment_lines, code_lines, max_block, has_code, comment_ratio), NULL where unmeasured."""
    kind = rows.schema[key].dataType.simpleString()
    lang = F.lit(None).cast("string") if language is None else F.col(language) if isinstance(language, str) else language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [metrics(t, x) or (None,) * 4 for t, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            cols = list(zip(*found)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, f[2]) for c, f in zip(cols, _FIELDS))], names=[key, *(f[0] for f in _FIELDS)])

    out = rows.select(key, F.col(text).cast("string").alias("__t"), lang.alias("__l")).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{f[0]} {f[1]}" for f in _FIELDS))
    total = F.col("comment_lines") + F.col("code_lines")
    return out.withColumn("comment_ratio", F.when(total > 0, F.col("comment_lines") / total))


def structural(measured: DataFrame, key: str, ratio: float = 0.0, block: int = 0, commented_out: bool = False, limit: int = 50, lines: int = 0) -> DataFrame:
    """Measured rows that pass all filters (lines: comment and code lines together), most commented first."""
    found = measured.where("comment_lines IS NOT NULL").where((F.coalesce("comment_ratio", F.lit(0.0)) >= ratio) & (F.col("max_block") >= block))
    if lines:
        found = found.where(F.col("comment_lines") + F.col("code_lines") >= lines)
    if commented_out:
        found = found.where("has_code")
    return found.orderBy(F.desc_nulls_last("comment_ratio"), F.desc("max_block"), key).limit(limit)


def unmeasured(measured: DataFrame) -> DataFrame:
    """(unmeasured): how many rows have no measures."""
    return measured.agg(F.count_if(F.col("comment_lines").isNull()).alias("unmeasured"))


def backfill(rows: DataFrame, key: str, text: str, language: str, limit: int = 5000) -> tuple[DataFrame, DataFrame]:
    """(measures of the first `limit` rows, by key, that have none; (measured, unmeasurable, remaining) of the run)."""
    open_ = rows.where("comment_lines IS NULL")
    done = measure(open_.orderBy(key).limit(limit), key, text, language)
    counts = done.agg(F.count_if(F.col("comment_lines").isNotNull()).alias("measured"), F.count_if(F.col("comment_lines").isNull()).alias("unmeasurable"))
    total = open_.agg(F.count("*").alias("n"))
    return done, counts.join(F.broadcast(total)).select("measured", "unmeasurable", (F.col("n") - F.col("measured") - F.col("unmeasurable")).alias("remaining"))


_SORTS = {"lines": "lines", "methods": "methods", "bytes": "bytes", "size": "bytes"}


def files_by_structure(files: DataFrame, lines: tuple[int | None, int | None] = (None, None), methods: tuple[int | None, int | None] = (None, None), size: tuple[int | None, int | None] = (None, None), language: str | None = None, sort: str = "lines", limit: int = 50) -> DataFrame:
    """Files within bounds of lines, methods and bytes, largest first by one of them."""
    for column, (least, most) in (("lines", lines), ("methods", methods), ("bytes", size)):
        if least is not None:
            files = files.where(F.col(column) >= least)
        if most is not None:
            files = files.where(F.col(column) <= most)
    if language is not None:
        files = files.where(F.col("language") == language)
    return files.orderBy(F.desc(_SORTS.get(sort, "lines")), "path").limit(limit)


AUDITS: Mapping[str, str] = {
    "blocking_sleep": r"Thread\.sleep",
    "open_task": r"//\s*(?:FIXME|HACK|TODO|XXX)",
    "debug_print": r"\bprint\(",
    "forced_unwrap": r"\w+!\.",
    "swallowed_error": r"try\?\s",
    "main_queue_sync": r"DispatchQueue\.main\.sync",
    "large_tuple": r"->\s*\([^)]{80,}\)",
    "nested_closure": r"\{[^{}]*\{[^{}]*\{[^}]*\{",  # same matches as with [^}] throughout, without its backtracking
}
SEVERITIES: Mapping[str, str] = {"blocking_sleep": "error", "main_queue_sync": "error", "swallowed_error": "warning", "large_tuple": "warning", "nested_closure": "warning"}


def audit(rows: DataFrame, key: str, text: str, patterns: Mapping[str, str] = AUDITS, limit: int | None = None) -> DataFrame:
    """(key, pattern, n) of every pattern that occurs in a text; invalid ones are left out; anchors stand for lines.

    limit: as many findings as that, in order of the key and of the patterns.
    """
    valid = {}
    for name, p in patterns.items():
        try:
            re.compile(p)
            valid[name] = p
        except re.error:
            continue
    if not valid:
        return rows.select(key, F.lit("").alias("pattern"), F.lit(0).alias("n")).limit(0)
    each = F.posexplode(F.array(*[F.struct(F.lit(n).alias("pattern"), F.regexp_count(F.col(text), F.lit("(?m)" + p)).alias("n")) for n, p in valid.items()]))
    found = rows.select(key, each.alias("place", "a")).where("a.n > 0")
    if limit is not None:
        found = found.orderBy(key, "place").limit(limit)
    return found.select(key, "a.pattern", "a.n")


_BROUGHT_IN = "JSONEncoder() JSONDecoder() JSONSerialization FileManager.default Data(contentsOf URLSession.shared FileHandle .write(to"
_IO = "|".join(re.escape(x) for x in _BROUGHT_IN.split())
_MAIN_CLASS = r"@MainActor\s+(?:@\w+\s+)*(?:(?:fileprivate|internal|open|private|public)\s+)*(?:final\s+)?class\s+\w+"
_TASK_IN_MAIN = r"(?s)MainActor\.run\s*\{[^}]*Task\s*\{"
_BROADCAST = r"(?s)for\s+\w+\s+in\s+\w+[^{]*\{[^}]*(?:broadcast|channel\.send|emit|notify|post|send|try\?.*await.*send)\("
CONCURRENCY = ("main_actor_io", "task_in_main_run", "nonisolated_candidate", "broadcast_loop")


def audit_concurrency(rows: DataFrame, key: str, text: str, language: str, construct: str | None = None, categories: tuple[str, ...] = CONCURRENCY) -> DataFrame:
    """(key, pattern, n) of concurrency findings in Swift texts, n the occurrences that each rests on.

    A main-actor class counts with I/O in it, and a function (by its construct type) that names the main actor
    and does I/O counts unless it is nonisolated.
    """
    own = F.col(text)
    count = lambda p: F.regexp_count(own, F.lit(p))
    kind = F.col(construct) if construct else F.lit(None).cast("string")
    io = count(_IO)
    free = F.contains(own, F.lit("MainActor")) & ~F.contains(own, F.lit("nonisolated")) & F.coalesce(kind.isin("function", "method"), F.lit(False))
    rules = (F.when(count(_MAIN_CLASS) > 0, io).otherwise(0), count(_TASK_IN_MAIN), F.when(free, io).otherwise(0), count(_BROADCAST))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("pattern"), n.alias("n")) for c, n in zip(CONCURRENCY, rules) if c in categories]))
    return rows.where(F.lower(F.col(language)) == "swift").select(key, each.alias("a")).select(key, "a.pattern", "a.n").where("n > 0")
