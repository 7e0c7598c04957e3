"""Scalar text functions: identities, paths, tags, counts and clean-up."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.column import Column

#: Paths that look like credentials.
SECRETS_PATTERN = r"(^|/)(id_(rsa|dsa|ed25519)|\.env(\..+)?|credentials(\.json)?|.+\.(pem|p12|key|keystore))$"
TEST_MARKS = r"/tests?/|/spec/|[_-](test|spec)\.|\.(test|spec)\."
_LABELS = {
    "Swift": "swift",
    "JavaScript": "js jsx mjs cjs",
    "TypeScript": "ts tsx mts cts",
    "Glimmer TypeScript": "gts",
    "Glimmer JavaScript": "gjs",
    "Handlebars": "hbs",
    "Vue": "vue",
    "Svelte": "svelte",
    "Astro": "astro",
    "Ruby": "rb rake gemspec",
    "ERB": "erb",
    "Python": "py pyi pyx",
    "Rust": "rs",
    "Go": "go",
    "C": "c h",
    "C++": "cpp hpp cc cxx",
    "C#": "cs",
    "Java": "java",
    "Kotlin": "kt kts",
    "Scala": "scala",
    "Groovy": "groovy gradle",
    "Markdown": "md mdx",
    "Text": "txt",
    "reStructuredText": "rst",
    "AsciiDoc": "adoc",
    "JSON": "json jsonc json5",
    "YAML": "yml yaml",
    "TOML": "toml",
    "XML": "xml plist",
    "CSS": "css scss sass less styl",
    "HTML": "html htm",
    "Template": "ejs njk liquid",
    "Shell": "sh bash zsh fish",
    "PowerShell": "ps1",
    "Batch": "bat cmd",
    "SQL": "sql",
    "GraphQL": "graphql gql",
    "Prisma": "prisma",
    "Dockerfile": "dockerfile",
    "Terraform": "tf hcl",
    "Protocol Buffers": "proto",
    "Config": "cfg ini conf env",
}
LANGUAGES = {ext: label for label, exts in _LABELS.items() for ext in exts.split()}


def stable_id(*parts: Column) -> Column:
    """Hex sha-256 of the parts joined by colons; a NULL part counts as empty."""
    return F.sha2(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def token_count(col: Column) -> Column:
    """Words between white space, 1 at least."""
    return F.greatest(F.lit(1), F.regexp_count(col, F.lit(r"\S+")))


def sanitize(col: Column, most: int = 10_000) -> Column:
    """The first characters without control characters, white space collapsed and trimmed."""
    clean = F.regexp_replace(F.substring(col, 1, most), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return F.trim(F.regexp_replace(clean, r"[ \t\n\r]+", " "))


def module_path(path: Column, depth: int = 2) -> Column:
    """The first directories of a path; NULL for a file at the root."""
    parts = F.split(path, "/")
    n = F.least(F.lit(depth), F.size(parts) - 1)
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.greatest(n, F.lit(1))), "/"))


def directory_bucket(path: Column, depth: int = 2) -> Column:
    return F.coalesce(module_path(path, depth), F.lit("(root)"))


def is_test_path(path: Column) -> Column:
    return F.lower(path).rlike(TEST_MARKS)


def extension(path: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(path), r"\.([a-z0-9]+)$", 1), F.lit(""))


def language_of(path: Column) -> Column:
    """A label by extension; an unknown extension in capitals; NULL without one."""
    ext = extension(path)
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.element_at(known, ext), F.upper(ext))


def normalize_remote(url: Column) -> Column:
    """A remote address without scheme, user, www. and .git, in lower case, host and path parted by a slash."""
    out = F.regexp_replace(F.lower(F.trim(url)), r"^[a-z+]+://", "")
    out = F.regexp_replace(out, r"^[^@/]+@", "")
    out = F.regexp_replace(out, r"^www\.", "")
    out = F.regexp_replace(out, r"^([^/:]+):([^0-9])", "$1/$2")
    return F.regexp_replace(F.regexp_replace(out, r"/+$", ""), r"\.git$", "")


def feature_tags(path: Column, words: list[str], extra: Column | None = None) -> Column:
    """Sorted distinct path words out of a list, and further tags."""
    own = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(path), w))
    return F.array_sort(F.array_distinct(F.concat(own, extra) if extra is not None else own))


#: Path words that make feature tags.
FEATURES = tuple("agent ast brew chain chunk config distributed embed git github handler index mcp model rag search service swarm template tool view vm worktree".split())
METADATA = "imports array<string>, superclass string, protocols array<string>, mixins array<string>, typeReferences array<string>, frameworks array<string>, usesEmberConcurrency boolean, hasTemplate boolean"


def metadata(col: Column) -> Column:
    """The fields of a chunk's JSON metadata; NULL for anything else."""
    return F.from_json(col, METADATA)


def file_tags(path: Column, language: Column, meta: Column) -> Column:
    """Feature tags of a file: path words, the frameworks and flags of its chunks' metadata (an array of them), and its language."""
    frameworks = F.flatten(F.transform(meta, lambda m: F.coalesce(m["frameworks"], F.array().cast("array<string>"))))
    flag = lambda field, tag: F.when(F.exists(meta, lambda m: F.coalesce(m[field], F.lit(False))), F.array(F.lit(tag))).otherwise(F.array().cast("array<string>"))
    extra = F.concat(F.transform(frameworks, F.lower), flag("usesEmberConcurrency", "ember-concurrency"), flag("hasTemplate", "glimmer"), F.array(F.lower(language)))
    return feature_tags(path, list(FEATURES), extra)


def import_kind(path: Column, language: Column) -> Column:
    """The kind of dependency that an import is: frameworks in Swift, inherit or require in Ruby, else import."""
    lang = F.lower(language)
    return F.when(lang == "swift", "framework").when((lang == "ruby") & F.contains(path, F.lit("::")), "inherit").when(lang == "ruby", "require").otherwise("import")


def now_text() -> Column:
    """The time as ISO text in UTC, with milliseconds."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def random_id() -> Column:
    """32 random hex digits."""
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))


def packed_list(*parts: Column) -> Column:
    """An aggregate that lists structs of the parts in order, where text with separators would do elsewhere."""
    return F.array_sort(F.collect_list(F.struct(*parts)))


def for_embedding(col: Column, model: str) -> Column:
    """The text that a model is given: 8,000 characters for the long-context ones, 2,000 for others."""
    return F.substring(col, 1, 8000 if "qwen3-embedding" in model else 2000)


def json_list(col: Column) -> Column:
    """A JSON array of text; anything else gives an empty list."""
    return F.coalesce(F.from_json(col, "array<string>"), F.array().cast("array<string>"))


#: Kinds of constructs that define a symbol.
SYMBOL_KINDS = frozenset(
    "class struct enum protocol trait interface extension actor module namespace".split()
    + "function method subscript init deinit operator macro".split()
    + "typealias type variable constant property modifier mixin".split()
    + "component controller helper model route service".split()
)


def symbol_kind(col: Column, checked: bool = False) -> Column:
    """A construct type in its plain form, without decl; NULL for one that defines nothing, if checked."""
    kind = F.regexp_replace(F.lower(F.trim(F.coalesce(col, F.lit("unknown")))), "decl$", "") if checked else F.regexp_replace(F.lower(F.trim(col)), "decl$", "")
    return F.when(kind.isin(*sorted(SYMBOL_KINDS)), kind) if checked else kind


def snippet(col: Column, n: int = 300) -> Column:
    return F.substring(col, 1, n)


def clean_reply(col: Column, n: int = 200) -> Column:
    """A model's reply without thinking and code fences: the summary of its JSON, else its first characters."""
    body = F.trim(F.regexp_replace(F.regexp_replace(col, r"(?s)<think>.*?</think>", ""), r"```[a-z]*", ""))
    return F.coalesce(F.get_json_object(body, "$.summary"), F.substring(body, 1, n))


def glob_regex(pattern: str) -> str:
    """A Java regex for a shell pattern in which * also crosses slashes."""
    out = []
    for c in pattern:
        out.append(".*" if c == "*" else "." if c == "?" else c if c.isalnum() or c in "_/" else "\\" + c)
    return "^" + "".join(out) + "$"
