"""One-hop graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions.text import stable_id, symbol_kind
from .analytics import least_values


def outgoing(edges: DataFrame, node, source: str = "source", target: str = "target") -> DataFrame:
    return edges.where(F.col(source) == node).select(target).distinct()


def incoming(edges: DataFrame, node, source: str = "source", target: str = "target") -> DataFrame:
    return edges.where(F.col(target) == node).select(source).distinct()


def edge_counts(edges: DataFrame, kind: str = "kind") -> DataFrame:
    return edges.groupBy(kind).agg(F.count("*").alias("n"))


def orphans(nodes: DataFrame, edges: DataFrame, key: str, target: str) -> DataFrame:
    """Nodes to which no edge leads."""
    return nodes.join(edges.select(F.col(target).alias(key)), key, "left_anti")


def references(edges: DataFrame, names: DataFrame, name: str, value: str, limit: int = 100, order: list[str] | None = None) -> DataFrame:
    """Edges to the symbols of one name, exactly and in its case."""
    found = edges.join(names.where(F.col(name) == value), "key")
    return found.orderBy(*(order or [name])).limit(limit)


def resolve(imports: DataFrame, files: DataFrame, candidates: str, key: str, path: str = "path") -> DataFrame:
    """(key, target): the file of the first candidate path that exists; NULL without one."""
    tried = imports.select(key, F.posexplode(candidates).alias("pos", path))
    hit = tried.join(files.select(path), path).groupBy(key).agg(F.min_by(path, "pos").alias("target"))
    return imports.select(key).join(hit, key, "left")


def dependencies(chunks: DataFrame, file_id: str = "file_id") -> DataFrame:
    """(file_id, kind, target), once each, from the array columns imports, superclass, protocols, mixins and frameworks."""
    kinds = {"imports": "import", "superclass": "inherit", "protocols": "conform", "mixins": "mixin", "frameworks": "framework"}
    return _named(chunks, file_id, kinds, "target")


def _named(chunks: DataFrame, file_id: str, kinds: dict[str, str], name: str) -> DataFrame:
    def tagged(column: str, kind: str):
        values = F.coalesce(F.col(column), F.array().cast("array<string>"))
        return F.transform(values, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias(name)))

    every = F.concat(*[tagged(c, k) for c, k in kinds.items() if c in chunks.columns])
    return chunks.select(file_id, F.explode(every).alias("e")).select(file_id, "e.kind", f"e.{name}").where(f"{name} != ''").distinct()


def symbol_refs(chunks: DataFrame, file_id: str = "file_id") -> DataFrame:
    """(id, file_id, kind, name): what each file refers to, once for each kind and name, from array columns like those of `dependencies`."""
    found = _named(chunks, file_id, {"typeReferences": "type", "protocols": "conform", "superclass": "inherit", "mixins": "mixin"}, "name")
    return found.select(stable_id(F.col(file_id), F.col("kind"), F.col("name")).alias("id"), file_id, "kind", "name")


def symbol_definitions(chunks: DataFrame, file_id: str = "file_id", order: list[str] | None = None) -> DataFrame:
    """(id, file_id, name, kind, start_line, end_line): named constructs that define something, the first of each name and kind."""
    own = chunks.select(file_id, F.trim("construct_name").alias("name"), symbol_kind(F.col("construct_type"), True).alias("kind"), "start_line", "end_line", *(order or []))
    own = own.where("name != '' AND kind IS NOT NULL")
    first = F.min_by(F.struct("start_line", "end_line"), F.struct(*(order or ["start_line", "end_line"])))
    found = own.groupBy(file_id, "name", "kind").agg(first.alias("f"))
    return found.select(stable_id(F.col(file_id), F.lit("def"), F.col("kind"), F.col("name")).alias("id"), file_id, "name", "kind", "f.start_line", "f.end_line")


def ends_with_path(path: Column, value: str) -> Column:
    """Whether a path is this one or ends with it, whole names only."""
    return (path == value) | F.endswith(path, F.lit("/" + value))


def dependencies_of(edges: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """Edges of the file at a path (or ending with it) with the path of their target, by kind and target."""
    own = files.where(ends_with_path(F.col("path"), path)).select(F.col("file_id").alias("source"), F.col("path").alias("source_path"))
    reached = files.select(F.col("file_id").alias("target_file"), F.col("path").alias("reached"))
    return edges.join(F.broadcast(own), "source").join(reached, "target_file", "left").orderBy("kind", "target")


def dependents_of(edges: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """Edges that lead to the file at a path, by its id or by the path that they name, by source."""
    own = files.where(ends_with_path(F.col("path"), path)).select(F.col("file_id").alias("target_file")).withColumn("hit", F.lit(True))
    sources = files.select(F.col("file_id").alias("source"), F.col("path").alias("source_path"))
    hit = edges.join(F.broadcast(own), "target_file", "left").where(F.col("hit") | ends_with_path(F.col("target"), path))
    return hit.drop("hit").join(sources, "source").orderBy("source_path", "target")


def edge_list(edges: DataFrame, files: DataFrame) -> DataFrame:
    """All edges with the paths of both files, NULL for a target outside."""
    a, b = (files.select(F.col("file_id").alias(k), F.col("path").alias(n)) for k, n in (("source", "source_path"), ("target_file", "target_path")))
    return edges.join(a, "source").join(b, "target_file", "left")


def file_summaries(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_id, path, out, into): files with the number of edges from and to them."""
    out = edges.groupBy(F.col("source").alias("file_id")).agg(F.count("*").alias("out"))
    into = edges.where("target_file IS NOT NULL").groupBy(F.col("target_file").alias("file_id")).agg(F.count("*").alias("into"))
    return files.select("file_id", "path").join(out, "file_id", "left").join(into, "file_id", "left").na.fill(0, ["out", "into"])


def find_symbols(symbols: DataFrame, files: DataFrame, name: str, limit: int = 100, kind: str | None = None, language: str | None = None, repo: str | None = None) -> DataFrame:
    """References to or definitions of a name, exactly and in its case, by repository, path and line."""
    found = symbols.where(F.col("name") == name)
    found = found.where(F.col("kind") == kind) if kind is not None else found
    files = files.where(F.lower("language") == language.lower()) if language is not None else files
    files = files.where(F.col("repo_id") == repo) if repo is not None else files
    order = ["repo_id", "path", *(c for c in ("start_line", "kind") if c in symbols.columns)]
    return found.join(files.select("file_id", "repo_id", "path", "language"), "file_id").orderBy(*order).limit(limit)


def symbol_counts(symbols: DataFrame, files: DataFrame, kind: str | None = None, language: str | None = None) -> DataFrame:
    """(name, n) of references or definitions, of one kind or language if given."""
    found = symbols.where(F.col("kind") == kind) if kind is not None else symbols
    if language is not None:
        found = found.join(files.where(F.lower("language") == language.lower()).select("file_id"), "file_id", "left_semi")
    return found.groupBy("name").agg(F.count("*").alias("n"))


#: Paths of tests, and of entry points.
TEST_PATHS = r"(?i)(?:tests?|spec)\.swift$|(?:test|spec)\.ts$|.(?:test|spec)\.rb$|^(?:tests?|..tests..|spec)/"
ENTRY_PATHS = r"(?i)(?:app|main)\.swift$|^(?:contentview\.swift|(?:index|main)\.[jt]s|(?:application|routes)\.rb)$"


def unreferenced(files: DataFrame, edges: DataFrame, symbols: DataFrame, refs: DataFrame, tests: bool = False, entries: bool = False, limit: int = 50) -> DataFrame:
    """(file_id, path, lines, symbols, names): files to which no edge leads and to whose symbols no other file refers, longest first.

    tests, entries: whether to list such files too. names are five at most, in order.
    """
    if not tests:
        files = files.where(~F.col("path").rlike(TEST_PATHS))
    if not entries:
        files = files.where(~F.col("path").rlike(ENTRY_PATHS))
    linked = edges.where("target_file IS NOT NULL").select(F.col("target_file").alias("file_id"))
    where = symbols.join(files.select("file_id", "repo_id"), "file_id").select("name", "file_id", "repo_id")
    uses = refs.select("name", F.col("file_id").alias("user")).distinct()
    # Two users at most matter: one may be the file itself.
    few = uses.groupBy("name").agg(F.min("user").alias("least"), F.max("user").alias("most"))
    used = where.join(few, "name").where("least != file_id OR most != file_id").select("file_id")
    own = symbols.groupBy("file_id").agg(F.count("*").alias("symbols"), least_values("name", 5).alias("names"))
    alone = files.join(linked, "file_id", "left_anti").join(used, "file_id", "left_anti").join(own, "file_id", "left")
    return alone.select("file_id", "path", "lines", F.coalesce("symbols", F.lit(0)).alias("symbols"), F.coalesce(F.array_join("names", ", "), F.lit("")).alias("names")).orderBy(F.desc("lines"), "file_id").limit(limit)


_ENDS = ("", ".swift", ".ts", ".tsx", ".js", ".jsx", ".rb", ".py")
_INDEXES = ("/index.ts", "/index.js", "/index.tsx")
_ADDON_ENDS = ("", ".gts", ".gjs", *_ENDS[2:3], ".js", ".tsx", ".jsx", "/index.gts", *_INDEXES[:2])


def import_candidates(target: Column, source: Column) -> Column:
    """The paths that an import may stand for, in order of preference; ../ is taken off, not followed."""
    folder = F.regexp_extract(source, r"^(.*)/[^/]*$", 1)
    tail = F.replace(F.regexp_replace(target, r"^(?:\.\./)+", ""), F.lit("./"), F.lit(""))
    near = F.when(folder == "", tail).otherwise(F.concat(folder, F.lit("/"), tail))
    relative = F.array(*[F.concat(near, F.lit(e)) for e in _ENDS])
    plain = F.array(*[F.concat(F.lit(p), target, F.lit(e)) for p in ("", "src/", "lib/", "app/", "Shared/", "Sources/") for e in _ENDS + _INDEXES])
    ruby = F.lower(F.replace(target, F.lit("::"), F.lit("/")))
    modules = F.array(*[F.concat(F.lit(p), ruby, F.lit(".rb")) for p in ("", "app/models/", "app/services/", "lib/")])
    package, rest = F.regexp_extract(target, "^/*([^/]+)/(.+)$", 1), F.regexp_extract(target, "^/*([^/]+)/(.+)$", 2)
    addons = F.array(*[F.concat(F.lit(a), package, F.lit(b), rest, F.lit(e)) for a, b in (("addons/", "/src/"), ("addons/", "/"), ("", "/app/")) for e in _ADDON_ENDS])
    none = F.array().cast("array<string>")
    far = F.concat(plain, F.when(F.contains(target, F.lit("::")), modules).otherwise(none), F.when(package != "", addons).otherwise(none))
    return F.array_distinct(F.when(target.startswith("./") | target.startswith("../"), relative).otherwise(far))


def path_tails(path: Column) -> Column:
    """All whole-name tails of a path, longest first, and those of the path up to each dot of its tail."""
    names = F.split(path, "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.array_join(F.slice(names, k, F.size(names)), "/"))
    cut = F.transform(tails, lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split(t, r"\.")) - 1, F.lit(1))), lambda n: F.call_function("substring_index", t, F.lit("."), n)))
    return F.array_distinct(F.concat(tails, F.flatten(cut)))


def resolve_imports(imports: DataFrame, files: DataFrame, candidates: str, key: str) -> DataFrame:
    """(key, target): the file of the first candidate that is a path or, failing that, a tail of a path (with or without what
    follows a dot); NULL without one. Of several files the least path is taken.

    Tails are exploded on the files' side and met by equality, not by patterns.
    """
    tried = imports.select(key, F.posexplode(candidates).alias("pos", "tried"))
    exact = files.select(F.col("path").alias("tried"), F.col("path").alias("target"), F.lit(0).alias("rank"))
    tails = files.select("path", F.explode(path_tails(F.col("path"))).alias("tried")).where("tried != path")
    suffix = tails.groupBy("tried").agg(F.min("path").alias("target")).select("tried", "target", F.lit(1).alias("rank"))
    hit = tried.join(exact.union(suffix), "tried").groupBy(key).agg(F.min_by("target", F.struct("pos", "rank", "target")).alias("target"))
    return imports.select(key).join(hit, key, "left")
