"""Scanning trees of text files into rows, with ignore rules."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import LANGUAGES, SECRETS_PATTERN, glob_regex, language_of

MOST_BYTES = 1_000_000
SKIPPED_DIRECTORIES = frozenset("node_modules build dist target vendor Pods DerivedData __pycache__ .git .venv venv .build .swiftpm .turbo Carthage __snapshots__ coverage tmp".split())
SKIPPED_FILES = frozenset("composer.lock Cargo.lock Gemfile.lock Podfile.lock package-lock.json pnpm-lock.yaml poetry.lock yarn.lock".split())
#: Parts of names of generated files.
SKIPPED_PARTS = (".bundle.", "-bundle.", ".chunk.", ".min.", ".packed.")
MANIFESTS = frozenset("Cargo.toml CMakeLists.txt Gemfile Package.swift build.gradle build.gradle.kts go.mod mix.exs package.json pom.xml pubspec.yaml pyproject.toml".split())
SECRETS = re.compile(SECRETS_PATTERN)


def credential(path: str) -> bool:
    """Whether a path looks like a credential and is never read."""
    return bool(SECRETS.search(path))


def ignore_patterns(root: str) -> list[str]:
    """Lines of .ragignore and .gitignore of the root without comments, blanks and negations."""
    out = []
    for name in (".ragignore", ".gitignore"):
        path = os.path.join(root, name)
        if os.path.isfile(path):
            with open(path, encoding="utf-8", errors="replace") as f:
                out += [x for x in (line.strip() for line in f) if x and x[0] not in "#!"]
    return out


def ignored(path: str, patterns: Iterable[str]) -> bool:
    """Whether a relative path falls under a pattern; one that ends in / stands for a folder anywhere."""
    parts = path.split("/")
    for p in patterns:
        if p.endswith("/"):
            name = p.rstrip("/").removeprefix("**/")
            if path.startswith(name + "/") or name in parts[:-1]:
                return True
        elif re.match(glob_regex(p), path) or re.match(glob_regex(p), parts[-1]):
            return True
    return False


#: Directories that the driver lists before executors walk the rest.
_FRONTIER = 256


def scan(spark: SparkSession, root: str, excluded: Iterable[str] = (), policy=credential) -> tuple[DataFrame, DataFrame]:
    """((path, bytes, language, text) of all files to index, (path) of refused ones).

    The driver lists directories until there are enough to share out; executors walk these and read the files,
    so the folder has to be shared. Hidden and empty files, unknown or no extensions and texts that aren't UTF-8
    are left out; of large files the first MOST_BYTES are read.
    """
    patterns, gone, root = ignore_patterns(root), {os.path.normpath(x) for x in excluded}, os.path.abspath(root)

    def subfolders(rel: str) -> list[str]:
        found = []
        for e in os.scandir(os.path.join(root, rel)):
            own = f"{rel}/{e.name}" if rel else e.name
            if e.is_dir(follow_symlinks=False) and not e.name.startswith(".") and e.name not in SKIPPED_DIRECTORIES and os.path.normpath(os.path.join(root, own)) not in gone and not ignored(own + "/x", patterns):
                found.append(own)
        return sorted(found)

    flat, deep = [], [""]
    while deep and len(deep) < _FRONTIER:
        flat.append(deep.pop(0))
        deep += subfolders(flat[-1])

    def files_of(rel: str) -> Iterator[str]:
        for e in sorted(os.scandir(os.path.join(root, rel)), key=lambda e: e.name):
            if e.is_file():
                yield f"{rel}/{e.name}" if rel else e.name

    def kept(path: str) -> bool:
        name = path.rpartition("/")[2]
        fits = not name.startswith(".") and name not in SKIPPED_FILES and not any(x in name for x in SKIPPED_PARTS) and not ignored(path, patterns)
        return fits and os.path.splitext(name)[1][1:].lower() in LANGUAGES

    def walk(want_refused: bool):
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for b in batches:
                for rel, whole in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    stack = [rel]
                    while stack:
                        at = stack.pop()
                        stack += subfolders(at) if whole else []
                        for path in files_of(at):
                            if policy(path):
                                if want_refused:
                                    yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])
                                continue
                            if want_refused or not kept(path):
                                continue
                            with open(os.path.join(root, path), "rb") as f:
                                body = f.read(MOST_BYTES)
                            try:
                                text = body.decode()
                            except UnicodeDecodeError:
                                continue
                            if body:
                                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(body)]), pa.array([text])], names=["path", "bytes", "text"])

        return run

    shares = spark.createDataFrame([(d, False) for d in flat] + [(d, True) for d in deep], "folder string, whole boolean").repartition(max(1, min(len(flat) + len(deep), _FRONTIER)))
    found = shares.mapInArrow(walk(False), "path string, bytes long, text string")
    return found.select("path", "bytes", language_of(F.col("path")).alias("language"), "text"), shares.mapInArrow(walk(True), "path string").orderBy("path")


def repositories(paths: DataFrame, path: str = "path", depth: int = 4) -> DataFrame:
    """Folders that hold a .git entry, at most `depth` deep."""
    parent = F.regexp_extract(F.col(path), r"^(.+)/\.git$", 1)
    return paths.select(parent.alias("repo")).where((F.col("repo") != "") & (F.size(F.split("repo", "/")) <= depth)).distinct().orderBy("repo")


def packages(paths: DataFrame, manifests: Iterable[str] = MANIFESTS, path: str = "path", git_roots: DataFrame | None = None) -> DataFrame:
    """Folders below the root that hold a manifest; those that are repositories (repo in git_roots) aside."""
    name, parent = F.element_at(F.split(path, "/"), -1), F.regexp_extract(F.col(path), r"^(.+)/[^/]+$", 1)
    found = paths.where(name.isin(*manifests)).select(parent.alias("package")).where("package != ''").distinct()
    if git_roots is not None:
        found = found.join(git_roots.select(F.col("repo").alias("package")), "package", "left_anti")
    return found.orderBy("package")


def excluded_roots(found: DataFrame, tracked: DataFrame, allow_workspace: bool, exclude_all: bool) -> DataFrame:
    """Nested repositories to leave out of a scan: all of them, if both are asked for, else those with an entry (root_path) of their own."""
    if allow_workspace and exclude_all:
        return found.select("repo")
    return found.join(tracked.select(F.col("root_path").alias("repo")), "repo", "left_semi").select("repo")


def relative(path: str, root: str) -> str:
    """A path from a root on; /private before either of them doesn't count. A path elsewhere stays whole."""
    a, b = (p.removeprefix("/private") if p.startswith("/private/") else p for p in (path, root.rstrip("/")))
    return a[len(b) + 1 :] if a.startswith(b + "/") else path


def read_failures(spark: SparkSession, path: str, most: int = 500) -> DataFrame:
    """Chunking failures of a JSON file of one array, the latest `most`."""
    rows = spark.read.option("multiLine", True).schema("path string, hash string, kind string, language string, at string").json(path)
    return rows.where("path IS NOT NULL").orderBy(F.desc("at"), "path").limit(most)


def npy_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(pos, vector): rows of an NPY file of float32 vectors, read on executors in blocks through a memory map; the path has to be shared."""
    n = len(np.load(path, mmap_mode="r", allow_pickle=False))
    read_npy(path, check_only=True)
    step = 4096

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for k in b.column(0).to_pylist():
                part = np.ascontiguousarray(np.load(path, mmap_mode="r", allow_pickle=False)[k * step : (k + 1) * step])
                ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * step, k * step + len(part))), pa.ListArray.from_arrays(ends, pa.array(part.reshape(-1)))], names=["pos", "vector"])

    return spark.range(-(-n // step)).mapInArrow(run, "pos long, vector array<float>")


def read_npy(path: str, check_only: bool = False) -> np.ndarray:
    """A float32 matrix of vectors from an NPY file, not read yet if it is only to be checked."""
    rows = np.load(path, mmap_mode="r" if check_only else None, allow_pickle=False)
    if rows.dtype != np.float32 or rows.ndim != 2:
        raise ValueError("an NPY file of vectors has two dimensions of float32")
    return rows
