import re

import pytest
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.functions import vectors as V
from loam.operators import analytics, chunking, graph, knn, merge, providers, search, store, structure
from loam.sources import files
from loam.streaming import ingest


def _metrics(text, language):
    return structure.metrics(text, language)


@pytest.mark.parametrize(
    "text, language, want",
    [
        ("// one\n// two\nlet x = 1", "Swift", (2, 1, 2)),
        ("// one\n\n// two\nlet x = 1", "Swift", (2, 1, 1)),
        ("/*\n * a\n * b\n */\nrun()", "Swift", (4, 1, 4)),
        ("let x = 1  // set x\nlet y = 2  // set y", "Swift", (0, 2, 0)),
        ('name = "#not-a-comment"\nother = \'also # not one\'', "Ruby", (0, 2, 0)),
        ("=begin\nold_call(1)\n=end\nrun", "Ruby", (3, 1, 3)),
        ("-- pick the rows\nSELECT 1;", "SQL", (1, 1, 1)),
        ("<!-- hidden -->\n<div>x</div>", "HTML", (1, 1, 1)),
    ],
)
def test_comment_lines(text, language, want):
    assert _metrics(text, language)[:3] == want


@pytest.mark.parametrize("language", ["Markdown", "JSON", "Text", None])
def test_unmeasured_languages(language):
    assert _metrics("# Heading\ntext", language) is None


def test_commented_out_code():
    assert _metrics("# def old_method(arg)\n#   value = compute(arg)\n# end\ndef new_method; end", "Ruby")[3]
    assert _metrics("// model = candidate\n// priority = 3\nrun()", "Swift")[3]
    assert not _metrics("// Filename = SHA-256 of the project's node id\nrun()", "Swift")[3]


@pytest.mark.parametrize(
    "body, want",
    [
        ("end", "weak"),
        ("});", "weak"),
        ("}", None),
        ("public var model: String?", "strong"),
        ("let name: String!", "strong"),
        ("is the peer still reachable?", None),
        ("The actor is the source of truth;", None),
        ("Swift (SwiftLint)", None),
        ('StatusChip("Idle", .idle)', "strong"),
    ],
)
def test_likelihood(body, want):
    assert structure.likelihood(body) == want


def test_knn_partition_ties_and_bad_rows(spark):
    rows = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.8, 0.2]), (3, "b", [1.0, 0.0]), (4, "a", None), (5, "a", [0.0, 0.0]), (6, "a", [1.0])], "vec_id long, repo string, embedding array<double>")
    found = knn.search(rows, [1.0, 0.0], 5, where=F.col("repo") == "a").collect()
    assert [r.vec_id for r in found] == [1, 2]
    assert [r.vec_id for r in knn.search(rows, [1.0, 0.0], 2).collect()] == [1, 3]
    assert knn.search(rows.limit(0), [1.0, 0.0]).count() == 0
    with pytest.raises(ValueError):
        knn.search(rows, [1.0, 0.0], 5000)


def test_vector_errors(spark):
    rows = spark.createDataFrame([([1.0, 2.0, float("nan")],)], "v array<double>")
    assert rows.select(V.vec_to_json("v")).first()[0] == "[1.000000,2.000000,null]"
    assert rows.select(V.vec_quantize_int8("v")).first()[0] == [127, 127, 127]
    with pytest.raises(Exception):
        rows.select(V.vec_slice("v", 1, 9)).collect()
    with pytest.raises(ValueError):
        V.vec_slice("v", 1, 1)


def test_delete_under(spark):
    paths = ["api/app.rb", "api/lib/thing.rb", "front-end/index.js", "apiary/spec.md", "workspace/config.yml", "README.md"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    left = {r.path for r in merge.delete_under(rows, "path", ["api/"]).collect()}
    assert left == set(paths[2:])
    assert merge.delete_under(rows, "path", ["", "  "]).count() == 6
    assert merge.delete_under(rows, "path", ["%"]).count() == 6


def test_drift(spark):
    models = ["qwen"] * 5 + ["gemma"] * 3 + [analytics.FAILED] * 2 + [None]
    rows = spark.createDataFrame([(m, True) for m in models], "analyzer_model string, enriched boolean")
    got = analytics.analyzer_drift(rows, "gemma").first()
    assert (got.models, got.off_pin, got.failed, got.unanalysed, got.drifted) == (2, 5, 2, 1, True)
    assert analytics.analyzer_drift(rows, "   ").first().off_pin == 0


def test_lessons_and_search(spark):
    rows = spark.createDataFrame([(1, "sig", None, True, 1.0, 0, 0), (2, "sig", "x.py", False, 0.1, 0, 0)], "id long, error_signature string, file_pattern string, is_active boolean, confidence double, apply_count int, success_count int")
    assert [r.id for r in search.match_lessons(rows, "sig", "y").collect()] == [1]
    used = search.use_lesson(rows, F.col("id") == 2, F.lit(False)).orderBy("id").collect()
    assert used[1].confidence == pytest.approx(0.1) and used[0].apply_count == 0
    assert search.text_search(rows, "  ", ["error_signature"]).count() == 0


def test_resolve_and_dependencies(spark):
    rows = spark.createDataFrame([(1, ["b", "a"]), (2, ["zz"]), (3, None)], "id long, c array<string>")
    found = graph.resolve(rows, spark.createDataFrame([("a",), ("b",)], "path string"), "c", "id")
    assert {r.id: r.target for r in found.collect()} == {1: "b", 2: None, 3: None}
    chunks = spark.createDataFrame([("f", ["x", "x", ""], None)], "file_id string, imports array<string>, protocols array<string>")
    assert [tuple(r) for r in graph.dependencies(chunks).collect()] == [("f", "import", "x")]


@pytest.mark.parametrize("sizes", [[5000] * 32, [10] * 200, [100, 96_000, 100], [], [42], [5055] * 32])
def test_batches(sizes):
    runs = chunking.batches(sizes)
    assert [i for r in runs for i in r] == list(range(len(sizes)))
    assert all(len(r) <= 32 and (sum(sizes[i] for i in r) <= 32_000 or len(r) == 1) for r in runs)


def test_windows(spark):
    body = "\n".join(f"line {i}" for i in range(45))
    rows = spark.createDataFrame([(1, body), (2, ""), (3, None)], "id long, text string")
    found = chunking.fixed_windows(rows, most=20, overlap=5).orderBy("id", "chunk").collect()
    assert [(r.id, r.start_line, r.end_line) for r in found] == [(1, 1, 20), (1, 16, 35), (1, 31, 45), (2, 1, 1)]
    assert chunking.semantic(rows, "id", most=20).count() >= 3


def test_scan(spark, tmp_path):
    for p, body in {"tas/main.py": b"x = 1", "poetry.lock": b"a", "id_rsa": b"k", "gen/out.py": b"y", "bad.py": b"\xff\xfe", ".ragignore": b"# c\n**/gen/\n", "empty.py": b""}.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(body)
    found, refused = files.scan(spark, str(tmp_path))
    assert [(r.path, r.language, r.text) for r in found.collect()] == [("tas/main.py", "Python", "x = 1")]
    assert [r.path for r in refused.collect()] == ["id_rsa"]
    paths = spark.createDataFrame([("a/.git",), ("a/b/.git",), ("a/pkg/setup.py",), ("setup.py",)], "path string")
    assert [r.repo for r in files.repositories(paths).collect()] == ["a", "a/b"]
    assert [r.package for r in files.packages(paths, ["setup.py"]).collect()] == ["a/pkg"]


def test_ingest_once(spark, tmp_path):
    spark.createDataFrame([("a",), ("a",), ("b",)], "text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text string").parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest.ingest(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_text_functions(spark):
    rows = spark.createDataFrame([("git@github.com:x/alpha.git", "a/b/c.swift"), ("https://www.GitHub.com/x/alpha/", "readme")], "url string, path string")
    got = rows.select(T.normalize_remote(F.col("url")), T.module_path(F.col("path")), T.language_of(F.col("path"))).collect()
    assert [tuple(r) for r in got] == [("github.com/x/alpha", "a/b", "Swift"), ("github.com/x/alpha", None, None)]
    assert rows.select(T.json_list(F.lit("{bad"))).first()[0] == []


def test_scan_extensions(spark, tmp_path):
    listed = "swift js ts tsx jsx mjs cjs mts cts gts gjs hbs vue svelte astro rb rake gemspec erb py pyi pyx rs go c h cpp hpp cc cxx java kt kts scala groovy gradle md mdx txt rst adoc json jsonc json5 yml yaml toml xml plist css scss sass less styl html htm ejs njk liquid sh bash zsh fish ps1 bat cmd sql graphql gql prisma dockerfile tf hcl proto cfg ini conf env".split()
    for name in [f"a.{x}" for x in listed] + ["B.TSX", "Dockerfile", "conf", "a.exe"]:
        (tmp_path / name).write_text("x")
    found = {r.path: r.language for r in files.scan(spark, str(tmp_path))[0].collect()}
    assert set(found) == {f"a.{x}" for x in listed} | {"B.TSX"}
    want = {"a.hpp": "C++", "B.TSX": "TypeScript", "a.gts": "Glimmer TypeScript", "a.erb": "ERB", "a.plist": "XML", "a.scss": "CSS", "a.ejs": "Template", "a.cmd": "Batch", "a.hcl": "Terraform", "a.proto": "Protocol Buffers", "a.ini": "Config", "a.kts": "Kotlin"}
    assert {k: found[k] for k in want} == want


def test_built_in_audits(spark):
    texts = ["func f() -> (" + "a: Int, " * 12 + "b: Int) {", "func f() -> (Int, Int)", "a { b { c { d { e } } } }", "{}{}{}{}", "{{{{{{{{ } {{{{", "{ { { x } {"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = {(r.id, r.pattern): r.n for r in structure.audit(rows, "id", "text").collect()}
    assert found == {(0, "large_tuple"): 1, (2, "nested_closure"): 1, (4, "nested_closure"): 2}
    for t in texts:
        assert [m.span() for m in re.finditer(r"\{[^}]*\{[^}]*\{[^}]*\{", t)] == [m.span() for m in re.finditer(structure.AUDITS["nested_closure"], t)]


@pytest.mark.parametrize(
    "text, language, want",
    [
        ('let url = "http://example.com/path"\nlet other = "https://a.b//c"', "Swift", (0, 2, 0, False)),
        ("# def old_method(arg)\n#   value = compute(arg)\n# end\ndef new_method; end", "Ruby", (3, 1, 3, True)),
        ("// model = candidate\n// priority = 3\nrun()", "Swift", (2, 1, 2, True)),
        ("=begin\nold_call(1)\n=end\nrun", "Ruby", (3, 1, 3, True)),
        ("let a = 1 /* from here\nto here */\nlet b = 2", "Swift", (1, 2, 1, False)),
        ("/* a */ let x = 1", "Swift", (0, 1, 0, False)),
        ("/* a */\n\n/* b */", "Swift", (2, 0, 1, False)),
        ('"""\nDoc of this.\n"""\nx = 1', "Python", (3, 1, 3, False)),
        ("{{!-- a --}}\n<b>{{x}}</b>", "Handlebars", (1, 1, 1, False)),
        ("<%# a %>\n<!-- b\n-->\n<p>", "ERB", (3, 1, 3, False)),
        ("/// public func foo(a: Int)\nlet x = 1", "Swift", (1, 1, 1, True)),
        ("// TODO: foo(bar)\n// if the peer drops, retry.", "Swift", (2, 0, 2, False)),
        ("", "Swift", (0, 0, 0, False)),
    ],
)
def test_comment_structure(text, language, want):
    assert structure.metrics(text, language) == want


@pytest.mark.parametrize(
    "body, want",
    [
        ("let x = store.lookup(key)", "strong"), ("return value", "weak"), ("subsystem: \"com.x\",", "weak"), ("let logger = Logger(", "weak"), ("case idle", "weak"), ("Case sensitivity matters", None),
        ("x" * 401 + "()", None), ("if (a > b) {", "strong"), ("from a.b import c", "strong"), ("from the start of it", None), ("@objc", "strong"), ("Settings (opens a window)", None), ("extension Foo {", "strong"),
        ("private static func run(", "strong"), ("import Foundation", "strong"), ("],", None), ("end of it", None), ("note: f(x)", None), ("while x do", "weak"), ("\"device.assign\",", "weak"),
    ],
)
def test_likelihood_rules(body, want):
    assert structure.likelihood(body) == want


def test_structure_store(spark):
    files_ = {"Abandoned.swift": "// func old(a: Int) {\n//   run(a)\n//   stop()\n// }\nlet x = 1", "Clean.swift": "/// Says what it does.\nfunc f() {}", "Heavy.swift": "// a\n// b\n// c\n// d\n// e\nlet x = 1", "Light.swift": "let a = 1\nlet b = 1\nlet c = 1\nlet d = 1", "README.md": "# x"}
    rows = spark.createDataFrame([(k, v, "Swift" if k.endswith("swift") else "Markdown", None) for k, v in files_.items()], "path string, text string, language string, comment_lines int")
    m = structure.measure(rows, "path", "text", "language")
    assert [r.path for r in structure.structural(m, "path", commented_out=True).collect()] == ["Abandoned.swift"]
    assert [r.path for r in structure.structural(m, "path", 0.5, lines=6).collect()] == ["Heavy.swift"]
    assert structure.unmeasured(m).first()[0] == 1
    done, counts = structure.backfill(rows, "path", "text", "language", 3)
    assert done.count() == 3 and tuple(counts.first()) == (3, 0, 2)


def test_concurrency_audit(spark):
    io = "let d = JSONEncoder()"
    texts = [(1, f"@MainActor public final class A {{ {io} }}", "class"), (2, "@MainActor class A {}", "class"), (3, "await MainActor.run { Task { f() } }", None), (4, f"@MainActor func f() {{ {io} }}", "function"), (5, f"nonisolated func f() {{ MainActor; {io} }}", "method"), (6, "for p in peers { p.send(x) }", None), (7, io, "function")]
    rows = spark.createDataFrame([(k, t, "Swift", c) for k, t, c in texts], "id int, text string, language string, construct string")
    found = {(r.id, r.pattern) for r in structure.audit_concurrency(rows, "id", "text", "language", "construct").collect()}
    assert found == {(1, "main_actor_io"), (3, "task_in_main_run"), (4, "nonisolated_candidate"), (6, "broadcast_loop")}


def test_audit_limit_and_anchors(spark):
    rows = spark.createDataFrame([(1, "a\nb"), (2, "b\na\na")], "id int, text string")
    found = structure.audit(rows, "id", "text", {"x": "^a$", "bad": "(", "y": "^b"}, 3).collect()
    assert [(r.id, r.pattern, r.n) for r in found] == [(1, "x", 1), (1, "y", 1), (2, "x", 2)]


def test_knn_runs_once(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    plan = knn.search(rows, [1.0, 0.0], distance=("<", 0.5))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_brute_force_and_similar(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in knn.brute_force(rows, [1.0, 0.0], 5, -1.0).collect()] == [1, 2, 3, 4]
    assert [r.vec_id for r in knn.similar(rows, [1.0, 0.0], 1, 0.5, F.col("vec_id") == 1).collect()] == [2]
    assert [r.vec_id for r in knn.similar(rows, [1.0, 0.0], 3, 0.5).collect()] == [1, 2]


def test_vector_columns(spark):
    rows = spark.createDataFrame([([100, -100], [100, -100], bytearray([0b10000001, 2]))], "a array<tinyint>, b array<tinyint>, bits binary")
    got = rows.select(V.vec_add("a", "b", "int8"), V.vec_sub("a", "b", "int8"), V.vec_distance_l1("a", "b", "int8")).first()
    assert tuple(got) == ([-56, 56], [0, 0], 0)
    assert [r[1] for r in rows.select(V.vec_each("bits", "bit")).collect()] == [1, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 1, 0]
    blobs = spark.createDataFrame([(bytearray(b"\0\0\x80?"),), (bytearray(b"abc"),), (None,)], "b binary")
    assert [r[0] for r in blobs.select(V.decode_vector("b")).collect()] == [[1.0], None, None]
    with pytest.raises(Exception):
        rows.select(V.vec_distance_l2("a", F.array(F.lit(1)))).collect()
    assert "loam" in rows.select(V.vec_debug()).first()[0]


def test_function_providers(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(["aa", "bad", "cccc", None, "aa"])], "chunk_id long, text string")

    def embed(texts):
        if "bad" in texts:
            raise ValueError("no")
        return [[float(len(t)), 1.0] for t in texts]

    own = providers.FunctionEmbedding(embed, 2, "len")
    cache = spark.createDataFrame([], "text_hash string, embedding array<float>")
    found, full = providers.embed_chunks(rows, cache, own)
    assert {r.chunk_id: r.embedding for r in found.collect()} == {0: [2.0, 1.0], 2: [4.0, 1.0], 4: [2.0, 1.0]} and full.count() == 2
    analyzer = providers.FunctionAnalyzer(lambda t: (t.upper(), [t]) if t != "bad" else 1 / 0, "up")
    open_ = rows.withColumn("analyzer_model", F.lit(None).cast("string"))
    got = {r.chunk_id: (r.summary, r.analyzer_model) for r in providers.analyze_chunks(open_, analyzer).collect()}
    assert got[0] == ("AA", "up") and got[1] == (store.FAILED_SUMMARY, analytics.FAILED)
    assert providers.search_text(rows, "bad", own, knn.search).count() == 0


def test_embedding_dimensions_are_checked(spark):
    old = spark.createDataFrame([("a", [1.0])], "chunk_id string, embedding array<float>")
    for bad in ([], [1.0, 2.0], None):
        with pytest.raises(Exception):
            store.upsert_embeddings(old, spark.createDataFrame([("b", bad)], old.schema), 1).collect()
    assert store.upsert_embeddings(old, spark.createDataFrame([("b", [1.0, 2.0])], old.schema), 0).count() == 2


def test_hybrid_chunks_and_failures(spark):
    good = "import os\n\n@x\ndef f():\n    pass\n\nclass A:\n    def g(self):\n        pass\n"
    rows = spark.createDataFrame([("a.py", good, "Python"), ("b.py", "def (", "Python"), ("c.txt", "x", "Text"), ("d.py", "x = 1", "Python")], "path string, text string, language string")
    found = chunking.hybrid(rows)
    got = {(r.path, r.start_line, r.end_line, r.construct_name, r.error) for r in found.collect()}
    assert got == {("a.py", 3, 5, "f", None), ("a.py", 7, 9, "A", None), ("a.py", 8, 9, "A.g", None), ("b.py", 1, 1, None, "parse"), ("c.txt", 1, 1, None, None), ("d.py", 1, 1, None, "empty")}
    hashed = rows.select("path", chunking.file_hash(F.col("text")).alias("hash"), "language")
    known = chunking.track_failures(spark.createDataFrame([("a.py", "old", "parse", "Python", 1), ("z.py", "h", "timeout", "Python", 1)], "path string, hash string, kind string, language string, at int"), hashed, found, F.lit(2))
    assert {(r.path, r.kind, r["at"]) for r in known.collect()} == {("b.py", "parse", 2), ("d.py", "empty", 2), ("z.py", "timeout", 1)}
    again = {r.path: r.error for r in chunking.hybrid(rows, known).where("path = 'b.py'").collect()}
    assert again == {"b.py": None}


def _chunked(text, most, overlap, least, back):
    """Windows by the rule, written out for one text."""
    lines, out, start = text.split("\n"), [], 0
    while True:
        end = min(len(lines), start + most)
        if end < len(lines):
            cut = [i for i in range(max(start + least, end - back), end) if lines[i].strip(" \t\xa0").startswith(chunking._STARTS)]
            blank = [i + 1 for i in range(max(start + least, end - back), end) if not lines[i].strip(" \t\xa0") and lines[i + 1].strip(" \t\xa0").startswith(chunking._AFTER_BLANK)]
            end = max(cut + blank, default=end)
        out.append((start + 1, end, "\n".join(lines[start:end])))
        if end == len(lines):
            return out
        start = end - overlap


def test_line_chunks():
    import random

    rng = random.Random(2)
    for _ in range(40):
        text = "\n".join(rng.choice(["x = 1", "", "  func f() {", "// MARK: - a", "class A {", "## head", "funcs", "// note", "}"]) for _ in range(rng.randrange(1, 500)))
        assert list(chunking.line_chunks(text)) == _chunked(text, 120, 5, 20, 30)
    assert list(chunking.line_chunks("")) == [(1, 1, "")]


def test_resolve_repo_and_remap(spark):
    rows = spark.createDataFrame([("r1", "alpha", "/orig/alpha", "github.com/x/alpha"), ("r2", "b", "/a/beta", "host/b"), ("r3", "b", "/b/beta", "host/b"), ("r4", "b", "/c/gamma", "host/b")], "repo_id string, name string, root_path string, repo_identifier string")
    resolve = lambda path, remote=None: [r.repo_id for r in store.resolve_repo(rows, path, remote).collect()]
    assert resolve("/orig/alpha") == ["r1"] and resolve("/other/alpha", "github.com/x/alpha") == ["r1"]
    assert resolve("/other/beta", "host/b") == [] and resolve("/other/gamma", "host/b") == ["r4"] and resolve("/none") == []
    assert store.remap_root(rows, "r1", "/moved/alpha").where("root_path = '/orig/alpha'").count() == 1
    assert store.remap_root(rows, "r1", "/moved/alpha", True).where("root_path = '/moved/alpha'").count() == 1


def test_lessons_by_origin(spark):
    rows = spark.createDataFrame([(1, "Bound batches by bytes", "a"), (2, "Bound batches by bytes, not item count", "b")], "id int, fix_description string, source_learning_id string")
    left, n = store.delete_lessons(rows, F.col("source_learning_id") == "a")
    assert [r.id for r in left.collect()] == [2] and n.first()[0] == 1
    assert store.delete_lessons(rows, F.col("source_learning_id") == "zz")[1].first()[0] == 0


def test_store_status(spark):
    ok = {n: spark.createDataFrame([], ", ".join(f"{c} string" for c in cols)) for n, cols in store.TABLES.items()}
    assert store.status(ok, 3, 3)["usable"] and not store.status(ok, 2, 3)["usable"]
    assert store.status({"repos": ok["repos"].drop("name")}, 3, 3)["lacking"] == {"repos": ["name"]}
    assert store.scalar(ok["repos"]) == 0 and store.has_column(ok["repos"], "name")


def test_import_candidates(spark):
    rows = spark.createDataFrame([("../x/./y", "a/b.ts"), ("A::B", "a.rb"), ("pkg/mod", "a.ts"), ("Foo", "a.swift")], "target string, source string")
    got = [r[0] for r in rows.select(graph.import_candidates(F.col("target"), F.col("source"))).collect()]
    assert got[0][:2] == ["a/x/y", "a/x/y.swift"] and "app/models/a/b.rb" in got[1] and "addons/pkg/src/mod/index.gts" in got[2] and "pkg/app/mod.js" in got[2]
    assert got[3][0] == "Foo" and got[3][1] == "Foo.swift" and "Sources/Foo/index.tsx" in got[3]


def test_orphan_paths(spark):
    paths = ["FooTests.swift", "a_test.rb", "test.rb", "Tests/x.rb", "main.js", "src/main.js", "MyApp.swift", "lib/x.swift", "x.spec.ts"]
    rows = spark.createDataFrame([(k, "r", p, k) for k, p in enumerate(paths)], "file_id long, repo_id string, path string, lines long")
    none = spark.createDataFrame([], "source long, target_file long, target string, kind string")
    symbols = spark.createDataFrame([(7, "n", "class"), (5, "m", "class")], "file_id long, name string, kind string")
    refs = spark.createDataFrame([(7, "n"), (1, "m")], "file_id long, name string")
    assert [r.path for r in graph.unreferenced(rows, none, symbols, refs).collect()] == ["lib/x.swift", "test.rb"]
    assert graph.unreferenced(rows, none, symbols, refs, True, True).count() == 8


def test_source_helpers(spark, tmp_path):
    assert files.relative("/private/var/a/b", "/var/a/") == "b" and files.relative("/x/y", "/a") == "/x/y"
    found, own = (spark.createDataFrame([(x,) for x in v], f"{c} string") for v, c in ((["/ws/a", "/ws/b"], "repo"), (["/ws/a"], "root_path")))
    assert [r.repo for r in files.excluded_roots(found, own, False, True).collect()] == ["/ws/a"]
    assert files.excluded_roots(found, own, True, True).count() == 2
    paths = spark.createDataFrame([("a/Cargo.toml",), ("b/go.mod",), ("go.mod",)], "path string")
    assert [r.package for r in files.packages(paths, git_roots=spark.createDataFrame([("a",)], "repo string")).collect()] == ["b"]
    import json

    import numpy as np

    np.save(tmp_path / "v.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    assert [tuple(r) for r in files.npy_vectors(spark, str(tmp_path / "v.npy")).orderBy("pos").collect()] == [(0, [0.0, 1.0]), (1, [2.0, 3.0]), (2, [4.0, 5.0])]
    (tmp_path / "f.json").write_text(json.dumps([{"path": "a", "kind": "parse", "at": "2"}, {"path": "b", "at": "3"}]))
    assert [r.path for r in files.read_failures(spark, str(tmp_path / "f.json")).collect()] == ["b", "a"]
    for name in ("__init__.py", "x.min.js", "deep/er/y.py", "tmp/z.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1")
    assert sorted(r.path for r in files.scan(spark, str(tmp_path))[0].collect()) == ["__init__.py", "deep/er/y.py", "f.json"]


def test_identifiers(spark):
    a, b = spark.range(1).select(T.random_id(), T.now_text()).first()
    assert re.fullmatch("[0-9a-f]{32}", a) and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z", b)


def test_duplicates_rules(spark):
    rows = spark.createDataFrame([("A", "c", "x", 60, "s"), ("A", "c", "y", 70, None), ("A", "c", "y", 10, None), ("B", None, "x", 50, None), ("B", None, "y", 50, None), ("", "c", "x", 90, None), ("", "c", "y", 90, None), ("C", "c", "x", 30, None), ("C", "c", "x", 30, None), ("C", "c", "y", 30, None)], "construct_name string, construct_type string, path string, tokens long, summary string")
    got = [tuple(r) for r in analytics.duplicates(rows).collect()]
    assert got == [("A", "c", 2, 130, 65, "s", ["y", "x"]), ("B", None, 2, 100, 50, None, ["x", "y"])]


def test_prefix_path_itself_stays(spark):
    rows = spark.createDataFrame([("api",), ("api/x",)], "path string")
    assert [r.path for r in merge.delete_under(rows, "path", ["api"]).collect()] == ["api"]
