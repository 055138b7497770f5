import datetime as dt

from pyspark.sql import functions as F

from corpusloom.functions import classify as C
from corpusloom.functions import text as T
from corpusloom.operators import budget, compress, graph, imports, jobs, rank, report, resolve, running, scan
from corpusloom.plans.context import build_context


def files(spark, rows):
    df = spark.createDataFrame([(p, t, i) for i, (p, t) in enumerate(rows)], "relative_path string, text string, scan_ord long")
    return df.withColumn("language", C.language_of("relative_path"))


def edges_of(spark, rows):
    f = files(spark, rows)
    return {(r.src, r.dst) for r in resolve.edges(imports.imports(f, []), f, []).collect()}


def test_suffix_and_language(spark):
    rows = spark.createDataFrame([("a/.gitignore",), ("a.tar.gz",), ("x/Dockerfile",), ("go.sum",), ("m.TSX",), ("a.",), (None,)], "p string")
    got = [tuple(r) for r in rows.select(C.suffix_of("p"), C.language_of("p"), C.category_of("p")).collect()]
    assert got == [("", "unknown", "asset"), ("gz", "unknown", "asset"), ("", "dockerfile", "config_data"), ("sum", "go", "config_data"), ("tsx", "typescript", "source_code"), ("", "unknown", "asset"), (None, None, None)]


def test_edges_python_typescript(spark):
    rows = [("src/app.py", "from .db import x\nimport os"), ("src/db.py", "y = 1"), ("web/index.ts", "import { a } from './client'"), ("web/client.ts", "")]
    assert edges_of(spark, rows) == {("src/app.py", "src/db.py"), ("web/index.ts", "web/client.ts")}


def test_edges_other_languages(spark):
    rows = [
        ("web/setup.ts", "import './client'\nexport * from './shared'"), ("web/client.ts", ""), ("web/shared.ts", None),
        ("cmd/server/main.go", 'import (\n  "x.example/p/internal/db"\n)'), ("internal/db/db.go", "package db"), ("src/lib.rs", "mod storage;"), ("src/storage.rs", ""),
    ]
    assert edges_of(spark, rows) == {("web/setup.ts", "web/client.ts"), ("web/setup.ts", "web/shared.ts"), ("cmd/server/main.go", "internal/db/db.go"), ("src/lib.rs", "src/storage.rs")}


def test_edges_across_languages_and_unresolved_parents(spark):
    rows = [("app/src/main/kotlin/A.kt", "import com.x.B"), ("app/src/main/java/com/x/B.java", ""), ("web/a.ts", "import x from '../client'"), ("client.ts", "")]
    assert edges_of(spark, rows) == {("app/src/main/kotlin/A.kt", "app/src/main/java/com/x/B.java")}


def test_empty_and_broken_imports(spark):
    assert edges_of(spark, []) == set()
    assert edges_of(spark, [("a.py", "def ("), ("b.py", None), ("c.bin", "import x")]) == set()


def ranks(spark, rows, task):
    f = files(spark, rows)
    e = resolve.edges(imports.imports(f, []), f, [])
    r = rank.ranked(f.select("relative_path", "text", "scan_ord"), e, [], T.terms(F.lit(task)))
    return {x.relative_path: x for x in r.collect()}


def test_hub_ranking(spark):
    rows = [("src/app.py", "import core\n# billing workflow"), ("src/cli.py", "import core"), ("src/worker.py", "import core"), ("src/core.py", "x = 1"), ("lib/sidebar.py", "y = 2")]
    rows = [(p, t.replace("import core", "from .core import x") if t else t) for p, t in rows]
    got = ranks(spark, rows, "billing workflow")
    assert got["src/app.py"].priority == "HIGH" and got["src/core.py"].priority == "HIGH"
    assert "lib/sidebar.py" not in got
    assert got["src/cli.py"].graph_distance == 2


def test_config_cap_and_large_files(spark):
    rows = [("lib/app.py", "checkout flow checkout"), ("package.json", "checkout"), ("lib/gen.py", "x = 1\n" * 4000)]
    got = ranks(spark, rows, "checkout flow")
    assert got["package.json"].priority != "HIGH" and got["lib/app.py"].priority == "HIGH" and "lib/gen.py" not in got


def test_fallback_seed_is_the_first_file(spark):
    got = ranks(spark, [("a/x.py", "q"), ("a/y.py", "r")], "nothing matches here zzz")
    assert got["a/x.py"].graph_distance == 0 and set(got) == {"a/x.py"}


def test_distances_by_brute_force(spark):
    pairs = [(f"n{i}", f"n{(i * 7 + 3) % 40}") for i in range(40)] + [("n1", "n1"), ("n1", "n1")]
    e = spark.createDataFrame(pairs, "src string, dst string")
    s = spark.createDataFrame([("n0",), ("n0",)], "node string")
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want, front, d = {"n0": 0}, {"n0"}, 0
    while front:
        d += 1
        front = {y for x in front for y in near[x]} - set(want)
        want.update(dict.fromkeys(front, d))
    assert {r.node: r.distance for r in graph.distances(e, s, []).collect()} == want


def test_running_numbers_match_a_window(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * 37 % 101).alias("v"), "id")
    got = {r.id: (r.n, r.s) for r in running.running(df, ["g"], [F.col("v").asc(), F.col("id").asc()], {"s": F.col("v")}, number="n").collect()}
    for g in range(3):
        total = 0
        for n, (v, i) in enumerate(sorted((i * 37 % 101, i) for i in range(500) if i % 3 == g), 1):
            total += v
            assert got[i] == (n, total)


def apart(spark, text, language):
    return compress.parts(spark.createDataFrame([(1, text, language)], "id long, text string, language string"), ["id"])


def test_strip_and_skeleton(spark):
    (c,) = apart(spark, 'int a; // x\n/* b */\nchar *s = "// \\" no"; # y\n\n#define X 1\n', "c").collect()
    assert c.stripped == 'int a;\nchar *s = "// \\" no";\n#define X 1' and c.lines == c.stripped.split("\n") and c.skeleton == compress.HIDDEN
    assert compress.strip_python("x = 1  # c\n\n# d\ny = '#'\n") == "x = 1\ny = '#'"
    (k,) = apart(spark, "/* fun old() {\n */ class A {\n  fun b(c: Int): Int {\n    return 1 // }\n  }\n}", "kotlin").collect()
    assert k.skeleton == "class A {\n  [implementation hidden]\n}\n  fun b(c: Int): Int {\n    [implementation hidden]\n  }".replace("class", " class").replace("\n  [implementation hidden]\n}\n", "\n   [implementation hidden]\n }\n", 1)
    (p,) = apart(spark, 'def f(a):\n    """doc"""\n    return a', "python").collect()
    assert p.skeleton == 'def f(a):\n    """doc"""\n    [implementation hidden]'
    assert apart(spark, "", "go").collect()[0].skeleton == compress.HIDDEN and apart(spark, None, "go").count() == apart(spark, None, "python").count() == 0
    (z,) = apart(spark, "pub const W = struct {\n    x: u8,\n};\npub fn draw(w: W) void {\n    go();\n}\n", "unknown").collect()
    assert [(d.kind, d.n, d.last_n) for d in z.declarations] == [("class", 0, 0), ("function", 3, 5)]


def test_snippet_keeps_matching_declarations(spark):
    text = "class Main {\n" + "".join(f"  fun step{i}() {{\n    work({i})\n  }}\n" for i in range(30)) + "  fun navigate() {\n    go()\n  }\n}"
    words = F.array(F.lit("navigate"))
    (out,) = apart(spark, text, "kotlin").withColumn("pieces", compress.pieces(words)).select(compress.snippet(20).alias("s"), compress.snippet(2).alias("t")).collect()
    assert out.s == "  fun navigate() {\n    go()\n  }" and out.t == "  fun navigate() {\n..."
    (py,) = apart(spark, "class A:\n" + "".join(f"    def step{i}(self):\n        return {i}\n" for i in range(30)) + "    def navigate(self):\n        return 0\n", "python").withColumn("pieces", compress.pieces(words)).select(compress.snippet(20).alias("s")).collect()
    assert py.s == "    def navigate(self):\n        return 0"


def test_very_long_lines_and_escapes(spark):
    (r,) = apart(spark, 'x = "' + '\\"a' * 200_000 + '" // y\n' + "{" * 5000, "javascript").collect()
    assert r.stripped.endswith("{") and "// y" not in r.stripped


def test_declarations_have_offsets(spark):
    text = "x = 1\ndef f(a):\n    return a\n\nclass B:\n    pass\n"
    java = "class A {\n\tint f(int a) {\n\t\tif (a > 1) { return 2; } else {\n\t\t\treturn 3;\n\t\t}\n\t}\n\tint g()\n\t{\n\t}\n\tint h() { return 1; }\n}\n"
    rows = spark.createDataFrame([(1, text, "python"), (2, java, "java"), (3, "def (", "python")], "id long, text string, language string")
    d = sorted(compress.declaration_rows(rows, ["id"]).collect(), key=lambda r: (r.id, r.start_line))
    assert [(r.kind, r.start_line, r.end_line, r.signature) for r in d if r.id == 1] == [("function", 1, 2, "def f(a):"), ("class", 4, 4, "class B:")]
    assert text[d[0].start_offset : d[0].end_offset] == "def f(a):\n    return a\n"
    assert [(r.kind, r.start_line, r.end_line) for r in d if r.id == 2] == [("class", 0, 0), ("function", 1, 5), ("function", 6, 8), ("function", 9, 9)]
    assert java[d[3].start_offset : d[3].end_offset] == java[java.index("\tint f") : java.index("\n\tint g")]


def test_names_are_normalised_and_deduplicated(spark):
    rows = [(1, 10, 0, "a\\b.py", "x"), (1, 11, 1, "./a//b.py", "y"), (1, 12, 2, "..", None), (1, 13, 3, "build/x.py", "z"), (1, 14, 4, None, "w")]
    up = spark.createDataFrame(rows, "request_id long, input_id long, file_ord int, name string, content string")
    got = {r.input_id: (r.relative_path, r.text) for r in scan.request_files(up).collect()}
    assert got == {10: ("a/b.py", "x"), 11: ("a/b_2.py", "y"), 12: ("snippet_3.txt", ""), 14: ("snippet_5.txt", "w")}


def test_directory_scan(spark, tmp_path):
    for name, data in {"app.py": b"x", "skip.py": b"y", "out/a.py": b"z", "n.log": b"l", "__init__.py": b"", "b.py": b"\0", "build/c.py": b"c", "tests/t.py": b"t", "l.py": "é".encode("latin-1")}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(data)
    (tmp_path / ".gitignore").write_text("# c\nskip.py\nout/\n*.log\n")
    got = {r.relative_path for r in scan.scan_directory(spark, str(tmp_path), include_tests=False).collect()}
    assert got == {".gitignore", "app.py", "__init__.py", "l.py"}


def test_documents_fit_and_tokens_add_up(spark):
    body = "\n".join(f"def billing_{i}(x):\n    total = x + {i}\n    return total" for i in range(60))
    rows = spark.createDataFrame([(f"src/feature_{i}.py", body) for i in range(4)], "relative_path string, text string")
    for limit in (8000, 600, 120, 40, 5):
        r = build_context(spark, rows, "billing", limit).documents.collect()
        assert len(r) == 1 and r[0].tokens <= limit
        assert len(r[0].markdown.split()) == r[0].tokens
        assert (r[0].compression_warning is None) == (limit == 8000 and "FullCode" in r[0].markdown)


def test_medium_files_fill_the_budget(spark):
    rows = [("src/app.py", "from .core import a\n# checkout")] + [(f"lib/m{i}.kt", "import x.Y\n" + "\n".join(f"val checkout_{j} = {j}" for j in range(100))) for i in range(0)]
    rows += [("src/core.py", "\n".join(f"v{j} = {j}" for j in range(300)))]
    r = build_context(spark, spark.createDataFrame(rows, "relative_path string, text string"), "checkout", 4000)
    assert r.documents.collect()[0].tokens <= 4000 and r.choice.collect()[0].rung == 1


def test_jobs_fold(spark):
    t = dt.datetime(2025, 1, 1)
    row = lambda i, s, st, p, res=None, err=None: (i, "j", t + dt.timedelta(seconds=s), st, p, "m", "c", res, err)
    rows = [row(1, 0, "queued", 0), row(3, 9, "RUNNING", 140, "{}"), row(2, 5, "running", -4), row(4, 9, "running", 140, "{}"), row(5, 12, "completed", 100), row(6, 20, "running", 1)]
    e = spark.createDataFrame(rows, "event_id long, job_id string, ts timestamp, status string, progress int, message string, message_code string, result_json string, error string")
    last = jobs.latest(e).collect()[0]
    assert (last.status, last.progress, last.result_json) == ("running", 1, "{}")
    assert [r.event_id for r in jobs.emissions(e).orderBy("ts").collect()] == [1, 2, 3, 5]
    assert jobs.expired(jobs.latest(e), F.lit(t + dt.timedelta(hours=1))).collect()[0].status == "failed"
    assert [r.n_events for r in jobs.silences(e, 6).orderBy("started").collect()] == [4, 1]
    assert jobs.latest(e.limit(0)).count() == 0


def test_reports(spark):
    md = "#### `a.py`\n\n- x\n\n```python\nx = 1\n```\n\n---\n#### `b.go`\n\n```go\ny\nz\n```\n"
    got = report.blocks(spark.createDataFrame([(1, md), (2, None), (3, "")], "id long, m string"), "id", "m").collect()
    assert [(r.path, r.language, r.content) for r in got] == [("a.py", "python", "x = 1"), ("b.go", "go", "y\nz")]
    old, new = spark.createDataFrame([(1, "a\nb"), (2, "")], "k int, text string"), spark.createDataFrame([(1, "a\nc\nd"), (2, "q")], "k int, text string")
    assert [r.changed for r in report.line_changes(old, new, ["k"]).orderBy("k", "line_no").collect()] == [False, True, True, False]


def test_limits_and_locales(spark):
    r = spark.createDataFrame([("8k",), ("1M",), (" 500 ",), ("x",), ("",), (None,)], "t string").select(T.parse_limit("t")).collect()
    assert [x[0] for x in r] == [8000, 1_000_000, 500, None, None, None]
    rows = spark.createDataFrame([(1, "t", 0, "EN-us"), (2, "t", None, None), (3, "t", 2_000_000, "fr")], "request_id long, task string, token_limit int, locale string")
    assert [(x.limit, x.loc) for x in budget.limits(rows).orderBy("request_id").collect()] == [(None, "en"), (8000, "en"), (None, "en")]


def test_hot_keys_are_salted_alike(spark):
    from corpusloom.sources import tables

    left = spark.range(300).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hub").otherwise(F.col("id").cast("string")).alias("k"), F.lit(1).alias("v"))
    right = spark.createDataFrame([("hub", 7), ("1", 8), ("none", 9)], "k string, w int")
    want = sorted(tuple(r) for r in left.join(right, "k", "left").select("id", "w").collect())
    assert sorted(tuple(r) for r in tables.lookup(left, right, ["k"], width=1 << 40, salt="id").select("id", "w").collect()) == want
    parts = tables.salted(left, right, ["k"], ["id"], 8).where("k = 'hub'")
    assert parts.count() == 100


def test_settings_links(spark):
    from corpusloom.functions import links

    rows = [("fix é/+?", 2.6, "ru"), (None, None, None), ("x", 9e9, "xx")]
    r = spark.createDataFrame(rows, "t string, n double, l string").select(links.packed(F.col("t"), F.col("n"), F.col("l")).alias("k"))
    got = [tuple(x.v) for x in r.select(links.unpacked(F.col("k")).alias("v")).collect()]
    assert got == [("fix é/+?", 3, "ru"), ("", 8000, "en"), ("x", 1_000_000, "en")]
    bad = spark.createDataFrame([("",), ("a",), ("!!",), ("bm9uZQ",), (None,)], "k string")
    assert [x.v for x in bad.select(links.unpacked(F.col("k")).alias("v")).collect()] == [None] * 5


def test_feedback_and_created_jobs(spark):
    meta = {f"k{i:02}": "v" * 2000 for i in range(20)} | {"a": "", "b": None}
    rows = [("positive", " hi ", meta), ("other", "x", {}), ("negative", "  ", None), ("negative", "y" * 5000, None)]
    got = report.feedback(spark.createDataFrame(rows, "kind string, message string, metadata map<string,string>")).collect()
    assert [(r.kind, len(r.message), sorted(r.metadata), {len(v) for v in r.metadata.values()}) for r in got] == [("positive", 2, [f"k{i:02}" for i in range(12)], {1024}), ("negative", 4096, [], set())]
    made = jobs.created(spark.createDataFrame([(5, dt.datetime(2025, 1, 1)), (5, dt.datetime(2025, 1, 1))], "request_id long, created_at timestamp")).collect()
    assert [(r.job_id, r.status, r.progress, r.message_code) for r in made] == [("job-5", "queued", 0, "jobQueued")]


def test_results_with_nodes_and_edges(spark):
    f = files(spark, [("src/app.py", "import src.db\n# billing\n"), ("src/db.py", "x = 1\n")])
    c = build_context(spark, f.select("relative_path", "text"), "billing workflow", 8000)
    (r,) = c.results().collect()
    assert [n.id for n in r.nodes][0] == "src/app.py" and r.priority_counts["HIGH"] >= 1 and [tuple(e) for e in r.edges] == [("src/app.py", "src/db.py")]
    (m,) = c.metrics().collect()
    assert m.files_kept == len(r.nodes) and m.limit == 8000 and m.tokens == r.tokens
    back = report.from_response(report.to_response(c.results().drop("nodes", "edges").withColumn("files_scanned", F.lit(2).cast("long")))).collect()
    assert back[0].markdown == r.markdown
