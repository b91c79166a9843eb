"""Tool texts, readers and writers."""

import json

from pyspark.sql import functions as F
from shapes import STATION

from coppice.operators import history, markers
from coppice.sinks import report
from coppice.sources import gittext, trees
from coppice.streaming import recount as stream


def test_log_text(spark):
    log = (
        "\x01aaaa1111\x022 days ago\x02an\x02update: it\x03\nsub/README.md\nsub/src/cli.rs\n\n"
        "\x01broken header\x03\nlost.txt\n"
        "\x01bbbb2222\x0210 days ago\x02an\x02root\x02more\x03\r\nREADME.md\r\nsub\\README.md\n"
    )
    commits, touched = gittext.parse_log(spark.createDataFrame([("r", log)], "repo string, text string"))
    got = {(r["seq"], r["hash"], r["date"], r["subject"]) for r in commits.collect()}
    assert got == {(0, "aaaa111", "2 days ago", "update: it"), (2, "bbbb222", "10 days ago", "root\x02more")}
    assert sorted((r["seq"], r["path"]) for r in touched.collect()) == [
        (0, "sub/README.md"), (0, "sub/src/cli.rs"), (2, "README.md"), (2, "sub/README.md"),
    ]
    last = {r["path"]: r["seq"] for r in history.last_commits(commits, touched).collect()}
    assert last == {"sub/README.md": 0, "sub/src/cli.rs": 0, "README.md": 2}
    below = gittext.below_prefix(touched, "sub/")
    assert sorted(r["path"] for r in history.churn(below).collect()) == ["README.md", "src/cli.rs"]


def test_status_and_diff_text(spark):
    status = " M a.txt\x00R  README.md\x00Renamed from\x00?? new/\x00A\x00RM x\\y\x00old\x00"
    got = gittext.parse_status(spark.createDataFrame([("r", status)], "repo string, text string"))
    assert {(r["path"], r["xy"]) for r in got.collect()} == {("a.txt", " M"), ("README.md", "R "), ("new/", "??"), ("x/y", "RM")}
    diff = "M\x00a.txt\x00R100\x00old\x00new\x00D\x00gone\x00A\x00b\x00C75\x00half"
    changes = gittext.parse_diff(spark.createDataFrame([("r", diff)], "repo string, text string"))
    assert {(r["path"], r["status"]) for r in changes.collect()} == {("a.txt", "M"), ("new", "R"), ("gone", "D"), ("b", "A")}
    marks = {r["path"]: r["mark"] for r in history.since_marks(changes, got).collect()}
    assert marks == {"a.txt": "M", "new": "R", "b": "A", "README.md": "M", "new/": "A", "x/y": "M"}
    assert [r["path"] for r in history.deleted(changes).collect()] == ["gone"]


def test_directory_and_manifest_sources(spark, tmp_path):
    root = tmp_path / "tree"
    texts = {"a/b.txt": "one\n", "c.py": "x = 1\n", ".hidden": "1\n", "a/__init__.py": "", "_x/.y/_z/w.txt": "1\n2\n", "a/.git/HEAD": "ref\n"}
    for path, text in texts.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "_x/.empty").mkdir()
    (root / "a/link").symlink_to("../_x")
    (root / "gone").symlink_to("nowhere")
    files, bodies = trees.from_directory(spark, str(root), "disk")
    found = {r["path"]: r for r in files.collect()}
    assert {p: r["size"] for p, r in found.items() if r["kind"] == "file"} == {p: len(t) for p, t in texts.items()}
    assert {p for p, r in found.items() if r["kind"] == "dir"} == {"a", "a/.git", "_x", "_x/.y", "_x/.y/_z", "_x/.empty"}
    link, gone = found["a/link"], found["gone"]
    assert (link["kind"], link["link_target"], link["target_is_dir"]) == ("symlink", "_x", True)
    assert (gone["kind"], gone["link_target"], gone["size"]) == ("symlink", "nowhere", None)
    counts = {r["path"]: r["lines"] for r in trees.text_counts(bodies).collect()}
    assert counts == {p: t.count("\n") for p, t in texts.items()}
    assert "_x/.empty" in {r["path"] for r in trees.with_directories(files).collect()}

    manifest = {"repo": "m", "files": [{"path": "x/y/z.md", "content": "日本", "mtime": 5.0}], "now": 9.0}
    (tmp_path / "m.json").write_text(json.dumps(manifest, indent=1))
    files, contents = trees.from_manifests(trees.read_manifests(spark, str(tmp_path / "m.json")))
    assert {(r["path"], r["kind"], r["size"]) for r in files.collect()} == {
        ("", "dir", None), ("x", "dir", None), ("x/y", "dir", None), ("x/y/z.md", "file", 6),
    }
    assert contents.first()["text"] == "日本"


def test_read_texts(spark, tmp_path):
    (tmp_path / "shop.txt").write_text("\x01h\x02d\x02a\x02s\x03\nf\n")
    commits, _ = gittext.parse_log(gittext.read_texts(spark, str(tmp_path)))
    assert [(r["repo"], r["hash"]) for r in commits.collect()] == [("shop", "h")]


def test_writers(spark, forest, tmp_path):
    from coppice.operators import summary

    files, contents = forest({**STATION, 'odd,"name".txt': "x"})
    annotated = summary.annotate(files, counts=trees.text_counts(contents), todos=markers.scan(contents))
    report.write_report(report.file_report(annotated), str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.count() == len(STATION) + 1
    assert back.where(F.col("path") == 'odd,"name".txt').first()["lines"] == "1"

    report.write_nodes(report.nodes(trees.with_directories(files), max_depth=1), str(tmp_path / "json"))
    nodes = spark.read.json(str(tmp_path / "json"))
    assert nodes.where("path = 'web'").first()["truncated"] and nodes.where("depth > 1").count() == 0

    report.write_pack(report.pack(trees.bodies(contents)), str(tmp_path / "pack"))
    text = "\n".join(r["value"] for r in spark.read.option("recursiveFileLookup", "true").text(str(tmp_path / "pack")).collect())
    assert f"# pack — {len(STATION) + 1} files" in text and "## web/draw/axis.ts" in text and "```typescript" in text

    edges = spark.createDataFrame([("r", "head", "b", "a"), ("r", "head", "a", 'c"')], "repo string, snapshot string, src string, dst string")
    lines = [r["line"] for r in report.mermaid(edges).orderBy("section", "n", "m").collect()]
    assert lines == ["graph LR", '    n0["a"]', '    n1["c&quot;"]', '    n2["b"]', "    n0 --> n1", "    n2 --> n0"]
    report.write_lines(report.dot(edges), ["section", "src", "dst"], str(tmp_path / "dot"))
    dot = [r["value"] for r in spark.read.option("recursiveFileLookup", "true").text(str(tmp_path / "dot")).collect()]
    two = edges.unionByName(edges.withColumn("snapshot", F.lit("old")))
    report.write_lines(report.mermaid(two), ["section", "n", "m"], str(tmp_path / "both"))
    for snapshot in ("head", "old"):
        apart = [r["value"] for r in spark.read.text(str(tmp_path / "both" / "repo=r" / f"snapshot={snapshot}")).collect()]
        assert apart == lines
    assert set(dot) == {
        "digraph imports {", "    rankdir=LR;", "    node [shape=box, fontsize=10];", "}", '    "a" -> "c\\"";', '    "b" -> "a";',
    }


def test_counts_from_a_stream(spark, tmp_path):
    inventories, bodies, store = (str(tmp_path / n) for n in ("inventories", "bodies", "store"))

    def arrive(texts, mtime):
        rows = [("r", "head", p, t) for p, t in texts.items()]
        df = spark.createDataFrame(rows, "repo string, snapshot string, path string, text string")
        df.write.mode("overwrite").parquet(bodies)
        sized = df.select("repo", "snapshot", "path", F.octet_length("text").cast("long").alias("size"), F.lit(mtime).alias("mtime"))
        trees.inventory(sized).write.mode("append").parquet(inventories)
        stream.keep_counted(inventories, bodies, store, str(tmp_path / "state"), spark).awaitTermination()
        return stream.stored(spark, store)

    first = arrive({"a": "one\n", "b": "two\nlines"}, 1.0)
    assert {(r["path"], r["lines"]) for r in first.collect()} == {("a", 1), ("b", 2)}
    again = arrive({"a": "one\ntwo\n", "b": "two\nlines"}, 2.0)
    known = {("a", 1.0, 1), ("b", 1.0, 2), ("a", 2.0, 2), ("b", 2.0, 2)}
    assert {(r["path"], r["mtime"], r["lines"]) for r in again.collect()} == known
    # Another stream over the same inventories brings batch 0 again: nothing is lost, nothing counted twice.
    stream.keep_counted(inventories, bodies, store, str(tmp_path / "other"), spark).awaitTermination()
    assert sorted((r["path"], r["mtime"], r["lines"]) for r in stream.stored(spark, store).collect()) == sorted(known)


def test_log_records_over_many_tasks(spark, tmp_path):
    """One log cut into small splits gives the records that the whole text gives."""
    from coppice.sources import gittext

    said = ["a preamble\n", "", "\r"]
    for number, start in enumerate(said):
        records = [f"\x01{k:040}\x02day {k}\x02me\x02did {'x' * (k % 90)} \x01 it\x03\n\nsrc/{k}.py\nall\\{k % 7}\r\n" for k in range(300)]
        records[5] = "\x01too few fields\x03\nlost.py\n"
        text = start + "\n".join(records).replace("\n\x01" + "0" * 37 + "123", "\n\r\r\x01" + "0" * 37 + "123")
        (tmp_path / f"repo{number}.log").write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        read = gittext.read_log(spark, str(tmp_path))
        got = [sorted(map(tuple, df.collect())) for df in gittext.parse_records(read)]
        assert spark.read.text(str(tmp_path), lineSep="\n\x01").rdd.getNumPartitions() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    whole = gittext.parse_log(spark.createDataFrame([(f"repo{k}", (tmp_path / f"repo{k}.log").read_bytes().decode()) for k in range(3)], "repo string, text string"))
    assert got == [sorted(map(tuple, df.collect())) for df in whole]
    assert len(got[0]) == 3 * 299


def test_recount_reads_changed_buckets_only(spark, tmp_path):
    rows = [("r", f"d/f{k}.txt", "word " * k) for k in range(1, 200)]
    files, contents = trees.from_table(spark.createDataFrame(rows, "repo string, path string, text string"), "repo", "path", "text")
    files = files.where("kind = 'file'").withColumn("mtime", F.lit(1.0))
    bodies = trees.write_bucketed(contents, str(tmp_path / "bodies"))
    nothing = spark.createDataFrame([], trees.recount(files, contents, files.limit(0).selectExpr(
        "repo", "snapshot", "path", "size", "mtime", "'chars' AS method", "-1L AS read_limit", "1L AS tokens", "1L AS lines")).schema)
    prior = spark.createDataFrame(trees.recount(files, bodies, nothing).collect(), nothing.schema)
    later = files.withColumn("mtime", F.when(F.col("path") == "d/f7.txt", 2.0).otherwise(F.col("mtime")))
    again = trees.recount(later, bodies, prior)
    assert {(r.path, r.tokens, r.lines) for r in again.collect()} == {(r.path, r.tokens, r.lines) for r in prior.collect()}
    plan = again._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.split("\n") if "PartitionFilters: [" in line and "bucket" in line.split("PartitionFilters: [")[1].split("]")[0]]
    assert filters  # the buckets are folders, so unchanged ones are not listed for reading


def test_log_of_several_files(spark, tmp_path):
    """Records go on from file to file; what stands before a file's first mark is none."""
    from coppice.sources import gittext

    record = "\x01{0}\x02day\x02me\x02{0}\x03\n{0}.py\n"
    for name, lead, held in (("x-0", "", "ab"), ("x-1", "noise\n", "cd"), ("x-2", "", "e"), ("y-0", "noise\n", "f")):
        (tmp_path / f"{name}.txt").write_text(lead + "\n".join(record.format(c) for c in held))
    repo = F.regexp_extract("_metadata.file_name", "^(.)", 1)
    commits, touched = gittext.parse_records(gittext.read_log(spark, str(tmp_path), repo))
    want = [("x", 0, "a"), ("x", 1, "b"), ("x", 2, "c"), ("x", 3, "d"), ("x", 4, "e"), ("y", 0, "f")]
    assert sorted((r["repo"], r["seq"], r["subject"]) for r in commits.collect()) == want
    assert sorted((r["repo"], r["seq"], r["path"]) for r in touched.collect()) == [(a, n, f"{c}.py") for a, n, c in want]


def test_a_languages_log_is_written_by_several_tasks(spark, tmp_path):
    from pathlib import Path

    from coppice.plans import checked_graph

    rows = [(n, f"line {n}\nmore", "en") for n in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    folder = checked_graph._log_folder(spark, str(tmp_path))
    assert len(list(Path(folder.removeprefix("file:")).glob("lang=en/part-*.txt"))) > 1


def test_empty_lines_among_imports(spark, forest):
    """They are not moved, but for the one that ends a statement which a backslash carries on."""
    from coppice.operators import pysource

    text = "import a\n\n\n# said\n\nfrom b import (\n\n  c,  # d\n\n\n  e,\n)\n \t\n\nx = 1; import f\ny = \\;\n\n\nimport g\n"
    got = pysource.line_imports(forest({"m.py": text})[1]).orderBy("ord").collect()
    assert [(r["form"], r["spec"], r["names"]) for r in got] == [
        ("import", "a", None), ("from", "b", ["c", "e"]), ("import", "f", None), ("import", "g", None),
    ]
    moved = spark.createDataFrame([("a\n\n \t\n\nb\n",), ("a\\\n\n\nb",)], "t string")
    assert [r[0] for r in moved.select(F.regexp_replace("t", pysource.EMPTY_LINES, "\n")).collect()] == ["a\nb\n", "a\\\n\nb"]
