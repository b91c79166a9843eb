"""Whole reports over small trees, with results counted by hand."""

import pytest
from pyspark.sql import functions as F
from shapes import ALIASES, ORCHARD, ORDERS, STATION

from coppice.operators import diff, graph, imports, resolve, rollup, symbols, testsgap, visible
from coppice.plans.reports import Trees
from coppice.sources import trees


def paths_of(df, column="path"):
    return sorted(r[0] for r in df.select(column).collect())


def pairs(df):
    return sorted((r[0], r[1]) for r in df.select("src", "dst").collect())


@pytest.fixture(scope="module")
def station(forest):
    return Trees(*forest(STATION))


def test_totals(station):
    listed = station.listed.where("path <> ''")
    assert listed.where("kind = 'dir'").count() == 11
    assert listed.where("kind <> 'dir'").count() == 21
    marks = sorted((r["path"], r["line"], r["kind"]) for r in station.todos.collect())
    assert marks == [
        ("agent/queue/queue.go", 7, "TODO"), ("manage.py", 5, "TODO"), ("station/sensors/rain.py", 4, "FIXME"),
        ("station/units.py", 4, "HACK"), ("web/bin/wx.cjs", 4, "XXX"),
    ]
    hack = station.todos.where("kind = 'HACK'").first()["text"]
    assert len(hack) == 81 and hack.endswith("…")


def test_entries_configs_tests(station):
    assert paths_of(station.entries) == [
        "agent/cmd/poll/main.go", "docker-compose.yml", "manage.py", "web/bin/wx.cjs", "web/draw/index.ts", "web/start.mjs",
    ]
    assert paths_of(testsgap.config_files(station.listed)) == ["agent/go.mod", "docker-compose.yml", "requirements.txt"]
    assert paths_of(station.untested) == [
        "agent/cmd/poll/main.go", "agent/queue/queue.go", "manage.py", "station/__init__.py", "station/core.py",
        "station/sensors/__init__.py", "station/sensors/rain.py", "station/sensors/vane.py", "station/sensors/wind.py",
        "web/draw/index.ts",
    ]


def test_graph(station):
    sensors = "station/sensors/"
    assert pairs(station.edges) == sorted([
        ("manage.py", "station/core.py"), ("manage.py", sensors + "rain.py"), ("station/core.py", sensors + "wind.py"),
        (sensors + "__init__.py", sensors + "rain.py"), (sensors + "rain.py", "station/units.py"), (sensors + "vane.py", "station/core.py"),
        (sensors + "wind.py", sensors + "rain.py"), (sensors + "wind.py", sensors + "vane.py"), ("tests/test_units.py", "station/units.py"),
        ("web/bin/wx.cjs", "web/draw/axis.ts"), ("web/draw/axis.spec.ts", "web/draw/axis.ts"), ("web/draw/index.ts", "web/draw/axis.ts"),
        ("web/start.mjs", "web/draw/index.ts"),
    ])
    top = [(r["path"], r["used_by_count"]) for r in graph.most_depended(station.edges, 4).orderBy("rank").collect()]
    assert top == [(sensors + "rain.py", 3), ("web/draw/axis.ts", 3), ("station/core.py", 2), ("station/units.py", 2)]
    assert paths_of(station.components, "node") == ["station/core.py", sensors + "vane.py", sensors + "wind.py"]
    order = graph.reading_order(station.entries, station.edges, 3, 3).orderBy("rank")
    assert [r["path"] for r in order.collect()] == ["agent/cmd/poll/main.go", "docker-compose.yml", "manage.py"]
    # The Go module below a folder is not resolved from the root.
    outside = sorted((r["src"], r["spec"]) for r in station.externals.collect())
    agent = "agent/cmd/poll/main.go"
    assert outside == [(agent, "os"), (agent, "weather.test/agent/queue"), ("manage.py", "csv"), ("web/start.mjs", "d3")]


def test_all_external_names_count(forest, spark):
    """Lists may show the first ten; counts take all."""
    lines = "".join(f"import lib{n}\n" for n in range(25))
    project = Trees(*forest({"many.py": lines}))
    assert project.externals.count() == 25
    assert project.imports().first()["external_imports"] == 25
    assert resolve.externals(project.resolved, 10).count() == 10


def test_outlines(station):
    got = {r["path"]: r["outline"] for r in symbols.outlines(station.symbols).collect()}
    assert got["manage.py"] == "class Console, def Console.show, def Console._hide, def start"
    assert got["station/core.py"] == "class Mast, def Mast.poll, class _Cache, def _calibrate"
    assert got["web/draw/axis.ts"] == "func ticks, func hidden"
    assert got["web/draw/index.ts"] == "func plot, func frame"
    assert got["agent/queue/queue.go"] == "interface Sink, func Push, func drop"
    public = {(r["path"], r["name"]) for r in symbols.public(station.symbols).collect()}
    assert {("manage.py", "show"), ("station/core.py", "poll"), ("agent/queue/queue.go", "Push"), ("web/draw/axis.ts", "ticks")} <= public
    assert not public & {("manage.py", "_hide"), ("station/core.py", "_Cache"), ("agent/queue/queue.go", "drop"), ("web/draw/index.ts", "frame")}


def test_summary_and_listing(station):
    row = station.analyze().first()
    assert (row["files"], row["todo_count"], row["missing_tests"]) == (21, 5, 10)
    assert (row["entry_points"], row["config_files"]) == (6, 3)
    assert (row["cyclic_components"], row["files_in_cycles"]) == (1, 3)
    lines = [r["line"] for r in station.tree(annotated=True).orderBy("tree_key").collect()]
    assert lines[0].startswith("r/ (5 dirs, 4 files, ")
    assert lines[1].startswith("├── agent/ (2 dirs, 1 file, 282 bytes")
    rain = next(line for line in lines if "rain.py" in line)
    assert rain.startswith("│   │   ├── rain.py (91 bytes") and rain.endswith("def depth, imports×1, used-by×3)")
    assert lines[-1].startswith("└── ⚙ requirements.txt")


def test_focus(station, spark):
    asked = spark.createDataFrame([("r", "head", "web/start.mjs")], "repo string, snapshot string, path string")
    out = station.focus(asked)
    assert [r["node"] for r in out["depends_on"].orderBy("pos").collect()] == ["web/draw/index.ts", "web/draw/axis.ts"]
    assert out["depended_on_by"].count() == 0
    assert [r["spec"] for r in out["external_imports"].collect()] == ["d3"]
    typo = spark.createDataFrame([("r", "head", "draw/axis.ts")], "repo string, snapshot string, path string")
    assert [r["path"] for r in station.focus(typo)["did_you_mean"].collect()] == ["web/draw/axis.ts"]


def test_budget(station):
    for tokens in (40, 300):
        rows = station.budget(tokens).orderBy("pos").collect()
        assert rows[0]["path"] == ""
        text = "".join(r["line"] + "\n" for r in rows)
        ascii_chars = sum(c < "\x80" for c in text)
        cost = round(ascii_chars / 4 + (len(text) - ascii_chars) / 1.5)
        assert cost <= tokens or len(rows) == 1
    costs = [r["tokens"] for r in station.estimate().orderBy("place").collect()]
    assert costs == sorted(costs)


def test_crates(forest):
    files, contents = forest(ORCHARD)
    raw = imports.by_pattern(contents, ["rs"])
    resolved = resolve.resolve(raw, files, cargo_dirs=trees.cargo_dirs(files), langs=("rs",))
    edges = resolve.edges(resolved)
    assert pairs(edges) == [
        ("press/src/barrel.rs", "press/src/main.rs"), ("press/src/main.rs", "press/src/barrel.rs"), ("src/lib.rs", "src/tree.rs"),
        ("src/lib.rs", "src/yields/mod.rs"), ("src/yields/apple.rs", "src/tree.rs"), ("src/yields/mod.rs", "src/yields/apple.rs"),
    ]
    assert pairs(edges.where("decl_only")) == [("src/lib.rs", "src/yields/mod.rs"), ("src/yields/mod.rs", "src/yields/apple.rs")]
    assert paths_of(graph.components(edges), "node") == ["press/src/barrel.rs", "press/src/main.rs"]
    found = {(r["path"], r["name"], r["parent"]) for r in symbols.brace_symbols(contents).collect()}
    assert {("src/tree.rs", "seed", "Tree"), ("src/tree.rs", "grow", "Grow"), ("src/tree.rs", "bark", None)} <= found
    untested = paths_of(testsgap.untested(files, edges, imports.inline_tested(contents)))
    assert "src/tree.rs" in untested and "press/src/barrel.rs" not in untested


def test_nested_groups_and_several_statements_in_a_line(forest):
    texts = {
        "a.rs": "use a::{b::{c, d as x}, e, f::{self, g::{h}}};\npub use k::l as m;\nuse {n, o::p};\n",
        "b.js": "import a from './a'; import b from './b';\nexport { c } from './c';import './d';\n",
    }
    found = {}
    for r in imports.by_pattern(forest(texts)[1], ["rs", "js"]).orderBy("src", "ord").collect():
        found.setdefault(r["src"], []).append(r["spec"])
    assert found["a.rs"] == ["a::b::c", "a::b::d", "a::e", "a::f::self", "a::f::g::h", "k::l", "n", "o::p"]
    assert found["b.js"] == ["./a", "./b", "./c", "./d"]


def test_sizes_count_what_is_not_listed(spark):
    """A folder is as large as all it holds, shown or not."""
    rows = [("a/.big", 9000), ("a/small", 1), ("b/mid", 500)]
    df = spark.createDataFrame([("r", p, n) for p, n in rows], "repo string, path string, size long")
    project = Trees(trees.inventory(df), spark.createDataFrame([], "repo string, snapshot string, path string, text string"))
    top = project.top(1).where("kind = 'dir'").first()
    assert (top["path"], top["size"]) == ("a", 9001)
    lines = [r["line"] for r in project.tree("size").orderBy("tree_key").collect()]
    assert "a/" in lines[1] and "b/" in lines[3]


def test_ignore_files(forest):
    files, contents = forest(ORDERS)
    all_files = trees.with_directories(files)
    kept = visible.visible(all_files, trees.ignore_rules(contents))
    assert paths_of(kept.where("kind <> 'dir'")) == ["ledger.bak", "open/2024/order.md", "open/2024/sealed.md"]
    assert paths_of(kept.where("kind = 'dir'")) == ["", "open", "open/2024"]
    assert visible.visible(all_files, trees.ignore_rules(contents), include_ignored=True).count() > kept.count()


def test_rule_star_crosses_directories(forest, spark):
    tree = {".gitignore": "docs/*.tmp\n", "docs/a.tmp": "", "deep/docs/b.tmp": "", "deep/docs/c.txt": "", "secret.txt": ""}
    files, contents = forest(tree)
    all_files = trees.with_directories(files)
    by_rules = visible.visible(all_files, trees.ignore_rules(contents))
    assert paths_of(by_rules.where("kind <> 'dir'")) == ["deep/docs/c.txt", "secret.txt"]
    exact = spark.createDataFrame(
        [("r", "head", "docs/a.tmp"), ("r", "head", "secret.txt")], "repo string, snapshot string, path string"
    )
    by_set = visible.visible(all_files, ignored_paths=exact)
    assert paths_of(by_set.where("kind <> 'dir'")) == ["deep/docs/b.tmp", "deep/docs/c.txt"]


def test_parsers_and_aliases(forest):
    project = Trees(*forest(ALIASES))
    found = {(r["path"], r["name"]) for r in project.symbols.where("path LIKE '%.py'").collect()}
    assert found == {("query.py", "fetch"), ("torn.py", "half")}
    assert pairs(project.edges) == [("app/page.ts", "app/ui/parts/button.ts"), ("server/run.js", "server/log.js")]
    assert project.externals.count() == 0


def test_python_spans_and_parents(forest):
    text = """@deco(1,
      2)
class Tree(
    Base,
):
    '''Grows.

def no(): pass
    '''
    limit = {
'a': 1,
    }

    class _Bark:
        def rough(self): return 1

    async def grow(self, n=")", *rest):
        'One line.'
        def inner():
            return n
        if n:
            def deeper():
                pass
        return inner

if limit:
    def late():
        x = 1
# a remark
    y = 2
def end(): pass
"""
    found = {r["name"]: r for r in symbols.symbols(forest({"t.py": text})[1]).collect()}
    spans = {n: (r["line_start"], r["line_end"], r["parent"], r["public"]) for n, r in found.items()}
    assert spans == {
        "Tree": (3, 24, None, True), "_Bark": (14, 15, "Tree", False), "rough": (15, 15, "_Bark", False), "grow": (17, 24, "Tree", True),
        "inner": (19, 20, "grow", False), "deeper": (22, 23, "grow", False), "late": (27, 28, None, True), "end": (31, 31, None, True),
    }
    assert (found["Tree"]["doc"], found["grow"]["doc"], found["inner"]["doc"]) == ("Grows.", "One line.", None)


def test_a_long_row_of_links(spark):
    """As many folders as one likes, each reached through a link in the one before."""
    rows = [(f"d{n:02}/next", "symlink", f"d{n + 1:02}", True) for n in range(70)] + [("d70/end.txt", "file", None, False)]
    df = spark.createDataFrame([("r", p, k, t, d) for p, k, t, d in rows], "repo string, path string, kind string, link_target string, target_is_dir boolean")
    files = trees.with_directories(trees.inventory(df))
    ends = visible.follow_links(files).where("real_path = 'd70/end.txt'")
    assert ends.count() == 71


def test_large_bodies_are_compared_to_their_end(spark):
    size = 5 << 20
    bodies = {"v1": "a" * size, "v2": "a" * (size - 1) + "b"}
    sides = [
        trees.from_table(spark.createDataFrame([("r", "big.txt", t)], "repo string, path string, text string"), "repo", "path", "text", v)[1]
        for v, t in bodies.items()
    ]
    assert [r["status"] for r in diff.compare(*sides).collect()] == ["changed"]
    assert diff.compare(sides[0], sides[0]).count() == 0


def test_edge_bodies(forest, spark):
    line = b"0123456789abcdef" * 4 + b"\n"
    rows = [
        ("big.txt", line * 1000),
        ("cjk.md", ("日本語です。" * 40).encode()),
        ("nul.txt", b"\x00\x01BINARY" + b"\xff" * 100),
        ("image.png", b"\x89PNG"),
        ("crlf.txt", b"one\r\ntwo\r\n"),
        ("newline.txt", b"\n"),
        ("bad.txt", b"caf\xc3\xa9 \xff\xfe end\n"),
        ("empty.txt", b""),
    ]
    df = spark.createDataFrame([("r", "head", p, bytearray(b)) for p, b in rows], "repo string, snapshot string, path string, content binary")
    got = {r["path"]: (r["tokens"], r["lines"], r["truncated"]) for r in trees.text_counts(df, 50_000).collect()}
    # 50,000 of 65,000 bytes are read: both counts are scaled back up.
    assert got["big.txt"] == (16250, 1001, True)
    assert got["cjk.md"] == (160, 1, False)
    assert got["nul.txt"][:2] == (None, None) and got["image.png"][:2] == (None, None)
    assert got["crlf.txt"] == (2, 2, False)
    assert got["newline.txt"] == (1, 1, False)
    assert got["bad.txt"][1] == 1 and got["empty.txt"][:2] == (0, 0)
    text = trees.bodies(df).where("path = 'bad.txt'").first()["text"]
    assert text == "café  end\n"


def test_links_and_unreadable_directories(spark):
    rows = [
        ("docs", "dir", None, None, False), ("empty", "dir", None, None, False), ("locked", "dir", None, None, True),
        ("docs/a.txt", "file", 10, None, False), ("top.txt", "file", 5, None, False), ("loop/in/f.txt", "file", 3, None, False),
        ("loop/in/back", "symlink", None, "loop", False), ("links/docs", "symlink", None, "docs", False),
        ("links/broken", "symlink", None, "nowhere", False),
    ]
    df = spark.createDataFrame(
        [("r", p, k, s, t, p.endswith(("back", "links/docs")), d) for p, k, s, t, d in rows],
        "repo string, path string, kind string, size long, link_target string, target_is_dir boolean, denied boolean",
    )
    files = trees.with_directories(trees.inventory(df))
    sizes = {r["dir"]: (r["size"], r["partial"]) for r in rollup.directory_sizes(files).collect()}
    assert sizes[""] == (18, True) and sizes["docs"] == (10, False) and sizes["empty"] == (0, False)
    assert sizes["locked"] == (0, True) and sizes["links"] == (0, False)
    followed = {r["path"]: (r["real_path"], r["cyclic"]) for r in visible.follow_links(files).collect()}
    assert followed["links/docs/a.txt"] == ("docs/a.txt", False)
    assert followed["loop/in/back"] == ("loop/in/back", True)
    assert not any(p.startswith("loop/in/back/") for p in followed)


def test_api_diff_between_snapshots(forest, spark):
    old = Trees(*forest({"a.py": "def one():\n    pass\ndef two():\n    pass\n", "gone.py": "def old():\n    pass\n", "same.py": "def s():\n    pass\n"}, "v1"))
    new = Trees(
        *forest({"a.py": "def one():\n    pass\ndef three():\n    pass\n", "same.py": "def s():\n    pass\n", "new/b.go": "func Fresh() {\n}\n", "moved.py": "def m():\n    pass\n"}, "v2"),
        changes=spark.createDataFrame([("r", "a.py", "M"), ("r", "gone.py", "D"), ("r", "moved.py", "R")], "repo string, path string, status string"),
        status=spark.createDataFrame([("r", "new/", "??")], "repo string, path string, xy string"),
    )
    got = sorted((r["path"], r["symbol"], r["change"], r["untracked"]) for r in new.api_diff(old).collect())
    assert got == [
        ("a.py", "def three", "added", False), ("a.py", "def two", "removed", False), ("gone.py", "def old", "removed", False),
        ("moved.py", "def m", "added", False), ("new/b.go", "func Fresh", "added", True),
    ]
    assert new.compare(old).where(F.col("status") == "only_a").count() == 2
    assert old.compare(old).count() == 0


def test_inline_scripts(forest):
    pages = {
        "a.html": (
            "<!doctype html>\n<html>\n<head>\n<script>\nfunction alpha() {\n  return 1;\n}\nconst beta = () => 2;\n</script>\n</head>\n"
            '<body>\n<script type="module">\nfunction gamma() {}\n</script>\n</body>\n</html>\n'
        ),
        "b.html": (
            '<script src="app.js"></script>\n<script type="application/json">{"function": "no"}</script>\n'
            "<SCRIPT>function upper() {}</SCRIPT>\n<script src=x />\n"
        ),
        "c.htm": "<script>\nfunction ok() {}\nfunction broken( {\n</script>\n",
        "d.html": "<p>none</p>",
    }
    found = symbols.html_symbols(forest(pages)[1]).collect()
    spans = {(r["path"], r["name"]): (r["line_start"], r["line_end"]) for r in found}
    assert spans[("a.html", "alpha")] == (5, 7) and spans[("a.html", "gamma")] == (13, 13)
    assert spans[("a.html", "beta")] == (8, 8) and ("b.html", "upper") in spans and ("c.htm", "ok") in spans
    assert {p for p, _ in spans} == {"a.html", "b.html", "c.htm"}


def test_newest_first(spark):
    from coppice.operators import tree

    rows = [("old.txt", 1.0), ("new.txt", 9.0), ("mid.txt", 5.0), ("dir/x.txt", 7.0)]
    df = spark.createDataFrame([("r", p, 1, m, m) for p, m in rows], "repo string, path string, size long, mtime double, ctime double")
    files = trees.with_directories(trees.inventory(df))
    keyed = tree.tree_keys(files, "mtime", files_first=True)
    listed = [r["path"] for r in tree.positions(keyed).orderBy("pos").collect()]
    assert listed == ["", "new.txt", "mid.txt", "old.txt", "dir", "dir/x.txt"]
    back = [r["path"] for r in tree.positions(tree.tree_keys(files, "ctime", reverse=True)).orderBy("pos").collect()]
    assert back == ["", "dir", "dir/x.txt", "old.txt", "mid.txt", "new.txt"]


def test_python_strings_with_marks_of_comments_and_brackets(forest):
    text = r'''
x = paint(Q#fffQ)
class Ink:  # itQs (open
    shade = "\"(" + Q\Q[Q + rQ\(Q + "QQQ"
    def dry(self, mark="#)"):
        return f"{self}#("
    long = Qone \
def no(): passQ
    def wet(self): QQQa \QQQ ( # QQQ
import first  # donQt (
from second import (  # "
    one,
    two)
s = "# Q" + Q""" (Q
import third
def end(): pass
'''.replace("Q", "'")
    far = 'x = """' + "(' \\\" " * 20000 + '"""\ndef far(): pass\n'
    contents = forest({"t.py": text, "far.py": far})[1]
    found = {(r["name"], r["line_start"], r["line_end"], r["parent"]) for r in symbols.symbols(contents).collect()}
    assert found == {("Ink", 3, 9, None), ("dry", 5, 6, "Ink"), ("wet", 9, 9, "Ink"), ("end", 16, 16, None), ("far", 2, 2, None)}
    got = imports.python(contents).orderBy("ord").collect()
    assert [(r["spec"], r["names"]) for r in got] == [("first", None), ("second", ["one", "two"]), ("third", None)]


def test_ten_thousand_ignore_rules(spark):
    """Named rules are looked up, only globs are tried; against Python's own matching."""
    import random
    import re

    from coppice.operators import visible

    rng = random.Random(2)
    part = lambda: rng.choice(["a", "b", "src", "out", "x.y", "log"])
    listed = {}
    for k in range(250):
        path = "/".join(part() for _ in range(rng.randint(1, 4))) + rng.choice(["", ".log", ".tar.gz", f"{k}.o", "~"])
        if not any(p.startswith(path + "/") or path.startswith(p + "/") for p in listed):
            listed[path] = "file"
    for path in list(listed):
        for n in range(1, path.count("/") + 1):
            listed[path.rsplit("/", n)[0]] = "dir"
    rules = [("", f"no{k}" if k % 2 else f"/no/{k}.txt") for k in range(10_000)]
    some = ["*.log", "!b.log", "/src/out", "out/", "x.y/a", "*.tar.gz", "!*.gz", "*~", "/a/?", "l[!a]g", "!/src/out/b", "*17.o", "b/*.o", "!x.y"]
    for place, pattern in zip(rng.sample(range(10_000), len(some)), some, strict=True):
        rules[place] = ("", pattern)
    rules += [("src", "/a"), ("src", "!*.log"), ("a/b", "log"), ("out", "a/")]

    def regex(glob):
        return "".join({"*": ".*", "?": "."}.get(t, t.replace("[!", "[^") if len(t) > 1 else re.escape(t)) for t in re.findall(r"\[.*?\]|.", glob))

    compiled, number = [], {}
    for folder, pattern in rules:
        number[folder] = number.get(folder, 0) + 1
        bare = pattern.lstrip("!").rstrip("/")
        below = (folder + bare).lstrip("/") if bare.startswith("/") else bare
        shape = re.compile(("" if bare.startswith("/") else "(?:.*/)?") + regex(below), re.S)
        compiled.append((folder, number[folder], pattern.startswith("!"), pattern.endswith("/"), shape))
    lost = set()
    for path, kind in listed.items():
        hits = [
            (d.count("/") + bool(d), n, neg)
            for d, n, neg, dirs, shape in compiled
            if (not d or path.startswith(d + "/")) and (kind == "dir" or not dirs) and shape.fullmatch(path)
        ]
        if hits and not max(hits)[2]:
            lost.add(path)
    want = {p for p in listed if not any(p == h or (p.startswith(h + "/") and listed[h] == "dir") for h in lost)}
    rows = [("r", "head", p, k) for p, k in listed.items()]
    files = spark.createDataFrame(rows, "repo string, snapshot string, path string, kind string")
    seen = {}
    numbered_rules = []
    for d, p in rules:
        seen[d] = seen.get(d, 0) + 1
        numbered_rules.append(("r", "head", d, seen[d], p))
    table = spark.createDataFrame(numbered_rules, "repo string, snapshot string, dir string, line_no int, pattern string")
    assert {r.path for r in visible.apply_ignore(files, table).collect()} == want
    forms = {r.form: r["count"] for r in visible.compiled_rules(table).groupBy("form").count().collect()}
    assert forms["glob"] <= 6 and sum(forms.values()) == len(rules)


def test_bodies_of_unique_sizes_are_not_digested(spark):
    from coppice.operators import dupes
    from coppice.sources import trees

    rows = [("r", f"f{k}", "x" * (k + 1)) for k in range(300)] + [("r", "g", "y" * 7), ("r", "h", "x" * 7), ("q", "i", "x" * 9), ("q", "j", "")]
    files, contents = trees.from_table(spark.createDataFrame(rows, "repo string, path string, text string"), "repo", "path", "text")
    kept = dupes.of_repeated_size(contents, files)
    assert sorted(r.path for r in kept.collect()) == ["f6", "g", "h"]
    groups = dupes.groups(dupes.digests(kept)).collect()
    assert [(r.copies, r.path) for r in groups] == [(2, "f6")]
    everywhere = dupes.of_repeated_size(contents, files, across=True)
    assert sorted(r.path for r in everywhere.collect()) == ["f6", "f8", "g", "h", "i"]


def test_empty_lines_are_not_tried(forest):
    """Lines a comment leaves empty are dropped before the line patterns; numbers stay those of the file."""
    _, contents = forest({"a.rs": "// one\n/* two\n three */\n\nfn f() {\n// four\n}\n", "b.go": "// none\n"})
    lines = symbols._lines(contents, [".go", ".rs"])
    assert sorted((r["path"], r["_n"], r["_line"]) for r in lines.collect()) == [("a.rs", 4, "fn f() {"), ("a.rs", 6, "}")]
    found = symbols.brace_symbols(contents).collect()
    assert [(r["path"], r["line_start"], r["line_end"], r["name"]) for r in found] == [("a.rs", 5, 7, "f")]
