"""Checked queries on import graphs and on commit histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from coppice.functions import labels
from coppice.operators import graph, history, testsgap, visible
from coppice.operators.skew import tasks_for
from coppice.plans import registry as R
from coppice.plans.registry import checked, table, view
from coppice.schema import TREE
from coppice.session import Folder, cut
from coppice.sinks import report
from coppice.sources import gittext, trees

# SQL: all pairs that are connected, without distances.
_PAIRS = """
RECURSIVE e AS (SELECT repo, src, dst FROM @EDGES g),
pairs AS (SELECT repo, src AS root, dst AS node FROM e UNION SELECT p.repo, p.root, e.dst FROM pairs p JOIN e ON e.repo = p.repo AND e.src = p.node)
"""


def _edges(spark, sf_dir):
    return view(spark, sf_dir, "EDGES")


@checked(
    """
SELECT repo, path, cast(sum(o) AS bigint) AS imports, cast(sum(i) AS bigint) AS imported_by FROM (
  SELECT repo, src AS path, 1 AS o, 0 AS i FROM @EDGES a UNION ALL SELECT repo, dst, 0, 1 FROM @EDGES b) x GROUP BY 1, 2
"""
)
def edge_degrees(spark, sf_dir):
    return graph.degrees(_edges(spark, sf_dir)).drop("snapshot")


_USED = """
used AS (SELECT repo, dst AS path, count(*) AS used_by_count, row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, min(src), dst) AS rank FROM @EDGES g GROUP BY 1, 2)
"""


@checked(f"WITH {_USED} SELECT * FROM used WHERE rank <= 10")
def most_depended_on(spark, sf_dir):
    return graph.most_depended(_edges(spark, sf_dir)).drop("snapshot")


@checked(f"WITH {_PAIRS} SELECT repo, root, node FROM pairs WHERE root <> node")
def impact_of_every_file(spark, sf_dir):
    """Everything each file depends on, directly or not."""
    return graph.impact_pairs(_edges(spark, sf_dir)).select("repo", "root", "node")


_COUNTS = """
SELECT n.repo, n.path, (SELECT count(*) FROM e WHERE e.repo = n.repo AND e.{near} = n.path) AS direct,
  (SELECT count(*) FROM pairs p WHERE p.repo = n.repo AND p.{root} = n.path AND p.{node} <> n.path) AS files
FROM (SELECT repo, src AS path FROM e UNION SELECT repo, dst FROM e) n
"""


@checked(f"WITH {_PAIRS} {_COUNTS.format(near='dst', root='node', node='root')}")
def dependents_of_every_file(spark, sf_dir):
    """How many files depend on each file, directly and in all."""
    return graph.impact_counts(_edges(spark, sf_dir), reverse=True).drop("snapshot")


@checked(f"WITH {_PAIRS} SELECT repo, root, node FROM pairs WHERE root <> node AND root IN ('lib/f3', 'lib/f14', 'lib/f31')")
def impact_of_chosen_files(spark, sf_dir):
    """Everything that three files of each tree depend on, directly or not."""
    edges = _edges(spark, sf_dir)
    roots = edges.where(F.col("src").isin("lib/f3", "lib/f14", "lib/f31")).select(*TREE, F.col("src").alias("path")).distinct()
    return graph.impact(edges, roots).select("repo", "root", "node")


@checked()
def dependents_in_order(spark, sf_dir):
    """Files affected by a change of each tree's first target, in breadth-first order."""
    edges = _edges(spark, sf_dir)
    roots = edges.groupBy(*TREE).agg(F.min("dst").alias("path"))
    return graph.impact_in_order(edges, roots, reverse=True).drop("snapshot")


@checked(
    f"""
WITH {_PAIRS}, far AS (SELECT p.repo, p.node, p.root FROM pairs p WHERE p.root IN ('lib/f0', 'lib/f7', 'lib/f23'))
SELECT DISTINCT repo, node AS path FROM far
"""
)
def reached_from_seeds(spark, sf_dir):
    """Union of what a few seeds of each tree reach."""
    edges = _edges(spark, sf_dir)
    seeds = edges.where(F.col("src").isin("lib/f0", "lib/f7", "lib/f23")).select(*TREE, F.col("src").alias("node"))
    return graph.reachable(edges, seeds).select("repo", F.col("node").alias("path"))


@checked(
    f"""
WITH {_PAIRS}, cyc AS (SELECT repo, root, node FROM pairs p WHERE EXISTS (SELECT 1 FROM pairs q WHERE q.repo = p.repo AND q.root = p.node AND q.node = p.root))
SELECT repo, root AS node, min(node) AS component FROM cyc GROUP BY 1, 2
"""
)
def cyclic_components(spark, sf_dir):
    """Files on import cycles, grouped by who can reach each other."""
    return graph.components(_edges(spark, sf_dir)).drop("snapshot")


@checked(
    f"""
WITH {_PAIRS}, cyc AS (SELECT repo, root, node FROM pairs p WHERE EXISTS (SELECT 1 FROM pairs q WHERE q.repo = p.repo AND q.root = p.node AND q.node = p.root)),
comp AS (SELECT repo, root AS path, min(node) AS component FROM cyc GROUP BY 1, 2),
asked AS (SELECT DISTINCT repo, 'lib/f11' AS focus FROM @EDGES g)
SELECT a.repo, a.focus, c.component, c.path FROM asked a JOIN comp f ON f.repo = a.repo AND f.path = a.focus JOIN comp c ON c.repo = a.repo AND c.component = f.component
"""
)
def cycles_of_requested(spark, sf_dir):
    edges = cut(_edges(spark, sf_dir), "edges")
    asked = edges.select(*TREE, F.lit("lib/f11").alias("path")).distinct()
    return graph.cycles_of(cut(graph.components(edges), "components"), asked).drop("snapshot")


@checked()
def witness_cycles(spark, sf_dir):
    """One shortest cycle through the smallest file of each component."""
    edges = cut(_edges(spark, sf_dir), "edges")
    return graph.witness_cycles(edges, cut(graph.components(edges), "components")).drop("snapshot")


@checked(
    f"""
WITH {_USED}, entries AS (SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY path) AS n FROM (SELECT DISTINCT repo, src AS path FROM @EDGES g WHERE regexp_matches(src, '[15]$') AND src < 'lib/f2') x),
both_ AS (SELECT repo, path, 0 AS g, n FROM entries WHERE n <= 8 UNION ALL SELECT repo, path, 1, rank FROM used WHERE rank <= 5 AND (repo, path) NOT IN (SELECT (repo, path) FROM entries))
SELECT * FROM (SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY g, n) AS rank FROM both_) y WHERE rank <= 8
"""
)
def reading_order(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    entries = edges.where(F.col("src").rlike("[15]$") & (F.col("src") < "lib/f2")).select(*TREE, F.col("src").alias("path"))
    return graph.reading_order(entries, edges).drop("snapshot")


_NUMBERS = """
first_ AS (SELECT repo, path, min(m) AS m FROM (SELECT repo, src AS path, [src, ''] AS m FROM @EDGES a UNION ALL SELECT repo, dst, [src, dst] FROM @EDGES b) x GROUP BY 1, 2),
numbers AS (SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY m) - 1 AS n FROM first_)
"""


@checked(
    f"""
WITH {_NUMBERS}
SELECT repo, 0 AS section, 0 AS n, 0 AS m, 'graph LR' AS line FROM (SELECT DISTINCT repo FROM numbers) r
UNION ALL SELECT repo, 1, n, 0, '    n' || cast(n AS varchar) || '["' || path || '"]' FROM numbers
UNION ALL SELECT e.repo, 2, a.n, b.n, '    n' || cast(a.n AS varchar) || ' --> n' || cast(b.n AS varchar)
FROM @EDGES e JOIN numbers a ON a.repo = e.repo AND a.path = e.src JOIN numbers b ON b.repo = e.repo AND b.path = e.dst
"""
)
def mermaid_lines(spark, sf_dir):
    return report.mermaid(_edges(spark, sf_dir)).drop("snapshot")


@checked(
    """
SELECT repo, 1 AS section, src, dst, '    "' || src || '" -> "' || dst || '";' AS line FROM @EDGES e
UNION ALL SELECT r.repo, v.s, v.k, '', v.t FROM (SELECT DISTINCT repo FROM @EDGES e) r,
  (VALUES (0, '', 'digraph imports {'), (0, 'a', '    rankdir=LR;'), (0, 'b', '    node [shape=box, fontsize=10];'), (2, '', '}')) v(s, k, t)
"""
)
def dot_lines(spark, sf_dir):
    return report.dot(_edges(spark, sf_dir)).drop("snapshot")


@checked(
    """
WITH asked AS (SELECT DISTINCT repo, 'web/' || list_extract(string_split(src, '/'), -1) AS given FROM @EDGES g),
nodes AS (SELECT DISTINCT repo, unnest([src, dst, 'old/' || src, 'more/x/' || dst]) AS path FROM @EDGES g),
hits AS (SELECT a.repo, a.given, n.path FROM asked a JOIN nodes n ON n.repo = a.repo AND list_extract(string_split(n.path, '/'), -1) = list_extract(string_split(a.given, '/'), -1))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, given ORDER BY path) AS rank FROM hits) x WHERE rank <= 3
"""
)
def did_you_mean(spark, sf_dir):
    """Graph files with the name of a path that is not in the graph."""
    edges = _edges(spark, sf_dir)
    moved = edges.select(*TREE, F.concat(F.lit("old/"), "src").alias("src"), F.concat(F.lit("more/x/"), "dst").alias("dst"))
    asked = edges.select(*TREE, F.replace("src", F.lit("lib/"), F.lit("web/")).alias("path")).distinct()
    return graph.suggestions(asked, edges.unionByName(moved)).drop("snapshot")


# ---------------------------------------------------------------- history

_SEQ = "seqs AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ts DESC, event_id DESC) - 1 AS seq FROM @COMMITS c)"
_TOUCHED = f"{_SEQ}, touched AS (SELECT f.repo, f.path, s.seq FROM @COMMIT_FILES f JOIN seqs s ON s.event_id = f.event_id)"


def _log(spark, sf_dir):
    commits = history.number_commits(
        view(spark, sf_dir, "COMMITS"), [F.col("ts").desc(), F.col("event_id").desc()]
    )
    commits = cut(commits, "commits")
    touched = view(spark, sf_dir, "COMMIT_FILES").join(commits.select("event_id", "seq"), "event_id")
    return commits, touched.select("repo", "seq", "path")


@checked(f"WITH {_SEQ} SELECT event_id, seq FROM seqs")
def numbered_commits(spark, sf_dir):
    """Commits numbered from the newest, in a log of any length."""
    return _log(spark, sf_dir)[0].select("event_id", "seq")


@checked(
    f"""
WITH {_TOUCHED}, last AS (SELECT repo, path, min(seq) AS seq FROM touched GROUP BY 1, 2)
SELECT l.repo, l.path, l.seq, s.hash, s.author, '"' || CASE WHEN length(s.subject) > 30 THEN left(s.subject, 30) || '…' ELSE s.subject END || '" (' || s.date || ')' AS label
FROM last l JOIN seqs s ON s.repo = l.repo AND s.seq = l.seq
"""
)
def last_commit_per_path(spark, sf_dir):
    commits, touched = _log(spark, sf_dir)
    out = history.last_commits(commits, touched)
    return out.select("repo", "path", "seq", "hash", "author", "label")


_CHURN = f"""{_TOUCHED}, churn AS (SELECT repo, path, count(*) AS changes, min(seq) AS newest,
  CASE WHEN count(*) >= 20 THEN 0 WHEN count(*) >= 10 THEN 1 WHEN count(*) >= 5 THEN 2 WHEN count(*) >= 3 THEN 3 WHEN count(*) >= 2 THEN 4 ELSE 5 END AS heat FROM touched GROUP BY 1, 2)"""


@checked(f"WITH {_CHURN} SELECT * FROM churn")
def churn_and_heat(spark, sf_dir):
    return history.churn(_log(spark, sf_dir)[1])


@checked(f"WITH {_CHURN.replace('s.event_id = f.event_id)', 's.event_id = f.event_id WHERE s.seq < 500)')} SELECT * FROM churn")
def churn_in_horizon(spark, sf_dir):
    """The newest 500 commits of each repository only: here the limit is the feature."""
    return history.churn(history.horizon(_log(spark, sf_dir)[1], 500))


@checked(f"WITH {_CHURN} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY changes DESC, newest, path) AS rank FROM churn) x WHERE rank <= 5")
def hotspots(spark, sf_dir):
    return history.hotspots(history.churn(_log(spark, sf_dir)[1]))


_LOG = """
SELECT 'd' || cast(doc_id AS varchar) AS repo, line_no - 1 AS seq, left(md5(line), 7) AS hash, 'day ' || cast(line_no - 1 AS varchar) AS date, lang AS author, line AS subject
FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents) l
"""


def _log_texts(spark, sf_dir):
    """Log text per document: every line a commit that touches two paths."""
    docs = table(spark, sf_dir, "documents")
    record = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.concat(
            F.lit("\x01"), F.md5(line), F.lit("\x02day "), i.cast("string"), F.lit("\x02"), F.col("lang"), F.lit("\x02"), line,
            F.lit("\x03\nsrc/a"), F.length(line).cast("string"), F.lit(".py\r\nall\\"), F.col("lang"), F.lit("\n"),
        ),
    )
    return docs.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("repo"),
        F.array_join(record, "\n").alias("text"),
    )


@checked(_LOG)
def parsed_log_commits(spark, sf_dir):
    return gittext.parse_log(_log_texts(spark, sf_dir))[0]


@checked(
    """
SELECT 'd' || cast(doc_id AS varchar) AS repo, line_no - 1 AS seq, unnest(['src/a' || cast(length(line) AS varchar) || '.py', 'all/' || lang]) AS path
FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents) l
"""
)
def parsed_log_paths(spark, sf_dir):
    return gittext.parse_log(_log_texts(spark, sf_dir))[1]


def _log_folder(spark, sf_dir):
    """The log of each language, its documents' records in order, cut into files by size."""
    folder = Folder(spark, "logs").path("by-language")
    files = tasks_for(table(spark, sf_dir, "documents"), F.octet_length("text"))
    texts = _log_texts(spark, sf_dir).join(
        table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("repo"), "doc_id", "lang"), "repo"
    )
    texts.repartitionByRange(files, "lang", "doc_id").sortWithinPartitions("lang", "doc_id").select("lang", "text").write.partitionBy("lang").text(folder)
    return folder


_FILED_LOG = """
lines AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
records AS (SELECT lang AS repo, row_number() OVER (PARTITION BY lang ORDER BY doc_id, line_no) - 1 AS seq, line, line_no FROM lines)
"""


@checked(f"WITH {_FILED_LOG} SELECT repo, seq, left(md5(line), 7) AS hash, 'day ' || cast(line_no - 1 AS varchar) AS date, repo AS author, line AS subject FROM records")
def filed_log_commits(spark, sf_dir):
    """Commits from log files that are read record by record."""
    language = F.regexp_extract("_metadata.file_path", "lang=([^/]*)/", 1)
    return gittext.parse_records(gittext.read_log(spark, _log_folder(spark, sf_dir), language))[0]


@checked(f"WITH {_FILED_LOG} SELECT repo, seq, unnest(['src/a' || cast(length(line) AS varchar) || '.py', 'all/' || repo]) AS path FROM records")
def filed_log_paths(spark, sf_dir):
    """Touched paths from the same files."""
    language = F.regexp_extract("_metadata.file_path", "lang=([^/]*)/", 1)
    return gittext.parse_records(gittext.read_log(spark, _log_folder(spark, sf_dir), language))[1]


def _status_texts(spark, sf_dir):
    """Status text per file of the TREE view: modified, renamed, untracked by turns."""
    files = view(spark, sf_dir, "TREE")
    return files.select(
        "repo",
        F.concat(
            F.lit(" M "), "path", F.lit("\x00R  new/"), "path", F.lit("\x00RM old/"), "path", F.lit("\x00"),
            F.when(F.col("size") % 2 == 0, F.concat(F.lit("?? fresh/"), "path", F.lit("\x00"))).otherwise(F.lit("A\x00")),
        ).alias("text"),
    )


_STATUS = """
status AS (SELECT repo, path, ' M' AS xy FROM @TREE t UNION ALL SELECT repo, 'new/' || path, 'R ' FROM @TREE t
  UNION ALL SELECT repo, 'fresh/' || path, '??' FROM @TREE t WHERE size % 2 = 0)
"""


@checked(f"WITH {_STATUS} SELECT * FROM status")
def parsed_status(spark, sf_dir):
    return gittext.parse_status(_status_texts(spark, sf_dir))


def _diff_texts(spark, sf_dir):
    files = view(spark, sf_dir, "TREE")
    return files.select(
        "repo",
        F.concat(
            F.when(F.col("size") % 3 == 0, "M").when(F.col("size") % 3 == 1, "D").otherwise("A"), F.lit("\x00"), "path",
            F.lit("\x00R100\x00was/"), "path", F.lit("\x00now/"), "path", F.lit("\x00"),
        ).alias("text"),
    )


_CHANGES = """
changes AS (SELECT repo, path, CASE size % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'D' ELSE 'A' END AS status FROM @TREE t
  UNION ALL SELECT repo, 'now/' || path, 'R' FROM @TREE t)
"""


@checked(f"WITH {_CHANGES} SELECT * FROM changes")
def parsed_diff(spark, sf_dir):
    return gittext.parse_diff(_diff_texts(spark, sf_dir))


_SINCE = f"""{_STATUS}, {_CHANGES}, since AS (SELECT repo, path, arg_min(mark, p) AS mark FROM (
  SELECT repo, path, status AS mark, 0 AS p FROM changes WHERE status <> 'D' UNION ALL SELECT repo, path, CASE WHEN xy = '??' THEN 'A' ELSE 'M' END, 1 FROM status) x GROUP BY 1, 2)"""


def _since(spark, sf_dir):
    changes = gittext.parse_diff(_diff_texts(spark, sf_dir))
    status = gittext.parse_status(_status_texts(spark, sf_dir))
    return history.since_marks(changes, status), changes, status


@checked(f"WITH {_SINCE} SELECT * FROM since")
def since_marks(spark, sf_dir):
    """The diff's marks, completed by the working tree's."""
    return _since(spark, sf_dir)[0]


@checked(f"WITH {_CHANGES} SELECT repo, path FROM changes WHERE status = 'D'")
def deleted_paths(spark, sf_dir):
    return history.deleted(_since(spark, sf_dir)[1])


@checked(f"WITH {_SINCE} SELECT repo, path[5:] AS path, mark FROM since WHERE path LIKE 'now/%'")
def marks_below_prefix(spark, sf_dir):
    return gittext.below_prefix(_since(spark, sf_dir)[0], "now/")


@checked(
    f"""
WITH {_CHANGES}, touched AS (SELECT repo, path FROM changes WHERE status <> 'D'), kept AS (SELECT t.repo, t.path FROM @TREE t JOIN touched s ON s.repo = t.repo AND s.path = t.path)
SELECT repo, path, 'file' AS kind FROM kept UNION ALL SELECT DISTINCT repo, unnest({R.above()}), 'dir' FROM kept
"""
)
def changed_files_only(spark, sf_dir):
    """Listing cut to changed files and the directories that hold them."""
    files = cut(trees.inventory(view(spark, sf_dir, "TREE").drop("text")), "files")
    since = _since(spark, sf_dir)[1].where(F.col("status") != "D").select("repo", "path")
    listed = trees.with_directories(files)
    return visible.visible(listed, show_all=True, since=since).select("repo", "path", "kind")


@checked(
    """
SELECT t.repo, t.path, CASE WHEN t.size % 4 = 1 THEN 'M' WHEN t.size % 3 <> 1 THEN CASE t.size % 3 WHEN 0 THEN 'M' ELSE 'A' END END AS git_status FROM @TREE t
"""
)
def status_overlay(spark, sf_dir):
    """Status code of each file, else its mark since the reference."""
    files = trees.inventory(view(spark, sf_dir, "TREE").drop("text"))
    changes = _since(spark, sf_dir)[1]
    status = gittext.parse_status(_status_texts(spark, sf_dir)).join(
        files.where(F.col("size") % 4 == 1).select("repo", "path"), ["repo", "path"], "left_semi"
    )
    none = status.where(F.lit(False))
    return history.overlay(files, status, history.since_marks(changes, none)).drop("snapshot")


_LOW = f"lower({R.name_of()})"
_STEM = f"left({_LOW}, length({_LOW}) - length({R.ext_of()}))"


@checked(
    f"""
WITH f AS (SELECT repo, path, {_LOW} AS low, {R.name_of()} AS name, {R.ext_of()} AS ext, regexp_matches({_STEM}, '^test_|(_test|\\.test|\\.spec)$') AS is_test FROM @TREE t),
s AS (SELECT *, left(name, length(name) - length(ext)) AS stem FROM f WHERE ext IN ('.py', '.js', '.jsx', '.ts', '.tsx', '.go') AND NOT is_test)
SELECT repo, path FROM s WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.repo = s.repo AND f.low IN ('test_' || s.stem || s.ext, s.stem || '_test' || s.ext, s.stem || '.test' || s.ext, s.stem || '.spec' || s.ext))
"""
)
def untested_by_name(spark, sf_dir):
    files = cut(trees.inventory(view(spark, sf_dir, "TREE").drop("text")), "files")
    return testsgap.untested_by_name(files).drop("snapshot")


@checked(
    """
SELECT repo, path, CASE WHEN n >= 20 THEN 0 WHEN n >= 10 THEN 1 WHEN n >= 5 THEN 2 WHEN n >= 3 THEN 3 WHEN n >= 2 THEN 4 ELSE 5 END AS heat_changes
FROM (SELECT repo, dst AS path, count(*) AS n FROM @EDGES e GROUP BY 1, 2) x
"""
)
def heat_by_changes(spark, sf_dir):
    counted = graph.degree_of(_edges(spark, sf_dir), "dst", "n")
    return counted.select("repo", "path", labels.heat_by_changes(F.col("n")).alias("heat_changes"))
