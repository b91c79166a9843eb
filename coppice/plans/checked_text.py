"""Checked queries on bodies: counts, markers, packs, budgets, snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from coppice.functions import measure, paths
from coppice.operators import budget, diff, markers, rollup, tree
from coppice.plans import registry as R
from coppice.plans.checked_tree import _KEY, COUNTED, ENTRIES
from coppice.plans.registry import checked, table, view
from coppice.schema import ENTRY, TREE
from coppice.session import Folder, cut
from coppice.sinks import report
from coppice.sources import trees

WORDS = ["license", "copyright", "secret", "password"]


@checked(
    f"SELECT repo, path, size, {R.tokens_of()} AS tokens, {R.lines_of()} AS lines, length(text) - {R.others()} AS ascii_chars, {R.others()} AS other_chars FROM @FILES f"
)
def text_counts(spark, sf_dir):
    counts = trees.text_counts(view(spark, sf_dir, "FILES"))
    return counts.select("repo", "path", "size", "tokens", "lines", "ascii_chars", "other_chars")


# The read limit of the check.  SQL side: the longest run of whole characters that fits.
_CAP = 4096


@checked(
    f"""
WITH h AS (SELECT repo, path, size, size > {_CAP} AS truncated, least(size, {_CAP}) AS byte_len,
  CASE WHEN size <= {_CAP} THEN text ELSE left(text, len(list_filter(list_transform(range(1, {_CAP} + 1), lambda i: strlen(left(text, i))), lambda b: b <= {_CAP}))) END AS text FROM @FILES f),
c AS (SELECT *, CASE WHEN truncated THEN size::DOUBLE / byte_len::DOUBLE ELSE 1.0::DOUBLE END AS s, {R.others()} AS o, {R.lines_of()} AS n FROM h)
SELECT repo, path, size, truncated, CASE WHEN text = '' THEN 0 ELSE greatest(1, cast(round_even(((length(text) - o) / 4.0::DOUBLE + o / 1.5::DOUBLE) * s, 0) AS bigint)) END AS tokens,
  CASE WHEN text = '' THEN 0 WHEN truncated THEN greatest(1, cast(round_even(n * s, 0) AS bigint)) ELSE n END AS lines
FROM c
"""
)
def capped_counts(spark, sf_dir):
    """The read limit as a feature: counts of a cut body are scaled to its size."""
    counts = trees.text_counts(view(spark, sf_dir, "FILES"), limit=_CAP)
    return counts.select("repo", "path", "size", "truncated", "tokens", "lines")


@checked(
    f"""
WITH b AS (SELECT repo, path, size, CASE WHEN size % 5 = 0 THEN text || chr(0) WHEN size % 5 = 1 THEN path ELSE text END AS text,
  CASE WHEN size % 5 = 1 THEN path || '.png' ELSE path END AS named FROM @FILES f)
SELECT repo, named AS path, size % 5 IN (0, 1) AS is_binary, CASE WHEN size % 5 > 1 THEN {R.tokens_of()} END AS tokens, CASE WHEN size % 5 > 1 THEN {R.lines_of()} END AS lines FROM b
"""
)
def binary_files(spark, sf_dir):
    """Binary by extension or by a NUL byte at the very end: such files have no counts."""
    df = view(spark, sf_dir, "FILES")
    kind = F.col("size") % 5
    body = (
        F.when(kind == 0, F.concat("text", F.lit("\x00")))
        .when(kind == 1, F.col("path"))
        .otherwise(F.col("text"))
    )
    contents = df.select(
        *TREE,
        F.when(kind == 1, F.concat("path", F.lit(".png"))).otherwise(F.col("path")).alias("path"),
        F.encode(body, "UTF-8").alias("content"),
    )
    return trees.text_counts(contents).select("repo", "path", "is_binary", "tokens", "lines")


@checked(
    """
SELECT repo, path, md5(text) AS digest, length(text) AS chars FROM @FILES f
"""
)
def damaged_bodies(spark, sf_dir):
    """Bytes that are not UTF-8 are dropped: damage put in comes out again."""
    df = view(spark, sf_dir, "FILES")
    bad = F.lit(bytearray(b"\xc3\xff"))
    good = F.encode("text", "UTF-8")
    content = F.when(F.col("size") % 2 == 0, good).otherwise(
        F.concat(F.lit(bytearray(b"\xe3\x81")), good, bad, F.lit(bytearray(b"\x80\xf0\x9f")))
    )
    damaged = df.select(*ENTRY, content.alias("content"))
    held = trees.bodies(damaged)
    return held.select("repo", "path", F.md5("text").alias("digest"), F.length("text").cast("long").alias("chars"))


@checked(
    "SELECT repo, path, CASE WHEN text = '' THEN 0 ELSE greatest(1, len(regexp_extract_all(text, '[^ \\n\\t\\r]+'))) END AS tokens, 'tokenizer' AS token_method FROM @FILES f"
)
def counted_by_tokenizer(spark, sf_dir):
    """A tokenizer passed in by the caller (here: blank-separated words)."""

    def words(text):
        return F.regexp_count(text, F.lit(r"[^ \n\t\r]+")).cast("long")

    counts = trees.text_counts(view(spark, sf_dir, "FILES"), tokenizer=words)
    return counts.select("repo", "path", "tokens", "token_method")


_RECOUNTED = f"""
WITH prior AS (SELECT repo, path, size, mtime, {R.tokens_of()} AS tokens, {R.lines_of()} AS lines FROM @FILES f),
now AS (SELECT repo, path, size, 5.0::DOUBLE + mtime AS mtime, text FROM @FILES_B b WHERE size % 3 = 0 UNION ALL SELECT repo, path, size, mtime, text FROM @FILES_B b WHERE size % 3 <> 0)
SELECT n.repo, n.path, n.size, n.mtime, {R.tokens_of('n.text')} AS tokens, {R.lines_of('n.text')} AS lines
FROM now n
"""


@checked(_RECOUNTED)
def recounted(spark, sf_dir, bucketed=False):
    """Counts of a later snapshot: only what changed is read again.

    Files that kept size and time keep their counts, whatever their text.
    """
    before = view(spark, sf_dir, "FILES")
    files = trees.inventory(before.drop("text"))
    empty = trees.text_counts(before).select(*ENTRY, "tokens", "lines")
    prior = files.join(empty, ENTRY).select(
        "repo", F.lit("next").alias("snapshot"), "path", "size", "mtime", F.lit("chars").alias("method"),
        F.lit(-1).cast("long").alias("read_limit"), "tokens", "lines",
    )
    later = view(spark, sf_dir, "FILES_B").withColumn(
        "mtime", F.when(F.col("size") % 3 == 0, F.col("mtime") + 5.0).otherwise(F.col("mtime"))
    )
    # Replaced blanks keep the size and the counts, so reuse and recount agree.
    bodies = later.select(*ENTRY, "text")
    bodies = trees.write_bucketed(bodies, Folder(spark, "bodies").path("bucketed")) if bucketed else bodies
    result = trees.recount(trees.inventory(later.drop("text")), bodies, cut(prior, "prior"))
    return result.select("repo", "path", "size", "mtime", "tokens", "lines")


@checked(_RECOUNTED)
def recounted_by_bucket(spark, sf_dir):
    """The same with bodies in buckets, of which only those with a changed file are read."""
    return recounted(spark, sf_dir, bucketed=True)


_MARKS = """
marks AS (SELECT repo, path, line, upper(regexp_extract(raw, '(?i)(?:^|[^\\pL\\pM\\p{Nd}\\p{Pc}])(license|copyright|secret|password)(?:$|[^\\pL\\pM\\p{Nd}\\p{Pc}])', 1)) AS kind,
  CASE WHEN length(trimmed) > 80 THEN left(trimmed, 80) || '…' ELSE trimmed END AS text FROM (
  SELECT *, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS trimmed FROM (
    SELECT repo, path, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM @FILES f) l
  WHERE regexp_matches(raw, '(?i)(?:^|[^\\pL\\pM\\p{Nd}\\p{Pc}])(license|copyright|secret|password)(?:$|[^\\pL\\pM\\p{Nd}\\p{Pc}])')) m)
"""


@checked(f"WITH {_MARKS} SELECT repo, path, line, kind, text FROM marks")
def marker_lines(spark, sf_dir):
    return markers.scan(view(spark, sf_dir, "FILES"), WORDS).drop("snapshot")


@checked(
    f"""
WITH {_MARKS}
SELECT CASE WHEN grouping(repo) = 1 THEN 'all' WHEN grouping(path) = 1 THEN 'tree' WHEN grouping(kind) = 1 THEN 'file' ELSE 'kind' END AS level,
  repo, path, kind, count(*) AS todos FROM marks GROUP BY GROUPING SETS ((repo, path, kind), (repo, path), (repo), ())
"""
)
def marker_counts(spark, sf_dir):
    return markers.counts(markers.scan(view(spark, sf_dir, "FILES"), WORDS)).drop("snapshot")


@checked(
    f"""
WITH {_MARKS}, few AS (SELECT *, 'file' AS kind2 FROM (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY line) AS n FROM marks) x WHERE n <= 3)
SELECT repo, path, line, kind, text, rank FROM (
  SELECT repo, path, line, mark AS kind, text, row_number() OVER (PARTITION BY repo ORDER BY {_KEY}, path, line) AS rank
  FROM (SELECT repo, path, line, kind AS mark, kind2 AS kind, text FROM few) f) y WHERE rank <= 20
"""
)
def marker_samples(spark, sf_dir):
    """At most three markers of a file and twenty of a tree, in listing order."""
    return markers.samples(markers.scan(view(spark, sf_dir, "FILES"), WORDS)).drop("snapshot")


@checked(
    f"""
WITH {_MARKS}, t AS (SELECT count(*) AS n FROM marks)
SELECT repo, path, line, mark AS kind, text, (SELECT n FROM t) AS todo_count, (SELECT n FROM t) > 25 AS truncated
FROM (SELECT repo, path, line, kind AS mark, 'file' AS kind, text FROM marks) m ORDER BY repo, {_KEY}, path, line LIMIT 25
"""
)
def marker_report(spark, sf_dir):
    """The flat list with a row limit; the full count shows what was cut."""
    return report.flat_todos(markers.scan(view(spark, sf_dir, "FILES"), WORDS), 25).drop("snapshot")


# ---------------------------------------------------------------- packs

_HINT = "CASE ext WHEN '.md' THEN 'markdown' WHEN '.py' THEN 'python' WHEN '.html' THEN 'html' WHEN '.json' THEN 'json' ELSE '' END"
_SECTION = f"""'## ' || path || ' (' || {R.size_label('size')} || ', ' || {R.token_label('tokens')} || ')' || chr(10) || chr(10) || ticks || {_HINT} || chr(10)
  || regexp_replace(text, '\\n+$', '') || chr(10) || ticks || chr(10)"""
_PACK = f"""
packed AS (SELECT repo, path, size, tokens, {_SECTION} AS section FROM (
  SELECT *, {R.tokens_of()} AS tokens, {R.ext_of()} AS ext,
    repeat('`', greatest(3, 1 + coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda r: length(r))), 0))) AS ticks
  FROM (SELECT * REPLACE (CASE WHEN size % 3 = 0 THEN text || ' ````` ``' || chr(10) || chr(10) ELSE text END AS text) FROM @FILES f) g) p)
"""


def _packed(spark, sf_dir):
    df = view(spark, sf_dir, "FILES")
    # Some bodies hold runs of backticks and blank last lines.
    text = F.when(F.col("size") % 3 == 0, F.concat("text", F.lit(" ````` ``\n\n"))).otherwise(F.col("text"))
    held = trees.bodies(df.select(*ENTRY, text.alias("text")))
    sizes = df.select(*ENTRY, "size")
    return report.pack(held.drop("size").join(sizes, ENTRY))


@checked(f"WITH {_PACK} SELECT repo, path, size, tokens, md5(section) AS section FROM packed")
def packed_files(spark, sf_dir):
    """Markdown sections with fences longer than any run of backticks inside."""
    return _packed(spark, sf_dir).select("repo", "path", "size", "tokens", F.md5("section").alias("section"))


@checked(
    f"""
WITH {_PACK}, t AS (SELECT repo, count(*) AS files, cast(sum(tokens) AS bigint) AS tokens FROM packed GROUP BY repo)
SELECT repo, files, tokens, '# pack — ' || cast(files AS varchar) || CASE WHEN files = 1 THEN ' file, ' ELSE ' files, ' END || {R.token_label('tokens')} AS header FROM t
"""
)
def pack_headers(spark, sf_dir):
    return report.pack_headers(_packed(spark, sf_dir)).drop("snapshot")


# ---------------------------------------------------------------- budgets

_RUN = f"""
SELECT repo, pos, text, cast(sum(length(text) - {R.others()} + 1) OVER w AS bigint) AS a, cast(sum({R.others()}) OVER w AS bigint) AS o
FROM @TURNS t WINDOW w AS (PARTITION BY repo ORDER BY pos ROWS UNBOUNDED PRECEDING)
"""


@checked(f"SELECT repo, pos, md5(text) AS text, cost_so_far FROM (SELECT *, {R.estimate('a', 'o')} AS cost_so_far FROM ({_RUN}) r) x WHERE cost_so_far <= 300")
def turns_in_budget(spark, sf_dir):
    """Rows in order while their running cost stays within a budget."""
    kept = budget.within_budget(view(spark, sf_dir, "TURNS"), 300, TREE, [F.col("pos")])
    return kept.select("repo", "pos", F.md5("text").alias("text"), "cost_so_far")


# SQL: bare and annotated listing lines of the FILES view, with depth and order.
_LINES = f"""
{ENTRIES.replace('@TREE', '(SELECT repo, path, size, mtime, 0.0 AS ctime, false AS denied, text FROM @FILES v)')},
ranked AS (SELECT *, row_number() OVER (PARTITION BY repo, {R.parent_of()} ORDER BY CASE WHEN kind = 'dir' THEN 1 ELSE 0 END, {R.fold(R.name_of())} DESC, {R.name_of()} DESC) = 1 AS last
  FROM entries WHERE path <> ''),
hops AS (SELECT repo, path, kind, unnest(list_append({R.above()}[2:], path)) AS hop FROM entries WHERE path <> ''),
pre AS (SELECT h.repo, h.path, h.kind, string_agg(CASE WHEN h.hop = h.path THEN CASE WHEN r.last THEN '└── ' ELSE '├── ' END
  ELSE CASE WHEN r.last THEN '    ' ELSE '│   ' END END, '' ORDER BY len(string_split(h.hop, '/'))) AS prefix
  FROM hops h JOIN ranked r ON r.repo = h.repo AND r.path = h.hop GROUP BY 1, 2, 3),
bare AS (SELECT repo, path, kind, len(string_split(path, '/')) AS depth, {_KEY} AS key, prefix || {R.name_of()} || CASE WHEN kind = 'dir' THEN '/' ELSE '' END AS line FROM pre
  UNION ALL SELECT repo, path, kind, 0, [], repo || '/' FROM entries WHERE path = ''),
counted AS ({COUNTED}),
plain AS (SELECT b.* REPLACE (b.line || CASE WHEN c.path IS NULL THEN '' ELSE ' (' || {R.token_label('c.tokens')} || ')' END AS line) FROM bare b LEFT JOIN counted c ON c.repo = b.repo AND c.path = b.path),
full_ AS (SELECT b.* REPLACE (b.line || CASE WHEN c.path IS NULL THEN '' ELSE ' (' || {R.token_label('c.tokens')} || ', ' || cast(c.lines AS varchar) || ' lines)' END AS line) FROM bare b LEFT JOIN counted c ON c.repo = b.repo AND c.path = b.path)
"""


def _depth_cost(name: str, depth: str) -> str:
    a, o = f"sum(length(line) - {R.others('line')} + 1)", f"sum({R.others('line')})"
    return f"SELECT repo, {R.estimate(a, o)} AS tokens FROM {name} WHERE {depth} GROUP BY repo"


def _three_listings(spark, sf_dir):
    from coppice.functions import labels

    source = view(spark, sf_dir, "FILES")
    files = cut(trees.with_directories(trees.inventory(source.drop("text"))), "files")
    counts = cut(trees.text_counts(source).select(*ENTRY, "tokens", "lines"), "counts")
    token_note = labels.token_label(F.col("tokens"))
    plain = counts.select(*ENTRY, token_note.alias("note"))
    full = counts.select(*ENTRY, F.concat(token_note, F.lit(", "), F.col("lines").cast("string"), F.lit(" lines")).alias("note"))
    return [tree.tree_lines(files, n) for n in (full, plain, None)]


@checked(
    f"""
WITH {_LINES}, e AS (
  SELECT 0 AS place, '1 bare' AS level, * FROM ({_depth_cost('bare', 'depth <= 1')}) a
  UNION ALL SELECT 1, '1', * FROM ({_depth_cost('full_', 'depth <= 1')}) b UNION ALL SELECT 2, '2', * FROM ({_depth_cost('full_', 'depth <= 2')}) c
  UNION ALL SELECT 3, '3', * FROM ({_depth_cost('full_', 'depth <= 3')}) d UNION ALL SELECT 4, 'all', * FROM ({_depth_cost('full_', 'true')}) f)
SELECT repo, place, level, tokens, tokens > 400 AS over_cap, 320 AS suggested FROM e
"""
)
def listing_costs(spark, sf_dir):
    """Tokens a listing takes at each depth, marked against a cap."""
    full, _, bare = _three_listings(spark, sf_dir)
    return budget.estimate(full, bare, cap=400).drop("snapshot")


def _fit(budget_tokens: int) -> str:
    steps = [("full_", "true", "full", None)] + [("full_", f"depth <= {d}", "full", d) for d in (6, 5, 4, 3, 2, 1)]
    steps += [("plain", "depth <= 1", "plain", 1), ("bare", "depth <= 1", "bare", 1)]
    union = " UNION ALL ".join(
        f"SELECT repo, {i} AS r, '{detail}' AS detail, cast({'NULL' if d is None else d} AS int) AS max_depth, tokens FROM ({_depth_cost(name, where)}) s{i}"
        for i, (name, where, detail, d) in enumerate(steps)
    )
    a = f"sum(length(line) - {R.others('line')} + 1) OVER w"
    o = f"sum({R.others('line')}) OVER w"
    return f"""
WITH {_LINES}, steps AS ({union}),
chosen AS (SELECT repo, arg_min({{'detail': detail, 'max_depth': max_depth, 'tokens': tokens}}, CASE WHEN tokens <= {budget_tokens} THEN r ELSE 17 - r END) AS l FROM steps GROUP BY repo),
lines AS (SELECT *, 'full' AS detail FROM full_ UNION ALL SELECT *, 'plain' FROM plain UNION ALL SELECT *, 'bare' FROM bare),
picked AS (SELECT x.repo, x.path, x.key, x.line, x.detail, c.l.max_depth AS max_depth, c.l.tokens AS level_cost FROM lines x JOIN chosen c ON c.repo = x.repo AND c.l.detail = x.detail
  WHERE c.l.max_depth IS NULL OR x.depth <= c.l.max_depth),
summed AS (SELECT *, {a} AS a, {o} AS o, row_number() OVER w AS pos, count(*) OVER (PARTITION BY repo) AS n FROM picked WINDOW w AS (PARTITION BY repo ORDER BY key, path ROWS UNBOUNDED PRECEDING)),
kept AS (SELECT *, {R.estimate('a', 'o')} AS cost FROM summed)
SELECT repo, path, detail, max_depth, pos, line, n - count(*) OVER (PARTITION BY repo) AS left_out, level_cost FROM kept WHERE cost <= {budget_tokens} OR path = ''
"""


@checked(_fit(150))
def listing_in_budget(spark, sf_dir):
    """Listings fitted to 150 tokens: less depth first, then less detail, then fewer rows."""
    return budget.fit(*_three_listings(spark, sf_dir), 150).drop("snapshot")


@checked(_fit(12))
def listing_in_tiny_budget(spark, sf_dir):
    """A budget so small that rows have to go; the root line stays."""
    return budget.fit(*_three_listings(spark, sf_dir), 12).drop("snapshot")


# ---------------------------------------------------------------- snapshots

_JOINED = """
both_ AS (SELECT coalesce(a.repo, b.repo) AS repo, coalesce(a.path, b.path) AS path, a.size AS size_a, b.size AS size_b,
  CASE WHEN b.path IS NULL THEN 'only_a' WHEN a.path IS NULL THEN 'only_b' WHEN a.size <> b.size THEN 'changed'
    WHEN a.size > 0 AND md5(a.text) <> md5(b.text) THEN 'changed' END AS status
  FROM @FILES a FULL JOIN @FILES_B b ON b.repo = a.repo AND b.path = a.path)
"""


@checked(f"WITH {_JOINED} SELECT * FROM both_ WHERE status IS NOT NULL")
def compared_trees(spark, sf_dir):
    return diff.compare(view(spark, sf_dir, "FILES"), view(spark, sf_dir, "FILES_B"))


@checked("SELECT repo, path, 'changed' AS status, size AS size_a, size AS size_b FROM @FILES f WHERE right(text, 1) = '.' AND size % 3 = 0")
def compared_ends(spark, sf_dir):
    """Bodies of the same size that differ in their last character only."""
    before = view(spark, sf_dir, "FILES")
    end = F.when(F.col("text").endswith(".") & (F.col("size") % 3 == 0), F.lit("!")).otherwise(F.right("text", F.lit(1)))
    after = before.withColumn("text", F.concat(F.expr("left(text, length(text) - 1)"), end))
    return diff.compare(before, after)


@checked(
    f"""
WITH {_JOINED}, t AS (SELECT repo, count(*) FILTER (status = 'only_a') AS only_a, count(*) FILTER (status = 'only_b') AS only_b, count(*) FILTER (status = 'changed') AS changed,
  cast(coalesce(sum(size_a), 0) AS bigint) AS total_a, cast(coalesce(sum(size_b), 0) AS bigint) AS total_b FROM both_ GROUP BY repo)
SELECT *, total_b - total_a AS delta, CASE WHEN total_b >= total_a THEN '+' ELSE '-' END || {R.size_label('abs(total_b - total_a)')} AS delta_label FROM t
"""
)
def compared_totals(spark, sf_dir):
    return diff.compare_totals(view(spark, sf_dir, "FILES"), view(spark, sf_dir, "FILES_B"))


@checked("SELECT repo, path, size FROM @FILES_B b")
def baseline_bodies(spark, sf_dir):
    """Bodies of one snapshot out of a table that holds several."""
    both = view(spark, sf_dir, "FILES").unionByName(view(spark, sf_dir, "FILES_B"))
    held = trees.at_snapshot(both, "next")
    return held.select("repo", "path", F.octet_length("text").cast("long").alias("size"))


# ---------------------------------------------------------------- ignore files, flat report


@checked(
    """
WITH l AS (SELECT 'd' || cast(doc_id AS varchar) AS repo, lang AS dir, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line_no
  FROM (SELECT doc_id, lang, '# note' || chr(10) || chr(10) || '  ' || replace(text, '. ', chr(10)) || '  ' AS text FROM documents) d),
s AS (SELECT repo, dir, line_no, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS pattern FROM l)
SELECT * FROM s WHERE pattern <> '' AND pattern NOT LIKE '#%'
"""
)
def ignore_file_lines(spark, sf_dir):
    """Rules out of ignore files: every document read as one."""
    docs = table(spark, sf_dir, "documents")
    contents = docs.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("repo"),
        F.lit("head").alias("snapshot"),
        F.concat("lang", F.lit("/.gitignore")).alias("path"),
        F.concat(F.lit("# note\n\n  "), F.replace("text", F.lit(". "), F.lit("\n")), F.lit("  ")).alias("text"),
    )
    return trees.ignore_rules(contents).drop("snapshot")


@checked(
    f"""
WITH c AS ({COUNTED}), {_MARKS}, m AS (SELECT repo, path, count(*) AS n FROM marks GROUP BY 1, 2)
SELECT f.repo, f.path, f.size, c.ext, cast(f.mtime AS bigint) AS mtime_epoch, c.tokens, c.lines, coalesce(m.n, 0) AS todo_count, false AS is_entry, false AS is_config,
  CASE WHEN c.ext = '.py' THEN true END AS has_test, cast(NULL AS bigint) AS imports, cast(NULL AS bigint) AS imported_by
FROM @FILES f JOIN c ON c.repo = f.repo AND c.path = f.path LEFT JOIN m ON m.repo = f.repo AND m.path = f.path
"""
)
def flat_report(spark, sf_dir):
    """The twelve-column report; columns of analyses not run stay blank."""
    from coppice.operators import summary, testsgap

    df = view(spark, sf_dir, "FILES")
    files = trees.inventory(df.drop("text"))
    annotated = summary.annotate(
        files,
        counts=trees.text_counts(df),
        todos=markers.scan(df, WORDS),
        entries=testsgap.entry_points(files),
        configs=testsgap.config_files(files),
        untested=testsgap.config_files(files).where(F.lit(False)),
    )
    return report.file_report(annotated).drop("snapshot")


@checked(
    f"""
SELECT repo, {R.parent_of()} AS dir, cast(sum(length(text) - {R.others()}) AS bigint) AS ascii_chars, cast(sum({R.others()}) AS bigint) AS other_chars,
  {R.estimate(f'sum(length(text) - {R.others()})', f'sum({R.others()})')} AS tokens FROM @FILES f GROUP BY 1, 2
"""
)
def directory_tokens(spark, sf_dir):
    """Token cost of each directory's files joined up: summed characters, one rounding."""
    counts = trees.text_counts(view(spark, sf_dir, "FILES"))
    summed = counts.groupBy("repo", paths.dirname(F.col("path")).alias("dir")).agg(
        F.sum("ascii_chars").alias("ascii_chars"), F.sum("other_chars").alias("other_chars")
    )
    return summed.withColumn("tokens", measure.tokens_of(F.col("ascii_chars"), F.col("other_chars")))


@checked(
    f"""
WITH {ENTRIES} SELECT t.repo, c.code FROM (SELECT DISTINCT repo FROM entries) t,
  (VALUES ('git_log_unavailable'), ('gitignore_degraded'), ('root_gitignored')) c(code)
WHERE (c.code = 'git_log_unavailable' AND t.repo NOT IN (SELECT repo FROM @TREE x WHERE size > 9000)) OR (c.code = 'gitignore_degraded' AND t.repo NOT IN (SELECT repo FROM @TREE x WHERE denied))
  OR (c.code = 'root_gitignored' AND t.repo IN (SELECT repo FROM @TREE x WHERE size % 97 = 0))
"""
)
def error_rows(spark, sf_dir):
    """What could not be had in full, per tree."""
    files = trees.inventory(view(spark, sf_dir, "TREE").drop("text"))
    out = report.error_rows(
        files,
        commits=files.where(F.col("size") > 9000),
        exact_ignored=rollup.denied_entries(files),
        ignored_roots=files.where(F.col("size") % 97 == 0),
    )
    return out.select("repo", "code")
