"""Checked queries on inventories: sources, filters, roll-ups, order, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from coppice.functions import labels, names, paths
from coppice.operators import dupes, rollup, testsgap, tree, visible
from coppice.plans import registry as R
from coppice.plans.registry import checked, table, view
from coppice.schema import ENTRY, TREE
from coppice.session import cut
from coppice.sinks import report
from coppice.sources import trees

NOW = 1_700_000_000.0


def _files(spark, sf_dir, name="FILES"):
    return trees.inventory(view(spark, sf_dir, name).drop("text"))


def _listed(spark, sf_dir, name="TREE"):
    return trees.with_directories(_files(spark, sf_dir, name))


# SQL: every entry of the TREE view, directories included.
ENTRIES = f"""
entries AS (
  SELECT repo, path, 'file' AS kind, size, mtime, ctime, denied FROM @TREE t
  UNION ALL
  SELECT DISTINCT repo, unnest({R.above()}), 'dir', NULL, NULL, NULL, false FROM @TREE t)
"""

COUNTED = f"""
SELECT repo, path, {R.ext_of()} AS ext, {R.tokens_of()} AS tokens, {R.lines_of()} AS lines FROM @FILES f
"""


@checked(
    f"""
WITH c AS ({COUNTED})
SELECT CASE WHEN grouping(repo) = 1 THEN 'all' WHEN grouping(type) = 1 THEN 'tree' ELSE 'type' END AS level,
  repo, type, count(*) AS files, cast(sum(lines) AS bigint) AS lines, cast(sum(tokens) AS bigint) AS tokens
FROM (SELECT *, CASE WHEN ext = '' THEN '(no ext)' ELSE ext END AS type FROM c) x
GROUP BY GROUPING SETS ((repo, type), (repo), ())
"""
)
def type_breakdown(spark, sf_dir):
    """Files, lines and tokens by type, tree and overall."""
    files, contents = trees.from_table(view(spark, sf_dir, "FILES"), "repo", "path", "text")
    counts = trees.text_counts(contents)
    return rollup.type_totals(files, counts).drop("snapshot")


@checked(
    f"""
WITH {ENTRIES}, up AS (
  SELECT repo, unnest(CASE WHEN path = '' THEN [''] WHEN kind = 'dir' THEN list_append({R.above()}, path) ELSE {R.above()} END) AS dir,
    kind, CASE WHEN kind = 'file' THEN size ELSE 0 END AS size, denied FROM entries)
SELECT repo, dir, cast(sum(size) AS bigint) AS size, cast(sum(CASE WHEN kind = 'file' THEN 1 ELSE 0 END) AS bigint) AS files_below,
  bool_or(denied) AS partial FROM up GROUP BY repo, dir
"""
)
def directory_rollup(spark, sf_dir):
    """Bytes and files below every directory, with the partial flag."""
    return rollup.directory_sizes(_listed(spark, sf_dir)).drop("snapshot")


@checked(
    f"""
WITH {ENTRIES}
SELECT repo, {R.parent_of()} AS dir, cast(sum(CASE WHEN kind = 'dir' THEN 1 ELSE 0 END) AS bigint) AS dirs,
  cast(sum(CASE WHEN kind <> 'dir' THEN 1 ELSE 0 END) AS bigint) AS files
FROM entries WHERE path <> '' GROUP BY 1, 2
"""
)
def direct_children(spark, sf_dir):
    return rollup.child_counts(_listed(spark, sf_dir)).drop("snapshot")


@checked(
    f"SELECT repo, CASE WHEN {R.ext_of()} = '' THEN '(no ext)' ELSE {R.ext_of()} END AS type, count(*) AS files FROM @TREE t GROUP BY 1, 2"
)
def extension_histogram(spark, sf_dir):
    return rollup.extension_counts(_files(spark, sf_dir, "TREE")).drop("snapshot")


@checked(
    f"""
SELECT repo, path, {R.parent_of()} AS parent, {R.name_of()} AS name, {R.ext_of()} AS ext,
  left({R.name_of()}, length({R.name_of()}) - length({R.ext_of()})) AS stem,
  len(string_split(path, '/')) AS depth FROM @TREE t
"""
)
def path_parts(spark, sf_dir):
    files = _files(spark, sf_dir, "TREE")
    return files.select("repo", "path", "parent", "name", "ext", paths.stem(F.col("name")).alias("stem"), F.col("depth").cast("long"))


@checked(
    f"""
SELECT repo, path, kind, CASE WHEN path = '' THEN 0 ELSE len(string_split(path, '/')) END AS depth, size FROM (
  SELECT 'd' || cast(doc_id AS varchar) AS repo, unnest([source || '/a/' || lang || '.txt', 'b' || cast(doc_id AS varchar)]) AS path, 'file' AS kind,
    unnest([strlen(text), 1]) AS size FROM documents
  UNION ALL
  SELECT 'd' || cast(doc_id AS varchar), unnest(['', source, source || '/a']), 'dir', NULL FROM documents) x
"""
)
def manifest_files(spark, sf_dir):
    """Trees given as lists of files with content; directories are implied."""
    item = lambda p, t: F.struct(p.alias("path"), t.alias("content"), F.lit(1.0).alias("mtime"))
    manifests = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("repo"),
        F.lit("head").alias("snapshot"),
        F.array(
            item(F.concat("source", F.lit("/a/"), "lang", F.lit(".txt")), F.col("text")),
            item(F.concat(F.lit("b"), F.col("doc_id").cast("string")), F.lit("x")),
        ).alias("files"),
        F.lit(NOW).alias("now"),
    )
    files, _ = trees.from_manifests(manifests)
    return files.select("repo", "path", "kind", F.col("depth").cast("long"), "size")


@checked(
    f"""
WITH p AS (SELECT repo, path, {R.parent_of()} || '/.././x//../' || {R.name_of()} AS messy FROM @TREE t),
n AS (SELECT repo, path, messy, list_reduce(list_prepend('', string_split(messy, '/')),
  lambda a, c: CASE WHEN c = '' OR c = '.' THEN a
    WHEN c = '..' AND a <> '' AND list_extract(string_split(a, '/'), -1) <> '..' THEN regexp_replace(a, '/?[^/]*$', '')
    WHEN a = '' THEN c ELSE a || '/' || c END) AS clean FROM p)
SELECT repo, path, clean, '../' || {R.name_of('path')} AS from_sibling FROM n
"""
)
def normalized_paths(spark, sf_dir):
    files = _files(spark, sf_dir, "TREE")
    messy = F.concat("parent", F.lit("/.././x//../"), "name")
    return files.select(
        "repo",
        "path",
        paths.normpath(messy).alias("clean"),
        paths.relative_to(F.col("path"), paths.join(F.col("parent"), F.lit("other"))).alias("from_sibling"),
    )


@checked(
    f"""
SELECT repo, path, {R.size_label('size')} AS size_label, {R.size_label('size * 1013', 'denied')} AS big_label,
  {R.token_label('size')} AS token_label, {R.token_label('size * 50')} AS big_tokens,
  cast(size % 3 AS varchar) || CASE WHEN denied THEN '+' ELSE '' END || CASE WHEN size % 3 = 1 AND NOT denied THEN ' dir, ' ELSE ' dirs, ' END ||
  cast(size % 2 AS varchar) || CASE WHEN denied THEN '+' ELSE '' END || CASE WHEN size % 2 = 1 AND NOT denied THEN ' file' ELSE ' files' END AS count_label
FROM @TREE t
"""
)
def quantity_labels(spark, sf_dir):
    files = _files(spark, sf_dir, "TREE")
    size, denied = F.col("size"), F.col("denied")
    return files.select(
        "repo",
        "path",
        labels.size_label(size).alias("size_label"),
        labels.size_label(size * 1013, denied).alias("big_label"),
        labels.token_label(size).alias("token_label"),
        labels.token_label(size * 50).alias("big_tokens"),
        labels.count_label(size % 3, size % 2, denied).alias("count_label"),
    )


def _ago(per: int, unit: str) -> str:
    return f"CASE WHEN s // {per} = 1 THEN '1 {unit} ago' ELSE cast(s // {per} AS varchar) || ' {unit}s ago' END"


AGE = f"""CASE WHEN s < 60 THEN 'now' WHEN s < 3600 THEN {_ago(60, 'min')} WHEN s < 86400 THEN {_ago(3600, 'hour')}
  WHEN s < 172800 THEN 'yesterday' WHEN s < 604800 THEN {_ago(86400, 'day')} WHEN s < 2592000 THEN {_ago(604800, 'week')}
  WHEN s < 31536000 THEN {_ago(2592000, 'month')} ELSE {_ago(31536000, 'year')} END"""


@checked(
    f"""
SELECT repo, path, {AGE} AS age,
  CASE WHEN s < 3600 THEN 0 WHEN s < 86400 THEN 1 WHEN s < 604800 THEN 2 WHEN s < 2592000 THEN 3 WHEN s < 15552000 THEN 4 ELSE 5 END AS heat_age,
  CASE WHEN size >= 104857600 THEN 0 WHEN size >= 10485760 THEN 1 WHEN size >= 1048576 THEN 2 WHEN size >= 102400 THEN 3 WHEN size >= 10240 THEN 4 ELSE 5 END AS heat_size
FROM (SELECT *, cast(1700000000 - mtime AS bigint) AS s FROM @TREE t) x
"""
)
def age_and_heat(spark, sf_dir):
    files = _files(spark, sf_dir, "TREE")
    return files.select(
        "repo",
        "path",
        labels.age_label(F.lit(NOW), F.col("mtime")).alias("age"),
        labels.heat_by_age(F.lit(NOW), F.col("mtime")).alias("heat_age"),
        labels.heat_by_size(F.col("size")).alias("heat_size"),
    )


def _bits(shift: int, special: int, mark: str) -> str:
    on = lambda bit: f"(mode & {bit}) <> 0"
    x = on(1 << shift)
    return (
        f"CASE WHEN {on(4 << shift)} THEN 'r' ELSE '-' END || CASE WHEN {on(2 << shift)} THEN 'w' ELSE '-' END || "
        f"CASE WHEN {x} AND {on(special)} THEN '{mark}' WHEN {on(special)} THEN '{mark.upper()}' WHEN {x} THEN 'x' ELSE '-' END"
    )


@checked(
    f"SELECT repo, path, '-' || {_bits(6, 2048, 's')} || {_bits(3, 1024, 's')} || {_bits(0, 512, 't')} AS perms FROM @TREE t"
)
def permission_labels(spark, sf_dir):
    files = _files(spark, sf_dir, "TREE")
    return files.select("repo", "path", labels.mode_label(F.col("mode")).alias("perms"))


@checked(
    f"""
SELECT repo, path, md5(regexp_replace(text, '[\\x00-\\x1F\\x7F\\x{{80}}-\\x{{9F}}]', '?', 'g')) AS printable,
  md5({R.fold('text')}) AS folded, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS stripped,
  CASE WHEN length(text) > 30 THEN left(text, 30) || '…' ELSE text END AS short
FROM @FILES f
"""
)
def text_clean_up(spark, sf_dir):
    df = view(spark, sf_dir, "FILES")
    text = F.col("text")
    return df.select(
        "repo",
        "path",
        F.md5(labels.printable(text)).alias("printable"),
        F.md5(paths.casefold(text)).alias("folded"),
        F.md5(paths.strip(text)).alias("stripped"),
        paths.truncate(text, 30).alias("short"),
    )


@checked(
    f"""
SELECT repo, path, regexp_matches({R.name_of()}, '^.*_[0-9]?[02468]\\..*$') AS even_tail,
  regexp_matches(path, '^[^a-f].*/d[0-3]/.*$') AS first_dirs, regexp_matches(path, '^.*[.\\]-]md$') AS odd_class,
  regexp_matches({R.name_of()}, '^.*\\[.*$') AS open_bracket,
  CASE WHEN path LIKE 'en/%.md' THEN path[4:-4] END AS star
FROM @TREE t
"""
)
def glob_matches(spark, sf_dir):
    files = _files(spark, sf_dir, "TREE")
    hit = lambda c, g: F.rlike(F.col(c), paths.glob_to_regex(F.lit(g)))
    return files.select(
        "repo",
        "path",
        (hit("name", "*_[02468].*") | hit("name", "*_[0-9][02468].*")).alias("even_tail"),
        hit("path", "[!a-f]*/d[0-3]/*").alias("first_dirs"),
        hit("path", "*[].-]md").alias("odd_class"),
        hit("name", "*[*").alias("open_bracket"),
        paths.star_match(F.lit("en/*.md"), F.col("path")).alias("star"),
    )


HIDDEN = "regexp_matches(path, '(^|/)\\.')"


@checked(f"WITH {ENTRIES} SELECT repo, path, kind FROM entries WHERE NOT {HIDDEN}")
def without_hidden(spark, sf_dir):
    return visible.not_hidden(_listed(spark, sf_dir)).select("repo", "path", "kind")


@checked(
    f"""
WITH {ENTRIES} SELECT repo, path, kind FROM entries
WHERE NOT list_bool_or(list_prepend(false, list_transform(string_split(path, '/'), lambda c: regexp_matches(c, '^d[12]$') OR regexp_matches(c, '^Secret_.*$'))))
  AND (kind = 'dir' OR regexp_matches({R.name_of()}, '^.*\\.(md|txt|TXT)$'))
"""
)
def excluded_and_included(spark, sf_dir):
    out = visible.exclude(_listed(spark, sf_dir), ["d[12]", "Secret_*"])
    return visible.include(out, ["*.md", "*.txt", "*.TXT"]).select("repo", "path", "kind")


@checked(
    f"WITH {ENTRIES} SELECT repo, path, kind FROM entries WHERE kind = 'dir' OR ({R.ext_of()} = '.txt' AND size BETWEEN 500 AND 5000)"
)
def typed_and_sized(spark, sf_dir):
    out = visible.of_type(_listed(spark, sf_dir), "TXT")
    return visible.sized(out, 500, 5000).select("repo", "path", "kind")


@checked(
    f"""
WITH {ENTRIES}, kept AS (SELECT * FROM entries WHERE kind = 'dir' OR {R.ext_of()} = '.md'),
hold AS (SELECT DISTINCT repo, unnest({R.above()}) AS path FROM kept WHERE kind = 'file' AND len(string_split(path, '/')) <= 3)
SELECT repo, path, kind FROM kept WHERE kind = 'file' OR (repo, path) IN (SELECT (repo, path) FROM hold)
"""
)
def pruned(spark, sf_dir):
    return visible.prune(visible.of_type(_listed(spark, sf_dir), "md"), 3).select("repo", "path", "kind")


@checked(
    f"""WITH {ENTRIES} SELECT repo, path, kind FROM entries WHERE kind = 'dir' AND (path = '' OR len(string_split(path, '/')) <= 2)"""
)
def shallow_directories(spark, sf_dir):
    out = visible.dirs_only(_listed(spark, sf_dir))
    return visible.to_depth(out, 2).select("repo", "path", "kind")


# SQL: the rules of the RULES view by hand, as (dir depth, line, negated, hit).
_IGNORED = f"""
hits AS (
  SELECT repo, path, kind, unnest([
    CASE WHEN regexp_matches(path, '^(?:.*/)?.*\\.log$') THEN {{'r': 1001, 'neg': false}} END,
    CASE WHEN regexp_matches(path, '^(?:.*/)?log_.[0-4].*\\.log$') THEN {{'r': 1002, 'neg': true}} END,
    CASE WHEN kind = 'dir' AND regexp_matches(path, '^(?:.*/)?build$') THEN {{'r': 1003, 'neg': false}} END,
    CASE WHEN kind = 'dir' AND regexp_matches(path, '^fr/d[1-3]$') THEN {{'r': 1004, 'neg': false}} END,
    CASE WHEN regexp_matches(path, '^(?:.*/)?Doc_.*$') THEN {{'r': 1005, 'neg': false}} END,
    CASE WHEN path LIKE 'en/%' AND path = 'en/d5' THEN {{'r': 2001, 'neg': false}} END,
    CASE WHEN path LIKE 'en/%' AND regexp_matches(path, '^(?:.*/)?Doc_.*[^02468]\\.md$') THEN {{'r': 2002, 'neg': true}} END,
    CASE WHEN path LIKE '__/d6/%' AND regexp_matches(path, '^(?:.*/)?a\\.tar.*$') THEN {{'r': 3001, 'neg': false}} END]) AS h
  FROM entries WHERE path <> ''),
ign AS (SELECT repo, path, kind FROM hits WHERE h IS NOT NULL GROUP BY repo, path, kind HAVING NOT arg_max(h.neg, h.r)),
gone AS (
  SELECT DISTINCT e.repo, e.path FROM (SELECT repo, path, unnest(list_append({R.above()}, path)) AS hole FROM entries WHERE path <> '') e
  JOIN ign ON ign.repo = e.repo AND ign.path = e.hole)
"""


@checked(
    f"""
WITH {ENTRIES}, {_IGNORED}
SELECT repo, path, kind FROM entries WHERE (repo, path) NOT IN (SELECT (repo, path) FROM gone)
"""
)
def without_ignored(spark, sf_dir):
    """Nested ignore files, last match wins, ignored directories hide their subtree."""
    return visible.apply_ignore(_listed(spark, sf_dir), view(spark, sf_dir, "RULES")).select("repo", "path", "kind")


@checked(
    f"""
WITH {ENTRIES}, ign AS (SELECT repo, path FROM entries WHERE (kind = 'dir' AND regexp_matches(path, '/tests/d[0-2]$')) OR path LIKE '%.gz'),
gone AS (SELECT DISTINCT e.repo, e.path FROM (SELECT repo, path, unnest(list_append({R.above()}, path)) AS hole FROM entries WHERE path <> '') e
  JOIN ign ON ign.repo = e.repo AND ign.path = e.hole)
SELECT repo, path, kind FROM entries WHERE (repo, path) NOT IN (SELECT (repo, path) FROM gone)
"""
)
def without_ignored_set(spark, sf_dir):
    """An exact set of ignored paths instead of rules."""
    listed = _listed(spark, sf_dir)
    ignored = listed.where(
        ((F.col("kind") == "dir") & F.col("path").rlike("/tests/d[0-2]$")) | F.endswith("path", F.lit(".gz"))
    ).select(*ENTRY)
    return visible.apply_ignored_set(listed, ignored).select("repo", "path", "kind")


@checked(
    f"""
WITH {ENTRIES}, {_IGNORED}, seen AS (
  SELECT repo, path, kind FROM entries WHERE (repo, path) NOT IN (SELECT (repo, path) FROM gone) AND NOT {HIDDEN}
    AND NOT list_bool_or(list_prepend(false, list_transform(string_split(path, '/'), lambda c: c = 'd4')))
    AND (kind = 'dir' OR size >= 400)),
hold AS (SELECT DISTINCT repo, unnest({R.above()}) AS path FROM seen WHERE kind = 'file')
SELECT repo, path, kind FROM seen WHERE kind = 'file' OR (repo, path) IN (SELECT (repo, path) FROM hold)
"""
)
def visible_entries(spark, sf_dir):
    """All filters at once, in their order."""
    return visible.visible(
        _listed(spark, sf_dir), view(spark, sf_dir, "RULES"), excludes=["d4"], min_size=400, pruned=True
    ).select("repo", "path", "kind")


_LOW = f"lower({R.name_of()})"


@checked(
    f"""
SELECT repo, path FROM @TREE t WHERE {_LOW} = '.env' OR ({_LOW} LIKE '.env.%' AND NOT contains({_LOW}, 'example') AND NOT contains({_LOW}, 'sample'))
  OR {R.ext_of()} IN ('.pem', '.key', '.p12', '.pfx', '.keystore', '.jks') OR regexp_matches({_LOW}, '^id_(rsa|ed25519|ecdsa)')
  OR {_LOW} IN ('credentials.json', 'service-account.json', '.npmrc', '.pypirc', '.netrc', '.htpasswd') OR contains({_LOW}, 'secret')
"""
)
def sensitive_names(spark, sf_dir):
    return visible.sensitive(_files(spark, sf_dir, "TREE")).drop("snapshot")


@checked(
    f"""
SELECT repo, path, {_LOW} IN ('main.py', 'makefile') AS is_entry, {_LOW} IN ('makefile') OR {_LOW} IN ('package.json') AND false AS is_config,
  regexp_matches(left({_LOW}, length({_LOW}) - length({R.ext_of()})), '^test_|(_test|\\.test|\\.spec)$') AS is_test,
  regexp_matches(left({_LOW}, length({_LOW}) - length({R.ext_of()})), '^test_|(_test|\\.test|\\.spec)$') OR regexp_matches(path, '^tests?/|/tests?/|/__tests__/') AS is_testish,
  {R.ext_of()} IN ('.py', '.js', '.jsx', '.ts', '.tsx', '.go', '.rs') AS applies
FROM @TREE t
"""
)
def name_flags(spark, sf_dir):
    files = _files(spark, sf_dir, "TREE")
    flags = testsgap.test_flags(files)
    return files.select(
        *ENTRY,
        names.is_entry_name(F.col("name")).alias("is_entry"),
        names.is_config_name(F.col("name")).alias("is_config"),
    ).join(flags, ENTRY).drop("snapshot")


# ---------------------------------------------------------------- order

_KEY = f"""list_transform(string_split(path, '/'), lambda c, i: {{'g': CASE WHEN i = len(string_split(path, '/')) AND kind <> 'dir' THEN 1 ELSE 0 END,
  'f': {R.fold('c')}, 'n': c}})"""


@checked(
    f"""
WITH {ENTRIES} SELECT repo, path, row_number() OVER (PARTITION BY repo, {R.parent_of()} ORDER BY kind, {R.fold(R.name_of())}, {R.name_of()}) AS rank
FROM (SELECT * REPLACE (CASE WHEN kind = 'dir' THEN 0 ELSE 1 END AS kind) FROM entries) e WHERE path <> ''
"""
)
def siblings_by_name(spark, sf_dir):
    return tree.sibling_ranks(_listed(spark, sf_dir)).select("repo", "path", "rank")


_TOTAL = f"""
total AS (
  SELECT e.repo, e.path, e.kind, e.mtime, CASE WHEN e.kind = 'dir' THEN coalesce(d.size, 0) ELSE e.size END AS size
  FROM entries e LEFT JOIN (SELECT repo, unnest({R.above()}) AS path, size FROM @TREE t) u ON false
  LEFT JOIN (SELECT repo, path, cast(sum(size) AS bigint) AS size FROM (SELECT repo, unnest({R.above()}) AS path, size FROM @TREE t) a GROUP BY 1, 2) d
  ON d.repo = e.repo AND d.path = e.path)
"""


@checked(
    f"""
WITH {ENTRIES}, {_TOTAL}
SELECT repo, path, row_number() OVER (PARTITION BY repo, {R.parent_of()} ORDER BY CASE WHEN kind = 'dir' THEN 1 ELSE 0 END, size, {R.name_of()}) AS rank
FROM total WHERE path <> ''
"""
)
def siblings_by_size_reversed(spark, sf_dir):
    """Smallest first (reversed size order), files before directories."""
    return tree.sibling_ranks(_listed(spark, sf_dir), "size", reverse=True, files_first=True).select("repo", "path", "rank")


@checked(f"WITH {ENTRIES} SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY CASE WHEN path = '' THEN [] ELSE {_KEY} END) AS pos FROM entries")
def depth_first_positions(spark, sf_dir):
    return tree.positions(tree.tree_keys(_listed(spark, sf_dir))).select("repo", "path", "pos")


@checked(
    f"""
WITH {ENTRIES}, {_TOTAL}, r AS (
  SELECT repo, path, row_number() OVER (PARTITION BY repo, {R.parent_of()} ORDER BY CASE WHEN kind = 'dir' THEN 0 ELSE 1 END, size DESC, {R.name_of()}) AS rank
  FROM total WHERE path <> ''),
k AS (SELECT e.repo, e.path, list(r.rank ORDER BY len(string_split(e.hop, '/'))) AS key
  FROM (SELECT repo, path, unnest(list_append({R.above()}[2:], path)) AS hop FROM entries WHERE path <> '') e
  JOIN r ON r.repo = e.repo AND r.path = e.hop GROUP BY 1, 2 UNION ALL SELECT repo, path, [] FROM entries WHERE path = '')
SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY key) AS pos FROM k
"""
)
def depth_first_by_size(spark, sf_dir):
    """Listing order with the largest entry of each directory first."""
    return tree.positions(tree.tree_keys(_listed(spark, sf_dir), "size")).select("repo", "path", "pos")


@checked(
    f"""
WITH {ENTRIES}, {_TOTAL}
SELECT * FROM (SELECT repo, path, kind, size, row_number() OVER (PARTITION BY repo, kind ORDER BY size DESC, path) AS rank FROM total WHERE path <> '') x WHERE rank <= 5
"""
)
def largest_per_tree(spark, sf_dir):
    return tree.largest(_listed(spark, sf_dir), 5).drop("snapshot")


@checked(
    f"""
WITH {ENTRIES}, {_TOTAL}
SELECT * FROM (SELECT repo, path, kind, size, row_number() OVER (PARTITION BY kind ORDER BY size DESC, repo, path) AS rank FROM total WHERE path <> '') x WHERE rank <= 20
"""
)
def largest_overall(spark, sf_dir):
    return tree.largest(_listed(spark, sf_dir), 20, per_tree=False).drop("snapshot")


@checked(
    f"""
WITH t AS (SELECT repo, path, 'file' AS kind, CASE WHEN {R.ext_of()} = '' THEN '(no ext)' ELSE {R.ext_of()} END AS type FROM @TREE t),
c AS (SELECT repo, type, count(*) AS files, min({_KEY}) AS first FROM t GROUP BY 1, 2)
SELECT repo, type, files, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY files DESC, first) AS rank FROM c) x WHERE rank <= 8
"""
)
def top_extensions(spark, sf_dir):
    """Ties go by first appearance in listing order."""
    return tree.top_extensions(_files(spark, sf_dir, "TREE")).drop("snapshot")


@checked(
    f"""
WITH t AS (SELECT repo, path, 'file' AS kind, CASE WHEN ext = '' THEN '(no ext)' ELSE ext END AS type, tokens, lines FROM ({COUNTED}) c),
c AS (SELECT repo, type, count(*) AS files, cast(sum(tokens) AS bigint) AS tokens, cast(sum(lines) AS bigint) AS lines, min({_KEY}) AS first FROM t GROUP BY 1, 2)
SELECT repo, type, files, tokens, lines, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY tokens DESC, first) AS rank FROM c) x WHERE rank <= 6
"""
)
def top_types_by_tokens(spark, sf_dir):
    files, contents = trees.from_table(view(spark, sf_dir, "FILES"), "repo", "path", "text")
    return tree.top_types_by_tokens(files, trees.text_counts(contents)).drop("snapshot")


@checked(
    f"""
WITH {ENTRIES}, {_TOTAL}
SELECT t.repo, t.path, t.kind, t.size, p.size AS parent_size, CASE WHEN p.size = 0 THEN 0 ELSE least(100, cast(floor(t.size * 100.0::DOUBLE / p.size) AS bigint)) END AS percent,
  '[' || repeat('█', cast(round_even(percent * 10 / 100.0::DOUBLE, 0) AS bigint)) || repeat('░', 10 - cast(round_even(percent * 10 / 100.0::DOUBLE, 0) AS bigint))
    || ']' || lpad(cast(percent AS varchar), 4, ' ') || '%' AS bar
FROM total t JOIN total p ON p.repo = t.repo AND p.path = {R.parent_of('t.path')} AND p.kind = 'dir' WHERE t.path <> ''
"""
)
def parent_shares(spark, sf_dir):
    return rollup.shares(_listed(spark, sf_dir)).drop("snapshot", "parent")


def _sizes(spark, sf_dir):
    """The inventory of the FILES view, without its bodies."""
    return view(spark, sf_dir, "FILES").select(*TREE, F.lit("file").alias("kind"), "size")


@checked(
    """
WITH d AS (SELECT repo, path, size, md5(text) AS h FROM @FILES f WHERE size > 0),
g AS (SELECT repo, size, h, count(*) AS copies, min(path) AS path FROM d GROUP BY 1, 2, 3 HAVING count(*) >= 2)
SELECT repo, size, copies, path, size * (copies - 1) AS wasted FROM g
"""
)
def duplicate_groups(spark, sf_dir):
    bodies = dupes.of_repeated_size(view(spark, sf_dir, "FILES"), _sizes(spark, sf_dir))
    return dupes.groups(dupes.digests(bodies)).drop("snapshot", "digest")


@checked(
    """
WITH d AS (SELECT repo, path, size, md5(text) AS h FROM @FILES f WHERE size > 0),
g AS (SELECT size, h, count(*) AS copies FROM d GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT d.repo, d.path, d.size, g.copies, d.size * (g.copies - 1) AS wasted FROM d JOIN g ON g.size = d.size AND g.h = d.h
"""
)
def duplicate_members_everywhere(spark, sf_dir):
    """Copies across all trees, one row per file."""
    bodies = dupes.of_repeated_size(view(spark, sf_dir, "FILES"), _sizes(spark, sf_dir), across=True)
    digested = cut(dupes.digests(bodies), "digests")
    grouped = dupes.groups(digested, across=True)
    return dupes.members(digested, grouped, across=True).drop("snapshot", "digest")


# ---------------------------------------------------------------- node rows, lines


@checked(
    f"""
WITH {ENTRIES}, {_TOTAL}, kids AS (
  SELECT repo, {R.parent_of()} AS path, count(*) FILTER (kind = 'dir') AS dirs, count(*) FILTER (kind <> 'dir') AS files FROM entries WHERE path <> '' GROUP BY 1, 2),
bad AS (SELECT DISTINCT repo, unnest({R.above()}) AS path FROM @TREE t WHERE denied)
SELECT 1 AS schema_version, t.repo, t.path, CASE WHEN t.path <> '' THEN {R.parent_of('t.path')} END AS parent, {R.name_of('t.path')} AS name,
  CASE WHEN t.path = '' THEN 0 ELSE len(string_split(t.path, '/')) END AS depth, CASE WHEN t.kind = 'dir' THEN 'directory' ELSE 'file' END AS type,
  t.size, CASE WHEN t.kind = 'dir' AND b.path IS NOT NULL THEN {R.size_label('t.size', 'true')} ELSE {R.size_label('t.size')} END AS size_human,
  CASE WHEN t.kind <> 'dir' THEN {R.ext_of('t.path')} END AS ext, CASE WHEN t.kind = 'dir' THEN coalesce(k.dirs, 0) END AS dirs,
  CASE WHEN t.kind = 'dir' THEN coalesce(k.files, 0) END AS files,
  t.kind = 'dir' AND t.path <> '' AND len(string_split(t.path, '/')) >= 3 AND coalesce(k.dirs, 0) + coalesce(k.files, 0) > 0 AS truncated
FROM total t LEFT JOIN kids k ON k.repo = t.repo AND k.path = t.path AND t.kind = 'dir' LEFT JOIN bad b ON b.repo = t.repo AND b.path = t.path
WHERE t.path = '' OR len(string_split(t.path, '/')) <= 3
"""
)
def node_rows(spark, sf_dir):
    """Flat nodes of the tree down to depth 3, deeper content marked."""
    rows = report.nodes(_listed(spark, sf_dir), max_depth=3)
    return rows.select(
        "schema_version", "repo", "path", "parent", "name", F.col("depth").cast("long"), "type", "size", "size_human", "ext",
        F.col("item_count.dirs").alias("dirs"), F.col("item_count.files").alias("files"), "truncated",
    )


@checked(
    f"""
WITH {ENTRIES}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY repo, {R.parent_of()} ORDER BY CASE WHEN kind = 'dir' THEN 1 ELSE 0 END, {R.fold(R.name_of())} DESC, {R.name_of()} DESC) = 1 AS last
  FROM entries WHERE path <> ''),
hops AS (SELECT repo, path, kind, unnest(list_append({R.above()}[2:], path)) AS hop FROM entries WHERE path <> ''),
pre AS (SELECT h.repo, h.path, h.kind, string_agg(CASE WHEN h.hop = h.path THEN CASE WHEN r.last THEN '└── ' ELSE '├── ' END
  ELSE CASE WHEN r.last THEN '    ' ELSE '│   ' END END, '' ORDER BY len(string_split(h.hop, '/'))) AS prefix
  FROM hops h JOIN ranked r ON r.repo = h.repo AND r.path = h.hop GROUP BY 1, 2, 3)
SELECT repo, path, prefix || {R.name_of()} || CASE WHEN kind = 'dir' THEN '/' ELSE '' END AS line FROM pre
UNION ALL SELECT repo, path, repo || '/' FROM entries WHERE path = ''
"""
)
def tree_text(spark, sf_dir):
    """Listing lines with branches."""
    return tree.tree_lines(_listed(spark, sf_dir)).select("repo", "path", "line")


# Annotations of the TREE view's files, worked out from their sizes: (column, Spark and DuckDB expression).
_MARKS = {
    "tokens": "size * 3",
    "lines": "CASE WHEN size % 4 > 0 THEN size % 40 END",
    "last_commit": "CASE WHEN size % 6 = 0 THEN '\"fix ' || cast(size % 50 AS string) || '\" (day 3)' END",
    "todo_count": "size % 3",
    "has_test": "CASE WHEN size % 5 < 3 THEN size % 5 = 1 END",
    "is_config": "size % 7 < 2",
    "outline": "CASE WHEN size % 9 = 0 THEN 'def f, +2' END",
    "imports": "size % 2",
    "imported_by": "size % 4",
    "git_status": "CASE size % 5 WHEN 1 THEN 'M ' WHEN 2 THEN '??' WHEN 3 THEN ' ' END",
    "is_entry": "size % 11 < 3",
}


@checked(
    f"""
WITH {ENTRIES}, {_TOTAL}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY repo, {R.parent_of()} ORDER BY CASE WHEN kind = 'dir' THEN 1 ELSE 0 END, {R.fold(R.name_of())} DESC, {R.name_of()} DESC) = 1 AS last
  FROM entries WHERE path <> ''),
hops AS (SELECT repo, path, kind, unnest(list_append({R.above()}[2:], path)) AS hop FROM entries WHERE path <> ''),
pre AS (SELECT h.repo, h.path, h.kind, string_agg(CASE WHEN h.hop = h.path THEN CASE WHEN r.last THEN '└── ' ELSE '├── ' END
  ELSE CASE WHEN r.last THEN '    ' ELSE '│   ' END END, '' ORDER BY len(string_split(h.hop, '/'))) AS prefix
  FROM hops h JOIN ranked r ON r.repo = h.repo AND r.path = h.hop GROUP BY 1, 2, 3),
kids AS (SELECT repo, {R.parent_of()} AS path, count(*) FILTER (kind = 'dir') AS dirs, count(*) FILTER (kind <> 'dir') AS files FROM entries WHERE path <> '' GROUP BY 1, 2),
bad AS (SELECT DISTINCT repo, unnest({R.above()}) AS path FROM @TREE t WHERE denied),
marks AS (SELECT repo, path, mode, cast({NOW} - mtime AS bigint) AS s, {', '.join(f'{e} AS {c}' for c, e in _MARKS.items())} FROM @TREE t),
shares AS (SELECT t.repo, t.path, least(100, cast(floor(t.size * 100.0::DOUBLE / p.size) AS bigint)) AS percent
  FROM total t JOIN total p ON p.repo = t.repo AND p.path = {R.parent_of('t.path')} AND p.kind = 'dir' WHERE t.path <> '' AND p.size > 0),
bars AS (SELECT repo, path, ' [' || repeat('█', cast(round_even(percent * 10 / 100.0::DOUBLE, 0) AS bigint)) || repeat('░', 10 - cast(round_even(percent * 10 / 100.0::DOUBLE, 0) AS bigint))
  || ']' || lpad(cast(percent AS varchar), 4, ' ') || '%' AS bar FROM shares)
SELECT t.repo, t.path, coalesce(pre.prefix, '')
  || CASE WHEN t.kind = 'dir' THEN '' ELSE '[-' || {_bits(6, 2048, 's')} || {_bits(3, 1024, 's')} || {_bits(0, 512, 't')} || '] '
    || CASE WHEN trim(m.git_status) <> '' THEN '[' || trim(m.git_status) || '] ' ELSE '' END || CASE WHEN m.is_entry THEN '* ' WHEN m.is_config THEN '⚙ ' ELSE '' END END
  || CASE WHEN t.path = '' THEN t.repo || '/' WHEN t.kind = 'dir' THEN {R.name_of('t.path')} || '/' ELSE {R.name_of('t.path')} END || ' ('
  || CASE WHEN t.kind = 'dir' THEN coalesce(k.dirs, 0) || CASE WHEN k.dirs = 1 THEN ' dir, ' ELSE ' dirs, ' END || coalesce(k.files, 0) || CASE WHEN k.files = 1 THEN ' file' ELSE ' files' END || ', '
      || {R.size_label('t.size', 'b.path IS NOT NULL')}
    ELSE concat_ws(', ', {R.size_label('t.size')}, (SELECT {AGE} FROM (SELECT m.s AS s) x), {R.token_label('m.tokens')}, m.lines || ' lines', m.last_commit,
      CASE WHEN m.todo_count > 0 THEN 'TODO×' || m.todo_count END, CASE WHEN NOT m.has_test THEN 'no test' END, CASE WHEN m.is_config THEN 'config' END, m.outline,
      CASE WHEN m.imports > 0 THEN 'imports×' || m.imports END, CASE WHEN m.imported_by > 0 THEN 'used-by×' || m.imported_by END) END || ')'
  || coalesce(r.bar, '') AS line
FROM total t LEFT JOIN pre ON pre.repo = t.repo AND pre.path = t.path LEFT JOIN kids k ON k.repo = t.repo AND k.path = t.path AND t.kind = 'dir'
LEFT JOIN bad b ON b.repo = t.repo AND b.path = t.path AND t.kind = 'dir' LEFT JOIN marks m ON m.repo = t.repo AND m.path = t.path LEFT JOIN bars r ON r.repo = t.repo AND r.path = t.path
"""
)
def marked_listing(spark, sf_dir):
    """Listing lines with every note, mark and bar."""
    files = cut(_listed(spark, sf_dir), "files")
    annotated = files.where(F.col("kind") == "file").select(*ENTRY, *[F.expr(e).alias(c) for c, e in _MARKS.items()])
    notes = tree.entry_notes(files, annotated, now=NOW, bars=True, modes=True)
    return tree.tree_lines(files, notes).select("repo", "path", "line")


@checked()
def followed_links(spark, sf_dir):
    """Links to directories entered, loops stopped.

    Every ``tests`` directory gets a link to the language directory above its
    sibling ``build`` and back to its own top.
    """
    listed = _listed(spark, sf_dir)
    inner = listed.where((F.col("kind") == "dir") & (F.col("depth") == 2) & F.col("name").isin("tests", "build"))
    up = trees.inventory(
        inner.select(
            *TREE,
            F.concat("path", F.lit("/back")).alias("path"),
            F.lit("symlink").alias("kind"),
            F.when(F.col("name") == "tests", F.col("parent")).otherwise(F.concat("parent", F.lit("/tests"))).alias("link_target"),
            F.lit(True).alias("target_is_dir"),
        )
    )
    return visible.follow_links(listed.unionByName(up)).select("repo", "path", "real_path", "kind", "cyclic")


@checked(
    """
WITH r AS (SELECT DISTINCT repo, path FROM @TREE t UNION SELECT repo, 'gone/' || path FROM @TREE t UNION SELECT repo, 'en' FROM @TREE t)
SELECT r.repo, r.path, CASE WHEN f.path IS NOT NULL THEN f.size END AS size,
  CASE WHEN r.path = 'en' AND EXISTS (SELECT 1 FROM @TREE x WHERE x.repo = r.repo AND x.path LIKE 'en/%') THEN 'is a directory' WHEN f.path IS NULL THEN 'not found' END AS error
FROM r LEFT JOIN @TREE f ON f.repo = r.repo AND f.path = r.path
"""
)
def requested_files(spark, sf_dir):
    """Each requested path once; unresolved ones say why."""
    files = _files(spark, sf_dir, "TREE")
    asked = files.select(
        *TREE,
        F.explode(
            F.array(F.col("path"), F.concat(F.lit("./"), "path", F.lit(" ")), F.concat(F.lit("gone/"), "path"), F.lit("en/"), F.lit(" "))
        ).alias("path"),
    )
    return trees.requested(asked, _listed(spark, sf_dir)).select("repo", "path", "size", "error")
