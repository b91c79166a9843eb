import fnmatch
import posixpath
import stat

from pyspark.sql import functions as F

from coppice.functions import labels, measure, names, paths

X = F.col("x")


def test_extension(values):
    given = ["foo.py", ".env", ".env.local", "Makefile", "a.tar.gz", "...", "..a.b", "A.TXT", "x."]
    assert values(paths.suffix(X), given) == [".py", "", ".local", "", ".gz", "", ".b", ".TXT", "."]
    assert values(paths.stem(X), given)[:5] == ["foo", ".env", ".env", "Makefile", "a.tar"]
    assert values(paths.ext(X), ["A.TXT"]) == [".txt"]


def test_parents(values):
    given = ["", "a", "a/b", "a/b/c.py"]
    assert values(paths.ancestors(X), given) == [[], [""], ["", "a"], ["", "a", "a/b"]]
    assert values(paths.depth(X), given) == [0, 1, 2, 3]
    assert values(paths.dirname(X), given) == ["", "", "a", "a/b"]
    assert values(paths.basename(X), given) == ["", "a", "b", "c.py"]


def test_normpath_and_relative(values):
    given = ["a/../b", "./a//b/.", "../a", "a/../../b", "/a/../../b", "", ".", "/", "a/b/../..", "../../x/.."]
    assert values(paths.normpath(X), given) == [posixpath.normpath(g) for g in given]
    pairs = [("a/b/c", "a"), ("a/b", "a/x/y"), ("a", "a"), ("b/c", "a"), ("a/b", "a/b/c")]
    got = values(paths.relative_to(X, F.col("y")), pairs, "x string, y string")
    assert got == [posixpath.relpath(a, b) for a, b in pairs]
    joined = values(paths.join(X, F.col("y")), [("", "b"), ("a", "/b"), ("a", "b")], "x string, y string")
    assert joined == ["b", "/b", "a/b"]


GLOBS = ["*.md", "a?c", "a[-x]c", "a[a-z]c", "a[!a-z]c", "a[]]c", "a[c", "[bracket].txt", "[]", "[!]", "a[z-a]c", "*", "", "[!", "a.c", "x[*]y", "[a-]c", "(a|b)+"]
NAMES = ["foo.md", "foo.mdx", "a/b/c.md", "abc", "a-c", "aBc", "a]c", "a[c", "b.txt", "[bracket].txt", "a.c", "", "x*y", "-c", "[]", "[!]", "a\nc", "日本.md", "(a|b)+"]


def test_globs(values):
    for glob in GLOBS:
        # "[z-a]" is an empty class here and there.
        want = [fnmatch.fnmatchcase(n, glob) for n in NAMES]
        assert values(X.rlike(paths.regex_of_glob(glob)), NAMES) == want, glob
        by_column = values(F.rlike(X, paths.glob_to_regex(F.col("y"))), [(n, glob) for n in NAMES], "x string, y string")
        assert by_column == want, glob


def test_star_match(values):
    cases = [("@lib/*", "@lib/a/b"), ("*", "x"), ("a", "a"), ("a", "b"), ("a*a", "a"), ("#x/*.js", "#x/y.js")]
    got = values(paths.star_match(X, F.col("y")), cases, "x string, y string")
    assert got == ["a/b", "x", "", None, None, "y"]


def test_module_names(values):
    assert values(paths.python_module(X), ["a/b/__init__.py", "a/b.py", "__init__.py", "b.py"]) == ["a.b", "a.b", "", "b"]
    cases = [("src/lib.rs", ""), ("src/a/mod.rs", ""), ("c/src/a/b.rs", "c"), ("c/x.rs", "c"), ("src/main.rs", "")]
    assert values(paths.rust_module(X, F.col("y")), cases, "x string, y string") == ["", "a", "a::b", None, ""]


def test_sizes(values):
    given = [0, 1, 1024, 1536, 1587, 307200, 1152, 1 << 40, (1 << 30) + 12345]
    want = ["0 bytes", "1 byte", "1 KB", "1.5 KB", "1.55 KB", "300 KB", "1.12 KB", "1 TB", "1 GB"]
    assert values(labels.size_label(X), given, "x long") == want
    assert values(labels.size_label(X, F.lit(True)), [0, 1, 1024], "x long") == ["0+ bytes", "1+ bytes", "1+ KB"]


def test_token_labels_round_like_the_double(values):
    given = list(range(990, 3200)) + [10**6 + 50, 10**6 + 150, 2_000_050, 123_456_750, 10**9 + 50, 5 * 10**9 + 650]
    want = []
    for n in given:
        text = f"{n / 1000:.1f}".rstrip("0").rstrip(".")
        want.append(f"~{text}K tok" if n >= 1000 else f"~{n} tok")
    assert values(labels.token_label(X), given, "x long") == want


def test_bars_ages_counts(values):
    bars = values(labels.share_bar(X, F.col("y")), [(30, 100), (5, 0), (25, 100), (300, 100)], "x long, y long")
    assert bars == ["[███░░░░░░░]  30%", "[░░░░░░░░░░]   0%", "[██░░░░░░░░]  25%", "[██████████] 100%"]
    given = [10.0, 90.0, 90 * 60.0, 30 * 3600.0, 4 * 86400.0, 10 * 86400.0, 100 * 86400.0, 400 * 86400.0]
    want = ["now", "1 min ago", "1 hour ago", "yesterday", "4 days ago", "1 week ago", "3 months ago", "1 year ago"]
    assert values(labels.age_label(X, F.lit(0.0)), given, "x double") == want
    counts = values(labels.count_label(X, F.col("y")), [(1, 1), (0, 2)], "x long, y long")
    assert counts == ["1 dir, 1 file", "0 dirs, 2 files"]


def test_modes(values):
    given = [0o100644, 0o040755, 0o120777, 0o104755, 0o102644, 0o041777, 0o041776, 0o100000, 0o010600]
    assert values(labels.mode_label(X), given, "x int") == [stat.filemode(m) for m in given]


def test_texts(values):
    given = ["evil\x1b[2J.txt", "a\nb", "x\u009b31m", "plain"]
    assert values(labels.printable(X), given) == ["evil?[2J.txt", "a?b", "x?31m", "plain"]
    assert values(paths.casefold(X), ["Straße", "ABC", "ﬁx", "µ"]) == ["strasse", "abc", "fix", "μ"]
    assert values(paths.strip(X), ["　 a\x1c\n", "\t"]) == ["a", ""]
    assert values(paths.truncate(X, 3), ["日本語文", "abc"]) == ["日本語…", "abc"]
    assert values(labels.commit_label(X, F.lit("2 days ago")), [" short "]) == ['"short" (2 days ago)']


def test_measures(values):
    given = ["", "hello world", "ab\n", "日本語", "a" * 10]
    assert values(measure.tokens(X), given) == [0, 3, 1, 2, 2]
    assert values(measure.lines(X), ["", "a", "a\n", "a\nb", "\n"]) == [0, 1, 1, 2, 1]


def test_names(values):
    risky = [".env", ".env.local", ".env.example", "a.pem", "id_rsa.pub", "my_SECRET.txt", "x.py", ".npmrc"]
    assert values(names.is_sensitive_name(X), risky) == [True, True, False, True, True, True, False, True]
    tests = ["test_a.py", "a_test.go", "a.test.ts", "a.spec.js", "contest.py", "testing.py"]
    assert values(names.is_test_name(X), tests) == [True] * 4 + [False] * 2
    assert values(names.is_test_path(X), ["tests/a.py", "x/__tests__/a.js", "a/test/b.go", "attests/a.py"]) == [True, True, True, False]
