"""Near-dedup, line dedup and decontamination against plain Python, and their odd inputs."""

import random
from itertools import combinations

import numpy as np
import pytest

from coppice.llm import containment, lines, near
from coppice.llm.components import components
from coppice.llm.words import shingle_set

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, component_id string"


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", len(t or ""), False, "x") for k, t in texts], DOCS)


def shingles(text, size=5):
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute_groups(texts):
    sets = {k: shingles(t) for k, t in texts}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= 75 * len(sets[a] | sets[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {k: (len(sets[k]), find(k)) for k in sets}


def corpus(seed=1):
    """Chains of near copies, exact copies, shared passages, short and empty texts."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        for _ in range(rng.randint(1, 9)):
            texts.append(" ".join(base).title() if rng.random() < 0.2 else "  ".join(base))
            base[rng.randrange(len(base))] = rng.choice(words)
    passage = " ".join(rng.choice(words) for _ in range(40))
    texts += [f"{passage} " + " ".join(rng.choice(words) for _ in range(rng.randint(3, 12))) for _ in range(60)]
    texts += ["", None, " \t", "a b", "A b", "a b c", "one", "x " * 3000]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_near_copies_as_by_hand(spark):
    texts = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near.grouped(frame(spark, texts)).collect()}
    want = brute_groups(texts)
    assert got == {k: (n, c, c == k) for k, (n, c) in want.items()}
    kept = {r.doc_id for r in near.one_of_each(frame(spark, texts)).collect()}
    assert kept == {k for k, (_, c) in want.items() if c == k}
    assert near.one_of_each(frame(spark, texts)).columns == frame(spark, texts).columns


def test_a_crowded_bucket_is_compared_beyond_its_smallest(spark, monkeypatch):
    """Many texts around one passage, linked in pairs that do not touch the bucket's smallest."""
    monkeypatch.setattr(near, "CROWD", 3)
    texts = corpus(seed=5)
    got = {r.doc_id: r.component_id for r in near.grouped(frame(spark, texts)).collect()}
    assert got == {k: c for k, (_, c) in brute_groups(texts).items()}


def test_texts_travel_in_short_batches(spark, monkeypatch):
    """Also where the session leaves Spark's own length, which is put back."""
    signed, key = near._signed, "spark.sql.execution.arrow.maxRecordsPerBatch"

    def checked(batches):
        def short():
            for batch in batches:
                assert batch.num_rows <= 256
                yield batch

        yield from signed(short())

    monkeypatch.setattr(near, "_signed", checked)
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        docs = spark.range(0, 2000, 1, 1).selectExpr("id AS doc_id", "concat('a text of number ', id) AS text")
        assert near.grouped(docs).count() == 2000
        assert spark.conf.get(key) == "10000"
    finally:
        spark.conf.set(key, before)


def test_near_copies_of_odd_rows(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (3, None), (2, "")]
    got = sorted(map(str, near.grouped(frame(spark, rows)).collect()))
    one = "Row(doc_id=5, n_shingles=2, component_id=5, kept=True)"
    want = [
        one, one, "Row(doc_id=None, n_shingles=2, component_id=None, kept=True)", "Row(doc_id=7, n_shingles=2, component_id=5, kept=False)",
        "Row(doc_id=3, n_shingles=0, component_id=3, kept=True)", "Row(doc_id=2, n_shingles=0, component_id=2, kept=True)",
    ]
    assert got == sorted(want)
    assert near.grouped(frame(spark, [])).count() == 0
    assert near.one_of_each(frame(spark, [])).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    errors = []
    for share in (0.2, 0.5, 0.8):
        for _ in range(20):
            both = rng.integers(0, 2**63, int(600 * share)).astype(np.uint64)
            rest = rng.integers(0, 2**63, 600 - len(both)).astype(np.uint64)
            a = near.signature(np.concatenate([both, rest[::2]]))
            b = near.signature(np.concatenate([both, rest[1::2]]))
            errors.append((a == b).mean() - share)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06
    assert len(shingle_set(np.array([], np.uint64))) == 0


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 200), (200, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = dict.fromkeys(range(1, 61), 0) | dict.fromkeys(range(101, 160), 100) | {300: 200}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- lines ---


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_lines(texts):
    rows, first = [], {}
    for k, t in texts:
        for n, line in enumerate((t or "").split("\n")):
            words = tuple(line.lower().split())
            if len(words) >= lines.MIN_WORDS:
                rows.append((k, n, words))
                first[words] = min(first.get(words, (k, n)), (k, n))
    out = set()
    for k, n, words in rows:
        alike = [p for w, p in first.items() if p < first[words] and one_edit(w, words)]
        if alike:
            out.add((k, n, *min(alike), 1))
        elif first[words] != (k, n):
            out.add((k, n, *first[words], 0))
    return out


def edited(seed=2):
    rng = random.Random(seed)
    words = [f"v{k}" for k in range(30)]
    pool = []
    for _ in range(15):
        line = [rng.choice(words) for _ in range(rng.randint(8, 30))]
        for _ in range(8):
            pool.append(" ".join(line))
            line = list(line)
            at = rng.randrange(len(line))
            change = rng.randrange(4)
            if change == 0:
                line[at] = rng.choice(words)
            elif change == 1:
                line.insert(at, rng.choice(words))
            elif change == 2 and len(line) > 8:
                del line[at]
    pool += ["short line", "", "  ", "a a a a a a a a", "a a a a a a a a a", "a a a a a a a b", "b a a a a a a a"]
    return [(k, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 8)))) for k in range(40)]


def test_repeated_lines_as_by_hand(spark):
    texts = edited() + [(90, None), (91, ""), (92, "x " * 5000), (93, "x " * 5001)]
    got = {tuple(r) for r in lines.repeated(frame(spark, texts)).collect()}
    assert got == brute_lines(texts)
    assert any(g[4] for g in got) and not all(g[4] for g in got)


def test_lines_of_recurring_words_find_their_partner(spark):
    """Many orders of the same words: an anagram must not stand in for the earlier line one word away."""
    rng = random.Random(7)
    pool = ["| " + " | ".join(rng.choice("01") for _ in range(9)) + " |" for _ in range(500)]
    pool += ["the " + " the ".join(rng.choice("abc") for _ in range(6)) for _ in range(200)]
    for _ in range(20):  # over several blocks of words
        line = [rng.choice("01") for _ in range(rng.choice([63, 64, 65, 200]))]
        other = [*line]
        at = rng.randrange(len(line))
        other[at : at + 1] = rng.choice([[], ["2"], ["0", "1"]])
        pool += [" ".join(line), " ".join(other)]
    texts = [(k, "\n".join(rng.choice(pool) for _ in range(10))) for k in range(120)]
    got = {tuple(r) for r in lines.repeated(frame(spark, texts)).collect()}
    assert got == brute_lines(texts)


def test_documents_less_their_repeated_lines(spark):
    texts = edited() + [(90, None), (91, ""), (None, "k k k k k k k k k")]
    gone = {}
    for k, n, *_ in brute_lines([t for t in texts if t[0] is not None]):
        gone.setdefault(k, set()).add(n)
    want = {}
    for k, t in texts:
        left = t if k not in gone else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[k])
        if k not in gone or left.split():
            want[k] = left
    df = lines.without_repeated(frame(spark, texts))
    assert {r.doc_id: r.text for r in df.collect()} == want
    assert df.columns == DOCS.replace(",", "").split()[::2]
    assert all(r.n_chars == len(r.text or "") for r in df.collect())
    assert lines.without_repeated(frame(spark, [])).count() == 0


@pytest.mark.parametrize("number", [None, 5])
def test_rows_that_share_a_number_lose_only_their_own_lines(spark, number):
    """Rows without ``doc_id``, and rows of one ``doc_id`` with several texts, are documents of their own."""
    said = {c: " ".join([c, *"b c d e f g h i j".split()]) for c in "pqrstu"}
    edit = said["p"].replace("j", "J2")
    texts = ["\n".join(said[c] for c in cs) for cs in ("pqr", "stp", "suu")] + [edit]
    df = frame(spark, [(number, t) for t in texts] + [(number, texts[0])])
    left = sorted(r.text for r in lines.without_repeated(df, min_words=3).collect())
    words = [x for text in left for x in text.split("\n")]
    # All lines but their first words are alike, so one word changed makes any two a pair: one line is left in the corpus.
    assert len(set(words)) == 1
    different = {c: " ".join(f"{c}{k}" for k in range(9)) for c in "pqrstu"}
    texts = ["\n".join(different[c] for c in cs) for cs in ("pqr", "stp", "sxu".replace("x", "q"))]
    df = frame(spark, [(number, t) for t in texts] + [(number, texts[0])])
    got = lines.without_repeated(df).collect()
    kept = [x for r in got for x in r.text.split("\n")]
    assert set(kept) == set(different.values())  # no line is lost
    by_text = {t: [r.text for r in got if set(r.text.split("\n")) <= set(t.split("\n"))] for t in texts}
    assert all(by_text.values())
    # Each line stays in one document only; the two equal rows are one document.
    assert sum(kept.count(x) - 1 for x in set(kept)) == len(texts[0].split("\n")) - sum(kept.count(different[c]) == 1 for c in "pqr")


# --- benchmark ---


def test_contained_items_as_by_hand(spark):
    rng = random.Random(4)
    words = [f"u{k}" for k in range(200)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for k in range(40)] + [(90, None), (91, " "), (None, "a b c d e")]
    texts = []
    for k in range(80):
        passage = (items[k % 40][1]).split()
        if k % 3 == 0 and passage:
            passage[rng.randrange(len(passage))] = "changed"
        if k % 5 == 0:
            passage = passage[: len(passage) * 3 // 4]
        around = [rng.choice(words) for _ in range(rng.choice([0, 5, 500, 4000]))]
        texts.append((k, " ".join([*around, *passage, *around]).upper()))
    texts += [(80, None), (81, ""), (82, texts[1][1]), (82, texts[1][1])]
    want = set()
    for d, t in texts:
        for i, item in items:
            own, held = shingles(item), shingles(t)
            if i is not None and own and 100 * len(own & held) >= 75 * len(own):
                want.add((d, i, len(own), len(own & held)))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {tuple(r) for r in containment.found(frame(spark, texts), bench).collect()}
    assert got == want and len({w[0] for w in want}) > 30
    clean = {r.doc_id for r in containment.clean(frame(spark, texts), bench).collect()}
    assert clean == {k for k, _ in texts} - {w[0] for w in want}
    assert containment.found(frame(spark, texts), bench.where("false")).count() == 0
    assert containment.clean(frame(spark, []), bench).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 8, 40])
def test_sketches_leave_no_gap(spark, n):
    """Whatever quarter of its shingles an item loses, one of the sketch is left."""
    items = spark.createDataFrame([(1, [*range(n)], n)], "item_id bigint, shingles array<bigint>, n int")
    depth = containment.sketches(items).count()
    assert depth > n - -(-75 * n // 100) and depth <= n
