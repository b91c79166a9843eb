"""Quality rules, classifier, language model, mixing and license scan: against plain Python, held-out rows and odd inputs."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from coppice.llm import crf, divergence, gru, licenses, mixing

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, n_words string, weight string, topic string"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, lang, src, len(t or ""), "s", "n", "w", "t") for k, t, lang, src in rows], DOCS)


def prose(rng, n, lang="en"):
    common = {"en": ["the", "of", "and", "to"], "fr": ["le", "de", "et", "à"]}[lang]
    return " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("abcdeioé") for _ in range(6)) for _ in range(n))


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lang = rng.choice(["en", "fr"])
        text = "\n".join(prose(rng, rng.randint(5, 60), lang) for _ in range(rng.randint(2, 6)))
        if k % 6 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        rows.append((k, text, lang, rng.choice(["a", "a", "a", "b", "c"])))
    return rows


ODD = [(900, None, "en", "a"), (901, "", None, None), (902, "one", "xx", "b"), (903, "a b " * 20000, "en", "a"), (903, "a b " * 20000, "en", "a"), (None, "x y z", "en", "c")]


# --- quality rules ---


def brute_counts(text):
    words = (text or "").translate({11: " ", 12: " ", 9: " ", 13: " ", 10: " "}).split(" ")
    words = [w for w in words if w]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = set()
    for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)):
        if windows[w] > 1:
            inside |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    seen, repeats = set(), 0
    for x in lines:
        repeats += x in seen
        seen.add(x)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), repeats, len(inside)


def test_rules_as_by_hand(spark):
    rows = corpus() + ODD + [(910, "a b c a b c a\xa0x\x0bq\x1cz #*|<\nb\n b\nb\n\n", "en", "a"), (911, "a a a a", "fr", "b")]
    known = divergence.references(frame(spark, corpus()))  # the odd rows' 160,000 words would outweigh it
    got = divergence.judged(frame(spark, rows), known).collect()
    assert len(got) == len(rows)
    texts = {k: t for k, t, *_ in rows}
    for r in got:
        n, chars, symbols, again, windows = brute_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, again, windows)
        assert r.base_failed == (n < 50 or 100 * windows > 50 * n)
        assert not (r.kept and r.base_failed)
    kept = {r.doc_id for r in got if r.kept}
    assert kept and not any(k % 6 == 0 for k in kept)
    assert {k for k, t, *_ in corpus() if k % 6 and len(t.split()) >= 50} <= kept
    passed = divergence.passing(frame(spark, rows), known)
    assert {r.doc_id for r in passed.collect()} == kept and passed.columns == frame(spark, []).columns


def test_references_count_every_document(spark):
    rows = [*corpus(), *ODD]
    known = divergence.references(frame(spark, rows))
    for row, lang in enumerate(known.languages):
        words = Counter(w for _, t, here, _ in rows if here == lang for w in (t or "").encode().split())
        total = sum(words.values())
        common = {w: n / total for w, n in words.items() if n >= divergence.COMMON * total}
        assert sorted(known.words[p] for p in known.places[row] if p < len(known.words)) == sorted(common)
        assert known.shares[row].sum() == pytest.approx(1)
    assert "xx" not in known.languages
    assert divergence.references(frame(spark, [])).languages == []
    assert divergence.judged(frame(spark, [])).count() == 0


@pytest.mark.parametrize("many", [200, 1])
def test_columns_named_as_the_rules_own(spark, monkeypatch, many):
    """Input columns may have any name; with and without languages whose references come by a join."""
    monkeypatch.setattr(divergence, "MANY", many)
    rows = [(k, " ".join(f"w{(k + j) % 40}" for j in range(300)), "de" if k % 3 else "en", k, "c", [0.5], "d", "o") for k in range(60)]
    schema = "doc_id bigint, text string, lang string, common int, classes string, shares array<double>, doc string, own string"
    df = spark.createDataFrame(rows, schema)
    plain = df.select("doc_id", "text", "lang")
    kept = divergence.passing(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in divergence.passing(plain).collect())
    assert sorted(map(tuple, divergence.judged(df).collect())) == sorted(map(tuple, divergence.judged(plain).collect()))


def test_documents_of_small_languages_stay(spark, monkeypatch):
    """Clean texts of a language of under 0.5 % of the words, without a label, or in one too small for references."""
    rng = random.Random(6)
    greek = lambda n: " ".join(rng.choice(["και", "το", "να"]) if rng.random() < 0.4 else "".join(rng.choice("αβγδε") for _ in range(5)) for _ in range(n))
    rows = corpus()
    rows += [(k, prose(rng, 20_000), "en", "a") for k in range(100, 130)]
    rows += [(k, greek(150), "el", "a") for k in range(200, 216)]
    rows += [(300, greek(100), None, "a"), (301, greek(100), "xx", "a")]
    rows += [(310, " ".join(w + "%%%%%%%%" for w in greek(100).split()), "el", "a")]
    clean = {k for k, *_ in rows if 200 <= k < 302}
    for many in (divergence.MANY, 2):  # with the tasks, and joined
        monkeypatch.setattr(divergence, "MANY", many)
        df = frame(spark, rows)
        known = divergence.references(df)
        assert known.languages == (["el", "en", "fr"] if many > 2 else ["en", "fr"]) and (known.rare is None) == (many > 2)
        got = {r.doc_id: (r.kept, r.class_distance, r.word_distance) for r in divergence.judged(df, known).collect()}
        assert len(got) == len(rows) and {k for k, g in got.items() if 200 <= k and g[0]} == clean
        assert {r.doc_id for r in divergence.passing(df, known).collect()} == {k for k, g in got.items() if g[0]}
        if many == 2:
            assert got == {k: pytest.approx(g) for k, g in before.items()}
        before = got


def test_jensen_shannon():
    p, q = np.array([0.5, 0.5, 0]), np.array([0, 0.5, 0.5])
    assert divergence.jensen_shannon(p, p) == 0
    assert divergence.jensen_shannon(np.array([1.0, 0]), np.array([0, 1.0])) == pytest.approx(1)
    assert divergence.jensen_shannon(p, q) == pytest.approx(math.sqrt(0.5))


# --- classifier ---


def test_marginals_as_by_enumeration():
    rng = np.random.default_rng(0)
    field = crf.Field(np.zeros(crf.WIDTH), rng.normal(size=(2, 2)), rng.normal(size=2))
    e = rng.normal(size=6)
    lengths = np.array([4, 2])
    marginals, log_z, expected = crf._marginals(field, e, crf._Chains(lengths), pairs=True)
    at, total, jumps = 0, 0.0, np.zeros((2, 2))
    for n in lengths:
        states = [[(k >> i) & 1 for i in range(n)] for k in range(2**n)]
        def weight(s, at=at, n=n):
            return math.exp(field.first[s[0]] + sum(e[at + i] * s[i] for i in range(n)) + sum(field.transitions[s[i], s[i + 1]] for i in range(n - 1)))
        z = sum(map(weight, states))
        total += math.log(z)
        for i in range(n):
            assert marginals[at + i] == pytest.approx(sum(weight(s) for s in states if s[i]) / z)
        for s in states:
            for i in range(n - 1):
                jumps[s[i], s[i + 1]] += weight(s) / z
        at += n
    assert log_z == pytest.approx(total)
    assert expected == pytest.approx(jumps)


def test_classifier_on_held_out_rows(spark):
    rows = corpus(200) + ODD
    labels = spark.createDataFrame([(k, int(k % 6 != 0), 0) for k in range(0, 200)] + [(None, 1, 0), (5, None, 1), (900, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = crf.scored(frame(spark, rows), crf.trained(frame(spark, rows), labels)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.held_out and r.doc_id < 200:
            assert r.predicted == int(r.doc_id % 6 != 0)
    empty = crf.trained(frame(spark, rows), labels.where("false"))
    assert {r.score for r in crf.scored(frame(spark, rows), empty).collect()} == {0.5}
    assert crf.scored(frame(spark, []), empty).count() == 0


# --- language model ---


def test_language_model_scores(spark, monkeypatch):
    monkeypatch.setattr(gru, "WORDS", 50)
    rows = [(k, t.upper() if k == 3 else t, *rest) for k, t, *rest in corpus(150)] + ODD
    counts = gru.counted(frame(spark, rows)).cache()
    vocab = gru.vocabulary(counts, known=80, words=50)
    model = gru.trained(frame(spark, rows), vocab)
    got = gru.scored(frame(spark, rows), counts, vocab, model).collect()
    assert len(got) == len(rows)
    train = Counter()
    held = {k for k, *_ in rows if k is not None and zlib.crc32(str(k).encode()) % 10 == 0}
    for k, t, *_ in rows:
        if k not in held:
            train.update(gru.tokens_of((t or "").encode()))
    n, v = sum(train.values()), len(train)
    texts = {k: (t or "").encode() for k, t, *_ in rows}
    base = model_score = 0
    for r in got:
        tokens = gru.tokens_of(texts[r.doc_id])
        want = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        assert r.held_out == (r.doc_id in held) and r.train_tokens == n
        assert (r.n_tokens, r.n_known) == (len(tokens), sum(train[w] > 0 for w in tokens))
        assert r.base_score == pytest.approx(want, rel=1e-9)
        assert r.score < 0
        if r.held_out:
            base, model_score = base + r.base_score, model_score + r.score
    assert model_score > base  # better on texts it has not seen


def small_model(seed=0, scale=0.5):
    vocab = gru.Vocabulary({b"w%d" % k: k for k in range(90)}, np.arange(90, 0, -1.0), np.array([k if k < 60 else 60 + k % gru.TAILS for k in range(90)], np.int32), 60, 5000, 100, np.zeros(gru.TAILS))
    model = gru.first_model(vocab)
    rng = np.random.default_rng(seed)
    return vocab, gru.Model(*[a + rng.normal(0, scale, a.shape).astype(np.float32) for a in model.arrays()])


def test_probabilities_add_up_to_one():
    vocab, model = small_model()
    state = np.random.default_rng(1).normal(0, 0.5, (1, gru.STATE)).astype(np.float32)
    targets = np.arange(60 + gru.TAILS)
    found, _ = gru._output(model, np.repeat(state, len(targets), 0), targets, None)
    assert np.exp(found.astype(float)).sum() == pytest.approx(1, abs=1e-4)


def test_the_state_is_carried_through_whole_documents():
    """Any layout of lanes and windows gives what a plain loop gives."""
    vocab, model = small_model()
    rng = np.random.default_rng(2)
    lengths = np.array([1, 75, 3, 200, 33])
    ids = rng.integers(0, 60 + gru.TAILS, lengths.sum()).astype(np.int32)
    start = 60 + gru.TAILS
    got = gru.log_probabilities(model, gru.Lanes(ids, lengths, start))
    at = 0
    for n in lengths:
        h, before = np.zeros(gru.STATE), start
        for t in range(at, at + n):
            a, x = h @ model.recur, model.table[before]
            z = 1 / (1 + np.exp(-(x + a)[: gru.STATE]))
            r = 1 / (1 + np.exp(-(x + a)[gru.STATE : 2 * gru.STATE]))
            c = np.tanh(x[2 * gru.STATE :] + r * a[2 * gru.STATE :])
            h, before = (1 - z) * c + z * h, ids[t]
            found, _ = gru._output(model, h[None].astype(np.float32), ids[t : t + 1], None)
            assert got[t] == pytest.approx(found[0], abs=2e-3)
        at += n


def test_gradients_as_by_differences(monkeypatch):
    vocab, model = small_model(scale=0.2)
    rng = np.random.default_rng(3)
    lengths = np.array([20, 9, 14])
    ids = rng.integers(0, 60 + gru.TAILS, lengths.sum()).astype(np.int32)
    lanes = gru.Lanes(ids, lengths, 60 + gru.TAILS)
    places, active = next(lanes.windows(gru.WINDOW))
    inputs, mask = lanes.inputs[places], np.arange(places.shape[1]) < active[:, None]

    def total(m):
        states, _, _ = gru._forward(m, inputs, active, lanes.start, np.zeros((len(lanes.places), gru.STATE), np.float32), False)
        return gru._output(m, states[mask], lanes.targets[places[mask]], None)[0].astype(float).sum()

    slopes = gru.Model(*[np.zeros_like(a) for a in model.arrays()])
    states, _, kept = gru._forward(model, inputs, active, lanes.start, np.zeros((len(lanes.places), gru.STATE), np.float32), True)
    _, down = gru._output(model, states[mask], lanes.targets[places[mask]], slopes)
    spread = np.zeros_like(states)
    spread[mask] = down
    gru._backward(model, slopes, inputs, active, lanes.start, kept, spread)
    for which, slope in enumerate(slopes.arrays()):
        way = slope / np.linalg.norm(slope)
        ends = []
        for step in (0.02, -0.02):
            arrays = [a.copy() for a in model.arrays()]
            arrays[which] = arrays[which] + np.float32(step) * way
            ends.append(total(gru.Model(*arrays)))
        assert (ends[0] - ends[1]) / 0.04 == pytest.approx(np.linalg.norm(slope), rel=0.03)


def test_every_window_shapes_the_weights():
    """The inputs of each window, met in no other one, get a gradient."""
    vocab, model = small_model()
    ids = np.repeat(np.arange(40), gru.WINDOW).astype(np.int32)
    trainer = gru.Trainer(model)
    trainer.read(gru.Lanes(ids, np.array([len(ids)]), 60 + gru.TAILS))
    trainer.step()
    moved = np.abs(trainer.model.table - model.table).max(axis=1) > 0
    assert moved[:40].all() and not moved[40 : 60 + gru.TAILS].any()
    assert trainer.seen == len(ids) and trainer.waiting == 0


def test_a_round_of_few_documents_has_few_tasks():
    assert gru._tasks(320, 1, 32, 6) == 10 and gru._tasks(320, 27, 32, 6) == 270
    assert gru._tasks(32, 4, 32, 6) == 6 and gru._tasks(2, 1, 32, 6) == 2 and gru._tasks(0, 1, 32, 6) == 1


def test_outputs_hold_over_several_blocks_and_for_wild_weights():
    for scale in (0.3, 40):
        vocab, model = small_model(scale=scale)
        rng = np.random.default_rng(5)
        states = np.tanh(rng.normal(0, 1, (2 * gru.ROWS + 7, gru.STATE))).astype(np.float32)
        targets = rng.integers(0, 60 + gru.TAILS, len(states))
        slopes, summed = (gru.Model(*[np.zeros_like(a) for a in model.arrays()]) for _ in range(2))
        found, down = gru._output(model, states, targets, slopes)
        for k in range(len(states)):
            one, below = gru._output(model, states[k : k + 1], targets[k : k + 1], summed)
            assert np.allclose(found[k], one[0], rtol=1e-4, atol=1e-3) and np.allclose(down[k], below[0], rtol=1e-3, atol=1e-3 * scale)
        for a, b in zip(slopes.arrays(), summed.arrays(), strict=True):
            assert np.isfinite(a).all() and np.allclose(a, b, rtol=1e-3, atol=0.05)


def test_language_model_without_rows(spark):
    assert gru.read_and_scored(frame(spark, [])).count() == 0
    one = gru.read_and_scored(frame(spark, [(10, "a b", "en", "s")])).collect()
    assert len(one) == 1 and math.isfinite(one[0].score)


# --- mixing ---


def test_raked_weights_meet_their_targets(spark):
    rng = random.Random(5)
    cells = [(s, lang, t, rng.randint(1, 1000)) for s in "abcd" for lang in ("en", "fr", "") for t in ("prose", "legal")]
    df = spark.createDataFrame(cells, "source_ string, lang_ string, topic string, n_words bigint")
    targets = {"source_": {"a": 0.1, "b": 0.2, "c": 0.3, "d": 0.4}, "lang_": {"en": 0.5, "fr": 0.3, "": 0.2}, "topic": {"prose": 0.9, "legal": 0.1}}
    rows = mixing.raked(df, targets, rounds=25).collect()
    for margin, shares in targets.items():
        for value, share in shares.items():
            assert sum(r.raked for r in rows if r[margin] == value) == pytest.approx(share, abs=1e-6)
    # Raking keeps the cells' odds ratios.
    got = {(r.source_, r.lang_, r.topic): r.raked for r in rows}
    had = {tuple(c[:3]): c[3] for c in cells}
    ratio = lambda x: x["a", "en", "prose"] * x["b", "fr", "prose"] / x["a", "fr", "prose"] / x["b", "en", "prose"]
    assert ratio(got) == pytest.approx(ratio(had))


def test_sample_of_odd_rows(spark):
    rows = corpus() + ODD
    all_ = mixing.mixed(frame(spark, rows)).collect()
    assert len(all_) == len(rows)
    assert all(0 < r.probability <= 1 <= r.weight for r in all_)
    kept = sorted(str(r.doc_id) for r in all_ if r.kept)
    drawn = mixing.sampled(frame(spark, rows))
    assert sorted(str(r.doc_id) for r in drawn.collect()) == kept
    assert sorted(drawn.columns) == sorted(frame(spark, []).columns)
    assert mixing.mixed(frame(spark, [])).count() == 0
    assert mixing.sampled(frame(spark, [(1, "", None, None)])).count() == 1


# --- licences ---


def test_licences_and_their_inheritance(spark):
    apache = "Licensed under the Apache License, Version 2.0."
    filler = "some words that say nothing at all about anything\n" * 40
    rows = [
        (1, "r", "LICENSE", "# Released under the MIT License.\n"),
        (2, "r", "a/b.py", filler),
        (3, "r", "a/c/COPYING", "This work is licensed under the\nGNU General Public License, version 3.\n" + filler),
        (4, "r", "a/c/d/e.py", filler),
        (5, "r", "a/c/d/f.py", filler + apache.upper() + "\n" + filler),
        (6, "q", "x.py", filler),
        (7, "q", None, apache),
        (8, "q", "y.py", None),
        (8, "q", "y.py", ""),
        (9, "r", "ab/c.py", "the version of the work, in general"),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id bigint, repo string, path string, text string, license string")
    got = {(r.doc_id, r.license, r.origin, r.from_path) for r in licenses.scanned(df).collect()}
    assert got == {
        (1, "MIT", "file", None), (2, "MIT", "inherited", "LICENSE"), (3, "GPL-3.0", "file", None),
        (4, "GPL-3.0", "inherited", "a/c/COPYING"), (5, "Apache-2.0", "header", None), (6, None, None, None),
        (7, "Apache-2.0", "header", None), (8, None, None, None), (9, "MIT", "inherited", "LICENSE"),
    }
    assert licenses.scanned(df.where("false")).count() == 0


def test_a_notice_that_many_files_carry(spark):
    """A footer on a third of the files, and a table of two equal notices."""
    rng = random.Random(9)
    rows = [(k, "r" if k % 3 == 0 else "q", f"{k}.txt", prose(rng, 30) + ("\nAll rights reserved." if k % 3 == 0 else "")) for k in range(90)]
    rows += [(90, "r", "b/LICENSE", "All rights reserved."), (91, "r", "b/c/x.txt", "nothing here")]
    df = spark.createDataFrame(rows, "doc_id bigint, repo string, path string, text string")
    got = {r.doc_id: (r.license, r.origin, r.from_path) for r in licenses.scanned(df).collect()}
    assert got == {k: ("proprietary", "header", None) if k % 3 == 0 else (None, None, None) for k in range(90)} | {
        90: ("proprietary", "file", None), 91: ("proprietary", "inherited", "b/LICENSE"),
    }
    two = spark.createDataFrame([(k, "r", f"{k}.py", "# SPDX-License-Identifier: MIT") for k in range(2)], df.schema)
    assert {(r.license, r.similarity) for r in licenses.scanned(two).collect()} == {("MIT", 1.0)}


def _plain_cosine(a, b):
    dot = sum(w * b.get(t, 0) for t, w in a.items())
    return round(dot / math.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values())), 9) if a and b else 0.0


def _plain_notice(text, idf, whole):
    """Licence and cosine of a text by comparing every run with every template."""
    weights = lambda ts: {t: n * idf(t) for t, n in Counter(ts).items()}
    lines = [licenses.terms(x.encode()) for x in (text or "").split("\n")]
    for k, line in enumerate((text or "").split("\n")):
        if m := re.search(r"SPDX-License-Identifier: (\S+(?: (?:AND|OR|WITH) \S+)*)", line):
            return m[1], 1.0, k + 1
    runs = [(k, sum(lines[k : k + n], [])) for n in (1, 2, 3) for k in range(len(lines) - n + 1)] + ([(0, sum(lines, []))] if whole else [])
    seen, best = set(), None
    for at, run in runs:
        alike = []
        for n, (name, wording) in enumerate(licenses.TEMPLATES):
            own = licenses.terms(wording.encode())
            cosine = _plain_cosine(weights(run), weights(own)) if licenses.told(run) == licenses.told(own) else 0.0
            if cosine >= licenses.ALIKE:
                seen.add((name, n))
                alike.append((cosine, -at, -n, name))
        if alike and (best is None or max(alike)[:2] > best[0][:2]):
            best = max(alike), {a[3] for a in alike if a[0] >= max(alike)[0] - licenses.MARGIN}
    if best is None:
        return None, None, None
    votes = Counter(name for name, _ in seen if name in best[1]).most_common(2)
    name = votes[0][0] if len(votes) == 1 or votes[0][1] > votes[1][1] else licenses.UNKNOWN
    return name, best[0][0], 1 - best[0][1]


def test_the_whole_scan_against_all_pairs(spark):
    """Cosines, votes and inheritance of a small tree, each found the long way round."""
    rng = random.Random(3)
    pool = [w for _, w in licenses.TEMPLATES] + ["# SPDX-License-Identifier: GPL-2.0-only", "// SPDX-License-Identifier: MIT OR Apache-2.0", "version 2 of it", "mit"]
    pool += [prose(rng, 8) for _ in range(60)]
    rows = []
    for k in range(160):
        folder = "/".join(rng.choice("ab") for _ in range(rng.randint(0, 3)))
        name = rng.choice(["LICENSE", "COPYING", "x.py", "y.py", "z.c", "z.c"])
        said = [rng.choice(pool) for _ in range(rng.randint(0, 5))]
        said = [" ".join(x.split()[: rng.choice([4, 8, 99])]) for x in said]
        rows.append((k, rng.choice("rq"), f"{folder}/{name}" if folder else name, "\n".join(said) if k % 13 else None))
    df = spark.createDataFrame(rows, "doc_id bigint, repo string, path string, text string")
    lines = [set(licenses.terms(x.encode())) for r in rows for x in (r[3] or "").split("\n")]
    idf = lambda t: math.log((1 + len(lines)) / (1 + (sum(t in x for x in lines) if t in licenses.VOCABULARY else 0))) + 1
    own = {r[0]: _plain_notice(r[3], idf, r[2].rsplit("/", 1)[-1] in ("LICENSE", "COPYING")) for r in rows}
    want = {}
    for k, repo, path, _ in rows:
        name, cosine, line = own[k]
        if name is not None:
            want[k] = (name, round(cosine, 6), line, "file" if path.rsplit("/", 1)[-1] in ("LICENSE", "COPYING") else "header", None)
            continue
        folder, heads = path, []
        while not heads and folder:
            folder = folder.rpartition("/")[0]
            heads = [(-round(own[j][1], 6), p, own[j][0]) for j, r, p, _ in rows if r == repo and p in (f"{folder}/LICENSE".lstrip("/"), f"{folder}/COPYING".lstrip("/")) and own[j][0]]
        want[k] = (min(heads)[2], None, None, "inherited", min(heads)[1]) if heads else (None, None, None, None, None)
    got = {r.doc_id: (r.license, r.similarity, r.line, r.origin, r.from_path) for r in licenses.scanned(df).collect()}
    assert got == want
    assert len({w[0] for w in want.values()}) > 20


GNU = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU {} as published by\nthe Free Software Foundation; either version {} of the License, or\n(at your option) any later version."


@pytest.mark.parametrize(
    "text,want",
    [
        (GNU.format("General Public License", "2"), "GPL-2.0"), (GNU.format("General Public License", "3"), "GPL-3.0"),
        (GNU.format("Lesser General Public License", "2.1"), "LGPL-2.1"), (GNU.format("Lesser General Public License", "3"), "LGPL-3.0"),
        (GNU.format("Library General Public License", "2"), "LGPL-2.0"), (GNU.format("Affero General Public License", "3"), "AGPL-3.0"),
        ("GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991", "GPL-2.0"), ("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "LGPL-3.0"),
        ("Licensed under CC BY 4.0.", "CC-BY-4.0"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Licensed under CC BY-SA 3.0.", "CC-BY-SA-3.0"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
        ("Licensed under the Apache Software License, Version 1.1.", "Apache-1.1"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        ("Mozilla Public License Version 1.1", None), ("Eclipse Public License - v 1.0", "EPL-1.0"), ("Eclipse Public License - v 2.0", "EPL-2.0"),
        (licenses.GRANT + ", provided that the above\ncopyright notice and this permission notice appear in all copies.", "ISC"), (licenses.GRANT + ".", "0BSD"),
        (licenses.FORMS + ":", "unknown"), (licenses.FORMS + ":\n\nNeither the name of the copyright holder nor the names of its contributors\nmay be used to endorse or promote products derived from this software\nwithout specific prior written permission.", "BSD-3-Clause"),
        ("BSD 2-Clause License\n\n" + licenses.FORMS, "BSD-2-Clause"), ("// SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0-only"),
        ("/* SPDX-License-Identifier: LGPL-2.1-or-later WITH GCC-exception-3.1 */", "LGPL-2.1-or-later WITH GCC-exception-3.1"), ("# SPDX-License-Identifier: ISC", "ISC"),
    ],
)
def test_licences_that_are_easily_mistaken(text, want):
    rare = licenses.Templates(100_000, dict.fromkeys(licenses.VOCABULARY, 40))
    got = licenses.notice(text.encode(), rare)[0]
    assert got == want or (want is None and got in (None, "MPL-1.1"))
    assert licenses.notice(b"this is the version 2 of a text under way", rare) == (None, None, None)


def test_runs_passed_over_are_not_the_best():
    rng = random.Random(11)
    known = licenses.Templates(500, {t: rng.randint(0, 500) for t in licenses.VOCABULARY})
    wordings = [w.split() for _, w in licenses.TEMPLATES]
    for _ in range(150):
        lines = [" ".join(rng.choice(["x", "y"]) if rng.random() < 0.15 else w for w in rng.choice(wordings)) for _ in range(5)]
        runs = [licenses.terms(" ".join(lines[k : k + n]).encode()) for n in (1, 2, 3) for k in range(6 - n)]
        best = max(known.cosines(run).max() for run in runs)
        found = licenses.notice("\n".join(lines).encode(), known)[1]
        assert found == (pytest.approx(best) if best >= licenses.ALIKE else None)


def test_cosine_as_by_hand():
    found = {t: n for n, t in enumerate(sorted(licenses.VOCABULARY))}
    known = licenses.Templates(1000, found)
    run = licenses.terms(b"licensed under the mit license or so")
    idf = lambda t: math.log(1001 / (1 + found[t])) + 1 if t in found else math.log(1001) + 1
    weights = lambda ts: {t: n * idf(t) for t, n in Counter(ts).items()}
    for (_, wording), cosine in zip(licenses.TEMPLATES, known.cosines(run), strict=True):
        own = licenses.terms(wording.encode())
        assert cosine == pytest.approx(_plain_cosine(weights(run), weights(own)) if licenses.told(own) == {"mit"} else 0)


def test_words_by_arrow_are_the_tokens():
    """Words are split, counted and numbered for many texts at once as ``tokens_of`` does for one."""
    read = [b"", b" \t ", "  A\x0bb\x0cÄ\u00a0Ö \r\n".encode(), b"x", b"b b  zz\x00q \x1c B", "ß\u2003ß É".encode(), b"broken \xff\xc3 end"]
    words, counts = gru.words_of(read)
    want = [gru.tokens_of(t) for t in read]
    assert words.cast(pa.large_binary()).to_pylist() == [w for ws in want for w in ws[:-1]]
    assert counts.tolist() == [len(ws) - 1 for ws in want]
    told = pa.Table.from_batches(list(gru._counted(iter([pa.record_batch([pa.array(read, pa.binary())], names=["text"])]))))
    assert dict(zip(told["token"].to_pylist(), told["n"].to_pylist())) == Counter(w for ws in want for w in ws)
    for top in ([gru.END, b"b", b"x"], [b"b"], []):
        ranks = {w: k for k, w in enumerate(top)}
        vocab = gru.Vocabulary(ranks, np.ones(len(top)), np.arange(len(top), dtype=np.int32), len(top), 1, 1, np.zeros(gru.TAILS))
        ids, rank, lengths, rare = gru._numbered(vocab, read)
        tokens = [w for ws in want for w in ws]
        assert rank.tolist() == [ranks.get(w, -1) for w in tokens]
        assert ids.tolist() == [ranks.get(w, len(top) + gru.tail_class(w)) for w in tokens]
        assert lengths.tolist() == list(map(len, want))
        assert gru._rest(rank, lengths, rare) == [[w for w in ws if w not in ranks] for ws in want]


def test_log_probabilities_over_several_calls(monkeypatch):
    """Outputs of several windows are worked out together; where a call ends has no bearing."""
    rng = np.random.default_rng(3)
    counts = np.sort(rng.integers(1, 500, 100))[::-1].astype(np.float64)
    vocab = gru.Vocabulary({}, counts, np.arange(100, dtype=np.int32), 100, int(counts.sum()), 100, np.zeros(gru.TAILS))
    model, start = gru.first_model(vocab), 100 + gru.TAILS
    lengths = np.array([700, 3, 90, 1, 260])
    lanes = gru.Lanes(rng.integers(0, start, int(lengths.sum())).astype(np.int32), lengths, start)
    whole = gru.log_probabilities(model, lanes)
    monkeypatch.setattr(gru, "TOGETHER", 50)
    monkeypatch.setattr(gru, "ROWS", 7)
    assert np.allclose(gru.log_probabilities(model, lanes), whole, atol=1e-5) and (whole < 0).all()
