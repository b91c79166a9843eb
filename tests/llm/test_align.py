"""Tokenizer alignment against a plain double loop over token occurrences."""

import hashlib
import os
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from coppice.llm import align

pytestmark = pytest.mark.skipif(not os.path.exists(align.BYTE_BPE), reason="tokenizers are not here")

DOCS = "doc_id bigint, text string, block string, pair string, bits string"
ODD = [
    None, "", " ", "\n\n  x\t", "naïve façade — 東京 😀", "<|endoftext|> and <s> </s> <unk>", "▁ is not a space", "ﬁ ligature é", "a" * 5000,
    "  wide　blanks\r\n", "\x00\x07", "It's we'll I'D 'S", "the cat sat on the mat. " * 300, "1234567 8.9e-10 $$$ ...",
]


def _spelled(text):
    """Ids and bytes of both readings by the libraries' own plain calls."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    if not hasattr(_spelled, "a"):
        _spelled.a, _spelled.b = Tokenizer.from_file(align.BYTE_BPE), SentencePieceProcessor(model_file=align.PIECE_BPE)
        _spelled.a.encode_special_tokens = True
        alphabet = align._byte_of_character()
        _spelled.chars = {k: bytes(alphabet[c] for c in v) for v, k in _spelled.a.get_vocab().items() if all(c in alphabet for c in v)}
    a = [(k, _spelled.chars[k]) for k in _spelled.a.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for k in _spelled.b.encode(text):
        piece = _spelled.b.id_to_piece(k)
        b.append((k, bytes([int(piece[1:-1], 16)]) if _spelled.b.is_byte(k) else piece.replace("▁", " ").encode()))
    whole = b" " + text.encode()
    ok = text and b"".join(x for _, x in a) == whole == b"".join(x for _, x in b)
    return (a, b) if ok else ([], [])


def _ranges(tokens):
    at = 0
    for k, spelled in tokens:
        yield k, at, at + len(spelled)
        at += len(spelled)


def _plain(text):
    a, b = (list(_ranges(x)) for x in _spelled(text or ""))
    links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e]
    stops = sorted({e for _, _, e in a} & {e for _, _, e in b})
    groups, start = [], 0
    for stop in stops:
        groups.append("|".join(",".join(str(k) for k, s, e in side if start <= s and e <= stop) for side in (a, b)))
        start = stop
    return len(a), len(b), groups, links


def _expected(texts):
    plain = [_plain(t) for t in texts]
    documents = Counter(p for *_, links in plain for p in set(links))
    links_of = Counter(p for *_, links in plain for p in links)
    most = {}
    for (a, _), n in documents.items():
        most[a] = max(most.get(a, 0), n)
    rows = []
    for n_a, n_b, groups, links in plain:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        best = sum(documents[p] == most[p[0]] for p in links)
        rows.append((n_a, n_b, len(groups), len(links), best, sum(documents[p] for p in links), digest))
    return rows, documents, links_of


def _rows(df):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.orderBy("doc_id").collect()]


def test_against_plain_loops(spark):
    docs = spark.createDataFrame([(k, t, "x", None, "") for k, t in enumerate(ODD)], DOCS).repartition(3)
    want, documents, links = _expected(ODD)
    assert _rows(align.aligned(docs)) == want
    assert want[7][0] == 0 or want[6][0] == 0  # some text that one of them does not spell
    rows = align.index(docs)
    size = align.vocabulary()
    counts = align.with_best(align.pair_counts(rows), size).collect()
    assert {(r.a_id, r.b_id): (r.documents, r.links) for r in counts} == {p: (documents[p], links[p]) for p in documents}


def test_repeated_rows_and_rows_without_number(spark):
    texts = ["one two two", "one two two", "one three", None]
    docs = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, None)], "doc_id bigint, text string")
    want, *_ = _expected(texts)
    got = align.aligned(docs).collect()
    assert sorted((r.n_a, r.count_sum, r.groups_sha256) for r in got) == sorted((w[0], w[5], w[6]) for w in want)


def test_empty_table(spark):
    assert align.aligned(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_dense_postings_over_blocks(spark, monkeypatch):
    """Documents of several blocks, a pair in all of them, and multiplicities over several planes."""
    texts = ["the " * (k % 7 + 1) + f"w{k % 5}" for k in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    assert _rows(align.aligned(docs)) == _expected(texts)[0]
    monkeypatch.setattr(align, "HELD", 100)
    assert align.index(docs).select("block").distinct().count() > 10


@given(st.lists(st.lists(st.integers(0, align.BLOCK - 1), min_size=1, max_size=600, unique=True), max_size=6))
@settings(max_examples=60, deadline=None)
def test_bitmaps_open_again(sets):
    sets = [sorted(s) for s in sets]
    bits = align.bitmaps(np.array([x for s in sets for x in s], np.uint16), np.array([len(s) for s in sets], np.int64))
    ordinals, owner = align.opened(bits)
    assert [sorted(ordinals[owner == k].tolist()) for k in range(len(sets))] == sets
    assert all(len(bits[k].as_py()) <= align.BLOCK // 8 for k in range(len(sets)))


@given(st.text(max_size=80))
@settings(max_examples=300, deadline=None)
def test_fast_reading_is_the_files_own(text):
    a, b, _ = align._readers(align.BYTE_BPE, align.PIECE_BPE)
    _spelled("")
    assert a.read([text]) == [_spelled.a.encode(" " + text, add_special_tokens=False).ids]
    assert b.read([text]) == [_spelled.b.encode(text)]
