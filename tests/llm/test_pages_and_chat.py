"""URL filter and chat formatting against plain Python, and their odd inputs."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from coppice.llm import chat, urls

PAGES = "page_id bigint, url string, html string, host string, path string"
TURNS = "conv_id bigint, turn bigint, role string, text string, output string"
pieces = st.lists(
    st.sampled_from(["[INST]", "[/INST]", " [/INST]", "</s>", "<s>", "\\", "[", "<", "/", "ROLE]", "[ROLE]", "[/TURN]", "[\\INST]", "<\\\\/s>", " ", "é", "\n", "a"]),
    max_size=8,
).map("".join)


@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), pieces), pieces), max_size=6))
@settings(max_examples=300, deadline=None)
def test_every_text_comes_back(turns):
    output = "".join(chat.formatted(role, text) for role, text in turns)
    assert list(chat.parsed(output)) == turns
    loss = [chat.plain(output[a:b]) for a, b in chat.loss_spans(output)]
    assert loss == [text for role, text in turns if role == "assistant"]


def test_plain_texts_are_left_as_they_are():
    assert chat.formatted("user", "a <b> [c]") == "[INST] a <b> [c] [/INST]"
    assert chat.formatted("assistant", "x</s>") == "<s>x<\\/s></s>"
    with pytest.raises(chat.Malformed):
        list(chat.parsed("[INST] no end"))


def test_digests_by_conversation(spark):
    rows = [
        (1, 1, "assistant", "</s>", "o"), (1, 0, "user", None, "o"), (1, 2, None, "x" * 200_000, None),
        (2, 0, "user", "é", None), (2, 0, "user", "é", None), (None, 0, "user", "q", None), (3, None, "assistant", "", None),
    ]
    df = chat.with_marks_conversation(spark.createDataFrame(rows, TURNS))
    got = {r.conv_id: r for r in chat.digests(chat.formatted_turns(df)).collect()}
    said = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", said, None), (-7, 1, "assistant", said, None)]
    for conv in (1, 2, 3, None, -7):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1]))
        pairs = [(r[2] or "", r[3] or "") for r in mine]
        loss = "".join(t for r, t in pairs if r == "assistant")
        assert got[conv].n_turns == len(pairs)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in pairs).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[conv].formatted_chars == len("".join(chat.formatted(r, t) for r, t in pairs))
    assert len(got) == 5
    empty = chat.digests(chat.formatted_turns(spark.createDataFrame([], TURNS)))
    assert empty.count() == 0


def brute_verdict(url, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    path = re.match("[^/?#]*([^?#]*)", rest)[1]
    best = None
    for verdict, h, p in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, best[0] if best else None, best[1] if best else ("block" if url in listed else "allow")


def test_verdicts(spark):
    given_urls = [
        "https://A.example.org/es/1", "http://example.org/en/12?x#y", "https://example.org/en/2", "https://b.com/de/", "https://com/fr/x",
        "https://notcom/de/", "https://x.net/a", "https://www.x.net/a/", "http://m.x.net:80/a?utm_source=f&ref=z#q", "https://x.net/b",
        "x.net/a", "", None, "https://", "https://org", "https://x.net/a?b=2&a=1", "http://x.net/a?a=1&b=2", "ÄÖ://ÜX.net/é",
    ]
    rows = [(n, u, None, "h", "p") for n, u in enumerate(given_urls)] + [(None, "https://x.net/a", "", None, None)] * 2
    listed = spark.createDataFrame([("https://x.net/a",), ("http://x.net/a?b=2&a=1",), (None,), ("",), ("https://x.net/a",)], "url string")
    got = [tuple(r) for r in urls.judged(spark.createDataFrame(rows, PAGES), listed).collect()]
    same = {given_urls[k] for k in (6, 7, 8, 15, 16)}
    want = [(r[0], *brute_verdict(r[1], same)) for r in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))
    none = urls.judged(spark.createDataFrame([], PAGES), listed.where("false"))
    assert none.count() == 0
    assert urls.judged(spark.createDataFrame(rows, PAGES), listed.where("false")).where("verdict = 'block'").count() == 3


def test_filter_has_no_false_negatives(spark):
    names = spark.range(5000).selectExpr("concat('x.net/', id) AS canonical")
    seen = urls.possible(names, names.where("substring(canonical, 7) % 3 = 0"), 1667).groupBy("possible").count()
    counts = {r.possible: r["count"] for r in seen.collect()}
    assert 1667 <= counts[True] < 1900
