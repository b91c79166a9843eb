"""Mixing sources to target weights by iterative proportional fitting.

The documents' words are added up by cell (source, language, topic).  The
cells' weights are raked: scaled to the target shares of the sources, then of
the languages, then of the topics, and again, until all three margins hold.  A
document is then drawn with a probability that brings its cell to its raked
weight; where that would need more than all of a cell, all of it is kept and
``weight`` says how often each of its documents counts.  The draw is a hash of
``doc_id``, so it is the same on every run.

Targets are shares given by value; a value without one gets its share of the
words to the power ``TEMPER``, and all shares of a margin are scaled to 1.

Topics come from marks counted over the whole text: the mark found most often,
the first named one on a tie, ``prose`` without any.

Results for odd input: a null source or language is a value of its own
(``""``); a document without words has no weight to rake, is kept, and weighs
1; a null ``doc_id`` draws like the text ``""``; repeated rows draw alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coppice.llm.words import WORD
from coppice.session import cut

MARGINS = ["source_", "lang_", "topic"]
TOPICS = [
    ("legal", ["icense", "opyright"]),
    ("contact", ["@", "://"]),
    ("table", [" | "]),
    ("shouting", ["!!"]),
    ("code", ["();", "{", "}"]),
]
LANGUAGES = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}
TARGETS: dict[str, dict[str, float]] = {"source_": {}, "lang_": LANGUAGES, "topic": {}}
TEMPER = {"source_": 0.5, "lang_": 0.5, "topic": 0.8}
ROUNDS = 8
SHARE = 0.7  # of all words that the sample should have
_DRAWS = 16**8


def topic_of(text: Column) -> Column:
    """The topic whose marks the text has most often."""
    said = F.coalesce(text, F.lit(""))

    def hits(marks: list[str]) -> Column:
        counts = [(F.length(said) - F.length(F.replace(said, F.lit(m), F.lit("")))) / len(m) for m in marks]
        return sum(counts[1:], counts[0]).cast("bigint")

    found = F.array(*[F.struct(hits(marks).alias("n"), F.lit(-k).alias("k")) for k, (_, marks) in enumerate(TOPICS)])
    most = F.array_max(found)
    names = F.array(*[F.lit(name) for name, _ in TOPICS])
    return F.when(most["n"] > 0, F.get(names, -most["k"])).otherwise(F.lit("prose"))


def _cell() -> list[Column]:
    return [
        F.coalesce("source", F.lit("")).alias("source_"),
        F.coalesce("lang", F.lit("")).alias("lang_"),
        topic_of(F.col("text")).alias("topic"),
    ]


def counted(docs: DataFrame) -> DataFrame:
    """Document, cell and number of words."""
    n_words = F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))
    return docs.select("doc_id", *_cell(), n_words.alias("n_words"))


def raked(cells: DataFrame, targets: dict = TARGETS, rounds: int = ROUNDS) -> DataFrame:
    """Cells with ``n_words`` and their raked share of all words as ``raked``."""
    total = cells.agg(F.sum("n_words")).first()[0]
    if not total:
        return cells.where("false").withColumn("raked", F.lit(0.0))
    rows = cells.where("n_words > 0").withColumn("raked", F.col("n_words") / F.lit(float(total)))
    for margin in MARGINS:
        words = F.sum("n_words").over(W.partitionBy(margin))
        tempered = F.pow(words / F.lit(float(total)), F.lit(TEMPER[margin]))
        given = F.lit(None).cast("double")
        for value, share in targets.get(margin, {}).items():
            given = F.when(F.col(margin) == value, F.lit(float(share))).otherwise(given)
        rows = rows.withColumn(f"{margin}_target", F.coalesce(given, tempered))
    rows = cut(rows, "cells")
    for margin in MARGINS:
        whole = rows.groupBy(margin).agg(F.first(f"{margin}_target").alias("t")).agg(F.sum("t")).first()[0]
        rows = rows.withColumn(f"{margin}_target", F.col(f"{margin}_target") / F.lit(float(whole)))
    for _ in range(rounds):
        for margin in MARGINS:
            now = F.sum("raked").over(W.partitionBy(margin))
            rows = rows.withColumn("raked", F.col("raked") * F.col(f"{margin}_target") / now)
    return rows.select(*MARGINS, "n_words", "raked")


def rates(cells: DataFrame, targets: dict = TARGETS, rounds: int = ROUNDS, share: float = SHARE) -> DataFrame:
    """By cell: the probability to keep a document, and what a kept one weighs."""
    rows = raked(cells, targets, rounds)
    total = rows.agg(F.sum("n_words")).first()[0] or 1
    wanted = F.lit(share * total) * F.col("raked") / F.col("n_words")
    return rows.select(
        *MARGINS, F.least(F.lit(1.0), wanted).alias("probability"), F.greatest(F.lit(1.0), wanted).alias("weight")
    )


def _draw(doc_id: str) -> Column:
    """A number from 0 to 1 that hangs on ``doc_id`` alone."""
    digest = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / _DRAWS


def _rates_of(rows: DataFrame, targets: dict, rounds: int, share: float) -> DataFrame:
    cells = cut(rows.groupBy(*MARGINS).agg(F.sum("n_words").alias("n_words")), "mixing-cells")
    return cut(rates(cells, targets, rounds, share), "mixing-rates")


def mixed(docs: DataFrame, targets: dict = TARGETS, rounds: int = ROUNDS, share: float = SHARE) -> DataFrame:
    """One row per document: its cell, words, ``probability``, ``weight`` and whether it is ``kept``."""
    rows = cut(counted(docs), "mixing")
    joined = rows.join(_rates_of(rows, targets, rounds, share), MARGINS, "left")
    probability = F.coalesce("probability", F.lit(1.0))
    return joined.select(
        "doc_id",
        F.col("source_").alias("source"),
        F.col("lang_").alias("lang"),
        "topic",
        "n_words",
        F.round(probability, 6).alias("probability"),
        F.round(F.coalesce("weight", F.lit(1.0)), 6).alias("weight"),
        (_draw("doc_id") < probability).alias("kept"),
    )


def sampled(docs: DataFrame, targets: dict = TARGETS, rounds: int = ROUNDS, share: float = SHARE) -> DataFrame:
    """The documents drawn, with all their columns, and their ``weight``."""
    known = _rates_of(counted(docs), targets, rounds, share)
    rows = docs.select(F.struct(*docs.columns).alias("doc"), *_cell()).join(known, MARGINS, "left")
    drawn = rows.where(_draw("doc.doc_id") < F.coalesce("probability", F.lit(1.0)))
    weight = F.round(F.coalesce("weight", F.lit(1.0)), 6).alias("weight")
    return drawn.select(*[F.col(f"doc.{c}") for c in docs.columns if c != "weight"], weight)


def _sql_target(margin: str) -> str:
    tempered = f"pow(sum(n_words) OVER (PARTITION BY {margin}) / total::DOUBLE, {TEMPER[margin]}::DOUBLE)"
    given = " ".join(f"WHEN '{value}' THEN {share}::DOUBLE" for value, share in TARGETS[margin].items())
    return f"CASE {margin} {given} ELSE {tempered} END" if given else tempered


def sql(documents: str = "documents", rounds: int = ROUNDS, share: float = SHARE) -> str:
    """The same in SQL: every document with its cell, probability, weight and verdict."""
    hits = [
        " + ".join(f"(length(t) - length(replace(t, '{m}', ''))) // {len(m)}" for m in marks) for _, marks in TOPICS
    ]
    topics = " ".join(f"WHEN h[{k + 1}] = list_max(h) THEN '{name}'" for k, (name, _) in enumerate(TOPICS))
    steps, last = [], "scaled"
    for n in range(rounds):
        for margin in MARGINS:
            step = f"r{n}_{margin}"
            steps.append(
                f"{step} AS (SELECT * REPLACE (raked * {margin}_target / sum(raked) OVER (PARTITION BY {margin}) AS raked) FROM {last})"
            )
            last = step
    return f"""
WITH said AS (
  SELECT doc_id, coalesce(source, '') AS source_, coalesce(lang, '') AS lang_, coalesce(text, '') AS t FROM {documents}
), hit AS (
  SELECT *, [{", ".join(hits)}] AS h, len(regexp_extract_all(t, '[^ \\t\\n\\x0b\\f\\r]+')) AS n_words FROM said
), counted AS (
  SELECT doc_id, source_, lang_, n_words, CASE WHEN list_max(h) = 0 THEN 'prose' {topics} END AS topic FROM hit
), cells AS (
  SELECT source_, lang_, topic, sum(n_words)::BIGINT AS n_words, sum(sum(n_words)) OVER ()::BIGINT AS total
  FROM counted GROUP BY ALL
), aimed AS (
  SELECT *, n_words / total::DOUBLE AS raked, {", ".join(f"{_sql_target(m)} AS {m}_target" for m in MARGINS)}
  FROM cells WHERE n_words > 0
), scaled AS (
  SELECT * REPLACE ({", ".join(f"{m}_target / (SELECT sum(t) FROM (SELECT any_value({m}_target) AS t FROM aimed GROUP BY {m})) AS {m}_target" for m in MARGINS)})
  FROM aimed
), {", ".join(steps)}
, rates AS (
  SELECT source_, lang_, topic, {share}::DOUBLE * total * raked / n_words AS wanted FROM {last}
)
SELECT doc_id, source_ AS source, lang_ AS lang, topic, n_words,
  round(coalesce(least(1.0::DOUBLE, wanted), 1.0), 6) AS probability, round(coalesce(greatest(1.0::DOUBLE, wanted), 1.0), 6) AS weight,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / {_DRAWS}::DOUBLE < coalesce(least(1.0::DOUBLE, wanted), 1.0) AS kept
FROM counted LEFT JOIN rates USING (source_, lang_, topic)
"""
