"""Line dedup by a deletion-neighbourhood join.

Two lines are alike if they are equal, or one word added, left out or changed
makes them so (edit distance 1, counted in lower-cased words).  Of alike lines
the earliest (by ``doc_id``, then line number) stays: a line goes if an equal
one or an alike one stands earlier.

Each distinct line emits, for every word, the hash of the line without it, the
order of its words included.  Lines with one word changed agree on such a
variant and on its place; a line with a word more has a variant equal to the
whole shorter line.  So any two of a group are alike, and it only yields its
smallest member, never its pairs: a group of any size is a plain aggregation.  Each match is checked by edit distance on the
words.

An edit leaves the first or the last half of a line as it was, so lines whose
halves occur in no other line cannot have a partner; they emit no variants.
That costs two short keys a line and spares most of the rows.

Lines of fewer than ``MIN_WORDS`` words (headings, list marks, blank lines)
are left alone.  A document is a ``doc_id`` with a text, told apart by hash and
length: rows that share a ``doc_id`` but not the text, or have none, are
documents of their own, in the order of their hashes.

Results for odd input: a null text has no lines and stays null; rows that
repeat ``doc_id`` and text are one document; rows without ``doc_id`` come before
all others; very long lines cost as much as their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.llm.words import WORD, word_list
from coppice.session import cut

MIN_WORDS = 8
PLACE = ["doc_id", "body", "line_no"]
BLOCK = 64


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _body(text: str) -> Column:
    """What tells the texts of one ``doc_id`` apart."""
    return F.struct(F.xxhash64(text).alias("hash"), F.length(text).alias("length"))


def line_rows(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Long lines: their place, a hash of their words, and hashes of their halves."""
    # What stands beside a generator in a projection is worked out for every line: the body goes before.
    whole = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("bigint"), _body("text").alias("body"), F.split("text", "\n").alias("lines"))
    lines = whole.select("doc_id", "body", F.posexplode_outer("lines").alias("line_no", "line"))
    lines = lines.where(F.regexp_count("line", F.lit(WORD)) >= min_words)
    words = lines.select(*PLACE, word_list(F.col("line")).alias("words"))
    words = words.withColumn("n", F.size("words"))
    ends = []
    for less in (0, 1):  # as it is, and as the longer of two lines
        m = F.col("n") - less
        half = (m / 2).cast("int")
        ends.append(F.xxhash64(F.lit("head"), m, F.slice("words", F.lit(1), half)))
        ends.append(F.xxhash64(F.lit("tail"), m, F.slice("words", F.col("n") - half + 1, half)))
    return words.select(*PLACE, F.xxhash64("words").alias("line"), F.array(*ends).alias("ends"))


def _distinct(lines: DataFrame) -> DataFrame:
    """Each different line with its earliest place and how often it occurs."""
    return lines.groupBy("line").agg(
        F.min(F.struct(*PLACE)).alias("place"), F.first("ends").alias("ends"), F.count("*").alias("times")
    )


def _may_pair(distinct: DataFrame) -> DataFrame:
    """Lines one of whose halves occurs in another line, numbered in order of their places."""
    keyed = distinct.select("line", F.explode("ends").alias("end"))
    shared = keyed.groupBy("end").agg(F.min("line").alias("a"), F.max("line").alias("b")).where("a <> b").select("end")
    chosen = keyed.join(shared, "end", "left_semi").select("line").distinct()
    places = distinct.join(chosen, "line", "left_semi").select("line", "place.*")
    return places.orderBy(F.asc_nulls_first("doc_id"), "body", "line_no").withColumn("number", F.monotonically_increasing_id())


def _with_words(chosen: DataFrame, docs: DataFrame) -> DataFrame:
    """Number and words of the chosen lines, read again from their documents."""
    asked = chosen.groupBy("doc_id", "body").agg(F.collect_list(F.struct("line_no", "line", "number")).alias("asked"))
    asked = asked.withColumnsRenamed({"doc_id": "asked_id", "body": "asked_body"})
    texts = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("bigint"), _body("text").alias("body"), F.split("text", "\n").alias("lines"))
    same = _same(F.col("doc_id"), F.col("asked_id")) & (F.col("body") == F.col("asked_body"))
    rows = texts.join(asked, same).select("lines", F.explode("asked").alias("asked"))
    words = rows.select("asked.*", word_list(F.get("lines", F.col("asked.line_no"))).alias("words"))
    # A document may be there several times.
    return words.where(F.xxhash64("words") == F.col("line")).dropDuplicates(["number"]).select("number", "words")


def _variants(chosen: DataFrame) -> DataFrame:
    """Hashed keys of the chosen lines: ``kind`` 0 a word changed, 1 the longer, 2 the shorter line.

    Exclusive ors of hashes of words with their places stand for a line and for
    each variant, so the order of the words counts.  Leaving out a word moves all
    later ones by one place: a running exclusive or of ``here`` and ``left`` (the
    word at its own place and one further left) gives every variant.  It is made
    in blocks, as an array that grows word by word is copied each time.
    """
    words = F.transform(
        "words", lambda w, i: F.struct(F.xxhash64(w, i).alias("here"), F.xxhash64(w, i - 1).alias("left"))
    )
    hashed = chosen.select("number", words.alias("w"))
    zero = F.lit(0).cast("bigint")
    state = "struct<run:bigint,before:array<bigint>>"

    def step(held: Column, w: Column) -> Column:
        run = held["run"].bitwiseXOR(w["here"]).bitwiseXOR(w["left"])
        return F.struct(run.alias("run"), F.concat(held["before"], F.array(held["run"])).alias("before")).cast(state)

    def block(done: Column, at: Column) -> Column:
        run = F.coalesce(F.get(done, F.size(done) - 1)["run"], zero)
        start = F.struct(run.alias("run"), F.array().cast("array<bigint>").alias("before")).cast(state)
        return F.concat(done, F.array(F.aggregate(F.slice("w", at + 1, F.lit(BLOCK)), start, step)))

    blocks = F.aggregate(F.sequence(F.lit(0), F.size("w") - 1, F.lit(BLOCK)), F.array().cast(f"array<{state}>"), block)
    before = F.flatten(F.transform(blocks, lambda b: b["before"]))
    summed = hashed.select(
        "number",
        F.size("w").alias("n"),
        F.aggregate("w", zero, lambda s, w: s.bitwiseXOR(w["here"])).alias("whole"),
        F.aggregate("w", zero, lambda s, w: s.bitwiseXOR(w["left"])).alias("moved"),
        F.zip_with(before, "w", lambda b, w: b.bitwiseXOR(w["left"])).alias("cuts"),
    )
    cuts = summed.select("number", "n", "moved", F.posexplode_outer("cuts").alias("i", "c"))
    cuts = cuts.select("number", "n", "i", F.col("c").bitwiseXOR(F.col("moved")).alias("v"))
    keys = F.array(
        F.struct(F.xxhash64("v", "n", "i").alias("key"), F.lit(0).alias("kind")),
        F.struct(F.xxhash64("v", F.col("n") - 1, F.lit(-1)).alias("key"), F.lit(1).alias("kind")),
    )
    whole = summed.select("number", F.xxhash64("whole", "n", F.lit(-1)).alias("key"), F.lit(2).alias("kind"))
    return cuts.select("number", F.explode(keys).alias("k")).select("number", "k.key", "k.kind").unionByName(whole)


def one_edit(a: Column, b: Column) -> Column:
    """Whether two word arrays differ by exactly one word changed, added or left out."""
    shorter = F.least(F.size(a), F.size(b))
    agree = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    back = F.zip_with(F.reverse(a), F.reverse(b), lambda x, y: x.eqNullSafe(y))

    def run(flags: Column) -> Column:  # how many agree from the start
        first = F.array_position(flags, False)
        return F.when(first == 0, F.size(flags)).otherwise(first - 1)

    return (F.abs(F.size(a) - F.size(b)) <= 1) & (a != b) & (
        run(agree) + run(back) >= F.when(F.size(a) == F.size(b), shorter - 1).otherwise(shorter)
    )


def _partners(words: DataFrame) -> DataFrame:
    """``number`` of each line that has an earlier one within the bound, and that one's as ``partner``."""
    variants = _variants(words)
    groups = variants.groupBy("key").agg(
        *[F.min(F.when(F.col("kind") == kind, F.col("number"))).alias(f"first{kind}") for kind in range(3)],
        F.min("number").alias("low"),
        F.max("number").alias("high"),
    )
    groups = groups.where("low < high").drop("low", "high")
    # Changed: any earlier of the group. Longer: the one shorter line. Shorter: the first longer one.
    partner = (
        F.when(F.col("kind") == 0, F.col("first0")).when(F.col("kind") == 1, F.col("first2")).otherwise(F.col("first1"))
    )
    pairs = variants.join(groups, "key").select("number", partner.alias("partner")).where("partner < number").distinct()
    a, b = words.alias("a"), words.alias("b")
    checked = (
        pairs.join(a, F.col("a.number") == pairs["number"])
        .join(b, F.col("b.number") == F.col("partner"))
        .where(one_edit(F.col("a.words"), F.col("b.words")))
    )
    return checked.groupBy(pairs["number"]).agg(F.min("partner").alias("partner"))


def _repeated(docs: DataFrame, min_words: int) -> DataFrame:
    """Lines to take out: their place, the earlier line's place ``stays``, and ``edits`` between them (0 or 1)."""
    lines = cut(line_rows(docs, min_words), "lines")
    distinct = cut(_distinct(lines), "distinct-lines")
    chosen = cut(_may_pair(distinct), "chosen-lines")
    words = cut(_with_words(chosen, docs), "chosen-words")
    partners = _partners(words)
    kept = chosen.select(F.col("number").alias("partner"), F.struct(*PLACE).alias("other"))
    near = partners.join(kept, "partner").join(chosen.select("number", "line"), "number").select("line", "other")
    known = distinct.select("line", "place", "times").join(near, "line", "left")
    # Written, so that Spark can split a line that very many documents have.
    known = cut(known.where((F.col("times") > 1) | F.col("other").isNotNull()).select("line", "place", "other"), "known-lines")
    found = lines.select(*PLACE, "line").join(known, "line")
    gone = found.where(F.col("other").isNotNull() | ~_same(F.struct(*PLACE), F.col("place")))
    edits = F.when(F.col("other").isNotNull(), 1).otherwise(0)
    return gone.select(*PLACE, F.coalesce("other", "place").alias("stays"), edits.alias("edits"))


def repeated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Lines to take out: their place, the place of the earlier line, and ``edits`` between them (0 or 1)."""
    return _repeated(docs, min_words).select(
        "doc_id",
        F.col("line_no").cast("bigint"),
        F.col("stays.doc_id").alias("kept_doc_id"),
        F.col("stays.line_no").cast("bigint").alias("kept_line_no"),
        "edits",
    )


def without_repeated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents less their repeated lines; one that had words and has none left goes.

    ``n_chars``, where there is such a column, follows the text.
    """
    gone = _repeated(docs, min_words).groupBy("doc_id", "body").agg(F.collect_set("line_no").alias("gone"))
    gone = cut(gone.withColumnsRenamed({"doc_id": "gone_id", "body": "gone_body"}), "repeated-lines")
    rows = docs.select(F.struct(*docs.columns).alias("doc"))
    same = _same(F.col("doc.doc_id").cast("bigint"), F.col("gone_id")) & (_body("doc.text") == F.col("gone_body"))
    rows = rows.join(gone, same, "left")
    lines = F.split("doc.text", "\n")
    left = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains("gone", i)), "\n")
    rows = rows.select("doc", F.col("gone").isNotNull().alias("shorter"), F.when(F.col("gone").isNotNull(), left).alias("left"))
    rows = rows.where(~F.col("shorter") | F.coalesce(F.col("left").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    changed = {"text": F.when(F.col("shorter"), F.col("left")).otherwise(F.col("doc.text"))}
    if "n_chars" in docs.columns:
        length = F.length("left").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col("shorter"), length).otherwise(F.col("doc.n_chars"))
    return rows.select(*[changed.get(c, F.col(f"doc.{c}")).alias(c) for c in docs.columns])


SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
), worded AS (
  SELECT doc_id, line_no, list_filter(string_split_regex(lower(line), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '') AS w FROM lines
), long_ AS (
  SELECT * FROM worded WHERE len(w) >= {MIN_WORDS}
), distinct_ AS (
  SELECT w, min({{'d': doc_id, 'l': line_no}}) AS place FROM long_ GROUP BY w
), cuts AS (
  SELECT w, place, unnest(range(1, len(w) + 1)) AS i FROM distinct_
), variants AS (
  SELECT w, place, i, array_to_string(list_concat(w[:i - 1], w[i + 1:]), ' ') AS v, len(w) AS n FROM cuts
), pairs AS (
  SELECT a.w, a.place, b.place AS other FROM variants a JOIN variants b ON a.v = b.v AND a.i = b.i AND a.n = b.n AND b.place < a.place
  UNION ALL
  SELECT a.w, a.place, b.place FROM variants a JOIN distinct_ b ON a.v = array_to_string(b.w, ' ') AND b.place < a.place
  UNION ALL
  SELECT b.w, b.place, a.place FROM variants a JOIN distinct_ b ON a.v = array_to_string(b.w, ' ') AND a.place < b.place
), near AS (
  SELECT w, min(other) AS other FROM pairs GROUP BY w
)
SELECT doc_id, line_no, coalesce(other, place).d AS kept_doc_id, coalesce(other, place).l AS kept_line_no,
  CASE WHEN other IS NOT NULL THEN 1 ELSE 0 END AS edits
FROM long_ JOIN distinct_ USING (w) LEFT JOIN near USING (w)
WHERE other IS NOT NULL OR doc_id <> place.d OR line_no <> place.l
"""
