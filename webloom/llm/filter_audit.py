"""How document filters interact: what each removes, in every order that they could be applied in.

Native expressions give each document a mask of the filters that it fails, a grouping by text (by its digest, so
that texts are not shuffled) supplies the smallest id that holds it, and masks are counted: 32 cells for each part
of the corpus. All 120 orders are read off the cells; no order looks at a document again.

The filters: A fewer than ``least_words`` words, B too few of them different, C too many capitals, D a character of
``MARKS``, E the text of a document with a smaller id, anywhere in the table.

Null handling: a null text is empty, a null part is the empty string. A document without id, and one that only
shares text and id with others, is no copy of any; a document without id is nobody's first copy either, and has
no labels. Ids with several rows of labels have a label if one of the rows has it. A very long text is
one row like others. An empty table has no parts and gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.session import materialize

#: What separates words, and the characters of filter D.
BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\u000b\f\r"
MARKS = r"[#$%&*|]"

FILTERS = "ABCDE"
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
CELLS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COUNTED = ("n", "good", "toxic")


def word_list(text: Column) -> Column:
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK))


def text_mask(text: Column, words: Column, least_words: int, distinct_percent: int, capital_percent: int) -> Column:
    """The bits of the filters that look at one text alone: A to D."""
    n = F.size(words)
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]", ""))
    fails = {
        "A": n < least_words,
        "B": F.size(F.array_distinct(words)) * 100 < n * distinct_percent,
        "C": capitals.cast("long") * 100 > F.char_length(text).cast("long") * capital_percent,
        "D": text.rlike(MARKS),
    }
    return sum(F.when(c, BIT[f]).otherwise(0) for f, c in fails.items())


def masked(docs: DataFrame, labels: DataFrame, least_words: int = 200, distinct_percent: int = 50, capital_percent: int = 3) -> DataFrame:
    """Rows that stand for ``n`` documents each: part, mask, n, good, toxic.

    Documents are counted by text and part before copies meet, so that a text which a third of all documents share
    is a few rows by then.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("part"))
    worded = text.withColumn("words", word_list(F.col("text")))
    narrow = worded.select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), text_mask(F.col("text"), F.col("words"), least_words, distinct_percent, capital_percent).alias("own")
    )
    said = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("label_id"))
    said = said.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    # documents without id go by their text here: one null would gather them in one task
    place = F.coalesce("doc_id", F.xxhash64("digest"))
    labelled = narrow.join(said, (place == F.col("label_id")) & F.col("doc_id").isNotNull(), "left").drop("label_id")
    labelled = labelled.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    key = ["digest", "part", "good", "toxic"]
    by_id = labelled.groupBy("doc_id", *key).agg(F.count("*").alias("n"), F.first("own").alias("own"))
    by_text = by_id.groupBy(*key).agg(
        F.first("own").alias("own"),
        F.sum("n").alias("n"),
        F.min("doc_id").alias("least"),
        F.min_by("n", "doc_id").alias("at_least"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"),
    )
    first = by_text.groupBy("digest").agg(F.min("least").alias("first"))
    placed = by_text.join(first, "digest")
    stays = F.col("no_id") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    halves = F.array(F.struct(F.lit(0).alias("bit"), stays.alias("n")), F.struct(F.lit(BIT["E"]).alias("bit"), (F.col("n") - stays).alias("n")))
    each = placed.select("part", "own", "good", "toxic", F.explode(halves).alias("half")).where("half.n > 0")
    count = F.col("half.n")
    return each.select(
        "part",
        (F.col("own") + F.col("half.bit")).alias("mask"),
        count.alias("n"),
        F.when(F.col("good"), count).otherwise(0).alias("good"),
        F.when(F.col("toxic"), count).otherwise(0).alias("toxic"),
    )


def _count_at(counts: str):
    return lambda mask: F.coalesce(F.element_at(counts, mask), F.lit(0).cast("long"))


def cells(rows: DataFrame) -> DataFrame:
    """One row per part: an array of ``CELLS`` counts for each of n, good and toxic, by mask."""
    few = rows.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in COUNTED])
    made = {c: F.map_from_entries(F.collect_list(F.struct("mask", c))) for c in COUNTED}  # at most 32 entries
    by_part = few.groupBy("part").agg(*[m.alias(c) for c, m in made.items()])
    all_cells = F.sequence(F.lit(0), F.lit(CELLS - 1))
    return by_part.select("part", *[F.transform(all_cells, _count_at(c)).alias(c) for c in COUNTED])


def _total(counts: str, wanted) -> Column:
    """The documents in the cells whose mask is wanted."""
    picked = F.transform(F.col(counts), lambda n, m: F.when(wanted(m), n).otherwise(F.lit(0).cast("long")))
    return F.aggregate(picked, F.lit(0).cast("long"), lambda a, b: a + b)


def audit(by_part: DataFrame) -> DataFrame:
    """Every order and step over the cells of each part: see the module for the columns."""
    orders = by_part.withColumn("filter_order", F.explode(F.lit(ORDERS)))
    steps = orders.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    earlier = F.substring(F.col("filter_order"), F.lit(1), F.col("step") - 1)
    bit = sum(F.when(F.substring(F.col("filter_order"), F.col("step"), F.lit(1)) == f, b).otherwise(0) for f, b in BIT.items())
    steps = steps.withColumns({"bit": bit, "before": sum(F.when(F.contains(earlier, F.lit(f)), b).otherwise(0) for f, b in BIT.items())})
    fails = lambda m: m.bitwiseAND(F.col("bit")) != 0
    passed = lambda m: m.bitwiseAND(F.col("before")) == 0
    counted = steps.withColumns(
        {
            "kept": _total("n", lambda m: ~fails(m) & passed(m)),
            "removed": _total("n", lambda m: fails(m) & passed(m)),
            "redundant": _total("n", lambda m: fails(m) & ~passed(m)),
            "unique_fails": _total("n", lambda m: m == F.col("bit")),
            "good_lost": _total("good", lambda m: fails(m) & passed(m)),
            "toxic_lost": _total("toxic", lambda m: fails(m) & passed(m)),
        }
    ).drop(*COUNTED)
    whole = counted.groupBy(F.col("part").alias("of"), F.col("bit").alias("its")).agg(F.sum("removed").alias("shapley"))
    same = (F.col("part") == F.col("of")) & (F.col("bit") == F.col("its"))
    return counted.join(whole, same).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step; the cells are written first, so that documents are read once."""
    return audit(materialize(cells(masked(docs, labels)), "filter-cells"))


ORACLE = r"""
WITH said AS (
  SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id
), plain AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), masks AS (
  SELECT p.part, coalesce(s.good, false) AS good, coalesce(s.toxic, false) AS toxic,
         CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN p.doc_id > min(p.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
  FROM plain p LEFT JOIN said s ON s.doc_id = p.doc_id
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
   AND len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT filter_order, i AS step, bits[i] AS bit, coalesce(list_sum(bits[1:i - 1]), 0)::INT AS before FROM orders, range(1, 6) r(i)
), grouped AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS t FROM masks GROUP BY 1, 2
), counted AS (
  SELECT part, filter_order, step, bit,
         coalesce(sum(n) FILTER (WHERE mask & (before | bit) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE mask & before <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails,
         coalesce(sum(g) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost,
         coalesce(sum(t) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost
  FROM grouped, steps GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM counted
"""
