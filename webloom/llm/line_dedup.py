"""Line-level de-duplication across documents, with DataFrame functions only.

Lines are exploded and normalised, hashed to 128 bits, and counted by distinct document. A line
whose key is found in ``min_docs`` documents or more stays only in the document with the smallest
id that holds it. What moves between executors are hashes and ids; the text moves once, when the
lines to drop meet their document.

Null handling: a null or empty text is one empty line. A row without ``doc_id`` cannot be told
apart from others: it neither counts nor loses lines. Rows that repeat a ``doc_id`` count as one
document. A very long text is split and rebuilt within its row. Columns other than the id and the text pass through
unchanged, whatever their names; ``names`` give way to the new columns. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.skew import free, join_hot, often, quoted
from webloom.session import materialize

#: The characters stripped at both ends of a line, and the letters that are folded.
STRIP = " \t\n\u000b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without outer white space, A-Z lower-cased; other letters keep their case."""
    bare = F.btrim(line, F.lit(STRIP))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashed(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("_h1"), F.xxhash64(F.lit(7), key).alias("_h2")]


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 10,
    min_docs: int = 2,
    names: tuple[str, str] = ("n_lines", "n_dropped"),
) -> DataFrame:
    """``docs`` with ``text_col`` rebuilt, plus ``names``: the lines before and those dropped (long).

    A document without dropped lines keeps its text as it is, null included.
    """
    text, doc = quoted([text_col, id_col])
    row_hash = F.xxhash64(F.lit(11), text)
    lines = (
        docs.where(doc.isNotNull() & (F.char_length(text) >= min_chars))
        .select(doc.alias("_id"), row_hash.alias("_row"), F.posexplode(split_lines(text)).alias("_pos", "_line"))
        .select("_id", "_row", "_pos", line_key(F.col("_line")).alias("_key"))
        .where(F.char_length("_key") >= min_chars)
        .select("_id", "_row", "_pos", *_hashed(F.col("_key")))
    )
    lines = materialize(lines, "line-hashes")
    if min_docs <= 2:
        common = lines.groupBy("_h1", "_h2").agg(F.min("_id").alias("_keeper"), F.max("_id").alias("_last"), F.count("*").alias("_lines"))
        if min_docs == 2:
            common = common.where(F.col("_keeper") < F.col("_last"))
    else:
        common = (
            lines.groupBy("_h1", "_h2", "_id")
            .agg(F.count("*").alias("_one"))
            .groupBy("_h1", "_h2")
            .agg(F.min("_id").alias("_keeper"), F.count("*").alias("_n"), F.sum("_one").alias("_lines"))
            .where(F.col("_n") >= min_docs)
        )
    common = common.select(F.col("_h1").alias("_a"), F.col("_h2").alias("_b"), "_keeper", "_lines")
    common = materialize(common, "line-common")
    same = (F.col("_h1") == F.col("_a")) & (F.col("_h2") == F.col("_b"))
    did, drow, gone = free(docs, "_did", "_drow", "_gone")
    dropped = (
        join_hot(lines, common, same, often("_lines", lines.count()), "inner")
        .where(F.col("_id") > F.col("_keeper"))
        .groupBy(F.col("_id").alias(did), F.col("_row").alias(drow))
        .agg(F.collect_set("_pos").alias(gone))
    )
    old, split, count = free(docs, "_old", "_split", "_count")
    kept = F.array_except(F.sequence(F.lit(0), F.col(count) - 1), F.col(gone))
    rebuilt = F.array_join(F.transform(kept, lambda i: F.element_at(F.col(split), i + 1)), "\n")
    joined = docs.join(dropped, (doc == F.col(did)) & (row_hash == F.col(drow)), "left")
    new = {n.lower() for n in names}
    return (
        joined.withColumn(old, text)
        .withColumn(split, split_lines(F.col(old)))
        .withColumn(count, F.size(split))
        .withColumn(text_col, F.when(F.col(gone).isNull(), text).otherwise(rebuilt))
        .select(
            *quoted([c for c in docs.columns if c.lower() not in new]),
            F.col(count).cast("long").alias(names[0]),
            F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(names[1]),
        )
    )


def digest_columns(deduped: DataFrame) -> DataFrame:
    """The columns of the query: ids, counts and the digest of what is left."""
    return deduped.select(
        "doc_id",
        "n_lines",
        "n_dropped",
        F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, rn, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
  FROM (SELECT doc_id, row_number() OVER () AS rn, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, rn, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), common AS (
  SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT y.doc_id, y.rn, y.line, y.pos, (c.k IS NOT NULL AND y.doc_id > c.keeper) AS gone
  FROM keyed y LEFT JOIN common c ON y.k = c.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id, rn
"""
