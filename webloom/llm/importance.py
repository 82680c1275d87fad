"""Importance resampling towards a target: documents drawn by how much their words look like the target's.

Words (runs of letters, digits and bytes above 0x7F, A-Z lower-cased) are hashed to buckets by CRC-32; how often a
bucket occurs in all documents and in all target texts gives its gain, and a document weighs what its features gain on
average. Gumbel noise from its id turns the highest scores into a draw without replacement.

Texts are never split into words as objects. A byte automaton works on the Arrow buffer of a whole batch: a table
classes each byte, differences of the classes give the starts and ends of words, and table-driven CRCs advance by one
byte at all starts at once, longest words first, so that those still running are a prefix.

Null handling: a null text has no features and weighs 0. A row without id has no score and is never drawn, and does
not count among those to draw from. Rows that repeat an id are documents of their own; ties go to the smaller id, then
to fewer features. Very long texts are whole, one at a time; words over ``LONG`` bytes are hashed one by one. Without
documents the result is empty, without target texts all gains follow from the documents alone. Other columns are not
looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.session import materialize, ship

#: Words longer than this leave the common steps, which would otherwise go on for the longest one.
LONG = 64
#: A text longer than this many bytes is worked on alone.
STRETCH = 1 << 22


def byte_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(is a word byte, the byte lower-cased, CRC-32 of one byte)."""
    byte = np.arange(256)
    upper = (byte >= ord("A")) & (byte <= ord("Z"))
    lower = np.where(upper, byte + 32, byte)
    word = (byte >= 0x80) | ((byte >= ord("0")) & (byte <= ord("9"))) | ((lower >= ord("a")) & (lower <= ord("z")))
    crc = byte.astype(np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(0xEDB88320), crc >> 1)
    return word, lower.astype(np.uint8), crc.astype(np.uint32)


WORD, LOWER, CRC = byte_tables()


def words_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the words of texts that stand end to end; ``ends`` is where each text ends."""
    inside = WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = ends[(ends > 0) & (ends < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1 - starts


def crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of the lower-cased bytes of each word."""
    out = np.empty(len(starts), np.uint32)
    low = LOWER[data]
    long = np.flatnonzero(lengths > LONG)
    for i in long.tolist():
        out[i] = zlib.crc32(low[starts[i] : starts[i] + lengths[i]].tobytes())
    order = np.argsort(-np.minimum(lengths, LONG + 1).astype(np.int8), kind="stable")[len(long) :]
    at = starts[order]
    running = len(order) - np.searchsorted(lengths[order][::-1], np.arange(1, LONG + 1))
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for step in range(LONG):
        n = running[step]
        if not n:
            break
        crc[:n] = CRC[(crc[:n] ^ low[at[:n] + step]) & 0xFF] ^ (crc[:n] >> 8)
    out[order] = ~crc
    return out


def text_buffers(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of texts, their bytes end to end, where each ends) for stretches of a column of texts."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    begin = 0
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + STRETCH, side="right")) - 1)
        yield end - begin, raw[at[begin] : at[end]], at[begin + 1 : end + 1] - at[begin]
        begin = end


def word_buckets(column: pa.Array, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket of each word, words of each text) for stretches of a column of texts, in order."""
    for n, data, ends in text_buffers(column):
        starts, lengths = words_of(data, ends)
        yield crcs(data, starts, lengths) % np.uint32(buckets), np.diff(np.searchsorted(starts, ends), prepend=0)


def bucket_counts(texts: DataFrame, text_col: str, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all texts: a task counts its own, and Spark adds up; ``buckets`` rows come back."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for found, _ in word_buckets(batch.column(0), buckets):
                total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    counted = texts.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in counted.collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket in thousandths, rounded down."""
    width = len(source)
    s_all, t_all = float(source.sum() + width), float(target.sum() + width)
    pairs = zip(source.tolist(), target.tolist())
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in pairs], np.int64)


def weighed(docs: DataFrame, id_col: str, text_col: str, gain: np.ndarray) -> DataFrame:
    """Per document: doc_id, n_features, weight (the mean gain, rounded down)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, weights = [], []
            for found, words in word_buckets(batch.column(1), len(gain)):
                running = np.concatenate([[0], np.cumsum(gain[found])])
                ends = np.cumsum(words)
                total = running[ends] - running[ends - words]
                counts.append(words)
                weights.append(np.where(words > 0, total // np.maximum(words, 1), 0))
            columns = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in (counts, weights)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_features", "weight"])

    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_features long, weight long")


def drawn(rows: DataFrame, seed: int, least_features: int, percent: int) -> DataFrame:
    """``rows`` with score and rank.

    A score is a whole number of thousandths: the logarithms of counts and of 32-bit noise leave some hundred thousand
    different ones, whatever the number of documents. How many documents have each is what the driver sees; places
    within one score are given score by score.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = materialize(rows.withColumn("score", F.col("weight") + noise), "scored")
    able = (F.col("n_features") >= least_features) & F.col("score").isNotNull()
    spark = rows.sparkSession
    have = {r["score"]: r["n"] for r in scored.where(able).groupBy("score").agg(F.count("*").alias("n")).collect()}
    wanted, before, bases = percent * sum(have.values()) // 100, 0, []
    for score in sorted(have, reverse=True):
        if before >= wanted:
            break
        bases.append((score, before))
        before += have[score]
    lowest = bases[-1][0] if bases else None
    candidate = able & (F.col("score") >= lowest) if bases else F.lit(False)
    same = ["score", "doc_id", "n_features", "weight"]
    order = Window.partitionBy("score").orderBy("doc_id", "n_features")
    alike = scored.where(candidate).groupBy(*same).agg(F.count("*").alias("rows"))  # repeated rows are one until they have places
    placed = alike.withColumn("to", F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    table = spark.createDataFrame(bases, "of long, base long")
    based = placed.join(F.broadcast(table), F.col("score") == F.col("of"))  # a row for each score at most
    place = F.explode(F.sequence(F.col("base") + F.col("to") - F.col("rows") + 1, F.col("base") + F.col("to")))
    ranked = based.select("doc_id", "n_features", "weight", "score", place.alias("place"))
    ranked = ranked.withColumn("rank", F.when(F.col("place") <= wanted, F.col("place"))).drop("place")
    rest = scored.where(~F.coalesce(candidate, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionByName(rest.select(*columns))


def importance_resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    buckets: int = 10_000,
    seed: int = 2024,
    least_features: int = 20,
    percent: int = 10,
) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank (1 is the highest score; null: not drawn), all long."""
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets))
    return drawn(weighed(docs, id_col, text_col, gain), seed, least_features, percent)


ORACLE = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i::BIGINT], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
           lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS t
), texts AS (SELECT row_number() OVER () AS rn, 's' AS side, doc_id, text FROM documents UNION ALL SELECT -1, 't', NULL, text FROM benchmark
), tokens AS (
  SELECT rn, side, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts
), grouped AS (SELECT rn, side, word, count(*) AS n FROM tokens GROUP BY ALL
), words AS (
  SELECT word, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(hex(encode(word))) + 1, 2), lambda i: ('0x' || substr(hex(encode(word)), i, 2))::BIGINT)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM grouped), crc
), counts AS (
  SELECT bucket, sum(n) FILTER (WHERE side = 's') AS s, sum(n) FILTER (WHERE side = 't') AS t FROM grouped JOIN words USING (word) GROUP BY 1
), sums AS (SELECT coalesce(sum(s), 0)::DOUBLE AS big_s, coalesce(sum(t), 0)::DOUBLE AS big_t FROM counts
), gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (big_s + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (big_t + 10000))))::BIGINT AS g FROM counts, sums
), weights AS (
  SELECT rn, sum(n)::BIGINT AS n_features, floor(sum(n * g)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight
  FROM grouped JOIN words USING (word) JOIN gain USING (bucket) WHERE side = 's' GROUP BY rn
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM texts LEFT JOIN weights USING (rn) WHERE side = 's'
), able AS (
  SELECT *, n_features >= 20 AND score IS NOT NULL AS fits FROM scored
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY fits ORDER BY score DESC, doc_id, n_features) AS place, count(*) OVER (PARTITION BY fits) AS n FROM able
)
SELECT doc_id, n_features, weight, score, CASE WHEN fits AND place <= 10 * n // 100 THEN place END AS rank FROM placed
"""
