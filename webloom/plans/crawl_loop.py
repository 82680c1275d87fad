"""The crawl as a loop over depths, with a set of seen addresses that is stored, filtered and joined without being moved.

The set is a table bucketed by address: what a round found is shuffled into the buckets, the set itself never is. Beside it
lies a blocked Bloom filter, eight words of 64 bits for about forty addresses, as rows of their own. A round asks the filter
first; what it does not know is new and skips the join, what it may know is looked up. A filter has false positives and no
false negatives, so the rows are those of the join alone; ``Seen.false_positives`` measures how many look-ups were in vain.
The filter pays where most addresses are new, as in the first rounds; ``filtered=False`` goes without.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom import views as V
from webloom.session import dealt, discard, drop_path, materialize, work_path

WORDS = 8
#: Addresses for each block of 512 bits.
FILL = 40
KEY = ["land_id", "url"]


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(blocks)).alias("block")


def _bits() -> list[Column]:
    """One bit in each of the block's words, by hashes of their own."""
    return [F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(xxhash64(url, land_id, 'bits'), {6 * k}) & 63 AS INT))") for k in range(WORDS)]


def filter_rows(rows: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w7): the bits of the rows' addresses, or-ed in each task before they are shuffled."""
    each = rows.select(_block(blocks), *[b.alias(f"w{k}") for k, b in enumerate(_bits())])
    return each.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)])


class Seen:
    """Addresses of projects (land_id, url, depth) that were found so far, below a folder of the shared storage.

    ``expected`` sizes filter and buckets; more addresses than that raise the false positives and the size of the buckets,
    and lose nothing. Null addresses are never seen and never kept.
    """

    def __init__(self, spark: SparkSession, expected: int, buckets: int | None = None, filtered: bool = True):
        self.spark, self.filtered = spark, filtered
        self.blocks = max(1, -(-expected // FILL))
        self.buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), expected // 4_000_000)
        self.name, self.path = f"seen_{uuid.uuid4().hex[:12]}", work_path(spark, "seen")
        self.parts: list[str] = []
        self.asked = self.passed = self.known = 0
        self.exists = False

    def unseen(self, found: DataFrame) -> DataFrame:
        """The rows of ``found`` (land_id, url, one row each) that the set does not hold, as a written table."""
        found = found.where("land_id IS NOT NULL AND url IS NOT NULL")
        if not self.exists:
            return materialize(found, "unseen")
        if not self.filtered:
            return materialize(found.join(self.spark.table(self.name).select(*KEY), KEY, "left_anti"), "unseen")
        bits = found.select("*", _block(self.blocks), *[b.alias(f"b{k}") for k, b in enumerate(_bits())])
        hit = F.coalesce(F.expr(" AND ".join(f"(w{k} & b{k}) <> 0" for k in range(WORDS))), F.lit(False))
        asked = materialize(bits.join(self._filter(), "block", "left").select(*found.columns, hit.alias("_maybe")), "asked")
        maybe = asked.where("_maybe").drop("_maybe")
        unknown = maybe.join(self.spark.table(self.name).select(*KEY), KEY, "left_anti")
        new = materialize(asked.where("NOT _maybe").drop("_maybe").select(F.lit(False).alias("_vain"), "*").unionByName(unknown.select(F.lit(True).alias("_vain"), "*")), "unseen")
        n = asked.agg(F.count("*"), F.count_if("_maybe")).first()
        vain = new.where("_vain").count()
        self.asked, self.passed, self.known = self.asked + n[0], self.passed + vain, self.known + n[1] - vain
        discard(asked)
        kept = new.drop("_vain")
        kept.work_path = new.work_path
        return kept

    def false_positives(self) -> float:
        """Of the addresses that were new, how many the filter took for known ones."""
        new = self.asked - self.known
        return self.passed / new if new else 0.0

    def add(self, rows: DataFrame) -> None:
        """Put rows (land_id, url, depth) that ``unseen`` gave into the set; each call writes to the buckets and the filter."""
        kept = rows.select(*KEY, "depth")
        # one task for each bucket, so that a round adds one file to each
        kept.repartition(self.buckets, *KEY).write.mode("append").format("parquet").bucketBy(self.buckets, *KEY).option("path", f"{self.path}/rows").saveAsTable(self.name)
        self.exists = True
        if self.filtered:
            part = f"{self.path}/filter/{len(self.parts)}"
            filter_rows(kept, self.blocks).write.parquet(part)
            self.parts.append(part)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name) if self.exists else self.spark.createDataFrame([], "land_id long, url string, depth int")

    def close(self) -> None:
        """Forget the set and its files; what was read from it must have been written before."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        drop_path(self.spark, self.path)

    def _filter(self) -> DataFrame:
        each = self.spark.read.parquet(*self.parts)
        return each.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)]) if len(self.parts) > 1 else each


def crawl_rounds(seeds: DataFrame, pages: DataFrame, links: DataFrame, most_depth: int = 3, expected: int | None = None, filtered: bool = True) -> dict:
    """Follow links from the seeds, one depth a round, until nothing new turns up.

    ``seeds``: land_id, url. ``pages``: what a fetch of an address gives (land_id, url, relevance). ``links``: land_id,
    source, target (addresses). Links of a page are followed where its relevance is above zero and its depth below
    ``most_depth``; pages without relevance, and addresses that no fetch answers, stay as they are. Every address has the
    smallest depth at which it was found. Comes back: ``pages`` (land_id, url, depth), ``links`` (land_id, source, target,
    each once, none to the page itself), ``rounds`` (new addresses of each) and ``false_positives`` of the filter.
    """
    spark = seeds.sparkSession
    count = links.count()
    expected = expected or max(1, count)
    seen = Seen(spark, expected, filtered=filtered)
    # the pages that pass for the relevance, and the links that lead elsewhere, once for all rounds
    relevant = pages.where("relevance > 0").select("land_id", F.col("url").alias("source")).distinct()
    opened = links.where("source <> target").join(relevant, ["land_id", "source"]).select("land_id", "source", "target")
    open_links = materialize(dealt(opened, count, "land_id", "source", "target").distinct(), "links")
    new = seen.unseen(seeds.select("land_id", "url").distinct().withColumn("depth", F.lit(0)))
    edges, rounds = [], []
    for depth in range(most_depth + 1):
        rounds.append(new.count())
        if not rounds[-1]:
            break
        seen.add(new)
        if depth == most_depth:
            break
        step = materialize(open_links.join(new.select("land_id", F.col("url").alias("source")), ["land_id", "source"]), "edges")
        edges.append(step)
        discard(new)
        found = step.select("land_id", F.col("target").alias("url")).distinct()
        new = seen.unseen(found.withColumn("depth", F.lit(depth + 1)))
    result = materialize(seen.rows().select("land_id", "url", "depth"), "crawled")
    followed = edges[0] if edges else open_links.limit(0)
    for step in edges[1:]:
        followed = followed.unionByName(step)
    rate = seen.false_positives()
    seen.close()
    discard(new)
    return {"pages": result, "links": followed, "rounds": rounds, "false_positives": rate}


def _homes(s: SparkSession, d: str):
    """Each project starts from the first page of every host; links between pages are those of the corpus."""
    p = V.expressions(s, d).select("id", "land_id", "url", "domain_name", "relevance")
    seeds = p.groupBy("land_id", "domain_name").agg(F.min("url").alias("url"))
    ends = V.links(s, d).join(p.select(F.col("id").alias("source_id"), "land_id", F.col("url").alias("source")), "source_id")
    links = ends.join(p.select(F.col("id").alias("target_id"), F.col("url").alias("target")), "target_id").select("land_id", "source", "target")
    return seeds, p, links


QUERIES = {
    "crawl_rounds": lambda s, d: crawl_rounds(*_homes(s, d))["pages"],
    "crawl_round_links": lambda s, d: crawl_rounds(*_homes(s, d), most_depth=2)["links"],
}

_WEB = """web AS (SELECT DISTINCT a.land_id, a.url AS source, b.url AS target FROM links l JOIN expressions a ON a.id = l.source_id JOIN expressions b ON b.id = l.target_id WHERE a.url <> b.url),
 open AS (SELECT DISTINCT w.* FROM web w JOIN expressions e ON e.land_id = w.land_id AND e.url = w.source AND e.relevance > 0)"""


def _reach(most_depth: int) -> str:
    return f"""reach AS (SELECT land_id, min(url) AS url, 0 AS depth FROM expressions GROUP BY land_id, domain_name
  UNION SELECT r.land_id, o.target, r.depth + 1 FROM reach r JOIN open o ON o.land_id = r.land_id AND o.source = r.url WHERE r.depth < {most_depth})"""


_RECURSIVE = lambda *parts: V.with_views(*parts).replace("WITH ", "WITH RECURSIVE ", 1)
ORACLES = {
    "crawl_rounds": _RECURSIVE(V.EXPRESSIONS, V.LINKS, _WEB, _reach(3)) + "SELECT land_id, url, min(depth)::INT AS depth FROM reach GROUP BY 1, 2",
    "crawl_round_links": _RECURSIVE(V.EXPRESSIONS, V.LINKS, _WEB, _reach(2)) + "SELECT DISTINCT o.land_id, o.source, o.target FROM open o JOIN reach r ON r.land_id = o.land_id AND r.url = o.source AND r.depth < 2",
}
