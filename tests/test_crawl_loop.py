"""The crawl loop against a walk in memory, and its set of seen addresses."""

import random

import pytest

from webloom import views as V
from webloom.plans.crawl_loop import Seen, crawl_rounds

ROWS = "land_id long, url string"


def walk(seeds, pages, links, most_depth):
    relevant = {(a, u) for a, u, r in pages if r is not None and r > 0}
    depth, edges, now = dict.fromkeys(seeds, 0), set(), set(seeds)
    for d in range(most_depth):
        step = {(a, s, t) for a, s, t in links if (a, s) in now & relevant and t is not None and s != t}
        edges |= step
        now = {(a, t) for a, _, t in step} - depth.keys()
        depth.update(dict.fromkeys(now, d + 1))
    return {(a, u, d) for (a, u), d in depth.items()}, edges


@pytest.mark.parametrize("filtered", [True, False])
def test_rounds_are_those_of_a_walk(spark, filtered):
    rng = random.Random(3)
    pages = [(1 + k % 2, f"u{k // 2}", rng.choice([None, 0.0, 1.0, 2.5])) for k in range(400)]
    links = [(1 + rng.randrange(2), f"u{rng.randrange(200)}", f"u{int(rng.paretovariate(0.6)) % 230}") for _ in range(700)]
    links += [(1, "u0", "u0"), (1, "u0", None), (2, "u1", "hub")] + [(1, f"u{k}", "hub") for k in range(200)]
    seeds = [(1, "u0"), (1, "u3"), (2, "u1"), (2, "nowhere"), (1, "u0")]
    pages += [(1, "u0", 1.0), (1, "u3", 1.0), (2, "u1", 1.0), (1, "hub", 1.0)]  # an address may be fetched twice
    got = crawl_rounds(
        spark.createDataFrame(seeds, ROWS), spark.createDataFrame(pages, ROWS + ", relevance double"), spark.createDataFrame(links, "land_id long, source string, target string"), 4, expected=40, filtered=filtered
    )
    wanted, edges = walk(set(seeds), pages, links, 4)
    found = [tuple(r) for r in got["pages"].collect()]
    assert len(found) == len(set(found)) and set(found) == wanted
    step = [tuple(r) for r in got["links"].collect()]
    assert len(step) == len(set(step)) and set(step) == edges
    assert sum(got["rounds"]) == len(wanted)


def test_no_seeds_and_no_links(spark):
    none, pages = spark.createDataFrame([], ROWS), spark.createDataFrame([(1, "a", 1.0)], ROWS + ", relevance double")
    links = spark.createDataFrame([], "land_id long, source string, target string")
    assert crawl_rounds(none, pages, links)["pages"].count() == 0
    got = crawl_rounds(spark.createDataFrame([(1, "a"), (1, None)], ROWS), pages, links)
    assert [tuple(r) for r in got["pages"].collect()] == [(1, "a", 0)] and got["links"].count() == 0


@pytest.mark.parametrize("expected, most", [(20_000, 0.03), (400, 1.0)])  # a filter of the right size, and one that is full
def test_filter_never_loses_an_address(spark, expected, most):
    rows = lambda a, b: spark.range(a, b).selectExpr("1 + id % 2 AS land_id", "concat('https://x.org/', id) AS url", "0 AS depth")
    seen = Seen(spark, expected)
    for a in (0, 4000, 8000):
        seen.add(seen.unseen(rows(a, a + 4000)))
    got = {r["url"] for r in seen.unseen(rows(6000, 20_000)).collect()}
    assert got == {f"https://x.org/{k}" for k in range(12_000, 20_000)}
    assert 0 <= seen.false_positives() <= most and seen.known == 6000
    assert seen.false_positives() > 0.2 or expected > 400
    seen.close()


def test_the_set_is_not_shuffled(spark):
    seen = Seen(spark, 1000, buckets=4, filtered=False)
    rows = spark.range(1000).selectExpr("1 + id % 2 AS land_id", "concat('u', id) AS url", "0 AS depth")
    seen.add(rows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = rows.repartition(4, "land_id", "url").join(spark.table(seen.name).select("land_id", "url"), ["land_id", "url"], "left_anti")
        assert found.count() == 0
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.split("+- Scan")[0].count("Exchange hashpartitioning") <= 2 and "Bucketed: true" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        seen.close()


def test_links_of_a_task_do_not_grow_with_the_table(spark, tmp_path):
    """Many links: more tasks than the session's shuffle partitions, and each pair of pages once all the same."""
    spark.range(1000).selectExpr("id AS page_id").write.parquet(str(tmp_path / "pages.parquet"))
    n = 3_000_000
    spark.range(n).selectExpr("id AS l_orderkey", "id DIV 1000 AS l_partkey").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = V.links(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 8 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = spark.range(n).selectExpr("id % 1000 AS a", "(id DIV 1000) * 7 % 1000 AS b").where("a <> b").distinct()
    assert found.count() == wanted.count() and found.exceptAll(wanted).isEmpty()
