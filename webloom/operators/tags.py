"""Tag trees, their paths, and the matrix of pages by tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom import views as V
from webloom.session import discard, materialize


def tag_chains(tags: DataFrame) -> DataFrame:
    """Each tag with ``chain``: (sorting, id, name) of all tags from its root down to itself.

    A tag whose parent is missing is a root; tags of a ring, and those below one, have no root and are left out. Every
    round joins each tag to the tag that its chain hangs on, so that chains double and a tree of any depth takes as many
    rounds as its depth has binary digits. When a round completes no chain, only rings are left: had there been a
    deeper tag, one of its ancestors would have been completed.
    """
    link = F.struct("sorting", "id", "name")
    parents = tags.select(F.col("id").alias("_id")).distinct()
    begun = tags.join(parents, F.col("parent_id") == F.col("_id"), "left").withColumn("chain", F.array(link))
    state = materialize(begun.select("id", "parent_id", "name", "sorting", F.col("_id").alias("_up"), "chain"), "tag-chains")
    hanging, before = state.where("_up IS NOT NULL").count(), None
    while hanging and hanging != before:
        above = state.select(F.col("id").alias("_of"), F.col("_up").alias("_next"), F.col("chain").alias("_above"))
        longer = state.where("_up IS NOT NULL").join(above, F.col("_up") == F.col("_of"))
        longer = longer.select("id", "parent_id", "name", "sorting", F.col("_next").alias("_up"), F.concat("_above", "chain").alias("chain"))
        old, state = state, materialize(state.where("_up IS NULL").unionByName(longer), "tag-chains")
        discard(old)
        hanging, before = state.where("_up IS NOT NULL").count(), hanging
    return state.where("_up IS NULL").drop("_up")


def tag_paths(tags: DataFrame, separator: str = "_") -> DataFrame:
    """Each tag with its path from the root, its depth, and whether it is a leaf; see ``tag_chains``."""
    parents = tags.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("_p")).distinct()
    path = F.array_join(F.transform("chain", lambda c: c["name"]), separator).alias("path")
    found = tag_chains(tags).select("id", "parent_id", "name", "sorting", path, (F.size("chain") - 1).alias("depth"))
    return found.join(parents, F.col("id") == F.col("_p"), "left").select("id", "parent_id", "name", "sorting", "path", "depth", F.col("_p").isNull().alias("is_leaf"))


def ordered_tags(tags: DataFrame) -> DataFrame:
    """Tags in the order of lists: by parent, those without one last, then by sorting."""
    return tags.orderBy(F.col("parent_id").asc_nulls_last(), "sorting", "id")


def nested_tree(tags: DataFrame) -> DataFrame:
    """One row per root with its subtree as JSON: id, name, children in order; a missing parent makes a root.

    Sorted by their chains, the tags of a root stand as they do in the text: each opens its object, and closes as many
    as the next one stands higher.
    """
    order = F.transform("chain", lambda c: F.struct(c["sorting"], c["id"])).alias("order")
    tag = F.struct(order, (F.size("chain") - 1).alias("depth"), "id", "name").alias("tag")
    grouped = tag_chains(tags).groupBy(F.col("chain")[0]["id"].alias("id")).agg(F.array_sort(F.collect_list(tag)).alias("tags"))

    def written(t, i):
        earlier = F.coalesce(F.get("tags", i - 1)["depth"], F.lit(-1))
        later = F.coalesce(F.get("tags", i + 1)["depth"], F.lit(0))
        name = F.to_json(F.array(t["name"]))
        head = F.concat(F.when(earlier >= t["depth"], ",").otherwise(""), F.lit('{"id":'), t["id"].cast("string"), F.lit(',"name":'), name.substr(F.lit(2), F.length(name) - 2))
        return F.concat(head, F.lit(',"children":['), F.repeat(F.lit("]}"), F.when(later > t["depth"], 0).otherwise(t["depth"] - later + 1)))

    return grouped.select("id", F.array_join(F.transform("tags", written), "").alias("tree"))


def descendants(tags: DataFrame, tag_id: int) -> DataFrame:
    """The tags below a tag, with their distance from it."""
    chains = tag_chains(tags).select("id", F.transform("chain", lambda c: c["id"]).alias("steps"))
    at = F.array_position("steps", F.lit(tag_id))
    return chains.where(at > 0).select("id", (F.size("steps") - at).cast("int").alias("distance")).where("distance > 0")


def edited_passages(tagged: DataFrame, inserts: DataFrame, updates: DataFrame, deletes: DataFrame) -> DataFrame:
    """Tagged passages after an edit: by id, deleted ones go, updated ones change tag, new ones come."""
    new_tag = updates.select("id", F.col("tag_id").alias("_tag"))
    kept = tagged.join(deletes.select("id"), "id", "left_anti").join(new_tag, "id", "left")
    return kept.withColumn("tag_id", F.coalesce("_tag", "tag_id")).drop("_tag").unionByName(inserts.select(*tagged.columns))


def tag_counts(tagged: DataFrame, tags: DataFrame) -> DataFrame:
    """How often each page carries each tag path."""
    paths = tag_paths(tags).select(F.col("id").alias("tag_id"), "path")
    return tagged.join(paths, "tag_id").groupBy("expression_id", "path").agg(F.count("*").alias("n"))


def tag_matrix(tagged: DataFrame, tags: DataFrame) -> DataFrame:
    """One column per tag path in use, in tree order; 0 where a page lacks the tag."""
    paths = tag_paths(tags).where("depth > 0 OR is_leaf").orderBy("parent_id", "sorting", "id").select("path").collect()  # the tag tree, kept by hand
    counts = tag_counts(tagged, tags)
    return counts.groupBy("expression_id").pivot("path", [r["path"] for r in paths]).sum("n").na.fill(0)


def tag_names(tagged: DataFrame, tags: DataFrame) -> DataFrame:
    """Per page, the names of its tags in order."""
    named = tagged.join(tags.select(F.col("id").alias("tag_id"), "name"), "tag_id")
    return named.groupBy("expression_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("tags"))


def tree_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """What turns one tree into another: insert, update or delete, tag by tag."""
    o = old.select("id", F.struct("parent_id", "name", "sorting").alias("before"))
    n = new.select("id", F.struct("parent_id", "name", "sorting").alias("after"))
    change = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").when(~F.col("before").eqNullSafe(F.col("after")), "update")
    return o.join(n, "id", "full_outer").select("id", change.alias("change"), "after.name", "after.sorting").where("change IS NOT NULL")


def _edited(tags: DataFrame) -> DataFrame:
    """An example edit: some tags go, some are renamed, one comes."""
    kept = tags.where("id % 10 <> 3").withColumn("name", F.when(F.col("id") % 10 == 5, F.concat("name", F.lit("2"))).otherwise(F.col("name")))
    return kept.union(tags.limit(0)).union(tags.sparkSession.sql("SELECT 900, 1, 'NEW', 0"))


def _example_edit(tagged: DataFrame) -> DataFrame:
    new = tagged.where("id % 17 = 0").withColumn("id", F.col("id") + 1_000_000_000)
    return edited_passages(tagged, new, tagged.where("id % 11 = 0").withColumn("tag_id", F.lit(103)), tagged.where("id % 13 = 0"))


T, G = V.TAGS, V.TAGGED
#: The tag paths of the generated tables, nations dealt to regions in turn.
NATION_PATHS = [f"{region}_NATION_{n}" for k, region in enumerate(["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]) for n in range(k, 25, 5)]
PATHS = """tree AS (
  SELECT id, parent_id, name, sorting, name AS path, 0 AS depth FROM tags WHERE parent_id IS NULL
  UNION ALL SELECT c.id, c.parent_id, c.name, c.sorting, p.path || '_' || c.name, p.depth + 1 FROM tree p JOIN tags c ON c.parent_id = p.id)"""
_REC = f"WITH RECURSIVE {T}, {G}, {PATHS}\n"
QUERIES = {
    "tag_paths": lambda s, d: tag_paths(V.tags(s, d)),
    "tag_counts": lambda s, d: tag_counts(V.tagged_content(s, d), V.tags(s, d)),
    "tag_matrix": lambda s, d: tag_matrix(V.tagged_content(s, d), V.tags(s, d)),
    "ordered_tags": lambda s, d: ordered_tags(V.tags(s, d)),
    "nested_tags": lambda s, d: nested_tree(V.tags(s, d)),
    "tag_descendants": lambda s, d: descendants(V.tags(s, d), 2),
    "edited_passages": lambda s, d: _example_edit(V.tagged_content(s, d)).select("id", "tag_id"),
    "tag_names": lambda s, d: tag_names(V.tagged_content(s, d), V.tags(s, d)),
    "tag_tree_changes": lambda s, d: tree_changes(V.tags(s, d), _edited(V.tags(s, d))),
}
ORACLES = {
    "tag_paths": _REC + "SELECT t.*, NOT EXISTS (SELECT 1 FROM tags c WHERE c.parent_id = t.id) AS is_leaf FROM tree t",
    "tag_counts": _REC + "SELECT g.expression_id, t.path, count(*) AS n FROM tagged g JOIN tree t ON t.id = g.tag_id GROUP BY 1, 2",
    "tag_matrix": _REC.rstrip() + ", used AS (SELECT g.expression_id, t.path FROM tagged g JOIN tree t ON t.id = g.tag_id) SELECT expression_id, " + ", ".join(f'count(*) FILTER (WHERE path = \'{p}\') AS "{p}"' for p in NATION_PATHS) + " FROM used GROUP BY 1",
    "ordered_tags": V.with_views(T) + "SELECT id, parent_id, name, sorting FROM tags ORDER BY parent_id ASC NULLS LAST, sorting, id",
    "nested_tags": V.with_views(T)
    + """, leaf AS (SELECT parent_id, sorting, id, '{"id":' || id || ',"name":"' || name || '","children":[]}' AS tree FROM tags WHERE parent_id IS NOT NULL)
    SELECT t.id, '{"id":' || t.id || ',"name":"' || t.name || '","children":[' || coalesce((SELECT string_agg(l.tree, ',' ORDER BY l.sorting, l.id) FROM leaf l WHERE l.parent_id = t.id), '') || ']}' AS tree FROM tags t WHERE parent_id IS NULL""",
    "tag_descendants": V.with_views(T) + "SELECT id, 1 AS distance FROM tags WHERE parent_id = 2",
    "edited_passages": V.with_views(G) + "SELECT id, CASE WHEN id % 11 = 0 THEN 103 ELSE tag_id END AS tag_id FROM tagged WHERE id % 13 <> 0 UNION ALL SELECT id + 1000000000, tag_id FROM tagged WHERE id % 17 = 0",
    "tag_names": V.with_views(T, G) + "SELECT g.expression_id, string_agg(DISTINCT t.name, ',' ORDER BY t.name) AS tags FROM tagged g JOIN tags t ON t.id = g.tag_id GROUP BY 1",
    "tag_tree_changes": V.with_views(T)
    + ", edited AS (SELECT id, parent_id, CASE WHEN id % 10 = 5 THEN name || '2' ELSE name END AS name, sorting FROM tags WHERE id % 10 <> 3 UNION ALL SELECT 900, 1, 'NEW', 0) "
    "SELECT * FROM (SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'insert' WHEN n.id IS NULL THEN 'delete' WHEN o.name <> n.name OR o.sorting <> n.sorting THEN 'update' END AS change, "
    "n.name, n.sorting FROM tags o FULL JOIN edited n ON o.id = n.id) WHERE change IS NOT NULL",
}
