"""Trees of groups and wells as tables (node, parent, kind): order, globs, pruning, regrouping.

The root's parent is null. Ancestors come by one join a level, so a tree costs its depth in jobs.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.plans.storage import written


def ancestors(tree: DataFrame, max_depth: int = 64) -> DataFrame:
    """node, ancestor and distance (1: the parent) of every pair; a cycle is an error."""
    up = tree.filter("parent IS NOT NULL").select(F.col("node").alias("ancestor"), F.col("parent").alias("__up"))
    level = written(tree.filter("parent IS NOT NULL").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")))
    levels = [level]
    while not level.isEmpty():
        if len(levels) > max_depth:
            raise ValueError(f"the tree is deeper than {max_depth} or has a cycle")
        level = written(level.join(up, "ancestor").select("node", F.col("__up").alias("ancestor"), (F.col("distance") + 1).alias("distance")))
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def paths(tree: DataFrame) -> DataFrame:
    """Every node with ``path`` (names from the root to it) and ``depth`` (0: a root)."""
    up = ancestors(tree).groupBy("node").agg(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "ancestor"))).alias("__a"))
    x = tree.join(up, "node", "left").withColumn("__a", F.coalesce("__a", F.array().cast(up.schema["__a"].dataType)))
    return x.withColumn("path", F.concat(F.transform("__a", lambda a: a["ancestor"]), F.array("node"))).withColumn("depth", F.size("__a")).drop("__a")


def traversal(tree: DataFrame) -> DataFrame:
    """``path`` with sort keys ``pre`` and ``post``: ordering by one gives each parent before, or after, its subtree; siblings go by name."""
    x = paths(tree)
    return x.withColumn("pre", F.col("path")).withColumn("post", F.concat("path", F.array(F.lit("\U0010ffff"))))


def rendered(tree: DataFrame) -> DataFrame:
    """A line of text for each node, indented by its depth; order by ``pre``."""
    return traversal(tree).select("node", "pre", F.concat(F.repeat(F.lit("    "), F.col("depth")), F.lit("+-- "), "node").alias("text"))


def glob(tree: DataFrame, pattern: str) -> DataFrame:
    """Nodes whose path below the root matches ``a/b*/?``; ``*`` and ``?`` stay within a name."""
    names = "/".join(re.escape(p).replace(r"\*", "[^/]*").replace(r"\?", "[^/]") for p in pattern.strip("/").split("/"))
    return paths(tree).filter(F.array_join(F.slice("path", 2, 1 << 20), "/").rlike(f"^{names}$")).select(*tree.columns)


def grouped(tree: DataFrame, names: Sequence[str], group: str, root: str) -> DataFrame:
    """The named nodes moved under a new group at the root; groups and wells can't be mixed."""
    hit = F.col("node").isin(*names)
    kinds = tree.filter(hit).agg(F.countDistinct("kind").alias("k"), F.count("*").alias("n")).first()
    if kinds["k"] > 1:
        raise ValueError("a new group takes groups or wells, not both")
    if kinds["n"] < len(set(names)):
        raise KeyError("a named node isn't in the tree")
    new = tree.sparkSession.createDataFrame([(group, root, "group")], "node string, parent string, kind string")
    return tree.withColumn("parent", F.when(hit, group).otherwise(F.col("parent"))).unionByName(new, allowMissingColumns=True)


def dropped(tree: DataFrame, names: Sequence[str]) -> DataFrame:
    """The tree without the named nodes and all below them; names that aren't there are passed over."""
    below = ancestors(tree).filter(F.col("ancestor").isin(*names)).select("node").distinct()
    return tree.filter(~F.col("node").isin(*names)).join(below, "node", "left_anti").select(*tree.columns)


def without_empty_groups(tree: DataFrame) -> DataFrame:
    """The tree without groups that have no well below them."""
    wells = tree.filter("kind <> 'group'").select("node")
    full = ancestors(tree).join(wells, "node", "left_semi").select(F.col("ancestor").alias("node")).distinct()
    return tree.filter("kind <> 'group'").unionByName(tree.filter("kind = 'group'").join(full, "node", "left_semi").select(*tree.columns))


def complete_wells(tree: DataFrame, attributes: DataFrame, required: Sequence[str], instead: Sequence[str] = ("COMPDAT", "COMPDATL")) -> DataFrame:
    """The tree without wells that lack a required attribute (rows: node, attribute) and have none of ``instead``; what hangs below goes too."""
    seen = attributes.filter(F.col("attribute").isin(*required, *instead)).groupBy("node").agg(F.collect_set("attribute").alias("a"))
    ok = F.forall(F.array(*[F.lit(r) for r in required]), lambda r: F.array_contains("a", r)) | F.arrays_overlap("a", F.array(*[F.lit(r) for r in instead]))
    poor = tree.filter("kind = 'well'").join(seen.filter(ok), "node", "left_anti").select("node")
    below = ancestors(tree).join(poor.withColumnRenamed("node", "ancestor"), "ancestor", "left_semi").select("node")
    return tree.join(poor.unionByName(below).distinct(), "node", "left_anti").select(*tree.columns)


def inside_wells(tree: DataFrame, blocks: DataFrame, keep_ancestors: bool = False) -> DataFrame:
    """The tree without wells that have no blocks (rows: node).

    Their children hang on the nearest node left above; with ``keep_ancestors`` a well stays while
    one below it has blocks.
    """
    has = blocks.select("node").distinct()
    up = written(ancestors(tree))
    stays = tree.filter("kind <> 'well'").select("node").unionByName(tree.filter("kind = 'well'").select("node").join(has, "node", "left_semi"))
    if keep_ancestors:
        stays = stays.unionByName(up.join(has, "node", "left_semi").select(F.col("ancestor").alias("node"))).distinct()
        return tree.join(stays, "node", "left_semi").select(*tree.columns)
    near = up.join(stays.withColumnRenamed("node", "ancestor"), "ancestor", "left_semi").groupBy("node").agg(F.min_by("ancestor", "distance").alias("parent"))
    return tree.join(stays, "node", "left_semi").drop("parent").join(near, "node", "left").select(*tree.columns)
