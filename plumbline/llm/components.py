"""Connected components of links, as joins and minima that no large star overloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.frames import kept


def _star(links: DataFrame, wide: bool) -> DataFrame:
    """One step of large-star (``wide``) or small-star on links ``a > b``.

    The minimum of a node's neighbours combines before the shuffle; joining it back
    has the small side unique, so a hub's links can be split over tasks.
    """
    sides = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if wide else links
    least = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = sides.join(least, "a")
    if wide:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return moved.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component_id`` (the smallest reachable id) for each node that has a link.

    ``links`` has two columns of ids in any order; loops and repeats do no harm, and
    links with a null end are left out.  Large-star and small-star steps alternate until
    nothing changes, which takes a number of rounds logarithmic in the longest path.
    Every round is a written table.
    """
    a, b = links.columns
    now = kept(
        links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .distinct(),
        "links",
    )
    before = None
    while True:
        state = now.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if state == before or not state[0]:
            break
        before = state
        now = kept(_star(_star(now, True), False), "stars")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component_id"))
    centres = now.select(F.col("b").alias("node"), F.col("b").alias("component_id")).distinct()
    return nodes.unionByName(centres)
