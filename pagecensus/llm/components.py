"""Connected components of a table of links, by repeated contraction to stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecensus.llm.common import stage


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.expr("CAST(xxhash64(u, v) AS DECIMAL(38,0))"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (``u, v``): the smallest node it can reach.

    Each round hangs neighbours on the smallest node they know, first the larger ones, then the smaller
    ones, until nothing changes. A round moves narrow rows only; a node with very many links is a skewed
    key of a join, which Spark splits. Every round is written to the shared folder and read again. Loops
    and repeated links do no harm; links with a null end are left out.
    """
    links = links.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    links = stage(links.selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct(), "links")
    state = _state(links)
    while state[0]:
        both = links.union(links.selectExpr("v", "u"))
        least = both.groupBy("u").agg(F.expr("least(u, min(v)) AS least"))
        large = both.join(least, "u").where("v > u").selectExpr("v AS u", "least AS v")
        large = large.where("u <> v").distinct()
        below = large.groupBy("u").agg(F.min("v").alias("least"))
        small = large.join(below, "u").selectExpr("explode(array(struct(v AS u, least AS v), struct(u, least AS v))) AS link")
        links = stage(small.select("link.u", "link.v").where("u <> v").distinct(), "links")
        before, state = state, _state(links)
        if state == before:
            break
    stars = links.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    centres = links.selectExpr("v AS node", "v AS component").distinct()
    return stars.union(centres.join(stars.select("node"), "node", "left_anti"))
