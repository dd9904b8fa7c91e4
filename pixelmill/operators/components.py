"""Connected components of many small graphs at once.

Alternating large-star and small-star rounds: each round links every vertex closer
to the smallest vertex it can see, and the edge list shrinks until every vertex
points at the smallest one of its component. The number of rounds is logarithmic
in practice. Minima are combined map-side, and the joins have one row per vertex on
one side, so adaptive execution can split a hub's edges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.session import cut_lineage


def _fingerprint(e: DataFrame):
    row = e.agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*e.columns)).alias("h")
    ).first()
    return row["n"], row["h"]


def components(
    vertices: DataFrame, edges: DataFrame, by: Sequence[str], node: str = "node"
) -> DataFrame:
    """(by.., node, component): component is the smallest node it contains.

    ``edges`` is (by.., a, b); both ends have to be in ``vertices``.
    """
    by = list(by)
    links = cut_lineage(
        edges.select(*by, F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .filter(F.col("hi") != F.col("lo"))
        .distinct()
    )
    seen = _fingerprint(links)
    while seen[0]:
        # large star: bigger neighbours of u move to the smallest vertex u can see
        ends = F.array(
            F.struct(F.col("hi").alias("u"), F.col("lo").alias("v")),
            F.struct(F.col("lo").alias("u"), F.col("hi").alias("v")),
        )
        both = links.select(*by, F.inline(ends))
        low = both.groupBy(*by, "u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = (
            both.join(low, [*by, "u"])
            .filter(F.col("v") > F.col("u"))
            .select(*by, F.col("v").alias("hi"), F.col("m").alias("lo"))
            .distinct()
        )
        # small star: u and its smaller neighbours move to the smallest of them
        low = large.groupBy(*by, "hi").agg(F.min("lo").alias("m"))
        moved = F.array(
            F.struct(F.col("hi"), F.col("m").alias("lo")),
            F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")),
        )
        links = cut_lineage(
            large.join(low, [*by, "hi"])
            .select(*by, F.inline(moved))
            .filter(F.col("hi") != F.col("lo"))
            .distinct()
        )
        now = _fingerprint(links)
        if now == seen:
            break
        seen = now
    roots = links.select(*by, F.col("hi").alias(node), F.col("lo").alias("_root"))
    out = vertices.select(*by, node).join(roots, [*by, node], "left")
    return out.select(*by, node, F.coalesce("_root", node).alias("component"))
