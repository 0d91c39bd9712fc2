"""Connected components of an edge table, without gathering links or labels on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def label(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Component labels of 0..n-1 for edges (i, j): the smallest member."""
    at = np.arange(n)
    while True:
        low = np.minimum(at[i], at[j])
        before = at.copy()
        np.minimum.at(at, i, low)
        np.minimum.at(at, j, low)
        at = at[at]
        if (at == before).all():
            return at


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id that occurs in an edge; component is the smallest id reachable.

    Alternating large-star and small-star rounds: each replaces edges by edges to the smallest neighbour, so the
    table never outgrows the input and a hub's neighbours are aggregated with partial minima. Every round is
    checkpointed in the shared folder. Edges with a null end are ignored; loops and repeats do no harm.
    An empty table gives an empty result.
    """
    now = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )
    now = checkpointed(now)
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        large = large.where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u != v")
            .distinct()
        )
        now = checkpointed(small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = now.groupBy("v").agg(F.lit(1)).select(F.col("v").alias("id"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
