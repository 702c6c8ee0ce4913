"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probegrid.llm.common import stored

#: Edges that a task reduces at first, about.
EDGES = 200_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, smallest node that this task's edges reach), for all nodes but those smallest ones."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    rows = [(x, root(x)) for x in parent if parent[x] != x]
    table = np.asarray(rows, dtype=np.int64).reshape(-1, 2)
    for at in range(0, len(table), 100_000):
        part = table[at:at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], names=["u", "v"])


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on edges u > v. Both use minima, so a node of any degree is combined early."""
    least = edges.union(edges.select("v", "u")).groupBy(F.col("u").alias("x")).agg(F.min("v").alias("near"))
    least = least.select("x", F.least("x", "near").alias("m"))
    large = edges.join(least, edges.v == least.x).select("u", F.col("m").alias("v")).distinct()
    low = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
    moved = large.join(low, large.u == low.x).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the smallest node that each node of an edge reaches. Edges are two columns of long.

    A task reduces ``EDGES`` edges to a forest; up to so many need one task and no more.
    Else star steps join the forests of the tasks until nothing changes. Each step is
    written to the shared folder.
    """
    a, b = edges.columns
    plain = stored(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")), "edges")
    tasks = -(-plain.count() // EDGES)
    now, before = stored(plain.coalesce(max(1, tasks)).mapInArrow(_forest, "u long, v long"), "components"), None
    while tasks > 1:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if seen == before or not seen.n:
            break
        before = seen
        now = stored(_round(now).mapInArrow(_forest, "u long, v long").distinct(), "components")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
