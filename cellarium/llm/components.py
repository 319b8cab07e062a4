"""Connected components of a graph given as a DataFrame of edges, by alternating star contractions.

Edges are contracted within tasks of PART_EDGES at most first; where that takes one task, it is all. Otherwise every
round is two groupings and is written to the shared folder; no task or driver ever holds more. A hub's edges are joined,
not gathered, so a skewed join splits them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarium.llm.common import bound_batches, materialize

#: Edges that a task contracts in memory.
PART_EDGES = 200_000


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each node of the task's edges but the least it reaches, an edge to that one."""
    parent: dict = {}
    schema = None

    def find(x):
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    for batch in batches:
        schema = batch.schema
        for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    for at in range(0, len(nodes), 10_000):
        some = nodes[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, schema.field("u").type), pa.array([find(n) for n in some], schema.field("v").type)], ["u", "v"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction. edges: u > v. Large: larger neighbours of a node go to its least neighbour; small: smaller ones."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    near = both.join(least, "u")
    if large:
        out = near.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, part_edges: int = PART_EDGES) -> DataFrame:
    """(node, component) for each node of an edge; component is its least reachable node. edges: u, v; loops, nulls and repeats do no harm."""
    bound_batches(edges.sparkSession)
    now = materialize(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    parts = 1 + now.count() // part_edges
    now = materialize(now.repartition(parts).mapInArrow(_contracted, now.schema), "edges")
    seen = None
    while parts > 1 and (mark := now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()) != seen:
        seen = mark
        now = materialize(_star(_star(now, large=True), large=False), "edges")
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
