"""Connected components of an edge list.

Up to ONE_TASK edges (some 10 MB) are joined by union-find in one executor task, after a count shows that there
are no more; larger lists go through alternating large-star and small-star rounds on written tables. Both give
the same result."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from bitweft.session import Workspace


ONE_TASK = 500_000


def _union_find(edges: DataFrame) -> DataFrame:
    """id, comp of a list of at most ONE_TASK edges."""

    kind = to_arrow_type(edges.schema["u"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}

        def find(x):
            while (r := root.setdefault(x, x)) != x:
                root[x] = root[r]
                x = root[x]
            return x

        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
                a, b = find(u), find(v)
                root[max(a, b)] = min(a, b)
        yield pa.record_batch({"id": pa.array(list(root), kind), "comp": pa.array([find(x) for x in root], kind)})

    name = edges.schema["u"].dataType.simpleString()
    return edges.coalesce(1).mapInArrow(run, f"id {name}, comp {name}")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.select(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(ws: Workspace, edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """For edges(u, v): id, comp of every node, comp being the smallest node reachable; a written table.

    Each round meets neighbours through a grouped minimum (combined before the shuffle) and a join, so no
    node's neighbours are gathered in one place."""
    edges = edges.where("u <> v")
    if edges.limit(one_task + 1).count() <= one_task:
        return ws.put(_union_find(edges), "comps")
    e = ws.put(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _state(e)
    while before[0]:
        # large star: larger neighbours go to the smallest node of each neighbourhood
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = ws.put(large, "large")
        # small star: smaller neighbours and the node itself go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = ws.put(small, "edges")
        ws.drop(large, e)
        e, after = new, _state(new)
        if after == before:
            break
        before = after
    out = e.select(F.col("u").alias("id"), F.col("v").alias("comp"))
    return ws.put(out.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct()), "comps")
