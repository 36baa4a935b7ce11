"""Connected components of a graph of links, by contraction in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import cut_short

#: Links of a contracted graph, at most, that one task finishes. What has more is contracted further.
FEW = 20_000


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of the nodes of all links of a task, the root being the least node."""
    lead: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while lead.setdefault(top, top) != top:
            top = lead[top]
        while lead[x] != top:
            lead[x], x = top, lead[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = find(a), find(b)
            lead[max(x, y)] = min(x, y)
    nodes = list(lead)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(n) for n in nodes], pa.int64())], names=["node", "to"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """A row (node, root) for each node with a link; nodes of one component share the root, one of them.

    Each round draws a fresh order of the nodes by hash, leads every node to the least of itself and its neighbours, and from there once more in the same way, and
    contracts the links; most nodes vanish each time, chains and stars alike. When FEW links or fewer are left, one task finishes. Every step is a join or a sum on the
    node, and is written to the shared checkpoint folder, so nothing depends on one executor.
    """
    edges = cut_short(links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").distinct())
    root, salt = None, 0
    while (left := edges.count()) > 0:
        if left <= FEW:
            leads = cut_short(edges.coalesce(1).mapInArrow(_finish, "node long, to long"))
        else:
            salt += 1
            both = edges.union(edges.select("b", "a"))
            rank = lambda c: F.struct(F.xxhash64(F.lit(salt), c).alias("rank"), F.col(c).alias("node"))  # noqa: B023, E731
            leads = cut_short(both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("least")).select("node", F.least(rank("node"), "least")["node"].alias("to")))
            leads = cut_short(leads.join(leads.select(F.col("node").alias("to"), F.col("to").alias("then")), "to").select("node", F.col("then").alias("to")))
        if root is None:
            root = leads.select("node", F.col("to").alias("root"))
        else:
            root = cut_short(root.join(leads.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        if left <= FEW:
            break
        on = lambda c: leads.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))  # noqa: B023, E731
        new = edges.join(on("a"), "a").join(on("b"), "b").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
        edges = cut_short(new.where("a <> b").distinct())
    return root if root is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
