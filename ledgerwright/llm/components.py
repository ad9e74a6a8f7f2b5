"""Connected components of a graph that is spread over the cluster."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwright.llm.common import map_columns, stored

#: So few edges are joined up in one task; more are contracted by turns over the cluster first.
FEW_EDGES = 10_000


def _joined_up(batches: Iterator[dict]) -> Iterator[dict]:
    """from, to: each end of the edges and the smallest end it is connected with."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for columns in batches:
        for a, b in zip(columns["a"], columns["b"]):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    yield {"from": list(parent), "to": [find(x) for x in list(parent)]}


def _moved(df: DataFrame, column: str, moves: DataFrame) -> DataFrame:
    to = F.coalesce("to", column).alias(column)
    return df.join(moves, F.col(column) == F.col("from"), "left").select(*[to if c == column else c for c in df.columns])


def merge(roots: DataFrame, links: DataFrame) -> DataFrame:
    """`roots` (node, root) after connecting the ends of `links` (a, b).

    Nodes are connected if their roots agree. In each turn every root that has a neighbour
    with a smaller hash joins the one with the smallest, and the edges are rewritten to
    roots; a constant share of the roots goes in each turn, whatever the ids, as the hash
    changes. A hot root's edges are combined before the shuffle. Links whose ends are null
    or no nodes are ignored.
    """
    ends = links.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    for end in ("a", "b"):
        ends = ends.join(roots.withColumnsRenamed({"node": end, "root": f"r{end}"}), end)
    edges = stored(ends.where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
    turn = 0
    while (n := edges.count()) > 0:
        if n <= FEW_EDGES:
            return stored(_moved(roots, "root", map_columns(edges.coalesce(1), _joined_up, "from bigint, to bigint")), "roots")
        order = lambda c: F.xxhash64(F.col(c), F.lit(turn))
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = stored(
            both.groupBy("a").agg(F.min(F.struct(order("b").alias("h"), "b")).alias("m"))
            .where(F.col("m.h") < order("a")).select(F.col("a").alias("from"), F.col("m.b").alias("to")),
            "hooks",
        )
        edges = stored(_moved(_moved(edges, "a", hooks), "b", hooks).where("a <> b").distinct(), "edges")
        roots = stored(_moved(roots, "root", hooks), "roots")
        turn += 1
    return roots
