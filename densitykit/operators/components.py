"""Connected components (D4) as a DataFrame loop on the executors.

Edge contraction in label space: each round every label hooks to the smallest label among
itself and its neighbours, the hook chains are flattened by pointer jumping, and the edges
are rewritten to ``(hook(src), hook(dst))`` with self loops and duplicates removed. Merged
labels leave the edge table, so a long chain shrinks geometrically instead of one hop per
round. The loop stops when no edge is left, or few enough (``SMALL``, counted) for one task to finish by union-find; a vertex's label is then its chain of hooks
``h_R(..h_1(v))``, applied once at the end as a join per round (the vertex table is written
once, not once per round). Each label is the smallest vertex id of its component.

Every intermediate table is written to the shared checkpoint storage (``materialize``), so
lineage stays one step deep and a lost executor costs at most one step. The driver sees one
count per step, observed while the table is written.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densitykit.session import materialize

log = logging.getLogger(__name__)

#: Edges that one task may finish (some 100 MB there); more go through another round.
SMALL = 200_000


class ComponentsResult:
    def __init__(self, labels: DataFrame, rounds: int):
        self.labels = labels
        self.rounds = rounds


def _both_ways(e: DataFrame) -> DataFrame:
    return e.select(F.explode(F.array(F.struct(F.col("src").alias("s"), F.col("dst").alias("d")),
                                      F.struct(F.col("dst").alias("s"), F.col("src").alias("d")))).alias("e")) \
        .select(F.col("e.s").alias("src"), F.col("e.d").alias("dst"))


def _compose(h: DataFrame) -> DataFrame:
    """``l -> m`` composed with itself: ``l -> h(m)``."""
    return h.join(h.select(F.col("l").alias("m"), F.col("m").alias("mm")), "m", "left") \
        .select("l", F.coalesce(F.col("mm"), F.col("m")).alias("m"))


def _finish_small(edges: DataFrame) -> DataFrame:
    """``l -> m`` for the ends of at most ``SMALL`` edges: m is the smallest end reachable."""
    def least(batches):
        import pyarrow as pa

        up, kind = {}, None

        def find(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        def plain(col):  # ids may be structs; tuples compare as Spark compares them
            return [tuple(v.values()) if isinstance(v, dict) else v for v in col.to_pylist()]

        for b in batches:
            kind = b.schema.field(0).type
            for x, y in zip(plain(b.column(0)), plain(b.column(1))):
                up.setdefault(x, x)
                up.setdefault(y, y)
                x, y = find(x), find(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
        if up:
            def typed(vals):
                return pa.array([dict(zip([f.name for f in kind], v)) if pa.types.is_struct(kind) else v for v in vals], kind)

            yield pa.RecordBatch.from_arrays([typed(list(up)), typed([find(x) for x in up])], ["l", "m"])

    kind = edges.schema["src"].dataType.simpleString()
    return edges.coalesce(1).mapInArrow(least, f"l {kind}, m {kind}")


def _flatten(hook: DataFrame, max_jumps: int) -> DataFrame:
    """Pointer jumping on the hook table ``l -> m`` until every label points at the root of
    its hook tree. One job builds ``h4 = (h o h) o (h o h)`` and ``h8 = h4 o h4`` from the
    written table and counts the labels where they differ: none means ``h4`` is already
    flat. A chain of length L needs about log8(L) jobs; each is a join on the hook table,
    which is no larger than the edge table."""
    for _ in range(max_jumps):
        h4 = _compose(_compose(hook))
        h8 = h4.join(h4.select(F.col("l").alias("m"), F.col("m").alias("mm")), "m", "left") \
            .select("l", F.coalesce(F.col("mm"), F.col("m")).alias("m"),
                    (F.col("mm").isNotNull() & (F.col("mm") != F.col("m"))).alias("moved"))
        nxt, st = materialize(h8, "cc-jump", changed=F.count_if(F.col("moved")))
        hook = nxt.select("l", "m")
        if st["changed"] == 0:
            return hook
    raise RuntimeError("pointer jumping did not converge")


def connected_components(vertices: DataFrame, edges: DataFrame, max_rounds: int = 100,
                         vertex: str = "node", src: str = "src", dst: str = "dst") -> ComponentsResult:
    """``vertices(node)``, ``edges(src, dst)`` (any direction, duplicates allowed) ->
    ``labels(node, label)`` with label = min node id of the component.

    Raises if edges remain after ``max_rounds`` rounds.
    """
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src <> dst")
    # one row per undirected edge, smaller id first
    e, st = materialize(e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
                        .distinct(), "cc-edges", n=F.count(F.lit(1)))
    remaining = st["n"]
    hooks: list[DataFrame] = []
    rounds = 0
    while remaining > 0:
        rounds += 1
        if rounds > max_rounds:
            raise RuntimeError(f"connected components did not converge in {max_rounds} rounds")
        if remaining <= SMALL:
            hooks.append(materialize(_finish_small(e), "cc-small").where("l <> m"))
            break
        # hook every label with an edge to its smallest neighbour (or itself)
        hook = _both_ways(e).groupBy(F.col("src").alias("l")).agg(F.min("dst").alias("m")) \
            .select("l", F.least(F.col("l"), F.col("m")).alias("m"))
        hook = _flatten(materialize(hook, "cc-hook"), max_rounds)
        hooks.append(hook.where("l <> m"))
        hs = hook.select(F.col("l").alias("src"), F.col("m").alias("ms"))
        hd = hook.select(F.col("l").alias("dst"), F.col("m").alias("md"))
        e, st = materialize(e.join(hs, "src").join(hd, "dst")
                            .select(F.least("ms", "md").alias("src"), F.greatest("ms", "md").alias("dst"))
                            .where("src <> dst").distinct(), "cc-edges", n=F.count(F.lit(1)))
        remaining = st["n"]
        log.info("components round %d: %d edges left", rounds, remaining)
    labels = vertices.select(F.col(vertex).alias("node")).distinct().withColumn("label", F.col("node"))
    for h in hooks:
        labels = labels.join(h.withColumnRenamed("l", "label"), "label", "left") \
            .select("node", F.coalesce(F.col("m"), F.col("label")).alias("label"))
    if hooks:
        labels = materialize(labels, "cc-labels")
    return ComponentsResult(labels, rounds)
