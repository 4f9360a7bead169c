"""Neighbour counts and links of a point table through a hierarchy of cells (D1, D2, D5 for dense regions).

Points are grouped into *cells* so small that all points of one are neighbours, each with its count and its bounding box.
Pairs of cells, not of points, are compared first: a pair whose greatest distance is within eps counts (or links) whole, a
pair whose least distance exceeds eps is dropped, and only the rest is looked at closer: point by point if
the product of the two counts is at most ``LEAF``, otherwise by the pairs of their half-size subcells, a level at a time.

Distances between boxes are computed from the ends of the axes with the same operations as those between points;
rounding is monotone, so what a box decides is what every point test in it would say.

For a threshold (``min_samples``) a cell of that many points needs no comparison at all, and two nodes of
the core graph are linked by the first pair of points found within eps. So the comparisons of a hot region grow with its
cells and their borders, not with the square of its points.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densitykit.operators.neighbors import _dealt, _offsets, pair_tasks, within_diffs
from densitykit.session import materialize

#: Pairs of points that two cells may have to be compared point by point.
LEAF = 1 << 14
#: Pairs of points from which two cells are compared for counts as arrays, and the points of an array, about.
PACK, PIECE = 1 << 9, 1 << 9
#: Halvings after which what is left is compared in any case (cells of 2^-40 of a cell hold points that are as good as equal).
LEVELS = 40


def halvings(k: int, metric: str) -> int:
    """How often a cell of side eps is halved until its points are all within eps of each other."""
    span = {"euclidean": math.sqrt(k), "manhattan": float(k), "chebyshev": 1.0}[metric]
    return int(math.floor(math.log2(span) + 1e-12)) + 1


def near_boxes(a: str, b: str, k: int, eps: float, metric: str) -> Column:
    """Whether the least distance between the boxes ``{a}lo0, {a}hi0, ..`` and ``{b}..`` is within eps."""
    gaps = [F.greatest(F.lit(0.0), F.col(f"{b}lo{i}") - F.col(f"{a}hi{i}"), F.col(f"{a}lo{i}") - F.col(f"{b}hi{i}")) for i in range(k)]
    return within_diffs(gaps, eps, metric)


def whole_boxes(a: str, b: str, k: int, eps: float, metric: str) -> Column:
    """Whether the greatest distance between them is within eps."""
    far = [F.greatest(F.col(f"{a}hi{i}") - F.col(f"{b}lo{i}"), F.col(f"{b}hi{i}") - F.col(f"{a}lo{i}")) for i in range(k)]
    return within_diffs(far, eps, metric)


def near_reps(a: str, b: str, k: int, eps: float, metric: str) -> Column:
    """Whether one chosen point of each (``{a}rep`` struct) are within eps."""
    return within_diffs([F.col(f"{a}rep.x{i}") - F.col(f"{b}rep.x{i}") for i in range(k)], eps, metric)


def box_aggs(k: int) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *[F.min(f"x{i}").alias(f"lo{i}") for i in range(k)], *[F.max(f"x{i}").alias(f"hi{i}") for i in range(k)]]


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def open_aggs(open_: Column, all_small: Column | None = None) -> dict[str, Column]:
    """Of the pairs that are open: how many are small and large, and the pairs of points in the small ones."""
    product = F.col("a_n") * F.col("b_n")
    small = product <= LEAF if all_small is None else (product <= LEAF) | all_small
    return {"small": F.count_if(open_ & small), "large": F.count_if(open_ & ~small), "points": F.sum(F.when(open_ & small, product))}


@dataclass
class Grid:
    """Cells of a point table: side, origin, and what a cell must have in common besides its place (``keys``)."""

    k: int
    eps: float
    metric: str
    side: float
    origin: Sequence[float]
    keys: Sequence[str] = ()
    kd: object = None
    #: Pairs compared, of cells and of points.
    compared: dict = field(default_factory=lambda: {"cells": 0, "points": 0, "levels": 0})

    def __post_init__(self):
        self.halved = halvings(self.k, self.metric)
        self.fine = self.side / 2 ** self.halved

    def place(self, side: float) -> list[Column]:
        return [F.floor((F.col(f"x{i}") - F.lit(float(self.origin[i]))) / F.lit(side)).cast("long") for i in range(self.k)]

    def with_cells(self, points: DataFrame) -> DataFrame:
        """Adds ``cell``: keys and place."""
        keys = [F.col(c) for c in (*self.keys, *(["part"] if self.kd is not None else []))]
        return points.withColumn("cell", F.struct(*keys, *[c.alias(f"f{i}") for i, c in enumerate(self.place(self.fine))]))

    def cells(self, points: DataFrame) -> DataFrame:
        """``cell, n, lo.., hi.., clique``: clique if all its points are within eps of each other."""
        return points.groupBy("cell").agg(*box_aggs(self.k)).withColumn("clique", whole_boxes("", "", self.k, self.eps, self.metric))

    def pairs(self, cells: DataFrame) -> DataFrame:
        """All unordered pairs of cells (a cell with itself too) whose boxes are within eps, as ``a_``, ``b_`` columns."""
        k, own = self.k, [f"cell.{c}" for c in self.keys]
        keys = [f"_k{i}" for i in range(len(own))]
        named = cells.select("*", *[F.col(c).alias(n) for c, n in zip(own, keys)])
        if self.kd is None:
            place = [f"_c{i}" for i in range(k)]
            named = named.withColumns({p: F.shiftright(F.col(f"cell.f{i}"), self.halved) for i, p in enumerate(place)})
            steps = F.array(*[F.struct(*[F.lit(v).alias(f"d{i}") for i, v in enumerate(o)]) for o in _offsets(k, half=True)])
            left = prefixed(named, "a_").withColumnsRenamed({f"a_{c}": c for c in (*keys, *place)})
            right = prefixed(named, "b_").withColumn("_o", F.explode(steps)).withColumns({p: F.col(f"b_{p}") - F.col(f"_o.d{i}") for i, p in enumerate(place)}) \
                .withColumnsRenamed({f"b_{c}": c for c in keys}).withColumn("_same", F.forall(F.array(*[F.col(f"_o.d{i}") for i in range(k)]), lambda d: d == 0)).drop("_o")
            once = ~F.col("_same") | (F.col("a_cell") <= F.col("b_cell"))
        else:
            place = ["part"]
            copies = self.kd.halo_boxes(named, [f"lo{i}" for i in range(k)], [f"hi{i}" for i in range(k)], self.eps)
            left = prefixed(named.withColumn("part", F.col("cell.part")), "a_").withColumnsRenamed({f"a_{c}": c for c in (*keys, *place)})
            right = prefixed(copies, "b_").withColumnsRenamed({f"b_{c}": c for c in (*keys, *place)})
            once = F.col("a_cell") <= F.col("b_cell")
        both = left.join(right, [*keys, *place]).where(once & near_boxes("a_", "b_", k, self.eps, self.metric))
        own = ["cell", "n", "clique", *[f"{e}{i}" for e in ("lo", "hi") for i in range(k)]]
        return both.select(*[f"a_{c}" for c in own], *[f"b_{c}" for c in own]).withColumn("whole", whole_boxes("a_", "b_", k, self.eps, self.metric))

    # ---- counts

    def counts(self, points: DataFrame, pairs: DataFrame, min_samples: int | None, known: dict | None = None) -> tuple[DataFrame, DataFrame | None]:
        """``cell, whole_n`` (neighbours that whole cells give to each point of a cell) and ``id, more_n`` (what single
        points add; None if there are none). With ``min_samples``, cells that have it by themselves get no count.
        ``known`` has what ``open_aggs`` says of the pairs that boxes leave open and that matter."""
        enough = (lambda s: F.col(f"{s}clique") & (F.col(f"{s}n") >= min_samples)) if min_samples is not None else (lambda s: F.lit(False))
        p = pairs.select("a_cell", "b_cell", "a_n", "b_n", "whole", (~enough("a_")).alias("to_a"),
                         ((F.col("a_cell") != F.col("b_cell")) & ~enough("b_")).alias("to_b")).where("to_a or to_b")
        whole = p.where("whole").select(F.explode(F.filter(F.array(
            F.when(F.col("to_a"), F.struct(F.col("a_cell").alias("cell"), F.col("b_n").alias("n"))),
            F.when(F.col("to_b"), F.struct(F.col("b_cell").alias("cell"), F.col("a_n").alias("n")))), lambda s: s.isNotNull())).alias("s")) \
            .groupBy("s.cell").agg(F.sum("s.n").alias("whole_n"))
        if known is not None and not (known["small"] or known["large"]):
            return whole, None
        own = points.select(F.col("cell").alias("root"), "id", *[f"x{i}" for i in range(self.k)])
        open_ = p.where("not whole").select(F.col("a_cell").alias("a_root"), F.col("b_cell").alias("b_root"), "a_n", "b_n", "to_a", "to_b")
        some = []
        self._descend(open_, own, own, some.append, ["to_a", "to_b"], True, known)
        if not some:
            return whole, None
        more = some[0]
        for s in some[1:]:
            more = more.unionByName(s)
        return whole, more.groupBy("id").agg(F.sum("n").alias("more_n"))

    # ---- links

    def links(self, open_: DataFrame, left: DataFrame, right: DataFrame, known: dict | None = None) -> DataFrame | None:
        """Of the open pairs ``a_root, b_root, a_n, b_n`` those with points ``root, id, x0..`` of ``left`` and ``right``
        within eps: ``a_root, b_root`` (None if there are no open pairs)."""
        some = []
        self._descend(open_, left, right, some.append, [], False, known)
        out = None
        for s in some:
            out = s if out is None else out.unionByName(s)
        return out

    # ---- the descent

    def _descend(self, open_: DataFrame, left: DataFrame, right: DataFrame, emit, flags: list[str], counts: bool, known: dict | None) -> None:
        """Small pairs of ``open_`` are compared point by point, large ones by their subcells."""
        k, axes = self.k, [f"x{i}" for i in range(self.k)]
        root = ["a_root", "b_root"]
        small = F.col("a_n") * F.col("b_n") <= LEAF
        none = F.array().cast("array<bigint>")
        here, st = open_.withColumns({"a_at": none, "b_at": none}), known
        if st is None:
            here, st = materialize(here, "cells-open", **open_aggs(F.lit(True)))
        side, level = self.fine, 0
        a_pts, b_pts = left.withColumn("at", none), right.withColumn("at", none)
        while True:
            self.compared["points"] += st["points"] or 0
            if st["small"]:
                emit(self._compare(here.where(small), a_pts, b_pts, flags, counts))
            if not st["large"]:
                return
            side, level = side / 2, level + 1
            self.compared["levels"] = max(self.compared["levels"], level)
            large = here.where(~small)
            at = F.array(*[F.floor((F.col(c) - F.lit(float(self.origin[i]))) / F.lit(side)).cast("long") for i, c in enumerate(axes)])
            subs, pts = [], []
            for s, src in (("a", a_pts), ("b", b_pts)):
                mine = large.select(F.col(f"{s}_root").alias("root"), F.col(f"{s}_at").alias("at")).distinct()
                p = src.join(mine, ["root", "at"], "left_semi").withColumnRenamed("at", "up").withColumn("at", at)
                pts.append(materialize(p, "cells-points"))
                sub = pts[-1].groupBy("root", "up", "at").agg(*box_aggs(k), F.min_by(F.struct(*axes), "id").alias("rep"))
                subs.append(prefixed(sub, f"{s}_"))
            down = large.select(*root, *flags, F.col("a_at").alias("a_up"), F.col("b_at").alias("b_up")) \
                .join(subs[0], ["a_root", "a_up"]).join(subs[1], ["b_root", "b_up"]).where(near_boxes("a_", "b_", k, self.eps, self.metric)) \
                .withColumn("whole", whole_boxes("a_", "b_", k, self.eps, self.metric))
            if not counts:
                down = down.withColumn("whole", F.col("whole") | near_reps("a_", "b_", k, self.eps, self.metric))
            small = (F.col("a_n") * F.col("b_n") <= LEAF) if level < LEVELS else F.lit(True)
            still = ~F.col("whole")
            tested, st = materialize(down.select(*root, *flags, "a_at", "b_at", "a_n", "b_n", "whole"), "cells-level", pairs=F.count(F.lit(1)),
                                     whole=F.count_if(F.col("whole")), open=F.count_if(still))
            self.compared["cells"] += st["pairs"]
            a_pts, b_pts = (p.select("root", "at", "id", *axes) for p in pts)
            if counts:
                if st["whole"]:
                    emit(self._whole_counts(tested.where("whole"), a_pts, b_pts))
                here = tested.where(still)
            else:
                found = tested.where("whole").select(*root).distinct()
                if st["whole"]:
                    found = materialize(found, "cells-found")
                    emit(found)
                    here = tested.where(still).join(found, root, "left_anti")
                else:
                    here = tested
            here, st = materialize(here.select(*root, *flags, "a_at", "b_at", "a_n", "b_n"), "cells-open", **open_aggs(F.lit(True), F.lit(level >= LEVELS)))

    def _whole_counts(self, whole: DataFrame, a_pts: DataFrame, b_pts: DataFrame) -> DataFrame:
        out = None
        for s, o, src in (("a", "b", a_pts), ("b", "a", b_pts)):
            adds = whole.where(f"to_{s}").groupBy(F.col(f"{s}_root").alias("root"), F.col(f"{s}_at").alias("at")).agg(F.sum(f"{o}_n").alias("n"))
            mine = src.join(adds, ["root", "at"]).select("id", "n")
            out = mine if out is None else out.unionByName(mine)
        return out

    def _compare(self, pairs: DataFrame, a_pts: DataFrame, b_pts: DataFrame, flags: list[str], counts: bool) -> DataFrame:
        if counts:
            packed = F.col("a_n") * F.col("b_n") > PACK
            one = self._compare_one(pairs.where(~packed), a_pts, b_pts, True)
            return one.unionByName(self._compare_packed(pairs.where(packed), a_pts, b_pts))
        return self._compare_one(pairs, a_pts, b_pts, False)

    def _compare_packed(self, pairs: DataFrame, a_pts: DataFrame, b_pts: DataFrame) -> DataFrame:
        """``id, n`` of pairs with many points: the points of a cell as arrays (of about ``PIECE``), compared in numpy; each end of a
        pair counts for itself, so that a cell's counts are added up where they arise."""
        axes = [f"x{i}" for i in range(self.k)]
        ways = None
        for s, o in (("a", "b"), ("b", "a")):
            way = pairs.where(f"to_{s}").select(F.col(f"{s}_root").alias("root"), F.col(f"{s}_at").alias("at"), F.col(f"{s}_n").alias("n"), F.col(f"{o}_root").alias("o_root"),
                                                F.col(f"{o}_at").alias("o_at"), F.col(f"{o}_n").alias("o_n"), F.lit(s).alias("side"))
            ways = way if ways is None else ways.unionByName(way)

        def arrays(pre: str, side: str, cols: list[str]) -> DataFrame:
            """The cells that stand in ``ways`` as ``{pre}root, {pre}at``, from the points of that side."""
            other = {"a": "b", "b": "a"}
            out = None
            for src, at in ((a_pts, "a"), (b_pts, "b")):
                mine = ways.where(F.col("side") == (at if side == "own" else other[at])).select(F.col(f"{pre}root").alias("root"), F.col(f"{pre}at").alias("at"), F.col(f"{pre}n").alias("_n")).distinct()
                p = src.join(mine, ["root", "at"]).withColumn("_piece", F.pmod(F.xxhash64("id"), F.ceil(F.col("_n") / PIECE)))
                p = p.groupBy("root", "at", "_piece").agg(F.collect_list(F.struct(*cols)).alias("_l"), F.count(F.lit(1)).alias("_c")) \
                    .select(F.col("root").alias(f"{pre}root"), F.col("at").alias(f"{pre}at"), F.lit(at if side == "own" else other[at]).alias("side"),
                            *([F.xxhash64("root", "at", "_piece", F.lit(at)).alias("key")] if side == "own" else []), *[F.col("_l")[c].alias(f"{pre}{c}") for c in cols])
                out = p if out is None else out.unionByName(p)
            return out

        both = ways.drop("n", "o_n").join(arrays("o_", "other", axes), ["o_root", "o_at", "side"]).drop("o_root", "o_at")
        tasks = pair_tasks(pairs.sparkSession, 4 * self.compared["points"])
        both = _dealt(both, arrays("", "own", ["id", *axes]), ["root", "at", "side"], tasks)
        schema = a_pts.select("id", F.lit(0).cast("long").alias("n")).schema
        both = both.select("key", "id", *axes, *[f"o_{c}" for c in axes])
        return both.mapInArrow(_near_counts(self.k, self.eps, self.metric), schema).groupBy("id").agg(F.sum("n").alias("n"))

    def _compare_one(self, pairs: DataFrame, a_pts: DataFrame, b_pts: DataFrame, counts: bool) -> DataFrame:
        a, b = prefixed(a_pts, "a_"), prefixed(b_pts, "b_")
        near = within_diffs([F.col(f"a_x{i}") - F.col(f"b_x{i}") for i in range(self.k)], self.eps, self.metric)
        hits = pairs.drop("a_n", "b_n").join(a, ["a_root", "a_at"]).join(b, ["b_root", "b_at"]).where(near)
        if not counts:
            return hits.select("a_root", "b_root").distinct()
        ends = F.filter(F.array(F.when(F.col("to_a"), F.col("a_id")), F.when(F.col("to_b"), F.col("b_id"))), lambda c: c.isNotNull())
        return hits.select(F.explode(ends).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def _near_counts(k: int, eps: float, metric: str):
    """Batches ``key, id[], x0[].., o_x0[]..`` to ``id, n``: for each id of a row the other points within eps, with the operations
    of ``within_diffs``, added up over a batch's rows of the same key."""
    def counts(batches):
        import numpy as np
        import pyarrow as pa

        def near(own, other):
            out = None
            for c in range(k):
                d = own[c][:, None] - other[c][None, :]
                d = np.multiply(d, d, out=d) if metric == "euclidean" else np.abs(d, out=d)
                out = d if out is None else np.maximum(out, d, out=out) if metric == "chebyshev" else np.add(out, d, out=out)
            return np.count_nonzero(out <= (eps * eps if metric == "euclidean" else eps), axis=1)

        for batch in batches:
            keys = batch.column("key").to_numpy()
            ends = [batch.column(c).offsets.to_numpy() for c in ("id", "o_x0")]
            own = [batch.column(f"x{i}").values.to_numpy() for i in range(k)]
            other = [batch.column(f"o_x{i}").values.to_numpy() for i in range(k)]
            total, first = {}, {}
            for r, key in enumerate(keys):
                a, b = (slice(e[r], e[r + 1]) for e in ends)
                n = near([c[a] for c in own], [c[b] for c in other])
                if key in total:
                    total[key] += n
                else:
                    total[key], first[key] = n, r
            ids = batch.column("id").take(pa.array(list(first.values()), "int64")).flatten()
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate([*total.values(), np.zeros(0, "int64")]).astype("int64"))], ["id", "n"])

    return counts
