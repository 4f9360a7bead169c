"""DuckDB SQL for a kd partition of a point CTE (oracle side of C1-C8).

The label order of the tree is known without data (queue order, left keeps the label, right
takes the next one); axes and medians are computed per level by SQL aggregates. Boxes are
tracked as SQL expressions over the per-level split CTEs.
"""

from __future__ import annotations

from densitykit.plans.oracles import lit


def _plan(max_partitions: int) -> list[list[tuple[int, int]]]:
    levels, todo, nxt = [], [0], 1
    while nxt < max_partitions:
        splits, done = [], []
        while todo and nxt < max_partitions:
            p = todo.pop(0)
            splits.append((p, nxt))
            done += [p, nxt]
            nxt += 1
        levels.append(splits)
        todo = todo + done if todo else done
    return levels


def _argmax(k: int, v: str = "v") -> str:
    if k == 1:
        return "0"
    parts = []
    for i in range(k - 1):
        conds = " and ".join(f"{v}{i} >= {v}{j}" for j in range(i + 1, k))
        parts.append(f"when {conds} then {i}")
    return "case " + " ".join(parts) + f" else {k - 1} end"


def _axis_val(k: int, axis: str) -> str:
    if k == 1:
        return "x0"
    return "case " + " ".join(f"when {axis} = {i} then x{i}" for i in range(k - 1)) + f" else x{k - 1} end"


def kd_sql(points_cte: str, k: int, max_partitions: int, axis: str = "variance") -> tuple[str, str, dict]:
    """Return ``(ctes, final_points_cte_name, boxes)``: ``ctes`` is a list of CTEs (without
    ``with``) defining ``kd0 .. kdL`` (``id, x.., part``); ``boxes[part] = (lo_exprs, hi_exprs)``
    are scalar SQL expressions."""
    levels = _plan(max_partitions)
    ctes = [f"kd0 as (select id, {', '.join(f'x{i}' for i in range(k))}, 0 part from {points_cte})",
            "kdbb as (select " + ", ".join([f"min(x{i}) lo{i}" for i in range(k)] + [f"max(x{i}) hi{i}" for i in range(k)])
            + " from kd0)"]
    boxes = {0: ([f"(select lo{i} from kdbb)" for i in range(k)], [f"(select hi{i} from kdbb)" for i in range(k)])}
    xs = ", ".join(f"x{i}" for i in range(k))
    for L, splits in enumerate(levels, start=1):
        parts = ", ".join(str(p) for p, _ in splits)
        if axis == "variance":
            ctes.append(f"kv{L} as (select part, {_argmax(k)} axis from (select part, "
                        + ", ".join(f"var_pop(x{i}) v{i}" for i in range(k))
                        + f" from kd{L-1} where part in ({parts}) group by part))")
        else:
            ctes.append(f"kv{L} as (select distinct part, {(L - 1) % k} axis from kd{L-1} where part in ({parts}))")
        ctes.append(f"km{L} as (select part, axis, percentile_disc(0.5) within group (order by v desc) m from "
                    f"(select d.part, v.axis, {_axis_val(k, 'v.axis')} v from kd{L-1} d join kv{L} v using (part)) "
                    "group by part, axis)")
        newmap = "case part " + " ".join(f"when {p} then {n}" for p, n in splits) + " end"
        ctes.append(f"kd{L} as (select id, {xs}, case when km.part is not null and "
                    f"{_axis_val(k, 'km.axis')} >= km.m then {newmap} else part end part "
                    f"from kd{L-1} left join km{L} km using (part))")
        for p, n in splits:
            lo, hi = boxes[p]
            ax = f"(select axis from km{L} where part = {p})"
            m = f"(select m from km{L} where part = {p})"
            lhi = [f"case when {ax} = {i} then {m} else {hi[i]} end" for i in range(k)]
            rlo = [f"case when {ax} = {i} then {m} else {lo[i]} end" for i in range(k)]
            boxes[p] = (lo, lhi)
            boxes[n] = (rlo, hi)
    return ctes, f"kd{len(levels)}", boxes


def boxes_cte(boxes: dict, k: int, name: str = "kdboxes") -> str:
    rows = []
    for p in sorted(boxes):
        lo, hi = boxes[p]
        rows.append(f"select {p} part, " + ", ".join([f"({e})::double lo{i}" for i, e in enumerate(lo)]
                                                      + [f"({e})::double hi{i}" for i, e in enumerate(hi)]))
    return f"{name} as ({' union all '.join(rows)})"


def grown_contains(k: int, radius: float, p: str = "p", b: str = "b") -> str:
    r = lit(radius)
    return " and ".join(f"{p}.x{i} between {b}.lo{i} - {r} and {b}.hi{i} + {r}" for i in range(k))
