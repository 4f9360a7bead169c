"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

These strings are run by DuckDB over the same parquet tables (registered as views), side by
side with the Spark queries. They use no Spark code and share only the fixed parameters.
"""

from __future__ import annotations

# Point fixtures as DuckDB SQL (columns id, x0..x{k-1}); see FIXTURES.md.
POINTS_SQL = {
    "PT": "select p_partkey id, p_retailprice::double x0, p_size::double x1 from part",
    "CU": "select c_custkey id, c_acctbal::double/1000.0 x0, c_nationkey::double x1 from customer",
    "EV": ("select event_id id, (epoch_us(ts)-1704067200000000)::double/3600000000.0 x0, "
           "value::double/10.0 x1 from events where event_type='error'"),
    "EVT": ("select event_id id, event_type, (epoch_us(ts)-1704067200000000)::double/3600000000.0 x0, "
            "value::double/10.0 x1 from events"),
    "O3": ("select o_orderkey id, o_totalprice::double/10000.0 x0, date_diff('day', date '1995-01-01', o_orderdate::date)::double/30.0 x1, "
           "substr(o_orderpriority, 1, 1)::double x2 from orders"),
    "E3": ("select vec_id id, embedding[1]::double*10 x0, embedding[2]::double*10 x1, "
           "embedding[3]::double*10 x2 from embeddings"),
}


def lit(v: float) -> str:
    return f"({float(v)!r})::double"


def within_sql(k: int, eps: float, metric: str = "euclidean", a: str = "a", b: str = "b") -> str:
    d = [f"({a}.x{i}-{b}.x{i})" for i in range(k)]
    if metric == "euclidean":
        return "+".join(f"{x}*{x}" for x in d) + f" <= {lit(eps)}*{lit(eps)}"
    if metric == "manhattan":
        return "+".join(f"abs({x})" for x in d) + f" <= {lit(eps)}"
    if metric == "chebyshev":
        inner = ", ".join(f"abs({x})" for x in d)
        return (f"greatest({inner})" if k > 1 else inner) + f" <= {lit(eps)}"
    raise ValueError(metric)


def dbscan_ctes(p_sql: str, k: int, eps: float, min_samples: int, metric: str = "euclidean",
                group: str | None = None) -> str:
    """CTEs p, e (ordered pairs), core, ce, r, lab (core labels), bord (border labels)."""
    gcond = f" and a.{group} = b.{group}" if group else ""
    return f"""with recursive p as ({p_sql}),
 e as materialized (select a.id a, b.id b from p a join p b on {within_sql(k, eps, metric)}{gcond}),
 core as materialized (select a id, count(*) n from e group by a having count(*) >= {int(min_samples)}),
 ce as materialized (select a, b from e where a in (select id from core) and b in (select id from core)),
 r(id, root) as (select id, id from core
   union select ce.b, r.root from r join ce on ce.a = r.id where r.root < ce.b),
 lab as materialized (select id, min(root) l from r group by 1),
 bord as materialized (select e.a id, min(lab.l) l from e join lab on e.b = lab.id
          where e.a not in (select id from core) group by 1)"""


def dbscan_sql(p_sql: str, k: int, eps: float, min_samples: int, metric: str = "euclidean",
               group: str | None = None) -> str:
    """Exact DBSCAN: ``id, label, kind`` (plus the group column when grouped)."""
    gsel = f"p.{group}, " if group else ""
    return dbscan_ctes(p_sql, k, eps, min_samples, metric, group) + f"""
select {gsel}p.id, coalesce(lab.l, bord.l, -1)::bigint label,
  case when lab.l is not null then 'core' when bord.l is not null then 'border' else 'noise' end kind
from p left join lab using (id) left join bord using (id)"""


def fixture_dbscan_sql(name: str, eps: float, min_samples: int, metric: str = "euclidean") -> str:
    k = 3 if name == "E3" else 2
    return dbscan_sql(POINTS_SQL[name], k, eps, min_samples, metric, group="event_type" if name == "EVT" else None)
