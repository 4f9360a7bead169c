"""Waveform queries over W40 (F1-F13): every user's whole series of event values by (ts, event_id) in waves
of 40 (the last one of a user may be shorter). For per-channel work a wave is two channels of 20.
Pairs are waves of one block of neighbouring users that have the same length."""

from __future__ import annotations

from pyspark.sql import functions as F

from densitykit.functions import waves as W
from densitykit.operators import waves as OW
from densitykit.plans import fixtures as fx
from densitykit.plans.catalog import r6, register
from densitykit.plans.oracles import lit

W40 = """w as (select *, count(*) over (partition by wave_id) n from (
  select user_id * 1000000 + p // 40 wave_id, (p % 40)::int pos, v from (select user_id, value::double v,
  row_number() over (partition by user_id order by ts, event_id) - 1 p from events)))"""
W40CH = W40 + ", wc as (select wave_id, (pos // 20)::int channel, (pos % 20)::int pos, v from w)"
PAIRS = "pr as (select distinct a.wave_id u1, b.wave_id u2, a.n from w a join w b on b.wave_id = a.wave_id + 1000000 and b.n = a.n)"


def _w40(spark, sf_dir):
    return fx.w40(spark, sf_dir)


def _signal(spark, sf_dir):
    w = _w40(spark, sf_dir)
    return w.select("wave_id", F.array(F.slice("v", 1, 20), F.slice("v", 21, 20)).alias("signal"))


def _zsql(src="w", keys="wave_id", out="z", digits=6):
    z = "(v - m) / case when s = 0 then 1 else s end"
    z = f"round({z}, {digits})" if digits is not None else z
    return (f"select {keys}, pos, {z} {out} from {src} "
            f"join (select {keys}, avg(v) m, stddev_pop(v) s from {src} group by {keys}) using ({keys})")


@register("wave_zscore", f"with {W40} {_zsql()}")
def q_wave_zscore(spark, sf_dir):
    """F1: z-score of each waveform."""
    z = _w40(spark, sf_dir).select("wave_id", W.zscore("v").alias("v"))
    return OW.to_long(z, ["wave_id"], out="z").select("wave_id", "pos", r6("z").alias("z"))


@register("channel_zscore", f"with {W40CH} {_zsql('wc', 'wave_id, channel')}")
def q_channel_zscore(spark, sf_dir):
    """F2: every channel z-scored, keeping the event and channel ids."""
    c = OW.channel_zscore(_signal(spark, sf_dir), ["wave_id"])
    return OW.to_long(c, ["wave_id", "channel"], out="z").select("wave_id", "channel", "pos", r6("z").alias("z"))


@register("wave_slice", f"with {W40CH} select wave_id, pos - 5 pos, v from wc where channel = 1 and pos >= 5 and pos < 15")
def q_wave_slice(spark, sf_dir):
    """channel 1, samples [5, 15)."""
    s = _signal(spark, sf_dir).select("wave_id", W.wave_window(F.col("signal")[1], 5, 10).alias("v"))
    return OW.to_long(s, ["wave_id"])


@register("wave_peak", f"""with {W40} select wave_id, min(pos) filter (where v = mx) peak_pos, max(mx) peak
from w join (select wave_id, max(v) mx from w group by wave_id) using (wave_id) group by wave_id""")
def q_wave_peak(spark, sf_dir):
    """position of the first maximum and its height."""
    return _w40(spark, sf_dir).select("wave_id", W.peak_index("v").alias("peak_pos"), W.peak_value("v").alias("peak"))


@register("wave_roll", f"with {W40} select wave_id, ((pos + 7) % n)::int pos, v from w")
def q_wave_roll(spark, sf_dir):
    """``np.roll(v, 7)``."""
    return OW.to_long(_w40(spark, sf_dir).select("wave_id", W.roll("v", 7).alias("v")), ["wave_id"])


@register("wave_roll_neg", f"with {W40} select wave_id, (((pos - 13) % n + n) % n)::int pos, v from w")
def q_wave_roll_neg(spark, sf_dir):
    """``np.roll(v, -13)``."""
    return OW.to_long(_w40(spark, sf_dir).select("wave_id", W.roll("v", -13).alias("v")), ["wave_id"])


@register("wave_align", f"""with {W40},
 pk as (select wave_id, min(pos) filter (where v = mx) p from w join (select wave_id, max(v) mx from w group by wave_id)
   using (wave_id) group by wave_id),
 r as (select wave_id, (((pos + 19 - p) % n + n) % n - 11)::int pos, v from w join pk using (wave_id)),
 a as (select * from r where pos >= 0 and pos < 24)
{_zsql('a')}""")
def q_wave_align(spark, sf_dir):
    """peak rolled to 19, samples [11, 35) kept (8 before, 16 after), z-scored."""
    a = _w40(spark, sf_dir).select("wave_id", W.align_peak("v", 19, 8, 16).alias("v"))
    return OW.to_long(a, ["wave_id"], out="z").select("wave_id", "pos", r6("z").alias("z"))


def _pairs(spark, sf_dir):
    w = _w40(spark, sf_dir)
    a = w.select(F.col("wave_id").alias("u1"), F.col("v").alias("v1"))
    b = w.select(F.col("wave_id").alias("u2"), F.col("v").alias("v2"))
    return a.join(b, (F.col("u2") == F.col("u1") + fx.WAVE_STEP) & (F.size("v1") == F.size("v2")))


@register("wave_dist", f"""with {W40}, z as ({_zsql(digits=None)}), {PAIRS}
select pr.u1, pr.u2, round(sqrt(sum((a.z - b.z) * (a.z - b.z))), 4) dist
from pr join z a on a.wave_id = pr.u1 join z b on b.wave_id = pr.u2 and b.pos = a.pos group by pr.u1, pr.u2""")
def q_wave_dist(spark, sf_dir):
    """distance of z-scored waveforms of waves of neighbouring users."""
    return _pairs(spark, sf_dir).select("u1", "u2", F.round(W.scaled_distance("v1", "v2"), 4).alias("dist"))


@register("wave_ss_dist", f"""with {W40}, {PAIRS}
select pr.u1, pr.u2, round(sqrt(sum(power(a.v * {lit(1.5)} + {lit(0.25)} - (b.v / {lit(1.5)} - {lit(0.25)}), 2))), 4) dist
from pr join w a on a.wave_id = pr.u1 join w b on b.wave_id = pr.u2 and b.pos = (a.pos + 3) % pr.n group by pr.u1, pr.u2""")
def q_wave_ss_dist(spark, sf_dir):
    """F8: shift/scale distance with s 1.5, u 0.25, r 3."""
    return _pairs(spark, sf_dir).select("u1", "u2", F.round(W.shift_scale_distance("v1", "v2", 1.5, 0.25, 3), 4).alias("dist"))


@register("wave_best_match", f"""with {W40}, {PAIRS},
 g as (select s::double s, u::double u, r::int r from (select 0.5 + 0.25 * i s from range(7) t(i)),
   (select -1.0 + 0.5 * j u from range(5) t(j)), (select k - 8 r from range(17) t(k))),
 d as (select pr.u1, pr.u2, g.s, g.u, g.r, sqrt(sum(power(a.v * g.s + g.u - (b.v / g.s - g.u), 2))) dist
   from pr cross join g join w a on a.wave_id = pr.u1 join w b on b.wave_id = pr.u2 and b.pos = ((a.pos + g.r) % pr.n + pr.n) % pr.n
   group by pr.u1, pr.u2, g.s, g.u, g.r),
 o as (select *, row_number() over (partition by u1, u2 order by dist, abs(r), r, s, u) rn from d)
select u1, u2, round(dist, 4) dist, s, u, r from o where rn = 1""")
def q_wave_best_match(spark, sf_dir):
    """best (s, u, r) on the fixed grid per pair of waves of neighbouring users."""
    b = OW.best_shift_scale(_pairs(spark, sf_dir))
    return b.select("u1", "u2", F.round("dist", 4).alias("dist"), "s", "u", "r")


@register("wave_least_distance", f"""with {W40}, {PAIRS},
 s1 as (select wave_id, count(*) n, sum(v) s, sum(v * v) - sum(v) * sum(v) / count(*) a from w group by wave_id),
 k as (select pr.u1, pr.u2, pr.n, power(b.a / a.a, 0.25) s, (b.s / power(b.a / a.a, 0.25) - power(b.a / a.a, 0.25) * a.s) / (2 * pr.n) u
   from pr join s1 a on a.wave_id = pr.u1 join s1 b on b.wave_id = pr.u2),
 d as (select k.u1, k.u2, k.s, k.u, t.i i, sqrt(sum(power(a.v * k.s + k.u - (b.v / k.s - k.u), 2))) dist
   from k join range(40) t(i) on t.i < k.n join w a on a.wave_id = k.u1 join w b on b.wave_id = k.u2 and b.pos = (a.pos + t.i) % k.n group by all)
select u1, u2, round(min(dist), 4) dist, round(s, 6) s, round(u, 6) u from d group by all""")
def q_wave_least_distance(spark, sf_dir):
    """the least distance over all s, u and shifts (every shift tried in the SQL)."""
    b = OW.least_shift_scale(_pairs(spark, sf_dir))
    return b.select("u1", "u2", F.round("dist", 4).alias("dist"), r6("s").alias("s"), r6("u").alias("u"))


@register("pulse_least_squares_check", f"""with {W40} select count(distinct wave_id) n, 0::bigint above_closed_form, 0::bigint out_of_bounds from w""")
def q_pulse_least_squares_check(spark, sf_dir):
    """the bounded least-squares fit of every wave, which must not be worse than the closed form."""
    w = _w40(spark, sf_dir)
    fit = OW.pulse_least_squares(w, ["wave_id"], baseline="zero", threshold=0.0)
    closed = OW.pulse_fit(w, ["wave_id"], baseline="zero", threshold=0.0).select("wave_id", F.col("res").alias("closed"))
    j = fit.join(closed, "wave_id", "left")
    return j.agg(F.count("res").alias("n"), F.count_if(F.col("res") > F.col("closed") * (1 + 1e-9)).alias("above_closed_form"),
                 F.count_if((F.col("b") < 0) | (F.col("d") < 1e-4)).alias("out_of_bounds"))


@register("pulse_value", f"""with {W40},
 p as (select wave_id, min(v) a, max(v) - min(v) b, min(pos) filter (where v = mx) c
   from w join (select wave_id, max(v) mx from w group by wave_id) using (wave_id) group by wave_id)
select wave_id, pos, round(a + b * exp(-((pos::double - c) * (pos::double - c)) / {lit(20.0)}), 6) y from w join p using (wave_id)""")
def q_pulse_value(spark, sf_dir):
    """the pulse with a = min, b = max - min, c = peak position, d = 20 at each position."""
    w = _w40(spark, sf_dir).select("wave_id", "v", F.array_min("v").alias("a"),
                                   (F.array_max("v") - F.array_min("v")).alias("b"), W.peak_index("v").alias("c"))
    return w.select("wave_id", F.posexplode("v").alias("pos", "_v"), "a", "b", "c") \
        .select("wave_id", F.col("pos").cast("int").alias("pos"),
                r6(W.pulse(F.col("pos").cast("double"), "a", "b", F.col("c").cast("double"), 20.0)).alias("y"))


def _fit_sql():
    det = lambda a: (f"({a[0]}*({a[4]}*{a[8]}-{a[5]}*{a[7]}) - {a[1]}*({a[3]}*{a[8]}-{a[5]}*{a[6]}) "  # noqa: E731
                     f"+ {a[2]}*({a[3]}*{a[7]}-{a[4]}*{a[6]}))")
    m = ["n", "su", "s2", "su", "s2", "s3", "s2", "s3", "s4"]
    d = det(m)
    q0 = det(["l0", "su", "s2", "l1", "s2", "s3", "l2", "s3", "s4"])
    q1 = det(["n", "l0", "s2", "su", "l1", "s3", "s2", "l2", "s4"])
    q2 = det(["n", "su", "l0", "su", "s2", "l1", "s2", "s3", "l2"])
    return f"""with {W40},
 x as (select wave_id, pos::double - 19.5 u, ln(v) l, v from w where v > 0),
 s as (select wave_id, count(*)::double n, sum(u) su, sum(u*u) s2, sum(u*u*u) s3, sum(u*u*u*u) s4, sum(l) l0, sum(u*l) l1, sum(u*u*l) l2
   from x group by wave_id),
 q as (select wave_id, case when n >= 3 and {d} <> 0 then {q0} / {d} end q0, case when n >= 3 and {d} <> 0 then {q1} / {d} end q1,
   case when n >= 3 and {d} <> 0 then {q2} / {d} end q2 from s),
 f as (select wave_id, 0.0::double a, case when q2 < 0 then exp(q0 - q1*q1/(4*q2)) end b,
   case when q2 < 0 then 19.5 - q1/(2*q2) end c, case when q2 < 0 then -1.0/q2 end d from q),
 r as (select wave_id, sum(power(v - (f.a + f.b * exp(-((pos::double - f.c) * (pos::double - f.c)) / f.d)), 2)) res
   from w join f using (wave_id) group by wave_id)
select wave_id, a, round(b, 4) b, round(c, 4) c, round(d, 4) d, round(case when b is not null then res end, 2) res
from f join r using (wave_id)"""


@register("pulse_fit", _fit_sql())
def q_pulse_fit(spark, sf_dir):
    """closed-form pulse fit per wave (zero baseline, all positive samples)."""
    f = OW.pulse_fit(_w40(spark, sf_dir), ["wave_id"], baseline="zero", threshold=0.0, center=19.5)
    return f.select("wave_id", "a", F.round("b", 4).alias("b"), F.round("c", 4).alias("c"),
                    F.round("d", 4).alias("d"), F.round("res", 2).alias("res"))


@register("wave_pop_stats", f"""with {W40CH}
select channel, pos, round(avg(v), 6) mean, round(var_pop(v), 4) var from wc group by channel, pos""")
def q_wave_pop_stats(spark, sf_dir):
    """mean and population variance per (channel, position) over all waves."""
    s = OW.wave_stats(OW.channels(_signal(spark, sf_dir), ["wave_id"]))
    return s.select("channel", "pos", r6("mean").alias("mean"), F.round("var", 4).alias("var"))


@register("wave_renorm", f"""with {W40CH},
 st as (select channel, pos, avg(v) mean, var_pop(v) var from wc group by channel, pos),
 rr as (select wave_id, channel, pos, (v - mean) / case when sqrt(var) = 0 then 1 else sqrt(var) end v
   from wc join st using (channel, pos))
{_zsql('rr', 'wave_id, channel')}""")
def q_wave_renorm(spark, sf_dir):
    """rescaled by the population stats (std divisor), then z-scored per channel."""
    c = OW.channels(_signal(spark, sf_dir), ["wave_id"])
    stats = OW.wave_stats(c)
    z = OW.to_long(OW.renormalize(c, stats, ["wave_id"]), ["wave_id", "channel"], out="z")
    return z.select("wave_id", "channel", "pos", r6("z").alias("z"))
