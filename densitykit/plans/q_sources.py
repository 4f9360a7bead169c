"""Source and sink queries (S1-S12, D12). Each writes data derived from the test tables to
the session's shared scratch storage and reads it back through the source under test."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from densitykit.operators.dbscan import DensityClusterer
from densitykit.operators.points import as_points, read_vectors_text
from densitykit.plans import fixtures as fx
from densitykit.plans import oracles as osql
from densitykit.plans.catalog import r6, register
from densitykit.plans.q_waves import W40
from densitykit.session import scratch_path
from densitykit.sources import event_file as EF
from densitykit.sources import files as SF

# events derived from W40: one event per wave of n values, channel c sample s = floor(10 v[s mod n]) + c; a
# file holds up to 64 blocks of the users of one (user_id div 64, user_id mod 3, user_id mod 2), so the number
# of files grows with the data and no file (one writer task each) grows without bound
_EV_SQL = f"""with {W40},
 u as (select user_id, min(ts) t0 from events group by user_id),
 i as (select distinct wave_id, wave_id // 1000000 user_id, wave_id % 1000000 block from w),
 f as (select wave_id, (200 + user_id // 64)::int series, (user_id % 3 + 1 + 3 * (block // 64))::int run, (user_id % 2 + 1)::int board,
   epoch_us(t0) / 1000000.0 ts,
   (row_number() over (partition by user_id // 64, user_id % 3, block // 64, user_id % 2 order by wave_id) - 1)::int idx
   from i join u using (user_id)),
 sg as (select wave_id, 8 * sum(floor(v * 10)::bigint * (2048 // n + case when pos < 2048 % n then 1 else 0 end)) + 2048 * 28 ssum,
   max(floor(v * 10)::bigint) + 7 ch7 from w group by wave_id)"""


def _derived_events(spark, sf_dir):
    """Events without their signal: name fields, index, timestamp and the wave ``v`` that the signal repeats."""
    w = fx.w40(spark, sf_dir).withColumn("user_id", F.floor(F.col("wave_id") / fx.WAVE_STEP)).withColumn("block", F.col("wave_id") % fx.WAVE_STEP)
    ev = fx.table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("t0"))
    d = w.join(ev, "user_id").select(
        "wave_id", F.lit("S").alias("type"), (F.lit(200) + F.floor(F.col("user_id") / 64)).cast("int").alias("series"),
        (F.pmod("user_id", F.lit(3)) + 1 + 3 * F.floor(F.col("block") / 64)).cast("int").alias("run"),
        (F.pmod("user_id", F.lit(2)) + 1).cast("int").alias("board"),
        (fx.epoch_micros("t0") / 1000000.0).alias("timestamp"), "v")
    win = Window.partitionBy("series", "run", "board").orderBy("wave_id")
    return d.withColumn("index", (F.row_number().over(win) - 1).cast("int"))


def _with_signal(rows):
    """``v`` repeated to the samples of a channel; channel c is floor(10 v) + c, computed once for each value of the wave."""
    times = F.ceil(F.lit(float(EF.N_SAMPLES)) / F.size("v")).cast("int")
    tens = F.transform("v", lambda x: F.floor(x * 10))
    signal = F.array(*[F.slice(F.flatten(F.array_repeat(F.transform("tens", lambda x: (x + c).cast("smallint")), F.col("times"))), 1, EF.N_SAMPLES)
                       for c in range(EF.N_CHANNELS)])
    rows = rows.withColumns({"tens": tens, "times": times})
    return rows.select(*[c for c in rows.columns if c not in ("v", "tens", "times")], signal.alias("signal"))


def _event_folder(spark, sf_dir, split=16):
    path = scratch_path(spark, "events")
    EF.write_event_files(_derived_events(spark, sf_dir).drop("wave_id"), path, header="densitykit test run",
                         footer="end of run", finish=_with_signal)
    return path


@register("event_scan", _EV_SQL + """
select 'S' type, series, run, board, idx index, round(ts, 6) timestamp, 8 n_channels, 255 hp_flag,
 '********' start_flag, ssum signal_sum, ch7 ch7_peak from f join sg using (wave_id)""")
def q_event_scan(spark, sf_dir):
    """Events written as binary files (one per run/board) and read back by byte range
    (16 events per split, many files in one job)."""
    ev = EF.read_events(spark, _event_folder(spark, sf_dir), eventsPerSplit=16)
    return ev.select("type", "series", "run", "board", "index", r6("timestamp").alias("timestamp"), "n_channels",
                     "hp_flag", "start_flag", EF.signal_sum().alias("signal_sum"),
                     F.array_max(F.col("signal")[7]).cast("bigint").alias("ch7_peak"))


@register("event_seek", _EV_SQL + """
select series, run, board, idx event_pos, idx index from f where idx between 3 and 7""")
def q_event_seek(spark, sf_dir):
    """S3: random access: only events 3..7 of every file (splits outside are pruned)."""
    ev = EF.read_events(spark, _event_folder(spark, sf_dir), eventsPerSplit=4, eventFrom=3, eventTo=7)
    return ev.where(F.col("event_pos").between(3, 7)).select("series", "run", "board", "event_pos", "index")


@register("event_files", _EV_SQL + """
select 'S' type, series, run, board, count(*) n_events, 'densitykit test run' header, 'end of run' footer
from f group by series, run, board""")
def q_event_files(spark, sf_dir):
    """File metadata: name fields, event count, header and footer."""
    f = EF.read_event_files(spark, _event_folder(spark, sf_dir))
    return f.select("type", "series", "run", "board", "n_events", "header", "footer")


_PATH = ("concat('/data/ss', user_id::varchar, '/', ['S','C','D'][(event_id % 3) + 1], (user_id % 400)::varchar, "
         "'r', (event_id % 17)::varchar, 'b', (event_id % 2 + 1)::varchar, '.dat')")


@register("path_fields", f"""select event_id, ['S','C','D'][(event_id % 3) + 1] type, (user_id % 400)::int series,
 (event_id % 17)::int run, (event_id % 2 + 1)::int board from events""")
def q_path_fields(spark, sf_dir):
    """Type, series, run and board parsed from file paths built from the events."""
    ev = fx.table(spark, sf_dir, "events")
    path = F.concat(F.lit("/data/ss"), F.col("user_id").cast("string"), F.lit("/"),
                    F.element_at(F.array(F.lit("S"), F.lit("C"), F.lit("D")), (F.pmod("event_id", F.lit(3)) + 1).cast("int")),
                    F.pmod("user_id", F.lit(400)).cast("string"), F.lit("r"), F.pmod("event_id", F.lit(17)).cast("string"),
                    F.lit("b"), (F.pmod("event_id", F.lit(2)) + 1).cast("string"), F.lit(".dat"))
    return ev.select("event_id", *SF.path_fields(path))


_ALL64 = ", ".join(f"round(embedding[{i + 1}]::double, 6) x{i}" for i in range(64))


@register("points_scan", f"select vec_id id, {_ALL64} from embeddings")
def q_points_scan(spark, sf_dir):
    """Keyed points from an array column (all 64 coordinates, cast to DOUBLE)."""
    p = as_points(fx.table(spark, sf_dir, "embeddings"), key="vec_id", array_col="embedding", k=64)
    return p.select("id", *[r6(f"x{i}").alias(f"x{i}") for i in range(64)])


@register("points_text", f"select id, x0, x1 from ({osql.POINTS_SQL['PT']})")
def q_points_text(spark, sf_dir):
    """PT written as ``(id, [x0, x1])`` lines and parsed back."""
    path = scratch_path(spark, "points-text")
    SF.write_vectors_text(fx.pt_points(spark, sf_dir), path, "id", ["x0", "x1"])
    v = read_vectors_text(spark, path, id_first=True)
    return v.select("id", F.col("values")[0].alias("x0"), F.col("values")[1].alias("x1"))


@register("event_table", _EV_SQL + """
select 'S' type, series, run, board, idx index, round(ts::float::double, 0) timestamp, ssum signal_sum, 8::bigint n_channels from f join sg using (wave_id)""")
def q_event_table(spark, sf_dir):
    """Events appended in two writes to a table created on first use, and read back."""
    import uuid

    ev = EF.read_events(spark, _event_folder(spark, sf_dir))
    name, path = f"densitykit_events_{uuid.uuid4().hex[:8]}", scratch_path(spark, "table")
    rows = ev.select("type", "series", "run", "board", "index", F.col("timestamp").cast("float").alias("timestamp"),
                     F.col("signal").alias("channels"))
    SF.save_table(rows.where("board = 1"), name, path=path)
    t = SF.save_table(rows.where("board <> 1"), name, path=path)
    return t.select("type", "series", "run", "board", "index", F.round(F.col("timestamp").cast("double"), 0).alias("timestamp"),
                    EF.signal_sum("channels").alias("signal_sum"), F.size("channels").cast("bigint").alias("n_channels"))


@register("event_load", _EV_SQL + """
select 'S' type, series, run, board, idx event_pos, ssum signal_sum, 2::bigint loads from f join sg using (wave_id)""")
def q_event_load(spark, sf_dir):
    """Files loaded in two steps, each step run twice, with a load that was lost half-way; every event is there once."""
    from densitykit.sources import ledger as LG

    folder, target = _event_folder(spark, sf_dir), scratch_path(spark, "load")
    for source in (f"{folder}/*b1.dat", f"{folder}/*b1.dat", folder, folder):
        LG.load_events(spark, source, target)
    EF.read_events(spark, f"{folder}/*b2.dat").write.parquet(f"{target}/data/load=lost")  # no ledger entry
    n = LG.ledger(spark, target).agg(F.countDistinct("load").alias("loads"))
    return LG.loaded_events(spark, target).select("type", "series", "run", "board", "event_pos", EF.signal_sum().alias("signal_sum")) \
        .join(F.broadcast(n))


#: The 2,048 samples of channel 7 of every event, from the waves they repeat.
_SAMPLES = _EV_SQL + """,
 ex as (select wave_id, pos + n * i s, y from (select wave_id, n, pos, floor(v * 10)::double y, unnest(range((2047 - pos) // n + 1)) i from w))"""


@register("event_channel_zscore", _SAMPLES + """,
 m as (select wave_id, avg(y) mean, case when stddev_pop(y) = 0 then 1 else stddev_pop(y) end sd from ex group by wave_id),
 z as (select wave_id, max(case when s = 0 then (y - mean) / sd end) z_first, max((y - mean) / sd) z_max, sum(abs(y - mean) / sd) z_abs
   from ex join m using (wave_id) group by wave_id)
select series, run, board, idx event_pos, c.i::int channel, round(z_first, 4) z_first, round(z_max, 4) z_max, round(z_abs, 2) z_abs
from f join z using (wave_id), range(8) c(i)""")
def q_event_channel_zscore(spark, sf_dir):
    """F2 on event files: all 8 channels of 2,048 samples of every event z-scored."""
    from densitykit.operators import waves as OW

    ev = EF.read_events(spark, _event_folder(spark, sf_dir))
    z = OW.channel_zscore(ev, ["series", "run", "board", "event_pos"])
    return z.select("series", "run", "board", "event_pos", "channel", F.round(F.col("v")[0], 4).alias("z_first"), F.round(F.array_max("v"), 4).alias("z_max"),
                    F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(x)), 2).alias("z_abs"))


@register("event_pop_stats", _SAMPLES + """
select c.i::int channel, s::int pos, count(*) n, round(avg(y + c.i), 6) mean, round(var_pop(y), 4) var from ex, range(8) c(i) group by c.i, s""")
def q_event_pop_stats(spark, sf_dir):
    """F12 on event files: mean and population variance of 8 x 2,048 positions over all events."""
    from densitykit.operators import waves as OW

    s = OW.wave_stats(OW.channels(EF.read_events(spark, _event_folder(spark, sf_dir)), []))
    return s.select("channel", F.col("pos").cast("int").alias("pos"), "n", r6("mean").alias("mean"), F.round("var", 4).alias("var"))


def _event_fit_sql():
    det = lambda a: (f"({a[0]}*({a[4]}*{a[8]}-{a[5]}*{a[7]}) - {a[1]}*({a[3]}*{a[8]}-{a[5]}*{a[6]}) "  # noqa: E731
                     f"+ {a[2]}*({a[3]}*{a[7]}-{a[4]}*{a[6]}))")
    d = det(["n", "su", "s2", "su", "s2", "s3", "s2", "s3", "s4"])
    q = {"q0": det(["l0", "su", "s2", "l1", "s2", "s3", "l2", "s3", "s4"]), "q1": det(["n", "l0", "s2", "su", "l1", "s3", "s2", "l2", "s4"]),
         "q2": det(["n", "su", "l0", "su", "s2", "l1", "s2", "s3", "l2"])}
    return _SAMPLES + f""",
 lo as (select wave_id, min(y) a, max(y) mx from ex group by wave_id),
 kept as (select wave_id, s - 1023.5::double u, ln(y - a) l from ex join lo using (wave_id) where y - a > 0.2::double * (mx - a) and y - a > 0),
 sm as (select wave_id, count(*)::double n, count(distinct l) levels, sum(u) su, sum(u*u) s2, sum(u*u*u) s3, sum(u*u*u*u) s4, sum(l) l0, sum(u*l) l1, sum(u*u*l) l2
   from kept group by wave_id),
 qq as (select wave_id, {', '.join(f'case when n >= 3 and levels > 1 then {v} / {d} end {k}' for k, v in q.items())} from sm),
 ft as (select wave_id, case when q2 < -1e-12 then q0 - q1*q1/(4*q2) end lb, case when q2 < -1e-12 then 1023.5 - q1/(2*q2) end c, case when q2 < -1e-12 then -1.0/q2 end d from qq)
select series, run, board, idx event_pos, round(a + 7, 4) a, round(lb, 3) ln_b, round(c / 100, 3) c, round(ln(d), 3) ln_d
from f join lo using (wave_id) left join ft using (wave_id)"""


@register("event_pulse_features", _event_fit_sql())
def q_event_pulse_features(spark, sf_dir):
    """S1 -> F3 -> F11: channel 7 of every event file's events, closed-form fit (null for one kept level, or a curvature
    that is rounding)."""
    from densitykit.functions import waves as W
    from densitykit.plans import pipelines as PL

    ev = EF.read_events(spark, _event_folder(spark, sf_dir))
    v = F.col("signal")[7]
    kept = W.bound(F.struct(F.array_min(v).alias("lo"), F.array_max(v).alias("hi")), lambda m: F.filter(
        v, lambda x: (x - m["lo"] > F.lit(0.2) * (m["hi"] - m["lo"])) & (x > m["lo"])))
    some = F.size(F.array_distinct(kept)) > 1
    ev = ev.withColumns({"low": F.array_min(v).cast("double"), "some": some})
    j = PL.event_features(ev, keep=["series", "run", "board", "low", "some"]).withColumnRenamed("event_index", "event_pos")
    only = lambda c: F.when(F.col("some") & (F.col("d") < 1e12), c)
    return j.select("series", "run", "board", "event_pos", F.round("low", 4).alias("a"), F.round(only(F.ln("b")), 3).alias("ln_b"),
                    F.round(only(F.col("c")) / 100, 3).alias("c"), F.round(only(F.ln("d")), 3).alias("ln_d"))


@register("feature_sink", f"""with {W40} select wave_id, round(max(v), 6) peak, round(avg(v), 6) mean from w group by wave_id""")
def q_feature_sink(spark, sf_dir):
    """Per-wave features saved as text and read back."""
    from densitykit.functions import waves as W

    f = fx.w40(spark, sf_dir).select("wave_id", F.array_max("v").alias("peak"), W.wave_mean("v").alias("mean"))
    path = scratch_path(spark, "features-text")
    SF.write_vectors_text(f, path, "wave_id", ["peak", "mean"])
    v = read_vectors_text(spark, path, id_first=True)
    return v.select(F.col("id").alias("wave_id"), r6(F.col("values")[0]).alias("peak"), r6(F.col("values")[1]).alias("mean"))


@register("predictions_csv", f"with d as ({osql.fixture_dbscan_sql('PT', 2.0, 6)}) select id, label cluster from d")
def q_predictions_csv(spark, sf_dir):
    """Result CSV ``id,cluster`` with a header, read back."""
    r = DensityClusterer(2.0, 6).fit(fx.pt_points(spark, sf_dir)).result.select("id", F.col("label").alias("cluster"))
    path = scratch_path(spark, "results-csv")
    SF.write_csv(r, path)
    return SF.read_csv(spark, path, "id BIGINT, cluster BIGINT")


@register("dbscan_text", osql.fixture_dbscan_sql("PT", 2.0, 6))
def q_dbscan_text(spark, sf_dir):
    """Text-fed DBSCAN: vectors from text, clustered, labels written as text and read back."""
    src = scratch_path(spark, "dbscan-in")
    SF.write_vectors_text(fx.pt_points(spark, sf_dir), src, "id", ["x0", "x1"])
    v = read_vectors_text(spark, src, id_first=True)
    pts = v.select("id", F.col("values")[0].alias("x0"), F.col("values")[1].alias("x1"))
    res = DensityClusterer(2.0, 6).fit(pts).result
    out = scratch_path(spark, "dbscan-out")
    res.select(F.concat_ws(",", F.col("id").cast("string"), F.col("label").cast("string"), "kind").alias("value")) \
        .write.text(out)
    back = spark.read.text(out).select(F.split("value", ",").alias("f"))
    return back.select(F.col("f")[0].cast("bigint").alias("id"), F.col("f")[1].cast("bigint").alias("label"),
                       F.col("f")[2].alias("kind"))
