"""Operators on tiny tables with answers worked out by hand, and metamorphic checks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronospark.functions import text, times
from chronospark.functions.bands import axis, axis_value, band_index
from chronospark.functions.types import loses_precision, numeric, parse_datatype, parse_spectrum, reinterpret_unsigned, value_as_string
from chronospark.operators import align, decimate, filters, merge, ordered, stale, stats, timebase
from chronospark.operators.asof import asof
from chronospark.streaming.guard import Guard

DAY = ordered.DAY_NS


def frame(spark, rows):
    return spark.createDataFrame([(i, c, t, v) for i, (c, t, v) in enumerate(rows)], "ord long, channel string, ts_ns long, v double")


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first()["x"]


# Ordered helpers: buckets must not change the answers


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(8)
    rows = [(rng.choice("abc"), rng.randrange(0, 6 * DAY), rng.random()) for _ in range(400)]
    rows += [("a", 5, 1.0), ("a", 5, 2.0), ("d", 3, 9.0)]
    return frame(spark, rows)


def test_numbers_neighbours_and_nearest(spark, series):
    rows = sorted(series.collect(), key=lambda r: (r["channel"], r["ts_ns"], r["ord"]))
    by = {}
    for r in rows:
        by.setdefault(r["channel"], []).append(r)
    bucket = ordered.time_bucket(F.col("ts_ns"))
    got = {r["ord"]: r["i"] for r in ordered.numbered(series, ["channel"], ["ts_ns", "ord"], bucket, "i").collect()}
    assert got == {r["ord"]: i for own in by.values() for i, r in enumerate(own)}
    nxt = {r["ord"]: r["nx"] for r in ordered.with_next(series, ["channel"], ["ts_ns", "ord"], bucket, {"nx": "ts_ns"}).collect()}
    assert nxt == {r["ord"]: own[i + 1]["ts_ns"] if i + 1 < len(own) else None for own in by.values() for i, r in enumerate(own)}
    prv = {r["ord"]: r["pv"] for r in ordered.with_previous(series, ["channel"], ["ts_ns", "ord"], bucket, {"pv": "v"}).collect()}
    assert prv == {r["ord"]: own[i - 1]["v"] if i else None for own in by.values() for i, r in enumerate(own)}
    value = F.when(F.col("ord") % 9 == 0, F.col("v"))
    near = {r["ord"]: (r["lo"], r["hi"]) for r in ordered.with_nearest(series, ["channel"], ["ts_ns", "ord"], bucket, value).collect()}
    for own in by.values():
        keep = [r["v"] if r["ord"] % 9 == 0 else None for r in own]
        for i, r in enumerate(own):
            lo = next((x for x in reversed(keep[: i + 1]) if x is not None), None)
            assert near[r["ord"]] == (lo, next((x for x in keep[i:] if x is not None), None))


@pytest.mark.parametrize("bucket", [DAY, 10**13, 10**18])
def test_asof_equals_numpy(spark, series, bucket):
    source, probe = series.where("channel = 'a'"), series.where("channel = 'b'").select("ord", "ts_ns")
    points = {}
    for r in sorted(source.collect(), key=lambda r: r["ord"]):
        points[r["ts_ns"]] = r["v"]
    t = np.array(sorted(points))
    v = np.array([points[x] for x in t])
    got = {r["ord"]: r["found"] for r in asof(probe, source, "linear", bucket_ns=bucket).collect()}
    for r in probe.collect():
        assert got[r["ord"]] == pytest.approx(float(np.interp(r["ts_ns"], t, v)), rel=1e-9)
    zoh = {r["ord"]: r["found"] for r in asof(probe, source, "zoh", bucket_ns=bucket).collect()}
    for r in probe.collect():
        k = int(np.searchsorted(t, r["ts_ns"], "right")) - 1
        assert zoh[r["ord"]] == (None if k < 0 else v[k])


def test_asof_goes_through_no_frame_anew(spark):
    """A frame up to the partition's end costs the square of its rows."""
    df = frame(spark, [("a", i, float(i)) for i in range(9)])
    for method in ("linear", "nearest", "zoh"):
        plan = asof(df, df, method, bucket_ns=4)._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "windowexpression" in plan or "windowspecdefinition" in plan
        assert "unboundedfollowing" not in plan


def test_asof_edges(spark):
    source = frame(spark, [("s", 10, 1.0), ("s", 20, 3.0), ("s", 20, 5.0)])
    probe = frame(spark, [("p", 5, 0.0), ("p", 15, 0.0), ("p", 20, 0.0), ("p", 99, 0.0)]).select("ord", "ts_ns")
    found = lambda m: [r["found"] for r in asof(probe, source, m).orderBy("ord").collect()]
    assert found("linear") == [1.0, 3.0, 5.0, 5.0]
    assert found("nearest") == [1.0, 1.0, 5.0, 5.0]  # 15 is as far from both: the earlier one
    assert found("zoh") == [None, 1.0, 5.0, 5.0]
    assert asof(probe, source.limit(0), "linear").where("found is null").count() == 4
    with pytest.raises(ValueError):
        asof(probe, source, "cubic")


def test_asof_by_key(spark):
    source = frame(spark, [("a", 10, 1.0), ("b", 10, 2.0)])
    probe = frame(spark, [("a", 12, 0.0), ("b", 12, 0.0)]).select("ord", "channel", "ts_ns")
    assert [r["found"] for r in asof(probe, source, "zoh", by=["channel"]).orderBy("channel").collect()] == [1.0, 2.0]


# Statistics


def test_stats(spark):
    s = frame(spark, [("a", 1, 1.0), ("a", 2, 3.0), ("b", 1, 5.0), ("n", 1, float("nan")), ("n", 2, 2.0), ("n", 3, 4.0)])
    rows = {r["channel"]: r for r in stats.channel_stats(s).collect()}
    assert (rows["a"]["n"], rows["a"]["mean"], rows["a"]["sd"]) == (2, 2.0, math.sqrt(2)) and rows["b"]["sd"] == 0.0
    assert (rows["n"]["vmin"], rows["n"]["vmax"]) == (2.0, 4.0) and math.isnan(rows["n"]["mean"])
    full = stats.with_empty(stats.channel_stats(s), spark.createDataFrame([("a",), ("z",)], "channel string"))
    assert {r["channel"]: r["n"] for r in full.collect()} == {"a": 2, "z": 0}
    assert stats.channel_stats(s, 2, None).where("channel = 'a'").first()["n"] == 1
    assert stats.extent(s.limit(0)).first() == (0, 0)
    assert [r["channel"] for r in stats.top_channels(s, 2).collect()] == ["n", "a"]


def test_bands(spark):
    s = frame(spark, [("a", 0, 10.0), ("a", 5, 30.0), ("a", 9, 200.0), ("a", 10, 1.0)])
    got = {(r["band"]): r["dur_ns"] for r in stats.band_occupancy(s, all_bands=True).collect()}
    assert got == {0: 5, 1: 4, 2: 0, 3: 0, 4: 1}
    shares = {r["band"]: r["share"] for r in stats.band_shares(stats.band_occupancy(s)).collect()}
    assert shares == {0: 50.0, 1: 40.0, 4: 10.0}
    assert one(spark, band_index(F.col("v"), (30, 50)), v=30.0) == 1
    assert [r["elapsed_ns"] for r in stats.first_crossing(s, 100).collect()] == [9] and stats.first_crossing(s, 999).first()["elapsed_ns"] is None


# Merging


def test_merge_is_idempotent(spark, series):
    s = series.withColumn("file_rank", F.lit(0))
    a = merge.merge(s)
    b = merge.merge(a.withColumn("file_rank", F.lit(0)).withColumn("ord", F.lit(0)))
    assert a.exceptAll(b).count() == 0 and a.count() == b.count() == s.select("channel", "ts_ns").distinct().count()
    twice = s.unionByName(s.withColumn("file_rank", F.lit(1)))
    assert merge.merge(twice).exceptAll(a).count() == 0
    over = merge.merge(s, overlap="overwrite")
    differ = a.join(over.withColumnRenamed("v", "w"), ["channel", "ts_ns"]).where("v <> w")
    assert differ.count() == 1  # the one time that one channel has twice
    with pytest.raises(ValueError):
        merge.merge(s, 5, 5)
    with pytest.raises(ValueError):
        merge.merge(s, overlap="newest")


def test_merged_schema(spark):
    rows = [("f1", 1, 0, "B", "double"), ("f0", 0, 0, "a", "int32"), ("f0", 0, 1, "b", "string"), ("f1", 1, 1, "C", "float")]
    d = spark.createDataFrame(rows, "file string, file_rank int, channel_pos int, channel string, datatype string")
    got = [(r["channel_index"], r["channel"], r["datatype"]) for r in merge.merged_schema(d).orderBy("channel_index").collect()]
    assert got == [(0, "a", "int32"), (1, "b", "string"), (2, "C", "float")]


# Aligning and thinning


def test_align_unpivots_to_the_samples(spark, series):
    unique = merge.merge(series.withColumn("file_rank", F.lit(0)), overlap="overwrite")
    wide = align.align_wide(series, ["a", "b", "c", "d"])
    long = wide.unpivot(["ts_ns"], ["a", "b", "c", "d"], "channel", "v").where("v is not null").select("channel", "ts_ns", "v")
    assert long.exceptAll(unique).count() == 0 and unique.exceptAll(long).count() == 0
    rows = align.align_by_index(series, ["a", "d"])
    assert rows.where("d is not null").count() == 1 and rows.count() == series.where("channel = 'a'").count()


def test_pixels_equal_the_rule(spark):
    rng = random.Random(3)
    for _ in range(6):
        t0, span, width = rng.randrange(10**6), rng.randrange(1, 5000), rng.randrange(1, 60)
        ts = [t0 + rng.randrange(span) for _ in range(80)] + [t0, t0 + span - 1, t0 + span]
        edges = [t0 + px * span // width for px in range(width + 1)]
        got = decimate.decimate(frame(spark, [("a", t, float(t)) for t in ts]), t0, t0 + span, width).collect()
        want = {}
        for t in ts:
            for px in range(width):
                if edges[px] <= t < edges[px + 1]:
                    lo, hi = want.get(px, (t, t))
                    want[px] = (min(lo, t), max(hi, t))
        assert {r["px"]: (r["lo"], r["hi"]) for r in got} == want
    both = decimate.decimate(frame(spark, [("a", 10, 1.0)]), 0, 10, 4, closed="both")
    assert both.first()["px"] == 3
    with pytest.raises(ValueError):
        decimate.decimate(both, 5, 5, 1)


def test_every_nth_and_windows(spark):
    s = frame(spark, [("a", t, float(t)) for t in range(25)] + [("b", 0, 0.0)])
    assert [r["ts_ns"] for r in decimate.every_nth(s, 10).where("channel = 'a'").orderBy("ts_ns").collect()] == list(range(0, 25, 2))
    w = decimate.sliding_windows(s, 10, 7).orderBy("win").collect()
    assert [(r["win"], r["values"][0], len(r["values"])) for r in w] == [(0, 0.0, 10), (1, 7.0, 10), (2, 14.0, 10)]
    sparse = decimate.sliding_windows(s, 2, 5).orderBy("win").collect()
    assert [r["values"] for r in sparse] == [[0.0, 1.0], [5.0, 6.0], [10.0, 11.0], [15.0, 16.0], [20.0, 21.0]]


# Stale values


def test_stale_values(spark):
    s = frame(spark, [("a", 0, 1.0), ("a", 250, 2.0), ("b", 0, 5.0), ("b", 100, 6.0)])
    assert [(r["channel"], r["ts_ns"], r["v"]) for r in stale.reemit_stale(s, 100).orderBy("ts_ns").collect()] == [("a", 100, 1.0), ("a", 200, 1.0)]
    assert stale.reemit_stale(s, 100, end_ns=450).where("ts_ns > 250").count() == 2 + 2
    g = Guard(100)
    g.write("a", 0, 1.0)
    assert g.poll(99) == [] and g.poll(100) == [("a", 100, 1.0)] and g.poll(150) == [] and g.poll(1000) == [("a", 1000, 1.0)]
    assert g.is_tracked("a")
    g.forget("a")
    assert g.poll(10**9) == []
    g.write("b", 1, 2.0)
    g.clear()
    assert not g.is_tracked("b")


def test_stream_sends_stale_values(spark, tmp_path):
    from chronospark.streaming.guard import guard_stream

    source, schema = tmp_path / "in", "channel string, ts_ns long, v double"
    s = 1_000_000_000

    def add(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{source}")

    def go():
        q = guard_stream(spark.readStream.schema(schema).parquet(f"file://{source}"), 100 * s).writeStream.format("parquet").option("path", f"file://{tmp_path}/out")
        q.option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)

    add("1", [("a", 1000 * s, 1.0), ("b", 1000 * s, 7.0)])
    go()
    add("2", [("b", 1050 * s, 8.0), ("b", 1250 * s, 9.0)])
    go()
    add("3", [("b", 1100 * s, 8.5), ("late", 900 * s, 3.0), ("late", 901 * s, 4.0)])
    go()
    out = spark.read.parquet(f"file://{tmp_path}/out")
    passed = sorted((r["channel"], r["ts_ns"] // s, r["v"]) for r in out.where("not reemitted").collect())
    assert passed == [("a", 1000, 1.0), ("b", 1000, 7.0), ("b", 1050, 8.0), ("b", 1100, 8.5), ("b", 1250, 9.0), ("late", 900, 3.0), ("late", 901, 4.0)]
    again = [(r["channel"], r["v"]) for r in out.where("reemitted").collect()]
    assert ("a", 1.0) in again and all(c == "a" for c, _ in again)


def test_stream_guards_positions(spark, tmp_path):
    from chronospark.streaming.guard import guard_stream

    source, schema = tmp_path / "in", "channel string, ts_ns long, v double, v_gps struct<latitude:double,longitude:double,altitude:double>"
    s = 1_000_000_000
    rows = [("gps", 1000 * s, None, (1.0, 2.0, 3.0)), ("num", 1000 * s, 5.0, None), ("text", 1000 * s, None, None), ("other", 1200 * s, 1.0, None)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{source}")
    q = guard_stream(spark.readStream.schema(schema).parquet(f"file://{source}"), 100 * s).writeStream.format("parquet").option("path", f"file://{tmp_path}/out")
    q.option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    out = spark.read.parquet(f"file://{tmp_path}/out")
    assert out.where("not reemitted").count() == 4
    assert sorted((r["channel"], r["v"], tuple(r["v_gps"]) if r["v_gps"] else None) for r in out.where("reemitted").collect()) == [("gps", None, (1.0, 2.0, 3.0)), ("num", 5.0, None)]


def test_buckets_follow_the_counts(spark):
    from chronospark.operators import ordered

    rows = spark.range(4000).select((F.col("id") % 2).cast("string").alias("channel"), F.when(F.col("id") < 3000, F.col("id")).otherwise(F.col("id") * 10**12).alias("ts_ns"), F.col("id").alias("ord"), F.col("id").cast("double").alias("v"))
    size = ordered.bucket_size(rows, ["channel"], rows=200)
    most = rows.groupBy("channel", ordered.time_bucket(F.col("ts_ns"), size)).count().agg(F.max("count")).first()[0]
    assert most <= 250 and ordered.bucket_size(rows.limit(0), ["channel"]) == ordered.DAY_NS
    got = stats.forward_diff(rows, size).where("dur_ns is null").count()
    assert got == 2 and stats.forward_diff(rows, size).exceptAll(stats.forward_diff(rows)).count() == 0


def test_exact_median(spark, monkeypatch):
    import statistics

    monkeypatch.setattr(stats, "MEDIAN_ACCURACY", 20)
    rng = __import__("random").Random(4)
    data = {"a": [rng.gauss(0, 1) for _ in range(999)], "b": [float(rng.randrange(4)) for _ in range(1000)], "c": [7.0], "d": [1.0, 2.0], "e": [float(i) for i in range(1000)]}
    df = spark.createDataFrame([(k, v) for k, x in data.items() for v in x] + [("f", None), ("a", None)], "channel string, v double")
    assert {r["channel"]: r["med"] for r in stats.median(df).collect()} == {k: pytest.approx(statistics.median(x)) for k, x in data.items()}


# Time base


def test_equidistant_times(spark):
    ts = lambda start, rate, i, m="exact": one(spark, timebase.equidistant_ts(F.col("s"), F.col("r"), F.col("i"), m), s=start, r=rate, i=i)
    top = (1 << 63) - 1
    assert ts(1000, 3.0, 2) == 1000 + 666666666 and ts(1000, 3.0, 2, "rounded") == 1000 + 666666666 and ts(0, 7.0, 3, "rounded") == 428571429
    assert ts(5, 0.0, 9) == 5 and ts(top - 5, 1.0, 1) == top and ts(0, 1e-300, 9) == top
    assert ts(-5, 2.0, 1) == 499_999_995


def test_segments_keep_gaps(spark):
    rows = [("f", 0, 0, "start", 2, 1000, 10.0, [1.0, 2.0]), ("f", 0, 1, "continued", 1, None, None, [3.0]), ("f", 0, 2, "start", 1, 10**12, 1.0, [4.0]), ("f", 1, 0, "continued", 1, None, None, [9.0])]
    b = spark.createDataFrame(rows, "file string, channel_index int, block_ord long, kind string, n long, start_ns long, rate_hz double, values array<double>")
    got = [(r["seg"], r["ts_ns"], r["v"]) for r in timebase.expand_equidistant(b).orderBy("channel_index", "v").collect()]
    assert got == [(1, 1000, 1.0), (1, 100_001_000, 2.0), (1, 200_001_000, 3.0), (2, 10**12, 4.0), (0, None, 9.0)]
    assert {(r["channel_index"], r["code"]) for r in timebase.check_families(b).collect()} == {(1, "ContinuedDataWithoutStart")}
    mixed = b.unionByName(spark.createDataFrame([("f", 0, 9, "absolute", 1, None, None, [1.0])], b.schema))
    assert "ChannelMixedBlockTypes" in {r["code"] for r in timebase.check_families(mixed).collect()}


def test_relative_times(spark):
    df = spark.createDataFrame([("a", 0, None, 5), ("a", 1, 100, 0), ("a", 2, None, 5), ("a", 3, None, 7), ("a", 4, 50, 0), ("a", 5, None, 1)], "channel string, ord int, abs_ns long, delta_ns long")
    got = [(r["ts_ns"], r["anchored"]) for r in timebase.accumulate_relative(df).orderBy("ord").collect()]
    assert got == [(None, False), (100, True), (105, True), (112, True), (50, True), (51, True)]


# Filters


def test_filters(spark):
    c = spark.createDataFrame([(0, "GPS.lat"), (1, "gps.Lon"), (2, "Temp(1)"), (7, "3")], "channel_index int, channel string")
    names = lambda df: [r["channel"] for r in df.orderBy("channel_index").collect()]
    assert names(filters.by_mask(c, "GPS.*")) == ["GPS.lat", "gps.Lon"] and names(filters.by_mask(c, "temp(?)")) == ["Temp(1)"]
    assert filters.resolve(c, ["7", "GPS.lat", "gps.lat", "99"]) == (["3", "GPS.lat"], ["gps.lat", "99"])
    s = frame(spark, [("a", t, 1.0) for t in range(1, 6)])
    assert filters.interval(s, 2, 4).count() == 3 and filters.interval(s, 0, -1).count() == 5 and filters.interval(s, 3).count() == 3
    assert [r["ts_ns"] for r in filters.head(s, 2).orderBy("ts_ns").collect()] == [1, 2]
    assert filters.by_names(s, ["A"]).count() == 5 and filters.by_name(s, "A").count() == 0


# Functions


def test_times(spark):
    ns = 1_700_000_000_123_456_789
    f = lambda style, dialect="delphi", t=ns: one(spark, times.fmt_ts(F.col("t"), style, dialect), t=t)
    assert f("datetime") == "14.11.2023 22:13:20.123" and f("seconds") == "14.11.2023 22:13:20" and f("iso8601") == "2023-11-14T22:13:20.123456789Z"
    assert f("datetime", "java") == "2023-11-14 22:13:20.123" and f("seconds", "java") == "1700000000.123456789" and f("iso8601", "java") == "2023-11-14T22:13:20Z"
    assert f("nanoseconds") == str(ns) and f("seconds", "java", -1) == "-1.999999999" and f("iso8601", "delphi", -1) == "1969-12-31T23:59:59.999999999Z"
    with pytest.raises(ValueError):
        times.fmt_ts(F.col("t"), "weeks")
    iso = lambda s: one(spark, times.parse_iso(F.col("s")), s=s)
    assert iso("2023-11-14T22:13:20+05:00") == 1_700_000_000 * 10**9 and iso("2023-11-14") is None and iso("2023-99-14T22:13:20") is None
    d = lambda a, b: one(spark, times.duration_hms(F.col("a"), F.col("b")), a=a, b=b)
    assert d(0, 3723 * 10**9 + 5) == "1h 2m 3s" and d(5, 5) == "-" and d(9, 5) == "-"
    assert times.zoom(0, 100, 0.8) == (10, 90) and times.pan(0, 100, 0.25) == (25, 125)


def test_text(spark):
    r = lambda v: one(spark, text.render_double(F.col("v")), v=v)
    assert (r(3.0), r(-2.0), r(2.5), r(float("inf")), r(1e300)) == ("3", "-2", "2.5", "Infinity", "1.0E300") and r(float("nan")) == "NaN"
    e = lambda v: one(spark, text.csv_escape(F.col("v")), v=v)
    assert e('a"b') == '"a""b"' and e("a,b") == '"a,b"' and e("plain") == "plain" and e("a\nb") == '"a\nb"'
    assert one(spark, text.name_path(F.col("v")), v="A.B.C") == "/A/B/C" and one(spark, text.name_parts(F.col("v")), v="A.B") == ["A", "B"]
    assert one(spark, text.fmt_bytes(F.col("v")), v=1536) == "1.50 KiB" and one(spark, text.fmt_bytes(F.col("v")), v=12) == "12 B"
    assert one(spark, text.decimal_sep(F.col("v"), F.lit(False)), v="1.5") == "1.5"


def test_types(spark):
    assert one(spark, parse_datatype(F.col("v")), v="bytearray") == "binary" and one(spark, parse_datatype(F.col("v")), v="odd") == "odd"
    assert one(spark, parse_spectrum(F.col("v")), v="realImag") == "realimag" and one(spark, parse_spectrum(F.col("v")), v="?") == "amplitude"
    assert int(one(spark, reinterpret_unsigned(F.col("v")), v=-1)) == 2**64 - 1
    assert one(spark, loses_precision(F.col("v")), v="uint64") is True
    assert one(spark, axis(F.col("v"), 5, 5, 10), v=6) == 10.0 and one(spark, axis_value(F.col("v"), 0, 50, 10), v=5) == 25.0
    from chronospark.functions.types import SAMPLES

    row = {f.name: None for f in SAMPLES} | {"datatype": "gpslocation", "v_gps": (1.0, 2.0, 3.0)}
    blob = {f.name: None for f in SAMPLES} | {"datatype": "binary", "v_binary": bytearray(b"abc")}
    flag = {f.name: None for f in SAMPLES} | {"datatype": "bool", "v_bool": True}
    df = spark.createDataFrame([tuple(x.values()) for x in (row, blob, flag)], SAMPLES)
    assert [r[0] for r in df.select(value_as_string()).collect()] == ["lat=1.0 lon=2.0 alt=3.0", "<3 bytes>", "True"]
    assert [r[0] for r in df.select(numeric()).collect()] == [None, None, 1.0]
