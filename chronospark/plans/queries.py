"""One entry per operator; each callable takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as text_functions
from ..functions import times
from ..functions.bands import axis, band_index
from ..operators import align, decimate, filters, merge, ordered, stale, stats, timebase, verify
from ..operators.asof import asof
from .tables import CHANNELS, event_blocks, hourly, packed_blocks, samples, table, two_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

S = "with s as (select event_id, event_type as channel, epoch_us(ts)*1000 as ts_ns, value as v from events)"
T0, T1 = 1_704_067_200_000_000_000, 1_706_659_200_000_000_000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# Choosing and ordering


@query(f"{S} select event_id, channel, ts_ns, v from s where lower(channel) in ('click', 'view')")
def channel_filter(spark, sf_dir):
    return filters.by_names(samples(spark, sf_dir), ["CLICK", "View"]).withColumnRenamed("ord", "event_id")


@query("select p_partkey, p_name from part where regexp_matches(lower(p_name), '^.*a.e.*$')")
def channel_mask(spark, sf_dir):
    return filters.by_mask(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "*a?e*", "p_name")


@query(f"{S} select event_id, ts_ns, v from s where channel = 'purchase'")
def channel_by_name(spark, sf_dir):
    return filters.by_name(samples(spark, sf_dir), "purchase").select(F.col("ord").alias("event_id"), "ts_ns", "v")


@query(f"{S} select event_id, channel, ts_ns from s where ts_ns between 1704672000000000000 and 1705276800000000000")
def sample_interval(spark, sf_dir):
    week = (1704672000000000000, 1705276800000000000)
    return filters.interval(samples(spark, sf_dir, *week), *week).select(F.col("ord").alias("event_id"), "channel", "ts_ns")


@query("""
with t as (select o_orderkey, case o_orderkey % 5 when 0 then 'double' when 1 then 'int64' when 2 then 'string' when 3 then 'gpslocation' else 'uint64' end as datatype from orders)
select o_orderkey, datatype, datatype in ('int64', 'uint64') as loses_precision from t where datatype in ('double', 'int64', 'uint64')
""")
def numeric_only(spark, sf_dir):
    from ..functions.types import loses_precision

    names = F.array(*[F.lit(x) for x in ("double", "int64", "string", "gpslocation", "uint64")])
    typed = table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(names, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("datatype"))
    return filters.numeric_only(typed).withColumn("loses_precision", loses_precision(F.col("datatype")))


@query(f"{S} select channel, event_id, ts_ns, v from s qualify row_number() over (partition by channel order by event_id) <= 5")
def head_per_channel(spark, sf_dir):
    return filters.head(samples(spark, sf_dir), 5).withColumnRenamed("ord", "event_id")


@query(f"{S} select channel, count(*) n from s group by 1 order by n desc, channel limit 3")
def top_channels(spark, sf_dir):
    return stats.top_channels(samples(spark, sf_dir), 3)


@query("select p_type, count(*) n from part where exists (select 1 from lineitem where l_partkey = p_partkey) group by 1")
def non_empty_channels(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("channel"), "p_type")
    found = filters.non_empty(parts, table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("channel")))
    return found.groupBy("p_type").agg(F.count("*").alias("n"))


# Merging


def _merged(keep: str) -> str:
    return f"""{S}, u as (select 0 f, event_id, lower(channel) channel, ts_ns - ts_ns % 3600000000000 ts_ns, v from s where event_id % 3 <> 0
union all select 1, event_id, lower(channel), ts_ns - ts_ns % 3600000000000, v+1000 from s where event_id % 2 = 0)
select channel, ts_ns, v from u qualify row_number() over (partition by channel, ts_ns order by f {keep}, event_id {keep}) = 1"""


@query(_merged("asc"))
def merge_skip(spark, sf_dir):
    return merge.merge(two_files(spark, sf_dir))


@query(_merged("desc"))
def merge_overwrite(spark, sf_dir):
    return merge.merge(two_files(spark, sf_dir), overlap="overwrite")


def _typed_files(spark, sf_dir):
    """File 1 has the channel "error" as text, so its samples of that channel go."""
    rows = two_files(spark, sf_dir).withColumn("file", F.concat(F.lit("f"), F.col("file_rank").cast("string")))
    definitions = rows.groupBy("file", "file_rank", "channel").agg(F.min("ord").alias("channel_pos"))
    bad = (F.col("file_rank") == 1) & (F.col("channel") == "error")
    definitions = definitions.withColumn("datatype", F.when(bad, "string").otherwise("double"))
    return rows, definitions


@query(f"""{S}, u as (select 0 f, event_id, channel, ts_ns - ts_ns % 3600000000000 ts_ns, v from s where event_id % 3 <> 0
union all select 1, event_id, channel, ts_ns - ts_ns % 3600000000000, v+1000 from s where event_id % 2 = 0 and channel <> 'error')
select channel, ts_ns, v from u qualify row_number() over (partition by channel, ts_ns order by f, event_id) = 1""")
def merge_type_mismatch(spark, sf_dir):
    rows, definitions = _typed_files(spark, sf_dir)
    good, _ = merge.split_mismatches(rows, definitions, merge.merged_schema(definitions))
    return merge.merge(good)


@query("select 'f1' as file, 'error' as key, 'string' as found, 'double' as expected")
def merge_warnings(spark, sf_dir):
    rows, definitions = _typed_files(spark, sf_dir)
    return merge.split_mismatches(rows, definitions, merge.merged_schema(definitions))[1]


@query("select distinct epoch_us(l_shipdate)*1000 as ts_ns from lineitem")
def distinct_timeline(spark, sf_dir):
    return align.timeline(table(spark, sf_dir, "lineitem").select(times.from_timestamp(F.col("l_shipdate")).alias("ts_ns")))


# Aligning and as-of


@query(f"""{S} select ts_ns - ts_ns % 3600000000000 as ts_ns, arg_max(v, event_id) filter (channel='click') as click, arg_max(v, event_id) filter (channel='error') as error,
arg_max(v, event_id) filter (channel='purchase') as purchase, arg_max(v, event_id) filter (channel='signup') as signup, arg_max(v, event_id) filter (channel='view') as view from s group by 1""")
def align_wide(spark, sf_dir):
    return align.align_wide(hourly(samples(spark, sf_dir)), CHANNELS)


@query(f"""{S}, r as (select *, row_number() over (partition by channel order by event_id)-1 i from s) select i, max(v) filter (channel='click') as click, max(v) filter (channel='error') as error,
max(v) filter (channel='purchase') as purchase, max(v) filter (channel='signup') as signup, max(v) filter (channel='view') as view from r group by 1""")
def align_row_index(spark, sf_dir):
    return align.align_by_index(samples(spark, sf_dir), CHANNELS)


NEAR = f"""{S}, p as (select event_id, ts_ns, v as pv from s where channel='purchase'), c as (select ts_ns, v from s where channel='click'),
lo as (select p.event_id, p.ts_ns, p.pv, c.ts_ns t0, c.v v0 from p asof left join c on p.ts_ns >= c.ts_ns),
hi as (select p.event_id, c.ts_ns t1, c.v v1 from p asof left join c on p.ts_ns <= c.ts_ns), j as (select * from lo join hi using (event_id))"""
LERP = "case when t0 is null then v1 when t1 is null or t1=t0 then v0 else v0+(v1-v0)*((ts_ns-t0)/cast(t1-t0 as double)) end"


def _asof(spark, sf_dir, method):
    rows = samples(spark, sf_dir)
    found = asof(filters.by_name(rows, "purchase").select("ord", "ts_ns", "v"), filters.by_name(rows, "click"), method)
    return found.select(F.col("ord").alias("event_id"), F.col("found").alias("v"))


@query(f"{NEAR} select event_id, v0 as v from j")
def asof_zoh(spark, sf_dir):
    return _asof(spark, sf_dir, "zoh")


@query(f"{NEAR} select event_id, {LERP} as v from j")
def asof_linear(spark, sf_dir):
    return _asof(spark, sf_dir, "linear")


@query(f"{NEAR} select event_id, case when t0 is null then v1 when t1 is null then v0 when ts_ns-t0<=t1-ts_ns then v0 else v1 end as v from j")
def asof_nearest(spark, sf_dir):
    return _asof(spark, sf_dir, "nearest")


BAND = "case when {0}<30 then 0 when {0}<50 then 1 when {0}<80 then 2 when {0}<110 then 3 else 4 end"


@query(f"{NEAR}, k as (select pv, {LERP} as b from j) select {BAND.format('b')} as band, count(*) n, avg(pv) mean, max(pv) vmax from k where b is not null group by 1")
def band_conditional_stats(spark, sf_dir):
    rows = samples(spark, sf_dir)
    return stats.band_stats(filters.by_name(rows, "purchase"), filters.by_name(rows, "click"))


@query(f"{S}, n as (select channel, count(*) n, min(ts_ns) first_ts from s group by 1) select event_type as channel, event_id, n from events join n on lower(event_type) = lower(channel)")
def channel_catalog_join(spark, sf_dir):
    from ..sources.catalog import with_catalog

    rows = samples(spark, sf_dir)
    known = rows.groupBy("channel").agg(F.count("*").alias("n"), F.min("ts_ns").alias("first_ts"), F.max("ts_ns").alias("last_ts"))
    return with_catalog(rows, known).select("channel", F.col("ord").alias("event_id"), "n")


# Statistics


@query(f"{S} select channel, count(*) n, min(v) vmin, max(v) vmax, avg(v) mean, coalesce(stddev_samp(v),0.0) sd from s where ts_ns between 1704672000000000000 and 1705276800000000000 group by 1")
def channel_stats(spark, sf_dir):
    week = (1704672000000000000, 1705276800000000000)
    return stats.channel_stats(samples(spark, sf_dir, *week), *week)


@query(f"{S} select channel, min(v) vmin, max(v) vmax, avg(v) mean, median(v) med from s group by 1")
def median_stats(spark, sf_dir):
    return stats.describe_numeric(samples(spark, sf_dir))


@query(f"{S} select min(ts_ns) first_ts, max(ts_ns) last_ts from s")
def extent(spark, sf_dir):
    return stats.extent(samples(spark, sf_dir))


@query(f"{S} select channel, min(v) lo, max(v) hi from s group by 1")
def y_range(spark, sf_dir):
    return stats.y_range(samples(spark, sf_dir))


@query(f"{S} select channel, min(ts_ns) first_ts, max(ts_ns) last_ts from s group by 1")
def time_range(spark, sf_dir):
    return timebase.time_range(samples(spark, sf_dir))


@query(f"{S}, r as (select channel, min(ts_ns) a, max(ts_ns) b from s group by 1), q as (select channel, (b-a)//1000000000 d from r) select channel, printf('%dh %dm %ds', d//3600, d%3600//60, d%60) duration from q")
def duration(spark, sf_dir):
    r = timebase.time_range(samples(spark, sf_dir))
    return r.select("channel", times.duration_hms(F.col("first_ts"), F.col("last_ts")).alias("duration"))


@query(f"{S}, d as (select *, lead(ts_ns) over (partition by channel order by ts_ns, event_id) - ts_ns dur from s) select event_id, channel, dur as dur_ns from d")
def forward_diff(spark, sf_dir):
    return stats.forward_diff(samples(spark, sf_dir)).select(F.col("ord").alias("event_id"), "channel", "dur_ns")


OCCUPANCY = f"{S}, d as (select *, lead(ts_ns) over (partition by channel order by ts_ns, event_id) - ts_ns d from s), o as (select channel, {BAND.format('v')} band, cast(sum(d) as bigint) dur_ns from d where d is not null group by 1,2)"


@query(f"{OCCUPANCY} select * from o")
def band_occupancy(spark, sf_dir):
    return stats.band_occupancy(samples(spark, sf_dir))


@query(f"{OCCUPANCY} select channel, band, dur_ns/1e9 as seconds, dur_ns*100.0/sum(dur_ns) over (partition by channel) as share from o")
def band_shares(spark, sf_dir):
    return stats.band_shares(stats.band_occupancy(samples(spark, sf_dir)))


@query(f"{S} select event_id, {BAND.format('v')} as band from s")
def band_series(spark, sf_dir):
    return samples(spark, sf_dir).select(F.col("ord").alias("event_id"), band_index(F.col("v"), stats.BOUNDS).alias("band"))


@query(f"{S} select channel, min(ts_ns) filter (v>=200) - min(ts_ns) elapsed_ns from s group by 1")
def first_crossing(spark, sf_dir):
    return stats.first_crossing(samples(spark, sf_dir), 200)


@query(f"{S} select channel, ts_ns - ts_ns % 86400000000000 w, min(v) lo, max(v) hi, avg(v) mean, stddev_samp(v) sd from s group by 1,2")
def window_summary(spark, sf_dir):
    return stats.window_summary(samples(spark, sf_dir), 86_400_000_000_000)


@query(f"{S}, w as (select channel, ts_ns - ts_ns % 86400000000000 w, max(v) hi, min(v) lo, avg(v) mean, stddev_samp(v) sd, regr_slope(v, ts_ns/1e9) k from s group by 1,2) select channel, w, case when k > 0 then 'up' when k < 0 then 'down' else 'flat' end direction, coalesce(hi-mean > 3*sd or mean-lo > 3*sd, false) anomaly from w")
def window_trend(spark, sf_dir):
    return stats.window_summary(samples(spark, sf_dir), 86_400_000_000_000, trend=True).select("channel", "w", "direction", "anomaly")


@query("select split_part(p_type, ' ', 1) a, split_part(p_type, ' ', 2) b, count(*) n from part group by rollup (1, 2)")
def namespace_rollup(spark, sf_dir):
    parts = F.split("p_type", " ")
    named = table(spark, sf_dir, "part").select(F.get(parts, 0).alias("a"), F.coalesce(F.get(parts, 1), F.lit("")).alias("b"))
    return named.rollup("a", "b").agg(F.count("*").alias("n"))


# Fewer samples


@query(f"{S} select channel, cast(((cast(ts_ns-{T0}+1 as hugeint)*97) - 1) // {T1 - T0} as bigint) px, min(v) lo, max(v) hi from s where ts_ns>={T0} and ts_ns<{T1} group by 1,2")
def decimate_pixels(spark, sf_dir):
    return decimate.decimate(samples(spark, sf_dir, T0, T1), T0, T1, 97)


@query(f"""{S}, d as (select channel, cast(((cast(ts_ns-{T0}+1 as hugeint)*3000) - 1) // {T1 - T0} as bigint) px, min(v) lo, max(v) hi from s where ts_ns>={T0} and ts_ns<{T1} group by 1,2)
select c.channel, p.px, lo, hi, lo is not null as has_data from (select distinct channel from s) c cross join (select unnest(range(3000)) px) p left join d on d.channel = c.channel and d.px = p.px""")
def decimate_all_pixels(spark, sf_dir):
    return decimate.decimate(samples(spark, sf_dir), T0, T1, 3000, all_pixels=True)


@query(f"{S}, r as (select *, row_number() over (partition by channel order by event_id)-1 i, count(*) over (partition by channel) n from s) select event_id, channel, v from r where i % (case when n > 100 then n // 100 else 1 end) = 0")
def every_nth(spark, sf_dir):
    return decimate.every_nth(samples(spark, sf_dir), 100).select(F.col("ord").alias("event_id"), "channel", "v")


@query(f"""{S}, r as (select *, row_number() over (partition by channel order by event_id)-1 i, count(*) over (partition by channel) n from s),
x as (select channel, i, v, n, unnest(range(greatest(0, (i-32+24)//24), i//24+1)) win from r)
select channel, win, sum(v) total, count(*) n, min(i) first_i from x where i >= win*24 and i < win*24+32 and win*24+32 <= n group by 1,2""")
def sliding_windows(spark, sf_dir):
    w = decimate.sliding_windows(samples(spark, sf_dir), 32, 24)
    total = F.aggregate("values", F.lit(0.0), lambda a, b: a + b)
    return w.select("channel", "win", total.alias("total"), F.size("values").cast("long").alias("n"), (F.col("win") * 24).alias("first_i"))


@query(f"{S}, g as (select *, lead(ts_ns) over (partition by channel order by ts_ns,event_id) nx from s) select channel, ts_ns + k*3600000000000 as ts_ns, v from g, unnest(range(1, (nx-ts_ns-1)//3600000000000 + 1)) t(k) where nx-ts_ns > 3600000000000")
def stale_reemit(spark, sf_dir):
    return stale.reemit_stale(samples(spark, sf_dir), 3_600_000_000_000)


# Time base


@query(f"""{S}, r as (select *, row_number() over (partition by channel order by event_id)-1 rn from s), q as (select *, rn//40 + 1 seg, rn%40 i from r), z as (select channel, seg, min(ts_ns) filter (i<10) start_ns from q group by 1,2)
select channel, cast(seg as bigint) seg, start_ns + cast(trunc(i*1e9/3.0) as bigint) ts_ns, v from q join z using (channel, seg)""")
def timebase_expand(spark, sf_dir):
    out = timebase.expand_equidistant(packed_blocks(spark, sf_dir), keys=("channel",))
    return out.select("channel", "seg", "ts_ns", "v")


@query(f"""{S}, r as (select *, row_number() over (partition by channel order by event_id)-1 rn from s), q as (select *, rn//40 + 1 seg, rn%40 i from r), z as (select channel, seg, min(ts_ns) filter (i<10) start_ns from q group by 1,2)
select channel, cast(seg as bigint) seg, start_ns + i*333333333 ts_ns, v from q join z using (channel, seg)""")
def timebase_rounded(spark, sf_dir):
    out = timebase.expand_equidistant(packed_blocks(spark, sf_dir), keys=("channel",), model="rounded")
    return out.select("channel", "seg", "ts_ns", "v")


@query(f"""{S}, d as (select event_id, channel, case when event_id % 50 = 0 then ts_ns end abs_ns, event_id % 977 * 1000 delta from s),
e as (select *, count(abs_ns) over (partition by channel order by event_id) k from d)
select event_id, channel, case when k > 0 then first_value(abs_ns) over w + cast(coalesce(sum(case when abs_ns is null then delta else 0 end) over w, 0) as bigint) end ts_ns from e window w as (partition by channel, k order by event_id rows unbounded preceding)""")
def rel_stamp_accumulate(spark, sf_dir):
    rows = samples(spark, sf_dir).select("ord", "channel", F.when(F.col("ord") % 50 == 0, F.col("ts_ns")).alias("abs_ns"), (F.col("ord") % 977 * 1000).alias("delta_ns"))
    return timebase.accumulate_relative(rows).select(F.col("ord").alias("event_id"), "channel", "ts_ns")


@query("""with l as (select *, lag(epoch_us(l_shipdate)) over (partition by l_returnflag order by l_orderkey,l_linenumber,l_partkey,l_suppkey,l_extendedprice,epoch_us(l_shipdate)) > epoch_us(l_shipdate) b from lineitem)
select l_returnflag, count(*) filter (b) n_back from l group by 1""")
def backward_steps(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("t", F.unix_micros(F.col("l_shipdate").cast("timestamp")))
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "t"]
    return verify.backward_steps(lines, ["l_returnflag"], order, "t", ordered.id_bucket(F.col("l_orderkey")))


# Reading telemetry and catalog

BLOCKS = f"""{S}, b as (select channel, event_id//100 k, count(*) n, min(ts_ns) first_ts, max(ts_ns) last_ts from s group by 1,2),
x as (select 'f' || (k%3) as file, k, list_position(['click','error','purchase','signup','view'], channel)-1 as channel_index, n*16+5 as length, case when k%4=0 then 'start' else 'continued' end kind, n, first_ts, last_ts,
case when k%7=3 then 'ZeroLengthBlock' when k%11=5 then 'CrcMismatch' when k%13=6 then 'StatusEvent' end skip_reason from b)"""


@query(f"""{BLOCKS} select file, cast(channel_index as int) channel_index, count(*) filter (skip_reason is null) blocks_read, count(*) filter (skip_reason is not null) blocks_skipped,
cast(coalesce(sum(n) filter (skip_reason is null),0) as bigint) samples_total, cast(coalesce(sum(length) filter (skip_reason is null),0) as bigint) bytes_payload, count(*) filter (skip_reason is null and kind='start') segments,
min(first_ts) filter (skip_reason is null) first_ts, max(last_ts) filter (skip_reason is null) last_ts from x group by 1,2""")
def reader_telemetry(spark, sf_dir):
    return stats.channel_telemetry(event_blocks(spark, sf_dir))


@query(f"""{BLOCKS} select file, count(*) blocks_total, count(*) filter (skip_reason is null) blocks_read, count(*) filter (skip_reason='ZeroLengthBlock') zero, count(*) filter (skip_reason='CrcMismatch') crc,
count(*) filter (skip_reason='StatusEvent') status, count(distinct channel_index) filter (skip_reason is null and n>0) channels_with_data from x group by 1""")
def file_telemetry(spark, sf_dir):
    t = stats.file_telemetry(event_blocks(spark, sf_dir))
    return t.select("file", "blocks_total", "blocks_read", F.col("skipped_ZeroLengthBlock").alias("zero"), F.col("skipped_CrcMismatch").alias("crc"), F.col("skipped_StatusEvent").alias("status"), "channels_with_data")


@query(f"{BLOCKS} select file, case when file='f0' then 'none' when count(*) filter (skip_reason='CrcMismatch') > 0 then 'invalid' when file='f2' then 'signature_unverifiable' else 'crc_valid' end status from x group by 1")
def verification_status(spark, sf_dir):
    t = stats.file_telemetry(event_blocks(spark, sf_dir))
    level = F.when(F.col("file") == "f0", "none").when(F.col("file") == "f2", "signed").otherwise("crc32c")
    return t.select("file", stats.verification_status(level, F.col("skipped_CrcMismatch")).alias("status"))


FILES = f"{S}, c as (select 'u' || (event_id % 40) as file, channel, count(*) n, min(ts_ns) first_ts, max(ts_ns) last_ts from s group by 1,2)"


def _catalog(spark, sf_dir):
    return samples(spark, sf_dir).groupBy(F.concat(F.lit("u"), (F.col("ord") % 40).cast("string")).alias("file"), "channel").agg(F.count("*").alias("n"), F.min("ts_ns").alias("first_ts"), F.max("ts_ns").alias("last_ts"))


@query(f"{FILES} select * from c")
def catalog_build(spark, sf_dir):
    return _catalog(spark, sf_dir)


@query(f"{FILES} select file, channel from c where last_ts >= {T0 + 86400 * 10**9} and first_ts <= {T0 + 2 * 86400 * 10**9} ")
def catalog_prune(spark, sf_dir):
    return _catalog(spark, sf_dir).where(filters.overlaps(T0 + 86400 * 10**9, T0 + 2 * 86400 * 10**9)).select("file", "channel")


@query(f"{FILES}, f as (select file, min(first_ts) first_ts from c group by 1) select file, first_ts, cast(row_number() over (order by first_ts, file) - 1 as int) file_rank from f")
def file_order(spark, sf_dir):
    return merge.file_rank(_catalog(spark, sf_dir).groupBy("file").agg(F.min("first_ts").alias("first_ts")))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def info_from_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# Text


@query(f"{S} select event_id, strftime(make_timestamp(ts_ns//1000),'%Y-%m-%dT%H:%M:%S') || '.' || lpad(cast(ts_ns % 1000000000 as varchar),9,'0') || 'Z' t from s")
def iso9(spark, sf_dir):
    return samples(spark, sf_dir).select(F.col("ord").alias("event_id"), times.fmt_ts(F.col("ts_ns"), "iso8601").alias("t"))


@query(f"{S} select event_id, strftime(make_timestamp(ts_ns//1000),'%d.%m.%Y %H:%M:%S.%g') a, strftime(make_timestamp(ts_ns//1000),'%Y-%m-%d %H:%M:%S.%g') b from s")
def fmt_datetime(spark, sf_dir):
    ts = F.col("ts_ns")
    return samples(spark, sf_dir).select(F.col("ord").alias("event_id"), times.fmt_ts(ts).alias("a"), times.fmt_ts(ts, dialect="java").alias("b"))


@query(f"{S} select event_id, strftime(make_timestamp(ts_ns//1000),'%d.%m.%Y %H:%M:%S') a, (ts_ns//1000000000) || '.' || lpad(cast(ts_ns % 1000000000 as varchar),9,'0') b, strftime(make_timestamp(ts_ns//1000),'%Y-%m-%dT%H:%M:%SZ') c, cast(ts_ns as varchar) d from s")
def fmt_seconds(spark, sf_dir):
    ts = F.col("ts_ns")
    styles = (("seconds", "delphi"), ("seconds", "java"), ("iso8601", "java"), ("nanoseconds", "delphi"))
    return samples(spark, sf_dir).select(F.col("ord").alias("event_id"), *[times.fmt_ts(ts, *x).alias(n) for x, n in zip(styles, "abcd")])


@query("select event_id, cast(epoch_us(date_trunc('second', ts))*1000 as bigint) as ts_ns from events")
def parse_iso(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", times.parse_iso(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("ts_ns"))


@query("select o_orderkey, replace(cast(cast(o_totalprice as decimal(12,2)) as varchar), '.', ',') t from orders")
def decimal_comma(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text_functions.decimal_sep(F.col("o_totalprice").cast("decimal(12,2)").cast("string"), F.lit(True)).alias("t"))


@query("""select doc_id, case when text like '%,%' or text like '%"%' or text like '%' || chr(10) || '%' or text like '%' || chr(13) || '%' then '"' || replace(text, '"', '""') || '"' else text end t from documents""")
def csv_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text_functions.csv_escape(F.col("text")).alias("t"))


@query("select l_orderkey, l_linenumber, case when l_quantity = round(l_quantity) then cast(cast(l_quantity as bigint) as varchar) else cast(l_quantity as varchar) end q, case when l_discount = round(l_discount) then cast(cast(l_discount as bigint) as varchar) else cast(l_discount as varchar) end d from lineitem")
def render_integral(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text_functions.render_double(F.col("l_quantity")).alias("q"), text_functions.render_double(F.col("l_discount")).alias("d"))


@query("select p_partkey, '/' || replace(p_type, ' ', '/') as path from part")
def namespace_path(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text_functions.name_path(F.col("p_type"), " ").alias("path"))


@query(f"{S} select event_id, (ts_ns - {T0}) / cast({T1 - T0} as double) * 800 as x from s")
def time_axis(spark, sf_dir):
    return samples(spark, sf_dir).select(F.col("ord").alias("event_id"), axis(F.col("ts_ns"), T0, T1, 800).alias("x"))
