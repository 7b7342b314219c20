import json
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronospark import cli
from chronospark.functions.types import numeric
from chronospark.operators import verify
from chronospark.sources import catalog, export, merging, recordings
from chronospark.sources.recordings import convert, read, register, sniff, with_rates, write
from chronospark.sources.views import Options, rows
from tests.recordings import START, mixed, simple, times


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.osf").write_bytes(mixed())
    (tmp_path / "sub" / "b.osfz").write_bytes(mixed(4, compression="gzip"))
    (tmp_path / "broken.osf").write_bytes(b"not a recording")
    (tmp_path / "notes.txt").write_text("x")
    return tmp_path


def test_read_views(spark, folder):
    path = f"file://{folder}"
    s = read(spark, path)
    assert s.groupBy("file").count().count() == 2 and s.count() == 2 * 803
    assert read(spark, path, "files").where("error is not null").count() == 1
    assert read(spark, path, "channels").count() == 18
    assert read(spark, path, channels=["sensor/counter"]).count() == 200
    assert {r["version"] for r in sniff(spark, path).where("file not like '%txt'").collect()} == {4, 5, None}
    assert read(spark, path, "blocks").where("skip_reason is not null").count() == 0
    with pytest.raises(Exception, match="FormatError"):
        read(spark, path, mode="FAILFAST").count()


def test_data_source(spark, folder, tmp_path):
    register(spark)
    df = spark.read.format("recording").load(str(folder))
    assert df.count() == 2 * 803
    assert spark.read.format("recording").option("view", "channels").load(str(folder)).count() == 18
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = spark.read.format("recording").option("pushdown", "true").load(str(folder))
        got = pushed.where((F.col("channel") == "Sensor/Counter") & (F.col("ts_ns") >= times(100)[90]))
        assert got.count() == 20
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


@pytest.mark.parametrize("version,integrity,compression", [(5, "crc32c", None), (4, "none", "gzip")])
def test_write_and_convert(spark, folder, tmp_path, version, integrity, compression):
    out = tmp_path / "out"
    convert(spark, f"file://{folder}/a.osf", str(out), version, integrity, compression)
    assert len(list(out.iterdir())) == 1
    keep = ["channel", "ts_ns", "v_double", "v_long", "v_ulong", "v_bool", "v_string", "v_binary", "mode"]
    a, b = read(spark, f"file://{folder}/a.osf").select(*keep), read(spark, f"file://{out}").select(*keep)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert read(spark, f"file://{out}", "files").first()["version"] == version
    assert {r["physical_unit"] for r in read(spark, f"file://{out}", "channels").collect()} == {"°C", "m/s²", None}


def test_catalog(spark, tmp_path):
    data, at = tmp_path / "data", f"file://{tmp_path}/catalog"
    data.mkdir()
    for i in range(3):
        (data / f"{i}.osf").write_bytes(simple("A", [START + i * 10**9, START + i * 10**9 + 5], [1.0, 2.0]))
    path = f"file://{data}"
    c = catalog.refresh(spark, path, at)
    assert c.count() == 3 and c.agg(F.sum("n")).first()[0] == 6
    assert [r["file"][-5:] for r in catalog.prune(c, START + 10**9, START + 10**9 + 3).collect()] == ["1.osf"]
    (data / "3.osf").write_bytes(simple("A", [START], [7.0]))
    (data / "bad.osf").write_bytes(b"OSF5 nothing\n")
    states = {r["file"][-5:]: r["status"] for r in catalog.status(catalog.load(spark, at), catalog.listing(spark, path)).collect()}
    assert states == {"0.osf": "valid", "1.osf": "valid", "2.osf": "valid", "3.osf": "missing", "d.osf": "missing"}
    c = catalog.refresh(spark, path, at)
    assert c.count() == 5 and c.where("error is not null").count() == 1
    c = catalog.refresh(spark, path, at)
    assert c.count() == 5
    assert catalog.with_catalog(read(spark, path, "channels"), c).where("n = 7").count() == 4


def test_merge_files(spark, tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    t = [START + i for i in range(6)]
    (data / "x.osf").write_bytes(simple("Chan", t[:4], [0.0, 1.0, 2.0, 3.0]))
    (data / "y.osf").write_bytes(simple("CHAN", t[2:], [20.0, 30.0, 40.0, 50.0]))
    (data / "z.osf").write_bytes(simple("chan", t, ["s"] * 6, "string"))
    (data / "far.osf").write_bytes(simple("chan", [START + 10**12], [9.0]))
    (data / "corrupt.osf").write_bytes(b"??")
    path = f"file://{data}"
    got, warnings = merging.merge(spark, path, START, START + 5)
    values = lambda df: [r["v_double"] for r in df.orderBy("ts_ns").collect()]
    assert values(got) == [0.0, 1.0, 2.0, 3.0, 40.0, 50.0]
    assert [(r["found"], r["expected"]) for r in warnings.collect()] == [("string", "double")]
    assert values(merging.merge(spark, path, START, START + 5, overlap="overwrite")[0]) == [0.0, 1.0, 20.0, 30.0, 40.0, 50.0]
    for bad in ((5, 5), (1, 2)):
        with pytest.raises(ValueError):
            merging.merge(spark, path, *bad)
    merging.merge_to_file(spark, path, str(tmp_path / "out"), "merged", START, START + 5)
    again = read(spark, f"file://{tmp_path}/out")
    assert values(again) == [0.0, 1.0, 2.0, 3.0, 40.0, 50.0] and {r["channel"] for r in again.collect()} == {"Chan"}


def test_rates_follow_segments(spark, folder):
    path = f"file://{folder}/a.osf"
    rated = with_rates(read(spark, path), read(spark, path, "blocks")).where("mode = 'equidistant'")
    assert {(r["seg_id"], r["rate_hz"]) for r in rated.collect()} == {(0, 100.0), (1, 3.0)}


def _text(path, encoding="utf-8"):
    parts = sorted((path / "head").glob("part-*")) + sorted((path / "body").glob("part-*"))
    return "".join(p.read_bytes().decode(encoding) for p in parts)


def test_csv_layouts(spark, tmp_path):
    data = tmp_path / "d"
    data.mkdir()
    t = [START, START + 500_000_000, START + 10**9]
    from chronospark.sources.encode import Writer

    w = Writer()
    w.add_samples(w.add_channel("A", "double", physical_unit="°C", comment="c"), t, [1.5, 2.0, 3.0])
    w.add_samples(w.add_channel('B,"x"', "int16"), t[1:2], [7])
    (data / "a.osf").write_bytes(w.to_bytes())
    s = read(spark, f"file://{data}").withColumn("v", numeric())
    channels = [{"channel": "A", "physical_unit": "°C", "comment": "c"}, {"channel": 'B,"x"'}]
    export.write_lines(*export.classic(s, channels), f"file://{tmp_path}/classic", "iso-8859-1", "\r\n")
    lines = _text(tmp_path / "classic", "latin-1").split("\r\n")
    assert lines[0] == 'Name:;time;A;time;B,"x"' and lines[3] == "Unit:;s;°C;s;" and lines[6] == "" and lines[7] == ";X-Values;Y-Values;X-Values;Y-Values"
    assert lines[8] == ";14.11.2023 22:13:20.000;1,5;14.11.2023 22:13:20.500;7" and lines[9] == ";14.11.2023 22:13:20.500;2,0;;"
    export.write_lines(*export.unified(s, channels, style="iso8601"), f"file://{tmp_path}/unified")
    assert _text(tmp_path / "unified").split("\n")[:4] == ['Timestamp;A;B,"x"', "ISO8601;°C;", "2023-11-14T22:13:20.000000000Z;1,5;", "2023-11-14T22:13:20.500000000Z;2,0;7"]
    export.write_lines(*export.unified(s, channels, ",", style="seconds", dialect="java"), f"file://{tmp_path}/java")
    assert _text(tmp_path / "java").split("\n")[:3] == ['timestamp,A,"B,""x"""', "1700000000.000000000,1.5,", "1700000000.500000000,2,7"]
    export.write_per_channel(s, f"file://{tmp_path}/per")
    assert (tmp_path / "per" / "channel=A").is_dir()
    with pytest.raises(RuntimeError):
        export.to_hdf5(s, str(tmp_path))


def test_verify(spark, tmp_path):
    from chronospark.sources.encode import Writer

    w = Writer(5, "crc32c")
    a = w.add_channel("A", "double")
    w.add_segment(a, 1000, 1.0, [1.0])
    w.add_segment(a, 500, 1.0, [2.0])
    data = bytearray(w.to_bytes())
    (tmp_path / "back.osf").write_bytes(data)
    data[-1] ^= 1
    (tmp_path / "crc.osf").write_bytes(data)
    (tmp_path / "cut.osf").write_bytes(w.to_bytes()[:-3])
    path = f"file://{tmp_path}"
    found = verify.verify(read(spark, path, "blocks"), read(spark, path, "files"))
    got = {(r["file"][-8:], r["code"]) for r in found.collect()}
    assert {("back.osf", "start_backward"), ("/crc.osf", "CrcMismatch"), ("/cut.osf", "truncated")} <= got
    assert verify.exit_code(found) == 4
    cut = verify.verify(read(spark, f"{path}/cut.osf", "blocks"), read(spark, f"{path}/cut.osf", "files"))
    assert verify.exit_code(cut) == 0 and verify.exit_code(cut, strict=True) == 4


def test_command_line(spark, folder, tmp_path, capsys, monkeypatch):
    monkeypatch.setenv("CHRONOSPARK_CONFIG", str(tmp_path / "config.json"))
    run = lambda *a: cli.main([str(x) for x in a], spark)
    one = f"file://{folder}/a.osf"
    assert run("--json", "info", one) == 0
    info = json.loads(capsys.readouterr().out)
    assert info["samples"] == 803 and info["version"] == 5
    assert run("--json", "channels", one, "--filter", "*c?unt*") == 0
    assert [json.loads(x)["channel"] for x in capsys.readouterr().out.splitlines()] == ["Sensor/Counter"]
    assert run("--json", "stat", one, "Sensor/Counter", "Sensor/Empty") == 0
    rows = {r["channel"]: r for r in map(json.loads, capsys.readouterr().out.splitlines())}
    assert rows["Sensor/Counter"]["mean"] == 49.5 and rows["Sensor/Empty"]["n"] == 0
    assert run("dump", one, "1", "nothing", "--limit", 2) == 0 and run("dump", one, "nothing") == 2
    steps = []
    cli.LISTENERS.append(lambda *x: steps.append(x[:2]))
    assert run("verify", one, "--strict") == 0
    cli.LISTENERS.clear()
    assert steps == [("verify", "started"), ("verify", "done")]
    assert run("verify", f"file://{folder}", "--strict") == 4
    assert run("convert", one, tmp_path / "c", "--v4") == 0
    assert run("export", one, f"file://{tmp_path}/u", "--format", "unified-csv") == 0
    assert run("export", one, f"file://{tmp_path}/u", "--start", "2023-11-14T00:00:00") == 1
    assert run("cache", "build", f"file://{folder}", f"file://{tmp_path}/cat") == 0
    capsys.readouterr()
    assert run("cache", "status", f"file://{folder}", f"file://{tmp_path}/cat") == 0
    assert capsys.readouterr().out.count("valid") == 4  # with the converted one
    assert run("info", f"file://{folder}/broken.osf") == 4
    assert run("info", "file:///nowhere/at/all") == 2
    assert run("nonsense") == 1
    assert run("config", "output.overlap", "overwrite") == 0 and run("config", "output.overlap") == 0 and run("config", "x") == 1
    assert "overwrite" in capsys.readouterr().out
    assert run("merge", f"file://{folder}/sub", tmp_path / "m" / "all", "--no-cache") == 0
    assert read(spark, f"file://{tmp_path}/m").where("channel = 'Sensor/Counter'").count() == 100


def test_stream_of_growing_files(spark, tmp_path):
    register(spark)
    data = tmp_path / "in"
    data.mkdir()
    whole = simple("A", times(3), [1.0, 2.0, 3.0])
    from chronospark.sources.encode import Writer

    w = Writer()
    s = w.add_channel("S", "string")
    w.add_samples(s, [1, 2, 3], ["x", "y", "z"])
    full = w.to_bytes()
    (data / "a.osf").write_bytes(whole)
    (data / "b.osf").write_bytes(full[:-5])  # its last block is not whole

    def go():
        q = (
            spark.readStream.format("recording").load(str(data)).writeStream.format("recording").option("checkpointLocation", str(tmp_path / "cp"))
            .option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        )
        q.awaitTermination(90)

    go()
    out = f"file://{tmp_path}/out"
    assert read(spark, out).groupBy("channel").count().orderBy("channel").collect() == [("A", 3), ("S", 2)]
    (data / "b.osf").write_bytes(full)
    go()
    assert [r["v_string"] for r in read(spark, out).where("channel = 'S'").orderBy("ts_ns").collect()] == ["x", "y", "z"]


def test_conformance_corpus(spark, tmp_path):
    """Versions, names, types, counts and modes of every generated recording; anomalies exactly."""
    from chronospark.sources import generate

    assert cli.main(["generate", str(tmp_path / "c")]) == 0
    path = f"file://{tmp_path}/c"
    counts = read(spark, path).groupBy("file", "channel", "datatype", "mode").count().collect()
    by = {}
    for r in counts:
        by.setdefault(r["file"].rsplit("/", 1)[1].rsplit(".", 1)[0], []).append((r["channel"], r["datatype"], r["count"], r["mode"]))
    assert len(by) == len(generate.corpus()) == 23
    assert sorted(by["v5_equidistant"]) == [(f"Sensor/Vibration{x}", "double", 100, "equidistant") for x in ("100Hz", "10kHz", "1kHz")]
    assert sorted(by["v4_messages"]) == [("Demo.Counter", "uint32", 5, "timestamped"), ("Demo.Message", "string", 5, "variable")]
    assert by["v4_timestamped_binary"] == [("Sensor/Image", "binary", 100, "variable")] and by["v5_empty_block"] == [("Sensor/Double", "double", 10, "timestamped")]
    bad = read(spark, path, "blocks").where("skip_reason is not null").collect()
    assert [(r["file"].rsplit("/", 1)[1][:14], r["skip_reason"]) for r in bad] == [("v5_empty_block", "ZeroLengthBlock")]
    four = read(spark, path).where("file like '%v4_mixed.%'").drop("file")
    five = read(spark, path).where("file like '%v5_mixed.%'").drop("file")
    assert four.exceptAll(five).count() == 0 and five.exceptAll(four).count() == 0


def test_sql_surface(spark, folder):
    from chronospark.operators.filters import positions, typed
    from chronospark.sources.recordings import create_view

    register(spark)
    create_view(spark, "recorded", f"file://{folder}/a.osf")
    assert spark.sql("select count(*) from recorded where channel like 'Sensor/C%'").first()[0] == 100
    spark.read.format("binaryFile").load(f"file://{folder}/a.osf").createOrReplaceTempView("files")
    got = spark.sql("select d.channel, count(*) n from files, lateral decode_recording(path, content) d group by 1")
    assert {r["channel"]: r["n"] for r in got.collect()}["Sensor/Counter"] == 100
    s = spark.table("recorded")
    assert typed(s.where("channel = 'Sensor/Counter'"), "doubles").agg(F.sum("v")).first()[0] == 4950.0
    assert positions(s).agg(F.max("altitude")).first()[0] == 618.0
    with pytest.raises(Exception, match="no strings in channel"):
        typed(s.where("channel = 'Sensor/Counter'"), "strings").collect()
    with pytest.raises(ValueError):
        typed(s, "shorts")


def test_merge_report(spark):
    from chronospark.operators.merge import report

    rows = [("a", 0, 10, 5, None), ("b", 50, 60, 7, None), ("c", None, None, 0, None), ("d", None, None, 0, "broken")]
    c = spark.createDataFrame(rows, "file string, first_ts long, last_ts long, n long, error string")
    assert report(c, 5, 40).first() == (4, 1, 1, 5)


def test_write_groups_by_file(spark, tmp_path):
    rows = spark.range(100).select(F.concat(F.lit("r"), (F.col("id") % 3).cast("string")).alias("file"), F.lit(0).alias("channel_index"), F.lit("A").alias("channel"), F.lit("double").alias("datatype"), F.col("id").alias("ts_ns"), F.col("id").cast("double").alias("v_double"))
    write(rows, str(tmp_path / "w"))
    got = read(spark, f"file://{tmp_path}/w")
    assert got.count() == 100 and got.select("file").distinct().count() == 3
    write(rows.where("file = 'r0'"), str(tmp_path / "w"), mode="overwrite")
    assert read(spark, f"file://{tmp_path}/w").count() == 34


def numbered(spark, files, n=100):
    name = F.element_at(F.array(*[F.lit(f) for f in files]), (F.col("id") % len(files) + 1).cast("int"))
    return spark.range(n).select(name.alias("file"), F.lit(0).alias("channel_index"), F.lit("A").alias("channel"), F.lit("double").alias("datatype"), F.col("id").alias("ts_ns"), F.col("id").cast("double").alias("v_double"))


def test_sink_loses_no_rows(spark, tmp_path):
    register(spark)
    # One recording in four tasks, without being sorted by file.
    numbered(spark, ["r"]).repartition(4).write.format("recording").mode("append").save(str(tmp_path / "one"))
    assert sorted(r["ts_ns"] for r in read(spark, f"file://{tmp_path}/one").collect()) == list(range(100))
    # Equal names in two folders, below a root and as relative names.
    write(numbered(spark, ["a/x", "b/x"]), str(tmp_path / "two"))
    assert sorted(str(p.relative_to(tmp_path / "two")) for p in (tmp_path / "two").rglob("*.osf")) == ["a/x.osf", "b/x.osf"]
    write(numbered(spark, ["/data/a/x.osf", "/data/b/x.osf"]), str(tmp_path / "three"), root="/data")
    assert len(list((tmp_path / "three").rglob("x.osf"))) == 2
    write(numbered(spark, ["/data/a/x.osf", "/data/b/x.osf"]), str(tmp_path / "four"))
    assert sorted(p.name for p in (tmp_path / "four").rglob("*.osf")) == ["x-2.osf", "x.osf"]
    # Appending a name that is there keeps both, overwriting replaces what was there.
    for _ in range(2):
        write(numbered(spark, ["a/x"]), str(tmp_path / "two"))
    assert read(spark, f"file://{tmp_path}/two").count() == 300
    write(numbered(spark, ["a/x", "c/y"], 10), str(tmp_path / "two"), mode="overwrite")
    assert read(spark, f"file://{tmp_path}/two").count() == 10 and not list((tmp_path / "two").rglob("_temporary*"))


def test_convert_keeps_folders(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / "in" / name).mkdir(parents=True)
        (tmp_path / "in" / name / "same.osf").write_bytes(simple("A", [1, 2], [1.0, 2.0]))
    convert(spark, f"file://{tmp_path}/in", str(tmp_path / "out"), 4)
    assert read(spark, f"file://{tmp_path}/out").count() == 4 and len(list((tmp_path / "out").rglob("same.osf"))) == 2


def test_definitions_need_the_beginning_only(spark, tmp_path):
    register(spark)
    data = simple("A", list(range(200_000)), [0.0] * 200_000)
    (tmp_path / "big.osf").write_bytes(data)
    (tmp_path / "broken.osf").write_bytes(b"no recording at all")
    from chronospark.sources.recordings import _metadata

    assert len(_metadata(str(tmp_path / "big.osf"), str(tmp_path))) < len(data) / 10
    assert [r["channel"] for r in spark.read.format("recording").option("view", "channels").load(str(tmp_path)).collect()] == ["A"]
    import gzip

    (tmp_path / "z.osfz").write_bytes(gzip.compress(data))
    assert spark.read.format("recording").option("view", "channels").load(str(tmp_path)).count() == 2


def test_catalog_keeps_a_whole_generation(spark, tmp_path):
    import os

    data, at = tmp_path / "data", f"file://{tmp_path}/catalog"
    data.mkdir()
    (data / "a.osf").write_bytes(simple("A", [5, 9], [1.0, 2.0]))
    first = catalog.refresh(spark, f"file://{data}", at)
    assert [tuple(r) for r in first.select("n", "first_ts", "last_ts").collect()] == [(2, 5, 9)]
    stat = os.stat(data / "a.osf")
    os.utime(data / "a.osf", ns=(stat.st_atime_ns, stat.st_mtime_ns + 900_000_000))  # within the tolerance
    assert [r["status"] for r in catalog.status(catalog.load(spark, at), catalog.listing(spark, f"file://{data}")).collect()] == ["valid"]
    os.utime(data / "a.osf", ns=(stat.st_atime_ns, stat.st_mtime_ns + 9_000_000_000))
    assert [r["status"] for r in catalog.status(catalog.load(spark, at), catalog.listing(spark, f"file://{data}")).collect()] == ["stale"]
    catalog.refresh(spark, f"file://{data}", at)
    assert first.count() == 1  # the last generation stays readable
    (tmp_path / "catalog" / "generation-7").mkdir()  # a crash before its end
    assert catalog.load(spark, at).count() == 1
    made = json.loads(catalog.sidecars(catalog.load(spark, at)).first()["value"])
    assert made["osf_cache_version"] == 1 and made["first_timestamp_ns"] == 5 and made["channels"][0]["sample_count"] == 2 and made["first_timestamp_utc"].endswith("Z")
    catalog.load(spark, at).withColumn("catalog_version", F.lit(0)).write.parquet(f"{at}/generation-9")
    assert catalog.load(spark, at) is None


def test_live_recording(tmp_path):
    from chronospark.sources.live import LiveRecording
    from chronospark.sources.views import Options, rows

    count = lambda p: sum(b.num_rows for b in rows("x", p.read_bytes(), Options()))
    path = tmp_path / "live.osf"
    r = LiveRecording(str(path), integrity="crc32c")
    a, b = r.add_channel("a", "double"), r.add_channel("b", "string")
    with pytest.raises(ValueError):
        r.samples(a, [1], [1.0])
    r.start()
    with pytest.raises(ValueError):
        r.add_channel("late", "double")
    for k in range(5):
        assert count(path) == 2 * k
        r.samples(a, [k], [1.0])
        r.samples(b, [k], ["x" * k * 20_000])
    with pytest.raises(ValueError):
        r.more(a, [1.0])
    with pytest.raises(ValueError):
        r.segment(a, 0, 1.0, [1.0])
    made = r.close("gzip")
    assert made.endswith(".osfz") and not path.exists() and count(tmp_path / "live.osfz") == 10
    with pytest.raises(ValueError):
        r.samples(a, [1], [1.0])
    with pytest.raises(FileExistsError):
        again = LiveRecording(str(tmp_path / "live.osfz"))
        again.add_channel("a", "double")
        again.start()


# Tables that are larger than what a task holds


def _batches(n, names, size=1000, **columns):
    made = {"file": names, "channel": ["c"] * n, "datatype": ["double"] * n, "channel_index": pa.array([0] * n, pa.int32()), "ts_ns": list(range(n)), "v_double": [i / 2 for i in range(n)]} | columns
    return pa.table(made).to_batches(max_chunksize=size)


def test_interleaved_recordings_give_a_file_each(tmp_path):
    """Each change of the name once began another file."""
    sink = recordings._Files({"path": str(tmp_path)})
    written = sink.write_batches(iter(_batches(4000, ["ab"[i % 2] for i in range(4000)])))
    assert sorted(f for _, f in written.files) == ["a", "b"]
    sink.finish([written])
    got = [r for f in ("a", "b") for b in rows(f, (tmp_path / f"{f}.osf").read_bytes(), Options()) for r in b.to_pylist()]
    assert sorted((r["ts_ns"], r["v_double"], r["file"]) for r in got) == [(i, i / 2, "ab"[i % 2]) for i in range(4000)]


def test_a_sink_holds_no_whole_recording(tmp_path):
    """Rows in order go to one file, whatever their number; before, all were in memory as objects."""
    n = 300_000
    batches = _batches(n, ["all"] * n, 10_000)
    sink = recordings._Files({"path": str(tmp_path)})
    tracemalloc.start()
    written = sink.write_batches(iter(batches))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [f for _, f in written.files] == ["all"] and peak < 20 << 20
    sink.finish([written])
    got = pa.Table.from_batches(rows("all", (tmp_path / "all.osf").read_bytes(), Options()))
    assert got["ts_ns"].to_pylist() == list(range(n)) and got["v_double"].to_pylist() == [i / 2 for i in range(n)]


@pytest.mark.parametrize("version, integrity, compression", [(5, "none", None), (5, "crc32c", "gzip"), (4, "none", None)])
def test_a_recording_in_pieces_equals_one_at_once(tmp_path, monkeypatch, version, integrity, compression):
    """Segments go on over the pieces, and length fields that grow late are right."""
    n = 90
    kind = ["double"] * 30 + ["double"] * 30 + ["string"] * 30
    columns = {
        "channel": ["a"] * 30 + ["b"] * 30 + ["c"] * 30, "channel_index": pa.array([0] * 30 + [1] * 30 + [2] * 30, pa.int32()), "datatype": kind, "mode": ["equidistant"] * 30 + ["timestamped"] * 60,
        "seg_id": pa.array([0] * 20 + [1] * 10 + [None] * 60, pa.int32()), "rate_hz": pa.array([3.0] * 30 + [None] * 60), "ts_ns": [int(i * 1e9 / 3) for i in range(20)] + [10**12 + int(i * 1e9 / 3) for i in range(10)] + list(range(60)),
        "v_double": pa.array([float(i) for i in range(60)] + [None] * 30), "v_string": [None] * 60 + ["x" * (70_000 if i == 29 else i) for i in range(30)],
    }
    batches = _batches(n, ["f"] * n, 7, **columns)
    whole = recordings.encode_samples(pa.Table.from_batches(batches), version, integrity, compression)
    monkeypatch.setattr(recordings, "GATHERED", 1)  # each batch is a piece
    options = {"path": str(tmp_path), "version": str(version), "integrity": integrity} | ({"compression": compression} if compression else {})
    written = recordings._Files(options).write_batches(iter(batches))
    assert len(written.files) == 1
    with open(written.files[0][0], "rb") as f:
        pieces = f.read()
    plain = lambda data: [{k: v for k, v in r.items() if k not in ("block_ord", "sample_ord")} for b in rows("f", data, Options(mode="FAILFAST")) for r in b.to_pylist()]
    assert plain(pieces) == plain(whole) and len(plain(whole)) == n
    assert max(r["seg_id"] or 0 for r in plain(pieces)) == 1


def test_values_are_not_cut_to_fit(tmp_path):
    rows_ = _batches(2, ["f"] * 2, datatype=["int8"] * 2, v_long=[1, 300])
    with pytest.raises(OverflowError):
        recordings._Files({"path": str(tmp_path)}).write_batches(iter(rows_))


def test_small_blocks_share_batches():
    """Each block, of one sample here, once was a batch of its own."""
    from chronospark.plans.block_queries import CODES, _integers

    made = list(rows("x", _integers([{"v": k, "ord": k} for k in range(100)]), Options()))
    assert len(made) == 1 and made[0].num_rows == 100 * len(CODES)


def test_table_function_gives_batches(spark, tmp_path):
    """Of a recording of any size the table function holds some thousand rows."""
    data = simple("x", list(range(100_000)), [float(i) for i in range(100_000)])
    made = list(recordings.DecodeRecordings().eval(pa.RecordBatch.from_pydict({"path": ["f"], "content": [data]})))
    assert sum(b.num_rows for b in made) == 100_000 and max(b.num_rows for b in made) < 40_000
    (tmp_path / "f.osf").write_bytes(data)
    register(spark)
    spark.read.format("binaryFile").load(f"file://{tmp_path}").createOrReplaceTempView("whole")
    assert spark.sql("select count(*) n, sum(v_double) s from decode_recordings(table(select path, content from whole))").first() == (100_000, 100_000 * 99_999 / 2)


def test_runs_of_blocks_equal_the_whole(spark):
    """No call gets more rows than a run has."""
    from chronospark.plans import block_queries as q

    def make(rows_):
        assert len(rows_) <= q.RUN_ROWS
        return q._segments(rows_)

    df = spark.range(25_003).selectExpr("'f' as file", "id as ord", "id * 7 as ts_ns", "cast(id as double) as v")
    begin = q.recording([q.channel(0, "double")], b"")
    made = q.in_runs(df, make, begin).collect()
    assert len(made) == 1 and bytes(made[0]["content"]) == begin + q._segments([r.asDict() for r in df.orderBy("ord").collect()])


def test_workers_get_a_few_mb_at_once(spark):
    from chronospark.plans.block_queries import view

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    content = spark.range(40, numPartitions=1).selectExpr("cast(id as string) as file", "cast(repeat('x', 1 << 20) as binary) as content")
    view(content)
    sizes = content.mapInArrow(lambda it: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in it), "n long").collect()
    assert max(r["n"] for r in sizes) <= 9
