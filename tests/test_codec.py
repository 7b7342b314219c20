import struct

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronospark.sources.checksums import crc32c
from chronospark.sources.encode import Writer
from chronospark.sources.frames import Reader, equidistant
from chronospark.sources.views import Options, rows
from chronospark.sources.wire import Channel, FormatError, build_header, build_metablock, parse_header, parse_metablock, Meta, peek, read_meta, unpack
from tests.recordings import START, mixed, simple, times


def table(data, view="samples", **options):
    batches = list(rows("f", data, Options(view=view, **options)))
    return [r for b in batches for r in b.to_pylist()]


def raw_file(channels, body, version=5, token=""):
    meta = build_metablock(version, {}, channels)
    head = build_header(version, meta)
    return head[:-1] + token.encode() + b"\n" + meta + body


def block(index, control, payload, width=2):
    return struct.pack("<HH" if width == 2 else "<HI", index, 1 + len(payload)) + bytes([control]) + payload


DOUBLE, STRING, INT = Channel(0, "D", "double"), Channel(1, "S", "string"), Channel(2, "I", "int32")


def test_crc32c():
    assert crc32c(b"123456789") == 0xE3069283
    assert crc32c(b"") == 0
    data = bytes(range(256)) * 40
    assert crc32c(data) == crc32c(data[:10240]) and crc32c(data) != crc32c(data[:-1])


@pytest.mark.parametrize("version,integrity,compression", [(5, "none", None), (5, "crc32c", None), (4, "none", None), (5, "none", "gzip")])
def test_round_trip(version, integrity, compression):
    got = table(mixed(version, integrity, compression))
    by = {}
    for r in got:
        by.setdefault(r["channel"], []).append(r)
    assert len(by) == 8
    assert [r["ts_ns"] for r in by["Sensor/Counter"]] == times(100)
    assert [r["v_string"] for r in by["Sensor/Message"]] == [f"Sample_{i}" for i in range(100)]
    assert [int(r["v_ulong"]) for r in by["Sensor/UInt64"]] == [2**63 + i * 1_000_000 for i in range(100)]
    assert by["Sensor/Blob"][3]["v_binary"] == bytes([3] * 64)
    assert by["Sensor/Position"][7]["v_gps"]["altitude"] == 526.0
    assert [r["v_bool"] for r in by["Sensor/AlarmFlag"]][:6] == [True] * 5 + [False]
    vib = by["Sensor/Vibration100Hz"]
    assert [r["ts_ns"] for r in vib[-3:]] == [START + 10**12, START + 10**12 + 333333333, START + 10**12 + 666666666]
    assert {r["seg_id"] for r in vib} == {0, 1}


def test_views_and_pushdown():
    data = mixed()
    assert len(table(data, "channels")) == 9
    f = table(data, "files")[0]
    assert (f["version"], f["integrity"], f["truncated"], f["latitude"]) == (5, "none", False, 48.1374)
    only = table(data, channels=("sensor/counter",), start_ns=times(100)[10], end_ns=times(100)[12])
    assert [r["v_long"] for r in only] == [10, 11, 12]
    assert all(b["skip_reason"] is None for b in table(data, "blocks"))


def test_truncation_at_every_byte():
    data = simple("A", times(4), [1.0, 2.0, 3.0, 4.0], integrity="crc32c")
    whole = len(table(data))
    for cut in range(len(data)):
        got = table(data[:cut])
        assert len(got) <= whole
        files = table(data[:cut], "files")
        assert files[0]["error"] is not None or files[0]["truncated"] or len(got) == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 20_000), st.integers(0, 255))
def test_damage_never_crashes(at, value):
    data = bytearray(mixed(n=12))
    data[at % len(data)] = value
    for view in ("samples", "blocks", "files"):
        table(bytes(data), view)


def test_zero_length_and_reserved_blocks():
    body = block(0, 8, struct.pack("<qd", 5, 1.5)) + struct.pack("<HH", 0, 0) + block(0, 8, struct.pack("<qd", 6, 2.5))
    body += block(0, 0, b"x") + block(0, 1, b"12345678") + block(0, 3, b"12345678") + block(0, 17, b"") + block(0, 2, b"")
    data = raw_file([DOUBLE], body)
    assert [r["v_double"] for r in table(data)] == [1.5, 2.5]
    assert [b["skip_reason"] for b in table(data, "blocks")] == [None, "ZeroLengthBlock", None, "ReservedBlockType", "DeprecatedBlockType", "StatusEvent", "ReservedBlockType", "ReservedBlockType"]
    assert table(data, "blocks", capture_skipped=True)[3]["payload"] == b"\x00x"


def test_messages():
    msg = lambda t, raw, extra=b"": struct.pack("<qI", t, len(raw)) + raw + extra
    body = block(1, 4, msg(1, b"abc")) + block(1, 4, msg(2, b"")) + block(1, 0x84, msg(3, b"no")) + block(2, 4, msg(4, b"no")) + block(1, 4, msg(5, b"xy", b"surplus"))
    for version in (4, 5):
        data = raw_file([DOUBLE, STRING, INT], body, version)
        assert [(r["ts_ns"], r["v_string"]) for r in table(data)] == [(1, "abc"), (2, ""), (5, "xy")]
        assert [b["skip_reason"] for b in table(data, "blocks")] == [None, None, "ReservedBlockType", "ReservedBlockType", None]


def test_relative_stamps():
    body = block(2, 8, struct.pack("<qi", 1000, 1)) + block(2, 0x87, struct.pack("<IIiIi", 2, 5, 2, 7, 3)) + block(2, 7, struct.pack("<Ii", 1, 4))
    data = raw_file([Channel(2, "I", "int32")], body)
    assert [(r["ts_ns"], r["v_long"]) for r in table(data)] == [(1000, 1), (1005, 2), (1012, 3), (1013, 4)]
    lost = raw_file([Channel(2, "I", "int32")], block(2, 7, struct.pack("<Ii", 1, 4)))
    assert table(lost, "blocks")[0]["skip_reason"] == "RelativeStampWithoutAnchor"
    with pytest.raises(FormatError):
        table(lost, mode="FAILFAST")


def test_families():
    start = block(0, 0x86, struct.pack("<qdI2d", 0, 10.0, 2, 1.0, 2.0))
    more = block(0, 5, struct.pack("<d", 3.0))
    stamp = block(0, 8, struct.pack("<qd", 5, 9.0))
    assert [r["ts_ns"] for r in table(raw_file([DOUBLE], start + more))] == [0, 100_000_000, 200_000_000]
    assert [b["skip_reason"] for b in table(raw_file([DOUBLE], start + stamp), "blocks")] == [None, "ChannelMixedBlockTypes"]
    assert table(raw_file([DOUBLE], more), "blocks")[0]["skip_reason"] == "ContinuedDataWithoutStart"


def test_unknown_channel_keeps_the_prefix():
    data = raw_file([DOUBLE], block(0, 8, struct.pack("<qd", 5, 1.5)) + block(7, 8, b"12345678"))
    assert [r["v_double"] for r in table(data)] == [1.5]
    assert table(data, "blocks")[1]["skip_reason"] == "UnknownChannel"
    assert table(data, "files")[0]["truncated"]
    with pytest.raises(FormatError):
        table(data, mode="FAILFAST")


def test_strings_by_version():
    one = block(1, 8, struct.pack("<q", 1) + b"ab\0")
    two = block(1, 0x88, struct.pack("<I", 2) + struct.pack("<q", 1) + b"ab" + struct.pack("<q", 2) + b"cd")
    odd = block(1, 0x88, struct.pack("<I", 2) + struct.pack("<q", 1) + b"abc")
    assert [r["v_string"] for r in table(raw_file([DOUBLE, STRING], one, 4))] == ["ab"]
    assert [r["v_string"] for r in table(raw_file([DOUBLE, STRING], one, 5))] == ["ab\0"]
    assert [r["v_string"] for r in table(raw_file([DOUBLE, STRING], two))] == ["ab", "cd"]
    assert [r["v_string"] for r in table(raw_file([DOUBLE, STRING], odd))] == ["abc"]
    bad = block(1, 8, struct.pack("<q", 1) + b"\xff")
    assert table(raw_file([DOUBLE, STRING], bad), "blocks")[0]["skip_reason"] == "MalformedBlock"
    assert table(raw_file([DOUBLE, STRING], bad), utf8="replace")[0]["v_string"] == "�"


def test_trailer_and_signature():
    info = struct.pack("<HI", 0xFFFF, 3) + b"\0{}"
    tail = b"OSF_STREAM_END 10".ljust(40, b"=")
    sample = block(0, 8, struct.pack("<qd", 5, 1.5))
    for end in (info, info + tail):
        f = table(raw_file([DOUBLE], sample + end), "files")[0]
        assert f["trailer_seen"] and not f["truncated"]
    w = Writer(5, "crc32c")
    w.add_samples(w.add_channel("D", "double"), [5], [1.5])
    head, rest = w.to_bytes().split(b"\n", 1)
    signed = head + b" ed25519:0123456789abcdef\n" + rest + struct.pack("<HI", 0xFFFE, 4) + b"\x09sig"
    assert [b["skip_reason"] for b in table(signed, "blocks")] == [None, "SignatureBlock"]
    assert table(signed, "files")[0]["integrity"] == "signed"


def test_damaged_block_is_skipped_and_counted():
    data = bytearray(mixed(5, "crc32c"))
    meta, plain, _ = read_meta(bytes(data))
    first = next(iter(Reader(plain, meta)))
    data[first.offset + 20] ^= 1
    got = table(bytes(data), "blocks")
    assert got[0]["skip_reason"] == "CrcMismatch" and got[0]["crc_ok"] is False and all(b["crc_ok"] for b in got[1:])
    data = bytearray(mixed(5, "crc32c"))
    data[meta.header_bytes + 5] ^= 1
    assert "checksum" in table(bytes(data), "files")[0]["error"]


@pytest.mark.parametrize("line", [b"OSF5  10\n", b"OSF5 10 \n", b"OSF5 x\n", b"OSF6 10\n", b"OSF4 10 crc32c:00000000\n", b"OSF5 10 crc32c:0000000a\n", b"OSF5 10 ed25519:0123456789abcdef\n", b"OSF5 10 other:1\n", b"OSF5 10"])
def test_bad_headers(line):
    with pytest.raises(FormatError):
        parse_header(line)


def test_good_headers():
    assert parse_header(b"OCEAN_STREAM_FORMAT4 12\r\n").version == 4
    assert parse_header(b"OSF5 12 crc32c:0000000A\n").integrity == "crc32c"
    assert peek(b"OSF5 12\n") == 5 and peek(b"nothing") is None


def test_metablocks():
    flat = b'{"osf":{"version":5,"creator":"me","channels":[{"index":0,"name":"a","channeltype":"scalar","datatype":"bytearray","spectrumtype":"realImag"}]}}'
    m = parse_metablock(Meta(5), flat)
    assert m.info["creator"] == "me" and m.channels[0].datatype == "binary" and m.channels[0].size_of_length_value == 2 and m.channels[0].spectrum_type == "realimag"
    for root in ("osf", "recording"):
        xml = f'<?xml version="1.0"?><{root} latitude="1.5" tag="x"><channels count="1"><channel index="3" name="n" channeltype="vector" datatype="weird" scale="2"/></channels><infos><info name="k" value="v"/></infos></{root}>'
        m = parse_metablock(Meta(4), xml.encode())
        assert m.info["latitude"] == 1.5 and not m.channels[0].supported and m.infos[0]["value"] == "v"
    for bad in (b"", b"x", b"{", b"<a/>", b'{"osf":{"channels":[{"index":0,"name":"a","datatype":"triple"}]}}', b'<!DOCTYPE a><osf/>'):
        with pytest.raises(FormatError):
            parse_metablock(Meta(5), bad)


def test_compression_is_sniffed():
    import zlib

    data = mixed()
    assert unpack(zlib.compress(data))[:2] == (data, "zlib")
    assert unpack(b"O")[1] == "none"
    assert unpack(mixed(compression="gzip")[:-20])[2] is True


def test_writer_guards():
    w = Writer()
    with pytest.raises(ValueError):
        w.to_bytes()
    a, s = w.add_channel("a", "double"), w.add_channel("s", "string")
    w.add_segment(a, 0, 1.0, [1.0])
    for bad in (lambda: w.add_samples(a, [1], [1.0]), lambda: w.add_segment(s, 0, 1.0, ["x"]), lambda: w.add_segment(a, 0, 0.0, [1.0]), lambda: w.add_samples(s, [1, 2], ["x"]), lambda: w.add_channel("v", "pair"), lambda: w.add_samples(9, [], [])):
        with pytest.raises(ValueError):
            bad()
    w.add_samples(s, [1], ["x" * 70_000])
    assert w.channels[s].size_of_length_value == 4
    assert len([r for r in table(w.to_bytes()) if r["channel"] == "s"][0]["v_string"]) == 70_000
    with pytest.raises(ValueError):
        Writer(4, "crc32c")


def test_no_writer_block_is_empty_or_deprecated():
    for version in (4, 5):
        assert all(b["length"] > 0 and b["control"] & 0x7F in (5, 6, 8) for b in table(mixed(version), "blocks"))


def test_equidistant_saturates():
    top = (1 << 63) - 1
    assert equidistant(top - 5, 1.0, 0, 3).tolist() == [top - 5, top, top]
    assert equidistant(7, 0.0, 0, 2).tolist() == [7, 7]
    assert equidistant(0, 3.0, 0, 4).tolist() == [0, 333333333, 666666666, 1000000000]
    assert equidistant(0, 3.0, 0, 3, "rounded").tolist() == [0, 333333333, 666666666]
    assert equidistant(0, 7.0, 5, 3).tolist() == [int(i * 1e9 / 7.0) for i in (5, 6, 7)]


def test_arrow_schema_matches():
    batch = next(iter(rows("f", mixed(), Options())))
    assert isinstance(batch, pa.RecordBatch) and batch.schema.names[0] == "file"


def test_checksums_of_all_sizes():
    import random

    from chronospark.sources import checksums

    rng = random.Random(1)
    for n in [0, 1, 1023, 1024, 1025, 2047, 2048, 4096, 21_344, 65_535, 65_536, 100_001, *(rng.randrange(1000, 9000) for _ in range(60))]:
        data = rng.randbytes(n)
        assert crc32c(data) == checksums._plain(data, 0xFFFFFFFF) ^ 0xFFFFFFFF
