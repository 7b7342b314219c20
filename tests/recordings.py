"""Recordings for tests, in the shapes of the conformance set; times in closed form."""

from __future__ import annotations

import math

from chronospark.sources.encode import Writer

START = 1_700_000_000_000_000_000


def times(n: int, start: int = START) -> list[int]:
    out, t = [], start
    for i in range(n):
        out.append(t)
        t += (10 + i * 37 % 191) * 1_000_000
    return out


def mixed(version: int = 5, integrity: str = "none", compression: str | None = None, n: int = 100) -> bytes:
    w = Writer(version, integrity, compression, latitude=48.1374, longitude=11.5755, altitude=519.0, reason="GENERATOR", tag="demo")
    theta = [2 * math.pi * i / n for i in range(n)]
    w.add_samples(w.add_channel("Sensor/TemperatureC", "double", physical_unit="°C"), times(n), [100 * math.sin(x) for x in theta])
    w.add_samples(w.add_channel("Sensor/Counter", "int16"), times(n), [i % 32767 for i in range(n)])
    c = w.add_channel("Sensor/Vibration100Hz", "double", physical_unit="m/s²")
    w.add_segment(c, START, 100.0, [100 * math.sin(x) for x in theta])
    w.add_segment(c, START + 10**12, 3.0, [1.0, 2.0, 3.0])
    w.add_samples(w.add_channel("Sensor/AlarmFlag", "bool"), times(n), [i % 10 < 5 for i in range(n)])
    w.add_samples(w.add_channel("Sensor/Message", "string"), times(n), [f"Sample_{i}" for i in range(n)])
    w.add_samples(w.add_channel("Sensor/Position", "gpslocation"), times(n), [(48.1 + 0.01 * math.sin(x), 11.5 + 0.01 * math.cos(x), 519.0 + i) for i, x in enumerate(theta)])
    w.add_samples(w.add_channel("Sensor/UInt64", "uint64"), times(n), [2**63 + i * 1_000_000 for i in range(n)])
    w.add_samples(w.add_channel("Sensor/Blob", "binary", mime_type="image/png"), times(n), [bytes([i % 256] * 64) for i in range(n)])
    w.add_channel("Sensor/Empty", "float")
    return w.to_bytes()


def simple(name: str, ts: list[int], values: list, datatype: str = "double", **info) -> bytes:
    w = Writer(5, **info)
    w.add_samples(w.add_channel(name, datatype), ts, values)
    return w.to_bytes()
