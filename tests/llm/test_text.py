import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from chronospark.llm._packed import packed, sliced, unpacked
from chronospark.llm._text import U, Words, chunks, run_hashes, span_hashes, window_hashes
from chronospark.llm.filters import BitFilter, _probes, size_for

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\x0b🙂", max_size=30)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words(texts):
    w = Words(pa.array(texts, pa.string()))
    raw = w.buf.tobytes()
    for d, t in enumerate(texts):
        got = [raw[s:e].decode() for s, e in zip(w.start[w.first[d] : w.first[d + 1]], w.end[w.first[d] : w.first[d + 1]])]
        assert got == re.findall(r"[^\x20\x09-\x0D]+", t or "")


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_hashes_follow_equality(texts):
    w = Words(pa.array(texts, pa.string()))
    raw, h = w.buf.tobytes(), w.hashes()
    seen = {}
    for s, e, x in zip(w.start, w.end, h.tolist()):
        assert seen.setdefault(raw[s:e], x) == x
    assert len(set(seen.values())) == len(seen)
    begin = w.windows(3)
    windows = window_hashes(h, begin, 3).tolist()
    words = [raw[s:e] for s, e in zip(w.start, w.end)]
    by = {}
    for b, x in zip(begin.tolist(), windows):
        assert by.setdefault(tuple(words[b : b + 3]), x) == x
    assert len(set(by.values())) == len(by)


def test_lower_case_and_slices():
    a = pa.array(["x The CAT", None, "the cat", "É"])
    h = Words(a).hashes(lower=True)
    assert h[1] == h[3] and h[2] == h[4]
    assert (Words(a.slice(2, 1)).hashes() == Words(pa.array(["the cat"])).hashes()).all()
    batch = pa.record_batch([pa.array(["ab" * 50] * 10)], ["t"])
    parts = list(chunks(batch, "t", 250))
    assert sum(p.num_rows for p in parts) == 10 and max(p.num_rows for p in parts) == 2
    assert [p.num_rows for p in chunks(batch, "t", 3)] == [1] * 10


def test_bit_filter():
    rng = random.Random(1)
    h = np.array([rng.getrandbits(64) for _ in range(2000)], U)
    bits = size_for(1000, 28)
    slices = {}
    for x in h[:1000]:
        s = int(x >> U(56))
        raw = slices.setdefault(s, np.zeros(1 << (bits - 8), bool))
        for k in range(BitFilter.PROBES):
            raw[_probes(np.array([x], U), bits, k)] = True
    f = BitFilter(bits, {s: np.packbits(r, bitorder="little").tobytes() for s, r in slices.items()})
    assert f.test(h[:1000]).all() and f.test(h[1000:]).mean() < 0.02


def test_hashes_do_not_depend_on_what_stands_around():
    rng = random.Random(2)
    data = bytes(rng.randrange(97, 100) for _ in range(3000))
    spans = [(s, min(len(data), s + rng.choice([0, 1, 7, 8, 9, 16, 17, 300]))) for s in (rng.randrange(3000) for _ in range(400))]
    buf = np.frombuffer(data, np.uint8)
    by = {}
    for lane in (0, 1):
        got = span_hashes(buf, np.array([s for s, _ in spans]), np.array([e for _, e in spans]), lane)
        for (s, e), h in zip(spans, got.tolist()):
            assert by.setdefault((lane, data[s:e]), h) == h == int(span_hashes(np.frombuffer(data[s:e], np.uint8), np.array([0]), np.array([e - s]), lane)[0])
    assert len(set(by.values())) == len(by)
    words = np.array([rng.randrange(4) for _ in range(200)], U)
    for size in (1, 2, 3, 5, 25, 50):
        begin = np.arange(200 - size)
        seen = {}
        for b, h in zip(begin.tolist(), window_hashes(words, begin, size).tolist()):
            assert seen.setdefault(tuple(words[b : b + size].tolist()), h) == h
        assert len(set(seen.values())) == len(seen)
        runs = run_hashes(words, begin, begin + size)
        assert len(set(runs.tolist())) == len(seen)


def test_long_words_of_two_letters_have_their_own_hashes():
    """Thue-Morse words collide in any polynomial hash modulo a power of two."""
    bits = [bin(i).count("1") % 2 for i in range(1 << 12)]
    for n in (1024, 2048, 4096):
        w = Words(pa.array(["".join("ab"[x] for x in bits[:n]), "".join("ba"[x] for x in bits[:n])]))
        assert all(len(set(w.hashes(lane=lane).tolist())) == 2 for lane in (0, 1))


def test_packed_values():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 2**50), (1000, 2**20), (1000, 2**52), (5, 3)):
        value = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        assert (unpacked(packed(value)) == value).all()
    value = rng.integers(0, 2**64, 500_000, dtype=np.uint64)
    live, data = sliced(value, 40, 4)
    back = np.concatenate([unpacked(d) | (U(i) << U(36)) for i, d in zip(live, data)])
    assert (back == np.sort(value >> U(24))).all() and sum(map(len, data)) < 4 * 500_000
