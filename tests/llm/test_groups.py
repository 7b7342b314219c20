"""Operators on pairs, groups and totals against plain versions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronospark.llm import embeddings, mixing, ngrams, substrings, warc
from chronospark.llm.components import connected_components
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def parts_of(links, nodes):
    top = {i: i for i in nodes}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        top[max(a, b)] = min(a, b)
    return {i: root(i) for i in nodes}


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(900, i) for i in range(700, 800)] + [(rng.randrange(400), rng.randrange(400)) for _ in range(150)] + [(5, 5)]
    df = spark.createDataFrame([*links, (None, 3), (3, None)], "a long, b long")
    got = {r["id"]: r["component"] for r in connected_components(df).collect()}
    want = parts_of(links, {x for p in links for x in p})
    assert got == {i: c for i, c in want.items() if i in got} and all(want[i] == i for i in want if i not in got)
    assert connected_components(df.limit(0)).count() == 0


def plain_sets(rows):
    lower = {i: i + 32 for i in range(65, 91)}
    out = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(lower))
        out.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def check_join(df, **options):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    sets = plain_sets(rows)
    ids = [i for i in sets if i is not None]
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b])]
    want = parts_of(links, ids)
    got = ngrams.link_documents(df, **options).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert r["component_id"] == want[r["doc_id"]]
            assert r["n_shingles"] in {len(s) for s in sets[r["doc_id"]]}
    return want


def test_ngram_join(spark, documents, empty):
    want = check_join(documents)
    assert sum(i != c for i, c in want.items()) > 10
    assert ngrams.link_documents(empty).count() == 0


def morse(n, a, b):
    return [(a, b)[bin(i).count("1") % 2] for i in range(n)]


def test_ngram_join_of_words_that_cancel_in_a_polynomial(spark):
    one, two = "".join(morse(2048, "a", "b")), "".join(morse(2048, "b", "a"))
    rest = " and four words more"
    rows = [(1, one), (2, two), (3, one + rest), (4, two + rest), (5, " ".join(morse(1024, "x", "y"))), (6, " ".join(morse(1024, "y", "x"))), (7, one)]
    want = check_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert want[2] == 2 and want[7] == 1 and want[4] == 4


def test_shingles_are_counted_over_all_tasks(spark):
    """A passage of one document in each of many tasks is frequent, as it is in one task."""
    rng = random.Random(8)
    shared = prose(rng, 30)
    rows = [(i, prose(rng, 40) + " " + shared) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string")
    found = []
    for n in (60, 1):
        bits, slices = ngrams.count_bits(df), ngrams.slices_for(df)
        counts = ngrams._counted(ngrams._summaries(df.repartition(n), 5, bits, slices), bits, slices)
        found.append(sorted(tuple(r) for r in counts.collect()))
    assert found[0] == found[1] and sum(n == 60 for _, n in found[0]) >= 24


@pytest.mark.parametrize("block, run_most, most", [(2048, 64, 1 << 20), (8, 3, 0)])
def test_ngram_join_of_a_large_group(spark, monkeypatch, block, run_most, most):
    """Near copies at all distances from each other: frequent shingles, split tiles and runs."""
    monkeypatch.setattr(ngrams, "FREQUENT_FROM", 6)
    monkeypatch.setattr(ngrams, "FREQUENT_MOST", most)
    monkeypatch.setattr(ngrams, "RUN_MOST", run_most)
    monkeypatch.setattr(ngrams, "BLOCK_BYTES", 30_000)
    rng = random.Random(4)
    base = [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(i) for i in range(90)]
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(90)] = f"x{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(w)))
    rows += [(2000 + i, " ".join(base)) for i in range(30)] + [(3000 + i, " ".join(base[:60]) + prose(rng, 60)) for i in range(10)]
    check_join(spark.createDataFrame(rows, "doc_id long, text string"), block=block)


def test_signatures_bound_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, 80, dtype=np.uint64))
        b = np.unique(np.concatenate([a[:60], rng.integers(0, 2**63, 40, dtype=np.uint64)]))
        apart = len(np.setxor1d(a, b))
        for width in (64, 128, 256):
            x, y = (ngrams.fold(ngrams.signature(s, 256), width) for s in (a, b))
            assert int(np.bitwise_count(x ^ y).sum()) <= apart


def plain_cosines(rows, least=0.98):
    links = []
    for k, (a, x, la) in enumerate(rows):
        for b, y, lb in rows[:k]:
            if la is None or la != lb or not x or not y or len(x) != len(y) or None in x or None in y:
                continue
            x_, y_ = np.array(x, float), np.array(y, float)
            if not (np.isfinite(x_).all() and np.isfinite(y_).all() and x_.any() and y_.any()):
                continue
            if x_ @ y_ / (np.linalg.norm(x_) * np.linalg.norm(y_)) >= least:
                links.append((a, b))
    return links


@pytest.mark.parametrize("block", [2048, 4])
def test_embeddings(spark, block):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(12):
        center = rng.normal(size=16)
        for _ in range(rng.integers(1, 9)):
            rows.append((len(rows), (center + rng.normal(scale=0.08, size=16)).tolist(), int(g % 3)))
    rows += [(500, rows[0][1], 0), (501, rows[0][1], 0), (502, rows[0][1], 1), (503, rows[0][1], None), (504, None, 0), (505, [0.0] * 16, 0), (506, [float("nan")] * 16, 0), (507, [None] * 16, 0), (508, [float("inf")] + [0.0] * 15, 0), (509, [1.0, 2.0], 0), (510, [], 0)]
    rows += [(511, [2 * v for v in rows[0][1]], 0)]
    df = spark.createDataFrame([(*r, "x", True) for r in rows] + [(None, rows[1][1], 0, "x", True)], "vec_id long, embedding array<double>, label int, key string, kept boolean")
    links = plain_cosines(rows)
    want = parts_of(links, [r[0] for r in rows])
    count = {r[0]: 0 for r in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    got = embeddings.near_duplicates(df, block=block).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if r["vec_id"] is None:
            assert r["component_id"] is None and not r["kept"]
        else:
            assert (r["n_links"], r["component_id"], r["kept"]) == (count[r["vec_id"]], want[r["vec_id"]], want[r["vec_id"]] == r["vec_id"])
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_of_an_id_with_several_vectors(spark):
    """Each row has the links of its own vector; the id is one node."""
    v = np.eye(6).tolist()
    rows = [(1, v[0], 0), (1, v[1], 1), (2, v[0], 0), (3, v[1], 1), (4, v[1], 1), (5, v[2], 0), (6, v[2], 0), (7, v[3], 0), (7, v[2], 0)]
    got = sorted(tuple(r)[:3] for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (4, 2, 1), (5, 2, 5), (6, 2, 5), (7, 0, 5), (7, 2, 5)]


def test_signatures_at_the_threshold():
    rng = np.random.default_rng(5)
    for count in (60, 104):
        x = rng.normal(size=(4000, 32))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y = rng.normal(size=x.shape)
        y -= (x * y).sum(1, keepdims=True) * x
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        apart = (embeddings._signs(x, count) != embeddings._signs(0.98 * x + np.sqrt(1 - 0.98**2) * y, count)).sum(1)
        assert apart.max() <= embeddings.most_apart(count, 0.98) < count / 2


def plain_substrings(rows):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - 49):
                key = tuple(w[k : k + 50])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        keep = [True] * len(w)
        if i is not None:
            for k in range(len(w) - 49):
                if first[tuple(w[k : k + 50])] < i:
                    keep[k : k + 50] = [False] * 50
        out.append((i, len(w), len(w) - sum(keep), " ".join(x for x, k in zip(w, keep) if k)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [28, 18])
def test_substrings(spark, documents, empty, bits):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.dedup(documents, filter_bits=bits).collect()), key=str)
    want = plain_substrings(rows)
    assert got == want and sum(r[2] > 0 for r in want) > 5
    assert substrings.dedup_digests(empty).count() == 0


def test_substrings_at_every_offset(spark):
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(75)]
    rows = [(k, " ".join([f"a{k}x{i}" for i in range(k)] + passage[: 49 + k % 27] + [f"b{k}x{i}" for i in range(rng.randrange(40))])) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.dedup(df).collect()), key=str)
    assert got == plain_substrings(rows)


@pytest.mark.parametrize("most", [1 << 20, 2])
def test_substrings_of_common_passages(spark, monkeypatch, most):
    """Common anchors apart, or only the two most common of them; texts that share an id."""
    monkeypatch.setattr(substrings, "COMMON_FROM", 4)
    monkeypatch.setattr(substrings, "COMMON_MOST", most)
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(120)]
    rows = [(k, " ".join([f"a{k}x{i}" for i in range(rng.randrange(30))] + passage[rng.randrange(30) : 85 + rng.randrange(30)])) for k in range(40)]
    rows += [(50, " ".join(passage)), (50, " ".join([f"q{i}" for i in range(300)])), (49, " ".join([f"q{i}" for i in range(100)])), (60, " ".join(morse(50, "x", "y"))), (61, " ".join(morse(50, "y", "x")))]
    long = ["".join(morse(2048, *pair)) for pair in (("a", "b"), ("b", "a"))]
    rows += [(70 + k, " ".join(passage[:0] + [f"c{i}" for i in range(49)] + [long[k]])) for k in (0, 1)]
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == plain_substrings(rows) and sum(r[2] > 0 for r in got) > 30
    ranges = {r["doc_id"]: r["repeats"] for r in substrings.dedup(spark.createDataFrame([(1, " ".join(passage)), (2, "x y z " + " ".join(passage[5:])), (3, "x")], "doc_id long, text string")).collect()}
    assert ranges == {1: "", 2: "3:118", 3: ""}


@pytest.mark.parametrize("line", [25, 50])
def test_substrings_of_a_line_that_one_document_repeats(spark, line):
    """Blocks that only one document indexes, often, are popular windows of both."""
    words = " ".join(f"w{i}" for i in range(line))
    lead = [" ".join(f"a{k}x{i}" for i in range(10 + k)) for k in range(3)]
    rows = [(k, lead[k] + f" {words}" * 5) for k in range(3)] + [(9, " ".join([words] * 40)), (10, "other words here " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.dedup(df).collect()), key=str)
    assert got == plain_substrings(rows) and sum(r[2] > 0 for r in got) == 3


# Mixing


def test_raking_meets_the_marginals(spark):
    rng = random.Random(1)
    cells = [((s, la, t), float(rng.randrange(1, 900))) for s in "abc" for la in "xy" for t in "mn" if rng.random() < 0.9]
    goals = []
    for k in range(3):
        own = {}
        for key, w in cells:
            own[key[k]] = own.get(key[k], 0) + w
        goals.append(mixing.shares(own, None, 0.5))
    factor = mixing.rake(cells, goals)
    total = sum(w for _, w in cells)
    for k in range(3):
        for v, want in goals[k].items():
            assert sum(w * f for (key, w), f in zip(cells, factor) if key[k] == v) / total == pytest.approx(want, abs=1e-5)


def test_both_ways_of_raking_agree(spark, documents):
    rows = documents.select(*mixing.keyed(documents))
    cells = rows.groupBy(F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic")).agg(F.sum("__tokens").alias("tokens"))
    key = lambda df: {(r["source"], r["lang"], r["topic"]): r["probability"] for r in df.collect()}
    a, b = key(mixing.factors(cells, rounds=8)), key(mixing.factors(cells, rounds=8, driver_cells=0))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-6) for k in a)


def test_draw(spark, documents, empty):
    out = mixing.draw(documents)
    assert out.count() == documents.count() and out.where("probability is null or probability > 1 or probability <= 0").count() == 0
    drawn = mixing.draw(documents, only_drawn=True)
    assert drawn.columns == documents.columns and drawn.count() == out.where("sampled").count()
    again = mixing.draw(documents.repartition(7), only_drawn=True)
    assert drawn.exceptAll(again).count() == 0 and again.exceptAll(drawn).count() == 0
    assert mixing.draw(empty).count() == 0
    words = {r["doc_id"]: r["tokens"] for r in out.collect()}
    assert all(words[r["doc_id"]] == len(WORD.findall(r["text"] or "")) for r in documents.where("doc_id < 400").collect())


def test_a_license_line_anywhere_makes_a_notice(spark):
    line = "\nCopyright 2020 by the authors, All Rights Reserved"
    rows = [(0, "plain words " * 600 + line), (1, line + " plain words" * 600), (2, "plain words " * 600), (3, "plain words " * 60 + "under a LICENCE"), (4, "a | b |" * 99 + line), (5, None)]
    got = spark.createDataFrame(rows, "id long, text string").select("id", mixing.topic_of(F.col("text")).alias("topic")).collect()
    assert {r["id"]: r["topic"] for r in got} == {0: "notice", 1: "notice", 2: "long", 3: "notice", 4: "table", 5: "note"}


def test_given_targets(spark):
    rows = [(i, "w " * 50, "en", "a" if i % 10 else "b", 100) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.draw(df, targets={"source": {"a": 0.5, "b": 0.5, "absent": 3.0}}).groupBy("source").agg(F.sum(F.col("tokens") * F.col("probability")).alias("t"), F.avg(F.col("sampled").cast("double")).alias("s")).collect()
    by = {r["source"]: r for r in out}
    assert by["a"]["t"] == pytest.approx(by["b"]["t"]) and by["b"]["s"] == 1.0 and 0.05 < by["a"]["s"] < 0.18


@pytest.mark.parametrize("driver_cells", [mixing.DRIVER_CELLS, 0])
def test_rare_cells_and_values_do_not_shrink_the_sample(spark, driver_cells):
    rng = random.Random(8)
    cells = [(s, la, t, 500 + rng.randrange(900)) for s in "abc" for la in "xy" for t in "mn"]
    for extra in ([("a", "z", "m", 900), ("c", "z", "n", 2)], [("odd", "one", "only", 3)]):
        df = spark.createDataFrame(cells + extra, "source string, lang string, topic string, tokens long")
        p = {(r["source"], r["lang"], r["topic"]): r["probability"] for r in mixing.factors(df, driver_cells=driver_cells).collect()}
        weight = {c[:3]: float(c[3]) for c in cells + extra}
        total = sum(weight.values())
        kept = sum(weight[c] * p[c] for c in weight)
        assert kept >= 0.4999 * total and all(0 < x <= 1 for x in p.values())
        if extra[0][0] == "odd":
            assert p[extra[0][:3]] == pytest.approx(1.0)
            continue
        for k in range(3):
            own = {}
            for c, w in weight.items():
                own[c[k]] = own.get(c[k], 0) + w
            for v, want in mixing.shares(own, None, 0.85).items():
                assert sum(weight[c] * p[c] for c in weight if c[k] == v) / kept == pytest.approx(want, abs=1e-5)


# Archive audit


def pages(spark, n=900):
    rows = [(i, f"http://h{i % 7}/p{i}", f"<html>é page {i} " + "x" * (i * 37 % 900)) for i in range(n)]
    rows += [(5, None, None), (5, None, None), (n, "u", ""), (n + 1, "u", "y" * 300_000), (None, "u", "no id")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x")).withColumn("file", F.lit(1))


def plain_audit(one, two):
    """Statuses and shifts of two lists of (file, offset, length, id, digest), matched copy by copy."""
    out = []
    for file, i in sorted({(r[0], r[3]) for r in one + two}, key=str):
        x, y = (sorted((r[1], r[2], r[4]) for r in side if (r[0], r[3]) == (file, i)) for side in (one, two))
        for d in sorted({r[2] for r in x} & {r[2] for r in y}):
            for p, q in zip([r for r in x if r[2] == d], [r for r in y if r[2] == d]):
                out.append((file, *p[:2], i, "ok", q[0] - p[0]))
                x.remove(p), y.remove(q)
        for k in range(max(len(x), len(y))):
            p, q = x[k] if k < len(x) else None, y[k] if k < len(y) else None
            out.append((file, *(p or q)[:2], i, "corrupt" if p and q else "missing" if p else "extra", q[0] - p[0] if p and q else None))
    return sorted(out, key=str)


def test_audit_finds_exactly_the_damage(spark):
    p = pages(spark)
    one = warc.pack(p, per_file=128)
    assert warc.audit(one, one).count() == 0
    gone = F.coalesce(F.col("page_id").isin(40, 300), F.lit(False))
    body = F.when(F.col("page_id") % 211 == 3, F.concat(F.lit("#"), F.expr("substring(html, 2)"))).when(F.col("page_id") % 190 == 100, F.concat("html", F.lit("longer"))).otherwise(F.col("html"))
    more = spark.createDataFrame([(500, "u", "once more"), (5, None, None), (None, "u", "no id either")], "page_id long, url string, html string")
    two = warc.pack(p.where(~gone).withColumn("html", body).select("page_id", "url", "html").unionByName(more), per_file=128)
    sides = [[tuple(r) for r in x.select("file", "offset", "length", "id", "digest").collect()] for x in (one, two)]
    want = plain_audit(*sides)
    got = sorted((tuple(r) for r in warc.audited(one, two).collect()), key=str)
    assert got == want
    status = [r[4] for r in got]
    assert (status.count("missing"), status.count("extra"), status.count("corrupt")) == (2, 3, 5 + 5)
    assert sum(r[4] == "ok" and r[5] != 0 for r in got) > 100
    assert warc.audited(one.limit(0), one.limit(0)).count() == 0
    assert warc.audit(one, one.limit(0)).where("status <> 'missing'").count() == 0


def test_one_lost_record_is_one_missing_record(spark):
    p = spark.createDataFrame([(i, f"u{i}", "x" * 50 * (i % 9)) for i in range(20)], "page_id long, url string, html string")
    for other, want in ((p.where("page_id <> 9"), {"ok": 19, "missing": 1}), (p.withColumn("html", F.when(F.col("page_id") == 9, "longer").otherwise(F.col("html"))), {"ok": 19, "corrupt": 1})):
        assert {r["status"]: r["count"] for r in warc.audited(warc.pack(p), warc.pack(other)).groupBy("status").count().collect()} == want


def test_many_records_without_id_are_in_files_of_bounded_size(spark):
    p = spark.createDataFrame([(None, f"u{i % 400}", "body") for i in range(900)], "page_id long, url string, html string")
    files = warc.pack(p, per_file=64).groupBy("file").count().collect()
    assert sum(r["count"] for r in files) == 900 and max(r["count"] for r in files) < 300 and all(r["file"] < 0 for r in files)


def test_offsets_and_files(spark, tmp_path):
    import gzip
    import hashlib

    p = pages(spark, 60).where("page_id is not null")
    key = F.col("page_id")
    records = p.select("page_id", warc.record_of(key, F.col("url"), F.col("html")).alias("r")).collect()
    ordered = sorted(((r["page_id"], hashlib.sha256(r["r"].encode()).hexdigest(), r["r"].encode()) for r in records))
    data = b"".join(x[2] for x in ordered)
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(data))
    leaves = warc.pack(p, per_file=1000)
    got = [(r["offset"], r["length"], r["digest"]) for r in leaves.orderBy("offset").collect()]
    read = warc.read(spark, f"file://{tmp_path}")
    for name in ("a.warc", "b.warc.gz"):
        own = read.where(F.col("file").endswith(name)).orderBy("offset").collect()
        assert [(r["offset"], r["length"], r["digest"]) for r in own] == got
    for step in (1, 7, 1000):  # pieces of any size, several gzip members
        assert [x[3] for x in warc.parse(data[i : i + step] for i in range(0, len(data), step))] == [x[2] for x in ordered]
    zipped = gzip.compress(data[:700]) + gzip.compress(data[700:])
    assert b"".join(x[3] for x in warc.parse(zipped[i : i + 99] for i in range(0, len(zipped), 99))) == data
    with pytest.raises(ValueError):
        list(warc.parse([b"no archive"]))
