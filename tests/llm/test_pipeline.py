import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from chronospark.llm import bpe, mixing, ngrams, pii, quality
from chronospark.llm.queries import RANKS

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tables(spark, documents, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    labels = documents.where("doc_id < 60").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    labels = labels.unionByName(spark.createDataFrame([(402, 0, 0), (407, 0, 0), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int"))
    documents.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_are_named_and_ordered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "PII", "mixing sources to target weights", "byte-level BPE"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_equals_the_stages_by_hand(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    scored = {(r["doc_id"], r["score"]) for r in quality.classify(docs, spark.read.parquet(f"{tables}/labels.parquet")).where("keep").collect()}
    rows = [r for r in docs.collect() if r["doc_id"] in {i for i, _ in scored}]
    # One row of each linked group, by the plain definition.
    from tests.llm.test_groups import parts_of, plain_sets

    sets = plain_sets([(r["doc_id"], r["text"]) for r in rows if r["doc_id"] is not None])
    ids = list(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b])]
    top = parts_of(links, ids)
    first = {}
    for r in rows:
        if r["doc_id"] is None or top[r["doc_id"]] == r["doc_id"]:
            first.setdefault((r["doc_id"], r["text"] if r["doc_id"] is None else None), r)
    kept = spark.createDataFrame(list(first.values()), docs.schema)
    assert corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, docs.schema), tables).count() == kept.count()
    clean = pii.redacted(kept)
    drawn = mixing.draw(clean, only_drawn=True)
    want = bpe.encode(drawn, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    got = corpus_pipeline.run(spark, tables)
    assert got.columns == ["doc_id", "n_tokens", "ids"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_rows_of_one_id_with_other_texts_stay(spark, tables):
    rows = [(1, "one text of its own about stones"), (1, "another text that nothing links to"), (1, "another text that nothing links to"), (1, None), (2, "a third one here with more words")]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), tables)
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(set(rows), key=str)


def test_stages_keep_the_columns(spark, documents, empty, tables):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, documents, tables).columns == documents.columns, name
        assert stage(spark, empty, tables).count() == 0, name


def test_every_query_has_its_name():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in __spark_entry__.queries()


def test_archive_audit_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{folder}/pages.parquet'")
    want = con.sql(__spark_entry__.oracle_sql()["op6_warc"]).fetchall()
    got = __spark_entry__.queries()["op6_warc"](spark, folder)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_joins_do_not_depend_on_the_deal(spark, documents):
    a = ngrams.link_documents(documents).select("doc_id", "component_id")
    b = ngrams.link_documents(documents.repartition(9)).select("doc_id", "component_id")
    assert a.exceptAll(b).count() == 0
