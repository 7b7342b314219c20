"""The registered queries of this subpackage and, where SQL can say them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embeddings, fingerprints, mixing, ngrams, pii, quality, secrets, substrings, warc
from ._store import table
from .spans import base_only, count_of, joined

#: The vocabulary that the queries use, by its public name.
RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [count_of(F.col("spans"), k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base_only(F.col("spans"))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.draw(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, digests=True)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents"))
    counts = [count_of(F.col("spans"), k).alias(f"n_{k}") for k in secrets.KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(joined(base_only(F.col("spans"))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def damaged(pages: DataFrame) -> DataFrame:
    """A second replica with one record in eight or so damaged: bytes changed, bodies that
    became longer, records lost anywhere, and records that the first one lacks."""
    every = lambda n, k: F.coalesce(F.pmod("page_id", F.lit(n)) == k, F.lit(False))
    body = F.when(every(29, 13), F.concat(F.lit("#"), F.expr("substring(html, 2)"))).when(every(31, 7), F.concat("html", F.lit("<!-- more -->"))).otherwise(F.col("html"))
    left = pages.where(~every(37, 5)).withColumn("html", body)
    return left.unionByName(pages.where(every(41, 3)).withColumn("page_id", F.col("page_id") + 10_000_019))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.audited(warc.pack(pages), warc.pack(damaged(pages))).withColumnRenamed("id", "page_id")


def op7_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.link_documents(table(spark, sf_dir, "documents"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_digests(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_pii": op2_pii,
    "op3_mixing": op3_mixing,
    "op4_bpe": op4_bpe,
    "op5_secrets": op5_secrets,
    "op6_warc": op6_warc,
    "op7_ngrams": op7_ngrams,
    "op8_embeddings": op8_embeddings,
    "op9_substrings": op9_substrings,
    "op10_quality": op10_quality,
}

_WORDS = "regexp_extract_all(coalesce({0}, ''), '[^\\x20\\x09-\\x0D]+')"
_REACH = """r(id, c) as (select {id}, {id} from {table} union select r.id, l.b from r join l on r.c = l.a), k as (select id, min(c) as component_id from r group by 1)"""

ORACLES: dict[str, str] = {
    "op7_ngrams": f"""
with recursive w as (select doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from w),
n as (select doc_id, count(*) as n from s group by 1),
i as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
l as materialized (select a, b from i join n p on p.doc_id = a join n q on q.doc_id = b where 100 * c >= 80 * (p.n + q.n - c)),
{_REACH.format(id="doc_id", table="documents")}
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, k.component_id from documents d left join n using (doc_id) join k on k.id = d.doc_id
""",
    "op8_embeddings": f"""
with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings where label is not null and embedding is not null),
ok as (select * from v where len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
l as materialized (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.98),
{_REACH.format(id="vec_id", table="embeddings")}
select e.vec_id, (select count(*) from l where l.a = e.vec_id) as n_links, k.component_id, k.component_id = e.vec_id as kept from embeddings e join k on k.id = e.vec_id
""",
    "op9_substrings": f"""
with w as (select doc_id, {_WORDS.format("text")} as w from documents),
x as (select doc_id, w, unnest(range(1, greatest(len(w) - 48, 1))) as i from w),
g as (select doc_id, i, hash(array_to_string(w[i:i+49], ' ')) as h, md5(array_to_string(w[i:i+49], ' ')) as m from x),
f as (select doc_id, i from g qualify min(doc_id) over (partition by h, m) < doc_id),
r as (select distinct doc_id, unnest(range(i, i + 50)) as j from f),
p as (select doc_id, unnest(w) as t, unnest(range(1, len(w) + 1)) as j from w),
k as (select p.doc_id, count(*) as kept, string_agg(t, ' ' order by p.j) as t from p anti join r on r.doc_id = p.doc_id and r.j = p.j group by 1),
i as (select doc_id, j, j - row_number() over (partition by doc_id order by j) as island from r),
m as (select doc_id, min(j) - 1 as s, max(j) as e from i group by doc_id, island),
x2 as (select doc_id, string_agg(s || ':' || e, ',' order by s) as repeats from m group by 1)
select w.doc_id, cast(len(w.w) as bigint) as n_words, cast(len(w.w) - coalesce(k.kept, 0) as bigint) as n_removed, sha256(coalesce(k.t, '')) as kept_sha256, coalesce(x2.repeats, '') as repeats from w left join k using (doc_id) left join x2 using (doc_id)
""",
    "op6_warc": """
with a as (select page_id, url, html from pages),
b as (select page_id, url, case when page_id % 29 = 13 then '#' || substring(html, 2) when page_id % 31 = 7 then html || '<!-- more -->' else html end as html from pages where page_id % 37 <> 5
      union all select page_id + 10000019, url, html from pages where page_id % 41 = 3),
ra as (select page_id, page_id // 512 as file, 'WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:' || page_id
       || '>\r\nWARC-Target-URI: ' || url || '\r\nContent-Type: text/html\r\nContent-Length: '
       || strlen(html) || '\r\n\r\n' || html || '\r\n\r\n' as rec from a),
rb as (select page_id, page_id // 512 as file, 'WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:' || page_id
       || '>\r\nWARC-Target-URI: ' || url || '\r\nContent-Type: text/html\r\nContent-Length: '
       || strlen(html) || '\r\n\r\n' || html || '\r\n\r\n' as rec from b),
oa as (select *, strlen(rec) as len, coalesce(sum(strlen(rec)) over (partition by file order by page_id rows between unbounded preceding and 1 preceding), 0) as off from ra),
ob as (select *, strlen(rec) as len, coalesce(sum(strlen(rec)) over (partition by file order by page_id rows between unbounded preceding and 1 preceding), 0) as off from rb)
select cast(coalesce(oa.file, ob.file) as bigint) as file, cast(coalesce(oa.off, ob.off) as bigint) as "offset", cast(coalesce(oa.len, ob.len) as bigint) as length, coalesce(oa.page_id, ob.page_id) as page_id,
       case when ob.rec is null then 'missing' when oa.rec is null then 'extra' when oa.rec <> ob.rec then 'corrupt' else 'ok' end as status, cast(ob.off - oa.off as bigint) as shift
from oa full join ob on oa.page_id = ob.page_id
""",
}
