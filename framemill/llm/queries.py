"""The queries of this subpackage, with their parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encoded

    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import secret_digests

    return secret_digests(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_gam import scored, train

    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_lm import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"), least=2)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archived

    return archived(table(spark, sf_dir, "pages"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"), similarity=0.8, shingle=5)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, scored

    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_byte_bpe, op2_token_counts, op3_secret_scan, op4_quality_classifier, op5_lm_scores, op6_warc, op7_jaccard_join, op8_quality_rules, op9_toxicity, op10_decontamination)}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op5_lm_scores": f"""
with d as (select doc_id, {_WORDS} as ws from documents),
t as (select doc_id, i, ws[i] as w, case when i > 1 then ws[i - 1] end as v from d, unnest(range(1, len(ws) + 1)) as t(i)),
u as (select w, count(*) as c from t group by 1), n as (select count(*) as n from t),
b as (select v, w, count(*) as c from t where v is not null group by 1, 2),
s as (select doc_id, case when t.v is null then 0 when b.c >= 2 then 0 else 1 end as backed,
  case when b.c >= 2 then round(1e6 * ln(cast(b.c as double) / uv.c)) else (case when t.v is null then 0 else round(1e6 * ln(0.4)) end) + round(1e6 * ln(cast(uw.c as double) / n.n)) end as m
  from t cross join n join u uw on uw.w = t.w left join u uv on uv.w = t.v left join b on b.v = t.v and b.w = t.w)
select d.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(sum(backed), 0) as bigint) as n_backoff, coalesce(sum(m), 0) / 1e6 as score, coalesce(sum(m), 0) / 1e6 / greatest(len(ws), 1) as mean_score
from d left join s using (doc_id) group by d.doc_id, ws""",
    "op6_warc": """
with p as (select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by 1)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
  case when first is not null and page_id <> first then 'revisit' else 'response' end as record_type,
  case when first is not null and page_id <> first then first end as refers_to
from p left join f using (payload_digest)""",
    "op7_jaccard_join": f"""
with recursive d as (select doc_id, {_WORDS} as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i : i + 4], ' ') as g from d, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as t(i) where len(ws) > 0),
n as (select doc_id, count(*) as n from s group by 1),
pairs as (select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y using (g) where x.doc_id <> y.doc_id group by 1, 2),
links as (select a, b from pairs join n na on a = na.doc_id join n nb on b = nb.doc_id where k >= 0.8 * (na.n + nb.n - k) - 1e-9),
reach(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from reach r join links l on r.b = l.a),
class as (select a as doc_id, min(b) as class_id from reach group by 1)
select doc_id, class_id, (select count(*) from links where a = doc_id) as n_links from class""",
    "op10_decontamination": f"""
with d as (select doc_id, {_WORDS} as ws from documents), b as (select item_id, {_WORDS} as ws from benchmark),
win as (select distinct item_id, least(10, len(ws)) as k, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') as g from b, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) as t(i) where len(ws) > 0),
ks as (select distinct k from win),
spots as (select doc_id, k, i, array_to_string(ws[i : i + k - 1], ' ') as g from d, ks, unnest(range(1, len(ws) - k + 2)) as t(i)),
hits as (select doc_id, i, k, item_id from spots join win using (k, g)),
covered as (select doc_id, count(distinct i + j) as n_hit from hits, unnest(range(0, k)) as t(j) group by 1),
items as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, cast(item_id as varchar) as id from hits) group by 1),
places as (select r, j, least(10, len(ws)) as k, array_to_string(ws[j : j + least(10, len(ws)) - 1], ' ') as g from (select ws, row_number() over () as r from b), unnest(range(1, len(ws) - least(10, len(ws)) + 2)) as t(j) where len(ws) > 0),
steps as (select doc_id, r, i, j, k, i - row_number() over (partition by doc_id, r, k, i - j order by i) as run from spots join places using (k, g)),
matches as (select doc_id, min(i) as i, count(*) + k - 1 as n from steps group by doc_id, r, k, i - j, run),
longest as (select doc_id, max(n) as n_longest, arg_min(i, (-n, i)) - 1 as longest_at from matches group by 1)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated,
  cast(coalesce(n_longest, 0) as bigint) as n_longest, cast(coalesce(longest_at, -1) as bigint) as longest_at
from d left join covered using (doc_id) left join items using (doc_id) left join longest using (doc_id)""",
}
