"""Queries of the training-data operators over the tables of a folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from radspark.llm import classifier, decontamination, jaccard, mixing, quality_rules, secrets, sharding, tokens, toxicity, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "kind", "n_windows", "n_slots", "first_word")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(_table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def queries() -> dict:
    found = (
        op1_sharding, op2_mixing, op3_secrets, op4_toxicity, op5_decontamination,
        op6_quality, op7_tokens, op8_quality_rules, op9_urls, op10_jaccard,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express over whole tables."""
    return {"op2_mixing": _MIXING, "op9_urls": _URLS, "op10_jaccard": _JACCARD}


_MIXING = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    ('0x' || substr(md5('mix' || coalesce(cast(doc_id as varchar), '')), 1, 15))::bigint as key,
    ('0x' || substr(md5(coalesce(text, '')), 1, 15))::bigint as tie
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source is null, source) as rank from d group by source),
w as (select *, cast([5, 2, 1][cast((rank - 1) % 3 + 1 as int)] as double) as w, 2.0::double * source_size as cap, 1.5::double * sum(source_size) over () as pot from s),
l as (select *, cap / w as ratio,
    (pot - coalesce(sum(cap) over (order by cap / w, rank rows between unbounded preceding and 1 preceding), 0)) / sum(w) over (order by cap / w, rank rows between current row and unbounded following) as level
  from w),
t as (select source, source_size, least(cap, coalesce((select arg_min(level, (ratio, rank)) from l where level <= ratio) * w, cap)) as target from l),
p as (
  select d.*, t.source_size, t.target, floor(t.target + 1e-6) as budget, coalesce(sum(size) over (partition by d.source order by key >> 51, tie >> 55, key, tie rows between unbounded preceding and 1 preceding), 0) as before
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
  cast(case when source_size > 0 then floor(budget / source_size) * size + greatest(0, least(size, budget - floor(budget / source_size) * source_size - before)) else 0 end as bigint) as taken
from p
"""

_URLS = r"""
with u as (select page_id, case when url like '%://%' then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, regexp_extract(rest, '^[^/?#]*') as raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
p as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from h),
r(host, path, verdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f as (
  select p.page_id, p.host, p.path, r.host || r.path as rule, r.verdict, row_number() over (partition by p.page_id order by length(r.host || r.path) desc nulls last) as k
  from p left join r on (p.host = r.host or p.host like '%.' || r.host) and starts_with(p.path, r.path))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from f where k = 1
"""

_JACCARD = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) end) as s
  from w),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r as (select a as doc_id, a as other from e union select r.doc_id, e.b from r join e on e.a = r.other),
m as (select doc_id, min(other) as least from r group by doc_id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(m.least, d.doc_id) as component_id from documents d left join n using (doc_id) left join m using (doc_id)
"""
