"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkquill.llm import align, decontaminate, fingerprints, jaccard, licenses, lines, pieces, quality, repeats, secrets, toxicity, urls, warc
from sparkquill.llm.batches import small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_classes(_table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_audit(_table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaked_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return licenses.license_scan(docs.select("doc_id", licenses.document_paths(docs.doc_id, docs.source, docs.lang).alias("path"), "text"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_components(_table(spark, sf_dir, "documents"))


#: verdict, host, path
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_verdicts(_table(spark, sf_dir, "pages"), urls.rules_table(spark, URL_RULES))


def op10_warc_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.replica_audit(_table(spark, sf_dir, "pages"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup_audit(_table(spark, sf_dir, "documents"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.run_audit(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_edit_fingerprints, op2_secret_scan, op3_sentencepiece, op4_benchmark_decontamination, op5_license_scan, op6_toxicity, op7_quality_classifier, op8_ngram_jaccard_join, op9_url_filters, op10_warc_merkle_audit, op11_line_dedup, op12_tokenizer_alignment, op13_periodic_runs)}

_ASSIGN = "(" + "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY])" + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = [("assign", _ASSIGN), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+"), ("token", "[A-Za-z0-9+/_-]{20,}")]
_MATCHES = " union all ".join(f"select r, {k} as kind, '{name}' as name, unnest(list_concat(regexp_extract_all(t, '{p}'), [''])) as x, unnest(string_split_regex(t, '{p}')) as gap, unnest(range(len(string_split_regex(t, '{p}')))) as i from d" for k, (name, p) in enumerate(_KINDS))

ORACLES: dict[str, str] = {
    "op2_secret_scan": rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t, coalesce(source, chr(0)) as owner, coalesce(lang, chr(0)) as repo from documents),
m as ({_MATCHES}),
p as (select r, kind, name, x, cast(sum(length(gap)) over w + sum(length(x)) over w - length(x) as bigint) as a from m window w as (partition by r, kind order by i)),
s as (select r, kind, name, a, a + length(x) as b, case when kind = 0 then regexp_extract(x, '{_ASSIGN}', 2) else x end as value from p where x <> ''),
base as (select * from s where length(value) >= case kind when 0 then 6 when 1 then 20 when 2 then 24 end),
high as (select * from s where kind = 3 and regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Za-z]')
  and not exists (select 1 from base where base.r = s.r and base.a < s.b and s.a < base.b)
  and round(-list_sum(list_transform(list_transform(list_distinct(string_split(value, '')), lambda c: len(list_filter(string_split(value, ''), lambda y: y = c)) / length(value)), lambda q: q * log2(q))), 9) >= 3.5),
found as (select * from base union all select * from high),
stats as (select value, count(distinct owner) as owners, count(distinct owner || chr(1) || repo) as repos from found join d using (r) group by 1),
judged as (select found.*, case when owners >= 3 or repos >= 4 then 'example' when owners = 1 and repos <= 2 then 'live' else 'shared' end as class from found join stats using (value)),
g as (select r, count(*) filter (kind = 0) as n0, count(*) filter (kind = 1) as n1, count(*) filter (kind = 2) as n2,
  string_agg(name || ':' || a || ':' || b, ',' order by a, kind, b) filter (kind < 3) as own, string_agg(name || ':' || a || ':' || b, ',' order by a, kind, b) filter (kind < 3 or class = 'live') as spans,
  count(*) filter (class = 'live') as n_live, count(*) filter (class = 'shared') as n_shared, count(*) filter (class = 'example') as n_example from judged group by 1)
select doc_id, coalesce(n0, 0) as n_assign, coalesce(n1, 0) as n_access, coalesce(n2, 0) as n_hex, sha256(coalesce(own, '')) as base_sha256, coalesce(spans, '') as spans,
  coalesce(n_live, 0) as n_live, coalesce(n_shared, 0) as n_shared, coalesce(n_example, 0) as n_example from d left join g using (r)
""",
    "op9_url_filters": r"""
with u as (select page_id, coalesce(url, '') as url, instr(coalesce(url, ''), '://') as spot from pages),
h as (select page_id, translate(regexp_extract(case when spot > 0 then substr(url, spot + 3) else '' end, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  case when spot > 0 then substr(url, spot + 3) else '' end as rest from u),
p as (select page_id, host, regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') as path from h),
r as (select * from (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) t(verdict, host, path))
select p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') as verdict
from p left join lateral (
  select r.host || r.path as rule, r.verdict from r
  where (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
  order by length(r.host || r.path) desc limit 1) b on true
""",
    "op10_warc_merkle_audit": r"""
with w as (select page_id, coalesce(url, '') as url, coalesce(html, '') as html from pages),
b as (select page_id, url, html, chr(0) || substr(html, 2) as bad, chr(13) || chr(10) as nl from w),
c as (select *, 'WARC/1.0' || nl || 'WARC-Type: resource' || nl || 'WARC-Record-ID: <urn:uuid:' as head, regexp_replace(md5(url || chr(10) || html), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') as id,
  regexp_replace(md5(url || chr(10) || bad), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') as bad_id,
  '>' || nl || 'WARC-Date: 1970-01-01T00:00:00Z' || nl || 'WARC-Target-URI: ' || url || nl || 'Content-Type: text/html' || nl || 'Content-Length: ' as rest, nl || nl as gap from b),
d as (select page_id, coalesce(page_id // 1000, -1) as file, head || id || rest || strlen(html) || gap || html || gap as rec, html,
  head || bad_id || rest || strlen(bad) || gap || bad || gap as rec_bad from c),
e as (select page_id, file, strlen(rec) as length, sha256(rec) as sha256,
  case when page_id % 50 = 0 and html <> '' then sha256(rec_bad) when page_id % 50 = 7 then null else sha256(rec) end as other from d),
f as (select *, coalesce(sum(length) over (partition by file order by page_id, sha256 rows between unbounded preceding and 1 preceding), 0)::bigint as start from e),
g as (select 0 as side, file, start, length, sha256 as sha from f union all select 1, file, start, length, other from f where other is not null),
l0 as (select side, file, start >> 16 as node, sha256(string_agg(start || ':' || length || ':' || sha, chr(10) order by start, length, sha)) as hash from g group by 1, 2, 3),
l1 as (select side, file, node >> 8 as node, sha256(string_agg(node || ':' || hash, chr(10) order by node)) as hash from l0 group by 1, 2, 3),
l2 as (select side, file, node >> 8 as node, sha256(string_agg(node || ':' || hash, chr(10) order by node)) as hash from l1 group by 1, 2, 3),
l3 as (select side, file, node >> 8 as node, sha256(string_agg(node || ':' || hash, chr(10) order by node)) as hash from l2 group by 1, 2, 3),
l4 as (select side, file, sha256(string_agg(node || ':' || hash, chr(10) order by node)) as hash from l3 group by side, file, node >> 8)
select f.page_id, 'crawl-' || f.file as file, f.start as "offset", f.length, f.sha256, a.hash as root, b.hash as other_root,
  case when f.other is null then 'missing' when f.other <> f.sha256 then 'changed' else 'ok' end as status
from f left join l4 a on a.file = f.file and a.side = 0 left join l4 b on b.file = f.file and b.side = 1
""",
    "op11_line_dedup": r"""
with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
x as (select r, doc_id, unnest(l) as line, unnest(range(len(l))) as i from d),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from x),
s as (select key, max(doc_id) as last from k where length(key) >= 20 group by 1 having count(distinct doc_id) >= 3),
j as (select k.r, k.line, k.i, s.key is not null and k.doc_id < s.last as gone from k left join s on s.key = k.key)
select d.doc_id, len(d.l) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from d join j using (r) group by d.r, d.doc_id, d.l
""",
    "op8_ngram_jaccard_join": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
s as (
  select distinct doc_id, array_to_string(case when len(w) < 5 then w else w[i:i + 4] end, ' ') as s
  from w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as t(i) where len(w) > 0),
n as (select doc_id, count(*) as n from s group by 1),
common as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
link as (select c.a, c.b from common c join n x on x.doc_id = c.a join n y on y.doc_id = c.b where 100 * c.k >= 80 * (x.n + y.n - c.k)),
reach(a, b) as (select a, b from link union select r.a, l.b from reach r join link l on l.a = r.b)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, least(d.doc_id, coalesce(r.m, d.doc_id)) as component_id, coalesce(l.n_links, 0) as n_links
from documents d left join n on n.doc_id = d.doc_id left join (select a, min(b) as m from reach group by 1) r on r.a = d.doc_id
left join (select a, count(*) as n_links from link group by 1) l on l.a = d.doc_id
""",
}
