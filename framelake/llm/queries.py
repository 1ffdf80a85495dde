"""Queries over the synthetic tables, one for each operator of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embedding_dedup, filter_audit, importance, langid, license_scan, line_dedup, lm_score, minhash, mixing, pii, suffix_dedup, url_filter
from .common import read_table

#: The tables hold no list and no fetch times: both follow from host and page_id by these rules.
_DAY_ZERO = "2024-01-01"


def _spread(host: Column) -> Column:
    return F.conv(F.substring(F.md5(host), 1, 6), 16, 10).cast("int")


def list_entries(hosts: DataFrame) -> DataFrame:
    """Dated entries of three lists for hosts chosen by their md5."""
    h = hosts.select("host", _spread(F.col("host")).alias("b"))

    def entry(where: str, name: str, scope: str, key: Column, action: str, day: Column) -> DataFrame:
        at = F.date_add(F.lit(_DAY_ZERO).cast("date"), day.cast("int")).cast("timestamp")
        return h.where(where).select(F.lit(name).alias("list_name"), F.lit(scope).alias("scope"), key.alias("key"), F.lit(action).alias("action"), at.alias("listed_at"))

    host, b = F.col("host"), F.col("b")
    out = entry("b % 4 = 0", "abuse", "host", host, "block", b % 300)
    out = out.union(entry("b % 4 = 0", "abuse", "host", host, "remove", b % 300 + 60))
    out = out.union(entry("b % 3 = 0", "farms", "domain", F.regexp_extract(host, r"([^.]+\.[^.]+\.[^.]+)$", 1), "block", b % 200 + 90))
    return out.union(entry("b % 5 = 0", "trusted", "prefix", F.concat(host, F.lit("/en")), "allow", b % 250))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    at = F.date_add(F.lit(_DAY_ZERO).cast("date"), (F.col("page_id") % 366).cast("int")).cast("timestamp")
    captures = pages.withColumn("fetched_at", at)
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    done = url_filter.filter_urls(captures, list_entries(hosts))
    return done.select("page_id", "url", "decision", "list_name", "scope", "key", F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("key")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"), keep_bytes=False)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents")).drop("key")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(read_table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents")).drop("key")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(read_table(spark, sf_dir, "documents")))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(read_table(spark, sf_dir, "embeddings"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.remove_common_blocks(read_table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.col("n_lines_in_").alias("n_lines"), (F.col("n_lines_in_") - F.col("n_lines_out_")).alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan_licenses(read_table(spark, sf_dir, "documents"))[0])


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_OPS = (
    op1_url_filter, op2_decontamination, op3_suffix_dedup, op4_language_id, op5_lm_score, op6_source_mixing, op7_minhash_near_dedup, op8_personal_data,
    op9_embedding_near_dedup, op10_line_dedup, op11_license_scan, op12_filter_audit, op13_importance_resampling,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _OPS}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _license_sql() -> str:
    """Every block of every template's length beside every template, by plain counting."""
    listed = [(t, label, license_scan.template_words(text)) for t, (label, text) in enumerate(license_scan.TEMPLATES)]
    words = ", ".join(f"({t}, '{label}', {1 << (len(w) - 1).bit_length()}, '{x}')" for t, label, w in listed for x in sorted(set(w)))
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in license_scan.PHRASES.items())
    return rf"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
t(template, label, step, word) as (values {words}),
n as (select template, count(*) as n from t group by template),
p(phrase, label) as (select string_split(phrase, ' '), label from (values {phrases}) v(phrase, label)),
x as (select doc_id, unnest(w) as word, unnest(range(0, len(w))) as i from w),
b as (
  select doc_id, template, label, step, i // step as block, word from x join t using (word)
  union select doc_id, template, label, step, i // step - 1, word from x join t using (word) where i >= step),
m as (
  select doc_id, template, label, count(*) / n as containment from b join n using (template)
  group by doc_id, template, label, step, block, n having count(*) >= {license_scan.THRESHOLD} * n),
f as (select doc_id, label, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1:i + len(phrase)] = phrase)) as place from w, p where len(list_intersect(w, phrase)) = len(phrase)),
g as (select doc_id, count(*) as n_base, min(place) as first_word, max(place) as last_word, string_agg(distinct label, ',' order by label) as base_labels from f group by doc_id),
l as (select doc_id, string_agg(distinct label, ',' order by label) as labels from (select doc_id, label from m union select doc_id, label from f) group by doc_id),
s as (select doc_id, max(containment) as best from m group by doc_id)
select w.doc_id, len(w.w) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
  case when n_base > 0 then 1.0::double else coalesce(best, 0.0)::double end as score
from w left join g using (doc_id) left join l using (doc_id) left join s using (doc_id)"""


ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": r"""
with p as (
  select page_id, url, date '2024-01-01' + cast(page_id % 366 as integer) as fetched,
    nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') as host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') as parts
  from pages),
h as (select host, cast(('0x' || substr(md5(host), 1, 6)) as integer) as b from (select distinct host from p where host is not null)),
e as (
  select 'abuse' as list_name, 'host' as scope, host as key, 'block' as action, date '2024-01-01' + b % 300 as day from h where b % 4 = 0
  union select 'abuse', 'host', host, 'remove', date '2024-01-01' + b % 300 + 60 from h where b % 4 = 0
  union select 'farms', 'domain', regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1), 'block', date '2024-01-01' + b % 200 + 90 from h where b % 3 = 0
  union select 'trusted', 'prefix', host || '/en', 'allow', date '2024-01-01' + b % 250 from h where b % 5 = 0),
v as (select *, lead(day) over (partition by list_name, scope, key order by day) as until from e),
k as (
  select page_id, url, fetched, 'host' as scope, host as key, 2 as rank from p
  union select page_id, url, fetched, 'domain', array_to_string(string_split(host, '.')[i:], '.'), 1 from p, unnest(range(1, 1 + len(string_split(host, '.')))) t(i)
  union select page_id, url, fetched, 'prefix', lower(host || '/' || array_to_string(parts[:i], '/')), 3 from p, unnest(range(1, 1 + len(parts))) t(i)),
m as (
  select k.page_id, k.url, v.action, v.list_name, v.scope, v.key, v.day,
    row_number() over (partition by k.page_id, k.url order by k.rank desc, length(v.key) desc, v.action = 'allow' desc, v.list_name desc) as n
  from k join v on k.scope = v.scope and k.key = v.key and k.fetched >= v.day and (v.until is null or k.fetched < v.until)
  where v.action <> 'remove')
select p.page_id, p.url, coalesce(m.action, 'keep') as decision, m.list_name, m.scope, m.key, strftime(m.day, '%Y-%m-%d') as valid_from
from p left join m on p.page_id = m.page_id and p.url = m.url and m.n = 1""",
    "op2_decontamination": r"""
with d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where doc_id is not null),
b as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from benchmark where item_id is not null),
bs as (select distinct item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) as s from b where len(w) >= 5),
n as (select item_id, count(*) as n_shingles from bs group by item_id),
ds as (select distinct doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) as s from d where len(w) >= 5)
select doc_id, item_id, n_shingles, count(*) as n_found, count(*) / n_shingles as containment
from ds join bs using (s) join n using (item_id) group by doc_id, item_id, n_shingles having count(*) >= 0.75 * n_shingles""",
    "op7_minhash_near_dedup": rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) as s from w where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select x.doc_id as a, y.doc_id as b, count(*) as i from s x join s y on x.s = y.s and x.doc_id <> y.doc_id group by x.doc_id, y.doc_id),
e as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * i >= 75 * (na.n + nb.n - i)),
r(v, c) as (select doc_id, doc_id from documents union select e.b, r.c from r join e on r.v = e.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, r.c as component_id, d.doc_id = r.c as kept
from documents d left join n on n.doc_id = d.doc_id join (select v, min(c) as c from r group by v) r on r.v = d.doc_id""",
    "op9_embedding_near_dedup": r"""
with recursive g as (select vec_id, cast(embedding as double[]) as x from embeddings),
e as (select a.vec_id as a, b.vec_id as b from g a join g b on a.vec_id <> b.vec_id where list_cosine_similarity(a.x, b.x) >= 0.9),
r(v, c) as (select vec_id, vec_id from g union select e.b, r.c from r join e on r.v = e.a)
select g.vec_id, coalesce(k.n, 0) as n_links, r.c as component_id, g.vec_id = r.c as kept
from g left join (select a, count(*) as n from e group by a) k on k.a = g.vec_id join (select v, min(c) as c from r group by v) r on r.v = g.vec_id""",
    "op11_license_scan": _license_sql(),
    "op12_filter_audit": r"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
e as (select text, min(doc_id) as least from d group by text),
l as (select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels group by doc_id),
f as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic, len(w) < 200 as A, 100 * list_unique(w) < 50 * len(w) as B,
    100 * len(regexp_extract_all(d.text, '[A-Z]')) > 3 * length(d.text) as C, regexp_matches(d.text, '[#$%&*|]') as D, doc_id > least as E
  from d join e on e.text = d.text left join l using (doc_id)),
k as (select part, good, toxic, (case when A then 'A' else '' end) || (case when B then 'B' else '' end) || (case when C then 'C' else '' end) || (case when D then 'D' else '' end) || (case when E then 'E' else '' end) as fails from f),
c as (select part, fails, count(*) as n, count(*) filter (good) as g, count(*) filter (toxic) as t from k group by part, fails),
x(f) as (values ('A'), ('B'), ('C'), ('D'), ('E')),
o as (
  select a.f || b.f || c.f || d.f || e.f as filter_order from x a, x b, x c, x d, x e
  where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s as (select filter_order, step, substr(filter_order, step, 1) as own, substr(filter_order, 1, step - 1) as before from o, (select unnest(range(1, 6)) as step)),
r as (
  select part, filter_order, step, own,
    sum(n) filter (not contains(fails, own) and not regexp_matches(fails, '[' || before || '-]')) as kept,
    sum(n) filter (contains(fails, own) and not regexp_matches(fails, '[' || before || '-]')) as removed,
    sum(n) filter (contains(fails, own) and regexp_matches(fails, '[' || before || '-]')) as redundant,
    sum(n) filter (fails = own) as unique_fails,
    sum(g) filter (contains(fails, own) and not regexp_matches(fails, '[' || before || '-]')) as good_lost,
    sum(t) filter (contains(fails, own) and not regexp_matches(fails, '[' || before || '-]')) as toxic_lost
  from c, s group by part, filter_order, step, own)
select part, filter_order, cast(step as integer) as step, cast(coalesce(kept, 0) as bigint) as kept, cast(coalesce(removed, 0) as bigint) as removed,
  cast(coalesce(redundant, 0) as bigint) as redundant, cast(coalesce(unique_fails, 0) as bigint) as unique_fails, cast(coalesce(good_lost, 0) as bigint) as good_lost,
  cast(coalesce(toxic_lost, 0) as bigint) as toxic_lost, cast(coalesce(sum(removed) over (partition by part, own), 0) as bigint) as shapley
from r""",
    "op13_importance_resampling": rf"""
with a as (
  select list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) order by n) as crc
  from (select unnest(range(0, 256)) as n)),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
dw as (select doc_id, unnest(w) as word from d), bw as (select unnest(w) as word from b),
v as (select word, hex(encode(word)) as x from (select word from dw union select word from bw)),
h as (
  select word, xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(0, len(x) // 2), lambda i: cast('0x' || substr(x, 2 * i + 1, 2) as bigint))),
    lambda c, y: xor(c // 256, crc[1 + xor(c, y) % 256])), 4294967295) % 10000 as bucket from v, a),
s as (select bucket, count(*) as s from dw join h using (word) group by bucket),
t as (select bucket, count(*) as t from bw join h using (word) group by bucket),
g as (
  select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select count(*) from dw) + 10000)::double / ((s + 1)::double * ((select count(*) from bw) + 10000)::double))) as gain
  from s left join t using (bucket)),
w as (select doc_id, cast(sum(gain) as bigint) as weight from dw join h using (word) join g using (bucket) group by doc_id),
c as (
  select d.doc_id, len(d.w)::bigint as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) as bigint)::double + 0.5) / 4294967296))) as bigint) as score
  from d left join w using (doc_id)),
r as (select *, case when n_features >= 20 then row_number() over (partition by n_features >= 20 order by score desc, doc_id) end as place from c)
select doc_id, n_features, weight, score, case when place <= 10 * (select count(*) from c where n_features >= 20) // 100 then place end as rank from r""",
}
