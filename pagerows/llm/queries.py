"""The operators' queries, with production parameters over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embed_dedup, langid, manifest, mixing, periodic, pii, piece_bpe, simhash, token_count, token_store, toxicity, url_filter
from .base import held_out, table

WORDS, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", *columns)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_documents(spark, sf_dir), public_tokenizers.path(WORDS))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    lexicon = toxicity.fit(documents, table(spark, sf_dir, "labels"))
    return toxicity.score(documents, lexicon).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir, "lang")
    return langid.identify(documents, langid.fit(documents)).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected"
    )


def op6_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_decode(_documents(spark, sf_dir), public_tokenizers.path(PIECES))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    return pii.report(documents, pii.fit(documents))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_round_trip(_documents(spark, sf_dir), public_tokenizers.path(WORDS))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def planted_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """The contract's planted repetition: from word a on, the p words from a repeat."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % (1 + (n - a) // (3 + g % 8)))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(_documents(spark, sf_dir), planted_order)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return manifest.manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], altered={"text": tampered})


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir, "source"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_decontamination, op2_token_counts, op3_toxicity, op4_simhash, op5_language_id,
        op6_piece_bpe, op7_pii, op8_embedding_dedup, op9_token_store, op10_url_filter,
        op11_periodic_runs, op12_merkle_manifest, op13_source_mixing,
    )}


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
with d as (select doc_id, regexp_extract_all({_LOWER.format('text')}, '{_WORD}') as w from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all({_LOWER.format('text')}, '{_WORD}') as w from benchmark),
p as (select item, least(13, len(w)) as m, unnest(range(greatest(1, len(w) - 12))) as i, w from b where len(w) > 0),
pat as (select item, m, array_to_string(w[i + 1 : i + m], ' ') as k from p),
lens as (select distinct m from pat),
win as (select doc_id, m, i, array_to_string(w[i + 1 : i + m], ' ') as k
  from (select doc_id, m, w, unnest(range(len(w) - m + 1)) as i from d, lens where len(w) >= m)),
hits as (select distinct doc_id, item, win.m, i from win join pat using (m, k)),
words as (select doc_id, count(distinct i + o) as n_hit
  from (select doc_id, i, unnest(range(m)) as o from (select distinct doc_id, m, i from hits)) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as s
  from (select distinct doc_id, item from hits) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(s, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
from d left join words using (doc_id) left join items using (doc_id)
"""

OP10 = """
with u as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from u),
s as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from h),
r(rh, rp, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f as (select page_id, rh || rp as rule, v, row_number() over (partition by page_id order by length(rh || rp) desc, length(rh) desc) as k
  from s join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp))
select s.page_id, host, path, rule, coalesce(v, 'allow') as verdict from s left join (select * from f where k = 1) f using (page_id)
"""


#: crc32 of the decimal ids, bit by bit.
_CRC = """crc(doc_id, s, k, c) as (
  select distinct doc_id, cast(doc_id as varchar), 0, cast(4294967295 as bigint) from documents where doc_id is not null
  union all
  select doc_id, s, k + 1, xor(x >> 1, 3988292384 * (x & 1))
  from (select *, case when k % 8 = 0 then xor(c, ascii(substr(s, k // 8 + 1, 1))) else c end as x from crc where k < 8 * length(s))),
hashed as (select doc_id, xor(c, 4294967295) as h from crc where k = 8 * length(s))"""

OP11 = rf"""
with recursive {_CRC},
d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, w, cast(len(w) as bigint) as n, h, h // 10 as g from d left join hashed using (doc_id)),
a as (select *, case when h % 10 = 0 and n > 0 then g % n end as a from s),
p as (select *, 1 + (n - a) // (3 + g % 8) as p from a),
t as (select doc_id, n, i, w[1 + case when i >= a then a + (i - a) % p else i end] as t
  from (select *, unnest(range(n)) as i from p)),
m as (select x.doc_id, x.i, y.i - x.i as q from t x join t y on x.doc_id = y.doc_id and x.t = y.t and y.i > x.i and 3 * (y.i - x.i) <= x.n),
g as (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as island from m),
c as (select doc_id, q, min(i) as start, count(*) + q as length from g group by doc_id, q, island having count(*) >= greatest(2 * q, 24 - q)),
r as (select doc_id, start, length, min(q) as period from c group by doc_id, start, length),
b as (select doc_id, start, length, period, row_number() over (partition by doc_id order by length / period desc, start, period) as k,
  count(*) over (partition by doc_id) as n_runs from r),
l as (select doc_id, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as listed from r group by doc_id),
u as (select distinct doc_id, unnest(range(start + period, start + length)) as i from r),
k as (select doc_id, string_agg(t, ' ' order by i) as kept from t anti join u using (doc_id, i) group by doc_id)
select d.doc_id, cast(coalesce(n_runs, 0) as bigint) as n_runs, start, length, period, 1000 * length // period as exponent_milli,
  sha256(coalesce(listed, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256
from d left join (select * from b where k = 1) using (doc_id) left join l using (doc_id) left join k using (doc_id)
"""

_FIELD = "coalesce(octet_length(encode(cast({0} as varchar))) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"

OP12 = rf"""
with recursive {_CRC},
leaves as (select doc_id, source, {_LEAF.format('text')} as leaf,
  {_LEAF.format("(case when h % 2 = 0 then replace(text, chr(10), '') else text end)")} as other
  from documents left join hashed using (doc_id)),
r as (select *, row_number() over (partition by source order by doc_id, leaf) - 1 as i from leaves),
nodes(k, source, i, n, d) as (
  select 0, source, i, count(*) over (partition by source), leaf from r
  union all
  select k + 1, source, i // 3, (n + 2) // 3, sha256(string_agg(d, '' order by i)) from nodes where n > 1 group by k, source, i // 3, n),
subs as (select source, d, row_number() over (order by source nulls first) - 1 as i from nodes where n = 1),
tops(k, i, n, d) as (
  select 0, i, count(*) over (), d from subs
  union all
  select k + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' order by i)) from tops where n > 1 group by k, i // 3, n),
sides as (
  select 0 as part, x.source, x.k, x.i, coalesce(string_agg(y.d, '' order by y.i) filter (y.i < x.i), '') as l,
    coalesce(string_agg(y.d, '' order by y.i) filter (y.i > x.i), '') as r
  from nodes x join nodes y on x.source is not distinct from y.source and x.k = y.k and x.i // 3 = y.i // 3 where x.n > 1 group by all
  union all
  select 1, null, x.k, x.i, coalesce(string_agg(y.d, '' order by y.i) filter (y.i < x.i), ''), coalesce(string_agg(y.d, '' order by y.i) filter (y.i > x.i), '')
  from tops x join tops y on x.k = y.k and x.i // 3 = y.i // 3 where x.n > 1 group by all),
walk(id, source, part, k, i, acc, proof) as (
  select row_number() over (), source, 0, 0, i, other, '' from r
  union all
  select w.id, w.source, case when s.k is null then w.part + 1 else w.part end, case when s.k is null then 0 else w.k + 1 end,
    case when s.k is null then b.i else w.i // 3 end, case when s.k is null then w.acc else sha256(s.l || w.acc || s.r) end,
    w.proof || coalesce(s.l || s.r, '')
  from walk w left join sides s on s.part = w.part and s.k = w.k and s.i = w.i and (w.part = 1 or s.source is not distinct from w.source)
  left join subs b on b.source is not distinct from w.source
  where w.part < 2),
numbered as (select *, row_number() over () as id from r),
ends as (select id, acc, proof from walk where part = 2)
select doc_id, leaf, b.d as subroot, (select d from tops where n = 1) as root, sha256(proof) as proof_sha256, acc as folded_root,
  acc = (select d from tops where n = 1) as verified
from numbered join ends using (id) join subs b on b.source is not distinct from numbered.source
"""

_FILL = """
f{k} as (select *, case when not more{j} and key is not null and size <= gap - won{j} then size else 0 end as fit{k} from p{j}),
r{k} as (select *, sum(fit{k}) over (partition by source order by key, doc_id, size rows unbounded preceding) as run{k} from f{k}),
m{k} as (select *, more{j} or (fit{k} > 0 and run{k} <= gap - won{j}) as more{k} from r{k}),
p{k} as (select *, sum(case when more{k} then size else 0 end) over (partition by source) as won{k} from m{k})"""

OP13 = rf"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
v as (select *, case when size > 0 then length(bin(size)) else 0 end as value from d),
s as (select source, cast(sum(size) as bigint) as words, row_number() over (order by source nulls last) - 1 as i from d group by source),
w as (select *, case i % 3 when 0 then 3 when 1 then 1 else 2 end as weight, 2 * words as bound from s),
l as (select *, (1.5e0 * sum(words) over () - coalesce(sum(bound) over (order by bound / weight, source rows between unbounded preceding and 1 preceding), 0))
  / sum(weight) over (order by bound / weight, source rows between current row and unbounded following) as level,
  row_number() over (order by bound / weight, source) as k from w),
lv as (select min_by(level, k) filter (level * weight <= bound) as level from l),
g as (select source, words as source_size, least(coalesce(lv.level * weight, bound), cast(bound as double)) as target from w, lv),
c as (select source, value, sum(size) as words from v where value > 0 group by all),
e as (select c.*, target, (target - 2 * coalesce(sum(words) over (partition by c.source order by value desc rows between unbounded preceding and 1 preceding), 0))
  / cast(sum(value * words) over (partition by c.source order by value desc rows between current row and unbounded following) as double) as c
  from c join g on c.source is not distinct from g.source),
x as (select source, max_by(c, value) filter (c * value <= 2) as c from e group by source),
y as (select e.source, value, words, target, coalesce(least(x.c * value, 2e0), 2e0) as expected from e join x on e.source is not distinct from x.source),
z as (select source, max(target) - sum(floor(expected) * words) as gap from y group by source),
u as (select v.*, floor(coalesce(expected, 0)) as whole, expected - floor(expected) as odds,
  (('0x' || substr(sha256(coalesce(cast(doc_id as varchar), '')), 1, 13))::bigint + 0.5e0) / 4503599627370496e0 as u
  from v left join y on v.source is not distinct from y.source and v.value = y.value),
p0 as (select u.*, z.gap, 0e0 as won0, false as more0, case when odds > 0 then (u / (1 - u)) / (odds / (1 - odds)) end as key
  from u left join z on u.source is not distinct from z.source),
{', '.join(_FILL.format(j=j, k=j + 1) for j in range(3))}
select doc_id, size, source_size, target, cast(size * (whole + more3::int) as bigint) as taken
from p3 join g on p3.source is not distinct from g.source
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1, "op10_url_filter": OP10, "op11_periodic_runs": OP11, "op12_merkle_manifest": OP12, "op13_source_mixing": OP13}
