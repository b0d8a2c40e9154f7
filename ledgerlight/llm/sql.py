"""DuckDB SQL of the training-data queries that SQL can express."""

from .quality_rules import BUCKETS, THRESHOLD, TRUSTED
from .url_reputation import FLOOR, LEAST, LONG_SUFFIXES, MOST, RULES, Z

#: CRC-32 of each token by its table, made from the reversed polynomial 0xEDB88320.
QUALITY = f"""
with crc as (
  select list(list_reduce(range(8), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, i) order by i) as t
  from (select unnest(range(256))::bigint as i)
),
toks as (
  select doc_id, list_filter(regexp_split_to_array(regexp_replace(coalesce(text, ''), '([!-/:-@\\[-`{{-~]+)', ' \\1 ', 'g'), '[ \\x09-\\x0D]+'), lambda x: x <> '') as ts
  from documents
),
flat as (select doc_id, unnest(ts) as tok, generate_subscripts(ts, 1) as i from toks),
codes as (
  select tok, 4294967295 - list_reduce(
      list_transform(range(0, length(hex(encode(tok))) // 2), lambda k: ('0x' || substring(hex(encode(tok)), (2 * k + 1)::int, 2))::bigint),
      lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295::bigint) as h
  from (select distinct tok from flat), crc
),
seq as (select doc_id, i, h from flat join codes using (tok)),
feats as (
  select doc_id, h % {BUCKETS} as b from seq
  union all
  select a.doc_id, (a.h * 31 + c.h) % {BUCKETS} from seq a join seq c on a.doc_id = c.doc_id and c.i = a.i + 1
),
good as (
  select doc_id from (select doc_id, min(quality) q, max(toxic) t from labels group by doc_id) where q = 1 and t = 0 and doc_id is not null
  order by (doc_id % 1000003 * 7919) % 1000003, doc_id limit {TRUSTED}
),
cnt as (select b, count(*) as raw, count(good.doc_id) as own from feats left join good using (doc_id) group by b),
tot as (select sum(raw) as raw, sum(own) as own from cnt),
llr as (
  select b, case when tot.own = 0 then 0 else round(1000 * (ln((cnt.own + 1) / (tot.own + {BUCKETS})) - ln((cnt.raw + 1) / (tot.raw + {BUCKETS}))))::bigint end as v from cnt, tot
),
score as (select doc_id, sum(v)::bigint as llr_sum, count(*)::bigint as n_features from feats join llr using (b) group by doc_id),
ws as (
  select doc_id, text, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda x: x <> '') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\x09-\\x0D]')) as lines
  from documents
),
tri as (select doc_id, unnest(range(1, len(w) - 1)) as i, w from ws where len(w) >= 3),
grams as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as n from tri),
cover as (select doc_id, count(distinct i + d)::bigint as n from grams, (select unnest([0, 1, 2]) as d) where n > 1 group by doc_id),
base as (
  select ws.doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(cover.n, 0)::bigint as n_repeat_words
  from ws left join cover using (doc_id)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and coalesce(llr_sum, 0) >= {THRESHOLD} * coalesce(n_features, 0) as kept,
  coalesce(llr_sum, 0) as llr_sum, coalesce(n_features, 0) as n_features
from base left join score using (doc_id)
"""


def _strength(groups: str, parent: str) -> str:
    """SQL of a level's prior strength by moments."""
    p = "s::double / n"
    return f"""select case when tau2 is null then {LEAST} when tau2 <= 0 then {MOST} else least(greatest(noise / tau2 - 1, {LEAST}), {MOST}) end as m from (
      select sum(n * {parent} * (1 - {parent})) / sum(n) as noise,
        (sum(n * ({p} - {parent}) * ({p} - {parent})) - (count(*) - 1) * (sum(n * {parent} * (1 - {parent})) / sum(n))) / nullif(sum(n) - sum(n * n)::double / sum(n), 0) as tau2
      from {groups} where n > 0)"""


_M = f"least(m, greatest({LEAST}, up_n))"
_LONG = "|".join(x.replace(".", "\\.") for x in LONG_SUFFIXES)
_FITS = [(f"(host = '{r.partition('/')[0]}' or ends_with(host, '.{r.partition('/')[0]}')) and starts_with(path, '/{r.partition('/')[2]}')", r, v) for r, v in sorted(RULES, key=lambda x: (-len(x[0]), x[0]))]
_RULE = " ".join(f"when {c} then '{r}'" for c, r, _ in _FITS)
_VERDICT = " ".join(f"when {c} then '{v}'" for c, _, v in _FITS)

REPUTATION = f"""
with p as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) as path
  from pages
),
good as (select doc_id, count(*) as n, sum(quality) as s from labels where doc_id is not null and quality is not null group by doc_id),
hosts as (
  select host, coalesce(sum(n), 0)::bigint as n, coalesce(sum(s), 0)::bigint as s,
    regexp_extract(host, '([^.]*\\.)?({_LONG}|[^.]*)$', 0) as domain, regexp_extract(host, '({_LONG}|[^.]*)$', 0) as suffix
  from p left join good on page_id = doc_id group by host
),
overall as (select (coalesce(sum(s), 0) + 1)::double / (coalesce(sum(n), 0) + 2) as r, coalesce(sum(n), 0) as up_n from hosts),
tops as (select suffix, sum(n) as n, sum(s) as s, any_value(r) as up, any_value(up_n) as up_n from hosts, overall group by suffix),
tops_m as ({_strength('tops', 'up')}),
tops_r as (select suffix, n as up_n, ({_M} * up + s) / ({_M} + n) as r from tops, tops_m),
doms as (select domain, suffix, sum(n) as n, sum(s) as s, any_value(r) as up, any_value(up_n) as up_n from hosts join tops_r using (suffix) group by domain, suffix),
doms_m as ({_strength('doms', 'up')}),
doms_r as (select domain, n as up_n, ({_M} * up + s) / ({_M} + n) as r from doms, doms_m),
hs as (select host, n, s, r as up, up_n from hosts join doms_r using (domain)),
hs_m as ({_strength('hs', 'up')}),
score as (
  select host, n, s, r + {Z} * sqrt(r * (1 - r) / (m + n + 1)) as bound from (select host, n, s, {_M} as m, ({_M} * up + s) / ({_M} + n) as r from hs, hs_m)
)
select page_id, host, path, case {_RULE} end as rule, case {_VERDICT} when bound < {FLOOR} then 'block' else 'allow' end as verdict, n as n_labels, s as n_good
from p join score using (host)
"""
