"""Queries of the question path, the load path and the scores, and the SQL each must equal. Imported by ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import sources as S
from ..functions import answers as A
from ..functions import guards as GD
from ..functions import numbers as N
from ..functions import periods as P
from ..functions import tables as TB
from ..functions import text as T
from ..operators import chunking as C
from ..operators import facts as FA
from ..operators import graph as G
from ..operators import load as L
from ..operators import metrics as M
from ..operators import provenance as PV
from ..operators import retrieval as RT
from .bindings import spread, table
from .queries import query


def _q(text: str) -> str:
    return text.replace("'", "''")


def _list(items) -> str:
    return "[" + ", ".join(f"'{_q(x)}'" for x in items) + "]"


def _pick(items, index):
    return F.get(F.array(*map(F.lit, items)), index.cast("int"))


#: One row per order and line number, which repeat in the tables.
_LI = "(select l_orderkey, l_linenumber, min(l_partkey) as l_partkey, min(l_suppkey) as l_suppkey, min(l_quantity) as l_quantity, min(l_returnflag) as l_returnflag, min(l_linestatus) as l_linestatus from lineitem group by all)"


def _items(spark, sf_dir: str) -> DataFrame:
    cols = ("l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in cols])


# ------------------------------------------------------------------ periods of questions, filters


ASKED = (
    "what was revenue in Q2 FY1998 and Q3 FY98", "how did revenue change quarter-on-quarter in Q1 FY98", "net profit year-on-year in Q3 FY24", "highest revenue across FY1997 and FY96",
    "annual revenue in FY25", "trend of revenue qoq in Q1 FY25", "sequential growth of Q4 FY2026 over the past", "who is the ceo",
)
_YY = "case when len(y) = 2 then 2000 + y::int else y::int end"


@query(f"""with q as (select c_custkey as id, {_list(ASKED)}[c_custkey % 8 + 1] as t, case when c_custkey % 3 = 0 then 'q2' when c_custkey % 3 = 1 then 'FY' end as mq, 2000 + c_custkey % 4 as my from customer),
  n as (select *, list_transform(list_zip(regexp_extract_all(t, '{_q(P.ASKED_PERIOD)}', 1), regexp_extract_all(t, '{_q(P.ASKED_PERIOD)}', 2)), lambda z: (case when len(z[2]) = 2 then 2000 + z[2]::int else z[2]::int end) * 4 + z[1]::int - 1) as p,
    list_sort(list_distinct(list_transform(regexp_extract_all(t, '{_q(P.ASKED_YEAR)}', 1), lambda y: {_YY}))) as ys from q),
  a as (select id, list_concat(list_concat(p, case when len(p) = 1 and not regexp_matches(t, '{_q(P.WIDE_TREND)}') and regexp_matches(t, '{_q(P.QOQ)}') then [p[1] - 1]
      when len(p) = 1 and not regexp_matches(t, '{_q(P.WIDE_TREND)}') and regexp_matches(t, '{_q(P.YOY)}') then [p[1] - 4] else [] end),
    list_concat(case when regexp_matches(t, '{_q(P.EVERY_QUARTER)}') then flatten(list_transform(ys, lambda y: [y * 4, y * 4 + 1, y * 4 + 2, y * 4 + 3]))
      when regexp_matches(t, '{_q(P.WHOLE_YEAR)}') then list_transform(ys, lambda y: -y) else [] end, case when upper(mq) = 'Q2' then [my * 4 + 1] else [] end)) as l from n),
  s as (select id, list_transform(list_filter(l, lambda x, i: list_position(l, x) = i), lambda x: case when x < 0 then 'FY-' || (-x) else 'Q' || (x % 4 + 1) || '-' || (x // 4) end) as l from a)
  select id, coalesce(array_to_string(l, ';'), '') as periods from s""")
def q_question_periods(spark, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), _pick(ASKED, k % 8).alias("t"), F.when(k % 3 == 0, "q2").when(k % 3 == 1, "FY").alias("mq"), (2000 + k % 4).alias("my"))
    found = P.question_periods(F.col("t"), F.col("my"), F.col("mq"))
    return rows.select("id", F.array_join(F.transform(found, lambda x: F.concat_ws("-", x["q"], x["fy"])), ";").alias("periods"))


_WISHES = (("1", "SRC1 Ltd", "2021-2023", "FY", "both"), ("2", "src2", "2022", "q1", "pdf"), ("3", "", "", "Q3", "audio"), ("4", "src", "2020 - 2021", "", ""))
_WISH_SQL = "(values " + ", ".join(str(w) for w in _WISHES) + ") as w(question_id, company, year, quarter, source_filter)"


def _placed(spark, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    year = F.when(k % 11 == 0, "n/a").otherwise((2020 + k % 5).cast("string"))
    return table(spark, sf_dir, "documents").select(k.alias("chunk_id"), F.col("source").alias("company"), year.alias("year"), F.concat(F.lit("Q"), (k % 4 + 1).cast("string")).alias("quarter"), F.when(k % 2 == 0, "pdf").otherwise("audio").alias("source_type"))


@query(f"""with c as (select doc_id as chunk_id, lower(source) as company, case when doc_id % 11 = 0 then 'n/a' else (2020 + doc_id % 5)::varchar end as year, 'Q' || (doc_id % 4 + 1) as quarter, case when doc_id % 2 = 0 then 'pdf' else 'audio' end as st from documents),
  w as (select *, regexp_replace(regexp_replace(lower(company), '\\bltd\\b', '', 'g'), '[^a-z0-9]', '', 'g') as wk, regexp_extract(trim(year), '^(\\d{{4}})\\s*-\\s*(\\d{{4}})$', 1) as lo, regexp_extract(trim(year), '^(\\d{{4}})\\s*-\\s*(\\d{{4}})$', 2) as hi from {_WISH_SQL})
  select question_id, chunk_id from c, w where (wk = '' or (c.company <> '' and (contains(c.company, wk) or contains(wk, c.company))))
    and (trim(w.year) = '' or case when lo <> '' then coalesce(try_cast(c.year as int) between lo::int and hi::int, false) else c.year = trim(w.year) end)
    and (upper(w.quarter) in {P.NO_QUARTER} or c.quarter = upper(w.quarter)) and (source_filter not in ('pdf', 'audio') or st = source_filter)""")
def q_scope_filters(spark, sf_dir: str) -> DataFrame:
    wishes = spark.createDataFrame(_WISHES, "question_id string, company string, year string, quarter string, source_filter string")
    return RT.scoped(wishes, _placed(spark, sf_dir))


# ------------------------------------------------------------------ guards and recovered values


_NAMES = ("Revenue from operations", "Revenue growth", "Net profit", "Total turnover", "EBITDA margin")
_VALUES = ("17%", "1,512.03", "3.0", "21.20", "5")
_UNITS = ("Crore INR", "Billion USD", "$ mn")
_PERIODS = ("Q2 FY26", "half-year ended", "December 31, 2024", "col_2", "31/03/2025", "Q4 FY204", "30062024", "corresponding 3 months ended previous year", "")
_SOURCES = ("Revenue 1512.03 and 21.2 in crore", "USD 17 % of 3", "", "no figures here")


def _extracted(spark, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(
        k.alias("id"), _pick(_NAMES, k % 5).alias("name"), _pick(_VALUES, F.floor(k / 5) % 5).alias("value"), _pick(_UNITS, k % 3).alias("unit"), _pick(_PERIODS, F.floor(k / 3) % 9).alias("period"),
        F.concat(F.lit("Q"), (F.floor(k / 7) % 4 + 1).cast("string")).alias("quarter"), (2024 + F.floor(k / 2) % 3).cast("string").alias("year"), _pick(_SOURCES, F.floor(k / 11) % 4).alias("source_text"),
    )


_EXTRACTED = f"""select p_partkey as id, {_list(_NAMES)}[p_partkey % 5 + 1] as name, {_list(_VALUES)}[p_partkey // 5 % 5 + 1] as value, {_list(_UNITS)}[p_partkey % 3 + 1] as unit, {_list(_PERIODS)}[p_partkey // 3 % 9 + 1] as period,
  p_partkey // 7 % 4 + 1 as q, 2024 + p_partkey // 2 % 3 as y, {_list(_SOURCES)}[p_partkey // 11 % 4 + 1] as src from part"""


@query(f"""with e as ({_EXTRACTED}), f as (select *, regexp_replace(src, '[\\s,]', '', 'g') as flat, regexp_replace(value, '[\\s,]', '', 'g') as v, regexp_extract(period, '(?i)\\bQ([1-4])\\s*FY\\s*(\\d{{2}}|\\d{{4}})\\b', ['q', 'y']) as ql,
    case when regexp_matches(period, '^[A-Z][a-z]+ \\d+, \\d{{4}}$') then strptime(period, '%B %d, %Y') when regexp_matches(period, '^\\d+/\\d+/\\d{{4}}$') then strptime(period, '%d/%m/%Y') when regexp_matches(period, '^\\d{{8}}$') then strptime(period, '%d%m%Y') end as d from e),
  g as (select *, case when ql.q <> '' then try_cast(ql.q as int) else quarter(d - interval 3 month)::int end as lq, case when ql.y <> '' then case when len(ql.y) = 2 then 2000 else 0 end + try_cast(ql.y as int) else year(d + interval 9 month)::int end as ly from f)
  select id, regexp_matches(period, '(?i)^col_?\\d+$') or regexp_matches(period, '(?i)\\bFY\\s*(\\d|\\d{{3}}|\\d{{5,}})\\b') as bad_label, regexp_matches(period, '{_q(P.OTHER_WINDOW)}') or regexp_matches(period, '{_q(P.PRIOR_YEAR)}') as other_window,
    coalesce(lq <> q or ly <> y, false) as contradicts, regexp_matches(unit, '(?i)\\busd\\b|\\$') and not regexp_matches(src, '(?i)\\busd\\b|\\$') as bad_unit, contains(value, '%') and not regexp_matches(name, '(?i)growth|margin') as stray_percent,
    flat <> '' and not (contains(flat, v) or (ends_with(v, '.0') and contains(flat, replace(v, '.0', ''))) or (contains(v, '.') and contains(flat, rtrim(rtrim(v, '0'), '.')))) as absent,
    regexp_matches(name, '(?i)\\b(revenue|sales|turnover)\\b') and coalesce(abs(try_cast(replace(value, ',', '') as double)) < 10, false) as small from g""")
def q_metric_guards(spark, sf_dir: str) -> DataFrame:
    name, value, unit, period, quarter, year, src = (F.col(c) for c in ("name", "value", "unit", "period", "quarter", "year", "source_text"))
    flags = {
        "bad_label": P.bad_label(period), "other_window": P.window_mismatch(quarter, period), "contradicts": P.contradicts(quarter, year, period), "bad_unit": GD.implausible_unit(unit, src),
        "stray_percent": GD.stray_percentage(name, value), "absent": GD.absent_from_source(value, src), "small": GD.small_revenue(name, value),
    }
    return _extracted(spark, sf_dir).select("id", *[v.alias(k) for k, v in flags.items()])


@query(f"""with e as ({_EXTRACTED}), f as (select *, regexp_replace(src, '[\\s,]', '', 'g') as flat, regexp_replace(value, '[\\s,]', '', 'g') as v from e)
  select id from f where period in ('Q2 FY26', 'December 31, 2024', '31/03/2025', '30062024', '') and case period when 'Q2 FY26' then q = 2 and y = 2026 when 'December 31, 2024' then q = 3 and y = 2025 when '31/03/2025' then q = 4 and y = 2025 when '30062024' then q = 1 and y = 2025 else true end
    and not (unit in ('Billion USD', '$ mn') and not contains(src, 'USD')) and not (value = '17%' and name not in ('Revenue growth', 'EBITDA margin'))
    and (flat = '' or contains(flat, v) or (ends_with(v, '.0') and contains(flat, replace(v, '.0', ''))) or (contains(v, '.') and contains(flat, rtrim(rtrim(v, '0'), '.'))))
    and not (name in ('Revenue from operations', 'Revenue growth', 'Total turnover') and coalesce(abs(try_cast(replace(value, ',', '') as double)) < 10, false))""")
def q_trusted_metrics(spark, sf_dir: str) -> DataFrame:
    return FA.trusted(_extracted(spark, sf_dir)).select("id")


@query("""with r as (select p_partkey as k, p_partkey % 5 as m, (p_partkey * 37 % 9000 + 1000)::varchar as v from part)
  select k, case m when 0 then v when 1 then v when 2 then null when 3 then v || '.5' when 4 then null end as value, m = 2 as ambiguous from r""")
def q_current_value(spark, sf_dir: str) -> DataFrame:
    k, v = F.col("p_partkey"), (F.col("p_partkey") * 37 % 9000 + 1000).cast("string")
    comma = F.regexp_replace(v, r"^(\d)(\d{3})$", "$1,$2")
    rows = table(spark, sf_dir, "part").select(
        k.alias("k"), F.when(k % 5 == 3, "Basic EPS").otherwise("Revenue from operations").alias("name"),
        F.when(k % 5 == 0, F.concat(F.lit("Revenue from operations 1 Total  Revenue from operations "), comma, F.lit(" 12 Other income 3")))
        .when(k % 5 == 1, F.concat(F.lit("I. revenue from operations\n= "), v, F.lit(" = 7 Expenses 9")))
        .when(k % 5 == 2, F.concat(F.lit("Revenue from operations (a) interest 4 (b) fees 5 (c) other "), v))
        .when(k % 5 == 3, F.concat(F.lit("Earning per share (EPS) a) Basic "), v, F.lit(".5 b) Diluted 2"))).otherwise("Revenue from operations none Expenses 5").alias("src"),
    )
    return rows.select("k", GD.current_value(F.col("src"), F.col("name")).alias("value"), GD.ambiguous_breakdown(F.col("name"), F.col("src")).alias("ambiguous"))


# ------------------------------------------------------------------ look-ups and facts


_STORED = ("Revenue from operations", "Net profit for the year", "Profit before tax", "EPS - basic (Rs)", "Basic EPS", "Profit margin", "Interest income")
_WANTED = (
    (1, "NATION_1", "revenue from operations", "Q2", "1997"), (2, "Nation 2", "Basic EPS", "Q1", "1996"), (3, "NATION_3", "Diluted EPS", "Q1", "1996"), (4, "NATION_4", "Net profit for the period", "Q3", "1995"),
    (5, "NATION_1", "PAT", "Q3", "1995"), (6, "NATION_5", "Interest income", "FY", "1996"),
)


def _stored(spark, sf_dir: str) -> DataFrame:
    """Metric rows of line items: one company per nation key, names by line number, some labels of a whole year."""
    i, d = F.col("l_linenumber"), F.to_date("l_shipdate")
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + i).alias("id"), F.concat(F.lit("NATION_"), (F.col("l_suppkey") % 7).cast("string")).alias("company"), _pick(_STORED, i - 1).alias("name"), F.col("l_quantity").cast("int").cast("string").alias("value"),
        F.concat(F.lit("Q"), P.fiscal_quarter(d)).alias("quarter"), P.fiscal_year(d).cast("string").alias("year"), F.when(F.col("l_orderkey") % 5 == 0, "year ended").when(F.col("l_orderkey") % 5 == 1, "col_1").otherwise("").alias("period"), F.col("l_suppkey").alias("page"),
    )
    return rows


_STORED_SQL = f"""select l_orderkey * 10 + l_linenumber as id, 'NATION_' || (l_suppkey % 7) as company, lower({_list(_STORED)}[l_linenumber]) as name, l_quantity::int::varchar as value, quarter(l_shipdate - interval 3 month) as q, year(l_shipdate + interval 9 month) as y, l_orderkey % 5 as lab, l_suppkey as page from lineitem"""


@query(f"""with s as ({_STORED_SQL}), w as (select * from (values {', '.join(map(str, _WANTED))}) as w(question_id, company, wanted, wq, wy)),
  j as (select w.*, s.id, s.name, s.value, s.lab, s.page from w join s on s.company = replace(upper(w.company), ' ', '_') and s.q = case when wq = 'FY' then 4 else substr(wq, 2)::int end and s.y = wy::int
    where lab <> 1 and (wq = 'FY' or lab <> 0)),
  t as (select *, case when name = lower(wanted) then 1 when regexp_matches(wanted, '(?i)basic|diluted') and contains(name, 'eps') and contains(name, lower(regexp_extract(wanted, '(?i)basic|diluted'))) then 2
    when regexp_matches(lower(wanted), '\\bprofit\\b') and (contains(name, 'profit for the period') or contains(name, 'profit for the year') or contains(name, 'net profit')) then 3 end as tier from j),
  m as (select *, min(tier) over (partition by question_id) as low from t where tier is not null), u as (select question_id from m where tier = 3 and low = 3 group by 1 having count(distinct value) = 1)
  select question_id, id, tier from m where tier = low and (tier < 3 or question_id in (select question_id from u)) and (wq <> 'FY' or lab = 0)
  qualify row_number() over (partition by question_id order by page, id) <= 200""")
def q_broad_lookup(spark, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame(_WANTED, "question_id int, company string, name string, q string, fy string")
    return FA.broad_lookup(wanted, _stored(spark, sf_dir)).select("question_id", "id", "tier")


@query(f"""select o_custkey as question_id, l_orderkey * 10 + l_linenumber as id, s_name as source_text from orders join {_LI} on l_orderkey = o_orderkey left join supplier on l_suppkey = s_suppkey and s_suppkey % 3 = 0 where o_orderpriority like '1%'""")
def q_chunk_metrics(spark, sf_dir: str) -> DataFrame:
    orders, items = table(spark, sf_dir, "orders"), _items(spark, sf_dir)
    got = orders.where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("question_id"), F.col("o_orderkey").alias("chunk_id"))
    rows = items.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("source_id"))
    text = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("chunk_id"), F.col("s_name").alias("text"))
    return FA.chunk_metrics(got, rows.select("src", F.col("id").alias("dst")), rows.select("id", "source_id"), text).select("question_id", "id", "source_text")


@query("""with r as (select distinct o_custkey % 50 as question_id, o_custkey % 40 as quarter_id from orders where o_orderpriority like '2%'),
  g as (select o_custkey % 40 as quarter_id, list_sort(list_distinct(list(o_orderpriority))) as l from orders where o_orderstatus = 'O' group by 1), k as (select o_custkey % 40 as quarter_id, list_sort(list_distinct(list(o_orderstatus))) as l from orders where o_orderstatus <> 'O' group by 1)
  select question_id, quarter_id, coalesce(array_to_string(g.l, ';'), '') as guidance, coalesce(array_to_string(k.l, ';'), '') as risks from r left join g using (quarter_id) left join k using (quarter_id)""")
def q_quarter_statements(spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("quarter_id", F.col("o_custkey") % 40)
    got = o.where("o_orderpriority like '2%'").select((F.col("o_custkey") % 50).alias("question_id"), F.col("o_orderkey").alias("chunk_id"))
    say = lambda where, c: o.where(where).select("quarter_id", F.col(c).alias("statement"))
    out = FA.quarter_statements(got, o.select(F.col("o_orderkey").alias("chunk_id"), "quarter_id"), say("o_orderstatus = 'O'", "o_orderpriority"), say("o_orderstatus <> 'O'", "o_orderstatus"))
    return out.select("question_id", "quarter_id", F.array_join("guidance", ";").alias("guidance"), F.array_join("risks", ";").alias("risks"))


def _fact_rows(spark, sf_dir: str) -> DataFrame:
    """Rendered facts of line items: metrics with statement types, periods and tags, and other categories."""
    i, k = F.col("l_linenumber"), F.col("l_orderkey")
    name = F.when(i % 3 == 0, "Revenue from operations").when(i % 3 == 1, "PAT (Standalone)").otherwise("PAT (Consolidated)")
    tags = F.when(k % 7 == 0, "[company=A; derived_from=raw_chunk]").when(k % 7 < 3, "[company=a; period=Q4 FY204]").when(k % 7 < 5, "[company=A; period=Q1 FY25]").otherwise("[company=b]")
    metric = F.concat(name, F.lit(" = "), F.col("l_quantity").cast("int").cast("string"), F.lit(" Crore (Q"), (i % 2 + 1).cast("string"), F.lit("-2025) "), tags)
    other = F.when(k % 4 == 0, "Guidance: more").when(k % 4 == 1, "Risk persisted: x").when(k % 4 == 2, "Management sentiment: good").otherwise("A -[OWNS]-> B")
    return table(spark, sf_dir, "lineitem").select((k % 40).alias("question_id"), F.when(i == 7, F.concat(other, F.lit(" "), k.cast("string"))).otherwise(metric).alias("fact")).distinct()


_FACT_ROWS = """select distinct l_orderkey % 40 as question_id, case when l_linenumber = 7 then ['Guidance: more', 'Risk persisted: x', 'Management sentiment: good', 'A -[OWNS]-> B'][l_orderkey % 4 + 1] || ' ' || l_orderkey
  else case l_linenumber % 3 when 0 then 'Revenue from operations' when 1 then 'PAT (Standalone)' else 'PAT (Consolidated)' end || ' = ' || l_quantity::int || ' Crore (Q' || (l_linenumber % 2 + 1) || '-2025) '
    || case when l_orderkey % 7 = 0 then '[company=A; derived_from=raw_chunk]' when l_orderkey % 7 < 3 then '[company=a; period=Q4 FY204]' when l_orderkey % 7 < 5 then '[company=A; period=Q1 FY25]' else '[company=b]' end end as fact from lineitem"""
_CATEGORY = "case when fact like 'Guidance%' then 'guidance' when fact like 'Risk%' then 'risk' when fact like 'Management sentiment:%' then 'sentiment' when contains(fact, ' -[') then 'entity' else 'metric' end"
_TAGGED = f"""select *, {_CATEGORY} as cat, lower(trim(regexp_extract(fact, 'company=([^;\\]]+)', 1))) as company, regexp_extract(fact, '\\((Q[1-4]|FY)-(\\d{{4}})\\)') as period,
    lower(trim(regexp_replace(regexp_replace(split_part(fact, ' = ', 1), '(?i)\\b(standalone|consolidated)\\b', '', 'g'), '[()\\s]+', ' ', 'g'))) as base from f"""


@query(f"with f as ({_FACT_ROWS}), t as ({_TAGGED}) select question_id, cat as category, company, period, base, count(*) as n from t group by all")
def q_fact_tags(spark, sf_dir: str) -> DataFrame:
    f = F.col("fact")
    return _fact_rows(spark, sf_dir).groupBy("question_id", A.category(f).alias("category"), A.company_tag(f).alias("company"), A.period_tag(f).alias("period"), A.base_name(f).alias("base")).agg(F.count("*").alias("n"))


@query(f"""with f as ({_FACT_ROWS}), t as (select *, contains(fact, 'derived_from=raw_chunk') as good from ({_TAGGED})),
  w as (select *, list_filter(list_distinct(regexp_extract_all(lower(regexp_replace(split_part(fact, ' = ', 1), '(?i)\\b(standalone|consolidated)\\b', '', 'g')), '[a-z]+')), lambda x: len(x) > 4) as words,
    regexp_matches(fact, 'period=[^;\\]]') and not contains(fact, 'FY204') or contains(fact, 'statement=') as claims from t)
  select question_id, fact from w where good or (not exists (select 1 from w g where g.good and g.question_id = w.question_id and g.company = w.company and g.base = w.base and g.period = w.period)
    and not (cat = 'metric' and not claims and exists (select 1 from w g where g.good and g.question_id = w.question_id and g.company = w.company and g.period = w.period and len(list_intersect(w.words, g.words)) >= 2)))""")
def q_prefer_recovered_facts(spark, sf_dir: str) -> DataFrame:
    return FA.prefer_recovered_facts(_fact_rows(spark, sf_dir))


@query(f"""with f as ({_FACT_ROWS}), t as (select *, case when cat = 'metric' and regexp_matches(fact, '(?i)\\bconsolidated\\b') then 'c' when cat = 'metric' and regexp_matches(fact, '(?i)\\bstandalone\\b') then 's' end as kind from ({_TAGGED})),
  w as (select *, bool_or(coalesce(kind = 'c', false)) over (partition by question_id, company, base) as there from t) select question_id, fact from w where kind is null or kind = 'c' or not there""")
def q_resolve_statements(spark, sf_dir: str) -> DataFrame:
    return FA.resolve_statements(_fact_rows(spark, sf_dir))


@query(f"""with f as ({_FACT_ROWS}), t as (select *, case when question_id % 2 = 0 then ['revenue', 'operations'] else ['dividend'] end as asked from ({_TAGGED})),
  h as (select *, cat = 'metric' and list_has_any(regexp_extract_all(lower(split_part(fact, ' = ', 1)), '[a-z]+'), asked) as hit from t), a as (select *, bool_or(hit) over (partition by question_id) as any_hit from h)
  select question_id, fact from a where cat <> 'metric' or hit or not any_hit""")
def q_relevant_metrics(spark, sf_dir: str) -> DataFrame:
    asked = F.when(F.col("question_id") % 2 == 0, "What was the revenue of operations?").otherwise("How much dividend?")
    return FA.relevant_metrics(_fact_rows(spark, sf_dir), asked)


@query(f"""with f as ({_FACT_ROWS}), t as ({_TAGGED}) select question_id, fact, row_number() over (partition by question_id order by case cat when 'metric' then 0 when 'entity' then 1 when 'guidance' then 2 when 'risk' then 3 else 4 end,
  case when cat = 'metric' then case when contains(lower(fact), 'revenue') then 0 else 4 end else 0 end, fact)::int as pos from t""")
def q_fact_order(spark, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("question_id").orderBy(*A.display_order(F.col("fact")))
    return _fact_rows(spark, sf_dir).select("question_id", "fact", F.row_number().over(w).alias("pos"))


_QUAL = """with f as (select user_id as question_id, case event_type when 'click' then 'metric' when 'view' then 'entity' when 'purchase' then 'guidance' when 'signup' then 'risk' else 'sentiment' end as category, lpad(event_id::varchar, 9, '0') as fact from events),
  p as (select *, case category when 'sentiment' then 0 when 'guidance' then 1 when 'risk' then 2 when 'entity' then 3 else 4 end as place, case category when 'entity' then 1 when 'metric' then 2 else 0 end as prio, case when category in ('entity', 'metric') then 2 else 3 end as quota,
    row_number() over (partition by question_id, category order by fact) as c from f),"""


@query(f"{_QUAL} s as (select *, row_number() over (partition by question_id order by (c > quota)::int, case when c <= quota then place else prio end, fact)::int as pos from p) select question_id, category, fact, pos from s where pos <= 16")
def q_fact_select_qualitative(spark, sf_dir: str) -> DataFrame:
    cat = FA.quota_case(F.col("event_type"), [("click", "metric"), ("view", "entity"), ("purchase", "guidance"), ("signup", "risk")], "sentiment")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("question_id"), cat.alias("category"), F.lpad(F.col("event_id").cast("string"), 9, "0").alias("fact"))
    return FA.select_facts(rows, F.lit(False), F.lit(16))


# ------------------------------------------------------------------ retrieval


@query("""with r as (select c_mktsegment as question_id, n_name as company, c_custkey % 200 as chunk_id, max(c_acctbal) as score, min(n_nationkey) as place from customer join nation on c_nationkey = n_nationkey group by all),
  k as (select *, row_number() over (partition by question_id, company order by score desc, chunk_id) as r from r), f as (select *, row_number() over (partition by question_id, chunk_id order by place, r) as f from k where r <= 7) select question_id, company, chunk_id from f where f = 1""")
def q_union_of_companies(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.groupBy(F.col("c_mktsegment").alias("question_id"), F.col("n_name").alias("company"), (F.col("c_custkey") % 200).alias("chunk_id")).agg(F.max("c_acctbal").alias("score"), F.min("n_nationkey").alias("place"))
    return RT.union_of_companies(rows, 7).select("question_id", "company", "chunk_id")


@query("select distinct source as quarter_id, doc_id as chunk_id, left(text, 20) as head from documents join embeddings on doc_id = vec_id")
def q_quarter_chunks(spark, sf_dir: str) -> DataFrame:
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    edges = docs.select(F.col("source").alias("src"), F.lit("HAS_TEXT").alias("rel"), F.col("doc_id").alias("dst"))
    edges = edges.unionByName(edges.withColumn("rel", F.lit("HAS_TABLE")))
    nodes = docs.select(F.col("doc_id").alias("chunk_id"), F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("text"), F.col("text").alias("embedding_text")).join(vectors.select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id", "left")
    return RT.quarter_chunks(edges, nodes).select("quarter_id", "chunk_id", F.substring("text", 1, 20).alias("head"))


@query("""select vec_id, round((0.45 * x + 0.25 * coalesce(y, 0) + 0.30 * greatest(coalesce(z, 0), 0)) / (0.45 + 0.25 + 0.30), 9)::double as score,
    case when vec_id % 2 = 0 then 1.0 * case when vec_id % 3 = 0 then 1.0 when vec_id % 5 = 0 then 1.10 else 0.94 end * case when vec_id % 7 = 0 then 1.0 when vec_id % 4 = 0 then 1.12 else 0.86 end else 1.0 end::double as boost
  from (select vec_id, (vec_id % 100) / 100.0 as x, case when vec_id % 4 <> 0 then (vec_id % 10) / 10.0 end as y, case when vec_id % 3 <> 0 then (vec_id % 7) / 7.0 - 0.5 end as z from embeddings)""")
def q_rescore(spark, sf_dir: str) -> DataFrame:
    k = F.col("vec_id")
    score = RT.rescore(k % 100 / 100.0, F.when(k % 4 != 0, k % 10 / 10.0), F.when(k % 3 != 0, k % 7 / 7.0 - 0.5))
    wanted, actual = F.when(k % 7 != 0, "consolidated"), F.when(k % 4 == 0, "consolidated").otherwise("standalone")
    boost = RT.financial_boost(k % 2 == 0, k % 3 != 0, k % 5 == 0, wanted, actual)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(score, 9).alias("score"), boost.cast("double").alias("boost"))


@query("""with r as (select c_mktsegment as q, c_custkey as chunk_id, c_acctbal as score, (c_custkey * 7919 % 1000) / 1000.0 as rr, row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) as rank from customer),
  m as (select *, round(0.5 * (rr - min(rr) over w) / (max(rr) over w - min(rr) over w) + 0.5 * (score - min(score) over w) / (max(score) over w - min(score) over w), 12) as b from r window w as (partition by q, rank <= 30))
  select q as question_id, chunk_id, row_number() over (partition by q order by (rank > 30)::int, case when rank <= 30 then -b else rank end, chunk_id)::int as pos from m""")
def q_rerank(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("question_id"), F.col("c_custkey").alias("chunk_id"), F.col("c_acctbal").alias("score"), (F.col("c_custkey") * 7919 % 1000 / 1000.0).alias("rerank_score"))
    from pyspark.sql import Window

    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id")))
    return RT.reranked(ranked).select("question_id", "chunk_id", "pos")


_ASKS = ("What was the standalone revenue from operations?", "Why did basic EPS grow", "Consolidated EBITDA vs PAT", "net profit of the quarter", "management outlook")


@query(f"""with a as (select c_custkey as k, {_list(_ASKS)}[c_custkey % 5 + 1] as q, case when c_custkey % 4 = 0 then 'Standalone' when c_custkey % 4 = 1 then 'both' end as stated from customer)
  select k, coalesce(case when lower(stated) in ('standalone', 'consolidated') then lower(stated) end, case when contains(lower(q), 'standalone') then 'standalone' when contains(lower(q), 'consolidated') then 'consolidated'
    when len(regexp_extract_all(lower(q), '{_q(T.NUMERIC_WORDS)}')) > len(regexp_extract_all(lower(q), '{_q(T.QUALITATIVE_WORDS)}')) then 'consolidated' end) as statement,
    array_to_string(list_transform(list_sort(list_transform(list_distinct(flatten(list_filter([{', '.join(f"case when contains(lower(q), '{k}') then {_list(v)} end" for k, v in T.METRIC_ALIASES)}], lambda x: x is not null))), lambda x: {{'a': -len(x), 'x': x}})), lambda s: s.x), ';') as phrases from a""")
def q_question_metrics(spark, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("k"), _pick(_ASKS, k % 5).alias("q"), F.when(k % 4 == 0, "Standalone").when(k % 4 == 1, "both").alias("stated"))
    # Equal lengths keep the order of the aliases; the asked questions have none that differ from the alphabet.
    return rows.select("k", T.requested_statement(F.col("q"), F.col("stated")).alias("statement"), F.array_join(T.metric_phrases(F.col("q")), ";").alias("phrases"))


# ------------------------------------------------------------------ answers and scores


@query("""with a as (select c_custkey as k, round(abs(c_acctbal) + 1000, 2) as v from customer), b as (select k, printf('%.2f', v) as good, printf('%.2f', v * 10) as shifted from a)
  select k, 'x FINAL ANSWER: ' || good || ' and 12.5' as answer from b""")
def q_decimal_shift(spark, sf_dir: str) -> DataFrame:
    good = (F.round(F.abs("c_acctbal") + 1000, 2)).cast("decimal(18,2)").cast("string")
    moved = F.concat(F.regexp_replace(good, r"^(\d+)(\d)\.(\d\d)$", "$1.$2$3"))
    said = F.concat(F.lit("x FINAL ANSWER: "), moved, F.lit(" and 12.5"))
    evidence = F.concat(F.lit("was "), good, F.lit(" or 1.25 crore"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), A.fix_decimal_shift(said, evidence).alias("answer"))


_ENDS = ("5 crore; change: +4 crore", "5 (+226.79 crore (+17.81%))", "5 (+ 3.5%)", "5 (3.5%)", "5 (-2.0 crore)")


@query(f"""with a as (select c_custkey as k, c_custkey % 5 as m, c_custkey % 2 = 0 as asks from customer) select k, 'change: 1 FINAL ANSWER: ' || case when asks then {_list(_ENDS)}[m + 1] else ['5 crore', '5', '5', '5 (3.5%)', '5'][m + 1] end as answer from a""")
def q_strip_delta(spark, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    said = F.concat(F.lit("change: 1 FINAL ANSWER: "), _pick(_ENDS, k % 5))
    asked = F.when(k % 2 == 0, "By how much did it grow?").otherwise("What was revenue?")
    return table(spark, sf_dir, "customer").select(k.alias("k"), A.strip_delta(said, asked).alias("answer"))


@query("""with d as (select doc_id as k, list_distinct([(doc_id % 10)::varchar, (doc_id % 7)::varchar || '%', '42']) as pred, list_distinct([(doc_id % 5)::varchar, (doc_id % 7)::varchar || '%']) as truth, list_distinct([(doc_id % 3)::varchar]) as seen from documents)
  select k, array_to_string(list_sort(list_filter(truth, lambda x: not list_contains(pred, x))), ';') as missing, array_to_string(list_sort(list_filter(pred, lambda x: not list_contains(truth, x))), ';') as extra,
    round(len(list_intersect(pred, truth)) / len(pred), 6) as consistency, len(list_filter(pred, lambda x: not list_contains(seen, x) and not list_contains(truth, x)))::int as invented from d""")
def q_missing_extra(spark, sf_dir: str) -> DataFrame:
    k, s = F.col("doc_id"), lambda x: x.cast("string")
    pred, truth = F.array_distinct(F.array(s(k % 10), F.concat(s(k % 7), F.lit("%")), F.lit("42"))), F.array_distinct(F.array(s(k % 5), F.concat(s(k % 7), F.lit("%"))))
    return table(spark, sf_dir, "documents").select(
        k.alias("k"), F.array_join(N.unmatched(truth, pred), ";").alias("missing"), F.array_join(N.unmatched(pred, truth), ";").alias("extra"), F.round(N.share_matched(pred, truth), 6).alias("consistency"),
        N.invented(pred, F.array(s(k % 3)), truth).alias("invented"),
    )


@query("""select k, case when m = 0 then (y = 26 and q = 4)::int when m = 1 then (v = 7)::int end as complete from (select c_custkey as k, c_custkey % 3 as m, c_custkey % 2 + 25 as y, c_custkey % 4 + 1 as q, c_custkey % 10 as v from customer)""")
def q_multivalue(spark, sf_dir: str) -> DataFrame:
    k, s = F.col("c_custkey"), lambda x: x.cast("string")
    said = F.when(k % 3 == 0, F.concat(F.lit("FINAL ANSWER: Q"), s(k % 4 + 1), F.lit("-20"), s(k % 2 + 25))).when(k % 3 == 1, F.concat(F.lit("FINAL ANSWER: 1,000, 2.50 and "), s(k % 10))).otherwise("FINAL ANSWER: 3")
    truth = F.when(k % 3 == 1, "1000 and 2.5 and 7").otherwise("3 and 4")
    expected = F.when(k % 3 == 0, "Q4 FY26")
    return table(spark, sf_dir, "customer").select(k.alias("k"), N.multivalue_complete(said, truth, expected).alias("complete"))


@query("""with r as (select l_orderkey as k, list_distinct(list(l_partkey)) as ids, list_distinct(list('doc' || (l_suppkey % 4) || '|' || l_linenumber)) as places from lineitem group by 1),
  t as (select k, ids, places, case when k % 3 <> 0 then [k % 200, k % 150] else [] end as tids, case when k % 3 <> 1 then ['doc' || (k % 4) || '|1', 'doc' || (k % 4) || '|2'] else [] end as tl from r),
  h as (select k, len(list_distinct(tids)) + len(tl) as total, len(list_intersect(ids, list_distinct(tids))) + len(list_intersect(places, tl)) as hits from t)
  select k, case when total > 0 then (hits > 0)::int::double end as hit, round(case when total > 0 then least(1, hits / total) end, 6) as recall from h""")
def q_source_hits(spark, sf_dir: str) -> DataFrame:
    k = F.col("k")
    place = F.struct(F.concat(F.lit("DOC"), (F.col("l_suppkey") % 4).cast("string"), F.lit(".pdf")).alias("doc"), F.col("l_linenumber").cast("int").alias("page"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set("l_partkey").alias("ids"), F.collect_set(place).alias("places"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    ids = F.when(k % 3 != 0, F.array(k % 200, k % 150)).otherwise(none("bigint"))
    docs = F.when(k % 3 != 1, F.array(F.concat(F.lit("doc"), (k % 4).cast("string"), F.lit(".json")))).otherwise(none("string"))
    hit, recall = M.source_hits(F.col("ids"), F.col("places"), ids, docs, F.array(F.lit(1), F.lit(2)))
    return rows.select("k", hit.alias("hit"), F.round(recall, 6).alias("recall"))


_SPOKEN = ("revenue um profit and net margin", "uh growth of assets in the quarter", "risk you know  dividend", "", "nothing of note")


@query(f"""with a as (select c_custkey as k, {_list(_SPOKEN)}[c_custkey % 5 + 1] as p, {_list(_SPOKEN)}[c_custkey // 5 % 5 + 1] as g, ['pdf', 'audio', 'pdf+audio', 'x'][c_custkey % 4 + 1] as m, case when c_custkey % 3 = 0 then ['PDF', 'audio'] when c_custkey % 3 = 1 then ['pdf'] else [] end as types from customer),
  w as (select *, list_filter(list_distinct(regexp_extract_all(lower(p), '[a-z]+')), lambda x: x in {M.TERMS}) as pw, list_filter(list_distinct(regexp_extract_all(lower(g), '[a-z]+')), lambda x: x in {M.TERMS}) as gw from a)
  select k, round(case when len(pw) > 0 then len(list_intersect(pw, gw)) / len(pw) end, 6) as term_precision, case when len(types) > 0 then case m when 'pdf' then 1.0 when 'audio' then (len(types) = 2)::int::double when 'pdf+audio' then (len(types) = 2)::int::double end end as source_type from w""")
def q_term_precision(spark, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    types = F.when(k % 3 == 0, F.array(F.lit("PDF"), F.lit("audio"))).when(k % 3 == 1, F.array(F.lit("pdf"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "customer").select(
        k.alias("k"), F.round(M.term_precision(_pick(_SPOKEN, k % 5), _pick(_SPOKEN, F.floor(k / 5) % 5)), 6).alias("term_precision"), M.source_type_accuracy(_pick(("pdf", "audio", "pdf+audio", "x"), k % 4), types).alias("source_type"),
    )


@query("select c_mktsegment as question_id, round(avg(c_acctbal), 6) as avg_a, round(avg(case when c_custkey % 2 = 0 then c_custkey end), 6) as avg_b, round(1 / nullif(avg(c_acctbal), 0), 9) as per_second from customer group by 1")
def q_mean_scores(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("question_id"), F.col("c_acctbal").alias("a"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).alias("b"))
    return M.mean_scores(rows, ["a", "b"]).select("question_id", F.round("avg_a", 6).alias("avg_a"), F.round("avg_b", 6).alias("avg_b"), F.round(M.throughput(F.col("avg_a")), 9).alias("per_second"))


@query()
def q_overlap_scores(spark, sf_dir: str) -> DataFrame:
    """ROUGE and BLEU of each conversation's turns against the turn before; beyond plain SQL, held against brute force."""
    from pyspark.sql import Window

    rows = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before is not null")
    p, g = T.tokens(F.substring("text", 1, 160)), T.tokens(F.substring("before", 1, 160))
    rows = rows.select("conv_id", "turn", p.alias("p"), g.alias("g"))
    p, g = F.col("p"), F.col("g")
    return rows.select("conv_id", "turn", M.rouge_n(p, g, 1).alias("rouge1"), M.rouge_n(p, g, 2).alias("rouge2"), M.rouge_l(p, g).alias("rougeL"), M.bleu(p, g).alias("bleu"))


@query("""select lang, count(*) as n, count(*) filter (doc_id % 3 = 0) as n_text, count(*) filter (doc_id % 3 = 1) as n_table, count(*) filter (doc_id % 3 = 2) as n_audio from documents group by lang""")
def q_chunk_statistics(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumn("chunk_type", _pick(("text", "table", "audio"), F.col("doc_id") % 3))
    return M.chunk_statistics(rows, ["lang"])


@query("""select count(*) filter (length(text) < 100) as short, count(*) filter (regexp_matches(text, '[0-9]')) as digits, count(*) filter (not (length(text) < 100) and not regexp_matches(text, '[0-9]')) as kept from documents""")
def q_failure_counts(spark, sf_dir: str) -> DataFrame:
    return M.failure_counts(table(spark, sf_dir, "documents"), {"short": F.length("text") < 100, "digits": F.col("text").rlike("[0-9]")})


# ------------------------------------------------------------------ chunking, tables


_TALK = "text || ['', ' um and', ' okay so you know ', ' the gross n p a of CASA'][(turn % 4)::int + 1]"


def _speech_sql(x: str) -> str:
    x = f"regexp_replace({x}, '\\s+', ' ', 'g')"
    for w in T.FILLERS:
        x = f"replace({x}, ' {w} ', ' ')"
    return f"trim({x})"


@query(f"select conv_id, turn, md5({_speech_sql(_TALK)}) as digest, regexp_replace({_speech_sql(_TALK)}, '(?i)gross n p a', 'Gross NPA') like '%Gross NPA%' as has_term from conversations")
def q_clean_speech(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("t", T.clean_speech(F.concat("text", _pick(("", " um and", " okay so you know ", " the gross n p a of CASA"), F.col("turn") % 4))))
    return rows.select("conv_id", "turn", F.md5(F.encode("t", "utf-8")).alias("digest"), T.spoken_terms(F.col("t")).contains("Gross NPA").alias("has_term"))


@query("""with w as (select l_suppkey as doc, (l_linenumber % 2)::bigint as page, l_orderkey as line, (floor(l_extendedprice)::bigint % 600)::double as x1 from lineitem where l_returnflag = 'R'), n as (select *, case when x1 - lag(x1) over (partition by doc, page order by x1) > 18 then 1 else 0 end as new from w),
  r as (select *, sum(new) over (partition by doc, page order by x1 rows unbounded preceding) as run from n), s as (select doc, page, run, count(*) as n, avg(x1) as anchor from r group by all), k as (select *, max(n) over (partition by doc, page) as most from s)
  select doc, page, (row_number() over (partition by doc, page order by run) - 1)::int as anchor_no, round(anchor, 6) as anchor from k where n >= 0.3 * most""")
def q_column_anchors(spark, sf_dir: str) -> DataFrame:
    return C.column_anchors(_words(spark, sf_dir)).withColumn("anchor", F.round("anchor", 6))


def _words(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("doc"), (F.col("l_linenumber") % 2).cast("long").alias("page"), F.col("l_orderkey").alias("line"), (F.floor("l_extendedprice") % 600).cast("double").alias("x1"), F.col("l_quantity").alias("value"))


@query("""with w as (select l_suppkey as doc, l_linenumber % 2 as page, l_orderkey as line, (floor(l_extendedprice)::bigint % 600)::double as x1, l_quantity as value, row_number() over () as rid from lineitem where l_returnflag = 'R'), a as (select unnest([0, 1, 2, 3]) as no, unnest([100.0, 250.0, 260.0, 500.0]) as x),
  d as (select w.*, no, abs(x - x1) as far, row_number() over (partition by rid order by abs(x - x1), no) as r from w, a) select doc, page::bigint as page, line, no::int as anchor_no, min(value) as value from d where r = 1 and far <= 27 group by all having count(*) = 1""")
def q_to_anchors(spark, sf_dir: str) -> DataFrame:
    words = _words(spark, sf_dir)
    spots = F.explode(F.array(*[F.struct(F.lit(i).alias("anchor_no"), F.lit(x).alias("anchor")) for i, x in enumerate((100.0, 250.0, 260.0, 500.0))]))
    return C.to_anchors(words, words.select("doc", "page").distinct().withColumn("s", spots).select("doc", "page", "s.*"))


@query("""select doc, page, id, row_number() over (partition by doc, page order by y nulls last, x nulls last, id)::int as pos from (select l_suppkey as doc, l_linenumber as page, l_orderkey as id, case when l_orderkey % 5 <> 0 then l_quantity end as y, case when l_orderkey % 5 <> 0 then l_discount end as x from lineitem)""")
def q_reading_order(spark, sf_dir: str) -> DataFrame:
    box = lambda c: F.when(F.col("l_orderkey") % 5 != 0, F.col(c))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), F.col("l_linenumber").alias("page"), F.col("l_orderkey").alias("id"), box("l_quantity").alias("y"), box("l_discount").alias("x"))
    return C.reading_order(rows).select("doc", "page", "id", "pos")


@query("select conv_id, role, min(turn) as turn from conversations group by all")
def q_first_copies(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", F.concat(F.lit("\n"), "role", F.lit("  ")).alias("text"))
    return C.first_copies(rows, ["conv_id"], ["turn"]).select("conv_id", "role", "turn")


@query("""with t as (select l_orderkey as doc, l_linenumber % 2 as page, l_linenumber as table_id, l_quantity as top from lineitem where l_returnflag = 'R'), b as (select l_orderkey as doc, l_linenumber % 2 as page, l_quantity as bottom, l_partkey::varchar as text from lineitem)
  select doc, page::int as page, table_id, arg_min(text, (top - bottom, text)) as title from t join b using (doc, page) where bottom <= top group by all""")
def q_nearest_above(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") % 2).cast("int").alias("page"), "l_linenumber", "l_quantity", "l_partkey", "l_returnflag")
    tables = rows.where("l_returnflag = 'R'").select("doc", "page", F.col("l_linenumber").alias("table_id"), F.col("l_quantity").alias("top"))
    return C.nearest_above(tables, rows.select("doc", "page", F.col("l_quantity").alias("bottom"), F.col("l_partkey").cast("string").alias("text")))


_HEADS = (["", "", ""], ["Particulars", "Q1 FY24", "Q2 FY24"], ["Particulars", "Audited", "Audited"])
_TOPS = (["Sr", "30 Jun", "30 Sep"], ["", "2023", "2024"], ["Particulars", "Sep 30, 2025", "Jun 30, 2025"])


def _headed(spark, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    arr = lambda xs: F.array(*map(F.lit, xs))
    money = N.two_places(F.col("c_acctbal"))
    body = [F.array(F.lit("Income"), money, (k % 90 + 100).cast("string")), F.array(F.lit("Cost"), F.lit("(55)"), F.lit("77"))]
    tops = F.when(k % 3 == 0, F.array(arr(_TOPS[0]), arr(_TOPS[1]))).when(k % 3 == 1, F.array(arr(["Income", "1", "2"]))).otherwise(F.array(arr(_TOPS[2])))
    heads = F.when(k % 3 == 0, arr(_HEADS[0])).when(k % 3 == 1, arr(_HEADS[1])).otherwise(arr(_HEADS[2]))
    context = F.when(k % 6 == 0, "Balance sheet Particulars as at September 30 , 2024 March 31,2024 Income 5")
    rows = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_custkey")
    return rows.select(k.alias("table_id"), F.lit("in crore").alias("title"), heads.alias("headers"), F.concat(tops, F.array(*body)).alias("rows"), context.alias("context"))


@query(f"""with t as (select c_custkey as id, c_custkey % 3 as m, c_custkey % 6 = 0 as ctx, {[list(h) for h in _HEADS]}[c_custkey % 3 + 1] as h, [[{list(_TOPS[0])}, {list(_TOPS[1])}], [], [{list(_TOPS[2])}]][c_custkey % 3 + 1] as tops,
    [case when c_custkey % 3 = 1 then 'Income' end, 'Income', 'Cost'] as labels, printf('%.2f', c_acctbal) as a, (c_custkey % 90 + 100)::varchar as b from customer),
  h as (select *, case when len(tops) = 0 then h else list_transform(range(1, 4), lambda i: case when len(tops) = 1 then tops[1][i] when tops[2][i] = '' then tops[1][i] else tops[1][i] || ' (' || tops[2][i] || ')' end) end as heads from t),
  p as (select *, case when ctx then ['Sep 30, 2024', 'Mar 31, 2024'] when m = 0 then null else heads[2:3] end as periods from h),
  c as (select id, unnest([{{'n': case when m = 1 then 'Income' end, 'v': '1', 'k': 1}}, {{'n': case when m = 1 then 'Income' end, 'v': '2', 'k': 2}}, {{'n': 'Income', 'v': a, 'k': 1}}, {{'n': 'Income', 'v': b, 'k': 2}}, {{'n': 'Cost', 'v': '-55', 'k': 1}}, {{'n': 'Cost', 'v': '77', 'k': 2}}]) as x, periods from p where periods is not null)
  select id as table_id, x.n as name, x.v as value, 'Crore INR' as unit, periods[x.k] as period from c where x.n is not null""")
def q_table_headers(spark, sf_dir: str) -> DataFrame:
    return TB.unpivot(_headed(spark, sf_dir)).select("table_id", "name", "value", "unit", "period")


@query()
def q_table_markdown(spark, sf_dir: str) -> DataFrame:
    rows = _headed(spark, sf_dir).withColumnRenamed("context", "text").withColumns({"section": F.lit("standalone results"), "document": F.lit("x.pdf")})
    return TB.table_markdown(rows)


# ------------------------------------------------------------------ load


def _extractions(spark, sf_dir: str) -> DataFrame:
    """Pieces of extractions: an order is a chunk, a line item one of its pieces."""
    o, i = F.col("l_orderkey"), F.col("l_linenumber")
    s = lambda x: x.cast("string")
    nothing = F.lit(None).cast("string")
    # Dealt out by chunk while the rows are narrow; neither the pieces nor the chunks are shuffled again.
    cols = ("l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    items = table(spark, sf_dir, "lineitem").select(s(o).alias("chunk_id"), "l_orderkey", "l_linenumber", *cols)
    rows = spread(items, "chunk_id").groupBy("chunk_id", "l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in cols]).select(
        "chunk_id", s(o % 20).alias("quarter_id"), F.when(o % 3 == 0, "table").otherwise("text").alias("chunk_type"), i.alias("piece"),
        F.array(F.struct(s(F.col("l_partkey") % 50).alias("name"), F.when(i % 3 != 0, "Part").alias("type"))).alias("entities"),
        F.array(F.struct(s(F.col("l_partkey") % 50).alias("source"), F.lit("Part").alias("source_type"), F.when(i % 4 == 0, "is part-of").otherwise(" sold  by ").alias("relation"), s(F.col("l_suppkey") % 9).alias("target"), nothing.alias("target_type"))).alias("relationships"),
        F.when(i == 1, F.array(F.struct(F.col("l_returnflag").alias("name"), s(F.col("l_quantity").cast("int")).alias("value"), F.lit("Crore").alias("unit"), F.when(o % 2 == 0, "Q1").alias("period")))).alias("metrics"),
        F.array(F.struct(F.when(i % 2 == 0, F.col("l_linestatus")).alias("statement"), F.lit("t").alias("topic"))).alias("guidance"), F.array(F.struct(F.col("l_returnflag").alias("statement"), nothing.alias("type"))).alias("risks"),
        F.when(i == 2, "good").when(i == 3, "bad").alias("sentiment"),
    )
    return rows


@query(f"select l_orderkey::varchar as chunk_id, count(*) as n_entities, count(*) filter (l_linenumber = 1) as n_metrics, case when bool_or(l_linenumber = 2) then 'good' when bool_or(l_linenumber = 3) then 'bad' end as sentiment, string_agg(l_returnflag, '' order by l_linenumber) as risks from {_LI} group by l_orderkey")
def q_merge_pieces(spark, sf_dir: str) -> DataFrame:
    rows = L.merge_pieces(_extractions(spark, sf_dir))
    return rows.select("chunk_id", F.size("entities").cast("long").alias("n_entities"), F.size("metrics").cast("long").alias("n_metrics"), "sentiment", F.array_join(F.transform("risks", lambda r: r["statement"]), "").alias("risks"))


@query(f"""with e as (select distinct l_orderkey::varchar as src, 'MENTIONS' as rel, 'Part:' || (l_partkey % 50) as dst from {_LI} where l_linenumber % 3 <> 0), r as (select distinct 'Part:' || (l_partkey % 50) as src, 'SOLD_BY' as rel, (l_suppkey % 9)::varchar as dst from {_LI} where l_linenumber % 4 <> 0),
  m as (select distinct l_orderkey::varchar as c, (l_orderkey % 20)::varchar as q, (l_orderkey % 20) || '|' || l_returnflag || '|' || case when l_orderkey % 2 = 0 then 'Q1' else '' end as dst from {_LI} where l_linenumber = 1)
  select * from e union all select * from r union all select distinct q, 'HAS_METRIC', dst from m union all select distinct c, 'CONTAINS_METRIC', dst from m""")
def q_graph_edges(spark, sf_dir: str) -> DataFrame:
    rows = L.merge_pieces(_extractions(spark, sf_dir))
    return L.mentions(rows).unionByName(L.relations(rows)).unionByName(L.metric_edges(rows))


@query(f"""with m as (select l_orderkey::varchar as c, (l_orderkey % 20)::varchar as q, l_returnflag as name, case when l_orderkey % 2 = 0 then 'Q1' end as period, l_quantity::int::varchar as value from {_LI} where l_linenumber = 1)
  select q || '|' || name || '|' || coalesce(period, '') as id, arg_max(value, c) as value, max(c) as source_chunk_id from m group by q, name, period""")
def q_metric_nodes(spark, sf_dir: str) -> DataFrame:
    return L.metric_nodes(L.merge_pieces(_extractions(spark, sf_dir))).select("id", "value", "source_chunk_id")


@query(f"""select distinct sha256(s) as id, k as kind, q as quarter_id, c as chunk_id from (select l_linestatus as s, 'guidance' as k, (l_orderkey % 20)::varchar as q, l_orderkey::varchar as c from {_LI} where l_orderkey % 3 <> 0 and l_linenumber % 2 = 0
  union all select l_returnflag, 'risks', (l_orderkey % 20)::varchar, l_orderkey::varchar from {_LI} where l_orderkey % 3 <> 0)""")
def q_statements(spark, sf_dir: str) -> DataFrame:
    rows = L.merge_pieces(_extractions(spark, sf_dir))
    side = lambda k: L.statements(rows, k).select("id", F.lit(k).alias("kind"), "quarter_id", "chunk_id")
    return side("guidance").unionByName(side("risks"))


@query("""select l_suppkey, l_partkey, count(*) as n from lineitem group by all having count(*) > 1""")
def q_duplicate_keys(spark, sf_dir: str) -> DataFrame:
    return G.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_partkey"])


@query("select doc_id as chunk_id from documents left join embeddings on doc_id = vec_id where text is not null and embedding is null")
def q_pending_embeddings(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("embedding_text"))
    return S.pending_embeddings(docs.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id", "left")).select("chunk_id")


# ------------------------------------------------------------------ provenance


@query("select item_id, doc_id from benchmark b join documents d on contains(d.text, b.text)")
def q_provenance_exact(spark, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("evidence"))
    return PV.exact_sources(items, table(spark, sf_dir, "documents").select("doc_id", "text")).select("item_id", "doc_id")


@query()
def q_provenance_fuzzy(spark, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("quarter_id"), F.col("text").alias("evidence"))
    return PV.best_sources(items, table(spark, sf_dir, "documents").select(F.col("source").alias("quarter_id"), F.col("doc_id").alias("chunk_id"), "text"))
