"""Documented input and output pairs, and properties."""

import pytest
from pyspark.sql import functions as F

from ledgerlight.functions import answers as A
from ledgerlight.functions import guards as GD
from ledgerlight.functions import numbers as N
from ledgerlight.functions import periods as P
from ledgerlight.functions import routing as R
from ledgerlight.functions import tables as TB
from ledgerlight.functions import text as T
from ledgerlight.operators import chunking as C
from ledgerlight.operators import facts as FA
from ledgerlight.operators import graph as G
from ledgerlight.operators import load as L
from ledgerlight.operators import metrics as M
from ledgerlight.operators import provenance as PV
from ledgerlight.operators import retrieval as RT


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [("1,591.04", 1591.04), ("(500)", -500.0), ("12%", 12.0), ("n/a", None), (None, None)])
def test_parse_numeric(spark, text, want):
    assert one(spark, N.parse_numeric(F.col("t")), t=text) == want if text else one(spark, N.parse_numeric(F.lit(None).cast("string"))) is None


@pytest.mark.parametrize(("text", "want"), [("(500)", ("-500", None)), ("12%", ("12", "%")), ("1't.92", (None, None)), ("-", (None, None))])
def test_parse_cell(spark, text, want):
    assert tuple(one(spark, N.parse_cell(F.col("t")), t=text)) == want


def test_adjacent(spark):
    for (fy, q, by), want in {(2026, 1, -1): (2025, 4), (2025, 3, -4): (2024, 3)}.items():
        a, b = P.shift(F.lit(fy), F.lit(q), F.lit(by))
        assert tuple(spark.range(1).select(a, b).first()) == want


def test_fiscal_quarter(spark):
    d = F.lit("2024-12-15").cast("date")
    assert tuple(spark.range(1).select(P.fiscal_quarter(d), P.fiscal_year(d)).first()) == (3, 2025)


@pytest.mark.parametrize(("text", "want"), [("30-Jun-23", True), ("Sep 30, 2025", True), ("Q2 FY26", True), ("30 Sep 2025", False), ("31-0ec-25", False), ("col_1", False)])
def test_strict_period(spark, text, want):
    assert one(spark, P.looks_like_period(F.col("t")), t=text) is want


def test_period_guards(spark):
    assert one(spark, P.bad_label(F.lit("Q4 FY204"))) and one(spark, P.bad_label(F.lit("col_3"))) and not one(spark, P.bad_label(F.lit("Q4 FY2024")))
    assert one(spark, P.contradicts(F.lit("Q3"), F.lit("2026"), F.lit("December 31, 2024")))
    assert one(spark, P.contradicts(F.lit("Q4"), F.lit("2026"), F.lit("Q1 FY2024")))
    assert not one(spark, P.contradicts(F.lit("Q4"), F.lit("2026"), F.lit("whatever")))


def test_change_type(spark):
    kind = lambda *x: one(spark, P.change_type(*map(F.lit, x)))
    assert [kind(2025, 4, 2026, 1), kind(2025, 1, 2025, 2), kind(2025, 1, 2026, 1)] == ["sequential", "QoQ", "YoY"]


def test_numbers(spark):
    assert one(spark, N.matched(F.array(F.lit("21.2")), F.array(F.lit("21.20")))) == 1
    assert one(spark, N.matched(F.array(F.lit("4778.91")), F.array(F.lit("4778.92")))) == 0
    assert one(spark, N.within_tolerance(F.array(F.lit("3.7%")), F.array(F.lit("3.6%")))) is False
    assert one(spark, N.answer_numbers(F.lit("In Q2 FY26 12 of 5. FINAL ANSWER: 1,065.41 in March 31, 2025"))) == ["1065.41"]
    assert one(spark, A.strip_delta(F.lit("x FINAL ANSWER: 1,065.41 (+226.79 crore (+17.81%))"))).endswith("1,065.41")


def test_companies(spark):
    same = lambda a, b: one(spark, T.same_company(T.company_key(F.lit(a)), T.company_key(F.lit(b))))
    assert same("Nykaa (FSN E-Commerce Ventures Limited)", "NYKAA") and same("CreditAccess Grameen Limited", "Credit Access Grameen") and not same("", "x")


def test_routing(spark):
    got = R.route(F.lit("Why did revenue increase quarter-on-quarter in Q2 FY26?"))
    assert one(spark, got["source_filter"]) == "both" and one(spark, got["is_temporal"])
    assert not one(spark, T.is_numeric_question(F.lit("disbursement")))


def test_relation_name(spark):
    assert one(spark, G.relation_name(F.lit("develops"))) == "DEVELOPS" and one(spark, G.relation_name(F.lit("is part-of"))) is None


def test_jaccard_of_nothing(spark):
    empty = F.array().cast("array<string>")
    assert one(spark, M.jaccard(empty, empty)) is None


def test_unpivot_fails_closed(spark):
    t = spark.createDataFrame([(1, "in crore", ["x", "Q1 FY24", "Q1 FY24"], [["Income", "1", "2"]]), (2, "in crore", ["x", "Q1 FY24", "Q2 FY24"], [["Income", "1", "(2)"], ["Notes", "1", "2"]])], "table_id long, title string, headers array<string>, rows array<array<string>>")
    assert sorted(map(tuple, TB.unpivot(t).drop("row_no").collect())) == [(2, "Income", "-2", "Crore INR", "Q2 FY24"), (2, "Income", "1", "Crore INR", "Q1 FY24")]


def test_window_dedupe_keeps_anchor(spark):
    b = spark.createDataFrame([(1, p, 0, "t") for p in (1, 3, 5, 6)], "doc long, page long, pos long, text string")
    assert sorted(r.page for r in C.window_dedupe(b).collect()) == [1, 5]


def test_filter_fallback_never_empties(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b")], "question_id long, k string")
    assert sorted(map(tuple, RT.filter_with_fallback(rows, F.col("k") == "a").collect())) == [(1, "a"), (2, "b")]


def test_fast_rp_is_stable(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "d")], "src string, dst string")
    runs = [{r.node: [round(x, 9) for x in r.vec] for r in G.fast_rp(x, 16).collect()} for x in (e, e.repartition(3))]
    assert runs[0] == runs[1] and set(runs[0]) == {"a", "b", "c"}


def periods(spark, q, year=None, quarter=None):
    got = one(spark, P.question_periods(F.lit(q), F.lit(year).cast("string"), F.lit(quarter).cast("string")))
    return [(x.q, x.fy) for x in got]


def test_question_periods(spark):
    assert periods(spark, "Why did revenue increase quarter-on-quarter in Q2 FY26?") == [("Q2", "2026"), ("Q1", "2026")]
    assert periods(spark, "revenue year-on-year in Q3 FY25") == [("Q3", "2025"), ("Q3", "2024")]
    assert periods(spark, "highest revenue in FY26") == [(f"Q{i}", "2026") for i in (1, 2, 3, 4)]
    assert periods(spark, "annual revenue in FY25 and FY24") == [("FY", "2024"), ("FY", "2025")]
    assert periods(spark, "Q1 FY24 vs Q1 FY24", "2024", "q1") == [("Q1", "2024")] and periods(spark, None) == []


@pytest.mark.parametrize(("label", "want"), [("Q1 FY24", (1, 2024)), ("December 31, 2024", (3, 2025)), ("30-06-2024", (1, 2025)), ("30062024", (1, 2025)), ("31 Mar 2025", (4, 2025)), ("2024", (None, None)), (None, (None, None))])
def test_parse_label(spark, label, want):
    assert tuple(one(spark, P.parse_label(F.lit(label).cast("string")))) == want


def test_scope(spark):
    assert one(spark, P.in_years(F.lit("2025"), F.lit("2024-2026"))) and not one(spark, P.in_years(F.lit("n/a"), F.lit("2024-2026"))) and one(spark, P.in_years(F.lit("x"), F.lit("")))
    assert one(spark, P.in_quarter(F.lit("Q1"), F.lit("FY-full"))) and not one(spark, P.in_quarter(F.lit("Q1"), F.lit("Q2"))) and one(spark, P.in_source(F.lit("audio"), F.lit("both")))


def test_guards(spark):
    at = lambda f, *x: one(spark, f(*map(F.lit, x)))
    assert at(GD.implausible_unit, "Billion USD", "in crore") and not at(GD.implausible_unit, "Billion USD", "US$ 3")
    assert at(GD.stray_percentage, "Revenue", "17%") and not at(GD.stray_percentage, "Revenue growth", "17%")
    assert not at(GD.absent_from_source, "21.20", "a 21.2 b") and at(GD.absent_from_source, "21.3", "a 21.2 b") and not at(GD.absent_from_source, "5", " ") and not at(GD.absent_from_source, "7.0", "x 7 y")
    assert at(GD.small_revenue, "Revenue from operations", "1") and not at(GD.small_revenue, "Net profit", "1") and not at(GD.small_revenue, "Revenue", "n/a")
    assert at(GD.current_value, "Total revenue from operations 1,453.29 1,400.00 Other income 3", "Revenue from operations") == "1453.29"
    assert at(GD.current_value, "Earning per share (EPS) a) Basic 10.82 11.23 b) Diluted 10.80", "Basic EPS") == "10.82"
    assert at(GD.current_value, "Revenue from operations (a) x 4,900.11 (b) y (c) z", "Revenue from operations") is None
    assert at(GD.ambiguous_breakdown, "Revenue from operations", "Revenue from operations (a) x (b) y (c) z") and not at(GD.ambiguous_breakdown, "Revenue", "total revenue (a)(b)(c)")


def test_answers(spark):
    fix = lambda a, e: one(spark, A.fix_decimal_shift(F.lit(a), F.lit(e)))
    assert fix("x 287.326 FINAL ANSWER: 287.326 and 12", "it was 2873.26 or 1,2.") == "x 287.326 FINAL ANSWER: 2873.26 and 12"
    assert fix("FINAL ANSWER: 1028.3", "102.83, 10.283") == "FINAL ANSWER: 102.83" and fix("no marker 1028.3", "102.83") == "no marker 1028.3" and fix("FINAL ANSWER: none", "1234") == "FINAL ANSWER: none"
    assert one(spark, A.strip_delta(F.lit("FINAL ANSWER: 5 (+1.0%)"), F.lit("by how much?"))).endswith("(+1.0%)")
    fact = F.lit("PAT (Standalone) = 60.19 Crore (Q4-2026) [company=X Ltd; period=Q4 FY204]")
    assert [one(spark, f(fact)) for f in (A.category, A.base_name, A.company_tag, A.period_tag, A.statement_kind, A.claims_period, A.direct_answer)] == ["metric", "pat", "x ltd", "(Q4-2026)", "standalone", False, "PAT (Standalone): 60.19 Crore (Q4-2026)"]
    assert one(spark, T.is_refusal(F.lit("The text does not contain it"))) and one(spark, T.abstained(F.lit("They did not mention it"))) and not one(spark, T.is_refusal(F.lit("5 crore")))
    assert one(spark, T.split_companies(F.lit("A Ltd vs B / C, D and E"))) == ["A Ltd", "B", "C", "D", "E"] and one(spark, T.all_companies(F.lit(" All companies ")))


def test_sole_fact(spark):
    q = spark.createDataFrame([(1, ["PAT"], "(Q4-2026)"), (2, ["PAT"], None)], "question_id long, names array<string>, tag string")
    f = spark.createDataFrame([(1, "PAT = 5 (Q4-2026) []"), (1, "PAT = 6 (Q3-2026) []"), (1, "PAT = 7 (Q4-2026) [confidence=low_x]"), (2, "PAT = 5 (Q4-2026)"), (2, "PAT = 6 (Q4-2026)")], "question_id long, fact string")
    assert [tuple(r) for r in FA.sole_fact(f, q).collect()] == [(1, "PAT = 5 (Q4-2026) []")]


def test_split_and_merge(spark):
    text = "\n".join(f"line {i} " + "x" * 90 for i in range(30))
    assert C._split("short\n\ntext", 1200, 200) == ["short\n\ntext"] and C._split("y" * 1300, 1200, 200) == ["", "y" * 1300]
    parts = C._split(text, 1200, 200)
    assert len(parts) == 3 and all(len(p) < 1200 for p in parts) and all(b[:199] in a for a, b in zip(parts, parts[1:], strict=False))
    for t in ("", "  ", text, "a" * 25, ("b" * 7 + "\n\n") * 9):
        got = C._split_large(t, 10)
        assert "".join(got).rstrip() == t.rstrip() and all(len(p) <= 10 for p in got) and got
    rows = [(1, 0, 0.0, 1.0, "one two."), (1, 1, 1.0, 2.0, "three"), (1, 2, 2.0, 3.0, "four."), (1, 3, 3.0, 4.0, "five six seven eight nine ten"), (1, 4, 4.0, 5.0, "x")]
    got = C.merge_segments(spark.createDataFrame(rows, "call long, seq long, start double, end double, text string"), 4, 6).orderBy("seq").collect()
    assert [(r.start, r.end, r.text) for r in got] == [(0.0, 3.0, "one two. three four."), (3.0, 5.0, "five six seven eight nine ten x")]


def test_window_dedupe_spares_headings(spark):
    b = spark.createDataFrame([(1, 1, 0, "t", False), (1, 2, 0, " t\n", False), (1, 1, 1, "H", True), (1, 2, 1, "H", True)], "doc long, page long, pos long, text string, is_heading boolean")
    assert sorted((r.page, r.pos) for r in C.window_dedupe(b).collect()) == [(1, 0), (1, 1), (2, 1)]


def test_tables(spark):
    kinds = "table_id long, title string, headers array<string>, rows array<array<string>>, context string"
    rows = [["Income", "1,200.5", "(77)"], ["", "", ""], ["Expenses", "nil", "9%"]]
    t = [
        (1, "Rs. in crore", ["", "", ""], [["Sr", "30 Jun", "30 Sep"], ["", "2023", "2024"], *rows], None),
        (2, "x", ["Particulars", "Audited", "Audited"], rows, "Particulars as at March 31, as at June 30, 2025 2024 Income 5"),
        (3, "x", ["", "", ""], [["Income", "55", ""], ["Cost", "", "66"]], None), (4, "x", ["P", "Value"], [["Income", "5"]], None), (5, "x", ["P", "Q1 FY24", "notes of a prose line"], rows, None),
        (6, "x", ["", "", ""], [["Income", "101", "102"], ["Cost", "103", "104"], ["Profit", "105", "106"]], None), (7, "x", ["S", "P", "Q1 FY24", "Q2 FY24"], [["1.", "Income", "5", "6"], ["2.", "Cost", "7", "8"]], None),
    ]
    got = {}
    for r in TB.unpivot(spark.createDataFrame(t, kinds)).orderBy("table_id", "row_no", "period").collect():
        got.setdefault(r.table_id, []).append((r.name, r.value, r.unit, r.period))
    assert 1 not in got  # '30 Jun (2023)' has no period's shape, and no context tells it
    assert got[2] == [("Income", "-77", None, "Jun 30, 2024"), ("Income", "1200.5", None, "Mar 31, 2025"), ("Expenses", "9", "%", "Jun 30, 2024")]
    assert 3 not in got and 5 not in got and got[4] == [("Income", "5", None, "")]
    assert got[6][:2] == [("Income", "101", None, "col_1"), ("Income", "102", None, "col_2")] and got[7][0] == ("Income", "5", None, "Q1 FY24") and len(got[7]) == 4
    text = one(spark, TB.table_text(F.lit("T"), F.array(*map(F.lit, ("a", "b", "c"))), F.array(F.array(*map(F.lit, ("x", "1", ""))))))
    assert text == "T\n\nColumns: a, b, c\n\nx\nb = 1"
    assert one(spark, TB.table_text(F.lit(None).cast("string"), F.array(*map(F.lit, ("a", "b"))), F.array(F.array(*map(F.lit, ("x", "1")))))) == "Columns: a, b\na: x; b: 1"
    full = spark.createDataFrame(t, kinds).withColumns({"text": F.col("context"), "section": F.lit("Standalone"), "document": F.lit("d")}).drop("context")
    shown = {r.table_id: r.markdown for r in TB.table_markdown(full).collect()}
    assert shown[7] == "**[Standalone figures]**\n| Metric | Q1 FY24 | Q2 FY24 |\n|---|---|---|\n| Income | 5 | 6 |\n| Cost | 7 | 8 |" and "| Col 2 | Col 3 |" in shown[6] and shown[3] == ""


def test_longest_block():
    import random

    rng = random.Random(3)
    for _ in range(60):
        a, b = ("".join(rng.choice("ab ") for _ in range(rng.randint(1, 14))) for _ in range(2))
        want = max((j - i for i in range(len(a)) for j in range(i + 1, len(a) + 1) if a[i:j] in b), default=0)
        assert PV.longest_block(a, b) == want


def test_sources_of_evidence(spark):
    items = spark.createDataFrame([(1, "q", "One  two three four"), (2, "q", "short"), (3, "q", "nothing alike at all!!"), (4, "q", "alpha beta gamma delta EPS")], "item_id long, quarter_id string, evidence string")
    chunks = spark.createDataFrame([(10, "q", "x one two THREE four y"), (11, "q", "one two three four"), (12, "q", "zz alpha beta gamma d zz")], "chunk_id long, quarter_id string, text string")
    got = {r.item_id: (r.chunk_id, round(r.share, 2)) for r in PV.best_sources(items, chunks).collect()}
    assert got == {1: (10, 1.0), 4: (12, 0.69)}
    exact = PV.exact_sources(spark.createDataFrame([(1, "two three four five six seven"), (2, "wo"), (3, "")], "item_id long, evidence string"), spark.createDataFrame([(7, "one two three four five six seven eight"), (8, "x")], "doc_id long, text string"))
    assert sorted((r.item_id, r.doc_id) for r in exact.collect()) == [(1, 7), (2, 7), (3, 7), (3, 8)]


def test_overlap_scores(spark):
    import math
    import random
    from collections import Counter

    rng = random.Random(5)
    pairs = [([rng.choice("abcd") for _ in range(rng.randint(1, 9))], [rng.choice("abcd") for _ in range(rng.randint(1, 9))]) for _ in range(40)]
    rows = spark.createDataFrame([(i, p, g) for i, (p, g) in enumerate(pairs)], "i int, p array<string>, g array<string>")
    p, g = F.col("p"), F.col("g")
    for r in rows.select("i", M.rouge_l(p, g).alias("l"), M.bleu(p, g).alias("b"), M.rouge_n(p, g, 1).alias("r")).collect():
        a, b = pairs[r.i]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert r.l == pytest.approx(2 * t[-1][-1] / (len(a) + len(b)))
        logs = 0.0
        for n in range(1, 5):
            x, y = (Counter(tuple(s[i : i + n]) for i in range(len(s) - n + 1)) for s in (a, b))
            hits = sum((x & y).values())
            first = hits if n == 1 else first
            logs += math.log((hits or 0.1) / max(1, len(a) - n + 1)) / 4
        assert r.b == pytest.approx(0 if not first else math.exp(logs + (0 if len(a) >= len(b) else 1 - len(b) / len(a))))
        assert r.r == pytest.approx(2 * sum((Counter(a) & Counter(b)).values()) / (len(a) + len(b)))


def test_replies(spark):
    assert L.repaired('{"a": [1, 2, {"b": "x,') == '{"a": [1, 2]}' and L.repaired('{"a": 1') is None and L.repaired('{"q": ["a,b", "c') == '{"q": ["a,b"]}'
    rows = spark.createDataFrame([(1, '```json\n{"sentiment": "good", "entities": [{"name": "a", "type": "b"}]}\n```'), (2, '{"entities": [{"name": "a", "type": "b"}, {"na'), (3, "sorry"), (4, None)], "id long, text string")
    got = {r.id: r for r in L.parse_replies(rows).collect()}
    assert [got[i].status for i in (1, 2, 3, 4)] == ["ok", "repaired", "failed", "failed"] and got[1].sentiment == "good" and len(got[2].entities) == 1 and got[3].entities is None


def test_answer_path_finds_both_values(spark):
    from ledgerlight.plans.answer import answers

    rows = answers(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) > 100 and sum(r.f1 for r in rows) / len(rows) > 0.99 and max(r.n_facts for r in rows) <= 10


def test_windowed_mentions(spark, tmp_path):
    from ledgerlight.streaming import windowed_mentions

    kinds = "id long, company string, topic string, at timestamp"
    rows = spark.sql("select * from values (1L, 'a', 't', timestamp'2024-01-02 00:00:00'), (2L, 'a', 't', timestamp'2024-01-03 00:00:00'), (3L, 'a', 'u', timestamp'2024-01-03 00:00:00') as m(id, company, topic, at)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = windowed_mentions(spark.readStream.schema(kinds).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("windowed").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).start()
    run.processAllAvailable()
    run.stop()
    assert sorted((r.topic, r.n) for r in spark.table("windowed").collect()) == [("t", 2), ("u", 1)]
