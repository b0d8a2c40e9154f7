"""Facts for a question: look-ups, resolution, preference and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import guards as GD
from ..functions import periods as P
from ..functions.text import any_of, company_key, same_company, settled

# How many facts of each category a numeric and another question takes, in this order; how the rest is ranked.
QUOTA_NUMERIC = (("metric", 6), ("entity", 2), ("sentiment", 1), ("guidance", 1), ("risk", 1))
QUOTA_QUALITATIVE = (("sentiment", 3), ("guidance", 3), ("risk", 3), ("entity", 2), ("metric", 2))
PRIORITY_NUMERIC = (("metric", 0), ("entity", 1), ("sentiment", 2), ("guidance", 3), ("risk", 3))
PRIORITY_QUALITATIVE = (("sentiment", 0), ("guidance", 0), ("risk", 0), ("entity", 1), ("metric", 2))
# Names under which a period's profit stands, and names that only look like it.
PROFIT_NAMES = ("profit for the period", "profit for the year", "net profit")
NOT_PROFIT = ("before tax", "margin", "comprehensive", "gross", "reclassif", "fair value")
WHOLE_YEAR_LABEL = r"(?i)\b(year|annual|12 months|twelve months)\b"


def period_lookup(wanted: DataFrame, metrics: DataFrame, most: int = 200) -> DataFrame:
    """(name, fy, fq) rows joined to metrics, at most ``most`` per key in the order of page and id."""
    rows = metrics.join(wanted.select(F.lower("name").alias("w_"), "fy", "fq"), ["fy", "fq"]).where(F.lower("name") == F.col("w_")).drop("w_")
    w = Window.partitionBy("name", "fy", "fq").orderBy("page", "id")
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)


def chunk_metrics(retrieved: DataFrame, contains: DataFrame, metrics: DataFrame, sources: DataFrame) -> DataFrame:
    """Metrics (id, source_id, ...) that the retrieved chunks (question_id, chunk_id) contain (src, dst), with the text of their source."""
    rows = retrieved.join(contains, retrieved["chunk_id"] == contains["src"]).select("question_id", "chunk_id", F.col("dst").alias("id")).join(metrics, "id")
    text = sources.select(F.col("chunk_id").alias("source_id"), F.col("text").alias("source_text"))
    return rows.join(text, "source_id", "left")


def quarter_statements(retrieved: DataFrame, chunks: DataFrame, guidance: DataFrame, risks: DataFrame) -> DataFrame:
    """(question_id, quarter_id, guidance, risks): distinct statements of the quarters of the retrieved chunks, sorted. Each side
    is gathered before the join, so guidance and risks never multiply."""
    quarters = retrieved.join(chunks.select("chunk_id", "quarter_id"), "chunk_id").select("question_id", "quarter_id").distinct()
    pack = lambda rows, name: rows.groupBy("quarter_id").agg(F.array_sort(F.collect_set("statement")).alias(name))
    none = F.array().cast("array<string>")
    out = quarters.join(pack(guidance, "guidance"), "quarter_id", "left").join(pack(risks, "risks"), "quarter_id", "left")
    return out.select("question_id", "quarter_id", F.coalesce("guidance", none).alias("guidance"), F.coalesce("risks", none).alias("risks"))


def trusted(metrics: DataFrame) -> DataFrame:
    """Without rows whose period, unit, percentage or value cannot be theirs: (name, value, unit, quarter, year, period, source_text)."""
    name, value, unit, source = (F.col(c) for c in ("name", "value", "unit", "source_text"))
    bad = P.suspect(F.col("quarter"), F.col("year"), F.col("period")) | GD.implausible_unit(unit, source) | GD.stray_percentage(name, value)
    return settled(metrics).where(~(bad | GD.absent_from_source(value, source) | GD.small_revenue(name, value)))


def broad_lookup(wanted: DataFrame, metrics: DataFrame, most: int = 200) -> DataFrame:
    """Look-ups of (question_id, company, name, q, fy) in metrics (id, company, name, value, quarter, year, period, page).

    By the exact name; failing that, for Basic or Diluted, any EPS of that kind; failing that, for a profit, the period's profit
    under another name, if all rows agree on one value. q = 'FY' reads the fourth quarter's rows that say so. Company names are
    matched by key on the few distinct names. Tiers are per wanted row; rows come in page order, ``most`` at most per company key.
    """
    names = metrics.select("company").distinct().withColumn("k_", company_key(F.col("company")))
    asked = wanted.select("company").distinct().withColumn("w_", company_key(F.col("company"))).withColumnRenamed("company", "asked")
    pairs = asked.join(names, same_company(F.col("w_"), F.col("k_"))).select("asked", F.col("company").alias("own"))
    w = wanted.join(pairs, wanted["company"].eqNullSafe(pairs["asked"])).select("question_id", F.col("name").alias("wanted"), "q", "fy", "own")
    w = w.withColumn("quarter_", F.when(F.col("q") == "FY", "Q4").otherwise(F.col("q")))
    rows = w.join(metrics, (metrics["company"] == w["own"]) & (F.upper(metrics["quarter"]) == w["quarter_"]) & (metrics["year"].cast("string") == w["fy"]))
    label, whole = F.col("period"), F.col("q") == "FY"
    sound = ~P.bad_label(label) & ~P.contradicts(F.col("quarter"), F.col("year"), label) & (whole | ~P.window_mismatch(F.col("quarter"), label))
    low, want = F.lower("name"), F.lower("wanted")
    kind = F.lower(F.regexp_extract("wanted", r"(?i)\b(basic|diluted)\b", 1))
    eps = (kind != "") & low.contains("eps") & F.regexp_like(low, F.concat(F.lit(r"\b"), kind, F.lit(r"\b")))
    profit = want.rlike(r"\bprofit\b") & any_of(low, PROFIT_NAMES) & ~any_of(low, NOT_PROFIT)
    rows = rows.withColumn("tier", F.when(low == want, 1).when(eps, 2).when(profit, 3)).where("tier is not null")
    rows = settled(rows).where(sound)  # the labels of the rows that were found, not of all metrics
    key = ["question_id", "wanted", "q", "fy"]
    rows = lowest_tier(rows, key)
    rows = rows.withColumn("values_", F.size(F.collect_set(F.when(F.col("tier") == 3, F.trim("value"))).over(Window.partitionBy(*key)))).where("tier < 3 or values_ = 1")
    rows = rows.where(~whole | F.coalesce(label, F.lit("")).rlike(WHOLE_YEAR_LABEL))
    rn = F.row_number().over(Window.partitionBy(*key).orderBy("page", "id"))
    return rows.withColumn("rn_", rn).where(F.col("rn_") <= most).drop("rn_", "values_", "quarter_", "own")


def lowest_tier(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of look-ups tried in tiers, only the lowest tier found per key."""
    return rows.withColumn("t_", F.min("tier").over(Window.partitionBy(*keys))).where("tier = t_").drop("t_")


def single_valued(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Keys with exactly one distinct value; one row each."""
    return rows.groupBy(*keys).agg(F.count_distinct(value).alias("n_"), F.min(value).alias(value)).where("n_ = 1").drop("n_")


def first_per_signature(facts: DataFrame, keys: list[str], text: str, order: list) -> DataFrame:
    """Facts that differ in more than signs and case."""
    sig = F.regexp_replace(F.lower(F.col(text)), "[^a-z0-9]", "")
    w = Window.partitionBy(*keys, sig).orderBy(*order)
    return facts.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def prefer_recovered(facts: DataFrame, recovered: DataFrame, keys: list[str]) -> DataFrame:
    """Without facts whose key a recovered one has."""
    return facts.join(recovered.select(*keys).distinct(), keys, "left_anti")


def prefer_recovered_facts(facts: DataFrame) -> DataFrame:
    """(question_id, fact) without metric facts that a fact read again from its source makes doubtful: those of the same company,
    name and period, and untagged ones of that company and period that share two long words of its name."""
    f = facts.withColumns({"good_": F.col("fact").contains(A.RECOVERED), "company_": A.company_tag(F.col("fact")), "base_": A.base_name(F.col("fact")), "period_": A.period_tag(F.col("fact")), "tokens_": A.name_tokens(F.col("fact"))})
    good = f.where("good_")
    rest = prefer_recovered(f.where("not good_"), good, ["question_id", "company_", "base_", "period_"])
    loose = (A.category(F.col("fact")) == "metric") & ~A.claims_period(F.col("fact"))
    other = good.select(F.col("question_id").alias("q2"), F.col("company_").alias("c2"), F.col("period_").alias("p2"), F.col("tokens_").alias("t2"))
    near = loose & (F.col("question_id") == F.col("q2")) & (F.col("company_") == F.col("c2")) & (F.col("period_") == F.col("p2")) & (F.size(F.array_intersect("tokens_", "t2")) >= 2)
    return good.union(rest.join(other, near, "left_anti").select(*f.columns)).select(*facts.columns)


def resolve_statements(facts: DataFrame, wanted: Column | None = None) -> DataFrame:
    """(question_id, fact): where a company's metric has standalone and consolidated facts, only the wanted kind stays."""
    want = F.lit("consolidated") if wanted is None else F.coalesce(wanted, F.lit("consolidated"))
    f = facts.withColumns({"kind_": F.when(A.category(F.col("fact")) == "metric", A.statement_kind(F.col("fact"))), "company_": A.company_tag(F.col("fact")), "base_": A.base_name(F.col("fact")), "want_": want})
    w = Window.partitionBy("question_id", "company_", "base_")
    f = f.withColumn("there_", F.max((F.col("kind_") == F.col("want_")).cast("int")).over(w))
    return f.where((F.coalesce("there_", F.lit(0)) == 0) | F.col("kind_").isNull() | (F.col("kind_") == F.col("want_"))).select(*facts.columns)


def relevant_metrics(facts: DataFrame, question: Column) -> DataFrame:
    """(question_id, fact, ...): metric facts whose name shares a word with the question, or all of them where none does, or
    where the question is null."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(A.metric_name(F.col("fact"))), F.lit("([a-z]+)"), 1))
    metric = A.category(F.col("fact")) == "metric"
    rows = facts.withColumn("hit_", metric & F.arrays_overlap(words, A.question_words(question)))
    rows = rows.withColumn("any_", F.max("hit_").over(Window.partitionBy("question_id")))
    return rows.where(~metric | F.col("hit_") | ~F.col("any_")).drop("hit_", "any_")


def all_facts(*parts: DataFrame) -> DataFrame:
    """The union of (question_id, fact) frames, one of each signature, the first in text order."""
    out = parts[0].select("question_id", "fact")
    for part in parts[1:]:
        out = out.unionByName(part.select("question_id", "fact"))
    return first_per_signature(out, ["question_id"], "fact", ["fact"])


def resolve_kind(facts: DataFrame, keys: list[str], kind: str = "kind", wanted: str | Column = "consolidated") -> DataFrame:
    """Where a key has several kinds and the wanted one is among them, only that."""
    want = F.lit(wanted) if isinstance(wanted, str) else wanted
    w = Window.partitionBy(*keys)
    rows = facts.withColumn("has_", F.max((F.col(kind) == want).cast("int")).over(w))
    return rows.where((F.col("has_") == 0) | F.col(kind).isNull() | (F.col(kind) == want)).drop("has_")


def select_facts(facts: DataFrame, numeric: Column | None = None, most=10) -> DataFrame:
    """(question_id, category, fact): quotas in declared order, then the rest by priority, cut at ``most``; adds ``pos``.

    ``numeric`` tells per row which quotas hold, numeric ones by default; ``most`` may be a column too."""
    pick = lambda a, b, d: quota_case(F.col("category"), list(a), d) if numeric is None else F.when(numeric, quota_case(F.col("category"), list(a), d)).otherwise(quota_case(F.col("category"), list(b), d))
    places = [[(c, i) for i, (c, _) in enumerate(q)] for q in (QUOTA_NUMERIC, QUOTA_QUALITATIVE)]
    own = Window.partitionBy("question_id", "category").orderBy("fact")
    rows = facts.withColumn("c_", F.row_number().over(own)).withColumn("in_", F.col("c_") <= pick(QUOTA_NUMERIC, QUOTA_QUALITATIVE, 0))
    rows = rows.withColumn("p_", F.when(F.col("in_"), pick(*places, 9)).otherwise(pick(PRIORITY_NUMERIC, PRIORITY_QUALITATIVE, 5)))
    pos = F.row_number().over(Window.partitionBy("question_id").orderBy(F.when(F.col("in_"), 0).otherwise(1), "p_", "fact"))
    return rows.withColumn("pos", pos).where(F.col("pos") <= most).drop("c_", "in_", "p_")


def quota_case(column: Column, pairs: list, default: int) -> Column:
    out = None
    for name, value in pairs:
        out = F.when(column == name, value) if out is None else out.when(column == name, value)
    return out.otherwise(default)


def sole_fact(facts: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, fact): the one confident metric fact of a question's metrics (array ``names``) and period ('(Qn-yyyy)' or
    null), which may replace a refusal; questions with none or several have no row."""
    rows = facts.join(questions.select("question_id", "names", "tag"), "question_id")
    fact, names = F.col("fact"), F.transform("names", lambda n: F.lower(n))
    fits = (A.category(fact) == "metric") & F.array_contains(names, A.base_name(fact)) & (F.col("tag").isNull() | fact.contains(F.col("tag"))) & ~fact.contains(A.LOW_CONFIDENCE)
    return rows.where(fits).groupBy("question_id").agg(F.count("*").alias("n_"), F.min("fact").alias("fact")).where("n_ = 1").drop("n_")
