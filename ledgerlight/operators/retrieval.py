"""Hybrid retrieval for a whole frame of questions at once.

Scores are columns of (question_id, chunk_id) rows; every ranking ends with the chunk's id. Dense scores compare a stated
set of questions with all chunks: questions are broadcast after their number is checked, in blocks beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.periods import in_quarter, in_source, in_years
from ..functions.text import company_key, same_company, signature, tokens

# Boosts by chunk type, and the constants of BM25.
BOOST_NUMERIC = {"table": 1.15, "text": 1.05, "audio": 0.85}
BOOST_QUALITATIVE = {"table": 0.90, "text": 0.95, "audio": 1.15}
K1, B, EPSILON = 1.5, 0.75, 0.25
MOST_QUESTIONS = 10_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """A zero vector counts as of length 1e-8."""
    return dot(a, b) / (F.greatest(F.sqrt(dot(a, a)), F.lit(1e-8)) * F.greatest(F.sqrt(dot(b, b)), F.lit(1e-8)))


def dense_scores(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(question_id, chunk_id, dense): all chunks for each question (question_id, q_vec)."""
    n = questions.count()
    parts = -(-n // MOST_QUESTIONS) or 1
    out = None
    for k in range(parts):
        block = questions if parts == 1 else questions.where(F.pmod(F.xxhash64("question_id"), F.lit(parts)) == k)
        one = chunks.join(F.broadcast(block)).select("question_id", "chunk_id", cosine(F.col("q_vec"), F.col("embedding")).alias("dense"))
        out = one if out is None else out.union(one)
    return out


def bm25_statistics(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings (term, chunk_id, tf, dl) and one row (n, avgdl) over the whole corpus."""
    split = chunks.select("chunk_id", tokens(F.col("text")).alias("t"))
    posts = split.select("chunk_id", F.size("t").alias("dl"), F.explode_outer("t").alias("term"))
    posts = posts.where("term is not null").groupBy("chunk_id", "dl", "term").agg(F.count("*").alias("tf"))
    return posts, split.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avgdl"))


def bm25_idf(posts: DataFrame, totals: DataFrame) -> DataFrame:
    """(term, idf): log-odds; negative ones become a quarter of the mean."""
    df = posts.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(totals.select("n")))
    raw = df.withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("idf").alias("mean"))
    return raw.join(F.broadcast(mean)).select("term", F.when(F.col("idf") < 0, EPSILON * F.col("mean")).otherwise(F.col("idf")).alias("idf"))


def bm25_scores(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(question_id, chunk_id, bm25) of chunks that share a term with (question_id, question); repeated terms count again.

    Every statistic is of the whole corpus. Postings are cut to the asked terms before they meet the questions."""
    posts, totals = bm25_statistics(chunks)
    asked = questions.select("question_id", F.explode(tokens(F.col("question"))).alias("term")).groupBy("question_id", "term").agg(F.count("*").alias("qn"))
    own = posts.join(asked.select("term").distinct(), "term", "left_semi")
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    weighed = own.join(bm25_idf(posts, totals), "term").join(F.broadcast(totals)).select("term", "chunk_id", (F.col("idf") * tf).alias("w"))
    return weighed.join(asked, "term").groupBy("question_id", "chunk_id").agg(F.sum(F.col("qn") * F.col("w")).alias("bm25"))


def normalised(scores: DataFrame, column: str) -> DataFrame:
    """Divided by the question's maximum where that is positive."""
    top = scores.groupBy("question_id").agg(F.max(column).alias("top_"))
    return scores.join(top, "question_id").withColumn(column, F.when(F.col("top_") > 0, F.col(column) / F.col("top_")).otherwise(F.col(column))).drop("top_")


def blend(dense: Column, bm25: Column, weight: float = 0.10) -> Column:
    return (1 - weight) * dense + weight * F.coalesce(bm25, F.lit(0.0))


def rescore(dense: Column, bm25: Column, structural: Column, weights=(0.45, 0.25, 0.30)) -> Column:
    """With a structural similarity; weights are renormalised, missing and negative similarities count 0."""
    total = sum(weights)
    return (weights[0] * dense + weights[1] * F.coalesce(bm25, F.lit(0.0)) + weights[2] * F.greatest(F.coalesce(structural, F.lit(0.0)), F.lit(0.0))) / total


def type_boost(kind: Column, numeric: Column) -> Column:
    pick = lambda m: F.when(kind == "table", m["table"]).when(kind == "text", m["text"]).when(kind == "audio", m["audio"]).otherwise(1.0)
    return F.when(numeric, pick(BOOST_NUMERIC)).otherwise(pick(BOOST_QUALITATIVE))


def financial_boost(numeric: Column, names_metric: Column, metric_in_text: Column, wanted: Column, actual: Column) -> Column:
    """For numeric questions: the named metric in the text, and the wanted statement type."""
    metric = F.when(~names_metric, 1.0).when(metric_in_text, 1.10).otherwise(0.94)
    kind = F.when(wanted.isNull() | actual.isNull(), 1.0).when(actual == wanted, 1.12).otherwise(0.86)
    return F.when(numeric, metric * kind).otherwise(1.0)


def collapse_near_duplicates(scored: DataFrame, text: str = "text", score: str = "score") -> DataFrame:
    """The best of each signature per question; blank signatures all stay, and are spread by chunk instead of gathered."""
    rows = scored.withColumn("sig_", signature(F.col(text)))
    w = Window.partitionBy("question_id", "sig_", F.when(F.col("sig_") == "", F.col("chunk_id"))).orderBy(F.desc(score), "chunk_id")
    return rows.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1 or sig_ = ''").drop("rn_", "sig_")


def top_k(scored: DataFrame, k, score: str = "score") -> DataFrame:
    """The k best per question with their rank; only k rows per task are shuffled on."""
    w = Window.partitionBy("question_id").orderBy(F.desc(score), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def expand_pool(ranked: DataFrame, pool: int = 5, most: int = 10, structural: str = "structural") -> DataFrame:
    """Behind the first ``pool`` rows, up to ``most`` others with positive structural similarity move ahead; new ``pos``."""
    rest = Window.partitionBy("question_id", F.col("rank") > pool).orderBy(F.desc(structural), "chunk_id")
    rows = ranked.withColumn("s_", F.row_number().over(rest))
    seg = F.when(F.col("rank") <= pool, 0).when((F.col(structural) > 0) & (F.col("s_") <= most), 1).otherwise(2)
    order = Window.partitionBy("question_id").orderBy("seg_", F.when(F.col("seg_") == 1, F.col("s_")).otherwise(F.col("rank")))
    return rows.withColumn("seg_", seg).withColumn("pos", F.row_number().over(order)).drop("s_", "seg_")


def reserve_slots(ranked: DataFrame, k: int, kind: str = "audio", least: int = 1) -> DataFrame:
    """The k best, in which at least min(least, k - 1) rows of a kind replace the weakest others, if there are any."""
    own = Window.partitionBy("question_id", F.col("kind") == kind).orderBy("rank")
    rows = ranked.withColumn("o_", F.row_number().over(own)).withColumn("is_", (F.col("kind") == kind))
    q = Window.partitionBy("question_id")
    have = F.sum((F.col("is_") & (F.col("rank") <= k)).cast("int")).over(q)
    there = F.sum(F.col("is_").cast("int")).over(q)
    rows = rows.withColumn("slots_", F.greatest(have, F.least(F.lit(min(least, k - 1)), there)))
    keep = F.when(F.col("is_"), F.col("o_") <= F.col("slots_")).otherwise(F.col("o_") <= k - F.col("slots_"))
    return rows.where(keep).drop("o_", "is_", "slots_")


def seed_centroid(ranked: DataFrame, vectors: DataFrame, seeds: int = 5) -> DataFrame:
    """(question_id, centroid): the normalised mean of the first seeds' vectors (chunk_id, vec); none for zero."""
    rows = ranked.where(F.col("rank") <= seeds).join(vectors, "chunk_id").select("question_id", F.posexplode("vec").alias("i", "x"))
    means = rows.groupBy("question_id", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    packed = means.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    norm = F.sqrt(dot(F.col("c"), F.col("c")))
    return packed.withColumn("n_", norm).where("n_ > 0").select("question_id", F.transform("c", lambda x: x / F.col("n_")).alias("centroid"))


def filter_with_fallback(rows: DataFrame, keep: Column, keys=("question_id",)) -> DataFrame:
    """Rows that satisfy ``keep``, or all rows of a key where none does. Only keys with a kept row travel, not the rows."""
    flagged = rows.withColumn("k_", F.coalesce(keep, F.lit(False)))
    some = flagged.where("k_").select(*[F.col(k).alias(f"{k}_k") for k in keys]).distinct()
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"{k}_k"))
        same = one if same is None else same & one
    out = flagged.join(some.withColumn("any_", F.lit(True)), same, "left")
    return out.where("k_ or any_ is null").select(*rows.columns)


def scoped(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(question_id, chunk_id) within the wishes of each question (question_id, company, year, quarter, source_filter): a company
    matched by name key, a year or range of years, a quarter, a source type. Empty wishes are no filter.

    Wishes are few beside questions: each distinct one meets the few distinct (company, year, quarter, source_type) of the chunks,
    and both sides are joined back by equality."""
    wish = ["company", "year", "quarter", "source_filter"]
    place = ["company", "year", "quarter", "source_type"]
    w = questions.select(*wish).distinct().select(F.struct(*wish).alias("wish"), company_key(F.col("company")).alias("wk"))
    c = chunks.select(*place).distinct().select(F.struct(*place).alias("place"), company_key(F.col("company")).alias("ck"))
    company = (F.coalesce("wish.company", F.lit("")) == "") | same_company(F.col("ck"), F.col("wk"))
    fits = company & in_years(F.col("place.year"), F.col("wish.year")) & in_quarter(F.col("place.quarter"), F.col("wish.quarter")) & in_source(F.col("place.source_type"), F.col("wish.source_filter"))
    met = w.join(c, fits).select("wish", "place")
    q = questions.select("question_id", F.struct(*wish).alias("wish"))
    p = chunks.select("chunk_id", F.struct(*place).alias("place"))
    return q.join(met, q["wish"].eqNullSafe(met["wish"])).select("question_id", met["place"]).alias("a").join(p.alias("b"), F.col("a.place").eqNullSafe(F.col("b.place"))).select("question_id", "chunk_id")


def quarter_chunks(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per quarter (src) and embedded chunk (dst) that an edge of any kind ties; text falls back to what was embedded."""
    rows = edges.select(F.col("src").alias("quarter_id"), F.col("dst").alias("chunk_id")).distinct().join(chunks.where("embedding is not null"), "chunk_id")
    return rows.withColumn("text", F.coalesce("text", "embedding_text"))


def union_of_companies(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each of a question's companies (question_id, company, chunk_id, score, place of the company), each chunk once,
    with the first company that has it."""
    best = Window.partitionBy("question_id", "company").orderBy(F.desc("score"), "chunk_id")
    rows = scored.withColumn("r_", F.row_number().over(best)).where(F.col("r_") <= k)
    first = Window.partitionBy("question_id", "chunk_id").orderBy("place", "r_")
    return rows.withColumn("f_", F.row_number().over(first)).where("f_ = 1").drop("r_", "f_")


def reranked(ranked: DataFrame, rerank_score: str = "rerank_score", pool: int = 30, alpha: float = 0.5) -> DataFrame:
    """The first ``pool`` rows by the mean of both scores, each scaled to 0..1 in its question; rows behind the pool stay there.
    The scores come from a provider."""
    from ..functions.numbers import min_max

    w = Window.partitionBy("question_id", F.col("rank") <= pool)
    both = alpha * min_max(F.col(rerank_score), w) + (1 - alpha) * min_max(F.col("score"), w)
    rows = ranked.withColumn("blend_", F.round(both, 12))
    order = Window.partitionBy("question_id").orderBy(F.when(F.col("rank") <= pool, 0).otherwise(1), F.when(F.col("rank") <= pool, -F.col("blend_")).otherwise(F.col("rank")), "chunk_id")
    return rows.withColumn("pos", F.row_number().over(order)).drop("blend_")


def fair_cap(ranked: DataFrame, base_k: int) -> DataFrame:
    """At most base_k * min(n, 2) rows per question: each of n companies has max(2, total // n), the rest goes by score."""
    q = Window.partitionBy("question_id")
    rows = ranked.withColumn("n_", F.size(F.collect_set("company").over(q))).withColumn("total_", base_k * F.least("n_", F.lit(2)))
    rows = rows.withColumn("share_", F.greatest(F.lit(2), F.floor(F.col("total_") / F.col("n_"))))
    rows = rows.withColumn("c_", F.row_number().over(Window.partitionBy("question_id", "company").orderBy(F.desc("score"), "chunk_id")))
    first = F.when(F.col("c_") <= F.col("share_"), 0).otherwise(1)
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("question_id").orderBy(first, F.desc("score"), "chunk_id")))
    return rows.where("pos <= total_").drop("n_", "total_", "share_", "c_")
