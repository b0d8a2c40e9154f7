"""The question path end to end, and its ablation, for all questions at once.

Everything starts from the question's text: routing, periods, metric names, look-ups, guards, resolution, selection, prompt,
generation, backstops, scores. The truth joins at the end only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import guards as GD
from ..functions import numbers as N
from ..functions import periods as P
from ..functions import routing as R
from ..functions import text as T
from ..operators import facts as FA
from ..operators import graph as G
from ..operators import metrics as M
from ..operators import retrieval as RT
from ..operators.temporal import evolution
from ..providers import OfflineProvider, embed_column, ensure_marker, generate_column, retry_refusals
from .bindings import metrics

#: Names that the metrics of the test tables go by here.
NAMES = {"1-URGENT": "Revenue from operations", "2-HIGH": "Net profit for the period", "3-MEDIUM": "EBITDA", "4-NOT SPECIFIED": "Basic EPS", "5-LOW": "Interest income"}
#: What each configuration has: weight of sparse scores, structural scores, facts, temporal facts, routing, hypothetical answers.
CONFIGS = (
    ("exp1_dense", 0.0, False, False, False, False, False), ("exp2_dense_bm25", 0.10, False, False, False, False, False), ("exp3_dense_bm25_fastrp", 0.10, True, False, False, False, False),
    ("exp4_plus_graph_facts", 0.10, True, True, False, False, False), ("exp5_plus_temporal_graph", 0.10, True, True, True, False, False), ("exp6_plus_routing", 0.10, True, True, True, True, False),
    ("exp7_plus_hyde_final", 0.10, True, True, True, True, True),
)
TOP_K = 7


def named_metrics(spark, sf_dir: str) -> DataFrame:
    name = F.coalesce(*[F.when(F.col("name") == k, F.lit(v)) for k, v in NAMES.items()], F.col("name"))
    return metrics(spark, sf_dir).withColumn("name", name)


def stored(spark, sf_dir: str) -> DataFrame:
    """Metric rows as an extraction left them: (id, company, name, value, unit, quarter, year, period, page, source_id)."""
    rows = named_metrics(spark, sf_dir)
    return rows.select(
        F.xxhash64("company", "name", "fy", "fq").alias("id"), "company", "name", F.format_string("%.2f", "value").alias("value"), F.lit("Crore INR").alias("unit"), F.concat(F.lit("Q"), "fq").alias("quarter"),
        F.col("fy").cast("string").alias("year"), F.lit("").alias("period"), F.col("fq").alias("page"), F.concat_ws("|", F.lit("pdf"), "company", "fy", "fq").alias("source_id"),
    )


def evidence(spark, sf_dir: str) -> DataFrame:
    """Two chunks per company and quarter: a filing with a row per metric, and a call that names no figures."""
    rows = stored(spark, sf_dir).groupBy("company", "year", "quarter", "source_id").agg(F.array_sort(F.collect_list(F.concat_ws(" ", F.lit("Total"), "name", "value", F.lit("expenses")))).alias("rows"))
    head = F.concat_ws(" ", "company", "quarter", F.concat(F.lit("FY"), "year"))
    pdf = rows.select(F.col("source_id").alias("chunk_id"), "company", "year", "quarter", F.lit("pdf").alias("source_type"), F.lit("table").alias("kind"), F.concat_ws("\n", head, F.array_join("rows", "\n")).alias("text"))
    call = F.concat(F.lit("management commentary and outlook on the call of "), head)
    audio = rows.select(F.regexp_replace("source_id", "^pdf", "audio").alias("chunk_id"), "company", "year", "quarter", F.lit("audio").alias("source_type"), F.lit("audio").alias("kind"), call.alias("text"))
    return pdf.unionByName(audio)


def asked(spark, sf_dir: str) -> DataFrame:
    """One question per company, metric and quarter that has a predecessor; the truth is the metric's value in both."""
    rows = evolution(named_metrics(spark, sf_dir)).where("change_type = 'QoQ'")
    text = F.format_string("What was %s of %s in Q%d FY%d, quarter-on-quarter?", "name", "company", "fq", "fy")
    truth = F.format_string("%.2f and %.2f", "value", "prev_value")
    chunk = F.concat_ws("|", F.lit("pdf"), "company", "fy", "fq")
    return rows.select(F.xxhash64("company", "name", "fy", "fq").alias("question_id"), "company", text.alias("question"), truth.alias("truth"), chunk.alias("chunk_id"))


def planned(questions: DataFrame) -> DataFrame:
    """(question_id, company, question) with what its words ask for."""
    q = F.col("question")
    return T.settled(questions.withColumns({**R.route(q), "names": R.metric_names(q), "periods": P.question_periods(q), "budget": R.fact_budget(q), "statement": T.requested_statement(q)}))


def metric_facts(plan: DataFrame, store: DataFrame, chunks: DataFrame) -> DataFrame:
    """(question_id, fact): looked up, guarded, read again from the source where it has the row, and rendered."""
    wanted = plan.select("question_id", "company", F.explode("names").alias("name"), "periods").select("question_id", "company", "name", F.explode("periods").alias("p")).select("question_id", "company", "name", "p.q", "p.fy")
    found = FA.broad_lookup(wanted, store).join(chunks.select(F.col("chunk_id").alias("source_id"), F.col("text").alias("source_text")), "source_id", "left")
    found = T.settled(FA.trusted(found).withColumn("again", GD.current_value(F.col("source_text"), F.col("name"))))
    again = F.col("again")
    doubtful = GD.ambiguous_breakdown(F.col("name"), F.col("source_text"))
    tags = F.concat_ws("; ", F.concat(F.lit("company="), "company"), F.when(F.col("period") != "", F.concat(F.lit("period="), "period")), F.when(doubtful, "confidence=low_possible_subitem_mismatch"), F.when(again.isNotNull(), A.RECOVERED))
    return found.select("question_id", F.format_string("%s = %s %s (%s-%s) [%s]", "name", F.coalesce(again, F.col("value")), "unit", "quarter", "year", tags).alias("fact"))


def chosen_facts(plan: DataFrame, facts: DataFrame) -> DataFrame:
    """(question_id, fact, place): united, resolved by statement type, without doubtful rivals, relevant, within budget, in order."""
    f = FA.prefer_recovered_facts(FA.all_facts(facts)).join(plan.select("question_id", "question", "statement", "is_numeric", "budget"), "question_id")
    kept = FA.relevant_metrics(FA.resolve_statements(f, F.col("statement")), F.when(F.col("is_numeric"), F.col("question"))).withColumn("category", A.category(F.col("fact")))
    picked = FA.select_facts(kept, F.col("is_numeric"), F.col("budget"))
    return picked.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy(*A.display_order(F.col("fact"))))).select("question_id", "fact", "place")


def replies(plan: DataFrame, facts: DataFrame, texts: DataFrame, provider=None) -> DataFrame:
    """(question_id, answer, n_facts): prompts of facts and texts (question_id, text), generated, with all backstops."""
    provider = provider or OfflineProvider()
    lines = facts.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "fact"))), lambda x: F.concat(F.lit("- "), x["fact"])).alias("lines"))
    rows = plan.select("question_id", "question", "names", "periods", "is_numeric").join(lines, "question_id", "left").join(texts, "question_id", "left")
    rows = rows.withColumn("prompt", F.concat_ws("\n", "question", F.lit("Facts:"), F.array_join("lines", "\n"), F.lit("Text:"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n- "), F.lit("\n"))))
    said = ensure_marker(rows.join(generate_column(rows, provider, "question_id", "prompt"), "question_id"), provider, "question_id")
    said = retry_refusals(said, provider, "question_id", ~F.col("is_numeric") & T.is_refusal(F.col("answer")))
    tag = F.when(F.size("periods") >= 1, F.concat(F.lit("("), F.col("periods")[0]["q"], F.lit("-"), F.col("periods")[0]["fy"], F.lit(")")))
    sole = FA.sole_fact(facts, plan.select("question_id", "names", tag.alias("tag"))).select("question_id", F.col("fact").alias("sole"))
    said = said.join(sole, "question_id", "left")
    override = T.is_refusal(F.col("answer")) & F.col("is_numeric") & F.col("sole").isNotNull()
    answer = F.when(override, F.concat(F.lit(A.MARKER + " "), A.direct_answer(F.col("sole")))).otherwise(F.col("answer"))
    answer = A.fix_decimal_shift(A.strip_delta(answer, F.col("question")), F.concat_ws(" ", F.array_join("lines", " "), "text"))
    return said.select("question_id", answer.alias("answer"), F.coalesce(F.size("lines"), F.lit(0)).alias("n_facts"))


def answers(spark, sf_dir: str, provider=None) -> DataFrame:
    """Every question of ``asked`` through the whole path, scored against its truth."""
    questions = asked(spark, sf_dir)
    plan = planned(questions.select("question_id", "company", "question")).persist()  # read by every step below
    facts = chosen_facts(plan, metric_facts(plan, stored(spark, sf_dir), evidence(spark, sf_dir)).persist()).persist()
    none = plan.select("question_id", F.lit("").alias("text"))
    said = replies(plan, facts, none, provider).join(questions.select("question_id", "company", "truth"), "question_id")
    got = N.precision_recall(N.answer_numbers(F.col("answer")), N.number_set(F.col("truth")))
    return said.select("question_id", "company", "answer", "n_facts", *[v.alias(k) for k, v in got.items()])


# ------------------------------------------------------------------ ablation


def retrieval_scores(plan: DataFrame, chunks: DataFrame, structure: DataFrame, provider, embed_text: str = "question") -> DataFrame:
    """(question_id, chunk_id, dense, bm25, structural): every chunk for every question, of which both are few here."""
    q_vec = embed_column(plan, provider, "question_id", embed_text).withColumnRenamed("embedding", "q_vec")
    dense = RT.dense_scores(q_vec, embed_column(chunks, provider, "chunk_id", "text"))
    sparse = RT.normalised(RT.bm25_scores(plan.select("question_id", "question"), chunks), "bm25")
    rows = dense.join(sparse, ["question_id", "chunk_id"], "left")
    seeds = RT.seed_centroid(RT.top_k(rows.withColumn("score", F.round("dense", 9)), 5), structure)
    rows = rows.join(seeds, "question_id", "left").join(structure, "chunk_id", "left")
    return rows.select("question_id", "chunk_id", "dense", "bm25", RT.cosine(F.col("centroid"), F.col("vec")).alias("structural"))


def ablation(spark, sf_dir: str, provider=None) -> DataFrame:
    """(bucket, n, hit, n_facts, f1) per configuration: whether the question's filing is among the first chunks, how many facts
    reached the prompt, and how well the answer's numbers agree."""
    provider = provider or OfflineProvider()
    questions, chunks, store = asked(spark, sf_dir), evidence(spark, sf_dir), stored(spark, sf_dir)
    plan = planned(questions.select("question_id", "company", "question")).persist()
    quarter = F.concat_ws("|", "company", "year", "quarter")
    edges = chunks.select(quarter.alias("src"), F.col("chunk_id").alias("dst")).unionByName(store.select(F.col("source_id").alias("src"), F.col("id").cast("string").alias("dst"))).unionByName(chunks.select(F.col("company").alias("src"), quarter.alias("dst")))
    structure = G.fast_rp(edges).select(F.col("node").alias("chunk_id"), "vec").persist()
    # Hypothetical answers replace the embedded question where it is routed to calls.
    guess = generate_column(plan.where("source_filter = 'audio'"), provider, "question_id", "question").withColumnRenamed("answer", "guess")
    plan_h = plan.join(guess, "question_id", "left").withColumn("embedded", F.coalesce("guess", "question"))
    plain = retrieval_scores(plan, chunks, structure, provider).persist()
    hyde = retrieval_scores(plan_h, chunks, structure, provider, "embedded").persist()
    own = metric_facts(plan, store, chunks).persist()
    before = evolution(named_metrics(spark, sf_dir)).select(
        F.xxhash64("company", "name", "fy", "fq").alias("question_id"), F.format_string("%s = %.2f Crore INR (Q%d-%d) [company=%s; period=previous]", "name", "prev_value", "prev_fq", "prev_fy", "company").alias("fact"))
    plain_facts, temporal_facts = chosen_facts(plan, own).persist(), chosen_facts(plan, own.unionByName(before.join(plan.select("question_id"), "question_id", "left_semi"))).persist()
    place = chunks.select("chunk_id", "kind", "source_type", F.col("text").alias("chunk_text"))
    # All configurations go through retrieval, prompt and scores as one frame, keyed by configuration and question.
    of = lambda name, rows: rows.withColumn("question_id", F.concat_ws("|", F.lit(name), F.col("question_id").cast("string")))
    scored = plans = facts = None
    for name, weight, structural, with_facts, temporal, routing, with_hyde in CONFIGS:
        rows = (hyde if with_hyde else plain).join(place, "chunk_id").join(plan.select("question_id", "source_filter", "is_numeric"), "question_id")
        if routing:
            rows = rows.where(P.in_source(F.col("source_type"), F.col("source_filter")))
        base = RT.rescore(F.col("dense"), F.col("bm25"), F.col("structural")) if structural else RT.blend(F.col("dense"), F.col("bm25"), weight)
        rows = of(name, rows.select("question_id", "chunk_id", "chunk_text", F.round(base * RT.type_boost(F.col("kind"), F.col("is_numeric")), 9).alias("score")))
        own_plan = of(name, plan)
        scored, plans = (rows, own_plan) if scored is None else (scored.unionByName(rows), plans.unionByName(own_plan))
        if with_facts:
            own_facts = of(name, temporal_facts if temporal else plain_facts)
            facts = own_facts if facts is None else facts.unionByName(own_facts)
    top = RT.top_k(scored, TOP_K)
    got = top.groupBy("question_id").agg(F.collect_list("chunk_id").alias("got"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_text"))), lambda x: x["chunk_text"]), "\n").alias("text")).persist()
    said = replies(plans, facts, got.select("question_id", "text"), provider).join(got.select("question_id", "got"), "question_id", "left")
    said = said.withColumns({"config": F.substring_index("question_id", "|", 1), "asked_id": F.substring_index("question_id", "|", -1).cast("long")})
    said = said.join(questions.select(F.col("question_id").alias("asked_id"), "truth", F.col("chunk_id").alias("filing")), "asked_id")
    f1 = N.precision_recall(N.answer_numbers(F.col("answer")), N.number_set(F.col("truth")))["f1"]
    out = said.select("config", M.hit(F.coalesce("got", F.array().cast("array<string>")), F.array("filing")).alias("hit"), "n_facts", f1.alias("f1"))
    means = out.groupBy(F.col("config").alias("bucket")).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("hit", "n_facts", "f1")])
    return means.select("bucket", "n", *[F.round(c, 6).alias(c) for c in ("hit", "n_facts", "f1")])
