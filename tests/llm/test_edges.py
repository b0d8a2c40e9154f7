"""Long texts, empty tables and nulls through every operator and stage; brute force of sharding and the license scan."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.llm import common
from ledgerlight.llm import decontamination as D
from ledgerlight.llm import jaccard_join as J
from ledgerlight.llm import license_scan as L
from ledgerlight.llm import quality_rules as Q
from ledgerlight.llm import sharding as S
from ledgerlight.llm import substring_dedup as U
from ledgerlight.llm import token_files as K

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_sharding_by_brute_force(spark):
    rng = np.random.default_rng(2)
    docs = spark.createDataFrame([(int(i) if i % 7 else None, "x" * int(n)) for i, n in enumerate(rng.integers(0, 400, 300))], "doc_id long, text string").coalesce(1)
    for limit in (150, 2_000, 1 << 20):
        rows = S.hashed(docs).collect()
        total, many = collections.Counter(), collections.Counter()
        for r in rows:
            for d in range(129):
                total[r.bits[:d]] += r.n_bytes
                many[r.bits[:d]] += 1
        fits = lambda p: total[p] <= limit or many[p] == 1  # noqa: B023, E731
        want = sorted((r.n_bytes, next(r.bits[:d] for d in range(129) if fits(r.bits[:d]))) for r in rows)
        assert sorted((r.n_bytes, r.shard) for r in S.shards(docs, limit, 5).collect()) == want


def test_licenses_by_brute_force(spark):
    rng = np.random.default_rng(9)
    vocab = ["cc", "by", "CC", "general", "public", "License", "all", "rights", "reserved", "mit", "released", "under", "the", "é", "x1"]
    texts = ["".join(w + rng.choice([" ", ", ", "\n", " -- "]) for w in rng.choice(vocab, rng.integers(0, 60))) for _ in range(80)]
    notice = "released under the mit license"
    plain = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    got = {r.doc_id: r for r in L.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        w = plain(t)
        places = [(k, label) for p, label in L.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(places)) and r.base_labels == ",".join(sorted({x for _, x in places}))
        assert (r.first_word, r.last_word) == ((min(k for k, _ in places), max(k for k, _ in places)) if places else (None, None))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
        if f" {notice} " in f" {' '.join(w)} ":
            assert "mit" in r.labels.split(",")


def test_very_long_texts(spark):
    rng = np.random.default_rng(4)
    vocab = [f"word{i}" for i in range(20_000)]
    long = " ".join(rng.choice(vocab, 160_000))
    assert len(long) > 1_200_000
    item = " ".join(rng.choice(vocab, 30))
    near = long[:700_000] + " " + item + " " + long[700_000:]
    docs = spark.createDataFrame([(1, long), (2, near), (3, "y" * 1_300_000), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in J.near_duplicates(docs).collect()}
    assert [got[i].component_id for i in (1, 2, 3, 4)] == [1, 1, 3, 4]
    runs = {r.doc_id: r for r in U.repeated_runs(docs).collect()}
    assert runs[1].n_removed == 0 and len(near) - len(item) - 4 <= runs[2].n_removed <= len(near) and runs[3].n_removed == 1_300_000 - 1
    kept = {r.doc_id: r for r in Q.judge(docs, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")).collect()}
    assert kept[1].n_words == 160_000 and kept[3].n_words == 1 and kept[4].n_words == 0
    assert {r.doc_id for r in D.contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()} == {2}
    assert {r.doc_id: r.n_words for r in L.scan_licenses(docs).collect()} == {1: 160_000, 2: 160_031, 3: 1, 4: 0}  # the item parts a word
    tokens = {r.doc_id: r.n_tokens for r in K.token_digests(docs).collect()}
    assert tokens[4] == 1 and tokens[2] > tokens[1] > 160_000


@pytest.mark.parametrize("empty", [True, False])
def test_pipeline_on_empty_and_null_rows(spark, tmp_path, empty):
    import corpus_pipeline as P

    sf = str(tmp_path)
    spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").limit(0 if empty else 2).write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "a benchmark item of at least eight words in all"), (2, None)], "item_id long, text string").limit(0 if empty else 2).write.parquet(f"{sf}/benchmark.parquet")
    text = " ".join(f"t{i}" for i in range(80))
    rows = [(None, None, None, None, None), (None, text, None, None, None), (None, text, None, None, None), (5, None, "en", "s", 0), (5, text + " more", "en", "s", 1), (6, "", "en", None, 0)]
    docs = spark.createDataFrame(rows, DOCS).limit(0 if empty else 99)
    for name, stage in P.STAGES:
        docs = common.materialize(stage(spark, docs, sf), name.replace(" ", "-"))
        if name != P.STAGES[-1][0]:
            assert docs.columns == [f.split()[0] for f in DOCS.split(", ")]
    assert docs.count() == 0 if empty else docs.count() >= 1
    assert docs.where("n_tokens < 2").count() == 0


def test_shared_folder_is_never_made_up_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    session = type("S", (), {"conf": Conf(), "sparkContext": Context()})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(session)
