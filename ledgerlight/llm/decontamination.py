"""Benchmark decontamination by latent semantic retrieval.

1.  Benchmark items are cut into passages. Document frequencies of their words are counted over the whole corpus, and the
    passages' TF-IDF matrix gets a randomised SVD: its products with the sketch run distributed over the passages, only
    (vocabulary x rank) sums reach the driver, which are bounded by a block of items.
2.  Every window of every document is projected into the latent space (running sums of word vectors make any window a
    difference of two rows) and compared with all passages: the cosine within the space, and the cosine against the
    window's full TF-IDF length, which words outside the benchmark's vocabulary add to.
3.  A candidate region is verified: the longest common subsequence of words, as a share of the passage, and the *answer*,
    the passage's rarest words, as the share found in the region. Near-verbatim copies pass by the first alone,
    paraphrases need both.

Items are searched in blocks of at most ``block_items``, several blocks in one reading of the corpus, so what is sent to the
workers has a fixed bound at any benchmark size. Documents are not shuffled; whole texts are searched, and no candidate is
capped. Items of fewer than ``least_words`` words have no latent place; they are found where all their words stand in a row.

Nulls: null or blank texts and items match nothing; an item of fewer than ``SHORT_WORDS`` words is too short to tell and is
not searched. A null doc_id or item_id is carried. Repeated rows are found alike, and rows are cleaned by doc_id and text, so
different texts that share a doc_id are judged apart. Of equal common subsequences of one document and item, the first is
reported. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, chunks, utf8, word_hashes

RANK, WINDOW, STRIDE = 64, 24, 8
LATENT, FULL = 0.8, 0.25
#: Shares of a passage: near-verbatim; paraphrase, with its answer words.
VERBATIM, PARAPHRASE, ANSWER = 0.75, 0.55, 0.75
BLOCK_ITEMS, BLOCKS_A_PASS, PASSAGE_WORDS, LEAST_WORDS, SHORT_WORDS = 1_024, 8, 96, 8, 4
#: Words in more than this share of documents carry no weight, save in hot passages: those whose words weigh so little that
#: ``FULL`` would miss them in a window of rare words. These are searched once more, where a word has ``FLOOR`` of a rare word's
#: weight at least.
COMMON, FLOOR = 0.2, 0.5
HOT = (FULL**2 * (WINDOW - LEAST_WORDS) / (LEAST_WORDS * (1 - FULL**2))) ** 0.5
_PIECE = 1 << 20


class Vocabulary:
    """Sorted word hashes; a word's number is its place."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.coarse = np.zeros(1 << 16, bool)
        self.coarse[(hashes & U64(0xFFFF)).astype(np.int64)] = True

    def __len__(self) -> int:
        return len(self.hashes)

    def codes(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of the vocabulary's words among hashes."""
        may = np.flatnonzero(self.coarse[(h & U64(0xFFFF)).astype(np.int64)])
        code = np.minimum(np.searchsorted(self.hashes, h[may]), len(self.hashes) - 1)
        ok = self.hashes[code] == h[may]
        return may[ok], code[ok]


class Passages:
    """Passages of a block of items: words as numbers of the block's vocabulary; ``short`` has whole items too short for one."""

    def __init__(self, ids: list, texts: list[str], passage_words: int, least_words: int):
        data, offs = utf8(pa.array([t or "" for t in texts], pa.string()))
        h, at = word_hashes(data, offs)
        self.vocab = Vocabulary(np.unique(h))
        code = np.searchsorted(self.vocab.hashes, h)
        self.item, self.words = [], []
        self.short: dict[int, list[tuple[int, int]]] = {}
        for k, item in enumerate(ids):
            own = code[at[k] : at[k + 1]]
            if SHORT_WORDS <= len(own) < least_words:
                self.short.setdefault(len(own), []).append((int(runs(h[at[k] : at[k + 1]], len(own))[0]), item))
            for a in range(0, max(len(own) - passage_words // 2, 1), passage_words // 2):
                part = own[a : a + passage_words]
                if len(part) >= least_words:
                    self.item.append(item)
                    self.words.append(part)

    def part(self, numbers: list[int]) -> tuple[Passages, np.ndarray]:
        """Some of the passages with the vocabulary of these alone, and that vocabulary's numbers in the whole one."""
        out = object.__new__(Passages)
        old = np.unique(np.concatenate([self.words[i] for i in numbers]))
        out.vocab, out.short = Vocabulary(self.vocab.hashes[old]), {}
        out.item, out.words = [self.item[i] for i in numbers], [np.searchsorted(old, self.words[i]) for i in numbers]
        return out, old


def runs(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words."""
    out = np.zeros(max(len(h) - width + 1, 0), U64)
    for i in range(width):
        out = out * U64(0xA0761D6478BD642F) + h[i : len(h) - width + 1 + i]
    return out


def document_frequencies(docs: DataFrame, vocab: Vocabulary) -> tuple[np.ndarray, int]:
    """In how many documents each word of the vocabulary stands, and the number of documents."""
    size = len(vocab)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(size, np.int64), 0
        for batch in batches:
            data, offs = utf8(batch.column(0))
            rows += batch.num_rows
            for a, b in chunks(offs, _PIECE):
                h, at = word_hashes(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                place, code = vocab.codes(h)
                own = np.searchsorted(at, place, "right") - 1
                df += np.bincount(np.unique(own * size + code) % size, minlength=size)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], rows))], ["w", "n"])

    got = dict(docs.select("text").mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n")).collect())  # a row per word of the blocks at most
    out = np.zeros(size, np.int64)
    for w, n in got.items():
        if w >= 0:
            out[w] = n
    return out, got.get(-1, 0)


def randomized_svd(spark, passages: Passages, idf: np.ndarray, rank: int = RANK, rounds: int = 3, seed: int = 7) -> np.ndarray:
    """Right singular vectors of the passages' TF-IDF rows, (vocabulary, rank), by subspace iteration on a Gaussian sketch.

    The rows are distributed; each part sends its share of X'(X Q) in blocks of the vocabulary, which are summed in the
    order of the parts, so that reruns agree.
    """
    size = len(idf)
    rank = min(rank, len(passages.words), size)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, rank)))[0]
    parts = max(1, min(8, len(passages.words) // 64))
    rows = spark.range(len(passages.words), numPartitions=parts).withColumn("part", F.spark_partition_id())
    words = passages.words
    step = 4_096

    def share(q: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, part = np.zeros(q.shape), 0
            for batch in batches:
                for i, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    part = p
                    code, tf = np.unique(words[i], return_counts=True)
                    x = tf * idf[code]
                    x = x / max(np.sqrt((x * x).sum()), 1e-12)
                    total[code] += x[:, None] * (x @ q[code])[None, :]
            cut = list(range(0, size, step))
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.int64()), pa.array([part] * len(cut), pa.int64()), pa.array([total[a : a + step].tobytes() for a in cut], pa.binary())], ["at", "part", "body"])

        return run

    def add(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        bodies = [np.frombuffer(x.as_buffer(), np.float64) for x in t.column("body")]
        return pa.table({"at": t.column("at").slice(0, 1), "body": pa.array([np.sum(bodies, axis=0).tobytes()], pa.binary())})

    for _ in range(rounds):
        sums = rows.mapInArrow(share(q), "at long, part long, body binary").groupBy("at").applyInArrow(add, "at long, body binary").collect()
        y = np.concatenate([np.frombuffer(r["body"], np.float64) for r in sorted(sums, key=lambda r: r["at"])]).reshape(size, rank)
        q = np.linalg.qr(y)[0]
    return q


def lcs_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, with the rows of the table as bits of one number."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        m = masks.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


_FIELDS = "doc_id long, item_id long, kind string, cosine double, lcs double, answer double, first_word long, last_word long"


def contaminated(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS, blocks_a_pass: int = BLOCKS_A_PASS) -> DataFrame:
    """(doc_id, item_id, kind, cosine, lcs, answer, first_word, last_word): documents that hold a passage of an item."""
    return _found(docs.select("doc_id", "text", F.lit(None).cast("string").alias("h")), benchmark, block_items, blocks_a_pass).drop("h")


def _found(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS, blocks_a_pass: int = BLOCKS_A_PASS) -> DataFrame:
    """contaminated() with each document's ``h``."""
    spark = docs.sparkSession
    items = benchmark.where("text is not null").select("item_id", "text").distinct()
    lots = max(1, -(-items.count() // (block_items * blocks_a_pass // 2)))
    out = spark.createDataFrame([], _FIELDS + ", h string")
    for k in range(lots):  # queries in blocks; a lot's blocks are searched in one reading of the corpus
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(lots)) == k).orderBy("item_id", "text").collect()
        blocks = [Passages([r[0] for r in own[a : a + block_items]], [r[1] for r in own[a : a + block_items]], PASSAGE_WORDS, LEAST_WORDS) for a in range(0, len(own), block_items)]
        for a in range(0, len(blocks), blocks_a_pass):
            part = [p for p in blocks[a : a + blocks_a_pass] if p.words or p.short]
            out = out.union(_search(spark, docs, part)) if part else out
    return out


def _search(spark, docs: DataFrame, blocks: list[Passages]) -> DataFrame:
    vocab = Vocabulary(np.unique(np.concatenate([p.vocab.hashes for p in blocks])))
    df, n_docs = document_frequencies(docs, vocab)
    rare = max(float(np.log((n_docs + 1) / 2)), 1.0)
    spaces, short = [], {}
    for passages in blocks:
        for size, own in passages.short.items():
            short.setdefault(size, []).extend(own)
        if not passages.words:
            continue
        own = df[np.searchsorted(vocab.hashes, passages.vocab.hashes)]
        true = np.log((n_docs + 1) / (own + 1))
        cut = np.where(own > np.maximum(COMMON * n_docs, 2), 0, true)
        hot = [bool(np.sqrt((cut[w] ** 2).mean()) < HOT * rare) for w in passages.words]
        if cut.any():
            spaces.append(_space(spark, passages, cut))
        if any(hot):  # besides, not instead: what the first space finds stays found
            some, old = passages.part(np.flatnonzero(hot).tolist())
            spaces.append(_space(spark, some, np.maximum(true, FLOOR * rare)[old]))
    exact = {size: (np.array([x for x, _ in sorted(own, key=str)], U64), [i for _, i in sorted(own, key=str)]) for size, own in short.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            data, offs = utf8(batch.column(1))
            rows = []
            for a, b in chunks(offs, _PIECE):
                h, at = word_hashes(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                best: dict[tuple, tuple] = {}
                for space in spaces:
                    _piece(h, at, rare, *space, best)
                for size, (hashes, items) in exact.items():
                    _exact(h, at, size, hashes, items, best)
                rows += [(ids[a + d], *rest, keys[a + d]) for d, *rest in best.values()]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.string())
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [*[f.split()[0] for f in _FIELDS.split(", ")], "h"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text", "h").mapInArrow(run, _FIELDS + ", h string")


def _exact(h: np.ndarray, at: np.ndarray, size: int, hashes: np.ndarray, items: list, rows: dict) -> None:
    """The first place of each item of ``size`` words that stands in a document word by word."""
    every = runs(h, size)
    where = np.flatnonzero(np.isin(every, hashes))
    doc = np.searchsorted(at, where, "right") - 1
    for s, d in zip(where.tolist(), doc.tolist(), strict=True):
        if s + size <= at[d + 1]:
            for i in np.flatnonzero(hashes == every[s]).tolist():
                rows.setdefault((d, items[i]), (d, items[i], "verbatim", 1.0, 1.0, 1.0, s - int(at[d]), s + size - int(at[d])))


def _space(spark, passages: Passages, idf: np.ndarray) -> tuple:
    """Passages, word weights, word vectors, the passages' own vectors and their answer words."""
    vectors = (randomized_svd(spark, passages, idf) * idf[:, None]).astype(np.float32)
    query = np.stack([vectors[w].sum(0) for w in passages.words])
    query /= np.maximum(np.linalg.norm(query, axis=1, keepdims=True), 1e-9)
    answers = []
    for w in passages.words:
        u = np.unique(w)
        answers.append(u[np.lexsort((u, -idf[u]))][: max(3, len(u) // 6)])
    return passages, idf, vectors, query, answers


def _piece(h: np.ndarray, at: np.ndarray, rare: float, passages: Passages, idf: np.ndarray, vectors: np.ndarray, query: np.ndarray, answers: list, rows: dict) -> None:
    """The best row of each (document, item) among the words ``h`` of the texts at ``at``, into ``rows``."""
    place, code = passages.vocab.codes(h)
    weigh = idf[code] > 0
    key, kcode = place[weigh], code[weigh]
    if not len(key):
        return
    # Windows start at every STRIDE-th word of a text; those without a weighty word of the vocabulary match nothing.
    first = np.searchsorted(at, key, "right") - 1
    inside = key - at[first]
    starts = []
    for back in range(0, WINDOW, STRIDE):
        s = inside // STRIDE * STRIDE - back
        starts.append(np.where(s >= 0, at[first] + s, -1))
    begin = np.unique(np.concatenate(starts))
    begin = begin[begin >= 0]
    doc = np.searchsorted(at, begin, "right") - 1
    end = np.minimum(begin + WINDOW, at[doc + 1])
    sums = np.zeros((len(key) + 1, vectors.shape[1]), np.float32)
    np.cumsum(vectors[kcode], axis=0, out=sums[1:])
    weight = np.full(len(h), rare * rare)
    weight[place] = idf[code] ** 2
    norms = np.append(0, np.cumsum(weight))
    out: dict[tuple[int, int], list] = {}
    for a in range(0, len(begin), 20_000):
        s, e = begin[a : a + 20_000], end[a : a + 20_000]
        z = sums[np.searchsorted(key, e)] - sums[np.searchsorted(key, s)]
        length = np.linalg.norm(z, axis=1)
        full = np.sqrt(np.maximum(norms[e] - norms[s], 1e-12))
        good = np.flatnonzero(length >= FULL * full)  # the full cosine cannot be larger than this ratio
        if not len(good):
            continue
        dots = z[good] @ query.T
        w, p = np.nonzero((dots >= LATENT * length[good, None]) & (dots >= FULL * full[good, None]))
        for i, j, cos in zip(good[w].tolist(), p.tolist(), (dots[w, p] / length[good[w]]).tolist(), strict=True):
            out.setdefault((int(doc[a + i]), j), []).append((int(s[i]), int(e[i]), cos))
    for (d, j), spans in out.items():
        words, size = passages.words[j], len(passages.words[j])
        lo, hi, best = None, None, 0.0
        regions = []
        for s, e, cos in sorted(spans):
            if lo is not None and s <= hi + size:
                hi, best = max(hi, e), max(best, cos)
            else:
                if lo is not None:
                    regions.append((lo, hi, best))
                lo, hi, best = s, e, cos
        regions.append((lo, hi, best))
        for lo, hi, cos in regions:
            # A region is read in overlapping stretches, so that words from far apart are not taken together.
            lo, hi = max(lo - size, int(at[d])), min(hi + size, int(at[d + 1]))
            for s in range(lo, max(hi - size, lo + 1), max(size // 2, 1)):
                e = min(s + 2 * size, hi)
                x, y = np.searchsorted(place, (s, e))
                near = code[x:y]
                share = lcs_length(words, near) / size
                if share < PARAPHRASE:
                    continue
                answer = float(np.isin(answers[j], near).mean())
                if share >= VERBATIM or answer >= ANSWER:
                    k = (d, passages.item[j])
                    row = (d, passages.item[j], "verbatim" if share >= VERBATIM else "paraphrase", cos, share, answer, s - int(at[d]), e - int(at[d]))
                    if k not in rows or row[4] > rows[k][4]:
                        rows[k] = row


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage; a row is known by its doc_id and text, either of which may be null."""
    h = F.md5(F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("did"), h.alias("h"))
    gone = _found(docs.select("doc_id", "text", h.alias("h")), benchmark).select(F.col("doc_id").alias("d2"), F.col("h").alias("h2")).distinct()
    return rows.join(gone, (rows["h"] == gone["h2"]) & rows["did"].eqNullSafe(gone["d2"]), "left_anti").select("row.*")


def op10_latent_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
