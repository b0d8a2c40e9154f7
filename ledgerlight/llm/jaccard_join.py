"""Exact n-gram Jaccard self-join by prefix filters under several global token orders.

Tokens are hashes of w-word shingles. Of two sets with Jaccard similarity t or more, any order of all tokens leaves a
common token among the first n - ceil(t n) + 1 of each; so a candidate must share one under *every* order used, and only
what passes all these filters is verified by counting common tokens.

1.  Equal texts are one class (a map-side combined aggregate); one text of each class goes on.
2.  Blocks of texts send their distinct tokens, packed, to token buckets; these answer with each token's document
    frequency class. The first order is by that class, so rare tokens come first. A text whose rare prefix has no token
    in common with another text links with nothing and is done; most texts end here.
3.  The others are routed: texts that share a prefix token under the first order are tied to the smallest (a star, never
    all pairs of a group), and components of these ties are clusters which no link leaves.
4.  Clusters are verified in chunks of bounded size, pairs of chunks for large ones. There each text looks up partners
    under two more orders, intersects these filters with the sizes' one, and counts common tokens. Texts already in the
    main class of the chunk are not compared among each other, as their link could not change the result.
5.  Components of the verified links.

Nulls: null and blank texts have no tokens and link with nothing. Rows with a null doc_id take part; a component's id is
the smallest non-null doc_id of its rows, or null. Rows sharing a doc_id are separate documents. Repeated rows link.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, block_count, chunks, materialize, mix, shuffle_partitions, unzbytes, utf8, word_hashes, zbytes
from .components import connected_components

_PIECE = 1 << 20
_STEP = 0xA0761D6478BD642F | 1


def shingle_hashes(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted shingle hashes of each text, and n + 1 offsets; a shorter text's words are one shingle."""
    h, bounds = word_hashes(data, offs)
    n = len(bounds) - 1
    many = np.diff(bounds)
    out, at = [], np.zeros(n + 1, np.int64)
    if len(h) >= width:
        s = np.zeros(len(h) - width + 1, U64)
        for i in range(width):
            s = s * U64(_STEP) + h[i : len(h) - width + 1 + i]
        s = mix(s + U64(width))
    for i in range(n):
        if many[i] >= width:
            x = np.sort(s[bounds[i] : bounds[i + 1] - width + 1])
            x = x[np.append(True, x[1:] != x[:-1])]
        elif many[i]:
            x = np.zeros(1, U64)
            for k in range(many[i]):
                x = x * U64(_STEP) + h[bounds[i] + k]
            x = mix(x + U64(many[i]))
        else:
            x = np.zeros(0, U64)
        out.append(x)
        at[i + 1] = at[i] + len(x)
    return (np.concatenate(out) if out else np.zeros(0, U64)), at


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    """n - ceil(percent n / 100) + 1."""
    return n - (percent * n + 99) // 100 + 1


def _prefixes(rank: np.ndarray, at: np.ndarray, percent: int) -> np.ndarray:
    """Mask of the tokens among each set's first ones in the order ``rank``."""
    n = np.diff(at)
    own = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((rank, own))
    mask = np.zeros(len(rank), bool)
    mask[order] = np.arange(len(rank)) - at[own] < prefix_size(n, percent)[own]
    return mask


def link_sets(tokens: np.ndarray, at: np.ndarray, percent: int, orders: int = 2) -> np.ndarray:
    """(i, j) rows whose components are those of all links among the sets, fewer than there are sets."""
    m = len(at) - 1
    sizes = np.diff(at)
    own = np.repeat(np.arange(m), sizes)
    by = np.argsort(tokens, kind="stable")
    value = tokens[by]
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    tid = np.empty(len(value), np.int64)
    tid[by] = np.cumsum(new) - 1
    df = np.bincount(tid)
    rare = np.log2(df[tid]).astype(np.int64)
    filters = []
    for k in range(orders):
        mask = _prefixes(np.argsort(np.lexsort((mix(tokens ^ U64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF)), rare))), at, percent)
        mask &= df[tid] > 1
        t, d = tid[mask], own[mask]
        order = np.argsort(t, kind="stable")
        filters.append((mask, np.searchsorted(t[order], np.arange(len(df) + 1)), d[order]))
    parent = np.arange(m)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    shared = np.bincount(own, np.minimum(df[tid] - 1, 1), minlength=m) / np.maximum(sizes, 1)
    turn = np.lexsort((np.arange(m), -np.round(shared, 3)))
    done, edges = np.zeros(m, bool), []
    seen = np.zeros(len(df), bool)
    main = turn[0] if m else 0
    for i in turn:
        if i != main and root(i) == root(main):
            continue  # all pairs of the main class and another one are met from the other side
        may = None
        for mask, cut, d in filters:
            ts = tid[at[i] : at[i + 1]][mask[at[i] : at[i + 1]]]
            got = np.zeros(m, bool)
            for a, b in zip(cut[ts], cut[ts + 1], strict=True):
                got[d[a:b]] = True
            may = got if may is None else may & got
        may[i] = False
        may &= ~done
        may &= (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
        cand = np.flatnonzero(may)
        done[i] = True
        if not len(cand):
            continue
        seen[tid[at[i] : at[i + 1]]] = True
        many = sizes[cand]
        pick = np.repeat(at[cand], many) + (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
        common = np.add.reduceat(seen[tid[pick]].astype(np.int64), np.cumsum(many) - many)
        seen[tid[at[i] : at[i + 1]]] = False
        for j in cand[100 * common >= percent * (sizes[i] + many - common)]:
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((i, j))
    return np.array(edges, np.int64).reshape(-1, 2)


_ROUTE = "bucket long, blk long, body binary, more binary"


def _route(rows: list[tuple]) -> pa.Table:
    kinds = (("bucket", pa.int64()), ("blk", pa.int64()), ("body", pa.binary()), ("more", pa.binary()))
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(kinds)})


def _sets(t: pa.Table, width: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Classes of a block in their hash's order, with their token sets."""
    t = t.sort_by("h")
    names = t.column("h").to_pylist()
    keep = [i for i, h in enumerate(names) if not i or h != names[i - 1]]
    t = t.take(pa.array(keep, pa.int64()))
    data, offs = utf8(t.column("text"))
    got = [shingle_hashes(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], width) for a, b in chunks(offs, _PIECE)]
    tokens = np.concatenate([x for x, _ in got]) if got else np.zeros(0, U64)
    sizes = np.concatenate([np.diff(x) for _, x in got]) if got else np.zeros(0, np.int64)
    return [names[i] for i in keep], tokens, np.append(0, np.cumsum(sizes))


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = 5, chunk_tokens: int = 1_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row; links are Jaccard similarities of ``percent`` per cent or more."""
    rows = docs.select("doc_id", text_hash(F.col("text")).alias("h"))
    named = text_classes(docs, percent, width, chunk_tokens)
    smallest = named.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    named = named.join(smallest, "c").select("h", F.col("n").alias("n_shingles"), "component_id")
    return rows.join(named, "h").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def text_classes(docs: DataFrame, percent: int = 75, width: int = 5, chunk_tokens: int = 1_000_000) -> DataFrame:
    """(h, doc_id, n, c): each distinct text's hash, its smallest doc_id, its number of shingles and its component."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    rows = docs.select("doc_id", text_hash(F.col("text")).alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    firsts = materialize(rows.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.max(F.octet_length("text")).alias("n_bytes")), "reps")
    # Blocks and buckets, which workers hold whole, grow in number with the bytes.
    blocks = block_count(spark, firsts.agg(F.sum("n_bytes")).first()[0] or 0)
    bits = max(3, int(np.ceil(np.log2(max(blocks // 4, 2)))))
    spread = lambda df: df.withColumn("blk", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), "h"), F.lit(blocks)))
    reps = spread(firsts.select("h", "doc_id"))

    def chosen(t: pa.Table, picks: pa.Table) -> pa.Table:
        ok = set(zip(picks.column("h").to_pylist(), picks.column("doc_id").to_pylist(), strict=True))
        return t.filter(pa.array([x in ok for x in zip(t.column("h").to_pylist(), t.column("doc_id").to_pylist(), strict=True)], pa.bool_()))

    def distinct(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.sort(tokens)
        new = np.ones(len(x), bool)
        new[1:] = x[1:] != x[:-1]
        at = np.flatnonzero(new)
        own = x[at]
        cut = np.searchsorted(own >> U64(64 - bits), np.arange((1 << bits) + 1).astype(U64))
        return own, np.diff(np.append(at, len(x))), cut

    def send(t: pa.Table, picks: pa.Table) -> pa.Table:
        if not t.num_rows or not picks.num_rows:
            return _route([])
        _, tokens, _ = _sets(chosen(t, picks), width)
        own, count, cut = distinct(tokens)
        short = ((own << U64(bits)) >> U64(32)).astype(np.uint32)
        blk = t.column("blk")[0].as_py()
        return _route([(b, blk, short[cut[b] : cut[b + 1]].tobytes(), zbytes(np.minimum(count[cut[b] : cut[b + 1]], 1 << 30).astype(np.uint32))) for b in range(1 << bits) if cut[b] < cut[b + 1]])

    def count(t: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_buffer(), np.uint32) for x in t.column("body")]
        key = np.concatenate(parts)
        many = np.concatenate([unzbytes(x.as_buffer(), np.uint32) for x in t.column("more")])
        order = np.argsort(key)
        new = np.ones(len(key), bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        group = np.cumsum(new) - 1
        total = np.bincount(group, many[order])
        level = np.empty(len(key), np.uint8)
        level[order] = np.log2(total).astype(np.uint8)[group]
        cut = np.cumsum([0, *map(len, parts)])
        bucket = t.column("bucket")[0].as_py()
        return _route([(bucket, blk, zbytes(level[cut[i] : cut[i + 1]]), None) for i, blk in enumerate(t.column("blk").to_pylist())])

    def survivors(t: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {"h": [], "nid": [], "n": [], "prefix": [], "tokens": []}
        picks = answers.filter(pa.array([x is not None for x in answers.column("h").to_pylist()], pa.bool_()))
        if t.num_rows and picks.num_rows:
            names, tokens, at = _sets(chosen(t, picks), width)
            own, _, cut = distinct(tokens)
            level = np.zeros(len(own), np.uint8)
            for b, body in zip(answers.column("bucket").to_pylist(), answers.column("body"), strict=True):
                if b is not None:
                    level[cut[b] : cut[b + 1]] = unzbytes(body.as_buffer(), np.uint8)
            blk = t.column("blk")[0].as_py()
            lv = level[np.searchsorted(own, tokens)]
            for i, name in enumerate(names):
                x, y = tokens[at[i] : at[i + 1]], lv[at[i] : at[i + 1]]
                size = len(x)
                prefix = np.zeros(0, np.int64)
                if size:
                    first = int(prefix_size(np.array(size), percent))
                    if (y == 0).sum() < first:
                        order = np.lexsort((x, y))[:first]
                        prefix = x[order][y[order] > 0].view(np.int64)
                out["h"].append(name)
                out["nid"].append(blk << 32 | i)
                out["n"].append(size)
                out["prefix"].append(prefix)
                out["tokens"].append(x.tobytes() if len(prefix) else None)
        return pa.table({k: pa.array(v, kind) for (k, v), kind in zip(out.items(), (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()), strict=True)})

    by_blk = spread(rows).groupBy("blk")
    sent = by_blk.cogroup(reps.groupBy("blk")).applyInArrow(send, _ROUTE)
    levels = sent.groupBy("bucket").applyInArrow(count, _ROUTE)
    both = levels.select("blk", "bucket", "body", F.lit(None).cast("string").alias("h"), F.lit(None).cast("long").alias("doc_id")).unionByName(
        reps.select("blk", F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("body"), "h", F.col("doc_id").cast("long").alias("doc_id"))
    )
    kept = materialize(by_blk.cogroup(both.groupBy("blk")).applyInArrow(survivors, "h string, nid long, n long, prefix array<long>, tokens binary"), "sets")

    # Ties of the first order: each text with the smallest one of each prefix token.
    posts = kept.select("nid", F.explode("prefix").alias("token"))
    least = posts.groupBy("token").agg(F.min("nid").alias("v"), F.count("*").alias("many")).where("many > 1").drop("many")
    ties = posts.join(least, "token").select(F.col("nid").alias("u"), "v").where("u <> v").distinct()
    clusters = materialize(connected_components(ties), "clusters")

    sets = kept.where("tokens is not null").select("nid", "n", "tokens")
    weights = kept.select("nid", "n").join(clusters, F.col("nid") == F.col("node")).groupBy("component").agg(F.sum("n").alias("w"))
    weights = weights.select("component", F.ceil(F.col("w") / F.lit(float(chunk_tokens))).cast("int").alias("parts"))
    placed = sets.join(clusters, F.col("nid") == F.col("node")).join(weights, "component").withColumn("part", F.pmod(F.xxhash64("nid"), F.col("parts")).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("component", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "nid", "tokens")
    # Many small clusters share a task; a chunk pair of a large one is a group of its own.
    pairs = pairs.withColumn("lot", F.pmod(F.xxhash64("component", "a", "b"), F.lit(blocks)))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; groups are closed as the next begins."""

        def close(rows: list) -> pa.RecordBatch:
            ids = np.array([r[0] for r in rows], np.int64)
            sets = [np.frombuffer(r[1], U64) for r in rows]
            edges = link_sets(np.concatenate(sets), np.append(0, np.cumsum([len(x) for x in sets])), percent)
            return pa.RecordBatch.from_arrays([pa.array(ids[edges[:, 0]]), pa.array(ids[edges[:, 1]])], ["u", "v"])

        now, rows = None, []
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(3)]
            ids, bodies = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for c, a, b, i, body in zip(*cols, ids, bodies, strict=True):
                if (c, a, b) != now:
                    if len(rows) > 1:
                        yield close(rows)
                    now, rows = (c, a, b), []
                rows.append((i, body))
        if len(rows) > 1:
            yield close(rows)

    links = pairs.repartition(n, "lot").sortWithinPartitions("component", "a", "b", "nid").select("component", "a", "b", "nid", "tokens").mapInArrow(verify, "u long, v long")
    comps = connected_components(links)
    classes = kept.join(comps, F.col("nid") == F.col("node"), "left").select("h", "n", F.coalesce("component", "nid").alias("c"))
    return materialize(classes.join(reps.select("h", "doc_id"), "h"), "classes")


def text_hash(text):
    return F.md5(F.encode(F.coalesce(text, F.lit("")), "utf-8"))


def one_of_each(docs: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """One row of each component, with all its columns, and every row without words.

    The row that stays is that of the smallest doc_id (null last), then text hash, then hash of the other columns; of rows
    equal in all columns, any one. Rows are told apart by doc_id and text, so different texts that share a doc_id are
    judged apart.
    """
    named = text_classes(docs.select("doc_id", "text"), percent, width)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.xxhash64(F.to_json(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(others)]))) if others else F.lit(0).cast("long")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("did"), text_hash(F.col("text")).alias("h"), rest.alias("rest"))
    first = named.where("n > 0").groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "h")).alias("f")).select("f.doc_id", "f.h")
    ids = rows.groupBy("did", "h", "rest").agg(F.count("*").alias("many"))
    ids = ids.join(first, (ids["h"] == first["h"]) & ids["did"].eqNullSafe(first["doc_id"])).groupBy(ids["did"], ids["h"]).agg(F.min(F.struct("rest", "many")).alias("m"))
    blank = named.where("n = 0").select(F.lit(None).cast("long").alias("did"), "h", F.lit(None).cast("long").alias("rest"), F.lit(0).cast("long").alias("many"))
    keep = materialize(ids.select("did", "h", "m.rest", "m.many").unionByName(blank), "keep").select(F.col("did").alias("d2"), F.col("h").alias("h2"), F.col("rest").alias("r2"), "many")
    same = (F.col("h") == F.col("h2")) & ((F.col("many") == 0) | (F.col("did").eqNullSafe(F.col("d2")) & (F.col("rest") == F.col("r2"))))
    kept = rows.join(keep, same)
    # Rows equal in all columns are rare; only these are shuffled once more, combined map-side.
    one = kept.where("many < 2").select("row")
    if keep.where("many > 1").take(1):
        one = one.union(kept.where("many > 1").dropDuplicates(["did", "h", "rest"]).select("row"))
    return one.select("row.*")


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 75, 5)
