"""Exact-substring removal by longest-previous-factor arrays over a distributed, sparse suffix order.

A byte goes if some ``length``-byte string over it also starts earlier: in a document of smaller doc_id, or earlier in
the same one. Suffix sorting every byte of a corpus would shuffle many times its size, so only suffixes that can match
are sorted:

1.  Every ``length``-byte window names one *anchor*: its k-gram of smallest hash. Equal windows name equal anchors at
    equal offsets, so all windows of an anchor lie in its *context*, the bytes around it.
2.  Blocks of documents send each distinct context once (anchor, hash of the context, first place). Equal contexts are
    one suffix: the first place stays, the others are later copies. Anchors with one context only match nothing.
3.  Different contexts around the same anchor (edges of shared passages, edits in near copies) meet in suffix order:
    ranks by prefix doubling, common prefixes of neighbours, previous and next smaller places, and from these the
    longest previous factor of each place. Where it reaches ``length``, the string starts earlier.
4.  The covered runs go back to the documents' blocks.

Anchors that hold more than a share of all contexts (a heavy-hitter list, of proven size) are not used: each of their
windows is a context of its own, so no anchor gathers a large part of the corpus in one task.

Nulls: a null text is empty, a null doc_id sorts last. Rows that share a doc_id are ordered by their text's hash, so one
of several equal rows stays. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, chunks, mix, powers, shuffle_partitions, table, unzbytes, utf8, zbytes

GRAM = 32
_FULL = U64(0xFFFFFFFFFFFFFFFF)
_LAST = np.iinfo(np.int64).max
_BYTE, _BYTE2 = table(21), table(22)
_BASE = 0xD6E8FEB86659FD93 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POW = powers(_BASE, 1 << 16)
_INV = powers(_INVERSE, 1 << 16)
_PIECE = 1 << 19


# ---------------------------------------------------------------- suffix order in memory


def suffix_ranks(text: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """Ranks of all suffixes by their first 8, 16, ... and ``depth`` bytes, by prefix doubling; past the end counts as 0."""
    n = len(text)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = text
    key = np.zeros(n, U64)
    for i in range(8):
        key = (key << U64(8)) | padded[i : i + n].astype(U64)
    keep = min(8, depth)
    out = [(k, key >> U64(8 * (8 - k))) for k in (1, 2, 4) if k < depth]  # equal where the first k bytes are
    if depth < 8:
        key >>= U64(8 * (8 - depth))
    while True:
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        out.append((keep, rank))
        if keep >= depth:
            return out
        step = min(keep, depth - keep)
        after = np.zeros(n, np.int64)
        after[: max(n - step, 0)] = rank[step:] + 1
        key = rank.astype(U64) * U64(n + 1) + after.astype(U64)
        keep += step


def neighbour_lcp(order: np.ndarray, ranks: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Common prefix, up to the ranks' depth, of each suffix with the one before it in ``order``."""
    n = len(order)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    depth, last = ranks[-1]
    same = last[order[1:]] == last[order[:-1]]
    out[1:][same] = depth
    todo = np.flatnonzero(~same) + 1
    a, b = order[todo - 1].copy(), order[todo].copy()
    size = len(last)
    for keep, rank in reversed(ranks[:-1]):
        inside = (a < size) & (b < size)
        ok = np.zeros(len(a), bool)
        ok[inside] = rank[a[inside]] == rank[b[inside]]
        out[todo[ok]] += keep
        a[ok] += keep
        b[ok] += keep
    return np.minimum(out, depth)


def longest_previous(place: np.ndarray, lcp: np.ndarray, least: int = 1) -> np.ndarray:
    """Longest previous factor of each suffix: the larger common prefix with the previous and the next smaller place.

    ``place`` is in suffix order, ``lcp`` that with the entry before. Pointers jump over entries known to be no smaller,
    all at once; a chain ends where its common prefix falls below ``least``.
    """

    def side(place: np.ndarray, lcp: np.ndarray) -> np.ndarray:
        to, common = np.arange(len(place)) - 1, lcp.copy()
        live = np.flatnonzero((to >= 0) & (common >= least))
        live = live[place[to[live]] >= place[live]]
        while len(live):
            at = to[live]
            common[live] = np.minimum(common[live], common[at])
            to[live] = to[at]
            dead = (to[live] < 0) | (common[live] < least)
            common[live[dead]] = 0
            live = live[~dead]
            live = live[place[to[live]] >= place[live]]
        return common

    if not len(place):
        return np.zeros(0, np.int64)
    back = np.concatenate([[0], lcp[:0:-1]]) if len(lcp) > 1 else np.zeros(1, np.int64)
    first = lcp.copy()
    first[0] = 0
    return np.maximum(side(place, first), side(place[::-1], back.astype(np.int64))[::-1])


# ---------------------------------------------------------------- anchors


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = f(x[: len(x) - have], x[have:])
        have *= 2
    return f(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def anchors(data: np.ndarray, offs: np.ndarray, length: int, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, context hash, row, start, end, anchor) of all contexts in the texts; ``hot`` anchors give one for each window."""
    n, w = len(data), length - GRAM + 1
    none = tuple(np.zeros(0, k) for k in (U64, U64, np.int64, np.int64, np.int64, np.int64))
    if n < length:
        return none
    h = _BYTE[data]
    have = 1
    while have < GRAM:
        h = h[: len(h) - have] * U64(_BASE ^ (have << 8)) + h[have:]
        have *= 2
    h = mix(h)
    ends = offs[1:]
    bad = np.zeros(n + 1, np.int32)  # k-grams that cross an end
    lo = np.maximum(ends - GRAM + 1, offs[:-1])
    np.add.at(bad, lo, 1)
    np.add.at(bad, ends, -1)
    h[np.cumsum(bad)[: len(h)] > 0] = _FULL
    if len(h) < w:
        return none
    m = _slide(h, w, np.minimum)
    off = np.zeros(n + 1, np.int32)  # windows that cross an end
    lo = np.maximum(ends - length + 1, offs[:-1])
    np.add.at(off, lo, 1)
    np.add.at(off, ends, -1)
    m[np.cumsum(off)[: len(m)] > 0] = 0
    edge = np.zeros(w - 1, U64)
    top = _slide(np.concatenate([edge, m, edge]), w, np.maximum)
    at = np.flatnonzero((top == h) & (h != _FULL))
    if not len(at):
        return none
    key = h[at]
    row = np.searchsorted(offs, at, "right") - 1
    start = np.maximum(offs[row], at - (length - GRAM))
    end = np.minimum(offs[row + 1], at + length)
    if len(hot):
        is_hot = np.isin(key, hot)
        if is_hot.any():
            p, k = at[is_hot], key[is_hot]
            first = np.maximum(p - (w - 1), 0)
            many = np.minimum(p, len(m) - 1) - first + 1
            j = np.repeat(first, many) + (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
            j = np.unique(j[m[j] == np.repeat(k, many)])
            key, row, start, end, at = (np.concatenate([x[~is_hot], y]) for x, y in ((key, np.zeros(len(j), U64)), (row, np.searchsorted(offs, j, "right") - 1), (start, j), (end, j + length), (at, j)))
    global _POW, _INV
    if n + 1 > len(_POW):
        _POW, _INV = powers(_BASE, 2 * n), powers(_INVERSE, 2 * n)
    sums = np.zeros(n + 1, U64)
    np.cumsum(_BYTE2[data] * _POW[:n], out=sums[1:])
    ctx = mix((sums[end] - sums[start]) * _INV[start] + (end - start).astype(U64) * U64(0x9E3779B97F4A7C15) + (at - start).astype(U64) * U64(0xC2B2AE3D27D4EB4F))
    key = np.where(key == 0, mix(ctx ^ U64(0x5851F42D4C957F2D)), key)
    return key, ctx, row, start - offs[row], end - offs[row], at - offs[row]


def _sorted_rows(t: pa.Table) -> pa.Table:
    """A block's rows in an order that any run finds again: by doc_id (null last), then by the text's hash."""
    return t.sort_by([("did", "ascending"), ("h", "ascending")])


def _firsts(t: pa.Table, length: int, hot: np.ndarray):
    """All contexts of a block; ``at``: indices of the first place of each, sorted by key and hash; ``copy``: of the others."""
    got = []
    data, offs = utf8(t.column("text"))
    for a, b in chunks(offs, _PIECE):
        key, ctx, row, s, e, p = anchors(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], length, hot)
        got.append((key, ctx, row + a, s, e, p))
    key, ctx, row, s, e, p = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, k) for k in (U64, U64, np.int64, np.int64, np.int64, np.int64))
    order = np.lexsort((p, row, ctx, key))
    new = np.ones(len(order), bool)
    new[1:] = (key[order[1:]] != key[order[:-1]]) | (ctx[order[1:]] != ctx[order[:-1]])
    return data, offs, key, ctx, row, s, e, p, order[new], order[~new]


# ---------------------------------------------------------------- the plan


def _runs(row: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, ...]:
    """Union of intervals in each row."""
    order = np.lexsort((s, row))
    row, s, e = row[order], s[order], e[order]
    if not len(row):
        return row, s, e
    base = row * (1 << 40)
    far = np.maximum.accumulate(base + e)
    new = np.ones(len(row), bool)
    new[1:] = (base[1:] + s[1:]) > far[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(row)) - 1
    return row[at], s[at], far[last] - base[at]


def _pack(*arrays: np.ndarray) -> bytes:
    import struct

    parts = [zbytes(x) for x in arrays]
    return struct.pack(f"<{len(parts)}I", *map(len, parts)) + b"".join(parts)


def _unpack(raw: bytes, *kinds) -> list[np.ndarray]:
    import struct

    sizes = struct.unpack_from(f"<{len(kinds)}I", raw)
    at, out = 4 * len(kinds), []
    for n, kind in zip(sizes, kinds, strict=True):
        out.append(unzbytes(raw[at : at + n], kind))
        at += n
    return out


_ROUTE = "bucket long, blk long, kind int, body binary"


def _route(rows: list[tuple]) -> pa.Table:
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate((("bucket", pa.int64()), ("blk", pa.int64()), ("kind", pa.int32()), ("body", pa.binary())))})


def heavy_anchors(base: DataFrame, length: int, most: int) -> np.ndarray:
    """Anchors with over 1/most of all contexts.

    Such an anchor has over 1/(2 most) of them in some batches, and these hold over 1/(2 most) of all; so the list
    below misses none and has under 2 * most entries, whatever the input's size.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column(0))
            keys = [anchors(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], length, np.zeros(0, U64))[:2] for a, b in chunks(offs, _PIECE)]
            if not keys:
                continue
            key, ctx = (np.concatenate(x) for x in zip(*keys, strict=True))
            key = np.unique(np.stack([key, ctx]), axis=1)[0] if len(key) < 256 else _distinct(key, ctx)
            keys, n = np.unique(key, return_counts=True)
            big = (n >= max(2, len(key) / (2 * most)))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(keys[big].view(np.int64), 0)), pa.array(np.append(n[big], 0)), pa.array(np.append(np.zeros(big.sum(), np.int64), len(key)))], ["key", "n", "total"])

    found = base.select("text").mapInArrow(count, "key long, n long, total long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    total = found.agg(F.sum("total")).first()[0] or 0
    found = found.where(F.col("n") >= max(64, total / (2 * most)))
    return np.sort(np.array([r[0] for r in found.select("key").collect()], np.int64).view(U64))


def _distinct(key: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    order = np.lexsort((ctx, key))
    key, ctx = key[order], ctx[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1])
    return key[new]


def repeated_runs(docs: DataFrame, length: int = 100, most_hot: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, starts, ends): what is left of each text, and the removed runs."""
    if length < GRAM + 1:
        raise ValueError(f"length must be over {GRAM}")
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    buckets, blocks = n, 4 * n
    base = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    hot = heavy_anchors(base, length, most_hot)
    base = base.select(
        F.coalesce(F.col("doc_id"), F.lit(_LAST)).cast("long").alias("did"), F.col("doc_id").isNull().alias("lost"), F.xxhash64("text").alias("h"), "text",
        F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.xxhash64("text"))), F.lit(blocks)).alias("blk"),
    )

    def send(t: pa.Table) -> pa.Table:
        blk, t = t.column("blk")[0].as_py(), _sorted_rows(t)
        _, _, key, ctx, row, _, _, p, at, _ = _firsts(t, length, hot)
        did = t.column("did").to_numpy()
        to = key[at] % U64(buckets)
        order = np.argsort(to, kind="stable")
        cut = np.searchsorted(to[order], np.arange(buckets + 1).astype(U64))
        rows = []
        for b in range(buckets):
            if cut[b] < cut[b + 1]:
                i = at[order[cut[b] : cut[b + 1]]]
                rows.append((b, blk, 0, _pack((key[i] >> U64(32)).astype(np.uint32), ctx[i], did[row[i]], row[i], p[i])))
        return _route(rows)

    def judge(t: pa.Table) -> pa.Table:
        """0: matches nothing; 1: a later copy of an equal context; 2: to be sorted with other contexts of its anchor."""
        blks = t.column("blk").to_pylist()
        parts = [_unpack(x.as_buffer(), np.uint32, U64, np.int64, np.int64, np.int64) for x in t.column("body")]
        sizes = [len(x[0]) for x in parts]
        key, ctx, did, row, p = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((p, row, did, ctx, key))
        k, c = key[order], ctx[order]
        new_key, new = np.ones(len(k), bool), np.ones(len(k), bool)
        new_key[1:] = k[1:] != k[:-1]
        new[1:] = new_key[1:] | (c[1:] != c[:-1])
        group = np.cumsum(new_key) - 1
        several = np.bincount(group, new) > 1
        state = np.zeros(len(k), np.uint8)
        state[order] = np.where(new, np.where(several[group], 2, 0), 1)
        cut = np.cumsum([0, *sizes])
        bucket = t.column("bucket")[0].as_py()
        return _route([(bucket, blk, 0, zbytes(state[cut[i] : cut[i + 1]])) for i, blk in enumerate(blks) if state[cut[i] : cut[i + 1]].any()])

    def apply(t: pa.Table, replies: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _route([])
        blk, t = t.column("blk")[0].as_py(), _sorted_rows(t)
        data, offs, key, ctx, row, s, e, p, at, copies = _firsts(t, length, hot)
        did = t.column("did").to_numpy()
        to = (key[at] % U64(buckets)).astype(np.int64)
        state = np.zeros(len(at), np.uint8)
        for bucket, body in zip(replies.column("bucket").to_pylist(), replies.column("body"), strict=True):
            state[to == bucket] = unzbytes(body.as_buffer(), np.uint8)
        gone = np.concatenate([copies, at[state == 1]])
        gone = gone[e[gone] - s[gone] >= length]
        rows = []
        if len(gone):
            rows.append((buckets + blk, blk, 1, _pack(*_runs(row[gone], s[gone], e[gone]))))
        edge = np.flatnonzero((state == 2) & (e[at] - s[at] >= length))
        edge = edge[np.argsort(to[edge], kind="stable")]
        cut = np.searchsorted(to[edge], np.arange(buckets + 1))
        for b in range(buckets):
            i = at[edge[cut[b] : cut[b + 1]]]
            if len(i):
                size = e[i] - s[i]
                take = np.repeat(offs[row[i]] + s[i], size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
                rows.append((b, blk, 2, _pack(key[i], did[row[i]], row[i], s[i], size, data[take])))
        return _route(rows)

    def compare(t: pa.Table) -> pa.Table:
        kinds = t.column("kind").to_pylist()
        blks = np.array(t.column("blk").to_pylist(), np.int64)
        rows = [(0, int(b), 1, x.as_py()) for b, k, x in zip(blks, kinds, t.column("body"), strict=True) if k == 1]
        parts = [(_unpack(x.as_buffer(), U64, np.int64, np.int64, np.int64, np.int64, np.uint8), b) for b, k, x in zip(blks, kinds, t.column("body"), strict=True) if k == 2]
        if parts:
            key, did, row, s, size, text = (np.concatenate([x[0][i] for x in parts]) for i in range(6))
            blk = np.repeat([b for _, b in parts], [len(x[0]) for x, _ in parts])
            begin = np.cumsum(size) - size
            order = np.argsort(key, kind="stable")
            ends = np.flatnonzero(np.append(key[order[1:]] != key[order[:-1]], True)) + 1  # groups stay whole
            total, got, at = np.cumsum(size[order]), [], 0
            while at < len(order):
                limit = (total[at - 1] if at else 0) + (1 << 20)
                j = np.searchsorted(total[ends - 1], limit, "right") - 1
                end = ends[j] if j >= 0 and ends[j] > at else ends[np.searchsorted(ends, at, "right")]
                got.append(_later(order[at:end], begin, size, text, did, row, s, length))
                at = end
            who, x, y = (np.concatenate(v) for v in zip(*got, strict=True))
            for b in np.unique(blk[who]):
                mine = blk[who] == b
                rows.append((0, int(b), 1, _pack(*_runs(row[who[mine]], x[mine], y[mine]))))
        return _route(rows)

    def cut_out(t: pa.Table, found: pa.Table) -> pa.Table:
        t = _sorted_rows(t) if t.num_rows else t
        data, offs = utf8(t.column("text")) if t.num_rows else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
        runs = [_unpack(x.as_buffer(), np.int64, np.int64, np.int64) for x in found.column("body")]
        row, s, e = _runs(*(np.concatenate(x) for x in zip(*runs, strict=True))) if runs else (np.zeros(0, np.int64),) * 3
        at = np.searchsorted(row, np.arange(t.num_rows + 1))
        kept, starts, ends = [], [], []
        for i in range(t.num_rows):
            a, b = at[i], at[i + 1]
            if a == b:
                kept.append(data[offs[i] : offs[i + 1]].tobytes())
            else:
                marks = np.zeros(offs[i + 1] - offs[i] + 1, np.int8)
                marks[s[a:b]] = 1
                marks[e[a:b]] -= 1
                kept.append(data[offs[i] : offs[i + 1]][np.cumsum(marks[:-1], dtype=np.int8) == 0].tobytes())
            starts.append(s[a:b])
            ends.append(e[a:b])
        ids = pa.array(t.column("did").to_pylist(), pa.int64(), mask=np.array(t.column("lost").to_pylist(), bool)) if t.num_rows else pa.array([], pa.int64())
        lens = np.diff(offs)[: t.num_rows]
        return pa.table({
            "doc_id": ids, "n_bytes": pa.array(lens, pa.int64()), "n_removed": pa.array([int((y - x).sum()) for x, y in zip(starts, ends, strict=True)], pa.int64()),
            "n_spans": pa.array([len(x) for x in starts], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), "kept": pa.array(kept, pa.binary()),
            "starts": pa.array(starts, pa.list_(pa.int64())), "ends": pa.array(ends, pa.list_(pa.int64())),
        })

    by_blk = base.groupBy("blk")
    sent = by_blk.applyInArrow(send, _ROUTE)
    replies = sent.groupBy("bucket").applyInArrow(judge, _ROUTE)
    routed = by_blk.cogroup(replies.groupBy("blk")).applyInArrow(apply, _ROUTE)
    found = routed.groupBy("bucket").applyInArrow(compare, _ROUTE)
    return by_blk.cogroup(found.groupBy("blk")).applyInArrow(cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, starts array<long>, ends array<long>")


def _later(pick, begin, size, text, did, row, s, length) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, start, end) of runs whose strings start earlier, from the suffix order of some contexts."""
    sizes = size[pick]
    many = int(sizes.sum())
    own = np.repeat(np.arange(len(pick)), sizes)
    inside = np.arange(many) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    body = text[np.repeat(begin[pick], sizes) + inside]
    ranks = suffix_ranks(body, length)
    full = np.flatnonzero(inside + length <= sizes[own])  # suffixes with a whole window in their context
    who = pick[own[full]]
    where = s[who] + inside[full]
    order = np.lexsort((where, row[who], did[who]))
    place = np.empty(len(full), np.int64)
    d, r, x = did[who][order], row[who][order], where[order]
    new = np.ones(len(order), bool)
    new[1:] = (d[1:] != d[:-1]) | (r[1:] != r[:-1]) | (x[1:] != x[:-1])
    place[order] = np.cumsum(new)
    by = np.lexsort((place, ranks[-1][1][full]))
    lpf = np.empty(len(full), np.int64)
    lpf[by] = longest_previous(place[by], neighbour_lcp(full[by], ranks), length)
    hit = np.flatnonzero(lpf >= length)
    return who[hit], where[hit], where[hit] + length


def kept_texts(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id and what is left of its bytes, for writing a cleaned corpus."""
    return repeated_runs(docs, length).select("doc_id", "kept", "starts", "ends")


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return repeated_runs(docs, 100).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
