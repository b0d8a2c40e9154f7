"""Token ids in Arrow files of fixed-size-list batches.

Documents are range-partitioned and sorted by doc_id, encoded, and each partition becomes one Arrow IPC file: rows of
``length`` ids (fixed-size list) with a mask of the same shape, the last row padded. All batches but a file's last have
``batch_rows`` rows, so a row's place is computed, not looked for; a file is memory-mapped and any sequence or mask is
reached without copying or reading others. Ids take 16 bits where the vocabulary allows it, else 32. Masks have a byte for
each id and are dictionary-encoded: a file holds each distinct mask once. Another column lists the documents that begin in
the row, so the files alone give back every document.

Files are written under names of their own per attempt and listed by what the job's surviving attempts return; a retried
task leaves an unlisted file at most. The folder is the session's shared one unless given; pyarrow's file systems write
to it, so it may be local-shared, HDFS or an object store.

Nulls: a null text is empty and has the end id only; null doc_ids come last. Rows that share a doc_id follow the order of
their text's hash; equal rows are interchangeable. An empty table gives no documents. Texts of any length are encoded whole.
"""

from __future__ import annotations

import gc
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, fresh_dir, materialize, shuffle_partitions, utf8

LENGTH = 2_048
END_ID = 0
_LAST = np.iinfo(np.int64).max
_PIECE = 1 << 20
_CUT = re.compile(r"(?<=[!-~\w])(?= )")
_UNSURE = re.compile(r" (?<=[^!-~\w] )")
#: A piece whose pre-tokens are plain: a word, signs (no apostrophe, which may begin a contraction), perhaps a further line's.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@[-`{-~]*)(?:\n([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@[-`{-~]*))?")
_STATE: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def open_fs(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pyarrow.fs.FileSystem.from_uri(uri)


def _byte_letters() -> dict[int, str]:
    """How a byte-level vocabulary writes each byte: visible Latin-1 as itself, the others from U+0100 on in their order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Memo(dict):
    """A dictionary that learns what it lacks when it is asked."""

    __slots__ = ("learn",)

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = self.learn(piece)
        return ids


class Encoder:
    """The tokenizer with a bounded memo of pieces.

    Byte-level pre-tokens never join a space to what stands before it, so a text may be cut before any space that follows
    a letter, digit or ASCII sign; a piece's ids do not hang on its neighbours. An unknown piece of plain pre-tokens is put
    together from theirs, so that a word known without its comma is not merged again; other unknown pieces are encoded as
    they are. A tokenizer that does not cut this way encodes whole texts.
    """

    def __init__(self, path: str, most: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.packed = [i.to_bytes(self.dtype.itemsize, "little") for i in range(size)]
        self.end = np.array([END_ID], self.dtype).tobytes()
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        cutter = parts.get("pre_tokenizer") or {}
        self.composes = cutter.get("type") == "ByteLevel" and cutter.get("use_regex") is True and not cutter.get("add_prefix_space") and not parts.get("normalizer")
        self.model = self._plain_model(parts.get("model") or {})
        self.letters = _byte_letters()
        self.space = self.letters[0x20]
        self.most = most
        self.memo, self.old = self._fresh(), {}
        self.lines, self.signs = {}, {}

    def _plain_model(self, model: dict):
        """The tokenizer's own model; a byte-pair one without its cache, which the memo replaces."""
        from tokenizers import models

        if not self.composes or model.get("type") != "BPE":
            return self.tokenizer.model
        keep = ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges", "dropout")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        return models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0, **{k: model[k] for k in keep if model.get(k) is not None})

    def _fresh(self) -> _Memo:
        memo = _Memo()
        memo.learn = self._learn
        return memo

    def pieces(self, text: str) -> list[str]:
        """The text up to the first cut, then the pieces without the space each begins with."""
        if text.startswith(" ") or _UNSURE.search(text):
            first, *rest = _CUT.split(text)
            return [first, *[x[1:] for x in rest]]
        return text.split(" ")

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pre_token(self, text: str, before: str = "") -> bytes:
        """The ids of one pre-token, after ``before`` in the vocabulary's letters."""
        if not text.isascii() or not text.isalpha():
            text = text.encode().decode("latin-1").translate(self.letters)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(before + text)])

    def _sign(self, text: str) -> bytes:
        if len(text) > 3:  # the memo of signs has a bound
            return self._pre_token(text)
        ids = self.signs.get(text)
        if ids is None:
            ids = self.signs[text] = self._pre_token(text)
        return ids

    def _line(self, word: str) -> bytes:
        ids = self.lines.get(word)
        if ids is None:
            ids = self.lines[word] = self._pre_token(word)
        return ids

    def _learn(self, piece: str) -> bytes:
        """The ids of a space and a piece: from the older half of the memo, from its pre-tokens, or by encoding it."""
        ids = self.old.get(piece)
        if ids is not None:
            return ids
        if piece.isalpha():
            return self._pre_token(piece, self.space)
        m = _PLAIN.fullmatch(piece)
        if m is None:
            return self._each([" " + piece])[0]
        word, signs, line, more = m.groups()
        ids = self.memo.get(word) or self.old.get(word)
        if ids is None:
            ids = self.memo[word] = self._pre_token(word, self.space)
        if signs:
            ids += self._sign(signs)
        if line:
            ids += self._sign("\n") + self._line(line)
            if more:
                ids += self._sign(more)
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian numbers."""
        if not self.composes:
            return self._each(texts)
        if len(self.memo) > self.most:  # what is used again comes back from the older half; the rest goes
            self.old, self.memo, self.lines = self.memo, self._fresh(), {}
        get, cut = self.memo.__getitem__, [self.pieces(t) for t in texts]
        collects = gc.isenabled()
        gc.disable()  # nothing below makes cycles, and the memo is large
        try:
            return [head + b"".join(map(get, islice(pieces, 1, None))) for head, pieces in zip(self._each([c[0] for c in cut]), cut, strict=True)]
        finally:
            if collects:
                gc.enable()


def _encoder(path: str) -> Encoder:
    if path not in _STATE:
        _STATE[path] = Encoder(path)
    return _STATE[path]


def _schema(dtype: np.dtype, length: int, batch_rows: int) -> pa.Schema:
    item = pa.struct([("doc_id", pa.int64()), ("offset", pa.int64()), ("n", pa.int64())])
    ids = pa.list_(pa.uint16() if dtype.itemsize == 2 else pa.uint32(), length)
    return pa.schema([("ids", ids), ("mask", pa.dictionary(pa.int32(), pa.list_(pa.uint8(), length))), ("docs", pa.list_(item))], metadata={"batch_rows": str(batch_rows)})


def _batch(ids: np.ndarray, real: int, docs: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    """Rows of ids, ``real`` of them before the padding; ``docs`` has (doc_id, offset in the batch, n) in order."""
    length = schema.field("ids").type.list_size
    rows = len(ids) // length
    masks = np.ones((2 if real < len(ids) else 1, length), np.uint8)
    if real < len(ids):
        masks[1] = np.arange(length) < real - (rows - 1) * length
    which = np.zeros(rows, np.int32)
    which[rows - 1] = len(masks) - 1
    mask = pa.DictionaryArray.from_arrays(pa.array(which), pa.FixedSizeListArray.from_arrays(pa.array(masks.reshape(-1)), length))
    begin = np.searchsorted(docs[:, 1] // length, np.arange(rows + 1)).astype(np.int32)
    items = pa.StructArray.from_arrays([pa.array(docs[:, 0]), pa.array(docs[:, 1] % length), pa.array(docs[:, 2])], fields=list(schema.field("docs").type.value_type))
    return pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(ids), length), mask, pa.ListArray.from_arrays(pa.array(begin), items)], schema=schema)


def write_token_files(docs: DataFrame, where: str, tokenizer: str | None = None, length: int = LENGTH, batch_rows: int = 256) -> DataFrame:
    """Encode ``docs`` to files under ``where``; a table of (part, file, n_tokens, n_docs) in document order."""
    path = tokenizer or default_tokenizer()
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    rows = docs.select(F.coalesce(F.col("doc_id"), F.lit(_LAST)).cast("long").alias("did"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, "did", "h").sortWithinPartitions("did", "h").select("did", "text", F.spark_partition_id().alias("part"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        schema, size, wide = _schema(enc.dtype, length, batch_rows), length * batch_rows, enc.dtype.itemsize
        sink = writer = None
        fs, base = open_fs(where)
        have, fill, docs, part, total, many = [], 0, [], 0, 0, 0

        def flush(end: bool) -> None:
            """Write whole batches; at the end the rest, its last row padded. A document belongs to the row in which it begins."""
            nonlocal have, fill, docs
            flat = np.frombuffer(b"".join(have), enc.dtype)
            own = np.array(docs, np.int64).reshape(-1, 3)
            real = len(flat) if end else len(flat) // size * size
            cut = np.searchsorted(own[:, 1], np.arange(0, real + size, size))
            for k, a in enumerate(range(0, real, size)):
                ids = flat[a : min(a + size, real)]
                batch = _batch(np.append(ids, np.zeros(-len(ids) % length, enc.dtype)), len(ids), own[cut[k] : cut[k + 1]] - [0, a, 0], schema)
                writer.write_batch(batch)
            docs = [(d, o - real, n) for d, o, n in docs[int(np.searchsorted(own[:, 1], real)) :]]
            have, fill = [flat[real:].tobytes()], len(flat) - real

        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                part = batch.column(2)[0].as_py()
                name = f"{base}/tokens-{part:06d}-{uuid.uuid4().hex}.arrow"
                sink = fs.open_output_stream(name, compression=None)
                writer = pa.ipc.new_file(sink, schema, options=pa.ipc.IpcWriteOptions(emit_dictionary_deltas=True))
            dids, (_, offs) = batch.column(0).to_pylist(), utf8(batch.column(1))
            for a, b in chunks(offs, _PIECE):
                for did, raw in zip(dids[a:b], enc.encode(batch.column(1)[a:b].to_pylist()), strict=True):
                    n = len(raw) // wide + 1
                    docs.append((did, fill, n))
                    have += (raw, enc.end)
                    fill += n
                    total += n
                many += b - a
                if fill >= size:
                    flush(False)
        if writer is not None:
            flush(True)
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([name]), pa.array([total]), pa.array([many])], ["part", "file", "n_tokens", "n_docs"])

    kinds = "part int, file string, n_tokens long, n_docs long"
    fix = lambda it: (b.cast(pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_tokens", pa.int64()), ("n_docs", pa.int64())])) for b in write(it))
    return materialize(rows.mapInArrow(fix, kinds), "manifest").withColumn("root", F.lit(where))


def read_documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from the files; ``start`` counts the ids of all documents before."""
    # One row per file: the running sum over files is small however many documents there are.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))
    files = files.select("root", "file", "base").repartition(shuffle_partitions(manifest.sparkSession), "file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for root, file, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, _ = open_fs(root)
                yield from _documents(fs, file, base)

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _documents(fs: pyarrow.fs.FileSystem, file: str, base: int) -> Iterator[pa.RecordBatch]:
    """Documents run over rows and batches; their crc is carried along."""
    ids, starts, sizes, crcs = [], [], [], []
    at, left, crc = base, 0, 0
    with fs.open_input_file(file) as source:
        reader = pa.ipc.open_file(source)
        for k in range(reader.num_record_batches):
            batch = reader.get_batch(k)
            lists = batch.column(0)
            length = lists.type.list_size
            flat = lists.values.to_numpy()[lists.offset * length : (lists.offset + len(lists)) * length].astype("<u4")
            pos = 0

            def take() -> None:
                nonlocal pos, left, crc
                part = flat[pos : pos + left]
                crc = zlib.crc32(part.tobytes(), crc)
                pos, left = pos + len(part), left - len(part)
                if not left:
                    crcs.append(crc)

            if left:
                take()
            for docs in batch.column(2).to_pylist():
                for d in docs:
                    ids.append(None if d["doc_id"] == _LAST else d["doc_id"])
                    starts.append(at)
                    sizes.append(d["n"])
                    at += d["n"]
                    left, crc = d["n"], 0
                    take()
            done = len(crcs)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x[:done], pa.int64()) for x in (ids, starts, sizes, crcs)], ["doc_id", "start", "n_tokens", "ids_crc32"])
                ids, starts, sizes, crcs = ids[done:], starts[done:], sizes[done:], []


def sequence(file_uri: str, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of one row of a local file, both mapped into memory and not copied; the row's batch is computed."""
    reader = pa.ipc.open_file(pa.memory_map(open_fs(file_uri)[1]))
    k, i = divmod(row, int(reader.schema.metadata[b"batch_rows"]))
    if row < 0 or k >= reader.num_record_batches:
        raise IndexError(row)
    batch = reader.get_batch(k)
    if i >= batch.num_rows:
        raise IndexError(row)
    mask = batch.column(1)
    return batch.column(0)[i].values.to_numpy(zero_copy_only=True), mask.dictionary[mask.indices[i].as_py()].values.to_numpy(zero_copy_only=True)


def token_digests(docs: DataFrame, where: str | None = None) -> DataFrame:
    """Write the files and read every document's place, length and crc back from them."""
    return read_documents(write_token_files(docs, where or fresh_dir(docs.sparkSession, "tokens")))


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
