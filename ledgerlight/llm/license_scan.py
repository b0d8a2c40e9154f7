"""License scan: listed phrases exactly, short notices with bounded errors.

A notice of m characters with at most k errors is split into k + 1 pieces: some piece stands unchanged in any match, so an
automaton of all pieces finds every candidate place. There the regex library's fuzzy matching, with its error bound,
verifies a window around the piece and gives the span and the number of edits. Everything works on texts with A-Z
lower-cased and every run of separators made one space, and whole texts are searched.

Batches of texts are searched as one buffer whose parts no phrase or notice can join; memory is bounded by the batch and
the longest text. Nothing is shuffled, so copies and hot sources are of no account.

Nulls: a null text is empty: no words, no labels ('' as joined), null first and last word, score 0. Repeated rows are
scanned alike. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, utf8

PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("licensed under the apache license version 2 0", "apache"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this work is licensed under a creative commons attribution", "cc-by"),
    ("licensed under the gnu general public license", "gpl"),
    ("this program is free software you can redistribute it and or modify it", "gpl"),
    ("released under the mit license", "mit"),
    ("dedicated to the public domain", "public-domain"),
    ("all rights reserved", "reserved"),
)
#: One error in so many characters of a notice.
ERROR_EVERY = 10
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_PIECE = 1 << 20


def errors(notice: str) -> int:
    return max(1, len(notice) // ERROR_EVERY)


class Scanner:
    """Compiled phrases, pieces and fuzzy patterns; one per worker."""

    def __init__(self, phrases=PHRASES, notices=NOTICES):
        import ahocorasick
        import regex

        self.phrases = [(p.encode(), label) for p, label in phrases]
        self.notices = []
        self.automaton = ahocorasick.Automaton()
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, (text, label) in enumerate(notices):
            k = errors(text)
            cut = [len(text) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cut, cut[1:], strict=False):
                pieces.setdefault(text[a:b], []).append((n, a))
            self.notices.append((text, label, k, regex.compile(f"(?b)(?:{regex.escape(text)}){{e<={k}}}")))
        for piece, who in pieces.items():
            self.automaton.add_word(piece, (len(piece), who))
        self.automaton.make_automaton()

    def fuzzy(self, flat: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) of all matches in a buffer of normalised texts."""
        spots: dict[int, list[int]] = {}
        for end, (size, who) in self.automaton.iter(flat):
            for n, a in who:
                spots.setdefault(n, []).append(end + 1 - size - a)
        out = []
        for n, places in spots.items():
            text, _, k, pattern = self.notices[n]
            last = -1
            for at in sorted(set(places)):
                lo, hi = max(at - k, last, 0), at + len(text) + k
                if hi <= last:
                    continue
                lo = max(lo, flat.rfind("\xff", 0, max(at, 0) + 1) + 1)
                stop = flat.find("\xff", max(at, lo), hi)
                found = pattern.search(flat, lo, hi if stop < 0 else stop)
                if found:
                    out.append((n, found.start(), found.end(), sum(found.fuzzy_counts)))
                    last = found.end()
        return out

    def scan(self, data: np.ndarray, offs: np.ndarray) -> dict[str, list]:
        """Per text: word count, phrase places and notice matches."""
        n = len(offs) - 1
        low = _LOWER[data]
        word = _WORD[low]
        # Each text as " word word " with \xff, which no UTF-8 text has, in between.
        first = np.zeros(len(low) + 1, bool)
        first[offs] = True
        begins = word & np.append(True, ~word[:-1] | first[1:-1])[: len(word)] if len(low) else word
        many = np.diff(np.append(0, np.cumsum(begins))[offs])
        gaps = np.flatnonzero(begins)
        own = np.searchsorted(offs, gaps, "right") - 1
        lens = np.cumsum(word)
        stops = np.append(gaps[1:], len(low))
        size = (lens[stops - 1] - lens[gaps] + 1) if len(gaps) else np.zeros(0, np.int64)
        # A word takes its bytes and the space after it; a text adds \xff and a space in front.
        at = np.cumsum(size + 1) - (size + 1) + 2 * (own + 1)
        total = int(size.sum()) + len(size) + 2 * n
        flat = np.full(total, 32, np.uint8)
        body = low[word]
        flat[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(len(body))] = body
        heads = np.append(0, np.cumsum(size + 1))[np.append(0, np.cumsum(many))][:n] + 2 * np.arange(n)
        flat[heads] = 255
        raw = flat.tobytes()
        word_at = np.append(0, np.cumsum(many))
        out = {"n_words": many, "base": [[] for _ in range(n)], "fuzzy": [[] for _ in range(n)]}
        for phrase, label in self.phrases:
            key = b" " + phrase + b" "
            i = raw.find(key)
            while i >= 0:
                w = int(np.searchsorted(at, i + 1))
                d = int(own[w])
                out["base"][d].append((w - int(word_at[d]), label))
                i = raw.find(key, i + 1)
        for k, s, e, edits in self.fuzzy(raw.decode("latin-1")):
            d = int(np.searchsorted(heads, s, "right")) - 1
            # Spans in the text's own bytes, from its first to its last word touched.
            a = max(int(np.searchsorted(at, s, "right")) - 1, int(word_at[d]))
            b = max(int(np.searchsorted(at, e - 1, "right")) - 1, a)
            end = int(gaps[b + 1]) if b + 1 < len(gaps) and own[b + 1] == d else int(offs[d + 1])
            while end > gaps[b] and not word[end - 1]:
                end -= 1
            out["fuzzy"][d].append((int(gaps[a] - offs[d]), int(end - offs[d]), self.notices[k][1], edits, 1 - edits / len(self.notices[k][0])))
        return out


_SCANNERS: dict = {}


def scan_licenses(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """Per row: n_words, n_base, first_word, last_word, base_labels, labels, score and the notices' byte spans."""
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("edits", pa.int64())]))
    schema = pa.schema([*fields, ("spans", span)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (phrases, notices)
        scanner = _SCANNERS.setdefault(key, None) or _SCANNERS.__setitem__(key, Scanner(phrases, notices)) or _SCANNERS[key]
        for batch in batches:
            data, offs = utf8(batch.column(1))
            for a, b in chunks(offs, _PIECE):
                got = scanner.scan(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                base, fuzzy = got["base"], got["fuzzy"]
                labels = [sorted({x[1] for x in p}) for p in base]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[a:b], pa.array(got["n_words"], pa.int64()), pa.array([len(p) for p in base], pa.int64()),
                    pa.array([min((x[0] for x in p), default=None) for p in base], pa.int64()), pa.array([max((x[0] for x in p), default=None) for p in base], pa.int64()),
                    pa.array([",".join(x) for x in labels]), pa.array([",".join(sorted({*x, *(f[2] for f in fs)})) for x, fs in zip(labels, fuzzy, strict=True)]),
                    pa.array([1.0 if p else max((f[4] for f in fs), default=0.0) for p, fs in zip(base, fuzzy, strict=True)], pa.float64()),
                    pa.array([[dict(zip(("start", "end", "label", "edits"), f[:4], strict=True)) for f in sorted(fs)] for fs in fuzzy], span),
                ], schema=schema)

    out = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start: long, end: long, label: string, edits: long>>"
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, out)


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
