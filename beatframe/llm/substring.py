"""Substring dedup: seed and extend.

Seeds are ``SEED``-word anchors picked by winnowing: of every ``length - SEED + 1``
consecutive anchors the one with the smallest hash.  The pick depends on nothing but the
words of the window, so two equal windows of ``length`` words have the same anchor at the
same place, and only anchors that occur twice matter.

Extension: an occurrence reaches ``length - SEED`` words to either side.  Occurrences with
the same words on both sides form one class; all but its first occurrence repeat the whole
reach.  First occurrences of different classes of one anchor are extended word by word: the
parts of the reach of ``length`` words that hold the anchor are matched by their words.
What repeats is merged per document; each run is a maximal repeat of at least ``length``
words.

Scale: every comparison is an equality of hashes (anchor and context, 128 bits), so no pair
of occurrences is built and thousands of copies cost a row each.  About one word in seven is
an anchor.  A document's text is shuffled twice, for the extension and for the removal.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import _power_tables, chunks, mix, prepare, runs, settle, signed, words

SEED = 8


def _winnow(h: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all texts of a chunk: index of the text, index of the word, hash."""
    g = runs(h, SEED)
    span = length - SEED + 1
    if len(g) < span:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    view = np.lib.stride_tricks.sliding_window_view(g, span)
    at = np.arange(len(view)) + (span - 1 - np.argmin(view[:, ::-1], axis=1))
    doc = np.searchsorted(off, np.arange(len(view)), "right") - 1
    inside = np.arange(len(view)) + length <= off[doc + 1]
    at = np.unique(at[inside])
    return np.searchsorted(off, at, "right") - 1, at, g[at]


def _between(h: np.ndarray):
    """Hash of the words from a to b, for arrays of a and b."""
    p, q = _power_tables(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * p[: len(h)], out=total[1:])
    return lambda a, b: mix((total[b] - total[a]) * q[a] + (b - a).astype(np.uint64))


def _anchors(length: int, contexts: bool):
    reach = length - SEED

    def run(batches):
        for b in chunks(batches):
            w = words(b.column("text"), lower=False)
            doc, at, h = _winnow(w.h, w.off, length)
            cols = {"h": pa.array(signed(h))}
            if contexts:
                lo, hi = np.maximum(at - reach, w.off[doc]), np.minimum(at + SEED + reach, w.off[doc + 1])
                ctx = mix(_between(w.h)(lo, hi) + (at - lo).astype(np.uint64))
                begin = w.off[doc]
                cols |= {"ctx": pa.array(signed(ctx)), "doc_id": b.column("doc_id").take(pa.array(doc)), "pos": pa.array((at - begin).astype(np.int32)), "lo": pa.array((lo - begin).astype(np.int32)), "hi": pa.array((hi - begin).astype(np.int32))}
            yield pa.RecordBatch.from_pydict(cols)

    return run


def _extend(length: int):
    """The parts of the reach around each asked position: all windows that hold the anchor."""

    def run(batches):
        for b in chunks(batches):
            w = words(b.column("text"), lower=False)
            g = runs(w.h, length)
            asked = b.column("asked")
            doc = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(asked.offsets)))
            flat = asked.flatten()
            pos = flat.field("pos").to_numpy() + w.off[doc]
            h = flat.field("h").to_numpy()
            for j in range(length - SEED + 1):
                s = pos - j
                ok = (s >= w.off[doc]) & (s + length <= w.off[doc + 1])
                d = doc[ok]
                yield pa.RecordBatch.from_pydict({"h": pa.array(h[ok]), "win": pa.array(signed(mix(g[s[ok]] + np.uint64(j)))), "doc_id": b.column("doc_id").take(pa.array(d)), "start": pa.array((s[ok] - w.off[d]).astype(np.int32))})

    return run


def _remove(batches):
    for b in batches:
        n, gone, digest, kept_text = [], [], [], []
        for text, marks in zip(b.column("text"), b.column("marks")):
            ws = (text.as_py() or "").encode().split()
            n.append(len(ws))
            drop = 0
            if marks.is_valid and len(marks.values):
                flag = np.zeros(len(ws) + 1, np.int64)
                v = marks.values
                np.add.at(flag, v.field("lo").to_numpy(), 1)
                np.add.at(flag, v.field("hi").to_numpy(), -1)
                out = np.cumsum(flag[:-1]) > 0
                drop = int(out.sum())
                ws = [x for x, o in zip(ws, out.tolist()) if not o]
            gone.append(drop)
            kept = b" ".join(ws)
            digest.append(hashlib.sha256(kept).hexdigest())
            kept_text.append(kept.decode())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest), pa.array(kept_text, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def remove_repeats(docs: DataFrame, length: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text: each text without the words covered by a window of
    ``length`` words that also starts earlier (smaller doc_id, or earlier in the document).

    Null or empty text: no words.  Repeated rows of a doc_id count as one document and each
    give a row.  Rows without doc_id neither repeat nor are repeated.
    """
    prepare(docs.sparkSession)
    n = F.col
    docs = docs.select(n("doc_id").cast("long").alias("doc_id"), n("text").cast("string").alias("text"))
    known = docs.where(n("doc_id").isNotNull())
    seeds = known.select("text").mapInArrow(_anchors(length, False), "h long")
    again = settle(seeds.groupBy("h").agg(F.count("*").alias("k")).where(n("k") > 1).select("h"), "seeds")
    found = known.mapInArrow(_anchors(length, True), "h long, ctx long, doc_id long, pos int, lo int, hi int")
    found = settle(found.join(again, "h", "left_semi"), "anchors")
    first = settle(found.groupBy("h", "ctx").agg(F.min(F.struct("doc_id", "pos")).alias("f")), "first")
    whole = found.join(first, ["h", "ctx"]).where((n("f.doc_id") != n("doc_id")) | (n("f.pos") != n("pos"))).select("doc_id", "lo", "hi")
    # anchors with several classes: their first occurrences are extended
    several = settle(first.groupBy("h").agg(F.count("*").alias("k")).where(n("k") > 1).select("h"), "several")
    asked = first.join(several, "h", "left_semi").select("h", "f.*").groupBy("doc_id").agg(F.collect_list(F.struct("h", "pos")).alias("asked"))
    parts = settle(known.join(asked, "doc_id").mapInArrow(_extend(length), "h long, win long, doc_id long, start int"), "parts")
    before = settle(parts.groupBy("h", "win").agg(F.min(F.struct("doc_id", "start")).alias("f"), F.count("*").alias("k")).where(n("k") > 1).drop("k"), "before")
    partly = parts.join(before, ["h", "win"]).where((n("f.doc_id") != n("doc_id")) | (n("f.start") != n("start")))
    partly = partly.select("doc_id", n("start").alias("lo"), (n("start") + length).alias("hi"))
    marks = whole.unionByName(partly).groupBy("doc_id").agg(F.collect_set(F.struct("lo", "hi")).alias("marks"))
    return docs.join(marks, "doc_id", "left").mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
