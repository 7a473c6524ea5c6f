"""Sequence packing: shortest-pack-first over the length histogram.

Documents become token ids and an end id, cut into full sequences and one rest.  The rests
are packed by their histogram alone (at most ``size`` lengths): from the longest length to
the shortest, pieces join the packs that are shortest so far, all packs of one pattern at
once; if even those have no room, they open new packs.  Patterns then go back to the pieces
by rank: the r-th piece of a length belongs to the pattern whose range of ranks holds r.

Scale: only the histogram (bounded by ``size``) comes to the driver.  Ranks are counted
within salted parts of each length and shifted by the parts before, so a length that most
pieces have is spread over all tasks.  A pattern table has at most about two patterns a
length.  Tokens are made once and leave only lengths and checksums behind, unless asked for.
"""

from __future__ import annotations

import base64
import functools
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import chunks, prepare, settle, width


@functools.lru_cache(2)
def encoder(path: str):
    """Text -> ids of a byte-level vocabulary (``path``: its ``tokenizers`` file, with the same
    vocabulary as ranks beside it, which is several times faster to use)."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    ranks = path.removesuffix(".json") + ".tiktoken"
    plain = lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    if not os.path.exists(ranks):
        return plain
    with open(ranks, "rb") as f:
        pairs = (x.split() for x in f)
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})

    def encode(text: str) -> np.ndarray:
        try:
            return np.array(fast.encode_ordinary(text), np.uint32)
        except Exception:  # the pattern's engine gives up on some very long runs
            return plain(text)

    return encode


def _cut(path: str, size: int, end: int, with_ids: bool):
    def run(batches):
        encode = encoder(path)
        for b in chunks(batches):
            doc, start, length, crc, total, out = [], [], [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(end)).astype("<u4")
                for at in range(0, len(ids), size):
                    piece = ids[at : at + size]
                    doc.append(i)
                    start.append(at)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(ids))
                    if with_ids:
                        out.append(piece.astype(np.int32))
            cols = {"doc_id": b.column("doc_id").take(pa.array(doc, pa.int64())), **{k: pa.array(v, pa.int64()) for k, v in (("start", start), ("length", length), ("ids_crc32", crc), ("doc_tokens", total))}}
            if with_ids:
                cols["ids"] = pa.array(out, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(cols)

    return run


def shortest_pack_first(count: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of a sequence) and how many sequences each has."""
    open_: dict[int, list[list]] = {}  # by the sum so far: [pattern, sequences]
    done = []
    for length in sorted(count, reverse=True):
        left = count[length]
        while left:
            low = min(open_, default=size)
            if low + length > size:
                pattern, n = (), left
            else:
                pattern, have = open_[low].pop()
                n = min(left, have)
                if n < have:
                    open_[low].append([pattern, have - n])
                if not open_[low]:
                    del open_[low]
            left -= n
            total = sum(pattern) + length
            (done if total == size else open_.setdefault(total, [])).append([(*pattern, length), n])
    return [(p, n) for p, n in [*done, *(x for packs in open_.values() for x in packs)]]


def _ranges(patterns) -> list[np.ndarray]:
    """Ranges of ranks by length: first key (length, rank), first sequence, pieces of that
    length in the pattern, and where their offsets begin; then all offsets."""
    used: dict[int, int] = {}
    rows, offsets, seq = [], [], 0
    for pattern, n in patterns:
        place: dict[int, list[int]] = {}
        at = 0
        for x in pattern:
            place.setdefault(x, []).append(at)
            at += x
        for x, offs in place.items():
            rows.append(((x << 44) + used.get(x, 0), seq, len(offs), len(offsets)))
            used[x] = used.get(x, 0) + n * len(offs)
            offsets += offs
        seq += n
    rows.sort()
    return [*(np.array(c, np.int64) for c in (zip(*rows) if rows else ((),) * 4)), np.array(offsets, np.int64)]


def _lay(ranges: list[np.ndarray]):
    key, seq, many, at, offsets = ranges

    def run(batches):
        for b in batches:
            if b.num_rows:
                mine = (b.column("length").to_numpy() << 44) + b.column("rank").to_numpy()
                i = np.searchsorted(key, mine, "right") - 1
                x = mine - key[i]
                cols = {c: b.column(c) for c in b.schema.names if c != "rank"}
                cols |= {"sequence_id": pa.array(seq[i] + x // many[i]), "offset": pa.array(offsets[at[i] + x % many[i]])}
                yield pa.RecordBatch.from_pydict(cols)

    return run


def pack(docs: DataFrame, vocabulary: str, size: int = 1024, end: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids): one row a piece.

    Ids are those of ``vocabulary`` (compared on every code point).  Null text counts as empty: one piece that holds only the end id.  Repeated rows are packed
    each for themselves.  Strings of special tokens in a text are ordinary text.
    """
    spark, n = prepare(docs.sparkSession), F.col
    docs = docs.select(n("doc_id").cast("long").alias("doc_id"), n("text").cast("string").alias("text"))
    cols = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    salt = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(width(spark))).cast("int")
    pieces = settle(docs.mapInArrow(_cut(vocabulary, size, end, with_ids), cols).withColumn("salt", salt), "pieces")
    parts = settle(pieces.groupBy("length", "salt").agg(F.count("*").alias("k")), "parts")
    count = {r.length: r.k for r in parts.groupBy("length").agg(F.sum("k").alias("k")).collect()}
    before = F.sum("k").over(W.partitionBy("length").orderBy("salt")) - n("k")
    parts = settle(parts.select("length", "salt", before.alias("before")), "parts")
    own = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "start")) - 1
    ranked = pieces.withColumn("own", own).join(parts, ["length", "salt"]).withColumn("rank", n("own") + n("before"))
    names = [c.split()[0] for c in cols.split(", ")]
    return ranked.select(*names, "rank").mapInArrow(_lay(_ranges(shortest_pack_first(count, size))), cols + ", sequence_id long, offset long")
