"""Language-model scoring by online logistic context mixing.

A text is a row of words, each written as its bytes and a space; an empty word ends the text.
Every bit of every byte is predicted by several counters, each found by hashing one context
with the bits of the byte so far: the last one, two, three or four bytes of the word, the whole
word so far, and that with the class of the word before.  Their log odds are mixed by weights
that a gate picks (how much the longest contexts have seen, and the place of the bit), learned
online over the training words; an adaptive map then corrects the mixed probability by what
followed it in training.  The bits of a word add up to its cost.

Since a word's cost hangs on nothing but the word and the class before it, every distinct
word is predicted once for each class and texts add up looked-up costs.

How the work is laid out: a task packs its texts into units of at most ``UNIT`` words (texts as
numbers of the unit's distinct words).  Distinct words of all units meet in one vocabulary
with their counts, cut into blocks; counters, weights and the map are learned from it,
predictions are made in it, and counts and costs go back to the units by word.  Counters are
a table keyed by context and byte (the counts of a byte's bits follow from those of all bytes
after a context): each block asks once for every context and byte that it has and says how
often it saw it, buckets of contexts add up what all blocks saw and answer.  The table has all
contexts of all words and grows with the vocabulary; nothing of it is broadcast or collected.
Units get costs in the same way: each asks once for every word that it has, in the classes in
which it has it, and buckets of words answer in the order of its words.
What is written goes as compressed columns of numbers, sorted hashes as their distances.
Words are told apart by 64-bit hashes, contexts by 56-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import _power_tables, chunks, dealt, groups, mix, prepare, settle, signed, width, words
from .quality import held_out as held

#: Bytes of items (a word in a class) in a block.
UNIT, CLASSES, BLOCK_BYTES = 2_000_000, 4, 500_000
#: Distinct bytes at a time: while the weights are learned (one update for each piece), and after.
LEARN_STEP, STEP = 6_000, 100_000
#: Predictors; buckets of contexts or words at least, and the bytes asked for, or words, that a bucket has about.
PREDICTORS, BUCKETS, BUCKET_ROWS, BUCKET_WORDS = 6, 64, 4_000_000, 1_000_000
END = np.uint64(0x9D8F_37A1_55C3_0E21)  # stands for the end of a text among the words' hashes
PRIOR, MAP_PRIOR, FORGET, LEVELS = 0.3, 16.0, 0.95, 33

#: Class of a word by its last byte: letter or digit, other byte of a letter, stop, symbol.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 0
_CLASS[128:] = 1
_CLASS[[ord(c) for c in ".,;:?"]] = 2
START = 2


# ---- units -------------------------------------------------------------------
def _zip(x: np.ndarray) -> bytes:
    """Numbers as their first bytes, their second bytes and so on: those that are alike come together."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T
    return pa.Codec("zstd", compression_level=3).compress(planes.tobytes(), asbytes=True)


def _unzip(col, dtype) -> np.ndarray:
    size, data = col
    if not size:
        return np.zeros(0, dtype)
    planes = np.frombuffer(pa.decompress(data, decompressed_size=size, codec="zstd"), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    out = np.empty(planes.shape[::-1], np.uint8)
    for k, plane in enumerate(planes):
        out[:, k] = plane
    return out.view(dtype).ravel()


def _zip_counts(x: np.ndarray) -> bytes:
    """Numbers from 0, in as many bytes as the largest needs (told by the first byte)."""
    kind = np.min_scalar_type(int(x.max(initial=0)))
    return bytes([kind.itemsize]) + _zip(x.astype(kind))


def _unzip_counts(n: int, data: bytes) -> np.ndarray:
    return _unzip((n * data[0], data[1:]), f"u{data[0]}")


def _zip_sorted(x: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit numbers as their distances."""
    return _zip(np.diff(x, prepend=np.uint64(0)))


def _unzip_sorted(n: int, data: bytes) -> np.ndarray:
    return np.cumsum(_unzip((8 * n, data), np.uint64), dtype=np.uint64)


def _cut(sorted_hashes: np.ndarray, buckets: int):
    """(bucket, range) of sorted hashes: buckets are their first bits."""
    bucket = (sorted_hashes >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int32)
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if a < b:
            yield int(bucket[a]), slice(a, b)


def _row(values: list, shape: str) -> pa.RecordBatch:
    """One row of the columns that a schema names."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    columns = [x.split() for x in shape.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[k]) for v, (_, k) in zip(values, columns)], names=[c for c, _ in columns])


UNITS = "unit long, docs binary, n_docs int, codes binary, n_codes int, hashes binary, counts binary, bytes binary, n_bytes int, n_words int"


def _pack(name: int, parts: list) -> pa.RecordBatch:
    """One unit of (ids, known, held, hashes, lengths, classes, words of chunk...) parts."""
    ids = np.concatenate([p["id"] for p in parts])
    flag = np.concatenate([p["flag"] for p in parts])
    n = np.concatenate([p["n"] for p in parts])
    h = np.concatenate([p["h"] for p in parts])
    cls = np.concatenate([p["cls"] for p in parts])
    distinct, first, code = np.unique(h, return_index=True, return_inverse=True)
    code = code * CLASSES + cls
    train = np.repeat(flag & 1 == 0, n)
    counts = np.zeros((len(distinct) * CLASSES, 2), np.int64)
    counts[:, 0] = np.bincount(code[train], minlength=len(counts))
    counts[:, 1] = np.bincount(code, minlength=len(counts))
    size = np.concatenate([p["size"] for p in parts])[first]
    buf = np.concatenate([p["buf"] for p in parts])
    at = np.concatenate([p["at"] + o for p, o in zip(parts, np.cumsum([0, *(len(p["buf"]) for p in parts[:-1])]))])[first]
    text = buf[_spread(at, size)]
    docs = np.concatenate([ids, flag.astype(np.int64), n])
    body = np.concatenate([np.frombuffer(size.astype(np.int32).tobytes(), np.uint8), text])
    row = {"unit": name, "docs": _zip(docs), "n_docs": len(ids), "codes": _zip(code.astype(np.int32)), "n_codes": len(code), "hashes": _zip_sorted(distinct), "counts": _zip_counts(counts), "bytes": _zip(body), "n_bytes": len(body), "n_words": len(distinct)}
    types = {"unit": pa.int64(), **{k: pa.int32() for k in ("n_docs", "n_codes", "n_bytes", "n_words")}}
    return pa.RecordBatch.from_pydict({k: pa.array([v], types.get(k, pa.binary())) for k, v in row.items()})


def _spread(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of all ranges [at, at + size) one after another."""
    total = np.cumsum(size)
    if not len(total):
        return np.zeros(0, np.int64)
    return np.arange(total[-1]) + np.repeat(at - (total - size), size)


def _units(batches):
    from pyspark import TaskContext

    task, k, parts, held_words = TaskContext.get().partitionId(), 0, [], 0
    for b in chunks(batches):
        w = words(b.column("text"), lower=True)
        docs, n = b.num_rows, np.diff(w.off)
        # an end after the words of each text
        at = w.off[1:]
        ends = at + np.arange(docs)
        total = len(w.h) + docs
        is_end = np.zeros(total, bool)
        is_end[ends] = True
        h = np.full(total, END)
        h[~is_end] = w.h
        size, start = np.zeros(total, np.int64), np.zeros(total, np.int64)
        size[~is_end], start[~is_end] = w.end - w.start, w.start
        own = np.full(total, START, np.uint8)
        own[~is_end] = _CLASS[w.buf[w.end - 1]]
        cls = np.concatenate([[START], own[:-1]]).astype(np.int64)  # after an end comes a text's first word
        ids = b.column("doc_id")
        flag = b.column("held").to_numpy(zero_copy_only=False).astype(np.uint8) + 2 * ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
        parts.append({"id": ids.fill_null(0).to_numpy(), "flag": flag, "n": n + 1, "h": h, "cls": cls, "size": size, "at": start, "buf": w.buf})
        held_words += total
        if held_words >= UNIT:
            yield _pack((task << 24) + k, parts)
            k, parts, held_words = k + 1, [], 0
    if parts:
        yield _pack((task << 24) + k, parts)


def _distinct(batches):
    """Words of units: hash, bytes, training counts by class, and which classes occur at all."""
    for b in batches:
        for r in b.to_pylist():
            n = r["n_words"]
            h = signed(_unzip_sorted(n, r["hashes"]))
            counts = _unzip_counts(n * CLASSES * 2, r["counts"]).astype(np.int64).reshape(n, CLASSES, 2)
            body = _unzip((r["n_bytes"], r["bytes"]), np.uint8)
            size = body[: 4 * n].view(np.int32)
            off = np.concatenate([[0], np.cumsum(size)])
            text = pa.py_buffer(body[4 * n :].tobytes())
            word = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(off.astype(np.int64).tobytes()), text]).cast(pa.binary())
            mask = ((counts[:, :, 1] > 0) << np.arange(CLASSES)).sum(axis=1)
            for a in range(0, n, 50_000):
                z = slice(a, a + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(h[z]), word[z], *(pa.array(counts[z, k, 0]) for k in range(CLASSES)), pa.array(mask[z])], names=["h", "word", *(f"c{k}" for k in range(CLASSES)), "mask"])


WANTED = "bucket int, unit long, n int, hashes binary, mask binary, counts binary, cost binary"
FOUND = "unit long, bucket int, n int, mask binary, counts binary, cost binary"


def _wanted(buckets: int):
    """Words of units by bucket, with the classes in which a unit has them."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                n = r["n_words"]
                h = _unzip_sorted(n, r["hashes"])
                counts = _unzip_counts(n * CLASSES * 2, r["counts"]).astype(np.int64).reshape(n, CLASSES, 2)
                mask = ((counts[:, :, 1] > 0) << np.arange(CLASSES)).sum(axis=1).astype(np.uint8)
                for bucket, z in _cut(h, buckets):
                    yield _row([bucket, r["unit"], z.stop - z.start, _zip_sorted(h[z]), _zip(mask[z]), None, None], WANTED)

    return run


def _in_classes(mask: np.ndarray) -> np.ndarray:
    return ((mask[:, None] >> np.arange(CLASSES)) & 1).astype(bool)


def _found(batches):
    """Training counts and costs of the words that units want, from buckets that have their own words first (unit -1)."""
    now, parts, table = None, [], None
    for b in batches:
        for r in b.to_pylist():
            if r["bucket"] != now:
                now, parts, table = r["bucket"], [], None
            n, h = r["n"], _unzip_sorted(r["n"], r["hashes"])
            if r["unit"] < 0:
                parts.append((h, _unzip_counts(n, r["counts"]).astype(np.int64), _unzip((4 * CLASSES * n, r["cost"]), np.float32).reshape(n, CLASSES)))
                continue
            if table is None:
                table = [np.concatenate(x) for x in zip(*parts)]
                order = np.argsort(table[0])
                parts, table = [], [x[order] for x in table]
            at = np.searchsorted(table[0], h)
            cost = table[2][at][_in_classes(_unzip((n, r["mask"]), np.uint8))]
            yield _row([r["unit"], now, n, r["mask"], _zip_counts(table[1][at]), _zip(cost)], FOUND)


# ---- bits --------------------------------------------------------------------
def _bytes_of(word_bytes: np.ndarray, size: np.ndarray, cls: np.ndarray):
    """Bytes of items (each word and its closing space) and the hashed contexts of each byte."""
    n = size + 1
    end = np.cumsum(n) - 1
    value = np.empty(int(n.sum()), np.uint8)
    last = np.zeros(len(value), bool)
    last[end] = True
    value[last], value[~last] = 32, word_bytes
    item = np.repeat(np.arange(len(size)), n)
    place = np.arange(len(value)) - np.repeat(end - size, n)
    p, q = _power_tables(len(value) + 1)
    total = np.zeros(len(value) + 1, np.uint64)
    np.cumsum((value.astype(np.uint64) + np.uint64(1)) * p[: len(value)], out=total[1:])
    here = np.arange(len(value))
    ctx = []
    for k in (1, 2, 3, 4, None):
        a = here - (place if k is None else np.minimum(place, k))
        ctx.append(mix((total[here] - total[a]) * q[a] + np.uint64(k or 99)))
    ctx.append(mix(ctx[-1] + cls[item].astype(np.uint64) + np.uint64(7)))
    return value, item, place, ctx


def _once(value: np.ndarray, ctx: list):
    """Items that begin alike share their first bytes: the distinct bytes (with what stands before
    them) in the order of a hash, the number among these of every byte, and their contexts."""
    key = mix(ctx[-1] ^ ((value.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)))
    order = np.argsort(key)  # any of equal ones stands for all
    new = np.concatenate([[True], np.diff(key[order]) != 0])[: len(key)]
    first, number = order[new], np.empty(len(key), np.int64)
    number[order] = np.cumsum(new) - 1
    return value[first], number, [c[first] for c in ctx]


def _bits(value: np.ndarray):
    v = value.astype(np.int64)
    for bit in range(7, -1, -1):
        yield 7 - bit, (v | 256) >> (bit + 1), (v >> bit) & 1


BLOCKS = "block long, hashes binary, n_words int, counts binary, bytes binary, n_bytes int"
ASKED = "bucket int, block long, n int, pairs binary, seen binary"
ANSWERED = "block long, bucket int, n int, answer binary"


def _blocks(batches):
    """Rows of a vocabulary in blocks (one longer word is a block of its own): the more words, the more that begin alike."""
    from pyspark import TaskContext

    task, k, parts, size = TaskContext.get().partitionId(), 0, [], 0
    for b in batches:
        if not b.num_rows:
            continue
        word = b.column("word")
        off = np.frombuffer(word.buffers()[1], np.int32)[word.offset : word.offset + len(word) + 1].astype(np.int64)
        data = np.frombuffer(word.buffers()[2], np.uint8) if word.buffers()[2] is not None else np.zeros(0, np.uint8)
        mask = b.column("mask").to_numpy().astype(np.uint8)
        counts = np.column_stack([b.column(f"c{c}").to_numpy() for c in range(CLASSES)])
        h = b.column("h").to_numpy()
        done = np.cumsum((np.diff(off) + 1) * ((mask[:, None] >> np.arange(CLASSES)) & 1).sum(axis=1))
        at = 0
        while at < len(h):
            before = int(done[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(done, before + BLOCK_BYTES - size, "right")))
            parts.append((h[at:to], counts[at:to], np.diff(off[at : to + 1]).astype(np.int32), mask[at:to], data[off[at] : off[to]]))
            size, at = size + int(done[to - 1]) - before, to
            if size >= BLOCK_BYTES or at < len(h):
                yield _block((task << 24) + k, parts)
                k, parts, size = k + 1, [], 0
    if parts:
        yield _block((task << 24) + k, parts)


def _block(name: int, parts: list) -> pa.RecordBatch:
    h, counts, size, mask, text = (np.concatenate(x) for x in zip(*parts))
    body = np.concatenate([np.frombuffer(size.tobytes(), np.uint8), mask, text])
    row = [name, h.tobytes(), len(h), _zip_counts(counts), _zip(body), len(body)]
    return _row(row, BLOCKS)


def _items(r: dict):
    """Items of a block: word, class; training counts of words by class; bytes and sizes of items."""
    n = r["n_words"]
    counts = _unzip_counts(n * CLASSES, r["counts"]).astype(np.int64).reshape(n, CLASSES)
    body = _unzip((r["n_bytes"], r["bytes"]), np.uint8)
    size, mask = body[: 4 * n].view(np.int32).astype(np.int64), body[4 * n : 5 * n]
    row, cls = np.nonzero((mask[:, None] >> np.arange(CLASSES)) & 1)
    return row, cls, counts, body[5 * n :][_spread((np.cumsum(size) - size)[row], size[row])], size[row]


def _asked(every: np.ndarray, contexts: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of a context (upper 56 bits) and a byte, sorted; and of each predictor and byte its pair."""
    pairs = [(mix(c + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)) & ~np.uint64(255)) | every for k, c in enumerate(contexts)]
    pairs, where = np.unique(np.concatenate(pairs), return_inverse=True)
    return pairs, where.reshape(PREDICTORS, -1)


def _open(r: dict):
    """Items of a block, the number of the distinct byte of each of their bytes, distinct bytes, how
    often training saw them, the pairs that they ask for and where in these."""
    row, cls, counts, text, size = _items(r)
    value, item, _, ctx = _bytes_of(text, size, cls)
    every, number, contexts = _once(value, ctx)
    weight = np.bincount(number, counts[row, cls][item], len(every))
    return row, cls, counts, item, number, every, weight, *_asked(every, contexts)


def _ask(buckets: int):
    """What blocks saw of each pair, by bucket of contexts (their first bits)."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                *_, weight, pairs, where = _open(r)
                seen = np.bincount(where.ravel(), np.tile(weight, PREDICTORS), len(pairs)).astype(np.int64)
                for bucket, z in _cut(pairs, buckets):
                    yield _row([bucket, r["block"], z.stop - z.start, _zip_sorted(pairs[z]), _zip_counts(seen[z])], ASKED)

    return run


def _counted(pairs: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """For sorted distinct pairs: how often the byte followed the context, and for each of its bits
    how often the bits before it were followed by the other bit."""
    out = np.empty((9, len(pairs)), np.float32)
    before = None
    for bits in range(9):
        part = pairs >> np.uint64(8 - bits)
        first = np.concatenate([[True], part[1:] != part[:-1]])
        now = np.add.reduceat(seen, np.flatnonzero(first))[np.cumsum(first) - 1]
        if bits:
            out[bits] = before - now
        before = now
    out[0] = before
    return out


def _answer(batches):
    for t in groups(batches, ["bucket"]):
        n = t.column("n").to_numpy()
        asked = np.concatenate([_unzip_sorted(m, x.as_py()) for m, x in zip(n.tolist(), t.column("pairs"))])
        seen = np.concatenate([_unzip_counts(m, x.as_py()).astype(np.int64) for m, x in zip(n.tolist(), t.column("seen"))])
        pairs, where = np.unique(asked, return_inverse=True)
        counted = _counted(pairs, np.bincount(where, seen, len(pairs)).astype(np.int64))
        at = 0
        for m, block, bucket in zip(n.tolist(), t.column("block").to_pylist(), t.column("bucket").to_pylist()):
            yield _row([block, bucket, m, _zip_counts(counted[:, where[at : at + m]])], ANSWERED)
            at += m


def _told(batches):
    """Blocks with the answers to what they asked, in the order of buckets."""
    for t in groups(batches, ["block"]):
        t = t.sort_by("bucket")
        names = [x.split()[0] for x in BLOCKS.split(", ")]
        rest = t.slice(1)  # the block itself has bucket -1
        more = [pa.array([rest.column("n").to_pylist()], pa.list_(pa.int32())), pa.array([rest.column("answer").to_pylist()], pa.list_(pa.binary()))]
        yield pa.RecordBatch.from_arrays([*(t.column(c).slice(0, 1).combine_chunks() for c in names), *more], names=[*names, "n", "answer"])


GATES = 8 * 6 * 4


def _seen(n: np.ndarray, levels: int) -> np.ndarray:
    return np.minimum(np.log2(n + 1), levels - 1).astype(np.uint8)


def _said(r: dict, every: np.ndarray, learning: bool):
    """Of each bit of a block's distinct bytes, the last first: step, node, bit, and of every pair the
    log odds of the bit and how much its context has seen (while learning without one sighting)."""
    said = np.concatenate([_unzip_counts(9 * n, x).reshape(9, -1).astype(np.float32) for n, x in zip(r["n"], r["answer"])], axis=1)
    same = said[0].astype(np.float64)
    for step, node, y in reversed(list(_bits(every))):
        own, other = np.maximum(same - 1, 0) if learning else same, said[step + 1]
        yield step, node, y, np.log((own + PRIOR) / (other + PRIOR)).astype(np.float32), (own + other).astype(np.float32)
        same = same + other


def _inputs(odds: np.ndarray, seen: np.ndarray, where: np.ndarray, step: int, y: np.ndarray):
    """Log odds of every predictor in the order of their gates; that order; and (gate, from, to) of each."""
    gate = _seen(seen[where[4]], 6) * np.uint8(4) + _seen(seen[where[2]] / 4, 4)
    order = np.argsort(gate, kind="stable")
    cuts = np.concatenate([[0], np.cumsum(np.bincount(gate, minlength=24))]).tolist()
    sign, x = (2 * y[order] - 1).astype(np.float32), np.empty((len(y), PREDICTORS), np.float32)
    for k in range(PREDICTORS):
        x[:, k] = odds[where[k][order]] * sign
    return x, order, [(step * 24 + g, cuts[g], cuts[g + 1]) for g in range(24) if cuts[g] < cuts[g + 1]]


def _pieces(total: int, size: int):
    for a in range(0, total, size):
        yield slice(a, a + size)


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -14, 14)))


def _level(z: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(z * 2) + LEVELS // 2, 0, LEVELS - 1).astype(np.int64)


def _learn(batches):
    """Weights of every gate after the words of a task, in turn, with the evidence for each;
    and what bits followed each mixed probability."""
    w = np.full((GATES, PREDICTORS), 1.5 / PREDICTORS)
    curve = np.tile(np.eye(PREDICTORS), (GATES, 1, 1))  # what the words so far say of the weights
    seen, ridge = np.zeros((GATES, PREDICTORS)), 1e-3 * np.eye(PREDICTORS)
    after = np.zeros((256 * LEVELS, 2))
    for r in (r for b in batches for r in b.to_pylist()):
        *_, every, weight, _, where = _open(r)
        on = np.flatnonzero(weight)
        c, where = weight[on], where[:, on]
        for step, node, y, odds, amount in _said(r, every, True):
            node, y = node[on], y[on]
            for part in _pieces(len(on), LEARN_STEP):
                x, order, parts = _inputs(odds, amount, where[:, part], step, y[part])
                z, cs, ys = np.empty(len(x)), c[part][order], y[part][order]
                for gate, a, b in parts:
                    xs = x[a:b].astype(np.float64)
                    z[a:b] = xs @ w[gate]
                    p = _squash(z[a:b])
                    push, h = (cs[a:b] * (ys[a:b] - p)) @ xs, cs[a:b] * p * (1 - p)
                    curve[gate] = FORGET * curve[gate] + xs.T @ (xs * h[:, None]) + ridge
                    w[gate] = np.clip(w[gate] + np.linalg.solve(curve[gate], push), -8, 8)
                    seen[gate] += cs[a:b].sum()
                at = node[part][order] * LEVELS + _level(z)
                after += np.bincount(2 * at + ys, cs, after.size).reshape(after.shape)
    out = np.concatenate([(w * seen).ravel(), seen.ravel(), after.ravel()])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out)], names=["at", "v"])


def _predict(w: np.ndarray, after: np.ndarray, buckets: int):
    """Cost of each word in each class that it occurs in, and its training count, by bucket of words."""
    follow = after.sum(axis=1)

    def run(batches):
        for r in (r for b in batches for r in b.to_pylist()):
            row, cls, counts, item, number, every, _, _, where = _open(r)
            bits = np.zeros(len(every))
            for step, node, y, odds, amount in _said(r, every, False):
                for part in _pieces(len(every), STEP):
                    x, order, parts = _inputs(odds, amount, where[:, part], step, y[part])
                    z = np.empty(len(x))
                    for gate, f, t in parts:
                        z[order[f:t]] = x[f:t] @ w[gate]
                    p = _squash(z)
                    at = node[part] * LEVELS + _level(z)
                    p = (p + (after[at, 1] + MAP_PRIOR * p) / (follow[at] + MAP_PRIOR)) / 2
                    bits[part] += np.log10(np.where(y[part] == 1, p, 1 - p))
            cost = np.zeros((len(counts), CLASSES))
            cost[row, cls] = np.bincount(item, bits[number], len(row))
            h = np.frombuffer(r["hashes"], np.uint64)
            order = np.argsort(h)
            h, c, cost = h[order], counts.sum(axis=1)[order], cost.astype(np.float32)[order]
            for bucket, z in _cut(h, buckets):
                yield _row([bucket, -1, z.stop - z.start, _zip_sorted(h[z]), None, _zip_counts(c[z]), _zip(cost[z])], WANTED)

    return run


def _texts(total: int, distinct: int):
    def run(batches):
        for t in groups(batches, ["unit"]):
            r = {k: t.column(k)[0].as_py() for k in ("docs", "n_docs", "codes", "n_codes")}  # the unit itself has bucket -1
            d = _unzip((r["n_docs"] * 24, r["docs"]), np.int64).reshape(3, -1)
            code = _unzip((r["n_codes"] * 4, r["codes"]), np.int32)
            found = t.slice(1).select(["n", "mask", "counts", "cost"]).to_pylist()
            c = np.concatenate([_unzip_counts(x["n"], x["counts"]).astype(np.int64) for x in found])
            mask = _in_classes(np.concatenate([_unzip((x["n"], x["mask"]), np.uint8) for x in found]))
            base, known, cost = np.log10(c + 0.1) - np.log10(total + 0.1 * (distinct + 1)), c > 0, np.zeros(mask.shape)
            sizes = [int(m.sum()) for m in np.split(mask, np.cumsum([x["n"] for x in found])[:-1])]
            cost[mask] = np.concatenate([_unzip((4 * k, x["cost"]), np.float32) for k, x in zip(sizes, found)])
            at = np.concatenate([[0], np.cumsum(d[2])[:-1]])
            word = code // CLASSES
            sums = lambda x: np.add.reduceat(x, at) if len(at) else x
            size = np.maximum(sums(np.diff(np.concatenate([[0.0], np.cumsum(np.ones(len(code)))]))), 1)
            ids = pa.array(d[0], pa.int64(), mask=(d[1] & 2) > 0)
            score = sums(cost.ravel()[code])
            yield pa.RecordBatch.from_arrays([ids, pa.array((d[1] & 1) > 0), pa.array(d[2]), pa.array(sums(known[word].astype(np.int64))), pa.array(np.full(len(size), total)), pa.array(sums(base[word])), pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def language_scores(docs: DataFrame, parts: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text.

    base_score: log10 of the smoothed word frequencies; score: log10 of the model's
    probability (total bits are -score / log10(2)).  Null or empty text is its end alone.  The
    model learns from documents outside the held-out part, rows without doc_id among them.
    Repeated rows count and are scored each.
    """
    spark, n = prepare(docs.sparkSession), F.col
    rows = docs.select(n("doc_id").cast("long").alias("doc_id"), n("text").cast("string").alias("text"), held(n("doc_id"), parts).alias("held"))
    units = settle(rows.mapInArrow(_units, UNITS), "units")
    counts = [f"c{k}" for k in range(CLASSES)]
    shape = "h long, word binary, " + "".join(f"{c} long, " for c in counts) + "mask long"
    seen = units.select("hashes", "counts", "bytes", "n_bytes", "n_words").mapInArrow(_distinct, shape)
    vocabulary = settle(seen.groupBy("h").agg(F.first("word").alias("word"), *(F.sum(c).alias(c) for c in counts), F.bit_or("mask").alias("mask")), "vocabulary")
    c = sum(n(x) for x in counts)
    # bytes of items times predictors: as many pairs at most
    asks = PREDICTORS * (F.octet_length("word") + 1) * F.bit_count("mask")
    row = vocabulary.agg(F.sum(c).alias("n"), F.sum((c > 0).cast("long")).alias("v"), F.sum(asks).alias("asks"), F.count("*").alias("words")).first()
    total, distinct = int(row.n or 0), int(row.v or 0)
    buckets = max(BUCKETS, 1 << ((row.asks or 0) // BUCKET_ROWS).bit_length())
    shelves = max(BUCKETS, 1 << (row.words // BUCKET_WORDS).bit_length())
    blocks = settle(vocabulary.mapInArrow(_blocks, BLOCKS), "blocks")
    answers = dealt(blocks.mapInArrow(_ask(buckets), ASKED), "bucket").mapInArrow(_answer, ANSWERED)
    both = blocks.withColumn("bucket", F.lit(-1)).unionByName(answers, allowMissingColumns=True)
    told = settle(dealt(both, "block").mapInArrow(_told, f"{BLOCKS}, n array<int>, answer array<binary>"), "told")
    learned = told.mapInArrow(_learn, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(2 * GATES * PREDICTORS + 2 * 256 * LEVELS)
    for r in learned:
        flat[r["at"]] = r.v
    ws, seen = flat[: 2 * GATES * PREDICTORS].reshape(2, GATES, PREDICTORS)
    w = np.divide(ws, seen, out=np.full_like(ws, 1.5 / PREDICTORS), where=seen > 0)
    after = flat[2 * GATES * PREDICTORS :].reshape(-1, 2)
    costs = settle(told.mapInArrow(_predict(w, after, shelves), WANTED), "costs")
    wanted = units.select("unit", "hashes", "counts", "n_words").mapInArrow(_wanted(shelves), WANTED)
    found = costs.unionByName(wanted).repartition(width(spark), "bucket").sortWithinPartitions("bucket", "unit").mapInArrow(_found, FOUND)
    heads = units.select("unit", F.lit(-1).alias("bucket"), "docs", "n_docs", "codes", "n_codes")
    both = heads.unionByName(found, allowMissingColumns=True).repartition(width(spark), "unit").sortWithinPartitions("unit", "bucket")
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return both.mapInArrow(_texts(total, distinct), out)
