"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

A text is encoded by tokenizer A (a byte-level ``.json``, of a space and the text) and by
tokenizer B (a sentencepiece ``.model``, which puts that space itself); tokens are byte ranges.

Method: interval coalescing, for all documents of a chunk at once.  All A and B tokens are
lexsorted by start, the ends are accumulated by their maximum, and a group breaks where a start
reaches the running maximum: there A and B both ended.  Within groups overlaps are expanded: a
token of A is linked with the run of B tokens from the first that ends after its start to the
last that starts before its end, so no pair is tried in vain.

How many documents hold a pair of ids linked is counted over the whole corpus.  Documents are
gathered in chunks of about ``LINKS`` links; a chunk stores its distinct pairs once, and its
documents as numbers of them.  Only the chunk's distinct pairs, with how many of its documents
hold them, are shuffled: once to be summed, once to meet the sums, once back to their chunk.

Scale: nothing is broadcast or collected; a chunk is bounded by ``LINKS`` and its longest
document; a pair that every document holds is one row a chunk.  The sums of one A id are at
most as many rows as B has ids.

Defined results: null and empty texts, and texts whose joined tokens differ from space + text
(a text with U+2581, say) have no tokens: zeros and ''.  Every row is a document of its own,
also if its doc_id is null or repeated; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import chunks, prepare, settle
from .packing import encoder

#: Links after which a chunk of documents is closed.
LINKS = 1 << 21


# ---- token bytes -------------------------------------------------------------
def byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: printable ones stand for
    themselves, the others for the letters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(rest)}}


@functools.lru_cache(2)
def byte_level(path: str) -> list[bytes]:
    """Bytes of every id of a byte-level vocabulary."""
    from tokenizers import Tokenizer

    letters = byte_letters()
    names = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    out = [b""] * (max(names.values()) + 1)
    for name, i in names.items():
        out[i] = bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode()
    return out


@functools.lru_cache(2)
def pieces(path: str):
    """The encoder of a sentencepiece model, and the bytes of every id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.get_piece_size()):
        name = model.id_to_piece(i)
        byte = re.fullmatch("<0x([0-9A-Fa-f]{2})>", name)
        out.append(bytes([int(byte[1], 16)]) if byte else name.replace("▁", " ").encode())
    return model.encode, out


# ---- alignment of a chunk ----------------------------------------------------
def coalesce(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Group of every interval: intervals that overlap, also through others, share one.
    Groups are numbered by place; intervals are not empty."""
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    new = np.ones(len(order), bool)
    new[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return group


def overlaps(start: np.ndarray, end: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (a, b) of all overlapping pairs; both sides are sorted and overlap not themselves."""
    low = np.searchsorted(end_b, start, "right")
    many = np.maximum(np.searchsorted(start_b, end, "left") - low, 0)
    a = np.repeat(np.arange(len(start)), many)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)


@functools.lru_cache(2)
def _written(ids: int) -> list[bytes]:
    """Ids in decimal after nothing, a comma, a semicolon and a bar."""
    return [before + str(i).encode() for before in (b"", b",", b";", b"|") for i in range(ids)]


class _Chunk:
    """Tokens of documents, gathered; ``row`` aligns them all."""

    def __init__(self, number: int) -> None:
        self.number, self.docs, self.tokens, self.a, self.b = number, [], 0, [], []

    def add(self, doc, a: np.ndarray, b: np.ndarray) -> None:
        self.docs.append(doc)
        self.a.append(a)
        self.b.append(b)
        self.tokens += len(a) + len(b)

    def row(self, size_a: np.ndarray, size_b: np.ndarray, with_groups: bool) -> dict:
        d = len(self.docs)
        n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (self.a, self.b))
        a, b = np.concatenate(self.a).astype(np.int64), np.concatenate(self.b).astype(np.int64)
        end_a, end_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
        start_a, start_b = end_a - size_a[a], end_b - size_b[b]
        group = coalesce(np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b]))
        doc_a, doc_b = np.repeat(np.arange(d), n_a), np.repeat(np.arange(d), n_b)
        # a document's groups are those of its A tokens, which follow each other
        first = np.ones(len(a), bool)
        first[1:] = group[1 : len(a)] != group[: max(len(a) - 1, 0)]
        n_groups = np.bincount(doc_a[first], minlength=d)
        # the groups as text: all tokens by group, A before B
        side = np.repeat([0, 1], [len(a), len(b)])
        order = np.argsort(group * 2 + side, kind="stable")
        g, s, token, doc = group[order], side[order], np.concatenate([a, b])[order], np.concatenate([doc_a, doc_b])[order]
        sign = np.ones(len(order), np.int64)
        sign[1:][s[1:] != s[:-1]] = 3
        sign[1:][g[1:] != g[:-1]] = 2
        sign[:1] = 0
        sign[1:][doc[1:] != doc[:-1]] = 0
        ids = max(len(size_a), len(size_b))
        written, cuts = _written(ids), np.concatenate([[0], np.cumsum(n_a + n_b)])
        code = sign * ids + token
        digests, groups = [], []
        for k in range(d):
            text = b"".join(map(written.__getitem__, code[cuts[k] : cuts[k + 1]].tolist()))
            digests.append(hashlib.sha256(text).hexdigest() if text else "")
            if with_groups:
                groups.append(text.decode())
        # links as numbers of the chunk's distinct pairs, and per document how often it has each
        x, y = overlaps(start_a, end_a, start_b, end_b)
        pairs, pair = np.unique(a[x] << 32 | b[y], return_inverse=True)
        own, often = np.unique(doc_a[x] * max(len(pairs), 1) + pair, return_counts=True)
        owner, pair = np.divmod(own, max(len(pairs), 1))
        return {
            "chunk": self.number, "doc_id": self.docs, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": np.bincount(doc_a[x], minlength=d), "groups_sha256": digests,
            "groups": groups if with_groups else None, "n_pairs": np.bincount(owner, minlength=d), "pair": pair.astype("<i4").tobytes(), "often": often.astype("<i4").tobytes(),
            "pairs": pairs, "n_docs": np.bincount(pair, minlength=len(pairs)),
        }


_LONGS = pa.list_(pa.int64())
_CHUNK = pa.schema({
    "chunk": pa.int64(), "doc_id": _LONGS, "n_a": _LONGS, "n_b": _LONGS, "n_groups": _LONGS, "n_links": _LONGS, "groups_sha256": pa.list_(pa.string()),
    "groups": pa.list_(pa.string()), "n_pairs": _LONGS, "pair": pa.binary(), "often": pa.binary(), "pairs": _LONGS, "n_docs": _LONGS,
})
_CHUNK_SQL = "chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, groups array<string>, n_pairs array<long>, pair binary, often binary, pairs array<long>, n_docs array<long>"


def _align(path_a: str, path_b: str, with_groups: bool):
    def run(batches):
        from pyspark import TaskContext

        encode_a, bytes_a = encoder(path_a), byte_level(path_a)
        encode_b, bytes_b = pieces(path_b)
        size_a, size_b = (np.array([len(x) for x in side], np.int64) for side in (bytes_a, bytes_b))
        none = np.zeros(0, np.int64)
        number = TaskContext.get().partitionId() << 32
        chunk = _Chunk(number)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([chunk.row(size_a, size_b, with_groups)], _CHUNK)

        for batch in chunks(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                a = b = none
                if text:
                    whole = f" {text}"
                    a, b = encode_a(whole), np.array(encode_b(text), np.int64)
                    whole = whole.encode()
                    if b"".join(map(bytes_a.__getitem__, a.tolist())) != whole or b"".join(map(bytes_b.__getitem__, b.tolist())) != whole:
                        a = b = none
                chunk.add(doc, a, b)
                if chunk.tokens >= LINKS:
                    yield row()
                    number += 1
                    chunk = _Chunk(number)
        if chunk.docs:
            yield row()

    return run


def _finish(with_groups: bool):
    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        out = []
        place = counts.column("place").to_numpy()
        held, best = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
        held[place], best[place] = counts.column("total").to_numpy(), counts.column("best").to_numpy(zero_copy_only=False)
        for row in docs.drop_columns(["pair", "often"]).to_pylist():
            pair, often = (np.frombuffer(docs.column(c)[0].as_py(), "<i4") for c in ("pair", "often"))
            owner = np.repeat(np.arange(len(row["doc_id"])), row["n_pairs"])
            size = len(row["doc_id"])
            sums, n_best = np.zeros(size, np.int64), np.zeros(size, np.int64)
            np.add.at(sums, owner, held[pair] * often)
            np.add.at(n_best, owner, best[pair] * often.astype(np.int64))
            cols = {k: pa.array(row[k], pa.int64()) for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
            cols |= {"n_best": pa.array(n_best), "count_sum": pa.array(sums), "groups_sha256": pa.array(row["groups_sha256"], pa.string())}
            if with_groups:
                cols["groups"] = pa.array(row["groups"], pa.string())
            out.append(pa.table(cols))
        return pa.concat_tables(out)

    return run


# ---- plan --------------------------------------------------------------------
def _chunks(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False) -> DataFrame:
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return settle(docs.mapInArrow(_align(path_a, path_b, with_groups), _CHUNK_SQL), "aligned")


def _held(chunk: DataFrame) -> DataFrame:
    """chunk, place, pair, n_docs: one row for each distinct pair of a chunk."""
    rows = chunk.select("chunk", F.posexplode(F.arrays_zip("pairs", "n_docs")).alias("place", "x"))
    return rows.select("chunk", "place", F.col("x.pairs").alias("pair"), F.col("x.n_docs").alias("n_docs"))


def _totals(held: DataFrame) -> DataFrame:
    """pair, total, best: documents that hold a pair linked, and whether no other pair of its
    A id has more."""
    n = F.col
    totals = settle(held.groupBy("pair").agg(F.sum("n_docs").alias("total")), "pairs")
    most = totals.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("total").alias("most"))
    return totals.withColumn("a", F.shiftright("pair", 32)).join(most, "a").select("pair", "total", (n("total") == n("most")).alias("best"))


def pair_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """a_id, b_id, n_docs, best of every pair of ids that some document holds linked."""
    n = F.col
    totals = _totals(_held(_chunks(docs, path_a, path_b)))
    return totals.select(F.shiftright("pair", 32).alias("a_id"), n("pair").bitwiseAND((1 << 32) - 1).alias("b_id"), n("total").alias("n_docs"), "best")


def alignments(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and groups, the
    text ``a1,a2|b1;a3|b2,b3``): one row a document."""
    chunk = _chunks(docs, path_a, path_b, with_groups)
    held = _held(chunk)
    counts = held.select("chunk", "place", "pair").join(settle(_totals(held), "totals"), "pair").select("chunk", "place", "total", "best")
    docs = chunk.drop("pairs", "n_docs").withColumn("of", F.col("chunk") + 0).drop("chunk")
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + ", groups string" * with_groups
    return docs.groupBy("of").cogroup(counts.groupBy("chunk")).applyInArrow(_finish(with_groups), out)
