"""Repair of conversation structure: cheapest edits that make a conversation alternate.

A conversation is sound if its role initials read ``(s?(ua)+)?``.  Every row is kept (0),
given another role (user or assistant, 1) or deleted (2; blank rows and rows seen before must
go); rows with an empty text may be inserted anywhere (5); a truncated row that stays costs 5
more.  Of the cheapest edits the one whose letters (D, I, K, R) sort first is taken.

Method: Four-Russians tables.  A row is one of nine symbols (initial and truncation, or "must
go").  What is still to be paid from each of the four states (start, after s, after u, after a)
is a vector; less its smallest entry only about twenty vectors occur, because inserting bounds
how far states can differ.  For each of these vectors and each block of four symbols the table
holds the vector before the block and the cost added, so blocks are handled by one lookup each,
from the end of the conversation to its start.  Then every block is expanded backward from the
vector on its right, which gives the costs at every row; on them the letters are read from the
start, the least letter that still leads to the cheapest total first.  State changes of rows
are functions of four states, composed for all rows of a batch at once.

Scale: equal rows are counted before they are shuffled, so a row that is repeated millions of
times is one entry.  Entries are range partitioned by (conversation, turn, role, start of the
text), so a conversation of any length is sorted in many tasks.  Texts seen before are found by
an aggregation over digests.  Then only a few bytes a row go to the task of their conversation,
as a stream of which one byte a row is held: as much as the ``audit`` cell of the result itself
takes.  The digest of the repaired text is sequential by definition; it is a stream as well, of
which one row and the audit are held.

Defined results: null role, text or part of the key counts as one space; a null conv_id is a
conversation of its own; rows are taken by turn (null first), then role, then text (bytes), so
rows with equal turns have a fixed order; equal rows follow each other; an initial other than
s, u or a (also of an empty role) can only be given another role or deleted.  Without rows:
zeros, empty audit.  Other columns are ignored.  Turns are counted in 64 bits (a span beyond
that wraps).
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import prepare, settle, width

#: Costs of the edits, and the penalty of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States, and the state that a row of the only fitting role (u or a) leads to.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
FITTING = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
#: Symbols: initial (s, u, a, other) + 4 if truncated, then rows that must go, then padding.
GONE, PAD, SYMBOLS = 8, 9, 10
#: Rows of a block, and rows of a very long conversation that are expanded at a time.
BLOCK, PIECE = 4, 1 << 16
#: Pairs of initials (s, u, a, other) that may follow each other.
LEGAL = np.zeros((5, 5), bool)
LEGAL[[0, 1, 2], [1, 2, 1]] = True
LEGAL[4] = True  # nothing before


# ---- tables ------------------------------------------------------------------
def _edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """Letter, cost and next state of all edits of a row but insertion, in order of letters."""
    if symbol == PAD:
        return [("", 0, state)]
    out = [("D", DELETE, state)]
    if symbol != GONE:
        extra = TRUNCATED * (symbol // 4)
        follows = {0: AFTER_S if state == START else None, 1: AFTER_U if state != AFTER_U else None, 2: AFTER_A if state == AFTER_U else None}
        kept = follows.get(symbol % 4)
        if kept is not None:
            out.append(("K", KEEP + extra, kept))
        out.append(("R", REROLE + extra, FITTING[state]))
    return out


def _with_insertions(cost: list[int]) -> list[int]:
    for _ in range(4):
        cost = [min(c, INSERT + cost[FITTING[q]]) for q, c in enumerate(cost)]
    return cost


def _before(after: tuple[int, ...], symbol: int) -> list[int]:
    return _with_insertions([min(c + after[n] for _, c, n in _edits(symbol, q)) for q in range(4)])


class Tables:
    """Vectors (the first is that of the end), steps of one symbol, steps of a block, letters."""

    def __init__(self) -> None:
        far = 1 << 20  # not an end
        end = tuple(_with_insertions([0, far, far, 0]))
        self.vectors, at = [end], {end: 0}
        step, add = [], []
        for v in self.vectors:  # grows while it is read
            row, cost = [], []
            for symbol in range(SYMBOLS):
                h = _before(v, symbol)
                low = min(h)
                h = tuple(x - low for x in h)
                if h not in at:
                    at[h] = len(self.vectors)
                    self.vectors.append(h)
                row.append(at[h])
                cost.append(low)
            step.append(row)
            add.append(cost)
        self.step, one = np.array(step, np.int16), np.array(add, np.int16)
        self.start = np.array([v[START] for v in self.vectors], np.int64)
        # blocks: the last symbol is met first
        to, cost = self.step, one
        for _ in range(BLOCK - 1):
            mid = to  # (vector, later symbols)
            to = self.step[mid].transpose(0, 2, 1).reshape(len(self.vectors), -1)
            cost = (cost[:, :, None] + one[mid]).transpose(0, 2, 1).reshape(len(self.vectors), -1)
        self.block, self.added = to, cost
        # letters of a row, given the vector on its right and the state on its left
        self.words: list[str] = []
        self.word = np.zeros((len(self.vectors), SYMBOLS, 4), np.int16)
        self.next = np.zeros((len(self.vectors), SYMBOLS, 4), np.int8)
        for i, v in enumerate(self.vectors):
            for symbol in range(SYMBOLS):
                h = _before(v, symbol)
                for q in range(4):
                    letters, at_state = "", q
                    while True:
                        ways = [(x, n) for x, c, n in _edits(symbol, at_state) if c + v[n] == h[at_state]]
                        if INSERT + h[FITTING[at_state]] == h[at_state] and symbol != PAD:
                            ways.append(("I", None))
                        letter, n = min(ways, key=lambda w: w[0])
                        letters += letter
                        if n is not None:
                            break
                        at_state = FITTING[at_state]
                    if letters not in self.words:
                        self.words.append(letters)
                    self.word[i, symbol, q], self.next[i, symbol, q] = self.words.index(letters), n
        self.tail = ["", "II", "I", ""]


@functools.cache
def tables() -> Tables:
    return Tables()


# ---- cheapest edits ----------------------------------------------------------
def _blocks(symbols: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of every conversation, padded to whole blocks, and its first block."""
    size = np.diff(off)
    first = np.concatenate([[0], np.cumsum(-(-size // BLOCK))])
    padded = np.full(first[-1] * BLOCK, PAD, np.uint8)
    padded[np.arange(len(symbols)) + np.repeat(first[:-1] * BLOCK - off[:-1], size)] = symbols
    return padded.reshape(-1, BLOCK), first


def lookups(padded: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vector on the right of every block, and per conversation the vector before its first
    row and the cost added; ``end`` is the vector behind its last row."""
    t = tables()
    code = padded.astype(np.int32) @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    right = np.zeros(len(padded), np.int16)
    v, cost = end[order].copy(), np.zeros(len(count), np.int64)
    many = count[order]
    # the r-th block from the end of all conversations that have so many
    for r in range(int(many[0]) if len(many) else 0):
        m = int(np.searchsorted(-many, -r, "left"))
        b = first[1:][order[:m]] - 1 - r
        right[b] = v[:m]
        cost[:m] += t.added[v[:m], code[b]]
        v[:m] = t.block[v[:m], code[b]]
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return right, v[back], cost[back]


def expand(padded: np.ndarray, first: np.ndarray, right: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the letters of every (padded) row, and the last state of every conversation."""
    t = tables()
    h = np.empty(padded.shape, np.int16)
    h[:, -1] = right
    for j in range(BLOCK - 1, 0, -1):
        h[:, j - 1] = t.step[h[:, j], padded[:, j]]
    h, symbol = h.reshape(-1), padded.reshape(-1)
    follow = t.next[h, symbol]
    size = np.diff(first) * BLOCK
    some = size > 0
    head = (first[:-1] * BLOCK)[some]
    follow[head] = follow[head, state[some]][:, None]  # the first row starts from a known state
    d = 1
    while d < (int(size.max()) if len(size) else 0):
        follow[d:] = np.take_along_axis(follow[d:], follow[:-d], 1)
        d *= 2
    after = follow[:, 0]
    before = np.empty(len(after), np.int8)
    before[1:] = after[:-1]
    before[head] = state[some]
    last = state.copy()
    last[some] = after[(first[1:] * BLOCK)[some] - 1]
    return t.word[h, symbol, before], last


def audits(conversations: list[np.ndarray]) -> list[tuple[int, str]]:
    """Cost and letters of the cheapest edits of every conversation (its symbols)."""
    t = tables()
    out: list[tuple[int, str]] = [(0, "")] * len(conversations)
    short = [i for i, c in enumerate(conversations) if len(c) <= PIECE]
    off = np.concatenate([[0], np.cumsum([len(conversations[i]) for i in short])]).astype(np.int64)
    padded, first = _blocks(np.concatenate([conversations[i] for i in short]) if short else np.zeros(0, np.uint8), off)
    right, v, cost = lookups(padded, first, np.zeros(len(short), np.int16))
    word, last = expand(padded, first, right, np.zeros(len(short), np.int8))
    for k, i in enumerate(short):
        letters = word[first[k] * BLOCK : first[k + 1] * BLOCK].tolist()
        out[i] = int(cost[k] + t.start[v[k]]), "".join(map(t.words.__getitem__, letters)) + t.tail[last[k]]
    for i, c in enumerate(conversations):
        if len(c) > PIECE:
            cuts = [(a, min(a + PIECE, len(c))) for a in range(0, len(c), PIECE)]
            total, v, behind = 0, np.zeros(1, np.int16), {}
            for a, b in reversed(cuts):
                behind[a] = v
                _, v, cost = lookups(*_blocks(c[a:b], np.array([0, b - a])), v)
                total += int(cost[0])
            total += int(t.start[v[0]])
            state, parts = np.zeros(1, np.int8), []
            for a, b in cuts:
                padded, first = _blocks(c[a:b], np.array([0, b - a]))
                word, state = expand(padded, first, lookups(padded, first, behind[a])[0], state)
                parts.append("".join(map(t.words.__getitem__, word.tolist())))
            out[i] = total, "".join(parts) + t.tail[state[0]]
    return out


# ---- streams -----------------------------------------------------------------
_SUMS = ("blank", "duplicate", "truncated", "illegal", "turns")
_HALF = 1 << 63


def _audit(batches):
    """Rows sorted by (key, at) -> one row a key; of an open conversation sums and symbols stay."""
    held = None  # key, sums, least turn, largest turn, symbols, last (turn or None, initial)

    def close(closed):
        found = audits([np.concatenate(c[4]) if c[4] else np.zeros(0, np.uint8) for c in closed])
        sums = np.array([c[1] for c in closed], np.int64)
        gaps = [(c[3] - c[2] + 1 - int(s[4]) + _HALF) % (2 * _HALF) - _HALF if s[4] else 0 for c, s in zip(closed, sums)]
        cols = {"key": pa.array([c[0] for c in closed]), "gaps": pa.array(gaps, pa.int64())}
        cols |= {k: pa.array(sums[:, j]) for j, k in enumerate(_SUMS[:4])}
        return pa.RecordBatch.from_pydict(cols | {"cost": pa.array([c for c, _ in found], pa.int64()), "audit": pa.array([a for _, a in found], pa.string())})

    for b in batches:
        n = b.num_rows
        if not n:
            continue
        key = b.column("key")
        turn, has, many, symbol, initial = (pc.cast(b.column(c), pa.int64()).to_numpy() for c in ("turn", "has_turn", "many", "symbol", "initial"))
        new = np.ones(n, bool)
        new[1:] = pc.not_equal(key.slice(1), key.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new[0] = held is None or held[0] != key[0].as_py()
        before = held[5] if held else (0, 0, 4)  # turn, whether it has one, initial
        old_turn, old_has, old_initial = (np.concatenate([[x], c[:-1]]) for x, c in zip(before, (turn, has, initial)))
        real = many > 0
        more = np.where(real, many - 1, 0)
        sums = np.stack([
            np.where(symbol == 9, many, 0),
            np.where(symbol == 9, 0, more + (symbol == 8)),
            real & (symbol >= 4) & (symbol < 8),
            np.where(real & ~new & ~LEGAL[old_initial, initial], 1, 0) + more,
            real & (has > 0) & (new | (old_has == 0) | (old_turn != turn)),
        ], 1).astype(np.int64)
        heads = np.flatnonzero(new) if new[0] else np.concatenate([[0], np.flatnonzero(new)])
        ends = np.append(heads[1:], n)
        sums = np.add.reduceat(sums, heads, 0)
        low = np.minimum.reduceat(np.where(has > 0, turn, np.iinfo(np.int64).max), heads)
        high = np.maximum.reduceat(np.where(has > 0, turn, np.iinfo(np.int64).min), heads)
        rows = np.repeat(np.arange(n), many)
        symbols = np.minimum(symbol, GONE).astype(np.uint8)[rows]
        symbols[1:][rows[1:] == rows[:-1]] = GONE
        upto = np.concatenate([[0], np.cumsum(many)])
        closed = []
        for k, (a, e) in enumerate(zip(heads, ends)):
            mine = symbols[upto[a] : upto[e]]
            if new[a]:
                if held:
                    closed.append(held)
                held = [key[int(a)].as_py(), sums[k], int(low[k]), int(high[k]), [mine], None]
            else:
                held = [held[0], held[1] + sums[k], min(held[2], int(low[k])), max(held[3], int(high[k])), [*held[4], mine], None]
        held[5] = int(turn[-1]), int(has[-1]), int(initial[-1])
        if closed:
            yield close(closed)
    if held:
        yield close([held])


def _apply(batches, with_rows: bool):
    """Audits and rows sorted by (key, at), the audit first -> digest a key, or repaired rows."""
    role_of = {"s": AFTER_S, "u": AFTER_U, "a": AFTER_A}
    key = audit = None
    at = state = place = 0
    digest = hashlib.sha256()
    out: list[tuple] = []

    def put(edit: str, role: str, text: str) -> None:
        nonlocal place
        if with_rows:
            out.append((key, place, edit, role, text))
        else:
            digest.update((("\n" if place else "") + f"{role}:{text}").encode())
        place += 1

    def insertions() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state = FITTING[state]
            put("I", "user" if state == AFTER_U else "assistant", "")
            at += 1

    def finish() -> None:
        if key is not None:
            insertions()
            if not with_rows:
                out.append((key, digest.hexdigest()))

    names = ("key", "place", "edit", "role", "text") if with_rows else ("key", "repaired_sha256")
    types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()) if with_rows else (pa.string(), pa.string())

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out)) or [()] * len(names)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=list(names))

    for b in batches:
        for k, letters, many, role, text in zip(*(b.column(c).to_pylist() for c in ("key", "audit", "many", "role", "text"))):
            if letters is not None:
                finish()
                key, audit, at, state, place, digest = k, letters, 0, START, 0, hashlib.sha256()
                continue
            for _ in range(many):
                insertions()
                edit = audit[at]
                at += 1
                if edit == "K":
                    state = role_of[role[0]]
                    put("K", role, text)
                elif edit == "R":
                    state = FITTING[state]
                    put("R", "user" if state == AFTER_U else "assistant", text)
        yield flush()
    finish()
    yield flush()


# ---- plan --------------------------------------------------------------------
def _text(c: str | Column) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the contract's damage by crc32(``conv_id:turn``) % 20."""
    n = F.col
    rows = conversations.select("conv_id", n("turn").cast("long").alias("turn"), _text("role").alias("role"), _text("text").alias("text"))
    rows = rows.withColumn("fate", F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn")).cast("binary")) % 20).where("fate <> 0")
    text = F.when(n("fate") == 1, "").when(n("fate") == 2, F.translate("text", ".!?", "")).otherwise(n("text"))
    rows = rows.select("conv_id", "turn", F.when(n("fate") == 4, "user").otherwise(n("role")).alias("role"), text.alias("text"), F.when(n("fate") == 3, 2).otherwise(1).alias("copies"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy")


def _placed(rows: DataFrame) -> DataFrame:
    """Distinct rows of every conversation in their order ``at``, with how many there are."""
    n = F.col
    key = F.coalesce(F.concat(F.lit("="), n("conv_id").cast("string")), F.lit(""))
    rows = rows.select(key.alias("key"), "conv_id", n("turn").cast("long").alias("turn"), _text("role").alias("role"), _text("text").alias("text"))
    rows = rows.groupBy("key", "conv_id", "turn", "role", "text").agg(F.count("*").alias("many"))
    order = ["key", "turn", "role", "text"]
    rows = rows.repartitionByRange("key", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions(*order)
    return settle(rows.withColumn("at", F.monotonically_increasing_id()), "turns")


def _audited(placed: DataFrame, ids: DataFrame) -> DataFrame:
    """key, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation."""
    n = F.col
    solid = r"[^\x20\x09-\x0D]"
    blank = ~n("text").rlike(solid)
    ends = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    initial = F.substring("role", 1, 1)
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    rows = placed.select(
        "key", "at", "turn", "many", number.alias("initial"), blank.alias("blank"), (~ends.isin(".", "!", "?")).alias("cut"),
        F.when(~blank, F.concat("role", F.lit(":"), F.md5(n("text").cast("binary")))).alias("digest"),
    )
    # texts that a conversation has at several turns: a short list, however often they are repeated
    seen = settle(rows.where("digest is not null").groupBy("key", "digest").agg(F.min("at").alias("first"), F.count("*").alias("k")).where("k > 1").drop("k"), "seen")
    rows = rows.join(seen, ["key", "digest"], "left").withColumn("again", F.coalesce(n("at") > n("first"), F.lit(False)))
    symbol = F.when(n("blank"), 9).when(n("again"), GONE).otherwise(n("initial") + F.when(n("cut"), 4).otherwise(0))
    rows = rows.select(
        "key", "at", F.coalesce("turn", F.lit(0)).cast("long").alias("turn"), n("turn").isNotNull().cast("int").alias("has_turn"),
        "many", symbol.cast("int").alias("symbol"), n("initial").cast("int").alias("initial"),
    )
    marks = ids.select("key", *(F.lit(v).cast(t).alias(c) for c, v, t in (("at", -1, "long"), ("turn", 0, "long"), ("has_turn", 0, "int"), ("many", 0, "long"), ("symbol", PAD, "int"), ("initial", 4, "int"))))
    rows = rows.unionByName(marks).repartition(width(placed.sparkSession), "key").sortWithinPartitions("key", "at")
    return settle(rows.mapInArrow(_audit, "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"), "audits")


def _ids(df: DataFrame) -> DataFrame:
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    return df.select(key.alias("key"), "conv_id").distinct()


def _stream(placed: DataFrame, audited: DataFrame) -> DataFrame:
    n = F.col
    marks = audited.select("key", F.lit(-1).cast("long").alias("at"), "audit", F.lit(0).cast("long").alias("many"), F.lit("").alias("role"), F.lit("").alias("text"))
    rows = placed.select("key", "at", F.lit(None).cast("string").alias("audit"), "many", "role", "text")
    return rows.unionByName(marks).repartition(width(placed.sparkSession), "key").sortWithinPartitions("key", n("at"))


def repaired_rows(rows: DataFrame) -> DataFrame:
    """conv_id, place, edit (K, R or I), role, text: the repaired conversations."""
    prepare(rows.sparkSession)
    ids, placed = settle(_ids(rows), "ids"), _placed(rows)
    out = _stream(placed, _audited(placed, ids)).mapInArrow(functools.partial(_apply, with_rows=True), "key string, place long, edit string, role string, text string")
    return out.join(ids, "key").select("conv_id", "place", "edit", "role", "text")


def repair(rows: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of
    every conversation in ``rows`` and in ``of`` (a table with further conv_ids)."""
    prepare(rows.sparkSession)
    ids = settle(_ids(rows if of is None else of.select("conv_id").unionByName(rows.select("conv_id"))), "ids")
    placed = _placed(rows)
    audited = _audited(placed, ids)
    digests = _stream(placed, audited).mapInArrow(functools.partial(_apply, with_rows=False), "key string, repaired_sha256 string")
    return ids.join(audited, "key").join(digests, "key").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
