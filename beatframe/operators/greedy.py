"""Greedy selections, without one list per run of interacting rows.

Two forms cover them.

*Chains* (:func:`walk`): which row is taken next depends only on the row taken last and a
bounded stretch behind it.  Every row then has one successor, whoever visits it, so the
selection is a path through a forest.  In a segment that is cut into chunks each chunk tells
for every row at which a path may enter (those within reach of its start) where that path
leaves it; these summaries are chained, and each chunk marks its own part of the path.

*Rounds* (:func:`in_rounds`): rows are decided in an order of priority, and a decision depends
on the rows in conflict that come before.  Each chunk sees its own rows and all that may be in
conflict with them, and decides what it can; a row whose predecessors a neighbouring chunk has
yet to decide waits for the next round.  The first undecided row of all can always be decided,
so rounds end; a chain of conflicts within a chunk needs one round, however long it is.

Neither keeps more than a chunk (and its reach) in a task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.kernels import DROPPED, UNDECIDED
from .layout import Layout, settle
from .peaks import arrow_groups

Successor = Callable[[dict], tuple[np.ndarray, np.ndarray]]


# ---- chains --------------------------------------------------------------------
def _path(after: np.ndarray, kept: np.ndarray, at: int, end: int) -> list[int]:
    """Kept rows of the path from row ``at``, as far as it stays before row ``end``."""
    follow, keep, out = after.tolist(), kept.tolist(), []
    while 0 <= at < end:
        if keep[at]:
            out.append(at)
        at = follow[at]
    return out


def walk(rows: DataFrame, keys: list[str], lay: Layout, reach: int, successor: Successor) -> DataFrame:
    """``keys, idx`` of the rows that a greedy scan from each key's first row keeps.

    ``successor(columns)`` gets rows in order of ``idx`` and returns, per row, the row that
    follows if it is visited (-1: one beyond those shown) and whether it is kept then.  A
    successor is decided by rows at most ``reach`` positions ahead; if none of them qualifies,
    it is the first row after them.
    """
    if not lay.long:
        def whole(c):
            after, kept = successor(c)
            return {"idx": c["idx"][_path(after, kept, 0, len(after))]}

        return arrow_groups(rows, keys, keys, [("idx", "int")], whole)
    rows, _, group = lay.frame(settle(rows), keys, reach)
    rows = settle(rows.withColumn("_from", F.col("_chunk") * lay.size))

    def ahead(c):
        core = np.flatnonzero(c["_core"].astype(bool))
        if not core.size:
            return None, 0
        return {k: v[core[0]:] for k, v in c.items()}, core.size

    def summary(c):
        c, n = ahead(c)
        if not n:
            return {}
        after, _ = successor(c)
        idx, start = c["idx"].astype(np.int64), int(c["_from"][0])
        here = np.arange(len(idx))
        to = np.where((here < n) & (after >= 0), after, here)
        while True:  # every row to the end of its path, twice as far each time
            far = to[to]
            if np.array_equal(far, to):
                break
            to = far
        leave = np.where(to >= n, idx[to], start + lay.size + reach)
        many = min(n, int(np.searchsorted(idx[:n], start + reach)) + 1)
        return {"idx": idx[:many], "leave": leave[:many], "_from": np.full(many, start)}

    def chain(c):
        out, at = {"_chunk": [], "enter": []}, -1
        cuts = np.flatnonzero(np.diff(c["_from"], prepend=-1, append=-1))
        for a, b in zip(cuts[:-1], cuts[1:]):
            j = a + int(np.searchsorted(c["idx"][a:b], at))
            if j < b:
                out["_chunk"].append(int(c["_from"][a]) // lay.size)
                out["enter"].append(int(c["idx"][j]))
                at = int(c["leave"][j])
        return out

    def mark(c):
        c, n = ahead(c)
        if not n:
            return {}
        after, kept = successor(c)
        return {"idx": c["idx"][_path(after, kept, int(np.searchsorted(c["idx"], c["enter"][0])), n)]}

    ends = settle(arrow_groups(rows, group, keys, [("idx", "bigint"), ("leave", "bigint"), ("_from", "bigint")], summary))
    enter = settle(arrow_groups(ends, keys, keys, [("_chunk", "bigint"), ("enter", "bigint")], chain))
    return arrow_groups(rows.join(enter, group), group, keys, [("idx", "int")], mark)


# ---- rounds --------------------------------------------------------------------
def in_rounds(
    rows: DataFrame, keys: list[str], lay: Layout, low: Column, high: Column, decide: Callable[[dict, np.ndarray, np.ndarray], np.ndarray],
    refresh: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The rows that are taken.  A row is shown to all chunks between its positions ``low`` and
    ``high`` and decided by the chunk of its ``idx``.

    ``decide(columns, state, own)`` gets rows in order of ``idx``, their states, and which of
    them it may decide; dropped rows are shown no more.  ``refresh`` adds columns that depend
    on all states (only asked for in segments that are cut).
    """
    names = [c for c in rows.columns if c not in keys]
    fields = [(c, rows.schema[c].dataType.simpleString()) for c in names] + [("_state", "int")]
    rows = rows.withColumn("_state", F.lit(UNDECIDED))

    def run(c):
        own = c["_own"].astype(bool)
        state = decide(c, c["_state"].astype(np.int8), own)
        left = own & (state != DROPPED)
        return {n: c[n][left] for n in names} | {"_state": state[left].astype(np.int32)}

    if not lay.long:
        return arrow_groups(rows.withColumn("_own", F.lit(True)), keys, keys, fields, run).drop("_state")
    rows = settle(rows)
    while True:
        shown = (refresh(rows) if refresh else rows).withColumn("_chunk", F.explode(F.sequence(lay.chunk(low), lay.chunk(high))))
        shown = shown.withColumn("_own", F.col("_chunk") == lay.chunk("idx"))
        rows = settle(arrow_groups(shown, keys + ["_chunk"], keys, fields, run))
        if rows.where(F.col("_state") == UNDECIDED).isEmpty():
            return rows.drop("_state")
