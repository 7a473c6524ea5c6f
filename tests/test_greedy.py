"""Greedy selections: cut segments equal whole ones, and both equal a plain scan in order."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from beatframe.functions import kernels as K
from beatframe.operators import artifacts as V, peaks as P, select as S
from beatframe.operators.greedy import in_rounds
from beatframe.operators.layout import Layout, settle
from beatframe.params import DETECTOR as D

SEG = ["segment_no"]
FS = 20.0
CUTS = [Layout(max_fs=FS), Layout(size=32, long=True, max_fs=FS), Layout(size=100, long=True, max_fs=FS)]


def dense(n=700, seed=3):
    """Peaks that never pause for the refractory window (5 samples), in two segments and one of a single peak."""
    r = random.Random(seed)
    rows, at = [], 0
    for seg, many in ((1, n), (2, n // 3), (3, 1)):
        at = 0
        for k in range(many):
            at += r.choice([1, 2, 2, 3, 4, 5] if seg == 1 else [2, 5, 9, 40])
            amp = r.choice([0.5, 0.8, 1.0, 1.0, 1.2]) if seg == 1 else r.random()
            low = None if k == 0 else amp - r.choice([0.05, 0.3, 0.6, 2.0])
            rows.append((seg, at, amp, r.choice([0.02, 0.2, 0.5, 0.9]), r.choice([0.04, 0.08, 0.2]), at // 60, FS, low))
    return rows


@pytest.fixture(scope="module")
def raw(spark):
    return settle(spark.createDataFrame(dense(), "segment_no int, idx int, amp double, prom double, width_s double, tid int, fs double, valley double").repartition(3))


def kept(df, *cols):
    return sorted(tuple(r) for r in df.select("segment_no", *(cols or ("idx",))).collect())


def chosen_low(rows, chosen):
    """Lowest valley since the previous chosen peak."""
    out, low = [], []
    for r in rows:
        low.append(r[7])
        if r[1] in chosen:
            out.append((r, min((v for v in low if v is not None), default=float("inf"))))
            low = []
    return out


def plain_refractory(rows, chosen):
    wait = max(1, round(max(D.refractory_dedup_window_s, D.dedup_min_sep_s) * FS))
    kept, last, low = [], None, float("inf")
    score = lambda r: r[3] * r[4] ** 0.5 * r[2] ** 0.5
    for r, v in chosen_low(rows, chosen):
        if last is None:
            last = r
            continue
        low = min(low, v)
        a, b = last, r
        small, large = min(a[2], b[2]), max(a[2], b[2])
        lobe = (
            D.main_double_lobe_exception_enabled and a[5] == b[5] and (b[1] - a[1]) / FS <= D.main_double_lobe_max_dt_s and b[1] - a[1] >= 2
            and min(a[4], b[4]) >= D.main_double_lobe_min_weak_width_s and min(a[3], b[3]) >= D.main_double_lobe_min_weak_prom_abs
            and small >= D.main_double_lobe_min_weak_amp_rel_strong * large and (small - low) / small >= D.main_double_lobe_min_valley_ratio
            and (small - low) / (large - low) >= D.main_double_lobe_min_reascent_ratio
        )
        if b[1] - a[1] > wait or lobe:
            kept.append(last[1])
            last, low = r, float("inf")
        elif score(b) >= score(a):
            last, low = r, float("inf")
    return kept + ([last[1]] if last else [])


def test_refractory_equals_a_plain_scan(raw):
    picks = raw.where("prom > 0.1")
    got = [kept(S.refractory_dedup(raw, picks, SEG, lay)) for lay in CUTS]
    want = []
    for seg in (1, 2, 3):
        rows = [r for r in dense() if r[0] == seg]
        want += [(seg, i) for i in plain_refractory(rows, {r[1] for r in rows if r[3] > 0.1})]
    assert got[0] == want and got[1] == want and got[2] == want


def test_short_gaps_alternate(raw):
    got = [kept(S.prune_short_gaps(raw, raw, SEG, lay)) for lay in CUTS]
    assert got[0] == got[1] == got[2] and len(got[0]) < raw.count()


def test_distance_suppression(raw):
    rng = np.random.default_rng(1)
    for n in (1, 5, 200, 900):
        pos = np.cumsum(rng.integers(1, 4, n))
        for amp in (rng.random(n), rng.integers(0, 3, n).astype(float), np.arange(n, dtype=float), -np.arange(n, dtype=float)):
            for d in (1, 2, 7):
                state = np.ones(n, bool)
                for j in np.lexsort((pos, amp))[::-1]:
                    if state[j]:
                        near = np.abs(pos - pos[j]) < d
                        near[j] = False
                        state[near] = False
                got = K.thin(pos, amp, d, np.full(n, -1, np.int8), np.ones(n, bool), waves=3)
                assert np.array_equal(got == K.TAKEN, state) and not (got == K.UNDECIDED).any()
    slope = raw.withColumn("amp", F.col("idx").cast("double"))  # each depends on the next one
    for rows in (raw, slope):
        got = [kept(P.thin_peaks(rows, SEG, lay, F.lit(7.0))) for lay in CUTS]
        assert got[0] == got[1] == got[2]


def test_spaced_centers(raw):
    want = []
    for seg in (1, 2, 3):
        last = None
        for r in (r for r in dense() if r[0] == seg):
            if last is None or r[1] - last > 6:
                want.append((seg, r[1]))
                last = r[1]
    for lay in CUTS:
        assert kept(V.spaced_centers(raw, SEG, lay, 6)) == want


def test_second_lobes_equals_a_plain_scan(spark, raw):
    mains = raw.where("prom >= 0.9")
    thr = spark.createDataFrame([(1, 0.7), (2, 0.95), (3, 0.5)], "segment_no int, strong_thr double")
    want = []
    for seg, strong in ((1, 0.7), (2, 0.95)):
        rows = [r for r in dense() if r[0] == seg]
        for i, c in enumerate(rows):
            if c[3] >= 0.9 or c[4] < 0.070 or c[3] < 0.030 or c[3] >= strong:
                continue
            found = False
            for j, m in enumerate(rows):
                dt = abs(m[1] - c[1]) / FS
                if m[3] < 0.9 or m[4] < 0.055 or not 0.10 <= dt <= 0.90 or abs(m[1] - c[1]) < 2:
                    continue
                low = min(r[7] for r in rows[min(i, j) + 1 : max(i, j) + 1])
                small = min(c[2], m[2])
                dip, climb = (small - low) / max(small, 1e-12), min(c[2] - low, m[2] - low) / max(c[2] - low, m[2] - low, 1e-12)
                pr, ar = c[3] / m[3], c[2] / m[2]
                found |= dip >= 0.12 and climb >= 0.20 and ((pr >= 0.20 and ar >= 0.65) or (pr >= 0.04 and ar >= 0.80 and dt <= 0.85) or (ar >= 0.90 and dip >= 0.40 and climb >= 0.55 and dt <= 0.24))
            if found:
                want.append((seg, c[1]))
    for lay in CUTS:
        assert kept(S.second_lobes(raw, mains, thr, SEG, lay)) == want
    assert len(want) > 20


def scored(n=400, seed=5):
    """Candidates of windows that overlap: close ones, and one that spans several chunks."""
    r = random.Random(seed)
    rows = []
    for seg in (1, 2):
        for at in sorted(r.sample(range(3 * n), n)):
            wide = r.random() < 0.2
            rows.append((seg, at, r.choice([0.1, 0.2, 0.3, r.random()]), ("large_gap", 600) if wide else ("boundary", at // 25 * 25), 4))
    return rows


def plain_accept(rows):
    out = []
    for seg in (1, 2):
        taken, used = [], {}
        for _, at, score, w, sep in sorted((r for r in rows if r[0] == seg), key=lambda r: (-r[2], r[1])):
            if used.get(w, 0) < D.rescue_max_candidates_per_window and all(abs(at - t) >= sep for t in taken):
                taken.append(at)
                used[w] = used.get(w, 0) + 1
        out += [(seg, t) for t in taken]
    return sorted(out)


def test_greedy_accept_equals_a_plain_scan(spark):
    rows = scored()
    df = settle(spark.createDataFrame(rows, "segment_no int, idx int, score double, win struct<type:string,center:long>, min_sep_n long").repartition(3))
    for lay in CUTS:
        assert kept(S.greedy_accept(df, SEG, lay)) == plain_accept(rows)


def test_actions_in_order(spark):
    """Replacements free the place of the main they remove, for later transients only."""
    r = random.Random(9)
    rows, mains, tid = [], [], 0
    for at in range(0, 3000, 12):
        tid += r.choice([1, 1, 3])
        cur = at + r.randint(0, 5) if r.random() < 0.6 else None
        if cur is not None:
            mains.append((1, cur))
        if r.random() < 0.8:
            rows.append((1, tid, at + r.randint(0, 14), cur, FS))
    a = spark.createDataFrame(rows, "segment_no int, tid int, idx int, cur int, fs double")
    m = spark.createDataFrame(mains, "segment_no int, idx int")
    sep = max(1, round(D.main_transient_fill_min_sep_s * FS))
    current, want = {i for _, i in mains}, []
    for _, t, idx, cur, _ in rows:
        if all(abs(c - idx) >= sep for c in current - {cur}):
            current = current - {cur} | {idx}
            want.append((1, t, idx))
    for lay in CUTS:
        assert kept(S._apply_actions(a, m, SEG, lay, D).where("ok"), "tid", "idx") == want
    assert 0 < len(want) < len(rows)


def test_rounds_cross_chunks(spark):
    """A chain of conflicts through all chunks is decided from its far end."""
    df = settle(spark.createDataFrame([(1, i, float(i)) for i in range(500)], "segment_no int, idx int, amp double"))
    got = P.thin_peaks(df, SEG, Layout(size=64, long=True), F.lit(2.0))
    assert kept(got) == [(1, i) for i in range(1, 500, 2)]
    assert in_rounds(df.where("false"), SEG, Layout(size=64, long=True), F.col("idx"), F.col("idx"), lambda c, s, o: s).count() == 0
