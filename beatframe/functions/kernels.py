"""NumPy helpers for what Spark SQL has no operator for: nearest sample beyond a
threshold (prominence, width), distance suppression, a sliding order statistic, lag products.  They see one bounded group at a time (a trace, a chunk, an
island); partitioning and shuffling stay with Spark."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np

UNDECIDED, DROPPED, TAKEN = -1, 0, 1


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Midpoints of runs of equal samples that stand above both neighbouring runs."""
    n = x.size
    if n < 3:
        return np.empty(0, dtype=np.int64)
    starts = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    v = x[starts]
    ends = np.append(starts[1:], n) - 1
    top = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])) + 1
    return (starts[top] + ends[top]) // 2


def percentile(v: np.ndarray, q: float) -> float | None:
    """Linearly interpolated quantile as SQL takes it: NaN is above all numbers, None without values."""
    if not v.size:
        return None
    at = (v.size - 1) * q
    lo, hi = int(np.floor(at)), int(np.ceil(at))
    part = np.partition(v, (lo, hi))
    a, b = float(part[lo]), float(part[hi])
    return a if lo == hi or a == b else (hi - at) * a + (at - lo) * b


def at_least(a, b):
    """``a >= b`` with NaN above all numbers."""
    return (a >= b) | np.isnan(a)


def or_least(v: float | None, least: float) -> float:
    """The larger of both; ``least`` without a value."""
    return least if v is None or v < least else v


def quiet_mad(v: np.ndarray) -> float | None:
    """Median absolute deviation of the lowest 30 percent (of all if these are fewer than five)."""
    if not v.size:
        return None
    low = v[at_least(percentile(v, 0.30), v)]
    low = v if low.size < 5 else low
    return percentile(np.abs(low - percentile(low, 0.5)), 0.5)


def steps(x: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differences between neighbouring samples, and which of them are between known ones."""
    return np.diff(x), known[1:] & known[:-1]


def step_spread(d: np.ndarray, scale: float) -> tuple[float | None, float | None]:
    """Median and scaled median absolute deviation."""
    m = percentile(d, 0.5)
    return (None, None) if m is None else (m, percentile(np.abs(d - m), 0.5) * scale)


def within(places: list, at: int, distance: int) -> bool:
    """Does the sorted list hold a place closer to ``at`` than ``distance``?"""
    j = bisect_left(places, at)
    return (j < len(places) and places[j] - at < distance) or (j > 0 and at - places[j - 1] < distance)


def thin(idx: np.ndarray, amp: np.ndarray, distance: int | np.ndarray, state: np.ndarray, own: np.ndarray, waves: int = 32) -> np.ndarray:
    """Distance suppression: highest first (later on ties), lower ones closer than ``distance`` go.

    All rows above their undecided neighbours are taken at once; a slope that needs more than
    ``waves`` of that is finished row by row.  ``distance`` may differ between runs of rows
    that never meet.
    """
    state = state.copy()
    distance = np.broadcast_to(distance, idx.shape)
    rank = np.empty(len(idx), np.int64)
    order = np.lexsort((idx, amp))
    rank[order] = np.arange(len(idx))

    def clear(taken: np.ndarray, left: np.ndarray) -> np.ndarray:
        if not taken.size or not left.size:
            return left
        j = np.searchsorted(taken, idx[left])
        near = (j < taken.size) & (taken[np.minimum(j, taken.size - 1)] - idx[left] < distance[left])
        near |= (j > 0) & (idx[left] - taken[np.maximum(j - 1, 0)] < distance[left])
        state[left[near]] = DROPPED
        return left[~near]

    left = clear(idx[state == TAKEN], np.flatnonzero(state == UNDECIDED))
    for _ in range(waves):
        if not left.size:
            return state
        p, r, d = idx[left], rank[left], distance[left]
        beaten = ~own[left]
        k = 1
        while k < left.size:
            close = p[k:] - p[:-k] < d[k:]
            if not close.any():
                break
            up = r[k:] > r[:-k]
            beaten[:-k] |= close & up
            beaten[k:] |= close & ~up
            k += 1
        if beaten.all():
            return state
        state[left[~beaten]] = TAKEN
        left = clear(p[~beaten], left[beaten])
    taken, waiting = idx[state == TAKEN].tolist(), []
    for e in left[np.argsort(-rank[left])].tolist():
        at, far = int(idx[e]), int(distance[e])
        if within(taken, at, far):
            state[e] = DROPPED
        elif not own[e] or within(waiting, at, far):
            insort(waiting, at)
        else:
            state[e] = TAKEN
            insort(taken, at)
    return state


class RangeTable:
    """Least values of blocks of 1, 2, 4, ... samples, for many questions at once."""

    def __init__(self, x: np.ndarray) -> None:
        self.levels = [np.asarray(x, dtype=float)]
        while self.levels[-1].size > 1:
            v = self.levels[-1]
            if v.size % 2:
                v = np.append(v, np.inf)
            self.levels.append(np.minimum(v[::2], v[1::2]))

    def _meets(self, level: int, block: np.ndarray, limit: np.ndarray, strict: bool) -> np.ndarray:
        v = self.levels[level]
        low = np.where(block < v.size, v[np.minimum(block, v.size - 1)], np.inf)
        return low < limit if strict else low <= limit

    def nearest(self, at: np.ndarray, limit: np.ndarray, side: int, strict: bool = False) -> np.ndarray:
        """Nearest sample before (``side`` -1) or after (+1) each ``at`` that is at most ``limit``
        (below it if ``strict``); -1 if there is none."""
        n = self.levels[0].size
        out = np.full(at.size, -1, np.int64)
        edge = at.astype(np.int64) if side < 0 else at.astype(np.int64) + 1  # first place not looked at, or the next one
        todo = np.arange(at.size)
        block, depth = np.zeros(at.size, np.int64), np.zeros(at.size, np.int64)
        found = np.zeros(at.size, bool)
        # up: single blocks beside the edge, twice as large each time
        for level in range(len(self.levels)):
            todo = todo[(edge[todo] > 0) if side < 0 else (edge[todo] < n)]
            if not todo.size:
                break
            odd = todo[(edge[todo] >> level) & 1 == 1]
            b = (edge[odd] >> level) - (side < 0)
            hit = self._meets(level, b, limit[odd], strict)
            block[odd[hit]], depth[odd[hit]], found[odd[hit]] = b[hit], level, True
            edge[odd] += side * (1 << level)
            todo = todo[~found[todo]]
        # down: the half that is nearer, if it holds one
        for level in range(len(self.levels) - 2, -1, -1):
            go = np.flatnonzero(found & (depth > level))
            if go.size:
                near = 2 * block[go] + (side < 0)
                hit = self._meets(level, near, limit[go], strict)
                block[go] = np.where(hit, near, 2 * block[go] + (side > 0))
        out[found] = block[found]
        return out

    def lowest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least sample of each range from ``a`` to before ``b`` (infinite if empty)."""
        a, b, out = a.astype(np.int64), b.astype(np.int64), np.full(a.size, np.inf)
        for v in self.levels:
            some = a < b
            if not some.any():
                break
            left, right = some & (a & 1 == 1), some & (b & 1 == 1)
            out[left] = np.minimum(out[left], v[a[left]])
            out[right] = np.minimum(out[right], v[b[right] - 1])
            a, b = (a + 1) >> 1, b >> 1
        return out


class Signals:
    """Several signals one after another, parted by walls that are higher than any sample."""

    def __init__(self, x: np.ndarray, off: np.ndarray) -> None:
        self.group = np.repeat(np.arange(off.size - 1), np.diff(off))
        self.first, self.last = off[:-1] + np.arange(1, off.size), off[1:] + np.arange(0, off.size - 1)
        self.x = np.full(x.size + off.size, np.inf)
        self.x[np.arange(x.size) + self.group + 1] = x
        self.low, self.high = RangeTable(self.x), RangeTable(-self.x)

    def maxima(self) -> tuple[np.ndarray, np.ndarray]:
        """Places (among samples and walls) and signals of all local maxima."""
        at = local_maxima(self.x)
        at = at[self.x[at] < np.inf]
        return at, np.searchsorted(self.first, at, "right") - 1

    def prominences(self, at: np.ndarray) -> np.ndarray:
        """Height above the higher of the two side minima, each side reaching to the
        nearest strictly higher sample (or the end)."""
        left = self.high.nearest(at, -self.x[at], -1, strict=True)
        right = self.high.nearest(at, -self.x[at], 1, strict=True)
        return self.x[at] - np.maximum(self.low.lowest(left + 1, at + 1), self.low.lowest(at, right))

    def half_widths(self, at: np.ndarray, of: np.ndarray, prom: np.ndarray) -> np.ndarray:
        """Width in samples where the flanks cross ``amp - prom/2`` (linear interpolation)."""
        h = self.x[at] - 0.5 * prom
        flat = self.x[at] <= h
        i, j = self.low.nearest(at, h, -1), self.low.nearest(at, h, 1)
        i = np.where(flat, at, np.maximum(i, self.first[of]))
        j = np.where(flat, at, np.where(j < 0, self.last[of], np.minimum(j, self.last[of])))

        def cross(end, back):  # share of a sample from ``end`` towards the peak
            below = self.x[end] < h
            rise = np.where(below, np.where(below, self.x[back], 1.0) - self.x[end], 1.0)
            return np.where(below, (h - self.x[end]) / rise, 0.0)

        return (j - cross(j, j - 1)) - (i + cross(i, i + 1))


def prominences(x: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return Signals(x, np.array([0, x.size])).prominences(pos + 1)


def half_widths(x: np.ndarray, pos: np.ndarray, prom: np.ndarray) -> np.ndarray:
    return Signals(x, np.array([0, x.size])).half_widths(pos + 1, np.zeros(pos.size, np.int64), prom)


def find_peaks_many(x, off, min_prom=None, distance=1, min_width=None, max_width=None):
    """Maxima -> distance -> prominence -> width of many signals (``x[off[g]:off[g + 1]]``).

    Limits are numbers or one number a signal (NaN: no limit).  Returns signal, position in
    it, prominence and width of every peak, in order."""
    off = np.asarray(off, np.int64)
    s = Signals(np.asarray(x, float), off)
    at, of = s.maxima()

    def limit(v):
        return np.broadcast_to(np.nan if v is None else np.asarray(v, float), off.size - 1)[of]

    far = np.ceil(limit(distance)).astype(np.int64)
    apart = at + of * (far.max() if far.size else 0)  # signals out of each other's reach
    kept = thin(apart, s.x[at], far, np.full(at.size, UNDECIDED, np.int8), np.ones(at.size, bool)) == TAKEN
    at, of = at[kept], of[kept]
    prom = s.prominences(at)
    kept = ~(prom < limit(min_prom))
    at, of, prom = at[kept], of[kept], prom[kept]
    width = s.half_widths(at, of, prom)
    kept = ~(width < limit(min_width)) & ~(width > limit(max_width))
    at, of = at[kept], of[kept]
    return of, at - s.first[of], prom[kept], width[kept]


def find_peaks(x, min_prom=None, distance=1, min_width=None, max_width=None):
    """One signal: ``(pos, prom, width)``."""
    return find_peaks_many(x, [0, x.size], min_prom, distance, min_width, max_width)[1:]


def sliding_rank(padded: np.ndarray, win: int, rank: int) -> np.ndarray:
    """Order statistic ``rank`` of every full window of ``win`` samples.

    Windows are taken in blocks.  Within a block samples are replaced by their ranks, which are
    split bit by bit from the highest; counts of zeros before each place then lead all windows
    of the block at once to the rank they look for.
    """
    total = padded.size - win + 1
    step = 1 << max(8, (2 * win).bit_length())
    size = step + win - 1
    rows = -(-total // step)
    whole = np.concatenate([padded, np.full(rows * step + win - 1 - padded.size, padded[-1])])
    blocks = np.lib.stride_tricks.sliding_window_view(whole, size)[::step]
    some = max(1, (1 << 15) // size)
    return np.concatenate([_block_ranks(blocks[k : k + some], step, win, rank).ravel() for k in range(0, rows, some)])[:total]


def _block_ranks(x: np.ndarray, step: int, win: int, rank: int) -> np.ndarray:
    rows, size = x.shape
    order = np.argsort(x, axis=1, kind="stable")
    start = (np.arange(rows, dtype=np.int32) * np.int32(size + 1))[:, None]  # of a row; places are counted through
    place = start + np.arange(size, dtype=np.int32)
    current = np.empty((rows, size), np.int32)
    np.put_along_axis(current, order, np.arange(size, dtype=np.int32)[None, :], 1)
    low, many = place[:, :step].copy(), np.full((rows, step), win, np.int32)
    want, found = np.full((rows, step), rank, np.int32), np.zeros((rows, step), np.int32)
    zero = np.empty((rows, size + 1), np.int32)  # where a place goes if its bit is zero
    split = np.empty(rows * (size + 1), np.int32)
    for bit in range((size - 1).bit_length() - 1, -1, -1):
        one = (current >> bit) & 1
        zero[:, :1] = start
        np.cumsum(1 - one, axis=1, out=zero[:, 1:])
        zero[:, 1:] += start
        first = zero[:, -1:]  # place of the first one
        a = zero.ravel().take(low)
        zeros = zero.ravel().take(low + many) - a
        up = want >= zeros
        want -= zeros * up
        found += up.astype(np.int32) << np.int32(bit)
        low = np.where(up, low + first - a, a)
        many = np.where(up, many - zeros, zeros)
        if bit:
            split[np.where(one == 1, place + first - zero[:, :-1], zero[:, :-1])] = current
            current = split.reshape(rows, size + 1)[:, :size].copy()
    return np.take_along_axis(x, np.take_along_axis(order, found.astype(np.int64), 1), 1)


def trend_window(n: int, fs: float, window_s: float) -> int:
    """Odd window length; shrinks to three quarters of a short signal."""
    win = max(31, round(window_s * fs))
    win += win % 2 == 0
    if win >= n:
        win = max(31, round(0.75 * n))
        win -= win % 2 == 0
    return int(win)


def odd_window(fs: float, ms: float, least: int = 3) -> int:
    """Samples of a window of ``ms``: odd, at least ``least``."""
    k = max(least, round(ms / 1000.0 * fs))
    return k + (k % 2 == 0)


def row_averages(x: np.ndarray, fs: float, ms: float) -> np.ndarray:
    """Centred mean of every row; edges are zero padded, rows shorter than the window unchanged."""
    k, n = odd_window(fs, ms), x.shape[1]
    if n < k:
        return x.copy()
    padded = np.pad(x, ((0, 0), (k // 2, k // 2)))
    return sum(padded[:, j : j + n] * (1.0 / k) for j in range(k))


def row_quiet_mad(x: np.ndarray, scale: float) -> np.ndarray:
    """Scaled MAD of the lowest 30 percent of every row."""
    n = x.shape[1]
    many = (x <= np.percentile(x, 30, axis=1, keepdims=True)).sum(axis=1)
    many = np.where(many < 5, n, many)
    at = np.arange(x.shape[0])

    def middle(ordered):
        return (ordered[at, (many - 1) // 2] + ordered[at, many // 2]) / 2

    ordered = np.sort(x, axis=1)
    away = np.abs(ordered - middle(ordered)[:, None])
    away[np.arange(n)[None, :] >= many[:, None]] = np.inf
    return np.maximum(middle(np.sort(away, axis=1)) * scale, 1e-12)


def lag_products(x: np.ndarray, n_core: int, max_lag: int) -> np.ndarray:
    """sum over core i of x[i]*x[i+lag] for lag 0..max_lag (x holds a right halo).

    Blocks of the core are transformed together with what follows them within ``max_lag``;
    their products are added before the one transform back.
    """
    if not n_core:
        return np.zeros(max_lag + 1)
    size = 1 << max(10, (4 * max_lag + 1).bit_length())  # of a transform
    step = size - max_lag
    rows = -(-n_core // step)
    whole = np.zeros((rows - 1) * step + size)
    part = x[: n_core + max_lag][: whole.size]
    whole[: part.size] = part
    blocks = np.lib.stride_tricks.sliding_window_view(whole, size)[::step]
    sums = np.zeros(size // 2 + 1, complex)
    some = max(1, (1 << 20) // size)
    for k in range(0, rows, some):
        core = blocks[k : k + some].copy()
        core[:, step:] = 0.0
        if k + some >= rows:
            core[-1, max(0, n_core - (rows - 1) * step):] = 0.0
        sums += (np.conj(np.fft.rfft(core, axis=1)) * np.fft.rfft(blocks[k : k + some], axis=1)).sum(axis=0)
    return np.fft.irfft(sums, size)[: max_lag + 1]


def dominant_lag(acf: np.ndarray, lo: int, hi: int) -> tuple[int, float]:
    """Most prominent maximum of ``acf[lo..hi]``: (lag, value); (-1, 0) when none."""
    if hi <= lo:
        return -1, 0.0
    pos, prom, _ = find_peaks(acf[lo : hi + 1], 0.02)
    if pos.size == 0:
        return -1, 0.0
    best = int(pos[int(np.argmax(prom))]) + lo
    return best, float(acf[best])


def dominant_many(parts: list[np.ndarray]) -> list[tuple[int, float]]:
    """Place and value of the most prominent maximum of every part; (-1, 0) when none."""
    of, pos, prom, _ = find_peaks_many(np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts])), 0.02)
    order = np.lexsort((pos, -prom, of))
    first = order[np.flatnonzero(np.diff(of[order], prepend=-1))]
    out = [(-1, 0.0)] * len(parts)
    for g, at in zip(of[first].tolist(), pos[first].tolist()):
        out[g] = (at, float(parts[g][at]))
    return out


def row_periodicities(x: np.ndarray, fs: float) -> np.ndarray:
    """Autocorrelation value at the dominant lag of every row."""
    rows, n = x.shape
    out = np.zeros(rows)
    z = x - np.median(x, axis=1, keepdims=True)
    lo, hi = max(2, int(0.15 * fs)), min(n - 1, int(2.0 * fs))
    some = np.flatnonzero(np.std(z, axis=1) >= 1e-12)
    if n < int(0.5 * fs) or hi <= lo or not some.size:
        return out
    size = 1 << (n + hi).bit_length()
    f = np.fft.rfft(z[some], size, axis=1)
    acf = np.fft.irfft(f * np.conj(f), size, axis=1)[:, : hi + 1]
    acf /= np.maximum(acf[:, :1], 1e-12)
    part = acf[:, lo:]
    of, pos, prom, _ = find_peaks_many(part.ravel(), np.arange(some.size + 1) * part.shape[1], 0.02)
    order = np.lexsort((pos, -prom, of))  # the most prominent of each row first
    first = order[np.flatnonzero(np.diff(of[order], prepend=-1))]
    out[some[of[first]]] = part[of[first], pos[first]]
    return out
