"""Iterative singular-spectrum imputation of many series at once."""

from __future__ import annotations

import numpy as np

#: Evaluations after which a series that still moves is given back as not settled.
LIMIT = 1500


def _correlations(x: np.ndarray, window: int) -> np.ndarray:
    """Sums of products of each series (rows, zero outside its bounds) with itself, a lag a column."""
    length = x.shape[1]
    return np.stack([np.einsum("ij,ij->i", x[:, : length - lag], x[:, lag:]) for lag in range(window)], 1)


def _gram(x: np.ndarray, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Products of the columns of each series' Hankel trajectory matrix, (n, window, window).

    The full correlations, less the products that reach over the first and the last rows.
    """
    window = head.shape[1]
    lags = np.abs(np.arange(window)[:, None] - np.arange(window))
    out = _correlations(x, window)[:, lags]
    over = np.zeros((len(x), window))
    for i in range(1, window):
        over[:, 1:] = over[:, :-1] + head[:, i - 1, None] * head[:, : window - 1]
        over[:, 0] = 0
        out[:, i] -= over
    over = np.zeros((len(x), window))
    for i in range(window - 2, -1, -1):
        over[:, :-1] = over[:, 1:] + tail[:, i + 1, None] * tail[:, 1:]
        over[:, -1] = 0
        out[:, i] -= over
    return out


def _leading(gram: np.ndarray, rank: int) -> np.ndarray:
    return np.linalg.eigh(gram)[1][:, :, -rank:]


def _turned(gram: np.ndarray, vectors: np.ndarray, times: int = 2) -> np.ndarray:
    """``vectors`` moved towards the leading eigenvectors by multiplying and making them orthonormal."""
    for _ in range(times):
        vectors = gram @ vectors
        for k in range(vectors.shape[2]):
            v = vectors[:, :, k]
            for j in range(k):
                u = vectors[:, :, j]
                v -= np.einsum("ij,ij->i", u, v)[:, None] * u
            v /= np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-300)[:, None]
    return vectors


class _Missing:
    """The missing cells of some series, and what their diagonal averages need.

    A cell between the ends is in ``window`` rows of the trajectory matrix, so its average is a
    filter whose taps are sums along the projector's diagonals; nearer to an end fewer rows hold
    it, and those are averaged as they are.
    """

    def __init__(self, missing: np.ndarray, low: np.ndarray, high: np.ndarray, window: int) -> None:
        self.row, self.at = np.nonzero(missing)
        self.low, self.high, self.window = low, high, window
        from_low, from_high = self.at - low[self.row], high[self.row] - 1 - self.at
        self.head, self.tail = np.flatnonzero(from_low < window - 1), np.flatnonzero(from_high < window - 1)
        self.from_low, self.from_high = from_low[self.head], from_high[self.tail]
        self.middle = np.flatnonzero((from_low >= window - 1) & (from_high >= window - 1))
        self.span = np.arange(1 - window, window)
        self.ends = np.arange(2 * window - 2)

    def _end(self, piece: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """Averages of the first ``window`` - 1 cells of pieces of 2 ``window`` - 2 cells."""
        w = self.window
        rows = np.lib.stride_tricks.sliding_window_view(piece, w, 1)[:, : w - 1]
        both = (rows @ vectors) @ vectors.transpose(0, 2, 1)
        out = np.empty((len(piece), w - 1))
        for u in range(w - 1):
            j = np.arange(u + 1)
            out[:, u] = both[:, u - j, j].mean(1)
        return out

    def averages(self, x: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        w = self.window
        out = np.empty(len(self.row))
        if len(self.middle):
            projector = vectors @ vectors.transpose(0, 2, 1)
            taps = np.stack([np.trace(projector, offset=abs(d), axis1=1, axis2=2) for d in range(w)], 1) / w
            both = np.concatenate([taps[:, :0:-1], taps], 1)
            row, at = self.row[self.middle], self.at[self.middle]
            flat = x.reshape(-1)
            for begin in range(0, len(row), 20_000):
                part = slice(begin, begin + 20_000)
                near = flat[(row[part] * x.shape[1] + at[part])[:, None] + self.span]
                out[self.middle[part]] = np.einsum("ij,ij->i", near, both[row[part]])
        for where, near, first, step in ((self.head, self.from_low, self.low, 1), (self.tail, self.from_high, self.high - 1, -1)):
            if len(where):
                # A series read backwards has the trajectories read backwards.
                rows, place = np.unique(self.row[where], return_inverse=True)
                piece = x[rows[:, None], first[rows][:, None] + step * self.ends]
                out[where] = self._end(piece, vectors[rows][:, ::step])[place, near]
        return out


def impute(values: np.ndarray, window: int = 24, rank: int = 4, steps: int = LIMIT, tolerance: float = 0.01) -> np.ndarray:
    """Series (rows) with NaN replaced, as ``impute_marked`` gives them."""
    return impute_marked(values, window, rank, steps, tolerance)[0]


def impute_marked(
    values: np.ndarray, window: int = 24, rank: int = 4, steps: int = LIMIT, tolerance: float = 0.01, low: np.ndarray | None = None, high: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Series (rows) with NaN replaced, and whether each series settled; known values stay.

    ``low``, ``high``: first cell of each series and the one after its last; cells outside stay NaN.
    Missing values start at the mean of their phase (position modulo ``window``), then are
    replaced by the diagonal averages of the trajectories on their ``rank`` leading singular
    vectors until such a step moves no value by more than ``tolerance`` standard deviations; a
    series that still moves after ``steps`` steps hasn't settled. On the way there steps are
    extrapolated, and vectors follow those of the step before; the last step is always a plain
    one with exact vectors. Series without any value stay NaN; those shorter than twice the window
    get their mean.
    """
    n, length = values.shape
    low = np.zeros(n, int) if low is None else low
    high = np.full(n, length) if high is None else high
    place = np.arange(length)
    inside = (place >= low[:, None]) & (place < high[:, None])
    known = ~np.isnan(values) & inside
    count = known.sum(1)
    held = np.where(known, values, 0.0)
    mean = np.where(count > 0, held.sum(1) / np.maximum(count, 1), np.nan)
    centred = np.where(known, values - mean[:, None], 0.0)
    spread = np.sqrt((centred**2).sum(1) / np.maximum(count, 1))
    scale = np.where(spread > 0, spread, 1.0)[:, None]
    x = centred / scale
    todo = np.flatnonzero((count > 0) & (count < high - low) & (spread > 0) & (high - low >= 2 * window))
    settled = np.ones(n, bool)
    if len(todo):
        x[todo], settled[todo] = _iterate(x[todo], known[todo], low[todo], high[todo], window, min(rank, window), steps, tolerance)
    return np.where(known, values, np.where(inside, x * scale + mean[:, None], np.nan)), settled


def _iterate(x: np.ndarray, known: np.ndarray, low: np.ndarray, high: np.ndarray, window: int, rank: int, steps: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    n, length = x.shape
    place = np.arange(length)
    missing = ~known & (place >= low[:, None]) & (place < high[:, None])
    for p in range(window):
        at = place % window == p
        start = x[:, at].sum(1) / np.maximum(known[:, at].sum(1), 1)
        x[:, at] = np.where(missing[:, at], start[:, None], x[:, at])
    settled = np.zeros(n, bool)
    moving, vectors, used = np.arange(n), None, 0
    near = np.arange(window)
    state: dict = {}

    def prepare() -> None:
        state["cells"] = _Missing(missing[moving], low[moving], high[moving], window)
        state["now"] = x[moving]

    def step(y: np.ndarray, exact: bool) -> np.ndarray:
        """The values of the missing cells after a step from ``y``."""
        nonlocal vectors
        rows = np.arange(len(y))[:, None]
        gram = _gram(y, y[rows, low[moving][:, None] + near], y[rows, high[moving][:, None] - window + near])
        vectors = _leading(gram, rank) if exact or vectors is None else _turned(gram, vectors)
        return state["cells"].averages(y, vectors)

    def most(change: np.ndarray) -> np.ndarray:
        """Greatest change of each series."""
        out = np.zeros(len(moving))
        np.maximum.at(out, state["cells"].row, np.abs(change))
        return out

    prepare()
    while len(moving) and used < steps:
        cells, y = state["cells"], state["now"]
        old = y[cells.row, cells.at]
        first = step(y, False)
        y[cells.row, cells.at] = first
        second = step(y, False)
        used += 2
        a, b = first - old, second - first
        change = b - a
        sums = [np.bincount(cells.row, v * v, len(moving)) for v in (a, change)]
        length_ = np.clip(np.sqrt(sums[0] / np.maximum(sums[1], 1e-300)), 1.0, 32.0)
        # Extrapolated only where the second step was shorter than the first.
        length_ = np.where(np.bincount(cells.row, b * b, len(moving)) < sums[0], length_, 1.0)[cells.row]
        y[cells.row, cells.at] = old + 2 * length_ * a + length_**2 * change
        third = step(y, False)
        used += 1
        y[cells.row, cells.at] = third
        still = most(b) > tolerance
        if not still.all():
            before = third
            exact = step(y, True)
            used += 1
            done = most(exact - before) <= tolerance
            y[cells.row, cells.at] = exact
            if done.any():
                x[moving[done]] = y[done]
                settled[moving[done]] = True
                moving, vectors = moving[~done], vectors[~done]
                x[moving] = y[~done]
                prepare()
    x[moving] = state["now"] if len(moving) else x[moving]
    return x, settled
