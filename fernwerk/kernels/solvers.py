"""Sequential numeric kernels on numpy arrays: each is one task's work, spread over tasks and never over rows."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable

import numpy as np


# -- kernels ----------------------------------------------------------------------------------------


class Rbf:
    """beta * exp(-|x - y|^2 / sigma)."""

    def __init__(self, sigma: float, beta: float = 1.0):
        self.sigma, self.beta = sigma, beta

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
        return self.beta * np.exp(-np.maximum(d, 0) / self.sigma)


class Polynomial:
    """(<x, y> + c)^d."""

    def __init__(self, d: float, c: float = 1.0):
        self.d, self.c = d, c

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (x @ y.T + self.c) ** self.d


class Dot:
    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return x @ y.T


class Precomputed:
    """Rows are numbers of a kernel matrix, as single features."""

    def __init__(self, matrix):
        self.matrix = np.ascontiguousarray(matrix, float)

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self.matrix[np.ix_(x[:, 0].astype(int), y[:, 0].astype(int))]


class PairFunction:
    """Any function of two examples, which may be objects."""

    def __init__(self, f: Callable):
        self.f = f

    def __call__(self, x, y) -> np.ndarray:
        return np.array([[self.f(a, b) for b in y] for a in x], float).reshape(len(x), len(y))


# -- support vector machines ------------------------------------------------------------------------


class KernelRows:
    """Rows of the kernel matrix of x with itself, made when they are asked for; the last used ones are kept, up to so many bytes."""

    def __init__(self, kernel, x, bytes: int = 256_000_000):
        self.kernel, self.x, self.n = kernel, x, len(x)
        self.most = max(2, bytes // (8 * max(self.n, 1)))
        self.diag = np.array([kernel(x[i : i + 1], x[i : i + 1])[0, 0] for i in range(self.n)])
        self.kept: dict[int, np.ndarray] = {}

    def row(self, i: int) -> np.ndarray:
        found = self.kept.pop(i, None)
        if found is None:
            if len(self.kept) >= self.most:
                self.kept.pop(next(iter(self.kept)))
            found = self.kernel(self.x[i : i + 1], self.x)[0]
        self.kept[i] = found  # the last used comes last
        return found


class MatrixRows:
    """Rows of a kernel matrix that is there."""

    def __init__(self, k: np.ndarray):
        self.k, self.n, self.diag = k, len(k), np.diag(k)

    def row(self, i: int) -> np.ndarray:
        return self.k[i]


def movable(a: np.ndarray, y: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows' a * y can go up, and which can go down."""
    return np.where(y > 0, a < c, a > 0), np.where(y > 0, a > 0, a < c)


def greatest_violation(score: np.ndarray, a: np.ndarray, y: np.ndarray, c: np.ndarray) -> float:
    """By how much a score at most breaks the optimum's conditions: a = 0 above the margin, a = c below it, on it in between."""
    margin = y * score - 1
    return float(np.maximum(np.where(a < c, -margin, 0), np.where(a > 0, margin, 0)).max(initial=0))


def svm_pairs(rows: KernelRows, y: np.ndarray, c: np.ndarray, eps: float = 1e-4, tau: float = 1e-12, max_iter: int = 1_000_000, a: np.ndarray | None = None, grad: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """min a'Qa/2 - sum(a), 0 <= a <= c, y'a = 0, with Q = yy'K: (a, b) so that a row's score is K @ (a * y) - b.

    Decomposition by pairs. The first of a pair violates optimality most, the second promises the greatest
    decrease to second order. Ends when the greatest violation is below eps; warns at max_iter. Starts from a and its gradient, if given.
    """
    n, diag = len(y), rows.diag
    a, grad = (np.zeros(n), -np.ones(n)) if a is None else (a.copy(), grad.copy())
    for _ in range(max_iter):
        down = -y * grad
        up, low = movable(a, y, c)
        i = int(np.where(up, down, -np.inf).argmax())
        worst = down[i]
        if worst - np.where(low, down, np.inf).min() < eps:
            break
        gap, k_i = worst - down, rows.row(i)
        curve = np.maximum(diag[i] + diag - 2 * k_i, tau)
        gain = np.where(low & (gap > 0), gap * gap / curve, -np.inf)
        j = int(gain.argmax())
        step = gap[j] / curve[j]
        step = min(step, c[i] - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else c[j] - a[j])
        a[i] += y[i] * step
        a[j] -= y[j] * step
        grad += step * y * (k_i - rows.row(j))
    else:
        warnings.warn("the solver stopped before it converged", stacklevel=2)
    a = np.clip(a, 0, c)
    return a, offset(-y * grad, a, y, c)


def greatest_gap(down: np.ndarray, a: np.ndarray, y: np.ndarray, c: np.ndarray) -> float:
    """By how much the pair that violates the optimum most does so. down: y less the score without b."""
    up, low = movable(a, y, c)
    return float(np.where(up, down, -np.inf).max(initial=-np.inf) - np.where(low, down, np.inf).min(initial=np.inf))


def worst_rows(g: np.ndarray, a: np.ndarray, y: np.ndarray, c: np.ndarray, each: int) -> np.ndarray:
    """Places of the `each` rows that most should go up and of those that most should go down. g: the score without b."""
    up, low = movable(a, y, c)
    highest, lowest = np.where(up, y - g, -np.inf), np.where(low, y - g, np.inf)
    first, last = np.argsort(-highest, kind="stable")[:each], np.argsort(lowest, kind="stable")[:each]
    return np.union1d(first[up[first]], last[low[last]])


def svm_blocks(kernel: Callable, x: np.ndarray, y: np.ndarray, c: np.ndarray, eps: float = 1e-4, size: int = 1024, max_rounds: int = 20_000) -> tuple[np.ndarray, float]:
    """The problem of svm_pairs(), whose pairs are sought within blocks of the rows that violate the optimum most; all other scores follow a block at once."""
    a, g = np.zeros(len(y)), np.zeros(len(y))
    for _ in range(max_rounds):
        gap = greatest_gap(y - g, a, y, c)
        if gap < eps:
            break
        at = worst_rows(g, a, y, c, size // 2)
        k = kernel(x, x[at])
        new, _ = svm_pairs(MatrixRows(k[at]), y[at], c[at], max(eps / 2, gap / 20), a=a[at], grad=(y * g - 1)[at])
        g += k @ ((new - a[at]) * y[at])
        a[at] = new
    else:
        warnings.warn("the solver stopped before it converged", stacklevel=2)
    return a, offset(y - g, a, y, c)


def offset(down: np.ndarray, a: np.ndarray, y: np.ndarray, c: np.ndarray) -> float:
    """b from the rows on the margin, or where there are none from the middle of what is left for it. down: y less the score without b."""
    free = (a > 1e-12 * c) & (a < c * (1 - 1e-12))
    if free.any():
        return float(-down[free].mean())
    up, low = movable(a, y, c)
    return float(-(np.where(up, down, -np.inf).max() + np.where(low, down, np.inf).min()) / 2)


def svm_smo(rows: KernelRows, y: np.ndarray, c: np.ndarray, tol: float = 1e-3, least: float = 1e-7, seed: int = 0, max_sweeps: int = 10_000) -> tuple[np.ndarray, float]:
    """The same problem by sequential minimal optimisation.

    Sweeps look for rows that break the conditions by more than tol: over all rows first, then over those between the bounds until they hold, and over
    all again. A row's partner is the row between the bounds whose error differs most; where that gives no step, other rows between the bounds, then any
    row, from a random place on. The errors of all rows are kept up to date. Rows that sit at a bound and are right by far are left out of
    sweeps (shrunk) until the others hold; then all are looked at again.
    """
    n, random = len(y), np.random.default_rng(seed)
    a, error, b = np.zeros(n), -y.astype(float), 0.0  # error: score less y

    def move(i: int, j: int) -> bool:
        nonlocal b
        if i == j:
            return False
        same = y[i] == y[j]
        low, high = (max(0.0, a[i] + a[j] - c[i]), min(c[j], a[i] + a[j])) if same else (max(0.0, a[j] - a[i]), min(c[j], c[i] + a[j] - a[i]))
        if high - low < 1e-14 * max(c[i], c[j]):
            return False
        k_i, k_j = rows.row(i), rows.row(j)
        curve, slope = k_i[i] + k_j[j] - 2 * k_i[j], y[j] * (error[i] - error[j])
        if curve > 1e-12:
            new = min(max(a[j] + slope / curve, low), high)
        else:  # a line: one of its ends, if they differ
            worth = [slope * (end - a[j]) - curve * (end - a[j]) ** 2 / 2 for end in (low, high)]
            new = (low, high)[int(worth[1] > worth[0])] if abs(worth[0] - worth[1]) > 1e-12 else a[j]
        if abs(new - a[j]) < least * (new + a[j] + least):
            return False
        other = a[i] - (new - a[j]) * (1 if same else -1)
        new, other = (0.0 if v < 1e-10 * m else m if v > m * (1 - 1e-10) else v for v, m in ((new, c[j]), (other, c[i])))
        by_i, by_j = y[i] * (other - a[i]), y[j] * (new - a[j])
        a[i], a[j] = other, new
        error[:] += by_i * k_i + by_j * k_j
        free = [k for k, v in ((i, other), (j, new)) if 0 < v < c[k]]
        shift = error[free[0]] if free else (error[i] + error[j]) / 2  # what makes the pair's errors nought
        error[:] -= shift
        b += shift
        return True

    def broken(at: np.ndarray) -> np.ndarray:
        off = y[at] * error[at]
        return at[((off < -tol) & (a[at] < c[at])) | ((off > tol) & (a[at] > 0))]

    def partnered(i: int) -> bool:
        inner = np.flatnonzero((a > 0) & (a < c))
        if len(inner) and move(i, int(inner[np.abs(error[inner] - error[i]).argmax()])):
            return True
        for at in (inner, np.arange(n)):
            at = np.roll(at, -int(random.integers(len(at)))) if len(at) else at
            if any(move(i, int(j)) for j in at):
                return True
        return False

    looked_at = np.arange(n)
    for _ in range(max_sweeps):
        moved = sum(partnered(int(i)) for i in broken(looked_at) if len(broken(np.array([i]))))
        while moved:
            inner = np.flatnonzero((a > 0) & (a < c))
            moved = sum(partnered(int(i)) for i in broken(inner) if len(broken(np.array([i]))))
        far = (y * error > 10 * tol) & (a == 0) | (y * error < -10 * tol) & (a == c)
        if len(broken(looked_at)):
            looked_at = np.flatnonzero(~far)
        elif len(looked_at) < n:
            looked_at = np.arange(n)
        else:
            break
        if len(looked_at) == n and not len(broken(looked_at)):
            break
    else:
        warnings.warn("the solver stopped before it converged", stacklevel=2)
    return a, offset(y - (error + y + b), a, y, c)


#: By the option `algorithm`.
ALGORITHMS = {"pairs": svm_pairs, "smo": svm_smo}


#: Kernel values that a model's decide() makes at once.
DECIDED_AT_ONCE = 4_000_000


class SvmModel:
    def __init__(self, vectors, weights: np.ndarray, b: float, kernel):
        self.vectors, self.weights, self.b, self.kernel = vectors, weights, b, kernel

    def decide(self, x) -> np.ndarray:
        if not len(self.weights):
            return np.zeros(len(x)) - self.b
        step = max(1, DECIDED_AT_ONCE // len(self.weights))
        return np.concatenate([self.kernel(x[s : s + step], self.vectors) @ self.weights for s in range(0, len(x), step)] or [np.zeros(0)]) - self.b


def solved(x, y: np.ndarray, kernel, c: float | np.ndarray, eps: float = 1e-4, algorithm: str = "pairs") -> tuple[np.ndarray, float]:
    """(a, b) for y of -1 and 1; c one for all or one for each row."""
    return svm_dual(KernelRows(kernel, x), y, c, eps, algorithm)


def svm_dual(rows: KernelRows | MatrixRows | np.ndarray, y: np.ndarray, c: float | np.ndarray, eps: float = 1e-4, algorithm: str = "pairs") -> tuple[np.ndarray, float]:
    """(a, b) from the kernel matrix or its rows on demand."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm!r}: {', '.join(ALGORITHMS)}")
    c = np.broadcast_to(np.asarray(c, float), len(y)).copy()
    if not (np.isfinite(c).all() and set(np.unique(y)) == {-1.0, 1.0}):
        raise ValueError("two classes, -1 and 1, and a finite c are needed")
    return ALGORITHMS[algorithm](MatrixRows(rows) if isinstance(rows, np.ndarray) else rows, y, c, eps)


def train_svm(x, y: np.ndarray, kernel, c: float | np.ndarray, eps: float = 1e-4, algorithm: str = "pairs") -> SvmModel:
    """y: 0/1 or -1/1."""
    s = np.where(np.asarray(y) > 0, 1.0, -1.0)
    if len(set(s)) < 2:
        return SvmModel(x[:0], np.zeros(0), -float(s[0]) if len(s) else 0.0, kernel)
    a, b = solved(x, s, kernel, c, eps, algorithm)
    at = np.flatnonzero(a > 0)
    return SvmModel(x[at] if isinstance(x, np.ndarray) else [x[i] for i in at], (a * s)[at], b, kernel)


def fit_sigmoid(f: np.ndarray, y: np.ndarray, n: np.ndarray | None = None, rounds: int = 200, tol: float = 1e-12) -> tuple[float, float]:
    """(a, b) of p = 1 / (1 + exp(f a + b)) of greatest likelihood under targets drawn in from 0 and 1; n: how often each (f, y) occurs.

    Newton steps on two unknowns, with as much added to the Hessian's diagonal as makes the loss fall; it ends when a step promises less
    than `tol` of the loss. Scores are scaled first, so that the damping means the same for any of them.
    """
    n = np.ones(len(f)) if n is None else np.asarray(n, float)
    yes = n[y > 0].sum()
    no = n.sum() - yes
    aim = np.where(y > 0, 1 / (yes + 2), 1 - 1 / (no + 2))  # of sigma(f a + b), which is 1 - p
    scale = max(float(np.abs(f).max(initial=0)), 1e-300)
    x = np.stack([np.asarray(f, float) / scale, np.ones(len(f))])

    def loss(w: np.ndarray) -> float:
        z = w @ x
        return float(n @ (np.logaddexp(0, z) - aim * z))

    w, damping = np.array([0.0, math.log((no + 1) / (yes + 1))]), 1e-6
    now = loss(w)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(w @ x, -700, 700)))
        slope = x @ (n * (q - aim))
        bend = (x * (n * q * (1 - q))) @ x.T
        step = np.linalg.solve(bend + damping * max(np.trace(bend), 1e-12) * np.eye(2), slope)
        if slope @ step <= tol * (1 + now):
            break
        new = loss(w - step)
        if new < now:
            w, now, damping = w - step, new, max(damping / 10, 1e-12)
        else:
            damping *= 10
            if damping > 1e12:
                break
    return float(w[0] / scale), float(w[1])


# -- perceptron, self-organising map ----------------------------------------------------------------


class LinearModel:
    def __init__(self, w: np.ndarray):
        self.w = w

    def decide(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w[1:] + self.w[0]


def perceptron_pass(x: np.ndarray, y: np.ndarray, w: np.ndarray, eta: float) -> tuple[np.ndarray, int]:
    """Weights after one pass over the rows in order, and how many were wrong: each of these corrects by the distance from its side's 1."""
    w, wrong = w.copy(), 0
    for row, yes in zip(x, np.asarray(y) > 0, strict=True):
        v = w[0] + w[1:] @ row
        if (v > 0) != yes:
            wrong += 1
            side = 1.0 if yes else -1.0
            e = side * eta * abs(side - v)
            w[0] += e
            w[1:] += e * row
    return w, wrong


def train_perceptron(x: np.ndarray, y: np.ndarray, eta: float = 0.1, max_iters: int = 128) -> LinearModel:
    """Rows in order, corrected by the distance from the right side's 1; passes until none is wrong, at most max_iters."""
    w = np.zeros(x.shape[1] + 1)
    for _ in range(max_iters):
        w, wrong = perceptron_pass(x, y, w, eta)
        if not wrong:
            break
    return LinearModel(w)


def put_points(grid: np.ndarray, points: np.ndarray, rate: float = 0.2, radius: int = 4) -> np.ndarray:
    """Each point in turn draws its closest cell and those around, rows and columns from -radius to before +radius."""
    grid = grid.copy()
    rows, cols = grid.shape[:2]
    for p in points:
        y, x = divmod(int(((grid - p) ** 2).sum(axis=2).argmin()), cols)
        y0, y1, x0, x1 = max(0, y - radius), min(rows, y + radius), max(0, x - radius), min(cols, x + radius)
        far = np.abs(np.arange(y0, y1) - y)[:, None] + np.abs(np.arange(x0, x1) - x)[None, :]
        pull = (rate / (1 + far))[:, :, None]
        grid[y0:y1, x0:x1] = (1 - pull) * grid[y0:y1, x0:x1] + pull * p
    return grid


# -- small dense problems ---------------------------------------------------------------------------


def lasso_gram(gram: np.ndarray, xy: np.ndarray, lam: float, b: np.ndarray | None = None, max_iter: int = 1024, tol: float = 1e-5) -> np.ndarray:
    """min b'Gb/2 - xy'b + lam |b|_1 by coordinate descent: all coordinates, then the nonzero ones until they rest, and again."""
    b = np.zeros(len(xy)) if b is None else b.copy()
    active = np.arange(len(b))
    full = True
    for _ in range(max_iter):
        moved = 0.0
        for k in active:
            if gram[k, k] <= 0:
                continue
            rho = xy[k] - gram[k] @ b + gram[k, k] * b[k]
            new = math.copysign(max(abs(rho) - lam, 0.0), rho) / gram[k, k]
            moved, b[k] = max(moved, abs(new - b[k])), new
        if moved > tol:
            active, full = np.flatnonzero(b), False
        elif full:
            break
        else:
            active, full = np.arange(len(b)), True
    return b


def nnls(a: np.ndarray, y: np.ndarray, tol: float = 1e-10) -> np.ndarray:
    """Nonnegative x with least |a x - y|: an active set is enlarged by the steepest coordinate and cut where a step leaves the cone."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    for _ in range(3 * n + 10):
        slope = a.T @ (y - a @ x)
        if free.all() or slope[~free].max() <= tol:
            break
        free[np.where(free, -np.inf, slope).argmax()] = True
        while True:
            s = np.zeros(n)
            s[free] = np.linalg.lstsq(a[:, free], y, rcond=None)[0]
            bad = free & (s <= 0)
            if not bad.any():
                break
            t = (x[bad] / np.maximum(x[bad] - s[bad], 1e-300)).min()
            x = x + t * (s - x)
            free &= x > tol
            x[~free] = 0
        x = s
    return x


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f = c = 1.0
    d = 0.0
    for k in range(400):
        m = k // 2
        num = 1.0 if k == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or tiny)
        c = 1 + num / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def f_cdf(x: float, d1: float, d2: float) -> float:
    return beta_cdf(d1 * x / (d1 * x + d2), d1 / 2, d2 / 2) if x > 0 else 0.0
