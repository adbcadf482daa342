"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

By Sylvester's law of inertia, the number of positive pivots of LDLT of (A - s I) is the number of eigenvalues above s.
Bisection on s isolates each leading eigenvalue in an interval that holds no other one; inverse iteration and Rayleigh
quotient iteration, which converges cubically, find its vector; counts just above and below each quotient certify its number.
Eigenvalues that agree to rounding can't be isolated: they are one cluster, whose vectors are an orthonormal basis.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(np.float64).eps)
_PIVOT = (1 + 17**0.5) / 8


def count_above(a: np.ndarray, s: float) -> int:
    """Eigenvalues of the symmetric ``a`` above ``s``: the positive pivots of (a - s I) = L D LT with symmetric pivoting (blocks
    of D are 1 x 1 or 2 x 2)."""
    m = a - s * np.eye(len(a))
    positive = 0
    while len(m):
        below = np.abs(m[1:, 0])
        step, take = 1, 0
        if len(below) and abs(m[0, 0]) < _PIVOT * below.max():
            r = int(below.argmax()) + 1
            beside = np.abs(m[r])
            beside[r] = 0.0
            if abs(m[0, 0]) * beside.max() < _PIVOT * below.max() ** 2:
                take, step = (r, 1) if abs(m[r, r]) >= _PIVOT * beside.max() else (r, 2)
        if take:
            place = step - 1
            order = np.arange(len(m))
            order[place], order[take] = order[take], order[place]
            m = m[np.ix_(order, order)]
        pivot, column = m[:step, :step], m[step:, :step]
        if step == 1:
            positive += int(pivot[0, 0] > 0)
            m = m[1:, 1:] - np.outer(column[:, 0], column[:, 0] / pivot[0, 0]) if pivot[0, 0] != 0 else m[1:, 1:]
        else:  # an indefinite block: one positive and one negative eigenvalue
            positive += 1
            m = m[2:, 2:] - column @ np.linalg.solve(pivot, column.T)
    return positive


def _solve(a: np.ndarray, s: float, x: np.ndarray, scale: float) -> np.ndarray:
    """A unit vector along (a - s I)^-1 x; a shift that hits an eigenvalue exactly is moved by a rounding error."""
    while True:
        try:
            y = np.linalg.solve(a - s * np.eye(len(a)), x)
            size = np.linalg.norm(y)
            if np.isfinite(size) and size > 0:
                return y / size
        except np.linalg.LinAlgError:
            pass
        s += 2 * EPS * scale


def _apart(x: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """The unit vector of ``x`` without its parts along ``basis``, taken away twice for full orthogonality."""
    for _ in range(2):
        for b in basis:
            x = x - (b @ x) * b
    return x / np.linalg.norm(x)


def _refine(a: np.ndarray, s: float, found: list[np.ndarray], scale: float, seed: int, quotient: bool) -> tuple[float, np.ndarray]:
    """An eigenpair near ``s`` apart from ``found``: three inverse iterations, then Rayleigh quotient iterations if asked for."""
    x = _apart(np.random.Generator(np.random.PCG64(seed)).standard_normal(len(a)), found)
    for _ in range(3):
        x = _apart(_solve(a, s, x, scale), found)
    value = float(x @ a @ x)
    for _ in range(12 if quotient else 0):
        if np.linalg.norm(a @ x - value * x) <= 4 * EPS * scale:
            break
        x = _apart(_solve(a, value, x, scale), found)
        value = float(x @ a @ x)
    return value, x


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of the symmetric ``a`` in falling order, and their unit vectors as rows."""
    d = len(a)
    k = min(k, d)
    scale = float(np.abs(a).sum(axis=1).max(initial=0.0))
    if k == 0 or scale == 0.0:
        return np.zeros(k), np.eye(d)[:k]
    tolerance = 16 * d * EPS * scale
    counts: dict[float, int] = {}

    def above(s: float) -> int:
        if s not in counts:
            counts[s] = count_above(a, s)
        return counts[s]

    def certified(n: int, value: float) -> bool:
        """Whether the eigenvalue after the first ``n`` is ``value``, by the counts on its two sides."""
        return above(value + 2 * tolerance) <= n < above(value - 2 * tolerance)

    low, high = -scale - tolerance, scale + tolerance
    values: list[float] = []
    vectors: list[np.ndarray] = []
    counts[low], counts[high] = d, 0
    while len(values) < k:
        n = len(values)  # the next eigenvalue is number n + 1: it lies above every shift with a count of n + 1 or more
        lo = max(s for s, c in counts.items() if c > n)
        hi = min(s for s, c in counts.items() if c <= n and s > lo)
        while True:
            cluster = above(lo) - above(hi)
            middle = (lo + hi) / 2
            if cluster > 1 and hi - lo <= tolerance:
                for _ in range(min(cluster, k - n)):
                    value, x = _refine(a, middle, vectors, scale, len(values), False)
                    values.append(value)
                    vectors.append(x)
                break
            if cluster == 1:
                value, x = _refine(a, middle, vectors, scale, n, True)
                if hi - lo <= tolerance or certified(n, value):  # (the iteration may have found a neighbour)
                    values.append(value)
                    vectors.append(x)
                    break
            if above(middle) > n:
                lo = middle
            else:
                hi = middle
    wrong = [n + 1 for n, value in enumerate(values) if not certified(n, value)]
    if wrong:
        raise ArithmeticError(f"the counts do not confirm eigenvalues {wrong}")
    return np.array(values), np.array(vectors)
