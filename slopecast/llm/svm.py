"""Linear support vector machines by dual coordinate descent, and byte n-gram features."""

from __future__ import annotations

import numpy as np

#: Bytes handled at once; a longer text is taken in overlapping slices, so nothing is cut off.
SLICE = 1 << 20


def fit_hinge(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, dims: int, cost: float = 1.0, rounds: int = 30, seed: int = 1, cost_of: np.ndarray | None = None) -> np.ndarray:
    """Weights (dims + 1, the last is the bias) of the L2-regularised hinge-loss model.

    rows are (indices, values). One dual variable a row is brought to its optimum in turn, in an
    order shuffled each round, until no projected gradient exceeds 1e-3 or rounds are used up.
    cost_of weighs rows, e.g. by class.
    """
    w = np.zeros(dims + 1)
    alpha = np.zeros(len(rows))
    upper = np.full(len(rows), cost) * (1.0 if cost_of is None else cost_of)
    norms = np.array([v @ v + 1.0 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for k in rng.permutation(len(rows)):
            idx, val = rows[k]
            y = signs[k]
            gradient = y * (w[idx] @ val + w[-1]) - 1.0
            if (alpha[k] <= 0 and gradient >= 0) or (alpha[k] >= upper[k] and gradient <= 0):
                continue
            worst = max(worst, abs(gradient))
            new = min(max(alpha[k] - gradient / norms[k], 0.0), upper[k])
            step = (new - alpha[k]) * y
            alpha[k] = new
            w[idx] += step * val
            w[-1] += step
        if worst < 1e-3:
            break
    return w


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def platt(margins: np.ndarray, positive: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and offset of the logistic curve through held-out margins, by Newton steps.

    A small penalty keeps the slope finite where the classes separate.
    """
    a, b = 1.0, 0.0
    n = np.ones(len(margins)) if weight is None else weight
    up, down = n[positive].sum(), n[~positive].sum()
    target = np.where(positive, (up + 1) / (up + 2), 1 / (down + 2))
    for _ in range(50):
        p = sigmoid(a * margins + b)
        g = np.array([(n * (p - target) * margins).sum() + 1e-3 * a, (n * (p - target)).sum()])
        q = n * p * (1 - p)
        h = np.array([[(q * margins * margins).sum() + 1e-3, (q * margins).sum()], [(q * margins).sum(), q.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def gram_codes(data: np.ndarray, width: int, bits: int) -> np.ndarray:
    """Hash codes below 2 ** bits of all runs of `width` bytes."""
    if len(data) < width:
        return np.zeros(0, np.int64)
    n = len(data) - width + 1
    code = np.full(n, width, np.uint32)
    for k in range(width):
        code = (code ^ data[k:k + n]) * np.uint32(0x9E3779B1)
        code ^= code >> np.uint32(15)
    return (code >> np.uint32(32 - bits)).astype(np.int64)


def slices(data: bytes, width: int):
    """The bytes as arrays of at most SLICE that overlap by width - 1."""
    whole = np.frombuffer(data, np.uint8)
    if len(whole) <= SLICE:
        yield whole
        return
    for at in range(0, len(whole) - width + 1, SLICE - width + 1):
        yield whole[at:at + SLICE]
