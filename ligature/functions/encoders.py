"""Encoders of 12-part vectors in NumPy: a circular harmonic network, a plain one, and a merge policy.

Weights are plain dictionaries of arrays, so they travel as broadcast variables and are stored as .npz files.
"""

from __future__ import annotations

import numpy as np

DILATIONS = HARMONICS = (1, 3, 4, 5)
BRANCH = 4
CHANNELS = BRANCH * len(DILATIONS)
PROJECTED = 2
GROUPS = 4
PAIRS = PROJECTED * len(HARMONICS)
PAIR_FEATURES = 5 * PAIRS
POLICY_INPUT = PAIR_FEATURES + 4


def l1_or_zero(v: np.ndarray) -> np.ndarray:
    s = v.sum(axis=1, keepdims=True)
    return np.divide(v, s, out=np.zeros_like(v, dtype=float), where=s > 1e-12)


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def taps_of(x: np.ndarray, dilation: int) -> np.ndarray:
    """[batch, place, tap and channel]: what a filter sees at each place, so that a layer is one product of matrices."""
    at = (np.arange(12)[:, None] + (np.arange(3) - 1) * dilation) % 12
    return x.transpose(0, 2, 1)[:, at].reshape(len(x), 12, -1)


def rows_of(w: np.ndarray) -> np.ndarray:
    """[tap and channel, out] of a filter (out, in, 3)."""
    return w.transpose(2, 1, 0).reshape(-1, len(w))


def circular(x: np.ndarray, w: np.ndarray, b: np.ndarray, dilation: int) -> np.ndarray:
    """x: (batch, in, 12), w: (out, in, 3); indices wrap around."""
    return (taps_of(x, dilation) @ rows_of(w)).transpose(0, 2, 1) + b[None, :, None]


def group_norm(x: np.ndarray, gain: np.ndarray, shift: np.ndarray) -> np.ndarray:
    g = x.reshape(len(x), GROUPS, -1)
    g = (g - g.mean(axis=2, keepdims=True)) / np.sqrt(g.var(axis=2, keepdims=True) + 1e-5)
    return g.reshape(x.shape) * gain[None, :, None] + shift[None, :, None]


def relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0.0)


def harmonic_weights(seed: int) -> dict[str, np.ndarray]:
    """Seeded starting weights of the harmonic network."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.uniform(-1, 1, shape) / np.sqrt(np.prod(shape[1:]))
    out = {f"branch{d}": draw(BRANCH, 1, 3) for d in DILATIONS} | {f"bias{d}": np.zeros(BRANCH) for d in DILATIONS}
    for k in ("first", "second"):
        out |= {k: draw(CHANNELS, CHANNELS, 3), f"{k}_bias": np.zeros(CHANNELS)}
    for k in ("stem", "norm1", "norm2"):
        out |= {f"{k}_gain": np.ones(CHANNELS), f"{k}_shift": np.zeros(CHANNELS)}
    return out | {"project": draw(PROJECTED, CHANNELS)}


def harmonic(v: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """16 numbers: chosen Fourier coefficients of two learned signals, as real and imaginary parts, with norm 1.

    Rolling both inputs turns their coefficients by one phase, so distances stay the same.
    """
    x = l1_or_zero(v)[:, None, :]
    x = np.concatenate([circular(x, w[f"branch{d}"], w[f"bias{d}"], d) for d in DILATIONS], axis=1)
    x = relu(group_norm(x, w["stem_gain"], w["stem_shift"]))
    y = relu(group_norm(circular(x, w["first"], w["first_bias"], 1), w["norm1_gain"], w["norm1_shift"]))
    y = group_norm(circular(y, w["second"], w["second_bias"], 1), w["norm2_gain"], w["norm2_shift"])
    signal = np.einsum("bcx,oc->box", relu(x + y), w["project"])
    spectrum = np.fft.rfft(signal, norm="ortho")[:, :, list(HARMONICS)]
    return unit(np.stack([spectrum.real, spectrum.imag], axis=3).reshape(len(v), -1))


def plain_weights(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    out: dict[str, np.ndarray] = {}
    for k, (a, b) in enumerate(((12, 32), (32, 16), (16, 16))):
        out |= {f"w{k}": rng.uniform(-1, 1, (a, b)) / np.sqrt(a), f"b{k}": np.zeros(b)}
    return out | {"gain": np.ones(32), "shift": np.zeros(32)}


def plain(v: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    x = l1_or_zero(v) @ w["w0"] + w["b0"]
    x = (x - x.mean(axis=1, keepdims=True)) / np.sqrt(x.var(axis=1, keepdims=True) + 1e-5) * w["gain"] + w["shift"]
    return unit(relu(relu(x) @ w["w1"] + w["b1"]) @ w["w2"] + w["b2"])


def pair_features(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Amplitudes, difference amplitudes and relative phases of two embeddings; unchanged by a common phase."""
    a, b = (x.reshape(len(x), PAIRS, 2) for x in (left, right))
    za, zb = a[..., 0] + 1j * a[..., 1], b[..., 0] + 1j * b[..., 1]
    turn = za * zb.conj()
    return np.concatenate([abs(za), abs(zb), abs(za - zb), np.stack([turn.real, turn.imag], axis=2).reshape(len(left), -1)], axis=1)


def policy_weights(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    out: dict[str, np.ndarray] = {}
    for k, (a, b) in enumerate(((POLICY_INPUT, 64), (64, 32), (32, 1))):
        out |= {f"w{k}": rng.uniform(-1, 1, (a, b)) / np.sqrt(a), f"b{k}": np.zeros(b)}
    return out


def policy(x: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    return (relu(relu(x @ w["w0"] + w["b0"]) @ w["w1"] + w["b1"]) @ w["w2"] + w["b2"])[:, 0]


class Episodes:
    """Pieces of one length, [piece, leaf, part], whose neighbouring clusters merge step by step, a merge in each piece at a time.

    A merge changes one cluster, so only its embedding is found anew.
    """

    def __init__(self, vectors: np.ndarray, w: dict[str, np.ndarray]) -> None:
        self.size, self.n = vectors.shape[:2]
        self.vectors, self.w, self.row = vectors, w, np.arange(self.size)
        self.edges = np.tile(np.arange(self.n + 1), (self.size, 1))
        self.emb = harmonic(vectors.reshape(self.size * self.n, -1), w).reshape(self.size, self.n, -1)
        self.nodes: list[np.ndarray] = []

    def features(self) -> np.ndarray:
        """[piece, pair, feature]: those of candidates."""
        m, n = self.emb.shape[1] - 1, self.n
        size = np.diff(self.edges).astype(float)
        a, b = size[:, :-1], size[:, 1:]
        more = np.stack([np.log1p(a) / np.log1p(n), np.log1p(b) / np.log1p(n), abs(a - b) / (a + b), self.edges[:, 1:-1] / n], axis=2)
        left, right = (x.reshape(self.size * m, -1) for x in (self.emb[:, :-1], self.emb[:, 1:]))
        return np.concatenate([pair_features(left, right).reshape(self.size, m, -1), more], axis=2)

    def merge(self, at: np.ndarray) -> None:
        i, k, j = (self.edges[self.row, at + x] for x in range(3))
        self.nodes.append(np.stack([i, j, k], axis=1))
        keep = np.ones(self.edges.shape, bool)
        keep[self.row, at + 1] = False
        self.edges = self.edges[keep].reshape(self.size, -1)
        self.emb = self.emb[keep[:, :-1]].reshape(self.size, self.edges.shape[1] - 1, -1)
        leaf = np.arange(self.n)
        inside = ((leaf >= i[:, None]) & (leaf < j[:, None])).astype(float)
        self.emb[self.row, at] = harmonic((inside[:, None] @ self.vectors)[:, 0], self.w)

    def merges(self) -> np.ndarray:
        """[piece, merge, (first, past the last, split)]."""
        return np.stack(self.nodes, axis=1) if self.nodes else np.zeros((self.size, 0, 3), np.int64)


def shares(logits: np.ndarray) -> np.ndarray:
    """The softmax of each row."""
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def rollouts(vectors: np.ndarray, encoder: dict, merge: dict) -> tuple[np.ndarray, np.ndarray]:
    """(merges [piece, merge, 3], log probabilities) of rollout's likeliest merges for pieces of one length at once."""
    e, logp = Episodes(vectors, encoder), np.zeros(len(vectors))
    for m in range(e.n - 1, 0, -1):
        logits = policy(e.features().reshape(e.size * m, -1), merge).reshape(e.size, m)
        at = logits.argmax(axis=1)
        logp += np.log(np.maximum(shares(logits)[e.row, at], 1e-12))
        e.merge(at)
    return e.merges(), logp


def candidates(vectors: np.ndarray, clusters: list[tuple[int, int]], w: dict[str, np.ndarray]) -> np.ndarray:
    """Features of each neighbouring pair of clusters: of its embeddings, sizes, imbalance and place."""
    n = len(vectors)
    emb = harmonic(np.array([vectors[i:j].sum(axis=0) for i, j in clusters]), w)
    size = np.array([j - i for i, j in clusters], float)
    a, b = size[:-1], size[1:]
    more = np.stack([np.log1p(a) / np.log1p(n), np.log1p(b) / np.log1p(n), abs(a - b) / (a + b), np.array([j for _, j in clusters[:-1]]) / n], axis=1)
    return np.concatenate([pair_features(emb[:-1], emb[1:]), more], axis=1)


def rollout(vectors: np.ndarray, encoder: dict, merge: dict, rng: np.random.Generator | None = None) -> tuple[list[tuple[int, int, int]], float]:
    """Merges (first, past the last, split) of a policy, and the log probability; the likeliest merges without rng."""
    clusters, out, logp = [(i, i + 1) for i in range(len(vectors))], [], 0.0
    while len(clusters) > 1:
        logits = policy(candidates(vectors, clusters, encoder), merge)
        p = np.exp(logits - logits.max())
        p /= p.sum()
        at = int(logits.argmax()) if rng is None else int(rng.choice(len(p), p=p))
        logp += float(np.log(max(p[at], 1e-12)))
        (i, k), (_, j) = clusters[at], clusters[at + 1]
        out.append((i, j, k))
        clusters[at : at + 2] = [(i, j)]
    return out, logp


def fit_logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, epochs: int = 300, rate: float = 0.05, penalty: float = 1e-3) -> dict:
    """Convex feature weights, intercept and positive gain of a logistic scorer, by Adam; deterministic.

    x: calibrated features in [0, 1] of a bounded training sample; y: 0 or 1, both present.
    """
    if set(np.unique(y)) != {0.0, 1.0}:
        raise ValueError("both classes are needed")
    d, share = x.shape[1], weights / weights.sum()
    theta, m, s = np.zeros(d + 2), np.zeros(d + 2), np.zeros(d + 2)
    logistic = lambda t: 1 / (1 + np.exp(-np.clip(t, -40, 40)))

    def parts(t):
        e = np.exp(t[:d] - t[:d].max())
        return e / e.sum(), np.logaddexp(0, t[d + 1]) + 1e-6

    for step in range(1, epochs + 1):
        w, gain = parts(theta)
        mean = x @ w
        error = share * (logistic(theta[d] + gain * (mean - 0.5)) - y)
        slope = gain * (x.T @ error) + 2 * penalty * (w - 1 / d)
        grad = np.concatenate([w * (slope - w @ slope), [error.sum(), error @ (mean - 0.5) * logistic(theta[d + 1])]])
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    w, gain = parts(theta)
    return {"weights": w, "intercept": float(theta[d]), "gain": float(gain)}
