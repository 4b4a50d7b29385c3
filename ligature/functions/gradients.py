"""Gradients of the encoders' losses in NumPy, and the Adam step. Parameters are dictionaries of arrays."""

from __future__ import annotations

import numpy as np

from . import encoders as E

#: The chosen Fourier coefficients of 12 numbers as a matrix: place -> harmonic -> (real, imaginary).
WAVES = np.array([[[np.cos(2 * np.pi * h * t / 12), -np.sin(2 * np.pi * h * t / 12)] for h in E.HARMONICS] for t in range(12)]) / np.sqrt(12)


def circular_back(x, w, dilation, out):
    """(d_x, d_w, d_b) of E.circular."""
    rows = out.transpose(0, 2, 1).reshape(-1, len(w))
    taps = E.taps_of(x, dilation).reshape(len(rows), -1)
    back = (rows @ E.rows_of(w).T).reshape(len(x), 12, 3, -1)
    d_x = sum(np.roll(back[:, :, k], (k - 1) * dilation, axis=1) for k in range(3)).transpose(0, 2, 1)
    d_w = (rows.T @ taps).reshape(len(w), 3, -1).transpose(0, 2, 1)
    return d_x, d_w, out.sum(axis=(0, 2))


def group_norm_back(x, gain, out):
    g = x.reshape(len(x), E.GROUPS, -1)
    scale = 1 / np.sqrt(g.var(axis=2, keepdims=True) + 1e-5)
    hat = (g - g.mean(axis=2, keepdims=True)) * scale
    d_gain, d_shift = (out * hat.reshape(x.shape)).sum(axis=(0, 2)), out.sum(axis=(0, 2))
    d = (out * gain[None, :, None]).reshape(g.shape)
    d_x = scale * (d - d.mean(axis=2, keepdims=True) - hat * (d * hat).mean(axis=2, keepdims=True))
    return d_x.reshape(x.shape), d_gain, d_shift


def forward(v: np.ndarray, w: dict) -> tuple[np.ndarray, tuple]:
    """E.harmonic(v, w), and what its gradient needs of the layers."""
    x0 = E.l1_or_zero(v)[:, None, :]
    x1 = np.concatenate([E.circular(x0, w[f"branch{d}"], w[f"bias{d}"], d) for d in E.DILATIONS], axis=1)
    x2 = E.group_norm(x1, w["stem_gain"], w["stem_shift"])
    x3 = E.relu(x2)
    y1 = E.circular(x3, w["first"], w["first_bias"], 1)
    y2 = E.group_norm(y1, w["norm1_gain"], w["norm1_shift"])
    y3 = E.relu(y2)
    y4 = E.circular(y3, w["second"], w["second_bias"], 1)
    z = E.relu(x3 + E.group_norm(y4, w["norm2_gain"], w["norm2_shift"]))
    signal = np.einsum("bcx,oc->box", z, w["project"])
    raw = np.einsum("box,xhr->bohr", signal, WAVES).reshape(len(v), -1)
    norm = np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-12)
    unit = raw / norm
    return unit, (x0, x1, x2, x3, y1, y2, y3, y4, z, norm, unit)


def harmonic_back(v: np.ndarray, w: dict, out: np.ndarray) -> dict:
    """The gradient of sum(out * E.harmonic(v, w)) in w."""
    return backward(forward(v, w)[1], w, out)


def backward(layers: tuple, w: dict, out: np.ndarray) -> dict:
    """harmonic_back from the layers of forward."""
    x0, x1, x2, x3, y1, y2, y3, y4, z, norm, unit = layers
    d_raw = (out - unit * (out * unit).sum(axis=1, keepdims=True)) / norm
    d_signal = np.einsum("bohr,xhr->box", d_raw.reshape(len(out), E.PROJECTED, len(E.HARMONICS), 2), WAVES)
    g = {"project": np.einsum("box,bcx->oc", d_signal, z)}
    d_z = np.einsum("box,oc->bcx", d_signal, w["project"]) * (z > 0)
    d_y4, g["norm2_gain"], g["norm2_shift"] = group_norm_back(y4, w["norm2_gain"], d_z)
    d_y3, g["second"], g["second_bias"] = circular_back(y3, w["second"], 1, d_y4)
    d_y1, g["norm1_gain"], g["norm1_shift"] = group_norm_back(y1, w["norm1_gain"], d_y3 * (y2 > 0))
    d_x3, g["first"], g["first_bias"] = circular_back(x3, w["first"], 1, d_y1)
    d_x1, g["stem_gain"], g["stem_shift"] = group_norm_back(x1, w["stem_gain"], (d_x3 + d_z) * (x2 > 0))
    for k, d in enumerate(E.DILATIONS):
        _, g[f"branch{d}"], g[f"bias{d}"] = circular_back(x0, w[f"branch{d}"], d, d_x1[:, k * E.BRANCH : (k + 1) * E.BRANCH])
    return g


def pair_loss(left, right, label, weight, w: dict) -> tuple[float, dict]:
    """Weighted cross entropy of boundaries from distances, and its gradient; w also has `raw_scale` and `bias`."""
    (a, left), (b, right) = forward(left, w), forward(right, w)
    gap = a - b
    d = np.linalg.norm(gap, axis=1)
    scale = np.logaddexp(0, w["raw_scale"])
    logit = scale * d + w["bias"]
    loss = float((weight * (np.logaddexp(0, logit) - label * logit)).sum())
    error = weight * (1 / (1 + np.exp(-logit)) - label)
    out = (error * scale)[:, None] * gap / np.maximum(d, 1e-12)[:, None]
    one, two = backward(left, w, out), backward(right, w, -out)
    g = {k: one[k] + two[k] for k in one}
    return loss, g | {"raw_scale": np.asarray((error * d).sum() / (1 + np.exp(-w["raw_scale"]))), "bias": np.asarray(error.sum())}


def policy_back(x: np.ndarray, w: dict, out: np.ndarray) -> dict:
    """The gradient of sum(out * E.policy(x, w)) in w."""
    h0 = E.relu(x @ w["w0"] + w["b0"])
    h1 = E.relu(h0 @ w["w1"] + w["b1"])
    d2 = out[:, None]
    d1 = (d2 @ w["w2"].T) * (h1 > 0)
    d0 = (d1 @ w["w1"].T) * (h0 > 0)
    return {"w2": h1.T @ d2, "b2": d2.sum(0), "w1": h0.T @ d1, "b1": d1.sum(0), "w0": x.T @ d0, "b0": d0.sum(0)}


def policy_input_back(x: np.ndarray, w: dict, out: np.ndarray) -> np.ndarray:
    """The gradient of sum(out * E.policy(x, w)) in x."""
    h0 = E.relu(x @ w["w0"] + w["b0"])
    h1 = E.relu(h0 @ w["w1"] + w["b1"])
    d1 = (out[:, None] @ w["w2"].T) * (h1 > 0)
    return ((d1 @ w["w1"].T) * (h0 > 0)) @ w["w0"].T


def pair_features_back(left: np.ndarray, right: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gradients of sum(out * E.pair_features(left, right)) in left and right."""
    a, b = (x.reshape(len(x), E.PAIRS, 2) for x in (left, right))
    own_a, own_b, apart = (out[:, k * E.PAIRS : (k + 1) * E.PAIRS, None] for k in range(3))
    turn = out[:, 3 * E.PAIRS : 5 * E.PAIRS].reshape(len(out), E.PAIRS, 2)
    unit = lambda z: z / np.maximum(np.linalg.norm(z, axis=2, keepdims=True), 1e-12)
    real, imag = turn[..., :1], turn[..., 1:]
    swap = lambda z: np.concatenate([-z[..., 1:], z[..., :1]], axis=2)
    away = apart * unit(a - b)
    d_a = own_a * unit(a) + away + real * b + imag * swap(b)
    d_b = own_b * unit(b) - away + real * a - imag * swap(a)
    return d_a.reshape(left.shape), d_b.reshape(right.shape)


def candidates_back(vectors: np.ndarray, clusters: list[tuple[int, int]], w: dict, out: np.ndarray) -> dict:
    """The gradient of sum(out * E.candidates(vectors, clusters, w)) in w: through the merged vectors of the clusters."""
    merged = np.array([vectors[i:j].sum(axis=0) for i, j in clusters])
    emb = E.harmonic(merged, w)
    d = np.zeros_like(emb)
    left, right = pair_features_back(emb[:-1], emb[1:], out[:, : E.PAIR_FEATURES])
    d[:-1] += left
    d[1:] += right
    return harmonic_back(merged, w, d)


class Adam:
    """Steps of Adam with decoupled weight decay."""

    def __init__(self, rate: float, decay: float = 0.0) -> None:
        self.rate, self.decay, self.n, self.m, self.s = rate, decay, 0, {}, {}

    def step(self, w: dict, g: dict, most: float | None = None) -> dict:
        """New weights; gradients with a norm over most are scaled down to it."""
        norm = np.sqrt(sum(float((x**2).sum()) for x in g.values()))
        shrink = 1.0 if most is None or norm <= most else most / norm
        self.n += 1
        out = {}
        for k, x in w.items():
            if k not in g:
                out[k] = x
                continue
            d = g[k] * shrink
            self.m[k] = 0.9 * self.m.get(k, 0.0) + 0.1 * d
            self.s[k] = 0.999 * self.s.get(k, 0.0) + 0.001 * d**2
            step = self.m[k] / (1 - 0.9**self.n) / (np.sqrt(self.s[k] / (1 - 0.999**self.n)) + 1e-8)
            out[k] = x * (1 - self.rate * self.decay) - self.rate * step
        return out


def flat(g: dict) -> np.ndarray:
    return np.concatenate([np.ravel(g[k]) for k in sorted(g)])


def shaped(v: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        n = np.size(like[k])
        out[k] = np.reshape(v[at : at + n], np.shape(like[k]))
        at += n
    return out
