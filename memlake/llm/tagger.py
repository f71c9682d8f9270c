"""A character-level bidirectional LSTM with CRF transitions, in numpy: training and decoding."""

import numpy as np

#: Characters that have a vector of their own; every other one shares a vector with its class.
ALPHABET = "0123456789@.+-_()%[]:/, \n" + "abcdefghijklmnopqrstuvwxyz" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_IDS = np.full(129, 1, dtype=np.int16)
_IDS[[ord(c) for c in ALPHABET]] = np.arange(2, len(ALPHABET) + 2)
_IDS[128] = 1
SYMBOLS = len(ALPHABET) + 2  # 0 pads, 1 is any other character


def symbols(code: np.ndarray) -> np.ndarray:
    return _IDS[np.minimum(code, 128)]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logsum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def new(tags: int, size: int = 20, seed: int = 0) -> dict[str, np.ndarray]:
    """Fresh weights; the symbol vectors are folded into the gates' input table."""
    r = np.random.default_rng(seed)
    p = {}
    for d in ("f", "b"):
        p[f"in_{d}"] = r.normal(0, 0.3, (SYMBOLS, 4 * size))
        p[f"in_{d}"][:, size:2 * size] += 1  # forget gates start open
        p[f"rec_{d}"] = r.normal(0, 1 / np.sqrt(size), (size, 4 * size))
    p["out"] = r.normal(0, 0.2, (2 * size, tags))
    p["bias"] = np.zeros(tags)
    p["move"] = np.zeros((tags, tags))
    return {k: v.astype(np.float32) for k, v in p.items()}


def _direction(x, p, d, keep):
    """Hidden states of one direction for windows of symbols x (windows, length)."""
    rec = p[f"rec_{d}"]
    n, length, size = *x.shape, len(rec)
    h, c = np.zeros((n, size), rec.dtype), np.zeros((n, size), rec.dtype)
    out, steps = np.zeros((length, n, size), rec.dtype), []
    order = range(length) if d == "f" else range(length - 1, -1, -1)
    for t in order:
        z = p[f"in_{d}"][x[:, t]] + h @ rec
        gate = _sigmoid(z[:, :3 * size])
        i, f, o, g = gate[:, :size], gate[:, size:2 * size], gate[:, 2 * size:], np.tanh(z[:, 3 * size:])
        before = (h, c)
        c = f * c + i * g
        s = np.tanh(c)
        h = o * s
        out[t] = h
        if keep:
            steps.append((t, *before, i, f, o, g, s))
    return out, steps


def emissions(x, p, keep=False):
    """Tag scores (length, windows, tags) and what backward() needs."""
    f, fs = _direction(x, p, "f", keep)
    b, bs = _direction(x, p, "b", keep)
    both = np.concatenate((f, b), axis=2)
    return both @ p["out"] + p["bias"], (both, fs, bs)


def loss_and_gradient(x, y, p):
    """Mean negative log likelihood of tags y per window, and its gradient. Symbol 0 is padding
    behind the window's end; there the tags must be 0 and count like any other."""
    n, length = x.shape
    e, (both, fs, bs) = emissions(x, p, keep=True)
    move = p["move"]
    a, z = np.empty_like(e), np.zeros_like(e)
    a[0] = e[0]
    for t in range(1, length):
        a[t] = _logsum(a[t - 1][:, :, None] + move, 1) + e[t]
    for t in range(length - 2, -1, -1):
        z[t] = _logsum(move + (e[t + 1] + z[t + 1])[:, None, :], 2)
    total = _logsum(a[-1], 1)
    rows = np.arange(n)
    de = np.exp(a + z - total[None, :, None])
    dmove = np.zeros_like(move)
    gold = np.zeros(n)
    for t in range(length):
        de[t][rows, y[:, t]] -= 1
        gold += e[t][rows, y[:, t]]
        if t:
            pair = np.exp(a[t - 1][:, :, None] + move + (e[t] + z[t])[:, None, :] - total[:, None, None])
            dmove += pair.sum(0)
            np.add.at(dmove, (y[:, t - 1], y[:, t]), -1)
            gold += move[y[:, t - 1], y[:, t]]
    de /= n
    tags = e.shape[2]
    grad = {"move": dmove / n, "bias": de.sum((0, 1)),
            "out": both.reshape(-1, both.shape[2]).T @ de.reshape(-1, tags)}
    dboth = de @ p["out"].T
    size = both.shape[2] // 2
    ones = (x.T[:, :, None] == np.arange(SYMBOLS)).astype(e.dtype)
    for d, steps, dh_all in (("f", fs, dboth[:, :, :size]), ("b", bs, dboth[:, :, size:])):
        rec = p[f"rec_{d}"]
        din, drec = np.zeros_like(p[f"in_{d}"]), np.zeros_like(rec)
        dh, dc = np.zeros((n, size), rec.dtype), np.zeros((n, size), rec.dtype)
        for t, h0, c0, i, f, o, g, s in reversed(steps):
            dh = dh + dh_all[t]
            dc = dc + dh * o * (1 - s * s)
            dz = np.concatenate((dc * g * i * (1 - i), dc * c0 * f * (1 - f),
                                 dh * s * o * (1 - o), dc * i * (1 - g * g)), axis=1)
            din += ones[t].T @ dz
            drec += h0.T @ dz
            dh, dc = dz @ rec.T, dc * f
        grad[f"in_{d}"], grad[f"rec_{d}"] = din, drec
    return float((total - gold).mean()), grad


def train(x, y, tags, size=20, epochs=6, batch=64, rate=0.02, seed=0):
    """Fit by Adam over shuffled batches of labelled windows."""
    p = new(tags, size, seed)
    m, v, k = {a: 0 for a in p}, {a: 0 for a in p}, 0
    r = np.random.default_rng(seed)
    for epoch in range(epochs):
        order = r.permutation(len(x))
        for at in range(0, len(x), batch):
            some = order[at:at + batch]
            _, g = loss_and_gradient(x[some], y[some], p)
            k += 1
            norm = np.sqrt(sum(float((q ** 2).sum()) for q in g.values()))
            for a in p:
                q = g[a] * min(1, 5 / max(norm, 1e-9))
                m[a], v[a] = 0.9 * m[a] + 0.1 * q, 0.999 * v[a] + 0.001 * q * q
                step = rate * (1 - 0.7 * epoch / epochs)
                p[a] = (p[a] - step * (m[a] / (1 - 0.9 ** k)) / (np.sqrt(v[a] / (1 - 0.999 ** k)) + 1e-8)).astype(np.float32)
    return p


def decode(x, p) -> np.ndarray:
    """The best tags of each window by Viterbi: (windows, length)."""
    e, _ = emissions(x, p)
    length, n, tags = e.shape
    score, back = e[0], np.zeros((length, n, tags), np.int8)
    for t in range(1, length):
        step = score[:, :, None] + p["move"]
        back[t] = step.argmax(1)
        score = step.max(1) + e[t]
    out = np.zeros((n, length), np.int8)
    out[:, -1] = score.argmax(1)
    for t in range(length - 1, 0, -1):
        out[:, t - 1] = back[t][np.arange(n), out[:, t]]
    return out
