"""A gated recurrent language model in numpy: truncated backpropagation, class-factored softmax.

Token 0 ends a text, token 1 stands for all words outside the vocabulary.  Token t is in class
t // WIDTH; its probability is that of its class times its own within the class, both softmaxes of
the hidden state.  Texts run in lanes, side by side, in windows of a fixed number of steps; the state
is carried from window to window and starts anew with each text.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

END, UNKNOWN = 0, 1
_BREAK = -1  # the end of a text in a lane
WIDTH = 32  # tokens of a class
STEPS = 32  # tokens of a window
F32 = np.float32


def new_model(counts: np.ndarray, hidden: int = 16, seed: int = 7) -> dict[str, np.ndarray]:
    """A model that starts from the tokens' frequencies; counts has a multiple of WIDTH entries."""
    rng, n = np.random.default_rng(seed), len(counts)
    p = (counts + 0.5) / (counts.sum() + 0.5 * n)
    own = p.reshape(-1, WIDTH)
    scale = 1 / np.sqrt(hidden)
    return {
        "x": (rng.standard_normal((n, 3 * hidden)) * 0.1).astype(F32),
        "u": (rng.standard_normal((hidden, 3 * hidden)) * scale).astype(F32),
        "b": np.concatenate([np.zeros(2 * hidden), np.zeros(hidden)]).astype(F32),
        "c": np.zeros((hidden, len(own)), dtype=F32),
        "cb": np.log(own.sum(axis=1)).astype(F32),
        "w": np.zeros((len(own), hidden, WIDTH), dtype=F32),
        "wb": np.log(own / own.sum(axis=1, keepdims=True)).astype(F32),
    }


def _sigmoid(a: np.ndarray) -> np.ndarray:
    """Of ``a``, in its place."""
    np.negative(a, out=a)
    np.exp(a, out=a)
    a += 1
    return np.reciprocal(a, out=a)


def _run(m: dict, inputs: np.ndarray, fresh: np.ndarray, h: np.ndarray, tape: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """States after each step [steps, lanes, hidden] and the last; fresh marks steps where a text starts."""
    k = h.shape[1]
    out = np.empty((inputs.shape[1], *h.shape), dtype=F32)
    given = m["x"][inputs.T] + m["b"]
    for t in range(inputs.shape[1]):
        if fresh[:, t].any():
            h = h * ~fresh[:, t, None]
        a = h @ m["u"]
        gates = _sigmoid(given[t, :, : 2 * k] + a[:, : 2 * k])
        z, r = gates[:, :k], gates[:, k:]
        new = r * a[:, 2 * k :]
        new += given[t, :, 2 * k :]
        np.tanh(new, out=new)
        if tape is not None:
            tape.append((h, z, r, new, a[:, 2 * k :]))
        h = h - new
        h *= z
        h += new
        out[t] = h
    return out, h


def _log_prob_of(weights: np.ndarray, bias: np.ndarray, h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log softmax of each row's logits at one place; logits stand in columns, where numpy reduces them fastest."""
    a = weights.T @ h.T
    a += bias[:, None]
    own, top = a[at, np.arange(len(at))], a.max(axis=0)
    a -= top
    np.exp(a, out=a)
    return own - top - np.log(a.sum(axis=0))


def _by_class(targets: np.ndarray):
    """For each class among the targets, the class and where its tokens are."""
    classes = (targets // WIDTH).astype(np.int16)  # sorted by radix
    order = np.argsort(classes, kind="stable")
    cuts = np.flatnonzero(np.diff(classes[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            yield classes[rows[0]], rows


def _log_probs(m: dict, h: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """The natural log probability of each target after its state."""
    out = _log_prob_of(m["c"], m["cb"], h, targets // WIDTH)
    for c, rows in _by_class(targets):
        out[rows] += _log_prob_of(m["w"][c], m["wb"][c], h[rows], targets[rows] % WIDTH)
    return out


class Lanes:
    """Texts in lanes, side by side, each followed by END.  Only one window is laid out at a time: memory follows the tokens, however long one text is."""

    def __init__(self, texts: list[np.ndarray], lanes: int):
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        filled: list[list[int]] = [[] for _ in range(min(lanes, len(texts)))]
        heap = [(0, j) for j in range(len(filled))]
        for i in order:
            size, j = heap[0]
            filled[j].append(i)
            heapq.heapreplace(heap, (size + len(texts[i]) + 1, j))
        size_of = {j: size for size, j in heap}
        rank = sorted(size_of, key=lambda j: -size_of[j])  # the longest lane is first
        end = np.array([_BREAK], dtype=np.int32)
        self.sizes = np.array([size_of[j] for j in rank], dtype=np.int64)
        #: the token before and after each step: a text's inputs are END and its words, its targets its words and END
        self.tokens = [np.concatenate([end, *[x for i in filled[j] for x in (texts[i], end)]]).astype(np.int32) for j in rank]
        self.owners = np.array([i for j in rank for i in filled[j]], dtype=np.int64)
        self.first = np.cumsum([0, *[len(filled[j]) for j in rank]])[:-1]

    @property
    def steps(self) -> int:
        return int(self.sizes.max()) if len(self.sizes) else 0

    def windows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Inputs, targets, whether they are used, starts of texts, and the text of each step, as [lanes, steps] of each window's live lanes."""
        over = np.zeros(len(self.sizes), dtype=np.int64)  # texts that ended before, by lane
        for at in range(0, self.steps, STEPS):
            live = int((self.sizes > at).sum())
            laid = np.zeros((live, STEPS + 1), dtype=np.int32)
            for row in range(live):
                part = self.tokens[row][at : at + STEPS + 1]
                laid[row, : len(part)] = part
            breaks = laid == _BREAK
            laid[breaks] = END
            used = np.arange(at, at + STEPS) < self.sizes[:live, None]
            ends = np.cumsum(breaks[:, 1:], axis=1)
            before = np.concatenate([np.zeros((live, 1), dtype=np.int64), ends[:, :-1]], axis=1)
            place = np.minimum(self.first[:live, None] + over[:live, None] + before, len(self.owners) - 1)
            over[:live] += ends[:, -1]
            yield laid[:, :-1], laid[:, 1:], used, breaks[:, :-1], self.owners[place]


def log_likelihoods(m: dict, texts: list[np.ndarray], lanes: int = 1024) -> np.ndarray:
    """The natural log probability of each whole text, its end included."""
    total = np.zeros(len(texts))
    h = np.zeros((min(lanes, len(texts)), m["u"].shape[0]), dtype=F32)
    for inputs, targets, used, fresh, owner in Lanes(texts, lanes).windows():
        states, h = _run(m, inputs, fresh, h[: len(inputs)])
        on = used.T.ravel()
        p = _log_probs(m, states.reshape(-1, h.shape[1])[on], targets.T.ravel()[on])
        total += np.bincount(owner.T.ravel()[on], weights=p, minlength=len(texts))
    return total


def _softmax_loss(weights: np.ndarray, bias: np.ndarray, x: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Gradients by weights, bias and x of the softmax's loss, summed over the rows of x and divided by n, and that loss; logits stand in columns."""
    a, each = weights.T @ x.T, np.arange(len(at))
    a += bias[:, None]
    a -= a.max(axis=0)
    own = a[at, each]
    np.exp(a, out=a)
    total = a.sum(axis=0)
    loss = float((np.log(total) - own).sum())
    a /= total
    a[at, each] -= 1
    a /= F32(n)
    return (a @ x).T, a.sum(axis=1), (weights @ a).T, loss


def gradients(m: dict, inputs: np.ndarray, targets: np.ndarray, used: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray, float]:
    """Gradients of the mean loss over one window, the state after it, and the loss; nothing flows back beyond the window."""
    k, tape = h.shape[1], []
    states, last = _run(m, inputs, fresh, h, tape)
    flat, want = states.reshape(-1, k), targets.T.ravel()
    rows = np.flatnonzero(used.T.ravel())
    rows = rows[np.argsort((want[rows] // WIDTH).astype(np.int16), kind="stable")]  # by class
    n, x, y = max(len(rows), 1), flat[rows], want[rows]
    g = {"w": np.zeros_like(m["w"]), "wb": np.zeros_like(m["wb"]), "x": np.zeros_like(m["x"])}
    g["c"], g["cb"], back, loss = _softmax_loss(m["c"], m["cb"], x, y // WIDTH, n)
    cuts = np.searchsorted(y // WIDTH, np.arange(len(m["w"]) + 1))
    for c in np.flatnonzero(np.diff(cuts)):
        own = np.s_[cuts[c] : cuts[c + 1]]
        g["w"][c], g["wb"][c], more, lost = _softmax_loss(m["w"][c], m["wb"][c], x[own], y[own] % WIDTH, n)
        back[own] += more
        loss += lost
    dh_out = np.zeros_like(flat)
    dh_out[rows] = back
    dh_out = dh_out.reshape(states.shape)
    dx = np.empty((inputs.shape[1], inputs.shape[0], 3 * k), dtype=F32)
    da = np.empty_like(dx)
    carried = np.zeros_like(h)
    on = ~fresh
    for t in reversed(range(inputs.shape[1])):
        was, z, r, new, an = tape[t]
        dh = dh_out[t] + carried
        dnew = dh * (1 - z)
        dnew *= 1 - new * new
        dx[t, :, :k] = dh * (was - new) * z * (1 - z)
        dx[t, :, k : 2 * k] = dnew * an * r * (1 - r)
        dx[t, :, 2 * k :] = dnew
        da[t, :, : 2 * k] = dx[t, :, : 2 * k]
        np.multiply(dnew, r, out=da[t, :, 2 * k :])
        dh *= z
        dh += da[t] @ m["u"].T
        carried = dh * on[:, t, None]
    before = np.stack([step[0] for step in tape]).reshape(-1, k)
    g["u"] = before.T @ da.reshape(-1, 3 * k)
    flat_dx, tokens = dx.reshape(-1, 3 * k), inputs.T.ravel()
    g["b"] = flat_dx.sum(axis=0)
    order = np.argsort(tokens, kind="stable")
    starts = np.flatnonzero(np.diff(tokens[order], prepend=-1))
    g["x"][tokens[order][starts]] = np.add.reduceat(flat_dx[order], starts, axis=0)
    return g, last, loss / n


def train(m: dict, texts: list[np.ndarray], lanes: int = 512, rate: float = 0.02) -> dict[str, np.ndarray]:
    """The model after Adam steps over windows of all texts, once; few tokens run in fewer lanes, for as many steps."""
    m = {name: v.copy() for name, v in m.items()}
    if not texts:
        return m
    laid = Lanes(texts, min(lanes, max(1, sum(map(len, texts)) // (128 * STEPS))))
    first, second, k = {n: np.zeros_like(v) for n, v in m.items()}, {n: np.zeros_like(v) for n, v in m.items()}, 0
    total = -(-laid.steps // STEPS)
    h = np.zeros((len(laid.sizes), m["u"].shape[0]), dtype=F32)
    for inputs, targets, used, fresh, _ in laid.windows():
        g, h, _ = gradients(m, inputs, targets, used, fresh, h[: len(inputs)])
        k += 1
        size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        lr = rate * (1 - 0.9 * k / total) * np.sqrt(1 - 0.99**k) / (1 - 0.9**k)
        for name, v in g.items():
            if size > 1:
                v /= F32(size)
            first[name] += F32(0.1) * (v - first[name])
            second[name] += F32(0.01) * (v * v - second[name])
            m[name] -= F32(lr) * first[name] / (np.sqrt(second[name]) + F32(1e-8))
    return m


def pack(m: dict) -> np.ndarray:
    """All parameters as one vector."""
    return np.concatenate([m[name].ravel() for name in sorted(m)])


def unpack(vector: np.ndarray, like: dict) -> dict[str, np.ndarray]:
    """The parameters again, shaped like those of another model."""
    out, at = {}, 0
    for name in sorted(like):
        n = like[name].size
        out[name] = np.asarray(vector[at : at + n], dtype=F32).reshape(like[name].shape)
        at += n
    return out
