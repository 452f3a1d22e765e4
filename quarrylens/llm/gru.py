"""A gated recurrent language model over word codes, in numpy: class-factored softmax, truncated backpropagation.

A code is a head word or a shape, which stands for all words beyond the head of
that shape. Head words have classes of ``CLASS_WORDS`` words by frequency, each
shape is a class of its own. The network gives P(class) and, in a head class,
P(word | class); what a word's part of its shape is, the caller knows.

Documents run in lanes side by side, one after the other in a lane; the state is
carried over windows of ``WINDOW`` tokens and begins anew with each document.
Gradients reach back to the beginning of the window. In training, lanes are
stretches of equal length, and a document that is cut goes on in the next lane
without the state; in scoring, documents are whole.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

HIDDEN, WINDOW, LANES = 16, 24, 384
HEAD_WORDS, CLASS_WORDS, SHAPES = 1024, 32, 32
HEAD_CLASSES = HEAD_WORDS // CLASS_WORDS
CLASSES = HEAD_CLASSES + SHAPES
#: Code of what stands before a document's first token.
START = HEAD_WORDS + SHAPES
RATE = 0.04
F4 = np.float32
#: States whose logits are computed at once.
ROWS = 1024
#: Logits are held below this, so that no exponential overflows.
TOP = F4(60)

SHAPE_OF = {
    "x": (START + 1, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "wc": (HIDDEN, CLASSES), "bc": (CLASSES,),
    "ww": (HEAD_CLASSES, HIDDEN, CLASS_WORDS), "bw": (HEAD_CLASSES, CLASS_WORDS),
}


def initial(head_counts: np.ndarray, shape_counts: np.ndarray) -> dict[str, np.ndarray]:
    """A network that gives each code its share of the corpus, whatever stands before it."""
    rng = np.random.default_rng(0)
    p = {k: rng.normal(0, 0.1, s).astype(F4) for k, s in SHAPE_OF.items()}
    head = head_counts.reshape(HEAD_CLASSES, CLASS_WORDS) + 0.1
    p["bw"] = np.log(head / head.max(1, keepdims=True)).astype(F4)
    p["bc"] = np.log(np.append(head.sum(1), shape_counts + 1.0)).astype(F4)
    p["bc"] -= p["bc"].max()
    p["wc"] *= 0
    p["ww"] *= 0
    p["u"] = np.concatenate([np.linalg.qr(rng.normal(size=(HIDDEN, HIDDEN)))[0] for _ in range(3)], 1).astype(F4) * F4(0.7)
    p["x"][:, :HIDDEN] += 2.0  # slow gates at first: the state remembers
    return p


def pack(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPE_OF])


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPE_OF.items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s).astype(F4)
        at += n
    return out


def lanes(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of tokens as steps x lanes, -1 where a lane has ended; lengths of lanes, descending).

    Long documents first, each to the shortest lane. There are fewer lanes where the
    longest document would leave most of the table empty.
    """
    total, longest = int(sizes.sum()), int(sizes.max())
    n = int(min(most, len(sizes), max(1, 4 * total // longest)))
    starts = np.cumsum(sizes) - sizes
    heap = [(0, k) for k in range(n)]
    held: list[list[int]] = [[] for _ in range(n)]
    for d in np.argsort(-sizes, kind="stable").tolist():
        size, k = heapq.heappop(heap)
        held[k].append(d)
        heapq.heappush(heap, (size + int(sizes[d]), k))
    length = np.array([int(sizes[h].sum()) for h in held])
    order = np.argsort(-length, kind="stable")
    at = np.full((int(length.max()), n), -1, np.int32)
    for col, k in enumerate(order.tolist()):
        d = np.array(held[k])
        at[: length[k], col] = np.repeat(starts[d] - (np.cumsum(sizes[d]) - sizes[d]), sizes[d]) + np.arange(length[k])
    return at, length[order]


def parts(a: np.ndarray) -> np.ndarray:
    """The parts of update, reset and candidate of a matrix, one after the other: steps then work on unbroken stretches of memory."""
    return np.ascontiguousarray(a.reshape(len(a), 3, HIDDEN).transpose(1, 0, 2))


def with_bias(w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bias as a last row of the weights; states have a 1 there."""
    return np.concatenate([w, b[..., None, :]], -2)


def softmax(s: np.ndarray, target: np.ndarray, w: np.ndarray, reach: float, grads: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Log-probabilities of the targets given the states, and gradients by states and weights.

    All are stacks with one matrix of weights each; a row of zeros is no state and has no gradient. No state has an entry beyond ``reach``.
    """
    e = s @ w
    # most networks can't reach the limit, and then the logits need not be gone through
    if reach * np.abs(w).sum(-2).max() > TOP:
        np.minimum(e, TOP, out=e)
    flat = e.reshape(-1)
    own = np.arange(0, e.size, e.shape[-1]) + target.ravel()
    picked = flat.take(own).reshape(target.shape)
    np.exp(e, out=e)
    z = (e.reshape(-1, e.shape[-1]) @ np.ones(e.shape[-1], F4)).reshape(target.shape)
    logp = picked - np.log(z)
    if not grads:
        return logp, None, None
    e *= (1 / z)[..., None]
    flat[own] = np.exp(logp).ravel() - 1
    return logp, e @ w[..., :-1, :].swapaxes(-1, -2), s.swapaxes(-1, -2) @ e


def stacks(count: np.ndarray) -> list[np.ndarray]:
    """Classes that have targets, in groups in which none has over twice another's: few and well-filled stacks."""
    size = np.frexp(count)[1]
    return [np.flatnonzero(size == k) for k in np.unique(size[count > 0])]


class Pass:
    """One window: forward, log-probabilities and, where asked for, gradients."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p

    def forward(self, h: np.ndarray, codes: np.ndarray, first: np.ndarray, keep: bool = True) -> tuple[np.ndarray, tuple]:
        """States after each step (steps x lanes x HIDDEN), and what the way back needs; where it isn't kept, that of the last step."""
        steps, n = codes.shape
        x, u = parts(self.p["x"]), parts(self.p["u"])
        # gates are 1 / (1 + exp(-a))
        np.negative(x[:2], out=x[:2])
        np.negative(u[:2], out=u[:2])
        kept = steps if keep else 1
        before, a_c, out = (np.empty((k, n, HIDDEN), F4) for k in (kept, kept, steps))
        gates, a = np.empty((kept, 3, n, HIDDEN), F4), np.empty((2, n, HIDDEN), F4)
        begin = [np.flatnonzero(f) for f in first]
        for t in range(steps):
            hp, g, uc = before[t % kept], gates[t % kept], a_c[t % kept]
            hp[:] = h
            hp[begin[t]] = 0
            np.take(x, codes[t], axis=1, out=g, mode="clip")
            both, c = g[:2], g[2]
            both += np.matmul(hp, u[:2], out=a)
            np.exp(both, out=both)
            both += 1
            np.reciprocal(both, out=both)
            np.matmul(hp, u[2], out=uc)
            c += np.multiply(g[1], uc, out=a[0])
            np.tanh(c, out=c)
            h = np.subtract(hp, c, out=out[t])
            h *= g[0]
            h += c
        return out, (before, a_c, gates, begin)

    def output(self, states: np.ndarray, target: np.ndarray, grads: dict | None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probability of each target code given the state; and the states' gradients."""
        p, n, train = self.p, len(target), grads is not None
        # by codes, so that a class's targets lie side by side; a row of zeros at the end fills up stacks
        order = np.argsort(target.astype(np.int16), kind="stable")
        code = np.append(target.take(order), 0)
        kind = np.where(code < HEAD_WORDS, code // CLASS_WORDS, code - HEAD_WORDS + HEAD_CLASSES)
        s = np.zeros((n + 1, HIDDEN + 1), F4)
        s[:n, :HIDDEN], s[:n, HIDDEN] = states.take(order, 0), 1
        reach = max(1, s.max(), -s.min())
        logp, back = np.zeros(n + 1, F4), np.zeros((n + 1, HIDDEN), F4) if train else None
        w, dw = with_bias(p["wc"], p["bc"]), np.zeros((HIDDEN + 1, CLASSES), F4)
        for i in range(0, n, ROWS):
            at = slice(i, min(i + ROWS, n))
            logp[at], b, d = softmax(s[at], kind[at], w, reach, train)
            if train:
                back[at] = b
                dw += d
        edge = np.searchsorted(kind[:n], np.arange(HEAD_CLASSES + 1))
        w, dww = with_bias(p["ww"], p["bw"]), np.zeros((HEAD_CLASSES, HIDDEN + 1, CLASS_WORDS), F4)
        word = code % CLASS_WORDS
        more, row, size = [np.zeros((1, HIDDEN), F4)], np.zeros(n + 1, np.int64), 1
        for classes in stacks(np.diff(edge)):
            begin, count = edge[classes, None], edge[classes + 1, None] - edge[classes, None]
            width, most = max(1, ROWS // len(classes)), int(count.max())
            for i in range(0, most, width):
                k = np.arange(i, min(i + width, most))
                at = np.where(k < count, begin + k, n)
                own, b, d = softmax(s.take(at, 0), word.take(at), w[classes], reach, train)
                logp[at] += own
                if train:
                    dww[classes] += d
                    more.append(b.reshape(-1, HIDDEN))
                    row[at] = np.arange(size, size + at.size).reshape(at.shape)
                    size += at.size
        place = np.empty_like(order)
        place[order] = np.arange(n)
        if not train:
            return logp.take(place), None
        grads["wc"], grads["bc"], grads["ww"], grads["bw"] = dw[:-1], dw[-1], dww[:, :-1], dww[:, -1]
        back += np.concatenate(more).take(row, 0)
        return logp.take(place), back.take(place, 0)

    def backward(self, dout: np.ndarray, kept: tuple, codes: np.ndarray, grads: dict) -> None:
        before, a_c, gates, begin = kept
        steps, n = codes.shape
        back = np.ascontiguousarray(parts(self.p["u"]).transpose(0, 2, 1))
        d = np.empty((3, steps, n, HIDDEN), F4)  # by the sums in update, reset and candidate
        da = np.empty((steps, n, HIDDEN), F4)  # by the candidate's product with the state
        dh, rest, part = (np.zeros((n, HIDDEN), F4) for _ in range(3))
        for t in range(steps - 1, -1, -1):
            dh += dout[t]
            z, r, c = gates[t]
            dz, dr, dc = d[0, t], d[1, t], d[2, t]
            np.subtract(1, z, out=rest)
            rest *= dh
            np.subtract(before[t], c, out=dz)
            dz *= rest
            dz *= z
            np.multiply(c, c, out=dc)
            np.subtract(1, dc, out=dc)
            dc *= rest
            np.multiply(dc, r, out=da[t])
            np.subtract(1, r, out=dr)
            dr *= a_c[t]
            dr *= da[t]
            dh *= z
            for k, x in enumerate((dz, dr, da[t])):
                dh += np.matmul(x, back[k], out=part)
            dh[begin[t]] = 0
        state = before.reshape(-1, HIDDEN).T
        grads["u"] = np.concatenate([state @ x.reshape(-1, HIDDEN) for x in (d[0], d[1], da)], 1)
        flat = codes.ravel()
        order = np.argsort(flat.astype(np.int16), kind="stable")
        own, start = np.unique(flat[order], return_index=True)
        grads["x"] = (own, np.concatenate([np.add.reduceat(x.reshape(-1, HIDDEN).take(order, 0), start, axis=0) for x in d], 1))


def stretches(total: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for n lanes of equal length, cut anywhere: no few lanes are left over at the end."""
    length = -(-total // n)
    at = np.arange(n * length, dtype=np.int32).reshape(n, length).T
    return np.where(at < total, at, -1), np.full(n, length)


def windows(codes: np.ndarray, sizes: np.ndarray, at: np.ndarray, length: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(lanes, positions, codes before, whether a document begins, which are tokens) of each window of steps."""
    begin = np.zeros(len(codes), bool)
    begin[np.cumsum(sizes) - sizes] = True
    previous = np.append(START, codes[:-1])
    previous[begin] = START
    for t in range(0, len(at), WINDOW):
        n = int(np.searchsorted(-length, -t))
        pos = at[t : t + WINDOW, :n]
        real = pos >= 0
        safe = np.where(real, pos, 0)
        yield n, safe, np.where(real, previous[safe], START), begin[safe] | ~real, real


def log_probabilities(p: dict[str, np.ndarray], codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Natural log-probability of each token's code given all before it in its document."""
    out = np.zeros(len(codes))
    run, h = Pass(p), np.zeros((LANES, HIDDEN), F4)
    for n, pos, before, first, real in windows(codes, sizes, *lanes(sizes, LANES)):
        states, _ = run.forward(h[:n], before, first, keep=False)
        h = states[-1]
        at = np.flatnonzero(real)
        own = pos.ravel().take(at)
        out[own] = run.output(states.reshape(-1, HIDDEN).take(at, 0), codes.take(own), None)[0]
    return out


class Trainer:
    """Adagrad over the windows of what it is given."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = {k: v.copy() for k, v in p.items()}
        self._sum = {k: np.full_like(v, 1e-6) for k, v in p.items()}
        self.tokens = 0

    def learn(self, codes: np.ndarray, sizes: np.ndarray) -> None:
        # few tokens make fewer lanes, so that there are enough steps
        most = int(np.clip(len(codes) // 4096, min(8, len(codes)), LANES))
        run, h = Pass(self.p), np.zeros((most, HIDDEN), F4)
        for n, pos, before, first, real in windows(codes, sizes, *stretches(len(codes), most)):
            states, kept = run.forward(h[:n], before, first)
            h = states[-1].copy()
            grads: dict = {}
            at = np.flatnonzero(real)
            _, back = run.output(states.reshape(-1, HIDDEN).take(at, 0), codes.take(pos.ravel().take(at)), grads)
            dout = np.zeros_like(states)
            dout.reshape(-1, HIDDEN)[at if len(at) < real.size else slice(None)] = back
            run.backward(dout, kept, before, grads)
            self._step(grads, 1 / (WINDOW * most))
        self.tokens += len(codes)

    def _step(self, grads: dict, scale: float) -> None:
        for k, g in grads.items():
            at: slice | np.ndarray = slice(None)
            if k == "x":
                at, g = g
            g = g * F4(scale)
            s = self._sum[k][at] + g * g
            self._sum[k][at] = s
            self.p[k][at] -= F4(RATE) * g / np.sqrt(s)
