"""A small causal self-attention model in numpy: forward, gradients, and training steps.

Inputs and outputs are classes of subword ids: frequent ids are classes of their own, the
others share classes of about equal weight, within which the corpus counts give the
probabilities.  The output is a tree of two levels: a softmax over groups of classes, and one
over the classes of the group.  One attention layer with learnt positions and one hidden
layer, each added to what comes in.  Windows of a text overlap, and every token is scored once, in the window
that gives it the longest context.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WINDOW = 64
STRIDE = 48
WIDTH = 32
HIDDEN = 48
OWN_CLASSES = 896
SHARED_CLASSES = 128
GROUP = 32
RATE = 1e-2
STEP_WINDOWS = 18
#: Sums below ``TINY`` move no weight; they become zero now and then, as arithmetic on denormal numbers is slow.
TINY = 1e-30
FLUSH_STEPS = 64
SHAPES = (
    "embed", "place", "query", "key", "value", "mixed", "up", "up_bias", "down", "out", "out_bias", "leaf", "leaf_bias"
)


@dataclass(frozen=True)
class Classes:
    """Class of each subword id and the log probability of the id within its class."""

    of: np.ndarray
    within: np.ndarray
    prior: np.ndarray  # log probability of each class

    @classmethod
    def from_counts(cls, counts: np.ndarray, own: int = OWN_CLASSES, shared: int = SHARED_CLASSES) -> Classes:
        weight = counts.astype(np.float64) + 1.0
        order = np.argsort(-counts, kind="stable")
        of = np.empty(len(counts), np.int64)
        of[order[:own]] = np.arange(own)
        tail = order[own:]
        if len(tail):
            upto = np.cumsum(weight[tail])
            of[tail] = own + np.minimum((shared * (upto - weight[tail] / 2) / upto[-1]).astype(np.int64), shared - 1)
        total = np.bincount(of, weight, own + shared)
        return cls(of, np.log(weight / total[of]), np.log((total + 1e-3) / weight.sum()))

    @property
    def size(self) -> int:
        return len(self.prior)


def fresh(classes: Classes, seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    c = classes.size

    def drawn(*shape: int, scale: float) -> np.ndarray:
        return (rng.normal(size=shape) * scale).astype(np.float32)

    d = WIDTH
    return {
        "embed": drawn(c + 1, d, scale=0.5),
        "place": drawn(WINDOW, d, scale=0.1),
        "query": drawn(d, d, scale=d**-0.5),
        "key": drawn(d, d, scale=d**-0.5),
        "value": drawn(d, d, scale=d**-0.5),
        "mixed": drawn(d, d, scale=d**-0.5),
        "up": drawn(d, HIDDEN, scale=d**-0.5),
        "up_bias": np.zeros(HIDDEN, np.float32),
        "down": drawn(HIDDEN, d, scale=HIDDEN**-0.5),
        "out": drawn(d, c // GROUP, scale=0.02),
        "out_bias": (top := np.log(np.exp(classes.prior).reshape(-1, GROUP).sum(axis=1))).astype(np.float32),
        "leaf": drawn(c // GROUP, d, GROUP, scale=0.02),
        "leaf_bias": (classes.prior.reshape(-1, GROUP) - top[:, None]).astype(np.float32),
    }


def packed(model: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([model[k].ravel() for k in SHAPES]).astype(np.float32, copy=False)


def unpacked(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in SHAPES:
        n = like[k].size
        out[k] = flat[at : at + n].reshape(like[k].shape).astype(np.float32)
        at += n
    return out


_SEEN = np.tril(np.ones((WINDOW, WINDOW), np.float32))
_SAFE = 60.0


def _exp(z: np.ndarray) -> np.ndarray:
    """exp in place; rows are only shifted where values are large."""
    if z.size and not -_SAFE < float(z.min()) <= float(z.max()) < _SAFE:
        z -= z.max(axis=-1, keepdims=True)
        np.maximum(z, -_SAFE, out=z)
    return np.exp(z, out=z)


def _ways(model) -> tuple[np.ndarray, np.ndarray]:
    """Weights from an input to what the inputs it looks back at are multiplied with (scaled), and from their mean to the sum.

    These are products of queries with keys and of values with ``mixed``, so neither keys nor values are worked out.
    """
    return model["query"] * np.float32(WIDTH**-0.5) @ model["key"].T, model["value"] @ model["mixed"]


def _totals(z: np.ndarray) -> np.ndarray:
    """Sums over the last axis, as a column."""
    return z @ np.ones((z.shape[-1], 1), z.dtype)


def _embedded(model, x: np.ndarray) -> np.ndarray:
    e = model["embed"].take(x, axis=0)
    e += model["place"][: x.shape[1]]
    return e


def _shares(asking: np.ndarray, turned: np.ndarray, since: int) -> np.ndarray:
    """Undivided shares of the inputs (``turned``: width by position) for positions from ``since`` on."""
    a = _exp(asking @ turned)
    a *= _SEEN[since : since + a.shape[1], : a.shape[2]]
    return a


def _added(model, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hidden layer, what it and its input add up to)."""
    r = h @ model["up"]
    r += model["up_bias"]
    np.maximum(r, 0, out=r)
    g = r @ model["down"]
    g += h
    return r, g


def _hidden(model, x, since: int = 0):
    """Everything up to the output layer for positions from ``since`` on, which comes last."""
    near, far = _ways(model)
    e = _embedded(model, x)
    own = e[:, since:]
    a = _shares(own @ near, np.ascontiguousarray(e.transpose(0, 2, 1)), since)
    m = a @ e
    m /= _totals(a)
    h = m @ far
    h += own
    r, g = _added(model, h.reshape(-1, WIDTH))
    return h, r, g.reshape(h.shape)


def _by_group(own: np.ndarray):
    """(order of the classes by group, (group, first, end) of every group that occurs in that order)."""
    group = (own // GROUP).astype(np.uint16)
    order = np.argsort(group, kind="stable")
    ends = np.cumsum(np.bincount(group)).tolist()
    return order, [(c, a, b) for c, (a, b) in enumerate(zip([0, *ends], ends)) if a < b]


def _leaf_logits(model, rows: np.ndarray, group: np.ndarray, runs, out: np.ndarray) -> None:
    """Logits within the groups, of rows that lie in the order of their groups."""
    leaf = model["leaf"]
    for c, a, b in runs:
        np.dot(rows[a:b], leaf[c], out=out[a:b])
    out += model["leaf_bias"].reshape(-1, GROUP).take(group, axis=0)


def log_probability(model, classes: Classes, x: np.ndarray, target: np.ndarray, asked: np.ndarray, since: int = 0) -> np.ndarray:
    """Natural log probability of the asked targets; ``x`` are classes of the tokens before them.

    No position before ``since`` may be asked.
    """
    ids = target[asked]
    own = classes.of.take(ids)
    order, runs = _by_group(own)
    g = _hidden(model, x, since)[-1]
    g = g.reshape(-1, WIDTH).take(np.flatnonzero(asked[:, since:]).take(order), axis=0)
    own, n = own.take(order), len(order)
    z = np.empty((2, n, GROUP), g.dtype)
    np.matmul(g, model["out"], out=z[0])
    z[0] += model["out_bias"]
    group = own // GROUP
    _leaf_logits(model, g, group, runs, z[1])
    z = _exp(z.reshape(-1, GROUP))
    p = z.take(np.arange(0, z.size, GROUP) + np.concatenate([group, own % GROUP])) / _totals(z)[:, 0]
    out = np.empty(n)
    out[order] = np.log(np.maximum(p[:n] * p[n:], 1e-30).astype(np.float64))
    return out + classes.within.take(ids)


def _softmax_gradient(z, y, n: int):
    """(log probability of every row's ``y``, gradient of the losses' sum over ``n``), the latter in place of the logits."""
    at = np.arange(0, z.size, z.shape[-1]) + y
    p = _exp(z)
    total = _totals(p)
    chosen = p.take(at) / total[:, 0]
    total *= n
    p /= total
    p.reshape(-1)[at] -= 1 / n
    return np.log(np.maximum(chosen, 1e-30)), p


def _column_sums(z: np.ndarray) -> np.ndarray:
    return np.ones(len(z), z.dtype) @ z


def _asking_parts(asked: np.ndarray) -> list[tuple[np.ndarray | slice, int, int, int, int]]:
    """(windows, first, end position, first, end row) of what is worked out: each position is a row.

    The beginning of a window that asks for nothing there, as later windows do, is only looked back at.
    """
    n, t = asked.shape
    cut = min(WINDOW - STRIDE, t)
    heads = np.flatnonzero(asked[:, :cut].any(axis=1))
    rest = n * (t - cut)
    parts = [(slice(None), cut, t, 0, rest), (heads, 0, cut, rest, rest + len(heads) * cut)]
    return [part for part in parts if part[3] < part[4]]


def _rows(z: np.ndarray, parts) -> np.ndarray:
    """The rows of all parts, one after the other."""
    return np.concatenate([z[:0].reshape(-1, *z.shape[2:]), *(z[w, f:t].reshape(-1, *z.shape[2:]) for w, f, t, _, _ in parts)])


def gradients(model, x: np.ndarray, y: np.ndarray, asked: np.ndarray):
    """(mean loss over the asked positions, its gradient); ``y`` are classes."""
    near, far = _ways(model)
    e = _embedded(model, x)
    turned = np.ascontiguousarray(e.transpose(0, 2, 1))
    parts = _asking_parts(asked)
    own = _rows(e, parts)
    q = own @ near
    m, total, shares = np.empty_like(own), np.empty_like(own[:, :1]), []
    for w, f, t, s, s_end in parts:
        a = _shares(q[s:s_end].reshape(-1, t - f, WIDTH), turned[w, :, :t], f)
        np.matmul(a, e[w, :t], out=m[s:s_end].reshape(-1, t - f, WIDTH))
        np.matmul(a.reshape(-1, t), np.ones((t, 1), a.dtype), out=total[s:s_end])
        shares.append(a)
    m /= total
    h = m @ far
    h += own
    r, g = _added(model, h)

    targets = _rows(np.where(asked, y, -1), parts)
    at = np.flatnonzero(targets >= 0)
    targets = targets.take(at)
    order, runs = _by_group(targets)
    at, targets = at.take(order), targets.take(order)
    n = len(at)
    with_one = np.ones((n, WIDTH + 1), g.dtype)  # its last column gives the gradients of the biases
    rows = with_one[:, :WIDTH]
    rows[:] = g.take(at, axis=0)
    z = np.empty((2, n, GROUP), g.dtype)
    np.matmul(rows, model["out"], out=z[0])
    z[0] += model["out_bias"]
    group = targets // GROUP
    _leaf_logits(model, rows, group, runs, z[1])
    chosen, z = _softmax_gradient(z.reshape(-1, GROUP), np.concatenate([group, targets % GROUP]), max(n, 1))
    loss = -2 * float(chosen.mean())
    p, leaf = z[:n], z[n:]
    d, both = {}, with_one.T @ p
    d["out"], d["out_bias"] = both[:WIDTH], both[WIDTH]
    back, below = p @ model["out"].T, np.empty_like(p[:, :WIDTH])
    to_leaf, from_leaf = np.zeros((len(model["leaf"]), WIDTH + 1, GROUP), g.dtype), model["leaf"].transpose(0, 2, 1)
    for c, first, end in runs:
        part = leaf[first:end]
        np.dot(with_one[first:end].T, part, out=to_leaf[c])
        np.dot(part, from_leaf[c], out=below[first:end])
    d["leaf"], d["leaf_bias"] = to_leaf[:, :WIDTH], to_leaf[:, WIDTH]
    back += below
    dg = np.zeros_like(g)
    dg[at] = back
    d["down"] = r.T @ dg
    du = dg @ model["down"].T
    du *= r > 0
    d["up"], d["up_bias"] = h.T @ du, _column_sums(du)
    dh = du @ model["up"].T
    dh += dg
    through = m.T @ dh
    d["value"], d["mixed"] = through @ model["mixed"].T, model["value"].T @ through
    dm = dh @ far.T
    dm /= total  # as the shares are not divided
    # a row's sum of a * da is the product of its dm and m, as m = a @ e
    less = _totals(dm * m)
    dq, de = np.empty_like(q), np.zeros_like(e)
    for (w, f, t, s, s_end), a in zip(parts, shares):
        here = (-1, t - f, WIDTH)
        part = dm[s:s_end].reshape(here)
        ds = part @ turned[w, :, :t]
        ds -= less[s:s_end].reshape(-1, t - f, 1)
        ds *= a
        np.matmul(ds, e[w, :t], out=dq[s:s_end].reshape(here))
        back = a.transpose(0, 2, 1) @ part
        back += ds.transpose(0, 2, 1) @ q[s:s_end].reshape(here)
        de[w, :t] += back
    turn = own.T @ dq
    scale = np.float32(WIDTH**-0.5)
    d["query"], d["key"] = scale * turn @ model["key"], scale * turn.T @ model["query"]
    dh += dq @ near.T
    for w, f, t, s, s_end in parts:
        de[w, f:t] += dh[s:s_end].reshape(-1, t - f, WIDTH)
    d["place"] = np.zeros_like(model["place"])
    d["place"][: x.shape[1]] = de.sum(axis=0)
    d["embed"] = _row_sums(x.ravel(), de.reshape(-1, WIDTH), len(model["embed"]))
    return loss, d


def _row_sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` by their place in 0..n-1, each place in one run."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    order = np.argsort(at.astype(np.uint16) if n <= 1 << 16 else at, kind="stable")
    places = at.take(order)
    if len(places):
        first = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
        out[places.take(first)] = np.add.reduceat(values.take(order, axis=0), first, axis=0)
    return out


class Trainer:
    """Adam steps on a copy of a model; the arrays of the model are parts of one."""

    def __init__(self, model: dict[str, np.ndarray], rate: float = RATE):
        self.flat = packed(model)
        self.model, at = {}, 0
        for k in SHAPES:
            self.model[k] = self.flat[at : at + model[k].size].reshape(model[k].shape)
            at += model[k].size
        # running sums of gradients and of their squares: the means are a tenth and a hundredth of them
        self.first, self.second = np.zeros_like(self.flat), np.zeros_like(self.flat)
        self.rate, self.steps = rate, 0

    def step(self, x: np.ndarray, y: np.ndarray, asked: np.ndarray) -> float:
        loss, grads = gradients(self.model, x, y, asked)
        self.steps += 1
        size = self.rate * min(1.0, self.steps / 10) * np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
        g, first, second = packed(grads), self.first, self.second
        first *= np.float32(0.9)
        first += g
        g *= g
        second *= np.float32(0.99)
        second += g
        np.sqrt(second, out=g)
        g += np.float32(1e-6)
        np.divide(first, g, out=g)
        g *= np.float32(size)
        self.flat -= g
        if self.steps % FLUSH_STEPS == 0:
            first[np.abs(first) < TINY] = 0
            second[second < TINY] = 0
        return loss


def window_starts(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, first position) of every window."""
    count = np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - WINDOW) // STRIDE)), 0)
    doc = np.repeat(np.arange(len(lengths)), count)
    return doc, (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE


def windows(ids: np.ndarray, lengths: np.ndarray, classes: Classes, doc: np.ndarray, start: np.ndarray):
    """(inputs, targets, asked) of windows over documents that lie one after the other in ``ids``."""
    first = (np.cumsum(lengths) - lengths).take(doc) + start
    inside = np.arange(WINDOW) < (lengths.take(doc) - start)[:, None]
    y = ids.take(first[:, None] + np.arange(WINDOW), mode="clip")  # beyond a text nothing is asked
    x = np.empty(y.shape, classes.of.dtype)
    x[:, 0] = np.where(start == 0, classes.size, classes.of.take(ids.take(first - 1, mode="clip")))
    x[:, 1:] = classes.of.take(y[:, :-1])
    short = np.flatnonzero(~inside[:, -1])
    x[short] = np.where(inside[short], x[short], classes.size)
    asked = inside.copy()
    asked[start > 0, : WINDOW - STRIDE] = False
    return x, y, asked


def score(model, classes: Classes, ids: np.ndarray, lengths: np.ndarray, batch: int = 32) -> np.ndarray:
    """Log10 probability of each document."""
    out = np.zeros(len(lengths))
    doc, start = window_starts(lengths)
    # later windows ask for nothing in their overlap, so nothing but keys and values is worked out there
    for some, since in ((start == 0, 0), (start > 0, WINDOW - STRIDE)):
        some = np.flatnonzero(some)
        for k in range(0, len(some), batch):
            own = doc[some[k : k + batch]]
            x, y, asked = windows(ids, lengths, classes, own, start[some[k : k + batch]])
            values = log_probability(model, classes, x, y, asked, since)
            n = asked.sum(axis=1)  # a window asks for something
            np.add.at(out, own, np.add.reduceat(values, np.cumsum(n) - n))
    return out / np.log(10)
