"""A small gated recurrent language model in numpy, with a class-factored softmax."""

from __future__ import annotations

import heapq

import numpy as np

#: Size of the state; classes of frequent words, and words in each; classes of all other words.
STATE, CLASSES, CLASS_WORDS, TAILS = 24, 64, 64, 60
HEAD = CLASSES * CLASS_WORDS
INPUTS = HEAD + TAILS

Weights = dict[str, np.ndarray]


def start_weights(head_mass: np.ndarray, tail_mass: np.ndarray) -> Weights:
    """Weights whose predictions are the relative frequencies, whatever the state."""
    draw = np.random.default_rng(5)
    mass = np.maximum(head_mass.reshape(CLASSES, CLASS_WORDS), 1e-9)
    w = {
        "input": draw.normal(0, 0.3, (INPUTS, 3 * STATE)),
        "state": draw.normal(0, 0.25, (STATE, 3 * STATE)),
        "bias": np.zeros(3 * STATE),
        "class": np.zeros((STATE, CLASSES + TAILS)),
        "class_bias": np.log(np.concatenate((mass.sum(axis=1), np.maximum(tail_mass, 1e-9)))),
        "word": np.zeros((CLASSES, CLASS_WORDS, STATE)),
        "word_bias": np.log(mass),
    }
    return {k: v.astype(np.float32) for k, v in w.items()}


def pack(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def unpack(flat: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at: at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def step(turned: np.ndarray, x: np.ndarray, h: np.ndarray):
    """The next states, and what their gradient needs: gates and the state's share in the candidate.
    States and inputs have a column for each run; ``turned`` are the weights of the state, transposed."""
    u = turned @ h
    gates = np.empty_like(u)
    z, r, n = gates[:STATE], gates[STATE: 2 * STATE], gates[2 * STATE:]
    np.add(x[: 2 * STATE], u[: 2 * STATE], out=gates[: 2 * STATE])
    _sigmoid(gates[: 2 * STATE])
    np.multiply(r, u[2 * STATE:], out=n)
    n += x[2 * STATE:]
    n *= 2  # tanh(n) = 2 / (1 + exp(-2n)) - 1
    _sigmoid(n)
    n *= 2
    n -= 1
    after = h - n
    after *= z
    after += n
    return after, gates, u[2 * STATE:]


def class_of(ids: np.ndarray) -> np.ndarray:
    return np.where(ids < HEAD, ids // CLASS_WORDS, ids - HEAD + CLASSES)


#: Tokens whose logits are worked on at a time, to stay in the processor's cache.
_TOKENS = 1024


def _by_class(classes: np.ndarray):
    """Token numbers in the order of their classes, and for blocks of ``_TOKENS`` of them ``a, b`` and the pieces
    ``k, from, to`` of each class of frequent words."""
    order = np.argsort(classes.astype(np.uint8), kind="stable")
    cuts = np.concatenate(([0], np.cumsum(np.bincount(classes, minlength=CLASSES)[:CLASSES]))).tolist()
    blocks, k = [], 0
    for a in range(0, len(order), _TOKENS):
        b, pieces = min(a + _TOKENS, len(order)), []
        while k < CLASSES and cuts[k] < b:
            if cuts[k + 1] > max(a, cuts[k]):
                pieces.append((k, max(a, cuts[k]), min(b, cuts[k + 1])))
            if cuts[k + 1] > b:
                break
            k += 1
        blocks.append((a, b, pieces))
    return order, blocks


def _with_bias(w: Weights) -> tuple[np.ndarray, np.ndarray]:
    """Weights of classes and words, their bias as a last column (the states have a last row of ones)."""
    return np.concatenate((w["class"].T, w["class_bias"][:, None]), 1), np.concatenate((w["word"], w["word_bias"][:, :, None]), 2)


#: Logits up to this size need no shift before their exponents: 124 of them neither overflow nor vanish.
_SAFE = 80.0


def _within(weights: np.ndarray, hs: np.ndarray) -> bool:
    """Whether no logit of states ``hs`` can exceed ``_SAFE``."""
    high = max(1.0, float(np.abs(hs).max(initial=0)))
    return float(np.abs(weights).sum(axis=-1).max()) * high <= _SAFE


def _exponents(x: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray | float]:
    """exp(x - top) in the place of the logits (a column for each token), and top."""
    if safe:
        return np.exp(x, out=x), 0.0
    top = x.max(axis=0)
    x -= top
    return np.exp(x, out=x), top


def _logits(words: np.ndarray, hs: np.ndarray, a: int, pieces) -> np.ndarray:
    """Logits of the words of each token's class, for a block that begins at token ``a``."""
    x = np.empty((CLASS_WORDS, pieces[-1][2] - a), np.result_type(words, hs))
    for k, i, j in pieces:
        np.matmul(words[k], hs[:, i:j], out=x[:, i - a: j - a])
    return x


def predict(w: Weights, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Log probabilities of ``ids`` after the states ``h`` (a row for each); of a class only for other words."""
    return _predict(_with_bias(w), np.concatenate((h.T, np.ones((1, len(h)), h.dtype))), ids)


def _predict(weights: tuple[np.ndarray, np.ndarray], hs: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """``predict`` with a column for each state, the last row ones."""
    classes = class_of(ids)
    order, blocks = _by_class(classes)
    hs, classes, column = np.take(hs, order, 1, mode="clip"), classes[order], ids[order] % CLASS_WORDS

    safe = all(_within(x, hs) for x in weights)

    def picked(logits: np.ndarray, row: np.ndarray) -> np.ndarray:
        chosen = logits[row, np.arange(len(row))]
        e, top = _exponents(logits, safe)
        return chosen - top - np.log(e.sum(axis=0))

    found = np.empty(len(ids), hs.dtype)
    for a, b, pieces in blocks:
        found[a:b] = picked(weights[0] @ hs[:, a:b], classes[a:b])
        if pieces:
            end = pieces[-1][2]
            found[a:end] += picked(_logits(weights[1], hs, a, pieces), column[a:end])
    out = np.empty_like(found)
    out[order] = found
    return out


def _lanes(sizes: np.ndarray, lanes: int) -> list[list[int]]:
    """Documents shared out over lanes, longest first; the fullest lane first."""
    order = np.argsort(-sizes, kind="stable")
    if len(sizes) <= lanes:
        return [[d] for d in order]
    rows: list[list[int]] = [[] for _ in range(lanes)]
    heap = [(0, i) for i in range(lanes)]
    for d in order:
        filled, i = heapq.heappop(heap)
        rows[i].append(d)
        heapq.heappush(heap, (filled + int(sizes[d]), i))
    return sorted(rows, key=lambda r: -int(sizes[r].sum()))


def score_documents(w: Weights, docs: list[np.ndarray], lanes: int = 256, window: int = 32) -> np.ndarray:
    """Log probability of each whole document.

    Documents share out over lanes, longest first, and follow each other in a lane; the state is
    carried from window to window and is zero where a document begins. A window is laid out when its turn comes, so
    that a text much longer than the others takes the memory of its own tokens only.
    """
    total = np.zeros(len(docs))
    sizes = np.array([len(d) for d in docs])
    rows = _lanes(sizes, lanes)
    order = np.concatenate(rows)
    ids, owner = np.concatenate([docs[d] for d in order]), np.repeat(order.astype(np.int32), sizes[order])
    begins = np.zeros(len(ids) + 1, bool)
    begins[np.cumsum(sizes[order])] = True
    lengths = np.array([sizes[r].sum() for r in rows])
    base = np.cumsum(lengths) - lengths
    table, turn, weights = np.ascontiguousarray((w["input"] + w["bias"]).T), np.ascontiguousarray(w["state"].T), _with_bias(w)
    h = np.zeros((STATE, len(rows)), np.float32)
    begin, longest = 0, int(lengths[0])
    while begin < longest:
        active = int((lengths > begin).sum())
        h, steps = h[:, :active], np.arange(begin, min(begin + window * max(1, lanes // active), longest))
        begin += len(steps)
        real = steps[:, None] < lengths[:active]
        at = np.minimum(base[:active] + steps[:, None], len(ids) - 1)
        inputs = np.take(table, ids[at].ravel(), 1, mode="clip").reshape(3 * STATE, *at.shape)
        states = np.ones((STATE + 1, *at.shape), np.float32)
        fresh = begins[at] & real
        some = fresh.any(axis=1)
        for t in range(len(steps)):
            if some[t]:
                h = np.where(fresh[t], np.float32(0), h)
            states[:STATE, t] = h
            h = step(turn, inputs[:, t], h)[0]
        flat = real.ravel()
        states = states.reshape(STATE + 1, -1)
        picked = _predict(weights, states if flat.all() else states[:, flat], ids[at[real]])
        total += np.bincount(owner[at[real]], picked.astype(float), len(docs))
    return total


def gradients(w: Weights, ids: np.ndarray, real: np.ndarray, h: np.ndarray):
    """Mean loss and its gradients over one window (time by rows), and the state after it."""
    loss, g, rows, values, h = sparse_gradients(w, ids, real, h)
    g["input"] = np.zeros_like(w["input"])
    g["input"][rows] = values
    return loss, g, h


def sparse_gradients(w: Weights, ids: np.ndarray, real: np.ndarray, h: np.ndarray):
    """Mean loss over one window (time by rows), its gradients, those of the inputs as touched rows and their
    values, and the state after the window.

    Back-propagation ends at the window's begin: ``h`` counts as given.
    """
    times, rows = ids.shape
    kind = h.dtype if h.dtype == np.float64 else np.float32
    flat_ids, flat_real = ids.ravel(), real.ravel()
    at = np.flatnonzero(flat_real)
    n, whole = max(1, len(at)), len(at) == ids.size
    by_id = np.argsort(flat_ids.astype(np.int16), kind="stable")
    in_order = flat_ids[by_id]
    starts = np.flatnonzero(np.diff(in_order, prepend=-1))
    touched, place = in_order[starts], np.empty(ids.size, np.intp)
    place[by_id] = np.repeat(np.arange(len(starts)), np.diff(starts, append=ids.size))
    inputs = np.take(np.ascontiguousarray((w["input"][touched] + w["bias"]).T), place, 1, mode="clip").reshape(3 * STATE, times, rows)

    states, gates = np.ones((STATE + 1, times, rows), kind), np.empty((3 * STATE, times, rows), kind)
    carried = np.empty((STATE, times, rows), kind)
    turned, h = np.ascontiguousarray(w["state"].T), np.ascontiguousarray(h.T)
    for t in range(times):
        states[:STATE, t] = h
        after, gates[:, t], carried[:, t] = step(turned, inputs[:, t], h)
        h = after if whole else np.where(real[t], after, h)
    flat_h = states.reshape(STATE + 1, -1)

    classes = class_of(flat_ids[at])
    order, blocks = _by_class(classes)
    tokens = at[order]
    hs, classes, column = np.take(flat_h, tokens, 1, mode="clip"), classes[order], flat_ids[tokens] % CLASS_WORDS
    by_class, by_word = _with_bias(w)
    share, loss, safe = hs.dtype.type(1 / n), 0.0, _within(by_class, hs) and _within(by_word, hs)
    g_class, g_word, d_out = np.zeros_like(by_class), np.zeros_like(by_word), np.zeros((STATE, len(at) + 1), kind)

    def errors(logits: np.ndarray, row: np.ndarray) -> np.ndarray:
        nonlocal loss
        e, _ = _exponents(logits, safe)
        total, line = e.sum(axis=0), np.arange(len(row))
        loss -= float(np.log(e[row, line] / total).sum())
        e *= share / total
        e[row, line] -= share
        return e

    for a, b, pieces in blocks:
        d = errors(by_class @ hs[:, a:b], classes[a:b])
        g_class += d @ hs[:, a:b].T
        np.matmul(w["class"], d, out=d_out[:, a:b])
        if pieces:
            d = errors(_logits(by_word, hs, a, pieces), column[a: pieces[-1][2]])
            for k, i, j in pieces:
                own = d[:, i - a: j - a]
                g_word[k] += own @ hs[:, i:j].T
                d_out[:, i:j] += w["word"][k].T @ own
    g = {"class": g_class[:, :STATE].T, "class_bias": g_class[:, STATE], "word": g_word[:, :, :STATE], "word_bias": g_word[:, :, STATE]}
    g = {k: np.ascontiguousarray(x) for k, x in g.items()}

    back_to = np.full(ids.size, len(at))
    back_to[tokens] = np.arange(len(at))
    every = np.take(d_out, back_to, 1, mode="clip").reshape(STATE, times, rows)
    z, r, c = gates[:STATE], gates[STATE: 2 * STATE], gates[2 * STATE:]
    by_z, by_n, by_r = (states[:STATE] - c) * z * (1 - z), (1 - z) * (1 - c * c), carried * r * (1 - r)
    back = np.zeros((STATE, rows), kind)
    dx, dn = np.empty((3 * STATE, times, rows), kind), np.empty((STATE, times, rows), kind)
    for t in range(times - 1, -1, -1):
        live = back if whole else back * real[t]
        x = dx[:, t]
        np.multiply(live, by_z[:, t], out=x[:STATE])
        np.multiply(live, by_n[:, t], out=x[2 * STATE:])
        np.multiply(x[2 * STATE:], by_r[:, t], out=x[STATE: 2 * STATE])
        np.multiply(x[2 * STATE:], r[:, t], out=dn[:, t])
        before = w["state"][:, : 2 * STATE] @ x[: 2 * STATE] + w["state"][:, 2 * STATE:] @ dn[:, t]
        before += live * z[:, t]
        before += every[:, t]
        back = before if whole else before + back * ~real[t]
    flat, dn, flat_h = dx.reshape(3 * STATE, -1), dn.reshape(STATE, -1), flat_h[:STATE]
    g["state"] = np.concatenate((flat_h @ flat[: 2 * STATE].T, flat_h @ dn.T), 1)
    g["bias"] = flat.sum(axis=1)
    values = np.empty((len(touched), 3 * STATE), kind)
    for j, x in enumerate(flat):
        values[:, j] = np.bincount(place, x, len(touched))
    if not whole:
        own = np.bincount(place[at], minlength=len(touched)) > 0
        touched, values = touched[own], values[own]
    return loss / n, g, touched, values, h.T


class _Adam:
    """Adam steps; rows that a step does not touch keep their moments as they are."""

    def __init__(self, w: Weights, rate: float):
        self.w, self.rate, self.turn = w, rate, 0
        self.first, self.second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))

    def apply(self, name: str, at, x: np.ndarray) -> None:
        first, second = self.first[name], self.second[name]
        m, v = first[at], second[at]
        m *= np.float32(0.9)
        m += np.float32(0.1) * x
        v *= np.float32(0.99)
        v += np.float32(0.01) * x * x
        if not isinstance(at, slice):
            first[at], second[at] = m, v
        scale = v * np.float32(1 / (1 - 0.99**self.turn))
        np.sqrt(scale, out=scale)
        scale += np.float32(1e-6)
        np.divide(m, scale, out=scale)
        scale *= np.float32(self.rate / (1 - 0.9**self.turn))
        self.w[name][at] -= scale


#: Runs that a training step reads side by side, and batches that there should be at least.
LANES, BATCHES = (16, 256), 40


def train(w: Weights, runs: list[np.ndarray], rate: float, size: int = 32) -> tuple[Weights, int]:
    """Truncated back-propagation over runs of ids, sorted by length, ``size`` steps at a time with
    the state carried on, by Adam. Batches hold runs of like length and come in an order drawn with a
    fixed seed. Returns the weights and the number of tokens."""
    w = {k: v.copy() for k, v in w.items()}
    batch = min(max(len(runs) // BATCHES, LANES[0]), LANES[1])
    adam, tokens = _Adam(w, rate), 0
    for i in np.random.default_rng(0).permutation(-(-len(runs) // batch)) * batch:
        own = runs[i: i + batch]
        rows = np.full((max(map(len, own)), len(own)), -1, np.int32)
        for j, r in enumerate(own):
            rows[: len(r), j] = r
        h = np.zeros((rows.shape[1], STATE), np.float32)
        for t in range(0, len(rows), size):
            ids = rows[t: t + size]
            real = ids >= 0
            if not real.any():
                break
            _, g, touched, values, h = sparse_gradients(w, np.maximum(ids, 0), real, h)
            tokens += int(real.sum())
            adam.turn += 1
            norm = np.sqrt(sum(float(np.vdot(x, x)) for x in (values, *g.values())))
            shrink = np.float32(min(1.0, 1.0 / (norm + 1e-6)))
            adam.apply("input", touched, values * shrink)
            for k, x in g.items():
                adam.apply(k, slice(None), x * shrink)
    return w, tokens
