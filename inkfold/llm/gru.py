"""A gated recurrent language model in numpy with a class-factored output softmax.

A token is a head word (0 to words - 1) or RARE, the model's last class, which stands for all other
words. P(token) = P(class | state) * P(word | class, state); classes are blocks of `block` head words in
order of frequency. The start of a text is an input of its own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np

Params = dict[str, np.ndarray]
PART = 1024


def initial(counts: np.ndarray, rare: float, hidden: int = 24, block: int = 32, seed: int = 7) -> Params:
    """Small random weights; the output biases give the unigram distribution. len(counts) is a multiple of block."""
    rng = np.random.RandomState(seed)
    words, classes = len(counts), len(counts) // block
    mass = counts.reshape(classes, block) + 1.0
    by_class = np.append(mass.sum(1), rare + 1.0)
    draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    return {
        "input": draw(words + 2, 3 * hidden),
        "state": draw(hidden, 3 * hidden) + np.tile(np.eye(hidden, dtype=np.float32) * 0.3, 3),
        "bias": np.repeat(np.array([0, 1, 0], np.float32), hidden),
        "class_w": draw(hidden, classes + 1),
        "class_b": np.log(by_class / by_class.sum()).astype(np.float32),
        "word_w": draw(classes, hidden, block),
        "word_b": np.log(mass / mass.sum(1, keepdims=True)).astype(np.float32),
    }


def _step(p: Params, gates_in: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step of a batch of states. Fastest where both arrays are transposed views, so that a gate is one stretch of memory."""
    k = h.shape[1]
    both = (p["state"].T @ h.T).T
    both, s = both[:, : 2 * k], both[:, 2 * k :]
    both += gates_in[:, : 2 * k]
    np.negative(both, out=both)
    with np.errstate(over="ignore"):  # a gate whose exp is infinite is shut
        np.exp(both, out=both)
    both += 1
    np.reciprocal(both, out=both)
    r, z = both[:, :k], both[:, k:]
    n = r * s
    n += gates_in[:, 2 * k :]
    np.tanh(n, out=n)
    new = h - n
    new *= z
    new += n
    return new, r, z, n, s


def _with_bias(w: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.concatenate([w, b[..., None, :]], -2)


def _bounded(w: np.ndarray) -> bool:
    """Whether no state (its entries are in [-1, 1]) can give a logit whose exp is too large."""
    return float(np.abs(w).sum(-2).max()) < 60


def _softmax_parts(logits: np.ndarray, places: np.ndarray, bounded: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """exp of the logits (in their place), its row sums, and the log of each row's picked share. places: of the picks in all logits."""
    if not bounded:
        np.minimum(logits, 60, out=logits)
    picked = logits.ravel().take(places)
    np.exp(logits, out=logits)
    sums = logits @ np.ones(logits.shape[1], logits.dtype)
    return logits, sums, picked - np.log(sums)


def _by_class(classes: np.ndarray, most: int) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """The rows in order of class, those of class `most` and beyond left out, and the stretches of at most PART rows of each class below."""
    # numbers of 16 bits are sorted by radix
    order = np.argsort(classes.astype(np.uint16 if most < 1 << 16 else np.int64), kind="stable")
    bounds = np.searchsorted(classes[order], np.arange(most + 1)).tolist()
    return order[: bounds[-1]], [(c, slice(k, min(k + PART, b))) for c, (a, b) in enumerate(zip(bounds, bounds[1:])) for k in range(a, b, PART)]


def log_probs(p: Params, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log of P(target) for each state; the probability of RARE is that of its class."""
    classes, k, block = p["word_w"].shape
    if states.shape[1] == k:
        states = np.concatenate([states, np.ones((len(states), 1), states.dtype)], 1)
    by_class, by_word = _with_bias(p["class_w"], p["class_b"]), _with_bias(p["word_w"], p["word_b"])
    safe = _bounded(by_class), _bounded(by_word)
    cls = np.minimum(targets // block, classes)
    rows, out = np.arange(PART), np.empty(len(cls), states.dtype)
    for c in range(0, len(cls), PART):
        own = cls[c : c + PART]
        out[c : c + PART] = _softmax_parts(states[c : c + PART] @ by_class, rows[: len(own)] * (classes + 1) + own, safe[0])[2]
    order, stretches = _by_class(cls, classes)
    inner, own = states.take(order, 0), targets[order] - cls[order] * block
    more = np.empty(len(order), states.dtype)
    for c, at in stretches:
        more[at] = _softmax_parts(inner[at] @ by_word[c], rows[: at.stop - at.start] * block + own[at], safe[1])[2]
    out[order] += more
    return out


def _output(w: np.ndarray, x: np.ndarray, places: np.ndarray, weight: np.ndarray, bounded: bool) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradients of one softmax by its weights (the last row is the bias) and its inputs, and the summed loss."""
    d, sums, logp = _softmax_parts(x @ w, places, bounded)
    d *= (weight / sums)[:, None]
    d.ravel()[places] -= weight
    return x.T @ d, d @ w[:-1].T, -float(logp @ weight)


def gradients(p: Params, inputs: np.ndarray, targets: np.ndarray, mask: np.ndarray, h: np.ndarray) -> tuple[Params, float, np.ndarray]:
    """Backpropagation through one window: gradients, summed loss and the state after it.

    inputs, targets, mask: steps x batch. The state that comes in counts as a constant (truncation).
    """
    steps, batch = inputs.shape
    classes, k, block = p["word_w"].shape
    kind = p["state"].dtype
    # steps x gates x batch
    table, gates = p["input"] + p["bias"], np.empty((steps, 3 * k, batch), kind)
    kept, states = [], np.ones((steps, batch, k + 1), kind)
    for t in range(steps):
        gates[t] = table.take(inputs[t], 0).T
        new, *parts = _step(p, gates[t].T, h)
        kept.append([x.T for x in (h, *parts)])
        states[t, :, :k] = h = new
    goal, weight = targets.ravel(), mask.ravel().astype(kind)
    by_class, by_word = _with_bias(p["class_w"], p["class_b"]), _with_bias(p["word_w"], p["word_b"])
    safe = _bounded(by_class), _bounded(by_word)
    # what counts, in order of class: the rows of one class, and all with a head word, are stretches; the rest has a class of its own
    cls = np.where(weight > 0, np.minimum(goal // block, classes), classes + 1)
    order, stretches = _by_class(cls, classes + 1)
    flat, cls, goal, weight, rows = states.reshape(-1, k + 1).take(order, 0), cls[order], goal[order], weight[order], np.arange(PART)
    g_class, g_word, loss, d_sorted = np.zeros_like(by_class), np.zeros_like(by_word), 0.0, np.zeros((len(order) + 1, k), kind)
    for c in range(0, len(order), PART):
        part = slice(c, min(c + PART, len(order)))
        g_part, d_sorted[part], lost = _output(by_class, flat[part], rows[: part.stop - c] * (classes + 1) + cls[part], weight[part], safe[0])
        g_class += g_part
        loss += lost
    own = goal - cls * block
    for c, at in stretches:
        if c < classes:
            g_part, d_part, lost = _output(by_word[c], flat[at], rows[: at.stop - at.start] * block + own[at], weight[at], safe[1])
            g_word[c] += g_part
            d_sorted[at] += d_part
            loss += lost
    # rows without weight have the zeros at the end
    place = np.full(steps * batch, len(order))
    place[order] = np.arange(len(order))
    d_states = d_sorted.take(place, 0).reshape(steps, batch, k)
    g = {"class_w": g_class[:-1], "class_b": g_class[-1], "word_w": g_word[:, :-1], "word_b": g_word[:, -1], "state": np.zeros_like(p["state"])}
    dh, into_state = np.zeros((k, batch), kind), np.empty((3 * k, batch), kind)
    after = h.T
    for t in reversed(range(steps)):
        before, r, z, n, s = kept[t]
        dh += d_states[t].T
        out = gates[t]
        dr, dz, dn = out[:k], out[k : 2 * k], out[2 * k :]
        keep = 1 - z
        keep *= dh
        np.subtract(after, n, out=dz)  # z times what the state was away from n
        dz *= keep
        np.multiply(n, n, out=dn)
        np.subtract(1, dn, out=dn)
        dn *= keep
        np.multiply(dn, s, out=dr)
        np.multiply(dn, r, out=into_state[2 * k :])
        dr *= r
        dr *= 1 - r
        into_state[: 2 * k] = out[: 2 * k]
        g["state"] += before @ into_state.T
        dh *= z
        dh += p["state"] @ into_state
        after = before
    # the commonest input, RARE, is summed apart
    rare, g["input"] = len(p["input"]) - 2, np.empty_like(p["input"])
    is_rare = inputs == rare
    step, column = np.nonzero(~is_rare)
    tokens, at = inputs[step, column], step * (3 * k * batch) + column
    flat = gates.ravel()
    for j in range(3 * k):
        g["input"][:, j] = np.bincount(tokens, flat.take(at), len(p["input"]))
        at += batch
    g["input"][rare] = (gates @ is_rare[..., None].astype(kind)).sum((0, 2))
    g["bias"] = g["input"].sum(0)
    return g, loss, h


class Adam:
    def __init__(self, p: Params, rate: float = 0.01):
        self.p, self.rate, self.t = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, g: Params, n: int) -> None:
        """One step along the mean of gradients summed over n tokens, its norm clipped at 5. g is used up."""
        self.t += 1
        norm = np.sqrt(sum(float(np.vdot(x, x)) for x in g.values())) / n
        scale = np.float32(min(1.0, 5.0 / (norm + 1e-9)) / n)
        rate = np.float32(self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t))
        for k, x in g.items():
            m, v = self.m[k], self.v[k]
            x *= scale
            m *= np.float32(0.9)
            m += np.float32(0.1) * x
            np.multiply(x, x, out=x)
            x *= np.float32(0.001)
            v *= np.float32(0.999)
            v += x
            np.sqrt(v, out=x)
            x += np.float32(1e-8)
            np.divide(m, x, out=x)
            x *= rate
            self.p[k] -= x


def portions(segments: Iterable[np.ndarray], least: int, most: int) -> Iterator[list[np.ndarray]]:
    """Batches that grow by an eighth from `least` to `most` segments: small steps first, then cheap ones."""
    segments, size = iter(segments), float(least)
    while part := list(islice(segments, int(size))):
        yield part
        size = min(size * 1.125, most)


def train(p: Params, segments: Iterable[np.ndarray], window: int = 32, batch: tuple[int, int] = (48, 384), rate: float = 0.02) -> tuple[Params, int]:
    """One pass over segments: arrays of an input token followed by targets. Returns new parameters and tokens seen.

    The segments of a batch go window by window; each window's last state starts the next.
    """
    p = {k: v.copy() for k, v in p.items()}
    adam, seen = Adam(p, rate), 0
    for part in portions(segments, *batch):
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        longest = int(sizes.max()) - 1
        there = np.arange(longest + 1) < sizes[:, None]
        grid = np.zeros(there.shape, np.int64)
        grid[there] = np.concatenate(part)
        mask = there[:, 1:]
        h = np.zeros((p["state"].shape[0], len(part)), np.float32).T
        for t in range(0, longest, window):
            inputs, targets, m = (np.ascontiguousarray(x.T) for x in (grid[:, t : min(t + window, longest)], grid[:, t + 1 : min(t + window, longest) + 1], mask[:, t : t + window]))
            g, _, h = gradients(p, inputs, targets, m, h)
            n = int(m.sum())
            adam.step(g, max(n, 1))
            seen += n
    return p, seen


def score(p: Params, tokens: np.ndarray, offsets: np.ndarray, slots: int = 512, window: int = 64) -> np.ndarray:
    """Natural log-likelihood of each text; text i is tokens[offsets[i]:offsets[i + 1]].

    Texts are packed into slots that run side by side; a slot's state is carried from window to window
    and cleared where its next text starts.
    """
    lengths, n = np.diff(offsets), len(offsets) - 1
    if not len(tokens):
        return np.zeros(n)
    slots = int(min(slots, (lengths > 0).sum()))
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    heap = [(0, s) for s in range(slots)]
    slot_of, first = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    for i, size in enumerate(lengths[order].tolist()):
        at, s = heapq.heappop(heap)
        slot_of[i], first[i] = s, at
        heapq.heappush(heap, (at + size, s))
    # longest slots first, so that those at work are always the leading ones
    ends = np.array(sorted(heap, key=lambda x: -x[0]))
    slot_of = np.argsort(ends[:, 1])[slot_of]
    ends = ends[:, 0]
    size, total = lengths[order], int(ends[0])
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    place = (np.repeat(first, size) + within) * slots + np.repeat(slot_of, size)
    source = np.repeat(offsets[:-1][order], size) + within
    grid, owner = np.zeros(total * slots, np.int32), np.full(total * slots, n, np.int32)
    grid[place] = tokens[source]
    owner[place] = np.repeat(order, size)
    grid, owner = grid.reshape(total, slots), owner.reshape(total, slots)
    start = len(p["input"]) - 1
    out, h = np.zeros(n + 1), np.zeros((p["state"].shape[0], slots), np.float32).T
    table = p["input"] + p["bias"]
    for t in range(0, total, window):
        steps, busy = min(window, total - t), int((ends > t).sum())
        h, states = h[:busy], np.ones((steps, busy, h.shape[1] + 1), np.float32)
        before = np.full((steps, busy), start)
        before[1 if t == 0 else 0 :] = grid[max(t - 1, 0) : t + steps - 1, :busy]
        opens = np.ones((steps, busy), bool)
        opens[1 if t == 0 else 0 :] = owner[max(t, 1) : t + steps, :busy] != owner[max(t, 1) - 1 : t + steps - 1, :busy]
        before[opens] = start
        any_opens = opens.any(1)
        for s in range(steps):
            if any_opens[s]:
                h = h * ~opens[s][:, None]
            h = _step(p, np.ascontiguousarray(table.take(before[s], 0).T).T, h)[0]
            states[s, :, :-1] = h
        mine = owner[t : t + steps, :busy].ravel()
        real = np.flatnonzero(mine < n)
        lp = log_probs(p, states.reshape(-1, h.shape[1] + 1)[real], grid[t : t + steps, :busy].ravel()[real])
        out += np.bincount(mine[real], lp, n + 1)
    return out[:n]


def flatten(p: Params) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def unflatten(flat: np.ndarray, like: Params) -> Params:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out
