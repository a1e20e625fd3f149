"""A small gated recurrent language model in numpy with a class-factored softmax.

Words are numbers below ``words``; the number ``words`` itself stands for every other word. Words are
numbered by falling frequency and cut into classes of equal size; the other-word mark is a class of
its own. The probability of a word is that of its class times that of the word within the class.

Texts are laid end to end in parallel lanes. A window of some steps is processed for all lanes at once
and the state is carried from window to window, so a text is read as a whole however long it is;
it is set to zero where a new text begins. Training carries the state in the same way and truncates only the
gradient, at the window's start. Texts beyond ``STRETCH`` words are trained as stretches side by side; a later
stretch first reads the ``WARM_UP`` words before it, without learning from them, to get its state.
"""

from __future__ import annotations

import heapq

import numpy as np

HIDDEN = 24
CLASS_WORDS = 40
WINDOW = 24
STRETCH = 100 * WINDOW
WARM_UP = 4 * WINDOW
#: Lanes of one training step: wide enough for few steps on much text, narrow enough for many on little.
NARROW, WIDE, STEPS = 32, 512, 200
#: Steps are adaptive only for gradients above this size; rare words' biases would drift otherwise.
FLOOR = 1e-5

Parameters = dict[str, np.ndarray]


def initial(counts: np.ndarray, other: float, seed: int = 1, hidden: int = HIDDEN) -> Parameters:
    """Small random weights; output biases give the word frequencies ``counts`` and ``other``."""
    draw = np.random.default_rng(seed)
    words = len(counts)
    classes = -(-words // CLASS_WORDS)
    padded = np.zeros(classes * CLASS_WORDS)
    padded[:words] = counts
    grid = padded.reshape(classes, CLASS_WORDS)
    totals = np.append(grid.sum(axis=1), other)
    small = lambda *shape: draw.normal(0.0, 0.08, shape).astype(np.float32)
    bias = np.where(grid > 0, np.log(np.maximum(grid, 1e-9)), -30.0) - np.log(np.maximum(grid.sum(axis=1, keepdims=True), 1e-9))
    return {
        "embed": small(words + 1, hidden),
        "input": draw.normal(0.0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32),
        "recur": draw.normal(0.0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32),
        "gate_bias": np.zeros(3 * hidden, dtype=np.float32),
        "class_out": small(hidden, classes + 1) * 0.1,
        "class_bias": np.log(np.maximum(totals, 1e-3) / max(totals.sum(), 1e-3)).astype(np.float32),
        "word_out": small(classes, hidden, CLASS_WORDS) * 0.1,
        "word_bias": bias.astype(np.float32),
    }


class Lanes:
    """Texts (arrays of word numbers) laid end to end in at most ``width`` lanes.

    ``before`` is the word that is given before the first word of every text, or of each.
    """

    def __init__(self, texts: list[np.ndarray], before: int | list[int], width: int):
        sizes = [len(t) for t in texts]
        order = sorted(range(len(texts)), key=lambda i: -sizes[i])
        lanes: list[list[int]] = [[] for _ in range(min(width, len(texts)))]
        load = [(0, k) for k in range(len(lanes))]
        for i in order:
            total, k = heapq.heappop(load)
            lanes[k].append(i)
            heapq.heappush(load, (total + sizes[i], k))
        lanes.sort(key=lambda members: -sum(sizes[i] for i in members))
        self.order = [i for members in lanes for i in members]
        self.lengths = np.array([sum(sizes[i] for i in members) for members in lanes], dtype=np.int64)
        self.base = np.cumsum(self.lengths) - self.lengths
        self.target = np.concatenate([texts[i] for i in self.order]) if texts else np.zeros(0, dtype=np.int32)
        ends = np.cumsum([sizes[i] for i in self.order])
        self.first = (ends - [sizes[i] for i in self.order]).astype(np.int64)
        self.fresh = np.zeros(len(self.target), dtype=bool)
        self.fresh[self.first[self.first < len(self.target)]] = True
        self.given = np.empty_like(self.target)
        self.given[1:] = self.target[:-1]
        starts = self.first < len(self.target)
        befores = np.full(len(texts), before) if isinstance(before, int) else np.array(before)
        self.given[self.first[starts]] = befores[self.order][starts]

    def windows(self, steps: int):
        """Per window: the places of every step's words; lanes that ended are left out."""
        longest = int(self.lengths[0]) if len(self.lengths) else 0
        for at in range(0, longest, steps):
            rows = []
            for t in range(at, min(at + steps, longest)):
                live = int(np.searchsorted(-self.lengths, -t, side="left"))
                rows.append(self.base[:live] + t)
            yield rows


def _sigmoid(x: np.ndarray) -> np.ndarray:
    out = np.negative(x)
    np.exp(out, out=out)
    out += 1.0
    return np.reciprocal(out, out=out)


def _moderate(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Whether the exponentials of ``states @ weights + bias`` can be summed as they are, per class.

    States lie between -1 and 1, so the parameters bound them: none overflows and the largest does not vanish. A single
    output is certain, which only a shift by the largest gives exactly.
    """
    reach = np.abs(weights).sum(axis=-2)
    return ((bias + reach).max(axis=-1) < 70) & ((bias - reach).max(axis=-1) > -60) & (bias.shape[-1] > 1)


def _outputs(p: Parameters, states: np.ndarray, target: np.ndarray, learn: int = 0):
    """Log probabilities of the targets; with ``learn`` also gradients of their negative sum divided by it."""
    classes = p["word_out"].shape[0]
    kind = np.minimum(target // CLASS_WORDS, classes)
    kind = np.where(target >= p["embed"].shape[0] - 1, classes, kind)
    logits = states @ p["class_out"]
    logits += p["class_bias"]
    if not _moderate(p["class_out"], p["class_bias"]):
        logits -= logits.max(axis=1, keepdims=True)
    rows = np.arange(len(target))
    logp = logits[rows, kind]
    share = np.exp(logits, out=logits)
    total = share @ np.ones(classes + 1, dtype=share.dtype)
    logp -= np.log(total)
    grads, back = {}, None
    if learn:
        total *= learn
        share *= np.reciprocal(total)[:, None]
        share[rows, kind] -= 1.0 / learn
        grads = {"class_out": states.T @ share, "class_bias": share.sum(axis=0), "word_out": np.zeros_like(p["word_out"]), "word_bias": np.zeros_like(p["word_bias"])}
        back = share @ p["class_out"].T
    # Rows of one class lie together: every class works on slices.
    order = np.argsort(kind.astype(np.int16), kind="stable")
    edges = np.searchsorted(kind[order], np.arange(classes + 1))
    ordered, words = states[order], target[order]
    gained, pulled = np.zeros_like(logp), np.zeros_like(ordered) if learn else None
    moderate, ones = _moderate(p["word_out"], p["word_bias"]), np.ones(CLASS_WORDS, dtype=share.dtype)
    for c in np.flatnonzero(np.diff(edges)):
        mine = slice(edges[c], edges[c + 1])
        own = ordered[mine]
        inner = own @ p["word_out"][c]
        inner += p["word_bias"][c]
        if not moderate[c]:
            inner -= inner.max(axis=1, keepdims=True)
        word = words[mine] - c * CLASS_WORDS
        at = rows[: len(own)]
        gained[mine] = inner[at, word]
        share = np.exp(inner, out=inner)
        total = share @ ones
        gained[mine] -= np.log(total)
        if learn:
            total *= learn
            share *= np.reciprocal(total)[:, None]
            share[at, word] -= 1.0 / learn
            grads["word_out"][c] = own.T @ share
            grads["word_bias"][c] = share.sum(axis=0)
            pulled[mine] = share @ p["word_out"][c].T
    logp[order] += gained
    if learn:
        back[order] += pulled
    return logp, grads, back


def log_probabilities(p: Parameters, texts: list[np.ndarray], start_word: int, width: int = WIDE) -> np.ndarray:
    """Natural log probability of every text. Texts must not be empty."""
    if not texts:
        return np.zeros(0)
    lanes = Lanes(texts, start_word, width)
    hidden = p["recur"].shape[0]
    given = p["embed"] @ p["input"] + p["gate_bias"]
    state = np.zeros((len(lanes.lengths), hidden), dtype=np.float32)
    logp = np.empty(len(lanes.target))
    for rows in lanes.windows(WINDOW):
        states = []
        for at in rows:
            h = state[: len(at)]
            h[lanes.fresh[at]] = 0.0
            x, u = given[lanes.given[at]], h @ p["recur"]
            gates = _sigmoid(x[:, : 2 * hidden] + u[:, : 2 * hidden])
            n = np.tanh(x[:, 2 * hidden :] + gates[:, hidden:] * u[:, 2 * hidden :])
            h = n + gates[:, :hidden] * (h - n)
            state[: len(at)] = h
            states.append(h)
        places = np.concatenate(rows)
        logp[places], _, _ = _outputs(p, np.concatenate(states), lanes.target[places])
    sums = np.add.reduceat(logp, lanes.first)
    out = np.empty(len(texts))
    out[lanes.order] = sums
    return out


def _stretches(texts: list[np.ndarray], start_word: int) -> tuple[list[np.ndarray], list[int], list[int]]:
    """Texts cut for training: the words, the word before them, and how many of them are only read."""
    words, before, quiet = [], [], []
    for text in texts:
        for at in range(0, len(text), STRETCH):
            read = min(at, WARM_UP)
            words.append(text[at - read : at + STRETCH])
            before.append(int(text[at - read - 1]) if at > read else start_word)
            quiet.append(read)
    return words, before, quiet


def gradients(p: Parameters, lanes: Lanes, quiet: np.ndarray, rows: list[np.ndarray], state: np.ndarray, learn: int):
    """Gradients of the negative log probability of a window's words, divided by ``learn``; ``state`` moves on.

    ``quiet`` marks places that are read but not learned from.
    """
    hidden = p["recur"].shape[0]
    places = np.concatenate(rows)
    edges = np.cumsum([0, *(len(at) for at in rows)])
    kinds, which = np.unique(lanes.given[places], return_inverse=True)
    embedded = p["embed"][kinds]
    table = embedded @ p["input"] + p["gate_bias"]
    held = np.empty((len(places), hidden), dtype=state.dtype)
    states, gates, news, pulls = (np.empty((len(places), k * hidden), dtype=state.dtype) for k in (1, 2, 1, 1))
    for i, at in enumerate(rows):
        mine = slice(edges[i], edges[i + 1])
        h = state[: len(at)]
        h[lanes.fresh[at]] = 0.0
        held[mine] = h
        x, u = table[which[mine]], h @ p["recur"]
        both = _sigmoid(x[:, : 2 * hidden] + u[:, : 2 * hidden])
        n = np.tanh(x[:, 2 * hidden :] + both[:, hidden:] * u[:, 2 * hidden :])
        h = n + both[:, :hidden] * (h - n)
        state[: len(at)] = h
        states[mine], gates[mine], news[mine], pulls[mine] = h, both, n, u[:, 2 * hidden :]
    hushed = quiet[places]
    if hushed.any():
        loud = ~hushed
        back = np.zeros_like(states)
        _, grads, back[loud] = _outputs(p, states[loud], lanes.target[places[loud]], learn)
    else:
        _, grads, back = _outputs(p, states, lanes.target[places], learn)
    z, r = gates[:, :hidden], gates[:, hidden:]
    # What a state's gradient is multiplied by on its way to each gate; only the state's own part runs back in steps.
    to_new, to_z = (1.0 - z) * (1.0 - news * news), (held - news) * z * (1.0 - z)
    to_r = pulls * r * (1.0 - r)
    dx, du = (np.empty((len(places), 3 * hidden), dtype=state.dtype) for _ in range(2))
    later = np.zeros((0, hidden), dtype=state.dtype)
    for i in range(len(rows) - 1, -1, -1):
        mine = slice(edges[i], edges[i + 1])
        d = back[mine]
        d[: len(later)] += later
        dn = d * to_new[mine]
        dx[mine, :hidden] = d * to_z[mine]
        dx[mine, hidden : 2 * hidden] = dn * to_r[mine]
        dx[mine, 2 * hidden :] = dn
        du[mine, : 2 * hidden] = dx[mine, : 2 * hidden]
        du[mine, 2 * hidden :] = dn * r[mine]
        later = d * z[mine] + du[mine] @ p["recur"].T
        later[lanes.fresh[rows[i]]] = 0.0
    order = np.argsort(which, kind="stable")
    sums = np.add.reduceat(dx[order], np.searchsorted(which[order], np.arange(len(kinds))))
    grads["input"], grads["recur"], grads["gate_bias"] = embedded.T @ sums, held.T @ du, sums.sum(axis=0)
    grads["embed"] = np.zeros_like(p["embed"])
    grads["embed"][kinds] = sums @ p["input"].T
    return grads


def train(p: Parameters, texts: list[np.ndarray], start_word: int, width: int | None = None, rate: float = 0.01) -> Parameters:
    """One pass of truncated backpropagation with adaptive steps (Adam) over the texts."""
    p = {k: v.copy() for k, v in p.items()}
    words, before, read = _stretches(texts, start_word)
    if not words:
        return p
    if width is None:
        width = int(np.clip(sum(map(len, words)) // (WINDOW * STEPS), NARROW, WIDE))
    mix = np.random.default_rng(len(words)).permutation(len(words))
    lanes = Lanes([words[i] for i in mix], [before[i] for i in mix], width)
    quiet = np.zeros(len(lanes.target), dtype=bool)
    for first, i in zip(lanes.first, lanes.order, strict=True):
        quiet[first : first + read[mix[i]]] = True
    state = np.zeros((len(lanes.lengths), p["recur"].shape[0]), dtype=p["recur"].dtype)
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for rows in lanes.windows(WINDOW):
        # Windows in which few lanes are left weigh less.
        grads = gradients(p, lanes, quiet, rows, state, WINDOW * len(state))
        step += 1
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
        scale = min(1.0, 1.0 / (norm + 1e-9))
        for name, g in grads.items():
            g = g * scale
            first[name] += 0.1 * (g - first[name])
            second[name] += 0.01 * (g * g - second[name])
            p[name] -= (rate / (1.0 - 0.9**step)) * first[name] / (np.sqrt(second[name] / (1.0 - 0.99**step)) + FLOOR)
    return p


def flat(p: Parameters) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)]).astype(np.float64)


def shaped(values: np.ndarray, like: Parameters) -> Parameters:
    out, at = {}, 0
    for k in sorted(like):
        n = like[k].size
        out[k] = values[at : at + n].reshape(like[k].shape).astype(np.float32)
        at += n
    return out
