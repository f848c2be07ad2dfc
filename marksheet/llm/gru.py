"""A gated recurrent language model in numpy, with a class-factored output softmax.

The tokens are the ``HEAD`` most frequent words of the corpus, the end of a document, and one token
for all other words.  A word's probability is that of its class times that of the word in its
class; classes are runs of the frequency order.  Biases start at the unigram model.  Training is
truncated backpropagation: the state is carried from window to window, the gradient is not.
"""
from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

HIDDEN = 12
CLASSES, PER_CLASS = 16, 32     # of the head; the other words are one more class
HEAD = CLASSES * PER_CLASS
WINDOW = 16                     # steps of backpropagation
LANES = 512                     # lanes of sequences trained side by side
SEGMENT = 1024                  # longer documents are trained as several sequences (but scored as one)
SCORED, SCORED_LANES = 32, 512  # steps between two softmaxes when scoring; lanes at most
RATE, DECAY = 0.01, (0.9, 0.999)
CLIP = 5.0

#: States and logits are (features x lanes): sums over features then run along contiguous lanes.
SHAPES = {"embed": (HEAD + 1, 3 * HIDDEN), "recur": (3 * HIDDEN, HIDDEN), "class_w": (CLASSES + 1, HIDDEN),
          "class_b": (CLASSES + 1, 1), "word_w": (CLASSES, PER_CLASS, HIDDEN), "word_b": (CLASSES, PER_CLASS, 1)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The parameters as arrays that share ``flat``'s memory."""
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name], at = flat[at:at + n].reshape(shape), at + n
    return out


def start(counts: np.ndarray, seed: int = 0) -> np.ndarray:
    """First parameters: small random weights, biases from the counts of the head's words and of all others."""
    draw = np.random.default_rng(seed)
    flat = np.zeros(SIZE, np.float32)
    p = views(flat)
    p["embed"][:] = draw.normal(0, 0.3, SHAPES["embed"])
    p["recur"][:] = draw.normal(0, 0.5 / np.sqrt(HIDDEN), SHAPES["recur"])
    p["class_w"][:] = draw.normal(0, 0.05, SHAPES["class_w"])
    p["word_w"][:] = draw.normal(0, 0.05, SHAPES["word_w"])
    smooth = counts + 0.5
    words = smooth[:HEAD].reshape(CLASSES, PER_CLASS, 1)
    p["word_b"][:] = np.log(words)
    p["class_b"][:CLASSES] = np.log(words.sum(axis=1))
    p["class_b"][CLASSES] = np.log(smooth[HEAD])
    for name in ("word_b", "class_b"):
        p[name] -= p[name].mean(axis=-2, keepdims=True)
    return flat


def gate_inputs(p: dict, inputs: np.ndarray) -> np.ndarray:
    """What the tokens (steps x lanes) add to the gates: steps x 3 HIDDEN x lanes."""
    return np.ascontiguousarray(p["embed"][inputs].transpose(0, 2, 1))


def step(p: dict, state: np.ndarray, x: np.ndarray):
    """One step of the gates: the new state, and what the backward pass needs."""
    g = p["recur"] @ state
    inner = g[2 * HIDDEN:]
    gates = x[:2 * HIDDEN] + g[:2 * HIDDEN]
    np.negative(gates, out=gates)
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    z, r = gates[:HIDDEN], gates[HIDDEN:]
    new = r * inner
    new += x[2 * HIDDEN:]
    new *= -2               # tanh(a) = 2 / (1 + exp(-2 a)) - 1
    np.minimum(new, 80, out=new)
    np.exp(new, out=new)
    new += 1
    np.divide(2, new, out=new)
    new -= 1
    return new + z * (state - new), (state, z, r, inner, new)


def _softmax(logits: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-probabilities of the targets, the exponentials of the logits, and their sums."""
    logits -= logits.max(axis=0)
    chosen = logits[targets, np.arange(len(targets))]
    np.exp(logits, out=logits)
    sums = logits.sum(axis=0)
    return chosen - np.log(sums), logits, sums


def _error(weights: np.ndarray, sums: np.ndarray, targets: np.ndarray) -> np.ndarray:
    weights /= sums
    weights[targets, np.arange(len(targets))] -= 1
    return weights


def log_probs(p: dict, states: np.ndarray, targets: np.ndarray, grads: dict | None = None):
    """Natural log-probabilities of ``targets``; with ``grads``, adds the gradients and returns that of the states."""
    kind = np.minimum(targets // PER_CLASS, CLASSES).astype(np.int8)
    order = np.argsort(kind, kind="stable")
    kind, sorted_targets = kind[order], targets[order]
    states = states[:, order]               # a class is then a contiguous span
    logs, weights, sums = _softmax(p["class_w"] @ states + p["class_b"], kind)
    below = None
    if grads is not None:
        error = _error(weights, sums, kind)
        grads["class_w"] += error @ states.T
        grads["class_b"] += error.sum(axis=1, keepdims=True)
        below = p["class_w"].T @ error
    ends = np.searchsorted(kind, np.arange(CLASSES + 1))
    for c in range(CLASSES):
        own = slice(ends[c], ends[c + 1])
        if ends[c] < ends[c + 1]:
            inside, word = states[:, own], sorted_targets[own] - c * PER_CLASS
            more, weights, sums = _softmax(p["word_w"][c] @ inside + p["word_b"][c], word)
            logs[own] += more
            if grads is not None:
                error = _error(weights, sums, word)
                grads["word_w"][c] += error @ inside.T
                grads["word_b"][c] += error.sum(axis=1, keepdims=True)
                below[:, own] += p["word_w"][c].T @ error
    out = np.empty_like(logs)
    out[order] = logs
    if grads is None:
        return out, None
    down = np.empty_like(below)
    down[:, order] = below
    return out, down


def backward(p: dict, grads: dict, saved: list, inputs: np.ndarray, first: np.ndarray, down: np.ndarray) -> None:
    """Gradients of one window; ``down`` (steps x hidden x lanes) comes from the softmax.

    No gradient passes the first token of a sequence.
    """
    carried = np.zeros_like(saved[0][0])
    into = np.empty((3 * HIDDEN, len(saved), carried.shape[1]), np.float32)
    for t in range(len(saved) - 1, -1, -1):
        state, z, r, inner, new = saved[t]
        d = down[t] + carried
        carried = d * z
        d -= carried                        # d * (1 - z)
        d_new = d - d * new * new
        d *= state - new
        gates = np.concatenate([d * z, d_new * inner, d_new])
        gates[HIDDEN:2 * HIDDEN] *= r - r * r
        into[:, t] = gates
        gates[2 * HIDDEN:] *= r
        grads["recur"] += gates @ state.T
        carried += p["recur"].T @ gates
        carried[:, first[t]] = 0
    token = inputs.ravel()
    for k, row in enumerate(into.reshape(3 * HIDDEN, -1)):
        grads["embed"][:, k] += np.bincount(token, row, minlength=HEAD + 1)


@dataclass
class Lanes:
    """Token sequences packed behind one another into lanes of nearly equal length (steps x lanes).

    ``targets`` are the tokens and ``inputs`` those before them, ``first`` marks where a sequence
    starts (its state is zero), ``owner`` is the document of a place, and -1 behind the last one.
    """

    inputs: np.ndarray
    targets: np.ndarray
    first: np.ndarray
    owner: np.ndarray

    @classmethod
    def of(cls, documents: list[np.ndarray], end: int, most: int, segment: int | None = None) -> Lanes:
        """At most ``most`` lanes; ``segment`` cuts documents into sequences of so many tokens."""
        parts = []
        for owner, own in enumerate(documents):
            cut = segment or max(len(own), 1)
            parts += [(len(own[at:at + cut]), owner, at) for at in range(0, len(own), cut)]
        parts.sort(key=lambda part: -part[0])
        total, longest = sum(part[0] for part in parts), parts[0][0]
        n = int(min(most, max(1, total // longest)))
        free = [(0, lane) for lane in range(n)]
        placed = []
        for size, owner, at in parts:       # the longest left goes to the shortest lane
            length, lane = free[0]
            placed.append((lane, length, size, owner, at))
            heapq.heapreplace(free, (length + size, lane))
        steps = max(length for length, _ in free)
        targets, inputs = np.zeros((n, steps), np.int32), np.zeros((n, steps), np.int32)
        first, owners = np.zeros((n, steps), bool), np.full((n, steps), -1, np.int32)
        for lane, begin, size, owner, at in placed:
            own = documents[owner]
            targets[lane, begin:begin + size] = own[at:at + size]
            inputs[lane, begin] = own[at - 1] if at else end
            inputs[lane, begin + 1:begin + size] = own[at:at + size - 1]
            first[lane, begin] = True
            owners[lane, begin:begin + size] = owner
        return cls(*(np.ascontiguousarray(a.T) for a in (inputs, targets, first, owners)))


class Trainer:
    """Adam on windows of sequences; goes on from batch to batch."""

    def __init__(self, flat: np.ndarray):
        self.flat, self.grad = flat.copy(), np.zeros(SIZE, np.float32)
        self.first, self.second, self.updates, self.tokens = np.zeros_like(self.grad), np.zeros_like(self.grad), 0, 0
        self.p, self.g = views(self.flat), views(self.grad)

    def learn(self, documents: list[np.ndarray], end: int) -> None:
        """One pass over documents (of one token at least)."""
        if not documents:
            return
        lanes = Lanes.of(documents, end, LANES, SEGMENT)
        state = np.zeros((HIDDEN, lanes.inputs.shape[1]), np.float32)
        for at in range(0, len(lanes.inputs), WINDOW):
            span = slice(at, at + WINDOW)
            state = self._update(state, lanes.inputs[span], lanes.targets[span], lanes.first[span], lanes.owner[span] >= 0)

    def _update(self, state, inputs, targets, first, real):
        saved, states = [], []
        for x, new in zip(gate_inputs(self.p, inputs), first):
            state, kept = step(self.p, state * ~new, x)
            saved.append(kept)
            states.append(state)
        self.grad[:] = 0
        states = np.stack(states, axis=1)       # hidden x steps x lanes
        if real.all():
            _, down = log_probs(self.p, states.reshape(HIDDEN, -1), targets.ravel(), self.g)
            down = down.reshape(states.shape)
        else:
            down = np.zeros_like(states)
            down[:, real] = log_probs(self.p, states[:, real], targets[real], self.g)[1]
        down = down.transpose(1, 0, 2)
        backward(self.p, self.g, saved, inputs, first, down)
        n = int(real.sum())
        self.grad /= n
        self.grad *= min(1.0, CLIP / (float(np.sqrt(self.grad @ self.grad)) + 1e-12))
        self.updates += 1
        self.tokens += n
        self.first += (1 - DECAY[0]) * (self.grad - self.first)
        self.second += (1 - DECAY[1]) * (self.grad * self.grad - self.second)
        rate = RATE * np.sqrt(1 - DECAY[1] ** self.updates) / (1 - DECAY[0] ** self.updates)
        self.flat -= np.float32(rate) * self.first / (np.sqrt(self.second) + 1e-8)
        return state


def score(flat: np.ndarray, documents: list[np.ndarray], end: int) -> np.ndarray:
    """Natural log-likelihood of every document (of one token at least), the state carried through its whole length."""
    total = np.zeros(len(documents))
    if not documents:
        return total
    p = views(flat)
    lanes = Lanes.of(documents, end, SCORED_LANES)
    state = np.zeros((HIDDEN, lanes.inputs.shape[1]), np.float32)
    for at in range(0, len(lanes.inputs), SCORED):
        span, states = slice(at, at + SCORED), []
        for x, new in zip(gate_inputs(p, lanes.inputs[span]), lanes.first[span]):
            state, _ = step(p, state * ~new, x)
            states.append(state)
        real = lanes.owner[span] >= 0
        logs, _ = log_probs(p, np.stack(states, axis=1)[:, real], lanes.targets[span][real])
        total += np.bincount(lanes.owner[span][real], logs, minlength=len(total))
    return total
