"""Marginal-likelihood EM over answer patterns, and stochastic EM with all draws of a round in one pass.

The expectation step is one pass over the distinct patterns: posterior weights on the ability grid, and
from them the expected answers of every item at every node.  Item parameters live on the driver (their
number is bounded by ``patterns.MOST_ITEMS``).  ``accelerated`` extrapolates pairs of EM steps and takes the
result only where the marginal likelihood is no lower, so the likelihood never falls.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from marksheet.functions import logistic as lg
from marksheet.operators.patterns import Rows, sums

MAX_STEP = 1.0
CHAIN_START_SPREAD = 1.0


def curve(a, b, c, nodes) -> np.ndarray:
    """P(right), (items, nodes), in intercept form."""
    return c[:, None] + (1 - c[:, None]) / (1 + np.exp(-np.clip(a[:, None] * nodes + b[:, None], -30, 30)))


def posterior(rows: Rows, logs: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of every row over the nodes, and its log marginal likelihood; ``logs`` is (item, code, node)."""
    return _normalised(rows.per_row(rows.n[:, None] * logs[rows.item, rows.code]) + np.log(mass))


def _normalised(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    most = raw.max(1, keepdims=True)
    weight = np.exp(raw - most)
    total = weight.sum(1, keepdims=True)
    return weight / total, (most + np.log(total))[:, 0]


def expectation(table: DataFrame, logs: np.ndarray, mass: np.ndarray) -> tuple[float, np.ndarray]:
    """Marginal log-likelihood of all rows, and the expected answers (item, code, node)."""
    found = expectations(table, logs, mass)
    return float(found["loglik"]), found["counts"]


def expectations(table: DataFrame, logs: np.ndarray, mass: np.ndarray) -> dict[str, np.ndarray]:
    """loglik, counts (item, code, node) and mass (expected learners per node) of all rows."""
    items, codes, nodes = logs.shape

    def work(rows: Rows):
        cells = rows.matrix(items, codes)
        if cells is not None:       # the same sums as two products of matrices
            share, loglik = _normalised(cells @ logs.reshape(items * codes, nodes) + np.log(mass))
            counts = cells.T @ (rows.weight[:, None] * share)
            return {"loglik": np.array((rows.weight * loglik).sum()), "counts": counts, "mass": rows.weight @ share}
        share, loglik = posterior(rows, logs, mass)
        expected = (rows.weight[rows.row] * rows.n)[:, None] * share[rows.row]
        counts = np.stack([rows.per_item(np.where((rows.code == k)[:, None], expected, 0.0), items) for k in range(codes)], 1)
        return {"loglik": np.array((rows.weight * loglik).sum()), "counts": counts, "mass": rows.weight @ share}

    return sums(table, {"loglik": (), "counts": logs.shape, "mass": (nodes,)}, work)


def curvature(table: DataFrame, logs: np.ndarray, first: np.ndarray, second: np.ndarray, mass: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Marginal log-likelihood, its gradient and its Hessian by all parameters of all items.

    ``logs`` is (item, code, node), ``first`` (item, code, parameter, node) and ``second`` (item, code, parameter, parameter, node)
    its derivatives by the item's own parameters.
    """
    items, codes, nodes = logs.shape
    size = first.shape[2]
    N = items * size
    by_node = np.ascontiguousarray(first.transpose(3, 0, 2, 1))     # node, item, parameter, code

    def work(rows: Rows):
        value, counts, hessian = 0.0, np.zeros((items * codes, nodes)), np.zeros((N, N))
        for part in rows.parts(max(items * codes, N)):
            cells = part.matrix(items, codes, sparse=True)
            share, loglik = _normalised(cells @ logs.reshape(items * codes, nodes) + np.log(mass))
            value += (part.weight * loglik).sum()
            weighted = part.weight[:, None] * share
            counts += cells.T @ weighted
            turned = np.ascontiguousarray(cells.T).reshape(items, codes, -1)
            mean = np.zeros((N, len(cells)))
            for k in range(nodes):
                slope = (by_node[k] @ turned).reshape(N, -1)
                hessian += (slope * weighted[:, k]) @ slope.T
                mean += slope * share[:, k]
            hessian -= (mean * part.weight) @ mean.T
        return {"loglik": np.array(value), "counts": counts, "hessian": hessian}

    found = sums(table, {"loglik": (), "counts": logs.shape, "hessian": (N, N)}, work)
    hessian = found["hessian"].reshape(items, size, items, size)
    hessian[np.arange(items), :, np.arange(items)] += np.einsum("nck,ncpqk->npq", found["counts"], second)
    return float(found["loglik"]), np.einsum("nck,ncpk->np", found["counts"], first).ravel(), hessian.reshape(N, N)


def item_logs(a, b, c, nodes) -> np.ndarray:
    p = curve(a, b, c, nodes)
    return np.log(np.stack([np.maximum(1 - p, 1e-300), np.maximum(p, 1e-300)], 1))


def item_step(a, b, c, counts, nodes, free: tuple[str, ...], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """a and b that raise the expected log-likelihood of ``counts``: Fisher steps, halved until they do."""
    wrong, right = counts[:, 0], counts[:, 1]

    def value(a, b):
        logs = item_logs(a, b, c, nodes)
        return (wrong * logs[:, 0] + right * logs[:, 1]).sum(1)

    best = value(a, b)
    for _ in range(rounds):
        s = 1 / (1 + np.exp(-np.clip(a[:, None] * nodes + b[:, None], -30, 30)))
        p = c[:, None] + (1 - c[:, None]) * s
        rise = (1 - c[:, None]) * s * (1 - s)
        slopes = np.stack([rise * nodes, rise], 1)
        gradient = (((right - (right + wrong) * p) / (p * (1 - p)))[:, None] * slopes).sum(2)
        information = np.einsum("nk,nik,njk->nij", (right + wrong) / (p * (1 - p)), slopes, slopes)
        if "a" not in free:
            gradient[:, 0], information[:, 0], information[:, :, 0] = 0, 0, 0
            information[:, 0, 0] = 1
        step = solved(gradient, np.stack([information[:, 0, 0], information[:, 0, 1], information[:, 1, 1]], 1), a)
        for _ in range(20):
            new_a, new_b = np.clip(a + step[:, 0], *lg.A_BOUNDS), np.clip(b + step[:, 1], *lg.B_BOUNDS)
            now = value(new_a, new_b)
            worse = now < best
            if not worse.any():
                break
            step[worse] /= 2
        moved = np.abs(np.where(worse[:, None], 0, step)).max(initial=0)
        a, b, best = np.where(worse, a, new_a), np.where(worse, b, new_b), np.where(worse, best, now)
        if moved < 1e-10:
            break
    return a, b


def accelerated(start: np.ndarray, em: Callable[[np.ndarray], tuple[float, np.ndarray]], inside: Callable[[np.ndarray], np.ndarray | None],
                max_rounds: int, settled: Callable[[float, float, np.ndarray, np.ndarray], bool]):
    """Squared extrapolation of EM steps: parameters, log-likelihood there, EM steps used, whether they settled, history.

    ``em`` gives the marginal log-likelihood of its argument and the next parameters; ``inside`` moves
    extrapolated parameters into their bounds, or gives None.
    """
    x0 = start
    f0, x1 = em(x0)
    rounds, history = 1, [f0]
    while rounds < max_rounds:
        f1, x2 = em(x1)
        rounds += 1
        if settled(f0, f1, x0, x1):
            return x1, f1, rounds, True, [*history, f1]
        r, v = x1 - x0, x2 - 2 * x1 + x0
        length = -max(1.0, np.sqrt((r * r).sum() / max((v * v).sum(), 1e-300)))
        x3 = inside(x0 - 2 * length * r + length ** 2 * v) if length < -1 else None
        if x3 is not None:
            f3, x4 = em(x3)
            rounds += 1
            if f3 >= f1:
                x0, f0, x1 = x3, f3, x4
                history.append(f0)
                continue
        x0, f0, x1 = x1, f1, x2
        history.append(f0)
    return x0, f0, rounds, False, history


# ---- stochastic EM ----------------------------------------------------------------------------

def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: counters to independent-looking bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _counted(key: np.ndarray, *counters: int) -> np.ndarray:
    """The bits of a key after these counters; more counters go on from there."""
    bits = key.astype(np.uint64)
    for counter in counters:
        bits = _mixed(bits + np.uint64((counter * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64))
    return bits


def uniforms(key: np.ndarray, *counters: int) -> np.ndarray:
    """A number in (0, 1) for every 64-bit key and this counter; the same on every machine."""
    return ((_counted(key, *counters) >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def gaussians(key: np.ndarray, *counters: int) -> np.ndarray:
    return np.sqrt(-2 * np.log(uniforms(key, *counters, 1))) * np.cos(2 * np.pi * uniforms(key, *counters, 2))


def _flat_value(rows: Rows, a, b, c) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    own_a, own_b, own_c = a[rows.item], b[rows.item], c[rows.item]

    def value(theta):
        z = np.clip(own_a * theta[rows.row] + own_b, -30, 30)
        p = own_c + (1 - own_c) / (1 + np.exp(-z))
        return rows.per_row(rows.n * np.log(np.where(rows.code == 1, p, 1 - p))) - theta ** 2 / 2, p

    return value


REACH = 8.0         # abilities up to here go by tables, those beyond by all items
TABLE = 1 << 22     # numbers of a table


class Curves:
    """Log density of every row's ability as a function of that alone, without guessing, from (item, row) counts.

    What depends on the items is tabled for every row as a polynomial of degree five for each of many even steps: a draw
    costs the same whatever the number of items.  Steps are so small that the error stays below 1e-10 times the number of items.
    """

    def __init__(self, right: np.ndarray, both: np.ndarray, a: np.ndarray, b: np.ndarray):
        self.right, self.both, self.a, self.b = right, both, a, b
        self.h = 2.0 ** -np.ceil(np.log2(16 * max(1.0, np.abs(a).max(initial=0) / 1.5)))
        self.nodes = np.arange(-REACH, REACH + self.h / 2, self.h)
        self.size, self.count = len(self.nodes) - 1, both.shape[1]
        self.up, self.base = a @ right, b @ right
        self.first = np.arange(self.count) * self.size
        z, s, bent = self._at_nodes()
        self.table = self._sums(self._polynomials(np.logaddexp(0, z), a[:, None] * s, a[:, None] ** 2 * bent))

    def _at_nodes(self):
        z = np.multiply.outer(self.a, self.nodes) + self.b[:, None]
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return z, s, s * (1 - s)

    def _polynomials(self, f, f1, f2) -> np.ndarray:
        """Coefficients, (item, step, 6), that meet values, slopes and curvatures at both ends of a step."""
        f0, g0, f1, g1, f2, g2 = f[:, :-1], f[:, 1:], self.h * f1[:, :-1], self.h * f1[:, 1:], self.h ** 2 * f2[:, :-1], self.h ** 2 * f2[:, 1:]
        rise = g0 - f0
        return np.stack([f0, f1, f2 / 2, 10 * rise - 6 * f1 - 4 * g1 - 1.5 * f2 + g2 / 2, -15 * rise + 8 * f1 + 7 * g1 + 1.5 * f2 - g2,
                         6 * rise - 3 * (f1 + g1) - (f2 - g2) / 2], 2)

    def _sums(self, by_item: np.ndarray) -> np.ndarray:
        return (self.both.T @ by_item.reshape(len(self.a), -1)).reshape(self.count * self.size, 6)

    def _place(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the table, and how far on to the next."""
        x = (np.clip(theta, -REACH, REACH) + REACH) * (1 / self.h)
        j = np.minimum(x.astype(np.int64), self.size - 1)
        return self.first + j, x - j

    def value(self, theta: np.ndarray) -> tuple[np.ndarray, None]:
        at, t = self._place(theta)
        found = self.table.take(at, 0)
        lost = found[:, 5]
        for k in range(4, -1, -1):
            lost = lost * t + found[:, k]
        if max(theta.max(), -theta.min()) > REACH:
            far = np.flatnonzero(np.abs(theta) > REACH)
            lost[far] = (self.both[:, far] * np.logaddexp(0, np.multiply.outer(self.a, theta[far]) + self.b[:, None])).sum(0)
        return theta * (self.up - theta / 2) + self.base - lost, None

    def collector(self, weight: np.ndarray):
        """``add`` for draws, and ``sums``: gradient and information by slope and intercept of every item over them."""
        held, total, beyond = np.zeros((self.count * self.size, 6)), np.zeros(self.count), []
        draws, weights = [0], np.ones((self.count, 6))

        def add(theta, _):
            total[:] += theta
            draws[0] += 1
            at, t = self._place(theta)
            weights[:, 0] = 1
            for k in range(1, 6):
                np.multiply(weights[:, k - 1], t, out=weights[:, k])
            if max(theta.max(), -theta.min()) > REACH:
                far = np.flatnonzero(np.abs(theta) > REACH)
                weights[far] = 0
                beyond.append((far, theta[far]))
            held[at] = held.take(at, 0) + weights

        def powers(f, theta):       # (p theta, p, v theta^2, v theta, v)
            p, v = f
            return p * theta, p, v * theta * theta, v * theta, v

        def sums():
            spread = (self.both * weight) @ held.reshape(self.count, self.size * 6)     # item, (step, power)
            spread = spread.reshape(len(self.a), self.size, 6)
            _, p, v = self._at_nodes()
            a, x = self.a[:, None], self.nodes
            p1, p2, v1, v2 = a * v, a * a * v * (1 - 2 * p), a * v * (1 - 2 * p), a * a * v * (1 - 6 * v)
            parts = ((x * p, p + x * p1, 2 * p1 + x * p2), (p, p1, p2), (x * x * v, 2 * x * v + x * x * v1, 2 * v + 4 * x * v1 + x * x * v2),
                     (x * v, v + x * v1, 2 * v1 + x * v2), (v, v1, v2))
            found = np.stack([(spread * self._polynomials(*part)).sum((1, 2)) for part in parts], 1)
            for rows, theta in beyond:
                s = 1 / (1 + np.exp(-np.clip(np.multiply.outer(self.a, theta) + self.b[:, None], -30, 30)))
                found += np.stack([((self.both[:, rows] * weight[rows]) * f).sum(1) for f in powers((s, s * (1 - s)), theta)], 1)
            gradient = self.right @ (np.stack([total, np.full(self.count, float(draws[0]))], 1) * weight[:, None]) - found[:, :2]
            return gradient, found[:, 2:]

        return add, sums


def chain(rows: Rows, key: np.ndarray, value: Callable, draws: int, burn_in: int, salt: tuple[int, ...], keep: Callable, merge: Callable | None = None) -> None:
    """Metropolis-Hastings on every row's ability, prior N(0, 1); ``keep`` sees each draw after ``burn_in``.

    ``value`` gives the log density and what else it found; with ``merge`` (old, new, taken) ``keep`` gets that
    for the draw too.  A chain starts at the row's state.  Numbers depend on (key, salt, draw) alone.
    """
    theta = rows.state[:, 0].copy()
    now, found = value(theta)
    key = _counted(key, *salt)
    for draw in range(burn_in + draws):
        bits = _counted(key, draw)
        new = theta + gaussians(bits)
        after, other = value(new)
        taken = np.log(uniforms(bits, 3)) < after - now
        theta, now = np.where(taken, new, theta), np.where(taken, after, now)
        if merge:
            found = merge(found, other, taken)
        if draw >= burn_in:
            keep(theta, found)


def _counts(rows: Rows, c) -> tuple[np.ndarray, np.ndarray] | None:
    """Right and all answers, (item, row), where ``Curves`` serve."""
    cells = None if np.any(c) or len(rows.start) * 12 * 16 * REACH > TABLE else rows.matrix(len(c), 2)
    return None if cells is None else (np.ascontiguousarray(cells[:, 1::2].T), np.ascontiguousarray((cells[:, ::2] + cells[:, 1::2]).T))


def sampled_sums(table: DataFrame, a, b, c, draws: int, burn_in: int, salt: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and information by slope and intercept of every item, averaged over all draws of a round: one pass."""
    items = len(a)

    def work(rows: Rows):
        gradient, information = np.zeros((items, 2)), np.zeros((items, 3))
        key, counts = rows.state[:, 1].astype(np.uint64), _counts(rows, c)
        if counts is not None:
            curves = Curves(*counts, a, b)
            add, found = curves.collector(rows.weight)
            chain(rows, key, curves.value, draws, burn_in, salt, add)
            gradient, information = found()
            return {"gradient": gradient / draws, "information": information / draws}

        own_c, weight = c[rows.item], rows.weight[rows.row] * rows.n

        def keep(theta, p):
            t = theta[rows.row]
            s = (p - own_c) / (1 - own_c)
            rise = (1 - own_c) * s * (1 - s)
            g = weight * (rows.code - p) / (p * (1 - p)) * rise
            h = weight * rise * rise / (p * (1 - p))
            for sink, parts in ((gradient, (g * t, g)), (information, (h * t * t, h * t, h))):
                for k, part in enumerate(parts):
                    sink[:, k] += np.bincount(rows.item, part, items)

        chain(rows, key, _flat_value(rows, a, b, c), draws, burn_in, salt, keep, lambda old, new, taken: np.where(taken[rows.row], new, old))
        return {"gradient": gradient / draws, "information": information / draws}

    found = sums(table, {"gradient": (items, 2), "information": (items, 3)}, work)
    return found["gradient"], found["information"]


def mean_draws(rows: Rows, a, b, c, draws: int, burn_in: int, salt: tuple[int, ...]) -> np.ndarray:
    """Mean of every row's draws."""
    total, counts = np.zeros(len(rows.start)), _counts(rows, c)
    value = _flat_value(rows, a, b, c) if counts is None else Curves(*counts, a, b).value

    def keep(theta, _):
        total[:] += theta

    chain(rows, rows.state[:, 1].astype(np.uint64), value, draws, burn_in, salt, keep)
    return total / draws


def mean_sums(table: DataFrame, a, b, c, draws: int, burn_in: int, salt: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and information of every item at the mean of every row's draws: one pass."""
    items = len(a)

    def work(rows: Rows):
        t = mean_draws(rows, a, b, c, draws, burn_in, salt)[rows.row]
        own_a, own_b, own_c, weight = a[rows.item], b[rows.item], c[rows.item], rows.weight[rows.row] * rows.n
        s = 1 / (1 + np.exp(-np.clip(own_a * t + own_b, -30, 30)))
        p = own_c + (1 - own_c) * s
        rise = (1 - own_c) * s * (1 - s)
        g, h = weight * (rows.code - p) / (p * (1 - p)) * rise, weight * rise * rise / (p * (1 - p))
        add = lambda *parts: np.stack([np.bincount(rows.item, x, items) for x in parts], 1)
        return {"gradient": add(g * t, g), "information": add(h * t * t, h * t, h)}

    found = sums(table, {"gradient": (items, 2), "information": (items, 3)}, work)
    return found["gradient"], found["information"]


def solved(gradient: np.ndarray, information: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Steps of 2 x 2 systems given as (aa, ab, bb), cut to MAX_STEP.

    A slope that rests on a bound and pushes against it stays, and the intercept is solved alone.
    """
    aa, ab, bb = information.T
    bottom = aa * bb - ab * ab
    safe = np.where(bottom > 1e-12, bottom, np.inf)
    step = np.stack([(bb * gradient[:, 0] - ab * gradient[:, 1]) / safe, (aa * gradient[:, 1] - ab * gradient[:, 0]) / safe], 1)
    low, high = lg.A_BOUNDS
    resting = (a <= low) & (step[:, 0] <= 0) | (a >= high) & (step[:, 0] >= 0)
    alone = np.stack([np.zeros(len(a)), gradient[:, 1] / np.where(bb > 1e-12, bb, np.inf)], 1)
    return np.clip(np.where(resting[:, None], alone, step), -MAX_STEP, MAX_STEP)
