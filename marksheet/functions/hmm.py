"""Batch arithmetic for hidden Markov models on ragged answer sequences, used inside Arrow tasks.

Arrays are indexed (sequence, step, state).  Steps past the end of a sequence are masked by
``lengths``.  ``prior`` is the state distribution before the first answer of the row, ``after`` the
likelihood of the answers that follow the row (all ones when nothing follows).
"""
from __future__ import annotations

import numpy as np

TINY = 1e-300
ROW_SUM_TOLERANCE = 1e-12


def blocks(lengths: np.ndarray, cells: int = 1 << 18):
    """Row index groups of similar length whose padded size stays bounded."""
    order = np.argsort(lengths, kind="stable")
    start = 0
    while start < len(order):
        stop = start + 1
        shortest = max(int(lengths[order[start]]), 1)
        while stop < len(order):
            width = int(lengths[order[stop]])
            if width > 2 * shortest + 8 or width * (stop + 1 - start) > cells:
                break
            stop += 1
        yield order[start:stop]
        start = stop


def pad(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ragged values as a rectangle; cells past the end repeat an arbitrary valid value."""
    steps = np.arange(max(int(lengths.max()), 1))
    index = np.minimum(starts[:, None] + steps, max(len(flat) - 1, 0))
    return flat[index] if len(flat) else np.zeros(index.shape, flat.dtype)


def emission_from_table(B: np.ndarray, obs: np.ndarray) -> np.ndarray:
    """P(answer | state) from per-row tables B (row, state, code)."""
    return np.where(obs[:, :, None] == 1, B[:, None, :, 1], B[:, None, :, 0])


def emission_from_levels(obs: np.ndarray, difficulty: np.ndarray, offset: float, states: int) -> np.ndarray:
    """P(answer | level) when the chance of a right answer grows with level minus difficulty."""
    right = 1 / (1 + np.exp(difficulty[:, :, None] - np.arange(states) - offset))
    return np.where(obs[:, :, None] == 1, right, 1 - right)


def forward(prior, A, emission, lengths):
    """Filtered state per step and the log-likelihood of each row."""
    n, steps, states = emission.shape
    filtered = np.empty_like(emission)
    predicted, loglik = prior, np.zeros(n)
    for t in range(steps):
        weight = predicted * emission[:, t]
        scale = np.maximum(weight.sum(1), TINY)
        live = t < lengths
        current = weight / scale[:, None]
        if t:
            current = np.where(live[:, None], current, filtered[:, t - 1])
        filtered[:, t] = current
        loglik += np.where(live, np.log(scale), 0.0)
        predicted = np.einsum("ni,nij->nj", current, A)
    return filtered, loglik


def backward(A, emission, lengths, after):
    """Likelihood of the later answers given the state at each step, up to a factor."""
    n, steps, states = emission.shape
    beta = np.empty_like(emission)
    beta[:, steps - 1] = after
    for t in range(steps - 2, -1, -1):
        value = np.einsum("nij,nj->ni", A, emission[:, t + 1] * beta[:, t + 1])
        value /= np.maximum(value.sum(1, keepdims=True), TINY)
        beta[:, t] = np.where((t + 1 < lengths)[:, None], value, after)
    return beta


def smooth(filtered, beta):
    gamma = filtered * beta
    return gamma / np.maximum(gamma.sum(2, keepdims=True), TINY)


def statistics(prior, A, emission, obs, lengths, later, continued):
    """Sufficient statistics of each row.

    Returns the smoothed first state, expected transitions, answer-weighted state mass and
    log-likelihood.  Where ``continued``, ``later`` is the likelihood of the pieces after this row
    given their first state, and the transition into them is counted here.
    """
    n, steps, states = emission.shape
    filtered, loglik = forward(prior, A, emission, lengths)
    beta = backward(A, emission, lengths, after_row(A, later, continued))
    gamma = smooth(filtered, beta)

    def expected(state, weight, counted):
        xi = state[:, :, None] * A * weight[:, None, :]
        xi /= np.maximum(xi.sum((1, 2), keepdims=True), TINY)
        return np.where(counted[:, None, None], xi, 0.0)

    moves = expected(filtered[:, -1], later, continued)
    for t in range(steps - 1):
        moves += expected(filtered[:, t], emission[:, t + 1] * beta[:, t + 1], t + 1 < lengths)
    live = (np.arange(steps) < lengths[:, None])[:, :, None]
    mass = np.where(live, gamma, 0.0)
    right = (obs == 1)[:, :, None]
    by_answer = np.stack([np.where(right, 0.0, mass).sum(1), np.where(right, mass, 0.0).sum(1)], axis=2)
    return gamma[:, 0], moves, by_answer, loglik


def after_row(A, later, continued):
    """Likelihood of everything after the row given its last state."""
    return np.where(continued[:, None], np.einsum("nij,nj->ni", A, later), 1.0)


def best_scores(log_prior, log_A, log_emission, lengths):
    """Best log score of each last state and the back pointers that lead to it."""
    n, steps, states = log_emission.shape
    score = log_prior + log_emission[:, 0]
    back = np.zeros((n, steps, states), dtype=np.int64)
    for t in range(1, steps):
        through = score[:, :, None] + log_A
        origin = through.argmax(1)
        moved = np.take_along_axis(through, origin[:, None, :], 1)[:, 0] + log_emission[:, t]
        live = (t < lengths)[:, None]
        back[:, t] = np.where(live, origin, np.arange(states))
        score = np.where(live, moved, score)
    return score, back


def trace_back(back, final):
    """States of every step, given the state at the last one (any leading shape of ``final``)."""
    n, steps, _ = back.shape
    path = np.empty((steps, *final.shape), dtype=np.int64)
    path[steps - 1] = final
    rows = np.arange(n).reshape(n, *[1] * (final.ndim - 1))
    for t in range(steps - 1, 0, -1):
        path[t - 1] = back[rows, t, path[t]]
    return np.moveaxis(path, 0, -1)


def transfer(A, emission, lengths):
    """Product of the (emission, transition) matrices of a row, with its log factor."""
    n, steps, states = emission.shape
    product = np.broadcast_to(np.eye(states), (n, states, states)).copy()
    logs = np.zeros(n)
    for t in range(steps):
        nxt = (product * emission[:, t][:, None, :]) @ A
        scale = np.maximum(nxt.max((1, 2)), TINY)
        live = t < lengths
        product = np.where(live[:, None, None], nxt / scale[:, None, None], product)
        logs += np.where(live, np.log(scale), 0.0)
    return product, logs


def log_transfer(log_A, log_emission, lengths):
    """The same product in (max, +) arithmetic, for the most likely path."""
    n, steps, states = log_emission.shape
    product = np.full((n, states, states), -np.inf)
    product[:, np.arange(states), np.arange(states)] = 0.0
    for t in range(steps):
        carried = product + log_emission[:, t][:, None, :]
        nxt = (carried[:, :, :, None] + log_A[:, None, :, :]).max(2)
        product = np.where((t < lengths)[:, None, None], nxt, product)
    return product


def into_bounds(rows, low, high):
    """Move probability rows (last axis) into [low, high] with sum 1; also tells which rows succeeded.

    Clip, then spread what the sum is off by over the entries not at the blocking bound; repeat.
    """
    values = np.clip(rows, low, high)
    for _ in range(100):
        off = values.sum(-1, keepdims=True) - 1
        if np.all(np.abs(off) < ROW_SUM_TOLERANCE):
            break
        free = np.where(off > 0, values > low, values < high)
        share = off / np.maximum(free.sum(-1, keepdims=True), 1)
        moved = np.where(free, values - share, values)
        values = np.where(np.abs(off) < ROW_SUM_TOLERANCE, values, np.clip(moved, low, high))
    return values, np.abs(values.sum(-1) - 1) < 1e-9


def new_parameters(first, n_valid, moves, by_answer, bounds, fit_emission):
    """Bounded PI, A and B from summed statistics; a state without mass counts as all ones."""
    def shares(counts):
        mass = counts.sum(-1, keepdims=True)
        return np.where(mass > 0, counts / np.where(mass > 0, mass, 1.0), 1.0)

    pi, ok = into_bounds(first / np.maximum(n_valid, 1)[:, None], bounds["pi_low"], bounds["pi_high"])
    A, ok_a = into_bounds(shares(moves), bounds["A_low"], bounds["A_high"])
    ok = ok & ok_a.all(1)
    B = None
    if fit_emission:
        B, ok_b = into_bounds(shares(by_answer), bounds["B_low"], bounds["B_high"])
        ok = ok & ok_b.all(1)
    return pi, A, B, ok
