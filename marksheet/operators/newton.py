"""Damped Newton steps on a sum over rows, for fits whose EM steps hardly move in the end.

A pass gives value, gradient and Hessian.  A step goes by the Hessian's absolute curvatures, more damped
after a pass that shows a lower value, which is not taken: the value never falls.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np

UNKNOWNS = 512          # parameters that the driver's Hessian may have
PASSES = 60             # after so many the caller goes on by EM
LONGEST = 1.0           # of a step in one parameter
FLAT = 1e-9             # of the largest curvature: less counts as this


def curved(hessian: np.ndarray, damping: float) -> np.ndarray:
    """The negative Hessian with its curvatures made positive and raised by ``damping``."""
    size, axes = np.linalg.eigh(-hessian)
    size = np.abs(size)
    return (axes * (np.maximum(size, FLAT * size.max(initial=0) + 1e-300) + damping)) @ axes.T


def free_step(gradient: np.ndarray, model: np.ndarray, _) -> np.ndarray:
    return np.linalg.solve(model, gradient)


def bounded_step(gradient: np.ndarray, model: np.ndarray, room: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The best step of the quadratic model with ``A @ step >= -slack`` for (A, slack) = ``room``: bounds enter and leave one at a time."""
    A, slack = room
    step, inverse = np.zeros(len(gradient)), np.linalg.inv(model)
    across = A @ inverse
    between = across @ A.T
    held = [k for k in np.flatnonzero(slack <= 0) if A[k] @ gradient < 0]
    for _ in range(20 * len(gradient)):
        left = gradient - model @ step
        try:
            pull = np.linalg.solve(between[np.ix_(held, held)], -across[held] @ left)
        except np.linalg.LinAlgError:   # bounds that say the same
            pull = np.linalg.lstsq(between[np.ix_(held, held)], -across[held] @ left, rcond=None)[0]
        move = inverse @ (left + pull @ A[held])
        if np.abs(move).max() <= 1e-12 * max(1.0, np.abs(step).max()):
            if not held or pull.min() >= -1e-12 * np.abs(gradient).max():
                break
            held.pop(int(pull.argmin()))
            continue
        by = A @ move
        by[held] = 0
        reach = np.where(by < -1e-15, np.maximum(slack + A @ step, 0) / np.maximum(-by, 1e-300), np.inf)
        first = int(reach.argmin())
        step = step + min(1.0, reach[first]) * move
        if reach[first] < 1:
            held.append(first)
    return step


def ascend(z: np.ndarray, evaluate: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], settled: Callable[[np.ndarray, float], bool],
           solve: Callable = free_step, room: Callable = lambda z: None, project: Callable = lambda z: z, passes: int = PASSES):
    """Parameters, value, passes used, whether ``settled`` (step that is left, its gain), and the values on the way."""
    value, gradient, hessian = evaluate(z)
    damping, used, history = 1.0, 1, [value]
    while used < passes and np.isfinite(hessian).all():
        step = solve(gradient, curved(hessian, damping), room(z))
        if settled(step, float(step @ gradient) / 2):       # else the undamped step, which gains more, is not settled either
            model = curved(hessian, 0.0)
            last = solve(gradient, model, room(z))
            if settled(last, float(last @ gradient - last @ model @ last / 2)):
                return z, value, used, True, history
        new = project(z + step * min(1.0, LONGEST / max(np.abs(step).max(), 1e-300)))
        found = evaluate(new)
        used += 1
        if found[0] >= value and np.isfinite(found[2]).all():
            z, (value, gradient, hessian) = new, found
            damping = max(damping / 5, 1e-9)
            history.append(value)
        elif damping > 1e12:
            break
        else:
            damping *= 10
    return z, value, used, False, history
