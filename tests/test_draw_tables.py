"""Tabled log densities of the draws, and steps of the modal fits that are not tried twice."""
import numpy as np
import pytest

from marksheet.operators import marginal, modal


def test_tables_give_log_densities_and_sums_of_all_items():
    draw = np.random.default_rng(1)
    a, b, weight = draw.uniform(0.25, 5, 30), draw.normal(size=30), draw.integers(1, 4, 50).astype(float)
    both = draw.integers(0, 3, (30, 50)).astype(float)
    right = np.minimum(both, draw.integers(0, 3, (30, 50)))
    curves = marginal.Curves(right, both, a, b)
    add, sums = curves.collector(weight)
    gradient, information = np.zeros((30, 2)), np.zeros((30, 3))
    for spread in (0.5, 1.0, 3.0, 4.0):
        theta = np.append(draw.normal(size=49) * spread, 2.2 * spread)      # the last one lies beyond the table
        z = a[:, None] * theta + b[:, None]
        plain = (right * z - both * np.logaddexp(0, z)).sum(0) - theta ** 2 / 2
        assert curves.value(theta)[0] == pytest.approx(plain, abs=1e-7)
        add(theta, None)
        p = 1 / (1 + np.exp(-z))
        rest, v = weight * (right - both * p), weight * both * p * (1 - p)
        gradient += np.stack([(rest * theta).sum(1), rest.sum(1)], 1)
        information += np.stack([(v * theta ** 2).sum(1), (v * theta).sum(1), v.sum(1)], 1)
    found = sums()
    assert found[0] == pytest.approx(gradient, abs=1e-5) and found[1] == pytest.approx(information, abs=1e-5)


def test_a_step_that_fell_is_not_tried_again():
    slope, curvature = np.array([3.0, -1.0]), np.array([50.0, 2.0])
    damping = modal._more(1e-9, slope, curvature)
    assert np.linalg.norm(slope / (curvature + damping) - slope / curvature) > 0.1 * np.linalg.norm(slope / curvature)
    assert modal._more(8.0, slope, curvature) == 32.0
