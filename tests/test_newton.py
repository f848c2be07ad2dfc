"""Newton steps of the marginal fits: derivatives by differences, bounds, and fits that end where EM hardly moves."""
import numpy as np
import pytest

from marksheet.functions.grids import hermite_grid
from marksheet.operators import diagnosis, graded, marginal, newton, patterns


def plain_rows(draw, learners, items, codes, most=2):
    item = np.concatenate([np.sort(draw.choice(items, draw.integers(1, items + 1), replace=False)) for _ in range(learners)])
    starts = np.flatnonzero(np.concatenate([[True], item[1:] <= item[:-1]]))
    row = np.searchsorted(starts, np.arange(len(item)), "right") - 1
    return patterns.Rows(row, item, draw.integers(0, codes, len(item)), draw.integers(1, most + 1, len(item)).astype(float), starts,
                         draw.integers(1, 4, len(starts)).astype(float))


def check_derivatives(evaluate, z):
    _, gradient, hessian = evaluate(z)
    for k in range(len(z)):
        step = np.zeros(len(z))
        step[k] = 1e-5
        up, down = evaluate(z + step), evaluate(z - step)
        assert gradient[k] == pytest.approx((up[0] - down[0]) / 2e-5, abs=1e-4)
        assert hessian[k] == pytest.approx((up[1] - down[1]) / 2e-5, abs=1e-3)


def test_graded_and_diagnosis_derivatives(monkeypatch):
    draw = np.random.default_rng(1)
    nodes, mass = (np.array(x) for x in hermite_grid(7))
    rows = plain_rows(draw, 30, 4, 3)
    monkeypatch.setattr(patterns, "CELLS", 8)      # several parts
    for module in (marginal, diagnosis):
        monkeypatch.setattr(module, "sums", lambda table, shapes, work: {k: np.reshape(v, shapes[k]) for k, v in work(table).items()})
    x = np.column_stack([draw.normal(size=4), [1.0, 0.8, 0.5, 1.2], [-0.3, -1.0, -0.2, 0.1]])
    check_derivatives(lambda z: marginal.curvature(rows, *graded.log_slopes(z.reshape(4, 3)[:, 0], z.reshape(4, 3)[:, 1:], nodes), mass), x.ravel())

    rows, eta = plain_rows(draw, 30, 4, 2), diagnosis.ideal(np.array([1, 2, 3, 0]), 2)
    right = lambda z: 1 / (1 + np.exp(-z))
    check_derivatives(lambda z: diagnosis.curvature(rows, eta, right(z[:4]), right(z[4:8]), z[8:], 20.0),
                      np.concatenate([draw.normal(1, 0.3, 4), draw.normal(-1, 0.3, 4), [0.1, 0.2, 0.3, 0.4]]))


def test_bounded_step_is_best_of_the_allowed():
    draw = np.random.default_rng(2)
    for _ in range(20):
        root = draw.normal(size=(5, 5))
        model, gradient = root @ root.T + 0.1 * np.eye(5), draw.normal(size=5) * 3
        A, slack = np.concatenate([np.eye(5), -np.eye(5), [[1, -1, 0, 0, 0]]]), np.abs(draw.normal(size=11)) * (draw.random(11) < 0.7)
        step = newton.bounded_step(gradient, model, (A, slack))
        value = lambda s: s @ gradient - s @ model @ s / 2
        assert (A @ step >= -slack - 1e-9).all()
        others = step + draw.normal(size=(4000, 5)) * draw.choice([1e-3, 0.1, 1.0], (4000, 1))
        allowed = others[((A @ others.T).T >= -slack).all(1)]
        assert all(value(o) <= value(step) + 1e-9 for o in allowed)


def counting(monkeypatch, *modules):
    passes, real = [], patterns.sums
    for module in modules:
        monkeypatch.setattr(module, "sums", lambda *args: passes.append(1) or real(*args))
    return passes


def test_graded_fit_of_noise_takes_few_passes(spark, monkeypatch):
    draw = np.random.default_rng(3)
    rows = [(u, i, int(s)) for u in range(500) for i, s in enumerate(draw.integers(0, 3, 8)) if draw.random() < 0.7]
    passes, history = counting(monkeypatch, marginal), []
    items, _ = graded.fit_grm(spark.createDataFrame(rows, "user_id int, item_id int, score int"), history=history)
    assert all(r.converged for r in items.collect()) and len(passes) <= 35
    assert all(b - a > -1e-8 for a, b in zip(history, history[1:]))


def test_dina_of_noise_ends_and_knows_it(spark, monkeypatch):
    draw = np.random.default_rng(4)
    rows = [(u, i, int(s)) for u in range(400) for i, s in enumerate(draw.integers(0, 2, 9)) if draw.random() < 0.8]
    q = spark.createDataFrame([(i, f"s{k}") for i in range(9) for k in range(3) if (i % 7 + 1) >> k & 1], "item_id int, skill string")
    passes, history = counting(monkeypatch, marginal, diagnosis), []
    items, shares, info = diagnosis.fit_dina(spark.createDataFrame(rows, "user_id int, item_id int, answer int"), q, history=history)
    assert info["converged"] and info["rounds"] == len(passes) <= 85 and all(b - a > -1e-8 for a, b in zip(history, history[1:]))
    assert all(r.guess <= 1 - r.slip + 1e-12 for r in items.collect()) and sum(r.share for r in shares.collect()) == pytest.approx(1)


def test_blocks_hold_the_same_rows(spark):
    draw = np.random.default_rng(5)
    rows = [(u, i, int(draw.integers(0, 3))) for u in range(300) for i in range(6) for _ in range(draw.integers(0, 3))]
    found = patterns.pack(spark.createDataFrame(rows, "user_id int, item_id int, answer int"))
    work = lambda r: {"n": np.bincount(r.item * 3 + r.code, r.n * r.weight[r.row], 18), "w": np.array((r.per_row(r.n) * r.weight).sum())}
    plain, blocks = (patterns.sums(t, {"n": (18,), "w": ()}, work) for t in (found.distinct, found.blocks()))
    assert (plain["n"] == blocks["n"]).all() and plain["w"] == blocks["w"] == len(rows)
