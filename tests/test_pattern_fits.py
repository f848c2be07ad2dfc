"""Fits over answer patterns: plain versions, numeric derivatives, rising likelihoods, recovery."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from marksheet.functions.grids import hermite_grid, normal_grid
from marksheet.operators import calibration, graded, joint, marginal, modal, patterns
from marksheet.sources import views

MODELS = {"3PL": (1, False, True, False, 1.702, (5.0, 17.0)), "1PL": (1, False, False, True, 1.702, (5.0, 17.0)),
          "M3PL": (2, True, True, False, 1.0, (2.0, 5.0)), "M3PLN": (2, False, True, False, 1.0, (2.0, 5.0))}


def plain_rows(draw, learners=7, items=4, dims=1):
    item = np.concatenate([np.sort(draw.choice(items, draw.integers(1, items + 1), replace=False)) for _ in range(learners)])
    starts = np.flatnonzero(np.concatenate([[True], item[1:] <= item[:-1]]))
    row = np.searchsorted(starts, np.arange(len(item)), "right") - 1
    n = len(starts)
    return patterns.Rows(row, item, draw.integers(0, 2, len(item)), draw.integers(1, 3, len(item)).astype(float), starts,
                         draw.integers(1, 4, n).astype(float), np.zeros((n, dims)))


@pytest.mark.parametrize("name", MODELS)
def test_modal_derivatives_by_differences(name):
    model, draw = joint.ModalModel(*MODELS[name]), np.random.default_rng(3)
    curve = modal.Curve(model)
    rows = plain_rows(draw, dims=model.dims)
    z = draw.normal(size=(4, model.item_size)) * 0.4
    theta, _, moved = modal.learner_modes(curve, z, rows)
    assert moved.max() < 1e-9
    rows = rows._replace(state=theta)

    def value(flat):
        x = flat.reshape(z.shape)
        return float((rows.weight * modal.learner_modes(curve, x, rows)[1]).sum()) + modal._prior(curve, x)[0]

    def slope(flat):
        x = flat.reshape(z.shape)
        return (modal._posterior(curve, x, rows)["gradient"] + modal._prior(curve, x)[1]).ravel()

    found = modal._posterior(curve, z, rows)
    hessian = found["hessian"] + np.diag(modal._prior(curve, z)[2].ravel())
    for k in range(z.size):
        step = np.zeros(z.size)
        step[k] = 1e-5
        assert slope(z.ravel())[k] == pytest.approx((value(z.ravel() + step) - value(z.ravel() - step)) / 2e-5, abs=2e-4)
        assert hessian[k] == pytest.approx((slope(z.ravel() + step) - slope(z.ravel() - step)) / 2e-5, abs=2e-4)


@pytest.mark.parametrize("name", ["3PL", "M3PLN"])
def test_modal_fits_converge_and_never_fall(spark, sf_dir, name):
    history = []
    items, users, _ = joint.fit_modal(views.answers(spark, sf_dir), joint.ModalModel(*MODELS[name]), history=history)
    assert all(a <= b for a, b in zip(history, history[1:])) and len(history) > 3
    assert items.filter("not converged").isEmpty() and users.filter("not converged").isEmpty()


def made(draw, learners=400, items=8):
    theta, a, b = draw.normal(size=learners), draw.uniform(0.7, 1.8, items), np.linspace(-1.5, 1.5, items)
    right = draw.random((learners, items)) < 1 / (1 + np.exp(-(a * theta[:, None] + b)))
    return theta, a, b, right.astype(int)


def long_table(spark, right, weight=None):
    rows = [(u, i, int(right[u, i]), *([float(weight[u])] if weight is not None else [])) for u in range(len(right)) for i in range(right.shape[1])]
    return spark.createDataFrame(rows, "user_id int, item_id int, answer int" + (", weight double" if weight is not None else ""))


def test_marginal_fit_by_plain_em(spark, monkeypatch):
    _, _, _, right = made(np.random.default_rng(8))
    answers = long_table(spark, right)
    items, users, info = calibration.fit_mml(answers)
    assert info["converged"] and all(b - a > -1e-8 for a, b in zip(info["history"], info["history"][1:]))
    nodes, mass = (np.array(x) for x in normal_grid(40, -6.0, 6.0, "normal"))
    a, b, c, last = np.ones(8), np.zeros(8), np.zeros(8), -np.inf
    for _ in range(2000):
        logs = marginal.item_logs(a, b, c, nodes)
        raw = np.take_along_axis(logs[None], right[:, :, None, None], 2)[:, :, 0].sum(1) + np.log(mass)
        loglik = np.log(np.exp(raw).sum(1))
        post = np.exp(raw - loglik[:, None])
        counts = np.stack([(1 - right).T @ post, right.T @ post], 1)
        if loglik.sum() - last < 1e-9:
            break
        last = loglik.sum()
        a, b = marginal.item_step(a, b, c, counts, nodes, ("a", "b"), 20)
    assert info["loglik"] == pytest.approx(last, abs=1e-4)
    found = {r.item_id: r for r in items.collect()}
    assert [found[i].a for i in range(8)] == pytest.approx(list(a), abs=5e-3) and [found[i].b for i in range(8)] == pytest.approx(list(b), abs=5e-3)
    theta = {r.user_id: r.theta for r in users.collect()}
    assert [theta[u] for u in range(400)] == pytest.approx(list(post @ nodes), abs=5e-3)
    monkeypatch.setattr(calibration, "pack", lambda *_: None)       # as with more items than are packed
    joined, _, more = calibration.fit_mml(answers, max_rounds=25)
    assert all(b - a > -1e-8 for a, b in zip(more["history"], more["history"][1:])) and more["loglik"] <= info["loglik"] + 1e-6
    assert joined.count() == 8


def test_patterns_merge_equal_learners_and_keep_weights(spark):
    rows = [(u, i, (u + i) % 2) for u in range(40) for i in range(3)] + [(99, 0, 1), (99, 0, 1), (98, 0, 1), (97, None, 1), (96, 0, None)]
    table = spark.createDataFrame(rows, "user_id int, item_id int, answer int")
    found = patterns.pack(table.filter("item_id is not null"))
    assert sorted(r.weight for r in found.distinct.collect()) == [1.0, 1.0, 20.0, 20.0] and found.learners.count() == 42
    assert patterns.pack(table.filter("item_id is not null"), most_items=2) is None
    weight = np.array([3.0] * 20 + [1.0] * 20)
    _, _, _, right = made(np.random.default_rng(2), 40, 4)
    once, _, a = calibration.fit_mml(long_table(spark, right, weight), max_rounds=40)
    often, _, b = calibration.fit_mml(long_table(spark, np.repeat(right, weight.astype(int), 0)), max_rounds=40)
    assert a["loglik"] == pytest.approx(b["loglik"], rel=1e-9) and once.count() == often.count()


def test_graded_fit_rises_and_settles(spark):
    draw = np.random.default_rng(4)
    theta, slopes = draw.normal(size=1500), [0.8, 1.5, 1.1, 0.9, 1.3, 1.0]
    rows = []
    for i, slope in enumerate(slopes):
        reach = 1 / (1 + np.exp(-(slope * theta[:, None] + np.array([1.0, -0.2, -1.2]))))
        score = (draw.random((1500, 1)) < reach).sum(1)
        rows += [(u, i, int(s)) for u, s in enumerate(score)]
    history = []
    items, _ = graded.fit_grm(spark.createDataFrame(rows, "user_id int, item_id int, score int"), history=history)
    found = items.orderBy("item_id").collect()
    assert all(r.converged for r in found) and all(b - a > -1e-8 for a, b in zip(history, history[1:]))
    assert [r.slope for r in found] == pytest.approx(slopes, abs=0.4)
    assert len(hermite_grid()[0]) == 11


def test_chains_draw_from_the_posterior_and_repeat():
    draw = np.random.default_rng(5)
    rows = plain_rows(draw, 6, 4)._replace(state=np.column_stack([np.zeros(6), np.arange(1, 7)]))
    a, b, c = np.array([1.0, 1.4, 0.7, 2.0]), np.array([0.3, -0.5, 0.0, 1.0]), np.zeros(4)
    nodes = np.linspace(-6, 6, 400)
    share, _ = marginal.posterior(rows, marginal.item_logs(a, b, c, nodes), np.exp(-nodes ** 2 / 2) / np.exp(-nodes ** 2 / 2).sum())
    mean = marginal.mean_draws(rows, a, b, c, 20_000, 50, (1,))
    assert mean == pytest.approx(share @ nodes, abs=0.06)
    assert (marginal.mean_draws(rows, a, b, c, 50, 5, (1,)) == marginal.mean_draws(rows, a, b, c, 50, 5, (1,))).all()
    numbers = marginal.uniforms(np.arange(200_000).astype(np.uint64), 3, 4)
    assert abs(numbers.mean() - 0.5) < 0.005 and abs(np.corrcoef(numbers[1:], numbers[:-1])[0, 1]) < 0.01


def test_stochastic_fits_agree_with_the_marginal_one(spark):
    theta, a, b, right = made(np.random.default_rng(6), 300, 6)
    answers = long_table(spark, right)
    exact = {r.item_id: r for r in calibration.fit_mml(answers)[0].collect()}
    items, users = joint.fit_mhrm(answers, rounds=120, draws=100)
    for r in items.collect():
        assert r.converged and (r.a, r.b) == pytest.approx((exact[r.item_id].a, exact[r.item_id].b), abs=0.2)
    got = {r.user_id: r.theta for r in users.collect()}
    assert np.corrcoef([got[u] for u in range(300)], theta)[0, 1] > 0.6
    items, users = joint.fit_mh_mle(answers.withColumn("answer", F.col("answer")), rounds=30, draws=50)
    again, _ = joint.fit_mh_mle(answers.repartition(5), rounds=30, draws=50)
    key = lambda r: r.item_id
    for x, y in zip(sorted(items.collect(), key=key), sorted(again.collect(), key=key)):
        assert (x.a, x.b) == pytest.approx((y.a, y.b), abs=1e-6)
    assert users.count() == 300
