"""Passes over patterns: parts for every core, matrices instead of flat cells; one timer for a learner's waiting answers."""
import numpy as np
import pandas as pd
import pytest

from marksheet.operators import marginal, patterns
from marksheet.streaming import mastery


def some_rows(draw, learners=40, items=6, most=1):
    held = draw.random((learners, items)) < 0.8
    held[:, 0] = True
    row, item = np.nonzero(held)
    return patterns.Rows(row, item, draw.integers(0, 2, len(row)), draw.integers(1, most + 1, len(row)).astype(float),
                         np.searchsorted(row, np.arange(learners)), draw.integers(1, 4, learners).astype(float),
                         np.column_stack([np.zeros(learners), np.arange(1, learners + 1)]))


def test_small_tables_are_packed_in_parts_for_every_core(spark):
    rows = [(u, i, u >> i & 1) for u in range(300) for i in range(9)]
    found = patterns.pack(spark.createDataFrame(rows, "user_id int, item_id int, answer int"))
    for table in (found.learners, found.distinct):
        assert len(table.inputFiles()) >= spark.sparkContext.defaultParallelism
    assert found.learners.count() == 300 and found.distinct.count() == 300


@pytest.mark.parametrize("most", [1, 3])
def test_matrices_give_the_draws_of_flat_cells(monkeypatch, most):
    draw = np.random.default_rng(most)
    rows = some_rows(draw, most=most)
    a, b, c = draw.uniform(0.5, 2, 6), draw.normal(size=6), np.zeros(6)
    work = {}
    monkeypatch.setattr(marginal, "sums", lambda table, shapes, run: work.setdefault(len(work), run(rows)))
    nodes = np.linspace(-3, 3, 7)

    def all_of():
        work.clear()
        means = marginal.mean_draws(rows, a, b, c, 60, 5, (3, 2))
        expected = marginal.expectations(None, marginal.item_logs(a, b, c, nodes), np.full(7, 1 / 7))
        return [means, *marginal.sampled_sums(None, a, b, c, 60, 5, (3, 2)), expected["loglik"], np.reshape(expected["counts"], (6, 2, 7)), expected["mass"]]

    assert rows.matrix(6, 2) is not None
    dense = all_of()
    monkeypatch.setattr(patterns, "DENSE", 0)
    assert rows.matrix(6, 2) is None
    for x, y in zip(dense, all_of()):
        assert x == pytest.approx(y, rel=1e-9, abs=1e-9)


class Held:
    """Value, list and timers of one key."""

    def __init__(self):
        self.value, self.rows, self.timers = None, [], []

    getValueState = getListState = lambda self, *_: self
    exists = lambda self: self.value is not None

    def update(self, value):
        self.value = value

    def get(self):
        return iter(self.rows) if self.listing else self.value

    def appendList(self, rows):
        self.rows += rows

    appendValue = lambda self, row: self.rows.append(row)
    put = lambda self, rows: self.__init__() or self.rows.extend(rows)
    clear = lambda self: self.rows.clear()
    registerTimer = lambda self, at: self.timers.append(at)


def test_answers_that_wait_have_one_timer_and_go_out_together():
    key, now, waiting = Held(), Held(), Held()
    now.listing, waiting.listing = False, True
    own = mastery.Mastery()
    own.handle, own.now, own.waiting = key, now, waiting
    frame = pd.DataFrame({"ts": pd.to_datetime([3_000, 1_000, 2_000, 9_000], unit="us"), "event_id": [3, 1, 2, 4], "answer": [1, 0, 1, 1],
                          "pi": [[0.5, 0.5]] * 4, "A": [[[0.9, 0.1], [0.0, 1.0]]] * 4, "B": [[[0.8, 0.2], [0.1, 0.9]]] * 4})
    assert list(own.handleInputRows(("s", 1), iter([frame]), None)) == [] and key.timers == [1]

    class At:
        getCurrentWatermarkInMs = lambda self: 3
        getExpiryTimeInMs = lambda self: 1

    out = list(own.handleExpiredTimer(("s", 1), At(), At()))
    assert [int(f["n_obs"][0]) for f in out] == [3] and key.timers == [1, 9] and [r[1] for r in waiting.rows] == [4]
