"""The mastery stream keeps many keys in one bucket."""
import numpy as np
import pandas as pd
import pytest

from marksheet.operators.tracing import STANDARD
from marksheet.streaming import mastery


class Store:
    """Value or list of one bucket; counts the calls."""

    def __init__(self):
        self.value, self.rows, self.calls, self.timers = None, None, 0, []

    def _called(self):
        self.calls += 1

    exists = lambda self: self._called() or self.value is not None
    update = lambda self, value: self._called() or setattr(self, "value", value)
    get = lambda self: self._called() or (iter(self.rows) if self.rows is not None else self.value)
    appendValue = lambda self, row: self._called() or self.rows.append(row)
    put = lambda self, rows: self._called() or setattr(self, "rows", list(rows))
    clear = lambda self: self._called() or setattr(self, "rows", [])
    registerTimer = lambda self, at: self._called() or self.timers.append(at)


class At:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def test_a_bucket_of_keys_takes_few_state_calls():
    draw = np.random.default_rng(1)
    pi, A, B = (np.array(x, float) for x in (STANDARD.pi, STANDARD.A, STANDARD.B))
    start, other = ('{"pi": %s, "A": %s, "B": %s}' % (p, A.tolist(), B.tolist()) for p in (pi.tolist(), [0.5, 0.5]))
    own = mastery.Masteries(start)
    own.handle, own.now, own.waiting = Store(), Store(), Store()
    own.waiting.rows = []
    frame = pd.DataFrame({"skill": draw.choice(["a", "b"], 4000), "user_id": draw.integers(0, 300, 4000), "tick": draw.integers(1, 40, 4000) * 1000,
                          "event_id": np.arange(4000), "answer": draw.integers(0, 2, 4000)})
    frame["model"] = np.where(frame["skill"] == "a", "", other)
    out = []
    for part, until in ((frame[frame["tick"] < 25_000], 15), (frame[frame["tick"] >= 25_000], 100)):
        assert list(own.handleInputRows((1,), iter([part.iloc[:900], part.iloc[900:]]), None)) == []
        out += own.handleExpiredTimer((1,), At(until), None)
    assert sum(s.calls for s in (own.handle, own.now, own.waiting)) <= 16 and own.waiting.rows == [] and own.handle.timers == [1, 16, 25]
    last = pd.concat(out).drop_duplicates(["skill", "user_id"], keep="last").set_index(["skill", "user_id"])
    assert len(last) == len(frame.drop_duplicates(["skill", "user_id"]))
    for key, rows in frame.sort_values(["tick", "event_id"]).groupby(["skill", "user_id"]):
        state = None
        for answer in rows["answer"]:
            state = mastery.updated(state, answer, pi if key[0] == "a" else np.array([0.5, 0.5]), A, B)
        found = last.loc[key]
        assert found["n_obs"] == len(rows) and found["tick"] == rows["tick"].max()
        assert found["state"] == pytest.approx(list(state), abs=1e-9) and found["prob"] == pytest.approx(float(state @ A @ B[:, 1]), abs=1e-9)
