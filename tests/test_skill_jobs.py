"""Diagnosis, learning factors, skill maps and the mastery stream against plain versions."""
import datetime
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marksheet.operators import diagnosis, factors, skills, tracing
from marksheet.operators.sequences import build_sequences
from marksheet.plans.lineage import scratch_path
from marksheet.streaming import mastery


def test_dina_recovers_slip_and_guess(spark):
    draw = np.random.default_rng(1)
    masks = [1, 2, 4, 1, 2, 4, 3, 6, 5, 7, 1, 2, 4]
    slip, guess = draw.uniform(0.05, 0.2, len(masks)), draw.uniform(0.05, 0.25, len(masks))
    classes = draw.integers(0, 8, 1500)
    able = (classes[:, None] & np.array(masks)) == np.array(masks)
    right = draw.random(able.shape) < np.where(able, 1 - slip, guess)
    answers = spark.createDataFrame([(u, i, int(right[u, i])) for u in range(1500) for i in range(len(masks))] + [(0, 0, None)],
                                    "user_id int, item_id int, answer int")
    q = spark.createDataFrame([(i, k) for i, m in enumerate(masks) for k in range(3) if m >> k & 1] * 2, "item_id int, skill int")
    history = []
    items, shares, info = diagnosis.fit_dina(answers, q, history=history)
    assert info["converged"] and all(b - a > -1e-7 for a, b in zip(history, history[1:]))
    found = {r.item_id: r for r in items.collect()}
    assert [found[i].mask for i in range(13)] == masks
    assert [found[i].slip for i in range(13)] == pytest.approx(list(slip), abs=0.08)
    assert [found[i].guess for i in range(13)] == pytest.approx(list(guess), abs=0.08)
    assert sum(r.share for r in shares.collect()) == pytest.approx(1)
    learners = diagnosis.dina_classify(answers, items, shares, 3).collect()
    assert np.mean([r.map_class == classes[r.user_id] for r in learners]) > 0.75
    assert all(0 <= x <= 1 + 1e-9 for r in learners for x in r.eap)


def test_dina_keeps_guess_below_one_minus_slip(spark):
    answers = spark.createDataFrame([(u, i, (u + i) % 2) for u in range(30) for i in range(4)], "user_id int, item_id int, answer int")
    q = spark.createDataFrame([(0, "x"), (1, "y"), (2, "x")], "item_id int, skill string")       # item 3 asks for nothing
    items, _, _ = diagnosis.fit_dina(answers, q, max_rounds=50)
    assert all(r.guess <= 1 - r.slip + 1e-9 for r in items.collect())
    many = spark.createDataFrame([(0, k) for k in range(20)], "item_id int, skill int")
    with pytest.raises(ValueError, match="skills"):
        diagnosis.fit_dina(answers, many)


# ---- learning factors

def made_log(spark, draw, learners=40, skills_of=({0}, {1}, {0, 1}, {2}, {1, 2})):
    rows = []
    for u in range(learners):
        for t in range(draw.randint(1, 25)):
            rows.append((len(rows), u, draw.randrange(len(skills_of)), draw.choice([0, 1, 1, None] if t == 3 else [0, 1, 1]), t))
    log = spark.createDataFrame(rows, "row_id int, user_id int, item_id int, answer int, t int")
    q = spark.createDataFrame([(i, f"k{k}") for i, s in enumerate(skills_of) for k in s], "item_id int, skill string")
    return rows, skills_of, log, q


def test_opportunities_by_brute_force(spark):
    rows, skills_of, log, q = made_log(spark, random.Random(2))
    want = {}
    for n, u, i, _, t in rows:
        for k in skills_of[i]:
            old = [r for r in rows if r[1] == u and r[4] < t and k in skills_of[r[2]]]
            want[n, f"k{k}"] = (len(old), sum(r[3] == 1 for r in old), sum(r[3] == 0 for r in old))
    for hot in (1_000_000, 4):
        got = factors.opportunities(log, q, ["t"], hot).collect()
        assert {(r.row_id, r.factor): (r.n_before, r.right_before, r.wrong_before) for r in got} == want


@pytest.mark.parametrize("conjunctive", [False, True])
def test_factor_fits_are_stationary_and_best(spark, conjunctive):
    rows, skills_of, log, q = made_log(spark, random.Random(5))
    practised = factors.opportunities(log, q, ["t"])
    history = []
    found, users, info = factors.fit_factors(practised, conjunctive, history=history)
    assert info["converged"] and all(b - a > -1e-6 for a, b in zip(history, history[1:]))
    phi = np.array([[r.easiness, r.rate] for r in sorted(found.collect(), key=lambda r: r.skill)])
    theta = np.zeros(40)
    for r in users.collect():
        theta[r.user_id] = r.theta
    cells = {}
    for r in practised.filter("answer is not null").collect():
        cells.setdefault((r.row_id, r.user_id, r.answer), []).append((int(r.factor[1:]), r.n_before))

    def value(phi, theta):
        total = -(theta ** 2).sum() / 2 - factors.RIDGE * (phi ** 2).sum() / 2
        for (_, u, y), parts in cells.items():
            if conjunctive:
                p = np.prod([1 / (1 + np.exp(-(theta[u] + phi[k, 0] + phi[k, 1] * t))) for k, t in parts])
            else:
                p = 1 / (1 + np.exp(-(theta[u] + sum(phi[k, 0] + phi[k, 1] * t for k, t in parts))))
            total += np.log(p if y else 1 - p)
        return total

    best = value(phi, theta)
    assert best == pytest.approx(info["loglik"], abs=1e-6)
    for k, j in itertools.product(range(3), range(2)):
        step = np.zeros_like(phi)
        step[k, j] = 1e-4
        assert abs(value(phi + step, theta) - value(phi - step, theta)) / 2e-4 < 2e-3
    for u in range(0, 40, 7):
        step = np.zeros(40)
        step[u] = 1e-4
        assert abs(value(phi, theta + step) - value(phi, theta - step)) / 2e-4 < 2e-3
    if not conjunctive:     # a concave problem: a dense fit can only end at the same place
        x, unknown = [], {s: i for i, s in enumerate([("u", u) for u in range(40)] + [(k, j) for k in range(3) for j in range(2)])}
        y = np.array([key[2] for key in cells], float)
        x = np.zeros((len(cells), len(unknown)))
        for n, ((_, u, _), parts) in enumerate(cells.items()):
            x[n, unknown["u", u]] = 1
            for k, t in parts:
                x[n, unknown[k, 0]] += 1
                x[n, unknown[k, 1]] += t
        ridge, w = np.array([1.0] * 40 + [factors.RIDGE] * 6), np.zeros(46)
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ w))
            w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        assert np.concatenate([theta, phi.ravel()]) == pytest.approx(w, abs=1e-3)


# ---- skill maps

def test_closure_of_chains_and_cycles(spark, monkeypatch):
    monkeypatch.setattr(skills, "MOST_ROUNDS", 12)
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(None, 3), (3, None), (5, 6)], "skill int, needs int")
    found = {(r.skill, r.needs): r.steps for r in skills.closure(chain).collect()}
    assert found == {(i, j): j - i for i in range(300) for j in range(i + 1, 301)}
    ring = skills.closure(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5)], "skill int, needs int"))
    assert sorted(tuple(r) for r in skills.cycles(ring).collect()) == [(1, 3, 1), (2, 3, 1), (3, 3, 1), (5, 1, 5)]
    assert skills.closure(chain.limit(0)).collect() == []


def test_closure_joins_only_pairs_of_one_distance(spark, monkeypatch):
    kind, joined = type(spark.range(1)), []
    plain = kind.join

    def join(self, other, on=None, how=None):
        if on == "middle" and how is None:
            joined.append(self.count())
        return plain(self, other, on, how)

    monkeypatch.setattr(kind, "join", join)
    edges = [(i, (i * 2) % 97) for i in range(400)]
    found = skills.closure(spark.createDataFrame(edges, "skill int, needs int")).collect()
    assert joined and max(joined) <= 400      # one pair a skill, not all that are known
    reached = {}
    for s, n in edges:
        steps = 1
        while (s, n) not in reached:
            reached[s, n], n, steps = steps, (n * 2) % 97, steps + 1
    assert {(r.skill, r.needs): r.steps for r in found} == reached
    assert {tuple(r) for r in skills.cycles(spark.createDataFrame(found)).collect()} == {
        (s, k, min(n for a, n in reached if a == s and (n, s) in reached)) for (s, t), k in reached.items() if s == t}


def test_knowledge_states_by_brute_force(spark):
    draw = random.Random(9)
    for k in (0, 1, 6, 12):
        edges = [(f"s{a}", f"s{b}") for a in range(k) for b in range(k) if a > b and draw.random() < 0.2]
        names = spark.createDataFrame([(f"s{i}", (i * 5) % k if k in (6, 12) else i) for i in range(k)], "skill string, bit int")
        bits = {r.skill: r.bit for r in names.collect()}
        closed = skills.closure(spark.createDataFrame(edges, "skill string, needs string"))
        want = [s for s in range(1 << k) if all(not s >> bits[a] & 1 or s >> bits[b] & 1 for a, b in edges)]
        got = skills.knowledge_states(names, closed).collect()
        assert sorted(r.state for r in got) == want and all(r.size == r.state.bit_count() for r in got)
    ring = skills.closure(spark.createDataFrame([("s0", "s1"), ("s1", "s0")], "skill string, needs string"))
    with pytest.raises(ValueError, match="cycle"):
        skills.knowledge_states(spark.createDataFrame([("s0", 0), ("s1", 1)], "skill string, bit int"), ring)


# ---- stream

def test_stream_gives_the_states_of_the_whole_log(spark):
    draw, start = random.Random(4), datetime.datetime(2024, 1, 1)
    rows = [(draw.choice(["a", "b"]), draw.randrange(4), start + datetime.timedelta(minutes=m), m, draw.randrange(2)) for m in range(120)]
    schema = "skill string, user_id int, ts timestamp, event_id int, answer int"
    slices = [rows[:40], rows[40:80], rows[80:]]
    slices[1], slices[2] = slices[1] + slices[2][:5], slices[2][5:]
    slices[2] = [*reversed(slices[2]), *rows[75:78]]    # out of order, and three that come long after the delay, once more
    late = rows[:3]
    base = scratch_path(spark, "stream")

    def land(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        query = mastery.start_mastery(spark, mastery.mastery_stream(stream, delay="50 minutes"), f"{base}/out", f"{base}/checkpoint")
        query.awaitTermination()
        return mastery.late_answers(query)

    slices[2] = [r for r in slices[2] if r not in rows[75:78]]
    land(slices[0])
    dropped = run()
    land(slices[1])
    land(slices[2])
    dropped += run()            # a new query that goes on from the checkpoint
    land(late)
    land([("z", 0, start + datetime.timedelta(days=2), 999, 1)])
    dropped += run()
    assert dropped == 3
    found = {(r.skill, r.user_id): r for r in mastery.latest(spark.read.parquet(f"{base}/out")).collect()}
    seqs = build_sequences(spark.createDataFrame(rows, schema), ["skill"], ["user_id"], ["ts", "event_id"], {"obs": "answer"})
    whole = {(r.trace, r.grp): r for r in tracing.forward(seqs).withColumn("prob", tracing.next_right()).collect()}
    assert found.keys() == whole.keys()
    for key, r in found.items():
        assert r.n_obs == whole[key].n_obs and r.state == pytest.approx(whole[key].state, abs=1e-9)
        assert r.prob == pytest.approx(whole[key].prob, abs=1e-9)
    assert spark.read.parquet(f"{base}/out").filter(F.col("n_obs") < 1).isEmpty()
