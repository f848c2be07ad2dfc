"""Knowledge-tracing queries.

The SQL checks are recursive expressions over numbered answers, generated for any number of states.
"""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from marksheet.catalog.registry import query, r, with_views
from marksheet.operators import classical as ct
from marksheet.operators import responses as rs
from marksheet.operators import sequences as sq
from marksheet.operators import tracing as tr
from marksheet.operators import training as tn
from marksheet.operators.tracing import LEVELS, STANDARD, TracingConfig
from marksheet.sources import views

ORDER = ["ts", "event_id"]
# A model whose decoding is less one-sided than the start values.
STEADY = TracingConfig(pi=[0.6, 0.4], A=[[0.85, 0.15], [0.0, 1.0]], B=[[0.75, 0.25], [0.3, 0.7]])


def log(spark, sf_dir):
    return views.tracing_answers(spark, sf_dir)


def sequences(spark, sf_dir):
    return sq.build_sequences(log(spark, sf_dir), ["skill"], ["user_id"], ORDER, {"obs": "answer"})


def split_rated(spark, sf_dir):
    """Training sequences and test answers, both with the difficulty calibrated on the training side."""
    marked = rs.leave_last_out(log(spark, sf_dir), ["skill", "user_id"], ORDER, "event_id")
    train = marked.filter("not is_test")
    items = ct.item_calibration(train).select("item_id", "difficulty")
    seqs = sq.build_sequences(ct.attach_item_info(train, items), ["skill"], ["user_id"], ORDER,
                              {"obs": "answer", "difficulty": "difficulty"})
    test = ct.attach_item_info(marked.filter("is_test"), items).select(
        "event_id", F.col("skill").alias("trace"), F.col("user_id").alias("grp"), "difficulty")
    return seqs, test


# ---- SQL -------------------------------------------------------------------------------------

def number(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


class Sql:
    """Expressions of a model: literals of a configuration, or columns of a parameter expression."""

    def __init__(self, config: TracingConfig, models: str | None = None, offset: float = 0.5):
        self.config, self.models, self.offset = config, models, offset
        self.S = range(config.states)

    def pi(self, i):
        return f"m.pi{i}" if self.models else number(self.config.pi[i])

    def A(self, i, j):
        if self.config.A[i][j] == 0 and (not self.models or self.config.states > 2):
            return None
        return f"m.a{i}{j}" if self.models else number(self.config.A[i][j])

    def right(self, i, difficulty="s.difficulty"):
        if self.config.leveled:
            return f"(1 / (1 + exp({difficulty} - {i} - {number(self.offset)})))"
        return f"m.b{i}1" if self.models else number(self.config.B[i][1])

    def emit(self, i):
        wrong = f"1 - {self.right(i)}"
        if not self.config.leveled:
            wrong = f"m.b{i}0" if self.models else number(self.config.B[i][0])
        return f"(CASE WHEN s.x = 1 THEN {self.right(i)} ELSE {wrong} END)"

    def join(self):
        return f"JOIN {self.models} m ON m.trace = s.trace" if self.models else ""

    def arrive(self, j, value):
        """Sum over i of value(i) * A[i][j]."""
        return "(" + " + ".join(f"{value(i)} * {self.A(i, j)}" for i in self.S if self.A(i, j)) + ")"

    def cols(self, *names):
        return ", ".join(f"{n}{i}" for n in names for i in self.S)

    def total(self, name):
        return "(" + " + ".join(f"{name}{i}" for i in self.S) + ")"

    def forward(self, name="fwd", seq="seq") -> dict[str, str]:
        """Filtered state f, log-likelihood ll per step t."""
        scale = self.total("w")
        norm = ", ".join(f"w{i} / {scale} AS f{i}" for i in self.S)
        first = ", ".join(f"{self.pi(i)} * {self.emit(i)} AS w{i}" for i in self.S)
        step = ", ".join(f"{self.arrive(j, lambda i: f'f.f{i}')} * {self.emit(j)} AS w{j}" for j in self.S)
        return {name: f"""SELECT trace, grp, t, n, {norm}, ln({scale}) AS ll FROM
            (SELECT s.trace, s.grp, s.t, s.n, {first} FROM {seq} s {self.join()} WHERE s.t = 1)
            UNION ALL SELECT trace, grp, t, n, {norm}, ll + ln({scale}) FROM
            (SELECT s.trace, s.grp, s.t, s.n, f.ll, {step} FROM {name} f
             JOIN {seq} s ON s.trace = f.trace AND s.grp = f.grp AND s.t = f.t + 1 {self.join()})"""}

    def backward(self, name="bwd", seq="seq") -> dict[str, str]:
        """Later likelihood b per step; v is emission times b of the same step."""
        scale = self.total("w")
        value = ", ".join("(" + " + ".join(f"{self.A(i, j)} * b.v{j}" for j in self.S if self.A(i, j)) + f") AS w{i}"
                          for i in self.S)
        ones = ", ".join(f"CAST(1 AS DOUBLE) AS b{i}" for i in self.S)
        seen = ", ".join(f"{self.emit(i)} AS v{i}" for i in self.S)
        norm = ", ".join(f"w{i} / {scale} AS b{i}" for i in self.S)
        both = ", ".join(f"e{i} * w{i} / {scale} AS v{i}" for i in self.S)
        emits = ", ".join(f"{self.emit(i)} AS e{i}" for i in self.S)
        return {name: f"""SELECT s.trace, s.grp, s.t, {ones}, {seen} FROM {seq} s {self.join()} WHERE s.t = s.n
            UNION ALL SELECT trace, grp, t, {norm}, {both} FROM
            (SELECT s.trace, s.grp, s.t, {value}, {emits} FROM {name} b
             JOIN {seq} s ON s.trace = b.trace AND s.grp = b.grp AND s.t = b.t - 1 {self.join()})"""}

    def gamma(self, name="gam", fwd="fwd", bwd="bwd", seq="seq") -> dict[str, str]:
        products = ", ".join(f"f{i} * b{i} AS w{i}" for i in self.S)
        norm = ", ".join(f"w{i} / {self.total('w')} AS g{i}" for i in self.S)
        return {name: f"""SELECT trace, grp, t, n, x, ll, {self.cols('f')}, {norm} FROM
            (SELECT trace, grp, t, f.n, x, ll, {self.cols('f')}, {products} FROM {fwd} f JOIN {bwd} b USING (trace, grp, t)
             JOIN {seq} USING (trace, grp, t))"""}

    def stats(self, tag="", seq="seq", keep="") -> dict[str, str]:
        """One row of additive statistics per sequence."""
        fwd, bwd, gam, xi = f"fwd{tag}", f"bwd{tag}", f"gam{tag}", f"xi{tag}"
        cells = [(i, j) for i in self.S for j in self.S]
        terms = ", ".join(f"{f'f.f{i} * {self.A(i, j)} * b.v{j}' if self.A(i, j) else 'CAST(0 AS DOUBLE)'} AS y{i}{j}"
                          for i, j in cells)
        total = "(" + " + ".join(f"y{i}{j}" for i, j in cells) + ")"
        return {
            **self.forward(fwd, seq), **self.backward(bwd, seq), **self.gamma(gam, fwd, bwd, seq),
            xi: f"""SELECT trace, grp, {', '.join(f'sum(y{i}{j} / {total}) AS m{i}{j}' for i, j in cells)} FROM
                (SELECT s.trace, s.grp, {terms} FROM {fwd} f JOIN {bwd} b ON b.trace = f.trace AND b.grp = f.grp AND b.t = f.t + 1
                 JOIN (SELECT DISTINCT trace, grp FROM {seq}) s ON s.trace = f.trace AND s.grp = f.grp {self.join()})
                GROUP BY trace, grp""",
            f"stat{tag}": f"""SELECT g.trace, g.grp, max(n) AS n_obs, max(CASE WHEN t = n THEN ll END) AS loglik,
                {', '.join(f'sum(CASE WHEN t = 1 THEN g{i} END) AS first{i}' for i in self.S)},
                {', '.join(f'sum(CASE WHEN x = {k} THEN g{i} ELSE 0 END) AS by{i}{k}' for i in self.S for k in (0, 1))},
                {', '.join(f'coalesce(any_value(m{i}{j}), 0) AS m{i}{j}' for i, j in cells)}
                FROM {gam} g LEFT JOIN {xi} x USING (trace, grp) {keep} GROUP BY g.trace, g.grp""",
        }

    def update(self, name: str, stat: str) -> dict[str, str]:
        """New parameters of the standard two-state model; the bounds leave row 1 of A fixed."""
        def share(top, *parts):
            return f"sum({top}) / sum({' + '.join(parts)})"

        return {name: f"""SELECT trace, count(*) AS n_seq, sum(loglik) AS loglik,
            sum(first0) / count(*) AS pi0, sum(first1) / count(*) AS pi1,
            {share('m00', 'm00', 'm01')} AS a00, {share('m01', 'm00', 'm01')} AS a01,
            CAST(0 AS DOUBLE) AS a10, CAST(1 AS DOUBLE) AS a11,
            greatest({share('by00', 'by00', 'by01')}, 0.7) AS b00, least({share('by01', 'by00', 'by01')}, 0.3) AS b01,
            least({share('by10', 'by10', 'by11')}, 0.3) AS b10, greatest({share('by11', 'by10', 'by11')}, 0.7) AS b11
            FROM {stat} GROUP BY trace"""}

    def paths(self, name="vit", seq="seq") -> dict[str, str]:
        """Best log score d and path text p per state and step."""
        def lg(x):
            return number(math.log(x)) if x > 0 else "CAST('-Infinity' AS DOUBLE)"

        first = ", ".join(f"{lg(self.config.pi[i])} + ln({self.emit(i)}) AS d{i}, '{i}' AS p{i}" for i in self.S)
        parts = []
        for j in self.S:
            moves = [(i, f"v.d{i} + {lg(self.config.A[i][j])}") for i in self.S if self.config.A[i][j] > 0]
            best = f"greatest({', '.join(m for _, m in moves)})"
            origin = "CASE " + " ".join(f"WHEN {m} = {best} THEN v.p{i}" for i, m in moves) + " END"
            parts.append(f"{best} + ln({self.emit(j)}) AS d{j}, {origin} || '{j}' AS p{j}")
        top = f"greatest({self.cols('d')})"
        pick = "CASE " + " ".join(f"WHEN d{i} = {top} THEN p{i}" for i in self.S) + " END"
        return {name: f"""SELECT s.trace, s.grp, s.t, s.n, {first} FROM {seq} s WHERE s.t = 1
            UNION ALL SELECT s.trace, s.grp, s.t, s.n, {', '.join(parts)} FROM {name} v
            JOIN {seq} s ON s.trace = v.trace AND s.grp = v.grp AND s.t = v.t + 1""",
                "best": f"SELECT trace, grp, {pick} AS path, {top} AS score FROM {name} WHERE t = n"}


def numbered(source="kt", trace="skill", difficulty=False) -> dict[str, str]:
    """Answers numbered within their sequence."""
    parts = {}
    extra = ""
    if difficulty:
        parts["info"] = """SELECT item_id, (1 - (sum(answer) + 1) / CAST(count(*) + 2 AS DOUBLE)) * 5 AS difficulty
            FROM train GROUP BY item_id"""
        extra, source = ", difficulty", f"{source} LEFT JOIN info USING (item_id)"
    parts["seq"] = f"""SELECT {trace} AS trace, user_id AS grp, answer AS x{extra},
        row_number() OVER (PARTITION BY skill, user_id ORDER BY ts, event_id) AS t,
        count(*) OVER (PARTITION BY skill, user_id) AS n FROM {source}"""
    return parts


def traced(body: str, *parts: dict[str, str], view="kt", difficulty=False) -> str:
    more = numbered(view, difficulty=difficulty)
    for part in parts:
        more.update(part)
    return with_views(view, body, more, recursive=True)


STD, STEADY_SQL = Sql(STANDARD), Sql(STEADY)
NEXT = " + ".join(f"{STD.arrive(j, lambda i: f'f{i}')} * {STD.right(j)}" for j in STD.S)


@query("kt_forward", traced(f"""SELECT trace, grp, n AS n_obs, {r('f0', 'state0')}, {r('f1', 'state1')}, {r('ll', 'loglik')}
    FROM fwd WHERE t = n""", STD.forward()))
def kt_forward(spark, sf_dir):
    return tr.forward(sequences(spark, sf_dir)).select(
        "trace", "grp", "n_obs", F.col("state")[0].alias("state0"), F.col("state")[1].alias("state1"), "loglik")


CELLS = [(i, j) for i in range(2) for j in range(2)]


@query("kt_sequence_stats", traced(f"""SELECT trace, grp, n_obs, {r('first0', 'first0')}, {r('first1', 'first1')},
    {', '.join(r(f'm{i}{j}', f'm{i}{j}') for i, j in CELLS)}, {', '.join(r(f'by{i}{j}', f'by{i}{j}') for i, j in CELLS)},
    {r('loglik', 'loglik')} FROM stat""", STD.stats()))
def kt_sequence_stats(spark, sf_dir):
    return tn.sequence_stats(sequences(spark, sf_dir)).select(
        "trace", "grp", "n_obs", F.col("first")[0].alias("first0"), F.col("first")[1].alias("first1"),
        *[F.col("moves")[2 * i + j].alias(f"m{i}{j}") for i, j in CELLS],
        *[F.col("by_answer")[2 * i + j].alias(f"by{i}{j}") for i, j in CELLS], "loglik")


@query("kt_smooth", traced(f"""SELECT trace, grp, t - 1 AS step, x AS obs, {r('g0', 'p0')}, {r('g1', 'p1')} FROM gam""",
                           STEADY_SQL.forward(), STEADY_SQL.backward(), STEADY_SQL.gamma()))
def kt_smooth(spark, sf_dir):
    return tr.smooth(sequences(spark, sf_dir), config=STEADY).select(
        "trace", "grp", "step", "obs", F.col("posterior")[0].alias("p0"), F.col("posterior")[1].alias("p1"))


@query("kt_decode_map", traced("SELECT trace, grp, t - 1 AS step, CASE WHEN g0 >= g1 THEN 0 ELSE 1 END::BIGINT AS state FROM gam",
                               STEADY_SQL.forward(), STEADY_SQL.backward(), STEADY_SQL.gamma()))
def kt_decode_map(spark, sf_dir):
    return tr.decode_map(sequences(spark, sf_dir), config=STEADY).select("trace", "grp", "step", "state")


PARAMS = ["pi0", "pi1", *[f"a{i}{j}" for i, j in CELLS], *[f"b{i}{j}" for i, j in CELLS]]
MODEL_SQL = f"SELECT trace, n_seq, {r('loglik', 'loglik')}, {', '.join(r(p, p) for p in PARAMS)} FROM "
LONG = "WHERE n >= 3"


def flat(models, *keys):
    return models.select(
        *keys, *[c for c in ("iter",) if c in models.columns], "n_seq", "loglik",
        F.col("pi")[0].alias("pi0"), F.col("pi")[1].alias("pi1"),
        *[F.col("A")[i][j].alias(f"a{i}{j}") for i, j in CELLS], *[F.col("B")[i][j].alias(f"b{i}{j}") for i, j in CELLS])


FITTED_SQL = MODEL_SQL.replace("n_seq", "iter, n_seq")


def fitted() -> dict[str, str]:
    """All rounds of the fit as ``fit``; a trace that has gained less than the tolerance stays as it is."""
    start = [*STANDARD.pi, *STANDARD.A[0], *STANDARD.A[1], *STANDARD.B[0], *STANDARD.B[1]]
    parts = {"mod0": f"""SELECT DISTINCT trace, {', '.join(f'{number(v)} AS {p}' for p, v in zip(PARAMS, start))},
        0 AS iter, CAST(NULL AS DOUBLE) AS loglik, CAST(0 AS BIGINT) AS n_seq, true AS active FROM seq"""}
    for k in range(1, STANDARD.max_iter + 1):
        last = "fit" if k == STANDARD.max_iter else f"mod{k}"
        parts[f"act{k}"] = f"SELECT * FROM mod{k - 1} WHERE active"
        parts |= Sql(STANDARD, f"act{k}").stats(f"_{k}", keep=LONG)
        parts |= Sql(STANDARD, f"act{k}").update(f"new{k}", f"stat_{k}")
        parts[last] = f"""SELECT m.trace, {', '.join(f'CASE WHEN u.n_seq IS NULL THEN m.{p} ELSE u.{p} END AS {p}' for p in PARAMS)},
            m.iter + CASE WHEN u.n_seq IS NULL THEN 0 ELSE 1 END AS iter, coalesce(u.loglik, m.loglik) AS loglik,
            coalesce(u.n_seq, m.n_seq) AS n_seq, m.active AND u.n_seq IS NOT NULL
            AND NOT coalesce((u.loglik - m.loglik) / u.n_seq < {number(STANDARD.tol)}, false) AS active
            FROM mod{k - 1} m LEFT JOIN new{k} u USING (trace)"""
    return parts


@query("kt_update_models", traced(MODEL_SQL + "one", STD.stats("_1", keep=LONG), STD.update("one", "stat_1")))
def kt_update_models(spark, sf_dir):
    stats = tn.sequence_stats(sq.drop_short_sequences(sequences(spark, sf_dir)))
    return flat(tn.update_models(tn.summed_stats(stats, 2)), "trace")


@query("kt_fit_by_skill", traced(FITTED_SQL + "fit", fitted()))
def kt_fit_by_skill(spark, sf_dir):
    return flat(tn.fit_by_skill(sequences(spark, sf_dir)), "trace")


@query("kt_fit_batch", traced(FITTED_SQL + "fit", fitted()))
def kt_fit_batch(spark, sf_dir):
    return flat(tn.fit_batch(log(spark, sf_dir), ["skill"], ["user_id"], ORDER, {"obs": "answer"}), "trace")


OWN = with_views("kt", FITTED_SQL + "fit WHERE n_seq > 0", {**numbered(trace="skill || '_' || user_id"), **fitted()}, True)


@query("kt_fit_by_skill_user", OWN)
def kt_fit_by_skill_user(spark, sf_dir):
    models = tn.fit_by_sequence(sequences(spark, sf_dir)).filter("success")
    return flat(models.withColumn("trace", F.concat_ws("_", "trace", "grp")), "trace")


@query("kt_fit_irt")
def kt_fit_irt(spark, sf_dir):
    seqs, _ = split_rated(spark, sf_dir)
    models = tn.fit_levels(seqs)
    return models.select("trace", "grp", "iter", "loglik", "success",
                         *[F.col("pi")[i].alias(f"pi{i}") for i in range(7)])


@query("kt_predict_next", traced(f"SELECT trace, grp, n AS n_obs, {r(NEXT, 'prob')} FROM fwd WHERE t = n", STD.forward()))
def kt_predict_next(spark, sf_dir):
    return tr.predict_next(sequences(spark, sf_dir))


@query("kt_predict_first", traced(f"SELECT trace, {r('pi0 * b01 + pi1 * b11', 'prob')} FROM fit", fitted()))
def kt_predict_first(spark, sf_dir):
    return tr.predict_first(tn.fit_by_skill(sequences(spark, sf_dir)))


PATHS = STEADY_SQL.paths()


@query("kt_viterbi", traced(f"""SELECT trace, grp, CAST(k AS BIGINT) AS step, {r('score', 'score')},
    CAST(substr(path, CAST(k + 1 AS BIGINT), 1) AS BIGINT) AS state
    FROM (SELECT *, unnest(range(length(path))) AS k FROM best)""", PATHS))
def kt_viterbi(spark, sf_dir):
    return tr.viterbi(sequences(spark, sf_dir), config=STEADY)


def next_state_sql(config: TracingConfig) -> str:
    arms = []
    for i, row in enumerate(config.A):
        best = max(range(len(row)), key=lambda j: row[j])
        arms.append((i, best, number(math.log(row[best]))))
    state = "CASE right(path, 1) " + " ".join(f"WHEN '{i}' THEN {b}" for i, b, _ in arms) + " END"
    move = "CASE right(path, 1) " + " ".join(f"WHEN '{i}' THEN {m}" for i, _, m in arms) + " END"
    return f"""SELECT trace, grp, CAST(right(path, 1) AS BIGINT) AS last_state, CAST({state} AS BIGINT) AS next_state,
        {r(f'score + {move}', 'score')} FROM best"""


@query("kt_predict_viterbi", traced(next_state_sql(STEADY), PATHS))
def kt_predict_viterbi(spark, sf_dir):
    return tr.predict_viterbi(sequences(spark, sf_dir), config=STEADY)


LEVEL_SQL = Sql(LEVELS)
LEVEL_NEXT = " + ".join(f"{LEVEL_SQL.arrive(j, lambda i: f'f{i}')} * {LEVEL_SQL.right(j, 'i.difficulty')}" for j in LEVEL_SQL.S)
ITEM_TEST = """test q JOIN {found} f ON q.skill = f.trace AND q.user_id = f.grp LEFT JOIN info i ON i.item_id = q.item_id"""


@query("kt_irt_predict_next", with_views("train test", f"""SELECT q.event_id, {r(LEVEL_NEXT, 'prob')}
    FROM {ITEM_TEST.format(found="fwd")} WHERE f.t = f.n""",
    {**numbered("train", difficulty=True), **LEVEL_SQL.forward()}, True))
def kt_irt_predict_next(spark, sf_dir):
    seqs, test = split_rated(spark, sf_dir)
    return tr.predict_next_item(seqs, test).select("event_id", "prob")


@query("kt_irt_predict_first", with_views("train test", f"""SELECT q.event_id,
    {r(' + '.join(f"{number(1 / 7)} * {LEVEL_SQL.right(j, 'i.difficulty')}" for j in LEVEL_SQL.S), 'prob')}
    FROM test q LEFT JOIN info i ON i.item_id = q.item_id""", {"info": numbered("train", difficulty=True)["info"]}))
def kt_irt_predict_first(spark, sf_dir):
    seqs, test = split_rated(spark, sf_dir)
    return tr.predict_first_item(tr.config_models(seqs, LEVELS), test).select("event_id", "prob")


@query("kt_irt_predict_viterbi", with_views("train test", f"""SELECT q.event_id, CAST(f.next AS BIGINT) AS next_state,
    {r("1 / (1 + exp(i.difficulty - f.next - CAST(0.5 AS DOUBLE)))", 'prob')} FROM {ITEM_TEST.format(found='nxt')}""",
    {**numbered("train", difficulty=True), **LEVEL_SQL.paths(),
     "nxt": "SELECT trace, grp, CAST(right(path, 1) AS INT) AS next FROM best"}, True))
def kt_irt_predict_viterbi(spark, sf_dir):
    seqs, test = split_rated(spark, sf_dir)
    states = tr.predict_viterbi(seqs, config=LEVELS).select("trace", "grp", "next_state")
    return test.join(states, ["trace", "grp"]).select(
        "event_id", "next_state", tr.state_right(LEVELS, "difficulty").alias("prob"))


@query("kt_log_likelihood", traced(f"""SELECT trace, count(*) AS n_seq, {r('sum(ll)', 'loglik')} FROM fwd WHERE t = n GROUP BY trace""",
                                   STEADY_SQL.forward()))
def kt_log_likelihood(spark, sf_dir):
    return tr.log_likelihood_by_trace(sequences(spark, sf_dir), config=STEADY)


@query("kt_model_table", traced(f"""SELECT count(*) AS n_models, count(*) FILTER (n_seq > 0) AS n_success,
    max(iter) AS max_iter, {r('sum(loglik)', 'loglik')} FROM fit""", fitted()))
def kt_model_table(spark, sf_dir):
    return tn.model_summary(tn.fit_by_skill(sequences(spark, sf_dir)))


STEADY_NEXT = " + ".join(f"{STEADY_SQL.arrive(j, lambda i: f'f{i}')} * {STEADY_SQL.right(j)}" for j in STEADY_SQL.S)


@query("kt_predict_batch", traced(f"""SELECT trace, grp, 'posterior' AS algorithm, {r(STEADY_NEXT, 'prob')} FROM fwd WHERE t = n
    UNION ALL SELECT trace, grp, 'viterbi', CASE right(path, 1) WHEN '0' THEN 0.25 ELSE 0.7 END FROM best""",
                                  STEADY_SQL.forward(), PATHS))
def kt_predict_batch(spark, sf_dir):
    rows = log(spark, sf_dir)
    parts = [tr.predict_batch(rows, ["skill"], ["user_id"], ORDER, {"obs": "answer"}, config=STEADY, algorithm=a)
             .withColumn("algorithm", F.lit(a)) for a in ("posterior", "viterbi")]
    return parts[0].unionByName(parts[1])
