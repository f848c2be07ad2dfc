"""Queries on skills: diagnosis, learning factors, skill maps, mastery over a stream."""
from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from marksheet.catalog.registry import query, r, with_views
from marksheet.catalog.tracing import ORDER, STD, log, traced
from marksheet.operators import diagnosis, factors, skills
from marksheet.plans.lineage import cut_lineage, scratch_path
from marksheet.sources import views
from marksheet.streaming import mastery

MASK = "(CAST(substr(item_id, 7) AS INT) % 15 + 1)"
QUARTERS = 4


def brand_skills(answers):
    """Which of four skills a brand asks for: the bits of a number made from its name."""
    mask = F.substring("item_id", 7, 10).cast("int") % 15 + 1
    bits = F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("k")
    return answers.select("item_id", mask.alias("m")).distinct().select("item_id", "m", bits).filter(
        F.col("m").bitwiseAND(F.expr("shiftleft(1, k)")) > 0).select("item_id", F.concat(F.lit("s"), F.col("k").cast("string")).alias("skill"))


# ---- diagnosis

def _round(items: str, shares: str, tag: str) -> dict[str, str]:
    right = "CASE WHEN (c.class & i.mask) = i.mask THEN 1 - i.slip ELSE i.guess END"
    low, high = (f"CAST({x!r} AS DOUBLE)" for x in (diagnosis.EDGE, 1 - diagnosis.EDGE))
    rate = lambda x, y: f"CASE WHEN {x} + {y} > 0 THEN {x} / ({x} + {y}) ELSE (r1 + r0) / (r1 + r0 + w1 + w0) END"
    pooled = "(r1 + r0) / (r1 + r0 + w1 + w0)"
    return {
        f"lik{tag}": f"""SELECT user_id, class, sum(ln(CASE WHEN answer = 1 THEN p ELSE 1 - p END)) + ln(any_value(share)) AS l FROM (
            SELECT user_id, answer, c.class, c.share, {right} AS p FROM resp JOIN {items} i USING (item_id), {shares} c) GROUP BY 1, 2""",
        f"post{tag}": f"""SELECT user_id, class, exp(l - m) / sum(exp(l - m)) OVER (PARTITION BY user_id) AS p,
            m + ln(sum(exp(l - m)) OVER (PARTITION BY user_id)) AS ll
            FROM (SELECT *, max(l) OVER (PARTITION BY user_id) AS m FROM lik{tag})""",
        f"side{tag}": f"""SELECT item_id, any_value(mask) AS mask,
            coalesce(sum(p) FILTER (able AND answer = 1), 0) AS r1, coalesce(sum(p) FILTER (able AND answer = 0), 0) AS w1,
            coalesce(sum(p) FILTER (NOT able AND answer = 1), 0) AS r0, coalesce(sum(p) FILTER (NOT able AND answer = 0), 0) AS w0
            FROM (SELECT item_id, mask, answer, p, (class & mask) = mask AS able FROM resp JOIN {items} USING (item_id) JOIN post{tag} USING (user_id))
            GROUP BY item_id""",
        f"items{tag}": f"""SELECT item_id, mask, 1 - least(greatest(CASE WHEN u > v THEN {pooled} ELSE v END, {low}), {high}) AS slip,
            least(greatest(CASE WHEN u > v THEN {pooled} ELSE u END, {low}), {high}) AS guess
            FROM (SELECT *, {rate('r1', 'w1')} AS v, {rate('r0', 'w0')} AS u FROM side{tag})""",
        f"shares{tag}": f"SELECT class, sum(p) / (SELECT count(DISTINCT user_id) FROM resp) AS share FROM post{tag} GROUP BY class"}


DINA = {
    "items_": f"""SELECT DISTINCT item_id, {MASK} AS mask, CAST({diagnosis.START} AS DOUBLE) AS slip, CAST({diagnosis.START} AS DOUBLE) AS guess FROM resp""",
    "shares_": "SELECT class, CAST(1 AS DOUBLE) / 16 AS share FROM range(16) t(class)"}


@query("dina_three_rounds", with_views("resp", f"SELECT item_id, mask, {r('slip', 'slip')}, {r('guess', 'guess')} FROM items2", {
    **DINA, **_round("items_", "shares_", "0"), **_round("items0", "shares0", "1"), **_round("items1", "shares1", "2")}))
def dina_three_rounds(spark, sf_dir):
    answers = views.answers(spark, sf_dir)
    items, _, _ = diagnosis.fit_dina(answers, brand_skills(answers), fixed_rounds=3)
    return items.select("item_id", "mask", "slip", "guess")


@query("fit_dina")
def fit_dina(spark, sf_dir):
    answers = cut_lineage(views.answers(spark, sf_dir), "answers")
    items, shares, info = diagnosis.fit_dina(answers, brand_skills(answers))
    done = F.lit(info["converged"]).alias("converged")
    return items.select(F.col("item_id").alias("key"), F.col("slip").alias("first"), F.col("guess").alias("second"), done).unionByName(
        shares.select(F.concat(F.lit("class "), F.col("class").cast("string")).alias("key"), F.col("share").alias("first"),
                      F.lit(None).cast("double").alias("second"), done))


def _bank(answers):
    """Slip and guess made from the item's share of right answers."""
    mask = F.substring("item_id", 7, 10).cast("int") % 15 + 1
    rate = F.avg(F.col("answer").cast("double"))
    return answers.groupBy("item_id").agg((0.1 + 0.2 * (1 - rate)).alias("slip"), (0.05 + 0.3 * rate).alias("guess")).withColumn("mask", mask)


BANK = {"bank": f"""SELECT item_id, {MASK} AS mask, CAST(0.1 AS DOUBLE) + CAST(0.2 AS DOUBLE) * (1 - avg(answer)) AS slip,
    CAST(0.05 AS DOUBLE) + CAST(0.3 AS DOUBLE) * avg(answer) AS guess FROM resp GROUP BY item_id""", "even": DINA["shares_"]}


@query("dina_classify", with_views("resp", f"""SELECT user_id, CAST(arg_min(class, (-round(p, 9), class)) AS INT) AS map_class, {r('max(p)', 'map_share')},
    {", ".join(r(f"sum(CASE WHEN (class >> {k}) & 1 = 1 THEN p ELSE 0 END)", f"s{k}") for k in range(4))}, {r('any_value(ll)', 'loglik')}
    FROM post0 GROUP BY user_id""", {**BANK, **_round("bank", "even", "0")}))
def dina_classify(spark, sf_dir):
    answers = views.answers(spark, sf_dir)
    shares = spark.range(16).select(F.col("id").cast("int").alias("class"), F.lit(1 / 16).alias("share"))
    found = diagnosis.dina_classify(answers, _bank(answers), shares, 4)
    return found.select("user_id", "map_class", "map_share", *[F.col("eap")[k].alias(f"s{k}") for k in range(4)], "loglik")


# ---- learning factors

def two_skills(answers):
    """Every item asks for its skill and for one of four others, by its number."""
    place = F.split("item_id", ",")
    return answers.select("item_id").distinct().select("item_id", F.explode(F.array(
        place[0], F.concat(F.lit("m"), (place[1].cast("int") % QUARTERS).cast("string")))).alias("skill"))


TWO = {"q": f"""SELECT DISTINCT item_id, unnest([split_part(item_id, ',', 1), 'm' || (CAST(split_part(item_id, ',', 2) AS INT) % {QUARTERS})]) AS factor FROM kt"""}


def practised(spark, sf_dir):
    answers = cut_lineage(log(spark, sf_dir), "log")
    return factors.opportunities(answers, two_skills(answers), ORDER).withColumn("row_id", F.col("event_id"))


@query("opportunity_counts", with_views("kt", """SELECT event_id, factor, count(*) OVER w AS n_before,
    CAST(coalesce(sum(answer) OVER w, 0) AS BIGINT) AS right_before, CAST(coalesce(sum(1 - answer) OVER w, 0) AS BIGINT) AS wrong_before
    FROM kt JOIN q USING (item_id) WINDOW w AS (PARTITION BY user_id, factor ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", TWO))
def opportunity_counts(spark, sf_dir):
    return practised(spark, sf_dir).select("event_id", "factor", "n_before", "right_before", "wrong_before")


def _factors(spark, sf_dir, conjunctive):
    found, users, info = factors.fit_factors(practised(spark, sf_dir), conjunctive)
    done = F.lit(info["converged"]).alias("converged")
    return found.select(F.col("skill").alias("key"), "easiness", "rate", done).unionByName(users.select(
        F.col("user_id").cast("string").alias("key"), F.col("theta").alias("easiness"), F.lit(None).cast("double").alias("rate"), done))


@query("fit_additive_factors")
def fit_additive_factors(spark, sf_dir):
    return _factors(spark, sf_dir, False)


@query("fit_conjunctive_factors")
def fit_conjunctive_factors(spark, sf_dir):
    return _factors(spark, sf_dir, True)


# ---- skill maps

REACHED = """SELECT skill, needs, CAST(1 AS BIGINT) AS steps FROM edges UNION
    SELECT p.skill, e.needs, p.steps + 1 FROM paths p JOIN edges e ON p.needs = e.skill WHERE p.steps < {most}"""


@query("prerequisite_closure", with_views("", "SELECT skill, needs, min(steps) AS steps FROM paths GROUP BY skill, needs", {
    "edges": """SELECT p_partkey AS skill, p_partkey // 2 AS needs FROM part WHERE p_partkey >= 2
        UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey >= 3 AND p_size % 4 = 0""",
    "paths": REACHED.format(most=60)}, True))
def prerequisite_closure(spark, sf_dir):
    part, key = views.table(spark, sf_dir, "part"), F.col("p_partkey")
    halves = part.filter(key >= 2).select(key.alias("skill"), F.floor(key / 2).cast("long").alias("needs"))
    thirds = part.filter((key >= 3) & (F.col("p_size") % 4 == 0)).select(key.alias("skill"), F.floor(key / 3).cast("long").alias("needs"))
    return skills.closure(halves.union(thirds))


@query("prerequisite_cycles", with_views("", """, least_steps AS (SELECT skill, needs, min(steps) AS steps FROM paths GROUP BY 1, 2)
    SELECT a.skill, any_value(a.steps) AS steps, min(b.needs) AS cycle FROM least_steps a JOIN least_steps b ON a.skill = b.skill
    JOIN least_steps c ON c.skill = b.needs AND c.needs = b.skill WHERE a.skill = a.needs GROUP BY a.skill""", {
    "edges": "SELECT DISTINCT p_partkey AS skill, (p_partkey * 2) % 97 AS needs FROM part", "paths": REACHED.format(most=200)}, True))
def prerequisite_cycles(spark, sf_dir):
    part = views.table(spark, sf_dir, "part")
    return skills.cycles(cut_lineage(skills.closure(part.select(F.col("p_partkey").alias("skill"), (F.col("p_partkey") * 2 % 97).alias("needs"))), "closure"))


def _map(answers):
    """The four skills with their bits, and what each needs: s1 needs s0, s2 and s3 need s1."""
    known = brand_skills(answers).select("skill").distinct()
    bit = F.substring("skill", 2, 1).cast("int")
    needs = known.filter(bit > 0).select("skill", F.concat(F.lit("s"), F.floor(bit / 2).cast("string")).alias("needs"))
    return known.select("skill", bit.alias("bit")), needs


STATES = {
    "used": f"SELECT DISTINCT k FROM resp, range(4) t(k) WHERE ({MASK} >> k) & 1 = 1",
    "states": """SELECT s AS state FROM range(16) t(s) WHERE NOT EXISTS (SELECT 1 FROM used WHERE k > 0 AND (s >> k) & 1 = 1 AND (s >> (k // 2)) & 1 = 0)
        AND NOT EXISTS (SELECT 1 FROM range(4) b(k) WHERE (s >> k) & 1 = 1 AND k NOT IN (SELECT k FROM used))"""}


def _states(answers):
    known, needs = _map(answers)
    return skills.knowledge_states(known, skills.closure(needs))


@query("knowledge_states", with_views("resp", "SELECT state, CAST(bit_count(state) AS INT) AS size FROM states", STATES))
def knowledge_states(spark, sf_dir):
    return _states(views.answers(spark, sf_dir))


EXPECTED = {**STATES, "expected": f"""SELECT state, item_id, CASE WHEN (state & mask) = mask THEN 1 ELSE 0 END AS expected
    FROM states, (SELECT DISTINCT item_id, {MASK} AS mask FROM resp)"""}


def _expected(answers):
    masks, _ = diagnosis.skill_masks(brand_skills(answers))
    return skills.expected_patterns(_states(answers), masks)


@query("expected_patterns", with_views("resp", "SELECT * FROM expected", EXPECTED))
def expected_patterns(spark, sf_dir):
    return _expected(views.answers(spark, sf_dir))


@query("match_patterns", with_views("resp", f"""SELECT user_id, state, {r('l', 'loglik')}, n_slips, n_guesses FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(l, 9) DESC, state) AS place FROM (
    SELECT user_id, state, sum(ln(CASE WHEN answer = 1 THEN p ELSE 1 - p END)) AS l, count(*) FILTER (expected = 1 AND answer = 0) AS n_slips,
    count(*) FILTER (expected = 0 AND answer = 1) AS n_guesses FROM (SELECT user_id, state, answer, expected,
    CASE WHEN expected = 1 THEN 1 - slip ELSE guess END AS p FROM resp JOIN expected USING (item_id) JOIN bank USING (item_id)) GROUP BY 1, 2))
    WHERE place = 1""", {**EXPECTED, **BANK}))
def match_patterns(spark, sf_dir):
    answers = cut_lineage(views.answers(spark, sf_dir), "answers")
    return skills.match_patterns(answers, _expected(answers), _bank(answers))


# ---- stream

@query("stream_mastery", traced(f"""SELECT trace AS skill, grp AS user_id, n AS n_obs, {r('f0', 'state0')}, {r('f1', 'state1')},
    {r("(" + STD.arrive(1, lambda i: f"f{i}") + f") * {STD.right(1)} + (" + STD.arrive(0, lambda i: f"f{i}") + f") * {STD.right(0)}", "prob")}
    FROM fwd WHERE t = n""", STD.forward()))
def stream_mastery(spark, sf_dir):
    """The events in four slices of time, one a micro-batch, and an answer a day later that moves the watermark on."""
    rows = log(spark, sf_dir).select("skill", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "answer")
    base = scratch_path(spark, "stream")
    ends = rows.agg(F.percentile_approx(F.unix_micros("ts"), [0.25, 0.5, 0.75], 1000).alias("c"), F.max("ts").alias("last")).first()
    after = spark.createDataFrame([("", None, ends["last"] + datetime.timedelta(days=1), -1, 0)], rows.schema).fillna(-1, ["user_id"])
    place, cuts = F.unix_micros("ts"), ends["c"]
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = rows.filter((F.lit(True) if low is None else place > low) & (F.lit(True) if high is None else place <= high))
        part.coalesce(1).write.mode("append").parquet(f"{base}/in")
    after.coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    mastery.start_mastery(spark, mastery.mastery_stream(stream), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    found = mastery.latest(spark.read.parquet(f"{base}/out"))
    return found.select("skill", "user_id", "n_obs", F.col("state")[0].alias("state0"), F.col("state")[1].alias("state1"), "prob")
