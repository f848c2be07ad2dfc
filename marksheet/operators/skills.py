"""Jobs on skill maps: prerequisite closure, knowledge states, expected patterns and their match."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marksheet.operators.scoring import answered
from marksheet.plans.lineage import RoundTable, cut_lineage

MOST_STATES = 4096
MOST_ROUNDS = 40        # of doubling: paths of up to 2 ** 40 steps


def closure(edges: DataFrame) -> DataFrame:
    """All pairs (skill, needs, steps) of which the second is reached from the first; ``steps`` is the shortest way.

    ``edges`` holds skill and needs (null: no edge).  Paths double, so a chain of n skills takes about log2(n)
    rounds: with all shortest ways of up to k steps known, one of up to 2 k goes k steps to some middle and k at
    most from there, so only pairs exactly k steps apart are joined, and with what their middles reach.  What is
    found is new unless it was known, and its steps are final.  A skill on a cycle reaches itself, which
    ``cycles`` reports.
    """
    state = RoundTable(edges.sparkSession, "closure")
    known = state.put(edges.filter("skill is not null and needs is not null").select("skill", "needs").distinct()
                      .withColumn("steps", F.lit(1).cast("long")))
    for k in range(MOST_ROUNDS):
        far = known.filter(F.col("steps") == 1 << k)
        if far.isEmpty():
            return known
        left = far.select("skill", F.col("needs").alias("middle"))
        # Of the known pairs only those of a middle are shuffled by it: where many skills need few, these are few.
        right = known.withColumnRenamed("skill", "middle").join(left.select("middle").distinct(), "middle", "left_semi").withColumnRenamed("steps", "more")
        found = left.join(right, "middle").select("skill", "needs", (F.col("more") + F.lit(1 << k)).alias("steps"))
        known = state.put(known.unionByName(found).groupBy("skill", "needs").agg(F.min("steps").alias("steps")))
    raise ValueError(f"paths of more than 2 ** {MOST_ROUNDS} steps")


def cycles(closed: DataFrame) -> DataFrame:
    """Skills that need themselves: skill, steps of the shortest cycle, and the smallest skill on a common cycle.

    Both skills of a common cycle need themselves, so only pairs of such skills are turned round and compared.
    """
    on = closed.filter("skill = needs").select("skill", "steps")
    own = on.select("skill")
    pairs = closed.select("skill", "needs").join(own, "skill", "left_semi").join(own.withColumnRenamed("skill", "needs"), "needs", "left_semi")
    back = pairs.select(F.col("needs").alias("skill"), F.col("skill").alias("needs"))
    both = pairs.select("skill", "needs").join(back, ["skill", "needs"], "left_semi").groupBy("skill").agg(F.min("needs").alias("cycle"))
    return on.join(both, "skill").select("skill", "steps", "cycle")


def knowledge_states(skills: DataFrame, closed: DataFrame) -> DataFrame:
    """All sets of skills that hold the prerequisites of every member, as bits: state, size.

    ``skills`` numbers the skills in a 0-based ``bit`` (62 at most).  Bits are first put into an order in
    which prerequisites come before, then every state grows only by skills behind its last one, so each
    set is made once and nothing is deduplicated; a level adds one skill to all states of the level before.
    """
    rows = {r.skill: r.bit for r in skills.select("skill", "bit").collect()}
    if len(rows) > 62:
        raise ValueError("more than 62 skills")
    needs = {s: set() for s in rows}
    for r in closed.select("skill", "needs").collect():     # 62 * 62 pairs at most
        if r.skill in rows and r.needs in rows:
            needs[r.skill].add(r.needs)
    if any(s in n for s, n in needs.items()):
        raise ValueError("prerequisites form a cycle")
    order = sorted(rows, key=lambda s: (len(needs[s]), rows[s]))    # closed sets: fewer prerequisites come first
    spark = skills.sparkSession
    steps = spark.createDataFrame([(k, 1 << rows[s], sum(1 << rows[x] for x in needs[s])) for k, s in enumerate(order)],
                                  "place int, own long, mask long")
    steps = F.broadcast(steps)      # a row for each skill
    level = spark.createDataFrame([(0, 0, -1)], "state long, size int, last int")
    found = []
    for _ in range(len(order) + 1):
        level = cut_lineage(level, "level")
        found.append(level.select("state", "size"))
        grown = level.join(steps, (F.col("place") > F.col("last")) & (F.col("state").bitwiseAND(F.col("mask")) == F.col("mask")))
        level = grown.select(F.col("state").bitwiseOR(F.col("own")).alias("state"), (F.col("size") + 1).alias("size"), F.col("place").alias("last"))
        if level.isEmpty():
            break
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    return whole


def expected_patterns(states: DataFrame, masks: DataFrame) -> DataFrame:
    """state, item_id, expected: right exactly if the state holds all skills of the item's ``mask``.

    Every item is written out for every state, which are ``MOST_STATES`` at most.
    """
    values = sorted(r.state for r in states.select("state").distinct().limit(MOST_STATES + 1).collect())
    if len(values) > MOST_STATES:
        raise ValueError(f"more than {MOST_STATES} states")
    each = F.explode(F.array(*[F.lit(v).cast("long") for v in values]) if values else F.expr("CAST(array() AS array<bigint>)"))
    able = F.col("state").bitwiseAND(F.col("mask").cast("long")) == F.col("mask").cast("long")
    return masks.select("item_id", "mask", each.alias("state")).select("state", "item_id", F.when(able, 1).otherwise(0).alias("expected"))


def match_patterns(responses: DataFrame, expected: DataFrame, curves: DataFrame) -> DataFrame:
    """The expected pattern that explains a learner's answers best: user_id, state, loglik, n_slips, n_guesses.

    Answers that differ are slips (expected right) or guesses (expected wrong).  ``curves`` gives every item a
    ``slip`` and a ``guess``.  Only answered items count.  Of equally likely states the one with the smallest
    number wins.  Learners meet states on their items, as sums per (learner, state) of combinable parts.
    """
    scored = expected.join(curves.select("item_id", "slip", "guess"), "item_id")
    right = F.when(F.col("expected") == 1, 1 - F.col("slip")).otherwise(F.col("guess"))
    logs = scored.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct(
        F.col("state"), F.struct(F.col("expected").alias("e"), F.log(right).alias("r"), F.log(1 - right).alias("w"))))).alias("_by"))
    joined = answered(responses).select("user_id", "item_id", "answer").join(logs, "item_id").select(
        "user_id", "answer", F.explode("_by").alias("state", "_v"))
    sums = joined.groupBy("user_id", "state").agg(
        F.sum(F.when(F.col("answer") == 1, F.col("_v.r")).otherwise(F.col("_v.w"))).alias("loglik"),
        F.sum(F.when((F.col("_v.e") == 1) & (F.col("answer") == 0), 1).otherwise(0)).alias("n_slips"),
        F.sum(F.when((F.col("_v.e") == 0) & (F.col("answer") == 1), 1).otherwise(0)).alias("n_guesses"))
    best = F.max_by(F.struct("state", "loglik", "n_slips", "n_guesses"), F.struct(F.round("loglik", 9), (-F.col("state"))))
    return sums.groupBy("user_id").agg(best.alias("_b")).select("user_id", "_b.state", "_b.loglik", "_b.n_slips", "_b.n_guesses")
