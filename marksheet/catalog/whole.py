"""Queries that run a whole analysis."""
from __future__ import annotations

from marksheet.catalog.registry import query, r, with_views
from marksheet.catalog.tracing import STD, log, numbered
from marksheet.plans import workflows as wf
from marksheet.sources import views

NEXT = " + ".join(f"{STD.arrive(j, lambda i: f'f{i}')} * {STD.right(j)}" for j in STD.S)


@query("kt_standard_eval", with_views("train test", f"""SELECT event_id, skill, user_id, answer, {r('p', 'prob')},
    CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS pred_label, (p > 0.5) = (answer = 1) AS pred_result
    FROM test LEFT JOIN (SELECT trace, grp, {NEXT} AS p FROM fwd WHERE t = n) ON skill = trace AND user_id = grp""",
                                      {**numbered("train"), **STD.forward()}, True))
def kt_standard_eval(spark, sf_dir):
    train, test = wf.split_log(log(spark, sf_dir))
    return wf.kt_standard_eval(train, test).select(
        "event_id", "skill", "user_id", "answer", "prob", "pred_label", "pred_result")


@query("kt_challenge")
def kt_challenge(spark, sf_dir):
    return wf.kt_challenge(log(spark, sf_dir))


@query("kt_compare")
def kt_compare(spark, sf_dir):
    rows = log(spark, sf_dir)
    return wf.kt_compare({"even": rows.filter("user_id % 2 = 0"), "odd": rows.filter("user_id % 2 = 1")})


@query("irt_train_eval")
def irt_train_eval(spark, sf_dir):
    return wf.irt_train_eval(views.answers(spark, sf_dir), ["item_id", "user_id"])
