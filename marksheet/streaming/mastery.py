"""Mastery over a live stream of answers: the filter of ``tracing.forward``, kept as keyed state.

Every (skill, learner) holds one state distribution, its number of answers and those that wait.  Some thousand
of them share a bucket, whose state is read and written as a whole: a call to the state store costs more than many
answers.  An answer
waits until the watermark has passed it, so answers are filtered in the order of their time even if they come
out of order within the allowed delay; then a timer applies what is due and the new state goes out.  Answers that
come later than the delay are dropped by the watermark, and ``late_answers`` counts them.
"""
from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from marksheet.functions import hmm
from marksheet.operators.tracing import STANDARD, TracingConfig, with_models

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MODEL = "pi array<double>, A array<array<double>>, B array<array<double>>"
ORDER_FIELDS = ("ts", "event_id")
BUCKETS = 1024
KEY = ["skill", "user_id"]


def updated(state: np.ndarray | None, answer: int, pi, A, B) -> np.ndarray:
    """State distribution after one more answer; None before the first."""
    predicted = np.asarray(pi) if state is None else state @ np.asarray(A)
    weight = predicted * np.asarray(B)[:, answer]
    return weight / max(weight.sum(), hmm.TINY)


class Mastery(StatefulProcessor):
    """State of one (skill, learner)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", f"state array<double>, n long, {MODEL}")
        self.waiting = handle.getListState("waiting", "ts long, event_id long, answer int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            if not self.now.exists():
                first = frame.iloc[0]
                self.now.update((None, 0, _plain(first["pi"]), _plain(first["A"]), _plain(first["B"])))
            # Microseconds order the answers; timers go by whole milliseconds, rounded up.
            ticks = frame["ts"].astype("datetime64[us]").astype("int64")
            self.waiting.appendList([(int(t), int(e), int(a)) for t, e, a in zip(ticks, frame["event_id"], frame["answer"])])
            self._wake(int(ticks.min()))
        return iter(())

    def _wake(self, tick: int) -> None:
        """A timer for the first answer that waits; those behind it get theirs when it expires."""
        self.handle.registerTimer(-(-tick // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get())
        due = [r for r in rows if r[0] <= until]
        if not due:
            return
        state, n, pi, A, B = self.now.get()
        state = None if state is None else np.array(state)
        for _, _, answer in due:
            state, n = updated(state, answer, pi, A, B), n + 1
        self.now.update((state.tolist(), n, _plain(pi), _plain(A), _plain(B)))
        if len(due) < len(rows):
            self.waiting.put([tuple(r) for r in rows[len(due):]])
            self._wake(rows[len(due)][0])
        else:
            self.waiting.clear()
        after = state @ np.array(A)
        yield pd.DataFrame({"skill": [key[0]], "user_id": [key[1]], "ts": [pd.Timestamp(due[-1][0], unit="us")], "n_obs": [n],
                            "state": [state.tolist()], "prob": [float(after @ np.array(B)[:, 1])]})

    def close(self) -> None:
        pass


def _plain(value):
    """Lists all the way down."""
    return [_plain(v) for v in value] if hasattr(value, "__len__") else float(value)


def _bytes(frame: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _frame(held: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(held).read_all().to_pandas()


def filtered(due: pd.DataFrame, state: np.ndarray, n: np.ndarray, pi, A, B) -> tuple[np.ndarray, np.ndarray]:
    """States and numbers of answers of keys 0, 1, ... after the answers of ``due`` (at: the key), which lie in order of key and time."""
    at, answer = due["at"].to_numpy(), due["answer"].to_numpy()
    place = np.arange(len(at)) - np.searchsorted(at, at)
    turns = np.argsort(place, kind="stable")
    ends = np.cumsum(np.bincount(place))
    state, n = state.copy(), n.copy()
    for k, end in enumerate(ends):      # the next answer of every key that has one
        rows = turns[ends[k - 1] if k else 0:end]
        own = at[rows]
        weight = np.where((n[own] == 0)[:, None], pi, state[own] @ A) * B.T[answer[rows]]
        state[own] = weight / np.maximum(weight.sum(1, keepdims=True), hmm.TINY)
        n[own] += 1
    return state, n


class Masteries(Mastery):
    """States of all (skill, learner) of a bucket; see ``Mastery`` for the order in which answers count."""

    def __init__(self, start: str):
        self.start = start      # model of answers that bring none

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "held binary")
        self.waiting = handle.getListState("waiting", "held binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        frame = pd.concat(frames, ignore_index=True) if len(frames) > 1 else frames[0]
        self.waiting.appendValue((_bytes(frame[[*KEY, "tick", "event_id", "answer", "model"]]),))
        self._wake(int(frame["tick"].min()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        rows = pd.concat([_frame(held) for held, in self.waiting.get()] or [pd.DataFrame({"tick": []})], ignore_index=True)
        is_due = rows["tick"] <= until
        if not is_due.any():
            return
        now = _frame(self.now.get()[0]) if self.now.exists() else rows[[*KEY, "model"]].iloc[:0].assign(n=0, state=None)
        both = pd.concat([now[[*KEY, "model"]], rows[[*KEY, "model"]]], ignore_index=True)
        number = both.groupby(KEY, sort=False).ngroup().to_numpy()
        keys = both[~both.duplicated(KEY)].reset_index(drop=True)        # a key keeps the model that it had first
        rows["at"] = number[len(now):]
        due = rows[is_due].sort_values(["at", "tick", "event_id", "answer"], ignore_index=True)
        n = np.zeros(len(keys), int)
        n[:len(now)] = now["n"]
        state, prob = np.empty(len(keys), object), np.zeros(len(keys))
        state[:len(now)] = [*now["state"]]
        model_of = keys["model"].to_numpy()[due["at"].to_numpy()]
        for model in pd.unique(model_of):
            pi, A, B = (np.array(json.loads(model or self.start)[k], float) for k in ("pi", "A", "B"))
            own = due[model_of == model]
            here, at = np.unique(own["at"].to_numpy(), return_inverse=True)
            before = np.array([pi if n[k] == 0 else state[k] for k in here])
            after, n[here] = filtered(own.assign(at=at), before, n[here], pi, A, B)
            state[here] = [*after]
            prob[here] = (after @ A) @ B[:, 1]
        known = n > 0
        self.now.update((_bytes(keys[known].assign(n=n[known], state=[s.tolist() for s in state[known]])),))
        left = rows[~is_due]
        if len(left):
            self.waiting.put([(_bytes(left.drop(columns="at")),)])
            self._wake(int(left["tick"].min()))
        else:
            self.waiting.clear()
        last = due.drop_duplicates("at", keep="last")
        at = last["at"].to_numpy()
        yield pd.DataFrame({"skill": keys["skill"].to_numpy()[at], "user_id": keys["user_id"].to_numpy()[at], "tick": last["tick"].to_numpy(), "n_obs": n[at],
                            "state": [s.tolist() for s in state[at]], "prob": prob[at]})


def mastery_stream(answers: DataFrame, models: DataFrame | None = None, config: TracingConfig = STANDARD, delay: str = "0 seconds") -> DataFrame:
    """States of every learner and skill as answers arrive: skill, user_id, ts, n_obs, state, prob (of a right next answer).

    ``answers`` is a stream of skill, user_id, ts, event_id, answer (rows with a null among these are left out);
    ``models`` a static table of (trace, pi, A, B) by skill, else every skill has the start values.  A row goes out whenever the watermark
    passes answers of a key, one for all that it passes, which count in time order and equal times by event_id.  Needs the RocksDB state store.
    """
    rows = answers.select("skill", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("answer").cast("int").alias("answer")) \
        .dropna().withWatermark("ts", delay).withColumn("trace", F.col("skill"))
    start = json.dumps({"pi": _plain(config.pi), "A": _plain(config.A), "B": None if config.B is None else _plain(config.B)})
    model = F.lit("") if models is None else F.to_json(F.struct("pi", "A", "B"))
    bucket = F.pmod(F.xxhash64("skill", "user_id"), F.lit(BUCKETS)).cast("int")
    modelled = with_models(rows, models, config).select("skill", "user_id", "ts", F.unix_micros("ts").alias("tick"), "event_id", "answer", model.alias("model"), bucket.alias("bucket"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"skill {kinds['skill']}, user_id {kinds['user_id']}, tick long, n_obs long, state array<double>, prob double"
    return modelled.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=Masteries(start), outputStructType=schema, outputMode="Append", timeMode="EventTime").select(
        "skill", "user_id", F.timestamp_micros("tick").alias("ts"), "n_obs", "state", "prob")


def start_mastery(spark: SparkSession, updates: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write all that has landed to ``path`` and stop; a later start with the same checkpoint goes on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return (updates.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def late_answers(query: StreamingQuery) -> int:
    """How many answers the watermark has dropped."""
    return sum(op.numRowsDroppedByWatermark for progress in query.recentProgress for op in progress.stateOperators)


def latest(updates: DataFrame) -> DataFrame:
    """The last state of every learner and skill."""
    newest = F.max_by(F.struct("ts", "n_obs", "state", "prob"), F.col("n_obs")).alias("s")
    return updates.groupBy("skill", "user_id").agg(newest).select("skill", "user_id", "s.*")
