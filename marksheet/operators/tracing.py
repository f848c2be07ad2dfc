"""Knowledge tracing with given parameters: filtering, prediction, smoothing, decoding.

State 0 is "not mastered" and 1 "mastered" (or levels 0..6); an answer is 0 or 1.  Filtering and
prediction are folds inside the JVM.  Smoothing and decoding need every step's state and run as
Arrow batches.  Sequences cut into pieces are chained: each piece is reduced to a small matrix, the
matrices are combined up and down a tree, and every piece then starts from the right state.
"""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marksheet.functions import hmm
from marksheet.functions.logistic import doubles, sigmoid, total
from marksheet.operators.sequences import build_sequences, is_split
from marksheet.plans.lineage import cut_lineage
from marksheet.plans.scan import attach, tree_scan
from marksheet.plans.skew import skew_join

KEYS = ["trace", "grp"]
DOUBLES = T.ArrayType(T.DoubleType())
MATRIX = T.ArrayType(DOUBLES)


@dataclass(frozen=True)
class TracingConfig:
    """Start values, bounds and stop rule of a tracing model."""
    pi: list = field(default_factory=list)
    A: list = field(default_factory=list)
    B: list | None = None            # None: answers depend on level and item difficulty
    pi_low: list | None = None
    pi_high: list | None = None
    A_low: list | None = None
    A_high: list | None = None
    B_low: list | None = None
    B_high: list | None = None
    max_iter: int = 20
    tol: float = 1e-2
    tol_mode: str = "per_sequence"   # or "total"
    minimum_obs: int = 3
    offset_train: float = 0.2
    offset_predict: float = 0.5

    def __post_init__(self):
        for rows in ([self.pi], self.A, self.B or []):
            if any(abs(sum(row) - 1) > hmm.ROW_SUM_TOLERANCE for row in rows):
                raise ValueError("probability rows must sum to 1")
        if len(self.A) != self.states or any(len(row) != self.states for row in self.A):
            raise ValueError("A must be square with one row per state")
        if self.B is not None and (len(self.B) != self.states or any(len(row) != 2 for row in self.B)):
            raise ValueError("B must have one row per state and two columns")
        if self.tol_mode not in ("per_sequence", "total"):
            raise ValueError(f"unknown tol_mode {self.tol_mode!r}")

    @property
    def states(self) -> int:
        return len(self.pi)

    @property
    def leveled(self) -> bool:
        return self.B is None

    def bounds(self) -> dict[str, np.ndarray]:
        S = self.states
        default = {"pi_low": np.zeros(S), "pi_high": np.ones(S), "A_low": np.zeros((S, S)),
                   "A_high": np.ones((S, S)), "B_low": np.zeros((S, 2)), "B_high": np.ones((S, 2))}
        return {k: v if getattr(self, k) is None else np.array(getattr(self, k), float)
                for k, v in default.items()}


# The standard two-state model.
STANDARD = TracingConfig(
    pi=[0.5, 0.5],
    A=[[0.4, 0.6], [0.0, 1.0]],
    B=[[0.8, 0.2], [0.2, 0.8]],
    A_low=[[0, 0], [0, 1]],
    A_high=[[1, 1], [0, 1]],
    B_low=[[0.7, 0], [0, 0.7]],
    B_high=[[1, 0.3], [0.3, 1]],
)


def level_config(levels: int = 7) -> TracingConfig:
    """Levels start uniform, stay or rise by one with equal chance, and never fall."""
    grid = range(levels)
    start = [[1.0 if i == j == levels - 1 else 0.5 if j in (i, i + 1) else 0.0 for j in grid] for i in grid]
    high = [[1.0 if i == j else 0.5 if j > i else 0.0 for j in grid] for i in grid]
    return TracingConfig(pi=[1.0 / levels] * levels, A=start, A_high=high)


LEVELS = level_config()


def matrix(rows) -> Column:
    return F.array(*[doubles(row) for row in rows])


def config_models(seqs: DataFrame, config: TracingConfig = STANDARD) -> DataFrame:
    """A model table that gives every trace the start values."""
    return with_models(seqs.select("trace").distinct(), None, config)


def with_models(seqs: DataFrame, models: DataFrame | None, config: TracingConfig) -> DataFrame:
    """Sequences with their trace's pi, A, B (no join when all traces share the start values)."""
    if models is None:
        B = F.lit(None).cast(MATRIX) if config.B is None else matrix(config.B)
        return (seqs.withColumn("pi", doubles(config.pi)).withColumn("A", matrix(config.A))
                .withColumn("B", B))
    return skew_join(seqs, models.select("trace", "pi", "A", "B"), ["trace"], "inner")


def right_chance(i: int, config: TracingConfig, difficulty: Column | None, offset: float) -> Column:
    """P(right | state i)."""
    if config.leveled:
        return sigmoid(F.lit(i + offset) - difficulty)
    return F.col("B")[i][1]


def _emission(i: int, x: Column, config: TracingConfig, offset: float) -> Column:
    if config.leveled:
        right = right_chance(i, config, x["difficulty"], offset)
        return F.when(x["obs"] == 1, right).otherwise(1 - right)
    return F.when(x["obs"] == 1, F.col("B")[i][1]).otherwise(F.col("B")[i][0])


def fold_forward(config: TracingConfig, offset: float) -> Column:
    """Scaled forward pass over ``seq`` as one struct: state, next, loglik."""
    S = range(config.states)

    def step(acc, x):
        weight = [acc["next"][i] * _emission(i, x, config, offset) for i in S]
        state = F.array(*weight)
        return F.struct(state.alias("weight"), acc["next"].alias("next"), acc["loglik"].alias("loglik"))

    def close(acc):
        # An answer that no state allows gets the same floor as in functions/hmm.py.
        scale = F.greatest(total([acc["weight"][i] for i in S]), F.lit(hmm.TINY))
        state = [acc["weight"][i] / scale for i in S]
        moved = [total([acc["weight"][i] * F.col("A")[i][j] for i in S]) / scale for j in S]
        return F.struct(F.array(*state).alias("weight"), F.array(*moved).alias("next"),
                        (acc["loglik"] + F.log(scale)).alias("loglik"))

    zero = F.struct(F.col("pi").alias("weight"), F.col("pi").alias("next"), F.lit(0.0).alias("loglik"))
    # close() reads the weights of step() from an array, so no step is evaluated twice.
    folded = F.aggregate("seq", zero, lambda acc, x: _then(step(acc, x), close))
    return F.struct(folded["weight"].alias("state"), folded["next"].alias("next"),
                    folded["loglik"].alias("loglik"))


def _then(value: Column, use) -> Column:
    """Evaluate ``value`` once and pass it to ``use``."""
    return F.transform(F.array(value), use)[0]


def forward(seqs: DataFrame, models: DataFrame | None = None, config: TracingConfig = STANDARD,
            offset: float | None = None) -> DataFrame:
    """Filtered state after the last answer, distribution of the next state, log-likelihood."""
    offset = config.offset_predict if offset is None else offset
    found = with_models(seqs, models, config)
    whole = found.filter("seg is null") if is_split(seqs) else found
    done = whole.select("trace", "grp", F.size("seq").cast("long").alias("n_obs"), "pi", "A", "B",
                        fold_forward(config, offset).alias("_f"))
    done = done.select("trace", "grp", "n_obs", "pi", "A", "B", F.col("_f.state").alias("state"),
                       F.col("_f.next").alias("next"), F.col("_f.loglik").alias("loglik"))
    if not is_split(seqs):
        return done
    pieces = batch_input(found.filter("seg is not null"), config)
    chained = run_batches(chain(pieces, config, offset), ["trace", "grp", "seg", "pi", "A", "B"],
                          _filter_job(config, offset), [("n_obs", T.LongType()), ("state", DOUBLES),
                                                        ("next", DOUBLES), ("loglik", T.DoubleType())])
    joined = chained.groupBy("trace", "grp").agg(
        F.sum("n_obs").alias("n_obs"), *[F.max_by(c, "seg").alias(c) for c in ("pi", "A", "B", "state", "next")],
        F.sum("loglik").alias("loglik"))
    return done.unionByName(joined)


def next_right(config: TracingConfig = STANDARD, difficulty: str | None = None, state: str = "next") -> Column:
    """P(right) for a state distribution: table emission, or by the next item's difficulty."""
    column = F.col(difficulty) if difficulty else None
    return total([F.col(state)[i] * right_chance(i, config, column, config.offset_predict)
                  for i in range(config.states)])


def predict_next(seqs: DataFrame, models: DataFrame | None = None, config: TracingConfig = STANDARD) -> DataFrame:
    """Chance that the answer after each history is right."""
    return forward(seqs, models, config).select("trace", "grp", "n_obs", next_right(config).alias("prob"))


def predict_first(models: DataFrame, config: TracingConfig = STANDARD) -> DataFrame:
    """Chance of a right first answer, per model."""
    return models.select("trace", next_right(config, state="pi").alias("prob"))


def predict_first_item(models: DataFrame, tests: DataFrame, config: TracingConfig = LEVELS) -> DataFrame:
    """Chance of a right first answer on given items: tests hold trace and difficulty."""
    joined = skew_join(tests, models.select("trace", "pi"), ["trace"], "inner")
    return joined.withColumn("prob", next_right(config, "difficulty", "pi")).drop("pi")


def predict_next_item(histories: DataFrame, tests: DataFrame, models: DataFrame | None = None,
                      config: TracingConfig = LEVELS) -> DataFrame:
    """Chance of a right answer on the next item: tests hold trace, grp and difficulty."""
    states = forward(histories, models, config).select("trace", "grp", "next")
    joined = skew_join(tests, states, ["trace", "grp"], "inner")
    return joined.withColumn("prob", next_right(config, "difficulty")).drop("next")


def log_likelihood(seqs: DataFrame, models: DataFrame | None = None,
                   config: TracingConfig = STANDARD) -> DataFrame:
    """Log-likelihood of every sequence."""
    return forward(seqs, models, config).select("trace", "grp", "n_obs", "loglik")


def log_likelihood_by_trace(seqs: DataFrame, models: DataFrame | None = None,
                            config: TracingConfig = STANDARD) -> DataFrame:
    return log_likelihood(seqs, models, config).groupBy("trace").agg(
        F.count(F.lit(1)).alias("n_seq"), F.sum("loglik").alias("loglik"))


# ---- Arrow batches --------------------------------------------------------------------------

def batch_input(found: DataFrame, config: TracingConfig) -> DataFrame:
    """Sequences with models, as flat arrays for Arrow: obs, difficulty, prior, later."""
    columns = [c for c in found.columns if c != "seq"]
    difficulty = F.transform("seq", lambda x: x["difficulty"]) if config.leveled else F.lit(None).cast(DOUBLES)
    return found.select(*columns, F.transform("seq", lambda x: x["obs"].cast("int")).alias("obs"),
                        difficulty.alias("difficulty"),
                        F.lit(None).cast(DOUBLES).alias("prior"), F.lit(None).cast(DOUBLES).alias("later"))


class Block:
    """Rows of similar length of one Arrow batch, as padded arrays."""

    def __init__(self, batch, rows, flat_obs, starts, lengths, config, offset):
        S = config.states
        n = len(rows)
        self.lengths = lengths
        self.obs = hmm.pad(flat_obs, starts, lengths)
        taken = batch.take(pa.array(rows))
        self.batch = taken
        self.pi = self.numbers("pi").reshape(n, S)
        self.A = self.numbers("A", 2).reshape(n, S, S)
        if config.leveled:
            flat = self.numbers("difficulty")
            own = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            self.emission = hmm.emission_from_levels(self.obs, hmm.pad(flat, own, lengths), offset, S)
        else:
            self.emission = hmm.emission_from_table(self.numbers("B", 2).reshape(n, S, 2), self.obs)
        self.prior = self._or("prior", self.pi)
        self.continued = np.asarray(taken.column("later").is_valid())
        self.later = self._or("later", np.ones((n, S)))

    def numbers(self, name, depth=1):
        values = self.batch.column(name)
        for _ in range(depth):
            values = values.flatten()
        return values.to_numpy(zero_copy_only=False)

    def _or(self, name, default):
        known = np.asarray(self.batch.column(name).is_valid())
        if not known.any():
            return default
        values = self.numbers(name).reshape(int(known.sum()), -1)
        if known.all():
            return values
        result = default.copy()
        result[known] = values
        return result


def run_batches(table: DataFrame, keep: list[str], job, outputs: list[tuple[str, T.DataType]],
                config: TracingConfig | None = None, offset: float | None = None) -> DataFrame:
    """Append the arrays ``job(block)`` returns to the ``keep`` columns of each row."""
    job_config, job_offset, work = job if isinstance(job, tuple) else (config, offset, job)
    schema = T.StructType([table.schema[c] for c in keep] + [T.StructField(n, t) for n, t in outputs])
    kinds = [t for _, t in outputs]
    names = [*keep, *[n for n, _ in outputs]]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            obs = batch.column("obs")
            ends = obs.offsets.to_numpy()
            lengths = np.diff(ends)
            flat = obs.values.to_numpy(zero_copy_only=False)
            for rows in hmm.blocks(lengths):
                block = Block(batch, rows, flat, ends[:-1][rows], lengths[rows], job_config, job_offset)
                results = work(block)
                arrays = [block.batch.column(c) for c in keep]
                arrays += [_arrow(r, t) for r, t in zip(results, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return table.mapInArrow(run, schema)


def _arrow(values, kind: T.DataType):
    """numpy results as Arrow: scalars, equal-length lists, matrices or (flat, lengths) lists."""
    if isinstance(values, tuple):
        flat, lengths = values
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
        return pa.ListArray.from_arrays(offsets, _arrow(flat, kind.elementType))
    if values.ndim == 1:
        return pa.array(values, {"double": pa.float64(), "bigint": pa.int64(), "int": pa.int32(),
                                 "boolean": pa.bool_()}[kind.simpleString()])
    inner = _arrow(values.reshape(-1, *values.shape[2:]), kind.elementType)
    offsets = pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32())
    return pa.ListArray.from_arrays(offsets, inner)


def _ragged(values: np.ndarray, lengths: np.ndarray):
    live = np.arange(values.shape[1]) < lengths[:, None]
    return values[live], lengths


def chain(pieces: DataFrame, config: TracingConfig, offset: float) -> DataFrame:
    """Fill ``prior`` and ``later`` of the pieces of cut sequences.

    Each piece becomes one states-by-states matrix; these are combined up and down a tree.
    """
    S = config.states

    def reduce_piece(block):
        product, _ = hmm.transfer(block.A, block.emission, block.lengths)
        return [product.reshape(len(product), S * S)]

    def combine(values):
        product = np.eye(S)
        for value in values.reshape(-1, S, S):
            product = product @ value
            product /= max(product.max(), hmm.TINY)
        return product.ravel()

    def spread(values, context):
        """``context``: the state before the first piece, then the likelihood after the last (none at the end)."""
        products = values.reshape(-1, S, S)
        priors, laters = [context[:S]], [context[S:]]
        for product in products[:-1]:
            state = priors[-1] @ product
            priors.append(state / max(state.sum(), hmm.TINY))
        value = context[S:] if len(context) > S else np.ones(S)
        for product in products[:0:-1]:
            value = product @ value
            value = value / max(value.max(), hmm.TINY)
            laters.append(value)
        return [np.concatenate(both) for both in zip(priors, laters[::-1])]

    reduced = run_batches(pieces, [*KEYS, "seg", "pi"], (config, offset, reduce_piece), [("value", DOUBLES)])
    tops = pieces.groupBy(*KEYS).agg(F.first("pi").alias("context"))
    placed = tree_scan(reduced, tops, KEYS, S * S, combine, spread)
    later = F.when(F.size("context") > S, F.slice("context", S + 1, S))
    return attach(pieces.drop("prior", "later"), placed, KEYS).withColumns(
        {"prior": F.slice("context", 1, S), "later": later}).drop("context")


def in_context(found: DataFrame, config: TracingConfig, offset: float) -> DataFrame:
    """Batch input for all rows, with pieces chained where there are any."""
    table = batch_input(found, config)
    if not is_split(found):
        return table.withColumn("seg", F.lit(None).cast("long"))
    whole = table.filter("seg is null")
    return whole.unionByName(chain(table.filter("seg is not null"), config, offset))


def _filter_job(config: TracingConfig, offset: float):
    def work(block):
        filtered, loglik = hmm.forward(block.prior, block.A, block.emission, block.lengths)
        last = filtered[:, -1]
        return [block.lengths.astype(np.int64), last, np.einsum("ni,nij->nj", last, block.A), loglik]
    return config, offset, work


def smooth(seqs: DataFrame, models: DataFrame | None = None, config: TracingConfig = STANDARD,
           offset: float | None = None) -> DataFrame:
    """State posterior of every answer: trace, grp, step, obs, posterior, whether or not sequences are cut."""
    offset = config.offset_predict if offset is None else offset
    table = in_context(with_models(seqs, models, config), config, offset)

    def work(block):
        filtered, _ = hmm.forward(block.prior, block.A, block.emission, block.lengths)
        beta = hmm.backward(block.A, block.emission, block.lengths,
                            hmm.after_row(block.A, block.later, block.continued))
        return [_ragged(hmm.smooth(filtered, beta), block.lengths)]

    found = run_batches(table, ["trace", "grp", "seg", "obs"], (config, offset, work), [("posterior", MATRIX)])
    return answer_rows(found, [], ["obs", "posterior"], is_split(seqs))


def answer_rows(found: DataFrame, keep: list[str], arrays: list[str], split: bool) -> DataFrame:
    """One row per answer: trace, grp, step in the whole sequence, ``keep`` and an element of every array."""
    earlier = Window.partitionBy("trace", "grp").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.size(arrays[0])).over(earlier), F.lit(0)) if split else F.lit(0)
    found = found.withColumn("_before", before)     # on its own: a window beside a generator would see its rows
    return found.select("trace", "grp", *keep, "_before", F.posexplode(F.arrays_zip(*arrays)).alias("step", "_s")) \
        .select("trace", "grp", (F.col("step") + F.col("_before")).cast("long").alias("step"), *keep,
                *[F.col("_s")[name].alias(name) for name in arrays])


def decode_map(seqs: DataFrame, models: DataFrame | None = None, config: TracingConfig = STANDARD) -> DataFrame:
    """Most likely state of every answer taken on its own."""
    best = F.array_position("posterior", F.array_max("posterior")) - 1
    return smooth(seqs, models, config).withColumn("state", best.cast("long"))


def viterbi(seqs: DataFrame, models: DataFrame | None = None, config: TracingConfig = STANDARD) -> DataFrame:
    """Most likely state path, a row per answer whether or not sequences are cut: trace, grp, step, score, state.

    ``score`` is the log score of the whole path.
    """
    found = _paths(seqs, models, config).withColumnRenamed("path", "state")
    return answer_rows(found, ["score"], ["state"], is_split(seqs))


def _paths(seqs: DataFrame, models: DataFrame | None, config: TracingConfig) -> DataFrame:
    """A row per sequence or piece: trace, grp, seg, obs, A, pi, path, score."""
    offset = config.offset_predict
    keep = ["trace", "grp", "seg", "obs", "A", "pi"]
    found = batch_input(with_models(seqs, models, config), config)
    paths = [("path", T.ArrayType(T.LongType())), ("score", T.DoubleType())]
    if not is_split(seqs):
        found = found.withColumn("seg", F.lit(None).cast("long"))
        return run_batches(found, keep, (config, offset, _decode_work), paths)
    whole = run_batches(found.filter("seg is null"), keep, (config, offset, _decode_work), paths)
    pieces = _chain_paths(found.filter("seg is not null"), config, offset)
    return whole.unionByName(run_batches(pieces, keep, (config, offset, _decode_piece_work), paths))


def _log(values):
    with np.errstate(divide="ignore"):
        return np.log(values)


def _decode_work(block):
    score, back = hmm.best_scores(_log(block.pi), _log(block.A), _log(block.emission), block.lengths)
    final = score.argmax(1)
    path = hmm.trace_back(back, final)
    best = np.take_along_axis(score, final[:, None], 1)[:, 0]
    return [_ragged(path, block.lengths), best]


def _decode_piece_work(block):
    _, back = hmm.best_scores(block.prior, _log(block.A), _log(block.emission), block.lengths)
    final = block.later[:, 0].astype(np.int64)
    return [_ragged(hmm.trace_back(back, final), block.lengths), block.later[:, 1]]


def _chain_paths(pieces: DataFrame, config: TracingConfig, offset: float) -> DataFrame:
    """Entry scores (``prior``) and last state with total score (``later``) of every piece.

    Forward, pieces combine by (max, +) matrices; backward, by the map from a piece's last state
    to its first and from there to the last state of the piece before.
    """
    S = config.states
    keys = [*KEYS, "seg"]

    def reduce_piece(block):
        product = hmm.log_transfer(_log(block.A), _log(block.emission), block.lengths)
        return [product.reshape(len(product), S * S)]

    def links(block):
        score, back = hmm.best_scores(block.prior, _log(block.A), _log(block.emission), block.lengths)
        finals = np.broadcast_to(np.arange(S), score.shape)
        firsts = hmm.trace_back(back, finals)[:, :, 0]
        into = (score[:, :, None] + _log(block.A)).argmax(1)
        return [np.concatenate([firsts, into], 1).astype(float), score]

    def combine_entries(values):
        product = values[0].reshape(S, S)
        for value in values[1:].reshape(-1, S, S):
            product = (product[:, :, None] + value).max(1)
        return product.ravel()

    def entries(values, context):
        scores = [context]
        for value in values[:-1].reshape(-1, S, S):
            scores.append((scores[-1][:, None] + value).max(0))
        return scores

    def combine_exits(values):
        """From the last state of the last node to the first state of the first one."""
        parts = values.astype(np.int64).reshape(-1, 2, S)
        state = parts[-1, 0]
        for firsts, into in parts[-2::-1]:
            state = firsts[into[state]]
        return np.concatenate([state, parts[-1, 1]]).astype(float)

    def exits(values, context):
        parts = values.astype(np.int64).reshape(-1, 2, S)
        ends = [context]
        for k in range(len(parts) - 2, -1, -1):
            state = parts[k, 1][parts[k + 1, 0][int(ends[-1][0])]]
            ends.append(np.array([float(state), context[1]]))
        return ends[::-1]

    reduced = run_batches(pieces, [*keys, "pi"], (config, offset, reduce_piece), [("value", DOUBLES)])
    starts = pieces.groupBy(*KEYS).agg(F.transform(F.first("pi"), log_or_never).alias("context"))
    placed = tree_scan(reduced, starts, KEYS, S * S, combine_entries, entries)
    entered = attach(pieces.drop("prior"), placed, KEYS).withColumnRenamed("context", "prior")
    linked = cut_lineage(run_batches(entered, keys, (config, offset, links),
                                     [("value", DOUBLES), ("score", DOUBLES)]), "links")
    best = linked.groupBy(*KEYS).agg(F.max_by("score", "seg").alias("score"))
    last = F.array_position("score", F.array_max("score")) - 1
    tops = best.select(*KEYS, F.array(last.cast("double"), F.array_max("score")).alias("context"))
    ended = tree_scan(linked, tops, KEYS, 2 * S, combine_exits, exits)
    return attach(entered.drop("later"), ended, KEYS).withColumnRenamed("context", "later").select(*pieces.columns)


def log_or_never(p: Column) -> Column:
    """log p, minus infinity for zero."""
    return F.when(p > 0, F.log(p)).otherwise(F.lit(float("-inf")))


def predict_viterbi(seqs: DataFrame, models: DataFrame | None = None,
                    config: TracingConfig = STANDARD) -> DataFrame:
    """Next state = the likeliest move from the last decoded state: trace, grp, next_state, score."""
    decoded = _paths(seqs, models, config)
    last = decoded.groupBy("trace", "grp").agg(
        F.max_by(F.element_at("path", -1), F.coalesce("seg", F.lit(0))).alias("last_state"),
        F.max_by("A", F.coalesce("seg", F.lit(0))).alias("A"), F.max("score").alias("score"))
    row = F.element_at("A", F.col("last_state").cast("int") + 1)
    return last.select("trace", "grp", "last_state",
                       (F.array_position(row, F.array_max(row)) - 1).alias("next_state"),
                       (F.col("score") + F.log(F.array_max(row))).alias("score"))


def predict_viterbi_first(models: DataFrame) -> DataFrame:
    """Without history: the likeliest start state."""
    return models.select("trace", (F.array_position("pi", F.array_max("pi")) - 1).alias("next_state"))


def state_right(config: TracingConfig, difficulty: str | None = None, state: str = "next_state") -> Column:
    """P(right) when the state is known."""
    if config.leveled:
        return sigmoid(F.col(state) + config.offset_predict - F.col(difficulty))
    return F.element_at(F.element_at("B", F.col(state).cast("int") + 1), 2)


def predict_batch(rows: DataFrame, trace_by: list[str], group_by: list[str], sorted_by: list[str],
                  values: dict[str, str], models: DataFrame | None = None, config: TracingConfig = STANDARD,
                  algorithm: str = "posterior") -> DataFrame:
    """Chance that the next answer is right, for every (trace, group) of a log."""
    seqs = build_sequences(rows, trace_by, group_by, sorted_by, values)
    if algorithm == "posterior":
        return predict_next(seqs, models, config).select("trace", "grp", "prob")
    if algorithm != "viterbi":
        raise ValueError(f"unknown algorithm {algorithm!r}")
    found = with_models(predict_viterbi(seqs, models, config), models, config)
    return found.select("trace", "grp", state_right(config).alias("prob"))
