"""Sparse logistic progress model: scoring, buckets, gradient, Adam and distributed training."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - loads pa.compute
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import squares
from ..functions.scores import sigmoid
from ..session import keep_freed_memory, materialise, scratch_scope
from ..sources.documents import latest_snapshot, write_epoch_weights, write_version
from . import games
from .features import kp_id_lists, with_kings, with_kp_ids
from .surveys import score_bucket

N_WEIGHTS = 81 * 1548
BETA1, BETA2, EPS, FLOOR = 0.9, 0.999, 1e-8, 1e-30


#: Bytes of features in a block of positions: what a task holds of them at a time.
BLOCK_BYTES = 16 << 20


def in_blocks(positions: DataFrame, size: Column, pos: str = "pos_id") -> DataFrame:
    """Add ``_block`` and lay rows of one block together: positions dealt by hash to blocks of some
    ``BLOCK_BYTES`` of ``size``, which a job of its own adds up.

    Derive wide features from narrow columns behind this, so that the narrow ones are moved.
    """
    total = positions.agg(F.sum(size.cast("bigint"))).first()[0] or 0
    blocks = max(2 * positions.sparkSession.sparkContext.defaultParallelism, -(-total // BLOCK_BYTES))
    return positions.withColumn("_block", F.pmod(F.xxhash64(pos), F.lit(blocks)).cast("int")).repartition("_block")


def block_weights(rows: DataFrame, weights: DataFrame, key: str = "idx") -> DataFrame:
    """``(_block, key, _w)``: the weights that the arrays ``key`` of each block's rows ask for.

    A block asks for a feature once, however many of its positions have it: what meets the weights grows with
    the blocks' different features, and a feature active everywhere is no hot key. How the weights join is
    left to the optimiser, which broadcasts what it measures to be small.
    """
    schema = T.StructType([rows.schema["_block"], T.StructField(key, rows.schema[key].dataType.elementType)])

    def ask(block: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys = pa.compute.unique(table[key].combine_chunks().flatten()).drop_null()
        return pa.table({"_block": pa.repeat(block[0], len(keys)), key: keys})

    found = weights.where(F.col("w").isNotNull()).select(key, F.col("w").alias("_w"))
    return rows.groupBy("_block").applyInArrow(ask, schema).join(found, key).select("_block", key, "_w")


def _sums(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(at, values, minlength=size).astype(float)  # of nothing, numpy makes whole numbers


class _BlockSums:
    """A block's positions, ``rows`` with arrays ``key``, under the weights ``found`` for it.

    A position's weights add up in the order of its array; rows of one position add up.
    """

    def __init__(self, rows: pa.Table, found: pa.Table, key: str, pos: str):
        lists = rows[key].combine_chunks()
        coded = lists.flatten().dictionary_encode(null_encoding="encode")
        self.keys, self.ids = coded.dictionary, np.asarray(coded.indices)
        place = pa.compute.index_in(found[key].combine_chunks(), value_set=self.keys)
        w = _sums(np.asarray(place), np.asarray(found["_w"]), len(self.keys))  # keys without a weight weigh 0
        named = rows[pos].combine_chunks().dictionary_encode(null_encoding="encode")
        self.positions, at = named.dictionary, np.asarray(named.indices)
        self.owner = np.repeat(at, np.asarray(pa.compute.list_value_length(lists).fill_null(0)))
        self.z = _sums(self.owner, w[self.ids], len(self.positions))


def score_rows(rows: DataFrame, weights: DataFrame, key: str = "idx", pos: str = "pos_id") -> DataFrame:
    """``(pos, p)``: sigmoid of the summed weights of the features in ``rows``, ``(_block, pos, key[])`` of :func:`in_blocks`."""
    schema = T.StructType([rows.schema[pos], T.StructField("z", T.DoubleType())])

    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        sums = _BlockSums(table, found, key, pos)
        return pa.table({pos: sums.positions, "z": sums.z})

    asked = block_weights(rows, weights, key)
    z = rows.select("_block", pos, key).groupBy("_block").cogroup(asked.groupBy("_block")).applyInArrow(run, schema)
    return z.select(pos, sigmoid(F.col("z")).alias("p"))


def row_gradient(rows: DataFrame, weights: DataFrame, key: str = "idx", pos: str = "pos_id") -> DataFrame:
    """``(key, g)``: sum over positions of ``2 (p - y) p (1 - p) norm`` for each active feature of ``rows``,
    ``(_block, pos, key[], _targets)`` of :func:`in_blocks`, ``_targets`` the position's ``(target, norm)``.

    A block's sums leave it, a row for each of its different features.
    """
    schema = T.StructType([T.StructField(key, rows.schema[key].dataType.elementType), T.StructField("g", T.DoubleType())])

    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        sums = _BlockSums(table, found, key, pos)
        first = np.asarray(pa.compute.index_in(sums.positions, value_set=table[pos].combine_chunks()))
        lists = table["_targets"].combine_chunks().take(pa.array(first))
        of = np.repeat(np.arange(len(first)), np.asarray(pa.compute.list_value_length(lists)))
        y, norm = (np.asarray(lists.flatten().field(c).cast("double").fill_null(np.nan)) for c in ("target", "norm"))
        with np.errstate(over="ignore"):
            p = 1.0 / (1.0 + np.exp(-sums.z[of]))
        each = 2.0 * (p - y) * p * (1.0 - p) * norm
        known = ~np.isnan(each)  # a position without a known target adds nothing
        scale = _sums(of[known], each[known], len(first))
        any_known = np.bincount(of[known], minlength=len(first)) > 0
        g = _sums(sums.ids, scale[sums.owner], len(sums.keys))
        hit = np.bincount(sums.ids, any_known[sums.owner], minlength=len(sums.keys)) > 0
        return pa.table({key: sums.keys, "g": pa.array(g, mask=~hit)})

    asked = block_weights(rows, weights, key)
    parts = rows.groupBy("_block").cogroup(asked.groupBy("_block")).applyInArrow(run, schema)
    return parts.groupBy(key).agg(F.sum("g").alias("g"))


def feature_rows(features: DataFrame, key: str = "idx", pos: str = "pos_id", place: str | None = None) -> DataFrame:
    """Features listed one a row as ``(pos, key[])``, in the order of ``place`` if given."""
    if place is None:
        return features.groupBy(pos).agg(F.collect_list(key).alias(key))
    listed = features.groupBy(pos).agg(F.array_sort(F.collect_list(F.struct(place, key))).alias("_l"))
    return listed.select(pos, F.col("_l").getField(key).alias(key))


def progress_score(features: DataFrame, weights: DataFrame, key: str = "idx", pos: str = "pos_id", place: str | None = None) -> DataFrame:
    """:func:`score_rows` of features listed one a row; unknown ones weigh 0.

    ``place`` names a column that orders a position's features: weights then add up in that order, for scores
    that must come out the same to the last bit. Features that already are arrays of their position's row
    need no gathering: give them to :func:`score_rows`.
    """
    return score_rows(in_blocks(feature_rows(features, key, pos, place), F.size(key) * 16, pos), weights, key, pos)


def target_lists(targets: DataFrame, pos: str = "pos_id") -> DataFrame:
    """``(pos, target, norm)`` rows as one row per position, ``(pos, _targets)``."""
    return targets.groupBy(pos).agg(F.collect_list(F.struct("target", "norm")).alias("_targets"))


def weight_sums(weights: DataFrame) -> np.ndarray:
    """The model's vector from ``(idx, w)`` rows: rows of one id add up, ids without one weigh 0."""
    inside = weights.where(F.col("idx").between(0, N_WEIGHTS - 1) & F.col("w").isNotNull())
    rows = inside.groupBy("idx").agg(F.sum("w").alias("w")).toArrow()  # at most the model's size
    out = np.zeros(N_WEIGHTS)
    out[np.asarray(rows["idx"])] = np.asarray(rows["w"])
    return out


def score_boards(positions: DataFrame, weights: np.ndarray) -> DataFrame:
    """Positions with both kings and ``p``, as :func:`progress_score` of their ids: a position's ids stay in its
    row, and the model's vector (125,388 numbers) is sent to the tasks."""
    rows = with_kp_ids(positions, "_ids")
    shared = rows.sparkSession.sparkContext.broadcast(weights)
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != "_ids"], T.StructField("_z", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("_ids"))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            z = np.bincount(owner, shared.value[np.asarray(lists.flatten())], minlength=batch.num_rows)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in schema.names[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(z)], schema.names)

    return rows.mapInArrow(run, schema).withColumn("p", sigmoid(F.col("_z"))).drop("_z")


def progress_bucket(p: Column, n: int) -> Column:
    return score_bucket(p, n)


def king_rank_bucket(stm: Column, bk: Column, wk: Column) -> Column:
    """Nine buckets from both kings' ranks in thirds, as the side to move sees them."""
    white = squares.inverse(wk)
    friend = F.when(stm == 0, bk.cast("int")).otherwise(white)
    enemy = F.when(stm == 0, white).otherwise(bk.cast("int"))
    third = lambda sq: F.floor(squares.rank_of(sq) / F.lit(3)).cast("int")
    return third(friend) * 3 + third(enemy)


def bucket_assign(positions: DataFrame, mode: str, n: int = 9, scores: DataFrame | None = None) -> DataFrame:
    """Add ``bucket`` by ``mode``: "progress" (needs ``scores``, or ``p`` in the rows) or "kingrank9" (needs n = 9)."""
    if mode == "kingrank9":
        if n != 9:
            raise ValueError("kingrank9 has nine buckets")
        return positions.withColumn("bucket", king_rank_bucket(F.col("stm"), F.col("bk_sq"), F.col("wk_sq")))
    if mode == "progress":
        if scores is None and "p" in positions.columns:
            return positions.withColumn("bucket", progress_bucket(F.col("p"), n)).drop("p")
        if scores is None:
            raise ValueError("progress buckets need scores")
        joined = positions.join(scores, "pos_id", "left")
        p = F.coalesce("p", F.lit(0.5))  # a position without features scores sigmoid(0)
        return joined.withColumn("bucket", progress_bucket(p, n)).drop("p")
    raise ValueError(f"unknown bucket mode {mode!r}")


def progress_gradient(
    features: DataFrame, weights: DataFrame, targets: DataFrame, key: str = "idx", pos: str = "pos_id"
) -> DataFrame:
    """:func:`row_gradient` of features listed one a row, for ``(pos, target, norm)``; positions without a
    target are left out before anything is gathered."""
    labelled = features.join(targets.select(pos), pos, "left_semi")
    rows = feature_rows(labelled, key, pos).join(target_lists(targets, pos), pos)
    return row_gradient(in_blocks(rows, F.size(key) * 16, pos), weights, key, pos)


def progress_eval(scored: DataFrame) -> DataFrame:
    """Loss sum, count, mean and the 8-bin histogram of ``p`` against ``target``, in one row."""
    e = F.col("p") - F.col("target")
    bin_ = F.greatest(F.least((F.col("p") * 8).cast("int"), F.lit(7)), F.lit(0))
    sums = scored.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(e * e), F.lit(0.0)).alias("loss"),
        *[F.count_if(bin_ == b).alias(f"h{b}") for b in range(8)],
    )
    mean = F.when(F.col("n") > 0, F.col("loss") / F.col("n")).otherwise(0.0)
    return sums.select("n", "loss", mean.alias("mean_loss"), *[f"h{b}" for b in range(8)])


def adam_step(weights: DataFrame, grad: DataFrame, lr: float, t: int, key: str = "idx") -> DataFrame:
    """One Adam step of ``(key, w, m, v)``; weights without a gradient still decay m and v."""
    bc1, bc2 = max(1 - BETA1**t, FLOOR), max(1 - BETA2**t, FLOOR)
    rows = weights.join(grad, key, "left").withColumn("_g", F.coalesce("g", F.lit(0.0)))
    g = F.col("_g")
    rows = rows.withColumns(
        {"m": F.lit(BETA1) * F.col("m") + F.lit(1 - BETA1) * g, "v": F.lit(BETA2) * F.col("v") + F.lit(1 - BETA2) * g * g}
    )
    step = F.lit(lr) * (F.col("m") / F.lit(bc1)) / (F.sqrt(F.col("v") / F.lit(bc2)) + F.lit(EPS))
    return rows.select(key, (F.col("w") - step).alias("w"), "m", "v")


def effective_lr(lr: float, scale: str, games_per_step: int) -> float:
    if scale not in ("none", "sqrt"):
        raise ValueError("lr scale is none or sqrt")
    return lr * math.sqrt(games_per_step) if scale == "sqrt" else lr


# ------------------------------------------------------------------------- training


_BOARD = ["pos_id", "board", "black_hand", "white_hand", "bk_sq", "wk_sq"]
_PLACE = ["file_id", "rec_idx", "ply"]
_ROW = ["is_val", "step_id", "game_seq", "pos_id", "idx", "target", "norm"]


def game_labels(positions: DataFrame, fraction: float, games_per_step: int, max_games: int = 0) -> DataFrame:
    """Side, step, game and target of every position: narrow rows, in which no board is moved."""
    seq = games.with_game_targets(games.segment_games(positions.select(*_PLACE, "pos_id")))
    return games.route_games(seq, fraction, games_per_step, max_games)


def labelled_boards(labels: DataFrame, positions: DataFrame, games_per_step: int) -> DataFrame:
    """Labels, with ``norm``, joined once to boards. Ids, an array of the position's own row and three times as wide, are made behind the join."""
    return games.with_position_norm(labels, games_per_step).join(positions.select(*_BOARD), "pos_id")


def training_table(positions: DataFrame, fraction: float, games_per_step: int, max_games: int = 0) -> DataFrame:
    """Positions of all games as ``(is_val, step_id, game_seq, pos_id, idx[], target, norm)``."""
    labels = game_labels(positions, fraction, games_per_step, max_games)
    return with_kp_ids(labelled_boards(labels, positions, games_per_step)).select(*_ROW)


@dataclass(frozen=True)
class StepStore:
    """The training table clustered by side and step, with the steps that each of its files holds.

    There are as many files as write tasks, however many steps: nothing is listed per step. ``spans`` has
    a row per file and side, (path, is_val, first step, last step).
    """

    spark: SparkSession
    schema: T.StructType
    spans: tuple[tuple[str, bool, int, int], ...]

    def files(self, is_val: bool, step: int | None = None) -> list[str]:
        return sorted(p for p, side, lo, hi in self.spans if side == is_val and (step is None or lo <= step <= hi))

    def read(self, is_val: bool, step: int | None = None) -> DataFrame:
        """The rows of a side, or of one of its steps: only the files that hold them are opened."""
        files = self.files(is_val, step)
        if not files:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*files).where(F.col("is_val") == is_val)
        return rows if step is None else rows.where(F.col("step_id") == step)

    def last_step(self) -> int | None:
        return max((hi for _, side, _, hi in self.spans if not side), default=None)


def store_steps(rows: DataFrame) -> StepStore:
    """Write the training table in ranges of (side, step, position), sorted inside.

    A large step is spread over many files, many small steps share one, where row groups and pages are
    skipped by their bounds.
    """
    order = ["is_val", "step_id", "pos_id"]
    table = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order), "progress-steps")
    spans = table.groupBy(F.col("_metadata.file_path").alias("path"), "is_val").agg(F.min("step_id").alias("lo"), F.max("step_id").alias("hi")).collect()
    return StepStore(rows.sparkSession, table.schema, tuple((r.path, r.is_val, r.lo, r.hi) for r in spans))


def _forward(batch: pa.RecordBatch, w: np.ndarray):
    """Ids, how many of them each position has, and its score and target."""
    lists = batch.column(batch.schema.get_field_index("idx"))
    ids, ends = np.asarray(lists.flatten()), np.asarray(lists.offsets)
    n = np.diff(ends)
    z, some = np.zeros(len(n)), n > 0
    if len(ids):
        z[some] = np.add.reduceat(w[ids], (ends[:-1] - ends[0])[some])
    p = 1.0 / (1.0 + np.exp(-z))
    return ids, n, p, np.asarray(batch.column(batch.schema.get_field_index("target")))


def step_gradient(rows: DataFrame | SmallStep | HeldOut, weights: np.ndarray) -> tuple[np.ndarray, float, int, np.ndarray]:
    """Gradient, loss sum, count and 8-bin histogram of one step, given as its rows or as one of :class:`SmallSteps`.
    Of :class:`HeldOut` positions there is no gradient.

    Each task sums into one dense vector of the model's size and emits its non-zero part; the
    sums meet in a grouped aggregation. What returns to the driver is bounded by the model
    (125,388 numbers), not by the data. ``idx`` -1 carries the loss, below it the histogram.
    """
    if isinstance(rows, SmallStep | HeldOut):
        return rows.gradient(weights)
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _StepSums(len(shared.value))
        for batch in batches:
            if batch.num_rows:
                sums.add(batch, shared.value)
        hit = np.flatnonzero(sums.total)
        keys = np.concatenate([hit, np.arange(-1, -11, -1)])
        vals = np.concatenate([sums.total[hit], [sums.loss, float(sums.n)], sums.hist])
        yield pa.RecordBatch.from_pydict({"idx": pa.array(keys.astype(np.int64)), "g": pa.array(vals)})

    parts = rows.select("idx", "target", "norm").mapInArrow(run, "idx bigint, g double")
    sums = parts.groupBy("idx").agg(F.sum("g").alias("g")).toArrow()
    shared.destroy()
    idx, g = np.asarray(sums["idx"]), np.asarray(sums["g"])
    grad = np.zeros(len(weights))
    grad[idx[idx >= 0]] = g[idx >= 0]
    extra = dict(zip(idx[idx < 0].tolist(), g[idx < 0].tolist()))
    hist = np.array([extra.get(-3 - b, 0.0) for b in range(8)])
    return grad, extra.get(-1, 0.0), int(extra.get(-2, 0)), hist


#: Positions of a step up to which one task takes it (some 20 MB of ids); larger steps are jobs over the files that hold them.
SMALL_STEP = 1 << 16
#: Small steps an epoch up to which each is a job of its own. More are taken in runs.
FEW_STEPS = 16
#: Positions in a run of small steps (some 80 MB of ids): a task reads its run step by step.
RUN_ROWS = 1 << 18


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Boards in the order of their steps as one row per step: its positions, with their ids, as one Arrow stream."""

    def row() -> pa.RecordBatch:
        table = pa.Table.from_batches(pieces).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        packed = pa.array([sink.getvalue().to_pybytes()], pa.binary())
        return pa.RecordBatch.from_pydict({"is_val": pa.array([is_val]), "step_id": pa.array([step], pa.int64()), "packed": packed})

    keep_freed_memory()
    pieces, is_val, step = [], None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023,E731
        rows = pa.RecordBatch.from_arrays([kp_id_lists(batch), column("target"), column("norm")], ["idx", "target", "norm"])
        steps = np.asarray(column("step_id"))
        cuts = [0, *(np.flatnonzero(np.diff(steps)) + 1), len(steps)]
        for lo, hi in zip(cuts, cuts[1:]):
            if pieces and steps[lo] != step:
                yield row()
                pieces = []
            is_val, step = column("is_val")[lo].as_py(), int(steps[lo])
            pieces.append(rows.slice(lo, hi - lo))
    if pieces:
        yield row()


@dataclass(frozen=True)
class SmallSteps:
    """Rows ``(is_val, step, Arrow stream)``, kept on the executors: the training side in partitions of ``per``
    consecutive steps, then the held-out side in the partitions ``held``.

    A step can be one task without planning, listing or shuffling. Where there are many, a run of them is one: steps
    follow each other, so a task that takes the next one where the last ended loses nothing, and saves a job.
    """

    rows: RDD
    per: int
    last: int  # step of the training side, -1 if there is none
    held: range

    @classmethod
    def of(cls, boards: DataFrame, labels: DataFrame) -> SmallSteps | None:
        """``boards`` as :func:`labelled_boards` gives them, packed at once. None if a step is too large for one task."""
        sizes = labels.groupBy("is_val", "step_id").agg(F.count(F.lit(1)).alias("n"))
        sides = {r.is_val: r for r in sizes.groupBy("is_val").agg(F.max("n").alias("most"), (F.max("step_id") + 1).alias("steps")).collect()}
        most = max((r.most for r in sides.values()), default=0)
        if False not in sides or most > SMALL_STEP:
            return None
        cores = labels.sparkSession.sparkContext.defaultParallelism
        # every core has runs to pack, but none is so short that its job takes longer than its steps
        per_run = lambda n: 1 if n <= FEW_STEPS else max(1, min(RUN_ROWS // most, max(n // (2 * cores), FEW_STEPS // 4)))
        steps, held = sides[False].steps, sides[True].steps if True in sides else 0
        per, per_held = per_run(steps), per_run(held)
        runs, held_runs = -(-steps // per), -(-held // per_held)
        run = F.when(F.col("is_val"), F.expr(f"{runs} + step_id div {per_held}")).otherwise(F.expr(f"step_id div {per}"))
        placed = with_kings(boards).repartitionById(runs + held_runs, run.cast("int")).sortWithinPartitions("step_id", "pos_id")
        packed = placed.select("is_val", "step_id", "target", "norm", *_BOARD).mapInArrow(_pack, "is_val boolean, step_id bigint, packed binary")
        rows = packed.rdd.map(lambda r: (r.is_val, r.step_id, bytes(r.packed))).persist(StorageLevel.MEMORY_AND_DISK)
        last = rows.map(lambda r: -1 if r[0] else r[1]).fold(-1, max)  # packs all partitions, side by side
        return cls(rows, per, last, range(runs, runs + held_runs))

    def at(self, step: int) -> SmallStep:
        return SmallStep(self.rows, step, step // self.per)

    def held_out(self) -> HeldOut:
        return HeldOut(self.rows, self.held)

    def end_of_run(self, step: int) -> int:
        """The step behind the run that holds ``step``."""
        return min((step // self.per + 1) * self.per, self.last + 1)

    def take(self, state: TrainState, stop: int, rate: float) -> TrainState:
        """The state after the steps before ``stop``, all of one run: one task, which sends its state back."""
        shared = self.rows.context.broadcast(state)

        def run(packed: Iterator[tuple[bool, int, bytes]]) -> Iterator[TrainState]:
            keep_freed_memory()
            now = replace(shared.value)  # steps make new arrays
            waiting = next((r for r in packed if r[1] >= now.step), None)
            while now.step < stop:
                sums = _StepSums(len(now.w))
                while waiting is not None and waiting[1] == now.step:
                    sums.add_stream(waiting[2], now.w)
                    waiting = next(packed, None)
                now.take(sums.total, rate)
                now.loss, now.samples, now.step = now.loss + sums.loss, now.samples + sums.n, now.step + 1
            yield now

        (after,) = self.rows.context.runJob(self.rows, run, [state.step // self.per])
        shared.destroy()
        return after


@dataclass(frozen=True)
class SmallStep:
    """One step, in a partition of ``rows``."""

    rows: RDD
    step: int
    partition: int

    def gradient(self, weights: np.ndarray) -> tuple[np.ndarray, float, int, np.ndarray]:
        context, step = self.rows.context, self.step
        shared = context.broadcast(weights)

        def run(packed: Iterator[tuple[bool, int, bytes]]):
            for _, at, data in packed:
                if at == step:
                    sums = _StepSums(len(shared.value))
                    sums.add_stream(data, shared.value)
                    hit = np.flatnonzero(sums.total)
                    yield hit.astype(np.int32), sums.total[hit], sums.loss, sums.n, sums.hist

        parts = context.runJob(self.rows, run, [self.partition])
        shared.destroy()
        grad, loss, n, hist = np.zeros(len(weights)), 0.0, 0, np.zeros(8)
        for idx, g, part_loss, part_n, part_hist in parts:
            grad[idx] += g
            loss, n, hist = loss + part_loss, n + part_n, hist + part_hist
        return grad, loss, n, hist


@dataclass(frozen=True)
class HeldOut:
    """The held-out side: ``partitions`` of ``rows``, scored side by side. Each sends back its loss, count and histogram."""

    rows: RDD
    partitions: range

    def gradient(self, weights: np.ndarray) -> tuple[None, float, int, np.ndarray]:
        if not self.partitions:
            return None, 0.0, 0, np.zeros(8)
        context = self.rows.context
        shared = context.broadcast(weights)

        def run(packed: Iterator[tuple[bool, int, bytes]]):
            keep_freed_memory()
            sums = _StepSums(0)
            for *_, data in packed:
                sums.add_stream(data, shared.value)
            yield sums.loss, sums.n, sums.hist

        losses, counts, hists = zip(*context.runJob(self.rows, run, list(self.partitions)))
        shared.destroy()
        return None, sum(losses), sum(counts), np.sum(hists, axis=0)


class _StepSums:
    """Gradient, loss, count and histogram of the batches added; of ``size`` 0, no gradient."""

    def __init__(self, size: int):
        self.total, self.hist, self.loss, self.n = np.zeros(size), np.zeros(8), 0.0, 0

    def add(self, batch: pa.RecordBatch, w: np.ndarray) -> None:
        ids, n, p, y = _forward(batch, w)
        if len(self.total):
            norm = np.asarray(batch.column(batch.schema.get_field_index("norm")))
            scale = 2.0 * (p - y) * p * (1.0 - p) * norm
            self.total += np.bincount(ids, np.repeat(scale, n), minlength=len(w))
        self.hist += np.bincount(np.clip((p * 8).astype(int), 0, 7), minlength=8)
        self.loss += float(((p - y) ** 2).sum())
        self.n += len(p)

    def add_stream(self, data: bytes, w: np.ndarray) -> None:
        for batch in pa.ipc.open_stream(data):
            self.add(batch, w)


@dataclass
class TrainState:
    """Where a training stands: weights, both moments, steps taken, and the epoch and step that come next."""

    w: np.ndarray
    m: np.ndarray
    v: np.ndarray
    t: int = 0
    epoch: int = 1
    step: int = 0
    loss: float = 0.0  # of the epoch so far
    samples: int = 0

    @classmethod
    def start(cls, init: np.ndarray | None = None) -> TrainState:
        w = np.zeros(N_WEIGHTS) if init is None else init.astype(float).copy()
        return cls(w, np.zeros_like(w), np.zeros_like(w))

    def take(self, g: np.ndarray, rate: float) -> None:
        """One Adam step."""
        self.t += 1
        self.m, self.v = BETA1 * self.m + (1 - BETA1) * g, BETA2 * self.v + (1 - BETA2) * g * g
        self.w = self.w - rate * (self.m / max(1 - BETA1**self.t, FLOOR)) / (np.sqrt(self.v / max(1 - BETA2**self.t, FLOOR)) + EPS)


_STATE = ("t", "epoch", "step", "loss", "samples")


def save_state(spark: SparkSession, state: TrainState, path: str) -> None:
    """Write a training's state as the next version below ``path``; readers see it once it is complete."""
    columns = {"idx": pa.array(np.arange(len(state.w), dtype=np.int32)), **{c: pa.array(getattr(state, c)) for c in "wmv"}}
    rows = spark.createDataFrame(pa.table(columns)).withColumns({c: F.lit(getattr(state, c)) for c in _STATE})
    write_version(rows.coalesce(1), path, "parquet")


def load_state(spark: SparkSession, path: str) -> TrainState | None:
    """The newest complete state below ``path``, None if there is none yet."""
    try:
        rows = spark.read.parquet(latest_snapshot(path, spark)).toArrow()
    except FileNotFoundError:
        return None
    if rows.num_rows != N_WEIGHTS:
        raise ValueError(f"a stored state has {rows.num_rows} weights, a model {N_WEIGHTS}")
    rows = rows.sort_by("idx")
    scalars = {c: rows[c][0].as_py() for c in _STATE}
    return TrainState(*[np.array(rows[c]) for c in "wmv"], **scalars)


def progress_train(
    positions: DataFrame,
    epochs: int,
    games_per_step: int,
    fraction: float = 0.0,
    lr: float = 1e-3,
    lr_scale: str = "sqrt",
    max_games: int = 0,
    init: np.ndarray | None = None,
    on_epoch=None,
    state_path: str | None = None,
    save_every: int = 0,
) -> tuple[np.ndarray, list[dict]]:
    """Train the model up to ``epochs`` epochs and return its weights and one record per epoch run.

    One job per optimiser step: choose ``games_per_step`` so that a step fills the cluster. Steps of up to
    ``SMALL_STEP`` positions are one task each, and where there are more than ``FEW_STEPS`` of them a run of steps
    is one task (:class:`SmallSteps`). Tables in between are dropped at the end.
    ``on_epoch(epoch, weights)`` is called after each epoch; :func:`store_epochs` makes one that
    writes to the checkpoint sink, and :func:`start_weights` reads an earlier model's table as
    ``init``. Fails when no training game is left.

    With ``state_path`` the whole state is stored after every epoch, and every ``save_every`` steps, each
    time as a new version. A call that finds a state there goes on from it, in mid-epoch too, and ends
    where an unbroken run would; ``init`` then counts for nothing. An epoch's ``on_epoch`` runs before its state is
    stored, so one that is run again writes the same epoch again.
    """
    spark = positions.sparkSession
    state = load_state(spark, state_path) if state_path else None
    state = state or TrainState.start(init)
    rate = effective_lr(lr, lr_scale, games_per_step)
    small, log = None, []
    with scratch_scope(spark, "progress-train"):
        try:
            places = materialise(positions.select(*_PLACE, "pos_id"), "progress-places")
            labels = materialise(game_labels(places, fraction, games_per_step, max_games), "progress-labels")
            boards = labelled_boards(labels, positions, games_per_step)
            small = SmallSteps.of(boards, labels)
            store = None if small else store_steps(with_kp_ids(boards).select(*_ROW))
            steps = small.last if small else store.last_step()
            if steps is None or steps < 0:
                raise ValueError("no training positions: no training games are left")
            while state.epoch <= epochs:
                while state.step <= steps:
                    if small and small.per > 1:
                        stop = small.end_of_run(state.step)
                        if state_path and save_every:
                            stop = min(stop, (state.step // save_every + 1) * save_every)
                        state = small.take(state, stop, rate)
                    else:
                        g, step_loss, step_n, _ = step_gradient(small.at(state.step) if small else store.read(False, state.step), state.w)
                        state.take(g, rate)
                        state.loss, state.samples, state.step = state.loss + step_loss, state.samples + step_n, state.step + 1
                    if state_path and save_every and state.step % save_every == 0 and state.step <= steps:
                        save_state(spark, state, state_path)
                record = {"epoch": state.epoch, "train_samples": state.samples, "train_loss": state.loss / state.samples}
                if fraction > 0:
                    _, val_loss, val_n, hist = step_gradient(small.held_out() if small else store.read(True), state.w)
                    record |= {"val_samples": val_n, "val_loss": val_loss / val_n if val_n else 0.0, "val_hist": hist.tolist()}
                log.append(record)
                if on_epoch:
                    on_epoch(state.epoch, state.w)
                state.epoch, state.step, state.loss, state.samples = state.epoch + 1, 0, 0.0, 0
                if state_path:
                    save_state(spark, state, state_path)
        finally:
            if small:
                small.rows.unpersist()
    return state.w, log


def store_epochs(spark: SparkSession, path: str):
    """An ``on_epoch`` that stores each epoch's weights with the checkpoint sink."""
    return lambda epoch, w: write_epoch_weights(weight_table(spark, w), path, epoch)


def start_weights(weights: DataFrame) -> np.ndarray:
    """``(idx, w)`` rows as the vector training starts from; as many rows as the model has, or an error."""
    rows = weights.select("idx", "w").limit(N_WEIGHTS + 1).toArrow()
    idx = np.asarray(rows["idx"])
    if len(idx) != N_WEIGHTS or len(np.unique(idx)) != N_WEIGHTS or idx.min() < 0 or idx.max() >= N_WEIGHTS:
        raise ValueError(f"a model has {N_WEIGHTS} weights, each once")
    out = np.empty(N_WEIGHTS)
    out[idx] = np.asarray(rows["w"])
    return out


def weight_table(spark: SparkSession, weights: np.ndarray, epoch: int | None = None, exact: bool = False) -> DataFrame:
    """A weight vector as ``(idx, w)`` rows, in single precision as stored models are (unless ``exact``)."""
    w = weights if exact else weights.astype(np.float32).astype(float)
    cols = {"idx": pa.array(np.arange(len(weights), dtype=np.int32)), "w": pa.array(w)}
    df = spark.createDataFrame(pa.table(cols))
    return df if epoch is None else df.withColumn("epoch", F.lit(epoch))
