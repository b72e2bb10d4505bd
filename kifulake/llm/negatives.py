"""Hard-negative mining with angular triangle filtering.

Every vector keeps its angles to a few reference directions. Two vectors' angles to one direction
differ by no more than the angle between the two, and add up to no less, so the angles of a tile
of vectors and of an anchor give an interval of cosines; times the norms, with a margin for
rounding, that bounds every score between them. A tile is scored in integers only for the anchors whose
interval overlaps what they still look for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

REFERENCES = 16
TILE = 512  # vectors that share a row of bounds
TILES = 16  # tiles of a task
ANCHORS = 1024  # anchors of a task
#: Margins of the bounds: arc cosines near 0 and pi lose half their digits.
ANGLE_MARGIN, SCORE_MARGIN = 1e-6, 1e-9
SCALE = 256
POSITIVES, NEGATIVES = 5, 10
_TOP = np.iinfo(np.int64).max


def vectors(rows: DataFrame, query: str = "vec_id % 100 = 0") -> DataFrame:
    """(vec_id, label, v, anchor): the rows that take part, components floored to integers (as doubles).

    Left out are rows with a null vec_id, label or vector, or with a null or non-finite component.
    Rows equal in all three are one row.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    taken = rows.where("vec_id is not null and label is not null and embedding is not null").where(finite)
    wrong = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    ints = F.transform("embedding", lambda x: F.floor(F.lit(SCALE) * x.cast("double")).cast("double"))
    return taken.select(
        F.col("vec_id").cast("long").alias("vec_id"), wrong.cast("long").alias("label"), ints.alias("v"), F.expr(query).alias("anchor")
    ).distinct()


def reference_directions(rows: DataFrame, n: int = REFERENCES) -> np.ndarray:
    """Unit vectors of the ``n`` rows of smallest hash that are not zero: a sample bounded by ``n``."""
    some = rows.where(F.exists("v", lambda x: x != 0)).orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(n).collect()
    width = max((len(r.v) for r in some), default=1)
    out = np.zeros((len(some), width))
    for i, r in enumerate(some):
        out[i, : len(r.v)] = r.v
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix; shorter vectors are filled with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    n = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
    if len(n) and (n == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(n), width))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def with_angles(rows: DataFrame, directions: np.ndarray, width: int) -> DataFrame:
    """Adds ``norm``, ``angles`` to the directions, and ``near``, the direction of smallest angle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = np.zeros((len(directions), width))
        refs[:, : directions.shape[1]] = directions
        for b in batches:
            v = _matrix(b.column("v"), width)
            norm = np.linalg.norm(v, axis=1)
            cos = (v @ refs.T) / np.maximum(norm, 1e-300)[:, None]
            angles = np.arccos(np.clip(cos, -1, 1))
            near = angles.argmin(axis=1) if len(directions) else np.zeros(len(v), np.int64)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(angles.ravel()), max(1, angles.shape[1])) if len(directions) else None
            lists = lists.cast(pa.list_(pa.float64())) if lists is not None else pa.array([[]] * len(v), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(norm), lists, pa.array(near.astype(np.int32)), pa.array(angles.min(axis=1) if len(directions) else norm)],
                [*b.schema.names, "norm", "angles", "near", "closest"],
            )

    return rows.mapInArrow(run, "vec_id long, label long, v array<double>, anchor boolean, norm double, angles array<double>, near int, closest double")


def bounds(angles: np.ndarray, norms: np.ndarray, low: np.ndarray, high: np.ndarray, small: float, large: float) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) possible score of anchors (angles, norms) with a tile whose angles lie in
    ``low``..``high`` (per direction) and norms in ``small``..``large``."""
    if angles.shape[1]:
        apart = np.maximum(0, np.maximum(angles - high, low - angles)).max(axis=1) - ANGLE_MARGIN
        along = np.minimum(angles + high, 2 * np.pi - angles - low).min(axis=1) + ANGLE_MARGIN
    else:
        apart, along = np.zeros(len(norms)), np.full(len(norms), np.pi)
    best, worst = np.cos(np.clip(apart, 0, np.pi)), np.cos(np.clip(along, 0, np.pi))
    top = norms * np.where(best > 0, large, small) * best
    bottom = norms * np.where(worst > 0, small, large) * worst
    margin = 1 + SCORE_MARGIN * norms * large
    return bottom - margin, top + margin


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows held as doubles; an error if one may not fit 64 bits."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    if most >= 2**63:
        exact = np.vectorize(int, otypes=[object])
        out = exact(a).dot(exact(b).T)
        if max(abs(x) for x in out.ravel()) >= 2**63:
            raise OverflowError("a score does not fit 64 bits")
        return out.astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _best(score: np.ndarray, ids: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor row, column) of the ``k`` first of each row among ``ok``: higher score, then smaller id."""
    if score.shape[1] > 4 * k:
        # no more than k columns beat the k-th best score; equal ones stay for the ids to decide
        masked = np.where(ok, score, -_TOP)
        kth = np.partition(masked, -k, axis=1)[:, -k]
        ok = ok & (score >= kth[:, None])
    row, col = np.nonzero(ok)
    order = np.lexsort((ids[col], -score[row, col], row))
    row, col = row[order], col[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    return row[nth < k], col[nth < k]


def tiled(rows: DataFrame) -> DataFrame:
    """The vectors with ``tile``: neighbours by direction and angle, at most ``TILE`` of them."""
    ordered = rows.repartitionByRange("near", "closest", "vec_id").sortWithinPartitions("near", "closest", "vec_id")
    at = F.monotonically_increasing_id()
    return stash(ordered.withColumn("tile", F.floor(at / F.lit(TILE)).cast("long")), "vector-tiles")


class _Found:
    """Rows (anchor_id, slot, other, score) gathered by a task."""

    def __init__(self):
        self.parts: list[tuple] = []

    def add(self, anchor, slot, other, score):
        self.parts.append((anchor, slot, other, score))

    def table(self) -> pa.Table:
        cols = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in zip(*self.parts, strict=True)] or [np.zeros(0, np.int64)] * 4
        return pa.table([pa.array(c.astype(np.int64)) for c in cols], names=["anchor_id", "slot", "other", "score"])


SOUGHT = "anchor_id long, slot long, other long, score long"


def _search(anchors: dict, tiles: dict, same: bool, k: int, width: int) -> pa.Table:
    """The ``k`` first partners of each sought window of each anchor within these tiles.

    ``anchors`` has per window: id, label, v, norm, angles, slot, low, high (inclusive score bounds);
    ``tiles`` the rows of some tiles. As windows fill, their lower bound rises to the k-th score found.
    """
    out = _Found()
    low = anchors["low"].copy()
    for t in np.unique(tiles["tile"]):
        mine = np.flatnonzero(tiles["tile"] == t)
        ang, norm = tiles["angles"][mine], tiles["norm"][mine]
        bottom, top = bounds(anchors["angles"], anchors["norm"], ang.min(axis=0), ang.max(axis=0), norm.min(), norm.max())
        live = np.flatnonzero((top >= low) & (bottom <= anchors["high"]) & (low <= anchors["high"]))
        if not len(live):
            continue
        # a position is scored once however many windows it has
        who, back = np.unique(anchors["row"][live], return_inverse=True)
        first = np.searchsorted(anchors["row"], who)
        got = scores(anchors["v"][first], tiles["v"][mine])
        ids, label = tiles["id"][mine], tiles["label"][mine]
        fits = (anchors["label"][first][:, None] == label) == same
        fits &= anchors["id"][first][:, None] != ids
        for i in range(0, len(live), 256):
            w = live[i : i + 256]
            s = got[back[i : i + 256]]
            ok = fits[back[i : i + 256]] & (s >= low[w][:, None]) & (s <= anchors["high"][w][:, None])
            r, c = _best(s, ids, ok, k)
            out.add(anchors["id"][w][r], anchors["slot"][w][r], ids[c], s[r, c])
            full = np.bincount(r, minlength=len(w)) >= k
            worst = np.full(len(w), _TOP)
            np.minimum.at(worst, r, s[r, c])
            low[w[full]] = np.maximum(low[w[full]], worst[full])
    return out.table()


def _anchor_side(t: pa.Table, width: int) -> dict:
    t = t.sort_by([("vec_id", "ascending"), ("slot", "ascending")])
    ids = t["vec_id"].to_numpy()
    row = np.cumsum(np.concatenate(([0], (np.diff(ids) != 0).astype(np.int64)))) if len(ids) else ids
    return {
        "id": ids, "row": row, "label": t["label"].to_numpy(), "v": _matrix(t["v"], width), "norm": t["norm"].to_numpy(),
        "angles": _angles(t["angles"]), "slot": t["slot"].to_numpy(), "low": t["low"].to_numpy(), "high": t["high"].to_numpy(),
    }


def _angles(column: pa.ChunkedArray) -> np.ndarray:
    a = column.combine_chunks()
    return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1)


def _tile_side(t: pa.Table, width: int) -> dict:
    return {
        "tile": t["tile"].to_numpy(), "id": t["vec_id"].to_numpy(), "label": t["label"].to_numpy(), "v": _matrix(t["v"], width),
        "norm": t["norm"].to_numpy(), "angles": _angles(t["angles"]),
    }


def at_home(tiles: DataFrame, sought: DataFrame, same: bool, k: int, width: int) -> DataFrame:
    """``sought`` with ``low`` raised to the k-th score that the anchor's own tile has in the window.

    One pass over the tiles, each with its own anchors: a start that lets most of the search skip.
    """

    def run(key, a: pa.Table, t: pa.Table) -> pa.Table:
        if not a.num_rows or not t.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names=["anchor_id", "slot", "least"])
        found = _search(_anchor_side(a, width), _tile_side(t, width), same, k, width).to_pandas()
        g = found.groupby(["anchor_id", "slot"])["score"].agg(["size", "min"]).reset_index()
        g = g[g["size"] >= k]
        return pa.table([pa.array(g[c].astype("int64")) for c in ("anchor_id", "slot", "min")], names=["anchor_id", "slot", "least"])

    pairs = sought.groupBy("tile").cogroup(tiles.join(sought.select("tile").distinct(), "tile", "left_semi").groupBy("tile"))
    least = stash(pairs.applyInArrow(run, "anchor_id long, slot long, least long"), "home-bounds")
    joined = sought.join(least.withColumnRenamed("anchor_id", "vec_id"), ["vec_id", "slot"], "left")
    return joined.withColumn("low", F.greatest("low", F.coalesce("least", "low"))).drop("least")


def search(tiles: DataFrame, sought: DataFrame, same: bool, k: int, width: int) -> DataFrame:
    """(anchor_id, slot, other, score, rank) of the first ``k`` rows in each window of ``sought``.

    Anchors are cut into blocks of ``ANCHORS`` and tiles into groups of ``TILES``; a task has one of
    each, so nothing it holds grows with the data, and sends at most ``k`` rows a window.
    """
    blocks = -(-sought.select("vec_id").distinct().count() // ANCHORS)
    groups = int(tiles.agg(F.countDistinct("tile")).first()[0])
    if not blocks or not groups:
        return tiles.sparkSession.createDataFrame([], SOUGHT + ", rank int")
    n_groups = -(-groups // TILES)
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    group = F.pmod(F.xxhash64("tile"), F.lit(n_groups)).cast("int")
    left = sought.withColumn("block", block).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    right = tiles.withColumn("part", group).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(a: pa.Table, t: pa.Table) -> pa.Table:
        if not a.num_rows or not t.num_rows:
            return _Found().table()
        return _search(_anchor_side(a, width), _tile_side(t, width), same, k, width)

    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(run, SOUGHT)
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.col("score").desc(), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, query: str = "vec_id % 100 = 0", positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows of ``query``. An anchor's positives are its ``positives`` best rows of the same
    label; for each, the ``negatives`` best rows of another label whose score lies between 30% and 90% of
    the positive's. Scores are integer inner products; of equal ones the smaller vec_id comes first.

    See :func:`vectors` for the rows that take part. Labels of every seventh vec_id are moved on by one.
    Rows of the anchor's own vec_id are not its partners. Shorter vectors are filled up with zeros. A positive
    without fitting rows gives none, nor does an empty table. Columns besides vec_id, embedding and label
    are not looked at.

    Passes: anchors against their own tile for a first bound, then against all tiles; the same for
    the windows of the negatives.
    """
    taken = stash(vectors(rows, query), "vectors")
    width = int(taken.agg(F.max(F.size("v"))).first()[0] or 0) or 1
    tiles = tiled(with_angles(taken, reference_directions(taken), width))
    anchors = stash(tiles.where("anchor").drop("anchor", "near", "closest"), "anchors")
    whole = {"slot": F.lit(0).cast("long"), "low": F.lit(-(2**63) + 2).cast("long"), "high": F.lit(2**63 - 1).cast("long")}
    sought = stash(at_home(tiles, anchors.withColumns(whole), True, positives, width), "sought-positives")
    plus = stash(search(tiles, sought, True, positives, width), "positives")

    # exact in integers: the least and greatest score between 30 and 90 hundredths of the positive's
    low, high = -F.expr("floor(-30BD * s / 100)"), F.expr("floor(90BD * s / 100)")
    windows = plus.select(F.col("anchor_id").alias("vec_id"), F.col("rank").cast("long").alias("slot"), F.col("score").cast("decimal(20,0)").alias("s"))
    windows = windows.select("vec_id", "slot", low.cast("long").alias("low"), high.cast("long").alias("high")).where("low <= high")
    sought = stash(at_home(tiles, anchors.join(windows, "vec_id"), False, negatives, width), "sought-negatives")
    minus = search(tiles, sought, False, negatives, width)
    named = plus.select("anchor_id", F.col("rank").cast("long").alias("slot"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    return minus.join(named, ["anchor_id", "slot"]).select(
        "anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
