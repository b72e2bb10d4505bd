"""Attack edges inside a position: enumeration, deduplication, indexing and surveys.

A piece row carries its position's board (81 bytes), so the first blocker of a ray is an
array lookup: edges are enumerated a batch at a time, without a join or a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import squares
from ..functions.binding import bind
from . import dims
from .boards import batch_codes, explode_pieces

# Percent of speed expected per percent of dead edges, from below and above.
SPEED_GAIN = {"speed_gain_low": 0.2, "speed_gain_high": 0.3}


def attack_edges(positions: DataFrame, keep: list[str]) -> DataFrame:
    """Active directed edges between non-king pieces: ``keep`` plus
    ``from_sq, to_sq, ac, dc, acolor, tcolor``. Kings block but form no edge.

    A position's edges are two arrays of its own row until they are exploded.
    """
    rows = positions.select(*dict.fromkeys([*keep, "board"]))
    schema = T.StructType([*rows.schema.fields, *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("_from", "_to")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, a, b = _board_edges(batch_codes(batch, "board", 81))
            order = np.argsort(row, kind="stable")
            upto = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=batch.num_rows)))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(upto, pa.array(x[order].astype(np.int32))) for x in (a, b)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], schema.names)

    rows = rows.mapInArrow(run, schema).select(*dict.fromkeys([*keep, "board"]), "_to", F.posexplode("_from").alias("_i", "from_sq"))
    rows = rows.withColumn("to_sq", F.get("_to", F.col("_i")))
    attacker, target = (F.get(F.col("board"), F.col(c)).cast("int") for c in ("from_sq", "to_sq"))
    return rows.select(
        *keep, "from_sq", "to_sq",
        dims.class_column(attacker).alias("ac"),
        dims.class_column(target).alias("dc"),
        (attacker % 2).alias("acolor"),
        (target % 2).alias("tcolor"),
    )


def mutual_edge_flag(edges: DataFrame) -> DataFrame:
    """Add ``mutual``: the attacked class reaches back on an empty board."""
    back = dims.reach(edges.sparkSession).select(
        F.col("cls").alias("dc"), F.col("color").alias("tcolor"),
        F.col("from_sq").alias("to_sq"), F.col("to_sq").alias("from_sq"), F.lit(True).alias("_back"),
    )
    out = edges.join(F.broadcast(back), ["dc", "tcolor", "to_sq", "from_sq"], "left")
    return out.withColumn("mutual", F.coalesce("_back", F.lit(False))).drop("_back")


def canonical_dead_edge(edges: DataFrame) -> DataFrame:
    """Add ``dead``: mutual and the attacker's class is the smaller one."""
    return edges.withColumn("dead", F.col("mutual") & (F.col("ac") < F.col("dc")))


def reverse_active_flag(edges: DataFrame, pos: str = "pos_id") -> DataFrame:
    """Add ``mutual`` where the reverse edge is active in the same position.

    For edge lists without move rules. Both directions of a pair share one group, so this is
    one aggregation-style window over (position, unordered pair): two rows at most.
    """
    pair = Window.partitionBy(pos, F.least("from_sq", "to_sq"), F.greatest("from_sq", "to_sq"))
    both = F.size(F.collect_set(F.col("from_sq") < F.col("to_sq")).over(pair)) == 2
    return edges.withColumn("mutual", both)


def edge_profile_filter(edges: DataFrame, profile: str, attacker_side: Column, attacked_side: Column) -> DataFrame:
    """Edges a profile keeps; ``full-symdedup`` keeps all pairs but drops dead edges."""
    kept = edges.where(~dims.excluded(profile, attacker_side, F.col("ac"), attacked_side, F.col("dc")))
    return kept.where(~F.col("dead")) if profile == "full-symdedup" else kept


def edges_by_profile(edges: DataFrame, attacker_side: Column, attacked_side: Column) -> DataFrame:
    """Every edge once per profile that keeps it, with ``profile``: one pass for all profiles."""
    keeps = [
        F.when(
            ~dims.excluded(p, attacker_side, F.col("ac"), attacked_side, F.col("dc")) & (~F.col("dead") if p == "full-symdedup" else F.lit(True)), F.lit(p)
        )
        for p in dims.PROFILES
    ]
    return edges.withColumn("profile", F.explode(F.array_compact(F.array(*keeps))))


def _view(edges: DataFrame, perspective: Column, tag: str) -> DataFrame:
    """Squares, sides and orientation of an edge as one player sees it."""
    own = F.when(perspective == 0, F.col("bk_sq").cast("int")).otherwise(squares.inverse(F.col("wk_sq")))
    edges = bind(edges, f"_m{tag}", squares.file_of(own) >= 5)
    mirrored = F.col(f"_m{tag}")
    view = F.struct(
        squares.viewed_by(F.col("from_sq"), perspective, mirrored).alias("f"),
        squares.viewed_by(F.col("to_sq"), perspective, mirrored).alias("t"),
        F.when(F.col("acolor") == perspective, 0).otherwise(1).alias("as"),
        F.when(F.col("tcolor") == perspective, 0).otherwise(1).alias("ds"),
        F.when(perspective == 0, F.col("acolor")).otherwise(1 - F.col("acolor")).alias("o"),
    )
    edges = bind(edges, "_view", view)  # its parts become join keys
    return edges.withColumns({f"_{k}{tag}": F.col(f"_view.{k}") for k in ("f", "t", "as", "ds", "o")}).drop(f"_m{tag}", "_view")


def edge_feature_index(edges: DataFrame, profile: str) -> DataFrame:
    """Add ``stm_idx`` and ``nstm_idx``: pair base + place among the class's attacks.

    ``edges`` carries ``stm, bk_sq, wk_sq`` of its position (and ``dead`` for the
    deduplicating profile). Pairs the profile excludes, and positions without both kings on
    the board, have no index and are dropped.
    """
    spark = edges.sparkSession
    edges = edges.where((F.col("bk_sq") < 81) & (F.col("wk_sq") < 81))
    if profile == "full-symdedup":
        edges = edges.where(~F.col("dead"))
    reach, pairs = dims.reach(spark), dims.pair_ranges(spark, profile)
    stm = F.col("stm").cast("int")
    for tag, perspective in (("s", stm), ("n", 1 - stm)):
        edges = _view(edges, perspective, tag)
        place = reach.select(
            F.col("cls").alias("ac"), F.col("color").alias(f"_o{tag}"), F.col("from_sq").alias(f"_f{tag}"),
            F.col("to_sq").alias(f"_t{tag}"), F.col("offset").alias(f"_p{tag}"),
        )
        base = pairs.select(
            F.col("attacker_side").alias(f"_as{tag}"), "ac", F.col("attacked_side").alias(f"_ds{tag}"), "dc",
            F.col("base").alias(f"_b{tag}"),
        )
        edges = edges.join(F.broadcast(place), ["ac", f"_o{tag}", f"_f{tag}", f"_t{tag}"])
        edges = edges.join(F.broadcast(base), [f"_as{tag}", "ac", f"_ds{tag}", "dc"])
    out = edges.withColumns({"stm_idx": F.col("_bs") + F.col("_ps"), "nstm_idx": F.col("_bn") + F.col("_pn")})
    return out.drop(*[f"_{k}{t}" for k in ("f", "t", "as", "ds", "o", "p", "b") for t in "sn"])


def attack_hits(boards: np.ndarray) -> np.ndarray:
    """(positions, color, square): how many pieces of a color attack each square, kings included.

    Pieces of one code on one square are walked together, a ray at a time; a ray goes on for the
    positions where the square before was empty.
    """
    out = np.zeros((len(boards), 2, 81), np.uint8)
    row, sq = np.nonzero(boards > 1)
    code = boards[row, sq].astype(np.int64)
    order = np.argsort(code * 81 + sq, kind="stable")
    row, key = row[order], (code * 81 + sq)[order]
    cuts = np.flatnonzero(np.diff(key, prepend=-1))
    for lo, hi in zip(cuts.tolist(), np.append(cuts[1:], len(key)).tolist(), strict=True):
        c, s = divmod(int(key[lo]), 81)
        for path in dims.rays_of(c // 2, c % 2, s):
            going = row[lo:hi]
            for to in path:
                out[going, c % 2, to] += 1  # a position has at most one piece of this code on this square
                going = going[boards[going, to] <= 1]
                if not len(going):
                    break
    return out


def _board_edges(boards: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, square, square): every attack of one piece on another, neither of them a king."""
    out = []
    row, sq = np.nonzero((boards > 1) & (boards >> 1 != dims.KING))
    code = boards[row, sq].astype(np.int64)
    order = np.argsort(code * 81 + sq, kind="stable")
    row, key = row[order], (code * 81 + sq)[order]
    cuts = np.flatnonzero(np.diff(key, prepend=-1))
    for lo, hi in zip(cuts.tolist(), np.append(cuts[1:], len(key)).tolist(), strict=True):
        c, s = divmod(int(key[lo]), 81)
        for path in dims.rays_of(c // 2, c % 2, s):
            going = row[lo:hi]
            for to in path:
                met = boards[going, to]
                hit = going[(met > 1) & (met >> 1 != dims.KING)]
                if len(hit):
                    out.append((hit, np.full(len(hit), s), np.full(len(hit), to)))
                going = going[met <= 1]
                if not len(going):
                    break
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True))


_CLASS_OF = np.array([-1 if c // 2 in (0, dims.KING) else dims.class_of(c // 2) for c in range(30)])


def _places() -> np.ndarray:
    """(class, color, from, to): the place of an empty-board attack in its class block, -1 where there is none."""
    place = np.full((len(dims.CLASS_TYPE), 2, 81, 81), -1, np.int64)
    for cls, color, a, b, offset in dims.reach_rows():
        place[cls, color, a, b] = offset
    return place


def dead_edge_counts(positions: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, ``n_dead``, ``n_unmatched``: per position its dead edges, and those whose reverse is not active there.

    :func:`edge_violations` for boards: a reverse can only lie in the same row, so edges never meet in a join.
    """
    reaches = _places() >= 0
    rows = positions.select(*dict.fromkeys([*keep, "board"]))
    schema = T.StructType([*[rows.schema[c] for c in keep], *[T.StructField(c, T.LongType()) for c in ("n_dead", "n_unmatched")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            boards = batch_codes(batch, "board", 81)
            row, a, b = _board_edges(boards)
            ac, dc, d_color = _CLASS_OF[boards[row, a]], _CLASS_OF[boards[row, b]], boards[row, b] % 2
            dead = reaches[dc, d_color, b, a] & (ac < dc)
            unmatched = dead & ~np.isin((row * 81 + b) * 81 + a, (row * 81 + a) * 81 + b)
            counts = [pa.array(np.bincount(row[x], minlength=len(boards)).astype(np.int64)) for x in (dead, unmatched)]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in keep], *counts], schema.names)

    return rows.mapInArrow(run, schema)


def with_edge_ids(positions: DataFrame, profile: str, first: int, stm_out: str, nstm_out: str) -> DataFrame:
    """Positions with the ids of :func:`edge_feature_index` from ``first`` on as two arrays per row.

    The edges of a row come from its own board: no piece or edge is a row of its own and nothing is
    regrouped. The tables of places and pair bases are fixed (26,244 cells a class and colour, 324 pairs).
    Both arrays hold the same edges in one order.
    """
    n_classes = len(dims.CLASS_TYPE)
    place = _places()
    base = np.full((2, n_classes, 2, n_classes), -1, np.int64)
    for r in dims.pair_ranges(positions.sparkSession, profile).collect():
        base[r.attacker_side, r.ac, r.attacked_side, r.dc] = r.base
    schema = T.StructType([*positions.schema.fields, *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in (stm_out, nstm_out)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c: np.asarray(batch.column(batch.schema.get_field_index(c)))  # noqa: B023,E731
            boards = batch_codes(batch, "board", 81)
            row, a, b = _board_edges(boards)
            order = np.lexsort((b, a, row))
            row, a, b = row[order], a[order], b[order]
            attacker, attacked = boards[row, a].astype(np.int64), boards[row, b].astype(np.int64)
            ac, dc, a_color, d_color = _CLASS_OF[attacker], _CLASS_OF[attacked], attacker % 2, attacked % 2
            stm, kings = column("stm").astype(np.int64), (column("bk_sq").astype(np.int64), 80 - column("wk_sq").astype(np.int64))
            keep = (kings[0] < 81) & (kings[1] >= 0)
            keep = keep[row]
            if profile == "full-symdedup":
                keep &= ~((place[dc, d_color, b, a] >= 0) & (ac < dc))
            ids = []
            for view in (stm[row], 1 - stm[row]):
                flip = np.where(view == 0, kings[0][row], kings[1][row]) // 9 >= 5
                ends = []
                for sq in (a, b):
                    seen = np.where(view == 0, sq, 80 - sq)
                    ends.append(np.where(flip, (8 - seen // 9) * 9 + seen % 9, seen))
                orient = np.where(view == 0, a_color, 1 - a_color)
                pair = base[(a_color != view).astype(np.int64), ac, (d_color != view).astype(np.int64), dc]
                keep &= pair >= 0
                ids.append(first + pair + place[ac, orient, ends[0], ends[1]])
            upto = np.concatenate(([0], np.cumsum(np.bincount(row[keep], minlength=len(boards))))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(upto), pa.array(x[keep].astype(np.int32))) for x in ids]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(batch.num_columns)], *lists], schema.names)

    return positions.mapInArrow(run, schema)


def with_attack_counts(positions: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, ``board``, and per square ``black_hits`` and ``white_hits``: one pass over the rows, no shuffle."""
    rows = positions.select(*keep, "board")
    schema = T.StructType([*rows.schema.fields, *[T.StructField(c, T.ArrayType(T.ShortType())) for c in ("black_hits", "white_hits")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            boards = batch_codes(batch, "board", 81)
            hits = attack_hits(boards).astype(np.int16)
            upto = pa.array(np.arange(0, 81 * (len(boards) + 1), 81, dtype=np.int32))
            lists = [pa.ListArray.from_arrays(upto, pa.array(np.ascontiguousarray(hits[:, c]).ravel())) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(batch.num_columns)], *lists], schema.names)

    return rows.mapInArrow(run, schema)


def attacker_counts(positions: DataFrame, pos: str = "pos_id") -> DataFrame:
    """``(pos, color, sq, n)``: how many pieces of a color attack a square, kings included."""
    counted = with_attack_counts(positions, [pos])
    both = F.array(
        F.struct(F.lit(0).alias("color"), F.col("black_hits").alias("hits")), F.struct(F.lit(1).alias("color"), F.col("white_hits").alias("hits"))
    )
    rows = counted.select(pos, F.explode(both).alias("_b")).select(pos, F.col("_b.color").alias("color"), F.posexplode("_b.hits").alias("sq", "n"))
    return rows.where(F.col("n") > 0).select(pos, "color", "sq", F.least(F.col("n").cast("int"), F.lit(255)).alias("n"))


def piece_attack_counts(positions: DataFrame, keep: list[str], pos: str = "pos_id") -> DataFrame:
    """Every board piece (kings included) with ``attacked`` and ``defended`` counts."""
    counted = with_attack_counts(positions, [pos, *keep])
    rows = explode_pieces(counted, [pos, *keep, "black_hits", "white_hits"], with_kings=True)
    black, white = F.get("black_hits", F.col("sq")).cast("int"), F.get("white_hits", F.col("sq")).cast("int")
    return rows.withColumns(
        {
            "defended": F.when(F.col("color") == 0, black).otherwise(white),
            "attacked": F.when(F.col("color") == 0, white).otherwise(black),
        }
    ).drop("black_hits", "white_hits")


# ------------------------------------------------------------------------- surveys


def edge_pair_breakdown(edges: DataFrame, top: int) -> DataFrame:
    """Per class pair: total, dead, percent; most dead first, then most edges, then pair order."""
    pairs = edges.groupBy("ac", "dc").agg(F.count(F.lit(1)).alias("total"), F.count_if("dead").alias("dead"))
    pairs = pairs.withColumn("pct", F.col("dead") * 100.0 / F.col("total"))
    return pairs.orderBy(F.desc("dead"), F.desc("total"), "ac", "dc").limit(top)


def edge_bin_breakdown(edges: DataFrame, bin_col: str, bins: list[int]) -> DataFrame:
    """Total, dead and percent per bin, bins without edges included; the first and the last bin are open,
    so every edge is counted. A null bin is an error."""
    spark = edges.sparkSession
    wanted = F.broadcast(spark.range(1).select(F.explode(F.array(*[F.lit(b) for b in bins])).alias("bin")))
    held = F.greatest(F.least(F.col(bin_col), F.lit(max(bins))), F.lit(min(bins)))
    held = F.when(F.col(bin_col).isNull(), F.raise_error(F.lit("an edge has no bin")).cast("int")).otherwise(held)
    sums = edges.groupBy(held.alias("bin")).agg(F.count(F.lit(1)).alias("t"), F.count_if("dead").alias("d"))
    out = sums.join(wanted, "bin", "right")
    total, dead = F.coalesce("t", F.lit(0)), F.coalesce("d", F.lit(0))
    return out.select(
        "bin", total.alias("total"), dead.alias("dead"),
        F.when(total > 0, dead * 100.0 / total).otherwise(0.0).alias("pct"),
    )


def edge_reduction_summary(edges: DataFrame, positions: DataFrame, pos: str = "pos_id") -> DataFrame:
    """Positions, edges, dead share, edges per position, the expected gain in speed and the verdict, in one row.

    Positions come from their own table: one without edges still counts.
    """
    n_pos = positions.agg(F.count(F.lit(1)).alias("positions"))
    sums = edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if("dead").alias("dead"))
    row = sums.crossJoin(F.broadcast(n_pos))  # one row each
    pct = F.when(F.col("edges") > 0, F.col("dead") * 100.0 / F.col("edges")).otherwise(0.0)
    return row.withColumn("pct", pct).select(
        "positions", "edges", "dead", "pct",
        F.when(F.col("positions") > 0, F.col("edges") / F.col("positions")).otherwise(0.0).alias("edges_per_position"),
        *[(F.lit(share) * F.col("pct")).alias(name) for name, share in SPEED_GAIN.items()],
        F.when(F.col("pct") >= 15.0, "worthwhile").when(F.col("pct") < 10.0, "too little").otherwise("undecided").alias("verdict"),
    )


def edge_violations(edges: DataFrame, pos: str = "pos_id") -> DataFrame:
    """Dead edges whose reverse is not active in the same position."""
    reverse = edges.select(pos, F.col("to_sq").alias("from_sq"), F.col("from_sq").alias("to_sq"))
    return edges.where("dead").join(reverse, [pos, "from_sq", "to_sq"], "left_anti")


def edge_invariant_check(edges: DataFrame, pos: str = "pos_id", fail: bool = True) -> DataFrame:
    """The first eight violations with the total beside them; raises when there are any."""
    bad = edge_violations(edges, pos)
    count = bad.agg(F.count(F.lit(1)).alias("violations"))
    first = bad.orderBy(pos, "from_sq", "to_sq").limit(8).crossJoin(F.broadcast(count))  # one row
    if fail:
        n = count.first()["violations"]
        if n:
            raise ValueError(f"{n} dead edges without an active reverse")
    return first
