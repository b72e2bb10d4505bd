"""Adapter views: the driver tables read as corpora, in Spark and as the same SQL for DuckDB.

``v_pos``     events as scored positions (file, record index, score, result, ply)
``v_seq``     conversation turns as one ordered record stream
``v_feat``    document tokens as sparse features with a weight and a target
``v_edge``    trade between nations as weekly attack-edge graphs
``v_tensor``  embeddings as named tensors
``v_hist``    daily event statistics as run histories
``v_board``   events as full board positions (a square permutation of the 40 pieces), so
              the codec, feature and edge operators have an oracle too
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - loads pa.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.boards import BOARD_FIELDS
from ..session import keep_freed_memory, spread, task_count


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- positions and sequences


EPOCH_DAY = "2024-01-01"


def day_number(ts: str) -> Column:
    """Days since the first day of the tables, from 1 on; months never fold together."""
    return (F.datediff(F.col(ts).cast("date"), F.lit(EPOCH_DAY).cast("date")) + 1).cast("int")


_DAY = f"CAST(date_diff('day', DATE '{EPOCH_DAY}', CAST(ts AS DATE)) + 1 AS INTEGER)"


def v_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    sign = F.when(kind.isin("error", "signup"), -1).otherwise(1)
    stamp = F.when(value >= 200, 32000).otherwise(F.floor(value * 66).cast("int"))
    result = F.when(kind.isin("purchase", "signup"), 1).when(kind.isin("error", "click"), -1).otherwise(0)
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 8).cast("int").alias("file_id"),
        F.col("event_id").alias("rec_idx"),
        (sign * stamp).cast("int").alias("score"),
        result.cast("int").alias("result"),
        F.hour("ts").alias("ply"),
        day_number("ts").alias("day"),
    )


V_POS = f"""
  SELECT CAST(user_id % 8 AS INTEGER) AS file_id, event_id AS rec_idx,
         CAST((CASE WHEN event_type IN ('error','signup') THEN -1 ELSE 1 END)
            * (CASE WHEN value >= 200 THEN 32000 ELSE CAST(floor(value * 66) AS INTEGER) END) AS INTEGER) AS score,
         CAST(CASE WHEN event_type IN ('purchase','signup') THEN 1
                   WHEN event_type IN ('error','click') THEN -1 ELSE 0 END AS INTEGER) AS result,
         CAST(hour(ts) AS INTEGER) AS ply, {_DAY} AS day
  FROM events"""


TURNS = 1 << 20  # record numbers of one conversation


def v_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.lit(0).alias("file_id"),
        F.when(F.col("turn").between(0, TURNS - 1), F.col("conv_id") * TURNS + F.col("turn"))
        .otherwise(F.raise_error(F.lit("a conversation has more turns than its record numbers")).cast("bigint"))
        .alias("rec_idx"),
        F.col("turn").cast("int").alias("ply"),
    )


V_SEQ = f"""
  SELECT 0 AS file_id, conv_id * {TURNS} + turn AS rec_idx, CAST(turn AS INTEGER) AS ply
  FROM conversations"""


# ---------------------------------------------------------------- sparse features


def v_feat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with their ``place`` in the text."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        F.col("doc_id").alias("pos_id"), F.posexplode(F.split("text", " ", -1)).alias("place", "token")
    )
    return docs.withColumn("w", _token_weight())


def _token_weight() -> Column:
    return (F.length("token") - 4) / F.lit(10.0)


def v_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of ``v_feat``, each once with its weight; a batch of texts gives each of its tokens once."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.compute.split_pattern(batch.column(0), " ").flatten()
            yield pa.RecordBatch.from_arrays([found.unique().cast("string")], ["token"])

    texts = spread(v_texts(spark, sf_dir).select("text"))
    return texts.mapInArrow(tokens, "token string").groupBy("token").agg(F.max(_token_weight()).alias("w"))


def v_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts whose words are ``v_feat``, a row each; one without a text has no features."""
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("pos_id"), "text")


V_FEAT = """
  SELECT pos_id, token, (length(token) - 4) / 10.0::DOUBLE AS w
  FROM (SELECT doc_id AS pos_id, unnest(string_split(text, ' ')) AS token FROM documents)"""


def v_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("pos_id"), F.col("quality").cast("double").alias("target")
    )


V_TARGET = "SELECT doc_id AS pos_id, CAST(quality AS DOUBLE) AS target FROM labels"


# ---------------------------------------------------------------- edges


def v_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct weekly (supplier nation -> customer nation) edges.

    Nation lookups are fixed at 25 rows and broadcast; orders, customers and suppliers grow,
    so their join strategy is left to the optimiser.
    """
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("from_sq"))
    cus = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("to_sq"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    buyers = orders.join(cus, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "to_sq", F.date_trunc("week", "o_orderdate").cast("date").alias("week")
    )
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    edges = (
        lines.join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
        .where(F.col("from_sq") != F.col("to_sq"))
        .select("week", "from_sq", "to_sq")
        .distinct()
    )
    ac = nation.select(F.col("n_nationkey").alias("from_sq"), F.col("n_regionkey").alias("ac"))
    dc = nation.select(F.col("n_nationkey").alias("to_sq"), F.col("n_regionkey").alias("dc"))
    return edges.join(ac, "from_sq").join(dc, "to_sq").select(
        F.datediff("week", F.lit("1990-01-01").cast("date")).cast("bigint").alias("pos_id"),
        F.year("week").alias("yr"),
        "from_sq",
        "to_sq",
        "ac",
        "dc",
    )


V_EDGE = """
  SELECT date_diff('day', DATE '1990-01-01', week) AS pos_id, CAST(year(week) AS INTEGER) AS yr,
         from_sq, to_sq, a.n_regionkey AS ac, d.n_regionkey AS dc
  FROM (SELECT DISTINCT CAST(date_trunc('week', o_orderdate) AS DATE) AS week,
               s_nationkey AS from_sq, c_nationkey AS to_sq
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
             JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
        WHERE s_nationkey <> c_nationkey) e
       JOIN nation a ON a.n_nationkey = from_sq JOIN nation d ON d.n_nationkey = to_sq"""


# ---------------------------------------------------------------- tensors and histories


def v_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.when(F.size("embedding") <= 64, F.col("embedding")).otherwise(
        F.raise_error(F.lit("an embedding has more than 64 values")).cast("array<float>")
    )
    e = table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("name"), "vec_id", F.posexplode(whole).alias("pos", "x")
    )
    return e.select("name", (F.col("vec_id") * 64 + F.col("pos")).alias("idx"), F.col("x").cast("double").alias("v"))


V_TENSOR = """
  SELECT CAST(label AS VARCHAR) AS name, vec_id * 64 + pos - 1 AS idx, CAST(embedding[pos] AS DOUBLE) AS v
  FROM (SELECT label, vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings)"""


def v_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("run"), day_number("ts").alias("superbatch"))
        .agg(
            F.avg("value").alias("loss"),
            F.stddev_samp("value").alias("test_loss"),
            F.count(F.lit(1)).alias("n_positions"),
            F.sum("value").alias("seconds"),
        )
    )


V_HIST = f"""
  SELECT event_type AS run, {_DAY} AS superbatch, avg(value) AS loss,
         stddev_samp(value) AS test_loss, count(*) AS n_positions, sum(value) AS seconds
  FROM events GROUP BY 1, 2"""


# ---------------------------------------------------------------- full boards

# Item i of a position: 0-17 pawn, 18-21 lance, 22-25 knight, 26-29 silver, 30-33 gold,
# 34-35 bishop, 36-37 rook, 38 first king, 39 second king, 40-80 empty. Square s holds item
# (a*s + b) mod 81 with a coprime to 81, so every item has exactly one square.

_ITEM_TYPE = (
    "CASE WHEN {i} < 18 THEN 1 WHEN {i} < 22 THEN 2 WHEN {i} < 26 THEN 3 WHEN {i} < 30 THEN 4 "
    "WHEN {i} < 34 THEN 7 WHEN {i} < 36 THEN 5 ELSE 6 END"
)


def _draw(i: str, div: str) -> str:
    """A pseudo-random number of item ``i``; the names below read it from a column ``d``."""
    return f"((h % 1009) * ({i} + 3) + {i} * {i} * 37 + (h {div} 1009))"


def _in_hand(div: str) -> str:
    return f"((d {div} 2) % 5 = 0)"


_COLOR = "(d % 2)"


def _cell_code(div: str) -> str:
    """Board code (type * 2 + color) of item ``i`` with draw ``d``; 0 when it is not on the board."""
    base = _ITEM_TYPE.format(i="i")
    up = f"CASE WHEN i < 30 THEN 8 + ({base}) WHEN i < 36 THEN 13 ELSE 14 END"
    ptype = f"CASE WHEN i NOT BETWEEN 30 AND 33 AND (d {div} 10) % 3 = 0 THEN {up} ELSE {base} END"
    return (
        f"CASE WHEN i >= 40 THEN 0 WHEN i >= 38 THEN 16 + i - 38 WHEN {_in_hand(div)} THEN 0 "
        f"ELSE 2 * ({ptype}) + {_COLOR} END"
    )


_HAND_RANGES = ((0, 17), (18, 21), (22, 25), (26, 29), (30, 33), (34, 35), (36, 37))
_H = "event_id * 7919 + user_id * 104729 + CAST(floor(value * 100) AS BIGINT) * 31"


def _quotient(x: np.ndarray, k: int) -> np.ndarray:
    """Integer division toward zero, as SQL divides."""
    return (x - np.fmod(x, k)) // k


# type and promoted type of items -80 to 80 (SQL's remainders keep their sign); kings and empty squares have none
_PLAIN = np.array([1] * 98 + [2] * 4 + [3] * 4 + [4] * 4 + [7] * 4 + [5] * 2 + [6] * 2 + [0] * 43)
_RAISED = np.array([9] * 98 + [10] * 4 + [11] * 4 + [12] * 4 + [7] * 4 + [13] * 2 + [14] * 2 + [0] * 43)


def _draws(h: np.ndarray, i: np.ndarray) -> np.ndarray:
    return np.fmod(h, 1009)[:, None] * (i + 3) + i * i * 37 + _quotient(h, 1009)[:, None]


def _is_held(d: np.ndarray) -> np.ndarray:
    return np.fmod(_quotient(d, 2), 5) == 0


def _place_items(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    """Boards, hands, side to move and king squares of a batch: ``_cell_code`` and its kin, all rows in step."""
    item = np.fmod(a[:, None] * np.arange(81) + b[:, None], 81)
    d = _draws(h, item)
    code = 2 * np.where(np.fmod(_quotient(d, 10), 3) == 0, _RAISED[item + 80], _PLAIN[item + 80]) + np.fmod(d, 2)
    code[_is_held(d)] = 0
    board = np.where(item >= 38, np.where(item >= 40, 0, item - 22), code)
    d = _draws(h, np.arange(38))
    held, color = _is_held(d), np.fmod(d, 2)
    hands = [np.stack([(held & (color == c))[:, lo : hi + 1].sum(1) for lo, hi in _HAND_RANGES], axis=1) for c in (0, 1)]
    kings = [np.where((at := item == i).any(1), at.argmax(1), -1) for i in (38, 39)]
    stm = np.fmod(_quotient(h, 7), 2)
    return {"board": board, "black_hand": hands[0], "white_hand": hands[1], "stm": stm, "bk_sq": kings[0], "wk_sq": kings[1]}


def _board_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keep_freed_memory()
    for batch in batches:
        column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023,E731
        unknown = ~np.asarray(column("h").is_valid())
        out = {c: column(c) for c in batch.schema.names if c != "h"}
        for c, x in _place_items(*[np.asarray(column(c).fill_null(0)) for c in "hab"]).items():
            x = x.astype(np.int8)
            if x.ndim == 1:
                out[c] = pa.array(x, mask=unknown)
            else:
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                out[c] = pa.ListArray.from_arrays(ends, pa.array(x.ravel()), mask=pa.array(unknown) if unknown.any() else None)
        yield pa.RecordBatch.from_pydict(out)


def v_board(spark: SparkSession, sf_dir: str, ranged: bool = False, parts: bool = False) -> DataFrame:
    """Positions with ``board`` (81 codes) and both hands, built batch by batch without a join.

    The small source rows are dealt to tasks of a bounded number of them first; with ``ranged`` in record-index
    ranges, for writing ordered files without sorting the encoded rows. ``parts`` keeps the permutation's ``a`` and ``b``.
    """
    source = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts")
    n = task_count(source)
    source = source.repartitionByRange(n, "event_id") if ranged else source.repartition(n)
    kind = F.col("event_type")
    sign = F.when(kind.isin("error", "signup"), -1).otherwise(1)
    stamp = F.when(F.col("value") >= 200, 32000).otherwise(F.floor(F.col("value") * 66).cast("int"))
    result = F.when(kind.isin("purchase", "signup"), 1).when(kind.isin("error", "click"), -1).otherwise(0)
    rows = source.select(
        F.col("event_id").alias("pos_id"),
        (F.col("user_id") % 8).cast("int").alias("file_id"),
        F.col("event_id").alias("rec_idx"),
        (sign * stamp).cast("int").alias("score"),
        result.cast("int").alias("result"),
        F.hour("ts").alias("ply"),
        F.expr(_H).alias("h"),
    )
    rows = rows.withColumns({"a": F.expr("3 * (h % 26) + 1 + ((h div 26) % 2)"), "b": F.expr("(h div 52) % 81")})
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "h"]
    placed = rows.mapInArrow(_board_batches, ", ".join([*kept, BOARD_FIELDS]))
    return placed.select(
        "pos_id", "file_id", "rec_idx", "board", "black_hand", "white_hand", "stm", "bk_sq", "wk_sq", "score", "result", "ply",
        *(["a", "b"] if parts else []),
    )


V_BOARD = f"""
  SELECT event_id AS pos_id, CAST(user_id % 8 AS INTEGER) AS file_id, event_id AS rec_idx,
         h, a, b, CAST((h // 7) % 2 AS INTEGER) AS stm, CAST(hour(ts) AS INTEGER) AS ply,
         CAST((CASE WHEN event_type IN ('error','signup') THEN -1 ELSE 1 END)
            * (CASE WHEN value >= 200 THEN 32000 ELSE CAST(floor(value * 66) AS INTEGER) END) AS INTEGER) AS score,
         CAST(CASE WHEN event_type IN ('purchase','signup') THEN 1
                   WHEN event_type IN ('error','click') THEN -1 ELSE 0 END AS INTEGER) AS result
  FROM (SELECT *, 3 * (h % 26) + 1 + ((h // 26) % 2) AS a, (h // 52) % 81 AS b
        FROM (SELECT *, {_H} AS h FROM events))"""

# one row per square of every position
V_SQUARE = f"""
  SELECT pos_id, stm, sq, CAST({_cell_code('//')} AS INTEGER) AS code
  FROM (SELECT pos_id, stm, sq, i, {_draw('i', '//')} AS d
        FROM (SELECT pos_id, stm, h, CAST(s AS INTEGER) AS sq, (a * s + b) % 81 AS i FROM v_board, range(81) AS r(s)))"""

# one row per occupied square, kings included
V_CELL = "SELECT pos_id, stm, sq, code, code // 2 AS ptype, code % 2 AS color FROM v_square WHERE code > 0"

# one row per (position, owner, hand type) with a count above zero
V_HAND = f"""
  SELECT pos_id, CAST({_COLOR} AS INTEGER) AS owner, CAST({_ITEM_TYPE.format(i='i')} AS INTEGER) AS ptype,
         CAST(count(*) AS INTEGER) AS n
  FROM (SELECT pos_id, i, {_draw('i', '//')} AS d FROM v_board, range(38) AS r(i)) WHERE {_in_hand('//')} GROUP BY 1, 2, 3"""

V_KINGS = """
  SELECT pos_id, CAST(max(CASE WHEN color = 0 THEN sq END) AS INTEGER) AS bk,
         CAST(max(CASE WHEN color = 1 THEN sq END) AS INTEGER) AS wk
  FROM v_cell WHERE ptype = 8 GROUP BY 1"""

_SQL = {
    "v_pos": (V_POS, ()),
    "v_seq": (V_SEQ, ()),
    "v_feat": (V_FEAT, ()),
    "v_target": (V_TARGET, ()),
    "v_edge": (V_EDGE, ()),
    "v_tensor": (V_TENSOR, ()),
    "v_hist": (V_HIST, ()),
    "v_board": (V_BOARD, ()),
    "v_square": (V_SQUARE, ("v_board",)),
    "v_cell": (V_CELL, ("v_square",)),
    "v_hand": (V_HAND, ("v_board",)),
    "v_kings": (V_KINGS, ("v_cell",)),
}


def add_view(name: str, sql: str, needs: tuple[str, ...] = ()) -> None:
    """Register a further oracle view built on others."""
    _SQL[name] = (sql, needs)


def ctes(views: tuple[str, ...]) -> str:
    """The named views and what they need, in dependency order, as a CTE list."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in _SQL[name][1]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for view in views:
        visit(view)
    return ",\n".join(f"{v} AS ({_SQL[v][0]})" for v in ordered)
