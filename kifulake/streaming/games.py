"""Cutting games out of a stream of records: state per file instead of a second look at the past."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "last_idx bigint, last_ply int, games bigint"


def _cut(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last_idx, last_ply, games = state.get if state.exists else (-1, None, 0)
    rows = pd.concat(list(parts)).sort_values("rec_idx", ignore_index=True)
    if rows["ply"].isna().any():
        raise ValueError("games are cut by ply, and a record has none")
    idx, ply = rows["rec_idx"].to_numpy(), rows["ply"].to_numpy()
    if idx[0] <= last_idx or (np.diff(idx) <= 0).any():
        raise ValueError(f"file {key[0]}: record {idx[0]} comes at or after {last_idx}, which was cut before")
    before = np.concatenate(([np.iinfo(np.int64).max if last_ply is None else last_ply], ply[:-1]))
    game = games + np.cumsum(ply <= before) - 1
    state.update((int(idx[-1]), int(ply[-1]), int(game[-1]) + 1))
    yield pd.DataFrame({"file_id": key[0], "rec_idx": idx, "ply": ply.astype(np.int32), "game": game})


def segment_games_stream(stream: DataFrame) -> DataFrame:
    """``(file_id, rec_idx, ply, game)``: games of each file numbered from 0 as their records come.

    A game starts at a file's first record and wherever ``ply <= previous ply``; one that straddles
    micro-batches goes on. The state of a file is its last record and ply and its games so far: a few
    bytes, however long the file. A file's records of one micro-batch meet in one task, three narrow
    columns each, so ``recordsPerTrigger`` bounds it. Records must come in order; one that comes late, or
    twice, fails the query.
    """
    rows = stream.select(F.col("file_id").cast("int").alias("file_id"), F.col("rec_idx").cast("bigint").alias("rec_idx"), F.col("ply").cast("int").alias("ply"))
    return rows.groupBy("file_id").applyInPandasWithState(
        _cut, "file_id int, rec_idx bigint, ply int, game bigint", STATE, "append", GroupStateTimeout.NoTimeout
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append what has come since the last run of ``checkpoint`` to the Parquet table at ``path``."""
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
