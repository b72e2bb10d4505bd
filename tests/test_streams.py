"""Streams of record files: offsets, restarts, and games that straddle micro-batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kifulake.operators import games
from kifulake.sources import records
from kifulake.streaming import games as stream_games

PSV = records.LAYOUTS["psv"]


def put(folder, name, plies, files=None, grow=False):
    rows = np.zeros(len(plies), PSV)
    rows["game_ply"] = plies
    if files is not None:
        rows["move16"] = files
    with open(folder / name, "ab" if grow else "wb") as f:
        f.write(rows.tobytes())


def follow(spark, tmp_path, **options):
    s = records.stream_records(spark, str(tmp_path / "in"), record="psv", columns="file_id,rec_idx,global_idx,game_ply", **options)
    stream_games.run_to_table(s, str(tmp_path / "out"), str(tmp_path / "check"))
    return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_files_arrive_and_the_last_one_grows(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder, "a.psv", [1, 2, 3])
    put(folder, "b.psv", [4])
    assert follow(spark, tmp_path) == [(0, 0, 0, 1), (0, 1, 1, 2), (0, 2, 2, 3), (1, 0, 3, 4)]
    assert len(follow(spark, tmp_path)) == 4  # nothing new, nothing again
    put(folder, "b.psv", [5, 6], grow=True)
    put(folder, "c.psv", [7])
    got = follow(spark, tmp_path, recordsPerPartition=1)
    assert got[4:] == [(1, 1, 4, 5), (1, 2, 5, 6), (2, 0, 6, 7)] and len(got) == 7
    back = records.read_psv(spark, str(folder), columns="file_id,rec_idx,global_idx,game_ply")
    assert got == sorted(tuple(r) for r in back.collect())


def test_a_file_that_sorts_before_is_refused(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder, "b.psv", [1, 2])
    follow(spark, tmp_path)
    put(folder, "a.psv", [9])
    with pytest.raises(Exception, match="sorts before"):
        follow(spark, tmp_path)


def test_micro_batches_are_bounded(tmp_path):
    """Offsets walk through files a bounded number of records at a time and never past the end."""
    for name, n in (("a.psv", 5), ("b.psv", 1), ("c.psv", 7)):
        put(tmp_path, name, range(n))
    stream = records.RecordStream("psv", ["game_ply"], {"path": str(tmp_path), "recordspertrigger": "4", "recordsperpartition": "3"})
    at, seen = stream.initialOffset(), []
    for _ in range(6):
        end = stream.latestOffset()
        parts = stream.partitions(at, end)
        assert sum(p.end - p.start for p in parts) <= 4 and all(p.end - p.start <= 3 for p in parts)
        seen += [p.before + i for p in parts for i in range(p.start, p.end)]
        at = end
    assert seen == list(range(13))
    again = records.RecordStream("psv", ["game_ply"], {"path": str(tmp_path)})
    assert again.partitions({"file": 1, "record": 1, "name": "b.psv"}, {"file": 2, "record": 3, "name": "c.psv"})[-1].end == 3


def test_an_empty_folder_waits(spark, tmp_path):
    (tmp_path / "in").mkdir()
    follow_empty = records.RecordStream("psv", ["game_ply"], {"path": str(tmp_path / "in")})
    assert follow_empty.latestOffset() == follow_empty.initialOffset()
    assert records.RecordStream("psv", [], {"path": str(tmp_path / "none")}).latestOffset()["record"] == 0


def cut(spark, tmp_path):
    s = records.stream_records(spark, str(tmp_path / "in"), record="psv", columns="global_idx,game_ply,move16")
    flow = stream_games.segment_games_stream(s.select(F.col("move16").alias("file_id"), F.col("global_idx").alias("rec_idx"), F.col("game_ply").alias("ply")))
    stream_games.run_to_table(flow, str(tmp_path / "out"), str(tmp_path / "check"))
    return spark.read.parquet(str(tmp_path / "out"))


def test_games_straddle_micro_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    r = np.random.default_rng(1)
    plies, files = np.cumsum(r.integers(0, 2, 400)) % 9, r.integers(0, 3, 400)
    for i, (a, z) in enumerate([(0, 3), (3, 130), (130, 131), (131, 400)]):
        put(tmp_path / "in", f"{i}.psv", plies[a:z], files[a:z])
        got = cut(spark, tmp_path)
    rows = spark.createDataFrame([(int(f), i, int(p)) for i, (f, p) in enumerate(zip(files, plies, strict=True))], "file_id int, rec_idx bigint, ply int")
    want = games.segment_games(rows, block_rows=64)
    first = want.groupBy("file_id").agg(F.min("game_seq").alias("g"))
    want = want.join(first, "file_id").select("file_id", "rec_idx", "ply", (F.col("game_seq") - F.col("g")).alias("game"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_late_and_missing_values():
    class State:
        exists, get = True, (10, 3, 2)

        def update(self, value):
            self.get = value

    import pandas as pd

    ok = State()
    out = pd.concat(stream_games._cut((1,), iter([pd.DataFrame({"rec_idx": [12, 11], "ply": [1, 4]})]), ok))
    assert out["game"].tolist() == [1, 2] and ok.get == (12, 1, 3)
    with pytest.raises(ValueError, match="comes at or after"):
        list(stream_games._cut((1,), iter([pd.DataFrame({"rec_idx": [10], "ply": [4]})]), State()))
    with pytest.raises(ValueError, match="has none"):
        list(stream_games._cut((1,), iter([pd.DataFrame({"rec_idx": [11], "ply": [None]})]), State()))
