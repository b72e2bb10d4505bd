"""Queries that go through files: record sources and sinks, documents, logs, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import times
from ..functions.scores import r as rnd
from ..operators import boards, filters, games
from ..session import scratch_path
from ..sources import documents, records, versions
from ..streaming import games as stream_games, snapshots
from . import adapters as ad
from .oracle_text import games as games_sql, r
from .positions import as_text
from .registry import query


def _psv(spark, sf):
    """The board corpus written as packed record files; the path."""
    rows = boards.encode_packed(ad.v_board(spark, sf, ranged=True)).select(
        "rec_idx", "sfen", F.col("score").cast("smallint").alias("score"), (F.col("rec_idx") % 65536).cast("int").alias("move16"),
        F.col("ply").alias("game_ply"), F.col("result").cast("tinyint").alias("game_result"),
    )
    path = scratch_path(spark, "corpus")
    records.write_records(rows, path, "psv", ["rec_idx"], ranged=True)
    return path


@query(
    "psv_scan",
    """SELECT rec_idx AS global_idx, CAST(rec_idx % 65536 AS INTEGER) AS move16, CAST(score AS SMALLINT) AS score, ply AS game_ply, CAST(result AS TINYINT) AS game_result FROM v_board""",
    ("v_board",),
)
def psv_scan(spark, sf):
    """Write the corpus as range files and scan them back with their global record index."""
    rows = records.read_psv(spark, _psv(spark, sf), columns="global_idx,score,move16,game_ply,game_result")
    return rows.select("global_idx", "move16", "score", "game_ply", "game_result")


@query(
    "record_range_scan",
    "SELECT file_id, rec_idx, score FROM v_pos WHERE rec_idx >= (SELECT count(*) // 4 FROM events) AND rec_idx < (SELECT 3 * count(*) // 4 FROM events)",
    ("v_pos",),
)
def record_range_scan(spark, sf):
    """Records [n/4, 3n/4) of a stream in several files, as a byte range of the source: no other record is read."""
    rows = ad.v_pos(spark, sf).select("rec_idx", F.lit(b"\0" * 32).alias("sfen"), F.col("score").cast("smallint").alias("score"), F.col("file_id").alias("move16"))
    path = scratch_path(spark, "ranged")
    records.write_records(rows, path, "psv", ["rec_idx"])
    size = records.LAYOUTS["psv"].itemsize
    n = sum(b for _, b in records.list_files(records.qualified(spark, path))) // size
    back = records.read_psv(spark, path, start=n // 4 * size, end=3 * n // 4 * size, columns="global_idx,score,move16")
    return back.select(F.col("move16").alias("file_id"), F.col("global_idx").alias("rec_idx"), F.col("score").cast("int").alias("score"))


@query(
    "training_view",
    f"""t AS (SELECT * FROM v_text), g AS (SELECT pos_id, greatest(least(score, 3000), -3000) AS score FROM v_board WHERE abs(score) < 32000)
        SELECT t.*, g.score FROM t JOIN g USING (pos_id)""",
    ("v_text", "v_board"),
)
def training_view(spark, sf):
    """Files to boards in the training order: drop and clamp on raw fields, then decode the rest."""
    rows = records.read_psv(spark, _psv(spark, sf), columns="sfen,score,global_idx")
    usable = filters.score_clamp(filters.score_drop(rows, 32000), 3000)
    # the record's own number is its event id, and the source knows it before any filter
    decoded = boards.decode_positions(usable.select(F.col("global_idx").alias("pos_id"), "score", "sfen"))
    return as_text(decoded, "score")


@query(
    "hcpe_scan",
    """SELECT rec_idx AS global_idx, CAST(score AS SMALLINT) AS score, CAST(CASE WHEN result = 0 THEN 0 WHEN (result = 1) = (stm = 0) THEN 1 ELSE 2 END AS INTEGER) AS result FROM v_board""",
    ("v_board",),
)
def hcpe_scan(spark, sf):
    absolute = F.when(F.col("result") == 0, 0).when((F.col("result") == 1) == (F.col("stm") == 0), 1).otherwise(2)
    rows = boards.encode_huffman(ad.v_board(spark, sf, ranged=True)).select("rec_idx", "pos", F.col("score").cast("smallint").alias("score"), absolute.cast("int").alias("result"))
    path = scratch_path(spark, "corpus-hcpe")
    records.write_records(rows, path, "hcpe", ["rec_idx"], ranged=True)
    return records.read_hcpe(spark, path, columns="global_idx,score,result")


@query(
    "progress_weights_file",
    f"SELECT row_number() OVER (ORDER BY idx) - 1 AS global_idx, {r('v', 9)} AS w FROM v_tensor",
    ("v_tensor",),
)
def progress_weights_file(spark, sf):
    """Weights as 64-bit vectors on disk, in single precision once read; the size must match."""
    t = ad.v_tensor(spark, sf).select("idx", F.col("v").alias("w"))
    path = scratch_path(spark, "weights")
    records.write_records(t, path, "f64", ["idx"])
    w = records.read_records(spark, path, record="f64", expectedRecords=t.count(), columns="global_idx,w")
    return w.select("global_idx", rnd(F.col("w").cast("float").cast("double"), 9).alias("w"))


@query("epoch_checkpoint_sink", f"SELECT name, idx, {r('v * 3', 9)} AS w FROM v_tensor", ("v_tensor",))
def epoch_checkpoint_sink(spark, sf):
    """Three epochs stored, one of them twice; the final view is the last epoch."""
    path = scratch_path(spark, "epochs")
    t = ad.v_tensor(spark, sf)
    for epoch in (1, 2, 3, 2):
        documents.write_epoch_weights(t.select("name", "idx", (F.col("v") * epoch).alias("w")), path, epoch)
    return documents.final_weights(spark, path).select("name", "idx", rnd(F.col("w"), 9).alias("w"))


def _run_docs(hist):
    """Run histories as run documents: optional keys stay absent where the run has none."""
    entry = F.struct(F.col("superbatch").cast("bigint").alias("superbatch"), "loss", "test_loss")
    docs = hist.groupBy(F.col("run").alias("id")).agg(
        F.array_sort(F.collect_list(entry)).alias("history"), F.sum("n_positions").alias("_n")
    )
    return docs.select(
        F.lit(1).alias("schema_version"), "id", F.col("id").alias("name"), F.lit("2024-01-01T00:00:00Z").alias("date"),
        F.lit("completed").alias("status"),
        F.struct(
            F.lit(0.001).alias("lr"), F.length("id").alias("l1"), (F.length("id") * 65536).alias("batch_size"),
            F.concat(F.lit("bands-"), "id").alias("prune_bands"),
        ).alias("params"), F.struct(F.col("_n").alias("total_positions")).alias("data"), "history",
    )


@query(
    "run_document_source",
    f"""SELECT run AS id, CAST(superbatch AS BIGINT) AS superbatch, {r('loss', 9)} AS loss, {r('test_loss', 9)} AS test_loss,
               0.001::DOUBLE AS lr, CAST(length(run) AS BIGINT) AS l1, CAST(length(run) * 65536 AS BIGINT) AS batch_size, 'bands-' || run AS prune_bands FROM v_hist""",
    ("v_hist",),
)
def run_document_source(spark, sf):
    """History rows and parameters read back from run documents under the declared schema."""
    base = scratch_path(spark, "runs")
    documents.write_snapshot(_run_docs(ad.v_hist(spark, sf)), base)
    docs = documents.read_run_documents(spark, documents.latest_snapshot(base), multi_line=False)
    params = docs.select("id", "params.lr", "params.l1", "params.batch_size", "params.prune_bands")
    h = documents.run_history(docs).join(params, "id")
    return h.select("id", "superbatch", rnd(F.col("loss"), 9).alias("loss"), rnd(F.col("test_loss"), 9).alias("test_loss"), "lr", "l1", "batch_size", "prune_bands")


@query(
    "prune_versions",
    """SELECT run, CAST(superbatch AS BIGINT) AS superbatch, loss FROM (
         SELECT run, superbatch, round(loss, 9) + 0.0 AS loss, row_number() OVER (PARTITION BY run ORDER BY superbatch DESC) AS rn FROM v_hist)
       WHERE rn <= 3""",
    ("v_hist",),
)
def prune_versions(spark, sf):
    """A folder per run and superbatch, pruned twice to the three newest of each run; what is left on disk."""
    base = scratch_path(spark, "versions")
    rows = ad.v_hist(spark, sf).select(F.format_string("%s-%d", "run", "superbatch").alias("version"), "run", F.col("superbatch").cast("bigint").alias("superbatch"), "loss")
    rows.write.partitionBy("version").parquet(base)
    for _ in range(2):
        versions.prune(spark, base, r"^version=(.+)-(\d+)$", 3)
    left = spark.read.schema(rows.schema).parquet(base)
    return left.select("run", "superbatch", rnd(F.col("loss"), 9).alias("loss"))


_CLOCK = "CAST(epoch(ts) // 1 AS BIGINT)"
_LONG = "CAST(floor(value * 37) AS BIGINT)"


@query(
    "time_texts",
    f"""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts, '%Y%m%dt%H%M%Sz') AS compact,
               CASE WHEN event_id % 11 = 0 THEN '??' WHEN {_LONG} >= 3600 THEN format('{{:d}}h{{:02d}}m{{:02d}}s', {_LONG} // 3600, {_LONG} % 3600 // 60, {_LONG} % 60)
                    WHEN {_LONG} >= 60 THEN format('{{:d}}m{{:02d}}s', {_LONG} // 60, {_LONG} % 60) ELSE format('{{:d}}s', {_LONG}) END AS took FROM events""",
)
def time_texts(spark, sf):
    """Every event's time in the two document forms, and a duration as logs print it."""
    e = ad.table(spark, sf, "events")
    # the tables hold wall-clock times; their second count is taken in the same clock
    clock = F.timestamp_diff("SECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), F.date_trunc("second", F.col("ts")).cast("timestamp_ntz"))
    took = F.when(F.col("event_id") % 11 == 0, F.lit(-1.0)).otherwise(F.col("value") * 37)
    return e.select("event_id", times.utc_iso(clock).alias("iso"), times.utc_compact(clock).alias("compact"), times.duration(took).alias("took"))


@query(
    "run_document_sink",
    "SELECT run AS id, count(*) AS n_history, CAST(sum(n_positions) AS BIGINT) AS total_positions FROM v_hist GROUP BY 1",
    ("v_hist",),
)
def run_document_sink(spark, sf):
    """Two snapshots of growing histories; readers see the newer one."""
    base = scratch_path(spark, "runs")
    hist = ad.v_hist(spark, sf)
    documents.write_snapshot(_run_docs(hist.where(F.col("superbatch") <= 10)), base)
    documents.write_snapshot(_run_docs(hist), base)
    docs = documents.read_run_documents(spark, documents.latest_snapshot(base), multi_line=False)
    return docs.select("id", F.size("history").cast("bigint").alias("n_history"), F.col("data.total_positions").alias("total_positions"))


@query(
    "train_log_scan",
    "SELECT run, superbatch, CAST(round(loss * 1000) AS DOUBLE) AS pos_per_sec FROM v_hist",
    ("v_hist",),
)
def train_log_scan(spark, sf):
    """Logs with progress noise and carriage returns, one folder per run, parsed back."""
    line = F.format_string(
        "noise 12 pos/s\r[train] superbatch %d/30 | loss 0.1 | %d pos/s | lr 1e-3\r[train] superbatch x/30 | 5 pos/s",
        F.col("superbatch"), F.round(F.col("loss") * 1000).cast("bigint"),
    )
    path = scratch_path(spark, "logs")
    ad.v_hist(spark, sf).select("run", line.alias("value")).write.partitionBy("run").text(path)
    return documents.read_train_log(spark, path).select("run", "superbatch", "pos_per_sec")


def _event_stream(spark, sf):
    """The events as files that arrive over several micro-batches, so that state is carried between them."""
    events = ad.table(spark, sf, "events")
    path = scratch_path(spark, "arriving")
    events.repartition(4, "event_id").write.parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("stream_active_histogram", "SELECT CAST(hour(ts) AS INTEGER) AS bin, count(*) AS n FROM events GROUP BY 1")
def stream_active_histogram(spark, sf):
    agg = snapshots.active_histogram(_event_stream(spark, sf), F.hour("ts"))
    return snapshots.final_state(agg, "stream-histogram")


@query(
    "stream_run_best",
    f"""a AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rk FROM events)
        SELECT event_type AS run, {r('max(CASE WHEN rk = 1 THEN value END)')} AS best_loss, max(CASE WHEN rk = 1 THEN event_id END) AS best_loss_superbatch,
               CAST(sum(user_id) AS BIGINT) AS total_positions, count(*) AS n_superbatches FROM a GROUP BY 1""",
)
def stream_run_best(spark, sf):
    agg = snapshots.run_best_so_far(_event_stream(spark, sf), "event_type", "event_id", "value", F.col("user_id"))
    return snapshots.final_state(agg, "stream-best").withColumn("best_loss", rnd(F.col("best_loss")))


@query(
    "games_from_files",
    f"""o AS (SELECT pos_id AS rec_idx, 0 AS file_id, ply FROM v_board), {games_sql('g', 'o')}
        SELECT game_seq, count(*) AS n FROM g GROUP BY 1""",
    ("v_board",),
)
def games_from_files(spark, sf):
    """Games of one stream that is stored in many files: its global record numbers order it."""
    rows = ad.v_board(spark, sf).select("rec_idx", F.lit(b"\0" * 32).alias("sfen"), F.col("ply").alias("game_ply"))
    path = scratch_path(spark, "stream-files")
    records.write_records(rows, path, "psv", ["rec_idx"])
    back = records.read_psv(spark, path, columns="global_idx,game_ply")
    back = back.select(F.lit(0).alias("file_id"), F.col("global_idx").alias("rec_idx"), "game_ply")
    g = games.segment_games(back, ply_col="game_ply", block_rows=1024)
    return g.groupBy("game_seq").agg(F.count(F.lit(1)).alias("n"))


def _arrivals(spark, sf, label, flow):
    """The events as record files that come in two waves. ``flow`` (stream -> stream) runs to the end of each
    from one checkpoint, so the second is a restart; the table it wrote. ``move16`` holds the game file."""
    rows = ad.v_pos(spark, sf).select(
        "rec_idx", F.lit(b"\0" * 32).alias("sfen"), F.col("score").cast("smallint").alias("score"), F.col("file_id").alias("move16"),
        F.col("ply").alias("game_ply"), F.col("result").cast("tinyint").alias("game_result"),
    )
    half = (rows.agg(F.max("rec_idx")).first()[0] or 0) // 2
    folder, table, checkpoint = (scratch_path(spark, f"{label}-{x}") for x in ("files", "table", "checkpoint"))
    for wave in (F.col("rec_idx") < half, F.col("rec_idx") >= half):
        records.write_records(rows.where(wave), folder, "psv", ["rec_idx"], files=3)
        stream = records.stream_records(spark, folder, record="psv", columns="global_idx,score,move16,game_ply,game_result", recordsPerPartition=4096)
        stream_games.run_to_table(flow(stream), table, checkpoint)
    return spark.read.parquet(table)


@query(
    "stream_record_scan",
    "SELECT rec_idx AS global_idx, file_id AS move16, CAST(score AS SMALLINT) AS score, ply AS game_ply, CAST(result AS TINYINT) AS game_result FROM v_pos",
    ("v_pos",),
)
def stream_record_scan(spark, sf):
    """Record files read as they arrive, over a restart, with their global record numbers."""
    return _arrivals(spark, sf, "arriving-records", lambda s: s)


@query(
    "stream_games",
    """SELECT file_id, rec_idx, ply, CAST(sum(CASE WHEN ply <= coalesce(prev, 1000000) THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY rec_idx) - 1 AS BIGINT) AS game
       FROM (SELECT *, lag(ply) OVER (PARTITION BY file_id ORDER BY rec_idx) AS prev FROM v_pos)""",
    ("v_pos",),
)
def stream_game_cutting(spark, sf):
    """Games of eight files whose records arrive in two waves: those that straddle a wave go on."""
    cut = lambda s: stream_games.segment_games_stream(s.select(F.col("move16").alias("file_id"), F.col("global_idx").alias("rec_idx"), F.col("game_ply").alias("ply")))
    return _arrivals(spark, sf, "arriving-games", cut)


_FILE_ROWS = 4096


@query(
    "file_list_union",
    f"""n AS (SELECT max(event_id) // {_FILE_ROWS} AS last FROM events),
        o AS (SELECT CAST(last - rec_idx // {_FILE_ROWS} AS INTEGER) AS file_id, rec_idx % {_FILE_ROWS} AS rec_idx, ply FROM v_pos, n), {games_sql('g', 'o')}
        SELECT file_id, rec_idx, game_seq FROM g""",
    ("v_pos",),
)
def file_list_union(spark, sf):
    """Files of a fixed number of records read as a comma list, the newest first: list order numbers the files,
    game state restarts with each and numbering goes on."""
    rows = ad.v_pos(spark, sf).select("rec_idx", F.lit(b"\0" * 32).alias("sfen"), F.col("ply").alias("game_ply"))
    last = (rows.agg(F.max("rec_idx")).first()[0] or 0) // _FILE_ROWS
    path = scratch_path(spark, "listed-files")
    dealt = rows.repartitionById(last + 1, F.expr(f"CAST(rec_idx div {_FILE_ROWS} AS INT)"))  # a file per block of records
    records.write_records(dealt, path, "psv", ["rec_idx"], ranged=True)
    named = [f for f, _ in records.list_files(records.qualified(spark, path))]
    back = records.read_psv(spark, ",".join(reversed(named)), columns="file_id,rec_idx,game_ply")
    return games.segment_games(back, ply_col="game_ply", block_rows=1024).select("file_id", "rec_idx", "game_seq")
