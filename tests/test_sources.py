import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from kifulake.operators import boards
from kifulake.sources import documents, records, versions
from kifulake.streaming import snapshots


def psv_bytes(n, start=0):
    rows = np.zeros(n, records.LAYOUTS["psv"])
    i = np.arange(start, start + n)
    rows["score"], rows["move16"], rows["game_ply"], rows["game_result"] = i - 500, 65535 - i, 60000 + i, i % 3 - 1
    return rows.tobytes()


@pytest.fixture
def corpus(tmp_path):
    a, b = tmp_path / "a.bin", tmp_path / "b.bin"
    a.write_bytes(psv_bytes(10))
    b.write_bytes(psv_bytes(7, 10))
    return f"{a},{b}"


def test_files_in_list_order(spark, corpus):
    rows = records.read_psv(spark, corpus, recordsPerPartition=3).orderBy("file_id", "rec_idx").collect()
    assert [(r.file_id, r.rec_idx) for r in rows] == [(0, i) for i in range(10)] + [(1, i) for i in range(7)]
    assert [r.score for r in rows] == [i - 500 for i in range(17)]
    assert [r.move16 for r in rows] == [65535 - i for i in range(17)]
    assert rows[3].game_ply == 60003 and {r.game_result for r in rows} == {-1, 0, 1} and len(rows[0].sfen) == 32


def test_index_filters_prune_ranges(spark, corpus):
    df = records.read_psv(spark, corpus, recordsPerPartition=2, columns="file_id,rec_idx,score")
    assert df.columns == ["file_id", "rec_idx", "score"]
    got = df.where("rec_idx >= 3 AND rec_idx < 6 AND file_id = 1")
    assert sorted(r.score for r in got.collect()) == [-487, -486, -485]
    assert got.rdd.getNumPartitions() == 2


def test_byte_ranges_and_sizes(spark, corpus, tmp_path):
    one = corpus.split(",")[0]
    assert records.read_psv(spark, one, start=80, end=200).count() == 3
    assert records.read_psv(spark, one, start=80, end=80).count() == 0
    for bad in ({"start": 1}, {"end": 90}, {"start": 200, "end": 80}, {"end": 4000}):
        with pytest.raises(Exception, match="range"):
            records.read_psv(spark, one, **bad).count()
    odd = tmp_path / "odd.bin"
    odd.write_bytes(psv_bytes(2) + b"xyz")
    with pytest.raises(Exception, match="multiple"):
        records.read_psv(spark, str(odd)).count()
    assert records.read_psv(spark, str(odd), trailing="ignore").count() == 2
    with pytest.raises(Exception, match="expected 5"):
        records.read_psv(spark, one, expectedRecords=5).count()


def test_extension_chooses_the_format(spark, tmp_path):
    path = tmp_path / "x.hcpe"
    rows = np.zeros(3, records.LAYOUTS["hcpe"])
    rows["score"], rows["result"] = [-3, 0, 9], [0, 1, 2]
    path.write_bytes(rows.tobytes())
    got = records.read_records(spark, str(path)).orderBy("rec_idx").collect()
    assert [(r.score, r.result) for r in got] == [(-3, 0), (0, 1), (9, 2)]


def test_write_is_published_on_commit(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(1000).select(F.col("id").alias("rec_idx"), F.col("id").cast("double").alias("w"))
    records.write_records(df, path, "f64", ["rec_idx"], files=3)
    names = sorted(os.listdir(path))
    assert "_SUCCESS" in names and not any(n.endswith(".tmp") for n in names)
    back = records.read_records(spark, path, record="f64", expectedRecords=1000)
    assert [r.w for r in back.orderBy("file_id", "rec_idx").collect()] == [float(i) for i in range(1000)]


def test_snapshots_show_only_complete_ones(spark, tmp_path):
    base = str(tmp_path)
    doc = spark.createDataFrame([("r1",)], "id string")
    first = documents.write_snapshot(doc, base)
    os.makedirs(f"{base}/v0000000002")  # a write that never finished
    assert documents.latest_snapshot(base) == first
    third = documents.write_snapshot(doc, base)
    assert third.endswith("v0000000003") and documents.latest_snapshot(base) == third


def test_run_document_with_absent_keys(spark, tmp_path):
    (tmp_path / "run.json").write_text(
        '{"schema_version": 1, "id": "a", "date": "2024-05-01T10:00:00Z", "params": {"lr": 0.001},\n'
        ' "history": [{"superbatch": 1, "loss": 0.5}, {"superbatch": 2, "loss": 0.4, "test_loss": 0.45}]}'
    )
    docs = documents.read_run_documents(spark, str(tmp_path))
    row = docs.first()
    assert row.lineage is None and row.params.lr == 0.001 and row.params.batch_size is None and row.started_at.year == 2024
    assert [(h.superbatch, h.test_loss) for h in documents.run_history(docs).orderBy("superbatch").collect()] == [(1, None), (2, 0.45)]


def test_log_lines(spark, tmp_path):
    (tmp_path / "log.txt").write_text(
        "[train] superbatch 1/3 | loss 0.1 | 1000000 pos/s | lr 1e-3\n[train] superbatch 2/3 | loss 0.1 | 1200000 pos/s | lr 1e-3\r"
        "[train] superbatch 3/3 | loss 0.1 | 1400000 pos/s | lr 1e-3\n[train] superbatch z/3 | 5 pos/s\nother 7 pos/s\n"
    )
    rows = documents.read_train_log(spark, str(tmp_path)).orderBy("superbatch").collect()
    assert [(r.superbatch, r.pos_per_sec) for r in rows] == [(1, 1e6), (2, 1.2e6), (3, 1.4e6)]


def test_latest_k_compares_numbers(spark):
    names = spark.createDataFrame([(n,) for n in ("net-9.bin", "net-10.bin", "net-2.bin", "other", "b-1.bin")], "f string")
    kept = versions.keep_latest_k(names, "f", r"^(.+)-(\d+)\.bin$", 2)
    assert sorted(r.name for r in kept.collect()) == ["b-1.bin", "net-10.bin", "net-9.bin"]
    with pytest.raises(ValueError):
        versions.keep_latest_k(names, "f", r"(a)(1)", 0)


def test_stream_keeps_a_snapshot_per_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    for part in range(3):
        spark.range(10).select((F.col("id") % 3).alias("v")).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("v bigint").option("maxFilesPerTrigger", 1).parquet(src)
    every = snapshots.snapshots(snapshots.active_histogram(stream, F.col("v")), "t").groupBy("batch").agg(F.sum("n").alias("n"))
    assert sorted(r.n for r in every.collect()) == [10, 20, 30]


def test_epochs_are_replaced_not_doubled(spark, tmp_path):
    path = str(tmp_path / "w")
    w = spark.range(5).select(F.col("id").alias("idx"), F.lit(1.0).alias("w"))
    for e in (1, 2, 2):
        documents.write_epoch_weights(w, path, e)
    assert documents.final_weights(spark, path).count() == 5 and spark.read.parquet(path).count() == 10


def test_appends_keep_every_record_in_order(spark, tmp_path):
    path = str(tmp_path / "out")
    part = lambda a, b: spark.range(a, b).select(F.col("id").alias("rec_idx"), F.col("id").cast("double").alias("w"))
    records.write_records(part(0, 100), path, "f64", ["rec_idx"], files=3)
    records.write_records(part(100, 140), path, "f64", ["rec_idx"], files=2)
    back = records.read_records(spark, path, record="f64", columns="global_idx,w", recordsPerPartition=7)
    assert [(r.global_idx, r.w) for r in back.orderBy("global_idx").collect()] == [(i, float(i)) for i in range(140)]


def test_global_number_needs_no_shuffle(spark, corpus):
    rows = records.read_psv(spark, corpus, columns="file_id,rec_idx,global_idx,score", recordsPerPartition=4)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    got = rows.orderBy("global_idx").collect()
    assert [r.global_idx for r in got] == list(range(17)) and [r.score for r in got] == [i - 500 for i in range(17)]
    assert [r.global_idx for r in rows.where("file_id = 1 AND rec_idx >= 3").orderBy("rec_idx").collect()] == [13, 14, 15, 16]


def test_over_long_versions_are_ignored(spark):
    names = spark.createDataFrame([("a-1.bin",), ("a-99999999999999999999.bin",), ("a-2.bin",)], "n string")
    assert sorted(r.name for r in versions.keep_latest_k(names, "n", r"^(a)-(\d+)\.bin$", 5).collect()) == ["a-1.bin", "a-2.bin"]


def test_schemes_of_other_stores():
    from kifulake.sources import files

    assert files.filesystem("file:///tmp/x")[1] == "/tmp/x" and files.filesystem("/tmp/x")[1] == "/tmp/x"
    assert files.SCHEMES["s3a"] == "s3"


def test_scratch_must_be_shared_off_a_local_master(monkeypatch):
    from kifulake import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(Session())


def test_log_without_a_line_is_refused(spark, tmp_path):
    (tmp_path / "log.txt").write_text("nothing here\n")
    with pytest.raises(ValueError, match="throughput"):
        documents.read_train_log(spark, str(tmp_path))


def test_all_parameters_are_declared(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"id": "a", "params": {"l2": 32, "prune_seed": 18446744073709551615, "tf32": true, "threads": 4, "wrm_pow_exp": 2.5}}')
    p = documents.read_run_documents(spark, str(tmp_path)).first().params
    assert len(p) == 59 and (p.l2, int(p.prune_seed), p.tf32, p.threads, p.wrm_pow_exp, p.lr) == (32, 2**64 - 1, True, 4, 2.5, None)


def test_durations(spark):
    from kifulake.functions import times

    rows = [(42.9,), (725.0,), (5025.0,), (0.0,), (-1.0,), (float("inf"),), (float("nan"),), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "s double").select(times.duration(F.col("s"))).collect()]
    assert got == ["42s", "12m05s", "1h23m45s", "0s", "??", "??", "??", "??"]


def test_byte_range_over_listed_files(spark, tmp_path):
    import numpy as np

    layout = records.LAYOUTS["psv"]
    for i, n in enumerate((3, 0, 5, 2)):
        rows = np.zeros(n, layout)
        rows["score"] = np.arange(n) + 100 * i
        (tmp_path / f"f{i}.bin").write_bytes(rows.tobytes())
    listed = ",".join(str(tmp_path / f"f{i}.bin") for i in (2, 0, 1, 3))  # list order, not name order
    every = [200, 201, 202, 203, 204, 0, 1, 2, 300, 301]
    for low, high in [(0, 10), (4, 9), (5, 5), (5, 8), (9, 10)]:
        got = records.read_psv(spark, listed, start=low * layout.itemsize, end=high * layout.itemsize, columns="global_idx,score").collect()
        assert sorted((r.global_idx, r.score) for r in got) == list(enumerate(every))[low:high]
    for start, end in [(1, 40), (0, 41), (0, 440)]:
        with pytest.raises(Exception, match="byte range"):
            records.read_psv(spark, listed, start=start, end=end, columns="score").collect()


def test_prune_is_repeatable_and_leaves_other_files(spark, tmp_path):
    base = str(tmp_path / "kept")
    assert versions.prune(spark, base, r"^(a)-(\d+)$", 2) == 0
    for name in ("net-1", "net-2", "net-10", "other-3", "notes.txt", "_marker-9"):
        (tmp_path / "kept" / name).mkdir(parents=True)
        (tmp_path / "kept" / name / "w").write_text("x")
    (tmp_path / "kept" / "net-4").write_text("a plain file")
    there = versions.list_versions(spark, base)
    assert versions.prune(spark, base, r"^(.+)-(\d+)$", 2) == 2 and versions.prune(spark, base, r"^(.+)-(\d+)$", 2) == 0
    assert sorted(p.name for p in (tmp_path / "kept").iterdir()) == ["_marker-9", "net-10", "net-4", "notes.txt", "other-3"]
    assert versions.remove(there.where("name IN ('net-1', 'net-2')"), base) == 2  # gone already: no error


def test_quarantine_counts_in_the_pass_that_writes(spark, tmp_path):
    decoded = spark.createDataFrame(
        [(1, None), (2, "code"), (3, None), (4, "game result"), (5, "code")], "pos_id long, error string"
    ).withColumn("raw", F.lit(None).cast("binary"))
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    counted = decoded.mapInArrow(seen, decoded.schema)
    sound, rejected, counters = boards.write_quarantine(counted, str(tmp_path / "q"))
    assert {k: v for k, v in counters.items() if v} == {"sound": 2, "code": 2, "game result": 1}
    assert sorted(r.pos_id for r in sound.collect()) == [1, 3] and sound.columns == ["pos_id"]
    assert sorted((r.pos_id, r.error) for r in rejected.collect()) == [(2, "code"), (4, "game result"), (5, "code")]
    assert reads.value == 5


def test_null_text_is_rejected(spark):
    rows = spark.createDataFrame([(None,), ("startpos",)], "sfen_text string")
    assert [r.error for r in boards.sfen_to_positions(rows).collect()] == ["no board", None]
