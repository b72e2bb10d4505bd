"""Fixed-size binary record files as a Spark data source, for reading and writing.

``spark.read.format("position_records").load(path)`` plans byte ranges aligned to whole
records, so one huge file is read by many tasks; record indices come from the byte position
and need no pass over the data, nor do global numbers (``global_idx``: file sizes in list order
before the file, plus the place in it). ``df.write.format("position_records")`` writes one file per
partition, named by write and partition, and publishes them only on commit; a later append
sorts behind what is there. ``spark.readStream`` follows a folder as files come: offsets are a file
and a record in it, so that a query that stops goes on from its checkpoint in mid-file.

Options: ``record`` (psv, hcpe or f64; default by file extension), ``start`` and ``end``
(aligned byte range of the listed files, one behind the other), ``trailing`` (error or ignore), ``columns`` (comma list;
unlisted fields are never built), ``recordsPerPartition``, ``expectedRecords``; for streams ``recordsPerTrigger``.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import itertools
import re

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from .files import filesystem, list_files, qualified

FORMAT = "position_records"
CHUNK = 65_536  # records per Arrow batch
PER_PARTITION = 4_000_000  # 160 MB of 40-byte records
COMMIT_THREADS = 16  # renames at a time
MAX_PARTITIONS = 100_000  # the driver plans one object each; ranges grow beyond that many

# Record layouts, little endian.
LAYOUTS = {
    "psv": np.dtype(
        [("sfen", "V32"), ("score", "<i2"), ("move16", "<u2"), ("game_ply", "<u2"), ("game_result", "i1"), ("pad", "u1")]
    ),
    "hcpe": np.dtype([("pos", "V32"), ("score", "<i2"), ("move16", "<u2"), ("result", "u1"), ("pad", "u1")]),
    "f64": np.dtype([("w", "<f8")]),
}
FIELDS = {
    "psv": {"sfen": "binary", "score": "smallint", "move16": "int", "game_ply": "int", "game_result": "tinyint"},
    "hcpe": {"pos": "binary", "score": "smallint", "move16": "int", "result": "int"},
    "f64": {"w": "double"},
}
_ARROW = {
    "binary": pa.binary(), "smallint": pa.int16(), "int": pa.int32(), "tinyint": pa.int8(), "double": pa.float64(),
}


def record_kind(path: str, options) -> str:
    kind = options.get("record") or ("hcpe" if path.split(",")[0].strip().endswith(".hcpe") else "psv")
    if kind not in LAYOUTS:
        raise ValueError(f"unknown record kind {kind!r}")
    return kind


@dataclass
class RecordRange(InputPartition):
    path: str
    file_id: int
    start: int  # record numbers within the file
    end: int
    before: int = 0  # records in earlier files


class RecordReader(DataSourceReader):
    def __init__(self, kind: str, columns: list[str], options):
        self.kind, self.columns, self.options = kind, columns, options
        self.low, self.high, self.files = None, None, None

    def pushFilters(self, filters):
        """Record-index bounds and file numbers prune ranges before anything is read."""
        for f in filters:
            name = getattr(f, "attribute", None)
            if name == ("rec_idx",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                low = f.value + isinstance(f, GreaterThan)
                self.low = low if self.low is None else max(self.low, low)
            elif name == ("rec_idx",) and isinstance(f, (LessThan, LessThanOrEqual)):
                high = f.value + isinstance(f, LessThanOrEqual)
                self.high = high if self.high is None else min(self.high, high)
            elif name == ("file_id",) and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.files = wanted if self.files is None else self.files & wanted
            else:
                yield f

    def partitions(self):
        opts, size_of = self.options, LAYOUTS[self.kind].itemsize
        files = list_files(opts["path"])
        trailing = opts.get("trailing", "error")
        if trailing not in ("error", "ignore"):
            raise ValueError("trailing must be error or ignore")
        for path, size in files:
            if size % size_of and trailing == "error":
                raise ValueError(f"{path}: size {size} is not a multiple of the {size_of}-byte record")
        ranges = [(i, path, 0, size // size_of) for i, (path, size) in enumerate(files)]
        if opts.get("start") is not None or opts.get("end") is not None:
            whole = sum(size for _, size in files)
            if len(files) > 1 and any(size % size_of for _, size in files):
                raise ValueError("a byte range over several files needs whole records in each")
            start, end = int(opts.get("start", 0)), int(opts.get("end", whole))
            if start % size_of or (end % size_of and end != whole):
                raise ValueError("byte range is not aligned to records")
            if not 0 <= start <= end <= whole:
                raise ValueError("byte range must satisfy 0 <= start <= end <= size")
            cut, at = [], 0  # bytes of the listed files, one behind the other
            for i, path, _, n in ranges:
                low, high = max(start // size_of - at, 0), min(end // size_of - at, n)
                cut += [(i, path, low, high)] if low < high else []
                at += n
            ranges = cut
        expected = opts.get("expectedrecords")
        if expected is not None and sum(r[3] - r[2] for r in ranges) != int(expected):
            raise ValueError(f"expected {expected} records, found {sum(r[3] - r[2] for r in ranges)}")
        total = sum(size // size_of for _, size in files)
        per = int(opts.get("recordsperpartition", max(PER_PARTITION, -(-total // MAX_PARTITIONS))))
        parts, firsts = [], [0, *itertools.accumulate(size // size_of for _, size in files)]
        for file_id, path, start, end in ranges:
            base = firsts[file_id]
            if self.files is not None and file_id not in self.files:
                continue
            start = start if self.low is None else max(start, self.low)
            end = end if self.high is None else min(end, self.high)
            parts += [RecordRange(path, file_id, s, min(s + per, end), base) for s in range(start, end, per)]
        return parts or [RecordRange("", 0, 0, 0)]

    def read(self, part: RecordRange) -> Iterator[pa.RecordBatch]:
        if part.start >= part.end:
            return
        layout = LAYOUTS[self.kind]
        fs, inner = filesystem(part.path)
        with fs.open_input_file(inner) as f:
            f.seek(part.start * layout.itemsize)
            at = part.start
            while at < part.end:
                n = min(CHUNK, part.end - at)
                data = f.read(n * layout.itemsize)
                if len(data) != n * layout.itemsize:
                    raise OSError(f"{part.path} ended early at record {at}")
                yield self._batch(np.frombuffer(data, layout), part.file_id, at, part.before)
                at += n

    def _batch(self, rows: np.ndarray, file_id: int, at: int, before: int) -> pa.RecordBatch:
        n, kinds = len(rows), FIELDS[self.kind]
        cols = {}
        for c in self.columns:
            if c == "file_id":
                cols[c] = pa.array(np.full(n, file_id, np.int32))
            elif c == "rec_idx":
                cols[c] = pa.array(np.arange(at, at + n, dtype=np.int64))
            elif c == "global_idx":
                cols[c] = pa.array(np.arange(before + at, before + at + n, dtype=np.int64))
            elif kinds[c] == "binary":
                width = rows.dtype[c].itemsize
                fixed = np.ascontiguousarray(rows[c]).tobytes()
                cols[c] = pa.Array.from_buffers(pa.binary(width), n, [None, pa.py_buffer(fixed)]).cast(pa.binary())
            else:
                cols[c] = pa.array(np.ascontiguousarray(rows[c])).cast(_ARROW[kinds[c]])
        return pa.RecordBatch.from_pydict(cols)


class RecordStream(DataSourceStreamReader):
    """The records of a growing list of files, in list order.

    An offset ``{file, record, name}`` stands for all files before number ``file`` and the first
    ``record`` records of it. The last file may still grow, by whole records; new files must sort
    behind it, as those of the sink do, else the query fails rather than skip or repeat any.
    ``recordsPerTrigger`` bounds a micro-batch, counted from what this reader has handed out: the first
    batch after a restart takes all that has come meanwhile.
    """

    def __init__(self, kind: str, columns: list[str], options):
        self.reader, self.options, self.at = RecordReader(kind, columns, options), options, None
        self.size_of = LAYOUTS[kind].itemsize

    def _files(self) -> list[tuple[str, int]]:
        try:
            return [(path, size // self.size_of) for path, size in list_files(self.options["path"])]
        except FileNotFoundError:  # nothing has come yet
            return []

    def initialOffset(self) -> dict:
        self.at = {"file": 0, "record": 0, "name": ""}
        return self.at

    def latestOffset(self) -> dict:
        files = self._files()
        if not files:
            return self.at or self.initialOffset()
        file, record = len(files) - 1, files[-1][1]
        most = self.options.get("recordspertrigger")
        if most is not None and self.at is not None:
            file, record, left = self.at["file"], self.at["record"], int(most)
            while True:
                take = min(left, files[file][1] - record)
                record, left = record + take, left - take
                if not left or file + 1 == len(files):
                    break
                file, record = file + 1, 0
        self.at = {"file": file, "record": record, "name": _name(files[file][0])}
        return self.at

    def partitions(self, start: dict, end: dict):
        files, self.at = self._files(), end
        for offset in (start, end):
            if offset["name"] and (offset["file"] >= len(files) or _name(files[offset["file"]][0]) != offset["name"]):
                raise ValueError(f"{offset['name']} is no longer file {offset['file']}: a file was removed, or one came that sorts before it")
        per = int(self.options.get("recordsperpartition", PER_PARTITION))
        parts, before = [], sum(n for _, n in files[: start["file"]])
        for i in range(start["file"], min(end["file"] + 1, len(files))):
            path, n = files[i]
            low = start["record"] if i == start["file"] else 0
            high = end["record"] if i == end["file"] else n
            if high > n:
                raise ValueError(f"{path} has become shorter than what was read of it")
            parts += [RecordRange(path, i, s, min(s + per, high), before) for s in range(low, high, per)]
            before += n
        return parts

    def read(self, part: RecordRange) -> Iterator[pa.RecordBatch]:
        return self.reader.read(part)


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str
    records: int


class RecordWriter(DataSourceArrowWriter):
    """Each task writes its own temporary file; the commit on the driver renames them all.

    A task that runs twice leaves a second temporary file, never a second visible one. Names carry the
    number of the write, one above any that is there when it is planned, then the partition: name
    order is write order. A name that exists at commit (two writes at once) is refused, never replaced.
    """

    def __init__(self, kind: str, path: str, overwrite: bool):
        self.kind, self.path, self.overwrite = kind, path, overwrite
        fs, base = filesystem(path)
        found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
        taken = [int(m[1]) for f in found if (m := re.match(r"part-(\d+)-", f.base_name))]
        self.write_no = max(taken, default=-1) + 1

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        layout, ctx = LAYOUTS[self.kind], TaskContext.get()
        fs, base = filesystem(self.path)
        fs.create_dir(base, recursive=True)
        final = f"{base}/part-{self.write_no:06d}-{ctx.partitionId():06d}.{self.kind}"
        temporary = f"{base}/_{self.write_no:06d}-{ctx.partitionId():06d}-{ctx.taskAttemptId()}.tmp"
        n = 0
        with fs.open_output_stream(temporary) as out:
            for batch in iterator:
                rows = np.zeros(batch.num_rows, layout)
                for c, kind in FIELDS[self.kind].items():
                    col = batch.column(batch.schema.get_field_index(c)) if c in batch.schema.names else None
                    if col is None:
                        continue
                    if kind == "binary":
                        fixed = col.cast(pa.binary(layout[c].itemsize))
                        raw = np.frombuffer(fixed.buffers()[1], layout[c])
                        rows[c] = raw[fixed.offset : fixed.offset + len(fixed)]
                    else:
                        rows[c] = np.asarray(col)
                out.write(rows.tobytes())
                n += batch.num_rows
        return Written(temporary, final, n)

    def commit(self, messages) -> None:
        fs, base = filesystem(self.path)
        if self.overwrite:
            keep = {m.temporary for m in messages if m}
            for old in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
                if old.is_file and old.path not in keep and not old.base_name.endswith(".tmp"):
                    fs.delete_file(old.path)
        moves = [m for m in messages if m and m.records]
        taken = [f.path for f in fs.get_file_info([m.final for m in moves]) if f.type != pafs.FileType.NotFound] if moves else []
        if taken:
            raise FileExistsError(f"another write has published {taken[0]}")
        with ThreadPoolExecutor(COMMIT_THREADS) as pool:
            list(pool.map(lambda m: fs.move(m.temporary, m.final), moves))
            list(pool.map(lambda m: fs.delete_file(m.temporary), [m for m in messages if m and not m.records]))
        fs.open_output_stream(f"{base}/_SUCCESS").close()

    def abort(self, messages) -> None:
        fs, _ = filesystem(self.path)
        for m in messages:
            if m:
                fs.delete_file(m.temporary)


class PositionRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _columns(self) -> tuple[str, list[str]]:
        kind = record_kind(self.options.get("path", ""), self.options)
        every = ["file_id", "rec_idx", "global_idx", *FIELDS[kind]]
        wanted = self.options.get("columns")
        picked = [c.strip() for c in wanted.split(",")] if wanted else [c for c in every if c != "global_idx"]
        unknown = [c for c in picked if c not in every]
        if unknown:
            raise ValueError(f"unknown columns {unknown} for {kind} records")
        return kind, picked

    def schema(self) -> str:
        kind, columns = self._columns()
        types = {"file_id": "int", "rec_idx": "bigint", "global_idx": "bigint", **FIELDS[kind]}
        return ", ".join(f"{c} {types[c]}" for c in columns)

    def reader(self, schema) -> DataSourceReader:
        kind, columns = self._columns()
        return RecordReader(kind, columns, {k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> DataSourceStreamReader:
        kind, columns = self._columns()
        return RecordStream(kind, columns, {k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool):
        path = self.options["path"]
        return RecordWriter(record_kind(path, self.options), path, overwrite)


def _register(spark):
    # the reader prunes by record index; Spark asks for this switch before it may
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PositionRecords)


def read_records(spark, path: str, **options):
    """Records of one or more files, in list order, with ``file_id`` and ``rec_idx``.

    ``columns`` may also ask for ``global_idx``, the record's number over all files.
    """
    _register(spark)
    return spark.read.format(FORMAT).options(path=qualified(spark, path), **{k: str(v) for k, v in options.items()}).load()


def stream_records(spark, path: str, **options):
    """The records of files that arrive, as a stream; columns and options as in :func:`read_records`."""
    _register(spark)
    return spark.readStream.format(FORMAT).options(path=qualified(spark, path), **{k: str(v) for k, v in options.items()}).load()


def read_psv(spark, path: str, **options):
    return read_records(spark, path, record="psv", **options)


def read_hcpe(spark, path: str, **options):
    return read_records(spark, path, record="hcpe", **options)


def write_records(
    df, path: str, record: str, order: list[str] | None = None, files: int | None = None, ranged: bool = False
) -> None:
    """Write record files whose list order is ``order`` (range-partitioned, sorted inside).

    Range partitioning samples its input, which computes it twice. Cut costly rows into ranges
    before the costly step and say ``ranged``: then they are only sorted inside.
    """
    _register(df.sparkSession)
    if order and not ranged:
        df = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    if order:
        df = df.sortWithinPartitions(*order)
    fields = [c for c in FIELDS[record] if c in df.columns]
    df.select(*fields).write.format(FORMAT).mode("append").options(path=qualified(df.sparkSession, path), record=record).save()

