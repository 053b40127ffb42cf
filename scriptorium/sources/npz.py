"""Sparse matrices as NPZ files, read and written by Spark's Python data source interface (SC6, SK2).

A file holds one block of rows in CSR form, in the members that NumPy users expect:
`matrix_data`, `matrix_indices`, `matrix_indptr` and `matrix_shape`; a matrix is one such file or a
directory of them. A vocabulary is `vocabulary_terms` and `idf`, in the same file or in blocks of
its own. Arrays with Python objects are refused: nothing is ever unpickled.

Reading is split by ranges of rows: a task looks at its piece of the row pointers and streams the
entries between them. Members of uncompressed files are reached by seeking; in compressed ones a
task skips what is before its range. Writing makes a file a block, beside the target; the commit
moves whole blocks into place, so a lost task leaves nothing and its repetition the same.
"""

from __future__ import annotations

import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .store import from_tasks

FORMAT = "csr_npz"
#: Rows that one task reads, rows and terms of one written file, and entries that go to Spark at a time.
SPLIT_ROWS, BLOCK, BATCH = 65536, 65536, 1 << 18
SCHEMAS = {"matrix": "row long, col long, value double", "vocabulary": "term_id long, term string, idf double"}


def _store(path: str) -> tuple[files.FileSystem, str]:
    if (found := from_tasks(path)) is None:
        raise OSError(f"no file system of tasks reaches {path}")
    return found


class _Member:
    """A one-dimensional array of a zip file, read in pieces."""

    def __init__(self, archive: zipfile.ZipFile, name: str):
        self._stream = archive.open(f"{name}.npy")
        version = np.lib.format.read_magic(self._stream)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        self.shape, _, self.dtype = read(self._stream)
        if self.dtype.hasobject:
            raise ValueError(f"{name} holds Python objects")
        self._start = self._stream.tell()

    def piece(self, low: int, high: int) -> np.ndarray:
        self._stream.seek(self._start + low * self.dtype.itemsize)
        size = (high - low) * self.dtype.itemsize
        raw = self._stream.read(size)
        if len(raw) != size:
            raise ValueError("an array ends too early")
        return np.frombuffer(raw, self.dtype)


@dataclass
class _Range(InputPartition):
    file: str = ""
    low: int = 0
    high: int = 0
    offset: int = 0

    def __post_init__(self):
        super().__init__((self.file, self.low, self.high))


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, split: int):
        self.path, self.table, self.split = path, table, split

    def partitions(self) -> list[InputPartition]:
        """Ranges of rows, from the headers alone."""
        store, path = _store(self.path)
        found = store.get_file_info(path)
        if found.type == files.FileType.NotFound:
            raise FileNotFoundError(self.path)
        names = [path] if found.is_file else sorted(f.path for f in store.get_file_info(files.FileSelector(path)) if re.match(r"[^._].*\.npz$", posixpath.basename(f.path)))
        out = []
        for name in names:
            with store.open_input_file(name) as raw, zipfile.ZipFile(raw) as archive:
                if self.table == "vocabulary":
                    n = _Member(archive, "vocabulary_terms").shape[0]
                else:
                    n = _Member(archive, "matrix_indptr").shape[0] - 1
                offset = int(_Member(archive, "first_row").piece(0, 1)[0]) if "first_row.npy" in archive.namelist() else 0
            out += [_Range(name, low, min(low + self.split, n), offset) for low in range(0, n, self.split)]
        return out or [_Range()]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if not part.file:
            return
        store, _ = _store(self.path)
        with store.open_input_file(part.file) as raw, zipfile.ZipFile(raw) as archive:
            if self.table == "vocabulary":
                yield from self._terms(archive, part)
            else:
                yield from self._entries(archive, part)

    def _terms(self, archive: zipfile.ZipFile, part: _Range) -> Iterator[pa.RecordBatch]:
        terms, idf = (_Member(archive, name).piece(part.low, part.high) for name in ("vocabulary_terms", "idf"))
        ids = np.arange(part.low, part.high, dtype=np.int64) + part.offset
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(terms.tolist(), pa.string()), pa.array(idf.astype(np.float64))], names=["term_id", "term", "idf"])

    def _entries(self, archive: zipfile.ZipFile, part: _Range) -> Iterator[pa.RecordBatch]:
        ends = _Member(archive, "matrix_indptr").piece(part.low, part.high + 1).astype(np.int64)
        if (np.diff(ends) < 0).any():
            raise ValueError("row pointers fall")
        data, indices = _Member(archive, "matrix_data"), _Member(archive, "matrix_indices")
        for low in range(int(ends[0]), int(ends[-1]), BATCH):
            high = min(low + BATCH, int(ends[-1]))
            rows = np.searchsorted(ends, np.arange(low, high), side="right") - 1 + part.low + part.offset
            yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int64)), pa.array(indices.piece(low, high).astype(np.int64)), pa.array(data.piece(low, high).astype(np.float64))], names=["row", "col", "value"])


@dataclass
class _Written(WriterCommitMessage):
    names: list[str] = field(default_factory=list)


class _Writer(DataSourceArrowWriter):
    """Rows must come sorted, and those of a block together, as `write_matrix` and `write_vocabulary` deal them."""

    def __init__(self, path: str, table: str, block: int, rows: int, columns: int, overwrite: bool):
        self.path, self.table, self.block, self.rows, self.columns, self.overwrite = path, table, block, rows, columns, overwrite
        self.aside = f"_writing-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, path = _store(self.path)
        folder = f"{path}/{self.aside}/{uuid.uuid4().hex}"
        store.create_dir(folder, recursive=True)
        done, held, now = [], [], None
        for batch in batches:
            of = batch.column(0).to_numpy() // self.block
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)] if len(of) else [0]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if now is not None and of[low] != now:
                    done.append(self._save(store, folder, now, held))
                    held = []
                now = int(of[low])
                held.append(batch.slice(low, high - low))
        if held:
            done.append(self._save(store, folder, now, held))
        return _Written(done)

    def _save(self, store: files.FileSystem, folder: str, number: int, held: list[pa.RecordBatch]) -> str:
        first = number * self.block
        columns = [np.concatenate([np.asarray(b.column(i).to_pylist() if pa.types.is_string(b.column(i).type) else b.column(i).to_numpy()) for b in held]) for i in range(3)]
        if (np.diff(columns[0]) < 0).any():
            raise ValueError("rows are to be in order")
        members = {"first_row": np.array([first], dtype=np.int64)}
        if self.table == "vocabulary":
            if (columns[0] != np.arange(first, first + len(columns[0]))).any():
                raise ValueError("term ids are to be dense from 0")
            members |= {"vocabulary_terms": columns[1].astype(np.str_), "idf": columns[2]}
        else:
            n = max(min(self.block, self.rows - first), int(columns[0].max()) - first + 1)
            members |= {"matrix_data": columns[2], "matrix_indices": columns[1].astype(np.int32 if self.columns < 2**31 else np.int64), "matrix_indptr": np.searchsorted(columns[0], np.arange(first, first + n + 1)).astype(np.int64), "matrix_shape": np.array([n, self.columns], dtype=np.int64)}
        name = f"{folder}/block-{number:09d}.npz"
        with store.open_output_stream(name) as out:
            np.savez_compressed(out, **members)
        return name

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, path = _store(self.path)
        blocks = [posixpath.basename(n) for m in messages if m is not None for n in m.names]
        if len(set(blocks)) < len(blocks):
            self._clear()
            raise ValueError("rows of one block came from two tasks")
        if self.overwrite:
            for old in store.get_file_info(files.FileSelector(path)):
                if old.is_file and old.path.endswith(".npz"):
                    store.delete_file(old.path)
        for name in (n for m in messages if m is not None for n in m.names):
            store.move(name, f"{path}/{posixpath.basename(name)}")
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, path = _store(self.path)
        if store.get_file_info(f"{path}/{self.aside}").type == files.FileType.Directory:
            store.delete_dir(f"{path}/{self.aside}")


class CsrNpz(DataSource):
    """Options: path; table (matrix or vocabulary); splitRows; for writing, blockRows, rows and columns."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _of(self) -> str:
        table = self.options.get("table", "matrix")
        if table not in SCHEMAS:
            raise ValueError(f"unknown table {table!r}")
        return table

    def schema(self) -> str:
        return SCHEMAS[self._of()]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self._of(), int(self.options.get("splitRows", SPLIT_ROWS)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self._of(), int(self.options.get("blockRows", BLOCK)), int(self.options.get("rows", 0)), int(self.options.get("columns", 0)), overwrite)


def read(spark: SparkSession, path: str, table: str = "matrix", split: int = SPLIT_ROWS) -> DataFrame:
    """SC6: (row, col, value) of a matrix, or (term_id, term, idf) of a vocabulary: of one NPZ file or a directory of blocks."""
    spark.dataSource.register(CsrNpz)
    return spark.read.format(FORMAT).option("table", table).option("splitRows", split).load(path)


def named_entries(rows: DataFrame, terms: DataFrame, path: str, block: int, parts: int) -> DataFrame:
    """(name, term, value) of a directory of blocks: rows (row, name) and terms (_part, col, term), those that block `_part` has.

    Names and terms go to the task that reads their block; no entry of the matrix moves.
    """
    part = F.floor(F.col("row") / block).cast("int").alias("_part")
    names = rows.select(part, F.col("row").cast("long").alias("at"), F.lit(False).alias("is_term"), F.col("name").alias("told"))
    both = names.unionByName(terms.select("_part", F.col("col").cast("long").alias("at"), F.lit(True).alias("is_term"), F.col("term").alias("told")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        at, is_term, told = table["at"].to_numpy(), table["is_term"].to_numpy(), table["told"].combine_chunks()
        (row, name), (col, term) = (_sorted(at, told, np.flatnonzero(which)) for which in (~is_term, is_term))
        store, folder = _store(path)
        for number in np.unique(row // block).tolist():
            file = f"{folder}/block-{number:09d}.npz"
            if store.get_file_info(file).type == files.FileType.NotFound:  # a block without entries has no file
                continue
            with store.open_input_file(file) as raw, zipfile.ZipFile(raw) as archive:
                n = _Member(archive, "matrix_indptr").shape[0] - 1
            for batch in _Reader(path, "matrix", block).read(_Range(file, 0, n, number * block)):
                yield pa.RecordBatch.from_arrays([name.take(_places(row, batch.column(0))), term.take(_places(col, batch.column(1))), batch.column(2)], names=["name", "term", "value"])

    return both.repartitionById(parts, F.col("_part")).select("at", "is_term", "told").mapInArrow(run, "name string, term string, value double")


def _sorted(at: np.ndarray, told: pa.Array, which: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    order = which[np.argsort(at[which])]
    return at[order], told.take(pa.array(order))


def _places(known: np.ndarray, wanted: pa.Array) -> pa.Array:
    found = np.searchsorted(known, wanted.to_numpy())
    if len(found) and (not len(known) or (known[np.minimum(found, len(known) - 1)] != wanted.to_numpy()).any()):
        raise ValueError("an entry has no name or no term")
    return pa.array(found)


def _write(df: DataFrame, order: list[str], path: str, table: str, block: int, placed: bool = False, **options) -> None:
    df.sparkSession.dataSource.register(CsrNpz)
    dealt = df if placed else df.repartition(F.floor(F.col(order[0]) / block)).sortWithinPartitions(*order)
    write = dealt.write.format(FORMAT).mode("overwrite").option("table", table).option("blockRows", block)
    for k, v in options.items():
        write = write.option(k, v)
    write.save(path)


def write_matrix(entries: DataFrame, path: str, rows: int, columns: int, block: int = BLOCK, placed: bool = False) -> None:
    """SK2: entries (row, col, value), no null, of a matrix of that many rows and columns, as CSR blocks. Rows without entries need none.

    `placed` where the entries of a block are in one partition, in order, as they come.
    """
    each = entries.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value"))
    _write(each, ["row", "col"], path, "matrix", block, placed, rows=rows, columns=columns)


def write_vocabulary(vocab: DataFrame, path: str, block: int = BLOCK) -> None:
    """SK2: (term_id, term, idf), term ids dense from 0, as blocks."""
    each = vocab.select(F.col("term_id").cast("long").alias("term_id"), "term", F.col("idf").cast("double").alias("idf"))
    _write(each, ["term_id"], path, "vocabulary", block)
