"""Token ids in Arrow stream files of fixed-size lists, and their reader.

The documents are dealt by ranges of doc_id, so file k holds the ids of the k-th range, one document after another.
A file is an Arrow IPC stream of record batches (ids: fixed_size_list<uint16|uint32>[length], mask:
fixed_size_list<bool>[length]); every row is one training sequence, the last row of a file is filled up with zeros,
and the mask tells real ids from filling. Buffers are not compressed: a memory map gives sequence i without a copy.
Beside it lie two more Arrow stream files: the documents' ids and token counts, and where each record batch begins, so
that a reader goes to the batch that it wants at once.

Text is shuffled once (by range); ids are never shuffled. A task writes under a name of its own attempt and renames,
so a lost or repeated task leaves a whole file. The driver gets one row for each file, never one for each document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweft.llm._common import scratch, small_batches, table, text_of
from lumenweft.llm._tokenizers import encoder

SEQUENCE_LENGTH = 2048
#: Sequences in a record batch of a file: 2 MB of 16-bit ids.
BATCH_SEQUENCES = 512


def _open(path: str):
    """The file system that holds path, and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class SequenceWriter:
    """Cuts a stream of ids into sequences of one length and writes them as record batches."""

    def __init__(self, sink, length: int, kind: str, rows: int = BATCH_SEQUENCES) -> None:
        self.length, self.kind, self.rows = length, kind, rows
        self.item = pa.uint16() if kind == "<u2" else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(self.item, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink, self.out = sink, pa.ipc.new_stream(sink, self.schema)
        self.begins: list[int] = []  # where each record batch is in the file
        self.parts: list[bytes] = []
        self.held = 0
        self.size = int(kind[-1])

    def add(self, ids: bytes) -> None:
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= self.rows * self.length * self.size:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        import numpy as np

        data, step = b"".join(self.parts), self.rows * self.length * self.size  # whole batches, so that their rows can be counted
        whole = len(data) // step * step
        rest = data[whole:]
        data, self.parts, self.held = (data, [], 0) if last else (data[:whole], [rest], len(rest))
        ids = np.frombuffer(data, self.kind)
        fill = -len(ids) % self.length
        mask = np.ones(len(ids) + fill, bool)
        if fill:
            mask[len(ids) :] = False
            ids = np.concatenate([ids, np.zeros(fill, self.kind)])
        if len(ids):
            lists = lambda x: pa.FixedSizeListArray.from_arrays(x, self.length)
            batch = pa.RecordBatch.from_arrays([lists(pa.array(ids, self.item)), lists(pa.array(mask))], schema=self.schema)
            for i in range(0, len(batch), self.rows):
                self.begins.append(self.sink.tell() or self.schema.serialize().size)  # the schema is written with the first batch
                self.out.write_batch(batch.slice(i, self.rows))

    def close(self) -> None:
        self._flush(True)
        self.out.close()


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, glue: bool = True, width: int = 16, length: int = SEQUENCE_LENGTH, doc_id: str = "doc_id", text: str = "text", special: bool = False) -> list[tuple[int, int, int]]:
    """Writes every whole text's ids and end_id after them, in ascending doc_id order. Returns (file number, documents, ids) by file.

    Null text: only end_id. Null doc_id: comes first. Repeated rows: each is written, one after the other. An empty
    table gives no file. width: bits of an id in the files, 16 or 32; 16 must hold the whole vocabulary. special: as in WordEncoder.
    """
    small_batches(docs.sparkSession)
    rows = text_of(docs, doc_id, text)
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        kind = f"<u{width // 8}"
        end = end_id.to_bytes(width // 8, "little")
        enc = encoder(tokenizer, glue, width, special=special)
        fs, base = _open(folder)
        writer = index = None
        n_docs = n_ids = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                fs.create_dir(base, recursive=True)
                sinks = [fs.open_output_stream(f"{base}/_{part}-{attempt}{x}") for x in (".ids", ".docs", ".begins")]
                writer = SequenceWriter(sinks[0], length, kind)
                index = pa.ipc.new_stream(sinks[1], pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())]))
            ids = [x + end for x in enc.encode(batch.column(1).to_pylist())]
            for x in ids:
                writer.add(x)
            counts = [len(x) * 8 // width for x in ids]
            index.write_batch(pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"]))
            n_docs, n_ids = n_docs + len(ids), n_ids + sum(counts)
        if writer is not None:
            writer.close()
            index.close()
            with pa.ipc.new_stream(sinks[2], pa.schema([("begin", pa.int64())])) as out:
                out.write_batch(pa.RecordBatch.from_arrays([pa.array(writer.begins, pa.int64())], ["begin"]))
            for sink, x in zip(sinks, ("ids", "docs", "begins"), strict=True):
                sink.close()
                fs.move(f"{base}/_{part}-{attempt}.{x}", f"{base}/part-{part:06d}.{x}.arrow")
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64())], ["part", "n_docs", "n_ids"])

    return sorted(tuple(r) for r in dealt.mapInArrow(run, "part bigint, n_docs bigint, n_ids bigint").collect())


def read_sequences(folder: str, part: int) -> Iterator[pa.RecordBatch]:
    """The record batches of one file, through a memory map where the file system has one."""
    fs, base = _open(folder)
    path = f"{base}/part-{part:06d}.ids.arrow"
    with pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path) as f, pa.ipc.open_stream(f) as r:
        yield from r


class SequenceFile:
    """One file, open for random access: no batch but the one that holds a sequence is read."""

    def __init__(self, folder: str, part: int, rows: int = BATCH_SEQUENCES) -> None:
        fs, base = _open(folder)
        path, self.rows = f"{base}/part-{part:06d}", rows
        with fs.open_input_file(f"{path}.begins.arrow") as f, pa.ipc.open_stream(f) as r:
            self.begins = r.read_all().column(0).to_pylist()
        self.file = pa.memory_map(f"{path}.ids.arrow") if fs.type_name == "local" else fs.open_input_file(f"{path}.ids.arrow")
        self.schema = pa.ipc.read_schema(self.file)

    def batch(self, k: int) -> pa.RecordBatch:
        self.file.seek(self.begins[k])
        return pa.ipc.read_record_batch(pa.ipc.read_message(self.file), self.schema)

    def __getitem__(self, i: int) -> tuple:
        """(ids, mask) of the i-th sequence, both views of the mapped file: a numpy array and an Arrow array of bits."""
        import numpy as np

        if not 0 <= i // self.rows < len(self.begins):
            raise IndexError(i)
        batch = self.batch(i // self.rows)
        at = i % self.rows
        if at >= len(batch):
            raise IndexError(i)
        n = batch.column(0).type.list_size
        return np.asarray(batch.column(0).values)[at * n : (at + 1) * n], batch.column(1).values.slice(at * n, n)


def sequence(folder: str, part: int, i: int, rows: int = BATCH_SEQUENCES) -> tuple:
    """(ids, mask) of the i-th sequence of a file, without a copy on a local file system."""
    return SequenceFile(folder, part, rows)[i]


def _read_documents(folder: str, part: int) -> Iterator[tuple[int | None, int, bytes]]:
    """(doc_id, n_tokens, ids as 32-bit little-endian bytes) of each document of a file, in order; filling is left out."""
    import numpy as np

    fs, base = _open(folder)
    with fs.open_input_file(f"{base}/part-{part:06d}.docs.arrow") as f, pa.ipc.open_stream(f) as r:
        index = r.read_all()
    held, size, batches = [], 0, read_sequences(folder, part)
    for doc, n in zip(index.column(0).to_pylist(), index.column(1).to_pylist(), strict=True):
        while size < n:
            batch = next(batches)
            ids = np.asarray(batch.column(0).values).astype("<u4")
            mask = batch.column(1).values
            if mask.false_count:
                ids = ids[mask.to_numpy(zero_copy_only=False)]
            held.append(ids)
            size += len(ids)
        whole = held[0] if len(held) == 1 else np.concatenate(held)
        yield doc, n, whole[:n].tobytes()
        held, size = [whole[n:]], size - n


def read(spark: SparkSession, folder: str, files: list[tuple[int, int, int]]) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, part."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, part bigint"
    if not files:
        return spark.createDataFrame([], schema)
    firsts = list(accumulate((n for _, _, n in files), initial=0))
    todo = spark.createDataFrame([(p, at) for (p, _, _), at in zip(files, firsts, strict=False)], "part bigint, first bigint").repartition(len(files))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out: list[tuple] = []
                for doc, n, ids in _read_documents(folder, part):
                    out.append((doc, start, n, zlib.crc32(ids), part))
                    start += n
                    if len(out) == 4096:
                        yield _rows(out)
                        out = []
                if out:
                    yield _rows(out)

    return todo.mapInArrow(run, schema)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32", "part"])


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    folder = scratch(spark, "token-files")
    files = write(table(spark, sf_dir, "documents"), folder, P.path("byte_bpe_50k.json"), end_id=2, special=True)
    return read(spark, folder, files)


QUERIES = {"op2_token_files": op2_token_files}
ORACLES: dict[str, str] = {}
