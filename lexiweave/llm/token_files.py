"""Token ids in Arrow IPC files: fixed-size-list batches of equal-length sequences with masks.

A shard is one contiguous range of doc_id. Its file holds record batches of ``tokens: fixed_size_list<uint16|uint32>[L]``
and ``mask: fixed_size_list<bool>[L]`` (true: a token; false: padding at the shard's end), so sequence i lies in
batch i // ROWS at row i % ROWS and a memory map gives it without a copy. A second file indexes the shard's
documents: doc_id, start within the shard, n_tokens. A retried task writes files of another name; only names in the
manifest, which Spark commits, are ever read.

Cases: a null or empty text is its end id alone; documents are in ascending doc_id order, nulls first, rows of
equal doc_id by text; an empty table gives no shard and no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encoding import encoded, encoder
from .shared import new_folder, ship, tidy, written

LENGTH = 2048
ROWS = 64
MANIFEST = "shard long, tokens_path string, index_path string, n_docs long, n_tokens long"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Appends documents' ids to one shard's pair of files."""

    def __init__(self, folder: str, name: str, width: int, length: int = LENGTH):
        self.fs, base = _open(folder)
        self.fs.create_dir(base, recursive=True)
        self.tokens_path, self.index_path = f"{folder}/{name}.tokens.arrow", f"{folder}/{name}.docs.arrow"
        self.length, self.dtype = length, "<u2" if width == 2 else "<u4"
        kind = pa.uint16() if width == 2 else pa.uint32()
        self.schema = pa.schema([("tokens", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sink, self.index_sink = self.fs.open_output_stream(f"{base}/{name}.tokens.arrow"), self.fs.open_output_stream(f"{base}/{name}.docs.arrow")
        self.out, self.index_out = pa.ipc.new_file(self.sink, self.schema), pa.ipc.new_file(self.index_sink, self.index_schema)
        self.held, self.held_n, self.rows, self.n_tokens, self.n_docs = [], 0, [], 0, 0

    def add(self, doc_id, ids) -> None:
        """ids: numpy array of the document's ids."""
        self.rows.append((doc_id, self.n_tokens, len(ids)))
        self.held.append(ids.astype(self.dtype))
        self.held_n += len(ids)
        self.n_tokens += len(ids)
        self.n_docs += 1
        if self.held_n >= self.length * ROWS:
            self._flush(False)
        if len(self.rows) >= 8192:
            self._flush_index()

    def _flush(self, last: bool) -> None:
        import numpy as np

        ids = np.concatenate(self.held) if self.held else np.empty(0, self.dtype)
        step = self.length * ROWS
        whole = len(ids) // step * step
        for at in range(0, whole, step):
            self._batch(ids[at : at + step], step)
        ids = ids[whole:]
        if last and len(ids):
            n = -(-len(ids) // self.length) * self.length
            self._batch(np.concatenate([ids, np.zeros(n - len(ids), self.dtype)]), len(ids))
            ids = ids[:0]
        self.held, self.held_n = [ids], len(ids)

    def _batch(self, ids, real: int) -> None:
        import numpy as np

        mask = pa.array(np.arange(len(ids)) < real)
        tokens = pa.array(ids, self.schema.field("tokens").type.value_type)
        self.out.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(tokens, self.length), pa.FixedSizeListArray.from_arrays(mask, self.length)], schema=self.schema))

    def _flush_index(self) -> None:
        if self.rows:
            self.index_out.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*self.rows)], schema=self.index_schema))
            self.rows = []

    def close(self) -> None:
        self._flush(True)
        self._flush_index()
        for x in (self.out, self.index_out, self.sink, self.index_sink):
            x.close()


class ShardReader:
    """Random access to a shard: sequence(i), mask(i), documents()."""

    def __init__(self, tokens_path: str, index_path: str):
        self.tokens, self.index = self._file(tokens_path), self._file(index_path)

    @staticmethod
    def _file(uri: str):
        from pyarrow import fs

        system, path = _open(uri)
        return pa.ipc.open_file(pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path))

    def _row(self, column: int, i: int):
        return self.tokens.get_batch(i // ROWS).column(column)[i % ROWS].values

    def sequence(self, i: int):
        """The ids of sequence i, a view on the mapped file."""
        return self._row(0, i).to_numpy(zero_copy_only=True)

    def mask(self, i: int):
        return self._row(1, i).to_numpy(zero_copy_only=False)

    def n_sequences(self) -> int:
        n = self.tokens.num_record_batches
        return 0 if not n else (n - 1) * ROWS + self.tokens.get_batch(n - 1).num_rows

    def documents(self):
        """Yields (doc_id, start, the document's ids as one or more arrays) in file order."""
        at, begins, ids = -1, 0, None
        for b in range(self.index.num_record_batches):
            for doc_id, start, n in zip(*(c.to_pylist() for c in self.index.get_batch(b).columns)):
                parts, lo = [], start
                while lo < start + n:
                    while ids is None or lo >= begins + len(ids):
                        begins += 0 if ids is None else len(ids)
                        at += 1
                        ids = self.tokens.get_batch(at).column(0).flatten().to_numpy(zero_copy_only=True)
                    hi = min(start + n, begins + len(ids))
                    parts.append(ids[lo - begins : hi - begins])
                    lo = hi
                yield doc_id, start, parts


def write_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1, length: int = LENGTH) -> DataFrame:
    """Write docs(doc_id, text) to `folder`; the manifest, a row per shard, in shard order of doc_id."""
    ship(docs.sparkSession)
    end = end_id.to_bytes(4, "little")

    def write(batches):
        import numpy as np

        context, out = TaskContext.get(), None
        enc = encoder(tokenizer)
        for batch in batches:
            for doc_id, ids in encoded(batch, enc):
                out = out or ShardWriter(folder, f"shard-{context.partitionId():06d}-{context.taskAttemptId()}", 2 if enc.vocab_size <= 65536 else 4, length)
                out.add(doc_id, np.frombuffer(bytes(ids) + end, "<u4"))
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (context.partitionId(), out.tokens_path, out.index_path, out.n_docs, out.n_tokens)], ["shard", "tokens_path", "index_path", "n_docs", "n_tokens"])

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(tidy(write, encodes=True), MANIFEST), "token-manifest")


def read_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start (over all shards), n_tokens, ids_crc32 of every document in the files of a manifest."""
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(ahead), F.lit(0))).select("tokens_path", "index_path", "base")

    def read(batches):
        for batch in batches:
            for tokens_path, index_path, base in zip(*(c.to_pylist() for c in batch.columns)):
                rows = []
                for doc_id, start, parts in ShardReader(tokens_path, index_path).documents():
                    crc, n = 0, 0
                    for p in parts:
                        crc, n = zlib.crc32(p.astype("<u4").tobytes(), crc), n + len(p)
                    rows.append((doc_id, base + start, n, crc))
                for i in range(0, len(rows), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + 20_000])], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.repartition(max(1, manifest.count())).mapInArrow(tidy(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digests(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write all documents as token files into a new shared folder and read them back."""
    spark: SparkSession = docs.sparkSession
    return read_digests(write_files(docs, tokenizer, new_folder(spark, "token-files"), end_id))
