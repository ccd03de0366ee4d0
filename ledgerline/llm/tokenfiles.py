"""Token-id output: Arrow IPC files of equal-length sequences and masks.

Each shard holds the ids of a range of documents, in ascending id order, as one stream cut into sequences of equal
length. A record batch has ``ids: fixed_size_list<uint16 or uint32>[L]`` and ``mask: fixed_size_list<bool>[L]``
(false on the padding behind the shard's last id), uncompressed, so that a mapped file gives any sequence as a numpy array and its mask
as an Arrow array of bits, both without a copy. A second IPC file beside it lists doc_id, start and n_tokens of the shard's documents, in batches.
Shards grow in number with the input's characters, and a task's memory is a batch of sequences and a batch of the index.
Strings of special tokens in a text are ordinary text (see encoding). Files of failed or repeated attempts are never listed: the manifest names those of the attempt that ended.

Cases: null and empty texts are the end id alone; null ids come first; rows with equal ids are ordered by a hash of their
texts; an empty table gives no files. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import new_path, text_slices
from ledgerline.llm.encoding import crc32_of, encoder, read_tokenizer, text_batches

LENGTH = 2048
BATCH = 64
#: Documents in a batch of the index, and characters that a shard holds about (there are at least as many shards as keep the cores busy).
INDEX_BATCH = 65_536
SHARD_CHARS = 256_000_000

MANIFEST = "shard int, path string, docs long, tokens long"
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def sequence_schema(dtype: np.dtype, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])


def file_system(path: str):
    """(file system, path in it) of a URI; s3a and s3n are what Hadoop calls s3."""
    from pyarrow import fs

    scheme, mark, rest = path.partition("://")
    return fs.FileSystem.from_uri(f"s3://{rest}" if mark and scheme in ("s3a", "s3n") else path)


class ShardWriter:
    """Writes one shard; memory is one batch of sequences and the index of its documents."""

    def __init__(self, path: str, dtype: np.dtype, length: int, batch: int):
        self.files, name = file_system(path)
        self.files.create_dir(name.rsplit("/", 1)[0])
        self.name, self.dtype, self.length, self.batch = name, dtype, length, batch
        self.schema = sequence_schema(dtype, length)
        self.sink = self.files.open_output_stream(f"{name}.arrow")
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.held, self.held_n, self.tokens, self.n_docs = [], 0, 0, 0
        self.index_sink = self.files.open_output_stream(f"{name}.index.arrow")
        self.index_out = pa.ipc.new_file(self.index_sink, INDEX)
        self.docs: list[tuple] = []

    def _write(self, ids: np.ndarray, real: int) -> None:
        flat = pa.array(np.arange(len(ids)) < real)
        lists = [pa.FixedSizeListArray.from_arrays(x, self.length) for x in (pa.array(ids), flat)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.tokens, len(ids)))
        self.n_docs += 1
        if len(self.docs) == INDEX_BATCH:
            self._write_index()
        self.held.append(ids)
        self.held_n += len(ids)
        self.tokens += len(ids)
        whole = self.length * self.batch
        if self.held_n >= whole:
            ids = np.concatenate(self.held)
            cut = len(ids) // whole * whole
            for at in range(0, cut, whole):
                self._write(ids[at : at + whole], whole)
            self.held, self.held_n = [ids[cut:]], len(ids) - cut

    def close(self) -> None:
        if self.held_n:
            ids = np.concatenate(self.held)
            self._write(np.pad(ids, (0, -len(ids) % self.length)), len(ids))
        self.out.close()
        self.sink.close()
        self._write_index()
        self.index_out.close()
        self.index_sink.close()

    def _write_index(self) -> None:
        columns = list(zip(*self.docs)) or [()] * 3
        self.index_out.write_batch(pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], schema=INDEX))
        self.docs = []


class ShardReader:
    """Random access to one shard; local files are mapped, so sequences are views of the file."""

    def __init__(self, path: str):
        self.files, self.name = file_system(path)
        self.source = self._open(f"{self.name}.arrow")
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.n_batches = self.file.num_record_batches
        self.per_batch = self.file.get_batch(0).num_rows if self.n_batches else 1
        self._at, self._ids = -1, np.empty(0)

    def _open(self, name: str):
        from pyarrow import fs

        return pa.memory_map(name) if isinstance(self.files, fs.LocalFileSystem) else self.files.open_input_file(name)

    def _batch(self, i: int) -> np.ndarray:
        if i != self._at:
            self._at, self._ids = i, self.file.get_batch(i).column(0).flatten().to_numpy()
        return self._ids

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """The ids and the mask of sequence i, views of the file."""
        batch, row = self.file.get_batch(i // self.per_batch), i % self.per_batch
        part = slice(row * self.length, (row + 1) * self.length)
        return batch.column(0).flatten()[part].to_numpy(), batch.column(1).flatten()[part]

    def tokens(self, start: int, n: int) -> np.ndarray:
        """n ids of the shard's stream from start."""
        size, parts = self.per_batch * self.length, []
        while n:
            ids = self._batch(start // size)[start % size :][:n]
            parts.append(ids)
            start, n = start + len(ids), n - len(ids)
        return parts[0] if len(parts) == 1 else np.concatenate(parts or [self._ids[:0]])

    def index(self) -> Iterator[pa.RecordBatch]:
        with self._open(f"{self.name}.index.arrow") as source:
            file = pa.ipc.open_file(source)
            for i in range(file.num_record_batches):
                yield file.get_batch(i)


def write_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, length: int = LENGTH, batch: int = BATCH, id_col: str = "doc_id", text_col: str = "text") -> list[Row]:
    """Write docs' ids to folder; the manifest, one row for each shard, in stream order."""
    spec = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, writer = encoder(spec.value), TaskContext.get().partitionId(), None
        path = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex[:12]}"
        end = np.array([end_id], enc.dtype)
        for doc_ids, texts in text_batches(batches):
            writer = writer or ShardWriter(path, enc.dtype, length, batch)
            for doc_id, ids in zip(doc_ids.to_pylist(), enc.encode(texts)):
                writer.add(doc_id, np.concatenate([ids, end]))
        if writer:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([path]), pa.array([writer.n_docs]), pa.array([writer.tokens])], names=["shard", "path", "docs", "tokens"])

    tie = F.xxhash64(F.col(text_col).cast("string"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), tie.alias("tie"))
    chars = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    shards = max(1, -(-chars // SHARD_CHARS), min(-(-chars // (1 << 20)), 8 * docs.sparkSession.sparkContext.defaultParallelism))
    rows = rows.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return sorted(rows.mapInArrow(run, MANIFEST).collect(), key=lambda x: x.shard)


def read_files(spark: SparkSession, manifest: list[Row]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files."""
    rows, base = [], 0
    for x in manifest:
        rows.append((x.path, base))
        base += x.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for item in (x for b in batches for x in b.to_pylist()):
            shard = ShardReader(item["path"])
            for part in text_slices(shard.index(), 4096):
                starts, sizes = part.column(1).to_numpy(), part.column(2).to_numpy()
                crcs = [crc32_of(shard.tokens(int(s), int(n))) for s, n in zip(starts, sizes)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(starts + item["base"]), part.column(2), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)))
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_files(docs, public_tokenizers.path("word_bpe_49k.json"), 2, new_path(spark, "tokens"))
    return read_files(spark, manifest)
