"""Token ids in Arrow files of equal-length sequences, read back without copying.

One part of the corpus (a range of document ids, in ascending order) is one pair of files in the shared folder:

* ``*.arrow``: Arrow file format, batches of ``BATCH_SEQUENCES`` rows with ``input_ids``, a fixed-size list of
  the tokenizer's id type (16 bits up to 65,536 ids), and ``mask``, a fixed-size list of booleans that is false
  on the padding of the part's last sequence only. Token *i* of the part stands in sequence *i // length*, so
  any span is found by arithmetic and read through a memory map.
* ``*.index.arrow``: ``doc_id``, ``start`` (tokens before the document in its part) and ``n_tokens``.

A task writes under a name of its own and only its committed manifest row makes the files part of the output,
so a lost or repeated task leaves at most files that nothing refers to.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeledger.llm.common import arrow_schema, texts
from cladeledger.llm.tokens import WordEncoder
from cladeledger.workspace import materialize, new_path

SEQUENCE_LENGTH = 2048
BATCH_SEQUENCES = 64

MANIFEST = T.StructType().add("part", "integer").add("path", "string").add("documents", "long").add("tokens", "long")
DOCUMENT = (
    T.StructType().add("doc_id", "long").add("start", "long").add("n_tokens", "long").add("ids_crc32", "long")
)
_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _open(path: str, mode: str):
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    if mode == "w":
        system.create_dir(place.rsplit("/", 1)[0], recursive=True)
        return system.open_output_stream(place)
    if isinstance(system, fs.LocalFileSystem):
        return pa.memory_map(place)
    return system.open_input_file(place)


class SequenceWriter:
    """Appends token runs to one file of equal-length sequences."""

    def __init__(self, path: str, dtype: np.dtype, length: int):
        self._length, self._dtype = length, dtype
        self._schema = pa.schema(
            [("input_ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))]
        )
        self._sink = _open(path, "w")
        self._file = pa.ipc.new_file(self._sink, self._schema)
        self._waiting: list[np.ndarray] = []
        self._n_waiting = 0

    def append(self, ids: np.ndarray) -> None:
        self._waiting.append(ids)
        self._n_waiting += len(ids)
        if self._n_waiting >= self._length * BATCH_SEQUENCES:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self._waiting) if self._waiting else np.empty(0, self._dtype)
        block = self._length * BATCH_SEQUENCES
        whole = len(ids) if last else len(ids) // block * block
        for start in range(0, whole, block):
            self._write(ids[start : min(start + block, whole)])
        self._waiting, self._n_waiting = [ids[whole:]], len(ids) - whole

    def _write(self, ids: np.ndarray) -> None:
        padding = -len(ids) % self._length
        mask = np.ones(len(ids) + padding, bool)
        if padding:
            mask[len(ids) :] = False
            ids = np.concatenate([ids, np.zeros(padding, self._dtype)])
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self._length) for x in (ids, mask)]
        self._file.write_batch(pa.record_batch(lists, schema=self._schema))

    def close(self) -> None:
        self._flush(last=True)
        self._file.close()
        self._sink.close()


class SequenceReader:
    """Random access to the sequences of one file; spans inside one batch are views of the mapped file."""

    def __init__(self, path: str):
        self._source = _open(path, "r")
        self._file = pa.ipc.open_file(self._source)
        self.length = self._file.schema.field("input_ids").type.list_size
        self._batch_no, self._ids = -1, np.empty(0)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence ``i``."""
        batch = self._file.get_batch(i // BATCH_SEQUENCES)
        row = i % BATCH_SEQUENCES
        mask = batch.column(1).slice(row, 1).flatten().to_numpy(zero_copy_only=False)
        return batch.column(0).slice(row, 1).flatten().to_numpy(zero_copy_only=True), mask

    def span(self, start: int, stop: int) -> np.ndarray:
        """Tokens ``start`` to ``stop`` of the part."""
        block = self.length * BATCH_SEQUENCES
        pieces = []
        while start < stop:
            if start // block != self._batch_no:
                self._batch_no = start // block
                self._ids = self._file.get_batch(self._batch_no).column(0).flatten().to_numpy(zero_copy_only=True)
            offset = start % block
            pieces.append(self._ids[offset : offset + stop - start])
            start += len(pieces[-1])
        return pieces[0] if len(pieces) == 1 else np.concatenate(pieces or [np.empty(0, np.uint16)])


def write_sequences(
    docs: DataFrame, tokenizer_path: str, end_id: int, length: int = SEQUENCE_LENGTH, folder: str | None = None
) -> DataFrame:
    """Write every document's ids and ``end_id`` in ascending ``doc_id`` order; returns the manifest of parts.

    Null texts count as empty, a null ``doc_id`` sorts first, and repeated rows are separate documents. Rows of one id
    stand in order of a hash of their text and may span several parts. An empty table gives an empty manifest. The manifest has one small row per part: ``part``,
    ``path``, ``documents``, ``tokens`` and ``first_token``, the number of tokens in all parts before.
    """
    folder = folder or new_path(docs.sparkSession, "sequences")
    schema = arrow_schema(MANIFEST)

    def write_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:05d}-{uuid.uuid4().hex}"
        encoder = writer = index = None
        documents = tokens = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                encoder = WordEncoder.of_worker(tokenizer_path)
                end = np.array([end_id], encoder.dtype)
                writer = SequenceWriter(f"{path}.arrow", encoder.dtype, length)
                index_sink = _open(f"{path}.index.arrow", "w")
                index = pa.ipc.new_file(index_sink, _INDEX)
            counts = []
            for ids in encoder.encode_all(batch.column(1).to_pylist()):
                writer.append(ids)
                writer.append(end)
                counts.append(len(ids) + 1)
            ends = tokens + np.cumsum(counts)
            index.write_batch(
                pa.record_batch(
                    [batch.column(0).cast(pa.int64()), pa.array(ends - counts), pa.array(counts, pa.int64())], schema=_INDEX
                )
            )
            documents, tokens = documents + batch.num_rows, int(ends[-1])
        if writer is not None:
            writer.close()
            index.close()
            index_sink.close()
            yield pa.record_batch([[part], [path], [documents], [tokens]], schema=schema)

    order = ["doc_id", "tie", "text"]
    keyed = texts(docs).withColumn("tie", F.xxhash64("text"))
    placed = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions(*order).select("doc_id", "text")
    parts = placed.mapInArrow(write_part, MANIFEST)
    manifest = materialize(parts, "manifest")
    # One row per part, never per document.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first_token", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_documents(manifest: DataFrame) -> DataFrame:
    """Per document of the written files: ``doc_id``, ``start`` in the whole corpus, ``n_tokens``, ``ids_crc32``.

    The checksum is that of the ids as little-endian unsigned 32-bit integers.
    """
    schema = arrow_schema(DOCUMENT)

    def read_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first_token").to_pylist()):
                reader = SequenceReader(f"{path}.arrow")
                index = pa.ipc.open_file(_open(f"{path}.index.arrow", "r"))
                for i in range(index.num_record_batches):
                    rows = index.get_batch(i)
                    starts = rows.column("start").to_numpy()
                    stops = starts + rows.column("n_tokens").to_numpy()
                    sums = [
                        zlib.crc32(reader.span(a, b).astype("<u4").tobytes())
                        for a, b in zip(starts.tolist(), stops.tolist())
                    ]
                    yield pa.record_batch(
                        [rows.column("doc_id"), pa.array(starts + first), rows.column("n_tokens"), pa.array(sums, pa.int64())],
                        schema=schema,
                    )

    parts = max(1, manifest.count())
    return manifest.repartitionByRange(parts, "part").mapInArrow(read_parts, DOCUMENT)
