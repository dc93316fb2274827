"""Token ids in directly addressable codes.

A shard file holds the ids of a range of documents. Ids are cut into bytes,
lowest first; level k holds the k-th bytes of the ids that have one. A bitmap
beside each level says which ids go on, and a directory of running counts (one
per ``BLOCK`` bits) turns a position of one level into that of the next. So any
token is read by a few look-ups, without decoding a block.

Layout, little-endian: magic, number of documents, tokens and levels; document
ids; document starts; then per level its length, bytes, bitmap and directory.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastemill.llm.common import open_store, stored
from tastemill.llm.tokens import worker_encoder
from tastemill.session import scratch_folder

MAGIC = b"TMDAC1\0\0"
END_ID = 2
BLOCK = 512
# A task closes a file once it holds so many tokens.
SHARD_TOKENS = 4_000_000
# A missing document id, in a file.
NO_ID = np.iinfo(np.int64).min


def encode_shard(doc_ids: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> bytes:
    """Bytes of a shard; ``starts`` has one entry per document and the total."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        ones = np.bitwise_count(bits).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.int64)
        levels.append(
            np.array([len(rest)], "<i8").tobytes()
            + (rest & 255).astype(np.uint8).tobytes()
            + bits.tobytes()
            + np.concatenate(([0], np.cumsum(ones))).astype("<i8").tobytes()
        )
        rest = rest[more] >> 8
        if not len(rest):
            break
    head = np.array([len(doc_ids), len(ids), len(levels)], "<i8").tobytes()
    body = doc_ids.astype("<i8").tobytes() + starts.astype("<i8").tobytes()
    return MAGIC + head + body + b"".join(levels)


class Shard:
    """Random access to the tokens of a shard's bytes."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        self._data, self._at = data, 8
        docs, self.tokens, levels = self._take("<i8", 3).tolist()
        self.doc_ids = self._take("<i8", docs)
        self.starts = self._take("<i8", docs + 1)
        self.levels = []
        for _ in range(levels):
            n = int(self._take("<i8", 1)[0])
            blocks = -(-n // BLOCK)
            self.levels.append(
                (
                    self._take(np.uint8, n),
                    self._take(np.uint8, blocks * BLOCK // 8),
                    self._take("<i8", blocks + 1),
                )
            )

    def _take(self, kind, n: int) -> np.ndarray:
        got = np.frombuffer(self._data, kind, n, self._at)
        self._at += got.nbytes
        return got

    def _before(self, level: int, at: int) -> int:
        """Ids of a level before a position that go on to the next level."""
        _, bits, directory = self.levels[level]
        block, rest = divmod(at, BLOCK)
        first = block * BLOCK // 8
        whole = int(np.bitwise_count(bits[first : first + rest // 8]).sum())
        part = int(bits[first + rest // 8]) & ((1 << rest % 8) - 1) if rest % 8 else 0
        return int(directory[block]) + whole + part.bit_count()

    def token(self, at: int) -> int:
        """The token at one position."""
        value = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[at]) << 8 * level
            if not bits[at >> 3] >> (at & 7) & 1:
                break
            at = self._before(level, at)
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Tokens of a range; the range stays contiguous in every level."""
        out = np.zeros(stop - start, np.uint32)
        where = np.arange(stop - start)
        for level, (chunks, bits, _) in enumerate(self.levels):
            if not len(where):
                break
            out[where] |= chunks[start:stop].astype(np.uint32) << np.uint32(8 * level)
            low = start >> 3
            flags = np.unpackbits(bits[low : (stop + 7) >> 3], bitorder="little")
            on = flags[start - 8 * low :][: stop - start].astype(bool)
            start, stop = self._before(level, start), self._before(level, stop)
            where = where[on]
        return out

    def document(self, number: int) -> np.ndarray:
        return self.slice(int(self.starts[number]), int(self.starts[number + 1]))


def write_tokens(
    docs: DataFrame, folder: str, end_id: int = END_ID, path: str | None = None
) -> DataFrame:
    """Encode all texts into shard files in ascending id order; returns the manifest.

    Documents are dealt out by ranges of their id, so shards follow each other
    and a hot id range gets more shards, not a larger one. File names carry the
    task attempt: a lost or repeated attempt leaves a stray file that the
    manifest, written from the attempts that counted, does not name. A null text
    has the end id only, a null id comes first, repeated ids stay beside each
    other.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, context = worker_encoder(path), TaskContext.get()
        store, root = open_store(folder)
        part, ids, docs_of, held, number = context.partitionId(), [], [], 0, 0

        def close() -> pa.RecordBatch:
            name = f"{part:06d}-{number:06d}-{context.taskAttemptId()}.dac"
            starts = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
            data = encode_shard(np.array(docs_of, np.int64), starts, np.concatenate(ids))
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(data)
            columns = [[name], [part], [number], [len(ids)], [held]]
            return pa.RecordBatch.from_arrays(
                [pa.array(x) for x in columns], names=["file", "part", "number", "docs", "tokens"]
            )

        store.create_dir(root, recursive=True)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for row, of in encoder.documents(batch.column(1), end_id):
                ids.append(of)
                docs_of.append(NO_ID if doc_ids[row] is None else doc_ids[row])
                held += len(of)
                if held >= SHARD_TOKENS:
                    yield close()
                    ids, docs_of, held, number = [], [], 0, number + 1
        if ids:
            yield close()

    ordered = (
        docs.select(F.col("doc_id").cast("long"), "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    return stored(
        ordered.mapInArrow(write, "file string, part long, number long, docs long, tokens long"),
        "manifest",
    )


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files.

    ``start`` counts the tokens of all documents before it: those of the parts
    before, of the part's shards before, and of the shard.
    """
    before = lambda w: F.coalesce(
        F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    parts = parts.select("part", before(Window.orderBy("part")).alias("of_part"))
    placed = (
        manifest.withColumn("inner", before(Window.partitionBy("part").orderBy("number")))
        .join(parts, "part")
        .select("file", (F.col("of_part") + F.col("inner")).alias("first"))
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        for batch in batches:
            for name, first in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_stream(f"{root}/{name}") as f:
                    shard = Shard(f.read())
                crc = [
                    zlib.crc32(shard.document(i).astype("<u4").tobytes())
                    for i in range(len(shard.doc_ids))
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.doc_ids, mask=shard.doc_ids == NO_ID),
                        pa.array(shard.starts[:-1] + first),
                        pa.array(np.diff(shard.starts)),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(tasks, "file").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def round_trip(docs: DataFrame, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Write all documents to a new folder beside the checkpoints and read them back."""
    folder = scratch_folder(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, end_id, path), folder)
