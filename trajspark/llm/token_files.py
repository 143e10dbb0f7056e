"""Token-id files: fixed-width bit packing in blocks, with random access.

File: blocks of packed ids, then the footer (doc ids, document starts, block offsets, all int64,
little-endian), then a 40-byte tail: bits, ids a block, ids, documents, footer place. A null doc id
is stored as the smallest int64.
"""

from __future__ import annotations

import posixpath
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialise, scratch_dir
from .encoding import encoder

BLOCK = 65_536
NULL_ID = np.iinfo(np.int64).min
TAIL = np.dtype([("bits", "<i8"), ("block", "<i8"), ("ids", "<i8"), ("docs", "<i8"), ("footer", "<i8")])


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """ids (unsigned, below 2**bits) in bits each, lowest bit first, filled up to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = ((ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8)
    return np.packbits(each, bitorder="little").tobytes()


def unpack_bits(data, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    each = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (each.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32).astype("<u4")


class TokenFileWriter:
    """Streams documents into one file; holds one block, and one number of each document."""

    def __init__(self, out, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.doc_ids, self.starts, self.offsets = [], [], []
        self.open, self.n = [], 0
        self.waiting = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit."""
        self.doc_ids.append(NULL_ID if doc_id is None else doc_id)
        self.starts.append(self.n)
        self.n += len(ids) // 4
        self.open.append(ids)
        self.waiting += len(ids)
        if self.waiting >= 4 * self.block:
            held = b"".join(self.open)
            whole = len(held) // (4 * self.block) * 4 * self.block
            for i in range(0, whole, 4 * self.block):
                self._write(held[i : i + 4 * self.block])
            self.open, self.waiting = [held[whole:]], len(held) - whole

    def _write(self, ids: bytes) -> None:
        self.offsets.append(self.out.tell())
        self.out.write(pack_bits(np.frombuffer(ids, "<u4"), self.bits))

    def close(self) -> None:
        if self.waiting:
            self._write(b"".join(self.open))
        footer = self.out.tell()
        for x in (self.doc_ids, self.starts, self.offsets):
            self.out.write(np.array(x, "<i8").tobytes())
        self.out.write(np.array([(self.bits, self.block, self.n, len(self.doc_ids), footer)], TAIL).tobytes())


class TokenFile:
    """Reads a file at any place: only the blocks that hold the asked ids."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        self.bits, self.block, self.n, docs, footer = (int(x) for x in np.frombuffer(source.read_at(TAIL.itemsize, size - TAIL.itemsize), TAIL)[0])
        index = np.frombuffer(source.read_at(size - TAIL.itemsize - footer, footer), "<i8")
        self.doc_ids, self.starts, self.offsets = index[:docs], index[docs : 2 * docs], index[2 * docs :]

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids start (included) to stop (excluded)."""
        stop = min(stop, self.n)
        if stop <= start:
            return np.empty(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        ids = []
        for b in range(first, last + 1):
            n = min(self.block, self.n - b * self.block)
            ids.append(unpack_bits(self.source.read_at((n * self.bits + 7) // 8, int(self.offsets[b])), self.bits, n))
        return np.concatenate(ids)[start - first * self.block : stop - first * self.block]

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """doc_id, start, ids and their CRC-32 of each document; one block is held at a time."""
        ends = [*self.starts[1:].tolist(), self.n]
        at, held = -1, b""
        for doc_id, start, end in zip(self.doc_ids.tolist(), self.starts.tolist(), ends, strict=True):
            crc, place = 0, start
            while place < end:
                b = place // self.block
                if b != at:
                    at, held = b, memoryview(self.read(b * self.block, (b + 1) * self.block).tobytes())
                stop = min(end, (b + 1) * self.block)
                crc = zlib.crc32(held[4 * (place - b * self.block) : 4 * (stop - b * self.block)], crc)
                place = stop
            yield None if doc_id == NULL_ID else doc_id, start, end - start, crc


def _write_shards(folder: str, path: str, end: int):
    def write(batches):
        import uuid

        store, base = fs.FileSystem.from_uri(folder)
        tail = end.to_bytes(4, "little")
        shard = name = out = None
        first = None
        for batch in batches:
            for doc_id, digest, text in zip(batch.column("doc_id").to_pylist(), batch.column("digest").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if shard is None:
                    enc, first = encoder(path), (doc_id, digest)
                    store.create_dir(base, recursive=True)
                    name = f"{uuid.uuid4().hex}.ids"  # of this attempt: a task that runs again writes another file
                    out = store.open_output_stream(posixpath.join(base, name))
                    shard = TokenFileWriter(out, max(enc.vocabulary - 1, end).bit_length())
                shard.add(doc_id, enc.ids(text) + tail)
        if shard is not None:
            shard.close()
            out.close()
            yield pa.RecordBatch.from_pylist([{"file": name, "first_doc": first[0], "first_digest": first[1], "n_docs": len(shard.doc_ids), "n_ids": shard.n}])

    return write


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, append end_id, and write the ids in ascending id order.

    Each task writes one file of a range of ids, so the files hold the order without one task ever
    seeing all of it. Returns the manifest (file, first_doc, first_digest, n_docs, n_ids, start), already written:
    start is the number of ids in all files before. Only files of the manifest count; what a lost
    task left behind has another name. Null ids come first; null or empty texts are the end id
    alone, and a text may be of any length; rows with the same id stand side by side, ordered by a digest
    of their text and then by text, so that very many of them spread too; other columns are ignored. An
    empty table writes none.
    """
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text")).repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest", "text")
    shards = materialise(ordered.mapInArrow(_write_shards(folder, tokenizer_path, end_id), "file string, first_doc long, first_digest long, n_docs long, n_ids long"))
    before = Window.orderBy(F.col("first_doc").asc_nulls_first(), "first_digest").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (over all files), n_tokens and ids_crc32 of each document, as the files hold them."""

    def read(batches):
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with store.open_input_file(posixpath.join(base, name)) as source:
                    rows = [(d, start + s, n, c) for d, s, n, c in TokenFile(source).documents()]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spark = manifest.sparkSession
    # a file a task: the manifest itself is a few bytes, the files are not
    tasks = max(1, manifest.count())
    return manifest.select("file", "start").repartition(tasks).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long") if tasks else spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch_dir(spark)
    manifest = write_token_files(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_documents(manifest, folder)
