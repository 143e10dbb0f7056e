"""Best-fit packing of token sequences."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .encoding import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class OpenBins:
    """Bounded-space online best fit.

    At most `limit` bins are open. A bitset has bit f set while some open bin has f free places;
    the best fit for n is its lowest bit from n on. If a new bin would exceed the limit, the fullest
    open bin, the lowest bit of all, closes first; `closed` counts those.
    """

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.bits, self.open, self.bins, self.closed = 0, 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        found = self.by_free[free]
        number = found.pop()
        if not found:
            self.bits &= ~(1 << free)
        self.open -= 1
        return number

    def place(self, n: int) -> tuple[int, int]:
        """Bin and offset of a piece of n tokens, 1 <= n <= capacity."""
        fits = self.bits >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if n < self.capacity and self.open == self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.closed += 1
            number, free = self.bins, self.capacity
            self.bins += 1
        left = free - n
        if left:
            self.by_free[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.capacity - free


def _pieces(path: str, end: int, capacity: int):
    tail = end.to_bytes(4, "little")

    def cut(batches):
        enc = encoder(path)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = memoryview(enc.ids(text) + tail)
                n = len(ids) // 4
                # the first piece is what is over, so that all others fill a sequence alone
                edges = [0, *range(n % capacity or min(n, capacity), n + 1, capacity)]
                out += [(doc_id, i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
            if out:
                d, i, a, n, c = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(i, pa.int32()), *(pa.array(x, pa.int64()) for x in (a, n, c))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def _pack(capacity: int, limit: int, window: int):
    def pack(batches):
        from pyspark import TaskContext

        bins = OpenBins(capacity, limit)
        base = TaskContext.get().partitionId() << 33

        def fill(batch):
            n = batch.column("length").to_numpy()
            order = np.argsort(-n, kind="stable")  # within a window the long ones come first
            number, offset = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            for i in order.tolist():
                number[i], offset[i] = bins.place(int(n[i]))
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(number + base), pa.array(offset)], [*batch.schema.names, "sequence_id", "offset"])

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= window:
                yield fill(pa.concat_batches(held))
                held, rows = [], 0
        if rows:
            yield fill(pa.concat_batches(held))

    return pack


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, open_bins: int = 16_384, window: int = 16_384, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack the tokens of all documents into sequences of at most `capacity` tokens.

    A document is its whole text's ids and end_id. Only longer ones are cut, into pieces of
    `capacity` tokens of which the first may be shorter. Texts are encoded where they are read; only
    the pieces' numbers are shuffled, dealt by a hash of document and piece, so a hot document or
    source spreads over all tasks. Each task packs what arrives by bounded-space best fit with at
    most `open_bins` open bins. It is online but for this: each window of arrivals is taken longest first.
    A window of no more pieces than open bins does not fill them with long pieces that nothing fits.

    Returns per piece: doc_id, piece int, start long, length long, ids_crc32 long (unsigned, of its
    ids as little-endian 32-bit), sequence_id long, offset long. Null or empty text: one piece, the
    end id alone; a text may be of any length. Repeated rows are packed each; a null id stays null; other
    columns are ignored. Bins of equal room are taken last opened first. An empty table gives none.
    """
    pieces = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_pieces(tokenizer_path, end_id, capacity), PIECES)
    dealt = pieces.repartition(F.xxhash64("doc_id", "piece", "ids_crc32")).sortWithinPartitions("doc_id", "piece", "ids_crc32")
    return dealt.mapInArrow(_pack(capacity, open_bins, window), f"{PIECES}, sequence_id long, offset long")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
