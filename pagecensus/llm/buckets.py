"""Exchange between chunks of documents through buckets of hashes.

A chunk is a bounded number of documents in one task. It sends the distinct hashes of its items, packed
into one row per bucket; a bucket compares what all chunks sent and answers each of them. An item that a
chunk holds a thousand times is sent once, so no hash can make a bucket large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from pagecensus.llm.common import shuffle_parts

# Documents of a chunk and bytes of their texts, bytes of text whose hashes make a bucket, and from how few
# documents and bytes on it is worth while to make a chunk and a bucket. Then bytes of text hashed at a time.
CHUNK_DOCS, CHUNK_BYTES, BUCKET_BYTES = 2000, 64 << 20, 4 << 20
FEW_DOCS, FEW_BYTES = 200, 1 << 20
HASHED_BYTES = 1 << 20
# Bits of an edge hash that are sent besides those that name the bucket.
SENT_BITS = 48
NO_ID = np.int64(2**63 - 1)
ANSWER = "chunk int, bucket int, flags binary, left binary, right binary, firsts binary"
SENT = "chunk int, bucket int, flags binary, left binary, right binary, keys binary, values binary"
SENT_KINDS = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
ANSWER_KINDS = [pa.int32(), pa.int32(), *[pa.binary()] * 4]


def arrow_table(rows: list[tuple], kinds: list, schema: str) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    names = [f.split()[0] for f in schema.split(", ")]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def text_groups(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about ``HASHED_BYTES`` together; a longer one stands alone."""
    begin = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > HASHED_BYTES:
            yield begin, texts[begin:i]
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, texts[begin:]


class Hashed:
    """The hashes of a chunk's items, the distinct ones of which are sent to buckets.

    What is sent and answered follows the order of the distinct hashes, not that of the rows.
    """

    hash: np.ndarray
    sent_bits = SENT_BITS

    def distinct(self, bits: int) -> None:
        """Sort the hashes' upper ``bits + sent_bits`` bits; the first ``bits`` name the bucket."""
        sent = self.hash >> np.uint64(64 - self.sent_bits - bits)
        self.order = np.argsort(sent, kind="stable")
        ordered = sent[self.order]
        new = np.ones(len(ordered), dtype=bool)
        new[1:] = ordered[1:] != ordered[:-1]
        self.first = np.flatnonzero(new)
        self.last = np.append(self.first[1:], len(ordered)) - 1 if len(ordered) else self.first
        self.sent = ordered[self.first]
        self.of = np.empty(len(sent), dtype=np.int64)  # item -> index of its distinct hash
        self.of[self.order] = np.cumsum(new) - 1
        self.repeated = np.zeros(len(self.sent), dtype=bool)
        self.cuts = np.searchsorted(self.sent >> np.uint64(self.sent_bits), np.arange(2**bits + 1, dtype=np.uint64))

    def slices(self) -> Iterator[tuple[int, slice]]:
        """The buckets that get something, each with its part of the distinct hashes."""
        for bucket in np.flatnonzero(np.diff(self.cuts)).tolist():
            yield bucket, slice(int(self.cuts[bucket]), int(self.cuts[bucket + 1]))

    def sent_rows(self, number: int) -> list[tuple]:
        low = self.sent & np.uint64(2**SENT_BITS - 1)
        return [
            (number, b, packed(self.repeated[s]), None, None, six_bytes(low[s]), None)
            for b, s in self.slices()
        ]

    def take_flags(self, answers: list[dict]) -> None:
        """Put together which hashes the buckets found repeated."""
        for answer in answers:
            own = slice(int(self.cuts[answer["bucket"]]), int(self.cuts[answer["bucket"] + 1]))
            if answer["flags"]:
                self.repeated[own] |= unpacked(answer["flags"], own.stop - own.start)


def packed(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unpacked(raw: bytes, size: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=size).astype(bool)


def six_bytes(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_six(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def bucket_rows(rows: pa.Table, key_size: int) -> tuple[list[dict], np.ndarray]:
    listed = rows.to_pylist()
    return listed, np.cumsum([0, *(len(r["keys"]) // key_size for r in listed)])


def answer_repeated(rows: pa.Table) -> pa.Table:
    """Hashes that several chunks hold, or that a chunk found repeated in itself."""
    listed, cuts = bucket_rows(rows, 6)
    keys = from_six(b"".join(r["keys"] for r in listed))
    order = np.argsort(keys)
    ordered = keys[order]
    same = np.zeros(len(keys) + 1, dtype=bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    repeated = np.empty(len(keys), dtype=bool)
    repeated[order] = same[1:] | same[:-1]
    out = []
    for i, row in enumerate(listed):
        flags = repeated[cuts[i] : cuts[i + 1]] | unpacked(row["flags"], int(cuts[i + 1] - cuts[i]))
        if flags.any():
            out.append((row["chunk"], row["bucket"], packed(flags), None, None, None))
    return arrow_table(out, ANSWER_KINDS, ANSWER)


def ids_of(docs: pa.Table) -> np.ndarray:
    return np.array([NO_ID if i is None else i for i in docs.column("doc_id").to_pylist()], dtype=np.int64)


def layout(docs: int, size: int, tasks: int, chunk_docs: int) -> tuple[int, int]:
    """Number of chunks and bits that name a bucket, for ``docs`` texts of ``size`` bytes together.

    Both follow from the data: a chunk holds up to ``chunk_docs`` texts and ``CHUNK_BYTES`` on average, a bucket
    the hashes of ``BUCKET_BYTES`` of text. Small tables are cut finer to give ``tasks`` tasks something to do,
    as long as a chunk keeps ``FEW_DOCS`` texts and a bucket the hashes of ``FEW_BYTES``.
    """
    chunks = max(1, -(-docs // chunk_docs), -(-size // CHUNK_BYTES), min(tasks, -(-docs // FEW_DOCS)))
    buckets = max(1, -(-size // BUCKET_BYTES), min(tasks, -(-size // FEW_BYTES)))
    return chunks, min(64 - SENT_BITS, (buckets - 1).bit_length())


def chunked(docs: DataFrame, chunk_docs: int) -> tuple[GroupedData, int]:
    """``docs`` (``doc_id, text`` and what comes along) grouped by chunk, and how many bits of a hash name a bucket.

    The groups may be used several times in one query: Spark reuses the exchange.
    """
    rows, size = docs.selectExpr("count(*)", "coalesce(sum(octet_length(text)), 0L)").first()
    chunks, bits = layout(rows, size, 2 * shuffle_parts(docs.sparkSession), chunk_docs)
    numbered = docs.withColumn("chunk", F.expr(f"CAST(pmod(xxhash64(doc_id, text), {chunks}) AS INT)"))
    return numbered.groupBy("chunk"), bits


def on_chunks(send, own: dict):
    def apply(docs: pa.Table) -> pa.Table:
        return send(docs, **own)

    return apply


def on_answers(send, own: dict):
    def apply(docs: pa.Table, answers: pa.Table) -> pa.Table:
        return send(docs, answers, **own)

    return apply
