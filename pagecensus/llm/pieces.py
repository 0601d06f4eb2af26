"""SentencePiece encoding and decoding by a table of distinct marked words.

The library puts a marker before a text and for each blank, and in the vocabularies meant here no piece
holds a marker behind another letter, nor a line break. So no piece crosses the start of a marked word
or of a line, and a text's ids are those of its chunks in order. Each worker keeps a table of distinct
chunks; a chunk is segmented once while it is in the table, and its ids are put back by position.
Nothing is shuffled: a table shared by all tasks would have to meet every word of the corpus by a join.
The table also has a chunk's decoded text, so that a round trip with its digests takes one look-up per chunk.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import partial
from itertools import filterfalse
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecensus.llm.common import arrow_map

MARKER = "▁"
_CHUNKS = re.compile(rf"[ {MARKER}]+[^ {MARKER}\n]*|\n[^ {MARKER}\n]*").findall
# Distinct chunks a worker keeps.
TABLE_CHUNKS = 500_000
EMPTY_SHA256 = hashlib.sha256().hexdigest()


class Chunk(NamedTuple):
    """What is known of a chunk: its ids in binary and in decimal, how many, and their text behind other pieces."""

    ids: bytes
    decimals: bytes
    count: int
    decoded: str


class ChunkEncoder:
    """A table of chunks. Those of a batch that are not there are segmented together; it starts again when full."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.processor.get_piece_size()
        pieces = [self.processor.id_to_piece(i) for i in range(size)]
        crossing = [p for p in pieces if MARKER in p.lstrip(MARKER) or "\n" in p]
        if crossing:
            raise ValueError(f"pieces of this vocabulary cross chunks, such as {crossing[0]!r}")
        self._marker = self.processor.piece_to_id(MARKER)
        self._decimals = [str(i).encode() for i in range(size)]
        # The text of ordinary pieces; bytes and special ones are left to the library.
        special = [
            self.processor.is_byte(i) or self.processor.is_control(i) or self.processor.is_unknown(i) for i in range(size)
        ]
        self._texts = [None if odd else p.replace(MARKER, " ") for p, odd in zip(pieces, special, strict=True)]
        # Something to decode behind: the library drops a marker in front of a text.
        self._before = self.processor.encode("a", num_threads=1)
        self._before_text = self.processor.decode(self._before)
        self._table: dict[str, Chunk] = {}

    def _known(self, ids: list[int]) -> Chunk:
        texts = [self._texts[i] for i in ids]
        if None in texts:
            decoded = self.processor.decode(self._before + ids)[len(self._before_text) :]
        else:
            decoded = "".join(texts)
        return Chunk(array("i", ids).tobytes(), b",".join([self._decimals[i] for i in ids]), len(ids), decoded)

    def _learn(self, chunks: list[str]) -> None:
        """The library adds a marker of its own in front: it stands for the chunk's first one."""
        lines = [c for c in chunks if c[0] == "\n"]
        words = [c for c in chunks if c[0] != "\n"]
        for word, ids in zip(words, self.processor.encode([w[1:] for w in words], num_threads=1), strict=True):
            self._table[word] = self._known(ids or [self._marker])
        for line, ids in zip(lines, self.processor.encode(lines, num_threads=1), strict=True):
            self._table[line] = self._known(ids[1:])

    def chunks(self, texts: list[str | None]) -> Iterator[list[Chunk]]:
        """The chunks of each text."""
        if len(self._table) > TABLE_CHUNKS:
            self._table.clear()
        split = [_CHUNKS(f" {t}") if t else [] for t in texts]
        unknown: set[str] = set()
        for words in split:
            unknown.update(filterfalse(self._table.__contains__, words))
        if unknown:
            self._learn(list(unknown))
        for words in split:
            yield list(map(self._table.__getitem__, words))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        return [b"".join([c.ids for c in chunks]) for chunks in self.chunks(texts)]

    def round_trips(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """Number of ids, SHA-256 of the ids in decimal, joined by commas, and of the decoded text."""
        for chunks in self.chunks(texts):
            if not chunks:
                yield 0, EMPTY_SHA256, EMPTY_SHA256
                continue
            decoded = "".join([c.decoded for c in chunks])
            if chunks[0].decoded[:1] == " ":
                decoded = decoded[1:]  # the marker in front of a text is not decoded
            ids = hashlib.sha256(b",".join([c.decimals for c in chunks])).hexdigest()
            yield sum([c.count for c in chunks]), ids, hashlib.sha256(decoded.encode()).hexdigest()


_ENCODERS: dict[str, ChunkEncoder] = {}


def _encoder(path: str) -> ChunkEncoder:
    """One encoder and table per Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(path)
    for batch in batches:
        raw = encoder.encode(batch.column(1).to_pylist())
        offsets = np.zeros(len(raw) + 1, dtype=np.int32)
        np.cumsum([len(r) // 4 for r in raw], out=offsets[1:])
        values = pa.array(np.frombuffer(b"".join(raw), dtype="<i4"))
        ids = pa.ListArray.from_arrays(pa.array(offsets), values)
        yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: the ids of each whole text, without begin and end ids.

    Null and empty texts have no ids. Null ids, repeated rows and empty tables pass through row by row;
    other columns are ignored. Texts may be of any length up to what a row can hold.
    """
    rows = docs.selectExpr(f"CAST(`{id_col}` AS LONG) AS doc_id", f"`{text_col}` AS text")
    return arrow_map(rows, partial(_encoded, path=model_path), "doc_id long, ids array<int>")


def _decoded(batches: Iterator[pa.RecordBatch], path: str, at: int) -> Iterator[pa.RecordBatch]:
    processor = _encoder(path).processor
    for batch in batches:
        lists = [x or [] for x in batch.column(at).to_pylist()]
        texts = [processor.decode(ids) if ids else "" for ids in lists]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"]
        )


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """The rows with a further column ``decoded``. Null and empty id lists give an empty text."""
    schema = encoded.drop("decoded").schema.add("decoded", "string")
    rows = encoded.drop("decoded")
    return arrow_map(rows, partial(_decoded, path=model_path, at=rows.columns.index(ids_col)), schema)


def digests(decoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of decoded rows."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


_ROUND_TRIP = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _round_trips(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(path)
    for batch in batches:
        rows = list(encoder.round_trips(batch.column(1).to_pylist()))
        columns = zip(*rows, strict=True) if rows else [[]] * 3
        arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [f.split()[0] for f in _ROUND_TRIP.split(", ")])


def round_trip_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``digests(decode(encode(docs)))`` in one pass, without the ids and texts leaving the task."""
    rows = docs.selectExpr(f"CAST(`{id_col}` AS LONG) AS doc_id", f"`{text_col}` AS text")
    return arrow_map(rows, partial(_round_trips, path=model_path), _ROUND_TRIP)
