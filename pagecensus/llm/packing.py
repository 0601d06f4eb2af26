"""Packing documents into token windows of several lengths.

Documents are routed to the shortest tier (512, 1024, 2048 or 4096 tokens) that holds them; longer
ones give full windows of the longest tier first, and their rest is routed. Each tier opens a window
per document, and the gap is filled with documents of shorter tiers, the longest that fit first. The
last bit of a gap is filled by cutting a document, whose rest is routed again. So all windows are full.

Every task packs the documents it reads, in blocks of bounded size, so nothing is shuffled and a lost
task is simply repeated. What is left at the end of a task is cut into windows whose lengths are powers
of two, which need no padding either.
"""

from __future__ import annotations

import os
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import partial
from itertools import filterfalse
from zlib import crc32

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from pagecensus.llm.common import arrow_map

TIERS = (512, 1024, 2048, 4096)
END_ID = 2
# A block of this many tokens is packed at a time (4 bytes each).
BLOCK_TOKENS = 2_000_000
# Windows of one step group hold this many tokens together.
STEP_TOKENS = 16 * 4096
# Distinct words a worker keeps the ids of; when there are more, the table starts again.
TABLE_WORDS = 400_000

PIECES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, "
    "offset long, sequence_length int, step_group long"
)


# The pre-tokenizer's pattern in the vocabulary file, a fixed value.
_PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Words of these characters are in normal form already, and lower-casing keeps them so.
_SIMPLE = r"[!-~\u00a1-\u00ff]+"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it is printable."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(others)}}


class WordTokenizer:
    """Ids of whole texts, by a table of the distinct words between blanks.

    The vocabulary's pre-tokenizer drops white space and no token crosses it, so the ids of a text
    are those of its words in order. A word is made of pre-tokens, which have a table of their own:
    the vocabulary's merges run once for each of them while it is in the table.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._pre_tokens = regex.compile(_PRE_TOKENS).findall
        self._simple = regex.compile(_SIMPLE).fullmatch
        self._letters = _byte_letters()
        self._words: dict[str, bytes] = {}
        self._parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        letters = part if part.isascii() else part.encode().decode("latin-1").translate(self._letters)
        return array("I", [t.id for t in self._model.tokenize(letters)]).tobytes()

    def _learn(self, words: set[str]) -> None:
        # Most words are letters, or letters and one sign; the pattern is for the others.
        plain, signed, mixed, other = {}, {}, {}, []
        for word in words:
            if not self._simple(word) or "<|" in word:
                other.append(word)
            elif word.isalpha():
                plain[word] = word.lower()
            elif word[:-1].isalpha() and word[-1] in ".,:;!?":
                signed[word] = word[:-1].lower()
            else:
                mixed[word] = self._pre_tokens(word.lower())
        parts = self._parts
        needed = {word[-1] for word in signed}.union(plain.values(), signed.values(), *mixed.values())
        for part in needed.difference(parts):
            parts[part] = self._part(part)
        table = self._words
        table.update((word, parts[part]) for word, part in plain.items())
        table.update((word, parts[part] + parts[word[-1]]) for word, part in signed.items())
        table.update((word, b"".join([parts[p] for p in own])) for word, own in mixed.items())
        for word in other:
            ids = self._tokenizer.encode(word, add_special_tokens=False).ids
            table[word] = array("I", ids).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        if len(self._words) > TABLE_WORDS:
            self._words.clear()
            self._parts.clear()
        split = [[] if t is None else t.replace("\n", " ").replace("\t", " ").split(" ") for t in texts]
        unknown: set[str] = set()
        for words in split:
            unknown.update(filterfalse(self._words.__contains__, words))
        if unknown:
            self._learn(unknown)
        find = self._words.__getitem__
        return [b"".join(map(find, words)) for words in split]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer and word table per Python worker."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


class Packer:
    """Packs pieces ``(length, number, start, ids)`` of documents; ``number`` counts the documents."""

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers = sorted(tiers)
        self.longest = self.tiers[-1]
        self.pool: list[tuple[int, int, int]] = []  # sorted by length
        self.waiting = 0
        self.windows: list[tuple[int, list[tuple[int, int, int]]]] = []

    def add(self, number: int, tokens: int) -> None:
        start = 0
        while tokens - start >= self.longest:
            self.windows.append((self.longest, [(self.longest, number, start)]))
            start += self.longest
        if start < tokens:
            insort(self.pool, (tokens - start, number, start))
            self.waiting += tokens - start

    def _take(self, at: int) -> tuple[int, int, int]:
        piece = self.pool.pop(at)
        self.waiting -= piece[0]
        return piece

    def _cut(self, at: int, length: int) -> tuple[int, int, int]:
        """The first ``length`` tokens of a piece; the rest is routed again."""
        size, number, start = self._take(at)
        insort(self.pool, (size - length, number, start + length))
        self.waiting += size - length
        return length, number, start

    def pack(self, last: bool) -> None:
        """Fill windows, the longest pieces first, while there are enough tokens to fill them."""
        while self.pool and self.waiting >= self.longest:
            piece = self._take(len(self.pool) - 1)
            length = next(tier for tier in self.tiers if tier >= piece[0])
            self._fill(length, [piece])
        while last and self.pool:
            self._fill(1 << (self.waiting.bit_length() - 1), [])

    def _fill(self, length: int, window: list[tuple[int, int, int]]) -> None:
        gap = length - sum(p[0] for p in window)
        while gap:
            at = bisect_right(self.pool, (gap, 1 << 62, 0)) - 1
            # Nothing fits, or only scraps would: cut a piece of the next longer size.
            piece = self._take(at) if at >= 0 else self._cut(0, gap)
            window.append(piece)
            gap -= piece[0]
        self.windows.append((length, window))


def _pack_partition(
    batches: Iterator[pa.RecordBatch], path: str, tiers: tuple[int, ...], end_id: int, with_ids: bool
) -> Iterator[pa.RecordBatch]:
    tokenizer = word_tokenizer(path)
    end = array("I", [end_id]).tobytes()
    context = TaskContext.get()
    base = (context.partitionId() if context else 0) << 36
    packer = Packer(tiers)
    held: dict[int, list] = {}  # number -> [doc_id, ids, tokens not given out yet]
    number = sequences = 0
    in_tier: dict[int, int] = {}

    def given_out() -> Iterator[pa.RecordBatch]:
        nonlocal sequences
        rows: list[tuple] = []
        size = 0
        for length, window in packer.windows:
            place = in_tier[length] = in_tier.get(length, -1) + 1
            group = base + (place // max(1, STEP_TOKENS // length)) * 64 + length.bit_length()
            offset = 0
            for tokens, owner, start in window:
                doc_id, ids, left = held[owner]
                own = ids[4 * start : 4 * (start + tokens)]
                rows.append(
                    (doc_id, start, tokens, own if with_ids else crc32(own), len(ids) // 4,
                     base + sequences, offset, length, group)
                )
                offset += tokens
                size += tokens
                if left == tokens:
                    del held[owner]
                else:
                    held[owner][2] = left - tokens
            sequences += 1
            if size > BLOCK_TOKENS // 2:
                yield _batch(rows, with_ids)
                rows, size = [], 0
        packer.windows.clear()
        if rows:
            yield _batch(rows, with_ids)

    for batch in batches:
        ids = batch.column(0).to_pylist()
        for doc_id, raw in zip(ids, tokenizer.encode(batch.column(1).to_pylist()), strict=True):
            raw += end
            held[number] = [doc_id, raw, len(raw) // 4]
            packer.add(number, len(raw) // 4)
            number += 1
        if packer.waiting > BLOCK_TOKENS:
            packer.pack(last=False)
        yield from given_out()
    packer.pack(last=True)
    yield from given_out()


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    ids = pa.binary() if with_ids else pa.int64()
    kinds = [pa.int64(), pa.int64(), pa.int64(), ids, pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    names = [f.split()[0] for f in _schema(with_ids).split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names
    )


def _schema(with_ids: bool) -> str:
    return PIECES if with_ids else PIECES.replace("ids binary", "ids_crc32 long")


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    tiers: tuple[int, ...] = TIERS,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece of a document, with its place in a window (``sequence_id``, ``offset``).

    ``ids`` are the piece's ids as little-endian unsigned 32-bit numbers, ``start`` how many of the
    document's ids lie before it, ``sequence_length`` the length of the window, and ``step_group``
    numbers groups of windows of one length that hold the same number of tokens together. Without
    ``with_ids``, the CRC-32 of the ids is returned in their place, as ``ids_crc32``.

    Null and empty texts have the end id alone. A null id stays null. Repeated rows are packed as
    often as they come. An empty table gives no rows. Other columns are ignored. A text of any length
    is cut into as many windows as it needs.
    """
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers are powers of two")
    rows = docs.selectExpr(f"CAST(`{id_col}` AS LONG) AS doc_id", f"`{text_col}` AS text")
    apply = partial(_pack_partition, path=tokenizer_path, tiers=tuple(tiers), end_id=end_id, with_ids=with_ids)
    return arrow_map(rows, apply, _schema(with_ids))
