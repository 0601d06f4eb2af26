"""Repeated byte strings by an enhanced suffix array with its common-prefix interval tree.

The array is sparse: it holds the suffixes that start at anchors. Among the k-grams of any window of
``min_bytes`` bytes the leftmost one with the smallest hash is the window's anchor, so two equal windows
have their anchors at the same place, and the occurrences of a repeat meet at the suffixes of one anchor.

1. Chunks of documents send their distinct anchors to buckets, which answer those that occur twice.
2. Chunks send the text around their repeated anchors, as far as windows with this anchor reach. A bucket
   sorts these suffixes, takes the common prefixes of neighbours, and scans them with a stack into the
   tree of common-prefix intervals. All suffixes of an interval share its prefix; what stands before the
   anchors decides how far the repeat extends to the left, and a set of occurrences whose left sides all
   go on alike is not maximal there. The scan gives all occurrences, not only neighbours in the array.
3. The answers tell each occurrence how far it is repeated, or the groups it belongs to.

Passages of a number of words (``min_words``, ``shared_words``) are found by hashes: windows of so many words
have an anchor among their word k-grams, and windows whose anchor occurs twice go to the buckets as hashes in
steps 2 and 3.

An anchor with more than ``HOT_CONTEXTS`` occurrences, such as a footer in many documents with different text
around it, has no suffixes: all windows with this anchor go to the buckets as hashes, spread by the windows'
own hashes. So no bucket holds more than that many contexts of an anchor. ``repeat_groups`` needs the suffixes
and takes all of them.

Contexts that a chunk holds several times are sent once, and equal ones from several chunks are one
suffix of the array, so large groups of copies are small here.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagecensus.llm.buckets import (
    ANSWER, ANSWER_KINDS, CHUNK_DOCS, SENT, SENT_KINDS, Hashed, answer_repeated, arrow_table, bucket_rows,
    chunked, from_six, on_answers, on_chunks, packed, text_groups, unpacked,
)
from pagecensus.llm.common import mixed, prefix_hashes, run_hashes, span_hashes, utf8, word_spans

MIN_BYTES = 400
# A window's anchor is a k-gram of about a third of it.
GRAM_SHARE = 0.32
WORD_GRAM_SHARE = 0.4
# Occurrences of an anchor, counted over all chunks, that are compared by their texts.
HOT_CONTEXTS = 1024
# In the column ``left``: a row of window hashes, not of contexts.
_WINDOWS = b"w"
_PLACE_BITS = np.uint64(24)
_SEGMENT = 1 << 22
# Not a byte of UTF-8, also not of lone surrogates.
_PAD = 0xFF


def _sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by running minima of blocks from both sides."""
    count = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def _anchors(data: np.ndarray, ends: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor, hash, first and last window start of each run of windows with one anchor.

    ``ends[i]`` is where the document of byte ``i`` ends; windows do not cross it.
    """
    found: list[tuple[np.ndarray, ...]] = []
    for begin in range(0, max(0, len(data) - size + 1), _SEGMENT):
        part = data[begin : begin + _SEGMENT + size - 1]
        starts = np.arange(len(part) - gram + 1)
        hashes = span_hashes(prefix_hashes(part), starts, starts + gram)
        ranked = (hashes >> _PLACE_BITS << _PLACE_BITS) | starts.astype(np.uint64)
        least = _sliding_minimum(ranked, size - gram + 1)
        chosen = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        at = np.arange(len(chosen)) + begin
        inside = at + size <= ends[at]
        new = inside.copy()
        new[1:] &= ~inside[:-1] | (chosen[1:] != chosen[:-1]) | (ends[at[1:]] != ends[at[:-1]])
        stop = inside.copy()
        stop[:-1] &= ~inside[1:] | new[1:]
        first, last = np.flatnonzero(new), np.flatnonzero(stop)
        place = chosen[first]
        found.append((place + begin, hashes[place], first + begin, last + begin))
    if not found:
        return tuple(np.empty(0, dtype=t) for t in (np.int64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(columns) for columns in zip(*found, strict=True))


class Chunk(Hashed):
    """The anchors of a chunk's documents and the text around them."""

    def __init__(self, texts: list[bytes], size: int, gram: int, bits: int, words: int = 0):
        self.texts = texts
        self.bounds = np.cumsum([0, *(len(t) for t in texts)])
        places, hashes, firsts, lasts = [], [], [], []
        for begin, some in text_groups(texts):
            data = np.frombuffer(b"".join(some), dtype=np.uint8)
            lengths = [len(t) for t in some]
            ends = np.repeat(np.cumsum(lengths), lengths)
            base = self.bounds[begin]
            place, value, first, last = _anchors(data, ends, size, gram)
            places.append(place + base)
            hashes.append(mixed(value))  # the smallest hashes were chosen; spread them over the buckets
            firsts.append(first + base)
            lasts.append(last + base)
        empty = np.empty(0, dtype=np.int64)
        self.place, self.first_start, self.last_start = (
            np.concatenate(x) if x else empty for x in (places, firsts, lasts)
        )
        self.hash = np.concatenate(hashes) if hashes else empty.astype(np.uint64)
        self.size, self.words = size, words
        # Byte anchors come first, then the word k-grams that are an anchor.
        self.anchors = len(self.hash)
        if words:
            self._passages(words)
        self.window_first, self.window_last = self.first_start, self.last_start
        self.distinct(bits)
        # Twice in the chunk is repeated: the same document counts too.
        self.repeated = self.first != self.last
        self.hot = np.zeros(len(self.sent), dtype=bool)

    def counted_rows(self, number: int) -> list[tuple]:
        """The distinct anchors with the number of their occurrences, up to 65,535."""
        counts = np.minimum(self.last - self.first + 1, 65_535).astype("<u2")
        parts = zip(self.sent_rows(number), self.slices(), strict=True)
        return [(*row[:-1], counts[s].tobytes()) for row, (_, s) in parts]

    def take_flags(self, answers: list[dict]) -> None:
        super().take_flags(answers)
        for answer in answers:
            own = slice(int(self.cuts[answer["bucket"]]), int(self.cuts[answer["bucket"] + 1]))
            if answer["flags"] and answer["right"]:
                self.hot[own] |= unpacked(answer["right"], own.stop - own.start)

    def _passages(self, words: int) -> None:
        """The windows of ``words`` words with their anchors, and the anchors' occurrences as items."""
        gram = max(1, round(words * WORD_GRAM_SHARE))
        width = words - gram + 1
        none = np.full(width - 1, np.iinfo(np.uint64).max, dtype=np.uint64)
        items, parts = [self.hash], []
        for begin, some in text_groups(self.texts):
            text = b" ".join(some)
            starts, ends = word_spans(text)
            if len(starts) < words:
                continue
            own = span_hashes(prefix_hashes(np.frombuffer(text, dtype=np.uint8)), starts, ends)
            doc = np.searchsorted(np.cumsum([len(t) + 1 for t in some]), starts, side="right")
            grams = run_hashes(own, gram)
            least = _sliding_minimum(grams, width)
            inside = doc[: len(least)] == doc[words - 1 :]
            # A k-gram is an anchor if it is the least of a window, so the greatest least of its windows.
            below = np.concatenate([none, np.where(inside, ~least, np.iinfo(np.uint64).max), none])
            items.append(mixed(grams[~_sliding_minimum(below, width) == grams]))
            # One blank stands before each text but the first.
            at = self.bounds[begin] - doc
            parts.append((
                mixed(least[inside]), run_hashes(own, words)[inside],
                (starts + at)[: len(least)][inside], (ends + at)[words - 1 :][inside],
            ))
        self.hash = np.concatenate(items)
        kinds = (np.uint64, np.uint64, np.int64, np.int64)
        columns = zip(*parts, strict=True) if parts else ([np.empty(0, dtype=k)] for k in kinds)
        self.passage_anchor, self.passage_hash, self.passage_start, self.passage_stop = map(np.concatenate, columns)

    def windows(self, bits: int, shared: bool = False) -> Windows:
        """Windows that are compared as hashes: those of hot anchors, and passages with a repeated anchor.

        With ``shared``, a passage that only one document holds is not repeated.
        """
        on = np.flatnonzero(self.hot[self.of[: self.anchors]])
        first, many = self.first_start[on], self.last_start[on] - self.first_start[on] + 1
        ahead = np.repeat(np.cumsum(many) - many, many)
        starts = np.sort(np.repeat(first, many) + np.arange(len(ahead)) - ahead)
        hashes = [np.empty(0, dtype=np.uint64)]
        for begin, some in text_groups(self.texts) if len(starts) else ():
            low, high = np.searchsorted(starts, [self.bounds[begin], self.bounds[begin + len(some)]])
            at = starts[low:high] - self.bounds[begin]
            hashes.append(span_hashes(prefix_hashes(np.frombuffer(b"".join(some), dtype=np.uint8)), at, at + self.size))
        stops, places, many = starts + self.size, -np.arange(1, len(starts) + 1), len(starts)
        if self.words:
            items = np.unique(self.hash[self.anchors :][self.repeated[self.of[self.anchors :]]])
            # Neighbours mostly have the same anchor.
            new = np.flatnonzero(np.diff(self.passage_anchor, prepend=~self.passage_anchor[:1]))
            on = np.repeat(np.isin(self.passage_anchor[new], items), np.diff(new, append=len(self.passage_anchor)))
            own = self.passage_start[on]
            docs = np.searchsorted(self.bounds, own, side="right") if shared else np.arange(len(own))
            starts, places = np.concatenate([starts, own]), np.concatenate([places, docs])
            stops = np.concatenate([stops, self.passage_stop[on]])
            hashes.append(self.passage_hash[on])
        return Windows(starts, stops, np.concatenate(hashes), bits, places, many)

    def contexts(self) -> None:
        """Distinct texts around repeated anchors, ordered by hash, left and right side."""
        of = self.of[: self.anchors]
        on = np.flatnonzero(self.repeated[of] & ~self.hot[of])
        joined = b"".join(self.texts)
        self.occurrence = on
        index: dict[tuple[int, bytes, bytes], list[int]] = {}
        for i, h, place, first, last in zip(
            range(len(on)), self.hash[on].tolist(), self.place[on].tolist(),
            self.window_first[on].tolist(), self.window_last[on].tolist(), strict=True,
        ):
            key = (h, joined[first:place], joined[place : last + self.size])
            index.setdefault(key, []).append(i)
        self.context = sorted(index)
        self.context_of = np.empty(len(on), dtype=np.int64)
        self.context_count = np.array([len(index[c]) for c in self.context], dtype=np.int64)
        for number, key in enumerate(self.context):
            self.context_of[index[key]] = number
        hashes = np.array([c[0] for c in self.context], dtype=np.uint64)
        bits = (len(self.cuts) - 1).bit_length() - 1
        bucket = hashes >> np.uint64(63 - bits) >> np.uint64(1)
        self.context_cuts = np.searchsorted(bucket, np.arange(2**bits + 1, dtype=np.uint64))


class Windows(Hashed):
    """Windows of a chunk by their hashes, the first ``of_bytes`` of them byte strings, the others passages.

    Those in two ``places`` of the chunk are repeated.
    """

    def __init__(
        self, starts: np.ndarray, stops: np.ndarray, hashes: np.ndarray, bits: int, places: np.ndarray, of_bytes: int
    ):
        self.starts, self.stops, self.hash, self.of_bytes = starts, stops, hashes, of_bytes
        self.distinct(bits)
        if len(self.first):
            ordered = places[self.order]
            self.repeated = np.minimum.reduceat(ordered, self.first) != np.maximum.reduceat(ordered, self.first)


def _of_table(docs: pa.Table, size: int, gram: int, bits: int, words: int) -> Chunk:
    return Chunk([utf8(t) for t in docs.column("text").to_pylist()], size, gram, bits, words)


def _send_anchors(docs: pa.Table, size: int, gram: int, bits: int, words: int) -> pa.Table:
    chunk = _of_table(docs, size, gram, bits, words)
    return arrow_table(chunk.counted_rows(docs.column("chunk")[0].as_py()), SENT_KINDS, SENT)


def _answer_anchors(rows: pa.Table, hot: int) -> pa.Table:
    """As ``answer_repeated``; ``right`` tells which anchors occur more than ``hot`` times."""
    listed, cuts = bucket_rows(rows, 6)
    keys = from_six(b"".join(r["keys"] for r in listed))
    counts = np.frombuffer(b"".join(r["values"] for r in listed), dtype="<u2").astype(np.int64)
    _, of = np.unique(keys, return_inverse=True)
    total = np.bincount(of, weights=counts)[of]
    out = []
    for i, row in enumerate(listed):
        own = total[cuts[i] : cuts[i + 1]]
        if (own > 1).any():
            out.append((row["chunk"], row["bucket"], packed(own > 1), None, packed(own > hot), None))
    return arrow_table(out, ANSWER_KINDS, ANSWER)


_HEAD = np.dtype([("hash", "<u8"), ("many", "u1"), ("left", "<u4"), ("right", "<u4")])


def _send_contexts(
    docs: pa.Table, answers: pa.Table, size: int, gram: int, bits: int, words: int, shared: bool = False
) -> pa.Table:
    listed = answers.to_pylist()
    if not listed or not docs.num_rows:
        return arrow_table([], SENT_KINDS, SENT)
    chunk = _of_table(docs, size, gram, bits, words)
    chunk.take_flags(listed)
    chunk.contexts()
    flags = {a["bucket"]: a["flags"] for a in listed}
    hot = {a["bucket"]: a["right"] for a in listed}
    rows = []
    for b in range(2**bits):
        lo, hi = int(chunk.context_cuts[b]), int(chunk.context_cuts[b + 1])
        if b not in flags and lo == hi:
            continue
        some = chunk.context[lo:hi]
        head = np.zeros(hi - lo, dtype=_HEAD)
        head["hash"] = [c[0] for c in some]
        head["many"] = chunk.context_count[lo:hi] > 1
        head["left"] = [len(c[1]) for c in some]
        head["right"] = [len(c[2]) for c in some]
        text = b"".join([part for c in some for part in c[1:]])
        rows.append((listed[0]["chunk"], b, flags.get(b), None, hot.get(b), head.tobytes(), text))
    sent = chunk.windows(bits, shared).sent_rows(listed[0]["chunk"])
    rows += [(number, b, repeated, _WINDOWS, None, keys, None) for number, b, repeated, _, _, keys, _ in sent]
    return arrow_table(rows, SENT_KINDS, SENT)


def _common(a: np.ndarray, b: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of rows."""
    differs = a != b
    first = np.where(differs.any(axis=1), differs.argmax(axis=1), a.shape[1])
    return np.minimum(first, limits)


class SuffixArray:
    """The sorted suffixes of many anchors with their common prefixes, and their left sides.

    Equal contexts are one suffix; ``many`` tells that it occurs more than once.
    """

    def __init__(self, hashes: np.ndarray, lefts: list[bytes], rights: list[bytes], many: np.ndarray):
        self.left_size = np.array([len(x) for x in lefts], dtype=np.int64)
        self.right_size = np.array([len(x) for x in rights], dtype=np.int64)
        wide_left = int(self.left_size.max(initial=0)) + 1
        wide_right = int(self.right_size.max(initial=0)) + 1
        before = _matrix([x[::-1] for x in lefts], wide_left)
        behind = _matrix(rights, wide_right)
        group = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
        order = _sorted_rows(group, behind, before)
        same = (hashes[order[1:]] == hashes[order[:-1]])
        equal = same & (behind[order[1:]] == behind[order[:-1]]).all(axis=1)
        equal &= (before[order[1:]] == before[order[:-1]]).all(axis=1)
        new = np.ones(len(order), dtype=bool)
        new[1:] = ~equal
        self.suffix_of = np.empty(len(order), dtype=np.int64)  # context -> suffix
        self.suffix_of[order] = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        self.many = np.add.reduceat(many[order].astype(np.int64) + 1, starts) > 1
        kept = order[starts]
        self.hash = hashes[kept]
        self.left_size, self.right_size = self.left_size[kept], self.right_size[kept]
        before, behind = before[kept], behind[kept]
        same = self.hash[1:] == self.hash[:-1]
        # prefix[i]: what suffix i shares with the one before it; -1 between anchors.
        self.prefix = np.full(len(kept) + 1, -1, dtype=np.int64)
        limits = np.minimum(self.right_size[1:], self.right_size[:-1])
        self.prefix[1:-1] = np.where(same, _common(behind[1:], behind[:-1], limits), -1)
        # The same by the left sides, read backwards.
        self.by_left = _sorted_rows(group[kept], before, behind)
        self.left_rank = np.empty(len(kept), dtype=np.int64)
        self.left_rank[self.by_left] = np.arange(len(kept))
        ordered = before[self.by_left]
        sizes = self.left_size[self.by_left]
        self.shared_left = np.zeros(len(kept) + 1, dtype=np.int64)
        self.shared_left[1:-1] = _common(ordered[1:], ordered[:-1], np.minimum(sizes[1:], sizes[:-1]))

    def intervals(self) -> Iterator[tuple[int, int, int]]:
        """``(prefix, first, last + 1)`` of all common-prefix intervals, children before parents."""
        stack: list[tuple[int, int]] = []
        for i, shared in enumerate(self.prefix[1:].tolist(), start=1):
            first = i - 1
            while stack and stack[-1][0] > shared:
                length, first = stack.pop()
                yield length, first, i
            if shared >= 0 and (not stack or stack[-1][0] < shared):
                stack.append((shared, first))

    def _left_neighbours(self, first: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes of an interval by their left sides, and what neighbours there share."""
        ranks = np.sort(self.left_rank[first:stop])
        between = self.shared_left[ranks[0] + 1 : ranks[-1] + 1]
        return self.by_left[ranks], np.minimum.reduceat(between, ranks[:-1] - ranks[0])

    def coverage(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """How far around its anchor each suffix is repeated: bytes to the left and to the right.

        All repeats of a suffix hold its anchor, so together they are one stretch.
        """
        whole = self.many & (self.left_size + self.right_size >= size)
        left, right = np.where(whole, self.left_size, 0), np.where(whole, self.right_size, 0)
        for length, first, stop in self.intervals():
            need = size - length
            if stop - first == 2:
                a, b = sorted(self.left_rank[first:stop].tolist())
                shared = int(self.shared_left[a + 1 : b + 1].min())
                if shared >= need:
                    for i in (first, first + 1):
                        left[i], right[i] = max(left[i], shared), max(right[i], length)
                continue
            members, shared = self._left_neighbours(first, stop)
            best = np.zeros(len(members), dtype=np.int64)
            best[1:] = shared
            best[:-1] = np.maximum(best[:-1], shared)
            # A left side that nobody shares is no repeat, however long the prefix.
            found = members[best >= max(need, 0)]
            left[found] = np.maximum(left[found], best[best >= max(need, 0)])
            right[found] = np.maximum(right[found], length)
        return left, right

    def maximal_repeats(self, size: int) -> Iterator[tuple[int, int, list[int]]]:
        """``(left, right, suffixes)`` of each maximal repeat of at least ``size`` bytes.

        Occurrences of an interval go on differently to the right. Those of them whose left sides agree
        for ``left`` bytes, and then differ, are a group; if they all lie in one child of the interval,
        they go on alike to the right and belong to the child.
        """
        # Suffixes whose whole context occurs several times, unless others hold it as a part of theirs.
        alone = set(np.flatnonzero(self.many & (self.left_size + self.right_size >= size)).tolist())
        for length, first, stop in self.intervals():
            members, shared = self._left_neighbours(first, stop)
            ends = [*shared.tolist(), -1]
            stack: list[tuple[int, int]] = []
            for i, value in enumerate(ends, start=1):
                begin = i - 1
                while stack and stack[-1][0] > value:
                    left, begin = stack.pop()
                    group = np.sort(members[begin:i])
                    if left + length >= size and int(self.prefix[group[0] + 1 : group[-1] + 1].min()) == length:
                        whole = (self.left_size[group] == left) & (self.right_size[group] == length)
                        alone.difference_update(group[whole].tolist())
                        yield left, length, group.tolist()
                if value >= 0 and (not stack or stack[-1][0] < value):
                    stack.append((value, begin))
        for i in sorted(alone):
            yield int(self.left_size[i]), int(self.right_size[i]), [i]


def _matrix(parts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join([p.ljust(width, bytes([_PAD])) for p in parts]), dtype=np.uint8).reshape(-1, width)


def _sorted_rows(*columns: np.ndarray) -> np.ndarray:
    rows = np.ascontiguousarray(np.concatenate(columns, axis=1))
    keys = rows.view(f"V{rows.shape[1]}").ravel().tolist()
    return np.array(sorted(range(len(keys)), key=keys.__getitem__), dtype=np.int64)


def _of_bucket(rows: pa.Table) -> tuple[list[dict], np.ndarray, SuffixArray | None]:
    listed = rows.to_pylist()
    heads = [np.frombuffer(r["keys"], dtype=_HEAD) for r in listed]
    cuts = np.cumsum([0, *(len(h) for h in heads)])
    if not cuts[-1]:
        return listed, cuts, None
    lefts, rights = [], []
    for row, head in zip(listed, heads, strict=True):
        text, at = row["values"], 0
        for left, right in zip(head["left"].tolist(), head["right"].tolist(), strict=True):
            lefts.append(text[at : at + left])
            rights.append(text[at + left : at + left + right])
            at += left + right
    head = np.concatenate(heads)
    return listed, cuts, SuffixArray(head["hash"], lefts, rights, head["many"].astype(bool))


def _answer_coverage(rows: pa.Table, size: int) -> pa.Table:
    listed, cuts, array = _of_bucket(rows)
    both = np.zeros((0, 2), dtype=np.uint32)
    if array is not None:
        both = np.stack(array.coverage(size), axis=1).astype(np.uint32)[array.suffix_of]
    out = [
        (r["chunk"], r["bucket"], r["flags"], None, r["right"], both[cuts[i] : cuts[i + 1]].tobytes())
        for i, r in enumerate(listed)
    ]
    return arrow_table(out, ANSWER_KINDS, ANSWER)


_MEMBER = np.dtype([("context", "<u4"), ("group", "<u8"), ("left", "<u4"), ("right", "<u4")])


def _answer_groups(rows: pa.Table, size: int) -> pa.Table:
    listed, cuts, array = _of_bucket(rows)
    members: list[list[tuple[int, int, int, int]]] = [[] for _ in listed]
    if array is not None:
        contexts = np.argsort(array.suffix_of, kind="stable")
        begin = np.searchsorted(array.suffix_of[contexts], np.arange(len(array.hash) + 1))
        for number, (left, right, suffixes) in enumerate(array.maximal_repeats(size)):
            name = int(mixed(array.hash[suffixes[0]] ^ mixed(np.array([number], dtype=np.uint64)))[0])
            for suffix in suffixes:
                for context in contexts[begin[suffix] : begin[suffix + 1]].tolist():
                    row = int(np.searchsorted(cuts, context, side="right")) - 1
                    members[row].append((context - int(cuts[row]), name, left, right))
    out = [
        (r["chunk"], r["bucket"], r["flags"], None, r["right"], np.array(m, dtype=_MEMBER).tobytes())
        for r, m in zip(listed, members, strict=True)
    ]
    return arrow_table(out, ANSWER_KINDS, ANSWER)


_REMOVED = "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, length: long>>, kept binary"
_PASSAGES = "passages array<struct<start: long, length: long>>"


def _spans(covered: np.ndarray) -> list[dict]:
    """The maximal runs of covered bytes."""
    if not covered.any():
        return []
    steps = np.diff(covered.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    return [{"start": s, "length": e - s} for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


def _removed(
    docs: pa.Table, answers: pa.Table, size: int, gram: int, bits: int, words: int, shared: bool = False
) -> pa.Table:
    texts = [utf8(t) for t in docs.column("text").to_pylist()]
    bounds = np.cumsum([0, *(len(t) for t in texts)])
    gone = np.zeros(int(bounds[-1]) + 1, dtype=np.int32)
    held = np.zeros_like(gone) if shared else gone
    listed = sorted(answers.to_pylist(), key=lambda a: a["bucket"])
    hashed, listed = [a for a in listed if a["left"]], [a for a in listed if not a["left"]]
    if listed:
        chunk = Chunk(texts, size, gram, bits, words)
        chunk.take_flags(listed)
        chunk.contexts()
        found = [np.frombuffer(a["firsts"], dtype=np.uint32) for a in listed if a["firsts"]]
        if found:
            reach = np.concatenate(found).reshape(-1, 2)[chunk.context_of].astype(np.int64)
            on = reach[:, 1] > 0
            place = chunk.place[chunk.occurrence[on]]
            np.add.at(gone, place - reach[on, 0], 1)
            np.add.at(gone, place + reach[on, 1], -1)
        if hashed:
            windows = chunk.windows(bits, shared)
            windows.take_flags(hashed)
            on = np.flatnonzero(windows.repeated[windows.of])
            cut = np.searchsorted(on, windows.of_bytes)
            for marks, some in ((gone, on[:cut]), (held, on[cut:])):
                np.add.at(marks, windows.starts[some], 1)
                np.add.at(marks, windows.stops[some], -1)
    covered = np.cumsum(gone[:-1]) > 0
    passages = np.cumsum(held[:-1]) > 0 if shared else None
    rows = []
    for i, (doc_id, text) in enumerate(zip(docs.column("doc_id").to_pylist(), texts, strict=True)):
        own = covered[bounds[i] : bounds[i + 1]]
        spans = _spans(own)
        if spans:
            text = np.frombuffer(text, dtype=np.uint8)[~own].tobytes()
        rows.append((doc_id, len(own), int(own.sum()), spans, text))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    out = arrow_table(rows, [pa.int64(), pa.int64(), pa.int64(), kind, pa.binary()], "doc_id, n_bytes, n_removed, spans, kept")
    if shared:
        found = [_spans(passages[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        out = out.append_column("passages", pa.array(found, kind))
    return out.append_column("row", docs.column("row")) if "row" in docs.schema.names else out


GROUPS = "group_id long, length long, doc_id long, start long"


def _group_rows(docs: pa.Table, answers: pa.Table, size: int, gram: int, bits: int, words: int) -> pa.Table:
    listed = sorted(answers.to_pylist(), key=lambda a: a["bucket"])
    kinds = [pa.int64()] * 4
    if not listed or not docs.num_rows:
        return arrow_table([], kinds, GROUPS)
    chunk = _of_table(docs, size, gram, bits, words)
    chunk.take_flags(listed)
    chunk.contexts()
    ids = docs.column("doc_id").to_pylist()
    occurrences: dict[int, list[int]] = {}
    for occurrence, context in zip(chunk.occurrence.tolist(), chunk.context_of.tolist(), strict=True):
        occurrences.setdefault(context, []).append(occurrence)
    rows = []
    for answer in listed:
        base = int(chunk.context_cuts[answer["bucket"]])
        for context, group, left, right in np.frombuffer(answer["firsts"], dtype=_MEMBER).tolist():
            for occurrence in occurrences[base + context]:
                start = int(chunk.place[occurrence]) - left
                doc = int(np.searchsorted(chunk.bounds, start, side="right")) - 1
                rows.append((group - 2**63, left + right, ids[doc], start - int(chunk.bounds[doc])))
    return arrow_table(rows, kinds, GROUPS)


def _answer_windows(rows: pa.Table) -> pa.Table:
    found = answer_repeated(rows)
    marks = pa.array([_WINDOWS] * found.num_rows, pa.binary())
    return found.set_column(found.schema.get_field_index("left"), "left", marks)


def _answers(
    docs: DataFrame, min_bytes: int, chunk_docs: int, answer, id_col: str, text_col: str, hot: int, carry=(), min_words=0,
    shared_words=0,
):
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{text_col}`").alias("text"),
        *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []),
    )
    by_chunk, bits = chunked(rows, chunk_docs)
    own = {"size": min_bytes, "gram": max(1, round(min_bytes * GRAM_SHARE)), "bits": bits, "words": shared_words or min_words}
    anchors = by_chunk.applyInArrow(on_chunks(_send_anchors, own), SENT)
    repeated = anchors.groupBy("bucket").applyInArrow(on_chunks(_answer_anchors, {"hot": hot}), ANSWER)
    sending = on_answers(_send_contexts, {**own, "shared": bool(shared_words)})
    contexts = by_chunk.cogroup(repeated.groupBy("chunk")).applyInArrow(sending, SENT)

    def answered(rows: pa.Table) -> pa.Table:
        hashed = rows.column("left").is_valid()
        found = [answer(rows.filter(pc.invert(hashed)), min_bytes), _answer_windows(rows.filter(hashed))]
        return pa.concat_tables(found)

    answers = contexts.groupBy("bucket").applyInArrow(answered, ANSWER)
    return by_chunk.cogroup(answers.groupBy("chunk")), own


def remove_repeats(
    docs: DataFrame,
    min_bytes: int = MIN_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_docs: int = CHUNK_DOCS,
    carry: Sequence[str] = (),
    min_words: int = 0,
    hot_contexts: int = HOT_CONTEXTS,
    shared_words: int = 0,
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept``: bytes in a string of ``min_bytes`` bytes that also
    starts elsewhere in the corpus, the same document included, are removed; all are judged on the input.
    With ``min_words``, so are runs of that many words, from the first word's start to the last one's end,
    whatever their length in bytes and the blanks between the words; they are compared by 64-bit hashes, as are
    the windows of an anchor that occurs more than ``hot_contexts`` times.

    With ``shared_words``, a further column ``passages`` has the maximal runs of bytes in runs of so many words
    that also stand in another document, found like those of ``min_words``. They stay in ``kept`` unless their
    bytes are removed as above. Of ``min_words`` and ``shared_words`` only one can be given.

    ``spans`` are the maximal runs of removed bytes, ``kept`` the other bytes. Null and empty texts have
    no bytes. Null and repeated ids do no harm: rows are documents. Repeated rows are copies of one
    another. An empty table gives no rows. The columns named in ``carry`` come along in a struct ``row``,
    the others are ignored.
    """
    if min_words and shared_words:
        raise ValueError("only one of min_words and shared_words can be given")
    grouped, own = _answers(
        docs, min_bytes, chunk_docs, _answer_coverage, id_col, text_col, hot_contexts, carry, min_words, shared_words
    )
    schema = StructType.fromDDL(f"{_REMOVED}, {_PASSAGES}" if shared_words else _REMOVED)
    if carry:
        schema = schema.add("row", StructType([docs.schema[c] for c in carry]))
    return grouped.applyInArrow(on_answers(_removed, {**own, "shared": bool(shared_words)}), schema)


def without_repeats(
    docs: DataFrame,
    min_bytes: int = MIN_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 0,
) -> DataFrame:
    """The documents without the bytes that ``remove_repeats`` removes, all columns as they were.

    A character that is removed in part goes as a whole. A document of which nothing is left stays, with
    an empty text; a null text becomes empty.
    """
    carry = [c for c in docs.columns if c != text_col]
    rows = remove_repeats(docs, min_bytes, id_col, text_col, carry=carry, min_words=min_words)
    # A cut through a character leaves bytes that are no UTF-8.
    kept = F.col("kept").cast("string")
    whole = F.when(F.expr("is_valid_utf8(CAST(kept AS STRING))"), kept).otherwise(
        F.regexp_replace(F.expr("make_valid_utf8(CAST(kept AS STRING))"), "\ufffd", "")
    )
    text = F.when(F.size("spans") > 0, whole).otherwise(kept)
    return rows.select(*[(text if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def repeat_groups(
    docs: DataFrame,
    min_bytes: int = MIN_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_docs: int = CHUNK_DOCS,
) -> DataFrame:
    """``group_id, length, doc_id, start``: the maximal repeats around each anchor, all occurrences.

    A repeat that is longer than the windows of one anchor appears once per anchor, each part in a group
    of its own. All contexts of an anchor meet in one task. Nulls, empty tables and repeated rows are treated as in ``remove_repeats``.
    """
    grouped, own = _answers(docs, min_bytes, chunk_docs, _answer_groups, id_col, text_col, 2**62)
    return grouped.applyInArrow(on_answers(_group_rows, own), GROUPS)


def digests(removed: DataFrame) -> DataFrame:
    """Counts and a digest instead of spans and bytes; of the passages, if there are any, number and bytes."""
    passages = [
        F.size("passages").cast("long").alias("n_passages"),
        F.expr("aggregate(passages, 0L, (n, p) -> n + p.length)").alias("n_passage_bytes"),
    ]
    return removed.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2(F.col("kept"), 256).alias("kept_sha256"), *(passages if "passages" in removed.columns else []),
    )


def brute_force(texts: list[str | None], min_bytes: int = MIN_BYTES) -> list[tuple[int, int, int, bytes]]:
    """The same by definition, for tests: bytes, removed bytes, runs, kept bytes."""
    raw = [utf8(t) for t in texts]
    seen: dict[bytes, int] = {}
    for text in raw:
        for i in range(len(text) - min_bytes + 1):
            seen[text[i : i + min_bytes]] = seen.get(text[i : i + min_bytes], 0) + 1
    out = []
    for text in raw:
        gone = bytearray(len(text))
        for i in range(len(text) - min_bytes + 1):
            if seen[text[i : i + min_bytes]] > 1:
                gone[i : i + min_bytes] = b"\1" * min_bytes
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(text), sum(gone), runs, bytes(b for b, g in zip(text, gone, strict=True) if not g)))
    return out
