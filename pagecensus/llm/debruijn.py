"""Removal of long spans that earlier documents hold, by compaction of a word de Bruijn graph.

An edge of the graph is a run of 13 words, a node the 12 words two runs share. Only edges that at least
two documents hold matter. Documents lie in chunks of bounded size, and every exchange between chunks
goes through buckets of edge hashes, with one packed row per chunk and bucket:

1. Chunks send their distinct edges; buckets answer which of them other chunks hold too.
2. Chunks send the neighbours of their repeated edges; buckets answer where paths branch, that is, where
   documents differ in the edge before or behind. Between branches, all documents run along the same
   path, so each run of repeated edges compacts into whole nonbranching paths.
3. Chunks send their distinct paths with the smallest document; buckets answer the smallest of all.

Paths are verified by a fingerprint of all their words, and their source coordinates give the words to
remove. A chunk sends each edge once however often it holds it, so frequent passages and large groups
of copies weigh no more in a bucket than others.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecensus.llm.buckets import (
    ANSWER, ANSWER_KINDS, CHUNK_DOCS, NO_ID, SENT, SENT_BITS, SENT_KINDS, Hashed, answer_repeated,
    arrow_table, bucket_rows, chunked, from_six, ids_of, on_answers, on_chunks, packed, six_bytes,
    text_groups, unpacked,
)
from pagecensus.llm.common import mixed, prefix_hashes, span_hashes, utf8, window_hashes, word_spans

SPAN_WORDS = 13
_VARIES = np.uint32(2**32 - 1)

_EMPTY_HASHES = np.empty(0, dtype=np.uint64)


class Chunk(Hashed):
    """The edges of a chunk's documents: hash, document, place in it; nothing depends on row order."""

    def __init__(self, texts: list[bytes], span: int, bits: int):
        hashes, owners, places = [], [], []
        self.words = np.zeros(len(texts), dtype=np.int64)
        for begin, some in text_groups(texts):
            joined = b"\n".join(some)
            starts, ends = word_spans(joined)
            bounds = np.cumsum([len(t) + 1 for t in some])
            doc = np.searchsorted(bounds, starts, side="right")
            counts = np.bincount(doc, minlength=len(some))
            self.words[begin : begin + len(some)] = counts
            if len(starts) < span:
                continue
            prefix = prefix_hashes(np.frombuffer(joined, dtype=np.uint8))
            edges = window_hashes(span_hashes(prefix, starts, ends), span)
            whole = doc[: len(edges)] == doc[span - 1 :]
            at = np.arange(len(edges)) - (np.cumsum(counts) - counts)[doc[: len(edges)]]
            hashes.append(edges[whole])
            owners.append(doc[: len(edges)][whole] + begin)
            places.append(at[whole])
        self.hash = np.concatenate(hashes) if hashes else _EMPTY_HASHES
        self.doc = np.concatenate(owners) if owners else np.empty(0, dtype=np.int64)
        self.place = np.concatenate(places) if places else np.empty(0, dtype=np.int64)
        self.distinct(bits)
        if len(self.sent):
            owner = self.doc[self.order]
            # A stable sort leaves documents in order, so the ends tell whether there are several.
            self.repeated = owner[self.first] != owner[self.last]

    def take(self, answers: list[dict]) -> None:
        """Put together what the buckets answered: repeated edges, branches, first documents."""
        self.left = np.zeros(len(self.sent), dtype=bool)
        self.right = np.zeros(len(self.sent), dtype=bool)
        self.take_flags(answers)
        firsts = []
        for answer in sorted(answers, key=lambda a: a["bucket"]):
            own = slice(int(self.cuts[answer["bucket"]]), int(self.cuts[answer["bucket"] + 1]))
            if answer["left"]:
                at = own.start + np.flatnonzero(self.repeated[own])
                self.left[at] = unpacked(answer["left"], len(at))
                self.right[at] = unpacked(answer["right"], len(at))
            if answer["firsts"]:
                firsts.append(np.frombuffer(answer["firsts"], dtype=np.int64))
        self.firsts = np.concatenate(firsts) if firsts else np.empty(0, dtype=np.int64)

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """For each distinct repeated edge, the one edge before and behind it, or that they vary."""
        on = np.flatnonzero(self.repeated[self.of]) if len(self.of) else np.empty(0, dtype=np.int64)
        short = (self.hash[on] & np.uint64(2**32 - 4)).astype(np.uint32) | np.uint32(1)
        joined = np.zeros(len(on) + 1, dtype=bool)
        joined[1:-1] = (np.diff(on) == 1) & (self.doc[on[1:]] == self.doc[on[:-1]])
        before, behind = np.zeros(len(on), dtype=np.uint32), np.zeros(len(on), dtype=np.uint32)
        before[1:] = np.where(joined[1:-1], short[:-1], 0)
        behind[:-1] = np.where(joined[1:-1], short[1:], 0)
        index = self.of[on]
        order = np.argsort(index, kind="stable")
        first = np.flatnonzero(np.diff(index[order], prepend=-1))
        return tuple(_only(side[order], first) for side in (before, behind))

    def paths(self) -> None:
        """Compact runs of repeated edges: first edge, number of edges, name and check of each path."""
        on = np.flatnonzero(self.repeated[self.of]) if len(self.of) else np.empty(0, dtype=np.int64)
        index = self.of[on]
        new = np.ones(len(on), dtype=bool)
        new[1:] = (
            (np.diff(on) != 1) | (self.doc[on[1:]] != self.doc[on[:-1]])
            | self.left[index[1:]] | self.right[index[:-1]]
        )
        first = np.flatnonzero(new)
        self.path_edge = on[first]
        self.path_size = np.diff(np.append(first, len(on)))
        edges = self.hash[on]
        self.path_check = np.add.reduceat(mixed(edges), first) if len(first) else _EMPTY_HASHES
        self.path_name = mixed(edges[first] ^ mixed(self.path_size.astype(np.uint64)))
        order = np.lexsort((self.path_check, self.path_name))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (np.diff(self.path_name[order]) != 0) | (np.diff(self.path_check[order]) != 0)
        self.distinct_path = order[new]
        self.path_of = np.empty(len(order), dtype=np.int64)
        self.path_of[order] = np.cumsum(new) - 1
        self.path_order, self.path_first = order, np.flatnonzero(new)


def _only(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The value of each group, or ``_VARIES``."""
    if not len(first):
        return values[:0]
    least, most = np.minimum.reduceat(values, first), np.maximum.reduceat(values, first)
    return np.where(least == most, least, _VARIES)


def _of_table(docs: pa.Table, span: int, bits: int) -> tuple[Chunk, list[bytes]]:
    texts = [utf8(t) for t in docs.column("text").to_pylist()]
    return Chunk(texts, span, bits), texts


def _send_edges(docs: pa.Table, span: int, bits: int) -> pa.Table:
    chunk, _ = _of_table(docs, span, bits)
    number = docs.column("chunk")[0].as_py()
    return arrow_table(chunk.sent_rows(number), SENT_KINDS, SENT)


def _send_neighbours(docs: pa.Table, answers: pa.Table, span: int, bits: int) -> pa.Table:
    listed = answers.to_pylist()
    if not listed or not docs.num_rows:
        return arrow_table([], SENT_KINDS, SENT)
    chunk, _ = _of_table(docs, span, bits)
    chunk.take(listed)
    before, behind = chunk.neighbours()
    flags = {a["bucket"]: a["flags"] for a in listed}
    at = np.cumsum([0, *chunk.repeated]) if len(chunk.repeated) else np.zeros(1, dtype=np.int64)
    low = chunk.sent & np.uint64(2**SENT_BITS - 1)
    rows = []
    for b, s in chunk.slices():
        if chunk.repeated[s].any():
            own = slice(int(at[s.start]), int(at[s.stop]))
            values = before[own].tobytes() + behind[own].tobytes()
            keys = six_bytes(low[s][chunk.repeated[s]])
            rows.append((listed[0]["chunk"], b, flags.get(b), None, None, keys, values))
    return arrow_table(rows, SENT_KINDS, SENT)


def _answer_branches(rows: pa.Table) -> pa.Table:
    """At which ends of an edge its documents part."""
    listed, cuts = bucket_rows(rows, 6)
    keys = from_six(b"".join(r["keys"] for r in listed))
    sides = [np.empty(len(keys), dtype=np.uint32) for _ in range(2)]
    for i, row in enumerate(listed):
        both = np.frombuffer(row["values"], dtype=np.uint32).reshape(2, -1)
        for side, values in zip(sides, both, strict=True):
            side[cuts[i] : cuts[i + 1]] = values
    order = np.argsort(keys)
    group = np.cumsum(np.diff(keys[order], prepend=keys[order][:1]) != 0)
    first = np.flatnonzero(np.diff(group, prepend=-1))
    parts = []
    for side in sides:
        flags = np.empty(len(keys), dtype=bool)
        flags[order] = (_only(side[order], first) == _VARIES)[group]
        parts.append(flags)
    out = [
        (r["chunk"], r["bucket"], r["flags"], *(packed(p[cuts[i] : cuts[i + 1]]) for p in parts), None)
        for i, r in enumerate(listed)
    ]
    return arrow_table(out, ANSWER_KINDS, ANSWER)


def _send_paths(docs: pa.Table, answers: pa.Table, span: int, bits: int) -> pa.Table:
    listed = answers.to_pylist()
    if not listed or not docs.num_rows:
        return arrow_table([], SENT_KINDS, SENT)
    chunk, _ = _of_table(docs, span, bits)
    chunk.take(listed)
    chunk.paths()
    ids = ids_of(docs)[chunk.doc[chunk.path_edge]]
    least = np.minimum.reduceat(ids[chunk.path_order], chunk.path_first)
    names = chunk.path_name[chunk.distinct_path]
    keys = np.stack([names, chunk.path_check[chunk.distinct_path]], axis=1)
    cuts = np.searchsorted(names >> np.uint64(63 - bits) >> np.uint64(1), np.arange(2**bits + 1, dtype=np.uint64))
    carried = {a["bucket"]: (a["flags"], a["left"], a["right"]) for a in listed}
    rows = []
    for b in range(2**bits):
        own = slice(int(cuts[b]), int(cuts[b + 1]))
        if b in carried or own.stop > own.start:
            held = carried.get(b, (None, None, None))
            rows.append((listed[0]["chunk"], b, *held, keys[own].tobytes(), least[own].tobytes()))
    return arrow_table(rows, SENT_KINDS, SENT)


def _answer_firsts(rows: pa.Table) -> pa.Table:
    """The smallest document of each path."""
    listed, cuts = bucket_rows(rows, 16)
    keys = np.frombuffer(b"".join(r["keys"] for r in listed), dtype=np.uint64).reshape(-1, 2)
    values = np.frombuffer(b"".join(r["values"] for r in listed), dtype=np.int64)
    firsts = np.empty(len(values), dtype=np.int64)
    if len(values):
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (np.diff(keys[order], axis=0) != 0).any(axis=1)
        least = np.minimum.reduceat(values[order], np.flatnonzero(new))
        firsts[order] = least[np.cumsum(new) - 1]
    out = [
        (r["chunk"], r["bucket"], r["flags"], r["left"], r["right"], firsts[cuts[i] : cuts[i + 1]].tobytes())
        for i, r in enumerate(listed)
    ]
    return arrow_table(out, ANSWER_KINDS, ANSWER)


SPANS = "doc_id long, n_words long, n_removed long, spans array<struct<start: long, length: long>>, kept string"


def _removed(docs: pa.Table, answers: pa.Table, span: int, bits: int) -> pa.Table:
    chunk, texts = _of_table(docs, span, bits)
    listed = answers.to_pylist()
    ids = ids_of(docs)
    gone = np.zeros(int(chunk.words.sum()) + 1, dtype=np.int64)
    base = np.cumsum(chunk.words) - chunk.words
    if listed:
        chunk.take(listed)
        chunk.paths()
        if len(chunk.path_edge):
            owner = chunk.doc[chunk.path_edge]
            later = chunk.firsts[chunk.path_of] < ids[owner]
            begin = base[owner[later]] + chunk.place[chunk.path_edge[later]]
            np.add.at(gone, begin, 1)
            np.add.at(gone, begin + chunk.path_size[later] + span - 1, -1)
    mask = np.cumsum(gone)[:-1] > 0
    rows = []
    for i, (doc_id, text) in enumerate(zip(docs.column("doc_id").to_pylist(), texts, strict=True)):
        own = mask[base[i] : base[i] + chunk.words[i]]
        words, spans = text.split(), []
        if own.any():
            steps = np.diff(own.astype(np.int8), prepend=0, append=0)
            starts, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
            spans = [{"start": s, "length": e - s} for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            words = list(compress(words, (~own).tolist()))
        kept = b" ".join(words).decode("utf-8", "surrogatepass")
        rows.append((doc_id, len(own), int(own.sum()), spans, kept))
    kinds = [
        pa.int64(), pa.int64(), pa.int64(),
        pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])), pa.string(),
    ]
    return arrow_table(rows, kinds, "doc_id, n_words, n_removed, spans, kept")


def remove_repeats(
    docs: DataFrame,
    span: int = SPAN_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_docs: int = CHUNK_DOCS,
) -> DataFrame:
    """``doc_id, n_words, n_removed, spans, kept``: words that lie in a run of ``span`` words which a
    document with a smaller id holds too are removed; runs are judged on the input.

    ``spans`` are the maximal runs of removed words, ``kept`` the other words joined by one blank.
    Null and empty texts have no words. A null id counts as larger than all others. Rows with the same
    id are one another's document: none of them removes words of another. An empty table gives no rows;
    other columns are ignored.
    """
    rows = docs.selectExpr(f"CAST(`{id_col}` AS LONG) AS doc_id", f"`{text_col}` AS text")
    by_chunk, bits = chunked(rows, chunk_docs)
    own = {"span": span, "bits": bits}

    def answered(sent: DataFrame, answer) -> DataFrame:
        return sent.groupBy("bucket").applyInArrow(answer, ANSWER)

    def sent(answers: DataFrame, send, schema: str) -> DataFrame:
        return by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(on_answers(send, own), schema)

    answers = answered(by_chunk.applyInArrow(on_chunks(_send_edges, own), SENT), answer_repeated)
    answers = answered(sent(answers, _send_neighbours, SENT), _answer_branches)
    answers = answered(sent(answers, _send_paths, SENT), _answer_firsts)
    return sent(answers, _removed, SPANS)


def digests(removed: DataFrame) -> DataFrame:
    return removed.select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def brute_force(docs: list[tuple[int | None, str | None]], span: int = SPAN_WORDS) -> list[tuple[int, int, str]]:
    """The same by definition, for tests: words, removed words, digest of the kept ones."""
    split = [utf8(text).split() for _, text in docs]
    first: dict[tuple, int] = {}
    ids = [NO_ID if i is None else i for i, _ in docs]
    for doc_id, words in zip(ids, split, strict=True):
        for i in range(len(words) - span + 1):
            key = tuple(words[i : i + span])
            first[key] = min(first.get(key, NO_ID), doc_id)
    out = []
    for doc_id, words in zip(ids, split, strict=True):
        gone = [False] * len(words)
        for i in range(len(words) - span + 1):
            if first[tuple(words[i : i + span])] < doc_id:
                gone[i : i + span] = [True] * span
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out
