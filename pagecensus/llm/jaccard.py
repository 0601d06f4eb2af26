"""Similarity join of documents by the Jaccard coefficient of their word shingles, size-aware.

Sets are ordered by how many documents hold a shingle, rare ones first. Two similar sets then share a
shingle among the first few of both. Sets up to a boundary are *light*: they list all pairs of shingles
from a slightly longer start, of which two similar sets share one; a pair is rarer than its parts, and
short starts have few pairs. Larger sets are *heavy*: they are found in the inverted lists of single
shingles, as are the light ones that can be similar to them. The boundary is where listing pairs becomes
dearer than scanning lists. Shingles in one document only open no list.

Lists give candidates, never all pairs of a list. Every set joins the group of one leader, the set of its
lists with the fewest rare shingles that it meets most often: copies of an original meet the original. In
a group, inverted lists of all shingles are scanned and counted, from the leader first; sets that are in
the leader's component by then need no scan of their own. A large group is split into blocks, and every
pair of blocks is a task. Then sets that share a list, but neither group nor component, are compared one
by one. All comparisons are exact; what is left out are links inside a component that is known already.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecensus.llm.buckets import (
    ANSWER, ANSWER_KINDS, CHUNK_DOCS, SENT, SENT_KINDS, Hashed, arrow_table,
    chunked, on_answers, on_chunks, packed, text_groups, unpacked,
)
from pagecensus.llm.common import (
    arrow_map, mixed, prefix_hashes, shuffle_parts, span_hashes, stage, utf8, window_hashes, word_spans,
)
from pagecensus.llm.components import components

WORDS = 5
PERCENT = 80
# What reading one entry of an inverted list costs, in listed pairs.
LIST_COST = 3
# Bytes of a shingle's hash that sets are compared by.
_SET_BYTES = 6
# Sets of a group that are scanned together; larger groups are split.
BLOCK_SETS = 1024


def least_overlap(size: int, percent: int) -> int:
    """How many shingles a set of ``size`` shares with any similar set."""
    return -(-percent * size // 100)


def start_length(size: int, percent: int, shared: int) -> int:
    """Length of the start of a set that holds ``shared`` of the shingles common with a similar set."""
    return min(size, size - least_overlap(size, percent) + shared)


def boundary(percent: int, list_cost: float = LIST_COST) -> int:
    """The largest size up to which listing pairs costs no more than scanning the lists."""
    size, cheaper = 1, 1
    while size <= cheaper + 100:
        pairs = start_length(size, percent, 2) * (start_length(size, percent, 2) - 1) // 2
        if pairs <= start_length(size, percent, 1) * (1 + list_cost):
            cheaper = size
        size += 1
    return cheaper


class Chunk(Hashed):
    """The distinct shingles of a chunk's documents, sorted by document."""

    sent_bits = 32

    def __init__(self, texts: list[bytes], words: int, bits: int):
        hashes, owners = [], []
        for begin, some in text_groups(texts):
            joined = b"\n".join(some).lower()
            starts, ends = word_spans(joined)
            if not len(starts):
                continue
            bounds = np.cumsum([len(t) + 1 for t in some])
            doc = np.searchsorted(bounds, starts, side="right")
            counts = np.bincount(doc, minlength=len(some))
            word = span_hashes(prefix_hashes(np.frombuffer(joined, dtype=np.uint8)), starts, ends)
            shingles = window_hashes(word, words)
            whole = doc[: len(shingles)] == doc[words - 1 :][: len(shingles)]
            own, of = [shingles[whole]], [doc[: len(shingles)][whole]]
            first = np.cumsum(counts) - counts
            for few in range(1, words):
                at = np.flatnonzero(counts == few)
                if len(at):
                    spread = np.stack([word[first[at] + i] for i in range(few)], axis=1)
                    own.append(mixed(window_hashes(spread.ravel(), few)[::few] + np.uint64(few)))
                    of.append(at)
            hashes.append(np.concatenate(own))
            owners.append(np.concatenate(of) + begin)
        self.hash = np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64)
        self.doc = np.concatenate(owners) if owners else np.empty(0, dtype=np.int64)
        order = np.lexsort((self.hash, self.doc))
        self.hash, self.doc = self.hash[order], self.doc[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (self.hash[1:] != self.hash[:-1]) | (self.doc[1:] != self.doc[:-1])
        self.hash, self.doc = self.hash[new], self.doc[new]
        self.size = np.bincount(self.doc, minlength=len(texts))
        self.distinct(bits)


def _of_table(docs: pa.Table, words: int, bits: int) -> Chunk:
    return Chunk([utf8(t) for t in docs.column("text").to_pylist()], words, bits)


def _send_shingles(docs: pa.Table, words: int, bits: int) -> pa.Table:
    chunk = _of_table(docs, words, bits)
    number = docs.column("chunk")[0].as_py()
    counts = np.minimum(chunk.last - chunk.first + 1, 255).astype(np.uint8)
    low = chunk.sent.astype(np.uint32)
    rows = [(number, b, None, None, None, low[s].tobytes(), counts[s].tobytes()) for b, s in chunk.slices()]
    return arrow_table(rows, SENT_KINDS, SENT)


def _answer_counts(rows: pa.Table) -> pa.Table:
    """Which shingles several documents hold, and the magnitude of how many."""
    listed = rows.to_pylist()
    keys = np.frombuffer(b"".join(r["keys"] for r in listed), dtype=np.uint32)
    counts = np.frombuffer(b"".join(r["values"] for r in listed), dtype=np.uint8).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(order), dtype=bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    total = np.add.reduceat(counts[order], np.flatnonzero(new))
    held = np.empty(len(keys), dtype=np.int64)
    held[order] = total[np.cumsum(new) - 1]
    out, at = [], 0
    for row in listed:
        own = held[at : at + len(row["values"])]
        at += len(own)
        if (own > 1).any():
            magnitude = np.log2(own[own > 1]).astype(np.uint8)
            out.append((row["chunk"], row["bucket"], packed(own > 1), magnitude.tobytes(), None, None))
    return arrow_table(out, ANSWER_KINDS, ANSWER)


_KEY = np.dtype([("key", "<u8"), ("node", "<i8"), ("size", "<u4"), ("place", "<u4"), ("rare", "<u4")])
FOUND = "kind int, bucket int, doc_id long, node long, size int, data binary"
_FOUND_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
_DOC, _SET, _KEYS = 0, 1, 2


def _find(docs: pa.Table, answers: pa.Table, words: int, bits: int, percent: int, light: int) -> pa.Table:
    """Documents with their set's name, sets that may be similar to others, and their keys by bucket."""
    if not docs.num_rows:
        return arrow_table([], _FOUND_KINDS, FOUND)
    chunk = _of_table(docs, words, bits)
    magnitude = np.zeros(len(chunk.sent), dtype=np.uint8)
    for answer in answers.to_pylist():
        own = slice(int(chunk.cuts[answer["bucket"]]), int(chunk.cuts[answer["bucket"] + 1]))
        flags = unpacked(answer["flags"], own.stop - own.start)
        magnitude[own.start + np.flatnonzero(flags)] = 1 + np.frombuffer(answer["left"], dtype=np.uint8)
    bounds = np.cumsum([0, *chunk.size])
    commonness = magnitude[chunk.of]
    rows, keys, seen = [], [], set()
    for i, doc_id in enumerate(docs.column("doc_id").to_pylist()):
        own = slice(int(bounds[i]), int(bounds[i + 1]))
        size = own.stop - own.start
        if not size:
            rows.append((_DOC, 0, doc_id, None, 0, None))
            continue
        hashes, common = chunk.hash[own], commonness[own]
        name = mixed(np.bitwise_xor.reduce(mixed(hashes), keepdims=True) + np.add.reduce(hashes, keepdims=True))
        node = int(name.view(np.int64)[0])
        rows.append((_DOC, 0, doc_id, node, size, None))
        if node in seen:
            continue
        seen.add(node)
        rare = int((common == 0).sum())
        start = start_length(size, percent, 2 if size <= light else 1)
        if rare >= start:
            continue  # all of the start is in this document only
        order = np.lexsort((hashes, common))
        ordered = hashes[order]
        places = np.arange(rare, start)
        own_keys, own_places = [], []
        if rare == 0:
            own_keys.append(name ^ np.uint64(1))
            own_places.append(np.zeros(1, dtype=np.int64))
        if size <= light:
            first, second = np.triu_indices(len(places), 1)
            own_keys.append(mixed(ordered[places[first]] + mixed(ordered[places[second]])))
            own_places.append(places[first])
        if 100 * size >= percent * (light + 1):
            single = places[places < start_length(size, percent, 1)]
            own_keys.append(ordered[single])
            own_places.append(single)
        values = np.concatenate(own_keys)
        some = np.zeros(len(values), dtype=_KEY)
        some["key"], some["place"] = values, np.concatenate(own_places)
        some["node"], some["size"], some["rare"] = node, size, rare
        keys.append(some)
        low = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_SET_BYTES]
        rows.append((_SET, 0, None, node, size, low.tobytes()))
    if keys:
        every = np.concatenate(keys)
        bucket = every["key"] >> np.uint64(63 - bits) >> np.uint64(1)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(2**bits + 1, dtype=np.uint64))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            rows.append((_KEYS, b, None, None, 0, every[order[cuts[b] : cuts[b + 1]]].tobytes()))
    return arrow_table(rows, _FOUND_KINDS, FOUND)


def _lists(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A bucket's entries by key, size and node, without repetition, and where each list begins."""
    entries = np.frombuffer(b"".join(rows.column("data").to_pylist()), dtype=_KEY)
    entries = entries[np.lexsort((entries["node"], entries["rare"], entries["key"]))]
    new = np.ones(len(entries), dtype=bool)
    new[1:] = (entries["key"][1:] != entries["key"][:-1]) | (entries["node"][1:] != entries["node"][:-1])
    entries = entries[new]
    first = np.flatnonzero(np.diff(entries["key"], prepend=entries["key"][:1] ^ np.uint64(1)))
    sizes = np.diff(np.append(first, len(entries)))
    kept = np.repeat(sizes > 1, sizes)
    entries = entries[kept]
    return entries, np.repeat(np.cumsum(sizes[sizes > 1]) - sizes[sizes > 1], sizes[sizes > 1])


LED = "node long, leader long, met long"


def _leaders(rows: pa.Table, percent: int) -> pa.Table:
    """Each set with the leader of its lists, and in how many of the bucket's lists they meet."""
    entries, first = _lists(rows)
    leader = entries[first]
    fits = (entries["node"] != leader["node"]) & (
        100 * np.minimum(entries["size"], leader["size"]).astype(np.int64)
        >= percent * np.maximum(entries["size"], leader["size"]).astype(np.int64)
    )
    pairs = np.stack([entries["node"][fits], leader["node"][fits]], axis=1)
    pairs, met = np.unique(pairs, axis=0, return_counts=True) if len(pairs) else (pairs, np.empty(0, dtype=np.int64))
    columns = (pairs[:, 0], pairs[:, 1], met)
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["node", "leader", "met"])


LISTED = "key long, node long, size int, place int"


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            e = np.frombuffer(raw, dtype=_KEY)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(e["key"].astype(np.int64)), pa.array(e["node"].astype(np.int64)),
                    pa.array(e["size"].astype(np.int32)), pa.array(e["place"].astype(np.int32)),
                ],
                ["key", "node", "size", "place"],
            )


def _decoded(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // _SET_BYTES, 8), dtype=np.uint8)
    wide[:, :_SET_BYTES] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, _SET_BYTES)
    return wide.view("<u8").ravel()


def _similar(percent: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for u, v, a, b in zip(us, vs, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                both = np.concatenate([_decoded(a), _decoded(b)])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(both) - shared):
                    out.append((u, v))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["u", "v"])

    return compare


def _linked_in_group(nodes: list[int], sets: list[np.ndarray], leader: int, percent: int) -> list[tuple[int, int]]:
    """Links that connect what is similar in a group, by scanning its inverted lists."""
    sizes = np.array([len(s) for s in sets])
    tokens = np.concatenate(sets)
    owners = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owners = tokens[order], owners[order]
    first = np.searchsorted(tokens, tokens)
    counts = np.searchsorted(tokens, tokens, side="right") - first
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    bounds = np.cumsum([0, *sizes])
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []

    def scan(i: int) -> None:
        at = place[bounds[i] : bounds[i + 1]]
        begin, size = first[at], counts[at]
        steps = np.ones(int(size.sum()), dtype=np.int64)
        ends = np.cumsum(size)
        steps[0] = begin[0]
        steps[ends[:-1]] = begin[1:] - begin[:-1] - size[:-1] + 1
        shared = np.bincount(owners[np.cumsum(steps)], minlength=len(sets))
        for j in np.flatnonzero(100 * shared >= percent * (sizes + sizes[i] - shared)).tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[a] = b
                links.append((nodes[i], nodes[j]))

    scan(leader)
    for i in range(len(sets)):
        if i != leader and root(i) != root(leader):
            scan(i)
    return links


def _scan(rows: pa.Table, percent: int) -> pa.Table:
    """The groups, or pairs of blocks of one, that fell to a task."""
    of: dict[tuple, dict[int, bytes]] = {}
    columns = (rows.column(c).to_pylist() for c in ("leader", "one", "other", "node", "data"))
    for leader, one, other, node, data in zip(*columns, strict=True):
        of.setdefault((leader, one, other), {})[node] = data
    links = []
    for (leader, _, _), sets in sorted(of.items()):
        nodes = sorted(sets)
        links += _linked_in_group(nodes, [_decoded(sets[n]) for n in nodes], nodes.index(leader), percent)
    columns = zip(*links, strict=True) if links else ([], [])
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["u", "v"])


def _group_links(best: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links inside the groups of leaders (``node, leader``)."""
    tasks = 4 * shuffle_parts(best.sparkSession)
    blocks = best.groupBy("leader").agg(F.expr(f"CAST(ceil(count(*) / {block}) AS INT) AS blocks"))
    members = best.union(best.selectExpr("leader AS node", "leader")).distinct()
    placed = members.join(blocks, "leader").join(sets, "node")
    own = "CAST(pmod(xxhash64(node), blocks) AS INT)"
    # A set goes to every pair of blocks that holds its own; the leader to all pairs.
    pairs = (
        "CASE WHEN blocks = 1 THEN array(struct(0 AS one, 0 AS other)) WHEN node = leader THEN "
        "flatten(transform(sequence(0, blocks - 1), i -> transform(sequence(i, blocks - 1), j -> struct(i AS one, j AS other)))) "
        f"ELSE transform(sequence(0, blocks - 1), i -> struct(least(i, {own}) AS one, greatest(i, {own}) AS other)) END"
    )
    spread = placed.selectExpr("leader", "node", "data", "blocks", f"explode({pairs}) AS pair").selectExpr(
        "leader", "node", "data", "pair.one", "pair.other",
        f"CASE WHEN blocks = 1 THEN pmod(xxhash64(leader), {tasks}) ELSE xxhash64(leader, pair.one, pair.other) END AS task",
    )

    def scanned(rows: pa.Table) -> pa.Table:
        return _scan(rows, percent)

    return spread.groupBy("task").applyInArrow(scanned, "u long, v long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``u, v`` whose sets are similar."""
    rows = (
        pairs.join(sets.selectExpr("node AS u", "data AS a"), "u")
        .join(sets.selectExpr("node AS v", "data AS b"), "v")
        .select("u", "v", "a", "b")
    )
    return arrow_map(rows, _similar(percent), "u long, v long")


def similar_documents(
    docs: DataFrame,
    words: int = WORDS,
    percent: int = PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_docs: int = CHUNK_DOCS,
    list_cost: float = LIST_COST,
    block_sets: int = BLOCK_SETS,
) -> DataFrame:
    """``doc_id, n_shingles, component_id``: documents linked if ``100 * shared >= percent * united``.

    The letters A to Z are lower-cased; a text with fewer than ``words`` words has all of them as its one
    shingle; an empty or null text has none and is linked with nothing. ``component_id`` is the smallest
    id that links lead to, the own one included; a null id is never smallest. Repeated rows and ids are
    kept and belong to the component of their text. An empty table gives no rows; other columns are
    ignored. ``percent`` is at least 51.
    """
    rows = docs.selectExpr(f"CAST(`{id_col}` AS LONG) AS doc_id", f"`{text_col}` AS text")
    by_chunk, bits = chunked(rows, chunk_docs)
    light = boundary(percent, list_cost)
    own = {"words": words, "bits": bits}
    counts = by_chunk.applyInArrow(on_chunks(_send_shingles, own), SENT).groupBy("bucket")
    answers = counts.applyInArrow(_answer_counts, ANSWER).groupBy("chunk")
    find = on_answers(_find, {**own, "percent": percent, "light": light})
    found = stage(by_chunk.cogroup(answers).applyInArrow(find, FOUND), "jaccard-found")

    sets = found.where(f"kind = {_SET}").select("node", "data").dropDuplicates(["node"])
    keys = found.where(f"kind = {_KEYS}").select("bucket", "data")

    def leaders(rows: pa.Table) -> pa.Table:
        return _leaders(rows, percent)

    met = keys.groupBy("bucket").applyInArrow(leaders, LED).groupBy("node", "leader").agg(F.sum("met").alias("met"))
    best = stage(met.groupBy("node").agg(F.expr("max_by(leader, struct(met, leader)) AS leader")), "jaccard-led")
    first = stage(_group_links(best, sets, percent, block_sets), "jaccard-links")
    known = stage(components(first), "jaccard-known")

    # Sets of one list that neither a group nor a component holds together.
    listed = arrow_map(keys.select("data"), _listed, LISTED).distinct()
    groups = best.join(known, "node", "full").selectExpr(
        "node", "coalesce(leader, node) AS leader", "coalesce(component, node) AS component"
    )
    placed = listed.join(groups, "node", "left").selectExpr(
        "key", "node", "size", "place", "coalesce(leader, node) AS leader", "coalesce(component, node) AS component"
    )
    open_keys = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b")
    open_keys = open_keys.select("key")
    placed = stage(placed.join(open_keys, "key", "left_semi"), "jaccard-open")
    other = placed.selectExpr(
        "key", "node AS v", "size AS size_v", "place AS place_v", "leader AS leader_v", "component AS component_v"
    )
    needed = f"{percent} * (size + size_v)"
    pairs = (
        placed.join(other, "key")
        .where("component < component_v AND leader <> leader_v AND node <> leader_v AND leader <> v")
        .where(f"100 * least(size, size_v) >= {percent} * greatest(size, size_v)")
        # What can still be shared behind the places of the common shingle, that one included.
        .where(f"{100 + percent} * (least(size - place, size_v - place_v) + least(place, place_v)) >= {needed}")
        .selectExpr("node AS u", "v")
        .distinct()
    )
    second = stage(_verified(pairs, sets, percent), "jaccard-links")
    linked = components(first.union(second))

    documents = found.where(f"kind = {_DOC}").selectExpr("doc_id", "CAST(size AS LONG) AS n_shingles", "node")
    smallest = documents.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = smallest.join(linked, "node", "left").selectExpr("node", "least", "coalesce(component, node) AS component")
    of_component = named.groupBy("component").agg(F.min("least").alias("component_id"))
    names = named.join(of_component, "component").select("node", "component_id")
    return documents.join(names, "node", "left").selectExpr(
        "doc_id", "n_shingles", "coalesce(component_id, doc_id) AS component_id"
    )


def one_of_each(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents with the smallest id of their component, with their columns unchanged.

    Of rows with equal id and text one stays. A document without an id cannot be named in a component and
    stays; of rows with one id and different texts, all go if one of them does. Columns may have any names.
    """
    found = similar_documents(docs, words, percent, id_col, text_col).where("doc_id <> component_id")
    key = f"_key_{uuid.uuid4().hex}"
    keyed = docs.withColumn(key, F.col(f"`{id_col}`").cast("long"))
    # Rows are only compared where an id is repeated; the texts of others do not move.
    repeated = keyed.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key)
    single = keyed.join(repeated, key, "left_anti")
    several = keyed.join(repeated, key, "left_semi").dropDuplicates([key, text_col])
    kept = single.unionByName(several).join(found.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def brute_force(
    docs: list[tuple[int, str | None]], words: int = WORDS, percent: int = PERCENT
) -> dict[int, tuple[int, int]]:
    """The same by definition, for tests: document -> number of shingles, component."""
    sets = {}
    for doc_id, text in docs:
        own = utf8(text).lower().split()
        sets[doc_id] = {tuple(own[i : i + words]) for i in range(max(1, len(own) - words + 1))} if own else set()
    parent = {d: d for d in sets}

    def root(d: int) -> int:
        while parent[d] != d:
            parent[d] = parent[parent[d]]
            d = parent[d]
        return d

    ids = sorted(sets)
    holders: dict[tuple, list[int]] = {}
    for d in ids:
        for shingle in sets[d]:
            holders.setdefault(shingle, []).append(d)
    for a in ids:
        for b in {x for shingle in sets[a] for x in holders[shingle] if x > a}:
            shared = len(sets[a] & sets[b])
            if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {d: (len(sets[d]), root(d)) for d in ids}
