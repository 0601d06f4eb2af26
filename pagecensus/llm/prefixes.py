"""Prefix trie of conversations by van Emde Boas recursion.

A node is a distinct sequence of first turns. The depths are cut in half: the prefixes up to the cut get names,
which split the problem into an upper trie and a forest below each named prefix. Both are cut again, all pieces
of a level in one pass, down to pieces of ``PIECE`` turns, so that a trie of depth d takes log(d) rounds. Totals
of subtrees go the other way: two neighbouring pieces grow together, the totals of the lower trees are grafted
onto the prefixes they hang from, and from there onto their ancestors in the upper piece.

A node's name is its smallest member together with its depth. Turns are compared by the SHA-256 digests of
their role and text. Counts combine before they are shuffled, so a prefix that very many conversations share
is no large group anywhere; rows that look up its name are joined, which Spark splits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from pagecensus.llm.common import arrow_map, shuffle_parts, stage

# Turns of the smallest pieces, whose prefixes are named at once.
PIECE = 4
# Bytes of ids that are hashed at a time.
HASHED_BYTES = 1 << 16

_WORDS = r"regexp_count(text, r'[^\x20\x09-\x0D]+')"


# ---- turns in order --------------------------------------------------------------------------


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each conversation within a sorted part, from 1."""
    last, count = None, 0
    for batch in batches:
        ids = batch.column("conv_id").to_numpy()
        if not len(ids):
            continue
        new = np.ones(len(ids), dtype=bool)
        new[1:] = ids[1:] != ids[:-1]
        new[0] = last is None or ids[0] != last
        begin = np.maximum.accumulate(np.where(new, np.arange(len(ids)), -count))
        place = np.arange(len(ids)) - begin + 1
        last, count = ids[-1], int(place[-1])
        yield batch.append_column("place", pa.array(place.astype(np.int64)))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, turn_key, words``: the turns of each conversation in order, ``pos`` from 1.

    ``conversations`` has ``conv_id, turn, role, text``. A null role or text counts as empty, a null turn comes
    first, equal turns are ordered by role and then by the digest of the turn. Rows without a ``conv_id`` belong
    to no conversation and are left out; further columns are ignored. Texts are digested before the sort. The
    sort spreads one conversation over several tasks if it has very many turns.
    """
    spark = conversations.sparkSession
    turns = conversations.where("conv_id IS NOT NULL").selectExpr(
        "CAST(conv_id AS LONG) AS conv_id", "CAST(turn AS LONG) AS turn", "coalesce(role, '') AS role",
        "coalesce(text, '') AS text",
    )
    digested = turns.selectExpr(
        "conv_id", "turn", "role",
        "unhex(sha2(concat(octet_length(role), ':', role, text), 256)) AS turn_key", f"CAST({_WORDS} AS LONG) AS words",
    )
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("turn_key")]
    ranged = digested.repartitionByRange(shuffle_parts(spark), *order).sortWithinPartitions(*order)
    parted = ranged.selectExpr("conv_id", "turn_key", "words", "spark_partition_id() AS part")
    schema = "conv_id long, turn_key binary, words long, part int, place long"
    numbered = stage(arrow_map(parted, _numbered, schema), "turns")
    # Conversations that go on in a later part: two per border at most.
    pieces = numbered.groupBy("conv_id", "part").agg(F.max("place").alias("n"))
    before = pieces.groupBy("conv_id").agg(F.expr("array_sort(collect_list(struct(part, n))) AS parts"))
    before = before.where("size(parts) > 1").selectExpr("conv_id", "inline(transform(parts, p -> struct("
        "p.part AS part, aggregate(filter(parts, q -> q.part < p.part), 0L, (sum, q) -> sum + q.n) AS earlier)))")  # fmt: skip
    return (
        numbered.join(F.broadcast(before), ["conv_id", "part"], "left")
        .selectExpr("conv_id", "place + coalesce(earlier, 0) AS pos", "turn_key", "words")
    )


# ---- the trie --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Trie:
    """``nodes``: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens``.

    ``ends``: ``conv_id, depth, member``, the conversations that end at each node.
    """

    nodes: DataFrame
    ends: DataFrame


def _pieces(turns: DataFrame) -> DataFrame:
    """``conv_id, piece, n_turns, keys, words``: at most ``PIECE`` turns a row."""
    return (
        turns.groupBy("conv_id", F.expr(f"(pos - 1) DIV {PIECE} AS piece"))
        .agg(F.expr("array_sort(collect_list(struct(pos, turn_key, words))) AS turns"))
        .selectExpr("conv_id", "piece", "turns.turn_key AS keys", "turns.words AS words")
    )


def _blocks(pieces: DataFrame, levels: int) -> list[DataFrame]:
    """Per level the digests of whole blocks of 1, 2, 4, ... pieces."""
    digest = "unhex(sha2(aggregate(keys, binary(''), (all, key) -> concat(all, key)), 256))"
    whole = pieces.where(f"size(keys) = {PIECE}").selectExpr("conv_id", "piece", f"{digest} AS block")
    found = [stage(whole, "blocks")]
    for level in range(1, levels):
        size = 2**level
        halves = found[-1].groupBy("conv_id", F.expr(f"piece DIV {size} * {size} AS piece")).agg(
            F.min_by("block", F.col("piece")).alias("first"),
            F.max_by("block", F.col("piece")).alias("second"), F.count(F.lit(1)).alias("n"),
        )
        both = halves.where("n = 2").selectExpr("conv_id", "piece", "unhex(sha2(concat(first, second), 256)) AS block")
        found.append(stage(both, "blocks"))
    return found


def _cut_names(conversations: DataFrame, blocks: list[DataFrame], root: int) -> DataFrame:
    """``conv_id, piece, name``: the name of the prefix in front of a piece, for the first piece of each block.

    Each round cuts all blocks in half. The prefix at a cut is named by the prefix at the block's beginning
    and the digest of the block's first half.
    """
    known = conversations.selectExpr("conv_id", "0L AS piece", f"{root}L AS name")
    for level in reversed(range(len(blocks))):
        halves = known.join(blocks[level], ["conv_id", "piece"])
        names = halves.groupBy("piece", "name", "block").agg(F.min("conv_id").alias("cut_name"))
        cut = halves.join(names, ["piece", "name", "block"])
        known = known.union(stage(cut.selectExpr("conv_id", f"piece + {2**level} AS piece", "cut_name AS name"), "cuts"))
    return known


_STEPS = (
    "transform(sequence(1, size(keys)), i -> struct(i AS place, words[i - 1] AS words, "
    "unhex(sha2(aggregate(slice(keys, 1, i), binary(''), (all, key) -> concat(all, key)), 256)) AS chain))"
)


def _paths(pieces: DataFrame, known: DataFrame, lengths: DataFrame) -> DataFrame:
    """``conv_id, piece, above, steps``: the nodes a conversation passes in a piece, below the prefix ``above``."""
    steps = pieces.join(known, ["conv_id", "piece"]).join(lengths, "conv_id").selectExpr(
        "conv_id", "piece", "name AS above", "n_turns", f"inline({_STEPS})"
    )
    steps = steps.selectExpr("*", f"n_turns = piece * {PIECE} + place AS ends").drop("n_turns")
    key = ["piece", "above", "place", "chain"]
    names = steps.groupBy(*key).agg(
        F.min("conv_id").alias("name"), F.count(F.lit(1)).alias("n_convs"), F.expr("count_if(ends) AS n_ends")
    )
    named = steps.join(names, key)
    step = "struct(place, name, n_convs, n_ends, words, ends)"
    return named.groupBy("conv_id", "piece", "above").agg(F.expr(f"array_sort(collect_list({step})) AS steps"))


def _own_nodes(paths: DataFrame) -> DataFrame:
    """Every node once, from the path of the conversation that names it."""
    return paths.selectExpr("conv_id AS owner", "piece", "above", "steps", "inline(steps)").where("name = owner").selectExpr(
        "name AS conv_id", f"piece * {PIECE} + place AS depth",
        "if(place = 1, above, steps[place - 2].name) AS parent_conv_id", "n_convs",
        "CAST(n_ends = n_convs AS LONG) AS n_leaves", "(n_convs - 1) * words AS saved_tokens",
    )


_NODE = ["conv_id", "depth", "parent_conv_id"]


def _totals(rows: GroupedData) -> DataFrame:
    return rows.agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))


def _at_steps(rows: DataFrame) -> DataFrame:
    """Give the totals of a row to the nodes of its ``steps`` and add them up."""
    listed = rows.selectExpr("piece", "above", "steps", "n_leaves", "saved_tokens", "posexplode(steps) AS (i, step)")
    nodes = listed.selectExpr(
        "step.name AS conv_id", f"piece * {PIECE} + i + 1 AS depth",
        "if(i = 0, above, steps[i - 1].name) AS parent_conv_id", "n_leaves", "saved_tokens",
    )
    return _totals(nodes.groupBy(*_NODE))


def _within_pieces(paths: DataFrame) -> DataFrame:
    """Totals of subtrees as far as they lie in the node's piece."""
    own = f"inline(transform(filter(steps, s -> s.name = conv_id), s -> struct(slice(steps, 1, s.place) AS line, " \
        "CAST(s.n_ends = s.n_convs AS LONG) AS n_leaves, (s.n_convs - 1) * s.words AS saved_tokens)))"  # fmt: skip
    return _at_steps(paths.selectExpr("piece", "above", own).withColumnRenamed("line", "steps"))


def _grafted(parts: list[DataFrame], paths: DataFrame, half: int) -> DataFrame:
    """What the trees below the cuts of blocks of ``2 * half`` pieces add to the nodes above, up to the block's beginning.

    A prefix at a cut finds its ancestors on the path of the conversation that names it.
    """
    below = reduce(DataFrame.union, parts).where(f"(depth - 1) % {2 * half * PIECE} = {half * PIECE}")
    cut = F.expr(f"(depth - 1) DIV {PIECE} AS cut")
    trees = _totals(below.groupBy(F.col("parent_conv_id").alias("conv_id"), cut))
    upper = trees.selectExpr("conv_id", "n_leaves", "saved_tokens", f"explode(sequence(cut - {half}, cut - 1)) AS piece")
    return _at_steps(paths.select("conv_id", "piece", "above", "steps").join(upper, ["conv_id", "piece"]))


def trie(conversations: DataFrame, turns: DataFrame) -> Trie:
    """The trie of all ``conversations`` (``conv_id, n_turns``, one row each, also without turns).

    ``turns`` has ``conv_id, pos, turn_key, words`` with ``pos`` from 1 to ``n_turns``. Without conversations there
    are no nodes, not even a root. The root has depth 0, all conversations as members and no parent. Intermediate
    tables are written to the shared folder.
    """
    conversations, turns = stage(conversations.select("conv_id", "n_turns"), "conversations"), stage(turns, "own-turns")
    n_convs, root, longest = conversations.selectExpr("count(*)", "min(conv_id)", "max(n_turns)").first()
    root, longest = root or 0, longest or 0
    levels = max(0, -(-longest // PIECE) - 1).bit_length()
    pieces = stage(_pieces(turns), "pieces")
    lengths = conversations.where("n_turns > 0")
    known = _cut_names(lengths.select("conv_id"), _blocks(pieces, levels) if levels else [], root)
    paths = stage(_paths(pieces, known, lengths), "paths")

    totals = [stage(_within_pieces(paths), "totals")]
    for level in range(levels):
        totals.append(stage(_grafted(totals, paths, 2**level), "totals"))
    sums = _totals(reduce(DataFrame.union, totals).groupBy("conv_id", "depth"))
    own = stage(_own_nodes(paths).drop("n_leaves", "saved_tokens"), "nodes")
    children = own.selectExpr("parent_conv_id AS conv_id", "depth - 1 AS depth").groupBy("conv_id", "depth")
    children = children.agg(F.count(F.lit(1)).alias("n_children"))
    inner = own.join(sums, ["conv_id", "depth"]).join(children, ["conv_id", "depth"], "left")
    first = sums.where("depth = 1").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
        F.count(F.lit(1)).alias("n_children"))
    top = first.where(F.lit(n_convs > 0)).selectExpr(
        f"{root}L AS conv_id", "0L AS depth", "CAST(NULL AS LONG) AS parent_conv_id", f"{n_convs}L AS n_convs",
        "n_children", "coalesce(n_leaves, 1L) AS n_leaves", "coalesce(saved_tokens, 0L) AS saved_tokens",
    )
    nodes = inner.selectExpr(
        *_NODE, "n_convs", "coalesce(n_children, 0L) AS n_children", "n_leaves", "saved_tokens"
    ).union(top)
    ends = paths.selectExpr("conv_id AS member", "piece", "inline(steps)").where("ends").selectExpr(
        "name AS conv_id", f"piece * {PIECE} + place AS depth", "member"
    )
    turnless = conversations.where("n_turns = 0").selectExpr(f"{root}L AS conv_id", "0L AS depth", "conv_id AS member")
    return Trie(nodes, ends.union(turnless))


# ---- digests of long lists of ids ------------------------------------------------------------

_CHUNK = "conv_id long, depth long, first long, ids binary"
_DIGEST = "conv_id long, depth long, ends_sha256 string"


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], slice]]:
    """Consecutive rows of one node."""
    ids, depths = batch.column("conv_id").to_numpy(), batch.column("depth").to_numpy()
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (ids[1:] != ids[:-1]) | (depths[1:] != depths[:-1])
    cuts = [*np.flatnonzero(new).tolist(), len(ids)]
    for begin, end in zip(cuts, cuts[1:]):
        yield (int(ids[begin]), int(depths[begin])), slice(begin, end)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids as texts of bounded length, ids joined by commas."""
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("ids", pa.binary())])
    step = HASHED_BYTES // 20
    for batch in batches:
        members = batch.column("member").to_pylist()
        rows = []
        for (conv_id, depth), run in _runs(batch):
            for begin in range(run.start, run.stop, step):
                some = members[begin : min(run.stop, begin + step)]
                rows.append((conv_id, depth, some[0], ",".join(map(str, some)).encode()))
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the texts of each node, in order."""
    node, digest = None, None
    for batch in batches:
        texts, done = batch.column("ids"), []
        for own, run in _runs(batch):
            if own != node:
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest, between = own, hashlib.sha256(), b""
            for i in range(run.start, run.stop):
                digest.update(between + texts[i].as_py())
                between = b","
        yield _digest_batch(done)
    if node is not None:
        yield _digest_batch([(*node, digest.hexdigest())])


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
    columns = zip(*rows) if rows else [[]] * 3
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def end_digests(ends: DataFrame) -> DataFrame:
    """``conv_id, depth, ends_sha256``: the digest of the ids that end at a node, ascending, joined by commas.

    A digest has to see its ids in one sequence. They are sorted and written as text by ranges, which splits a
    node with very many ids over tasks; only these texts, some thousand ids a row, then come together, and are
    hashed as they come.
    """
    parts = shuffle_parts(ends.sparkSession)
    order = ["conv_id", "depth", "member"]
    texts = arrow_map(ends.repartitionByRange(parts, *order).sortWithinPartitions(*order), _chunks, _CHUNK)
    together = texts.repartition(parts, "conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first")
    return arrow_map(together, _digests, _DIGEST)


def with_digests(found: Trie) -> DataFrame:
    """The nodes with ``ends_sha256``; a node where nothing ends has the digest of the empty string."""
    digests = found.nodes.join(end_digests(found.ends), ["conv_id", "depth"], "left")
    return digests.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))


# ---- conversations that share an opening -----------------------------------------------------

# Conversations of one group, the first of which gives the opening, and how many lengths an opening can have.
GROUP, OPENINGS = 20, 4


def with_shared_openings(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their group, as ``(conversations, turns)`` for ``trie``.

    Conversation c gets the first h turns of c - c % 20 (all it has, if fewer; none, if there is none) in place
    of its own first h; h is the CRC-32 of c in decimal, modulo 4. It may end up without turns. The remainder
    of a negative id is negative, as in SQL.
    """
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).selectExpr(
        "conv_id", "n", f"conv_id - conv_id % {GROUP} AS source",
        f"CAST(crc32(binary(CAST(conv_id AS STRING))) % {OPENINGS} AS INT) AS h",
    )
    heads = (
        turns.where(f"conv_id % {GROUP} = 0 AND pos < {OPENINGS}")
        .groupBy(F.col("conv_id").alias("source"))
        .agg(F.expr("array_sort(collect_list(struct(pos, turn_key, words))) AS opening"))
    )
    none = "CAST(array() AS ARRAY<STRUCT<pos: BIGINT, turn_key: BINARY, words: BIGINT>>)"
    planned = own.join(heads, "source", "left").selectExpr(
        "conv_id", "h", "n", f"if(h = 0, {none}, coalesce(slice(opening, 1, h), {none})) AS opening"
    )
    planned = stage(planned, "openings")
    rest = turns.join(planned.selectExpr("conv_id", "h", "size(opening) AS given"), "conv_id").where("pos > h")
    rebuilt = rest.selectExpr("conv_id", "pos - h + given AS pos", "turn_key", "words").union(
        planned.selectExpr("conv_id", "inline(opening)")
    )
    return planned.selectExpr("conv_id", "size(opening) + greatest(n - h, 0) AS n_turns"), rebuilt
