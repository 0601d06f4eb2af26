"""Hard negatives by exact integer scores, computed in a residue number system.

Components become integers. Their inner products are taken modulo several small primes, each as a float32
matrix product that cannot round, and put together by the Chinese remainder theorem. Anchors and rows meet in
blocks; a block keeps its few best rows per anchor, and a window picks the best of all blocks.

Defined results:

- Rows with a null label, a null vector, or a null or non-finite component take no part.
- Vectors of different lengths are compared as if zeros followed the shorter one; an empty one scores 0.
- Higher scores come first, ties by smaller ``vec_id``, a null id last. Repeated rows are rows of their own:
  each is an anchor, a positive or a negative for itself, and only the very same row is not its own positive.
- An empty table gives an empty result. Further columns are ignored.
- Components so large that a score might not fit 64 bits raise ``ValueError``.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagecensus.llm.common import stage

# The moduli are primes from here down; float32 holds integers up to 2**24 exactly.
LARGEST_MODULUS = 509
EXACT = 2**24
DIMS_AT_ONCE = EXACT // (LARGEST_MODULUS // 2) ** 2
# Rows and anchors of a block at most; small tables are cut finer, into up to four parts.
ROWS, FEWER_ROWS = 1 << 16, 1 << 12
ANCHORS, FEWER_ANCHORS = 1 << 14, 1 << 8
# Rows and anchors whose scores are in memory at a time.
TILE_ROWS, TILE_ANCHORS = 4096, 512
NO_SCORE = np.iinfo(np.int64).min
NO_ID = np.iinfo(np.int64).max

_USABLE = (
    "label IS NOT NULL AND embedding IS NOT NULL AND "
    "NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity'))"
)


def moduli(bound: int) -> list[int]:
    """Primes whose product tells apart all integers from ``-bound`` to ``bound``."""
    if bound >= 2**63:
        raise ValueError("scores may not fit 64 bits; scale the vectors down")
    found, product, p = [], 1, LARGEST_MODULUS
    while product <= 2 * bound:
        if all(p % q for q in range(3, int(p**0.5) + 1, 2)):
            found.append(p)
            product *= p
        p -= 2
    return found or [LARGEST_MODULUS]


def balanced(values: np.ndarray, p: int) -> np.ndarray:
    """Residues between ``-(p - 1) / 2`` and ``(p - 1) / 2``."""
    half = p // 2
    return (values + half) % p - half


class Residues:
    """A matrix of integers as one float32 matrix per modulus."""

    def __init__(self, values: np.ndarray, primes: list[int]):
        self.parts = [balanced(values, p).astype(np.float32) for p in primes]

    def __getitem__(self, rows: slice) -> list[np.ndarray]:
        return [part[rows] for part in self.parts]


def products(left: list[np.ndarray], right: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact inner products of all rows of ``left`` with all rows of ``right``.

    The digits of the mixed-radix form are balanced as well, so their sum has the right sign.
    """
    digits: list[np.ndarray] = []
    for a, b, p in zip(left, right, primes, strict=True):
        residue = np.zeros((len(a), len(b)), dtype=np.int32)
        for begin in range(0, a.shape[1], DIMS_AT_ONCE):
            part = slice(begin, begin + DIMS_AT_ONCE)
            residue = balanced(residue + (a[:, part] @ b[:, part].T).astype(np.int32), p)
        known = np.zeros_like(residue)
        for digit, q in zip(reversed(digits), reversed(primes[: len(digits)]), strict=True):
            known = (known * (q % p) + digit) % p
        weight = 1
        for q in primes[: len(digits)]:
            weight = weight * q % p
        digits.append(balanced((residue - known) * pow(weight, -1, p), p))
    total = np.zeros(digits[0].shape, dtype=np.int64)
    for digit, q in zip(reversed(digits), reversed(primes[: len(digits)]), strict=True):
        total *= np.int64(q)  # wraps around, the sum modulo 2**64 is the score
        total += digit
    return total


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and columns of each row's ``k`` best allowed columns; of equal scores the first column."""
    left = np.where(allowed, scores, NO_SCORE)
    rows = np.arange(len(scores))
    values = np.full((len(scores), k), NO_SCORE, dtype=np.int64)
    columns = np.zeros((len(scores), k), dtype=np.int64)
    for i in range(k):
        columns[:, i] = left.argmax(axis=1)
        values[:, i] = left[rows, columns[:, i]]
        if (values[:, i] == NO_SCORE).all():
            break
        left[rows, columns[:, i]] = NO_SCORE
    return values, columns


class Best:
    """The ``k`` best columns so far; columns come in ascending order, so earlier ones win ties."""

    def __init__(self, rows: int, k: int):
        self.values = np.full((rows, k), NO_SCORE, dtype=np.int64)
        self.columns = np.zeros((rows, k), dtype=np.int64)

    def take(self, scores: np.ndarray, allowed: np.ndarray, first: int) -> None:
        k = self.values.shape[1]
        values, columns = best(scores, allowed, k)
        values = np.concatenate([self.values, values], axis=1)
        columns = np.concatenate([self.columns, columns + first], axis=1)
        # All bits inverted: ascending order without the overflow of a minus sign.
        order = np.argsort(~values, axis=1, kind="stable")[:, :k]
        self.values = np.take_along_axis(values, order, axis=1)
        self.columns = np.take_along_axis(columns, order, axis=1)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, column and score of what was found."""
        rows, places = np.nonzero(self.values != NO_SCORE)
        return rows, self.columns[rows, places], self.values[rows, places]


class Block:
    """Rows of a block in ascending order of their ids."""

    def __init__(self, table: pa.Table, scale: int, dims: int, primes: list[int]):
        ids = table.column("vec_id").fill_null(NO_ID).to_numpy()
        uids = table.column("uid").to_numpy()
        self.order = np.lexsort((uids, ids))
        self.ids, self.uids = ids[self.order], uids[self.order]
        self.labels = table.column("label").to_numpy()[self.order]
        vectors = table.column("embedding").combine_chunks()
        sizes = vectors.value_lengths().to_numpy()
        values = np.zeros((len(sizes), dims))
        values[np.arange(dims) < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
        self.residues = Residues(np.floor(scale * values[self.order]).astype(np.int64), primes)

    def __len__(self) -> int:
        return len(self.ids)


def tiles(size: int, step: int) -> Iterator[slice]:
    for begin in range(0, size, step):
        yield slice(begin, min(size, begin + step))


def listed(ids: np.ndarray) -> pa.Array:
    """Ids as Arrow values, the place holder as null."""
    return pa.array(ids, mask=ids == NO_ID)


FOUND = "uid long, vec_id long, other_id long, score long"


def _positive_rows(anchors: pa.Table, rows: pa.Table, scale: int, dims: int, primes: list[int], k: int) -> pa.Table:
    """For each anchor the ``k`` best other rows of its label in this block."""
    left, right = Block(anchors, scale, dims, primes), Block(rows, scale, dims, primes)
    out = []
    for a in tiles(len(left), TILE_ANCHORS):
        kept = Best(a.stop - a.start, k)
        for b in tiles(len(right), TILE_ROWS):
            same = left.labels[a, None] == right.labels[None, b]
            allowed = same & (left.uids[a, None] != right.uids[None, b])
            kept.take(products(left.residues[a], right.residues[b], primes), allowed, b.start)
        at, column, score = kept.found()
        out.append((left.uids[a][at], left.ids[a][at], right.ids[column], score))
    uid, vec_id, other, score = (np.concatenate(c) for c in zip(*out, strict=True))
    return pa.table({"uid": uid, "vec_id": listed(vec_id), "other_id": listed(other), "score": score})


MINED = "uid long, place int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def share_up(values: np.ndarray, percent: int) -> np.ndarray:
    """``percent`` of the values, rounded up, without overflow."""
    return -share_down(-values, percent)


def share_down(values: np.ndarray, percent: int) -> np.ndarray:
    return values // 100 * percent + values % 100 * percent // 100


def _negative_rows(
    anchors: pa.Table, rows: pa.Table, scale: int, dims: int, primes: list[int], k: int, least: int, most: int
) -> pa.Table:
    """For each anchor and positive the ``k`` best rows of another label within the range, in this block."""
    left, right = Block(anchors, scale, dims, primes), Block(rows, scale, dims, primes)
    scores_of = anchors.column("positive_scores").to_pylist()
    ids_of = anchors.column("positive_ids").to_pylist()
    wanted = max(map(len, scores_of))
    scores = np.zeros((len(left), wanted), dtype=np.int64)
    has = np.zeros((len(left), wanted), dtype=bool)
    for row, source in enumerate(left.order.tolist()):
        own = scores_of[source]
        scores[row, : len(own)], has[row, : len(own)] = own, True
    out = []
    for a in tiles(len(left), TILE_ANCHORS):
        kept = [Best(a.stop - a.start, k) for _ in range(wanted)]
        for b in tiles(len(right), TILE_ROWS):
            found = products(left.residues[a], right.residues[b], primes)
            other = left.labels[a, None] != right.labels[None, b]
            for place in range(wanted):
                positive = scores[a, place, None]
                allowed = other & has[a, place, None] & (found >= share_up(positive, least))
                allowed &= found <= share_down(positive, most)
                kept[place].take(found, allowed, b.start)
        for place in range(wanted):
            at, column, score = kept[place].found()
            at = at + a.start
            positive = [ids_of[i][place] for i in left.order[at].tolist()]
            out.append((
                pa.array(left.uids[at]), pa.array(np.full(len(at), place, dtype=np.int32)), listed(left.ids[at]),
                pa.array(positive, pa.int64()), pa.array(scores[at, place]), listed(right.ids[column]), pa.array(score),
            ))
    names = [f.split()[0] for f in MINED.split(", ")]
    return pa.table([pa.chunked_array(c) for c in zip(*out, strict=True)], names=names)


def _parts(size: int, most: int, fewer: int) -> int:
    return max(1, -(-size // most), min(4, -(-size // fewer)))


def hard_negatives(
    vectors: DataFrame,
    anchors: str,
    positives: int = 5,
    negatives: int = 3,
    least: int = 50,
    most: int = 95,
    scale: int = 256,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` has ``vec_id, embedding, label``; ``anchors`` is a condition on them. Components are
    ``floor(scale * x)``. An anchor's positives are the ``positives`` best other rows of its label; for each,
    the ``negatives`` best rows of other labels whose score is ``least`` to ``most`` percent of the
    positive's are returned. Scores are computed twice, once for each window, instead of being stored.
    """
    rows = vectors.where(_USABLE).selectExpr(
        "monotonically_increasing_id() AS uid", "CAST(vec_id AS LONG) AS vec_id", "CAST(label AS LONG) AS label",
        "CAST(embedding AS ARRAY<FLOAT>) AS embedding",
    )
    rows = stage(rows, "vectors")
    largest = "max(aggregate(embedding, 0D, (most, x) -> greatest(most, abs(CAST(x AS DOUBLE)))))"
    size, queries, dims, reach = rows.selectExpr(
        "count(*)", f"count_if({anchors})", "coalesce(max(size(embedding)), 0)", f"coalesce({largest}, 0D)"
    ).first()
    primes = moduli(dims * (floor(reach * scale) + 1) ** 2)
    shape = {"scale": scale, "dims": dims, "primes": primes}
    across, down = _parts(queries, ANCHORS, FEWER_ANCHORS), _parts(size, ROWS, FEWER_ROWS)
    # Each anchor goes to all blocks of rows and each row to all blocks of anchors.
    queried = rows.where(F.expr(anchors)).withColumn("a", F.expr(f"pmod(xxhash64(uid), {across})"))
    queried = queried.withColumn("r", F.expr(f"explode(sequence(0, {down - 1}))"))
    # New names for the columns: the two sides of a cogroup must not share them.
    others = rows.select(*[F.col(name).alias(name) for name in rows.columns])
    others = others.withColumn("r", F.expr(f"CAST(pmod(xxhash64(uid), {down}) AS INT)"))
    others = others.withColumn("a", F.expr(f"explode(sequence(0L, {across - 1}L))")).groupBy("a", "r")

    def best_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return empty(FOUND)
        return _positive_rows(left, right, **shape, k=positives)

    def best_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return empty(MINED)
        return _negative_rows(left, right, **shape, k=negatives, least=least, most=most)

    per_anchor = Window.partitionBy("uid").orderBy(F.desc("score"), F.asc_nulls_last("other_id"))
    chosen = (
        queried.groupBy("a", "r").cogroup(others).applyInArrow(best_positives, FOUND)
        .withColumn("n", F.row_number().over(per_anchor))
        .where(F.col("n") <= positives)
        .groupBy("uid")
        .agg(F.expr("array_sort(collect_list(struct(n, other_id, score))) AS found"))
        .selectExpr("uid", "found.other_id AS positive_ids", "found.score AS positive_scores")
    )
    with_positives = queried.join(stage(chosen, "positives"), "uid")
    per_positive = Window.partitionBy("uid", "place").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    return (
        with_positives.groupBy("a", "r").cogroup(others).applyInArrow(best_negatives, MINED)
        .withColumn("rank", F.row_number().over(per_positive))
        .where(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


_KINDS = {"long": pa.int64(), "int": pa.int32()}


def empty(schema: str) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    return pa.schema([(name, _KINDS[kind]) for name, kind in fields]).empty_table()
