"""Document fingerprints from closed syncmers.

A k-mer of bytes is chosen if the smallest of its inner s-mers, by hash, lies at its start or its end.
Whether it is chosen depends on the k-mer alone, so an edit elsewhere leaves the other anchors and
their distances as they are. The fingerprint is the 64 smallest anchor hashes: equal texts have equal
fingerprints, and the overlap of two fingerprints estimates how much of the texts is alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecensus.llm.common import arrow_map, mixed, shuffle_parts, utf8

SKETCH = 64
# (k, s) in bytes, and the text lengths they are used for. Short texts have too few long anchors; in
# between both are used, so that texts of slightly different length can be compared.
SCALES = ((12, 5, 48, None), (5, 2, 5, 160))


def _packed(data: np.ndarray, width: int) -> np.ndarray:
    """Each run of up to eight bytes as one number."""
    count = len(data) - width + 1
    out = data[:count].astype(np.uint64)
    for i in range(1, width):
        out |= data[i : i + count].astype(np.uint64) << np.uint64(8 * i)
    return out


def closed_syncmers(text: bytes, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each closed syncmer; ``s < k <= 16`` and ``k`` at most 8 more than ``s``."""
    data = np.frombuffer(text, dtype=np.uint8)
    if len(data) < k:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    inner = mixed(_packed(data, s) + np.uint64(k << 56))
    window, least, span = k - s + 1, inner, 1
    while 2 * span <= window:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    if span < window:
        least = np.minimum(least[: len(least) - (window - span)], least[window - span :])
    count = len(data) - k + 1
    starts = np.flatnonzero((inner[:count] == least) | (inner[window - 1 : window - 1 + count] == least))
    low = min(k, 8)
    hashes = _packed(data, low)[starts]
    if k > 8:
        hashes = mixed(hashes) + _packed(data, k - 8)[starts + 8]
    return starts, mixed(hashes ^ np.uint64(k << 40))


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of all anchors of a text. One too short for any has itself as anchor."""
    found = [
        closed_syncmers(text, k, s)
        for k, s, least, most in SCALES
        if len(text) >= least and (most is None or len(text) < most)
    ]
    if any(len(f[0]) for f in found):
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    if not text:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    whole = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little")
    return np.zeros(1, dtype=np.int64), np.array([whole], dtype=np.uint64)


def sketch(text: bytes) -> np.ndarray:
    """The smallest anchor hashes, sorted, as 32-bit numbers."""
    hashes = np.unique((anchors(text)[1] >> np.uint64(32)).astype(np.uint32))
    return hashes[:SKETCH]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: twice what two texts share by what both have, estimated from their sketches.

    Two texts without anchors are alike, one without and one with are not.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    repeated = both[1:] == both[:-1]
    distinct = np.concatenate([[True], ~repeated])
    # The union's smallest hashes are a sample of the union; complete sketches are compared whole.
    size = int(distinct.sum())
    whole = len(a) < SKETCH and len(b) < SKETCH
    kept = size if whole else min(size, SKETCH)
    last = both[distinct][kept - 1]
    shared = int((both[1:][repeated] <= last).sum())
    return 2 * shared / (kept + shared)


def text_of(sketched: np.ndarray) -> str:
    return sketched.astype(">u4").tobytes().hex()


def matches(a: bytes, b: bytes) -> list[tuple[int, int]]:
    """Pairs of byte positions at which two texts have the same anchor, for positional matching.

    Anchors that a text repeats are left out: they do not tell a position.
    """
    places = []
    for text in (a, b):
        starts, hashes = anchors(text)
        values, first, counts = np.unique(hashes, return_index=True, return_counts=True)
        places.append(dict(zip(values[counts == 1].tolist(), starts[first[counts == 1]].tolist(), strict=True)))
    return sorted((places[0][h], places[1][h]) for h in places[0].keys() & places[1].keys())


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [anchors(utf8(t)) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([f[0] for f in found], pa.list_(pa.int64())),
                pa.array([f[1].view(np.int64) for f in found], pa.list_(pa.int64())),
                pa.array([text_of(np.unique((f[1] >> np.uint64(32)).astype(np.uint32))[:SKETCH]) for f in found]),
            ],
            ["doc_id", "starts", "hashes", "fingerprint"],
        )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, starts, hashes, fingerprint``: byte positions and hashes of a text's anchors.

    Null and empty texts have no anchors and an empty fingerprint. Null ids, repeated rows and empty
    tables pass through row by row; other columns are ignored. Whole texts of any length are read.
    """
    rows = docs.selectExpr(f"CAST(`{id_col}` AS LONG) AS doc_id", f"`{text_col}` AS text")
    return arrow_map(
        rows, _anchored, "doc_id long, starts array<long>, hashes array<long>, fingerprint string"
    )


# ---- comparison with the next document ---------------------------------------------------------


def with_next(docs: DataFrame) -> DataFrame:
    """Rows ``part, extra, place, doc_id, text`` such that each document's follower is in its part.

    Parts are ranges of ``doc_id`` between quantiles, one for each shuffle partition. The first
    document of a part is also given to the part before it, as an extra row. Only these bounds, two
    numbers per part, pass through the driver. Null ids come before all others.
    """
    spark = docs.sparkSession
    count = shuffle_parts(spark)
    rows = docs.withColumn("place", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn(
        "_at", F.col("place").cast("double")
    )
    cuts = rows.approxQuantile("_at", [i / count for i in range(1, count)], 1 / (4 * count)) if count > 1 else []
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    rows = Bucketizer(splits=splits, inputCol="_at", outputCol="_part").transform(rows)
    rows = rows.withColumn("part", F.col("_part").cast("int")).drop("_at", "_part")
    heads = sorted(rows.groupBy("part").agg(F.min("place").alias("place")).collect())
    before = [(heads[i].place, heads[i - 1].part) for i in range(len(heads))]
    extra = spark.createDataFrame(before, "place long, earlier int")
    joined = rows.join(F.broadcast(extra), "place", "left")
    places = F.when(F.col("earlier").isNull(), F.array(F.struct("part", F.lit(0).alias("extra")))).otherwise(
        F.array(
            F.struct("part", F.lit(0).alias("extra")),
            F.struct(F.col("earlier").alias("part"), F.lit(1).alias("extra")),
        )
    )
    return (
        joined.select(F.explode(places).alias("to"), "place", "doc_id", "text")
        .select("to.part", "to.extra", "place", "doc_id", "text")
        .repartition(count, "part")
        .sortWithinPartitions("part", "extra", "place", "text")
    )


COMPARED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None  # part, extra, doc_id, text, sketch of the row whose follower is still to come
    for batch in batches:
        rows = []
        for part, extra, doc_id, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
            text = text or ""
            if held is not None and held[0] == part and held[1] and extra:
                continue  # a further row with the id of the part's follower
            own = sketch(utf8(text))
            if held is not None and held[0] == part:
                _, _, held_id, held_text, held_sketch = held
                cut = len(held_text) // 4
                edited = utf8(held_text[: len(held_text) - cut] + text[:cut])
                changed = sketch(edited)
                rows.append(
                    (held_id, len(held_text), hashlib.sha256(edited).hexdigest(), text_of(held_sketch),
                     text_of(changed), likeness(held_sketch, changed), likeness(held_sketch, own))
                )
            held = (part, extra, doc_id, text, own)
        if rows:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(column, kind)
                    for column, kind in zip(
                        zip(*rows, strict=True),
                        [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()],
                        strict=True,
                    )
                ],
                [f.split()[0] for f in COMPARED.split(", ")],
            )


def compared_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint against its edited text's and its follower's.

    The edited text has its last quarter replaced by the follower's beginning; the last document's
    follower is the first. Rows of one id follow each other by text; null ids come first; a null text
    is an empty one. An empty table gives no rows. Other columns are ignored.
    """
    rows = docs.selectExpr(f"CAST(`{id_col}` AS LONG) AS doc_id", f"`{text_col}` AS text")
    if rows.limit(1).count() == 0:
        return docs.sparkSession.createDataFrame([], COMPARED)
    return arrow_map(with_next(rows), _compared, COMPARED)
