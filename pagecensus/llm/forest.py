"""Near duplicates among embeddings by a forest of random-projection trees.

Each tree splits the vectors of a label at the median of their projection on a random direction, again
and again until the parts are small. Vectors close to a cut go to both sides (spill), so that few close
pairs are torn apart, and hardly any in all trees. The vectors of a leaf are compared exactly. A part
that random cuts do not take apart, such as a dense cluster, stays a leaf of any size, and no task holds it
whole; large leaves are compared by pairs of blocks, each a task. A pair that meets in several leaves counts in the first only.
Equal vectors are one vector with a weight.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecensus.llm.common import stage
from pagecensus.llm.components import components

LEAST_COSINE = 0.98
TREES = 5
LEAF_VECTORS = 256
# A part this large is split by Spark, a smaller one within a task.
CELL_VECTORS = 20_000
# Vectors of a leaf that are compared in one task with as many others.
BLOCK_VECTORS = 1024
# How far from a cut vectors go to both sides, in typical distances of a pair at the least cosine.
SPILL = 0.8
_SEED = 20240501
# A cut that leaves more than this share on one side does not take a part apart.
_STUCK = 0.85


def _direction(name: str, size: int) -> np.ndarray:
    seed = int.from_bytes(hashlib.blake2b(f"{_SEED} {name}".encode(), digest_size=8).digest(), "big")
    direction = np.random.default_rng(seed).standard_normal(size)
    return direction / np.linalg.norm(direction)


def spill(size: int, least: float) -> float:
    """How far from a cut a vector still goes to both sides."""
    return SPILL * float(np.sqrt(max(0.0, 2 - 2 * least) / max(1, size)))


def _units(column: pa.ChunkedArray) -> np.ndarray:
    vectors = np.array(column.to_pylist(), dtype=np.float64)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _leaf_rows(rows: pa.Table, least: float, leaf_size: int) -> pa.Table:
    """Split a cell of a tree further; each vector with the leaves it falls into."""
    cell = rows.column("cell")[0].as_py()
    keys = np.array(rows.column("key").to_pylist(), dtype=np.int64)
    order = np.argsort(keys)  # so that a repeated task makes the same cuts
    keys, units = keys[order], _units(rows.column("vector"))[order]
    width = spill(units.shape[1], least)
    found_keys, found_leaves = [], []
    todo = [(np.arange(len(keys)), cell)]
    while todo:
        at, name = todo.pop()
        sides = None
        if len(at) > leaf_size:
            for attempt in range(4):
                shadow = units[at] @ _direction(f"{name}?{attempt}", units.shape[1])
                cut = np.median(shadow)
                parts = [at[shadow <= cut + width], at[shadow >= cut - width]]
                if max(map(len, parts)) <= _STUCK * len(at):
                    sides = parts
                    break
        if sides:
            todo += [(part, name + bit) for part, bit in zip(sides, "01", strict=True)]
        else:
            leaf = int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "big", signed=True)
            found_keys.append(keys[at])
            found_leaves.append(np.full(len(at), leaf, dtype=np.int64))
    return pa.table([pa.array(np.concatenate(found_keys)), pa.array(np.concatenate(found_leaves))], names=["key", "leaf"])


def _leaves(cells: DataFrame, least: float, leaf_size: int) -> DataFrame:
    """``key, leaf``: cells are split further in a task; those that ``_cells`` marked as done are leaves already."""

    def leaf_rows(rows: pa.Table) -> pa.Table:
        return _leaf_rows(rows, least, leaf_size)

    done = F.endswith("cell", F.lit("."))
    split = cells.where(~done).groupBy("cell").applyInArrow(leaf_rows, "key long, leaf long")
    return split.union(cells.where(done).select("key", F.xxhash64("cell").alias("leaf")))


def _cells(vectors: DataFrame, trees: int, least: float, cell_size: int) -> DataFrame:
    """``key, cell, vector`` for each tree; cells larger than ``cell_size`` are cut by Spark."""
    group = "concat_ws('/', label, size(vector))"
    placed = vectors.selectExpr(
        "key", f"explode(transform(sequence(1, {trees}), t -> concat(t, '/', {group}, ':'))) AS cell", "vector"
    )
    final = None
    for level in range(60):
        sizes = placed.groupBy("cell").agg(F.count("*").alias("n"))
        large = stage(sizes.where(f"n > {cell_size}"), "forest-large")
        if large.limit(1).count() == 0:
            break

        def shadows(batches):
            for batch in batches:
                cells = batch.column(1).to_pylist()
                units = _units(batch.column(2))
                directions: dict[tuple[str, int], np.ndarray] = {}
                out = np.empty(len(cells))
                for i, cell in enumerate(cells):
                    name = (cell, units.shape[1])
                    if name not in directions:
                        directions[name] = _direction(f"{cell}!", units.shape[1])
                    out[i] = units[i] @ directions[name]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array(out)], ["key", "cell", "vector", "shadow"]
                )

        rest = placed.join(large.select("cell"), "cell", "left_anti").select("key", "cell", "vector")
        cut = placed.join(large.select("cell"), "cell").select("key", "cell", "vector")
        cut = stage(cut.mapInArrow(shadows, "key long, cell string, vector array<double>, shadow double"), "forest-cut")
        width = f"{SPILL} * sqrt({max(0.0, 2 - 2 * least)} / size(vector))"
        medians = cut.groupBy("cell").agg(F.expr("percentile_approx(shadow, array(0.1, 0.5, 0.9)) AS q"))
        sides = cut.join(medians, "cell").withColumn("width", F.expr(width))
        # Nearly everything lies close to the cut: the cell stays whole, and is marked as done.
        sides = sides.selectExpr(
            "key", "vector",
            "explode(CASE WHEN q[0] >= q[1] - width AND q[2] <= q[1] + width THEN array(concat(cell, '.')) "
            "ELSE filter(array(IF(shadow <= q[1] + width, concat(cell, '0'), NULL), "
            "IF(shadow >= q[1] - width, concat(cell, '1'), NULL)), c -> c IS NOT NULL) END) AS cell",
        )
        final = rest if final is None else final.union(rest)
        placed = stage(sides.select("key", "cell", "vector"), "forest-level")
        done = placed.where("endswith(cell, '.')")
        final = final.union(done.select("key", "cell", "vector"))
        placed = placed.where("NOT endswith(cell, '.')")
    return placed if final is None else final.union(placed)


def _first_shared(leaves: list[list[int]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest leaf that both vectors of each pair fall into."""
    wide = max(map(len, leaves))
    table = np.array([[*own, *[own[-1]] * (wide - len(own))] for own in leaves], dtype=np.int64)
    out = np.zeros(len(a), dtype=np.int64)
    open_pairs = np.arange(len(a))
    for i in range(wide):
        if not len(open_pairs):
            break
        mine, others = table[a[open_pairs], i], table[b[open_pairs]]
        hit = (others == mine[:, None]).any(axis=1)
        out[open_pairs[hit]] = mine[hit]
        open_pairs = open_pairs[~hit]
    return out


FOUND = "kind int, u long, v long"


def _compare(rows: pa.Table, least: float) -> pa.Table:
    """Links counted for each vector (kind 0), and links that connect what is connected here (kind 1)."""
    rows = rows.sort_by("key")
    leaf, one, other = (rows.column(c)[0].as_py() for c in ("leaf", "one", "other"))
    keys = np.array(rows.column("key").to_pylist(), dtype=np.int64)
    weights = np.array(rows.column("weight").to_pylist(), dtype=np.int64)
    block = np.array(rows.column("block").to_pylist())
    leaves = rows.column("leaves").to_pylist()
    vectors = np.array(rows.column("vector").to_pylist(), dtype=np.float64)
    norms = np.linalg.norm(vectors, axis=1)
    near = (vectors @ vectors.T) / np.outer(norms, norms) >= least
    # Pairs of one block belong to the task of that block with itself.
    wanted = np.triu(np.ones_like(near), 1)
    if one != other:
        wanted &= block[:, None] != block[None, :]
    a, b = np.nonzero(near & wanted)
    counts = np.zeros(len(keys), dtype=np.int64)
    links: list[tuple[int, int]] = []
    if len(a):
        for i in range(0, len(a), 1 << 18):
            some_a, some_b = a[i : i + (1 << 18)], b[i : i + (1 << 18)]
            first = _first_shared(leaves, some_a, some_b) == leaf
            np.add.at(counts, some_a[first], weights[some_b[first]])
            np.add.at(counts, some_b[first], weights[some_a[first]])
        seen = np.zeros(len(keys), dtype=bool)
        linked = near & (wanted | wanted.T)
        for i in np.unique(np.concatenate([a, b])).tolist():
            if seen[i]:
                continue
            seen[i] = True
            todo = [i]
            while todo:
                j = todo.pop()
                new = np.flatnonzero(linked[j] & ~seen)
                seen[new] = True
                links += [(int(keys[j]), int(keys[k])) for k in new]
                todo += new.tolist()
    on = np.flatnonzero(counts)
    kind = np.concatenate([np.zeros(len(on), dtype=np.int32), np.ones(len(links), dtype=np.int32)])
    u = np.concatenate([keys[on], np.array([x for x, _ in links], dtype=np.int64)])
    v = np.concatenate([counts[on], np.array([x for _, x in links], dtype=np.int64)])
    return pa.table([pa.array(kind, pa.int32()), pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["kind", "u", "v"])


def near_duplicates(
    vectors: DataFrame,
    least: float = LEAST_COSINE,
    trees: int = TREES,
    leaf_size: int = LEAF_VECTORS,
    cell_size: int = CELL_VECTORS,
    block: int = BLOCK_VECTORS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: vectors of one label linked if their cosine reaches ``least``.

    Only links are counted that a leaf showed; none has a smaller cosine. ``n_links`` counts other rows,
    equal vectors included. Rows with a null label, or a vector that is null, empty, zero or has null or
    non-finite parts, link with nothing; vectors of different length do not either. ``component_id`` is
    the smallest id that links lead to; a null id is never smallest. Repeated rows are copies of one
    another. An empty table gives no rows; other columns are ignored.
    """
    fit = (
        "label IS NOT NULL AND size(vector) > 0 AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND "
        "abs(x) < double('Infinity')) AND exists(vector, x -> x <> 0)"
    )
    rows = vectors.selectExpr(
        f"CAST(`{id_col}` AS LONG) AS vec_id",
        f"CAST(`{label_col}` AS STRING) AS label",
        f"CAST(`{vector_col}` AS ARRAY<DOUBLE>) AS vector",
    )
    rows = rows.selectExpr(
        "vec_id", "label", "vector", f"CASE WHEN coalesce({fit}, false) THEN xxhash64(label, vector) END AS key"
    )
    rows = stage(rows, "vectors")
    distinct = stage(
        rows.where("key IS NOT NULL")
        .groupBy("key")
        .agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("weight"), F.min("vec_id").alias("least")),
        "vectors-distinct",
    )
    cells = _cells(distinct.select("key", "label", "vector"), trees, least, cell_size)

    leaves = stage(_leaves(cells, least, leaf_size), "forest-leaves")
    sizes = leaves.groupBy("leaf").agg(F.expr(f"CAST(ceil(count(*) / {block}) AS INT) AS blocks")).where("blocks >= 1")
    own = leaves.groupBy("key").agg(F.expr("array_sort(collect_set(leaf)) AS leaves"))
    # A vector goes to every pair of blocks of its leaf that holds its own block.
    placed = (
        leaves.join(sizes, "leaf")
        .withColumn("block", F.expr("CAST(pmod(xxhash64(key, leaf), blocks) AS INT)"))
        .withColumn("with", F.expr("explode(sequence(0, blocks - 1))"))
        .selectExpr("leaf", "key", "block", "least(block, with) AS one", "greatest(block, with) AS other")
    )
    full = placed.join(own, "key").join(distinct.select("key", "vector", "weight"), "key")

    def compare(rows: pa.Table) -> pa.Table:
        return _compare(rows, least)

    found = stage(full.groupBy("leaf", "one", "other").applyInArrow(compare, FOUND), "forest-found")
    counted = found.where("kind = 0").groupBy("u").agg(F.sum("v").alias("links")).withColumnRenamed("u", "key")
    linked = components(found.where("kind = 1").select("u", "v")).withColumnRenamed("node", "key")
    named = distinct.select("key", "weight", "least").join(linked, "key", "left").join(counted, "key", "left")
    named = named.selectExpr(
        "key", "least", "coalesce(component, key) AS component", "coalesce(links, 0) + weight - 1 AS n_links"
    )
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "component").select("key", "n_links", "component_id")
    return (
        rows.select("vec_id", "key")
        .join(named, "key", "left")
        .selectExpr(
            "vec_id", "coalesce(n_links, 0) AS n_links", "coalesce(component_id, vec_id) AS component_id",
            "coalesce(vec_id = coalesce(component_id, vec_id), false) AS kept",
        )
    )


def brute_force(rows: list[tuple], least: float = LEAST_COSINE) -> dict[int, tuple[int, int]]:
    """By definition, for tests: id -> number of links, component, of rows ``(id, vector, label)``."""
    parent = {r[0]: r[0] for r in rows}
    links = dict.fromkeys(parent, 0)

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    groups: dict = {}
    for i, vector, label in rows:
        if label is not None and vector and all(x is not None and np.isfinite(x) for x in vector) and any(vector):
            groups.setdefault((label, len(vector)), []).append((i, vector))
    for members in groups.values():
        ids = [i for i, _ in members]
        units = np.array([v for _, v in members], dtype=float)
        norms = np.linalg.norm(units, axis=1)
        near = (units @ units.T) / np.outer(norms, norms) >= least
        np.fill_diagonal(near, False)
        for x, y in zip(*np.nonzero(near), strict=True):
            links[ids[x]] += 1
            low, high = sorted((root(ids[x]), root(ids[y])))
            parent[high] = low
    return {i: (links[i], root(i)) for i in parent}
