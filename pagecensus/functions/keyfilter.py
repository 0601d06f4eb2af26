"""A filter of keys for the scan of a large table.

Each key of a short list sets a bit of a table of fixed size, which every task of the scan gets. A row whose bit
is not set has none of the keys; the few others that pass by chance are for the exact join that follows. The
filter drops rows before anything expensive is computed from them, and without moving them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Size of the table, half a megabyte. A hundred thousand keys let 2 percent of other rows pass, a million 21.
FILTER_BITS = 1 << 22


def key_filter(keys: DataFrame, key: str, bits: int = FILTER_BITS) -> Column:
    """The bit table of all values of ``key`` in ``keys``, as a scalar subquery of one array of numbers."""
    places = keys.selectExpr(f"pmod(xxhash64({key}), {bits}L) AS place")
    words = places.groupBy(F.expr("place DIV 64 AS word")).agg(
        F.expr("bit_or(shiftleft(1L, CAST(place % 64 AS INT))) AS word_bits")
    )
    all_words = keys.sparkSession.range(bits // 64).withColumnRenamed("id", "word").join(words, "word", "left")
    table = all_words.agg(F.expr("array_sort(collect_list(struct(word, coalesce(word_bits, 0L) AS word_bits))) AS t"))
    return table.selectExpr("transform(t, w -> w.word_bits) AS bits").scalar()


def passing(table: DataFrame, key: str, bit_table: Column, bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``table`` whose ``key`` may be among the keys of ``bit_table``; null never is."""
    place = F.expr(f"pmod(xxhash64({key}), {bits}L)")
    word = F.get(bit_table, F.shiftright(place, 6).cast("int"))
    return table.where(F.col(key).isNotNull() & (F.getbit(word, (place % 64).cast("int")) == 1))
