"""Column functions over arrays that stay inside one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CHUNK = 128


def with_prefix_sums(df: DataFrame, values: str, out: str) -> DataFrame:
    """Add ``out``: the inclusive running totals of the bigint array column ``values``.

    Summed in chunks, so that appending to an array costs a chunk and not the whole array.
    """
    arr = F.col(values)
    size = F.size(arr)
    # Elements are fetched one by one, since slicing copies the whole array each time.
    chunks = F.transform(
        F.when(size > 0, F.sequence(F.lit(0), size - 1, F.lit(_CHUNK))).otherwise(F.array().cast("array<int>")),
        lambda c: F.transform(F.sequence(c, F.least(c + _CHUNK, size) - 1), lambda i: F.get(arr, i)),
    )

    def totals(items: Column, value) -> Column:
        return F.aggregate(
            items,
            F.array(F.lit(0).cast("bigint")),
            lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + value(x)),
        )

    df = df.withColumn("_within", F.transform(chunks, lambda ch: totals(ch, lambda x: x)))
    bases = totals(F.col("_within"), lambda w: F.element_at(w, -1))
    shifted = F.zip_with(
        F.col("_within"),
        F.slice(bases, F.lit(1), F.size("_within")),
        lambda w, base: F.transform(F.slice(w, F.lit(2), F.size(w) - 1), lambda v: v + base),
    )
    return df.withColumn(out, F.flatten(shifted)).drop("_within")
