"""Vector expressions over ``ARRAY<FLOAT|DOUBLE>`` columns and sparse term vectors.

Dense math sums products in array order in DOUBLE, so results do not depend on how
the data is partitioned.  Term vectors are kept as integer counts so cosine scores are
computed from exact integer dot products and norms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product of two equal-length numeric arrays, in DOUBLE."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def sum_squares(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable.

    A column expression referenced inside a higher-order lambda is re-evaluated for
    every element; binding it through a one-element ``transform`` evaluates it once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def l2_normalize(v: Column) -> Column:
    """Unit-length copy of ``v`` as ``ARRAY<DOUBLE>``; an all-zero vector stays zero."""
    return let(F.sqrt(sum_squares(v)), lambda norm: F.transform(
        v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double"))))


# Fixed value: a token is a maximal run of letters and digits, after lower-casing.
TOKEN_PATTERN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased letter/digit tokens of a text, in order, duplicates kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), 0)


# Terms that a task counts or scores at once.
SLICE_TERMS = 1 << 16


def list_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_TERMS) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``most`` elements in a list column (at least one row each), in order.

    What a task holds beside a batch so depends on ``most``, not on the rows or the length
    of the texts of a batch.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop
        del batch  # before the next one is read
