"""Float vectors as vectors of integers, for the operators that need exact distances."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components up to this size keep sums of squared differences of up to 64 of them within 63 bits.
LARGEST = 2**27


def quoted(name: str) -> Column:
    """The column with exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def integers(vectors: DataFrame, vector_col: str, scale: int, *others: Column) -> DataFrame:
    """``others`` and ``x``: each component as floor(scale * component); rows without a whole finite vector go.

    A component beyond ``LARGEST`` in size stops the job with a message, as its distances could overflow.
    """
    vector = quoted(vector_col)
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    scaled = lambda c: F.floor(c.cast("double") * F.lit(float(scale)))
    small = F.forall(vector, lambda c: F.abs(c.cast("double") * F.lit(float(scale))) < LARGEST)
    too_large = F.raise_error(F.lit(f"a component times {scale} is beyond {LARGEST}")).cast("array<int>")
    x = F.when(small, F.transform(vector, lambda c: scaled(c).cast("int"))).otherwise(too_large)
    return vectors.where(vector.isNotNull() & F.forall(vector, finite)).select(*others, x.alias("x"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column whose lists all have ``width`` numbers, as 64-bit rows."""
    return np.asarray(column.flatten()).astype(np.int64).reshape(len(column), width)
