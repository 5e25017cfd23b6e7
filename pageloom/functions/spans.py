"""Where the cells of a table lie when they reach over rows and columns."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# The sweep travels with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def sweep(sizes, colspans, rowspans) -> np.ndarray:
    """(row, column, cell) of every grid cell, end to end, from the number of cells in each row and their spans.

    One pass over the rows with the columns that cells from above still hold; a row's cells fill the others in order.
    The work is that of the grid.  A negative colspan goes over so many columns less those held.
    """
    held: dict[int, tuple[int, int]] = {}
    out, cell = [], 0
    for row, size in enumerate(sizes):
        out += [(row, col, held[col][1]) for col in held]
        col, fresh = 0, {}
        for _ in range(size):
            wide = colspans[cell]
            for _ in range(wide if wide >= 0 else max(1, -wide - len(held))):
                while col in held:
                    col += 1
                out.append((row, col, cell))
                if rowspans[cell] > 1:
                    fresh[col] = (row + rowspans[cell] - 1, cell)
                col += 1
            cell += 1
        if held or fresh:
            held = {c: h for c, h in (held | fresh).items() if h[0] > row}
    return np.array(out, np.int32).reshape(-1)


def placed(sizes: Column, colspans: Column, rowspans: Column) -> Column:
    """``sweep`` for each row of a DataFrame, null for null; only numbers go to Python and back."""
    @F.pandas_udf("array<int>")
    def place(sizes: pd.Series, colspans: pd.Series, rowspans: pd.Series) -> pd.Series:
        rows = zip(sizes, colspans, rowspans)
        return pd.Series([None if s is None else sweep(s.tolist(), c.tolist(), r.tolist()) for s, c, r in rows], dtype=object)

    return place(sizes, colspans, rowspans)
