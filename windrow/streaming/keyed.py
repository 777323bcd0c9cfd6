"""State function of the count windows per key. Runs on the executors."""

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle

# The function travels to the executors with the job, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _in_order(rows, order_by):
    """Places of the rows in the order of the columns; equal rows stay as they are, NULL is first."""
    columns = [rows[c] for c in order_by]
    if not columns:
        return np.arange(len(rows))
    if any(c.dtype.kind not in "iufM" or c.hasnans for c in columns):
        rows = rows[list(order_by)].reset_index(drop=True)
        return rows.sort_values(order_by, kind="stable", na_position="first").index.to_numpy()
    return np.lexsort([c.to_numpy() for c in reversed(columns)])


def fold_windows(n, key, order_by, value, missing):
    """Function that emits the windows filled by a batch and holds back the rest.

    ``missing`` is the column that tells a NULL value from NaN. A window with a NULL has a NULL average. As NaN
    and NULL look alike in a result, ``is_nan`` tells one average from the other. Most calls have few rows: what
    counts is the number of columns and of pandas operations.
    """

    def fold(group, batches, state):
        window, held = (state.get[0], list(state.get[1])) if state.exists else (0, [])
        first, *others = batches
        rows = pd.concat([first, *others]) if others else first
        order = _in_order(rows, order_by)
        null = np.concatenate([np.array([v is None for v in held], bool), rows[missing].to_numpy(bool)[order]])
        values = np.concatenate([np.array([0.0 if v is None else v for v in held]), rows[value].to_numpy(float)[order]])
        full = len(values) // n
        whole = full * n
        state.update((window + full, [None if z else v for v, z in zip(values[whole:].tolist(), null[whole:].tolist())]))
        if not full:
            return
        mean = np.zeros(full)
        with np.errstate(invalid="ignore"):  # an infinity makes the mean NaN
            for i, column in enumerate(values[:whole].reshape(full, n).T, 1):
                mean = mean + (column - mean) / i
        empty = null[:whole].reshape(full, n).any(axis=1)
        yield pd.DataFrame(
            {
                key: [group[0]] * full,
                "window": window + np.arange(full),
                "average": np.where(empty, np.nan, mean),
                "is_nan": np.isnan(mean) & ~empty,
            }
        )

    return fold
