"""Depth of a queue over windows, as a scan in blocks. The functions on groups run on the executors."""

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.functions.integers import floor_div
from windrow.operators.positions import with_position

# The functions travel to the executors with the job, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Windows are looked at in blocks of this many.
BLOCK_WINDOWS = 100_000
_NO_BOUND = 1 << 62


class _Step:
    """What a stretch of windows does to the depth of the queue: x becomes max(low, min(high, x + shift)).

    Admitting and draining in one window is such a step, waiting is, and one after the other is again.
    """

    def __init__(self, shift: int = 0, low: int = -_NO_BOUND, high: int = _NO_BOUND):
        self.shift, self.low, self.high = shift, low, high

    def __call__(self, depth: int) -> int:
        return max(self.low, min(self.high, depth + self.shift))

    def then(self, other: "_Step") -> "_Step":
        return _Step(self.shift + other.shift, other(self.low), other(self.high))


def _window_step(arrivals: int, quota: int, drain: int) -> _Step:
    return _Step(arrivals - drain, 0, max(0, quota - drain))


def _wait_step(windows: int, drain: int) -> _Step:
    return _Step(-windows * drain, 0)


def queue_depths(counts: DataFrame, quota: int, drain: int, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Depth of the queue at the start of each window of ``counts`` (window, arrivals): window, depth.

    Windows follow each other, but steps can be put together first: each block of windows becomes one step on its own, these
    are followed from block to block (one row each), and every block then starts with its depth.
    """
    placed = with_position(counts.filter("window IS NOT NULL"), ["window"])
    blocked = placed.withColumn("block", floor_div(F.col("pos"), block_windows)).drop("pos")

    def in_order(rows: pd.DataFrame):
        rows = rows.sort_values("window")
        return zip(rows["window"].tolist(), rows["arrivals"].tolist())

    def step_of(rows: pd.DataFrame) -> pd.DataFrame:
        step, before = _Step(), None
        for window, arrivals in in_order(rows):
            if before is not None:
                step = step.then(_wait_step(window - before - 1, drain))
            step, before = step.then(_window_step(arrivals, quota, drain)), window
        first = int(rows["window"].min())
        return pd.DataFrame([(rows["block"].iloc[0], first, before, step.shift, step.low, step.high)], columns=["block", "first", "last", "shift", "low", "high"])

    def starts(blocks: pd.DataFrame) -> pd.DataFrame:
        depth, before, out = 0, None, []
        for b in blocks.sort_values("block").itertuples():
            if before is not None:
                depth = _wait_step(b.first - before - 1, drain)(depth)
            out.append((b.block, depth))
            depth, before = _Step(b.shift, b.low, b.high)(depth), b.last
        return pd.DataFrame(out, columns=["block", "start"])

    def depths_of(rows: pd.DataFrame) -> pd.DataFrame:
        depth, before, out = int(rows["start"].iloc[0]), None, []
        for window, arrivals in in_order(rows):
            if before is not None:
                depth = _wait_step(window - before - 1, drain)(depth)
            out.append((window, depth))
            depth, before = _window_step(arrivals, quota, drain)(depth), window
        return pd.DataFrame(out, columns=["window", "depth"])

    steps = blocked.groupBy("block").applyInPandas(step_of, "block long, first long, last long, shift long, low long, high long")
    begun = steps.groupBy().applyInPandas(starts, "block long, start long")
    return blocked.join(F.broadcast(begun), "block").groupBy("block").applyInPandas(depths_of, "window long, depth long")
