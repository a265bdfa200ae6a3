"""Motion of blocks over a stream of frames, with the previous frame as state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "img string, r int, c int, frame int, mean double, deviation double, changed boolean"


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches)).sort_values("frame", ignore_index=True)
    before = state.get if state.exists else None
    changed = []
    for m, d in zip(rows["mean"], rows["deviation"], strict=True):
        changed.append(bool(before is not None and abs(m - before[0]) > max(1.0, d) + max(1.0, before[1])))
        before = (float(m), float(d))
    state.update(before)
    yield rows.assign(changed=changed)[["img", "r", "c", "frame", "mean", "deviation", "changed"]]


def motion_stream(blocks: DataFrame) -> DataFrame:
    """changed for a stream of block statistics (img, r, c, frame, mean,
    deviation) whose frames come in order; state is two numbers a block."""
    out: Any = blocks.select("img", "r", "c", "frame", "mean", "deviation").groupBy("img", "r", "c")
    return out.applyInPandasWithState(_step, OUT, "mean double, deviation double", "append", GroupStateTimeout.NoTimeout)
