"""Filter programs over streams: row by row, as running folds with kept state, and over event-time windows."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from pipewright.lang.interp import evaluate
from pipewright.lang.values import dumps
from pipewright.operators.dynamic import apply_json


def apply_stream(stream: DataFrame, program: str, column: str = "value", **options) -> DataFrame:
    """Outputs of a program on each document; state-free, so a lost executor only repeats its micro-batch."""
    return apply_json(stream, program, column, **options)


def events(stream: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Path events of each document: [path, leaf], and [path] where a container closes."""
    return apply_json(stream, "tostream", column, keep)


def running(stream: DataFrame, key: str, program: str, initial=None, column: str = "value") -> DataFrame:
    """``foreach`` over a stream: for each row, ``program`` on [state, row] gives the key's next state, which is emitted.

    Rows of one key are folded in the order they come in.  State is one JSON text for each key, in the checkpoint.
    """
    kind = stream.schema[key].dataType.simpleString()

    def step(keys, frames, state):
        now = json.loads(state.get[0]) if state.exists else initial
        for frame in frames:
            out = []
            for text in frame[column]:
                for now in evaluate(program, [now, None if text is None else json.loads(text)])[-1:]:  # noqa: B020
                    out.append(dumps(now))
            state.update((dumps(now),))
            yield pd.DataFrame({key: [keys[0]] * len(out), "output": out})

    return stream.select(key, column).groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, output string", "state string", "append", GroupStateTimeout.NoTimeout)


def windowed(stream: DataFrame, time: str, width: str, late: str, keys: tuple[str, ...] = (), slide: str | None = None, **aggregates) -> DataFrame:
    """Aggregates over tumbling or sliding windows of event time; rows later than ``late`` are left out."""
    if stream.schema[time].dataType.typeName() == "timestamp_ntz":  # event time needs a zone
        stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, late).groupBy(window.alias("window"), *keys).agg(*(c.alias(n) for n, c in aggregates.items()))
