"""Prior history over a stream: count and mean of a key's earlier rows, kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout


def prior_history(stream: DataFrame, key: str, order: list[str], value: str, id_column: str) -> DataFrame:
    """(id, key, prior_count, prior_avg) of every row, against the rows of its key in earlier batches and those before it by `order` in its own.

    prior_count counts rows; prior_avg is the mean of the values that are not
    null, and null before the first of them.  State is three numbers a key.
    Rows that come later than ones of a larger order see those as history; a
    batch scan with `operators.history` is the exact form.
    """
    kinds = dict(stream.dtypes)
    columns = list(dict.fromkeys([key, id_column, *order, value]))

    def step(k: tuple, frames: Iterator[pd.DataFrame], state):
        rows_before, n, total = state.get if state.exists else (0, 0, 0.0)
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        values = pd.Series(rows[value].to_numpy(float))
        there = values.notna()
        counts = n + there.cumsum().shift(fill_value=0)
        sums = total + values.fillna(0.0).cumsum().shift(fill_value=0.0)
        state.update((rows_before + len(rows), n + int(there.sum()), total + float(values.fillna(0.0).sum())))
        yield pd.DataFrame({id_column: rows[id_column].to_numpy(), key: k[0], "prior_count": rows_before + pd.Series(range(len(rows))), "prior_avg": (sums / counts.where(counts > 0)).to_numpy()})

    schema = f"{id_column} {kinds[id_column]}, {key} {kinds[key]}, prior_count long, prior_avg double"
    return stream.select(*columns).groupBy(key).applyInPandasWithState(step, schema, "rows long, n long, total double", "append", GroupStateTimeout.NoTimeout)
