"""Sequential folds for recursions that no associative form exists for.

Rows are shuffled by key and sorted inside partitions by Spark; the task then streams Arrow
batches with one small state, so no group is ever held in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame


def fold_sorted(df: DataFrame, keys: Sequence[str], order: Sequence[str], make: Callable[[], Callable], schema: str) -> DataFrame:
    """``make()`` returns a fresh ``step(row) -> tuple | None`` for every key; rows are namedtuples."""
    keys = list(keys)

    def run(batches):
        current, step = None, None
        for pdf in batches:
            out = []
            at = [pdf.columns.get_loc(k) for k in keys]
            for row in pdf.itertuples(index=False, name="Row"):
                key = tuple(row[i] for i in at)
                if step is None or key != current:
                    current, step = key, make()
                r = step(row)
                if r is not None:
                    out.append(r)
            yield pd.DataFrame(out, columns=[c.strip().split(" ")[0] for c in schema.split(",")])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
