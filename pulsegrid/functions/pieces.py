"""Pandas functions that hold a bounded piece of an Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql.functions import pandas_udf

#: Rows that a function sees at a time: as many as a batch has in ``session.build_session``, whatever the session's own limit.
PIECE_ROWS = 512
#: Numbers that a piece's results hold at most, where each row has more than a few.
PIECE_NUMBERS = 1 << 17


def piece_rows(numbers: int) -> int:
    """Rows of a piece whose results have this many numbers each."""
    return max(1, min(PIECE_ROWS, PIECE_NUMBERS // max(1, numbers)))


def pieces_udf(returns: str, rows: int = PIECE_ROWS) -> Callable:
    """``pandas_udf`` for a function of series, called on at most ``rows`` rows at a time (``piece_rows`` where results are wide).

    A batch has 10,000 rows where a session sets nothing, and arrays and nested results take many times their Arrow size as Python objects.
    Each piece's result is handed on before the next is worked out, so beside the batch in Arrow form a task holds one piece, whatever the input.
    """

    def made(fn: Callable):
        def apply(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for batch in batches:
                columns = batch if isinstance(batch, tuple) else (batch,)
                for at in range(0, len(columns[0]), rows):
                    yield fn(*[c.iloc[at:at + rows].reset_index(drop=True) for c in columns])

        return pandas_udf(apply, returns)

    return made
