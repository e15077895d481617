"""What is known, or to be assumed, about the size of an input."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Sizing:
    """Limits of the single-task forms, and knowledge that saves counting.

    ``at_most``: a known upper bound on the input's rows, for example from the source's
    Parquet footers. Without it an operator that has to choose a form counts its input,
    which runs everything the input is derived from.
    ``bounds``: chunk boundaries of the order column, when they are known already.
    ``max_chunks``: chunks whose boundaries the driver holds. Longer inputs have chunks of chunks,
    so that ``rows_per_chunk`` holds for up to ``max_chunks`` squared of them.
    """

    at_most: int | None = None
    rows_per_chunk: int = 1_000_000
    rows_in_memory: int = 2_000_000
    max_chunks: int = 4096
    bounds: tuple[float, ...] | None = None

    def rows(self, df: DataFrame) -> int:
        return df.count() if self.at_most is None else self.at_most

    def fits_in_memory(self, df: DataFrame) -> bool:
        return self.rows(df) <= self.rows_in_memory

    def bounded(self, df: DataFrame, order: str) -> Sizing:
        """With equal-depth boundaries of ``order``; none when one chunk is enough.

        Beyond one chunk this costs one quantile sketch over one column.
        """
        if self.bounds is not None:
            return self
        rows = self.rows(df)
        if rows <= self.rows_per_chunk:
            return replace(self, bounds=())
        chunks = min(self.max_chunks, math.ceil(rows / self.rows_per_chunk))
        cuts = [i / chunks for i in range(1, chunks)]
        found = df.approxQuantile(order, cuts, 0.2 / chunks)
        return replace(self, bounds=tuple(sorted(set(found))))

    def parts(self, df: DataFrame) -> int:
        """Into how many parts each of ``max_chunks`` chunks is cut; 1 where chunks are small enough."""
        return min(self.max_chunks, math.ceil(self.rows(df) / (self.max_chunks * self.rows_per_chunk))) or 1


DEFAULT = Sizing()
