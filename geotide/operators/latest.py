"""Latest / top-k rows per key.

``row_number() <= k`` over a key is planned by Spark as a partial
``WindowGroupLimit`` before the shuffle and a final one after it, so a hot key
sends at most ``k`` rows per map partition through the exchange instead of
all its rows.  Every ranking carries a total order (D18): callers append a
unique column so results are deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def desc(c) -> Column:
    """Descending with Postgres null placement (nulls first)."""
    return _col(c).desc_nulls_first()


def asc(c) -> Column:
    """Ascending with Postgres null placement (nulls last)."""
    return _col(c).asc_nulls_last()


def top_k_per_key(df: DataFrame, keys: Sequence, order: Sequence[Column], k: int = 1,
                  rank_col: str | None = "rn") -> DataFrame:
    """Keep the first ``k`` rows of each key group under ``order``.

    ``rank_col`` names the kept 1-based rank column (``None`` drops it).
    """
    w = Window.partitionBy(*[_col(c) for c in keys]).orderBy(*order)
    name = rank_col or "__rn"
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
    return out if rank_col else out.drop(name)


def latest_per_key(df: DataFrame, keys: Sequence, ts_col: str = "created_at",
                   tiebreak: Sequence[str] = (), rank_col: str | None = None) -> DataFrame:
    """The newest row per key (``ts_col`` desc, then ``tiebreak`` desc)."""
    order = [desc(ts_col)] + [desc(t) for t in tiebreak]
    return top_k_per_key(df, keys, order, 1, rank_col)


def latest_k_per_key(df: DataFrame, keys: Sequence, k: int = 8, ts_col: str = "created_at",
                     tiebreak: Sequence[str] = (), rank_col: str | None = "rn") -> DataFrame:
    """The newest ``k`` rows per key."""
    order = [desc(ts_col)] + [desc(t) for t in tiebreak]
    return top_k_per_key(df, keys, order, k, rank_col)
