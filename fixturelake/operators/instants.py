"""One unambiguous UTC instant from a day cell and a time cell."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixturelake.functions.instants import HOME, ZoneTables, to_instants


def with_instant(df: DataFrame, date: str, time: str, out: str = "start_utc", home: str = HOME) -> DataFrame:
    """Add ``out``, the start as ``yyyy-MM-ddTHH:mm:ssZ`` to the nearest minute.

    Each cell is cut into a mask of character classes; a mask is matched to its parser once and kept. Local
    times are resolved against transition tables built once on the driver from one version of the zone data
    and shipped with the function, so all executors agree. Days come before months; a cell without a zone is
    in ``home``. Null where the day or the time is missing, unreadable or impossible, where the two cells
    contradict each other, or where the wall time occurs twice or never. A column named ``out`` is replaced.
    """
    zones = ZoneTables.build()

    @F.pandas_udf("string")
    def instant(d: pd.Series, t: pd.Series) -> pd.Series:
        pairs = pd.MultiIndex.from_arrays([d.fillna("").astype(str), t.fillna("").astype(str)])
        codes, unique = pairs.factorize()
        minutes = to_instants([x or None for x, _ in unique], [y or None for _, y in unique], zones, home)
        text = pd.Series(pd.to_datetime(pd.Series(minutes) * 60, unit="s", errors="coerce")).dt.strftime("%Y-%m-%dT%H:%M:00Z")
        text = text.astype(object).where(pd.Series(minutes).notna(), None)
        return text.iloc[codes].reset_index(drop=True) if len(unique) else pd.Series([], dtype=object)

    return df.withColumn(out, instant(F.col(date), F.col(time)))


def unusual(date: str, time: str):
    """Whether the two cells are not both in the usual form dd.MM.yyyy and HH:mm."""
    plain = F.col(date).rlike(r"\A\d{2}\.\d{2}\.\d{4}\z") & F.col(time).rlike(r"\A\d{2}:\d{2}\z")
    return ~F.coalesce(plain, F.lit(False))
