"""Bounded samples of labelled rows for fitting, chosen by a hash of the id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_sample(labelled: DataFrame, id_col: str, most: int, slack: float = 1.5) -> DataFrame:
    """At most about ``slack * most`` rows of labelled (all, where they are no more), the same on
    every run: those whose id hashes below a bound that the row count sets."""
    n = labelled.select(id_col).count()
    share = 1.0 if n <= most else slack * most / n
    unit = F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return labelled.where(unit < share)
