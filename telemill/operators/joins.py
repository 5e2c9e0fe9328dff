"""Joins against a small side, and membership tests that stand a dominating key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from telemill.functions.fields import is_missing

SMALL_ROWS = 50_000
SALTS = 16


def small_side(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows, else as it is.

    For configuration tables (rules, channels, silences).  They mostly come from memory, where Spark
    knows no size and would shuffle the large side on a handful of keys.  The check reads no more than
    one row over the bound.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def rows_of_keys(rows: DataFrame, keys: DataFrame, key: str, spread: Sequence[str]) -> DataFrame:
    """Rows whose ``key`` occurs in ``keys``; repeats and missing keys there do not matter.

    The ids are made distinct, which combines on the map side, and copied to every salt; a row's salt
    comes from its ``spread`` columns.  So the rows of one key go to ``SALTS`` tasks, and as both sides
    are plain shuffles on (key, salt) AQE can split further or broadcast the ids if they are few.
    """
    salts = F.array(*[F.lit(i) for i in range(SALTS)])
    wanted = keys.select(key).filter(~is_missing(key)).distinct().withColumn("_salt", F.explode(salts))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    return salted.join(wanted, [key, "_salt"], "left_semi").select(rows.columns)
