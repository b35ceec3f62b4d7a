"""A barrier against repeated evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """`df` with `columns`, each evaluated once per row however often later expressions refer to it.

    The optimiser merges projections and then repeats an expression at every use, also within lambdas; it does not merge them
    through a generator, and a generator over an array of one struct keeps the row count and needs no shuffle.
    """
    kept = [c for c in df.columns if c not in columns]
    held = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("__once")
    return df.select(*kept, held).select(*kept, *[F.col("__once")[n].alias(n) for n in columns])
