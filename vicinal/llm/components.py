"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.operators.diagnostics import reached


def components(links: DataFrame) -> DataFrame:
    """(id, comp) for every id in links (a, b): comp is the least id it reaches. No links give no rows."""
    return reached(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("node", "id")
