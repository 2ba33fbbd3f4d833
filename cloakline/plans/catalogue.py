"""Every registered query of the library with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakline.plans import file_queries, record_queries, text_queries

MODULES = (text_queries, record_queries, file_queries)


def widened(df: DataFrame) -> DataFrame:
    """Whole numbers as longs, so that both engines agree on types."""
    return df.select(*[F.col(f"`{f.name}`").cast("long").alias(f.name) if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)) else F.col(f"`{f.name}`") for f in df.schema])


def flagship(spark, sf_dir: str) -> DataFrame:
    return widened(text_queries.flagship(spark, sf_dir))


def queries() -> dict:
    return {name: (lambda spark, sf_dir, f=f: widened(f(spark, sf_dir))) for m in MODULES for name, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.SQL.items()}
