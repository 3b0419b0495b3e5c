"""Intermediate tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from insidertrail.session import shared_folder


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, for results that several steps read."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/insidertrail/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
