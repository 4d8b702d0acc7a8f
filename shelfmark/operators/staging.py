"""Written intermediate results.

A staged frame is a Parquet table in the folder that the session names in
``spark.checkpoint.dir``. It cuts the lineage, is read back column-wise, gives
the optimizer true sizes, and outlives lost executors.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from shelfmark.operators.statistics import observed, remember


def staging_root(spark: SparkSession, folder: str | None = None) -> str:
    """Folder for this application's staged tables.

    ``folder``, else the session's ``spark.checkpoint.dir``, else its warehouse:
    places that every executor shares.
    """
    shared = folder or spark.conf.get("spark.checkpoint.dir", None)
    shared = shared or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staging"
    return f"{shared.rstrip('/')}/shelfmark-{spark.sparkContext.applicationId}"


def stage(df: DataFrame, label: str, measured: bool = False, **options: str) -> DataFrame:
    """Write df once and return the written copy; ``measured`` counts its bytes on the way."""
    path = f"{staging_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    if measured:
        counted, seen = observed(df)
        counted.write.options(**options).parquet(path)
        remember(path, seen)
    else:
        df.write.options(**options).parquet(path)
    # the schema is known: no footer is read to infer it
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Remove what this application staged. Frames built on it are then unreadable."""
    path = spark._jvm.org.apache.hadoop.fs.Path(staging_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
