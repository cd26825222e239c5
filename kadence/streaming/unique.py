"""Uniqueness across batches: keys that an earlier batch has brought, found without reading what is stored whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kadence.sinks.kept import KeptTable


class SeenKeys:
    """The distinct keys of all batches so far, in buckets of which a batch reads and rewrites its own."""

    def __init__(self, path: str, keys: T.StructType, bucket: Column):
        self.names = keys.fieldNames()
        counted = T.StructType([*keys.fields, T.StructField("epoch", T.LongType())])
        self.table = KeptTable(path, counted, bucket)

    def _known(self, batch: DataFrame) -> DataFrame:
        """Rows with a key; of a compound one a part may be null."""
        known = F.lit(False)
        for name in self.names:
            known = known | F.col(name).isNotNull()
        return batch.where(known)

    def repeated(self, batch: DataFrame, epoch_id: int) -> DataFrame:
        """Rows of ``batch`` whose key an earlier epoch has brought, with that epoch as ``first_epoch``."""
        spark = batch.sparkSession
        keyed = self._known(batch)
        held = self.table.rows(spark, self.table.touched(keyed), before=epoch_id)
        mine, theirs = keyed.alias("m"), held.alias("s")
        same = F.lit(True)
        for n in self.names:
            same = same & F.col(f"m.{n}").eqNullSafe(F.col(f"s.{n}"))
        return mine.join(theirs, same).select("m.*", F.col("s.epoch").alias("first_epoch"))

    def remember(self, batch: DataFrame, epoch_id: int) -> None:
        """Add the keys of a batch; a replayed epoch adds its own again and no others."""
        keyed = self._known(batch)
        touched = self.table.touched(keyed)
        held = self.table.rows(batch.sparkSession, touched, before=epoch_id)
        new = keyed.select(*self.names, F.lit(epoch_id).cast("long").alias("epoch"))
        merged = held.unionByName(new).groupBy(*self.names).agg(F.min("epoch").alias("epoch"))
        self.table.replace(merged, touched, epoch_id)

    def rows(self, spark: SparkSession) -> DataFrame:
        return self.table.rows(spark)
