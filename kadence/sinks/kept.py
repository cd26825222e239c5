"""Tables of the current row per key, kept in buckets of which a batch rewrites only its own.

A bucket is a folder of files, replaced as a whole by a later epoch that touches it. Which epoch holds
which bucket is in an index, one small file per epoch, written last: until it is there an epoch has not
happened. A replayed epoch starts from the index before its own and so replaces itself.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kadence.sinks.tables import _file_system, names_in

BUCKET = "bucket"
#: Neighbouring keys that share a bucket, and buckets at most.
WIDTH, BUCKETS = 100_000, 4096


def bucket_of(key: str, width: int = WIDTH, buckets: int = BUCKETS) -> Column:
    """The bucket of a whole-number key: runs of ``width`` keys, dealt round-robin.

    New keys of a sequence share a bucket or two, so a batch of them rewrites little; random keys
    spread evenly. The number of buckets is bounded, and so is the index. Null keys are in bucket 0.
    """
    run = F.call_function("div", F.col(key), F.lit(width))
    return F.coalesce(F.pmod(run, F.lit(buckets)), F.lit(0)).cast("int")


@dataclass(frozen=True)
class KeptTable:
    """Rows of ``schema`` under ``path``, in buckets by the expression ``bucket`` over their columns."""

    path: str
    schema: T.StructType
    bucket: Column

    def _epochs(self, spark: SparkSession) -> list[int]:
        found = names_in(spark, f"{self.path}/_index")
        return sorted(int(n.removesuffix(".json")) for n in found if n.endswith(".json") and n[0].isdigit())

    def _index(self, spark: SparkSession, epoch: int) -> dict:
        fs, where, jvm = _file_system(spark, f"{self.path}/_index/{epoch}.json")
        stream = fs.open(where)
        try:
            # One entry per bucket at most, each short.
            text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        held = json.loads(text)
        return {"note": held["note"], "buckets": {int(b): e for b, e in held["buckets"].items()}}

    def state(self, spark: SparkSession, before: int | None = None) -> tuple[int, dict]:
        """The newest epoch (earlier than ``before``) and its index; -1 and an empty one if there is none."""
        epochs = [e for e in self._epochs(spark) if before is None or e < before]
        return (epochs[-1], self._index(spark, epochs[-1])) if epochs else (-1, {"note": None, "buckets": {}})

    def touched(self, df: DataFrame) -> list[int]:
        """Buckets of the rows of ``df``: as many numbers as there are buckets, at most."""
        return [r[0] for r in df.select(self.bucket.alias(BUCKET)).distinct().collect()]

    def rows(
        self, spark: SparkSession, buckets: list[int] | None = None, before: int | None = None
    ) -> DataFrame:
        """All rows, or those of some buckets, as of the newest epoch (earlier than ``before``)."""
        _, index = self.state(spark, before)
        held = index["buckets"]
        wanted = held if buckets is None else {b: held[b] for b in buckets if b in held}
        if not wanted:
            return spark.createDataFrame([], self.schema)
        # Not below the base path: bucket numbers are not columns.
        return spark.read.schema(self.schema).parquet(*(f"{self.path}/epoch={e}/{BUCKET}={b}" for b, e in wanted.items()))

    def replace(self, df: DataFrame, touched: list[int], epoch_id: int, note: object = None) -> None:
        """Make ``df`` the rows of the ``touched`` buckets from ``epoch_id`` on; ``note`` is kept beside the index.

        A touched bucket without rows becomes empty. Files that neither this epoch nor the one before
        refers to are removed, so a reader of the last state is not disturbed.
        """
        spark = df.sparkSession
        last, index = self.state(spark, epoch_id)
        folder = f"{self.path}/epoch={epoch_id}"
        if touched:
            # A bucket is one task: it holds a row per key of a bounded share of them.
            dealt = df.select(*self.schema.fieldNames(), self.bucket.alias(BUCKET)).repartition(F.col(BUCKET))
            dealt.write.mode("overwrite").partitionBy(BUCKET).parquet(folder)
        present = {int(n.split("=")[1]) for n in names_in(spark, folder) if n.startswith(f"{BUCKET}=")} if touched else set()
        held = {b: e for b, e in index["buckets"].items() if b not in set(touched)}
        held |= {b: epoch_id for b in touched if b in present}
        self._write_index(spark, epoch_id, {"note": note, "buckets": held})
        self._remove_replaced(spark, last, index["buckets"])

    def _write_index(self, spark: SparkSession, epoch_id: int, index: dict) -> None:
        fs, whole, jvm = _file_system(spark, f"{self.path}/_index/{epoch_id}.json")
        part = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_index/.{epoch_id}.part")
        stream = fs.create(part, True)
        try:
            stream.write(bytearray(json.dumps(index).encode()))
        finally:
            stream.close()
        fs.delete(whole, False)
        fs.rename(part, whole)

    def _remove_replaced(self, spark: SparkSession, last: int, kept: dict[int, int]) -> None:
        """Remove what the index before ``last`` refers to and ``last`` does not, and that index."""
        older = [e for e in self._epochs(spark) if e < last]
        fs, _, jvm = _file_system(spark, self.path)
        for epoch in older:
            for b, e in self._index(spark, epoch)["buckets"].items():
                if kept.get(b) != e:
                    fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/epoch={e}/{BUCKET}={b}"), True)
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/_index/{epoch}.json"), False)

    def take_back(self, spark: SparkSession, epoch_id: int) -> None:
        """Undo ``epoch_id`` and later ones: the state before holds again."""
        fs, _, jvm = _file_system(spark, self.path)
        for epoch in self._epochs(spark):
            if epoch >= epoch_id:
                fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/_index/{epoch}.json"), False)
