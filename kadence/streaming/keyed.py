"""History with keyed state: a stream of log rows in, revisions of intervals out.

Spark's state store holds the newest log row of each employee, so a batch closes and opens intervals without
reading any table. Employees of neighbouring numbers share a key of the store, as its calls, not its rows, are what
costs. A row that comes late finds the employee's earlier rows in a list beside it, which is read only
then, and the intervals it changes are sent again. What counts of an interval is its last revision.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kadence.functions.scalars import whole_days

# What tasks run travels by value, so executors need not have this library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Keyed state of several variables needs this store; fixed value.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROW = "at_us bigint, topic string, partition int, offset bigint, valid_us bigint, flag boolean, opens boolean"
REVISIONS = (
    "id_salarie bigint, topic string, partition int, offset bigint, est_eligible_prime_annuel boolean, "
    "debut_us bigint, fin_us bigint, revision bigint"
)
#: Employees that share a key of the store, at most.
WIDTH = 1000
_ORDER = ["id_salarie", "at_us", "topic", "partition", "offset"]
_PLACE = ["id_salarie", "topic", "partition", "offset"]
_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
_SCHEMA = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in f"id_salarie bigint, {ROW}".split(", ")])
_NULLABLE = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype(), pa.bool_(): pd.BooleanDtype()}


def _frame(table: pa.Table) -> pd.DataFrame:
    return table.to_pandas(types_mapper=_NULLABLE.get)


def _table(rows: pd.DataFrame) -> pa.Table:
    return pa.Table.from_pandas(rows[_SCHEMA.names], _SCHEMA, preserve_index=False)


def _packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _SCHEMA) as writer:
        writer.write_table(_table(rows))
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return _frame(pa.ipc.open_stream(data).read_all())


class History(StatefulProcessor):
    """Intervals of the employees of one bucket at a time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        # The newest row of each employee with the number of the revision sent last; all rows, in the order they came.
        self.newest = handle.getValueState("newest", "rows binary, revision bigint")
        self.rows = handle.getListState("rows", "rows binary")

    def handleInputRows(  # noqa: N802
        self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object
    ) -> Iterator[pd.DataFrame]:
        # Of copies of a message the one that came first by time counts.
        fresh = _frame(pa.concat_tables([_table(part) for part in rows]))
        fresh = fresh.sort_values(_ORDER, kind="stable").drop_duplicates(_PLACE)
        held, revision = self.newest.get() if self.newest.exists() else (None, -1)
        known = _unpacked(held) if held is not None else fresh.iloc[:0]
        # Late is whose first row here does not stand behind the newest one known; equal rows keep their order here.
        first = fresh[fresh["id_salarie"].isin(known["id_salarie"])].drop_duplicates("id_salarie")
        sides = pd.concat([first.assign(_known=False), known.assign(_known=True)]).sort_values(_ORDER, kind="stable")
        least = sides.drop_duplicates("id_salarie")
        late = least.loc[~least["_known"], "id_salarie"]
        base = known
        if len(late):
            earlier = pd.concat([_unpacked(part[0]) for part in self.rows.get()])
            earlier = earlier[earlier["id_salarie"].isin(late)]
            met = fresh.merge(earlier[_PLACE], "left", _PLACE, indicator="_met")
            fresh = met[met["_met"] == "left_only"].drop(columns="_met")
            if fresh.empty:
                return
            base = pd.concat([known[~known["id_salarie"].isin(late)], earlier])
        mine = fresh["id_salarie"].unique()
        chain = pd.concat([base[base["id_salarie"].isin(mine)], fresh]).sort_values(_ORDER, kind="stable")
        self.rows.appendValue((_packed(fresh),))
        last = chain.drop_duplicates("id_salarie", keep="last")
        self.newest.update((_packed(pd.concat([known[~known["id_salarie"].isin(mine)], last])), revision + 1))
        chain["fin_us"] = chain.groupby("id_salarie")["valid_us"].shift(-1)
        out = chain[chain["opens"].fillna(False)].assign(revision=revision + 1)
        if len(out):
            out = out.rename(columns={"flag": "est_eligible_prime_annuel", "valid_us": "debut_us"})
            yield out[[c.split()[0] for c in REVISIONS.split(", ")]]

    def close(self) -> None:
        pass


def interval_revisions(log: DataFrame, width: int = WIDTH) -> DataFrame:
    """Revisions of intervals from a stream of ``history.state_log`` rows with their topic positions.

    Rows without an employee have no history. All changes in a batch of ``width`` employees of neighbouring numbers
    meet in one task, so bound the batch by records; what the store keeps is a row per change.
    """
    spark: SparkSession = log.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = log.where(F.col("id_salarie").isNotNull()).select(
        "id_salarie", "at_us", "topic", "partition", "offset", F.unix_micros("valid_from").alias("valid_us"),
        F.col("est_eligible_prime_annuel").alias("flag"), (F.col("kind") == "open").alias("opens"),
        F.call_function("div", F.col("id_salarie"), F.lit(width)).alias("bucket"),
    )
    return rows.groupBy("bucket").transformWithStateInPandas(
        History(), outputStructType=REVISIONS, outputMode="Append", timeMode="None"
    )


def intervals_of(revisions: DataFrame) -> DataFrame:
    """Intervals as of their last revisions; changes combine before the shuffle."""
    place = ["id_salarie", "topic", "partition", "offset"]
    last = F.max_by(F.struct("est_eligible_prime_annuel", "debut_us", "fin_us"), "revision")
    found = revisions.groupBy(*place).agg(last.alias("last"))
    start, end = F.timestamp_micros("last.debut_us"), F.timestamp_micros("last.fin_us")
    return found.select(
        "id_salarie", "last.est_eligible_prime_annuel", start.alias("date_debut"), end.alias("date_fin"),
        whole_days(start, end).cast("int").alias("duree"),
    )
