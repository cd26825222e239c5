"""Change envelopes: producing, decoding, routing and cleaning them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kadence.functions.scalars import differs
from kadence.schemas import envelope

# Fields of an employee image that may stay in the lake.
LAKE_FIELDS = ("id_salarie", "bu", "type_contrat", "nb_jours_CP", "moyen_deplacement")
WATCHED = ("adresse_domicile", "moyen_deplacement")


def snapshot_to_changes(df: DataFrame) -> DataFrame:
    """Every existing row as a change of kind ``r`` (read), without a before image."""
    row = F.struct(*df.columns)
    image = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])
    return df.select(
        F.lit("r").alias("op"), F.lit(None).cast(image).alias("before"), row.alias("after")
    )


def diff_to_changes(
    old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]
) -> DataFrame:
    """Changes that lead from one snapshot to the next: ``c``, ``u`` and ``d`` with full images.

    The key is unique in both snapshots, so one shuffle of each suffices and no key is hot.
    """
    fields = [key, *columns]
    before = old.select(F.col(key), F.struct(*fields).alias("before"))
    after = new.select(F.col(key), F.struct(*fields).alias("after"))
    both = before.join(after, key, "full_outer")
    changed = F.lit(False)
    for column in columns:
        changed = changed | differs(F.col(f"before.{column}"), F.col(f"after.{column}"))
    op = (
        F.when(F.col("before").isNull(), F.lit("c"))
        .when(F.col("after").isNull(), F.lit("d"))
        .when(changed, F.lit("u"))
    )
    return both.select(op.alias("op"), "before", "after").filter(F.col("op").isNotNull())


def drop_tombstones(df: DataFrame) -> DataFrame:
    """Messages that carry a value."""
    return df.filter(F.col("value").isNotNull())


def dedupe_redelivered(df: DataFrame) -> DataFrame:
    """One message per topic position. Copies collapse before the shuffle."""
    return df.dropDuplicates(["topic", "partition", "offset"])


def first_delivery(df: DataFrame, key: str, at: str) -> DataFrame:
    """Of copies of a message, the one that came first by ``at``, so that a late copy is not news.

    ``key`` is the row's key, which copies share; equal copies combine before the shuffle.
    """
    position = [key, "topic", "partition", "offset"]
    rest = [c for c in df.columns if c not in position]
    first = F.min_by(F.struct(*rest), F.struct(at, *(c for c in rest if c != at))).alias("__first")
    return df.groupBy(*position).agg(first).select(*position, "__first.*").select(df.columns)


def dedupe_redelivered_stream(df: DataFrame, event_time: str, within: str) -> DataFrame:
    """The same on a stream; positions are remembered for ``within`` (``"1 day"``)."""
    return df.withWatermark(event_time, within).dropDuplicatesWithinWatermark(
        ["topic", "partition", "offset"]
    )


PARSED = "_parsed"


def decode(df: DataFrame, image: T.StructType) -> DataFrame:
    """Messages with their parsed envelope, to be split into changes and malformed ones."""
    schema = envelope(image).add("_corrupt", T.StringType())
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    return df.withColumn(PARSED, F.from_json("value", schema, options))


def without_text(decoded: DataFrame) -> DataFrame:
    """Decoded messages to be kept: a readable one has its envelope, and an empty text beside it."""
    readable = F.col("value").isNotNull() & F.col(f"{PARSED}._corrupt").isNull()
    return decoded.withColumn("value", F.when(readable, F.lit("")).otherwise(F.col("value")))


def malformed_of(decoded: DataFrame) -> DataFrame:
    """Messages that are no JSON of the expected types."""
    return decoded.filter(F.col(f"{PARSED}._corrupt").isNotNull()).drop(PARSED)


def changes_of(decoded: DataFrame) -> DataFrame:
    """``op``, ``before`` and ``after`` beside the topic position.

    Tombstones and malformed messages go. JSON without a payload yields nulls in all three and
    is skipped by every route.
    """
    position = [c for c in decoded.columns if c not in ("value", PARSED)]
    readable = F.col("value").isNotNull() & F.col(f"{PARSED}._corrupt").isNull()
    return decoded.filter(readable).select(
        *position, *(f"{PARSED}.payload.{c}" for c in ("op", "before", "after"))
    )


def split_malformed(df: DataFrame, image: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(decodable messages, malformed messages); tombstones are in neither."""
    decoded = decode(drop_tombstones(df), image)
    good = decoded.filter(F.col(f"{PARSED}._corrupt").isNull()).drop(PARSED)
    return good, malformed_of(decoded)


def unwrap_envelope(df: DataFrame, image: T.StructType) -> DataFrame:
    """Decoded changes of a topic."""
    return changes_of(decode(df, image))


def state_route(op: Column, before: Column, after: Column) -> Column:
    """``created``, ``updated`` or ``deleted``; null for a change that counts for nothing."""
    return (
        F.when(op.isin("r", "c") & after.isNotNull(), F.lit("created"))
        .when((op == "u") & before.isNotNull() & after.isNotNull(), F.lit("updated"))
        .when((op == "d") & before.isNotNull(), F.lit("deleted"))
    )


def route_state_changes(df: DataFrame) -> DataFrame:
    """State changes with their route; the rest is dropped."""
    route = state_route(F.col("op"), F.col("before"), F.col("after"))
    return df.withColumn("route", route).filter(F.col("route").isNotNull())


def route_fact_inserts(df: DataFrame) -> DataFrame:
    """Facts count when inserted, not when read in a snapshot, updated or deleted."""
    return df.filter((F.col("op") == "c") & F.col("after").isNotNull())


def has_relevant_change(columns: Sequence[str] = WATCHED) -> Column:
    """True if a watched column differs between two present images, nulls included."""
    changed = F.lit(False)
    for column in columns:
        changed = changed | differs(F.col(f"before.{column}"), F.col(f"after.{column}"))
    return F.col("before").isNotNull() & F.col("after").isNotNull() & changed


def drop_pii(df: DataFrame, allow: Sequence[str] = LAKE_FIELDS) -> DataFrame:
    """Keep only the allowed fields of both images."""

    def kept(image: str) -> Column:
        names = [f.name for f in df.schema[image].dataType.fields if f.name in allow]
        fields = F.struct(*(F.col(f"{image}.{n}").alias(n) for n in names))
        return F.when(F.col(image).isNotNull(), fields).alias(image)

    return df.withColumns({"before": kept("before"), "after": kept("after")})


def to_bronze(df: DataFrame, ingested_at: Column) -> DataFrame:
    """Raw change rows: kind, both images as JSON text (null for no image), ingestion time."""

    def text(image: str) -> Column:
        return F.to_json(image, {"ignoreNullFields": "false"}).alias(image)

    return df.select("op", text("before"), text("after"), ingested_at.alias("ingestion_ts"))


def batch_offset_ranges(df: DataFrame, stamp_ms: Column) -> DataFrame:
    """One row: ``<ms>_p0:1200-1245_p1:800-832``, a traceable id of a batch.

    Only one row per topic partition reaches the final list.
    """
    spans = df.groupBy("partition").agg(F.min("offset").alias("lo"), F.max("offset").alias("hi"))
    label = F.concat(F.lit("p"), "partition", F.lit(":"), "lo", F.lit("-"), "hi")
    listed = F.array_sort(F.collect_list(F.struct("partition", label.alias("label"))))
    return spans.agg(listed.alias("spans")).select(
        F.concat_ws(
            "_", stamp_ms.cast("string"), F.array_join(F.col("spans.label"), "_")
        ).alias("batch_id")
    )
