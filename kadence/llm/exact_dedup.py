"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that the second level hashes.
PREFIX = 256
#: Keys of surviving groups that are broadcast at most (24 bytes each, so 24 MB).
MAX_KEYS = 1_000_000


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digests: str = "surviving",
    prefix: int = PREFIX,
) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256.

    Rows are first grouped by the length of their text, those that share it by a hash of their
    first characters, and only what still shares a group by SHA-256 of the whole text. Each level
    moves keys, never texts. Of equal texts the largest id stays.

    ``digests="surviving"`` reads full content only for groups of more than one row after two
    levels, as long as there are at most ``MAX_KEYS`` of them to send to all executors; beyond
    that, or with ``"all"``, every row is hashed where it is read, which costs less than moving
    texts. With ``"surviving"`` text_sha256 is null outside these groups, at every size.

    A null text counts as empty. Null ids take part: they never stay when another id of the group
    is there, and keep_id is null if there is none. Rows that repeat an id with the same text share
    their verdict and count one by one in group_size. Other columns are ignored.
    """
    if digests not in ("surviving", "all"):
        raise ValueError(f"unknown digests: {digests}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(text).alias("size")
    head = F.xxhash64(F.substring(text, 1, prefix)).alias("head")
    full = F.sha2(text, 256).alias("full")

    lengths = docs.select(size).groupBy("size").agg(F.count("*").alias("n"))
    lengths = lengths.where("n > 1").select("size")
    # Counted before lengths are looked up, so a hot group is one row by then.
    heads = docs.select(size, head).groupBy("size", "head").agg(F.count("*").alias("n"))
    heads = heads.join(lengths, "size", "left_semi")
    heads = heads.where("n > 1").select("size", "head", F.lit(True).alias("shared"))

    if digests == "surviving" and heads.count() <= MAX_KEYS:
        rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), size, head).join(
            F.broadcast(heads), ["size", "head"], "left"
        )
        rows = rows.select(
            "id", "size", "head", F.when(F.col("shared"), F.sha2("text", 256)).alias("full"),
            F.coalesce("shared", F.lit(False)).alias("shared"),
        )
    else:
        rows = docs.select(F.col(id_col).alias("id"), size, head, full).join(
            heads, ["size", "head"], "left"
        )
        rows = rows.withColumn("shared", F.coalesce("shared", F.lit(False)))
        if digests == "surviving":
            rows = rows.withColumn("full", F.when(F.col("shared"), F.col("full")))
    groups = (
        rows.where("shared")
        .groupBy(F.col("full").alias("g_full"))
        .agg(F.max("id").alias("g_keep"), F.count("*").alias("g_size"))
        .where("g_size > 1")
    )
    # Rows that are alone by their length or prefix have no hash; null keys would meet in one task.
    key = F.coalesce(F.col("full"), F.concat_ws(" ", F.lit("alone"), F.col("id").cast("string")))
    alone = F.col("g_size").isNull()
    keep = F.when(alone, F.col("id")).otherwise(F.col("g_keep"))
    return rows.join(groups, key == F.col("g_full"), "left").select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("g_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.col("full").alias("text_sha256"),
    )
