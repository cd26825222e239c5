"""A corpus pipeline: five stages over documents, each stored and read again by the next."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kadence.llm.common import shipped, stored, table
from kadence.llm.exact_dedup import exact_duplicates
from kadence.llm.language import identify, learn_profiles, limits
from kadence.llm.mixing import mix_to_targets
from kadence.llm.ngram_join import jaccard_groups
from kadence.llm.packing import pack_documents
from kadence.workspace import remove, work_dir

#: Dimensions of the language stage: chance gives cosines of about 1/64.
DIMENSIONS = 4096
#: No stage is expressed in SQL as a whole: profiles, tilts, token ids and packing are not.
ORACLE_SQL = None


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` has not."""
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return name


#: Pieces of words that a worker of the packing stage keeps: it follows others in the same executors.
REMEMBERED = 150_000
#: Decisions on rows that are broadcast; more of them are joined.
FEW = 1_000_000
#: Rows of a file, as a power of two.
FILE_BITS = 40


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of its own for each row, and the key's name.

    The key is the place in the files that ``docs`` reads: their number and the row in them, whoever reads
    them and however often. So nothing is written for it; ``docs`` that are no files are written first.
    Decisions are joined back by it, so rows that repeat an id or have none are told apart.
    """
    row = _free(docs, "_row")
    try:
        place = docs.metadataColumn("_metadata")
        docs.select(place["row_index"])
    except AnalysisException:
        docs = stored(docs)
        place = docs.metadataColumn("_metadata")
    # One row per file, so one task numbers them.
    files = docs.select(place["file_path"].alias("_file")).distinct()
    number = F.row_number().over(Window.orderBy("_file")).cast("long")
    files = stored(files.withColumn("_number", number))
    placed = docs.select("*", place["file_path"].alias(f"{row}_file"), place["row_index"].alias(row))
    keyed = placed.join(files, F.col(f"{row}_file") == files["_file"])
    key = F.shiftleft(files["_number"], FILE_BITS) + F.col(row)
    return keyed.select(*(docs[c] for c in docs.columns), key.alias(row)), row


def _without(docs: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose key is not in ``gone``, without the key; all other columns stay as they are.

    If few rows go, their keys are broadcast and no text moves; else rows and keys are joined by key.
    """
    gone = stored(gone.select(F.col(row).alias("_gone")))
    few = gone.limit(FEW + 1).count() <= FEW
    side = F.broadcast(gone) if few else gone
    return docs.join(side, docs[row] == side["_gone"], "left_anti").drop(row)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in one of the languages that the labelled ones teach.

    A text without a letter goes, and so does one less like every language than labelled texts of
    its length are (see ``limits``). If nothing is labelled, only texts without a letter go.
    """
    shipped(spark)
    profiles = learn_profiles(docs, dimensions=DIMENSIONS)
    docs, row = _keyed(docs)
    found = identify(docs, profiles, docs["text"], docs["lang"])
    # Scored once, without the texts: the limits are taken from what is written.
    scored = stored(docs.select(F.col(row), found.alias("_found")))
    stays = F.col("_found")["has_letter"]
    if profiles.languages:
        stays &= F.col("_found")["score"] >= limits(scored, "_found", DIMENSIONS)
    return _without(docs, row, scored.where(~stays))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keep the one with the largest id, one row of it; a row without id only if none has one."""
    docs, row = _keyed(docs)
    key = _free(docs, "_key")
    # Null ids come first in the order of structs.
    found = exact_duplicates(docs.withColumn(key, F.struct("doc_id", row)), id_col=key)
    return _without(docs, row, found.where(~F.col("kept")).select(F.col(key)[row].alias(row)))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents, keep the one with the smallest id; one without id only if none has one."""
    shipped(spark)
    docs, row = _keyed(docs)
    groups = stored(jaccard_groups(docs, id_col=row, unique_ids=True).select(F.col(row).alias("_member"), "component_id"))
    # A text of its own group stays; only the others are looked up.
    paired = groups.groupBy("component_id").agg(F.count("*").alias("_size")).where("_size > 1")
    members = groups.join(paired, "component_id")
    places = docs.select("doc_id", F.col(row).alias("row"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    ordered = stored(places.join(members, F.col("row") == F.col("_member")).select("component_id", "row", order.alias("order")))
    first = ordered.groupBy("component_id").agg(F.min("order")["row"].alias("first"))
    others = ordered.join(first, "component_id").where(F.col("row") != F.col("first"))
    return _without(docs, row, others.select(F.col("row").alias(row)))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each row as often as the mix says: it is left out or repeated as a whole."""
    docs, row = _keyed(docs)
    copies = mix_to_targets(docs, id_col=row, order_col="doc_id")
    # Rows that are taken once need no decision.
    copies = stored(copies.where("copies != 1").select(F.col(row).alias("_id"), F.col("copies").cast("int").alias("_copies")))
    few = copies.limit(FEW + 1).count() <= FEW
    side = F.broadcast(copies) if few else copies
    taken = docs.join(side, docs[row] == side["_id"], "left")
    times = F.coalesce(side["_copies"], F.lit(1))
    each = F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>")))
    return taken.select(*(docs[c] for c in docs.columns if c != row), each.alias(_free(docs, "_copy"))).select(
        [c for c in docs.columns if c != row]
    )


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of whole documents; each copy is packed by itself."""
    shipped(spark)
    return pack_documents(docs, remembered=REMEMBERED)


STAGES = [
    ("language", language),
    ("exact_dedup", exact_dedup),
    ("ngram_join", ngram_join),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what lies between is stored in the shared folder, until the next stage has it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = work_dir(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
