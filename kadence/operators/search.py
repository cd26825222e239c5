"""Address search: free text to its best scored address, over an inverted index of numbers and trigrams.

Terms of an address are its numbers, whole, and the trigrams of its words, in any order. A term weighs the more the
fewer addresses have it. The score of two texts is the weight they share, twice, over the weight of both,
in thousandths. Texts that can reach the asked score share one of their rarest terms (see ``_rarest``), and the found one
has all numbers of the wanted one. So a text with numbers looks up its rarest number together with each of its
rarest terms; only texts without a number look up terms alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kadence.operators.places import NO_CANDIDATE, address_key, best_candidates, left_join_known

#: Fixed value: a number, or a run of letters (ASCII punctuation ends it).
TOKEN = r"[0-9]+|[^0-9\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Least score of a match, in thousandths.
LEAST = 500


def address_terms(address: Column) -> Column:
    """Distinct terms of a text: ``#`` and a number, or three letters of a word, whose ends count as ``_``."""

    def of(token: Column) -> Column:
        framed = F.concat(F.lit("_"), token, F.lit("_"))
        letters = F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: F.substring(framed, i, F.lit(3)))
        return F.when(token.rlike("^[0-9]"), F.array(F.concat(F.lit("#"), token))).otherwise(letters)

    tokens = F.regexp_extract_all(F.lower(address), F.lit(TOKEN), 0)
    return F.array_distinct(F.flatten(F.transform(tokens, of)))


def _weighted(texts: DataFrame, known: DataFrame, total: int) -> DataFrame:
    """``key, terms (term, w), weight, term, w`` per term of each distinct text; an unknown term is the rarest."""
    terms = texts.select("key", F.explode(address_terms(F.col("key"))).alias("term"))
    rarity = F.floor(F.lit(1000.0) * F.log1p(F.lit(float(total)) / F.coalesce("n", F.lit(1)))).cast("long")
    return terms.join(known, "term", "left").select("key", "term", rarity.alias("w"))


def _whole(weighted: DataFrame) -> DataFrame:
    return weighted.groupBy("key").agg(
        F.collect_list(F.struct("term", "w")).alias("terms"), F.sum("w").alias("weight")
    )


def _rarest(weighted: DataFrame, least: int) -> DataFrame:
    """The terms, rarest first, without which the rest could not reach ``least`` any more.

    A match of weight S and a text of weight W have 2000 S >= least (W + V), and the other's V is S at least. What
    comes after these terms weighs less, so a match shares one of them, and so it does for the other text.
    """
    order = Window.partitionBy("key").orderBy(F.col("w").desc(), "term").rowsBetween(0, Window.unboundedFollowing)
    left = weighted.withColumn("left", F.sum("w").over(order)).withColumn("weight", F.sum("w").over(Window.partitionBy("key")))
    return left.where((2000 - least) * F.col("left") >= least * F.col("weight")).select("key", "term")


def _looked_up(weighted: DataFrame, least: int) -> DataFrame:
    """``key, number, term`` to look up for each wanted text: a match has the number, if there is one, and one of the terms."""
    rank = F.when(F.col("term").startswith("#"), F.struct("w", "term"))
    numbers = weighted.groupBy("key").agg(F.max(rank)["term"].alias("number"))
    return _rarest(weighted, least).join(numbers, "key").select("key", F.coalesce("number", F.lit("")).alias("number"), "term")


def _listed(weighted: DataFrame, least: int) -> DataFrame:
    """``found, number, term`` under which an address stands: each rarest term with each of its numbers, and with none."""
    digits = F.collect_list(F.when(F.col("term").startswith("#"), F.col("term")))
    numbers = weighted.groupBy("key").agg(F.array_append(digits, F.lit("")).alias("numbers"))
    return _rarest(weighted, least).join(numbers, "key").select(
        F.col("key").alias("found"), F.explode("numbers").alias("number"), "term"
    )


def candidates(asked: DataFrame, index: DataFrame, least: int) -> DataFrame:
    """``key, found`` of weighted texts that may match: all that do are among them."""
    pairs = _looked_up(asked, least).join(_listed(index, least), ["number", "term"])
    return pairs.select("key", "found").distinct()


def search(wanted: DataFrame, addresses: DataFrame, least: int = LEAST) -> DataFrame:
    """``key, found, match`` for each distinct text ``key`` of ``wanted`` that has a match among ``key`` of ``addresses``.

    ``match`` is the score, ``least`` at least; all numbers of the wanted text stand in the found one. Of equal
    scores the first text counts. Texts without a term match nothing.
    """
    known = addresses.select(F.explode(address_terms(F.col("key"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    # One number; the index itself is never collected.
    total = addresses.count()
    asked, index = (_weighted(t, known, total) for t in (wanted, addresses))
    pairs = candidates(asked, index, least)
    mine = _whole(asked).withColumnsRenamed({"terms": "asked", "weight": "asked_weight"})
    theirs = _whole(index).withColumnRenamed("key", "found")
    both = pairs.join(mine, "key").join(theirs, "found")
    names = F.transform("terms", lambda t: t["term"])
    shared = F.filter("asked", lambda t: F.array_contains(names, t["term"]))
    numbers = F.size(F.filter("asked", lambda t: t["term"].startswith("#")))
    same = F.size(F.filter(shared, lambda t: t["term"].startswith("#"))) == numbers
    weight = F.aggregate(shared, F.lit(0).cast("long"), lambda sum_, t: sum_ + t["w"])
    match = F.call_function("div", 2000 * weight, F.col("asked_weight") + F.col("weight")).cast("int")
    scored = both.where(same).select("key", "found", match.alias("match")).where(F.col("match") >= least)
    best = F.min_by(F.struct("found", "match"), F.struct(-F.col("match"), F.col("found")))
    return scored.groupBy("key").agg(best.alias("best")).select("key", "best.*")


def geocode_search(
    df: DataFrame, addresses: DataFrame, address: str = "adresse_domicile", least: int = LEAST
) -> DataFrame:
    """Rows with ``lat, lon, geo_error, geo_match``: as ``geocode_join``, for misspelt and reordered addresses too.

    An address that stands in the lookup as it is has match 1000; each other distinct text is searched once. Below
    ``least`` there is no candidate, which is an error; a null address has neither match nor error.
    """
    located = best_candidates(addresses)
    keyed = df.withColumn("address_key", address_key(F.col(address)))
    asked = keyed.where("address_key is not null").select("address_key").distinct()
    exact = asked.join(located.select("address_key"), "address_key", "left_semi")
    rest = asked.join(located.select("address_key"), "address_key", "left_anti")
    met = search(rest.withColumnRenamed("address_key", "key"), located.select(F.col("address_key").alias("key")), least)
    links = exact.select("address_key", F.col("address_key").alias("found"), F.lit(1000).alias("geo_match")).unionByName(
        met.select(F.col("key").alias("address_key"), "found", F.col("match").alias("geo_match"))
    )
    known = links.join(located.withColumnRenamed("address_key", "found"), "found").drop("found")
    missed = F.col("geo_match").isNull() & F.col(address).isNotNull()
    return (
        left_join_known(keyed, known, ["address_key"])
        .withColumn("geo_error", F.when(missed, F.lit(NO_CANDIDATE)))
        .drop("address_key")
    )
