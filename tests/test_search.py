"""Address search against scoring all pairs, and what it must find or miss."""

import math
import random
import re

import pytest
from conftest import rows

from kadence.operators.places import NO_CANDIDATE
from kadence.operators.search import TOKEN, geocode_search, search

PLACES = [
    ("12 Rue de la République 34000 Montpellier", 1.0), ("14 Rue de la République 34000 Montpellier", 2.0),
    ("12 Avenue de la Gare 34000 Montpellier", 3.0), ("3 Impasse des Acacias 34970 Lattes", 4.0),
    ("3 Impasse des Acacias 34970 Lattes", 4.5), ("Mairie", 5.0), ("8 Rue Foch 34000 Montpellier", None),
]


def lookup(spark, places=PLACES):
    data = [(a, lat, 0.0, float(i)) for i, (a, lat) in enumerate(places)]
    return spark.createDataFrame(data, "adresse string, lat double, lon double, score double")


def located(spark, texts, places=PLACES):
    people = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, adresse_domicile string")
    found = geocode_search(people, lookup(spark, places))
    return {r["id"]: (r["lat"], r["geo_match"], r["geo_error"]) for r in found.collect()}


def test_what_is_found_and_what_is_missed(spark):
    texts = [
        "12  rue DE la république 34000 montpellier", "Montpellier 34000, rue de la République 12", "12 rue de la Republique 34000 Montpelier",
        "13 rue de la République 34000 Montpellier", "3, impasse des Accacias - 34970 LATTES", "mairie", "Gare", None, "", "…", "8 rue foch 34000 montpellier",
    ]
    got = located(spark, texts)
    assert got[0] == (1.0, 1000, None) and got[1] == (1.0, 1000, None)
    assert got[2][0] == 1.0 and 500 <= got[2][1] < 1000
    # Another house number is another address.
    assert got[3] == (None, None, NO_CANDIDATE)
    # Of equal texts in the lookup its own score decides.
    assert got[4][0] == 4.5
    assert got[5] == (5.0, 1000, None)
    assert got[6][2] == NO_CANDIDATE
    assert got[7] == (None, None, None)
    assert got[8][2] == got[9][2] == NO_CANDIDATE
    # A candidate without a place is no error here.
    assert got[10] == (None, 1000, None)


def terms(text):
    out = set()
    for token in re.findall(TOKEN, text.lower()):
        framed = f"_{token}_"
        out |= {"#" + token} if token[0].isdigit() else {framed[i : i + 3] for i in range(len(token))}
    return out


@pytest.mark.parametrize("least", [300, 500, 900])
def test_search_equals_scoring_all_pairs(spark, least):
    chance = random.Random(least)
    names = ["gare", "garde", "grande", "foch", "fosch", "republique", "place", "de", "la"]

    def text():
        return " ".join(chance.sample(names, chance.randrange(1, 4)) + [str(chance.randrange(4)) for _ in range(chance.randrange(2))])

    index, asked = sorted({text() for _ in range(120)}), sorted({text() for _ in range(120)})
    df = {t: sum(t in terms(a) for a in index) for a in [*index, *asked] for t in terms(a)}
    w = {t: math.floor(1000 * math.log1p(len(index) / max(n, 1))) for t, n in df.items()}
    want = []
    for q in asked:
        best = []
        for a in index:
            both, number = terms(q) & terms(a), {t for t in terms(q) if t[0] == "#"}
            score = 2000 * sum(w[t] for t in both) // (sum(w[t] for t in terms(q)) + sum(w[t] for t in terms(a)))
            if score >= least and number <= both:
                best.append((-score, a))
        if best:
            want.append((q, min(best)[1], -min(best)[0]))
    frame = lambda texts: spark.createDataFrame([(t,) for t in texts], "key string")
    assert rows(search(frame(asked), frame(index), least)) == sorted(want, key=repr)


def test_texts_with_numbers_meet_no_other_house_of_their_street(spark):
    """One street of many houses: all texts share its terms, but only those with the number are scored."""
    from kadence.operators import search as S

    frame = lambda texts: spark.createDataFrame([(t,) for t in texts], "key string")
    index, asked = frame([f"{k} rue machinery" for k in range(400)]), frame([f"{k} rue machinry" for k in range(0, 800, 2)])
    known = index.select(S.F.explode(S.address_terms(S.F.col("key"))).alias("term")).groupBy("term").agg(S.F.count("*").alias("n"))
    pairs = S.candidates(S._weighted(asked, known, 400), S._weighted(index, known, 400), 300)
    assert rows(pairs) == sorted(((f"{k} rue machinry", f"{k} rue machinery") for k in range(0, 400, 2)), key=repr)
    assert {r["key"] for r in search(asked, index, 300).collect()} == {f"{k} rue machinry" for k in range(0, 400, 2)}


def test_empty_sides(spark):
    assert located(spark, []) == {}
    assert located(spark, ["12 rue foch", None], []) == {0: (None, None, NO_CANDIDATE), 1: (None, None, None)}
