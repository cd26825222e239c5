"""Explicit schemas. Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

EMPLOYEE_CSV = T.StructType(
    [
        T.StructField("id_salarie", T.LongType()),
        T.StructField("nom", T.StringType()),
        T.StructField("prenom", T.StringType()),
        T.StructField("ddn_as_text", T.StringType()),
        T.StructField("bu", T.StringType()),
        T.StructField("date_embauche_as_text", T.StringType()),
        T.StructField("salaire_brut", T.IntegerType()),
        T.StructField("type_contrat", T.StringType()),
        T.StructField("nb_jours_CP", T.IntegerType()),
        T.StructField("adresse_domicile", T.StringType()),
        T.StructField("moyen_deplacement", T.StringType()),
    ]
)

# Row image of an employee change: dates travel as days since 1970-01-01.
EMPLOYEE_IMAGE = T.StructType(
    [
        T.StructField("id_salarie", T.LongType()),
        T.StructField("nom", T.StringType()),
        T.StructField("prenom", T.StringType()),
        T.StructField("ddn", T.IntegerType()),
        T.StructField("bu", T.StringType()),
        T.StructField("date_embauche", T.IntegerType()),
        T.StructField("salaire_brut", T.IntegerType()),
        T.StructField("type_contrat", T.StringType()),
        T.StructField("nb_jours_CP", T.IntegerType()),
        T.StructField("adresse_domicile", T.StringType()),
        T.StructField("moyen_deplacement", T.StringType()),
    ]
)

# Row image of an activity: timestamps travel as microseconds since 1970-01-01.
ACTIVITY_IMAGE = T.StructType(
    [
        T.StructField("id_evenement_sport", T.LongType()),
        T.StructField("salarie_id", T.LongType()),
        T.StructField("date_debut_activite", T.LongType()),
        T.StructField("date_fin_activite", T.LongType()),
        T.StructField("sport_type", T.StringType()),
        T.StructField("distance_m", T.LongType()),
        T.StructField("commentaire", T.StringType()),
    ]
)

ACTIVITY = T.StructType(
    [
        T.StructField("id_evenement_sport", T.LongType()),
        T.StructField("salarie_id", T.LongType()),
        T.StructField("date_debut_activite", T.TimestampType()),
        T.StructField("date_fin_activite", T.TimestampType()),
        T.StructField("sport_type", T.StringType()),
        T.StructField("distance_m", T.LongType()),
        T.StructField("commentaire", T.StringType()),
    ]
)

SILVER = T.StructType(
    [
        T.StructField("id_salarie", T.LongType()),
        T.StructField("est_eligible_prime_annuel", T.BooleanType()),
        T.StructField("date_debut", T.TimestampType()),
        T.StructField("date_fin", T.TimestampType()),
        T.StructField("duree", T.IntegerType()),
    ]
)

# What a change topic delivers: the broker's own columns.
TOPIC = T.StructType(
    [
        T.StructField("value", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
    ]
)

RULE_FILE = T.StructType(
    [
        T.StructField(
            "entreprises",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.IntegerType()),
                        T.StructField("type", T.StringType()),
                        T.StructField("adresse", T.StringType()),
                        T.StructField("ville", T.StringType()),
                        T.StructField("code_postal", T.StringType()),
                        T.StructField("pays", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField(
            "parametres_regles",
            T.StructType(
                [
                    T.StructField("%_jours_eligibles_par_an", T.DoubleType()),
                    T.StructField("prime_annuelle_%_brut", T.DoubleType()),
                    T.StructField("nb_journee_bien_etre_gagnees", T.IntegerType()),
                    T.StructField("nb_activite_physique_min", T.IntegerType()),
                    T.StructField("marche_running_distance_max_m", T.IntegerType()),
                    T.StructField("velo_trottinette_distance_max_m", T.IntegerType()),
                ]
            ),
        ),
    ]
)

ROAD_NODES = T.StructType(
    [
        T.StructField("network", T.StringType()),
        T.StructField("node_id", T.LongType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
    ]
)

ROAD_EDGES = T.StructType(
    [
        T.StructField("network", T.StringType()),
        T.StructField("u", T.LongType()),
        T.StructField("v", T.LongType()),
        T.StructField("length", T.DoubleType()),
    ]
)


def envelope(image: T.StructType) -> T.StructType:
    """``{"payload": {"op", "before", "after"}}`` around a row image; other members are ignored."""
    return T.StructType(
        [
            T.StructField(
                "payload",
                T.StructType(
                    [
                        T.StructField("op", T.StringType()),
                        T.StructField("before", image),
                        T.StructField("after", image),
                    ]
                ),
            )
        ]
    )
