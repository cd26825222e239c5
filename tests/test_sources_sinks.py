import datetime as dt
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kadence.operators.constraints import normalise_employee, primary_key_violations
from kadence.rules import Site
from kadence.schemas import ROAD_EDGES, ROAD_NODES
from kadence.sinks import tables as K
from kadence.sources import files as S
from kadence.workspace import work_dir

EMPLOYEES = "﻿" + """id_salarie,nom,prenom,ddn_as_text,bu,date_embauche_as_text,salaire_brut,type_contrat,nb_jours_CP,adresse_domicile,moyen_deplacement
1,Un,Ana,3/2/1971,Support,21/9/2011,41000,CDD,27,"8 Impasse Haute, 11111 Ville",Marche/running
2,Deux,Bo,28/12/1999,Finance,1/4/2022,52500,CDI,25,"4 Quai ""B"", 22222 Lieu",Transports en commun
"""

RULES = {
    "entreprises": [
        {"id": 0, "type": "Siège", "adresse": "1 rue X", "ville": "V", "code_postal": "1", "pays": "F"}
    ],
    "parametres_regles": {
        "%_jours_eligibles_par_an": 80,
        "prime_annuelle_%_brut": 5,
        "nb_journee_bien_etre_gagnees": 5,
        "nb_activite_physique_min": 15,
        "marche_running_distance_max_m": 15000,
        "velo_trottinette_distance_max_m": 25000,
    },
}


def test_employee_csv(spark, tmp_path):
    path = tmp_path / "e.csv"
    path.write_text(EMPLOYEES, encoding="utf-8")
    df = S.read_employee_csv(spark, str(path))
    assert rows(df, "id_salarie", "adresse_domicile") == [
        (1, "8 Impasse Haute, 11111 Ville"),
        (2, '4 Quai "B", 22222 Lieu'),
    ]
    typed = normalise_employee(df)
    assert rows(typed, "id_salarie", "ddn")[0] == (1, dt.date(1971, 2, 3))
    assert primary_key_violations(df, ["id_salarie"]).isEmpty()


def test_rule_file(spark, tmp_path):
    path = tmp_path / "config.json"
    path.write_text(json.dumps(RULES, indent=2), encoding="utf-8")
    rules, sites = S.read_rules(spark, str(path))
    assert (rules.min_eligible_percent, rules.walk_limit_m, rules.min_activities) == (80, 15000, 15)
    assert rows(sites, "id", "adresse") == [(0, "1 rue X")]


def test_road_graph_around_a_site(spark, tmp_path):
    places = [("walk", 1, 0.0, 0.0), ("walk", 2, 0.0, 0.01), ("walk", 3, 0.0, 1.0), ("drive", 3, 0.0, 1.0), ("sea", 1, 0.0, 0.0)]
    spark.createDataFrame(places, ROAD_NODES).write.parquet(f"{tmp_path}/n")
    roads = [("walk", 1, 2, 3.0), ("walk", 2, 3, 1.0), ("drive", 3, 3, 2.0), ("drive", 1, 3, 2.0)]
    spark.createDataFrame(roads, ROAD_EDGES).write.parquet(f"{tmp_path}/e")
    nodes, edges = S.read_road_graph(
        spark, f"{tmp_path}/n", f"{tmp_path}/e", around=Site(0.0, 0.0), reach_m={"walk": 15_000, "drive": 200_000}
    )
    assert rows(nodes, "network", "node_id") == [("drive", 3), ("walk", 1), ("walk", 2)]
    assert rows(edges) == [("drive", 3, 3, 2.0), ("walk", 1, 2, 3.0)]


def test_road_graph(spark, tmp_path):
    nodes = spark.createDataFrame([("walk", 1, 1.0, 2.0)], ROAD_NODES)
    edges = spark.createDataFrame([("walk", 1, 2, 3.0)], ROAD_EDGES)
    nodes.write.parquet(f"{tmp_path}/n")
    edges.write.parquet(f"{tmp_path}/e")
    n, e = S.read_road_graph(spark, f"{tmp_path}/n", f"{tmp_path}/e")
    assert (rows(n), rows(e)) == (rows(nodes), rows(edges))


SCHEMA = T.StructType([T.StructField("v", T.LongType())])


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], SCHEMA)


def test_replayed_batch_replaces_only_itself(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert K.read_batches(spark, path, SCHEMA).isEmpty()
    K.append_batch(numbers(spark, 1, 2), path, 0)
    K.append_batch(numbers(spark, 3), path, 1)
    K.append_batch(numbers(spark, 1, 2), path, 0)
    assert rows(K.read_batches(spark, path, SCHEMA)) == [(1,), (2,), (3,)]
    K.append_batch(numbers(spark), path, 0)
    assert rows(K.read_batches(spark, path, SCHEMA)) == [(3,)]


def test_overwritten_table_may_read_itself(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert not K.is_non_empty(K.read_table(spark, path, SCHEMA))
    K.overwrite_table(numbers(spark, 1), path)
    old = K.read_table(spark, path, SCHEMA)
    K.overwrite_table(old.select((F.col("v") + 1).alias("v")), path)
    assert rows(K.read_table(spark, path, SCHEMA)) == [(2,)]
    assert rows(old) == [(1,)]
    for _ in range(4):
        K.overwrite_table(numbers(spark, 9), path, keep=2)
    assert K.versions(spark, path) == [4, 5]


def test_incomplete_version_is_not_read(spark, tmp_path):
    path = f"{tmp_path}/t"
    K.overwrite_table(numbers(spark, 1), path)
    numbers(spark, 7).write.parquet(f"{path}/version=1")
    (tmp_path / "t" / "version=1" / "_SUCCESS").unlink()
    assert rows(K.read_table(spark, path, SCHEMA)) == [(1,)]
    K.overwrite_table(numbers(spark, 2), path)
    assert rows(K.read_table(spark, path, SCHEMA)) == [(2,)]


@pytest.mark.parametrize("rows_", [50, 1_500_000])
@pytest.mark.parametrize("one", [False, True])
def test_export_has_one_shape_at_every_size(spark, tmp_path, rows_, one):
    path = tmp_path / "copy"
    df = spark.range(0, rows_, 1, 4).toDF("v")
    assert K.export_copy(df, str(path), single_file=one) == rows_
    assert len(list(path.glob("*.parquet"))) == (1 if one else 4)
    assert spark.read.parquet(str(path)).count() == rows_


def test_facts_lose_their_index_column(spark, tmp_path):
    df = numbers(spark, 1).withColumn("__index_level_0__", F.lit(0))
    K.append_facts(df, f"{tmp_path}/f", 0)
    assert K.read_batches(spark, f"{tmp_path}/f", SCHEMA).columns == ["v"]


def test_work_dir_is_under_the_shared_folder(spark):
    assert work_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
