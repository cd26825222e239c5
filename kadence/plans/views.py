"""Change-data views over the given tables, for checks and benchmarks.

The same SQL runs in Spark and in DuckDB, apart from the few spellings in ``Dialect``. Only
``fx_change`` needs neighbouring rows: DuckDB takes them with a window, Spark with
``with_neighbours``. Every view reads its tables whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kadence.operators.skew import with_neighbours

TABLES = ("customer", "supplier", "part", "orders", "lineitem", "events")

# Row image of the employee changes below.
IMAGE = T.StructType(
    [
        T.StructField("id_salarie", T.LongType()),
        T.StructField("nom", T.StringType()),
        T.StructField("adresse_domicile", T.StringType()),
        T.StructField("moyen_deplacement", T.StringType()),
        T.StructField("distance_m", T.LongType()),
    ]
)


@dataclass(frozen=True)
class Dialect:
    each: Callable[[str], str]  # one row per literal of a list
    micros: Callable[[str], str]  # timestamp without zone -> microseconds
    stamp: Callable[[str], str]  # timestamp of a table -> timestamp of the session
    instant: Callable[[str], str]  # microseconds -> timestamp
    days: Callable[[str], str]  # timestamp -> days since 1970-01-01


SPARK = Dialect(
    each=lambda items: f"explode(array({items}))",
    micros=lambda c: f"unix_micros(cast({c} as timestamp))",
    stamp=lambda c: f"cast({c} as timestamp)",
    instant=lambda c: f"timestamp_micros({c})",
    days=lambda c: f"cast(unix_date(cast({c} as date)) as bigint)",
)
DUCKDB = Dialect(
    each=lambda items: f"unnest([{items}])",
    micros=lambda c: f"epoch_us({c})",
    stamp=lambda c: c,
    instant=lambda c: f"make_timestamp({c})",
    days=lambda c: f"date_diff('day', date '1970-01-01', cast({c} as date))",
)


def _place(key: str, step: int, centre: str, spread: str) -> str:
    """A coordinate scattered evenly around a centre."""
    return f"{centre} + (({key} * {step}) % 100003 / 100003e0 - 5e-1) * {spread}"


def _image(side: str) -> str:
    """JSON text of an image, ``null`` if there is none."""

    def text(column: str) -> str:
        return f"coalesce('\"' || {column} || '\"', 'null')"

    return f"""case when {side}_there then
        '{{{{"id_salarie":' || cast(id_salarie as string) ||
        ',"nom":"N' || cast(id_salarie as string) ||
        '","adresse_domicile":' || {text(f"{side}_adresse")} ||
        ',"moyen_deplacement":' || {text(f"{side}_moyen")} ||
        ',"distance_m":' || cast({side}_distance as string) || '}}}}'
        else 'null' end"""


def _fact(op: str, before: str, after: str, shift: int = 0) -> str:
    """JSON of an activity change; the sides are the end time in microseconds, or ``null``."""

    def side(fin: str) -> str:
        if fin == "null":
            return "'null'"
        return f"""'{{{{"id_evenement_sport":' || cast(id_evenement_sport + {shift} as string)
            || ',"salarie_id":' || cast(salarie_id as string)
            || ',"date_debut_activite":' || cast({fin} - 60000000 as string)
            || ',"date_fin_activite":' || cast({fin} as string)
            || ',"sport_type":"' || sport_type
            || '","distance_m":' || cast(distance_m as string) || ',"commentaire":null}}}}'"""

    return f"""'{{{{"payload":{{{{"op":"{op}","before":' || {side(before)}
            || ',"after":' || {side(after)} || '}}}}}}}}'"""


def _with_end(d: Dialect) -> str:
    return f"""(select *, {d.micros("date_fin_activite")} as fin_us from {{fx_activity}}) as f"""


def view_sql(d: Dialect) -> dict[str, str]:
    """View definitions in order of use; ``{name}`` stands for a table or an earlier view."""
    return {
        "fx_employee": """
            select c_custkey as id_salarie, c_name as nom,
                'P' || cast(c_nationkey as string) as prenom, c_mktsegment as bu,
                cast(25000 + floor((c_acctbal + 1000) * 4) as int) as salaire_brut,
                case when c_acctbal >= -850 then
                    cast(cast(floor(c_custkey / 4) as bigint) as string) || ' Rue '
                    || cast(c_custkey % 2 as string) end as adresse_domicile,
                case when c_acctbal >= 0 and c_acctbal < 100 then null
                    when c_nationkey % 4 = 0 then 'Marche/running'
                    when c_nationkey % 4 = 1 then 'Vélo/Trottinette/Autres'
                    when c_nationkey % 4 = 2 then 'Transports en commun'
                    else 'véhicule thermique/électrique' end as moyen_deplacement,
                cast(1 + c_custkey % 28 as string) || '/' || cast(1 + c_custkey % 12 as string)
                    || '/' || cast(1960 + c_custkey % 45 as string) as ddn_as_text,
                case when c_acctbal < -800 then null when c_acctbal > 9900 then '31/2/2021'
                    else cast(1 + c_custkey % 28 as string) || '/'
                    || cast(1 + c_custkey % 12 as string) || '/'
                    || cast(2000 + c_custkey % 24 as string) end as date_embauche_as_text
            from {customer}""",
        "fx_address": f"""
            select '  ' || upper(replace(adresse_domicile, ' ', '  ')) as adresse,
                case when c_acctbal < 8000 or c_acctbal > 8100
                    then {_place("c_custkey", 7919, "43.57e0", "0.5e0")} end as lat,
                {_place("c_custkey", 15401, "3.9e0", "0.6e0")} as lon,
                c_acctbal as score
            from (select c_custkey, c_acctbal,
                    cast(cast(floor(c_custkey / 4) as bigint) as string) || ' Rue '
                    || cast(c_custkey % 2 as string) as adresse_domicile
                from {{customer}}) as c
            where c_acctbal >= -850 and c_acctbal < 9000""",
        # A lookup with street names, and what people wrote: as it is, in another order, misspelt,
        # with punctuation and a further word, or with a number that no address has.
        "fx_street": f"""
            select cast(cast(floor(c_custkey / 4) as bigint) as string) || ' Rue '
                    || c_mktsegment || ' ' || cast(c_custkey % 2 as string) as adresse,
                case when c_acctbal < 8000 or c_acctbal > 8100
                    then {_place("c_custkey", 7919, "43.57e0", "0.5e0")} end as lat,
                {_place("c_custkey", 15401, "3.9e0", "0.6e0")} as lon,
                c_acctbal as score
            from {{customer}} where c_acctbal < 9000""",
        "fx_wanted": """
            select id_salarie, case k % 6 when 0 then nr || ' Rue ' || name || ' ' || last
                when 1 then lower(name) || ' ' || last || ' RUE ' || nr
                when 2 then nr || ' Rue ' || substr(name, 1, 2) || substr(name, 4, 20) || ' ' || last
                when 3 then nr || ', rue-' || lower(name) || ' appt; ' || last
                when 4 then '9' || nr || '77 Rue ' || name || ' ' || last end as adresse_domicile
            from (select c_custkey as id_salarie, c_custkey + cast(floor(c_custkey / 6) as bigint) as k,
                    cast(cast(floor(c_custkey / 4) as bigint) as string) as nr,
                    c_mktsegment as name, cast(c_custkey % 2 as string) as last
                from {customer}) as c""",
        "fx_node": f"""
            select {d.each("'walk', 'drive'")} as network, node_id, lat, lon from (
                select 2 * s_suppkey as node_id,
                    {_place("s_suppkey", 30011, "43.57e0", "0.5e0")} as lat,
                    {_place("s_suppkey", 4409, "3.9e0", "0.6e0")} as lon
                from {{supplier}}
                union all
                select 2 * p_partkey + 1 as node_id,
                    {_place("p_partkey", 20011, "43.57e0", "0.5e0")} as lat,
                    {_place("p_partkey", 6007, "3.9e0", "0.6e0")} as lon
                from {{part}}) as places""",
        # Every line is two roads between its places, each with its own length: one out, one back.
        # With flag N the second runs out as well, so the road is one-way. From every fiftieth
        # part all roads lead away from the network: it has a place but no path.
        "fx_edge": """
            select network, case when inward then part else supp end as u,
                case when inward then supp else part end as v, length
            from (
                select case when l_linestatus = 'O' then 'walk' else 'drive' end as network,
                    2 * l_suppkey as supp, 2 * l_partkey + 1 as part, false as inward,
                    1500 + l_quantity * 60 + l_extendedprice / 1e6 as length
                from {lineitem}
                union all
                select case when l_linestatus = 'O' then 'walk' else 'drive' end as network,
                    2 * l_suppkey as supp, 2 * l_partkey + 1 as part,
                    l_returnflag <> 'N' and l_partkey % 50 <> 0 as inward,
                    1000 + l_quantity * 50 + l_extendedprice / 1e6 as length
                from {lineitem}) as roads""",
        # One long road through all orders, down to order 0, with a side road to each line.
        "fx_chain": """
            select 'walk' as network, o_orderkey as u, o_orderkey - 1 as v,
                cast(1 + floor(o_totalprice) as double) as length
            from {orders} where o_orderkey > 0
            union all
            select 'walk' as network, 1000000000000 + 10 * l_orderkey + l_linenumber as u, l_orderkey as v,
                cast(l_quantity as double) as length
            from {lineitem}""",
        "fx_activity": f"""
            select event_id as id_evenement_sport, user_id as salarie_id,
                {d.instant(f"{d.micros('ts')} - k * 60000000")} as date_debut_activite,
                {d.stamp("ts")} as date_fin_activite,
                case event_type when 'click' then 'Tennis' when 'view' then 'Randonnée'
                    when 'purchase' then 'Runing' when 'signup' then 'Natation'
                    else 'Curling' end as sport_type,
                case when event_type = 'error' then 0
                    else cast(floor(value * 100) as bigint) end as distance_m,
                case when k < 10 then 'Belle sortie' when k > 90 then '' end as commentaire, k
            from (select event_id, user_id, ts, event_type, value,
                    cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k
                from {{events}}) as e""",
        "fx_registry": f"""
            select c_custkey as id_salarie, {d.instant("1672531200000000")} as created_at,
                case when c_acctbal > 9000 then {d.instant("1704067200000000")} end as deleted_at
            from {{customer}} where c_acctbal >= 500""",
        "fx_state": f"""
            select o_custkey as id_salarie,
                {d.days("o_orderdate")} * 1000000000000 + o_orderkey as seq,
                {d.stamp("o_orderdate")} as ts, o_orderstatus as status,
                case when o_totalprice < 10000 then null
                    when o_orderpriority = '1-URGENT' then 'Marche/running'
                    when o_orderpriority = '2-HIGH' then 'Vélo/Trottinette/Autres'
                    when o_orderpriority = '3-MEDIUM' then 'Transports en commun'
                    when o_orderpriority = '4-NOT SPECIFIED' then 'véhicule thermique/électrique'
                    else 'Course à pied (running)' end as moyen,
                cast(floor(o_totalprice * 6e-2) as bigint) as distance_m,
                case when o_totalprice >= 20000 then
                    cast(cast(floor(o_custkey / 4) as bigint) as string) || ' Rue '
                    || cast(o_orderkey % 2 as string) end as adresse
            from {{orders}}""",
        "fx_change": "",
        "fx_envelope": f"""
            select '{{{{"payload":{{{{"op":"' || op || '","before":' || {_image("b")}
                    || ',"after":' || {_image("a")} || '}}}}}}}}' as value,
                'state' as topic, cast(id_salarie % 16 as int) as part_no,
                seq as pos, ts
            from {{fx_change}}""",
        # As delivered: some messages come twice, some carry nothing or no JSON.
        "fx_topic": """
            select value, topic, part_no, pos, ts from {fx_envelope}
            union all
            select value, topic, part_no, pos, ts
            from {fx_envelope} where value like '%"moyen_deplacement":null%'
            union all
            select null as value, topic, part_no, pos + 500000000000 as pos, ts
            from {fx_envelope} where value like '%"after":null%'
            union all
            select substr(value, 1, 40) as value, topic, part_no,
                pos + 600000000000 as pos, ts
            from {fx_envelope} where value like '%"op":"c"%'""",
        "fx_fact_topic": f"""
            select '{{{{"payload":{{{{"op":"'
                    || case when sport_type = 'Natation' and k < 50 then 'r' else 'c' end
                    || '","before":null,"after":{{{{"id_evenement_sport":'
                    || cast(id_evenement_sport as string)
                    || ',"salarie_id":' || cast(salarie_id as string)
                    || ',"date_debut_activite":' || cast(fin_us - k * 60000000 as string)
                    || ',"date_fin_activite":' || cast(fin_us as string)
                    || ',"sport_type":"' || sport_type
                    || '","distance_m":' || cast(distance_m as string)
                    || ',"commentaire":' || coalesce('"' || commentaire || '"', 'null')
                    || '}}}}}}}}}}}}' as value,
                'facts' as topic, cast(salarie_id % 16 as int) as part_no,
                id_evenement_sport as pos
            from (select *, {d.micros("date_fin_activite")} as fin_us from {{fx_activity}}) as f""",
        # The same activities, delivered in four lots: as they are, some moved to another year,
        # these moved back and others that are deleted again, and everything odd once more.
        "fx_fact_lot": f"""
            select 0 as lot, value, topic, part_no, pos from {{fx_fact_topic}}
            union all
            select 1 as lot, {_fact("u", "null", "fin_us + 31622400000000")} as value,
                'facts' as topic, cast(salarie_id % 16 as int) as part_no,
                id_evenement_sport + 100000000000 as pos from {_with_end(d)} where k < 20
            union all
            select 1 as lot, {_fact("c", "null", "fin_us", 100000000000)} as value,
                'facts' as topic, cast(salarie_id % 16 as int) as part_no,
                id_evenement_sport + 200000000000 as pos from {_with_end(d)} where k >= 80
            union all
            select 2 as lot, {_fact("u", "fin_us + 31622400000000", "fin_us")} as value,
                'facts' as topic, cast(salarie_id % 16 as int) as part_no,
                id_evenement_sport + 300000000000 as pos from {_with_end(d)} where k < 20
            union all
            select 2 as lot, {_fact("d", "fin_us", "null", 100000000000)} as value,
                'facts' as topic, cast(salarie_id % 16 as int) as part_no,
                id_evenement_sport + 400000000000 as pos from {_with_end(d)} where k >= 80
            union all
            select 3 as lot, value, topic, part_no, pos from {{fx_fact_topic}}
            union all
            select 3 as lot, {_fact("c", "null", "fin_us", 100000000000)} as value,
                'facts' as topic, cast(salarie_id % 16 as int) as part_no,
                id_evenement_sport + 200000000000 as pos from {_with_end(d)} where k >= 80""",
    }


# An order is a state of its customer; the one before is the before image. The first is a
# creation (read in the snapshot, for even customers), a last one with status F a deletion.
CHANGE = """
    select id_salarie, seq, ts,
        case when b_seq is null then case when id_salarie % 2 = 0 then 'r' else 'c' end
            when n_seq is null and status = 'F' then 'd' else 'u' end as op,
        b_seq is not null as b_there, b_adresse, b_moyen, b_distance,
        b_seq is null or n_seq is not null or status <> 'F' as a_there,
        adresse as a_adresse, moyen as a_moyen, distance_m as a_distance
    from """

WINDOWS = """(
    select *, lag(seq) over w as b_seq, lead(seq) over w as n_seq,
        lag(adresse) over w as b_adresse, lag(moyen) over w as b_moyen,
        lag(distance_m) over w as b_distance
    from {fx_state} window w as (partition by id_salarie order by seq)) as s"""


def _names(sql: str) -> list[str]:
    return re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql)


class Views:
    """The tables of a folder and the views over them, as DataFrames built on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.folder = spark, sf_dir.rstrip("/")
        self.sql = view_sql(SPARK)
        self.made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.made:
            if name == "fx_change":
                self.made[name] = self._change()
            elif name in self.sql:
                self.made[name] = self.query(self.sql[name])
            elif name in TABLES:
                self.made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                raise AttributeError(name)
        return self.made[name]

    def query(self, sql: str) -> DataFrame:
        return self.spark.sql(sql, **{n: getattr(self, n) for n in _names(sql)})

    def _change(self) -> DataFrame:
        images = ["seq", "adresse", "moyen", "distance_m"]
        rows = with_neighbours(
            self.fx_state, ["id_salarie"], "seq", images, following="n", preceding="b"
        )
        flat = rows.select(
            *self.fx_state.columns,
            F.col("n.seq").alias("n_seq"),
            F.col("b.seq").alias("b_seq"),
            F.col("b.adresse").alias("b_adresse"),
            F.col("b.moyen").alias("b_moyen"),
            F.col("b.distance_m").alias("b_distance"),
        )
        return self.spark.sql(CHANGE + "{s}", s=flat)


def as_topic(df: DataFrame) -> DataFrame:
    """The broker's column names, which are reserved words in SQL."""
    return df.withColumnsRenamed({"part_no": "partition", "pos": "offset"})


# Heads of keyed recursions: one row is kept per key.
HEADS = {"sh_road": "sh_road(network, node_id, road_m) using key (network, node_id)"}


def duckdb_views(extra: dict[str, str] | None = None) -> dict[str, str]:
    """All view definitions for DuckDB, with plain names."""
    sql = view_sql(DUCKDB)
    sql["fx_change"] = CHANGE + WINDOWS
    named = {n: n for n in (*TABLES, *sql)}
    return {n: s.format(**named) for n, s in sql.items()} | (extra or {})


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """A DuckDB query preceded by the views it uses, directly or through others."""
    views = duckdb_views(extra)
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in views:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(views[name])

    visit(sql)
    if not needed:
        return sql
    parts = ",\n".join(f"{HEADS.get(n, n)} as ({views[n]})" for n in views if n in needed)
    return f"with recursive {parts}\n{sql}"
