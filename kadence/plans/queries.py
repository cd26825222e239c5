"""Registered queries: one per operator, run over whole tables, with a DuckDB check each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kadence.functions import messages as texts
from kadence.functions import scalars as S
from kadence.functions.geodesy import WGS84_A, WGS84_B, WGS84_F, EARTH_RADIUS_M, linear_distance
from kadence.operators import changes as C
from kadence.operators import constraints as K
from kadence.operators import eligibility as E
from kadence.operators import gold as G
from kadence.operators import history as H
from kadence.operators import notify as N
from kadence.operators import places as P
from kadence.operators import quality as Q
from kadence.operators import registry as R
from kadence.operators.regions import region_distances
from kadence.operators.search import geocode_search
from kadence.plans import commute as W
from kadence.plans.views import IMAGE, Views, as_topic, with_views
from kadence.rules import Rules, Site
from kadence.schemas import ACTIVITY, ACTIVITY_IMAGE
from kadence.session import pin_utc
from kadence.sinks.kept import bucket_of
from kadence.sinks.tables import (
    NOTIFICATIONS,
    append_batch,
    append_facts,
    export_copy,
    notification_table,
    overwrite_table,
    read_batches,
    read_table,
    versions,
)
from kadence.sources.files import read_road_graph, scan_activities, scan_silver
from kadence.sources.streams import FileTopic, read_change_stream
from kadence.streaming import facts, state
from kadence.streaming.batches import COUNTS, BatchWriter
from kadence.streaming.keyed import interval_revisions, intervals_of
from kadence.streaming.monitor import hourly_sketches, merged_quantiles
from kadence.streaming.unique import SeenKeys
from kadence.workspace import checkpointed, remove, work_dir

# The given events hold about 67 activities per user and year, so this threshold splits them.
RULES = Rules(min_activities=66)
SITE = Site(lat=43.57, lon=3.90)
YEAR = 2001
NOW = "2002-01-01 00:00:00"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Timestamps without a zone, as the given tables have them."""
    zoned = [c for c, t in df.dtypes if t == "timestamp"]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned}) if zoned else df


def query(name: str, oracle: str | None = None, extra: dict[str, str] | None = None):
    """Register a function of ``Views`` under a name, with the SQL that must agree."""

    def register(build: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(build(Views(pin_utc(spark), sf_dir)))

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = with_views(oracle, {**SHARED, **(extra or {})})
        return build

    return register


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def image(side: str) -> Column:
    """Row image of a change of the views."""
    row = F.struct(
        F.col("id_salarie"),
        F.concat(F.lit("N"), "id_salarie").alias("nom"),
        F.col(f"{side}_adresse").alias("adresse_domicile"),
        F.col(f"{side}_moyen").alias("moyen_deplacement"),
        F.col(f"{side}_distance").alias("distance_m"),
    )
    return F.when(F.col(f"{side}_there"), row).cast(IMAGE)


def changes(v: Views) -> DataFrame:
    """Decoded changes: what unwrapping the topic must yield."""
    return v.fx_change.select(
        "id_salarie", "seq", "ts", "op", image("b").alias("before"), image("a").alias("after")
    )


def judged(v: Views) -> DataFrame:
    """Routed changes with eligibility on both sides, from the distance in the images."""
    routed = C.route_state_changes(changes(v))

    def flag(side: str) -> Column:
        mode = S.commute_mode(F.col(f"{side}.moyen_deplacement"))
        return S.is_bonus_eligible(mode, F.col(f"{side}.distance_m"), RULES)

    counts = (F.col("route") != "updated") | C.has_relevant_change()
    return routed.filter(counts).withColumns(
        {
            "elig_before": F.when(F.col("before").isNotNull(), flag("before")),
            "elig_after": F.when(F.col("after").isNotNull(), flag("after")),
        }
    )


def intervals(v: Views) -> DataFrame:
    return H.scd2_intervals(H.state_log(judged(v)), sizes=v.fx_state)


# --- shared SQL ---------------------------------------------------------------------------


def sql_mode(c: str) -> str:
    return (
        f"case when contains(lower({c}), 'marche') or contains(lower({c}), 'running') then 'walk' "
        f"when contains(lower({c}), 'vélo') or contains(lower({c}), 'trottinette') then 'drive' end"
    )


def sql_limit(mode: str) -> str:
    return f"case {mode} when 'walk' then 15000 when 'drive' then 25000 end"


def sql_eligible(text: str, distance: str) -> str:
    return f"coalesce({distance} <= {sql_limit(f'({sql_mode(text)})')}, false)"


def sql_haversine(a: str, b: str, c: str, d: str) -> str:
    return (
        f"{2 * EARTH_RADIUS_M}e0 * asin(sqrt(least(1e0, sin(radians({c} - {a}) / 2) * "
        f"sin(radians({c} - {a}) / 2) + cos(radians({a})) * cos(radians({c})) * "
        f"sin(radians({d} - {b}) / 2) * sin(radians({d} - {b}) / 2))))"
    )


def sql_wgs84(source: str) -> str:
    """Geodesic metres of ``source(id, lat, lon)`` to the site, unrolled step by step."""
    f, a, b = (f"{x!r}e0" for x in (WGS84_F, WGS84_A, WGS84_B))
    angles = """c2 * sin(lam) as t1, c1 * s2 - s1 * c2 * cos(lam) as t2,
        s1 * s2 + c1 * c2 * cos(lam) as cs"""
    sql = f"""select id, lat, lon, sin(u1) as s1, cos(u1) as c1, sin(u2) as s2, cos(u2) as c2,
            span, span as lam from (select id, lat, lon,
            atan((1 - {f}) * tan(radians(lat))) as u1,
            atan((1 - {f}) * tan(radians({SITE.lat}e0))) as u2,
            radians({SITE.lon}e0 - lon) as span from ({source}) as p0) as p1"""
    keep = "id, lat, lon, s1, c1, s2, c2, span"
    for _ in range(6):
        sql = f"""select {keep}, span + (1 - c) * {f} * sa * (sigma + c * ss * (c2m + c * cs *
            (2 * c2m * c2m - 1))) as lam, ss, cs, c2a, c2m, sigma from (
            select *, {f} / 16 * c2a * (4 + {f} * (4 - 3 * c2a)) as c from (
            select *, case when c2a = 0 then 0e0 else cs - 2 * s1 * s2 / c2a end as c2m from (
            select *, 1 - sa * sa as c2a from (
            select *, case when ss = 0 then 0e0 else c1 * c2 * sin(lam) / ss end as sa,
                atan2(ss, cs) as sigma from (
            select *, sqrt(t1 * t1 + t2 * t2) as ss from (
            select {keep}, lam, {angles} from ({sql}) as q0) as q1) as q2) as q3) as q4) as q5) as q6"""
    return f"""select id, lat, lon, {b} * (1 + usq / 16384 * (4096 + usq * (-768 + usq *
            (320 - 175 * usq)))) * (sigma - bb * ss * (c2m + bb / 4 * (cs * (2 * c2m * c2m - 1)
            - bb / 6 * c2m * (4 * ss * ss - 3) * (4 * c2m * c2m - 3)))) as metres from (
            select *, usq / 1024 * (256 + usq * (-128 + usq * (74 - 47 * usq))) as bb from (
            select *, c2a * ({a} * {a} - {b} * {b}) / ({b} * {b}) as usq
            from ({sql}) as r0) as r1) as r2"""


def sql_key(c: str) -> str:
    return f"lower(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(sql_text(x) for x in values) + "]"


SITE_POINT = (f"{SITE.lat}e0", f"{SITE.lon}e0")

SHARED = {
    # Changes that count, with eligibility on both sides.
    "sh_judged": f"""
        select *, case when op in ('r', 'c') then 'created' when op = 'u' then 'updated'
                else 'deleted' end as route,
            case when b_there then {sql_eligible("b_moyen", "b_distance")} end as elig_before,
            case when a_there then {sql_eligible("a_moyen", "a_distance")} end as elig_after
        from fx_change
        where op <> 'u' or b_adresse is distinct from a_adresse
            or b_moyen is distinct from a_moyen""",
    "sh_log": """
        select id_salarie, elig_after, ts, seq, route from sh_judged
        where route <> 'updated' or elig_before is distinct from elig_after""",
    "sh_intervals": """
        select id_salarie, elig_after as est_eligible_prime_annuel, ts as date_debut, date_fin,
            cast(date_sub('day', ts, date_fin) as int) as duree
        from (select *, lead(ts) over (partition by id_salarie order by seq) as date_fin
            from sh_log) as s
        where route <> 'deleted'""",
    "sh_best": f"""
        select k as address_key, best.lat as lat, best.lon as lon from (
            select {sql_key("adresse")} as k,
                arg_max(struct_pack(lat := lat, lon := lon), score) as best
            from fx_address group by 1) as b""",
    "sh_measure": """
        select *, cast(trunc((fin_us - debut_us) / 1e6) as bigint) as duree_s,
            case when distance_m <> 0 then round_even(distance_m / 1e3, 1) end as distance_km,
            cast(year(date_fin_activite) as int) as annee
        from (select *, epoch_us(date_debut_activite) as debut_us,
            epoch_us(date_fin_activite) as fin_us from fx_activity) as m""",
    "sh_staff": "select * from fx_employee where salaire_brut >= 30000",
    "sh_template": "select * from (values "
    + ", ".join(
        f"({sql_text(s)}, {sql_list(p)}, {sql_list(c)}, {sql_list(e)})"
        for s, (p, c, e) in texts.SPORT_TEXTS.items()
    )
    + ") as t(sport_type, phrases, cheers, emojis)",
    "sh_wellbeing": """
        select salarie_id, cast(year(date_fin_activite) as int) as annee,
            count(id_evenement_sport) as nb_activites,
            count(id_evenement_sport) > 66 as est_eligible,
            cast(case when count(id_evenement_sport) > 66 then 5 else 0 end as int)
                as nb_jour_bien_etre
        from fx_activity group by 1, 2""",
    "sh_bonus": f"""
        select d.*, case when salaire_brut is null then null
                when ratio_jours > 80 and est_eligible_prime_annuel
                    then round_even(5 * salaire_brut / 1e2, 2) else 0e0 end as montant_prime
        from (select *, round_even(1e2 * duree / (case when annee % 4 = 0 and
                (annee % 100 <> 0 or annee % 400 = 0) then 366 else 365 end), 2) as ratio_jours
            from (select id_salarie, cast(year(fin) as int) as annee, est_eligible_prime_annuel,
                    sum(round_even((epoch_us(fin) - epoch_us(date_debut)) / 864e8, 0)) as duree
                from (select *, coalesce(date_fin, timestamp '{YEAR}-12-31 23:59:59') as fin
                    from sh_intervals) as i
                group by 1, 2, 3) as y) as d
        left join fx_employee as e on e.id_salarie = d.id_salarie""",
    # Roads walked back from the node nearest to the site, per network.
    "sh_target": f"""
        select network, arg_min(node_id, struct_pack(
            d := {sql_haversine("lat", "lon", *SITE_POINT)}, n := node_id)) as node_id
        from fx_node group by 1""",
    "sh_roads": """
        select network, u, v, min(length) as length from fx_edge group by 1, 2, 3""",
}
# A keyed recursion keeps one label per node.
SHARED_ROAD = {
    "sh_road": """
        select network, node_id, 0e0 as road_m from sh_target
        union all
        select c.network, c.node_id, c.road_m from (
            select e.network as network, e.u as node_id, min(r.road_m + e.length) as road_m
            from sh_road as r join sh_roads as e on e.network = r.network and e.v = r.node_id
            group by 1, 2) as c
        left join recurring.sh_road as k on k.network = c.network and k.node_id = c.node_id
        where k.road_m is null or c.road_m < k.road_m""",
}


# --- changes ------------------------------------------------------------------------------


@query(
    "cdc_snapshot",
    """select 'r' as op, true as sans_avant, id_salarie, nom, bu, salaire_brut,
        moyen_deplacement from fx_employee""",
)
def _(v):
    return C.snapshot_to_changes(v.fx_employee).select(
        "op",
        F.col("before").isNull().alias("sans_avant"),
        *(f"after.{c}" for c in ("id_salarie", "nom", "bu", "salaire_brut", "moyen_deplacement")),
    )


def _snapshots(v):
    old = v.query("""select id_salarie, bu, salaire_brut, moyen_deplacement from {fx_employee}
        where salaire_brut < 65000""")
    new = v.query("""select id_salarie, bu, case when bu = 'BUILDING' then salaire_brut + 100
            else salaire_brut end as salaire_brut,
            case when prenom = 'P7' then null else moyen_deplacement end as moyen_deplacement
        from {fx_employee} where salaire_brut >= 27000""")
    return old, new


@query(
    "cdc_snapshot_diff",
    """select * from (select coalesce(o.id_salarie, n.id_salarie) as id_salarie,
        case when o.id_salarie is null then 'c' when n.id_salarie is null then 'd'
            when o.bu is distinct from n.bu or o.salaire_brut is distinct from n.salaire_brut
            or o.moyen_deplacement is distinct from n.moyen_deplacement then 'u' end as op,
        o.salaire_brut as avant, n.salaire_brut as apres, o.moyen_deplacement as mode_avant,
        n.moyen_deplacement as mode_apres
        from sh_old as o full outer join sh_new as n on o.id_salarie = n.id_salarie) as d
    where op is not null""",
    {
        "sh_old": "select * from fx_employee where salaire_brut < 65000",
        "sh_new": """select id_salarie, bu, case when bu = 'BUILDING' then salaire_brut + 100
                else salaire_brut end as salaire_brut, case when prenom = 'P7' then null
                else moyen_deplacement end as moyen_deplacement
            from fx_employee where salaire_brut >= 27000""",
    },
)
def _(v):
    old, new = _snapshots(v)
    diff = C.diff_to_changes(old, new, "id_salarie", ["bu", "salaire_brut", "moyen_deplacement"])
    return diff.select(
        F.coalesce("before.id_salarie", "after.id_salarie").alias("id_salarie"),
        "op",
        F.col("before.salaire_brut").alias("avant"),
        F.col("after.salaire_brut").alias("apres"),
        F.col("before.moyen_deplacement").alias("mode_avant"),
        F.col("after.moyen_deplacement").alias("mode_apres"),
    )


def _side(side: str) -> list[Column]:
    fields = ("id_salarie", "adresse_domicile", "moyen_deplacement", "distance_m")
    return [F.col(f"{side}.{f}").alias(f"{side}_{f}") for f in fields]


def _side_sql(side: str, name: str) -> str:
    given = {
        "id_salarie": "id_salarie",
        "adresse_domicile": f"{side}_adresse",
        "moyen_deplacement": f"{side}_moyen",
        "distance_m": f"{side}_distance",
    }
    return ", ".join(f"case when {side}_there then {c} end as {name}_{f}" for f, c in given.items())


@query(
    "cdc_unwrap",
    f"""select seq, op, {_side_sql("b", "before")}, {_side_sql("a", "after")} from fx_change""",
)
def _(v):
    decoded = C.unwrap_envelope(as_topic(v.fx_envelope), IMAGE)
    return decoded.select(F.col("offset").alias("seq"), "op", *_side("before"), *_side("after"))


@query("cdc_tombstones", "select topic, part_no, pos from fx_topic where value is not null")
def _(v):
    kept = C.drop_tombstones(as_topic(v.fx_topic))
    return kept.select("topic", F.col("partition").alias("part_no"), F.col("offset").alias("pos"))


@query(
    "cdc_malformed",
    """select value, part_no, pos from fx_topic
    where value is not null and not json_valid(value)""",
)
def _(v):
    _, bad = C.split_malformed(as_topic(v.fx_topic), IMAGE)
    return bad.select("value", F.col("partition").alias("part_no"), F.col("offset").alias("pos"))


@query("cdc_dedupe", "select distinct topic, part_no, pos, value from fx_topic")
def _(v):
    once = C.dedupe_redelivered(as_topic(v.fx_topic))
    return once.select(
        "topic", F.col("partition").alias("part_no"), F.col("offset").alias("pos"), "value"
    )


@query(
    "cdc_route",
    """select seq, id_salarie, case when op in ('r', 'c') then 'created'
        when op = 'u' then 'updated' else 'deleted' end as route from fx_change""",
)
def _(v):
    return C.route_state_changes(changes(v)).select("seq", "id_salarie", "route")


@query(
    "cdc_fact_inserts",
    """select id_evenement_sport, salarie_id, sport_type, distance_m from fx_activity
    where not (sport_type = 'Natation' and k < 50)""",
)
def _(v):
    facts_only = C.route_fact_inserts(C.unwrap_envelope(as_topic(v.fx_fact_topic), ACTIVITY_IMAGE))
    return facts_only.select("after.*").select(
        "id_evenement_sport", "salarie_id", "sport_type", "distance_m"
    )


@query(
    "cdc_relevant_updates",
    """select seq, id_salarie from fx_change where op = 'u' and
    (b_adresse is distinct from a_adresse or b_moyen is distinct from a_moyen)""",
)
def _(v):
    return changes(v).filter(C.has_relevant_change()).select("seq", "id_salarie")


def _json_sql(side: str, pii: bool) -> str:
    def text(c: str) -> str:
        return f"""coalesce('"' || {c} || '"', 'null')"""

    personal = (
        f"""',"nom":"N' || id_salarie || '","adresse_domicile":' || {text(f"{side}_adresse")} ||"""
        if pii
        else ""
    )
    distance = f"""|| ',"distance_m":' || {side}_distance""" if pii else ""
    return f"""case when {side}_there then '{{"id_salarie":' || id_salarie || {personal}
        ',"moyen_deplacement":' || {text(f"{side}_moyen")} {distance} || '}}' end"""


@query(
    "bronze_changes",
    f"""select op, {_json_sql("b", True)} as before, {_json_sql("a", True)} as after,
    timestamp '{NOW}' as ingestion_ts from fx_change""",
)
def _(v):
    return C.to_bronze(changes(v), now())


@query(
    "bronze_no_pii",
    f"""select op, {_json_sql("b", False)} as before, {_json_sql("a", False)} as after,
    timestamp '{NOW}' as ingestion_ts from fx_change""",
)
def _(v):
    return C.to_bronze(C.drop_pii(changes(v)), now())


@query(
    "batch_offsets",
    """select '1700000000000_' || string_agg('p' || part_no || ':' || lo || '-' || hi, '_'
        order by part_no) as batch_id
    from (select part_no, min(pos) as lo, max(pos) as hi from fx_envelope group by 1) as p""",
)
def _(v):
    return C.batch_offset_ranges(as_topic(v.fx_envelope), F.lit(1_700_000_000_000))


# --- rules --------------------------------------------------------------------------------


@query(
    "commute_mode",
    f"select id_salarie, {sql_mode('moyen_deplacement')} as mode from fx_employee",
)
def _(v):
    return v.fx_employee.select(
        "id_salarie", S.commute_mode(F.col("moyen_deplacement")).alias("mode")
    )


@query(
    "bonus_eligibility",
    f"""select seq, {sql_mode("moyen")} as mode,
    cast({sql_limit(f"({sql_mode('moyen')})")} as int) as limite,
    {sql_eligible("moyen", "distance_m")} as est_eligible_prime_annuel from fx_state""",
)
def _(v):
    mode = S.commute_mode(F.col("moyen"))
    rows = E.with_eligibility(v.fx_state, RULES, "moyen", "distance_m")
    return rows.select(
        "seq", mode.alias("mode"), S.mode_limit(mode, RULES).alias("limite"),
        "est_eligible_prime_annuel",
    )


OUTCOME = """
    select *, case when adresse is null then 'adresse manquante'
        when moyen is null then 'moyen_deplacement manquant'
        when mode is null then null
        when geo_error is not null then 'Erreur geocode : ' || geo_error
        when lat is null or lon is null then 'Erreur geocode inconnue'
        when linear_m > lim then 'linear distance > ' || (lim / 1e3)::varchar || ' kms'
        when road_m is null then 'Erreur trajet : ' || coalesce(road_error, 'inconnue')
        when road_m > lim then 'distance hors règle : '
            || round_even(road_m / 1e3, 2)::varchar || ' kms' end as reason,
        adresse is not null and mode is not null and geo_error is null and lat is not null
            and lon is not null and not coalesce(linear_m > lim, false) as measured
    from (select *, {mode} as mode, {limit} as lim from {source}) as s"""


def _outcome_sql(source: str) -> str:
    mode = sql_mode("moyen")
    return OUTCOME.format(mode=mode, limit=sql_limit(f"({mode})"), source=source)


@query(
    "distance_outcome",
    f"""select seq, case when measured then road_m end as distance_m, reason
    from ({
        _outcome_sql(
            '''(select *,
        case when status = 'F' and distance_m < 3000 then 'Erreur : features empty' end
            as geo_error,
        case when distance_m >= 4000 then 43.57e0 end as lat, 3.9e0 as lon,
        distance_m * 8e-1 as linear_m,
        case when distance_m < 26000 then distance_m + 3e-1 end as road_m,
        case when status = 'O' then 'No path between 1 and 2.' end as road_error
        from fx_state) as x'''
        )
    }) as o""",
)
def _(v):
    rows = v.query("""select *,
        case when status = 'F' and distance_m < 3000 then 'Erreur : features empty' end
            as geo_error,
        case when distance_m >= 4000 then 43.57e0 end as lat, 3.9e0 as lon,
        distance_m * 8e-1 as linear_m,
        case when distance_m < 26000 then distance_m + 3e-1 end as road_m,
        case when status = 'O' then 'No path between 1 and 2.' end as road_error,
        adresse as adresse_domicile, moyen as moyen_deplacement
        from {fx_state}""").drop("distance_m")
    return W.with_outcome(rows, RULES).select("seq", "distance_m", "reason")


@query(
    "bonus_amount",
    """select id_salarie, case when sb is null then null
        when ratio > 80 and flag then round_even(5 * sb / 1e2, 2) else 0e0 end as montant_prime
    from (select id_salarie, case when salaire_brut > 26000 then salaire_brut end as sb,
        salaire_brut / 5e2 as ratio, prenom <> 'P3' as flag from fx_employee) as e""",
)
def _(v):
    rows = v.query("""select id_salarie, case when salaire_brut > 26000 then salaire_brut end as sb,
        salaire_brut / 5e2 as ratio, prenom <> 'P3' as flag from {fx_employee}""")
    amount = S.bonus_amount(F.col("sb"), F.col("ratio"), F.col("flag"), RULES)
    return rows.select("id_salarie", amount.alias("montant_prime"))


@query(
    "format_duration",
    """select id_evenement_sport, case when s is null or s <= 0 then '0min'
        when m // 60 > 0 and m % 60 > 0 then (m // 60) || 'h' || (m % 60) || 'min'
        when m // 60 > 0 then (m // 60) || 'h' else (m % 60) || 'min' end as duree
    from (select id_evenement_sport, s, cast(round_even(s / 6e1, 0) as bigint) as m
        from (select id_evenement_sport,
            case when k <> 50 then k * 150 - 300 + distance_m % 60 end as s
            from fx_activity) as a) as b""",
)
def _(v):
    seconds = F.when(F.col("k") != 50, F.col("k") * 150 - 300 + F.col("distance_m") % 60)
    return v.fx_activity.select("id_evenement_sport", S.format_duration(seconds).alias("duree"))


@query(
    "activity_measures",
    "select id_evenement_sport, duree_s, distance_km, annee from sh_measure",
)
def _(v):
    rows = N.activity_measures(_activity_images(v))
    return rows.select("id_evenement_sport", "duree_s", "distance_km", "annee")


def _activity_images(v: Views) -> DataFrame:
    """Activities with times in microseconds, as images carry them."""
    return v.fx_activity.withColumns(
        {
            c: F.unix_micros(c) for c in ("date_debut_activite", "date_fin_activite")
        }
    )


@query(
    "days_in_year",
    """select seq, cast(case when y % 4 = 0 and (y % 100 <> 0 or y % 400 = 0) then 366
        else 365 end as int) as jours
    from (select seq, 1600 + (distance_m // 50) as y from fx_state) as s""",
)
def _(v):
    year = (F.lit(1600) + F.floor(F.col("distance_m") / 50)).cast("int")
    return v.fx_state.select("seq", S.days_in_year(year).alias("jours"))


# --- history ------------------------------------------------------------------------------


@query("scd2_intervals", "select * from sh_intervals")
def _(v):
    return intervals(v)


@query(
    "scd2_active",
    """select id_salarie, est_eligible_prime_annuel, date_debut from sh_intervals
    where date_fin is null""",
)
def _(v):
    return H.active_rows(intervals(v)).select(
        "id_salarie", "est_eligible_prime_annuel", "date_debut"
    )


@query(
    "scd2_as_of",
    """select id_salarie, est_eligible_prime_annuel, date_debut from sh_intervals
    where date_debut <= timestamp '1998-06-01' and
        (date_fin is null or date_fin > timestamp '1998-06-01')""",
)
def _(v):
    at = F.lit("1998-06-01 00:00:00").cast("timestamp")
    return H.as_of(intervals(v), at).select(
        "id_salarie", "est_eligible_prime_annuel", "date_debut"
    )


@query(
    "latest_state",
    """select id_salarie, a_adresse as adresse_domicile, a_moyen as moyen_deplacement,
        a_distance as distance_m
    from fx_change as c where op <> 'd' and seq = (select max(seq) from fx_change as m
        where m.id_salarie = c.id_salarie)""",
)
def _(v):
    return H.latest_state(changes(v), "id_salarie", "seq").drop("nom")


@query(
    "eligibility_flips",
    """select seq, id_salarie, elig_before, elig_after from sh_judged
    where route = 'updated' and elig_before <> elig_after""",
)
def _(v):
    updates = judged(v).filter(F.col("route") == "updated")
    return E.eligibility_flips(updates).select("seq", "id_salarie", "elig_before", "elig_after")


@query(
    "quarantine_incoherences",
    f"""select id_salarie, 'silver' as couche, {sql_eligible("a_moyen", "a_distance")} as elig,
        null as raison from fx_change where a_there
    union all
    select id_salarie, 'incoherence', null, case when a_adresse is null then 'adresse manquante'
        else 'moyen_deplacement manquant' end
    from fx_change where a_there and (a_adresse is null or a_moyen is null)""",
)
def _(v):
    rows = changes(v).filter(F.col("after").isNotNull()).select("after.*")
    reason = F.when(F.col("adresse_domicile").isNull(), F.lit("adresse manquante")).when(
        F.col("moyen_deplacement").isNull(), F.lit("moyen_deplacement manquant")
    )
    flagged = E.with_eligibility(rows, RULES, "moyen_deplacement", "distance_m")
    silver, incoherences = E.split_quarantine(flagged.withColumn("reason", reason), now())
    return silver.select(
        "id_salarie",
        F.lit("silver").alias("couche"),
        F.col("est_eligible_prime_annuel").alias("elig"),
        F.lit(None).cast("string").alias("raison"),
    ).unionByName(
        incoherences.select(
            "id_salarie",
            F.lit("incoherence").alias("couche"),
            F.lit(None).cast("boolean").alias("elig"),
            F.col("raison_incoherence").alias("raison"),
        )
    )


# --- products -----------------------------------------------------------------------------


@query("wellbeing_days", "select * from sh_wellbeing order by annee, salarie_id")
def wellbeing_days(v):
    return G.sort_gold(G.yearly_activity_eligibility(v.fx_activity, RULES), "salarie_id")


@query("wellbeing_days_incremental", "select * from sh_wellbeing")
def _(v):
    cut = F.lit("2024-01-25 00:00:00").cast("timestamp")
    before = v.fx_activity.filter(F.col("date_fin_activite") < cut)
    batch = v.fx_activity.filter(F.col("date_fin_activite") >= cut)
    gold = G.yearly_activity_eligibility(before, RULES)
    return G.refresh_wellbeing(gold, v.fx_activity, G.touched_keys(batch), RULES)


@query(
    "touched_keys",
    "select distinct salarie_id, cast(year(date_fin_activite) as int) as annee from fx_activity",
)
def _(v):
    return G.touched_keys(v.fx_activity)


@query("annual_bonus", "select * from sh_bonus order by annee, id_salarie")
def _(v):
    gold = G.annual_bonus(intervals(v), G.scan_incomes(v.fx_employee), RULES, YEAR)
    return G.sort_gold(gold, "id_salarie")


# --- constraints, registry ----------------------------------------------------------------


@query(
    "activity_checks",
    """select id_evenement_sport, case when date_fin_activite <= date_debut_activite
        then 'end before start' else '' end as violations
    from fx_activity where date_fin_activite <= date_debut_activite""",
)
def _(v):
    _, broken = K.enforce_checks(v.fx_activity)
    return broken.select(
        "id_evenement_sport", F.array_join("violations", ",").alias("violations")
    )


@query(
    "activity_orphans",
    """select id_evenement_sport, salarie_id from fx_activity
    where salarie_id not in (select id_salarie from fx_registry)""",
)
def _(v):
    orphans = K.orphan_activities(v.fx_activity, v.fx_registry)
    return orphans.select("id_evenement_sport", "salarie_id")


@query(
    "pk_violations",
    """select topic, part_no, pos, count(*) as occurrences from fx_topic
    group by 1, 2, 3 having count(*) > 1""",
)
def _(v):
    return K.primary_key_violations(v.fx_topic, ["topic", "part_no", "pos"])


@query(
    "employee_normalise",
    """select id_salarie, nom, coalesce(cast(try_strptime(ddn_as_text, '%d/%m/%Y') as date),
        date '2000-01-01') as ddn, coalesce(cast(try_strptime(date_embauche_as_text, '%d/%m/%Y')
        as date), date '2000-01-01') as date_embauche from fx_employee""",
)
def _(v):
    return K.normalise_employee(v.fx_employee).select("id_salarie", "nom", "ddn", "date_embauche")


@query(
    "registry_insert",
    f"""select id_salarie, created_at, deleted_at from fx_registry
    union all select distinct id_salarie, timestamp '{NOW}', cast(null as timestamp)
    from fx_change where op in ('r', 'c')
        and id_salarie not in (select id_salarie from fx_registry)""",
)
def _(v):
    created = C.route_state_changes(changes(v)).filter(F.col("route") == "created")
    return R.registry_insert(v.fx_registry, created.select("id_salarie"), now())


@query(
    "registry_soft_delete",
    """select r.id_salarie, r.created_at, coalesce(d.ts, r.deleted_at) as deleted_at
    from fx_registry as r left join
        (select id_salarie, max(ts) as ts from fx_change where op = 'd' group by 1) as d
        on d.id_salarie = r.id_salarie""",
)
def _(v):
    deleted = C.route_state_changes(changes(v)).filter(F.col("route") == "deleted")
    gone = deleted.select("id_salarie", F.col("ts").alias("deleted_at"))
    return R.registry_soft_delete(v.fx_registry, gone)


@query(
    "layer_counts",
    """select 'bronze' as dataset, count(*) as n from fx_change
    union all select 'state_log', count(*) from sh_log
    union all select 'silver', count(*) from sh_intervals
    union all select 'gold_bonus', count(*) from sh_bonus
    union all select 'gold_wellbeing', count(*) from sh_wellbeing""",
)
def _(v):
    """Rows per layer, as the writer counts them while it writes."""
    silver = checkpointed(intervals(v))
    layers = {
        "bronze": C.to_bronze(changes(v), now()),
        "state_log": H.state_log(judged(v)),
        "silver": silver,
        "gold_bonus": G.annual_bonus(silver, G.scan_incomes(v.fx_employee), RULES, YEAR),
        "gold_wellbeing": G.yearly_activity_eligibility(v.fx_activity, RULES),
    }
    folder = work_dir(v.spark, "layers")
    writer = BatchWriter(folder, 0)
    for name, df in layers.items():
        writer.write(name, df)
    writer.write_counts(v.fx_change)
    stored = read_batches(v.spark, f"{folder}/counts", COUNTS)
    return _finished(v, folder, stored.withColumnRenamed("rows", "n"))


# --- identity, messages -------------------------------------------------------------------


def _staff(v: Views) -> DataFrame:
    return v.fx_employee.filter(F.col("salaire_brut") >= 30000)


@query(
    "identity_enrich",
    """select id_evenement_sport, a.salarie_id, nom, prenom, e.id_salarie is not null as connu
    from fx_activity as a left join sh_staff as e on e.id_salarie = a.salarie_id""",
)
def _(v):
    return N.enrich_identity(v.fx_activity, _staff(v)).select(
        "id_evenement_sport", "salarie_id", "nom", "prenom", "connu"
    )


@query(
    "identity_misses",
    """select id_evenement_sport, salarie_id from fx_activity
    where salarie_id not in (select id_salarie from sh_staff)""",
)
def _(v):
    return N.identity_misses(v.fx_activity, _staff(v)).select("id_evenement_sport", "salarie_id")


def _pick(values: str, seed: str, stride: int) -> str:
    return f"{values}[1 + ({seed} * {stride}) % len({values})]"


MESSAGE_SQL = f"""
    {_pick(sql_list(texts.INTERJECTIONS), "i", 5)} || ' ' || prenom || ' ' || nom || ' ! '
    || replace(replace({_pick("phrases", "i", 7)}, '{{distance_km}}',
        coalesce(cast(cast(distance_km as decimal(18, 1)) as varchar), 'None')),
        '{{duree_formate}}', duree)
    || ' ! ' || {_pick("cheers", "i", 11)} || ' ! '
    || array_to_string(list_slice(list_concat(emojis, emojis), 1 + (i * 13) % len(emojis),
        (i * 13) % len(emojis) + 1 + i % (len(emojis) - 1)), ' ')
    || ' ' || case when length(commentaire) > 0 then ' ("' || commentaire || '")' else '' end
    || '. '"""


@query(
    "activity_messages",
    f"""select id_evenement_sport, salarie_id, {MESSAGE_SQL} as message from (
        select m.*, m.id_evenement_sport as i, prenom, nom, phrases, cheers, emojis,
            case when duree_s <= 0 then '0min'
            when mn // 60 > 0 and mn % 60 > 0 then (mn // 60) || 'h' || (mn % 60) || 'min'
            when mn // 60 > 0 then (mn // 60) || 'h' else (mn % 60) || 'min' end as duree
        from (select *, cast(round_even(duree_s / 6e1, 0) as bigint) as mn from sh_measure) as m
        join sh_staff as e on e.id_salarie = m.salarie_id
        join sh_template as t on t.sport_type = m.sport_type) as x""",
)
def _(v):
    rows = N.activity_measures(_activity_images(v))
    return N.build_messages(rows, _staff(v), texts.templates(v.spark))


@query(
    "message_errors",
    f"""select a.salarie_id as salarie, case when e.id_salarie is null then '''prenom'''
        else '''' || a.sport_type || '''' end as error, timestamp '{NOW}' as timestamp
    from fx_activity as a left join sh_staff as e on e.id_salarie = a.salarie_id
    where e.id_salarie is null or a.sport_type not in (select sport_type from sh_template)""",
)
def _(v):
    rows = N.activity_measures(_activity_images(v))
    return N.message_errors(rows, _staff(v), texts.templates(v.spark), now())


# --- places and roads ---------------------------------------------------------------------


@query(
    "geocode_join",
    f"""select id_salarie, b.lat, b.lon, case when b.address_key is null
        and adresse_domicile is not null then 'Erreur : features empty' end as geo_error
    from fx_employee as e left join sh_best as b
        on b.address_key = {sql_key("adresse_domicile")}""",
)
def _(v):
    return P.geocode_join(v.fx_employee, v.fx_address).select(
        "id_salarie", "lat", "lon", "geo_error"
    )


def sql_terms(c: str) -> str:
    token = r"[0-9]+|[^0-9\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    return (
        f"list_distinct(flatten(list_transform(regexp_extract_all(lower({c}), '{token}'), lambda w: "
        "case when regexp_matches(w, '^[0-9]') then ['#' || w] "
        "else list_transform(range(1, length(w) + 1), lambda i: substr('_' || w || '_', i, 3)) end)))"
    )


@query(
    "geocode_search",
    """select id_salarie, lat, lon, match as geo_match, case when match is null
        and adresse_domicile is not null then 'Erreur : features empty' end as geo_error
    from fx_wanted as e left join lk_best as b on b.key = e.key_""".replace("e.key_", sql_key("e.adresse_domicile")),
    {
        "lk_place": f"""
            select k as key, best.lat as lat, best.lon as lon from (
                select {sql_key("adresse")} as k,
                    arg_max(struct_pack(lat := lat, lon := lon), score) as best
                from fx_street group by 1) as b""",
        "lk_term": f"select key, unnest({sql_terms('key')}) as term from lk_place",
        "lk_count": "select term, count(*) as n from lk_term group by term",
        "lk_asked": f"""
            select key, unnest({sql_terms("key")}) as term from (
                select distinct {sql_key("adresse_domicile")} as key from fx_wanted
                where adresse_domicile is not null) as q""",
        "lk_weight": """
            select term, cast(floor(1000 * ln(1 + (select count(*) from lk_place)::double / coalesce(n, 1))) as bigint) as w
            from (select distinct term from (select term from lk_asked union all select term from lk_term) as u) as t
            left join lk_count using (term)""",
        "lk_asked_sum": """
            select key, sum(w) as total, count(*) filter (starts_with(term, '#')) as numbers
            from lk_asked join lk_weight using (term) group by key""",
        "lk_term_sum": "select key, sum(w) as total from lk_term join lk_weight using (term) group by key",
        "lk_pair": """
            select q.key, a.key as found, sum(w) as shared, count(*) filter (starts_with(q.term, '#')) as same
            from lk_asked as q join lk_term as a using (term) join lk_weight using (term) group by 1, 2""",
        "lk_scored": """
            select p.key, p.found, cast((2000 * shared) // (q.total + a.total) as int) as match
            from lk_pair as p join lk_asked_sum as q on q.key = p.key join lk_term_sum as a on a.key = p.found
            where same = numbers""",
        "lk_best": """
            select key, lat, lon, match from (
                select s.key, s.match, l.lat, l.lon,
                    row_number() over (partition by s.key order by match desc, s.key <> s.found, s.found) as place
                from lk_scored as s join lk_place as l on l.key = s.found where match >= 500) as r
            where place = 1""",
    },
)
def _(v):
    """Free text addresses, misspelt and reordered ones too, to their best scored candidate."""
    return geocode_search(v.fx_wanted, v.fx_street).select(
        "id_salarie", "lat", "lon", "geo_match", "geo_error"
    )


@query(
    "linear_distance",
    f"""select score, round(case when lat is not null then
        {sql_haversine("lat", "lon", *SITE_POINT)} end, 3) as metres
    from fx_address""",
)
def _(v):
    return _linear(v, "haversine")


@query(
    "linear_distance_wgs84",
    f"""select id as score, round(metres, 3) as metres
    from ({sql_wgs84("select score as id, lat, lon from fx_address")}) as w""",
)
def _(v):
    return _linear(v, "wgs84")


def _linear(v: Views, method: str) -> DataFrame:
    metres = linear_distance(F.col("lat"), F.col("lon"), F.lit(SITE.lat), F.lit(SITE.lon), method)
    return v.fx_address.select("score", F.round(metres, 3).alias("metres"))


@query(
    "distance_prefilter",
    f"""select id_salarie, network from (
        select id as id_salarie, metres from ({
        sql_wgs84(
            f'''select id_salarie as id, b.lat, b.lon from fx_employee as e
            join sh_best as b on b.address_key = {sql_key("adresse_domicile")}'''
        )
    }) as w) as d
    join (select id_salarie as k, {sql_mode("moyen_deplacement")} as network from fx_employee) as m
        on m.k = d.id_salarie
    where metres <= {sql_limit("network")}""",
)
def _(v):
    located = P.geocode_join(v.fx_employee, v.fx_address).withColumn(
        "network", S.commute_mode(F.col("moyen_deplacement"))
    )
    measured = W.with_linear_distance(located, SITE)
    return W.within_limit(measured, RULES).select("id_salarie", "network")


def _points(v: Views) -> DataFrame:
    located = P.best_candidates(v.fx_address).filter(F.col("lat").isNotNull())
    return located.select(
        "lat", "lon", F.explode(F.array(F.lit("walk"), F.lit("drive"))).alias("network")
    )


NEAREST_SQL = f"""
    select p.network, p.lat, p.lon, arg_min(n.node_id, struct_pack(d := {
    sql_haversine("p.lat", "p.lon", "n.lat", "n.lon")
}, i := n.node_id)) as node_id
    from (select distinct lat, lon, unnest(['walk', 'drive']) as network from sh_best
        where lat is not null) as p
    join fx_node as n on n.network = p.network group by 1, 2, 3"""


@query("nearest_node", NEAREST_SQL)
def _(v):
    return P.nearest_node(_points(v), v.fx_node).select("network", "lat", "lon", "node_id")


@query("road_distance", "select network, node_id, road_m from sh_road", SHARED_ROAD)
def _(v):
    return W.distances_to(v.fx_edge, W.site_nodes(v.fx_node, SITE))


@query(
    "road_regions",
    """select 'walk' as network, o_orderkey as node_id, road_m from rg_order
    union all
    select 'walk', u, road_m + length from (
        select u, v, min(length) as length from fx_chain where u >= 1000000000000 group by 1, 2) as s
    join rg_order on o_orderkey = v""",
    {
        "rg_order": """
            select o_orderkey, coalesce(sum(length) over (order by o_orderkey), 0)::double as road_m
            from (select u as o_orderkey, length from fx_chain where u < 1000000000000
                union all select 0, 0) as c"""
    },
)
def _(v):
    """Ways of thousands of roads: solved by regions of ten thousand orders, with the lines beside them."""
    side = F.col("node") >= 1_000_000_000_000
    order = F.when(side, F.call_function("div", F.col("node") - 1_000_000_000_000, F.lit(10))).otherwise(F.col("node"))
    target = v.spark.createDataFrame([("walk", 0)], "network string, node_id bigint")
    return region_distances(v.fx_chain, target, F.call_function("div", order, F.lit(10_000)))


@query(
    "commute_distance",
    f"""select id_salarie, case when measured then round_even(road_m, 3) end as distance_m, reason
    from ({
        _outcome_sql(
            f'''(select e.id_salarie, e.adresse_domicile as adresse, e.moyen_deplacement as moyen,
        case when b.address_key is null then 'Erreur : features empty' end as geo_error,
        b.lat, b.lon, w.metres as linear_m, r.road_m,
        'No path between ' || n.node_id || ' and ' || t.node_id || '.' as road_error
    from (select *, {sql_mode("moyen_deplacement")} as network from fx_employee) as e
    left join sh_best as b on b.address_key = {sql_key("e.adresse_domicile")}
    left join ({sql_wgs84("select address_key as id, lat, lon from sh_best")}) as w
        on w.id = b.address_key
    left join ({NEAREST_SQL}) as n on n.network = e.network and n.lat = b.lat and n.lon = b.lon
    left join sh_target as t on t.network = e.network
    left join sh_road as r on r.network = e.network and r.node_id = n.node_id) as x'''
        )
    }) as o""",
    SHARED_ROAD,
)
def _(v):
    people = v.fx_employee.select("id_salarie", "adresse_domicile", "moyen_deplacement")
    found = W.commute_distance(people, v.fx_address, v.fx_node, v.fx_edge, SITE, RULES)
    return found.select("id_salarie", F.bround("distance_m", 3).alias("distance_m"), "reason")


COMMUTE_OK = f"""
    select distinct m.address_key, m.network from (
        select w.id as address_key, w.lat, w.lon, w.metres, unnest(['walk', 'drive']) as network
        from ({sql_wgs84("select address_key as id, lat, lon from sh_best")}) as w) as m
    join ({NEAREST_SQL}) as n on n.network = m.network and n.lat = m.lat and n.lon = m.lon
    join sh_road as r on r.network = n.network and r.node_id = n.node_id
    where metres <= {sql_limit("m.network")} and road_m <= {sql_limit("m.network")}"""


def _commute_flag(side: str) -> str:
    return f"""case when {side}_there then coalesce((select true from sh_commute_ok as k
        where k.address_key = {sql_key(f"{side}_adresse")}
            and k.network = {sql_mode(f"{side}_moyen")}), false) end"""


@query(
    "commute_history",
    f"""select id_salarie, after as est_eligible_prime_annuel, ts as date_debut, date_fin,
        cast(date_sub('day', ts, date_fin) as int) as duree
    from (select *, lead(ts) over (partition by id_salarie order by seq) as date_fin from (
        select id_salarie, ts, seq, route, {_commute_flag("b")} as before,
            {_commute_flag("a")} as after from sh_judged) as j
        where route <> 'updated' or before is distinct from after) as l
    where route <> 'deleted'""",
    {**SHARED_ROAD, "sh_commute_ok": COMMUTE_OK},
)
def _(v):
    """Employee changes to history, with distances from addresses and roads."""
    routed = C.route_state_changes(
        changes(v).withColumns(
            {"topic": F.lit("state"), "partition": F.lit(0), "offset": F.col("seq")}
        )
    )
    wanted = v.fx_address.select(
        P.address_key(F.col("adresse")).alias("address_key"),
        F.explode(F.array(F.lit("walk"), F.lit("drive"))).alias("network"),
    )
    known = W.address_distances(wanted, v.fx_address, v.fx_node, v.fx_edge, SITE, RULES)
    evaluated = W.evaluated_images(routed, W.evaluator(known, RULES), RULES)
    return H.scd2_intervals(H.state_log(evaluated), sizes=v.fx_state)


# --- quality ------------------------------------------------------------------------------


def _one_check(check: Callable[[], Q.Expectation]):
    return lambda v: Q.validate(v.fx_activity, [check()])


def _check_sql(kind: str, columns: str, seen: str, bad: str, source: str = "fx_activity") -> str:
    return f"""select '{kind}' as expectation, '{columns}' as column_name,
        cast({seen} as bigint) as evaluated, cast({bad} as bigint) as unexpected,
        ({bad}) = 0 as success from {source}"""


NOT_NULL = _check_sql(
    "not_null", "commentaire", "count(*)", "count(*) filter (commentaire is null)"
)
OF_TYPE = _check_sql("of_type", "date_fin_activite", "count(*)", "0")
OF_TYPE_NOT = _check_sql("of_type", "distance_m", "count(*)", "count(*)")
IN_SET = _check_sql(
    "in_set", "commentaire", "count(commentaire)",
    "count(*) filter (commentaire not in ('', 'Super'))",
)
BETWEEN = _check_sql(
    "between", "distance_m", "count(distance_m)",
    "count(*) filter (distance_m < 500 or distance_m > 5000)",
)
POSITIVE = _check_sql(
    "null_or_positive", "distance_m", "count(distance_m)", "count(*) filter (distance_m <= 0)"
)
UNIQUE = _check_sql(
    "compound_unique", "salarie_id,distance_m", "coalesce(sum(n), 0)",
    "coalesce(sum(case when n > 1 then n end), 0)",
    "(select salarie_id, distance_m, count(*) as n from fx_activity group by 1, 2) as u",
)


def _suite() -> list[Q.Expectation]:
    return [
        Q.not_null("commentaire"),
        Q.of_type("date_fin_activite", "timestamp"),
        Q.in_set("commentaire", ["", "Super"]),
        Q.between("distance_m", 500, 5000),
        Q.null_or_positive("distance_m"),
        Q.compound_unique(["salarie_id", "distance_m"]),
    ]


query("dq_not_null", NOT_NULL)(_one_check(lambda: Q.not_null("commentaire")))
query("dq_of_type", f"{OF_TYPE} union all {OF_TYPE_NOT}")(
    lambda v: Q.validate(
        v.fx_activity,
        [Q.of_type("date_fin_activite", "timestamp"), Q.of_type("distance_m", "string")],
    )
)
query("dq_in_set", IN_SET)(_one_check(lambda: Q.in_set("commentaire", ["", "Super"])))
query("dq_between", BETWEEN)(_one_check(lambda: Q.between("distance_m", 500, 5000)))
query("dq_null_or_positive", POSITIVE)(_one_check(lambda: Q.null_or_positive("distance_m")))
query("dq_compound_unique", UNIQUE)(
    _one_check(lambda: Q.compound_unique(["salarie_id", "distance_m"]))
)
query("dq_validate", " union all ".join([NOT_NULL, OF_TYPE, IN_SET, BETWEEN, POSITIVE, UNIQUE]))(
    lambda v: Q.validate(v.fx_activity, _suite())
)

GOLD_ROW_JSON = """'{"id_salarie":' || id_salarie || ',"annee":' || annee
    || ',"est_eligible_prime_annuel":' || est_eligible_prime_annuel || '}'"""


@query(
    "dq_failed_rows",
    f"""select 'b1' as batch_id, 'gold_bonus' as dataset, expectation, column_name,
        {GOLD_ROW_JSON} as row_json
    from (select *, 'between' as expectation, 'ratio_jours' as column_name from sh_bonus
            where ratio_jours < 0 or ratio_jours > 100
        union all select *, 'between', 'montant_prime' from sh_bonus where montant_prime < 0
        union all select *, 'compound_unique', 'id_salarie,annee' from sh_bonus
            where (id_salarie, annee) in (select (id_salarie, annee) from sh_bonus
                group by id_salarie, annee having count(*) > 1)) as f""",
)
def _(v):
    # Checked for repeated keys against itself, so it is computed once.
    gold = checkpointed(G.annual_bonus(intervals(v), G.scan_incomes(v.fx_employee), RULES, YEAR))
    rows = Q.failed_rows(gold, Q.shipped_suites()["gold_bonus"], "b1", "gold_bonus")
    parsed = F.from_json(
        "row_json", "id_salarie bigint, annee int, est_eligible_prime_annuel boolean"
    )
    return rows.withColumn("row_json", F.to_json(parsed))


@query(
    "dq_gate",
    """select id_evenement_sport, commentaire is null or distance_m < 500 as refuse
    from fx_activity""",
)
def _(v):
    suite = [Q.not_null("commentaire"), Q.between("distance_m", low=500)]
    passing, failing = Q.quality_gate(v.fx_activity, suite)
    return passing.select("id_evenement_sport", F.lit(False).alias("refuse")).unionByName(
        failing.select("id_evenement_sport", F.lit(True).alias("refuse"))
    )


# --- streams ------------------------------------------------------------------------------

#: Files of a lot, which tasks write and read side by side.
LOT_FILES = 4
#: Bytes of a row group of theirs. One task reads a group, and holds it as it is stored.
GROUP_BYTES = 16 << 20


def land(df: DataFrame, folder: str, lot: Column, lots: int, *, apart: bool = False) -> FileTopic:
    """Write messages as a landed topic, ``LOT_FILES`` files per lot, for a stream to read lot by lot.

    They are computed once and kept until then; with ``apart`` each lot is computed by itself, for lots that share nothing.
    """
    rows = df.withColumn("__lot", lot)
    if not apart:
        rows = checkpointed(rows)
    for i in range(lots):
        dealt = rows.filter(F.col("__lot") == i).drop("__lot").repartition(LOT_FILES)
        dealt.write.option("parquet.block.size", GROUP_BYTES).mode("append").parquet(folder)
    return FileTopic(folder, rows.drop("__lot").schema)


LOTS = 4


def _by_quarters(v: Views) -> Column:
    """Lots by time: changes of a key spread over them, and copies of a message share one."""
    # Each state is a message of the topic at its time, and the rest are copies.
    spans = v.fx_state.agg(F.min("ts").cast("double").alias("a"), F.max("ts").cast("double").alias("b"))
    low, high = spans.first()
    share = (F.col("ts").cast("double") - F.lit(low)) / F.lit(high - low or 1.0)
    return F.least(F.floor(share * LOTS), F.lit(LOTS - 1)).cast("int")


def _no_reason(people: DataFrame) -> DataFrame:
    return people.withColumn("reason", F.lit(None).cast("string"))


def _run_state(v: Views, folder: str, **options) -> str:
    topic = land(as_topic(v.fx_topic), f"{folder}/topic", _by_quarters(v), LOTS)
    state.run_state_stream(
        read_change_stream(v.spark, topic, files_per_trigger=LOT_FILES),
        IMAGE, _no_reason, RULES, f"{folder}/lake", f"{folder}/offsets",
        at=F.col("ts"), trigger={"availableNow": True}, **options,
    ).awaitTermination()
    return f"{folder}/lake"


def _finished(v: Views, folder: str, df: DataFrame) -> DataFrame:
    """The result, kept apart from the job's folder, which goes."""
    found = checkpointed(df)
    remove(v.spark, folder)
    return found


@query("stream_scd2", "select * from sh_intervals")
def _(v):
    folder = work_dir(v.spark, "state-stream")
    lake = _run_state(v, folder)
    return _finished(v, folder, state.stored_intervals(v.spark, lake))


@query(
    "stream_bonus_table",
    "select id_salarie, annee, est_eligible_prime_annuel, duree, montant_prime from sh_bonus",
)
def _(v):
    """The bonus table as the job refreshes it after each batch, from the last version."""
    folder = work_dir(v.spark, "bonus-stream")
    lake = _run_state(v, folder, incomes=G.scan_incomes(v.fx_employee), as_of_year=YEAR)
    newest = versions(v.spark, f"{lake}/gold_bonus")[-1]
    gold = v.spark.read.parquet(f"{lake}/gold_bonus/version={newest}")
    return _finished(v, folder, gold.drop("ratio_jours"))


@query(
    "stream_wellbeing",
    "select salarie_id, annee, nb_activites, est_eligible, nb_jour_bien_etre from sh_wellbeing",
)
def _(v):
    """Activities over four batches: copies in a later one, snapshot rows, moves between years
    and deletions leave the count of what is stored."""
    spark, folder = v.spark, work_dir(v.spark, "fact-stream")
    # Each part of the union is of one lot, so the other lots' parts are left out of a lot's plan.
    topic = land(as_topic(v.fx_fact_lot), f"{folder}/topic", F.col("lot"), LOTS, apart=True)
    facts.run_fact_stream(
        read_change_stream(spark, topic, files_per_trigger=LOT_FILES),
        _staff(v), texts.templates(spark), RULES, f"{folder}/lake", f"{folder}/offsets",
        trigger={"availableNow": True},
    ).awaitTermination()
    return _finished(v, folder, facts.stored_wellbeing(spark, f"{folder}/lake"))


@query("stream_keyed_scd2", "select * from sh_intervals")
def _(v):
    """The log in four lots through keyed state: intervals as of their last revisions."""
    spark, folder = v.spark, work_dir(v.spark, "keyed-stream")
    # The number of a change orders it and names its place.
    log = H.state_log(judged(v)).withColumns(
        {"at_us": F.col("seq"), "topic": F.lit("t"), "partition": F.lit(0), "offset": F.col("seq")}
    )
    log = checkpointed(log.select(state.STATE_LOG.fieldNames()))
    last = log.agg(F.max("offset")).first()[0] or 0
    topic = land(log, f"{folder}/log", F.least(F.floor(F.col("offset") * LOTS / F.lit(last + 1)), F.lit(LOTS - 1)).cast("int"), LOTS)
    stream = spark.readStream.schema(topic.schema).option("maxFilesPerTrigger", LOT_FILES).parquet(topic.path)
    query = interval_revisions(stream).writeStream.option("checkpointLocation", f"{folder}/offsets")
    query.trigger(availableNow=True).format("parquet").outputMode("append").start(f"{folder}/out").awaitTermination()
    return _finished(v, folder, intervals_of(spark.read.parquet(f"{folder}/out")))


@query(
    "keys_across_batches",
    """select a.id_evenement_sport, cast(min(b.id_evenement_sport % 4) as bigint) as first_epoch
    from fx_activity as a join fx_activity as b on a.salarie_id = b.salarie_id
        and a.distance_m is not distinct from b.distance_m
        and b.id_evenement_sport % 4 < a.id_evenement_sport % 4
    group by 1""",
)
def _(v):
    """Activities in four batches: those whose employee and distance an earlier batch has brought."""
    folder = work_dir(v.spark, "keys")
    keys = T.StructType([T.StructField("salarie_id", T.LongType()), T.StructField("distance_m", T.LongType())])
    seen = SeenKeys(f"{folder}/seen", keys, bucket_of("salarie_id", 1000))
    for epoch in range(LOTS):
        batch = v.fx_activity.where(F.pmod("id_evenement_sport", F.lit(LOTS)) == epoch)
        repeated = seen.repeated(batch, epoch).select("id_evenement_sport", "first_epoch")
        append_batch(repeated, f"{folder}/found", epoch)
        seen.remember(batch, epoch)
    return _finished(v, folder, read_batches(v.spark, f"{folder}/found", repeated.schema))


@query("merged_quantiles", "select sport_type, count(distance_m) as n, true as near from fx_activity group by 1")
def _(v):
    """Median and 95th percentile from hourly sketches, held against the ranks of all values."""
    hours = hourly_sketches(v.fx_activity, ["sport_type"], F.col("date_fin_activite"), "distance_m")
    merged = merged_quantiles(hours, ["sport_type"], [0.5, 0.95])
    ranked = v.fx_activity.where("distance_m is not null").join(merged.withColumnRenamed("n", "all"), "sport_type")
    met = []
    for i, share in enumerate((0.5, 0.95)):
        value = F.col("quantiles")[i]
        low, high = (F.count_if(c) / F.max("all") for c in (F.col("distance_m") < value, F.col("distance_m") <= value))
        met.append((low <= share + 0.03) & (high >= share - 0.03))
    return ranked.groupBy("sport_type").agg(F.count("*").alias("n"), (met[0] & met[1]).alias("near"))


# --- sinks --------------------------------------------------------------------------------


@query("sink_append", "select id_evenement_sport, salarie_id, distance_m from fx_activity")
def _(v):
    """Appended epochs, one of them written twice; the fact table without its index column."""
    folder = work_dir(v.spark, "append")
    rows = v.fx_activity.select("id_evenement_sport", "salarie_id", "distance_m")
    for epoch in (0, 1, 1):
        part = rows.filter(F.pmod("salarie_id", F.lit(2)) == epoch)
        append_facts(part.withColumn("__index_level_0__", F.lit(0)), f"{folder}/facts", epoch)
    return _finished(v, folder, read_batches(v.spark, f"{folder}/facts", rows.schema))


@query("sink_overwrite", "select salarie_id, annee, nb_activites from sh_wellbeing")
def _(v):
    """A table replaced twice, the second time from its own first version."""
    folder = work_dir(v.spark, "overwrite")
    counts = G.activity_counts(v.fx_activity)
    overwrite_table(counts, f"{folder}/gold")
    overwrite_table(read_table(v.spark, f"{folder}/gold", counts.schema), f"{folder}/gold")
    return _finished(v, folder, read_table(v.spark, f"{folder}/gold", counts.schema))


@query(
    "sink_export",
    "select id_salarie, annee, montant_prime, (select count(*) from sh_bonus) as n from sh_bonus",
)
def _(v):
    folder = work_dir(v.spark, "export")
    gold = G.annual_bonus(intervals(v), G.scan_incomes(v.fx_employee), RULES, YEAR)
    n = export_copy(gold.select("id_salarie", "annee", "montant_prime"), f"{folder}/copy")
    copy = v.spark.read.parquet(f"{folder}/copy").withColumn("n", F.lit(n).cast("bigint"))
    return _finished(v, folder, copy)


@query(
    "scan_tables",
    """select 'activites' as dataset, count(*) as n from fx_activity
    union all select 'silver', count(*) from sh_intervals""",
)
def _(v):
    """Stored facts and intervals through their readers."""
    folder = work_dir(v.spark, "scan")
    v.fx_activity.select(*ACTIVITY.fieldNames()).write.parquet(f"{folder}/facts")
    intervals(v).write.parquet(f"{folder}/silver")
    read = {
        "activites": scan_activities(v.spark, f"{folder}/facts"),
        "silver": scan_silver(v.spark, f"{folder}/silver"),
    }
    counted = [
        df.agg(F.lit(name).alias("dataset"), F.count(F.lit(1)).alias("n"))
        for name, df in read.items()
    ]
    return _finished(v, folder, counted[0].unionByName(counted[1]))


@query(
    "road_graph",
    """select 'edges' as part, network, count(*) as n, max(length) as longest from fx_edge group by 2
    union all select 'nodes', network, count(*), max(lat) from fx_node group by 2""",
)
def _(v):
    """Road tables through their reader."""
    folder = work_dir(v.spark, "graph")
    v.fx_node.write.parquet(f"{folder}/nodes")
    v.fx_edge.withColumn("length", F.col("length").cast("double")).write.parquet(f"{folder}/edges")
    nodes, edges = read_road_graph(v.spark, f"{folder}/nodes", f"{folder}/edges")

    def summed(df: DataFrame, part: str, value: str) -> DataFrame:
        grouped = df.groupBy("network").agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("longest"))
        return grouped.select(F.lit(part).alias("part"), "network", "n", "longest")

    return _finished(v, folder, summed(edges, "edges", "length").unionByName(summed(nodes, "nodes", "lat")))


@query(
    "sink_notifications",
    f"""select id_evenement_sport, m.salarie_id, timestamp '{NOW}' as created_at from sh_measure as m
    join sh_staff as e on e.id_salarie = m.salarie_id
    join sh_template as t on t.sport_type = m.sport_type""",
)
def _(v):
    folder = work_dir(v.spark, "notifications")
    rows = N.activity_measures(_activity_images(v))
    built = N.build_messages(rows, _staff(v), texts.templates(v.spark))
    append_batch(notification_table(built, now()), f"{folder}/sent", 0)
    sent = read_batches(v.spark, f"{folder}/sent", NOTIFICATIONS)
    return _finished(v, folder, sent.drop("message"))


@query(
    "quality_table",
    """select 'gold_bonus' as dataset, expectation, count(*) as n from (
        select 'between' as expectation from sh_bonus where ratio_jours < 0 or ratio_jours > 100
        union all select 'between' from sh_bonus where montant_prime < 0
        union all select 'compound_unique' from sh_bonus where (id_salarie, annee) in (
            select (id_salarie, annee) from sh_bonus group by id_salarie, annee having count(*) > 1)
        ) as f group by 1, 2""",
)
def _(v):
    """Failures of the product's suite as the job stores them, from its last batch."""
    folder = work_dir(v.spark, "quality")
    lake = _run_state(v, folder, incomes=G.scan_incomes(v.fx_employee), as_of_year=YEAR)
    stored = v.spark.read.parquet(f"{lake}/gold_quality")
    last = stored.agg(F.max("epoch_id")).first()[0]
    rows = stored.filter((F.col("epoch_id") == last) & (F.col("dataset") == "gold_bonus"))
    counted = rows.groupBy("dataset", "expectation").agg(F.count(F.lit(1)).alias("n"))
    return _finished(v, folder, counted)
