"""Registered queries of this package and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .exact_dedup import exact_duplicates
from .importance import resample
from .language import identify, learn_profiles
from .licences import PHRASES, SHIPPED, scan_licences
from .merkle import digest, folded, manifest
from .mixing import mix_to_targets
from .ngram_join import jaccard_groups
from .packing import pack_documents
from .personal_data import KINDS, find_personal_data, learn_spans
from .substring_dedup import drop_repeated_passages
from .suffix_dedup import drop_earlier_copies
from .token_counts import count_tokens
from .vector_dedup import vector_groups


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_to_targets(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_groups(table(spark, sf_dir, "embeddings"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_personal_data(docs, learn_spans(docs), redact=False)

    def joined(spans: Column) -> Column:
        name = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
        return F.array_join(F.transform(spans, name), ",")

    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS
    ]
    return found.select(
        "doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_earlier_copies(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), digests="all")


OP6_SQL = """
with t as (select doc_id, coalesce(text, '') as text from documents)
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
       doc_id = max(doc_id) over same as kept, sha256(text) as text_sha256
from t window same as (partition by text)
"""


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    profiles = learn_profiles(docs.where(fold != 0))
    found = identify(docs, profiles)
    return docs.select("doc_id", (fold == 0).alias("held_out"), found.alias("found")).select(
        "doc_id", "held_out", "found.lang_pred", "found.score"
    )


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def _crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of a DuckDB text: bit by bit, as DuckDB has none."""
    octets = (
        f"list_transform(range(length(hex(encode({text}))) // 2), lambda i: "
        f"cast('0x' || substr(hex(encode({text})), 2 * i + 1, 2) as bigint))"
    )
    bit = "lambda c, j: xor(c >> 1, 3988292384 * (c & 1))"
    byte = f"lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), {bit})"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {octets}), {byte}), 4294967295)"


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    # A decimal, as one more than the largest long is no long.
    more = F.when(tampered, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars").cast("decimal(20,0)"))
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    claimed = digest(*fields[:3], more, fields[4])
    proofs = manifest(docs, digest(*fields), "lang", "doc_id", claimed=claimed)
    siblings = F.array_join("proof", "")
    found = proofs.select(
        "doc_id", F.col("hash").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
        folded(F.col("claimed")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def _framed(value: str) -> str:
    return f"coalesce(strlen(cast({value} as varchar)) || ':' || cast({value} as varchar), '-')"


# Levels hold all nodes of all trees; the trees' roots are the leaves of the tree named by a null ``top``.
OP11_SQL = f"""
with recursive docs as (
  select *, {_crc32_sql("cast(doc_id as varchar)")} % 7 = 0 as tampered from documents
), leaves as (
  select doc_id, lang,
         sha256({" || ".join(_framed(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) as leaf,
         sha256({" || ".join(_framed(c) for c in ("doc_id", "source", "lang", "(n_chars + tampered::int)", "text"))}) as claimed
  from docs
), placed as (
  select doc_id, leaf, coalesce(claimed, leaf) as claimed, dense_rank() over (order by lang nulls first) - 1 as tree,
         row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos
  from leaves
), below as (
  select tree, 0 as level, pos, leaf as hash, count(*) over (partition by tree) as n from placed
  union all
  select tree, level + 1, pos // 2, sha256(string_agg(hash, '' order by pos)), any_value((n + 1) // 2)
  from below where n > 1 group by tree, level, pos // 2
), subroots as (select tree, level as depth, hash from below where n = 1),
above as (
  select 0 as level, tree as pos, hash, count(*) over () as n from subroots
  union all
  select level + 1, pos // 2, sha256(string_agg(hash, '' order by pos)), any_value((n + 1) // 2)
  from above where n > 1 group by level, pos // 2
), nodes as (
  select tree, level, pos, hash, n from below
  union all
  -- Levels of the tree of trees follow those of each tree.
  select s.tree, s.depth + a.level, a.pos, a.hash, a.n from above a, subroots s where a.level > 0 or a.n > 1
), folds as (
  select doc_id, tree, pos as leaf_pos, leaf, 0 as level, pos, claimed as hash, '' as proof from placed
  union all
  select f.doc_id, f.tree, f.leaf_pos, f.leaf, f.level + 1, case when f.level + 1 = s.depth then f.tree else f.pos // 2 end,
         sha256(case when f.pos % 2 = 1 then coalesce(b.hash, '') || f.hash else f.hash || coalesce(b.hash, '') end),
         f.proof || coalesce(b.hash, '')
  from folds f join subroots s on s.tree = f.tree
  left join nodes b on b.tree = f.tree and b.level = f.level and b.pos = xor(f.pos, 1) and b.n > 1
  where f.level < s.depth + (select max(level) from above)
)
select f.doc_id, f.leaf, s.hash as subroot, r.hash as root, sha256(f.proof) as proof_sha256,
       f.hash as folded_root, f.hash = r.hash as verified
from folds f join subroots s on s.tree = f.tree, (select hash, level from above where n = 1) r
where f.level = s.depth + r.level
"""


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


_PLAIN_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
OP12_SQL = f"""
with texts as (
  select doc_id, {_PLAIN_WORDS} as words from documents
), wanted as (
  select unnest({_PLAIN_WORDS}) as word from benchmark
), held as (
  select doc_id, unnest(words) as word from texts
), hashed as (
  select word, {_crc32_sql("word")} % 10000 as bucket from (select word from held union select word from wanted)
), source as (
  select bucket, count(*) as n from held join hashed using (word) group by bucket
), target as (
  select bucket, count(*) as n from wanted join hashed using (word) group by bucket
), totals as (
  select (select count(*) from held)::double as s, (select count(*) from wanted)::double as t
), gains as (
  select bucket, floor(1000 * ln((coalesce(t.n, 0) + 1::double) * (totals.s + 10000)
                                 / ((coalesce(s.n, 0) + 1::double) * (totals.t + 10000))))::bigint as gain
  from (select distinct bucket from hashed) left join source s using (bucket) left join target t using (bucket), totals
), weights as (
  select doc_id, sum(gain)::bigint as weight from held join hashed using (word) join gains using (bucket) group by doc_id
), scored as (
  select doc_id, len(words)::bigint as n_features, coalesce(weight, 0) as weight,
         cast('0x' || substr(sha256('2024:' || doc_id), 1, 8) as bigint) as h
  from texts left join weights using (doc_id)
), drawn as (
  select doc_id, n_features, weight,
         weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score
  from scored
), ranked as (
  select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as n
  from drawn where n_features >= 20
)
select doc_id, n_features, weight, score, case when place <= (10 * n) // 100 then place end as rank
from drawn left join ranked using (doc_id)
"""


def op13_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licences(table(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda p: p["start"].cast("long"))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(v) for v in row) + ")" for row in rows)


OP13_SQL = f"""
with texts as (
  select doc_id, {_PLAIN_WORDS} as words from documents
), held as (
  select doc_id, unnest(words) as word, generate_subscripts(words, 1) - 1 as spot from texts
), phrases(phrase, label, size, p, word) as (
  values {_values((i, label, len(t.split()), p, w) for i, (t, label) in enumerate(PHRASES.items()) for p, w in enumerate(t.split()))}
), templates(t, label, size, p, word, must) as (
  values {_values((i, t.label, len(t.words), p, w, p in t.must) for i, t in enumerate(SHIPPED) for p, w in enumerate(t.words))}
), base as (
  select doc_id, label, spot - p as start from held join phrases using (word)
  group by doc_id, phrase, label, size, spot - p having count(*) = size
), held_by as (
  select word, count(distinct doc_id) as n from held group by word
), ranked as (
  select doc_id, t, word, row_number() over (partition by doc_id, t order by n, word) as place
  from (select distinct doc_id, t, word from held join templates using (word)) join held_by using (word)
), starts as (
  select distinct r.doc_id, r.t, r.word, h.spot - m.p as start
  from ranked r join held h on h.doc_id = r.doc_id and h.word = r.word join templates m on m.t = r.t and m.word = r.word
  where r.place <= 3
), agreed as (
  select doc_id, t, start from starts group by doc_id, t, start having count(*) >= 2
), aligned as (
  select a.doc_id, m.label, count(h.word) / m.size as share
  from agreed a join templates m on m.t = a.t
  left join held h on h.doc_id = a.doc_id and h.spot = a.start + m.p and h.word = m.word
  group by a.doc_id, a.t, a.start, m.label, m.size having bool_and(h.word is not null or not m.must)
), added as (
  select * from aligned where share >= 0.8
), by_base as (
  select doc_id, count(*) as n_base, min(start) as first_word, max(start) as last_word,
         string_agg(distinct label, ',' order by label) as base_labels
  from base group by doc_id
), by_all as (
  select doc_id, string_agg(distinct label, ',' order by label) as labels
  from (select doc_id, label from base union all select doc_id, label from added) group by doc_id
), by_share as (select doc_id, max(share) as share from added group by doc_id)
select doc_id, len(words)::bigint as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
       coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
       case when n_base > 0 then 1.0::double else coalesce(share, 0) end as score
from texts left join by_base using (doc_id) left join by_all using (doc_id) left join by_share using (doc_id)
"""


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_mixing": op2_mixing,
    "op3_vector_dedup": op3_vector_dedup,
    "op4_personal_data": op4_personal_data,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_language": op7_language,
    "op8_ngram_join": op8_ngram_join,
    "op9_token_counts": op9_token_counts,
    "op10_packing": op10_packing,
    "op11_merkle": op11_merkle,
    "op12_importance": op12_importance,
    "op13_licences": op13_licences,
}
ORACLES = {"op6_exact_dedup": OP6_SQL, "op11_merkle": OP11_SQL, "op12_importance": OP12_SQL, "op13_licences": OP13_SQL}
