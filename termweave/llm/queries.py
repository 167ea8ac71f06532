"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .best_fit_packing import best_fit_packing
from .common import held_out
from .decontaminate import decontaminate
from .html_text import extract_text
from .language_id import identify_language
from .lm_scoring import lm_score
from .merkle_manifest import LOWER, UPPER, digest, folded, lowered, merkle_manifest, merkle_proofs, siblings
from .quality import quality_score
from .simhash_dedup import simhash_components
from .substring_dedup import substring_dedup
from .topk_search import top_k_search
from .url_filter import url_filter
from .vector_codes import label_errors, vector_codes
from .warc import read_warc, write_warc

#: Fixed values of the url query: (verdict, host, path prefix).
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = identify_language(table(spark, sf_dir, "documents"))
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")


def op4_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_score(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select(
        "doc_id", held_out("doc_id", 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    # a page's url ends in the number of the document that it shows: that document's label is the page's
    number = F.regexp_extract("url", r"/([0-9]{1,18})(\.[a-z]+)?/?([?#].*)?$", 1)
    shown = pages.select("url", F.when(number != "", number.cast("long")).alias("shown")).where("shown is not null")
    labelled = shown.join(labels.select(F.col("doc_id").alias("shown"), (F.col("quality") == 0).alias("bad")), "shown")
    return url_filter(pages, labelled.select("url", "bad"), URL_RULES)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = read_warc(write_warc(table(spark, sf_dir, "pages")), with_payload=False)
    checked = F.when(F.coalesce("digest_ok", F.lit(True)), F.col("payload_digest")).otherwise(
        F.raise_error(F.lit("a payload does not have its stated digest"))
    )
    return out.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset"
    )


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k_search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    manifest = merkle_manifest(table(spark, sf_dir, "documents"), tamper=(tampered, lowered(F.col("text"))))
    found = merkle_proofs(manifest).withColumn("root", F.lit(manifest.root).cast("string"))
    again = found.withColumn("folded_root", folded(F.coalesce("second", "digest"), F.col("path")))
    return again.select(
        F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root",
        digest(siblings(F.col("path"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes(table(spark, sf_dir, "embeddings"))
    books_hash = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return label_errors(codes).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books_hash).alias("codebooks_sha256")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_knn, op2_substring_dedup, op3_language_crf, op4_lattice_lm, op5_decontaminate, op6_url_filter,
        op7_warc, op8_pack, op9_topk, op10_simhash, op11_html_text, op12_merkle, op13_vector_codes,
    )
}

def _tree_sql(name: str, base: str, levels: int = 8) -> str:
    """CTEs of the trees over base (g, r, n, d): {name}k has the nodes of level k, {name}sk the siblings of
    those of level k - 1; base is level 0."""
    out, below = [], base
    for k in range(1, levels + 1):
        out.append(f"""
{name}s{k} as (
  select g, r, coalesce(string_agg(d, '') over (w rows between unbounded preceding and 1 preceding), '') as b,
         coalesce(string_agg(d, '') over (w rows between 1 following and unbounded following), '') as a
  from {below} where n > 1 window w as (partition by g, r // 16 order by r)),
{name}{k} as (
  select g, r // 16 as r, (any_value(n) + 15) // 16 as n, sha256(string_agg(d, '' order by r)) as d
  from {below} where n > 1 group by g, r // 16)""")
        below = f"{name}{k}"
    return ",".join(out)


def _path_sql(name: str, levels: int = 8) -> tuple[str, str]:
    """(joins, list of struct(b, a)) of the siblings of a node (g, r) named x, level by level."""
    joins = "".join(f" left join {name}s{k} s{k} on s{k}.g = x.g and s{k}.r = x.r // {16 ** (k - 1)}" for k in range(1, levels + 1))
    listed = ", ".join(f"case when s{k}.b is not null then struct_pack(b := s{k}.b, a := s{k}.a) end" for k in range(1, levels + 1))
    return joins, f"list_filter([{listed}], lambda s: s is not null)"


def _framed_sql(column: str) -> str:
    return f"coalesce(cast(strlen(cast({column} as varchar)) as varchar) || ':' || cast({column} as varchar), '-')"


def _fold_sql(levels: int) -> str:
    """CTEs f0 ... of the digests that leaves and paths p (struct list) give, step by step."""
    return ",".join(
        f"""
f{k} as (
  select * exclude (d), case when len(p) >= {k} then sha256(p[{k}].b || d || p[{k}].a) else d end as d from f{k - 1})"""
        for k in range(1, levels + 1)
    )


def _merkle_sql() -> str:
    head = " || ".join(_framed_sql(c) for c in ("doc_id", "source", "lang", "n_chars"))
    joins, path = _path_sql("t")
    up_joins, up_path = _path_sql("u")
    return f"""
with leaves as (
  select doc_id, source, {_framed_sql("source")} as g, sha256({head} || {_framed_sql("text")}) as d,
         sha256({head} || {_framed_sql(f"translate(text, '{UPPER}', '{LOWER}')")}) as other,
         xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(
           string_split(cast(doc_id as varchar), ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda c, x: case when x >= 0 then xor(c, x) when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) % 5 as crc5
  from documents),
t0 as (
  select *, row_number() over (partition by g order by doc_id nulls first, d) - 1 as r, count(*) over (partition by g) as n from leaves),
{_tree_sql("t", "t0")},
tops as (
  select g, d from ({" union all ".join(f"select g, d, n from t{k}" for k in range(9))}) where n = 1),
u0 as (
  select '' as g, row_number() over (order by source nulls first) - 1 as r, count(*) over () as n, d, tops.g as part
  from tops join (select distinct g, source from leaves) using (g)),
{_tree_sql("u", "u0")},
top as (select d from ({" union all ".join(f"select d, n from u{k}" for k in range(9))}) where n = 1),
above as (select x.part, x.d as subroot, {up_path} as p from u0 x{up_joins}),
below as (select x.doc_id, x.g, x.d as leaf, x.other, x.crc5, {path} as p from t0 x{joins}),
f0 as (
  select doc_id, leaf, subroot, list_concat(below.p, above.p) as p,
         case when crc5 = 0 then other else leaf end as d
  from below join above on above.part = below.g),
{_fold_sql(16)}
select doc_id, leaf, subroot, top.d as root, sha256(array_to_string(list_transform(p, lambda s: s.b || s.a), '')) as proof_sha256,
       f16.d as folded_root, f16.d = top.d as verified
from f16, top"""


def _codes_sql(rounds: int = 2) -> str:
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
n{k} as (
  select vec_id, v.part, v.x, min_by(e.entry, [e.dist, e.entry]) as entry, min(e.dist) as dist
  from (
    select v.row, v.part, b.entry,
           cast(list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint) as dist
    from v join b{k} b using (part)) e
  join v on v.row = e.row and v.part = e.part group by v.row, vec_id, v.part, v.x)""")
        if k < rounds:
            steps.append(f"""
m{k} as (
  select part, entry, list(cast((s - ((s % c) + c) % c) // c as bigint) order by i) as x
  from (
    select part, entry, i, cast(sum(x[i]) as bigint) as s, count(*) as c
    from (select part, entry, x, unnest(range(1, len(x) + 1)) as i from n{k}) group by part, entry, i)
  group by part, entry),
b{k + 1} as (select part, entry, coalesce(m{k}.x, b.x) as x from b{k} b left join m{k} using (part, entry))""")
    return f"""
with kept as (
  select vec_id, label, row_number() over (order by vec_id nulls last) as row,
         list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as x
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
v as (
  select row, vec_id, part, x[part * (len(x) // 16) + 1 : (part + 1) * (len(x) // 16)] as x
  from (select row, vec_id, x, unnest(range(0, 16)) as part from kept)),
b0 as (select part, row - 1 as entry, x from v where row <= 64),{",".join(steps)},
coded as (
  select vec_id, string_agg(lpad(printf('%x', cast(entry as bigint)), 2, '0'), '' order by part) as code, cast(sum(dist) as bigint) as error
  from n{rounds} group by vec_id),
books as (
  select sha256(string_agg(array_to_string(list_transform(x, lambda c: cast(c as varchar)), ','), ',' order by part, entry)) as h
  from b{rounds})
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, h as codebooks_sha256
from coded join (select vec_id, label from kept) using (vec_id), books"""


ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": r"""
with split as (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
  from documents),
starts as (
  select doc_id, i, array_to_string(ws[i:i + 49], ' ') as k
  from (select doc_id, ws, unnest(range(1, len(ws) - 48)) as i from split)),
lows as (select k, min(doc_id) as low from starts group by k),
hits as (select doc_id, i from starts join lows using (k) where low < doc_id),
covered as (select distinct doc_id, unnest(range(i, i + 50)) as p from hits),
words as (select doc_id, unnest(range(1, len(ws) + 1)) as p, unnest(ws) as w from split),
kept as (
  select doc_id, string_agg(w, ' ' order by p) as t, count(*) as n
  from words anti join covered using (doc_id, p) group by doc_id)
select s.doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(n, 0) as bigint) as n_removed,
       sha256(coalesce(t, '')) as kept_sha256
from split s left join kept k on s.doc_id = k.doc_id""",
    "op5_decontaminate": r"""
with d as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (
  select item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
tests as (
  select distinct item_id, m, array_to_string(ws[i:i + m - 1], ' ') as k
  from (select item_id, ws, least(10, len(ws)) as m, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) as i
        from b where len(ws) > 0)),
sizes as (select distinct m from tests),
places as (
  select doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') as k
  from (select doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) as i from d, sizes where len(ws) >= m)),
found as (select doc_id, item_id, places.m, i from places join tests using (k)),
hit as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + m)) as p from found) group by doc_id),
named as (
  select doc_id, count(*) as n, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, cast(item_id as varchar) as item from found where item_id is not null) group by doc_id)
select d.doc_id, cast(len(ws) as bigint) as n_words, coalesce(hit.n, 0) as n_hit, coalesce(named.n, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(hit.n, 0) > 0 as contaminated
from d left join hit on d.doc_id = hit.doc_id left join named on d.doc_id = named.doc_id""",
    "op9_topk": """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as x from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.x, c.x) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
ranked as (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from pairs)
select query_id, rank, vec_id, score from ranked where rank <= 5""",
    "op12_merkle": _merkle_sql(),
    "op13_vector_codes": _codes_sql(),
}
