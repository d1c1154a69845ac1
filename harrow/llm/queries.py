"""Registered queries of the corpus operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Query, read

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return keep


@query("op8_source_mix")
def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(read(spark, sf_dir, "documents")).select(
        "row.doc_id", "size", "source_size", "target", "taken", "passes", "shards")


#: (verdict, host, path)
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


@query("op10_url_filter", r"""
with cut as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end rest from pages),
parts as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from cut),
judged as (select *, case
 when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
 when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
 when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/'
 when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/' end "rule" from parts)
select page_id, host, path, "rule", case when "rule" in ('net/', 'example.com/de/') then 'block' else 'allow' end verdict from judged""")
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import filter_urls

    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    judged = filter_urls(read(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict")


@query("op2_simhash_trie")
def op2_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_groups

    return simhash_groups(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query("op1_sentence_spans")
def op1_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentences import drop_repeated_spans

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_spans(docs).select("row.doc_id", "n_sentences", "n_removed", "removed", F.col("kept").alias("text"))


@query("op9_fm_decontamination", r"""
with w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
item as (select item_id, least(len(w), 10) n, list_slice(w, i, i + least(len(w), 10) - 1) g from
 (select *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i from b where len(w) > 0)),
size as (select distinct n from item),
occ as (select doc_id, i, n, list_slice(w, i, i + n - 1) g from
 (select *, unnest(range(1, len(w) - n + 2)) i from w, size where len(w) >= n)),
hit as (select distinct doc_id, i, n, item_id from occ join item using (n, g)),
pos as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from hit) group by 1),
ids as (select doc_id, count(*) n_items, sha256(string_agg(x, ',' order by x)) h from (select distinct doc_id, cast(item_id as varchar) x from hit) group by 1)
select doc_id, cast(coalesce(len(w.w), 0) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
 coalesce(h, sha256('')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from w left join pos using (doc_id) left join ids using (doc_id)""")
def op9_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import digest, find

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(find(docs, read(spark, sf_dir, "benchmark")), "row.doc_id")


@query("op3_rans_tokens")
def op3_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from harrow.sources.sinks import scratch

    from .tokens import read_tokens, write_tokens

    path = scratch(spark, "token_files")
    write_tokens(read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path, ids=False)


@query("op4_exact_topk", """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) e from embeddings
 where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) as bigint) score
 from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id)
select query_id, cast(r as int) as "rank", vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) r from s) where r <= 20""")
def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    vectors = read(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 20 = 0"))


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import in_fraction
    from .langid import identify

    docs = read(spark, sf_dir, "documents")
    held_out = in_fraction("doc_id", 5, 0)
    found = identify(docs.select("doc_id", "text", held_out.alias("held_out")), docs.filter(~held_out))
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score", "rejected")


@query("op7_toxicity_fm")
def op7_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import in_fraction
    from .toxicity import toxicity

    docs = read(spark, sf_dir, "documents")
    held_out = in_fraction("doc_id", 4, 2)
    found = toxicity(docs.select("doc_id", "text", held_out.alias("held_out")), docs.filter(~held_out), read(spark, sf_dir, "labels"))
    return found.select("row.doc_id", "row.held_out", "score", "predicted")


@query("op5_suffix_dedup")
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import drop_repeated_bytes

    found = drop_repeated_bytes(read(spark, sf_dir, "documents").select("doc_id", "text"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "row.doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def piece(c: str) -> str:
    """A value in a Merkle leaf, in SQL."""
    return f"coalesce(strlen(cast({c} as varchar)) || ':' || {c}, '-')"


# a byte of the id enters the checksum at its first bit
CRC_IN = "xor(c, case when i % 8 = 0 then ascii(cast(doc_id as varchar)[cast(i // 8 + 1 as int)]) else 0 end)"


@query("op11_merkle_manifest", f"""
with recursive leaf as (select doc_id, source, {" || ".join(map(piece, ["doc_id", "source", "lang", "n_chars"]))} head, text,
  xor(4294967295, list_reduce(list_prepend(4294967295, range(0, 8 * length(cast(doc_id as varchar)))),
   lambda c, i: xor({CRC_IN} // 2, case when {CRC_IN} % 2 = 1 then 3988292384 else 0 end))) crc from documents),
hashed as (select doc_id, source, sha256(head || {piece("text")}) leaf,
  case when crc % 2 = 0 then sha256(head || {piece("replace(text, chr(10), '')")}) else sha256(head || {piece("text")}) end given from leaf),
placed as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 pos, count(*) over (partition by source) n from hashed),
low as (select source, 0 lvl, pos, n, leaf h from placed union all
 select source, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' order by pos)) from low where n > 1 group by source, lvl, pos // 3, n),
sub as (select source, h, row_number() over (order by source nulls first) - 1 pos, count(*) over () n from low where n = 1),
high as (select 0 lvl, pos, n, h from sub union all
 select lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' order by pos)) from high where n > 1 group by lvl, pos // 3, n),
kin as (select source, lvl, pos, n, h, false top from low union all select null, lvl, pos, n, h, true from high),
around as (select source, top, lvl, pos, n, coalesce(string_agg(h, '') over (w rows between unbounded preceding and 1 preceding), '') l,
  coalesce(string_agg(h, '') over (w rows between 1 following and unbounded following), '') r from kin window w as (partition by top, source, lvl, pos // 3 order by pos)),
way as (select doc_id, source, 0 lvl, pos, n, '' proof, given f from placed union all
 select way.doc_id, way.source, way.lvl + 1, way.pos // 3, (way.n + 2) // 3, proof || l || r, sha256(l || f || r) from way join around a
  on not a.top and way.source is not distinct from a.source and way.lvl = a.lvl and way.pos = a.pos where way.n > 1),
up as (select doc_id, way.source, 0 lvl, sub.pos, sub.n, proof, f from way join sub on way.source is not distinct from sub.source where way.n = 1 union all
 select up.doc_id, up.source, up.lvl + 1, up.pos // 3, (up.n + 2) // 3, proof || l || r, sha256(l || f || r) from up join around a on a.top and up.lvl = a.lvl and up.pos = a.pos where up.n > 1)
select doc_id, leaf, sub.h subroot, root.h root, sha256(proof) proof_sha256, f folded_root, f = root.h verified
from up join placed using (doc_id) join sub on placed.source is not distinct from sub.source join (select h from high where n = 1) root on true where up.n = 1""")
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import merkle as M

    cols = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = M.leaf_of([*cols[:4], F.replace("text", F.lit("\n"), F.lit(""))])
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    made = M.manifest(read(spark, sf_dir, "documents"), M.leaf_of(cols), ["doc_id"], carry={"tampered": F.when(crc % 2 == 0, tampered)})
    made = made.withColumn("folded_root", M.folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return made.select("row.doc_id", "leaf", "subroot", "root", M.digest_of(F.col("proof")).alias("proof_sha256"), "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))


@query("op12_quality_qda")
def op12_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import in_fraction
    from .quality import quality

    docs = read(spark, sf_dir, "documents")
    held_out = in_fraction("doc_id", 3, 1)
    found = quality(docs.select("doc_id", "text", held_out.alias("held_out")), docs.filter(~held_out), read(spark, sf_dir, "labels"))
    return found.select("row.doc_id", "row.held_out", "score", "predicted")


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .alignment import align

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
