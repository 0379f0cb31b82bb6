"""The registered queries of this subpackage and their SQL counterparts.

Every query applies its operator to the whole table; digest columns are derived here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setlist.llm import decontaminate, exact_dedup, hard_negatives, html_main, jaccard_join, language_id, lattice_join, line_dedup, lm_score, manifest, mixing, secrets, url_filter
from setlist.session import tune


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Arrow batches of few rows keep tasks that run Python within memory when texts are long.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language_id.learn_profiles(docs.where(~language_id.held_out(F.col("doc_id"))))
    found = language_id.predict_languages(docs.select("doc_id", "text"), profiles)
    return found.select("doc.doc_id", language_id.held_out(F.col("doc.doc_id")).alias("held_out"), "lang_pred", "score")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_texts(table(spark, sf_dir, "documents"), lm_score.held_out(F.col("doc_id")))


def op6_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract_main_text(table(spark, sf_dir, "pages"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.without_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.span_text(F.col("base")), 256).alias("base_sha256"), secrets.span_text(F.col("spans")).alias("spans"))


# Target weights of the production mixture; any other source has weight 1.
SOURCE_WEIGHTS: dict[str | None, float] = {"src0": 4.0, "src1": 2.0, "src2": 2.0, "src3": 0.5}
MIX_SEED = 17


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = mixing.mixed(table(spark, sf_dir, "documents"), SOURCE_WEIGHTS, seed=MIX_SEED)
    return copies.select("doc.doc_id", "doc.source", "copy", "n_copies")


# The contract's rules (host, path).
ALLOW_RULES = [("org", "/"), ("com", "/fr/")]
BLOCK_RULES = [("example.org", "/es/"), ("example.org", "/en/1"), ("com", "/de/")]
# The blocked hosts of the production list; subdomains are blocked with them.
BLOCKED_HOSTS = [
    f"{name}.example.{top}" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
    for top in ("com", "net", "org")
]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), ALLOW_RULES, BLOCK_RULES, BLOCKED_HOSTS)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", "start", "n_words", "hamming", "similarity")


def op11_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lattice_join.near_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding", 0.98)
    return found.select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


# Fixed value: the order of a leaf's fields.
LEAF_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    digest = lambda fields: F.sha2(manifest.field_text(fields), 256)
    changed = [c if c != "n_chars" else "n_chars_changed" for c in LEAF_FIELDS]
    leaves = docs.withColumn("n_chars_changed", F.col("n_chars") + 1).select(
        "doc_id", "lang", digest(LEAF_FIELDS).alias("leaf"), F.when(tampered, digest(changed)).alias("claimed"))
    proofs = manifest.Manifest(leaves, "lang", ["doc_id"], "leaf").proofs()
    folded = manifest.folded(F.coalesce("claimed", "leaf"), F.col("steps"))
    return proofs.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.concat_ws("", "steps.digest"), 256).alias("proof_sha256"),
        folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives.hard_negatives(
        rows.withColumn("mined_label", moved), F.col("vec_id") % 50 == 0, "vec_id", "mined_label", "embedding")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_lm_score": op2_lm_score,
    "op3_line_dedup": op3_line_dedup,
    "op4_mixing": op4_mixing,
    "op5_secrets": op5_secrets,
    "op6_html_main": op6_html_main,
    "op7_url_filter": op7_url_filter,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_decontaminate": op9_decontaminate,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_embedding_neardup": op11_embedding_neardup,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_hard_negatives": op13_hard_negatives,
}

# Fixed value: the white space of the contracts, as a regular expression.
_WS = r"[\x20\x09-\x0D]"

ORACLES: dict[str, str] = {
    "op3_line_dedup": r"""
        with docs as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
        ex as (select doc_id, unnest(generate_series(1, len(lines))) as i, unnest(lines) as line from docs),
        keyed as (select doc_id, i, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                         chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as key from ex),
        keys as (select key, max(doc_id) as last_doc from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
        marked as (select k.doc_id, k.i, k.line, s.key is not null and k.doc_id <> s.last_doc as gone from keyed k left join keys s on k.key = s.key)
        select doc_id, count(*)::bigint as n_lines, (count(*) filter (gone))::bigint as n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
        from marked group by doc_id""",
    # Poisson probabilities are summed from 0 up, as the operator does; rates here stay below its step.
    "op4_mixing": r"""
        with recursive sizes as (select source, sum(greatest(1, length(coalesce(text, ''))))::double as size,
            case source when 'src0' then 4.0 when 'src1' then 2.0 when 'src2' then 2.0 when 'src3' then 0.5 else 1.0 end::double as weight
            from documents group by source),
        rates as (select source, weight / (select sum(weight) from sizes) * (select sum(size) from sizes) / size as rate from sizes),
        p(source, rate, k, prob, below) as (
            select source, rate, 0, exp(-rate), exp(-rate) from rates
            union all select source, rate, k + 1, prob * rate / (k + 1), below + prob * rate / (k + 1) from p
            where k + 1 <= ceil(rate + 12 * sqrt(rate) + 40)),
        u as (select doc_id, source, ('0x' || substr(md5(concat_ws('|', '17', '1', coalesce(doc_id::varchar, 'null'),
                     md5(coalesce(text, '')))), 1, 13))::bigint / 4503599627370496.0::double as u from documents),
        n as (select u.doc_id, u.source, min(p.k)::integer as n_copies from u join p on u.source is not distinct from p.source and p.below > u.u
              group by u.doc_id, u.source, u.u)
        select doc_id, source, unnest(generate_series(0, n_copies - 1))::integer as copy, n_copies from n where n_copies > 0""",
    "op7_url_filter": r"""
        with u as (select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                          regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path from pages),
        rules(h, p, verdict) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                                        ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        best as (select page_id, host, path, max_by(h || p, length(h || p)) as rule, max_by(verdict, length(h || p)) as ruled
                 from u left join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
                 group by page_id, host, path)
        select page_id, host, path, rule, coalesce(ruled, case when regexp_matches(host,
               '^(.*[.])?(adult-x|ads-track|casino-win|cheap-pills|free-bets|spam-farm)[.]example[.](com|net|org)$')
               then 'block' else 'allow' end) as verdict from best""",
    "op10_exact_dedup": rf"""
        with n as (select doc_id, length(coalesce(text, '')) as n_chars,
                          sha256(regexp_replace(coalesce(text, ''), '{_WS}', '', 'g')) as text_sha256 from documents)
        select doc_id, first(doc_id) over w as keep_id, count(*) over (partition by text_sha256)::bigint as group_size,
               row_number() over w = 1 as kept, text_sha256
        from n window w as (partition by text_sha256 order by n_chars desc, doc_id
                            rows between unbounded preceding and unbounded following)""",
    # crc32 by its table of 256 entries, made from the polynomial.
    "op12_merkle_manifest": """
        with recursive crc_steps(b, c, k) as (
            select i, i, 0 from range(256) r(i)
            union all select b, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from crc_steps where k < 8),
        crc as (select list(c order by b) as entries from crc_steps where k = 8),
        docs as (select *, coalesce(lang, '') as l, lang is not null as has_lang,
            xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda d: ascii(d)::bigint)),
                lambda a, x: xor(a >> 8, entries[xor(a & 255, x) + 1])), 4294967295) % 7 = 0 as tampered from documents, crc),
        texts as (select doc_id, l, has_lang, tampered,
            coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
              || coalesce(strlen(lang) || ':' || lang, '-') as head,
            n_chars, coalesce(strlen(text) || ':' || text, '-') as tail from docs),
        leaves as (select doc_id, l, has_lang,
            sha256(head || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || tail) as leaf,
            sha256(head || coalesce(strlen((n_chars + tampered::int)::varchar) || ':' || (n_chars + tampered::int), '-') || tail) as claimed,
            row_number() over (partition by has_lang, l order by doc_id) - 1 as idx, count(*) over (partition by has_lang, l) as n from texts),
        tree(has_lang, l, lvl, idx, n, d) as (
            select has_lang, l, 0, idx, n, leaf from leaves
            union all select has_lang, l, lvl + 1, idx // 2, (any_value(n) + 1) // 2, sha256(string_agg(d, '' order by idx))
            from tree where n > 1 group by has_lang, l, lvl, idx // 2),
        subs as (select has_lang, l, d as subroot, row_number() over (order by has_lang, l) - 1 as idx, count(*) over () as n
                 from tree where n = 1),
        top(lvl, idx, n, d) as (
            select 0, idx, n, subroot from subs
            union all select lvl + 1, idx // 2, (any_value(n) + 1) // 2, sha256(string_agg(d, '' order by idx))
            from top where n > 1 group by lvl, idx // 2),
        up(doc_id, has_lang, l, lvl, idx, n, d, sibs) as (
            select doc_id, has_lang, l, 0, idx, n, claimed, '' from leaves
            union all select u.doc_id, u.has_lang, u.l, u.lvl + 1, u.idx // 2, (u.n + 1) // 2,
                sha256(case when u.idx % 2 = 1 then t.d || u.d else u.d || coalesce(t.d, '') end), u.sibs || coalesce(t.d, '')
            from up u left join tree t on t.has_lang = u.has_lang and t.l = u.l and t.lvl = u.lvl and t.idx = xor(u.idx, 1)
            where u.n > 1),
        over(doc_id, has_lang, l, lvl, idx, n, d, sibs) as (
            select u.doc_id, u.has_lang, u.l, 0, s.idx, s.n, u.d, u.sibs from up u join subs s using (has_lang, l) where u.n = 1
            union all select o.doc_id, o.has_lang, o.l, o.lvl + 1, o.idx // 2, (o.n + 1) // 2,
                sha256(case when o.idx % 2 = 1 then t.d || o.d else o.d || coalesce(t.d, '') end), o.sibs || coalesce(t.d, '')
            from over o left join top t on t.lvl = o.lvl and t.idx = xor(o.idx, 1) where o.n > 1)
        select o.doc_id, v.leaf, s.subroot, r.d as root, sha256(o.sibs) as proof_sha256, o.d as folded_root, o.d = r.d as verified
        from over o join leaves v using (doc_id) join subs s on s.has_lang = o.has_lang and s.l = o.l
        cross join (select d from top where n = 1) r where o.n = 1""",
    "op13_hard_negatives": """
        with q as (select vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label::bigint end as label,
                          list_transform(embedding, lambda x: floor(256 * x::double)) as v
                   from embeddings where label is not null and embedding is not null
                   and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        scores as (select a.vec_id as anchor_id, r.vec_id as row_id, a.label = r.label as same, list_dot_product(a.v, r.v)::bigint as score
                   from q a, q r where a.vec_id % 50 = 0 and a.vec_id <> r.vec_id),
        pos as (select anchor_id, row_id as positive_id, score as positive_score from scores where same
                qualify row_number() over (partition by anchor_id order by score desc, row_id) <= 5)
        select p.anchor_id, positive_id, row_number() over w::integer as rank, s.row_id as negative_id, positive_score, s.score as negative_score
        from pos p join scores s on s.anchor_id = p.anchor_id and not s.same and 100 * s.score between 50 * positive_score and 95 * positive_score
        window w as (partition by p.anchor_id, positive_id order by s.score desc, s.row_id)
        qualify row_number() over w <= 3""",
}
