"""The queries of this subpackage: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from . import ann, bpe, decontamination, licences, lm, pii, quality, ranking, repetition, sharding, simhash, urls, whitening
from .common import table


def op1_lm_scoring(spark, sf_dir):
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op2_licence_scan(spark, sf_dir):
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def op3_bpe_coding(spark, sf_dir):
    return bpe.token_digests(table(spark, sf_dir, "documents"))


def op4_sharding(spark, sf_dir):
    return sharding.shard_of(table(spark, sf_dir, "documents"))


def op5_url_filter(spark, sf_dir):
    return urls.judged(table(spark, sf_dir, "pages"))


def op6_personal_data(spark, sf_dir):
    return pii.span_digests(table(spark, sf_dir, "documents"))


def op7_quality(spark, sf_dir):
    found = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.drop("digest")


def op8_nearest_neighbours(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"))


def op9_simhash_components(spark, sf_dir):
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op10_decontamination(spark, sf_dir):
    found = decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("digest")


def op11_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_ranked_search(spark, sf_dir):
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_quality_rules(spark, sf_dir):
    return repetition.judge(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_lm_scoring, op2_licence_scan, op3_bpe_coding, op4_sharding, op5_url_filter,
        op6_personal_data, op7_quality, op8_nearest_neighbours, op9_simhash_components, op10_decontamination,
        op11_whitening, op12_ranked_search, op13_quality_rules,
    )
}
ORACLES: dict[str, str] = {
    "op12_ranked_search": """
        with doc as (select row_number() over () k, doc_id,
                            regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') terms from documents),
             item as (select row_number() over () item, item_id,
                             regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') terms from benchmark),
             size as (select count(*)::bigint as docs, sum(len(terms))::bigint as terms from doc where len(terms) > 0),
             tf as (select k, doc_id, n, term, count(*)::bigint as tf from (select k, doc_id, len(terms)::bigint as n, unnest(terms) as term from doc) group by all),
             df as (select term, floor(1000 * ln((2.0::double * docs + 2) / (2 * count(*) + 1)))::bigint as w from tf, size group by term, docs),
             asked as (select distinct item, item_id, unnest(terms) as term from item),
             scored as (select item, item_id, k, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * size.docs) // size.terms))))::bigint as score
                        from asked join df using (term) join tf using (term), size group by all),
             ranked as (select item_id, row_number() over (partition by item order by score desc, doc_id, k)::int as rank, doc_id, score from scored where score > 0)
        select * from ranked where rank <= 10
    """,
}
