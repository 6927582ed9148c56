"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from tidemark.llm import exactdedup, fingerprint, langid, linededup, media, neardup, packing, pii, search, spelling, suffixtree, urlfilter, wfst
from tidemark.llm._scratch import documents

QUERIES = {
    "op1_media_columns": lambda spark, d: media.media_report(documents(spark, d)),
    "op2_packing": lambda spark, d: packing.pack(documents(spark, d)),
    "op3_line_dedup": lambda spark, d: linededup.line_dedup_report(documents(spark, d)),
    "op4_url_filter": lambda spark, d: urlfilter.url_filter(spark.read.parquet(f"{d}/pages.parquet")),
    "op5_exact_dedup": lambda spark, d: exactdedup.exact_dedup(documents(spark, d)),
    "op6_sentencepiece_transducer": lambda spark, d: wfst.transducer_report(documents(spark, d)),
    "op7_lm_suffix_tree": lambda spark, d: suffixtree.lm_scores(documents(spark, d)),
    "op8_language_id": lambda spark, d: langid.language_report(documents(spark, d)),
    "op9_minhash_near_dedup": lambda spark, d: neardup.near_dup_report(documents(spark, d)),
    "op10_pii_pseudonyms": lambda spark, d: pii.pii_report(documents(spark, d)),
    "op11_fingerprints": lambda spark, d: fingerprint.fingerprints(documents(spark, d)),
    "op12_ranked_search": lambda spark, d: search.search(spark.read.parquet(f"{d}/benchmark.parquet"), documents(spark, d)),
    "op13_spelling_variants": lambda spark, d: spelling.spelling_variants(documents(spark, d)),
    "media_clips": lambda spark, d: media.clips(media.encode_column(documents(spark, d))),
    "source_fingerprints": lambda spark, d: fingerprint.source_fingerprints(documents(spark, d)),
    "url_rules": lambda spark, d: urlfilter.url_rules(spark.read.parquet(f"{d}/pages.parquet")),
}

ORACLE_SQL = {
    "op3_line_dedup": linededup.ORACLE_SQL,
    "op5_exact_dedup": exactdedup.ORACLE_SQL,
    "op11_fingerprints": fingerprint.ORACLE_SQL,
    "op12_ranked_search": search.ORACLE_SQL,
    "op13_spelling_variants": spelling.ORACLE_SQL,
    "source_fingerprints": fingerprint.SOURCES_SQL,
    "url_rules": urlfilter.RULES_SQL,
}
