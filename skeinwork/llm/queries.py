"""The queries of this subpackage, and their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import codes, decontaminate, minhash, packing, planes, quality, repair, secrets, sharding, substrings, template_sql, toxicity, vector_sql, vectors, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_vector_shards": sharding.op2_vector_shards,
    "op3_levenshtein_toxicity": toxicity.op3_levenshtein_toxicity,
    "op4_template_decontamination": decontaminate.op4_template_decontamination,
    "op5_bbit_minhash": minhash.op5_bbit_minhash,
    "op6_crf_secrets": secrets.op6_crf_secrets,
    "op7_warc_segments": warc.op7_warc_segments,
    "op8_level_doubling": substrings.op8_level_doubling,
    "op9_residual_packing": packing.op9_residual_packing,
    "op10_plane_files": planes.op10_plane_files,
    "op11_term_topk": vectors.op11_term_topk,
    "op12_annular_codes": codes.op12_annular_codes,
    "op13_ranked_repair": repair.op13_ranked_repair,
}

ORACLE_SQL: dict[str, str] = {"op4_template_decontamination": template_sql.SQL, "op11_term_topk": vector_sql.TOP, "op12_annular_codes": vector_sql.CODES}
