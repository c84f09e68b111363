"""The queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, centroids, decontaminate, divergence, langid, linededup, minhash, mixing, secrets, suffixdedup, toxicity, vectordedup, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secrets": secrets.op1_secrets,
        "op2_suffix_dedup": suffixdedup.op2_suffix_dedup,
        "op3_decontaminate": decontaminate.op3_decontaminate,
        "op4_line_dedup": linededup.op4_line_dedup,
        "op5_vector_dedup": vectordedup.op5_vector_dedup,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_bpe": bpe.op7_bpe,
        "op8_minhash": minhash.op8_minhash,
        "op9_langid": langid.op9_langid,
        "op10_warc": warc.op10_warc,
        "op11_mixing": mixing.op11_mixing,
        "op12_centroids": centroids.op12_centroids,
        "op13_divergence": divergence.op13_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": linededup.OP4_SQL, "op12_centroids": centroids.OP12_SQL, "op13_divergence": divergence.OP13_SQL}
