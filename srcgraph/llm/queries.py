"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import embedding, exact_dedup, language, minhash, mixing, packing, secrets, sharding, toxicity, warc


def queries() -> dict:
    return {
        "op1_best_fit_packing": packing.op1,
        "op2_secret_scan": secrets.op2,
        "op3_exact_dedup": exact_dedup.op3,
        "op4_language": language.op4,
        "op5_sharding": sharding.op5,
        "op6_toxicity": toxicity.op6,
        "op7_embedding_near_dedup": embedding.op7,
        "op8_minhash_near_dedup": minhash.op8,
        "op9_warc": warc.op9,
        "op10_mixing": mixing.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": exact_dedup.OP3_SQL, "op7_embedding_near_dedup": embedding.OP7_SQL, "op8_minhash_near_dedup": minhash.OP8_SQL, "op9_warc": warc.OP9_SQL}
