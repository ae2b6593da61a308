"""The queries of this package, one for each numbered operator, and their SQL where SQL can express them."""

from __future__ import annotations

from docloom.llm import divergence, exact_dedup, language, licences, merkle, minhash, mixing, nearest, quality, sentencepiece_bpe, suffixes, token_store, toxicity


def queries() -> dict:
    return {
        "op1_minhash": minhash.op1_minhash,
        "op2_licences": licences.op2_licences,
        "op3_mix_sources": mixing.op3_mix_sources,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_language": language.op5_language,
        "op6_sentencepiece": sentencepiece_bpe.op6_sentencepiece,
        "op7_nearest": nearest.op7_nearest,
        "op8_token_store": token_store.op8_token_store,
        "op9_quality": quality.op9_quality,
        "op10_suffixes": suffixes.op10_suffixes,
        "op11_toxicity": toxicity.op11_toxicity,
        "op12_divergence": divergence.op12_divergence,
        "op13_merkle": merkle.op13_merkle,
    }


def oracle_sql() -> dict[str, str]:
    """The others are models, tokenizers or an approximate search; tests hold them against brute force, libraries or held-out rows."""
    return {"op1_minhash": minhash.OP1_SQL, "op3_mix_sources": mixing.OP3_SQL, "op4_exact_dedup": exact_dedup.OP4_SQL, "op10_suffixes": suffixes.OP10_SQL, "op12_divergence": divergence.OP12_SQL, "op13_merkle": merkle.OP13_SQL}
