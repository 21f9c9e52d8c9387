"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import ann, bpe, chat, exact, langid, licenses, neardup, packing, phrases, quality, sharding, warc, whitening

QUERIES = {
    "op1_multiprobe_ann": ann.op1_multiprobe_ann,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_shuffle_shards": sharding.op4_shuffle_shards,
    "op5_language_id": langid.op5_language_id,
    "op6_quality": quality.op6_quality,
    "op7_warc": warc.op7_warc,
    "op8_minhash_near_dedup": neardup.op8_minhash_near_dedup,
    "op9_bpe": bpe.op9_bpe,
    "op10_exact_dedup": exact.op10_exact_dedup,
    "op11_phrase_mining": phrases.op11_phrase_mining,
    "op12_chat_formatting": chat.op12_chat_formatting,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
}

ORACLES = {
    "op2_license_scan": licenses.ORACLE,
    "op7_warc": warc.ORACLE,
    "op10_exact_dedup": exact.ORACLE,
    "op11_phrase_mining": phrases.ORACLE,
    "op12_chat_formatting": chat.ORACLE,
}
