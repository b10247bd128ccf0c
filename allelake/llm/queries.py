"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, classifier, licences, ordered, packing, rules, scoring, suffixes, tokenfile, vectors

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_suffixes": suffixes.op2_suffixes,
    "op3_order_minhash": ordered.op3_order_minhash,
    "op4_rules": rules.op4_rules,
    "op5_vectors": vectors.op5_vectors,
    "op8_scores": scoring.op8_scores,
    "op7_classifier": classifier.op7_classifier,
    "op6_licences": licences.op6_licences,
    "op9_token_file": tokenfile.op9_token_file,
    "op10_packing": packing.op10_packing,
}
ORACLE_SQL: dict[str, str] = {"op4_rules": rules.OP4_SQL}
