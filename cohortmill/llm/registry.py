"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, cuckoo, embeddings, licences, mixing, pages, secrets, simhash, tokens_out, toxicity

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_embeddings": embeddings.op2_embeddings,
    "op3_mixing": mixing.op3_mixing,
    "op4_secrets": secrets.op4_secrets,
    "op5_html": pages.op5_html,
    "op6_licences": licences.op6_licences,
    "op7_exact_dedup": cuckoo.op7_exact_dedup,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_token_output": tokens_out.op9_token_output,
    "op10_simhash": simhash.op10_simhash,
}
#: The others train a model, run iterations, or hash in a way that SQL has no function for.
ORACLE_SQL = {"op6_licences": licences.OP6_SQL, "op7_exact_dedup": cuckoo.OP7_SQL}
