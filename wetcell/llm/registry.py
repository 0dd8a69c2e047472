"""The queries of this subpackage and their SQL."""

from wetcell.llm import bpe, exact_dedup, jaccard_join, licenses, line_dedup, merkle, mixing, quality, secrets, token_counts, token_files, topk, whitening

QUERIES = {
    "op1_exact_topk": topk.op1_exact_topk,
    "op2_secret_scans": secrets.op2_secret_scans,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_ngram_jaccard_join": jaccard_join.op4_ngram_jaccard_join,
    "op5_quality_classifier": quality.op5_quality_classifier,
    "op6_mixing": mixing.op6_mixing,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_bpe_encoding": bpe.op8_bpe_encoding,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_license_scans": licenses.op10_license_scans,
    "op11_token_files": token_files.op11_token_files,
    "op12_whitening": whitening.op12_whitening,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}
SQL = {
    "op1_exact_topk": topk.OP1_SQL,
    "op4_ngram_jaccard_join": jaccard_join.OP4_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
    "op13_merkle_manifest": merkle.OP13_SQL,
}
