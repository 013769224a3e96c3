"""The queries of this subpackage by name, and DuckDB SQL where SQL can express them."""

from . import ann, bpe, exact_dedup, mixing, repair, sanitise, simhash, substring_dedup, toxicity, url_templates

QUERIES = {
    "op1_repair_ids": repair.op1_repair_ids,
    "op2_url_templates": url_templates.op2_url_templates,
    "op3_sanitise": sanitise.op3_sanitise,
    "op4_ann": ann.op4_ann,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_bpe": bpe.op6_bpe,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_mixing": mixing.op8_mixing,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_simhash": simhash.op10_simhash,
}

ORACLE_SQL = {"op2_url_templates": url_templates.OP2_SQL, "op7_exact_dedup": exact_dedup.OP7_SQL, "op8_mixing": mixing.OP8_SQL}
