"""The queries of this subpackage by name, with the SQL that gives the same rows where SQL can express it."""

from attesta.llm.ann import op10_ann_cross_polytope
from attesta.llm.byte_bpe import op6_byte_bpe
from attesta.llm.language_id import op3_language_id
from attesta.llm.merkle import OP11_SQL, op11_merkle_manifest
from attesta.llm.mixing import op2_mixing
from attesta.llm.pivot_index import op13_embedding_near_dedup
from attesta.llm.quality_mil import op1_quality_mil
from attesta.llm.quality_rules import OP8_SQL, op8_quality_rules
from attesta.llm.secret_scan import op5_secret_scan, oracle_sql as op5_sql
from attesta.llm.simhash import op7_simhash_near_dedup
from attesta.llm.substring_dedup import OP9_SQL, op9_substring_dedup
from attesta.llm.token_files import op4_token_files
from attesta.llm.whitening import op12_embedding_whitening

QUERIES = {
    "op1_quality_mil": op1_quality_mil,
    "op2_mixing": op2_mixing,
    "op3_language_id": op3_language_id,
    "op4_token_files": op4_token_files,
    "op5_secret_scan": op5_secret_scan,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_ann_cross_polytope": op10_ann_cross_polytope,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_embedding_near_dedup": op13_embedding_near_dedup,
}
ORACLE_SQL: dict = {
    "op5_secret_scan": op5_sql(),
    "op8_quality_rules": OP8_SQL,
    "op9_substring_dedup": OP9_SQL,
    "op11_merkle_manifest": OP11_SQL,
}
