"""The queries of this subpackage and the SQL they are compared with."""

from docweave.llm.chat import op1_chat_formatting
from docweave.llm.licenses import op4_license_scan
from docweave.llm.neighbours import op2_quality_classifier
from docweave.llm.packing import op5_best_fit_packing
from docweave.llm.pieces import op6_sentencepiece
from docweave.llm.rules import op3_quality_rules
from docweave.llm.simhash import op7_simhash_near_dedup
from docweave.llm.substrings import op9_suffix_array_dedup
from docweave.llm.toxicity import op10_toxicity
from docweave.llm.topk import OP8_SQL, op8_exact_top_k

QUERIES = {
    "op4_license_scan": op4_license_scan,
    "op1_chat_formatting": op1_chat_formatting,
    "op6_sentencepiece": op6_sentencepiece,
    "op2_quality_classifier": op2_quality_classifier,
    "op10_toxicity": op10_toxicity,
    "op3_quality_rules": op3_quality_rules,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op8_exact_top_k": op8_exact_top_k,
}
ORACLE_SQL = {"op8_exact_top_k": OP8_SQL}
