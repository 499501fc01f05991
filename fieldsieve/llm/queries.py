"""The queries of this subpackage and, where SQL expresses them, the SQL of their results."""

from .decontamination import op5_decontamination
from .hard_negatives import OP13_SQL, op13_hard_negatives
from .html_extract import op8_html_extract
from .lm_scoring import op9_lm_scoring
from .near_dedup import OP7_SQL, op7_near_dedup
from .ngram_join import OP11_SQL, op11_ngram_join
from .packing import op3_packing
from .quality_rules import op1_quality_rules
from .separator_scan import op2_separator_scan
from .sharding import op4_sharding
from .substring_dedup import op6_substring_dedup
from .token_alignment import op12_token_alignment
from .token_output import op10_token_output

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_separator_scan": op2_separator_scan,
    "op3_packing": op3_packing,
    "op4_sharding": op4_sharding,
    "op5_decontamination": op5_decontamination,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_near_dedup": op7_near_dedup,
    "op8_html_extract": op8_html_extract,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_token_output": op10_token_output,
    "op11_ngram_join": op11_ngram_join,
    "op12_token_alignment": op12_token_alignment,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op7_near_dedup": OP7_SQL,
    "op11_ngram_join": OP11_SQL,
    "op13_hard_negatives": OP13_SQL,
}
