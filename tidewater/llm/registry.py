"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from .ann import op8_additive_quantisation
from .filter_audit import OP11_SQL, op11_filter_interaction
from .html_extract import op1_html_extraction
from .lm_score import OP4_SQL, op4_cross_entropy_difference
from .media import op5_media_columns
from .mixing import OP10_SQL, op10_temperature_mixing
from .ngram_join import OP6_SQL, op6_ngram_jaccard_join
from .packing import op9_pattern_packing
from .quality import op3_quality_crf
from .risk_rules import OP12_SQL, op12_risk_controlled_rules
from .substring_dedup import OP7_SQL, op7_substring_dedup
from .toxicity import op2_toxicity_kn
from .yinyang import OP13_SQL, op13_yinyang_codes


def queries() -> dict:
    return {
        "op1_html_extraction": op1_html_extraction,
        "op2_toxicity_kn": op2_toxicity_kn,
        "op3_quality_crf": op3_quality_crf,
        "op4_cross_entropy_difference": op4_cross_entropy_difference,
        "op5_media_columns": op5_media_columns,
        "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_additive_quantisation": op8_additive_quantisation,
        "op9_pattern_packing": op9_pattern_packing,
        "op10_temperature_mixing": op10_temperature_mixing,
        "op11_filter_interaction": op11_filter_interaction,
        "op12_risk_controlled_rules": op12_risk_controlled_rules,
        "op13_yinyang_codes": op13_yinyang_codes,
    }


def oracle_sql() -> dict:
    return {"op4_cross_entropy_difference": OP4_SQL, "op6_ngram_jaccard_join": OP6_SQL, "op7_substring_dedup": OP7_SQL, "op10_temperature_mixing": OP10_SQL, "op11_filter_interaction": OP11_SQL, "op12_risk_controlled_rules": OP12_SQL, "op13_yinyang_codes": OP13_SQL}
