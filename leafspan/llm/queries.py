"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import oracle
from .conversations import op12_conversation_repair
from .decontam import op8_benchmark_decontamination
from .html_wrapper import op4_html_extraction
from .license_scan import op9_license_scan
from .line_dedup import op3_line_dedup
from .packing import op7_pack_tokens
from .pieces import op6_sentencepiece
from .quality_model import op1_quality_classifier
from .quality_rules import op10_quality_rules
from .repacking import op11_bestfit_repacking
from .resampling import op13_importance_resampling
from .simhash import op5_simhash_near_dedup
from .url_filter import op2_url_filter

QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_url_filter": op2_url_filter,
    "op3_line_dedup": op3_line_dedup,
    "op4_html_extraction": op4_html_extraction,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_pack_tokens": op7_pack_tokens,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_license_scan": op9_license_scan,
    "op10_quality_rules": op10_quality_rules,
    "op11_bestfit_repacking": op11_bestfit_repacking,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_importance_resampling": op13_importance_resampling,
}

SQL = {"op8_benchmark_decontamination": oracle.OP8, "op10_quality_rules": oracle.OP10, "op12_conversation_repair": oracle.OP12, "op13_importance_resampling": oracle.OP13}
