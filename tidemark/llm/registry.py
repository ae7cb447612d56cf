"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from tidemark.llm.byte_bpe import op5_byte_bpe
from tidemark.llm.exact_dedup import OP3_SQL, op3_exact_dedup
from tidemark.llm.line_dedup import op1_line_dedup
from tidemark.llm.mixing import op6_mixing
from tidemark.llm.near_dedup import op9_near_dedup
from tidemark.llm.pii import op10_pii
from tidemark.llm.quality_classifier import op7_quality_classifier
from tidemark.llm.quality_rules import OP4_SQL, SECTIONS_SQL, host_rules_sections, op4_quality_rules
from tidemark.llm.secrets import op2_secrets
from tidemark.llm.toxicity import op8_toxicity

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_secrets": op2_secrets,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_mixing": op6_mixing,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_toxicity": op8_toxicity,
    "op9_near_dedup": op9_near_dedup,
    "op10_pii": op10_pii,
    "host_rules_sections": host_rules_sections,
}

ORACLES = {"op3_exact_dedup": OP3_SQL, "op4_quality_rules": OP4_SQL, "host_rules_sections": SECTIONS_SQL}
