"""Queries of this subpackage, one for each operator, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from .ball_search import OP13_SQL, op13_ranked_search
from .byte_bpe import op4_byte_bpe
from .collocations import OP11_SQL, op11_collocations
from .gst import op5_decontamination
from .jaccard import op3_jaccard_join
from .language import op10_language_id
from .licenses import op7_license_scan
from .line_dedup import OP12_SQL, op12_line_dedup
from .line_rules import OP1_SQL, op1_quality_rules
from .secrets import op9_secrets
from .suffixes import op2_substring_dedup
from .token_sections import op6_token_counts
from .warc import OP8_SQL, op8_warc

ALL = (
    op1_quality_rules, op2_substring_dedup, op3_jaccard_join, op4_byte_bpe, op5_decontamination, op6_token_counts,
    op7_license_scan, op8_warc, op9_secrets, op10_language_id, op11_collocations, op12_line_dedup, op13_ranked_search,
)
QUERIES = {f.__name__: f for f in ALL}
ORACLES: dict[str, str] = {
    "op1_quality_rules": OP1_SQL, "op8_warc": OP8_SQL, "op11_collocations": OP11_SQL, "op12_line_dedup": OP12_SQL,
    "op13_ranked_search": OP13_SQL,
}
