"""The registered queries of the corpus operators, and their SQL where it can express them."""

from __future__ import annotations

from textmatch.llm.decontaminate import OP2_SQL, op2_decontaminate
from textmatch.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from textmatch.llm.html_extract import op8_html_extraction
from textmatch.llm.language_id import op13_language_id
from textmatch.llm.line_dedup import OP1_SQL, op1_line_dedup
from textmatch.llm.minhash import OP3_SQL, op3_minhash
from textmatch.llm.quality import OP6_SQL, op6_quality
from textmatch.llm.sentencepiece import op5_sentencepiece
from textmatch.llm.sharding import op9_sharding
from textmatch.llm.substring_dedup import op7_substring_dedup
from textmatch.llm.suffix_dedup import op10_suffix_array
from textmatch.llm.token_counts import op4_token_counts
from textmatch.llm.vector_codes import OP11_SQL, op11_vector_codes

REGISTRY = {
    "op1_line_dedup": op1_line_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_minhash": op3_minhash,
    "op4_token_counts": op4_token_counts,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_quality": op6_quality,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_html_extraction": op8_html_extraction,
    "op9_sharding": op9_sharding,
    "op10_suffix_array": op10_suffix_array,
    "op11_vector_codes": op11_vector_codes,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_language_id": op13_language_id,
}

ORACLES = {
    "op1_line_dedup": OP1_SQL,
    "op2_decontaminate": OP2_SQL,
    "op3_minhash": OP3_SQL,
    "op6_quality": OP6_SQL,
    "op11_vector_codes": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
}
