"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from evflow.llm.align import op12_alignment
from evflow.llm.decontaminate import op3_decontaminate
from evflow.llm.hamming import OP1_SQL, op1_hamming
from evflow.llm.html import op4_html
from evflow.llm.jaccard import OP7_SQL, op7_jaccard
from evflow.llm.licenses import op9_licenses
from evflow.llm.packing import op8_packing
from evflow.llm.pitman_yor import op5_pitman_yor
from evflow.llm.quality import op10_quality
from evflow.llm.records import op2_records
from evflow.llm.repeats import op13_repeats
from evflow.llm.toxicity import op6_toxicity
from evflow.llm.trie import OP11_SQL, op11_trie

QUERIES = {
    "op1_hamming": op1_hamming,
    "op2_records": op2_records,
    "op3_decontaminate": op3_decontaminate,
    "op4_html": op4_html,
    "op5_pitman_yor": op5_pitman_yor,
    "op6_toxicity": op6_toxicity,
    "op7_jaccard": op7_jaccard,
    "op8_packing": op8_packing,
    "op9_licenses": op9_licenses,
    "op10_quality": op10_quality,
    "op11_trie": op11_trie,
    "op12_alignment": op12_alignment,
    "op13_repeats": op13_repeats,
}

ORACLE_SQL: dict[str, str] = {"op1_hamming": OP1_SQL, "op7_jaccard": OP7_SQL, "op11_trie": OP11_SQL}
