"""Registered queries of the corpus operators and their DuckDB oracles, where SQL can express them."""

from __future__ import annotations

from marketlake.llm import prefix_trie, structure_repair, template_decontamination
from marketlake.llm.config_packing import op10_config_packing
from marketlake.llm.language_id import op5_language_id
from marketlake.llm.line_alignment import op3_line_alignment
from marketlake.llm.quality_forest import op4_quality_forest
from marketlake.llm.simhash_pivots import op2_simhash_pivots
from marketlake.llm.site_templates import op8_site_templates
from marketlake.llm.substring_dedup import op6_substring_dedup
from marketlake.llm.token_counts import op7_token_counts
from marketlake.llm.toxicity_automata import op12_toxicity_automata
from marketlake.llm.transcript_hmm import op9_transcript_hmm

QUERIES = {f.__name__: f for f in (
    template_decontamination.op1_template_decontamination, op2_simhash_pivots, op3_line_alignment, op4_quality_forest,
    op5_language_id, op6_substring_dedup, op7_token_counts, op8_site_templates, op9_transcript_hmm,
    op10_config_packing, prefix_trie.op11_prefix_trie, op12_toxicity_automata, structure_repair.op13_structure_repair)}

ORACLES = {"op1_template_decontamination": template_decontamination.ORACLE, "op11_prefix_trie": prefix_trie.ORACLE,
           "op13_structure_repair": structure_repair.ORACLE}
