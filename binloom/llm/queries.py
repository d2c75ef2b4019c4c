"""The queries of this subpackage, by name; SQL where it can express one over whole tables."""

from __future__ import annotations

from binloom.llm.decontaminate import OP5_SQL, op5_suffix_array_decontamination
from binloom.llm.html_mincut import op1_mincut_html
from binloom.llm.infill import OP11_SQL, op11_infill_units
from binloom.llm.merkle import op7_merkle_fingerprints
from binloom.llm.mixing import OP4_SQL, op4_curriculum_mixing
from binloom.llm.quality import op6_bradley_terry_quality
from binloom.llm.retrieval import OP13_SQL, op13_impact_ordered_search
from binloom.llm.sharding import OP3_SQL, op3_rendezvous_sharding
from binloom.llm.simhash import op9_simhash_trie
from binloom.llm.substrings import op10_suffix_array_dedup
from binloom.llm.token_counts import op8_longest_match_counts
from binloom.llm.toxicity import op2_nb_ngram_toxicity
from binloom.llm.urls import op12_association_url_filter

_ALL = (
    op1_mincut_html, op2_nb_ngram_toxicity, op3_rendezvous_sharding, op4_curriculum_mixing, op5_suffix_array_decontamination,
    op6_bradley_terry_quality, op7_merkle_fingerprints, op8_longest_match_counts, op9_simhash_trie, op10_suffix_array_dedup,
    op11_infill_units, op12_association_url_filter, op13_impact_ordered_search,
)
QUERIES = {f.__name__: f for f in _ALL}

#: The others use a hash, a fitted model or a search of bytes that SQL has no equal of; tests hold them against plain versions.
ORACLE_SQL: dict[str, str] = {
    "op3_rendezvous_sharding": OP3_SQL, "op4_curriculum_mixing": OP4_SQL, "op5_suffix_array_decontamination": OP5_SQL,
    "op11_infill_units": OP11_SQL, "op13_impact_ordered_search": OP13_SQL,
}
