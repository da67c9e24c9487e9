"""The opN_<name> queries and the SQL that says the same, where SQL can."""

from __future__ import annotations

from pulsegrid.llm.avi import op6_media_avi
from pulsegrid.llm.compression import op2_quality_classifier
from pulsegrid.llm.minhash import op12_fingerprints
from pulsegrid.llm.mixing import op3_mixing
from pulsegrid.llm.pieces import op5_sentencepiece
from pulsegrid.llm.rules import OP1_SQL, op1_quality_rules
from pulsegrid.llm.simhash import op10_simhash_near_dedup
from pulsegrid.llm.spelling import OP11_SQL, op11_spelling_variants
from pulsegrid.llm.substrings import OP4_SQL, op4_substring_dedup
from pulsegrid.llm.surrogates import op9_pii_surrogates
from pulsegrid.llm.tokenfile import op8_token_binary
from pulsegrid.llm.tries import OP13_SQL, op13_prefix_trie
from pulsegrid.llm.urls import OP7_SQL, op7_url_filters

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_mixing": op3_mixing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_media_avi": op6_media_avi,
    "op7_url_filters": op7_url_filters,
    "op8_token_binary": op8_token_binary,
    "op9_pii_surrogates": op9_pii_surrogates,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_fingerprints": op12_fingerprints,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES = {
    "op1_quality_rules": OP1_SQL,
    "op4_substring_dedup": OP4_SQL,
    "op7_url_filters": OP7_SQL,
    "op11_spelling_variants": OP11_SQL,
    "op13_prefix_trie": OP13_SQL,
}
