"""Queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from logloom.llm.centroids import OP12_SQL, op12_centroid_clustering
from logloom.llm.decontaminate import OP10_SQL, op10_benchmark_decontamination
from logloom.llm.html_text import OP4_SQL, op4_html_extraction
from logloom.llm.licenses import OP9_SQL, op9_license_scan
from logloom.llm.pii import OP3_SQL, op3_pii
from logloom.llm.quality import op5_quality_classifier
from logloom.llm.resample import OP13_SQL, op13_importance_resampling
from logloom.llm.rules import OP1_SQL, op1_quality_rules
from logloom.llm.secrets import OP8_SQL, op8_secret_scan
from logloom.llm.sentencepiece_codec import op6_sentencepiece
from logloom.llm.simhash import op2_simhash_near_dedup
from logloom.llm.substrings import op7_substring_dedup
from logloom.llm.token_files import op11_token_files

QUERIES = {f.__name__: f for f in (
    op1_quality_rules,
    op2_simhash_near_dedup,
    op3_pii,
    op4_html_extraction,
    op5_quality_classifier,
    op6_sentencepiece,
    op7_substring_dedup,
    op8_secret_scan,
    op9_license_scan,
    op10_benchmark_decontamination,
    op11_token_files,
    op12_centroid_clustering,
    op13_importance_resampling,
)}

# Operators 2, 5, 6, 7 and 11 (iterated components, a trained model, tokenizers,
# runs of units) have none: they are tested against brute force, held-out
# accuracy and the sentencepiece library.
ORACLES = {
    "op1_quality_rules": OP1_SQL,
    "op3_pii": OP3_SQL,
    "op4_html_extraction": OP4_SQL,
    "op8_secret_scan": OP8_SQL,
    "op9_license_scan": OP9_SQL,
    "op10_benchmark_decontamination": OP10_SQL,
    "op12_centroid_clustering": OP12_SQL,
    "op13_importance_resampling": OP13_SQL,
}
