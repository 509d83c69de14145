"""The queries of this subpackage, by name, and the SQL of those that SQL can express.

Hashes, models and tokenizers put the others beyond SQL; tests/llm holds their brute-force versions.
"""

from __future__ import annotations

from siltstone.llm.bpe import op6_byte_bpe
from siltstone.llm.centroids import op11_centroid_clustering
from siltstone.llm.decontaminate import op9_decontamination
from siltstone.llm.extract import op2_html_extraction
from siltstone.llm.langid import op8_language_id
from siltstone.llm.licenses import op13_license_scan
from siltstone.llm.neardup import op1_near_duplicates
from siltstone.llm.oracle import ORACLE_SQL  # noqa: F401
from siltstone.llm.repeats import op7_repeated_strings
from siltstone.llm.resample import op12_importance_resampling
from siltstone.llm.search import op3_top_k_search
from siltstone.llm.sharding import op4_sharding
from siltstone.llm.tokenstore import op10_token_files
from siltstone.llm.toxicity import op5_toxicity

QUERIES = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_html_extraction": op2_html_extraction,
    "op3_top_k_search": op3_top_k_search,
    "op4_sharding": op4_sharding,
    "op5_toxicity": op5_toxicity,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_repeated_strings": op7_repeated_strings,
    "op8_language_id": op8_language_id,
    "op9_decontamination": op9_decontamination,
    "op10_token_files": op10_token_files,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_license_scan": op13_license_scan,
}
