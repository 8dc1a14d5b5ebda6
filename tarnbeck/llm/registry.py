"""Queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .clusters import OP11_SQL, op11_centroid_clusters
from .decontamination import op9_decontamination
from .fingerprints import op1_fingerprints
from .near_duplicates import op2_near_duplicates
from .personal_data import op7_personal_data
from .piece_codec import op10_sentencepiece
from .prefix_trie import OP13_SQL, op13_prefix_trie
from .quality import op6_quality
from .token_counts import op3_token_counts
from .token_files import op5_token_files
from .toxicity import op8_toxicity
from .url_filters import OP12_SQL, op12_url_filters
from .warc import OP4_SQL, op4_warc

QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_token_counts": op3_token_counts,
    "op4_warc": op4_warc,
    "op5_token_files": op5_token_files,
    "op6_quality": op6_quality,
    "op7_personal_data": op7_personal_data,
    "op8_toxicity": op8_toxicity,
    "op9_decontamination": op9_decontamination,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_url_filters": op12_url_filters,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE: dict[str, str] = {
    "op4_warc": OP4_SQL,
    "op11_centroid_clusters": OP11_SQL,
    "op12_url_filters": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
