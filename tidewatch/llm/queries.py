"""Importing this module registers the queries of the operators in this folder."""

from tidewatch.llm import (  # noqa: F401
    op1_quality,
    op10_forest,
    op11_resampling,
    op12_centroids,
    op13_suffixes,
    op2_sentencepiece,
    op3_substrings,
    op4_tokenfiles,
    op5_warc,
    op6_minhash,
    op7_mixing,
    op8_language,
    op9_lines,
)
from tidewatch.llm.registry import ORACLES, QUERIES  # noqa: F401
