"""The registered queries of the operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumencat.llm.chunk_store import op8_content_store
from lumencat.llm.collocations import OP12_SQL, op12_prefix_collocations
from lumencat.llm.hamming_search import OP6_SQL, op6_multi_index_hamming
from lumencat.llm.language_id import op9_cross_parsing_language
from lumencat.llm.line_dedup import op2_line_dedup
from lumencat.llm.media import op1_webp_media
from lumencat.llm.near_dedup import op4_minmax_near_dedup
from lumencat.llm.outliers import op11_robust_outliers
from lumencat.llm.packing import op3_dp_packing
from lumencat.llm.piece_bpe import op7_piece_bpe
from lumencat.llm.spelling import op13_spelling_variants
from lumencat.llm.transcripts import op10_hmm_transcripts
from lumencat.llm.warc import op5_warc_captures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_webp_media": op1_webp_media,
    "op2_line_dedup": op2_line_dedup,
    "op3_dp_packing": op3_dp_packing,
    "op4_minmax_near_dedup": op4_minmax_near_dedup,
    "op5_warc_captures": op5_warc_captures,
    "op6_multi_index_hamming": op6_multi_index_hamming,
    "op7_piece_bpe": op7_piece_bpe,
    "op8_content_store": op8_content_store,
    "op9_cross_parsing_language": op9_cross_parsing_language,
    "op10_hmm_transcripts": op10_hmm_transcripts,
    "op11_robust_outliers": op11_robust_outliers,
    "op12_prefix_collocations": op12_prefix_collocations,
    "op13_spelling_variants": op13_spelling_variants,
}

#: The others pack, hash, parse or encode in ways that SQL cannot express; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op6_multi_index_hamming": OP6_SQL, "op12_prefix_collocations": OP12_SQL}
