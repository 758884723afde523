"""The corpus operators' queries over the given tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from landmesh.llm.bpe import op2_bpe
from landmesh.llm.centroids import OP13_SQL, op13_clusters
from landmesh.llm.chat import OP4_SQL, op4_chat
from landmesh.llm.decontaminate import op5_decontaminate
from landmesh.llm.html_text import op7_html
from landmesh.llm.jaccard_join import op8_jaccard_join
from landmesh.llm.lm_score import op6_lm_score
from landmesh.llm.quality import op3_quality
from landmesh.llm.substring_dedup import op9_substring_dedup
from landmesh.llm.suffix_dedup import op1_suffix_dedup
from landmesh.llm.token_store import op10_token_store
from landmesh.llm.vector_codes import OP12_SQL, op12_vector_codes
from landmesh.llm.warc import OP11_SQL, op11_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_bpe": op2_bpe,
    "op3_quality": op3_quality,
    "op4_chat": op4_chat,
    "op5_decontaminate": op5_decontaminate,
    "op6_lm_score": op6_lm_score,
    "op7_html": op7_html,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_token_store": op10_token_store,
    "op11_warc": op11_warc,
    "op12_vector_codes": op12_vector_codes,
    "op13_clusters": op13_clusters,
}

ORACLES: dict[str, str] = {"op4_chat": OP4_SQL, "op11_warc": OP11_SQL, "op12_vector_codes": OP12_SQL, "op13_clusters": OP13_SQL}
