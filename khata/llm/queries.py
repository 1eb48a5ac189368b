"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from khata.llm import oracles
from khata.llm.decontamination import op10_decontamination
from khata.llm.embedding_dedup import op6_embedding_dedup
from khata.llm.html_extraction import op1_html_extraction
from khata.llm.minhash_dedup import op4_minhash_dedup
from khata.llm.mixing import op8_mixing
from khata.llm.packing import op12_packing
from khata.llm.periodic_runs import op11_periodic_runs
from khata.llm.quality import op9_quality
from khata.llm.substring_dedup import op2_substring_dedup
from khata.llm.suffix_array import op3_suffix_array
from khata.llm.token_alignment import op13_token_alignment
from khata.llm.token_counts import op7_token_counts
from khata.llm.toxicity import op5_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_suffix_array": op3_suffix_array,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_mixing": op8_mixing,
    "op9_quality": op9_quality,
    "op10_decontamination": op10_decontamination,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_packing": op12_packing,
    "op13_token_alignment": op13_token_alignment,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {"op2_substring_dedup": oracles.OP2, "op3_suffix_array": oracles.OP3, "op4_minhash_dedup": oracles.OP4, "op6_embedding_dedup": oracles.OP6}
