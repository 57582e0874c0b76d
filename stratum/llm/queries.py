"""The corpus operators' queries and oracles, for ``__spark_entry__``."""

from __future__ import annotations

import corpus_pipeline
from stratum.llm.chat import OP5_SQL, op5_chat
from stratum.llm.dedup_exact import OP6_SQL, op6_exact_dedup
from stratum.llm.html_extract import op9_html_extraction
from stratum.llm.mixing import op10_mixing
from stratum.llm.near_dedup import OP1_SQL, op1_near_dedup
from stratum.llm.packing import op3_packing
from stratum.llm.quality import op4_quality_rules
from stratum.llm.sharding import op7_sharding
from stratum.llm.substring import OP8_SQL, op8_substring_dedup
from stratum.llm.toxicity import op2_toxicity

QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_packing": op3_packing,
    "op4_quality_rules": op4_quality_rules,
    "op5_chat": op5_chat,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_sharding": op7_sharding,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_html_extraction": op9_html_extraction,
    "op10_mixing": op10_mixing,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {"op1_near_dedup": OP1_SQL, "op5_chat": OP5_SQL, "op6_exact_dedup": OP6_SQL, "op8_substring_dedup": OP8_SQL}
