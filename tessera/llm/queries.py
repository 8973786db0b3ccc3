"""The queries of this subpackage, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from tessera.llm import chat, codes, divergence
from tessera.llm.chat import op4_chat_format
from tessera.llm.codes import op13_vector_codes
from tessera.llm.decontamination import op3_decontamination
from tessera.llm.divergence import op11_source_divergence
from tessera.llm.lm import op12_lm_scores
from tessera.llm.neardup import op7_near_duplicates
from tessera.llm.packing import op2_packing
from tessera.llm.pii import op10_pii
from tessera.llm.quality import op5_quality_rules
from tessera.llm.secrets import op9_secret_scan
from tessera.llm.sharding import op6_sharding
from tessera.llm.suffix import op1_suffix_dedup
from tessera.llm.tokens import op8_token_counts

QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_packing, op3_decontamination, op4_chat_format, op5_quality_rules, op6_sharding, op7_near_duplicates, op8_token_counts, op9_secret_scan, op10_pii, op11_source_divergence, op12_lm_scores, op13_vector_codes)}
ORACLES: dict[str, str] = {"op4_chat_format": chat.ORACLE, "op11_source_divergence": divergence.ORACLE, "op13_vector_codes": codes.ORACLE}
