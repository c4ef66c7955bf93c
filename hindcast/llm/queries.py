"""The operators' queries and their SQL, which the driver's entry file registers."""

from __future__ import annotations

from hindcast.llm.conversations import op12_conversation_repair
from hindcast.llm.filter_audit import ORACLE as AUDIT_SQL, op11_filter_audit
from hindcast.llm.language_id import op13_language_id
from hindcast.llm.main_text import op7_main_text
from hindcast.llm.neardup import ORACLE as NEARDUP_SQL, op6_near_duplicates
from hindcast.llm.packing import op9_packing
from hindcast.llm.quality import op2_quality
from hindcast.llm.rules import op3_quality_rules
from hindcast.llm.secret_scan import op4_secrets
from hindcast.llm.sharding import ORACLE as SHARDING_SQL, op10_sharding
from hindcast.llm.simhash import op5_simhash
from hindcast.llm.tokens import op8_bpe
from hindcast.llm.toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity, "op2_quality": op2_quality, "op3_quality_rules": op3_quality_rules,
    "op4_secrets": op4_secrets, "op5_simhash": op5_simhash, "op6_near_duplicates": op6_near_duplicates,
    "op7_main_text": op7_main_text, "op8_bpe": op8_bpe, "op9_packing": op9_packing, "op10_sharding": op10_sharding,
    "op11_filter_audit": op11_filter_audit, "op12_conversation_repair": op12_conversation_repair, "op13_language_id": op13_language_id,
}
ORACLES = {"op6_near_duplicates": NEARDUP_SQL, "op10_sharding": SHARDING_SQL, "op11_filter_audit": AUDIT_SQL}
