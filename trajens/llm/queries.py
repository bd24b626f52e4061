"""Registered queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from trajens.llm.ann import op4_nearest
from trajens.llm.audit import OP12_SQL, op12_filter_audit
from trajens.llm.langid import op8_langid
from trajens.llm.mixing import op2_mixing
from trajens.llm.packing import op3_packing
from trajens.llm.pii import op5_pii
from trajens.llm.quality import op7_quality
from trajens.llm.runs import op11_periodic_runs
from trajens.llm.secretscan import op13_secrets
from trajens.llm.sharding import op6_sharding
from trajens.llm.simhash import op9_simhash
from trajens.llm.substrings import op1_suffix_dedup
from trajens.llm.tokens import op10_token_counts

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_mixing": op2_mixing,
    "op3_packing": op3_packing,
    "op4_nearest": op4_nearest,
    "op5_pii": op5_pii,
    "op6_sharding": op6_sharding,
    "op7_quality": op7_quality,
    "op8_langid": op8_langid,
    "op9_simhash": op9_simhash,
    "op10_token_counts": op10_token_counts,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_filter_audit": op12_filter_audit,
    "op13_secrets": op13_secrets,
}
ORACLE: dict[str, str] = {"op12_filter_audit": OP12_SQL}
