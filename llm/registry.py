"""Queries of this subpackage, by name, and the SQL that DuckDB can hold them against."""

from __future__ import annotations

from .bpe_stream import op6_bpe_stream
from .chat_format import OP8_SQL, op8_chat_format
from .decontaminate import op5_decontaminate
from .ftrl_toxicity import op4_toxicity
from .jaccard_join import op1_jaccard_join
from .quality_rules import op7_quality_rules
from .run_index import op11_run_index
from .secrets_forest import op9_secret_scan
from .sharding import OP2_SQL, op2_sharding
from .spelling_variants import OP12_SQL, op12_spelling_variants
from .token_codes import op3_token_codes
from .whitening import op13_whitening
from .zstd_quality import op10_zstd_quality

QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_sharding": op2_sharding,
    "op3_token_codes": op3_token_codes,
    "op4_toxicity": op4_toxicity,
    "op5_decontaminate": op5_decontaminate,
    "op6_bpe_stream": op6_bpe_stream,
    "op7_quality_rules": op7_quality_rules,
    "op8_chat_format": op8_chat_format,
    "op9_secret_scan": op9_secret_scan,
    "op10_zstd_quality": op10_zstd_quality,
    "op11_run_index": op11_run_index,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op2_sharding": OP2_SQL,
    "op8_chat_format": OP8_SQL,
    "op12_spelling_variants": OP12_SQL,
}
