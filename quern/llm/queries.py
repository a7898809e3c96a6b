"""The corpus queries by name, and the same in SQL where SQL expresses them."""

from __future__ import annotations

from quern.llm.alignment import op13_token_alignment
from quern.llm.embedding import OP2_SQL, op2_embedding_near_dedup
from quern.llm.extraction import op12_html_extraction
from quern.llm.lines import OP10_SQL, op10_line_dedup
from quern.llm.manifest import OP11_SQL, op11_merkle_manifest
from quern.llm.mixing import op5_source_mixing
from quern.llm.packing import op9_best_fit_packing
from quern.llm.quality import op3_quality_rules
from quern.llm.secrets import op6_secret_scan
from quern.llm.simhash import op1_simhash_near_dedup
from quern.llm.tokens import op7_token_counts
from quern.llm.urls import op4_url_filter
from quern.llm.warc import OP8_SQL, op8_warc_archive

_ALL = (op1_simhash_near_dedup, op2_embedding_near_dedup, op3_quality_rules, op4_url_filter, op5_source_mixing, op6_secret_scan, op7_token_counts, op8_warc_archive, op9_best_fit_packing, op10_line_dedup, op11_merkle_manifest, op12_html_extraction, op13_token_alignment)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES: dict[str, str] = {"op2_embedding_near_dedup": OP2_SQL, "op8_warc_archive": OP8_SQL, "op10_line_dedup": OP10_SQL, "op11_merkle_manifest": OP11_SQL}
