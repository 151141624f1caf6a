"""Registered queries of this subpackage and their SQL checks."""

from __future__ import annotations

from schedlake.llm.bpe import op10_byte_bpe
from schedlake.llm.embedding_dedup import OP6_SQL, op6_embedding_dedup
from schedlake.llm.exact_dedup import OP3_SQL, op3_exact_dedup
from schedlake.llm.fill_in_middle import OP13_SQL, op13_fill_in_middle
from schedlake.llm.language_id import op9_language_id
from schedlake.llm.line_dedup import OP7_SQL, op7_line_dedup
from schedlake.llm.merkle import OP12_SQL, op12_merkle_manifest
from schedlake.llm.mixing import OP1_SQL, op1_mixing
from schedlake.llm.quality import op5_quality_classifier
from schedlake.llm.sharding import op4_sharding
from schedlake.llm.simhash_dedup import op8_simhash_dedup
from schedlake.llm.substring_dedup import OP2_SQL, op2_substring_dedup
from schedlake.llm.warc import OP11_SQL, op11_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing, op2_substring_dedup, op3_exact_dedup, op4_sharding, op5_quality_classifier, op6_embedding_dedup,
        op7_line_dedup, op8_simhash_dedup, op9_language_id, op10_byte_bpe, op11_warc, op12_merkle_manifest, op13_fill_in_middle,
    )
}

#: DuckDB SQL by query, where SQL can express it.
CHECKS: dict[str, str] = {
    "op1_mixing": OP1_SQL, "op2_substring_dedup": OP2_SQL, "op3_exact_dedup": OP3_SQL, "op6_embedding_dedup": OP6_SQL,
    "op7_line_dedup": OP7_SQL, "op11_warc": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_fill_in_middle": OP13_SQL,
}
