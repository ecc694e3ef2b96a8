"""All registered queries of the library's own operators, with their DuckDB counterparts."""

from __future__ import annotations

from leafmill.plans import queries_audit, queries_layout, queries_mapping, queries_records, queries_state, queries_text

QUERIES: dict = {**queries_text.QUERIES, **queries_records.QUERIES, **queries_audit.QUERIES, **queries_mapping.QUERIES, **queries_layout.QUERIES, **queries_state.QUERIES}
ORACLES: dict = {**queries_text.ORACLES, **queries_records.ORACLES, **queries_audit.ORACLES, **queries_mapping.ORACLES, **queries_layout.ORACLES, **queries_state.ORACLES}
FLAGSHIP = "corpus_summary"
