"""Structured Streaming: enrich statement files as they arrive, follow corrected rows."""

from ledgerlens.streaming.corrections import changes_stream, current_rows, use_rocksdb_state
from ledgerlens.streaming.ingest import monthly_spend_stream, start_statement_stream

__all__ = ["start_statement_stream", "monthly_spend_stream", "changes_stream", "current_rows", "use_rocksdb_state"]
