"""Statement sources (derived test statement, parquet/CSV/workbook files) and the CSV sink."""

from ledgerlens.sources.statement import (derive_statement, normalize_statement,
                                          read_statements, statement_to_display)
from ledgerlens.sources.sink import default_output_path, write_csv

__all__ = ["derive_statement", "normalize_statement", "read_statements",
           "statement_to_display", "write_csv", "default_output_path"]
