"""CSV sink with the single-file tool's text conventions.

Header row, no index, minimal quoting with doubled quotes, missing values as
empty fields, leading/trailing spaces kept, overwrite. Spark's CSV defaults
differ on three of these (backslash escapes, trimming, ``""`` for empty
strings), so they are set explicitly. Money is DECIMAL, so no float text
(``1.0E16``) appears.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.schema import INTERNAL_COLUMNS
from ledgerlens.sources.statement import statement_to_display

CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "emptyValue": "",
    "nullValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "encoding": "UTF-8",
}


def default_output_path(input_path: str) -> str:
    """Input path with its suffix replaced by ``.csv``; a URI keeps its scheme."""
    folder, slash, name = input_path.rstrip("/").rpartition("/")
    stem, dot, _ = name.rpartition(".")
    return f"{folder}{slash}{stem if dot and stem else name}.csv"


def write_csv(df: DataFrame, path: str, display_names: bool = True,
              partition_by_source: bool = False, sort_keys: list[str] | None = None) -> None:
    """Write the enriched statement as CSV (overwrite), without the columns
    that ingest added for its own use.

    Output is one part file per task; ``partition_by_source`` writes one
    folder per input statement instead, named by its full path. Its rows are
    brought together first, into several part files where a statement is
    large. Rows are ordered only when ``sort_keys`` is given (a range
    shuffle); part files then follow each other in that order.
    """
    out = df.drop(*INTERNAL_COLUMNS) if display_names else df
    if partition_by_source and "source_file" in out.columns:
        if sort_keys:
            out = out.repartitionByRange("source_file", *sort_keys).sortWithinPartitions("source_file", *sort_keys)
        else:  # adaptive execution splits large statements and joins small ones
            out = out.hint("rebalance", F.col("source_file"))
        out = statement_to_display(out) if display_names else out
        out.write.mode("overwrite").options(**CSV_OPTIONS).partitionBy("source_file").csv(path)
        return
    if sort_keys:
        out = out.orderBy(*sort_keys)
    if display_names:
        out = statement_to_display(out)
    out.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)
