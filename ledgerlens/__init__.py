"""ledgerlens: Spark-native bank-statement enrichment and spending analytics.

Statements are read into one validated DataFrame, remarks are cleaned and
categorised by a pluggable backend (a model behind ``mapInPandas`` or the
native rule backend), model replies are parsed with built-in column
expressions, and spending questions are answered with DataFrame aggregates.
"""

from ledgerlens.session import build_session, shared_dir

__all__ = ["build_session", "shared_dir"]
__version__ = "0.1.0"
