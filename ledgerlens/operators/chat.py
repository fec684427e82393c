"""Answering one question about a statement with a model.

The data part is a Spark job: the statement is reduced to the chat context
(one row: count, date range, spend per category), rendered natively. Only
that one row reaches the driver, which then makes a single backend call
with the context as the system prompt. Each question is answered on its
own; earlier turns are not sent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerlens.operators.backends import Backend
from ledgerlens.operators.summary import chat_context

# Own wording around the rendered context.
ASSISTANT_HEAD = "The figures below come from one customer's bank statement.\n\n"
ASSISTANT_TAIL = ("\n\nReply to the customer's question from these figures alone, in a few sentences, "
                  "and say when they do not hold the answer.")


def system_prompt(df: DataFrame) -> str:
    """The system prompt for ``df`` (one small aggregate row is collected)."""
    row = chat_context(df).select("context_text").first()
    return ASSISTANT_HEAD + row["context_text"] + ASSISTANT_TAIL


def ask(df: DataFrame, question: str, backend: Backend, prompt: str | None = None) -> str:
    """One answer from ``backend``; pass ``prompt`` to reuse a built context."""
    backend.open()
    try:
        return backend.call_one(question, prompt or system_prompt(df))
    finally:
        backend.close()
