"""Batch job: read statements, enrich, write CSV, print the summary.

    spark-submit -m ledgerlens statements/ -o out.csv [--format xlsx] [--backend rules|http]
    python -m ledgerlens statement.xlsx            # output: statement.csv

With ``--backend http`` the model server is taken from ``LEDGERLENS_MODEL_URL``
/ ``LEDGERLENS_MODEL`` (see ``backends.Settings``). ``--ask`` answers one
question with the same backend after the summary.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from ledgerlens.operators import summary
from ledgerlens.operators.backends import ChatHttpBackend, Settings
from ledgerlens.operators.enrich import enrich_statement
from ledgerlens.operators.rules import RuleBackend
from ledgerlens.session import build_session, materialize, scratch_scope
from ledgerlens.sources import default_output_path, read_statements, write_csv


def _work_folder(output: str) -> dict:
    """Where a local run without ``spark.checkpoint.dir`` keeps its replies: beside the output, so that the
    next run finds what this one has paid for. A cluster's or an open session's own setting stands."""
    session = SparkSession.getActiveSession()
    if "PYSPARK_GATEWAY_PORT" in os.environ or (session and session.conf.get("spark.checkpoint.dir", None)):
        return {}
    return {"spark.checkpoint.dir": os.path.abspath(output) + ".work"}


def main(argv=None) -> int:
    p = argparse.ArgumentParser(prog="ledgerlens", description="Enrich and summarise bank statements")
    p.add_argument("inputs", nargs="+", help="statement files or folders")
    p.add_argument("-o", "--output", help="output CSV folder (default: first input with .csv)")
    p.add_argument("--format", default=None, choices=["xlsx", "parquet", "csv"])
    p.add_argument("--backend", default="rules", choices=["rules", "http"])
    p.add_argument("--master", default=None)
    p.add_argument("--ask", default=None, help="one question to answer after the summary")
    a = p.parse_args(argv)
    fmt = a.format or ("xlsx" if a.inputs[0].lower().endswith(".xlsx") else "parquet")
    output = a.output or default_output_path(a.inputs[0])
    spark = build_session(a.master, extra=_work_folder(output))
    try:
        with scratch_scope(spark):  # intermediate tables go when the job ends; replies stay
            settings = Settings.from_env()
            backend = RuleBackend() if a.backend == "rules" else ChatHttpBackend.from_settings(settings)
            st = read_statements(spark, a.inputs, fmt=fmt)
            kw = {} if a.backend == "rules" else {
                "remark": {"max_concurrency": settings.max_concurrency},
                "category": {"max_concurrency": settings.max_concurrency}}
            out = materialize(enrich_statement(st, backend, **kw), "enriched")
            write_csv(out.drop("source_file") if len(a.inputs) == 1 else out, output)
            for r in summary.summary_report(out).toLocalIterator():  # a partition at a time, not all at once
                print(f"{r['section']:<22} {r['label']}: {r['value']}")
            q = summary.quality_counts(out).first()
            if q["unparseable_amounts"] or q["unparsed_dates"]:
                print(f"Not read: {q['unparseable_amounts']} amounts, {q['unparsed_dates']} dates of {q['rows']} rows", file=sys.stderr)
            if a.ask:
                from ledgerlens.operators.chat import ask
                qb = backend if isinstance(backend, ChatHttpBackend) else ChatHttpBackend.from_settings(settings)
                print(ask(out, a.ask, qb))
    except (FileNotFoundError, ValueError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
