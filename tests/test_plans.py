"""Physical-plan checks: pruning and pushdown reach the parquet scans, the
summaries aggregate partially before one exchange, and no broadcast is forced
on tables whose size grows with the data."""

import re

from pyspark.sql import functions as F

from ledgerlens.operators import questions, summary
from ledgerlens.plans import catalog, fixtures
from tests.conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df) -> str:
    jvm = df.sparkSession.sparkContext._jvm
    return jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(
        df._jdf.queryExecution(), "formatted")


def test_statement_scan_prunes_columns(spark):
    txt = formatted(fixtures.statement(spark, SF_SMALL))
    schemas = re.findall(r"ReadSchema: (struct<[^\n]*>)", txt)
    assert any("o_orderkey" in s and "o_orderpriority" not in s for s in schemas)
    assert any("c_name" in s and "c_mktsegment" not in s and "c_nationkey" not in s for s in schemas)


def test_statement_join_has_no_broadcast_hint(spark):
    lp = fixtures.statement(spark, SF_SMALL)._jdf.queryExecution().logical().toString()
    assert "broadcast" not in lp.lower()


def test_breakdown_reads_one_column_and_aggregates_partially(spark):
    cs = catalog.categorised_statement(spark, SF_SMALL)
    df = summary.category_breakdown(cs)
    txt = formatted(df)
    assert "ReadSchema: struct<category:string>" in txt
    assert "PushedFilters: [IsNotNull(category)]" in txt
    assert len(re.findall(r"HashAggregate", txt)) >= 2  # partial + final


def test_question_reads_a_pruned_enriched_scan(spark):
    re_df = catalog.rule_enriched(spark, SF_SMALL)
    txt = formatted(questions.spend_on(re_df, "fuel"))
    # lower(...) cannot be pushed into parquet; the filter runs right after a pruned scan.
    assert ("ReadSchema: struct<withdrawal:decimal(18,2),deposit:decimal(18,2),"
            "category:string,subcategory:string>") in txt
    assert "Filter" in txt


def test_top_categories_is_distributed_top_k(spark):
    re_df = catalog.rule_enriched(spark, SF_SMALL)
    assert "TakeOrderedAndProject" in plan(questions.top_categories(re_df, 5))


def test_parse_evaluates_json_once_per_row(spark):
    from ledgerlens.functions import with_parsed_category
    df = spark.range(10).withColumn("r", F.concat(F.lit('{"category":"'), F.col("id").cast("string"), F.lit('"}')))
    txt = plan(with_parsed_category(df, "r"))
    assert txt.count("parseJson") == 1


def test_lexicon_join_forces_no_broadcast(spark):
    from ledgerlens.operators import rules
    st = catalog.rule_enriched(spark, SF_SMALL)
    lex = rules.lexicon_frame(spark)
    df = rules.categorise_with_lexicon_table(st, lex, description="cleaned_remark")
    assert "broadcast" not in df._jdf.queryExecution().logical().toString().lower()


def test_lexicon_stands_once_in_the_plan(spark):
    """The keywords are literals of one lookup, not a chain of conditions
    copied into every consumer of the category."""
    from ledgerlens.operators.enrich import enrich_statement
    from ledgerlens.operators.rules import RuleBackend
    df = summary.category_breakdown(enrich_statement(fixtures.statement(spark, SF_SMALL), RuleBackend()))
    opt = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(_lex_norm" not in opt
    assert max(line.count("array_position") for line in opt.splitlines()) <= 6


def rows_per_task(df):
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


def test_blank_rows_are_spread_over_the_tasks(spark, tmp_path):
    """A third of all rows has no key; none of the join backs sends them to one task."""
    from ledgerlens.operators import rules
    from ledgerlens.operators.backends import ScriptedBackend
    from ledgerlens.operators.enrich import ReplyStore, clean_remarks
    from ledgerlens.plans.fixtures import REMARK_REPLIES
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        n = 12_000
        st = spark.range(n).select(F.col("id").alias("s_no"), F.when(F.col("id") % 3 > 0, F.concat(
            F.lit("r"), (F.col("id") % 4001).cast("string"))).alias("remarks"))
        done = clean_remarks(st, ScriptedBackend(REMARK_REPLIES), store=ReplyStore(spark, str(tmp_path / "a")), split_rows=100)
        sizes = rows_per_task(done)
        assert sum(sizes) == n and sizes[-1] <= 2 * n / len(sizes)
        keyed = st.withColumns({"remark_key": F.col("remarks"), "cleaned_remark": F.coalesce("remarks", F.lit(""))})
        sizes = rows_per_task(rules.remark_consensus(keyed, split_rows=100))
        assert sum(sizes) == n and sizes[-1] <= 2 * n / len(sizes)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_store_read_is_pruned_to_the_partitions_at_hand(spark, tmp_path):
    from ledgerlens.operators.backends import ScriptedBackend
    from ledgerlens.operators.enrich import ReplyStore, clean_remarks, prompt_key
    store = ReplyStore(spark, str(tmp_path / "s"))
    st = spark.range(200).select(F.col("id").alias("s_no"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("remarks"))
    clean_remarks(st, ScriptedBackend(['{"cleaned_remark":"x","notes_doubts":""}']), store=store)
    one = spark.createDataFrame([("p",)], "p string").select(prompt_key("p").alias("prompt_key"))
    txt = formatted(store.raw(one))
    assert re.search(r"PartitionFilters: \[.*key_prefix", txt)


def test_filter_on_parsed_date_keeps_one_copy_of_the_regex_work(spark):
    from ledgerlens.functions.dates import DATE_SHAPES, with_statement_date
    st = fixtures.statement(spark, SF_SMALL)
    df = with_statement_date(st).where(F.col("txn_date").isNotNull())
    opt = df._jdf.queryExecution().optimizedPlan().toString()
    # Pushed into the scan's filter the date expression is inlined; the
    # regex CASE must appear once, not once per reference (2,344 before).
    per_node = [line.count("RLIKE") for line in opt.splitlines()]
    assert max(per_node) <= 2 * len(DATE_SHAPES) and sum(per_node) <= 4 * len(DATE_SHAPES)


def test_skew_handling_of_the_joins(spark, tmp_path):
    """With AQE's skew thresholds lowered: the join back of the lexicon's
    hits is split by AQE itself; the reply join-back is not (its replies side comes
    through an aggregate), which is why hot prompts are split explicitly."""
    from ledgerlens.operators import rules
    from ledgerlens.operators.backends import ScriptedBackend
    from ledgerlens.operators.enrich import ReplyStore, clean_remarks
    from ledgerlens.plans.fixtures import REMARK_REPLIES
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)

        def final_plan(df):
            df.collect()
            return df._jdf.queryExecution().executedPlan().toString()

        ids = spark.range(30000)
        hot = F.col("id") % 3 == 0
        desc = ids.select(F.col("id").alias("s_no"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("pad"), F.when(hot, F.lit("petrol")).otherwise(
            F.concat(F.lit("w"), F.col("id").cast("string"))).alias("cleaned_remark"))
        lex = rules.categorise_with_lexicon_table(desc, rules.lexicon_frame(spark))
        assert "skew=true" in final_plan(lex)
        st = ids.select(F.col("id").alias("s_no"), F.when(hot, F.lit("HOT REMARK")).otherwise(
            F.concat(F.lit("r"), F.col("id").cast("string"))).alias("remarks"))
        b = ScriptedBackend(REMARK_REPLIES)
        unsplit = final_plan(clean_remarks(st, b, store=ReplyStore(spark, str(tmp_path / "a")), split_rows=10**9))
        assert "skew=true" not in unsplit
        split = final_plan(clean_remarks(st, b, store=ReplyStore(spark, str(tmp_path / "b")), split_rows=1000))
        assert "_salt" in split
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_scratch_scope_removes_intermediate_tables(spark):
    import os
    from ledgerlens.session import materialize_at, scratch_scope
    with scratch_scope(spark) as made:
        df, path = materialize_at(spark.range(10), "scoped")
        local = path.replace("file:", "")
        assert df.count() == 10 and os.path.isdir(local) and made == [path]
    assert not os.path.exists(local)
    kept, path2 = materialize_at(spark.range(3), "unscoped")  # outside a scope: kept
    assert os.path.isdir(path2.replace("file:", "")) and kept.count() == 3
