"""Enrichment: calls paid once, blank rows skipped, dedupe invariance, error capture."""

import os
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from ledgerlens.operators.backends import Backend, ScriptedBackend
from ledgerlens.operators.enrich import ReplyStore, categorise, clean_remarks, enrich_statement
from ledgerlens.operators.rules import RuleBackend
from ledgerlens.plans.fixtures import CATEGORY_REPLIES, REMARK_REPLIES


class CountingBackend(Backend):
    """Echo backend that records every prompt it is called with in a file."""

    name = "counting"

    def __init__(self, log_path):
        self.log_path = log_path

    def describe(self):
        return {"name": self.name, "log": self.log_path}

    def call_one(self, prompt, system_prompt):
        with open(self.log_path, "a") as f:
            f.write(prompt.replace("\n", " ") + "\n")
        if "boom" in prompt:
            raise RuntimeError("backend down")
        word = prompt.split("Transaction Remark: ")[-1].split("\n")[0]
        return '{"cleaned_remark": "%s", "notes_doubts": ""}' % word.upper()


# The test backend lives in this module; ship it to workers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _calls(path):
    return open(path).read().splitlines() if os.path.exists(path) else []


def _statement(spark):
    rows = [(1, "milk"), (2, "milk"), (3, "   "), (4, None), (5, "rent"), (6, "boom")]
    return spark.createDataFrame(rows, "s_no bigint, remarks string").withColumns(
        {"withdrawal": F.lit(100).cast("decimal(18,2)"), "deposit": F.lit(None).cast("decimal(18,2)")})


def test_calls_once_per_distinct_prompt_and_never_for_blanks(spark, scratch):
    log = os.path.join(scratch, "calls.log")
    b = CountingBackend(log)
    store = ReplyStore(spark, os.path.join(scratch, "store"))
    out = clean_remarks(_statement(spark), b, store=store)
    res = {r["s_no"]: (r["cleaned_remark"], r["notes_doubts"]) for r in out.collect()}
    out.count()  # a second action must not call the backend again
    assert len(_calls(log)) == 3  # milk, rent, boom
    assert res[1] == res[2] == ("MILK", "—")
    assert res[3] == ("", "") and res[4] == ("", "")
    assert res[6] == ("", "Error: backend down")
    # Re-running against the same store repeats the failed call only.
    clean_remarks(_statement(spark), b, store=store).collect()
    assert len(_calls(log)) == 4 and _calls(log)[-1].count("boom") == 1


def test_dedupe_off_calls_per_row_same_result(spark, scratch):
    log = os.path.join(scratch, "calls.log")
    b = CountingBackend(log)
    on = clean_remarks(_statement(spark), b, store=ReplyStore(spark, os.path.join(scratch, "s1")))
    off = clean_remarks(_statement(spark), b, store=ReplyStore(spark, os.path.join(scratch, "s2")), dedupe=False,
                        row_key=["s_no"])
    assert sorted(on.collect()) == sorted(off.collect())
    assert len(_calls(log)) == 3 + 4


def test_two_stage_row_count_and_domains(spark, scratch):
    st = _statement(spark)
    out = enrich_statement(st, ScriptedBackend(REMARK_REPLIES), ScriptedBackend(CATEGORY_REPLIES))
    rows = out.collect()
    assert len(rows) == st.count()
    assert all(r["confidence"] in ("High", "Medium", "Low") for r in rows)
    assert all(r["category"] for r in rows)
    for r in rows:
        if r["cleaned_remark"] == "":
            assert (r["category"], r["subcategory"], r["confidence"]) == ("Unclear", "", "Low")


def test_same_result_for_1_and_8_partitions(spark):
    st = _statement(spark)
    b = RuleBackend()
    one = enrich_statement(st.coalesce(1), b).collect()
    eight = enrich_statement(st.repartition(8), b).collect()
    assert sorted(one) == sorted(eight)


def test_category_prompt_uses_cleaned_column_even_when_empty(spark, scratch):
    log = os.path.join(scratch, "calls.log")
    df = spark.createDataFrame([(1, "milk", "")], "s_no bigint, remarks string, cleaned_remark string")
    out = categorise(df, CountingBackend(log), store=ReplyStore(spark, os.path.join(scratch, "s"))).first()
    assert (out["category"], out["subcategory"], out["confidence"]) == ("Unclear", "", "Low")
    assert _calls(log) == []


def test_settings_from_env():
    from ledgerlens.operators.backends import ChatHttpBackend, Settings
    s = Settings.from_env(env={"LEDGERLENS_MODEL": "m", "LEDGERLENS_TEMPERATURE": "0.3"})
    assert (s.model, s.temperature, s.max_concurrency) == ("m", 0.3, 10)
    b = ChatHttpBackend.from_settings(s)
    assert b.model == "m" and b.fingerprint() != ChatHttpBackend.from_settings(Settings()).fingerprint()


def test_ask_sends_context_as_system_prompt(spark, scratch):
    from ledgerlens.operators.backends import CallableBackend
    from ledgerlens.operators.chat import ask
    seen = {}

    def fn(prompt, system):
        seen["system"] = system
        return "answer to " + prompt

    df = spark.createDataFrame([(1, "01/02/2024", 10, "Food")],
                               "s_no bigint, txn_date_raw string, withdrawal int, category string")
    df = df.withColumn("withdrawal", df.withdrawal.cast("decimal(18,2)"))
    assert ask(df, "how much on food?", CallableBackend(fn, "answers")) == "answer to how much on food?"
    assert "- Food: ₹10.00" in seen["system"] and "- Total Transactions: 1" in seen["system"]


def test_job_entry_point(spark, scratch, capsys):
    from ledgerlens.__main__ import main
    from tests.xlsx_fixture import write_xlsx
    from ledgerlens.schema import REQUIRED_COLUMNS
    path = os.path.join(scratch, "stmt.xlsx")
    write_xlsx(path, REQUIRED_COLUMNS, [
        [1, "01/02/2024", "UPI/A SHOP/a@x/milk/HDFC/563800000001/ICIab", 40, None, 100],
        [2, "02/02/2024", "UPI/B/b@x/petrol bik/HDFC/563800000002/ICIcd", 500, None, 60]])
    assert main([path]) == 0
    out = capsys.readouterr().out
    assert "Total Transactions: 2" in out and "Groceries: 1" in out and "Fuel: 1" in out
    assert os.path.isdir(os.path.join(scratch, "stmt.csv"))
    assert main([os.path.join(scratch, "missing.xlsx")]) == 1


class InFlightBackend(Backend):
    """Records how many calls are in flight at once, across tasks and
    threads, in a counter file guarded by an OS file lock."""

    name = "in-flight"

    def __init__(self, path):
        self.path = path

    def describe(self):
        return {"name": self.name, "path": self.path}

    def _bump(self, delta):
        import fcntl
        with open(self.path, "a+") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            f.seek(0)
            now, peak = (int(x) for x in (f.read().split() or ["0", "0"]))
            now += delta
            f.seek(0)
            f.truncate()
            f.write(f"{now} {max(peak, now)}")

    def call_one(self, prompt, system_prompt):
        import time
        self._bump(1)
        try:
            time.sleep(0.05)
            return '{"cleaned_remark": "x", "notes_doubts": ""}'
        finally:
            self._bump(-1)


def test_global_concurrency_cap_holds(spark, scratch):
    path = os.path.join(scratch, "inflight")
    rows = [(i, f"remark {i}") for i in range(64)]
    df = spark.createDataFrame(rows, "s_no bigint, remarks string")
    store = ReplyStore(spark, os.path.join(scratch, "store"))
    out = clean_remarks(df, InFlightBackend(path), store=store, max_concurrency=4, partitions=2)
    assert out.where("cleaned_remark = 'x'").count() == 64
    now, peak = (int(x) for x in open(path).read().split())
    assert now == 0 and 2 <= peak <= 4  # 2 tasks x 2 threads, never more


def test_remarks_column_is_required(spark):
    import pytest
    df = spark.createDataFrame([(1, "x")], "s_no bigint, other string")
    with pytest.raises(ValueError):
        clean_remarks(df, ScriptedBackend(REMARK_REPLIES))


def test_http_backend_sends_system_message_only_when_given(monkeypatch):
    import io
    import json
    import urllib.request
    from ledgerlens.operators.backends import ChatHttpBackend
    sent = []

    class Resp(io.BytesIO):
        def __enter__(self):
            return self

        def __exit__(self, *a):
            return False

    def fake_urlopen(req, timeout):
        sent.append(json.loads(req.data))
        return Resp(json.dumps({"message": {"content": "ok"}}).encode())

    monkeypatch.setattr(urllib.request, "urlopen", fake_urlopen)
    b = ChatHttpBackend("http://model:1", "m", temperature=0.1)
    assert b.call_one("hello", None) == "ok"
    assert b.call_one("hello", "be brief") == "ok"
    assert [m["role"] for m in sent[0]["messages"]] == ["user"]
    assert [m["role"] for m in sent[1]["messages"]] == ["system", "user"]
    assert sent[1]["options"]["temperature"] == 0.1 and sent[1]["stream"] is False


def test_hot_prompt_is_split_and_results_unchanged(spark, scratch):
    from ledgerlens.operators.joins import hot_keys
    rows = [(i, "HOT REMARK" if i % 3 == 0 else f"remark {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "s_no bigint, remarks string")
    b = ScriptedBackend(REMARK_REPLIES)
    plain = clean_remarks(df, b, store=ReplyStore(spark, os.path.join(scratch, "a")))
    split = clean_remarks(df, b, store=ReplyStore(spark, os.path.join(scratch, "b")), split_rows=100)
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in plan  # the join runs on (key, salt)
    key = lambda r: (r["s_no"], r["cleaned_remark"], r["notes_doubts"])
    assert sorted(map(key, plain.collect())) == sorted(map(key, split.collect()))
    assert split.count() == 3000
    counts = spark.createDataFrame([("a", 1000), ("b", 50), ("c", 301)], "k string, n long")
    assert sorted(map(tuple, hot_keys(counts, "k", split_rows=100).collect())) == [("a", 10), ("c", 4)]


def test_reply_store_read_is_restricted_to_the_prompts_at_hand(spark, scratch):
    from ledgerlens.operators.enrich import prompt_key
    store = ReplyStore(spark, os.path.join(scratch, "store"))
    rows = spark.createDataFrame([(f"p{i}", f"r{i}", None, "run", i) for i in range(500)],
                                 "prompt string, response string, error string, run_id string, written_at bigint")
    key = prompt_key("prompt")
    store.append(rows.select(key.alias("prompt_key"), "*", F.substring(F.lower(F.hex(key)), 1, 1).alias("key_prefix")))
    keys = spark.createDataFrame([("p7",), ("p9",), ("absent",)], "prompt string").select(
        prompt_key("prompt").alias("prompt_key"))
    got = store.replies_by_key(keys)
    assert "LeftSemi" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["response"] for r in got.collect()) == ["r7", "r9"]


def test_failed_calls_are_made_again_and_answers_are_not(spark, scratch):
    st = _statement(spark)
    store = ReplyStore(spark, os.path.join(scratch, "store"))
    broken = clean_remarks(st, ScriptedBackend([None]), store=store).collect()
    assert {r["notes_doubts"] for r in broken if r["s_no"] in (1, 2, 5, 6)} == {"Error: timeout"}
    log = os.path.join(scratch, "calls.log")
    healthy = {r["s_no"]: r["cleaned_remark"] for r in clean_remarks(st, CountingBackend(log), store=store).collect()}
    assert healthy[1] == "MILK" and healthy[5] == "RENT" and len(_calls(log)) == 3
    clean_remarks(st, CountingBackend(log), store=store).collect()
    assert len(_calls(log)) == 4  # only the one that fails


def test_stores_are_named_by_backend_label_and_system_prompt(spark):
    import pytest
    from ledgerlens.operators.backends import CallableBackend
    one, two = CallableBackend(lambda p, s: "a", "one"), CallableBackend(lambda p, s: "b", "two")
    paths = {ReplyStore.default(spark, b, "remark", s).path for b in (one, two) for s in ("x", "y")}
    assert len(paths) == 4
    with pytest.raises(ValueError):
        CallableBackend(lambda p, s: "a", "")


def test_one_call_per_row_gives_each_row_its_own_reply(spark, scratch):
    import pytest
    log = os.path.join(scratch, "n")

    class Counter(Backend):
        name = "counter"

        def call_one(self, prompt, system_prompt):
            with open(log, "a") as f:
                f.write("x\n")
                n = f.tell() // 2
            return '{"cleaned_remark": "reply %d", "notes_doubts": ""}' % n

    df = spark.createDataFrame([(i, "same") for i in range(20)], "s_no bigint, remarks string").coalesce(1)
    store = ReplyStore(spark, os.path.join(scratch, "store"))
    got = clean_remarks(df, Counter(), store=store, dedupe=False, row_key=["s_no"], max_concurrency=1).collect()
    assert len({r["cleaned_remark"] for r in got}) == 20
    with pytest.raises(ValueError):
        clean_remarks(df, Counter(), store=store, dedupe=False)


def test_calls_are_committed_in_chunks_within_the_cap(spark, scratch):
    path = os.path.join(scratch, "inflight")
    df = spark.createDataFrame([(i, f"remark {i}") for i in range(48)], "s_no bigint, remarks string")
    store = ReplyStore(spark, os.path.join(scratch, "store"))
    out = clean_remarks(df, InFlightBackend(path), store=store, max_concurrency=2, chunk_prompts=10)
    assert out.where("cleaned_remark = 'x'").count() == 48
    assert int(open(path).read().split()[1]) <= 2
    assert store.raw().select("written_at").distinct().count() >= 5


def test_commits_of_a_large_run_are_bounded(spark, scratch):
    from ledgerlens.operators.enrich import call_missing, prompt_key
    prompts = spark.range(60).select(F.concat(F.lit("p"), "id").alias("prompt")).select(prompt_key("prompt").alias("prompt_key"), "prompt")
    store = ReplyStore(spark, os.path.join(scratch, "store"))
    commits, append = [], store.append
    store.append = lambda df: (append(df), commits.append(1))
    call_missing(prompts, ScriptedBackend(["x"]), None, store, chunk_prompts=1, most_commits=4)
    assert len(commits) == 4
    assert store.raw().count() == store.raw().select("prompt_key").distinct().count() == 60


def test_unparseable_amount_is_unclear_without_a_call(spark, scratch):
    log = os.path.join(scratch, "calls.log")
    df = spark.createDataFrame([(1, "petrol", True), (2, "petrol", False)], "s_no int, remarks string, amount_unparseable boolean")
    for backend in (RuleBackend(), CountingBackend(log)):
        got = {r["s_no"]: (r["category"], r["subcategory"], r["confidence"]) for r in categorise(df, backend).collect()}
        assert got[1] == ("Unclear", "", "Low")
    assert len(_calls(log)) == 1


class SystemPromptBackend(Backend):
    """Replies with a fixed object and records each distinct system prompt."""

    name = "system-prompt"

    def __init__(self, path, reply):
        self.path = path
        self.reply = reply

    def describe(self):
        return {"name": self.name, "path": self.path}

    def call_one(self, prompt, system_prompt):
        with open(self.path, "a") as f:
            f.write((system_prompt or "").replace("\n", " ")[:60] + "\n")
        return self.reply


def test_rows_come_back_once_each_and_stages_send_their_system_prompts(spark, scratch):
    from ledgerlens.operators.prompts import CATEGORY_SYSTEM_PROMPT, REMARK_SYSTEM_PROMPT
    rows = [(i, f"remark {i % 7}" if i % 5 else "  ", i * 1.5) for i in range(200)]
    df = spark.createDataFrame(rows, "s_no bigint, remarks string, extra double").withColumns(
        {"withdrawal": F.lit(10).cast("decimal(18,2)"), "deposit": F.lit(None).cast("decimal(18,2)")})
    log1, log2 = os.path.join(scratch, "s1"), os.path.join(scratch, "s2")
    out = enrich_statement(
        df, SystemPromptBackend(log1, '{"cleaned_remark": "x", "notes_doubts": ""}'),
        SystemPromptBackend(log2, '{"category": "Bills", "subcategory": "", "confidence": "High"}'))
    got = sorted((r["s_no"], r["extra"]) for r in out.collect())
    assert got == sorted((i, i * 1.5) for i in range(200))  # each input row once, own columns
    assert set(_calls(log1)) == {REMARK_SYSTEM_PROMPT.replace("\n", " ")[:60]}    # C3
    assert set(_calls(log2)) == {CATEGORY_SYSTEM_PROMPT.replace("\n", " ")[:60]}
