"""One call per remark template: slots, calls made, and the same results as one call per remark."""

import json
import os

import duckdb
from pyspark.sql import functions as F

from ledgerlens.operators import rules
from ledgerlens.operators.backends import CallableBackend, EchoBackend
from ledgerlens.operators.enrich import ReplyStore, call_missing, clean_remarks, prompt_key
from ledgerlens.operators.prompts import filled, with_remark_template
from tests.conftest import SF_SMALL

REMARKS = ["UPI/SHOP/milk/123456/ICIab9", "UPI/SHOP/milk/654321/ICIff0", "UPI/SHOP/milk/ 777777 /ICI1", "UPI/SHOP/milk", "a@b/ACME/x@y", "c@d/ACME/q@r",
           '9"9@x\\y/quote', "111111", "222222", "1234567/1234568/1234569/1234560/1234561/1234562/1234563/1234564/1234565/1234566/1234567",
           "keeps ⟦1⟧/123456", "keeps ⟦1⟧/999999", "", "  ", None, "/", "//123456//", "plain words"]


def frame(spark, remarks=REMARKS):
    return spark.createDataFrame(list(enumerate(remarks)), "s_no int, remarks string")


def store(spark, scratch, name):
    return ReplyStore(spark, f"{scratch}/{name}")


def test_templates_and_slots(spark):
    rows = {r["s_no"]: (r["_template"], r["_slots"]) for r in with_remark_template(frame(spark)).collect()}
    assert rows[0] == ("UPI/SHOP/milk/⟦1⟧/⟦2⟧", ["123456", "ICIab9"]) and rows[0][0] == rows[1][0]
    assert rows[2] == ("UPI/SHOP/milk/ ⟦1⟧ /⟦2⟧", ["777777", "ICI1"])
    assert rows[9][0].endswith("⟦10⟧/⟦11⟧") and len(rows[9][1]) == 11
    assert rows[10] == ("keeps ⟦1⟧/123456", []) and rows[14][0] is None
    df = with_remark_template(frame(spark)).where("remarks IS NOT NULL AND s_no != 6")
    assert df.where(filled(F.col("_template"), F.col("_slots")) != F.col("remarks")).isEmpty()


def test_same_results_as_one_call_per_remark(spark, scratch):
    each = clean_remarks(frame(spark), EchoBackend(), store=store(spark, scratch, "each"))
    few = store(spark, scratch, "few")
    templated = clean_remarks(frame(spark), EchoBackend(), store=few, templated=True)
    assert templated.columns == each.columns
    assert sorted(map(tuple, templated.collect()), key=repr) == sorted(map(tuple, each.collect()), key=repr)
    asked = len({r["_template"] for r in with_remark_template(frame(spark)).collect() if r["_template"] and r["_template"].strip()})
    assert few.raw().count() == asked < len({r for r in REMARKS if r and r.strip()})
    clean_remarks(frame(spark), EchoBackend(), store=few, templated=True).collect()
    assert few.raw().count() == asked


def test_as_many_calls_as_keys_without_ids(spark, scratch):
    """The statement in which every remark holds its own number and code: one call for each key left without them."""
    con = duckdb.connect()
    rows = con.sql(f"""SELECT o_orderkey, concat('UPI/', c_name, '/', ['temp rever', 'savings oc', 'petrol bik', 'milk', 'IRCTC ticket', 'rent au', 'Pay to'][o_orderkey % 7 + 1],
        '/Kotak Mahi/', lpad(CAST(o_orderkey AS VARCHAR), 12, '5'), '/ICI', md5(CAST(o_orderkey AS VARCHAR)))
        FROM '{SF_SMALL}/orders.parquet' JOIN '{SF_SMALL}/customer.parquet' ON o_custkey = c_custkey WHERE o_orderkey % 13 > 1""").fetchall()
    df = spark.createDataFrame(rows, "s_no long, remarks string")
    keys = rules.remark_tokens(df).select("remark_key").distinct().count()
    replies = store(spark, scratch, "keys")
    done = clean_remarks(df, EchoBackend(), store=replies, templated=True)
    assert done.where("cleaned_remark != concat('Seen: ', remarks)").isEmpty()
    assert replies.raw().count() == keys < len(rows)


def test_replies_without_slots_or_with_errors(spark, scratch):
    def fixed(prompt, system):
        if "SHOP" in prompt:
            raise TimeoutError("timeout")
        return json.dumps({"cleaned_remark": "no slots", "notes_doubts": "⟦2⟧ and ⟦99⟧"}, ensure_ascii=False)
    got = {r["s_no"]: (r["cleaned_remark"], r["notes_doubts"]) for r in clean_remarks(
        frame(spark), CallableBackend(fixed, "fixed"), store=store(spark, scratch, "fixed"), templated=True).collect()}
    assert got[0] == ("", "Error: timeout") and got[4] == ("no slots", "x@y and ⟦99⟧") and got[14] == ("", "")


def test_chunks_are_read_once_and_committed_in_few_files(spark, scratch):
    prompts = spark.range(400).select(F.concat(F.lit("p"), "id").alias("prompt")).select(prompt_key("prompt").alias("prompt_key"), "prompt")
    replies = store(spark, scratch, "chunks")
    commits = []
    append = replies.append

    def watched(df):
        files = {r[0] for r in df.select(F.col("prompt_key")).limit(0).collect()}  # the plan is valid
        before = files | set(listed(replies.path))
        append(df)
        commits.append((set(listed(replies.path)) - before, df.inputFiles()))
    replies.append = watched
    call_missing(prompts, EchoBackend(), None, replies, chunk_prompts=40)
    assert replies.raw().select("prompt_key").distinct().count() == replies.raw().count() == 400
    assert len(commits) == 10 and all(0 < len(made) <= 16 for made, _ in commits)
    read = [f for _, files in commits for f in files]
    assert len(read) == len(set(read)) and all("chunk=" in f for f in read)


def listed(path):
    return [f"{d}/{f}" for d, _, files in os.walk(path) for f in files if f.endswith(".parquet")]


def test_templates_against_plain_python(spark):
    import re
    texts = ["", "   ", "/", "//", " 1234567 /x", "a/ 123456/ICIab01 /p q@r s/", "12345/1234567x/ICIxyz/ICI/x ICIab", "@", " @ /a @ b/ / 000000",
             "UPI/a@b/c@d/e@f", "1234567", "⟦1⟧/1234567/a@b", "$1/1234567/$3", "x/\t1234567/ICIAB", "123456\n/x", "a@b\nc/999999"]
    got = {r["i"]: (r["_template"], r["_slots"]) for r in with_remark_template(
        spark.createDataFrame(list(enumerate(texts)), "i int, remarks string")).collect()}
    for i, text in enumerate(texts):
        parts, slots = [], []
        for p in text.split("/"):
            core = p.strip(" ")
            if not re.search(r"^[0-9]{6,}$|^ICI[0-9a-fA-F]+$|@", core) or "⟦" in text:
                parts.append(p)
                continue
            slots.append(core)
            parts.append(p[:len(p) - len(p.lstrip(" "))] + f"⟦{len(slots)}⟧" + p[len(p.rstrip(" ")):])
        assert got[i] == ("/".join(parts), slots), text


def test_no_regex_runs_inside_a_lambda(spark):
    # A regex per part, in a lambda that is inlined wherever the template is read, was most of the query's time.
    plan = with_remark_template(frame(spark)).where(F.col("_template").isNotNull())._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and "rlike" not in plan.lower()
