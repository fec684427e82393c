"""Short forms and synonyms as tables: closure, longest match, cycles, length."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import rules, wordlists


def entries(spark, rows):
    return spark.createDataFrame(rows, "key string, value string")


def test_chains_are_followed_to_their_end(spark):
    chain = [(f"K{i}", f"k{i + 1}") for i in range(37)]
    got = {r["key"]: r["value"] for r in wordlists.closed(entries(spark, chain + [
        ("gas", "FUEL"), ("fuel", "Fuel"), ("gas", "FUEL"), (None, "x"), ("  ", "y"), ("z", None), (" petrol ", "gas")])).collect()}
    assert got == {f"k{i}": "k37" for i in range(37)} | {"gas": "Fuel", "fuel": "Fuel", "petrol": "Fuel"}
    assert wordlists.closed(entries(spark, [])).collect() == []


@pytest.mark.parametrize("length", [2, 3, 4, 7])
def test_cycles_are_errors(spark, length):
    ring = [(f"c{i}", f"C{(i + 1) % length}") for i in range(length)]
    with pytest.raises(ValueError, match="lead back.*c0"):
        wordlists.closed(entries(spark, ring + [("into", "c0"), ("a", "b")]))


def test_two_values_and_slashes_are_errors(spark):
    with pytest.raises(ValueError, match="several values: oc"):
        wordlists.closed(entries(spark, [("oc", "October"), ("OC", "occasion")]))
    with pytest.raises(ValueError, match="slash"):
        wordlists.expand_short_forms(spark.createDataFrame([("a",)], "t string"), "t", entries(spark, [("a", "b/c")]), "e")


def plain(text, table):
    if text is None:
        return None
    words, out, i = text.replace("/", " / ").split(" "), [], 0
    while i < len(words):
        for size in range(len(words) - i, 0, -1):
            value = table.get(" ".join(words[i:i + size]).lower())
            if value is not None:
                out.append(value)
                i += size
                break
        else:
            out.append(words[i])
            i += 1
    return " ".join(out).replace(" / ", "/")


def test_longest_match_from_the_left_against_plain_python(spark):
    rng = random.Random(4)
    words = ["oc", "Temp", "rever", "a", "b", "c", "", "/", "É"]
    table = {"oc": "October", "temp rever": "temporary reversal", "temp": "temporary", "a b c": "ABC", "a b": "AB", "b c a": "bca", "é": "e acute"}
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 9))).replace(" / ", "/") for _ in range(400)] + [None, "", "/", "oc", "OC/oc"]
    texts += ["a b c oc"] * 300
    df = spark.createDataFrame([(i, t, "x", "x") for i, t in enumerate(texts)], "i int, t string, key string, value string")
    got = wordlists.expand_short_forms(df, "t", entries(spark, list(table.items())), "e", split_rows=50)
    assert got.columns == ["i", "t", "key", "value", "e"]
    assert {r["i"]: r["e"] for r in got.collect()} == {i: plain(t, table) for i, t in enumerate(texts)}


def test_the_fixed_list_as_a_table_reads_as_today(spark):
    rng = random.Random(8)
    parts = ["UPI", "ACME", "temp rever", "savings oc", "rent au", "petrol bik", "BIK", "milk", "pay to x", "123456789", "ICIab12", "a@b", "", " rever ", "Paytm"]
    remarks = ["/".join(rng.choices(parts, k=rng.randint(1, 6))) for _ in range(500)] + [None, "", "  "]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(remarks)], "s_no int, remarks string")
    cols = ["s_no", "purpose", "party", "cleaned_remark", "notes_doubts", "reading_rule", "remark_key"]
    today = rules.read_remark(df).select(*cols).collect()
    table = rules.read_remark(df, short_forms=entries(spark, rules.ABBREVIATIONS)).select(*cols).collect()
    assert sorted(map(tuple, table)) == sorted(map(tuple, today))


def test_fixed_synonyms_as_a_table(spark):
    names = ["Petrol", "GAS", "Fuel", "food", None, "", "Other"] * 5
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, category string")
    want = {r["i"]: r["c"] for r in df.select("i", rules.canonical_category("category").alias("c")).collect()}
    got = wordlists.canonicalise(df, "category", entries(spark, rules.CATEGORY_SYNONYMS), split_rows=3)
    assert got.columns == ["i", "category"]
    assert {r["i"]: r["category"] for r in got.collect()} == want


def test_long_lists_do_not_grow_the_plan(spark):
    def plan(n):
        table = spark.range(n).select(F.concat(F.lit("w"), "id").alias("key"), F.concat(F.lit("word "), "id").alias("value"))
        df = spark.range(2000).select("id", F.concat(F.lit("pay w"), F.col("id") * 50, F.lit(" now")).alias("t"))
        out = wordlists.expand_short_forms(df, "t", table, "e")
        assert out.where("e = concat('pay word ', id * 50, ' now')").count() == min(2000, -(-n // 50))
        return len(out._jdf.queryExecution().optimizedPlan().toString())
    assert plan(100_000) < 1.1 * plan(100)
