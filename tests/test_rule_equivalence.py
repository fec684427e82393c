"""The remark rules use regex built-ins (generated code) for part splitting,
short-form expansion and purpose detection. This checks them against the
plain lambda formulation of the same rules on generated remarks."""

import random

from pyspark.sql import functions as F

from ledgerlens.operators import rules

PIECES = ["UPI", "neft", "IMPS", "SHAIK NIYA", "temp rever", "TEMP Rever", "savings oc", "Savings OC",
          "petrol bik", "milk", "IRCTC ticket", "rent au", "Pay to", "Kotak Mahi", "563842971184",
          "ICIf635d23e", "abc@ybl", "", "  ", " milk ", "x milk y", "milkshake", "rever-sal", "bik  ride",
          "groceries\tbill", "Google Pay", "refund", "au au", "oc", "12345", "fees EMI"]


def _old_expand(text):
    m = F.create_map(*[F.lit(x) for kv in rules.ABBREVIATIONS for x in kv])
    return F.array_join(F.transform(F.split(text, " "),
                                    lambda w: F.coalesce(F.try_element_at(m, F.lower(w)), w)), " ")


def _old_purpose(parts_col, has_col, kept_col):
    purpose_words = F.array(*[F.lit(w) for w in rules.PURPOSE_WORDS])
    cand = F.when(has_col, F.slice(kept_col, 2, F.size(kept_col))).otherwise(kept_col)
    hit = F.filter(cand, lambda p: F.arrays_overlap(F.split(F.lower(_old_expand(p)), " "), purpose_words))
    return _old_expand(F.try_element_at(hit, F.lit(1)))


def test_regex_rules_equal_lambda_rules(spark):
    rnd = random.Random(7)
    remarks = ["/".join(rnd.choice(PIECES) for _ in range(rnd.randint(1, 7))) for _ in range(3000)]
    remarks += [" " + r + " " for r in remarks[:300]] + ["", "   ", "/", "//", "UPI/", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(remarks)], "id int, remarks string")
    new = rules.remark_tokens(df)
    text = F.coalesce(F.col("remarks"), F.lit(""))
    old_parts = F.transform(F.split(text, "/"), lambda p: F.trim(p))
    first = F.upper(F.try_element_at(old_parts, F.lit(1)))
    has = first.isin(*rules.CHANNELS) & (F.size(old_parts) > 1)
    rest = F.when(has, F.slice(old_parts, 2, F.size(old_parts))).otherwise(old_parts)
    kept = F.filter(rest, lambda p: (p != "") & ~p.rlike(rules.ID_PATTERN))
    old = df.select("id", old_parts.alias("parts"), _old_purpose(old_parts, has, kept).alias("old_purpose"),
                    _old_expand(F.col("remarks")).alias("old_expanded"))
    got = (new.join(old, "id")
           .select("id", "remarks", "purpose", "old_purpose",
                   F.split(F.trim(text), " */ *").alias("new_parts"), "parts",
                   rules.expand_words(F.col("remarks")).alias("new_expanded"), "old_expanded"))
    live = ~F.col("remarks").isNull() & (F.trim(F.col("remarks")) != "")
    bad = got.where(F.when(live, ~F.col("purpose").eqNullSafe(F.col("old_purpose"))).otherwise(False)
                    | ~F.col("new_parts").eqNullSafe(F.col("parts"))
                    | ~F.col("new_expanded").eqNullSafe(F.col("old_expanded"))).limit(5).collect()
    assert bad == []
