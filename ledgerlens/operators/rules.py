"""Rule backend: the reading and categorising rules that the model is asked
to follow, as deterministic native column logic (no network, no Python per
row). It is an approximation of what a model would answer, not parity.

Remark reading: split on ``/``, drop ids/handles/codes, expand short forms,
find a purpose part, then prefer purpose > party > app > reference number.
Categorising: whole-word lexicon match on the description, direction rules
for credits, a small-amount rule for named payees, else Unclear.

Small fixed lexicons are looked up inside the expression (no join). A user
lexicon above ``INLINE_LEXICON_LIMIT`` entries goes through a join on n-grams
of the distinct descriptions (:func:`categorise_with_lexicon_table`), with the
same answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import as_text, is_blank
from ledgerlens.operators.backends import NativeBackend
from ledgerlens.schema import AMOUNT_UNPARSEABLE, MONEY, description_column

# ---------------------------------------------------------------- fixed values
# Payment channels that open a structured remark.
CHANNELS = ["UPI", "NEFT", "IMPS"]
# Parts that are ids, handles or bank codes and carry no meaning.
ID_PATTERN = r"^[0-9]{6,}$|^ICI[0-9a-fA-F]+$|@"
REFERENCE_PATTERN = r"^[0-9]{6,}$"
# Short forms and their expansions.
ABBREVIATIONS = [("oc", "October"), ("au", "August"), ("rever", "reversal"),
                 ("bik", "bike"), ("temp", "temporary")]
# Payment apps, in lookup order.
PLATFORMS = ["Google Pay", "Paytm", "BharatPe", "Amazon Pay", "IRCTC"]
# Payment verbs, in lookup order, with the phrase used in the cleaned remark.
PAYMENT_VERBS = [("payment fr", "Payment from"), ("pay to", "Payment to"),
                 ("refund", "Refund from"), ("transfer", "Transfer to")]
# Words that name what a payment was for (matched after expansion).
PURPOSE_WORDS = ["rent", "milk", "grocery", "groceries", "ticket", "savings", "reversal",
                 "refund", "petrol", "diesel", "fuel", "bike", "electricity", "recharge",
                 "salary", "medicine", "food", "bill", "fees", "emi", "insurance"]
# Notes for each reading rule.
NOTE_PURPOSE = "—"
NOTE_PARTY = "Purpose not stated; read from the party name"
NOTE_PLATFORM = "Only the payment app is known"
NOTE_REFERENCE = "Only a reference number is present"
NOTE_NONE = "Remark could not be interpreted"

# Category lexicon: (keyword, category, subcategory, kind, direction), in
# priority order (first hit wins). kind 'purpose' gives High confidence,
# 'vendor' Medium. direction 'credit'/'debit' entries need a deposit/withdrawal.
LEXICON = [
    ("petrol", "Fuel", "Petrol", "purpose", "any"),
    ("diesel", "Fuel", "Diesel", "purpose", "any"),
    ("fuel", "Fuel", "", "purpose", "any"),
    ("salary", "Salary", "", "purpose", "credit"),
    ("refund", "Refund", "", "purpose", "any"),
    ("reversal", "Refund", "", "purpose", "any"),
    ("cashback", "Refund", "", "purpose", "any"),
    ("savings", "Savings Transfer", "", "purpose", "any"),
    ("self transfer", "Internal Transfer", "", "purpose", "any"),
    ("own account", "Internal Transfer", "", "purpose", "any"),
    ("atm", "Cash Withdrawal", "", "purpose", "debit"),
    ("cash withdrawal", "Cash Withdrawal", "", "purpose", "debit"),
    ("family", "Family Support", "", "purpose", "credit"),
    ("invoice", "Work Credit", "", "purpose", "credit"),
    ("freelance", "Work Credit", "", "purpose", "credit"),
    ("railway", "Travel", "Train", "purpose", "any"),
    ("train", "Travel", "Train", "purpose", "any"),
    ("ticket", "Travel", "Train", "purpose", "any"),
    ("flight", "Travel", "Flight", "purpose", "any"),
    ("bus", "Travel", "Bus", "purpose", "any"),
    ("cab", "Travel", "Cab", "purpose", "any"),
    ("metro", "Travel", "Metro", "purpose", "any"),
    ("auto", "Travel", "Auto", "purpose", "any"),
    ("milk", "Groceries", "Dairy", "purpose", "any"),
    ("vegetables", "Groceries", "Vegetables", "purpose", "any"),
    ("fruits", "Groceries", "Fruits", "purpose", "any"),
    ("meat", "Groceries", "Meat", "purpose", "any"),
    ("grains", "Groceries", "Grains", "purpose", "any"),
    ("grocery", "Groceries", "Ration", "purpose", "any"),
    ("groceries", "Groceries", "Ration", "purpose", "any"),
    ("ration", "Groceries", "Ration", "purpose", "any"),
    ("coffee", "Food & Beverage", "Beverage", "purpose", "any"),
    ("tea", "Food & Beverage", "Beverage", "purpose", "any"),
    ("snacks", "Food & Beverage", "Snacks", "purpose", "any"),
    ("restaurant", "Food & Beverage", "Restaurant", "purpose", "any"),
    ("food", "Food & Beverage", "Food", "purpose", "any"),
    ("electricity", "Utilities", "Electricity", "purpose", "any"),
    ("water", "Utilities", "Water", "purpose", "any"),
    ("internet", "Utilities", "Internet", "purpose", "any"),
    ("broadband", "Utilities", "Internet", "purpose", "any"),
    ("recharge", "Utilities", "Mobile", "purpose", "any"),
    ("mobile", "Utilities", "Mobile", "purpose", "any"),
    ("doctor", "Medical", "Doctor", "purpose", "any"),
    ("medicine", "Medical", "Medicine", "purpose", "any"),
    ("hospital", "Medical", "Hospital", "purpose", "any"),
    ("pharmacy", "Medical", "Pharmacy", "purpose", "any"),
    ("rent", "Housing", "Rent", "purpose", "any"),
    ("subscription", "Subscriptions", "", "purpose", "any"),
    ("bill", "Bills", "", "purpose", "any"),
    ("irctc", "Travel", "Train", "vendor", "any"),
    ("uber", "Travel", "Cab", "vendor", "any"),
    ("ola", "Travel", "Cab", "vendor", "any"),
    ("amazon", "Online Shopping", "", "vendor", "any"),
    ("flipkart", "Online Shopping", "", "vendor", "any"),
    ("airtel", "Utilities", "Mobile", "vendor", "any"),
    ("jio", "Utilities", "Mobile", "vendor", "any"),
    ("swiggy", "Food & Beverage", "Food", "vendor", "any"),
    ("zomato", "Food & Beverage", "Food", "vendor", "any"),
    ("apollo", "Medical", "Pharmacy", "vendor", "any"),
    ("netflix", "Subscriptions", "", "vendor", "any"),
]
# One name per kind of spend: model answers mapped to the canonical name.
CATEGORY_SYNONYMS = [("petrol", "Fuel"), ("gas", "Fuel"), ("diesel", "Fuel"),
                     ("grocery", "Groceries"), ("refunds", "Refund"),
                     ("food", "Food & Beverage"), ("savings", "Savings Transfer"),
                     ("cash withdrawals", "Cash Withdrawal"), ("transfers", "Transfer")]
# Named payee with a withdrawal below this amount leans Groceries (parameter).
SMALL_AMOUNT = 500
INLINE_LEXICON_LIMIT = 2000
# ----------------------------------------------------------------------------

CONFIDENCE_BY_KIND = {"purpose": "High", "vendor": "Medium"}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# A word is a run between single spaces (as ``split(text, " ")`` cuts it):
# these lookarounds mark its start and end without consuming the spaces.
_WORD_START, _WORD_END = r"(?<![^ ])", r"(?![^ ])"
_ABBR_KEYS = {a.lower() for a, _ in ABBREVIATIONS}
# One pass of replacements equals a word-by-word lookup only if no expansion
# contains a short form as a word of its own.
assert not any(w.lower() in _ABBR_KEYS for _, e in ABBREVIATIONS for w in e.split(" "))
assert all(a.isalnum() for a in _ABBR_KEYS | set(PURPOSE_WORDS))
# Words (lower-case) that make a part a purpose part once expanded.
_PURPOSE_TRIGGERS = sorted({w for w in PURPOSE_WORDS if w not in _ABBR_KEYS}
                           | {a.lower() for a, e in ABBREVIATIONS
                              if set(e.lower().split(" ")) & set(PURPOSE_WORDS)})
# First "/"-separated part holding a trigger word (the part must start at the
# string start or after "/", so the leftmost match is the first such part).
_PURPOSE_PART = (r"(?iu)(?<![^/])([^/]*?(?<![^ /])(?:" + "|".join(_PURPOSE_TRIGGERS)
                 + r")(?![^ /])[^/]*)")


def expand_words(text: Column) -> Column:
    """Replace known short forms word by word (case-insensitive match)."""
    out = _c(text)
    for abbr, expansion in ABBREVIATIONS:
        out = F.regexp_replace(out, F.lit(f"(?iu){_WORD_START}{abbr}{_WORD_END}"), F.lit(expansion))
    return out


def _first_match(text_lower: Column, items: list[tuple[str, str]]) -> Column:
    expr = None
    for needle, value in items:
        cond = F.contains(text_lower, F.lit(needle.lower()))
        expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    return expr


def capitalize_first(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


# The same part where short forms have been expanded already.
_EXPANDED_PURPOSE_PART = r"(?iu)(?<![^/])([^/]*?(?<![^ /])(?:" + "|".join(PURPOSE_WORDS) + r")(?![^ /])[^/]*)"


def remark_tokens(df: DataFrame, col: str = "remarks", short_forms: DataFrame | None = None) -> DataFrame:
    """Add the remark's parts: ``channel``, ``party``, ``purpose`` (expanded),
    ``platform``, ``verb``, ``reference`` and ``remark_key`` (the parts left
    after ids are dropped, lower-cased; similar remarks share it).

    ``short_forms``: a table ``(key, value)`` to use instead of the fixed list
    (:func:`ledgerlens.operators.wordlists.expand_short_forms`).

    Intermediate arrays are projected once (``_rt_*``) and dropped at the end.
    """
    d = df.withColumn("_rt_text", as_text(_c(col)))
    # Parts split on "/" with spaces trimmed from each ends (spaces around
    # every "/" are part of the separator).
    d = d.withColumn("_rt_parts", F.split(F.trim("_rt_text"), " */ *"))
    d = d.withColumns({"_rt_first": F.upper(F.try_element_at("_rt_parts", F.lit(1))),
                       "_rt_blank": is_blank(F.col("_rt_text")),
                       "_rt_low": F.lower("_rt_text")})
    d = d.withColumn("_rt_has", F.col("_rt_first").isin(*CHANNELS) & (F.size("_rt_parts") > 1))
    d = d.withColumn("_rt_rest", F.when(F.col("_rt_has"), F.slice("_rt_parts", 2, F.size("_rt_parts")))
                     .otherwise(F.col("_rt_parts")))
    d = d.withColumn("_rt_kept", F.filter("_rt_rest", lambda p: (p != "") & ~p.rlike(ID_PATTERN)))
    candidates = F.when(F.col("_rt_has"), F.slice("_rt_kept", 2, F.size("_rt_kept"))).otherwise(
        F.col("_rt_kept"))
    # First candidate part with a purpose word (after expansion), found by one
    # regex over the joined parts; parts never contain "/".
    live = ~F.col("_rt_blank")
    if short_forms is None:
        d = d.withColumn("_rt_purpose", F.regexp_extract(F.array_join(candidates, "/"), _PURPOSE_PART, 1))
        purpose = F.when(F.col("_rt_purpose") != "", expand_words(F.col("_rt_purpose")))
    else:
        from ledgerlens.operators.wordlists import expand_short_forms
        d = d.withColumn("_rt_candidates", F.array_join(candidates, "/"))
        d = expand_short_forms(d, "_rt_candidates", short_forms, "_rt_expanded")
        d = d.withColumn("_rt_purpose", F.regexp_extract("_rt_expanded", _EXPANDED_PURPOSE_PART, 1))
        purpose = F.nullif("_rt_purpose", F.lit(""))
    d = d.withColumns({
        "channel": F.when(F.col("_rt_has"), F.col("_rt_first")),
        "party": F.when(live & F.col("_rt_has"), F.try_element_at("_rt_kept", F.lit(1))),
        "purpose": F.when(live, purpose),
        "platform": F.when(live, _first_match(F.col("_rt_low"), [(p, p) for p in PLATFORMS])),
        "verb": F.when(live, _first_match(F.col("_rt_low"), PAYMENT_VERBS)),
        "reference": F.when(live, F.try_element_at(
            F.filter("_rt_rest", lambda p: p.rlike(REFERENCE_PATTERN)), F.lit(1))),
        "remark_key": F.when(live & (F.size("_rt_kept") > 0), F.lower(F.array_join("_rt_kept", "/"))),
    })
    return d.drop("_rt_text", "_rt_parts", "_rt_first", "_rt_blank", "_rt_low", "_rt_has",
                  "_rt_rest", "_rt_kept", "_rt_candidates", "_rt_expanded", "_rt_purpose")


def read_remark(df: DataFrame, col: str = "remarks", short_forms: DataFrame | None = None) -> DataFrame:
    """Rule-based ``cleaned_remark`` / ``notes_doubts`` plus ``reading_rule``
    (which priority level fired). Blank remarks give ('', ''). ``short_forms`` as for
    :func:`remark_tokens`."""
    t = remark_tokens(df, col, short_forms)
    blank = is_blank(as_text(_c(col)))
    rule = (F.when(blank, F.lit("blank"))
            .when(F.col("purpose").isNotNull(), F.lit("purpose"))
            .when(F.col("party").isNotNull(), F.lit("party"))
            .when(F.col("platform").isNotNull(), F.lit("platform"))
            .when(F.col("reference").isNotNull(), F.lit("reference"))
            .otherwise(F.lit("none")))
    t = t.withColumn("reading_rule", rule)
    rule = F.col("reading_rule")
    party_text = F.concat(F.coalesce(F.col("verb"), F.lit("Payment to")), F.lit(" "), F.col("party"))
    cleaned = (F.when(rule == "purpose", F.concat(
                   capitalize_first(F.col("purpose")),
                   F.coalesce(F.concat(F.lit(" - "), F.col("party")), F.lit(""))))
               .when(rule == "party", party_text)
               .when(rule == "platform", F.concat(F.col("platform"), F.lit(" payment")))
               .when(rule == "reference", F.concat(F.lit("Bank reference "), F.col("reference")))
               .otherwise(F.lit("")))
    notes = (F.when(rule == "blank", F.lit("")).when(rule == "purpose", F.lit(NOTE_PURPOSE))
             .when(rule == "party", F.lit(NOTE_PARTY))
             .when(rule == "platform", F.lit(NOTE_PLATFORM))
             .when(rule == "reference", F.lit(NOTE_REFERENCE))
             .otherwise(F.lit(NOTE_NONE)))
    return t.withColumns({"cleaned_remark": cleaned, "notes_doubts": notes})


def remark_consensus(df: DataFrame, key: str = "remark_key", value: str = "cleaned_remark",
                     split_rows: int | None = None) -> DataFrame:
    """Similar rows get one reading: per key, the most frequent non-empty
    value (ties: lowest value) becomes ``consensus_remark``; rows without a
    key or without any non-empty value keep their own.

    One aggregation of (key, value) counts with a map-side partial step (a
    key holding a third of all rows is reduced before it is shuffled) is
    written once; the best value per key and the rows per key both come from
    it. The join back splits keys with more than ``split_rows`` rows over
    several tasks (:mod:`ledgerlens.operators.joins`).
    """
    from ledgerlens.operators.joins import HOT_SPLIT_ROWS, hot_keys, split_hot_join
    from ledgerlens.session import materialize
    pairs = materialize(df.where(F.col(key).isNotNull())
                        .groupBy(key, value).agg(F.count(F.lit(1)).alias("_n")), "consensus_counts")
    best = (pairs.where(F.col(value) != "")
            .groupBy(key).agg(F.min(F.struct((-F.col("_n")).alias("neg"), F.col(value).alias("v")))
                              .alias("_b"))
            .select(key, F.col("_b.v").alias("_consensus")))
    hot = hot_keys(pairs.groupBy(key).agg(F.sum("_n").alias("n")), key,
                   split_rows=split_rows or HOT_SPLIT_ROWS)
    out = split_hot_join(df, best, key, hot)
    return out.withColumn("consensus_remark", F.coalesce("_consensus", value)).drop("_consensus")


def normalized_words(text: Column) -> Column:
    """`` word word `` form: lower-case, non-alphanumerics (except &) to one space."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(as_text(text)), "[^a-z0-9&]+", " "), F.lit(" "))


def _lexicon_index(norm: Column, wd: Column, dp: Column, lexicon) -> Column:
    """Position of the first entry that fits, as one lookup per n-gram of the text in the list of
    keywords (lists by direction, so each row tries only what its amounts allow). The keywords stand in
    literals, not in a chain of conditions, so the expression stays small wherever it is inlined."""
    words = max((len(e[0].split(" ")) for e in lexicon), default=1)
    grams = word_ngrams(F.trim(norm), words)
    best = None
    for direction, cond in (("any", None), ("credit", dp > 0), ("debit", wd > 0)):
        own = [(kw, i) for i, (kw, _c, _s, _k, d) in enumerate(lexicon) if d == direction]
        if not own:
            continue
        keys = F.split(F.lit("\n".join(kw for kw, _ in own)), "\n")
        places = F.split(F.lit(",".join(str(i) for _, i in own)), ",").cast("array<int>")
        at = F.array_min(F.filter(F.transform(grams, lambda g: F.get(places, (F.array_position(keys, g) - 1).cast("int"))),
                                  lambda i: i.isNotNull()))
        at = at if cond is None else F.when(cond, at)
        best = at if best is None else F.least(best, at)
    return best if best is not None else F.lit(None).cast("int")


def canonical_category(c) -> Column:
    """Map synonyms to one category name (Fuel, not Petrol or Gas). For a table of synonyms see
    :func:`ledgerlens.operators.wordlists.canonicalise`."""
    m = F.create_map(*[F.lit(x) for kv in CATEGORY_SYNONYMS for x in kv])
    col = _c(c)
    return F.coalesce(F.try_element_at(m, F.lower(col)), col)


def _amount(df: DataFrame, name: str) -> Column:
    return (F.coalesce(F.col(name).try_cast(MONEY), F.lit(0).cast(MONEY))
            if name in df.columns else F.lit(0).cast(MONEY))


def rule_categories(df: DataFrame, description: str | None = None, lexicon=None,
                    small_amount=SMALL_AMOUNT, party: str = "party") -> DataFrame:
    """Add ``category``, ``subcategory``, ``confidence``, ``category_rule``
    and ``name_ok`` (category is 1-3 words) from the description and amounts.

    The small-amount rule needs a named payee: it fires only when ``party``
    is a column of ``df`` and holds a name. A lexicon too long to compile into
    the expression goes through :func:`categorise_with_lexicon_table`."""
    lexicon = LEXICON if lexicon is None else list(lexicon)
    if len(lexicon) > INLINE_LEXICON_LIMIT:
        return categorise_with_lexicon_table(df, lexicon_frame(df.sparkSession, lexicon), description, small_amount, party)
    desc = description or description_column(df.columns)
    wd, dp = _amount(df, "withdrawal"), _amount(df, "deposit")
    d = df.withColumn("_lex_norm", normalized_words(F.col(desc)))
    d = d.withColumn("_lex", _lexicon_index(F.col("_lex_norm"), wd, dp, lexicon)).drop("_lex_norm")
    named = F.col(party).isNotNull() if party in df.columns else F.lit(False)
    return _finish(d, desc, wd, lexicon, small_amount, named)


def _finish(df: DataFrame, desc: str, wd: Column, lexicon, small_amount, named: Column) -> DataFrame:
    """The four result columns from the entry's position, bound once through a one-element ``transform``."""
    def lists(values):
        return F.split(F.lit("\n".join(values)), "\n")
    cats, subs = lists([e[1] for e in lexicon]), lists([e[2] for e in lexicon])
    confs, kws = lists([CONFIDENCE_BY_KIND[e[3]] for e in lexicon]), lists([e[0] for e in lexicon])
    blank = is_blank(F.col(desc))
    small = ~blank & named & (wd > 0) & (wd < F.lit(small_amount))

    def entry(i: Column) -> Column:
        hit = i.isNotNull()
        return F.struct(
            F.when(hit, F.get(cats, i)).when(small, F.lit("Groceries")).otherwise(F.lit("Unclear")).alias("category"),
            F.when(hit, F.get(subs, i)).otherwise(F.lit("")).alias("subcategory"),
            F.when(hit, F.get(confs, i)).otherwise(F.lit("Low")).alias("confidence"),
            F.when(hit, F.concat(F.lit("lexicon:"), F.get(kws, i))).when(small, F.lit("small_amount"))
             .otherwise(F.lit("none")).alias("category_rule"))
    out = df.withColumn("_entry", F.transform(F.array("_lex"), entry)[0])
    out = out.withColumns({c: F.col(f"_entry.{c}") for c in ("category", "subcategory", "confidence", "category_rule")})
    out = out.withColumn("name_ok", F.size(F.split(F.col("category"), " ")) <= 3)
    return out.drop("_lex", "_entry")


def word_ngrams(norm: Column, max_words: int) -> Column:
    """All word n-grams (1 <= n <= ``max_words``) of a normalised text (words
    of ``[a-z0-9&]`` separated by single spaces), n-grams joined by one space.

    Each n is one regex pass: a lookahead at every word start captures the
    next n words, so overlapping n-grams come out in one ``regexp_extract_all``
    (generated code; no lambda functions)."""
    return F.concat(*[F.regexp_extract_all(norm, F.lit(r"(?<![^ ])(?=([^ ]+" + r" [^ ]+" * (n - 1) + "))"), 1)
                      for n in range(1, max_words + 1)])


def categorise_with_lexicon_table(df: DataFrame, lexicon_df: DataFrame, description: str | None = None,
                                  small_amount=SMALL_AMOUNT, party: str = "party") -> DataFrame:
    """Lexicon-join path for lexicons too large to inline.

    ``lexicon_df``: ``(keyword, category, subcategory, kind, direction,
    priority)``. Each distinct description (normalised, with the directions its
    amounts allow) is cut into word n-grams as long as the lexicon's longest
    keyword, joined to the lexicon on the n-gram and reduced to the best
    priority; rows then take their description's entry by its digest. No row key
    is needed, and a description repeated in a third of all rows is matched once.

    Both joins shuffle; the planner broadcasts a side that it knows to be
    small, and adaptive execution splits a hot description in the join back.
    """
    from ledgerlens.session import materialize
    desc = description or description_column(df.columns)
    wd, dp = _amount(df, "withdrawal"), _amount(df, "deposit")
    lex = lexicon_df.select("keyword", "category", "subcategory", "kind", "direction", "priority")
    # One number: how many words the longest keyword has.
    longest = lex.agg(F.coalesce(F.max(F.size(F.split("keyword", " "))), F.lit(1))).first()[0]
    norm = F.trim(normalized_words(F.col(desc)))
    rows = df.withColumns({"_norm": norm, "_in": dp > 0, "_out": wd > 0})
    rows = rows.withColumn("_desc", F.unhex(F.sha2(F.to_json(F.struct("_norm", "_in", "_out")).cast("binary"), 256)))
    grams = (rows.select("_desc", "_norm", "_in", "_out").distinct()
             .select("_desc", "_in", "_out", F.explode(word_ngrams(F.col("_norm"), longest)).alias("keyword")))
    hits = (grams.join(lex, "keyword")
            .where((F.col("direction") == "any") | ((F.col("direction") == "credit") & F.col("_in"))
                   | ((F.col("direction") == "debit") & F.col("_out")))
            .groupBy("_desc").agg(F.min(F.struct("priority", "keyword", "category", "subcategory",
                                                 "kind")).alias("_best")))
    # Stored, so the join back shuffles both sides and a hot description can be split.
    out = rows.drop("_norm", "_in", "_out").join(materialize(hits, "lexicon_hits"), "_desc", "left").drop("_desc")
    hit = F.col("_best").isNotNull()
    blank = is_blank(F.col(desc))
    named = F.col(party).isNotNull() if party in df.columns else F.lit(False)
    small = ~blank & named & (wd > 0) & (wd < F.lit(small_amount))
    conf = F.when(F.col("_best.kind") == "purpose", F.lit("High")).otherwise(F.lit("Medium"))
    out = out.withColumns({
        "category": F.when(hit, F.col("_best.category")).when(small, F.lit("Groceries"))
                     .otherwise(F.lit("Unclear")),
        "subcategory": F.when(hit, F.col("_best.subcategory")).otherwise(F.lit("")),
        "confidence": F.when(hit, conf).otherwise(F.lit("Low")),
        "category_rule": (F.when(hit, F.concat(F.lit("lexicon:"), F.col("_best.keyword")))
                          .when(small, F.lit("small_amount")).otherwise(F.lit("none"))),
    })
    return out.withColumn("name_ok", F.size(F.split(F.col("category"), " ")) <= 3).drop("_best")


def lexicon_frame(spark, lexicon=None) -> DataFrame:
    """The lexicon as a DataFrame with ``priority`` = list position."""
    lexicon = LEXICON if lexicon is None else lexicon
    rows = [(kw, c, s, k, d, i) for i, (kw, c, s, k, d) in enumerate(lexicon)]
    return spark.createDataFrame(rows, "keyword string, category string, subcategory string, "
                                       "kind string, direction string, priority int")


class RuleBackend(NativeBackend):
    """Offline default backend: rules instead of model calls."""

    name = "rules"

    def __init__(self, small_amount=SMALL_AMOUNT, lexicon=None):
        self.small_amount = small_amount
        self.lexicon = lexicon

    def clean_remarks(self, df: DataFrame) -> DataFrame:
        cols = [c for c in df.columns if c not in ("cleaned_remark", "notes_doubts")]
        r = read_remark(df.select(*cols))
        return r.select(*cols, "cleaned_remark", "notes_doubts")

    def categorise(self, df: DataFrame) -> DataFrame:
        cols = [c for c in df.columns if c not in ("category", "subcategory", "confidence")]
        r = rule_categories(df.select(*cols), lexicon=self.lexicon, small_amount=self.small_amount)
        if AMOUNT_UNPARSEABLE in cols:
            bad = F.coalesce(AMOUNT_UNPARSEABLE, F.lit(False))
            r = r.withColumns({c: F.when(bad, F.lit(v)).otherwise(F.col(c)) for c, v in
                               (("category", "Unclear"), ("subcategory", ""), ("confidence", "Low"))})
        return r.select(*cols, "category", "subcategory", "confidence")
