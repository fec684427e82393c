"""DuckDB oracle SQL for every registered query.

The logic is re-stated in plain SQL (regex, JSON and list functions); only
the fixed values (patterns, word lists, reply texts, templates) are shared
with the Spark code. Two DuckDB differences are handled explicitly: its JSON
reader accepts trailing commas (checked with a regex) and its regex replace
needs the ``g`` flag to replace every match.
"""

from __future__ import annotations

from ledgerlens.functions import dates, replies as R, text
from ledgerlens.operators import prompts as P, rules as RU, summary as SU
from ledgerlens.plans import catalog, fixtures


def lit(s) -> str:
    if s is None:
        return "NULL"
    return "'" + str(s).replace("'", "''") + "'"


def strip(x: str) -> str:
    cls = text.PY_SPACE_CLASS
    return f"regexp_replace({x}, '^{cls}+|{cls}+$', '', 'g')"


def blank(x: str) -> str:
    return "(" + strip(f"coalesce(CAST({x} AS VARCHAR), '')") + " = '')"


MONEY = "DECIMAL(18,2)"


def money(x: str) -> str:
    return f"('₹' || format('{{:,.2f}}', {x}))"


STATEMENT = f"""st AS (
  SELECT o.o_orderkey AS s_no,
    CASE o.o_orderkey % 11 WHEN 0 THEN NULL WHEN 1 THEN 'not a date'
      WHEN 2 THEN strftime(o.o_orderdate, '%Y-%m-%d') ELSE strftime(o.o_orderdate, '%d/%m/%Y') END AS txn_date_raw,
    CASE o.o_orderkey % 13 WHEN 0 THEN NULL WHEN 1 THEN '   '
      ELSE CASE o.o_orderkey % 19
        WHEN 10 THEN concat('NEFT/', c.c_name, '/Pay to', tail) WHEN 11 THEN concat('IMPS/AMAZON/Pay to', tail)
        WHEN 12 THEN 'Paytm' WHEN 13 THEN lpad(CAST(o.o_orderkey AS VARCHAR), 12, '5')
        WHEN 14 THEN concat('ICI', md5(CAST(o.o_orderkey AS VARCHAR))) WHEN 15 THEN concat('NEFT/ACME CORP/salary', tail)
        WHEN 16 THEN concat('UPI/FAMILY TRUST/Pay to', tail) WHEN 17 THEN concat('NEFT/FREELANCE DESK/payment fr', tail)
        WHEN 18 THEN concat('IMPS/ATM CASH/Pay to', tail)
        ELSE concat('UPI/', c.c_name, '/',
          CASE o.o_orderkey % 7 WHEN 0 THEN 'temp rever' WHEN 1 THEN 'savings oc' WHEN 2 THEN 'petrol bik'
            WHEN 3 THEN 'milk' WHEN 4 THEN 'IRCTC ticket' WHEN 5 THEN 'rent au' ELSE 'Pay to' END, tail) END END AS remarks,
    CASE WHEN o.o_orderstatus <> 'F' THEN amount END AS withdrawal,
    CASE WHEN o.o_orderstatus = 'F' THEN amount END AS deposit,
    CAST(c.c_acctbal AS {MONEY}) AS balance
  FROM (SELECT *, CAST(CASE WHEN o_orderkey % 19 = 10 THEN o_totalprice / 1000 ELSE o_totalprice END AS {MONEY}) AS amount,
          concat('/Kotak Mahi/', lpad(CAST(o_orderkey AS VARCHAR), 12, '5'), '/ICI', md5(CAST(o_orderkey AS VARCHAR))) AS tail
        FROM orders) o JOIN customer c ON o.o_custkey = c.c_custkey)"""


def pick(key: str, values) -> str:
    n = len(values)
    whens = " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(values))
    return f"(CASE ({key}) % {n} {whens} END)"


def failed(key: str, values) -> str:
    bad = ", ".join(str(i) for i, v in enumerate(values) if v is None)
    return f"(CASE WHEN ({key}) % {len(values)} IN ({bad}) THEN {lit(fixtures.FAILED_CALL_ERROR)} END)"


# ----------------------------------------------------------------- parsing
def _parse_ctes(prefix: str, src: str, r: str, fields) -> tuple[list[str], str]:
    strict = R.strict_pattern(fields)
    loose = R.LOOSE_PATTERN
    a, b, c, d = (f"{prefix}_a", f"{prefix}_b", f"{prefix}_c", f"{prefix}_d")
    arr = f"('[' || {prefix}_js || ']')"
    kinds = ", ".join(
        f"json_type({prefix}_arr, '$[0].{f}') AS {prefix}_k{i}, "
        f"json_extract_string({prefix}_arr, '$[0].{f}') AS {prefix}_s{i}" for i, f in enumerate(fields))
    ctes = [
        f"{a} AS (SELECT *, regexp_extract({r}, {lit(strict)}, 0) AS {prefix}_strict FROM {src})",
        f"{b} AS (SELECT *, CASE WHEN {prefix}_strict <> '' THEN {prefix}_strict "
        f"ELSE regexp_extract({r}, {lit(loose)}, 0) END AS {prefix}_js FROM {a})",
        f"{c} AS (SELECT *, CASE WHEN {prefix}_js <> '' AND json_valid({arr}) "
        f"AND NOT regexp_matches({prefix}_js, ',\\s*[}}\\]]') AND try(json_array_length({arr})) = 1 "
        f"THEN {arr} END AS {prefix}_arr FROM {b})",
        f"{d} AS (SELECT *, ({prefix}_js <> '' AND {prefix}_arr IS NULL) AS {prefix}_bad, {kinds} FROM {c})",
    ]
    return ctes, d


def _bad_type(prefix: str, n: int) -> str:
    return "(" + " OR ".join(f"({prefix}_k{i} IS NOT NULL AND {prefix}_k{i} <> 'VARCHAR')"
                             for i in range(n)) + ")"


def remark_parse(prefix: str, src: str, r: str, e: str) -> tuple[list[str], str, str, str]:
    """CTEs + final relation + (cleaned_remark expr, notes_doubts expr)."""
    ctes, rel = _parse_ctes(prefix, src, r, R.REMARK_FIELDS)
    bt = _bad_type(prefix, 2)
    notes_v = strip(f"coalesce({prefix}_s1, '')")
    nodoubt = ", ".join(lit(x) for x in R.NO_DOUBT_NOTES)
    cleaned = (f"CASE WHEN {r} IS NULL OR {prefix}_js = '' THEN '' "
               f"WHEN {prefix}_bad THEN substring({r}, 1, {R.FALLBACK_CHARS}) WHEN {bt} THEN '' "
               "ELSE " + strip(f"coalesce({prefix}_s0, '')") + " END")
    notes = (f"CASE WHEN {r} IS NULL THEN 'Error: ' || coalesce({e}, 'no reply') "
             f"WHEN {prefix}_js = '' THEN {lit(R.ERR_NO_JSON)} "
             f"WHEN {prefix}_bad THEN {lit(R.JSON_ERROR)} WHEN {bt} THEN {lit(R.ERR_NOT_STRING)} "
             f"WHEN lower({notes_v}) IN ({nodoubt}) THEN {lit(R.NO_DOUBT)} ELSE {notes_v} END")
    return ctes, rel, cleaned, notes


def category_parse(prefix: str, src: str, r: str) -> tuple[list[str], str, str, str, str]:
    ctes, rel = _parse_ctes(prefix, src, r, R.CATEGORY_FIELDS)
    bt = _bad_type(prefix, 3)
    cat_v = strip(f"coalesce({prefix}_s0, {lit(R.UNCLEAR)})")
    sub_v = strip(f"coalesce({prefix}_s1, '')")
    conf_v = strip(f"coalesce({prefix}_s2, {lit(R.LOW)})")
    kw = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({r}), {lit(w)})" for w in words) + f" THEN {lit(cat)}"
        for words, cat in R.MALFORMED_KEYWORDS)
    dflt = f"({r} IS NULL OR {prefix}_js = '')"
    levels = ", ".join(lit(x) for x in R.CONFIDENCE_LEVELS)
    category = (f"CASE WHEN {dflt} THEN {lit(R.UNCLEAR)} "
                f"WHEN {prefix}_bad THEN CASE {kw} ELSE {lit(R.UNCLEAR)} END "
                f"WHEN {bt} THEN {lit(R.UNCLEAR)} WHEN {cat_v} = '' THEN {lit(R.UNCLEAR)} ELSE {cat_v} END")
    sub = f"CASE WHEN {dflt} OR {prefix}_bad OR {bt} THEN '' ELSE {sub_v} END"
    conf = (f"CASE WHEN {dflt} OR {prefix}_bad OR {bt} THEN {lit(R.LOW)} "
            f"WHEN {conf_v} IN ({levels}) THEN {conf_v} ELSE {lit(R.LOW)} END")
    return ctes, rel, category, sub, conf


def with_ctes(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


# ----------------------------------------------------------------- prompts
def remark_prompt(x: str) -> str:
    t = f"coalesce(CAST({x} AS VARCHAR), '')"
    return f"CASE WHEN {blank(x)} THEN NULL ELSE {lit(P.REMARK_PROMPT_HEAD)} || {t} || {lit(P.REMARK_PROMPT_TAIL)} END"


def amount0(x: str) -> str:
    return f"coalesce(TRY_CAST({x} AS {MONEY}), CAST(0 AS {MONEY}))"


def category_prompt(desc: str, w: str, d: str) -> str:
    t = f"coalesce(CAST({desc} AS VARCHAR), '')"
    return (f"CASE WHEN {blank(desc)} THEN NULL ELSE {lit(P.CATEGORY_PROMPT_HEAD)} || {t} || "
            f"{lit(chr(10) + 'Withdrawal Amount(INR): ')} || {money(amount0(w))} || "
            f"{lit(chr(10) + 'Deposit Amount(INR): ')} || {money(amount0(d))} || "
            f"{lit(P.CATEGORY_PROMPT_TAIL)} END")


# ----------------------------------------------------------------- dates
def date_parse(x: str) -> str:
    s = f"trim(CAST({x} AS VARCHAR))"
    shape = "CASE " + " ".join(f"WHEN regexp_matches({s}, {lit(p)}) THEN {i}"
                               for i, (p, *_r) in enumerate(dates.DATE_SHAPES)) + " END"

    def grp(j):
        return "CASE " + " ".join(f"WHEN regexp_matches({s}, {lit(shp[0])}) THEN regexp_extract({s}, {lit(shp[0])}, {shp[j]})"
                                  for shp in dates.DATE_SHAPES) + " END"
    two = [i for i, shp in enumerate(dates.DATE_SHAPES) if shp[0].endswith(r"(\d{2})$")]
    two_s = ", ".join(str(i) for i in two)
    y = (f"CASE WHEN ({shape}) IN ({two_s}) AND CAST({grp(1)} AS INT) < {dates.TWO_DIGIT_YEAR_PIVOT} "
         f"THEN CAST({grp(1)} AS INT) + 2000 WHEN ({shape}) IN ({two_s}) THEN CAST({grp(1)} AS INT) + 1900 "
         f"ELSE CAST({grp(1)} AS INT) END")
    mt = grp(2)
    months = " ".join(f"WHEN {lit(m)} THEN {i}" for names in (dates.MONTHS, dates.MONTH_NAMES) for i, m in enumerate(names, start=1)
                      if names is dates.MONTHS or m != "may")
    m = f"CASE WHEN regexp_matches({mt}, '^\\d+$') THEN CAST({mt} AS INT) ELSE (CASE lower({mt}) {months} END) END"
    d = f"CAST({grp(3)} AS INT)"
    return f"try(make_date({y}, {m}, {d}))"


# ----------------------------------------------------------------- rules
def expand(p: str) -> str:
    cases = " ".join(f"WHEN {lit(a)} THEN {lit(b)}" for a, b in RU.ABBREVIATIONS)
    return (f"array_to_string(list_transform(string_split({p}, ' '), "
            f"lambda w: coalesce(CASE lower(w) {cases} END, w)), ' ')")


def first_match(low: str, items) -> str:
    return "CASE " + " ".join(f"WHEN contains({low}, {lit(n.lower())}) THEN {lit(v)}" for n, v in items) + " END"


def token_ctes(src: str, col: str = "remarks") -> tuple[list[str], str]:
    chans = ", ".join(lit(c) for c in RU.CHANNELS)
    purpose = "[" + ", ".join(lit(w) for w in RU.PURPOSE_WORDS) + "]"
    cand = "CASE WHEN _has THEN list_slice(_kept, 2, len(_kept)) ELSE _kept END"
    words = f"string_split(lower({expand('p')}), ' ')"
    purpose_part = f"list_filter({cand}, lambda p: list_has_any({words}, {purpose}))[1]"
    ctes = [
        f"t1 AS (SELECT *, coalesce(CAST({col} AS VARCHAR), '') AS _t FROM {src})",
        "t2 AS (SELECT *, list_transform(string_split(_t, '/'), lambda p: trim(p)) AS _parts, "
        f"{strip('_t')} = '' AS _blank, lower(_t) AS _low FROM t1)",
        f"t3 AS (SELECT *, upper(_parts[1]) AS _first FROM t2)",
        f"t4 AS (SELECT *, (_first IN ({chans}) AND len(_parts) > 1) AS _has FROM t3)",
        "t5 AS (SELECT *, CASE WHEN _has THEN list_slice(_parts, 2, len(_parts)) ELSE _parts END AS _rest FROM t4)",
        f"t6 AS (SELECT *, list_filter(_rest, lambda p: p <> '' AND NOT regexp_matches(p, {lit(RU.ID_PATTERN)})) AS _kept FROM t5)",
        "t7 AS (SELECT *, CASE WHEN _has THEN _first END AS channel, "
        "CASE WHEN NOT _blank AND _has THEN _kept[1] END AS party, "
        f"CASE WHEN NOT _blank THEN {expand(purpose_part)} END AS purpose, "
        f"CASE WHEN NOT _blank THEN {first_match('_low', [(p, p) for p in RU.PLATFORMS])} END AS platform, "
        f"CASE WHEN NOT _blank THEN {first_match('_low', RU.PAYMENT_VERBS)} END AS verb, "
        f"CASE WHEN NOT _blank THEN list_filter(_rest, lambda p: regexp_matches(p, {lit(RU.REFERENCE_PATTERN)}))[1] END AS reference, "
        "CASE WHEN NOT _blank AND len(_kept) > 0 THEN lower(array_to_string(_kept, '/')) END AS remark_key FROM t6)",
    ]
    return ctes, "t7"


def reading_ctes(src: str) -> tuple[list[str], str]:
    ctes, rel = token_ctes(src)
    ctes += [
        f"r1 AS (SELECT *, CASE WHEN _blank THEN 'blank' WHEN purpose IS NOT NULL THEN 'purpose' "
        "WHEN party IS NOT NULL THEN 'party' WHEN platform IS NOT NULL THEN 'platform' "
        f"WHEN reference IS NOT NULL THEN 'reference' ELSE 'none' END AS reading_rule FROM {rel})",
        "r2 AS (SELECT *, CASE reading_rule "
        "WHEN 'purpose' THEN upper(substring(purpose, 1, 1)) || substring(purpose, 2) || coalesce(' - ' || party, '') "
        "WHEN 'party' THEN coalesce(verb, 'Payment to') || ' ' || party "
        "WHEN 'platform' THEN platform || ' payment' "
        "WHEN 'reference' THEN 'Bank reference ' || reference ELSE '' END AS cleaned_remark, "
        f"CASE reading_rule WHEN 'blank' THEN '' WHEN 'purpose' THEN {lit(RU.NOTE_PURPOSE)} "
        f"WHEN 'party' THEN {lit(RU.NOTE_PARTY)} WHEN 'platform' THEN {lit(RU.NOTE_PLATFORM)} "
        f"WHEN 'reference' THEN {lit(RU.NOTE_REFERENCE)} ELSE {lit(RU.NOTE_NONE)} END AS notes_doubts FROM r1)",
    ]
    return ctes, "r2"


def category_rule_ctes(src: str, desc: str = "cleaned_remark", party: str | None = "party") -> tuple[list[str], str]:
    lex = RU.LEXICON
    wd, dp = amount0("withdrawal"), amount0("deposit")
    whens = []
    for i, (kw, _c, _s, _k, direction) in enumerate(lex):
        cond = f"contains(_norm, {lit(' ' + kw + ' ')})"
        if direction == "credit":
            cond += f" AND {dp} > 0"
        elif direction == "debit":
            cond += f" AND {wd} > 0"
        whens.append(f"WHEN {cond} THEN {i}")
    arr = lambda vals: "[" + ", ".join(lit(v) for v in vals) + "]"
    cats = arr([e[1] for e in lex])
    subs = arr([e[2] for e in lex])
    confs = arr([RU.CONFIDENCE_BY_KIND[e[3]] for e in lex])
    kws = arr([e[0] for e in lex])
    named = f"{party} IS NOT NULL" if party else "FALSE"
    small = f"(NOT {blank(desc)} AND {named} AND {wd} > 0 AND {wd} < {RU.SMALL_AMOUNT})"
    ctes = [
        f"c1 AS (SELECT *, ' ' || regexp_replace(lower(coalesce(CAST({desc} AS VARCHAR), '')), '[^a-z0-9&]+', ' ', 'g') || ' ' AS _norm FROM {src})",
        f"c2 AS (SELECT *, CASE {' '.join(whens)} END AS _lex FROM c1)",
        f"c3 AS (SELECT *, CASE WHEN _lex IS NOT NULL THEN {cats}[_lex + 1] WHEN {small} THEN 'Groceries' ELSE 'Unclear' END AS category, "
        f"CASE WHEN _lex IS NOT NULL THEN {subs}[_lex + 1] ELSE '' END AS subcategory, "
        f"CASE WHEN _lex IS NOT NULL THEN {confs}[_lex + 1] ELSE 'Low' END AS confidence, "
        f"CASE WHEN _lex IS NOT NULL THEN 'lexicon:' || {kws}[_lex + 1] WHEN {small} THEN 'small_amount' ELSE 'none' END AS category_rule "
        "FROM c2)",
        "c4 AS (SELECT *, len(string_split(category, ' ')) <= 3 AS name_ok FROM c3)",
    ]
    return ctes, "c4"


def rule_enriched_ctes() -> tuple[list[str], str]:
    ctes, rel = reading_ctes("st")
    c2, rel2 = category_rule_ctes(rel)
    return [STATEMENT] + ctes + c2 + [f"re AS (SELECT *, {date_parse('txn_date_raw')} AS txn_date FROM {rel2})"], "re"


def categorised_ctes() -> tuple[list[str], str]:
    src = f"cs0 AS (SELECT *, {pick('s_no', fixtures.CATEGORY_REPLIES)} AS _reply FROM st)"
    ctes, rel, cat, sub, conf = category_parse("pc", "cs0", "_reply")
    return ([STATEMENT, src] + ctes +
            [f"cs AS (SELECT s_no, txn_date_raw, remarks, withdrawal, deposit, balance, "
             f"{cat} AS category, {sub} AS subcategory, {conf} AS confidence FROM {rel})"]), "cs"


# ----------------------------------------------------------------- queries
def q_statement_scan() -> str:
    return with_ctes([STATEMENT], "SELECT s_no, txn_date_raw, remarks, " +
                     ", ".join(f"{dbl(c)} AS {c}" for c in ("withdrawal", "deposit", "balance")) +
                     ", remarks IS NULL AS remark_missing FROM st")


def q_remark_prompts() -> str:
    p = remark_prompt("remarks")
    return with_ctes([STATEMENT], f"SELECT s_no, {p} AS prompt, ({p}) IS NOT NULL AS needs_call FROM st")


def q_category_prompts() -> str:
    p = category_prompt("remarks", "withdrawal", "deposit")
    return with_ctes([STATEMENT], f"SELECT s_no, {p} AS prompt, ({p}) IS NOT NULL AS needs_call FROM st")


def q_parse_remark_replies() -> str:
    src = (f"rr AS (SELECT o_orderkey AS s_no, {pick('o_orderkey', fixtures.REMARK_REPLIES)} AS response, "
           f"{failed('o_orderkey', fixtures.REMARK_REPLIES)} AS error FROM orders)")
    ctes, rel, cleaned, notes = remark_parse("pr", "rr", "response", "error")
    return with_ctes([src] + ctes, f"SELECT s_no, {cleaned} AS cleaned_remark, {notes} AS notes_doubts FROM {rel}")


def canonical(x: str) -> str:
    cases = " ".join(f"WHEN {lit(a)} THEN {lit(b)}" for a, b in RU.CATEGORY_SYNONYMS)
    return f"coalesce(CASE lower({x}) {cases} END, {x})"


def q_parse_category_replies() -> str:
    src = (f"rs AS (SELECT o_orderkey AS s_no, {pick('o_orderkey', fixtures.CATEGORY_REPLIES)} AS response "
           "FROM orders)")
    ctes, rel, cat, sub, conf = category_parse("pc", "rs", "response")
    body = (f"SELECT s_no, category, subcategory, confidence, {canonical('category')} AS canonical_category "
            f"FROM (SELECT s_no, {cat} AS category, {sub} AS subcategory, {conf} AS confidence FROM {rel})")
    return with_ctes([src] + ctes, body)


def q_enrich_statement() -> str:
    rem, cat = fixtures.REMARK_REPLIES, fixtures.CATEGORY_REPLIES
    s1 = f"e1 AS (SELECT *, {remark_prompt('remarks')} AS _p1 FROM st)"
    s1r = (f"e2 AS (SELECT *, CASE WHEN _p1 IS NOT NULL THEN {pick('length(_p1)', rem)} END AS _r1, "
           f"CASE WHEN _p1 IS NOT NULL THEN {failed('length(_p1)', rem)} END AS _e1 FROM e1)")
    c1, rel1, cleaned, notes = remark_parse("pr", "e2", "_r1", "_e1")
    s2 = (f"e3 AS (SELECT *, CASE WHEN _p1 IS NULL THEN '' ELSE {cleaned} END AS cleaned_remark, "
          f"CASE WHEN _p1 IS NULL THEN '' ELSE {notes} END AS notes_doubts FROM {rel1})")
    s3 = f"e4 AS (SELECT *, {category_prompt('cleaned_remark', 'withdrawal', 'deposit')} AS _p2 FROM e3)"
    s3r = f"e5 AS (SELECT *, CASE WHEN _p2 IS NOT NULL THEN {pick('length(_p2)', cat)} END AS _r2 FROM e4)"
    c2, rel2, category, sub, conf = category_parse("pc", "e5", "_r2")
    body = (f"SELECT s_no, cleaned_remark, notes_doubts, "
            f"CASE WHEN _p2 IS NULL THEN 'Unclear' ELSE {category} END AS category, "
            f"CASE WHEN _p2 IS NULL THEN '' ELSE {sub} END AS subcategory, "
            f"CASE WHEN _p2 IS NULL THEN 'Low' ELSE {conf} END AS confidence FROM {rel2}")
    return with_ctes([STATEMENT, s1, s1r] + c1 + [s2, s3, s3r] + c2, body)


def _kept_sub(x: str) -> str:
    return f"({x} IS NULL OR {strip(x)} <> '')"


def q_statement_totals() -> str:
    ctes, cs = categorised_ctes()
    k = _kept_sub("subcategory")
    return with_ctes(ctes, f"""SELECT count(*) AS total_transactions,
  {dbl('coalesce(sum(withdrawal), 0)')} AS total_withdrawals,
  {dbl('coalesce(sum(deposit), 0)')} AS total_deposits,
  count(DISTINCT category) AS categories_found,
  CASE WHEN count(CASE WHEN {k} THEN 1 END) > 0
       THEN count(DISTINCT CASE WHEN {k} THEN subcategory END) END AS subcategories_found
FROM {cs}""")


def q_category_breakdown() -> str:
    ctes, cs = categorised_ctes()
    return with_ctes(ctes, f"SELECT category, count(*) AS transactions FROM {cs} WHERE category IS NOT NULL "
                           "GROUP BY category ORDER BY transactions DESC, category")


def q_subcategory_breakdown() -> str:
    ctes, cs = categorised_ctes()
    return with_ctes(ctes, f"SELECT subcategory, count(*) AS transactions FROM {cs} "
                           f"WHERE subcategory IS NOT NULL AND {strip('subcategory')} <> '' "
                           "GROUP BY subcategory ORDER BY transactions DESC, subcategory")


def q_date_range() -> str:
    return with_ctes([STATEMENT, f"d AS (SELECT {date_parse('txn_date_raw')} AS txn_date FROM st)"],
                     "SELECT strftime(min(txn_date), '%Y-%m-%d') AS start_date, "
                     "strftime(max(txn_date), '%Y-%m-%d') AS end_date, count(txn_date) AS parsed_dates, "
                     "count(*) AS total_rows FROM d")


def q_category_spending() -> str:
    ctes, cs = categorised_ctes()
    return with_ctes(ctes, f"SELECT category, {dbl('coalesce(sum(withdrawal), 0)')} AS spent FROM {cs} "
                           "WHERE category IS NOT NULL GROUP BY category ORDER BY category")


def q_chat_context() -> str:
    ctes, cs = categorised_ctes()
    nl = "chr(10)"
    ctes = ctes + [
        f"h AS (SELECT count(*) AS total_transactions, strftime(min(d), '%Y-%m-%d') AS start_date, "
        f"strftime(max(d), '%Y-%m-%d') AS end_date FROM (SELECT {date_parse('txn_date_raw')} AS d FROM {cs}))",
        f"sp AS (SELECT category, coalesce(sum(withdrawal), 0) AS spent FROM {cs} WHERE category IS NOT NULL GROUP BY category)",
        f"ln AS (SELECT string_agg('- ' || category || ': ' || {money('spent')}, {nl} ORDER BY category) AS lines, "
        "count(*) AS n FROM sp)",
    ]
    return with_ctes(ctes, f"""SELECT total_transactions, start_date, end_date,
  {lit(SU.CONTEXT_HEADER)} || {nl} || '- Total Transactions: ' || CAST(total_transactions AS VARCHAR)
  || CASE WHEN start_date IS NOT NULL THEN {nl} || '- Date Range: ' || start_date || ' to ' || end_date ELSE '' END
  || CASE WHEN n > 0 THEN {nl} || {nl} || 'Spending by category:' || {nl} || lines ELSE '' END AS context_text
FROM h, ln""")


def q_summary_report() -> str:
    ctes, cs = categorised_ctes()
    k = _kept_sub("subcategory")
    ctes = ctes + [f"""tt AS (SELECT count(*) AS n, coalesce(sum(withdrawal), 0) AS w, coalesce(sum(deposit), 0) AS d,
  count(DISTINCT category) AS cats,
  CASE WHEN count(CASE WHEN {k} THEN 1 END) > 0 THEN count(DISTINCT CASE WHEN {k} THEN subcategory END) END AS subs
  FROM {cs})"""]
    body = f"""SELECT * FROM (
  SELECT 1 AS section_no, 'Totals' AS section, 'Total Transactions' AS label, CAST(n AS VARCHAR) AS value, CAST(NULL AS BIGINT) AS count FROM tt
  UNION ALL SELECT 1, 'Totals', 'Total Withdrawals', {money('w')}, CAST(NULL AS BIGINT) FROM tt
  UNION ALL SELECT 1, 'Totals', 'Total Deposits', {money('d')}, CAST(NULL AS BIGINT) FROM tt
  UNION ALL SELECT 2, 'Categories', 'Categories Found', CAST(cats AS VARCHAR), CAST(NULL AS BIGINT) FROM tt
  UNION ALL SELECT 4, 'Subcategories', 'Subcategories Found', CAST(subs AS VARCHAR), CAST(NULL AS BIGINT) FROM tt WHERE subs IS NOT NULL
  UNION ALL SELECT 3, 'Category Breakdown', category, CAST(count(*) AS VARCHAR), count(*) FROM {cs}
    WHERE category IS NOT NULL GROUP BY category
  UNION ALL SELECT 5, 'Subcategory Breakdown', subcategory, CAST(count(*) AS VARCHAR), count(*) FROM {cs}
    WHERE subcategory IS NOT NULL AND {strip('subcategory')} <> '' GROUP BY subcategory
) ORDER BY section_no, count DESC NULLS FIRST, label"""
    return with_ctes(ctes, body)


def q_remark_tokens() -> str:
    ctes, rel = token_ctes("st")
    return with_ctes([STATEMENT] + ctes, f"SELECT s_no, channel, party, purpose, platform, verb, reference, "
                                         f"remark_key FROM {rel}")


def q_remark_rules() -> str:
    ctes, rel = reading_ctes("st")
    return with_ctes([STATEMENT] + ctes, f"SELECT s_no, cleaned_remark, notes_doubts, reading_rule FROM {rel}")


def q_remark_consensus() -> str:
    ctes, rel = token_ctes("st")
    src = (f"x0 AS (SELECT *, {pick('s_no', fixtures.REMARK_REPLIES)} AS _reply, "
           f"{failed('s_no', fixtures.REMARK_REPLIES)} AS _error FROM {rel})")
    pc, prel, cleaned, _notes = remark_parse("pr", "x0", "_reply", "_error")
    ctes = [STATEMENT] + ctes + [src] + pc + [
        f"x AS (SELECT s_no, remark_key, {cleaned} AS cleaned_remark FROM {prel})",
        "cnt AS (SELECT remark_key, cleaned_remark, count(*) AS n FROM x "
        "WHERE remark_key IS NOT NULL AND cleaned_remark <> '' GROUP BY remark_key, cleaned_remark)",
        "best AS (SELECT remark_key, cleaned_remark AS consensus FROM (SELECT *, row_number() OVER "
        "(PARTITION BY remark_key ORDER BY n DESC, cleaned_remark) AS rn FROM cnt) WHERE rn = 1)",
    ]
    return with_ctes(ctes, "SELECT x.s_no, x.remark_key, x.cleaned_remark, "
                           "coalesce(best.consensus, x.cleaned_remark) AS consensus_remark "
                           "FROM x LEFT JOIN best ON x.remark_key = best.remark_key")


def q_rule_categories() -> str:
    ctes, rel = rule_enriched_ctes()
    return with_ctes(ctes, f"SELECT s_no, cleaned_remark, category, subcategory, confidence, category_rule, "
                           f"name_ok FROM {rel}")


def q_rule_categories_join() -> str:
    return q_rule_categories()


def q_spend_on() -> str:
    ctes, rel = rule_enriched_ctes()
    t = catalog.SPEND_TERM
    return with_ctes(ctes, f"SELECT {lit(t)} AS term, count(*) AS transactions, "
                           f"{dbl('coalesce(sum(withdrawal), 0)')} AS spent, "
                           f"{dbl('coalesce(sum(deposit), 0)')} AS received FROM {rel} "
                           f"WHERE lower(category) = {lit(t)} OR lower(subcategory) = {lit(t)}")


def q_top_categories() -> str:
    ctes, rel = rule_enriched_ctes()
    return with_ctes(ctes, f"SELECT category, {dbl('coalesce(sum(withdrawal), 0)')} AS spent FROM {rel} "
                           f"WHERE category IS NOT NULL GROUP BY category "
                           f"ORDER BY coalesce(sum(withdrawal), 0) DESC, category LIMIT {catalog.TOP_K}")


def q_savings_candidates() -> str:
    ctes, rel = rule_enriched_ctes()
    t = lit(catalog.SAVINGS_TERM)
    ctes = ctes + [
        f"tot AS (SELECT coalesce(sum(withdrawal), 0) AS all_spent FROM {rel})",
        f"mine AS (SELECT count(*) AS transactions, coalesce(sum(withdrawal), 0) AS spent FROM {rel} "
        f"WHERE lower(category) = {t})",
        f"pay AS (SELECT party AS payee, sum(withdrawal) AS payee_spent, count(*) AS payee_transactions FROM {rel} "
        f"WHERE lower(category) = {t} AND party IS NOT NULL AND withdrawal IS NOT NULL GROUP BY party "
        f"ORDER BY payee_spent DESC, payee LIMIT {catalog.SAVINGS_PAYEES})",
        "rk AS (SELECT *, row_number() OVER (ORDER BY payee_spent DESC, payee) AS payee_rank FROM pay)",
    ]
    return with_ctes(ctes, f"""SELECT {t} AS term, transactions, {dbl('spent')} AS spent,
  CASE WHEN transactions > 0 THEN CAST(spent AS DOUBLE) / transactions END AS avg_spent,
  CASE WHEN all_spent > 0 THEN CAST(spent AS DOUBLE) / CAST(all_spent AS DOUBLE) END AS share,
  CAST(payee_rank AS BIGINT) AS payee_rank, payee, {dbl('payee_spent')} AS payee_spent, payee_transactions
FROM mine CROSS JOIN tot LEFT JOIN rk ON TRUE""")


def q_monthly_trend() -> str:
    ctes, rel = rule_enriched_ctes()
    ctes = ctes + [f"m AS (SELECT strftime(txn_date, '%Y-%m') AS month, category, coalesce(sum(withdrawal), 0) AS spent, "
                   f"count(*) AS transactions FROM {rel} WHERE txn_date IS NOT NULL AND category IS NOT NULL "
                   "GROUP BY 1, 2)"]
    before = "strftime(CAST(m.month || '-01' AS DATE) - INTERVAL 1 MONTH, '%Y-%m')"
    return with_ctes(ctes, f"SELECT m.month, m.category, {dbl('m.spent')} AS spent, m.transactions, {dbl('b.spent')} AS prev_spent, "
                           f"{dbl('m.spent - b.spent')} AS change FROM m LEFT JOIN m b ON b.category = m.category "
                           f"AND b.month = {before} ORDER BY m.category, m.month")


# The expected values of the following stand literally in the SQL: nothing is shared with the code under test.
def q_date_formats() -> str:
    return """SELECT o_orderkey AS s_no, CASE
  WHEN o_orderkey % 22 IN (14, 15, 16) THEN NULL WHEN o_orderkey % 22 = 20 THEN '1969-01-01'
  WHEN o_orderkey % 22 = 21 THEN '2068-01-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS txn_date FROM orders"""


def q_amount_quality() -> str:
    return """SELECT o_orderkey AS s_no,
  CASE o_orderkey % 6 WHEN 0 THEN CAST(o_totalprice AS DECIMAL(18,2))::DOUBLE WHEN 4 THEN 1234.5 WHEN 5 THEN 12.0 END AS withdrawal,
  o_orderkey % 6 IN (1, 2) AS amount_unparseable,
  CASE WHEN o_orderkey % 6 IN (1, 2) THEN 'Unclear' ELSE 'Fuel' END AS category,
  CASE WHEN o_orderkey % 6 IN (1, 2) THEN 'Low' ELSE 'High' END AS confidence FROM orders"""


def q_lexicon_long_keywords() -> str:
    return """SELECT o_orderkey AS s_no,
  ['Bills', 'Bills', 'Insurance', 'Unclear', 'Codes'][o_orderkey % 5 + 1] AS category,
  ['Card', '', 'Health', '', 'C1999'][o_orderkey % 5 + 1] AS subcategory,
  ['High', 'High', 'Medium', 'Low', 'High'][o_orderkey % 5 + 1] AS confidence FROM orders"""


def q_overwrite_results() -> str:
    ctes, rel = reading_ctes("st")
    c2, rel2 = category_rule_ctes(rel, party=None)
    return with_ctes([STATEMENT] + ctes + c2, f"SELECT s_no, cleaned_remark, category, subcategory, confidence FROM {rel2}")


def q_enrich_retry() -> str:
    rem = fixtures.REMARK_REPLIES
    s1 = f"e1 AS (SELECT *, {remark_prompt('remarks')} AS _p1 FROM st)"
    s1r = (f"e2 AS (SELECT *, CASE WHEN _p1 IS NOT NULL THEN {pick('length(_p1)', rem)} END AS _r1, "
           f"CASE WHEN _p1 IS NOT NULL THEN {failed('length(_p1)', rem)} END AS _e1 FROM e1)")
    c1, rel1, cleaned, notes = remark_parse("pr", "e2", "_r1", "_e1")
    return with_ctes([STATEMENT, s1, s1r] + c1, f"SELECT s_no, CASE WHEN _p1 IS NULL THEN '' ELSE {cleaned} END AS cleaned_remark, "
                     f"CASE WHEN _p1 IS NULL THEN '' ELSE {notes} END AS notes_doubts FROM {rel1}")


def q_user_word_lists() -> str:
    return """SELECT o_orderkey AS s_no,
  CASE WHEN p_partkey IS NOT NULL THEN 'paid ' || p_brand || ' bill now' END AS purpose,
  CASE WHEN p_partkey IS NOT NULL THEN 'Paid ' || p_brand || ' bill now - PAYEE ' || o_custkey
       ELSE 'Payment to PAYEE ' || o_custkey END AS cleaned_remark,
  CASE WHEN p_partkey IS NOT NULL THEN 'purpose' ELSE 'party' END AS reading_rule,
  coalesce(p_type, 'Code ' || (o_orderkey % 500)) AS category
FROM orders LEFT JOIN part ON p_partkey = o_orderkey % 500"""


def q_similar_remarks() -> str:
    # Equal without one letter at the same place, or one is the other without a letter; closure within the few names of a shop.
    return """WITH RECURSIVE w AS (
  SELECT o_orderkey AS s_no, o_orderkey % 11 + 6 AS pos, 'shop ' || substr(md5(CAST(o_custkey AS VARCHAR)), 1, 12) AS shop FROM orders),
r AS (
  SELECT s_no, CASE s_no % 5 WHEN 1 THEN substr(shop, 1, pos - 1) || substr(shop, pos + 1) WHEN 2 THEN substr(shop, 1, pos - 1) || 'x' || substr(shop, pos + 1)
    WHEN 3 THEN substr(shop, 1, pos) || 'zz' || substr(shop, pos + 1) ELSE shop END AS name FROM w),
k AS (SELECT DISTINCT name FROM r),
d AS (SELECT name, p, substr(name, 1, p - 1) || substr(name, p + 1) AS rest FROM (SELECT name, unnest(range(1, length(name) + 1)) AS p FROM k)),
e AS (
  SELECT x.name AS a, y.name AS b FROM d x JOIN d y ON x.p = y.p AND x.rest = y.rest AND x.name <> y.name
  UNION SELECT d.name, k.name FROM d JOIN k ON k.name = d.rest
  UNION SELECT k.name, d.name FROM d JOIN k ON k.name = d.rest),
c AS (SELECT name, name AS other FROM k UNION SELECT c.name, e.b FROM c JOIN e ON e.a = c.other),
g AS (SELECT name, min(other) AS label FROM c GROUP BY name),
n AS (SELECT label, 'Payment to ' || name AS v, count(*) AS n FROM r JOIN g USING (name) GROUP BY ALL),
b AS (SELECT label, v, row_number() OVER (PARTITION BY label ORDER BY n DESC, v) AS place FROM n)
SELECT s_no, name AS remark_key, g.label AS remark_group, 'Payment to ' || name AS cleaned_remark, b.v AS consensus_remark
FROM r JOIN g USING (name) JOIN b ON b.label = g.label AND b.place = 1"""


def q_templated_calls() -> str:
    # Slashes divide parts; a part of digits, a bank code or a handle is a slot.
    return with_ctes([STATEMENT], f"""SELECT s_no, CASE WHEN {blank('remarks')} THEN '' ELSE {strip("'Seen: ' || remarks")} END AS cleaned_remark,
  CASE WHEN {blank('remarks')} THEN '' ELSE '—' END AS notes_doubts,
  (SELECT count(DISTINCT list_transform(string_split(remarks, '/'), lambda p: CASE WHEN regexp_matches(trim(p), '^[0-9]{{6,}}$|^ICI[0-9a-fA-F]+$|@')
     THEN '<id>' ELSE p END)) FROM st WHERE NOT {blank('remarks')}) AS calls FROM st""")


def q_date_order_by_file() -> str:
    # Files 0, 5, ..: month-first by far; 1, 6, ..: a quarter month-first, so only days over 12 show; 2, 7, ..: one number twice.
    return """WITH d AS (SELECT o_orderkey AS k, o_custkey % 50 AS f, CAST(o_orderdate AS DATE) AS d FROM orders),
v AS (
  SELECT *, CASE WHEN f % 5 = 0 OR (f % 5 = 1 AND k % 4 = 0) THEN 'm' WHEN f % 5 = 2 THEN 'same' WHEN f % 5 = 3 AND k % 3 = 0 THEN 'iso' ELSE 'd' END AS how
  FROM d),
u AS (
  SELECT f, count(*) FILTER (WHERE how = 'd' AND day(d) > 12) AS day_votes, count(*) FILTER (WHERE how = 'm' AND day(d) > 12) AS month_votes
  FROM v GROUP BY f)
SELECT k AS s_no, 'file ' || v.f AS source_file, strftime(CASE
  WHEN how = 'iso' OR (how <> 'same' AND day(d) > 12) THEN d
  WHEN how = 'same' THEN CASE WHEN month(d) <= 9 THEN make_date(year(d), month(d), month(d)) END
  WHEN (how = 'm') = (month_votes > day_votes) THEN d
  ELSE make_date(year(d), day(d), month(d)) END, '%Y-%m-%d') AS txn_date
FROM v JOIN u ON u.f = v.f"""


def q_balance_breaks() -> str:
    return f"""WITH o AS (
  SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey % 20 END AS f,
    CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END * CAST(o_totalprice AS {MONEY}) AS move FROM orders),
t AS (SELECT *, sum(move) OVER (PARTITION BY f ORDER BY k) AS total FROM o),
b AS (SELECT *, CASE WHEN k % 13 <> 0 THEN total + CASE WHEN f % 4 < 2 AND k % 101 = 7 THEN 1 ELSE 0 END END AS balance FROM t),
g AS (SELECT *, balance - sum(move) OVER (PARTITION BY f ORDER BY k) AS gap FROM b),
p AS (SELECT *, last_value(gap IGNORE NULLS) OVER (PARTITION BY f ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM g)
SELECT 'file ' || f AS source_file, count(*) AS transactions, count(gap) AS checked, count(*) FILTER (WHERE gap <> known) AS breaks,
  min(k) FILTER (WHERE gap <> known) AS first_broken FROM p GROUP BY f"""


def q_export_difference() -> str:
    return f"""WITH st AS (
  SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END AS s_no,
    CASE WHEN o_orderkey % 3 = 0 THEN 'Cash' ELSE o_orderpriority END AS remarks,
    CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_totalprice AS {MONEY}) END AS w FROM orders),
a AS (SELECT s_no, remarks, w FROM st WHERE k % 7 <> 0 UNION ALL SELECT s_no, remarks, w FROM st WHERE k % 7 <> 0 AND k % 5 = 0),
c AS (SELECT k, s_no, remarks, w + CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END AS w FROM st WHERE k % 11 <> 0),
b AS (SELECT s_no, remarks, w FROM c UNION ALL SELECT s_no, remarks, w FROM c WHERE k % 17 = 0),
d AS (
  SELECT *, 0 AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
  UNION ALL SELECT *, 1 FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)),
n AS (
  SELECT s_no, remarks, w, count(*) FILTER (WHERE side = 0) AS removed, count(*) FILTER (WHERE side = 1) AS added FROM d GROUP BY ALL),
s AS (SELECT s_no, sum(removed) > 0 AND sum(added) > 0 AS both_sides FROM n WHERE s_no IS NOT NULL GROUP BY s_no)
SELECT n.s_no, remarks, CAST(w AS DOUBLE) AS withdrawal, removed, added,
  CASE WHEN s.both_sides THEN 'changed' WHEN added > 0 THEN 'added' ELSE 'removed' END AS kind
FROM n LEFT JOIN s ON s.s_no = n.s_no"""


def q_incremental_summary() -> str:
    # Of the files by s_no % 8, those of 0 were corrected and those of 1 are gone.
    ctes, cs = categorised_ctes()
    sums = ", ".join(f"{dbl(f'sum({c} + CASE WHEN s_no % 8 = 0 THEN 1 ELSE 0 END)')} AS {c}s" for c in ("withdrawal", "deposit"))
    return with_ctes(ctes + [f"d AS (SELECT *, {date_parse('txn_date_raw')} AS txn_date FROM {cs} WHERE s_no % 8 <> 1)"],
                     f"SELECT category, subcategory, count(*) AS transactions, {sums}, strftime(min(txn_date), '%Y-%m-%d') AS start_date, "
                     "strftime(max(txn_date), '%Y-%m-%d') AS end_date FROM d GROUP BY ALL")


ORACLE = {name[2:]: fn for name, fn in globals().items() if name.startswith("q_")}


def oracle_sql() -> dict[str, str]:
    return {k: ORACLE[k]() for k in catalog.QUERIES if k in ORACLE}
