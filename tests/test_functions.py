import datetime as dt

from pyspark.sql import functions as F

from ledgerlens.functions import money_text, parse_statement_date, py_strip
from ledgerlens.functions.dates import with_statement_date

PY_WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def test_py_strip_matches_python(spark):
    samples = [PY_WHITESPACE + "a b" + PY_WHITESPACE, "​ x", "x", "", PY_WHITESPACE]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r[0] for r in df.select(py_strip("s")).collect()]
    assert got == [s.strip() for s in samples]


def test_money_text(spark):
    vals = ["0.00", "1234567.50", "-0.50", "999.99", "12345678901234.99"]
    df = spark.createDataFrame([(v,) for v in vals], "v string").select(F.col("v").cast("decimal(18,2)").alias("v"))
    got = [r[0] for r in df.select(money_text("v")).collect()]
    from decimal import Decimal
    assert got == [f"₹{Decimal(v):,.2f}" for v in vals]


def test_dates(spark):
    cases = {"24/02/2024": dt.date(2024, 2, 24), "2024-02-01": dt.date(2024, 2, 1),
             "1/2/24": dt.date(2024, 2, 1), "31/02/2024": None, "01-Feb-2024": dt.date(2024, 2, 1),
             "not a date": None, None: None, " 5/6/2023 ": dt.date(2023, 6, 5),
             "2024-02-01 10:00:00": dt.date(2024, 2, 1), "1/2/99": dt.date(1999, 2, 1),
             "05.06.2023": dt.date(2023, 6, 5)}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    col = {r[0]: r[1] for r in df.select("s", parse_statement_date("s")).collect()}
    staged = {r[0]: r[1] for r in with_statement_date(df, "s", "d").collect()}
    for k, v in cases.items():
        assert col[k] == v, k
        assert staged[k] == v, k


def _py_date(s):
    """Plain-Python statement of the day-first rules (first matching shape)."""
    import re
    from ledgerlens.functions.dates import DATE_SHAPES, MONTHS, TWO_DIGIT_YEAR_PIVOT
    if s is None:
        return None
    s = s.strip(" ")
    for pattern, yi, mi, di in DATE_SHAPES:
        m = re.search(pattern, s)
        if not m:
            continue
        y, mo, d = m.group(yi), m.group(mi), m.group(di)
        y = int(y)
        if pattern.endswith(r"(\d{2})$"):
            y += 2000 if y < TWO_DIGIT_YEAR_PIVOT else 1900
        mo = int(mo) if mo.isdigit() else (MONTHS.index(mo.lower()) + 1 if mo.lower() in MONTHS else None)
        try:
            return dt.date(y, mo, int(d)) if mo else None
        except ValueError:
            return None
    return None


def test_dates_match_python_rules_on_generated_text(spark):
    import random
    rnd = random.Random(11)
    names = ["Jan", "feb", "MAR", "Apr", "xyz", "Sep", "dec", "Foo"]
    out = []
    for _ in range(4000):
        d, m, y = rnd.randint(0, 33), rnd.randint(0, 13), rnd.randint(1, 9999)
        shape = rnd.randrange(8)
        out.append([f"{d}/{m}/{y:04d}", f"{d:02d}-{m:02d}-{y:04d}", f"{d}.{m}.{y:04d}",
                    f"{y:04d}-{m}-{d}", f"{y:04d}/{m:02d}/{d:02d}", f"{d}-{rnd.choice(names)}-{y:04d}",
                    f"{d}/{m}/{y % 100:02d}", f" {y:04d}-{m:02d}-{d:02d} 10:30 "][shape])
    df = spark.createDataFrame([(s,) for s in out], "s string")
    got = {r[0]: r[1] for r in with_statement_date(df, "s", "d").collect()}
    bad = [(s, got[s], _py_date(s)) for s in out if got[s] != _py_date(s)]
    assert bad[:5] == []
