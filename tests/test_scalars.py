import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from insidertrail.functions import scalars as S
from insidertrail.operators.footnotes import filing_rollup, with_classes


def values(spark, column, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {kind}")
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_dates(spark):
    got = values(spark, S.day_month_year("x"), ["31-MAR-2025", "1-jan-2020", "32-MAR-2025", "", None, "2020-01-01"])
    assert got == [dt.date(2025, 3, 31), dt.date(2020, 1, 1), None, None, None, None]
    assert values(spark, S.iso_date("x"), ["2025-03-31", " ", "bad"]) == [dt.date(2025, 3, 31), None, None]


def test_numbers_and_keys(spark):
    assert values(spark, S.safe_double("x"), ["1.5", " 2 ", "", "x", "3d", None]) == [1.5, 2.0, None, None, None, None]
    assert values(spark, S.float_text("x"), [12000000.0, 1000.0, 0.5, 12345678.25], "double") == [
        "12000000.0", "1000.0", "0.5", "12345678.25"]
    assert values(spark, S.strip_cik("x"), ["0000123", "000", "", None]) == ["123", "0", "0", "0"]
    assert values(spark, S.is_plausible_cik("x"), ["320193", "10000001", "abc", "", None]) == [
        True, False, False, False, False]


def test_float_text_is_the_shortest_text_that_reads_back(spark):
    rng = random.Random(5)
    given = [0.0, -0.0, 0.5, 1e-4, 1e-05, 1e-07, 12345678.1234561, 12345678.1234562, 1e15, 1e16, 1.5e16, 1e22, 2e-3, 2e23, 0.1 + 0.2,
             123456789012345.67, -0.001, 9007199254740993.0, 1.7976931348623157e308]
    given += [rng.uniform(-1, 1) * 10.0 ** rng.randint(-12, 20) for _ in range(2000)]
    given += [round(rng.uniform(0, 1e6), rng.randint(0, 6)) for _ in range(1000)]
    got = values(spark, S.float_text("x"), given, "double")
    assert [g for g, x in zip(got, given) if abs(x) < 2 ** 53] == [repr(x) for x in given if abs(x) < 2 ** 53]
    assert all(float(g) == x and len(g) <= len(repr(x)) for g, x in zip(got, given))


def test_footnotes_match_whatever_the_case_folding(spark):
    texts = ["dıvıdend reinvestment", "DİVİDEND REINVESTMENT", "Dividend Reinvestment", "nothing", "under a 10B5-1 plan"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = [(r.is_plan, r.mechanical_kinds) for r in with_classes(df).orderBy("i").collect()]
    assert rows == [(False, ["drip"]), (False, ["drip"]), (False, ["drip"]), (False, []), (True, [])]


def test_institution_pattern_needs_a_word_before_ampersand(spark):
    assert values(spark, S.is_institution("x"), ["Smith John", "Foo LLC", "FOO & CO", "FOO& CO", "Vanguard Group", None]) == [
        False, True, False, True, True, False]


def test_titles(spark):
    titles = ["Chief Executive Officer", "Vice President", "President", "EVP", "CFO", "Director", None]
    assert values(spark, S.is_csuite("x"), titles) == [True, False, True, False, True, False, False]
    assert values(spark, S.role_weight("x"), titles) == [1.0, 0.9, 0.9, 0.8, 0.95, 0.6, 0.5]


def test_common_stock_is_tri_state(spark):
    assert values(spark, S.is_common_stock("x"), ["Common Stock", "Preferred Stock", "Ordinary Shares", "Bond", None]) == [
        True, False, True, False, None]


@pytest.mark.parametrize("start", [dt.date(2024, 1, d) for d in range(1, 9)])
def test_weekday_arithmetic(spark, start):
    def slow(n):
        day, left = start, n
        while left:
            day += dt.timedelta(days=1)
            left -= day.weekday() < 5
        return day

    df = spark.createDataFrame([(start, n) for n in (0, 1, 4, 5, 60)], "d date, n int")
    assert [r[0] for r in df.select(S.plus_weekdays("d", F.col("n"))).collect()] == [slow(n) for n in (0, 1, 4, 5, 60)]


def test_right_closed_buckets(spark):
    assert values(spark, S.filing_lag_bucket("x"), [0, 1, 2, 5, 6], "int") == ["same_day", "fast", "fast", "normal", "slow"]
    assert values(spark, S.drawdown_severity("x"), [-0.5, -0.15, -0.05, 0.1, 0.2], "double") == [
        "crash", "moderate_dd", "moderate_dip", "neutral", "strength"]


def test_footnotes(spark):
    notes = [
        ("a", "Sold pursuant to a Rule 10b5-1 trading plan adopted on March 15, 2019."),
        ("b", "This was not made pursuant to a Rule 10b5‑1 trading plan."),
        ("c", "Purchase other than under a 10b51 plan"),
        ("d", "Shares acquired via dividend reinvestment and the 401 (k) plan."),
        ("d", "Bought under the ESPP to meet stock ownership guideline."),
        ("e", "Granted pursuant to his employment agreement."), ("f", "Held by a trust.")]
    df = spark.createDataFrame(notes, "accession_number string, text string")
    rows = {r.text[:12]: r for r in with_classes(df).collect()}
    assert rows["Sold pursuan"].is_plan and rows["Sold pursuan"].plan_adoption_date == "March 15, 2019"
    assert rows["This was not"].plan_negated and not rows["This was not"].is_plan
    assert rows["Purchase oth"].plan_negated
    rolled = {r.accession_number: r for r in filing_rollup(df).collect()}
    assert rolled["d"].fn_mechanical_kinds == ["drip", "espp", "ownership_guideline", "retirement_401k"]
    assert rolled["e"].fn_mechanical_kinds == ["employment_agreement"] and not rolled["f"].fn_mechanical


def test_unknown_atom_is_rejected(spark):
    with pytest.raises(ValueError):
        S.all_atoms(["no_such_atom"])
