"""Scalar column functions: parsing, classification and small arithmetic.

Every function takes and returns ``Column``s made of built-in Spark functions,
so they stay inside whole-stage code generation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from insidertrail.params import SIGNALS

# --- fixed values -----------------------------------------------------------

# Words in a security title that rule out common stock.
NON_COMMON_WORDS = ["preferred", "depositary", "warrant", "unit", "debt", "note", "right", "option"]

# Whole-word markers of an institutional owner name.
INSTITUTION_PATTERN = (
    r"\b("
    r"LLC|L\.?L\.?C\.?|INC\.?|CORP\.?|CORPORATION|COMPANY"
    r"|L\.?P\.?|LIMITED PARTNERSHIP"
    r"|TRUST|FUND|CAPITAL|MANAGEMENT|PARTNERS|HOLDINGS"
    r"|& CO\.?|GROUP|ADVISORS|ASSOCIATES|ENTERPRISES"
    r"|INVESTMENTS|ASSET|PENSION|FOUNDATION"
    r")\b"
)

CSUITE_TITLES = [
    "CEO", "CFO", "COO", "CTO",
    "CHIEF EXECUTIVE OFFICER", "CHIEF FINANCIAL OFFICER",
    "CHIEF OPERATING OFFICER", "CHIEF TECHNOLOGY OFFICER",
    "PRESIDENT", "CHAIRMAN",
]
CEO_TITLES = ["CEO", "CHIEF EXECUTIVE OFFICER"]
CFO_TITLES = ["CFO", "CHIEF FINANCIAL OFFICER"]

# Title fragment -> role weight; the first fragment found in the title wins.
ROLE_WEIGHTS = [
    ("CHIEF EXECUTIVE OFFICER", 1.0),
    ("CHIEF FINANCIAL OFFICER", 0.95),
    ("CHIEF OPERATING OFFICER", 0.9),
    ("CHIEF TECHNOLOGY OFFICER", 0.85),
    ("DIRECTOR", 0.6),
    ("PRESIDENT", 0.9),
    ("EXECUTIVE VICE PRESIDENT", 0.8),
    ("SENIOR VICE PRESIDENT", 0.75),
    ("VICE PRESIDENT", 0.7),
    ("10% OWNER", 0.5),
    ("OTHER OFFICER", 0.65),
    ("CEO", 1.0),
    ("CFO", 0.95),
    ("COO", 0.9),
    ("CTO", 0.85),
    ("EVP", 0.8),
    ("SVP", 0.75),
    ("VP", 0.7),
]

# Sector name -> sector fund, in the taxonomy used by outcome computation.
OUTCOME_SECTOR_FUNDS = {
    "Technology": "XLK", "Healthcare": "XLV", "Financials": "XLF",
    "Consumer Discretionary": "XLY", "Consumer Staples": "XLP", "Energy": "XLE",
    "Industrials": "XLI", "Materials": "XLB", "Real Estate": "XLRE",
    "Utilities": "XLU", "Communication Services": "XLC",
}
# The same funds in the taxonomy stored with company profiles.
PROFILE_SECTOR_FUNDS = {
    "Technology": "XLK", "Healthcare": "XLV", "Financial Services": "XLF",
    "Consumer Cyclical": "XLY", "Consumer Defensive": "XLP", "Energy": "XLE",
    "Industrials": "XLI", "Basic Materials": "XLB", "Real Estate": "XLRE",
    "Utilities": "XLU", "Communication Services": "XLC",
}

# Dash variants seen between "10b5" and "1" in filings: '-' and U+2010..U+2015.
PLAN_PATTERN = "10b5[-‐-―]?1"
PLAN_NEGATED_PATTERN = (
    r"(?:not|other\s+than)[^.]{0,80}?(?:pursuant\s+to|under)[^.]{0,40}?" + PLAN_PATTERN
)
PLAN_ADOPTED_PATTERN = (
    r"(?:adopted|entered\s+into|dated)\s+(?:on\s+|as\s+of\s+)?([A-Z][a-z]+\s+\d{1,2},?\s+\d{4})"
)
MECHANICAL_PATTERNS = [
    ("drip", r"dividend\s+reinvestment"),
    ("retirement_401k", r"401\s*\(\s*k\s*\)"),
    ("espp", r"employee\s+stock\s+purchase\s+plan|\bESPP\b"),
    ("deferred_comp", r"deferred\s+compensation"),
    ("ownership_guideline", r"(?:stock|share)\s+ownership\s+(?:guideline|requirement)"),
    ("employment_agreement",
     r"(?:pursuant\s+to|under)\s+(?:his|her|the|an)\s+employment\s+agreement"),
]

MAX_PLAUSIBLE_CIK = 10_000_000

# --- text to typed values ---------------------------------------------------


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def blank_to_null(col: Column | str) -> Column:
    """Trimmed text, with blank text as NULL."""
    return F.nullif(F.trim(_c(col)), F.lit(""))


def day_month_year(col: Column | str) -> Column:
    """'31-MAR-2025' -> date; anything else -> NULL."""
    return F.try_to_date(F.trim(_c(col)), "d-MMM-yyyy")


def iso_date(col: Column | str) -> Column:
    """'2025-03-31' -> date; anything else -> NULL."""
    return F.try_to_date(F.trim(_c(col)), "yyyy-M-d")


def safe_double(col: Column | str) -> Column:
    """Text to double; blank or malformed text is NULL."""
    text = F.trim(_c(col))
    # The JVM parser also takes type suffixes such as '1d'; those are not numbers here.
    return F.when(~text.rlike(r"[0-9.][dDfF]$"), text.try_cast("double"))


def relationship_flags(col: Column | str) -> dict[str, Column]:
    """Comma list of relationships -> officer / director / ten-percent-owner flags."""
    parts = F.transform(F.split(F.lower(F.coalesce(_c(col), F.lit(""))), ","), lambda x: F.trim(x))
    return {
        "is_officer": F.array_contains(parts, "officer"),
        "is_director": F.array_contains(parts, "director"),
        "is_ten_pct_owner": F.array_contains(parts, "tenpercentowner"),
    }


def strip_cik(col: Column | str) -> Column:
    """Drop leading zeros; an empty or all-zero key becomes '0'."""
    bare = F.regexp_replace(F.trim(F.coalesce(_c(col), F.lit(""))), "^0+", "")
    return F.when(bare == "", F.lit("0")).otherwise(bare)


def pad_cik(col: Column | str) -> Column:
    text = _c(col).cast("string")
    return F.when(F.length(text) >= 10, text).otherwise(F.lpad(text, 10, "0"))


def is_plausible_cik(col: Column | str) -> Column:
    text = F.trim(F.coalesce(_c(col).cast("string"), F.lit("")))
    digits = F.regexp_replace(text, "^0+", "")
    small = F.coalesce(digits.try_cast("bigint"), F.lit(0)) <= MAX_PLAUSIBLE_CIK
    return text.rlike("^[0-9]+$") & (F.length(digits) <= 8) & small


# --- classification ---------------------------------------------------------


def is_common_stock(title: Column | str) -> Column:
    """True / False for a known title, NULL for an unknown one."""
    lower = F.lower(_c(title))
    return (
        F.when(lower.isNull(), F.lit(None).cast("boolean"))
        .when(lower.rlike("|".join(NON_COMMON_WORDS)), F.lit(False))
        .otherwise(lower.contains("stock") | lower.contains("share"))
    )


def plan_flag(col: Column | str) -> Column:
    """'1'/'true' -> True, '0'/'false' -> False, anything else -> NULL."""
    text = F.lower(F.trim(_c(col)))
    return (F.when(text.isin("1", "true"), F.lit(True))
            .when(text.isin("0", "false"), F.lit(False)))


def is_discretionary(code: Column | str) -> Column:
    return F.coalesce(_c(code) == "P", F.lit(False))


def is_institution(name: Column | str) -> Column:
    return F.coalesce(_c(name).rlike("(?i)" + INSTITUTION_PATTERN), F.lit(False))


def _title_in(title: Column | str, phrases: list[str]) -> Column:
    upper = F.upper(_c(title))
    hit = upper.rlike(r"\b(?:" + "|".join(phrases) + r")\b") & ~upper.contains("VICE")
    return F.coalesce(hit, F.lit(False))


def is_csuite(title: Column | str) -> Column:
    return _title_in(title, CSUITE_TITLES)


def is_ceo(title: Column | str) -> Column:
    return _title_in(title, CEO_TITLES)


def is_cfo(title: Column | str) -> Column:
    return _title_in(title, CFO_TITLES)


def role_weight(title: Column | str, default: float = SIGNALS.default_role_weight) -> Column:
    upper = F.upper(_c(title))
    chain = F.when(F.coalesce(upper, F.lit("")) == "", F.lit(default))
    for fragment, weight in ROLE_WEIGHTS:
        chain = chain.when(upper.contains(fragment), F.lit(weight))
    return chain.otherwise(F.lit(default))


def role_category(is_officer: Column | str, is_director: Column | str) -> Column:
    return (F.when(_c(is_officer), F.lit("officer"))
            .when(_c(is_director), F.lit("director"))
            .otherwise(F.lit("10pct_owner")))


def role_title_or_fallback(title: Column, is_director: Column, is_owner: Column) -> Column:
    return (F.when(F.coalesce(title, F.lit("")) != "", title)
            .when(is_director, F.lit("Director"))
            .when(is_owner, F.lit("10% Owner"))
            .otherwise(F.lit("Other")))


def sector_fund(sector: Column | str, taxonomy: dict[str, str] = OUTCOME_SECTOR_FUNDS) -> Column:
    pairs = [F.lit(v) for kv in taxonomy.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), _c(sector))


def is_ticker(col: Column | str) -> Column:
    return F.coalesce(F.upper(F.trim(_c(col))).rlike(r"^[A-Z0-9.\-]{1,10}$"), F.lit(False))


# --- values and keys --------------------------------------------------------


def truthy(col: Column | str) -> Column:
    """A number, with zero treated as missing."""
    return F.nullif(_c(col), F.lit(0.0))


def total_value(shares: Column | str, price: Column | str) -> Column:
    return truthy(shares) * truthy(price)


def float_text(col: Column | str) -> Column:
    """Shortest text that reads back as the double: '12000000.0', '0.5', '1e-07', '1e+16'.

    Plain notation from 1e-4 up to 1e16, else one digit before the point and an exponent of at least two digits.
    Beyond 2^53, where several texts of one length read back, it need not be the nearest of them.
    """
    value = _c(col)
    size = F.abs(value)
    texts = [F.format_string(f"%.{digits}e", size) for digits in (14, 15, 16)]
    exact = F.when(texts[0].cast("double") == size, texts[0]).when(
        texts[1].cast("double") == size, texts[1]).otherwise(texts[2])
    digits = F.rtrim(F.replace(F.substring_index(exact, "e", 1), F.lit("."), F.lit("")), F.lit("0"))
    power = F.substring_index(exact, "e", -1).cast("int")
    whole = F.substr(F.rpad(digits, power + 1, F.lit("0")), F.lit(1), power + 1)
    rest = F.substr(digits, power + 2)
    plain = F.when(power >= 0, F.concat(whole, F.lit("."), F.when(rest == "", F.lit("0")).otherwise(rest))).otherwise(
        F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
    tail = F.substr(digits, F.lit(2))
    scientific = F.concat(
        F.substr(digits, F.lit(1), F.lit(1)), F.when(tail == "", F.lit("")).otherwise(F.concat(F.lit("."), tail)),
        F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")), F.when(F.abs(power) < 10, F.lit("0")).otherwise(F.lit("")),
        F.abs(power).cast("string"))
    text = (F.when(size == 0, F.lit("0.0")).when((power >= -4) & (power < 16), plain).otherwise(scientific))
    sign = F.when((value < 0) | (value.cast("string") == "-0.0"), F.lit("-")).otherwise(F.lit(""))
    # Nearly all numbers of shares are whole; they need no search for the shortest text.
    counted = value.cast("bigint")
    return (F.when((size > 0) & (size < 2.0 ** 53) & (counted.cast("double") == value), F.concat(counted.cast("string"), F.lit(".0")))
            .when(F.isnan(value), F.lit("nan")).when(size == float("inf"), F.concat(sign, F.lit("inf")))
            .otherwise(F.concat(sign, text)))


def transaction_key(accession: Column | str, code: Column | str, trade_date: Column | str,
                    shares: Column | str) -> Column:
    """accession_code_date_shares; a missing date leaves its slot empty."""
    return F.concat_ws("_", _c(accession), _c(code),
                       F.coalesce(_c(trade_date).cast("string"), F.lit("")),
                       float_text(shares))


def raw_accession(key: Column | str) -> Column:
    return F.substring_index(_c(key), "_", 1)


def simple_return(start: Column, end: Column) -> Column:
    return F.when(start == 0, F.lit(0.0)).otherwise(end / start - 1.0)


def filing_lag_days(trade_date: Column | str, filing_date: Column | str) -> Column:
    days = F.datediff(_c(filing_date), _c(trade_date))
    return F.when(days < 0, F.lit(0)).otherwise(days)


def filing_lag_bucket(days: Column | str) -> Column:
    d = _c(days)
    return (F.when(d.isNull(), F.lit(None).cast("string"))
            .when(d <= 0, "same_day").when(d <= 2, "fast").when(d <= 5, "normal")
            .otherwise("slow"))


def drawdown_severity(ret: Column | str) -> Column:
    r = _c(ret)
    return (F.when(r.isNull(), F.lit(None).cast("string"))
            .when(r <= -0.40, "crash").when(r <= -0.25, "severe")
            .when(r <= -0.15, "moderate_dd").when(r <= -0.05, "moderate_dip")
            .when(r <= 0.10, "neutral").otherwise("strength"))


def plus_weekdays(day: Column | str, n: Column | int) -> Column:
    """The n-th Monday-to-Friday day after ``day``."""
    d = _c(day)
    count = F.lit(n) if isinstance(n, int) else n
    monday0 = F.weekday(d)
    slot = F.least(monday0, F.lit(4))
    total = slot + count
    shift = -monday0 + F.floor(total / 5).cast("int") * 7 + F.pmod(total, F.lit(5))
    return F.when(count <= 0, d).otherwise(F.date_add(d, shift.cast("int")))


def value_in_bounds(value: Column | str, low: float = SIGNALS.min_event_value,
                    high: float = SIGNALS.max_event_value) -> Column:
    return _c(value).between(low, high)


# --- footnotes --------------------------------------------------------------


def footnote_classes(text: Column | str) -> dict[str, Column]:
    """Plan and mechanical-purchase markers."""
    t = _c(text)
    mentions = t.rlike("(?iU)" + PLAN_PATTERN)
    negated = mentions & t.rlike("(?iU)" + PLAN_NEGATED_PATTERN)
    adopted = F.when(mentions & ~negated, F.regexp_extract(t, "(?U)" + PLAN_ADOPTED_PATTERN, 1))
    kinds = F.array_compact(F.array(*[F.when(t.rlike("(?iU)" + pattern), F.lit(kind))
                                      for kind, pattern in MECHANICAL_PATTERNS]))
    return {
        "is_plan": mentions & ~negated,
        "plan_negated": negated,
        "plan_adoption_date": F.nullif(adopted, F.lit("")),
        "mechanical_kinds": kinds,
    }


# --- research atoms ---------------------------------------------------------

ATOMS = {
    "cluster_2plus": lambda: F.coalesce(F.col("cluster_size") >= 2, F.lit(False)),
    "senior_role": lambda: is_csuite("role_title"),
    "value_100k": lambda: F.coalesce(F.col("total_value") >= 100_000, F.lit(False)),
    "not_10b5_1": lambda: ~F.coalesce(F.col("is_10b5_1_plan"), F.lit(False)),
    "opportunistic": lambda: ~F.coalesce(F.col("is_routine"), F.lit(False)),
    "first_buy": lambda: F.coalesce(F.col("is_first_buy"), F.lit(False)),
}


def all_atoms(names: list[str], atoms: dict = ATOMS) -> Column:
    """AND of named atoms; an empty list accepts every row."""
    unknown = [n for n in names if n not in atoms]
    if unknown:
        raise ValueError(f"unknown atom(s): {unknown}")
    return reduce(lambda a, b: a & b, [atoms[n]() for n in names], F.lit(True))
