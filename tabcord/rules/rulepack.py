"""The ``tbl_*`` conventions: table names, column names and thresholds.

Fixed values: names and numbers below must stay as they are for the checks to
give the agreed results.
"""

from __future__ import annotations

FACT = "tbl_DetailedData"
MAPPING = "tbl_Key_Mapping"
FORECAST = "tbl_Forecast"
TREND = "tbl_Trend"
MIN_LOAD = "tbl_Min_Large_Load"
RATE_TABLES = ("tbl_RateChange", "tbl_RateChange_Pol")
PATTERN_TABLES = ("tbl_Patterns_Attr", "tbl_Patterns_Large", "tbl_Patterns_Prem")

KNOWN_TABLES = (
    "tbl_DetailedData",
    "tbl_RateChange",
    "tbl_Trend",
    "tbl_Patterns_Attr",
    "tbl_Patterns_Large",
    "tbl_Patterns_Prem",
    "tbl_Forecast",
    "tbl_Key_Mapping",
    "tbl_RateChange_Pol",
    "tbl_IELR_Attr",
    "tbl_IELR_Large",
    "tbl_ULR_Prior_Attr",
    "tbl_ULR_Prior_Large",
    "tbl_Min_Large_Load",
    "tbl_Weight_HistYears",
)

MEASURE = "Premium"
MONTH = "AsAt_Month"
KEY_PREFIX = "Key_"
EXEMPT_KEY = "Key_Forecast"
MODELLING_PREFIX = "Key_Modelling"
STRUCTURAL = ("AY", "UWY", "UY", "DevM")
YEARS = ("AY", "UWY", "UY")
DEVELOPMENT = "DevM"
RATE = "RateChange"
TREND_VALUE = "Trend_Value"
DEVELOPMENT_PREFIX = "DevPct_"
MIN_LOAD_PREFIX = "MinLoad_"

RATE_BANDS = {"inner": 0.2, "outer": 0.5, "warn_pct": 10, "fail_pct": 50}
DEVELOPMENT_LIMITS = {
    "ceiling": 1,
    "mean_lo": 0.7,
    "mean_hi": 1.0,
    "warn_pct": 5,
    "fail_pct": 20,
}
SEQUENCE_LIMITS = {"start": 1, "min_last": 120}
MIN_LOAD_LIMITS = {"ceiling": 3, "min_pct": 95}

TOP_ROWS = 10
EVIDENCE_ROWS = 20

# section id -> (label, unit of the summary)
SECTIONS = {
    "check1": ("Check 1 — Key Column Registration", "table(s) checked"),
    "checks2_5": (
        "Checks 2–5 — Referential Integrity, Row Uniqueness & Parent Columns",
        "table(s) checked",
    ),
    "check6": ("Check 6 — Mapping Table Uniqueness", ""),
    "check7": ("Check 7 — Value Range Checks", "column check(s) performed"),
    "check8": ("Check 8 — Key_Modelling Coverage", "Key_Modelling column(s) checked"),
}
