"""Small table set with known defects (fixed values) and its schemas."""

KEYS = ("RateChange", "Trend", "Pattern_Attr", "Pattern_Large", "Pattern_Prem")
KEY_DDL = ", ".join(f"Key_{k} string" for k in KEYS)

SCHEMAS = {
    "tbl_DetailedData": "AsAt_Month int, Premium double, Segment string, Region string, "
    f"LOB string, {KEY_DDL}, Key_Forecast string",
    "tbl_Key_Mapping": f"Segment string, Region string, LOB string, {KEY_DDL}",
    "tbl_RateChange": "Key_RateChange string, Region string, RateChange double",
    "tbl_RateChange_Pol": "Key_RateChange string, RateChange double",
    "tbl_Trend": "Key_Trend string, Region string, Trend_Value double",
    "tbl_Patterns_Attr": "Key_Pattern_Attr string, DevM bigint, DevPct_Incd_Attr double, "
    "DevPct_Paid_Attr double",
    "tbl_Patterns_Large": "Key_Pattern_Large string, DevM bigint, DevPct_Incd_Large double",
    "tbl_Patterns_Prem": "Key_Pattern_Prem string, DevM bigint, DevPct_Premium double",
    "tbl_Forecast_Adjustment": "Key_Forecast string, ForecastAdj double",
}

ROWS = {
    "tbl_DetailedData": [
        (202604, 100000.0, "S1", "North", "Motor", "RC_A", "TR_A", "PA_A", "PL_A", "PP_A", "F1"),
        (202604, 80000.0, "S2", "South", "Motor", "RC_B", "TR_B", "PA_B", "PL_B", "PP_B", "F1"),
        (202604, 60000.0, "S3", "East", "Property", "RC_MISS", "TR_A", "PA_A", "PL_A", "PP_A", "F1"),
        (202613, 50000.0, "S4", "West", "Liability", "RC_A", "TR_MISS", "PA_C", "PL_C", "PP_C", "F2"),
    ],
    "tbl_Key_Mapping": [
        ("S1", "North", "Motor", "RC_A", "TR_A", "PA_A", "PL_A", "PP_A"),
        ("S2", "South", "Motor", "RC_B", "TR_B", "PA_B", "PL_B", "PP_B"),
        ("S3", "East", "Property", "RC_C", "TR_C", "PA_A", "PL_A", "PP_A"),
        ("S4", "West", "Liability", "RC_A", "TR_D", "PA_C", "PL_C", "PP_C"),
        ("S2", "South", "Motor", "RC_B", "TR_BX", "PA_B", "PL_B", "PP_B"),
    ],
    "tbl_RateChange": [
        ("RC_A", "North", 0.05),
        ("RC_B", "South", 0.9),
        ("RC_C", "East", -0.8),
        ("RC_ORPHAN", "West", 0.01),
    ],
    "tbl_RateChange_Pol": [("RC_A", 0.02), ("RC_B", 0.6), ("RC_C", -0.55)],
    "tbl_Trend": [
        ("TR_A", "North", 0.03),
        ("TR_B", "South", 0.4),
        ("TR_C", "East", -0.1),
        ("TR_ORPHAN", "West", 0.02),
    ],
    "tbl_Patterns_Attr": [
        ("PA_A", 1, 0.2, 0.15),
        ("PA_A", 2, 0.45, 0.35),
        ("PA_A", 4, 1.25, 1.1),
        ("PA_B", 2, 0.8, 0.75),
        ("PA_C", 1, 1.3, 1.25),
    ],
    "tbl_Patterns_Large": [
        ("PL_A", 1, 0.3),
        ("PL_A", 2, 0.5),
        ("PL_B", 1, 0.95),
        ("PL_B", 3, 1.4),
        ("PL_C", 5, 1.2),
    ],
    "tbl_Patterns_Prem": [
        ("PP_A", 1, 0.25),
        ("PP_A", 2, 0.55),
        ("PP_B", 1, 0.9),
        ("PP_B", 2, 1.1),
        ("PP_C", 10, 1.3),
    ],
    "tbl_Forecast_Adjustment": [("F1", 1.02), ("F2", 0.98)],
}


def tables(spark):
    return {n: spark.createDataFrame(ROWS[n], ddl) for n, ddl in SCHEMAS.items()}
