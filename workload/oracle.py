"""SQL for DuckDB that computes each registered query from the same tables."""

from __future__ import annotations

FORWARD = """
  WITH total AS (SELECT sum(n_chars)::DOUBLE AS total FROM documents)
  SELECT doc_id, sum(n_chars)::DOUBLE AS n_chars,
         round_even(sum(n_chars)::DOUBLE / (SELECT total FROM total) * 100, 1)::DOUBLE AS pct
  FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
  GROUP BY doc_id
"""

SALES = """
  sales AS (
    SELECT c_mktsegment AS seg, n_name AS nat, r_name AS reg, p_brand AS brand, p_type AS ptype,
           o_orderpriority AS prio, year(o_orderdate) * 100 + month(o_orderdate) AS month,
           floor(c_acctbal / 1000)::BIGINT AS bal, l_extendedprice::DECIMAL(18,2) AS price
    FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey
    JOIN part ON l_partkey = p_partkey)
"""

RULE_TABLES = f"""
  {SALES},
  dd AS (
    SELECT month AS AsAt_Month, price AS Premium, seg AS Segment, reg AS Region, nat AS Nation,
           ptype AS ProductType, brand AS Key_RateChange, nat || ' ' || bal AS Key_Trend,
           prio AS Key_Pattern_Attr,
           CASE WHEN prio <> '4-NOT SPECIFIED' THEN seg END AS Key_Modelling,
           CASE WHEN ptype = 'MEDIUM' THEN ' ' ELSE ptype END AS Key_Modelling_Type
    FROM sales),
  who AS (
    SELECT c_mktsegment AS seg, n_name AS nat, r_name AS reg, c_acctbal
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
  mapping AS (
    SELECT DISTINCT seg AS Segment, reg AS Region, nat AS Nation,
           nat || ' ' || floor(c_acctbal / 1000)::BIGINT AS Key_Trend,
           seg AS Key_Modelling,
           CASE WHEN c_acctbal > 0 THEN 'POS' ELSE 'NEG' END AS Key_Pattern_Attr
    FROM who),
  rate AS (
    SELECT p_brand AS Key_RateChange, p_type AS ProductType,
           (p_size - 45)::DOUBLE / 10 AS RateChange
    FROM part),
  rate_pol AS (
    SELECT p_brand AS Key_RateChange, p_size::DOUBLE / 10 AS RateChange
    FROM part),
  trend AS (
    SELECT n_name || ' ' || floor(s_acctbal / 1000)::BIGINT AS Key_Trend, 'P' || floor(s_acctbal / 1000)::BIGINT AS Trend_Period,
           s_acctbal / 20000 AS Trend_Value
    FROM supplier JOIN nation ON s_nationkey = n_nationkey),
  pattern AS (
    SELECT o_orderpriority AS Key_Pattern_Attr,
           (year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS DevM,
           sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*)::DOUBLE / 260000.0::DOUBLE
             AS DevPct_Incd_Attr
    FROM orders GROUP BY ALL),
  forecast AS (
    SELECT nat AS Key_Forecast, seg AS Key_Modelling,
           CASE WHEN c_acctbal >= 0 THEN reg ELSE 'OFFSHORE' END AS Region, reg AS Area,
           sum(c_acctbal::DECIMAL(18,2)) AS Forecast_Premium
    FROM who GROUP BY ALL),
  load AS (
    SELECT p_brand AS Key_RateChange,
           CASE WHEN p_size = 50 THEN 'EXTRA ' || p_type ELSE p_type END AS ProductType,
           p_size / 12.5::DOUBLE AS MinLoad_Attr, p_size AS MinLoad_Large,
           p_name AS MinLoad_Note
    FROM part)
"""


def duplicates(table: str, keys: str) -> str:
    return f"SELECT {keys}, count(*) AS n FROM {table} GROUP BY {keys} HAVING count(*) > 1"


def uniqueness_row(name: str, table: str, keys: str) -> str:
    return f"""
      SELECT '{name}' AS table_name, '{keys}' AS key_cols, count(*) AS n_duplicates,
             coalesce(sum(n), 0)::BIGINT AS n_rows,
             CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END AS status
      FROM ({duplicates(table, keys)})"""


def parent_row(table: str, key: str, column: str) -> str:
    return f"""
      SELECT '{key}' AS key_col, '{column}' AS column_name, count(*) FILTER (bad) AS n_bad_keys,
             count(*) FILTER (bad) = 0 AS is_parent
      FROM (SELECT {key}, coalesce(min({column}) <> max({column}), false) AS bad
            FROM {table} GROUP BY {key})"""


def band_row(name: str, value: str, source: str, inner: str = "0.2", outer: str = "0.5") -> str:
    """Counts of one column; the thresholds 10 and 50 are applied by ``band_rows``."""
    return f"""
      SELECT '{name}' AS column_name, count({value}) AS n,
             count(*) FILTER (abs({value}) > {inner}::DOUBLE)::DOUBLE / count({value}) * 100 AS p_in,
             count(*) FILTER (abs({value}) > {outer}::DOUBLE)::DOUBLE / count({value}) * 100 AS p_out
      FROM {source}"""


def band_rows(rows: list[str], inner: str = "0.2", outer: str = "0.5") -> str:
    return f"""
      SELECT column_name, n, round_even(p_in, 1)::DOUBLE AS pct_inner,
             round_even(p_out, 1)::DOUBLE AS pct_outer,
             CASE WHEN p_out > 50 THEN 'FAIL' WHEN p_in > 10 THEN 'WARNING' ELSE 'PASS' END
               AS status,
             CASE WHEN p_out > 50
                  THEN printf('%.1f%% outside [−{outer}, +{outer}]', round_even(p_out, 1)::DOUBLE)
                       || ' — likely entered as percentages not decimals'
                  ELSE printf('%.1f%% outside [−{inner}, +{inner}]', round_even(p_in, 1)::DOUBLE)
             END AS detail
      FROM ({" UNION ALL ".join(rows)})"""


def exceed_row(name: str, value: str, source: str) -> str:
    return f"""
      SELECT '{name}' AS column_name, count({value}) AS n, avg({value}) AS m,
             count(*) FILTER ({value} > 1)::DOUBLE / count({value}) * 100 AS p
      FROM {source}"""


def exceed_rows(rows: list[str]) -> str:
    return f"""
      SELECT column_name, n, round_even(m, 4)::DOUBLE AS mean, round_even(p, 1)::DOUBLE AS pct_above,
             CASE WHEN p > 20 THEN 'FAIL' WHEN m < 0.7 OR m > 1 OR p > 5 THEN 'WARNING'
                  ELSE 'PASS' END AS status,
             CASE WHEN p > 20
                  THEN printf('%.1f%% of values > 1 (threshold: >20%%)', round_even(p, 1)::DOUBLE)
                  ELSE printf('Mean = %.4f; %.1f%% of values > 1', round_even(m, 4)::DOUBLE,
                              round_even(p, 1)::DOUBLE) END AS detail
      FROM ({" UNION ALL ".join(rows)})"""


def numeric_row(name: str, value: str, source: str, ceiling: str) -> str:
    return f"""
      SELECT '{name}' AS column_name, count(*) AS n,
             count({value}) - count(try_cast({value} AS DOUBLE)) AS n_non_numeric,
             coalesce(count(*) FILTER (try_cast({value} AS DOUBLE) < {ceiling})::DOUBLE
                      / nullif(count(try_cast({value} AS DOUBLE)), 0) * 100, 100) AS p
      FROM {source}"""


def sequence_sql(table: str, key: str, pos: str, label: str, min_last: int, shown: int) -> str:
    return f"""
      WITH held AS (SELECT DISTINCT {key}, {pos}::BIGINT AS p FROM {table} WHERE {pos} IS NOT NULL),
        spans AS (
          SELECT {key}, min(p) AS first_pos, max(p) AS last_pos,
                 max(p) - min(p) + 1 - count(*) AS n_gaps
          FROM held GROUP BY {key}),
        missing AS (
          SELECT {key}, p, row_number() OVER (PARTITION BY {key} ORDER BY p) AS nth
          FROM (SELECT {key}, unnest(generate_series(first_pos, last_pos)) AS p FROM spans
                WHERE n_gaps > 0) x
          WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.{key} = x.{key} AND h.p = x.p)),
        listed AS (
          SELECT {key}, string_agg(p, ', ' ORDER BY p) AS gaps FROM missing WHERE nth <= {shown}
          GROUP BY {key})
      SELECT {key}, first_pos, last_pos, n_gaps, coalesce(gaps, '') AS gaps,
             concat_ws('; ',
               CASE WHEN first_pos <> 1 THEN 'starts at ' || first_pos || ' (expected 1)' END,
               CASE WHEN n_gaps > 0 THEN 'gaps at [' || gaps || ']'
                    || CASE WHEN n_gaps > {shown} THEN '…' ELSE '' END END,
               CASE WHEN last_pos < {min_last}
                    THEN 'max {label} = ' || last_pos || ' (< {min_last} required)' END) AS reasons
      FROM spans LEFT JOIN listed USING ({key})
      WHERE first_pos <> 1 OR n_gaps > 0 OR last_pos < {min_last}"""


def ri_row(name: str, table: str, keys: list[str], ref_measure: str | None = None) -> str:
    """Both integrity findings of one rule-pack reference table."""
    on = " AND ".join(f"r.{k} IS NOT DISTINCT FROM d.{k}" for k in keys)
    k = ", ".join(keys)
    unused = f"FROM {table} d WHERE NOT EXISTS (SELECT 1 FROM dd r WHERE {on})"
    balance = f"(SELECT sum({ref_measure})::DOUBLE {unused})" if ref_measure else "NULL::DOUBLE"
    unmatched = f"""FROM (SELECT {k}, sum(Premium) AS p FROM dd GROUP BY {k}) d
                    WHERE NOT EXISTS (SELECT 1 FROM {table} r WHERE {on})"""
    return f"""
      SELECT 'checks2_5' AS section, 'forward_ri' AS check_name, '{name}' AS table_name,
             NULL::VARCHAR AS column_name, '{k}' AS key_cols,
             CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END AS status, n AS n_bad,
             m AS measure_bad,
             round_even(m / (SELECT sum(Premium)::DOUBLE FROM dd) * 100, 1)::DOUBLE AS pct
      FROM (SELECT count(*) AS n, sum(p)::DOUBLE AS m {unmatched})
      UNION ALL
      SELECT 'checks2_5', 'reverse_ri', '{name}', NULL, '{k}',
             CASE WHEN n > 0 THEN 'WARNING' ELSE 'PASS' END, n, m, NULL
      FROM (SELECT count(*) AS n, {balance} AS m
            FROM (SELECT DISTINCT {k} FROM {table}) d
            WHERE NOT EXISTS (SELECT 1 FROM dd r WHERE {on}))"""


#: Reference tables of the rule pack with their join keys.
JOIN_KEYS = {
    "tbl_RateChange": ("rate", ["Key_RateChange", "ProductType"]),
    "tbl_RateChange_Pol": ("rate_pol", ["Key_RateChange"]),
    "tbl_Trend": ("trend", ["Key_Trend"]),
    "tbl_Patterns_Attr": ("pattern", ["Key_Pattern_Attr"]),
    "tbl_Forecast": ("forecast", ["Key_Modelling", "Region"]),
    "tbl_Min_Large_Load": ("load", ["Key_RateChange", "ProductType"]),
}


def loose_rows(fact: str, forward: bool) -> str:
    """Every key of one side that the other lacks, for all reference tables."""
    names = {
        "key_rate": "Key_RateChange",
        "product": "ProductType",
        "key_trend": "Key_Trend",
        "key_pattern": "Key_Pattern_Attr",
        "key_modelling": "Key_Modelling",
        "region": "Region",
    }
    parts = []
    for name, (table, keys) in JOIN_KEYS.items():
        mine, other = (fact, table) if forward else (table, fact)
        on = " AND ".join(f"o.{k} IS NOT DISTINCT FROM m.{k}" for k in keys)
        cells = ", ".join(f"{k if k in keys else 'NULL::VARCHAR'} AS {n}" for n, k in names.items())
        measure = "NULL::DOUBLE"
        if forward:
            measure = "sum(Premium)::DOUBLE"
        elif name == "tbl_Forecast":
            measure = "sum(Forecast_Premium)::DOUBLE"
        parts.append(
            f"""
            SELECT '{name}' AS table_name, {cells}, {measure} AS measure FROM {mine} m
            WHERE NOT EXISTS (SELECT 1 FROM {other} o WHERE {on}) GROUP BY {", ".join(keys)}"""
        )
    return " UNION ALL ".join(parts)


def finding(
    section: str, check: str, table: str, status: str, n_bad: str, source: str,
    column: str = "NULL", keys: str = "NULL", measure: str = "NULL", pct: str = "NULL",
) -> str:
    return f"""
      SELECT '{section}' AS section, '{check}' AS check_name, {table} AS table_name,
             {column}::VARCHAR AS column_name, {keys}::VARCHAR AS key_cols, {status} AS status,
             {n_bad}::BIGINT AS n_bad, {measure}::DOUBLE AS measure_bad, {pct}::DOUBLE AS pct
      FROM {source}"""


def _pass_fail(n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN 'FAIL' ELSE 'PASS' END"


def _run_rows() -> str:
    """One row per finding of the whole run."""
    rows = []
    # check 1: the mapping lacks Key_RateChange; Key_Forecast is exempt
    registered = {
        "tbl_RateChange": ("Key_RateChange", 1),
        "tbl_RateChange_Pol": ("Key_RateChange", 1),
        "tbl_Trend": ("Key_Trend", 0),
        "tbl_Patterns_Attr": ("Key_Pattern_Attr", 0),
        "tbl_Forecast": ("Key_Forecast, Key_Modelling", 0),
        "tbl_Min_Large_Load": ("Key_RateChange", 1),
    }
    for t, (keys, n) in registered.items():
        rows.append(
            finding(
                "check1", "key_registration", f"'{t}'", _pass_fail(str(n)), str(n),
                "(SELECT 1)", keys=f"'{keys}'",
            )
        )
    rows += [
        ri_row("tbl_RateChange", "rate", ["Key_RateChange", "ProductType"]),
        ri_row("tbl_RateChange_Pol", "rate_pol", ["Key_RateChange"]),
        ri_row("tbl_Trend", "trend", ["Key_Trend"]),
        ri_row("tbl_Patterns_Attr", "pattern", ["Key_Pattern_Attr"]),
        ri_row("tbl_Forecast", "forecast", ["Key_Modelling", "Region"], "Forecast_Premium"),
        ri_row("tbl_Min_Large_Load", "load", ["Key_RateChange", "ProductType"]),
    ]
    unique = {
        "tbl_RateChange": ("rate", "Key_RateChange, ProductType"),
        "tbl_RateChange_Pol": ("rate_pol", "Key_RateChange"),
        "tbl_Trend": ("trend", "Key_Trend, Trend_Period"),
        "tbl_Patterns_Attr": ("pattern", "Key_Pattern_Attr, DevM"),
        "tbl_Forecast": ("forecast", "Key_Forecast, Region, Area, Forecast_Premium"),
        "tbl_Min_Large_Load": ("load", "Key_RateChange, ProductType"),
    }
    for t, (table, keys) in unique.items():
        rows.append(
            finding(
                "checks2_5", "row_uniqueness", f"'{t}'", _pass_fail("count(*)"), "count(*)",
                f"({duplicates(table, keys)})", keys=f"'{keys}'",
            )
        )
    # check 5: columns that are no parent, counted per reference table
    bad = {
        "tbl_RateChange": [("dd", "Key_RateChange", "ProductType")],
        "tbl_RateChange_Pol": [],
        "tbl_Trend": [],
        "tbl_Patterns_Attr": [],
        "tbl_Forecast": [
            ("forecast", "Key_Forecast", "Region"),
            ("forecast", "Key_Forecast", "Area"),
        ],
        "tbl_Min_Large_Load": [("dd", "Key_RateChange", "ProductType")],
    }
    for t, pairs in bad.items():
        tests = " UNION ALL ".join(
            f"SELECT NOT is_parent AS bad FROM ({parent_row(*p)})" for p in pairs
        )
        source = f"({tests})" if pairs else "(SELECT false AS bad)"
        n = "count(*) FILTER (bad)"
        rows.append(finding("checks2_5", "parent_columns", f"'{t}'", _pass_fail(n), n, source))
    outside = """(SELECT DISTINCT ProductType FROM load WHERE ProductType IS NOT NULL
                  AND ProductType NOT IN (SELECT ProductType FROM dd))"""
    rows.append(
        finding(
            "checks2_5", "domain_membership", "'tbl_Min_Large_Load'", _pass_fail("count(*)"),
            "count(*)", outside, column="'ProductType'",
        )
    )
    rows.append(
        finding(
            "check6", "mapping_uniqueness", "'tbl_Key_Mapping'", _pass_fail("count(*)"),
            "count(*)", f"({duplicates('mapping', 'Segment, Region, Nation')})",
            keys="'Segment, Region, Nation'",
        )
    )
    bands = {
        "tbl_RateChange": ("rate", "RateChange"),
        "tbl_RateChange_Pol": ("rate_pol", "RateChange"),
        "tbl_Trend": ("trend", "Trend_Value"),
    }
    for t, (table, c) in bands.items():
        source = f"({band_rows([band_row(c, c, table)])})"
        rows.append(
            finding(
                "check7", "band_share", f"'{t}'", "status", "NULL", source,
                column="column_name", pct="pct_inner",
            )
        )
    c = "DevPct_Incd_Attr"
    rows.append(
        finding(
            "check7", "exceed_share", "'tbl_Patterns_Attr'", "status", "NULL",
            f"({exceed_rows([exceed_row(c, c, 'pattern')])})",
            column="column_name", pct="pct_above",
        )
    )
    rows.append(
        finding(
            "check7", "yyyymm", "'tbl_DetailedData'", _pass_fail("count(DISTINCT AsAt_Month) - 1"),
            "count(DISTINCT AsAt_Month) FILTER (AsAt_Month % 100 NOT BETWEEN 1 AND 12)", "dd",
            column="'AsAt_Month'",
        )
    )
    rows.append(
        finding(
            "check7", "sequence", "'tbl_Patterns_Attr'", _pass_fail("count(*)"), "count(*)",
            f"({sequence_sql('pattern', 'Key_Pattern_Attr', 'DevM', 'DevM', 120, 5)})",
            column="'DevM'", keys="'Key_Pattern_Attr'",
        )
    )
    for c in ("MinLoad_Attr", "MinLoad_Large", "MinLoad_Note"):
        status = """CASE WHEN n_non_numeric > 0 THEN 'FAIL' WHEN p < 95 THEN 'WARNING'
                    ELSE 'PASS' END"""
        rows.append(
            finding(
                "check7", "numeric_share", "'tbl_Min_Large_Load'", status, "n_non_numeric",
                f"({numeric_row(c, c, 'load', '3')})",
                column="column_name", pct="round_even(p, 1)",
            )
        )
    for c in ("Key_Modelling", "Key_Modelling_Type"):
        blank = f"({c} IS NULL OR trim({c}) = '')"
        groups = """(SELECT AsAt_Month, Segment, Region, Nation, ProductType, Key_RateChange,
                     Key_Trend, Key_Pattern_Attr, Key_Modelling, Key_Modelling_Type,
                     sum(Premium) AS Premium FROM dd GROUP BY ALL)"""
        m = f"coalesce(sum(Premium) FILTER ({blank}), 0)"
        rows.append(
            finding(
                "check8", "key_coverage", "NULL::VARCHAR",
                f"CASE WHEN {m} > 0 THEN 'WARNING' ELSE 'PASS' END", f"count(*) FILTER ({blank})",
                groups, column=f"'{c}'", measure=m,
                pct=f"round_even({m}::DOUBLE / sum(Premium)::DOUBLE * 100, 1)",
            )
        )
    return " UNION ALL ".join(rows)


RUN = f"WITH {RULE_TABLES}, run AS ({_run_rows()})"
SEVERITY = "CASE status WHEN 'FAIL' THEN 3 WHEN 'WARNING' THEN 2 WHEN 'PASS' THEN 1 ELSE 0 END"


def worst(by: str, source: str) -> str:
    """Worst status and number of rows per group."""
    return f"""
      SELECT {by}, ['SKIP', 'PASS', 'WARNING', 'FAIL'][max({SEVERITY}) + 1] AS status,
             count(*) AS n_checks FROM {source} GROUP BY {by}"""


REPORTED = f"""
  reported AS (
    SELECT section, table_name, status FROM run WHERE section <> 'checks2_5'
    UNION ALL
    SELECT section, table_name, status
    FROM ({worst("section, table_name", "(SELECT * FROM run WHERE section = 'checks2_5')")}))
"""
UNITS = """(VALUES ('check1', 'table(s) checked'), ('checks2_5', 'table(s) checked'),
            ('check6', ''), ('check7', 'column check(s) performed'),
            ('check8', 'Key_Modelling column(s) checked')) units(section, unit)"""


def counted(status: str) -> str:
    n = f"count(*) FILTER (status = '{status}')"
    return f"CASE WHEN {n} > 0 THEN {n} || ' {status}' END"


COVERED = f"""
  {SALES},
  covered AS (
    SELECT seg, reg, CASE WHEN prio <> '4-NOT SPECIFIED' THEN prio END AS Key_Prio,
           CASE WHEN reg = 'ASIA' THEN '' ELSE reg END AS Key_Region, price
    FROM sales)
"""


def coverage_row(column: str) -> str:
    blank = f"({column} IS NULL OR {column} = '')"
    m = f"coalesce(sum(price) FILTER ({blank}), 0)"
    orders = f"count(DISTINCT l_orderkey) FILTER ({blank})"
    return f"""
      SELECT '{column}' AS column_name, {orders} AS n_unmapped, count(*) FILTER ({blank}) AS n_rows,
             {m}::DOUBLE AS unmapped_measure,
             round_even({m}::DOUBLE / sum(price)::DOUBLE * 100, 1)::DOUBLE AS pct,
             sum(price)::DOUBLE AS total_measure,
             CASE WHEN {m} > 0 THEN 'WARNING' ELSE 'PASS' END AS status
      FROM (SELECT l_orderkey, l_extendedprice::DECIMAL(18,2) AS price,
                   CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END
                     AS Key_Prio,
                   CASE WHEN r_name = 'ASIA' THEN '' ELSE r_name END AS Key_Region
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey
            JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
            JOIN region ON n_regionkey = r_regionkey)"""


PERIODS = """
  spans AS (
    SELECT o_custkey, min(year(o_orderdate)) AS a, max(year(o_orderdate)) AS b,
           min(year(o_orderdate)) FILTER (o_orderpriority = '1-URGENT') AS c,
           max(year(o_orderdate)) FILTER (o_orderpriority = '1-URGENT') AS d
    FROM orders GROUP BY o_custkey),
  periods AS (
    SELECT *, a || '-' || b || CASE WHEN c IS NULL THEN '' WHEN c = d THEN ' ex ' || c
                                    ELSE ' ex ' || c || '-' || d END AS period
    FROM spans)
"""

COMPARED = """
  b AS (SELECT * REPLACE (CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN 0.5
                               ELSE l_tax END AS l_tax) FROM lineitem),
  signed AS (SELECT *, 1 AS s FROM lineitem UNION ALL SELECT *, -1 FROM b),
  diff AS (SELECT * EXCLUDE (s), sum(s) AS s FROM signed GROUP BY ALL HAVING sum(s) <> 0)
"""

_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

ORACLE: dict[str, str] = {
    "load_tables": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in _TABLES
    ),
    "csv_tables": """
        SELECT 'tbl_customer' AS source, c_mktsegment AS seg, count(*) AS n_rows,
               sum(c_acctbal::DECIMAL(18,2))::DOUBLE AS balance
        FROM customer GROUP BY c_mktsegment
        UNION ALL SELECT 'tbl_supplier', NULL, count(*), sum(s_acctbal::DECIMAL(18,2))::DOUBLE
        FROM supplier
        UNION ALL SELECT 'tbl_nation.csv has no declared schema', NULL, 0, NULL""",
    "preaggregate_exact": """
        SELECT l_returnflag, l_linestatus, count(*) AS n_rows,
               sum(l_extendedprice::DECIMAL(20,2))::DOUBLE AS l_extendedprice
        FROM lineitem GROUP BY ALL""",
    "preaggregate": f"""
        WITH {SALES} SELECT seg, nat, brand, ptype, sum(price)::DOUBLE AS price
        FROM sales GROUP BY ALL""",
    "preaggregate_stored": f"""
        WITH {SALES} SELECT seg, reg, sum(price)::DOUBLE AS price,
               count(DISTINCT (prio, month)) AS n_groups
        FROM sales GROUP BY seg, reg""",
    "forward_ri_keys": """
        SELECT DISTINCT doc_id FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "forward_ri": FORWARD,
    "forward_ri_top10": f"{FORWARD} ORDER BY n_chars DESC, doc_id LIMIT 10",
    "forward_ri_summary": """
        WITH u AS (SELECT doc_id, sum(n_chars)::DOUBLE AS n FROM documents
                   WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY doc_id)
        SELECT count(*) AS n_unmatched, sum(n) AS unmatched_measure,
               sum(n) / (SELECT sum(n_chars)::DOUBLE FROM documents) * 100 AS unmatched_pct,
               CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END AS status
        FROM u""",
    "reverse_ri": """
        SELECT o_orderkey AS orderkey FROM orders o
        WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
        GROUP BY o_orderkey""",
    "reverse_ri_measure": """
        SELECT c_custkey AS custkey, sum(c_acctbal::DECIMAL(18,2))::DOUBLE AS balance
        FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)
        GROUP BY c_custkey""",
    "ri_status": """
        WITH counts AS (
            SELECT 'labels' AS table_name,
                   (SELECT count(DISTINCT doc_id) FROM documents
                    WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS n_unmatched,
                   (SELECT sum(n_chars)::DOUBLE FROM documents
                    WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS unmatched_measure,
                   (SELECT count(DISTINCT doc_id) FROM labels
                    WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS n_orphaned
            UNION ALL
            SELECT 'orders',
                   (SELECT count(DISTINCT l_orderkey) FROM lineitem
                    WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)),
                   (SELECT sum(l_extendedprice::DECIMAL(18,2))::DOUBLE FROM lineitem
                    WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)),
                   (SELECT count(DISTINCT o_orderkey) FROM orders
                    WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))
            UNION ALL
            SELECT 'suppliers',
                   (SELECT count(DISTINCT l_suppkey) FROM lineitem
                    WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)),
                   (SELECT sum(l_extendedprice::DECIMAL(18,2))::DOUBLE FROM lineitem
                    WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)),
                   (SELECT count(DISTINCT s_suppkey) FROM supplier
                    WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem)))
        SELECT *, CASE WHEN n_unmatched > 0 THEN 'FAIL' WHEN n_orphaned > 0 THEN 'WARNING'
                       ELSE 'PASS' END AS status
        FROM counts""",
    "domain_membership": """
        WITH ref AS (SELECT c_nationkey::DOUBLE AS nation,
                            floor(c_acctbal / 50)::DECIMAL(12,1) AS balance_class FROM customer),
             fact AS (SELECT s_nationkey::DOUBLE AS nation,
                             floor(s_acctbal / 50)::DECIMAL(12,1) AS balance_class FROM supplier)
        SELECT DISTINCT 'nation' AS column_name, nation::VARCHAR AS value FROM ref
        WHERE nation NOT IN (SELECT nation FROM fact)
        UNION ALL
        SELECT DISTINCT 'balance_class', balance_class::VARCHAR FROM ref
        WHERE balance_class NOT IN (SELECT balance_class FROM fact)""",
    "key_registration": """
        WITH catalog AS (
          SELECT DISTINCT user_id::VARCHAR AS t,
                 'Key_' || event_type || '_' || (props::JSON ->> 'k') AS c FROM events)
        SELECT s.t AS table_name, s.c AS key_col, target AS missing_from
        FROM catalog s, (VALUES ('0'), ('1')) x(target)
        WHERE s.t NOT IN ('0', '1') AND s.c <> 'Key_error_1'
          AND NOT EXISTS (SELECT 1 FROM catalog p WHERE p.t = target AND p.c = s.c)""",
    "natural_join": """
        WITH o AS (SELECT o_orderkey, o_orderstatus AS status,
                          CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_custkey END
                            AS custkey FROM orders),
             c AS (SELECT CASE WHEN c_acctbal <= 9000 THEN c_custkey END AS custkey,
                          sum(c_acctbal::DECIMAL(18,2))::DOUBLE AS balance,
                          max(c_mktsegment) AS status_cust FROM customer GROUP BY 1)
        SELECT o_orderkey, o.custkey, status, balance, status_cust
        FROM o LEFT JOIN c ON o.custkey IS NOT DISTINCT FROM c.custkey""",
    "natural_join_outer": """
        WITH e AS (SELECT user_id AS custkey, count(*) AS n_events FROM events GROUP BY 1),
             c AS (SELECT c_custkey AS custkey, c_name FROM customer)
        SELECT coalesce(e.custkey, c.custkey) AS custkey, n_events, c_name
        FROM e FULL JOIN c ON e.custkey = c.custkey""",
    "dataset_compare": f"""
        WITH {COMPARED}
        SELECT CASE WHEN s > 0 THEN 'left' ELSE 'right' END AS side, * EXCLUDE (s),
               abs(s)::BIGINT AS n
        FROM diff""",
    "dataset_compare_summary": f"""
        WITH {COMPARED}
        SELECT coalesce(sum(s) FILTER (s > 0), 0)::BIGINT AS n_left_only,
               coalesce(-sum(s) FILTER (s < 0), 0)::BIGINT AS n_right_only,
               count(*) = 0 AS equal
        FROM diff""",
    "row_uniqueness": """
        SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem
        GROUP BY ALL HAVING count(*) > 1""",
    "row_uniqueness_variants": f"WITH {RULE_TABLES}"
    + " UNION ALL ".join(
        uniqueness_row(*x)
        for x in (
            ("tbl_RateChange", "rate", "Key_RateChange, ProductType"),
            ("tbl_Trend", "trend", "Key_Trend, Trend_Period"),
            ("tbl_Patterns_Attr", "pattern", "Key_Pattern_Attr, DevM"),
            ("tbl_Forecast", "forecast", "Key_Forecast, Region, Area, Forecast_Premium"),
        )
    ),
    "mapping_uniqueness": """
        SELECT p_brand, p_type, count(*) AS n_rows FROM part
        GROUP BY p_brand, p_type HAVING count(*) > 1""",
    "text_uniqueness": """
        SELECT sha256(length(text) || ':' || text) AS key_digest, count(*) AS n_rows
        FROM documents GROUP BY text HAVING count(*) > 1""",
    "parent_columns": f"WITH {SALES}"
    + " UNION ALL ".join(
        parent_row("sales", k, c) for k in ("brand", "nat", "prio") for c in ("ptype", "reg", "seg")
    ),
    "forecast_parents": f"WITH {RULE_TABLES}"
    + " UNION ALL ".join(parent_row("forecast", "Key_Forecast", c) for c in ("Region", "Area")),
    "min_determinant": """
        SELECT DISTINCT n_name AS nat, r_name AS reg
        FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "band_share": band_rows(
        [band_row("rate", "(l_discount - 0.05::DOUBLE)", "lineitem", "0.025", "0.045")],
        "0.025",
        "0.045",
    ),
    "trend_share": band_rows(
        [
            band_row("Trend_Value", "(s_acctbal / 20000)", "supplier"),
            band_row("Trend_Percent", "(s_acctbal / 100)", "supplier"),
        ]
    ),
    "develop_share": exceed_rows(
        [
            exceed_row(
                "DevPct_Line",
                "(l_extendedprice / o_totalprice)",
                "lineitem JOIN orders ON l_orderkey = o_orderkey",
            ),
            exceed_row(
                "DevPct_Discount",
                "(l_discount * 10)",
                "lineitem JOIN orders ON l_orderkey = o_orderkey",
            ),
        ]
    ),
    "yyyymm_check": """
        WITH v AS (
          SELECT DISTINCT year(o_orderdate) * 100 + month(o_orderdate)
                 + CASE WHEN o_orderpriority = '1-URGENT' AND month(o_orderdate) = 12
                        THEN 1 ELSE 0 END AS v
          FROM orders),
        s AS (SELECT count(*) AS n_distinct, count(*) FILTER (v % 100 NOT BETWEEN 1 AND 12)
                AS n_invalid FROM v),
        f AS (SELECT string_agg(v, ', ' ORDER BY v % 100 BETWEEN 1 AND 12, v) AS sample
              FROM (SELECT v FROM v ORDER BY v % 100 BETWEEN 1 AND 12, v LIMIT 5))
        SELECT n_distinct, n_invalid,
               CASE WHEN n_distinct = 0 THEN 'SKIP' WHEN n_invalid > 0 OR n_distinct > 1 THEN 'FAIL'
                    ELSE 'PASS' END AS status,
               sample,
               CASE WHEN n_invalid > 0
                    THEN n_invalid || ' value(s) not in valid YYYYMM format: [' || sample || ']'
                    WHEN n_distinct > 1 THEN 'Multiple month values found: [' || sample || ']'
                    ELSE 'Single valid value: ' || sample END AS detail
        FROM s, f""",
    "sequence_check": sequence_sql("lineitem", "l_orderkey", "l_linenumber", "l_linenumber", 7, 5),
    "numeric_share": f"""
        SELECT column_name, n, n_non_numeric, round_even(p, 1)::DOUBLE AS pct_below,
               CASE WHEN n_non_numeric > 0 THEN 'FAIL' WHEN p < 95 THEN 'WARNING' ELSE 'PASS' END
                 AS status,
               CASE WHEN n_non_numeric > 0 THEN n_non_numeric || ' non-numeric value(s) found'
                    WHEN p < 95 THEN printf('Only %.1f%% of values < 95 (expected ≥95%%)',
                                            round_even(p, 1)::DOUBLE)
                    ELSE printf('%.1f%% of values < 95', round_even(p, 1)::DOUBLE) END AS detail
        FROM ({numeric_row("k", "(props::JSON ->> 'k')", "events", "95")} UNION ALL
              {numeric_row("value", "value", "events", "95")} UNION ALL
              {numeric_row("kind", "event_type", "events", "95")})""",
    "coverage_share": f"{coverage_row('Key_Prio')} UNION ALL {coverage_row('Key_Region')}",
    "coverage_breakdown": f"""
        WITH {COVERED},
          blank AS (
            SELECT 'Key_Prio' AS column_name, seg, reg, price FROM covered WHERE Key_Prio IS NULL
            UNION ALL
            SELECT 'Key_Region', seg, reg, price FROM covered WHERE Key_Region = '')
        SELECT column_name, seg, reg, sum(price)::DOUBLE AS price,
               round_even(sum(price)::DOUBLE / (SELECT sum(price)::DOUBLE FROM covered) * 100, 1)
                 ::DOUBLE AS pct
        FROM blank GROUP BY ALL""",
    "weighted_ratio": """
        SELECT l_returnflag AS Segment,
               round(sum(l_discount::DECIMAL(4,2) * l_extendedprice::DECIMAL(18,2))::DOUBLE
                     / sum(l_extendedprice::DECIMAL(18,2))::DOUBLE, 9) AS ULR_Attr,
               sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS Ult_Premium
        FROM lineitem GROUP BY l_returnflag""",
    "mixed_aggregate": """
        WITH g AS (
          SELECT CASE WHEN l_returnflag = 'N' THEN 'Unknown' ELSE l_returnflag END AS Segment,
                 l_linestatus AS Status,
                 arg_min(l_linenumber::BIGINT, l_orderkey * 8 + l_linenumber) AS DevM,
                 sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS price,
                 sum(l_quantity::DECIMAL(18,2))::DOUBLE AS qty,
                 sum(l_tax::DECIMAL(4,2) * l_extendedprice::DECIMAL(18,2))::DOUBLE AS taxed,
                 sum(l_tax::DECIMAL(4,2))::DOUBLE / count(*) AS mean_tax,
                 sum(l_discount::DECIMAL(4,2))::DOUBLE / count(*) AS mean_discount
          FROM lineitem GROUP BY 1, 2)
        SELECT Segment, Status, DevM,
               round(price, 6) AS Ult_Premium, round(price, 6) AS Incd_OL_Attr,
               round(qty, 6) AS Ult_OL_Attr_IncdCL, 0.0::DOUBLE AS Ult_OL_Large_IncdCL,
               round(qty, 6) AS Incd_OL_Large,
               round(taxed / price, 6) AS OLFactor_Premium,
               round(mean_tax, 6) AS OLFactor_PY_Premium,
               round(mean_discount, 6) AS DevPct_Attr,
               round((taxed / price) / mean_tax, 6) AS OLFactor_CY_Premium,
               round(price / qty, 6) AS DevPct_Incd_Attr, 1.0::DOUBLE AS DevPct_Incd_Large
        FROM g""",
    "in_use": """
        SELECT 'customer' AS table_name, count(*) AS n_rows,
               count(*) FILTER (c_mktsegment = 'BUILDING') AS n_placeholder,
               count(*) > count(*) FILTER (c_mktsegment = 'BUILDING') AS in_use FROM customer
        UNION ALL SELECT 'nation', count(*), count(*), false FROM nation
        UNION ALL SELECT 'orders', count(*), 0, count(*) > 0 FROM orders""",
    "placeholder_fill": """
        SELECT 'used' AS table_name, p_brand AS Key_Brand, 'kept' AS Comments, count(*) AS n_rows,
               count(p_size) AS n_sizes FROM part GROUP BY p_brand
        UNION ALL SELECT 'empty', 'Not in Use', '', 1, 0""",
    "period_expand": f"""
        WITH {PERIODS}
        SELECT o_custkey, period, y::INTEGER AS year, coalesce(y BETWEEN c AND d, false) AS excluded,
               NULL::VARCHAR AS problem
        FROM (SELECT *, unnest(generate_series(a, b)) AS y FROM periods)""",
    "period_suffix": f"""
        WITH {PERIODS}
        SELECT replace(replace(period, ' ', ''), '-', '_') AS suffix, count(*) AS n_customers
        FROM periods GROUP BY 1""",
    "display_projection": f"""
        WITH {RULE_TABLES} SELECT Key_RateChange, n AS n_rows
        FROM ({duplicates("rate_pol", "Key_RateChange, RateChange")})""",
    "evidence_records": """
        SELECT row_number() OVER (ORDER BY n_rows DESC, p_brand, p_type)::INTEGER AS rank,
               to_json({'p_brand': p_brand, 'p_type': p_type, 'n_rows': n_rows})::VARCHAR AS record
        FROM (SELECT p_brand, p_type, count(*) AS n_rows FROM part GROUP BY ALL
              HAVING count(*) > 1 ORDER BY n_rows DESC, p_brand, p_type LIMIT 10)""",
    "run_unmatched": f"WITH {RULE_TABLES} " + loose_rows("dd", True),
    "run_orphans": f"WITH {RULE_TABLES} " + loose_rows("dd", False),
    "run_breakdown": f"WITH {RULE_TABLES} "
    + " UNION ALL ".join(
        f"""
        SELECT '{c}' AS column_name, Segment AS segment, Region AS region, Nation AS nation,
               sum(Premium)::DOUBLE AS measure,
               round_even(sum(Premium)::DOUBLE / (SELECT sum(Premium)::DOUBLE FROM dd) * 100, 1)
                 ::DOUBLE AS pct
        FROM dd WHERE {c} IS NULL OR trim({c}) = '' GROUP BY Segment, Region, Nation"""
        for c in ("Key_Modelling", "Key_Modelling_Type")
    ),
    "table_records": f"""
        {RUN}, per AS (
          SELECT table_name,
                 max(n_bad) FILTER (check_name = 'forward_ri') AS f,
                 max(n_bad) FILTER (check_name = 'reverse_ri') AS r,
                 max(n_bad) FILTER (check_name = 'row_uniqueness') AS u,
                 max(n_bad) FILTER (check_name = 'parent_columns') AS p,
                 ['SKIP', 'PASS', 'WARNING', 'FAIL'][max({SEVERITY}) + 1] AS status
          FROM run WHERE section = 'checks2_5' GROUP BY table_name)
        SELECT 'checks2_5.' || table_name AS check_id,
               'RI / Uniqueness / Parent columns — ' || table_name AS label, table_name, status,
               coalesce(nullif(concat_ws('; ',
                 CASE WHEN f > 0 THEN 'Forward RI: ' || f || ' unmatched combination(s)' END,
                 CASE WHEN r > 0 THEN 'Reverse RI: ' || r || ' orphaned combination(s)' END,
                 CASE WHEN u > 0 THEN 'Uniqueness: ' || u || ' duplicate combination(s)' END,
                 CASE WHEN p > 0 THEN 'Parent cols: ' || p || ' failing' END), ''),
                 'All checks passed.') AS summary
        FROM per""",
    "consistency_run": f"{RUN} SELECT * FROM run",
    "table_rollup": f"""
        {RUN} SELECT table_name, status
        FROM ({worst("table_name", "(SELECT * FROM run WHERE section = 'checks2_5')")})""",
    "section_rollup": f"""
        {RUN}, {REPORTED}
        SELECT section, ['SKIP', 'PASS', 'WARNING', 'FAIL'][max({SEVERITY}) + 1] AS status,
               count(*) AS n_checks,
               CASE WHEN section = 'check6'
                    THEN (SELECT n_bad FROM run WHERE section = 'check6')
                         || ' duplicate non-Key_* combination(s).'
                    ELSE count(*) || ' ' || any_value(unit) || ': '
                         || concat_ws(', ', {counted("FAIL")}, {counted("WARNING")},
                                      {counted("PASS")}) || '.' END AS summary
        FROM reported JOIN {UNITS} USING (section) GROUP BY section""",
    "run_rollup": f"""
        {RUN}
        SELECT rule, ['SKIP', 'PASS', 'WARNING', 'FAIL'][max({SEVERITY}) + 1] AS status
        FROM run, (VALUES ('sections'), ('findings')) x(rule) GROUP BY rule""",
    "findings_payload": f"""
        {RUN} SELECT section, check_name, status, n_checks
        FROM ({worst("section, check_name", "run")})""",
    "degraded_run": f"""
        WITH {RULE_TABLES}
        SELECT 'check1' AS section, 'PASS' AS status, 0 AS n_warnings
        UNION ALL SELECT 'checks2_5', {_pass_fail("count(*)")}, 1
          FROM ({duplicates("(SELECT Trend_Period FROM trend)", "Trend_Period")})
        UNION ALL SELECT 'check6', 'SKIP', 0
        UNION ALL SELECT 'check7', status, 0
          FROM ({band_rows([band_row("Trend_Value", "Trend_Value", "trend")])})
        UNION ALL SELECT 'check8', 'SKIP', 0""",
}

from .growing_sql import SQL  # noqa: E402  (built from the tables above)

ORACLE |= SQL
