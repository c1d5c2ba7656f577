"""SQL for DuckDB of the queries in :mod:`workload.growing`."""

from __future__ import annotations

from .oracle import PERIODS, RULE_TABLES, RUN, SALES, _run_rows

INTS, TEXT, MONEY, MOMENT = "bigint", "string", "money", "timestamp_ntz"
UNTYPED = {
    "customer": {
        "c_custkey": INTS,
        "c_name": TEXT,
        "c_nationkey": INTS,
        "c_acctbal": MONEY,
        "c_mktsegment": TEXT,
    },
    "part": {
        "p_partkey": INTS,
        "p_name": TEXT,
        "p_brand": TEXT,
        "p_type": TEXT,
        "p_size": INTS,
        "p_retailprice": MONEY,
    },
    "orders": {
        "o_orderkey": INTS,
        "o_custkey": INTS,
        "o_orderstatus": TEXT,
        "o_totalprice": MONEY,
        "o_orderdate": MOMENT,
        "o_orderpriority": TEXT,
    },
}


def _profile(table: str, column: str, kind: str) -> str:
    whole = f"max(length(CAST(CAST(floor(abs({column})) AS BIGINT) AS VARCHAR)))"
    # a double is written with one digit behind the point at least
    scale = f"(CASE WHEN bool_or(round({column} * 100) % 10 <> 0) THEN 2 ELSE 1 END)"
    name = f"'{kind}'"
    if kind == MONEY:
        name = f"'decimal(' || ({whole} + {scale}) || ',' || {scale} || ')'"
    value = {
        INTS: f"{column} * 100",
        TEXT: f"length({column})",
        MONEY: f"CAST(round({column} * 100) AS BIGINT)",
        MOMENT: f"CAST(epoch({column}) AS BIGINT)",
    }[kind]
    return f"""
        SELECT '{table}' AS table_name, '{column}' AS column_name, {name} AS type,
               count({column}) AS n_values, CAST(sum({value}) AS BIGINT) AS digest FROM {table}"""


def _census(name: str, ref: str, keys: list[str]) -> str:
    on = " AND ".join(f"r.{k} IS NOT DISTINCT FROM d.{k}" for k in keys)
    k = ", ".join(keys)
    return f"""
        SELECT '{name}' AS table_name, n_unmatched,
               CASE WHEN n_unmatched > 0 THEN unmatched END AS unmatched_measure, n_orphaned,
               CASE WHEN n_unmatched > 0 THEN 'FAIL' WHEN n_orphaned > 0 THEN 'WARNING'
                    ELSE 'PASS' END AS status
        FROM (SELECT count(*) AS n_unmatched, sum(p)::DOUBLE AS unmatched
              FROM (SELECT {k}, sum(price) AS p FROM sales GROUP BY {k}) d
              WHERE NOT EXISTS (SELECT 1 FROM {ref} r WHERE {on})),
             (SELECT count(*) AS n_orphaned FROM (SELECT DISTINCT {k} FROM {ref}) d
              WHERE NOT EXISTS (SELECT 1 FROM sales r WHERE {on}))"""


def _conflicts(key: str, column: str) -> str:
    return f"""
        SELECT '{key}' AS key_col, {key} AS key_value, '{column}' AS column_name,
               {column} AS value, n AS n_rows,
               row_number() OVER (PARTITION BY {key} ORDER BY n DESC, {column}) = 1 AS is_majority,
               CAST(sum(n) OVER (PARTITION BY {key}) - max(n) OVER (PARTITION BY {key}) AS BIGINT)
                 AS n_remove
        FROM (SELECT {key}, {column}, count(*) AS n FROM sales GROUP BY ALL)
        QUALIFY count(*) OVER (PARTITION BY {key}) > 1"""


def _determinants(target: str, columns: list[str]) -> str:
    """Sets of columns by bit mask; a set is minimal if no found set is part of it."""
    sets = []
    for mask in range(2 ** len(columns)):
        own = [c for i, c in enumerate(columns) if mask >> i & 1]
        group = f"GROUP BY {', '.join(own)}" if own else ""
        sets.append(
            f"SELECT {mask} AS mask, '{', '.join(own)}' AS column_names, {len(own)} AS n_columns, "
            f"coalesce(max(n), 1) AS worst FROM (SELECT count(DISTINCT {target}) AS n FROM f {group})"
        )
    return f"""
        found AS (SELECT * FROM ({" UNION ALL ".join(sets)}) WHERE worst <= 1)
        SELECT column_names, n_columns FROM found a WHERE NOT EXISTS (
          SELECT 1 FROM found b WHERE b.mask <> a.mask AND (b.mask & a.mask) = b.mask)"""


def _scenario(name: str, changes: dict[str, str], dropped: tuple[str, ...] = ()) -> str:
    """The findings of a run whose tables are changed by a SELECT over the table ``was``."""
    ctes = RULE_TABLES
    for table, select in changes.items():
        ctes = ctes.replace(f"{table} AS (", f"{table}_was AS (", 1)
        ctes += f", {table} AS ({select.format(was=table + '_was')})"
    names = ", ".join(f"'{t}'" for t in dropped)
    where = f"WHERE coalesce(table_name, '') NOT IN ({names})" if dropped else ""
    return f"""
        SELECT '{name}' AS scenario, section, check_name, table_name, column_name, status, n_bad
        FROM (WITH {ctes}, run AS ({_run_rows()}) SELECT * FROM run) {where}"""


def _profile_leaves(side: str, orders: str, balance: str) -> str:
    """(custkey, path, value) of every leaf of the customer profiles."""
    return f"""
      {side}_o AS (SELECT * FROM orders {orders}),
      {side}_y AS (
        SELECT o_custkey, y, n, row_number() OVER (PARTITION BY o_custkey ORDER BY y) - 1 AS i
        FROM (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n FROM {side}_o GROUP BY ALL)),
      {side} AS (
        SELECT c_custkey AS custkey, 'who.seg' AS path, c_mktsegment AS value FROM customer
        UNION ALL
        SELECT c_custkey, 'who.bal', CAST(CAST({balance} AS DECIMAL(18,2)) AS VARCHAR) FROM customer
        UNION ALL
        SELECT o_custkey, 'prio{{' || o_orderpriority || '}}',
               CAST(CAST(count(*) AS DECIMAL(18,2)) AS VARCHAR)
        FROM {side}_o GROUP BY o_custkey, o_orderpriority
        UNION ALL
        SELECT o_custkey, 'years[' || i || '].' || u.f,
               CAST(CAST(CASE u.f WHEN 'y' THEN y ELSE n END AS DECIMAL(18,2)) AS VARCHAR)
        FROM {side}_y, (VALUES ('y'), ('n')) u(f)
        UNION ALL
        SELECT c_custkey, u.f, NULL FROM customer, (VALUES ('prio'), ('years')) u(f)
        WHERE NOT EXISTS (SELECT 1 FROM {side}_o WHERE o_custkey = c_custkey))"""


SQL: dict[str, str] = {
    "csv_inferred": " UNION ALL ".join(
        _profile(t, c, kind) for t, columns in UNTYPED.items() for c, kind in columns.items()
    ),
    "preaggregate_delta": """
        SELECT l_returnflag, l_linestatus, year(l_shipdate) AS ship_year,
               sum(l_extendedprice::DECIMAL(18,2)
                   * CASE WHEN l_orderkey % 8 = 2 THEN 2 ELSE 1 END)::DOUBLE AS price,
               count(*) AS n_rows
        FROM lineitem WHERE l_orderkey % 8 <> 1 GROUP BY ALL""",
    # the doubles are whole numbers of 2 to the power of -46; their exact sum is parsed as a text
    "preaggregate_binned": """
        SELECT l_returnflag, l_linestatus,
               CAST(CAST(sum(CAST(l_extendedprice * (1 - l_discount) * 70368744177664 AS HUGEINT))
                    AS VARCHAR) AS DOUBLE) / 70368744177664 AS net,
               count(*) AS n_rows
        FROM lineitem GROUP BY ALL""",
    "ri_census_tree": f"""
        WITH {SALES},
        buyers AS (
          SELECT c_mktsegment AS seg, n_name AS nat, r_name AS reg, floor(c_acctbal / 1000) AS bal
          FROM orders JOIN customer ON o_custkey = c_custkey
          JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
        products AS (SELECT p_brand AS brand, p_type AS ptype FROM part WHERE p_size > 3),
        brands AS (SELECT p_brand || CASE WHEN p_size > 45 THEN 'x' ELSE '' END AS brand FROM part),
        rich AS (SELECT nat, seg FROM buyers WHERE bal >= 0),
        markets AS (SELECT nat, seg, 'Brand#' || length(reg) || '1' AS brand FROM buyers)
        {" UNION ALL ".join(
            (
                _census("products", "products", ["brand", "ptype"]),
                _census("brands", "brands", ["brand"]),
                _census("buyers", "rich", ["nat", "seg"]),
                _census("markets", "markets", ["nat", "seg", "brand"]),
            )
        )}""",
    "parent_conflicts": f"""
        WITH {SALES}
        {" UNION ALL ".join((_conflicts("brand", "ptype"), _conflicts("nat", "seg"), _conflicts("nat", "reg")))}""",
    "all_determinants": f"""
        WITH f AS (
          SELECT DISTINCT c_mktsegment AS seg, n_name AS nat, r_name AS reg,
                 o_orderpriority AS prio, year(o_orderdate) * 100 + month(o_orderdate) AS month,
                 floor(c_acctbal / 1000) AS bal
          FROM orders JOIN customer ON o_custkey = c_custkey
          JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
        {_determinants("reg", ["seg", "nat", "prio", "month", "bal"])}""",
    "scenario_matrix": " UNION ALL ".join(
        (
            _scenario("baseline", {}),
            _scenario("absent", {}, ("tbl_Trend", "tbl_Forecast")),
            _scenario(
                "months",
                {
                    "dd": "SELECT * REPLACE (CASE WHEN Segment = 'BUILDING' THEN 202513 "
                    "ELSE AsAt_Month END AS AsAt_Month) FROM {was}"
                },
            ),
            _scenario("gap", {"pattern": "SELECT * FROM {was} WHERE NOT (DevM > 1 AND DevM < 12)"}),
            _scenario(
                "copies",
                {
                    "mapping": "SELECT * FROM {was} UNION ALL SELECT * FROM {was} "
                    "WHERE Segment = 'MACHINERY'"
                },
            ),
        )
    ),
    "resumed_run": "SELECT section, check_name, table_name, status, n_bad, "
    "check_name = 'mapping_uniqueness' AS repeated FROM ("
    + _scenario(
        "copies",
        {
            "mapping": "SELECT * FROM {was} UNION ALL SELECT * FROM {was} "
            "WHERE Segment = 'MACHINERY'"
        },
    )
    + ") WHERE check_name IN ('row_uniqueness', 'mapping_uniqueness')",
    "nested_payload": f"""
        WITH found AS (
          SELECT * FROM ({RUN} SELECT * FROM run)
          WHERE check_name IN ('row_uniqueness', 'mapping_uniqueness')),
        sections AS (SELECT section, max(status = 'FAIL') AS failed FROM found GROUP BY section)
        SELECT CASE WHEN (SELECT max(failed) FROM sections) THEN 'FAIL' ELSE 'PASS' END
                 AS run_status,
               section, CASE WHEN failed THEN 'FAIL' ELSE 'PASS' END AS section_status,
               section || '.' || table_name AS check_id, status, check_name, n_bad
        FROM found JOIN sections USING (section)""",
    "nested_compare": f"""
        WITH {_profile_leaves("a", "", "c_acctbal")},
        {_profile_leaves("b", "WHERE o_orderpriority <> '1-URGENT'",
                         "CASE WHEN c_nationkey = 3 THEN c_acctbal + 1 ELSE c_acctbal END")}
        SELECT coalesce(a.custkey, b.custkey) AS custkey, coalesce(a.path, b.path) AS path,
               a.value AS left_value, b.value AS right_value,
               CASE WHEN b.path IS NULL THEN 'left only' WHEN a.path IS NULL THEN 'right only'
                    ELSE 'changed' END AS change
        FROM a FULL JOIN b ON a.custkey = b.custkey AND a.path = b.path
        WHERE a.path IS NULL OR b.path IS NULL OR a.value IS DISTINCT FROM b.value""",
    "period_join": f"""
        WITH {PERIODS}
        SELECT o_custkey, period, count(*) AS n_orders,
               sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS price
        FROM orders JOIN periods USING (o_custkey)
        WHERE year(o_orderdate) BETWEEN a AND b
          AND NOT coalesce(year(o_orderdate) BETWEEN c AND d, false)
        GROUP BY ALL""",
}
