"""What the checks would say of changed tables, for many changes at once.

A scenario is a set of rows that join or leave tables, and of tables that are
absent.  The changes are signed rows: every table is counted once per distinct
row, and beside that count stand the differences of each scenario that touches
the table.  A check groups these counts by its key a single time; whether a key
is broken is then an expression per scenario over the base count and its
difference.  All scenarios are part of one plan per check and the base tables are
read once, so a further scenario costs its own rows and a few sums, not a run.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    KeyTypeClash,
    as_number,
    clean,
    col,
    common_type,
    is_blank,
    is_numeric,
    local_rows,
    percent,
    require_same_kind,
)
from ..functions.durable import materialise
from ..operators import ranges
from ..rules import roles
from ..rules import rulepack as rp
from ..sources.tables import TableSet

OUTCOME = "scenario string, section string, check string, table string, column string, status string, n_bad bigint"


@dataclass(frozen=True)
class Scenario:
    """Rows that join (``added``) or leave (``removed``) tables, and tables that are absent.

    A row leaves as often as it is given; it must be there.
    """

    name: str
    added: Mapping[str, DataFrame] = field(default_factory=dict)
    removed: Mapping[str, DataFrame] = field(default_factory=dict)
    dropped: frozenset[str] = frozenset()

    def touches(self, table: str) -> bool:
        return table in self.added or table in self.removed


@dataclass(frozen=True)
class Weighted:
    """A table whose rows say how often they are there, at first and by scenario.

    ``weights`` and ``totals`` have, by scenario number, the columns to add to
    ``b`` (rows) and ``m`` (measure); scenarios that leave the table alone have
    none.
    """

    df: DataFrame
    weights: dict[int, str]
    totals: dict[int, str]

    def n(self, world: int) -> Column:
        base = F.col("__b")
        return base + F.col(self.weights[world]) if world in self.weights else base

    def m(self, world: int) -> Column:
        base = F.col("__m")
        if world not in self.totals:
            return base
        change = F.coalesce(F.col(self.totals[world]), F.lit(0))
        return F.coalesce(base, F.lit(0)) + change

    def sums(self) -> list[Column]:
        names = ["__b", *self.weights.values()]
        return [F.sum(c).alias(c) for c in names]

    def measures(self) -> list[Column]:
        return [F.sum(c).alias(c) for c in ["__m", *self.totals.values()]] if self.totals else [
            F.sum("__m").alias("__m")
        ]


def weighted(
    base: DataFrame,
    table: str,
    scenarios: Sequence[Scenario],
    columns: Sequence[str],
    measure: str | None = None,
) -> Weighted:
    """A table counted per distinct row of the given columns, with the scenarios' differences."""
    touching = [i for i, s in enumerate(scenarios) if s.touches(table)]
    zero = F.lit(0).cast("long")

    def rows(df: DataFrame, world: int | None, sign: int) -> DataFrame:
        value = clean(df, measure) if measure else F.lit(None).cast("long")
        none = F.lit(None)
        return df.select(
            *[clean(df, c).alias(c) for c in columns],
            (F.lit(1).cast("long") if world is None else zero).alias("__b"),
            (value if world is None else none.cast(base.schema[measure].dataType) if measure else none.cast("long")).alias("__m"),
            *[(F.lit(sign).cast("long") if i == world else zero).alias(f"__d{i}") for i in touching],
            *[
                (value * sign if i == world else none).cast(
                    base.schema[measure].dataType if measure else "long"
                ).alias(f"__e{i}")
                for i in touching
            ],
        )

    whole = rows(base, None, 1)
    for i in touching:
        for sign, changes in ((1, scenarios[i].added), (-1, scenarios[i].removed)):
            if table in changes:
                whole = whole.unionByName(rows(changes[table], i, sign))
    out = Weighted(
        whole, {i: f"__d{i}" for i in touching}, {i: f"__e{i}" for i in touching} if measure else {}
    )
    counted = whole.groupBy(*[col(c) for c in columns]).agg(*out.sums(), *out.measures())
    return Weighted(counted, out.weights, out.totals)


class _Matrix:
    """The checks over weighted tables; each gives rows (world, check, table, column, n_bad, status)."""

    def __init__(self, tables: TableSet, scenarios: Sequence[Scenario]):
        self.tables, self.scenarios = tables, scenarios
        self.spark: SparkSession = tables.fact.sparkSession
        self.worlds = range(len(scenarios))
        keys = [self._keys(s) for s in scenarios]
        self.keys = list(dict.fromkeys(c for own in keys for c in own))
        self.world_keys = dict(enumerate(keys))
        self.measure = rp.MEASURE if rp.MEASURE in tables.fact.columns else None
        fact = weighted(tables.fact, rp.FACT, scenarios, self.keys, self.measure)
        self.fact = Weighted(materialise(fact.df, "weighted_fact"), fact.weights, fact.totals)
        self.schema = T.StructType(
            [
                *[tables.fact.schema[k] for k in self.keys],
                *([tables.fact.schema[rp.MEASURE]] if self.measure else []),
            ]
        )
        self.refs = {
            name: weighted(df, name, scenarios, df.columns) for name, df in tables.refs.items()
        }

    def _keys(self, scenario: Scenario) -> list[str]:
        others = [df.schema for n, df in self.tables.refs.items() if n not in scenario.dropped]
        if self.tables.mapping is not None and rp.MAPPING not in scenario.dropped:
            others.append(self.tables.mapping.schema)
        return roles.preaggregation_keys(self.tables.fact.schema, others)

    # -- shapes -----------------------------------------------------------------

    def rows(
        self,
        df: DataFrame,
        check: str,
        table: Column | str,
        n_bad: Callable[[int], Column],
        status: Callable[[int], Column],
        column: Column | None = None,
        section: str = "checks2_5",
        kept: Callable[[int], Column] | None = None,
        worlds: Sequence[int] | None = None,
    ) -> DataFrame:
        """One row per world out of a row that has the figures of all worlds."""
        worlds = self.worlds if worlds is None else worlds
        each = [
            F.struct(
                F.lit(w).alias("world"),
                n_bad(w).cast("long").alias("n_bad"),
                status(w).alias("status"),
                (kept(w) if kept else F.lit(True)).alias("kept"),
            )
            for w in worlds
        ]
        return (
            df.select(
                (F.lit(table) if isinstance(table, str) else table).alias("table"),
                (column if column is not None else F.lit(None).cast("string")).alias("column"),
                F.inline(F.array(*each)),
            )
            .where("kept")
            .select(
                "world",
                F.lit(section).alias("section"),
                F.lit(check).alias("check"),
                "table",
                "column",
                "status",
                "n_bad",
            )
        )

    def static(self, rows: list[tuple]) -> DataFrame:
        schema = "world int, section string, check string, table string, column string, status string, n_bad bigint"
        return local_rows(self.spark, rows, schema)

    @staticmethod
    def _failing(n: str) -> Callable[[int], Column]:
        return lambda w: F.when(F.coalesce(F.col(f"{n}{w}"), F.lit(0)) > 0, "FAIL").otherwise("PASS")

    @staticmethod
    def _count(n: str) -> Callable[[int], Column]:
        return lambda w: F.coalesce(F.col(f"{n}{w}"), F.lit(0))

    def per_world(self, name: str, figure: Callable[[int], Column]) -> list[Column]:
        return [figure(w).alias(f"{name}{w}") for w in self.worlds]

    # -- checks -----------------------------------------------------------------

    def checks(self) -> list[Callable[[], list[DataFrame]]]:
        """The checks, each one plan for all scenarios; they can run side by side."""
        return [
            self.key_registration,
            self.referential_integrity,
            self.row_uniqueness,
            self.parent_columns,
            self.mapping_uniqueness,
            self.value_ranges,
            self.key_coverage,
        ]

    def key_registration(self) -> list[DataFrame]:
        rows = []
        for w, s in enumerate(self.scenarios):
            targets = {rp.FACT: self.tables.registered()}
            if self.tables.mapping is not None and rp.MAPPING not in s.dropped:
                targets[rp.MAPPING] = self.tables.mapping.columns
            for name, df in self.tables.refs.items():
                wanted = [c for c in roles.key_cols(df.columns) if c != rp.EXEMPT_KEY]
                n = sum(c not in have for c in wanted for have in targets.values())
                rows.append((w, "check1", "key_registration", name, None, "FAIL" if n else "PASS", n))
        return [self.static(rows)]

    def referential_integrity(self) -> list[DataFrame]:
        keys, skipped = {}, []
        for name, df in self.tables.refs.items():
            key = roles.join_key(df.schema, self.schema)
            try:
                require_same_kind(self.tables.fact.select(*[col(k) for k in key]), df, key)
            except KeyTypeClash:
                key = []
            if key:
                keys[name] = key
            else:
                skipped += [
                    (w, "checks2_5", c, name, None, "SKIP", None)
                    for w in self.worlds
                    for c in ("forward_ri", "reverse_ri")
                ]
        parts = [self.static(skipped)]
        if not keys:
            return parts
        columns = list(dict.fromkeys(k for key in keys.values() for k in key))
        short = {c: f"k{i}" for i, c in enumerate(columns)}
        kinds = {c: self.tables.fact.schema[c].dataType for c in columns}
        zero = F.lit(0).cast("long")

        def side(name: str, table: Weighted, left: bool) -> DataFrame:
            cells = [
                (col(c) if c in keys[name] else F.lit(None)).cast(kinds[c]).alias(n)
                for c, n in short.items()
            ]
            own = [table.n(w) for w in self.worlds]
            return table.df.select(
                F.lit(name).alias("table"),
                *cells,
                *[(n if left else zero).alias(f"l{w}") for w, n in enumerate(own)],
                *[(zero if left else n).alias(f"r{w}") for w, n in enumerate(own)],
            )

        both = reduce(
            DataFrame.unionByName,
            [side(n, t, left) for n in keys for t, left in ((self.fact, True), (self.refs[n], False))],
        )
        sums = [F.sum(f"{x}{w}").alias(f"{x}{w}") for x in "lr" for w in self.worlds]
        census = both.groupBy("table", *short.values()).agg(*sums)
        lost = lambda a, b: lambda w: F.count_if((F.col(f"{a}{w}") > 0) & (F.col(f"{b}{w}") <= 0))
        counts = census.groupBy("table").agg(
            *self.per_world("forward", lost("l", "r")), *self.per_world("reverse", lost("r", "l"))
        )
        # a table whose rows and whose fact rows are all absent has no key at all
        named = local_rows(self.spark, [(n,) for n in keys], "table string")
        counts = named.join(counts, "table", "left")
        warned = lambda w: F.when(F.coalesce(F.col(f"reverse{w}"), F.lit(0)) > 0, "WARNING").otherwise("PASS")
        table = F.col("table")
        return [
            *parts,
            self.rows(counts, "forward_ri", table, self._count("forward"), self._failing("forward")),
            self.rows(counts, "reverse_ri", table, self._count("reverse"), warned),
        ]

    def _repeated(self, table: Weighted, key: Sequence[str]) -> DataFrame:
        groups = table.df.groupBy(*[col(k) for k in key]).agg(*table.sums())
        return groups.agg(*self.per_world("n", lambda w: F.count_if(table.n(w) > 1)))

    def row_uniqueness(self) -> list[DataFrame]:
        parts, skipped = [], []
        for name, df in self.tables.refs.items():
            key = roles.uniqueness_key(name, df.schema, self.schema)
            if not key:
                skipped += [(w, "checks2_5", "row_uniqueness", name, None, "SKIP", None) for w in self.worlds]
                continue
            found = self._repeated(self.refs[name], key)
            parts.append(
                self.rows(found, "row_uniqueness", name, self._count("n"), self._failing("n"))
            )
        return [self.static(skipped), *parts]

    def mapping_uniqueness(self) -> list[DataFrame]:
        df, key = self.tables.mapping, []
        if df is not None:
            key = [c for c in df.columns if not c.startswith(rp.KEY_PREFIX)]
        absent = [w for w, s in enumerate(self.scenarios) if not key or rp.MAPPING in s.dropped]
        skipped = [(w, "check6", "mapping_uniqueness", rp.MAPPING, None, "SKIP", None) for w in absent]
        parts = [self.static(skipped)]
        here = [w for w in self.worlds if w not in absent]
        if here:
            table = weighted(df, rp.MAPPING, self.scenarios, key)
            parts.append(
                self.rows(
                    self._repeated(table, key),
                    "mapping_uniqueness",
                    rp.MAPPING,
                    self._count("n"),
                    self._failing("n"),
                    section="check6",
                    worlds=here,
                )
            )
        return parts

    def parent_columns(self) -> list[DataFrame]:
        wanted: list[tuple[str, str, str, str]] = []
        domain: list[str] = []
        for name, df in self.tables.refs.items():
            if name == rp.FORECAST:
                if rp.EXEMPT_KEY in df.columns:
                    wanted += [(name, name, rp.EXEMPT_KEY, c) for c in roles.forecast_context(df.schema)]
                continue
            keys = roles.key_cols(roles.join_key(df.schema, self.schema))
            context = roles.context_cols(df.schema, self.schema)
            wanted += [(name, rp.FACT, k, c) for k in keys for c in context if k != c]
            if name == rp.MIN_LOAD and keys:
                domain = context
        if not self.tables.refs:
            return []
        names = local_rows(self.spark, [(t,) for t in self.tables.refs], "table string")
        found = []
        for source, table in ((rp.FACT, self.fact), (rp.FORECAST, self.refs.get(rp.FORECAST))):
            pairs = sorted({(k, c) for _, s, k, c in wanted if s == source})
            if pairs:
                found.append(self._broken_parents(source, table, pairs))
        if found:
            pairs = local_rows(
                self.spark, wanted, "table string, source string, key_col string, column string"
            )
            bad = pairs.join(reduce(DataFrame.unionByName, found), ["source", "key_col", "column"])
            counts = bad.groupBy("table").agg(
                *self.per_world("n", lambda w: F.count_if(F.col(f"bad{w}") > 0))
            )
            rows = names.join(counts, "table", "left")
        else:
            rows = names.select("table", *self.per_world("n", lambda w: F.lit(0)))
        parts = [
            self.rows(rows, "parent_columns", F.col("table"), self._count("n"), self._failing("n"))
        ]
        if domain:
            parts.append(self._foreign_values(domain))
        return parts

    def _broken_parents(self, source: str, table: Weighted, pairs) -> DataFrame:
        cells = F.array(
            *[
                F.struct(
                    F.lit(k).alias("key_col"),
                    col(k).cast("string").alias("key_value"),
                    F.lit(c).alias("column"),
                    col(c).cast("string").alias("value"),
                )
                for k, c in pairs
            ]
        )
        weights = ["__b", *table.weights.values()]
        held = (
            table.df.select(F.inline(cells), *weights)
            .where("value IS NOT NULL")
            .groupBy("key_col", "key_value", "column", "value")
            .agg(*table.sums())
        )
        values = held.groupBy("key_col", "key_value", "column").agg(
            *self.per_world("v", lambda w: F.count_if(table.n(w) > 0))
        )
        bad = values.groupBy("key_col", "column").agg(
            *self.per_world("bad", lambda w: F.count_if(F.col(f"v{w}") > 1))
        )
        return bad.withColumn("source", F.lit(source))

    def _foreign_values(self, columns: Sequence[str]) -> DataFrame:
        ref, schema = self.refs[rp.MIN_LOAD], self.tables.refs[rp.MIN_LOAD].schema
        kinds = {c: common_type(schema[c].dataType, self.schema[c].dataType) for c in columns}

        def values(table: Weighted, own: str, other: str) -> DataFrame:
            cells = F.array(
                *[
                    F.struct(F.lit(c).alias("column"), col(c).cast(kinds[c]).cast("string").alias("value"))
                    for c in columns
                ]
            )
            return table.df.select(
                F.inline(cells),
                *[table.n(w).alias(f"{own}{w}") for w in self.worlds],
                *[F.lit(0).cast("long").alias(f"{other}{w}") for w in self.worlds],
            ).where("value IS NOT NULL")

        held = values(ref, "r", "f").unionByName(values(self.fact, "f", "r"))
        sums = [F.sum(f"{x}{w}").alias(f"{x}{w}") for x in "rf" for w in self.worlds]
        groups = held.groupBy("column", "value").agg(*sums)
        foreign = lambda w: F.count_if((F.col(f"r{w}") > 0) & (F.col(f"f{w}") <= 0))
        counts = groups.groupBy("column").agg(*self.per_world("n", foreign))
        named = local_rows(self.spark, [(c,) for c in columns], "column string")
        return self.rows(
            named.join(counts, "column", "left"),
            "domain_membership",
            rp.MIN_LOAD,
            self._count("n"),
            self._failing("n"),
            column=F.col("column"),
        )

    def value_ranges(self) -> list[DataFrame]:
        refs, parts = self.tables.refs, []
        for name, c in [*[(t, rp.RATE) for t in rp.RATE_TABLES], (rp.TREND, rp.TREND_VALUE)]:
            if name in refs and c in refs[name].columns:
                parts.append(self._band(name, c))
        for name in rp.PATTERN_TABLES:
            for c in roles.with_prefix(refs[name].schema, rp.DEVELOPMENT_PREFIX) if name in refs else []:
                parts.append(self._exceed(name, c))
        if rp.MONTH in self.keys:
            parts.append(self._months())
        for name in rp.PATTERN_TABLES:
            if name in refs and rp.DEVELOPMENT in refs[name].columns:
                key = roles.pattern_key(refs[name].schema)
                if key:
                    parts.append(self._sequences(name, key))
        if rp.MIN_LOAD in refs:
            for c in roles.with_prefix(refs[rp.MIN_LOAD].schema, rp.MIN_LOAD_PREFIX):
                parts.append(self._numeric(c))
        return parts

    def _sums(self, table: Weighted, figures: Mapping[str, Column]) -> DataFrame:
        """Weighted sums of figures by world, in one row; 0 over nothing."""
        return table.df.agg(
            *[
                F.coalesce(F.sum(figure * table.n(w)), F.lit(0)).alias(f"{name}{w}")
                for name, figure in figures.items()
                for w in self.worlds
            ]
        )

    def _band(self, name: str, column: str) -> DataFrame:
        v, bands = col(column), rp.RATE_BANDS
        outside = lambda edge: F.when(F.abs(v) > edge, 1).otherwise(0)
        found = self._sums(
            self.refs[name],
            {
                "n": v.isNotNull().cast("int"),
                "inner": outside(bands["inner"]),
                "outer": outside(bands["outer"]),
            },
        )
        pct = lambda x, w: percent(F.col(f"{x}{w}"), F.col(f"n{w}"))
        return self.rows(
            found,
            "band_share",
            name,
            lambda w: F.lit(None),
            lambda w: ranges.band_status(
                pct("inner", w), pct("outer", w), bands["warn_pct"], bands["fail_pct"]
            ),
            column=F.lit(column),
            section="check7",
            kept=lambda w: F.col(f"n{w}") > 0,
        )

    def _exceed(self, name: str, column: str) -> DataFrame:
        v, limits = col(column), rp.DEVELOPMENT_LIMITS
        found = self._sums(
            self.refs[name],
            {
                "n": v.isNotNull().cast("int"),
                "total": v,
                "above": F.when(v > limits["ceiling"], 1).otherwise(0),
            },
        )
        return self.rows(
            found,
            "exceed_share",
            name,
            lambda w: F.lit(None),
            lambda w: ranges.exceed_status(
                F.try_divide(F.col(f"total{w}").cast("double"), F.col(f"n{w}").cast("double")),
                percent(F.col(f"above{w}"), F.col(f"n{w}")),
                *(limits[k] for k in ("mean_lo", "mean_hi", "warn_pct", "fail_pct")),
            ),
            column=F.lit(column),
            section="check7",
            kept=lambda w: F.col(f"n{w}") > 0,
        )

    def _months(self) -> DataFrame:
        fact = self.fact
        value = col(rp.MONTH)
        if not is_numeric(self.schema[rp.MONTH].dataType):
            value = value.cast("string")
        months = (
            fact.df.select(value.alias("value"), "__b", *fact.weights.values())
            .where("value IS NOT NULL")
            .groupBy("value")
            .agg(*fact.sums())
            .withColumn("valid", ranges.is_yyyymm(F.col("value")))
        )
        counts = months.agg(
            *self.per_world("n", lambda w: F.count_if(fact.n(w) > 0)),
            *self.per_world("bad", lambda w: F.count_if((fact.n(w) > 0) & ~F.col("valid"))),
        )
        return self.rows(
            counts,
            "yyyymm",
            rp.FACT,
            self._count("bad"),
            lambda w: ranges.months_status(F.col(f"n{w}"), F.col(f"bad{w}")),
            column=F.lit(rp.MONTH),
            section="check7",
        )

    def _sequences(self, name: str, key: str) -> DataFrame:
        table, limits = self.refs[name], rp.SEQUENCE_LIMITS
        pos = col(rp.DEVELOPMENT).cast("long")
        held = (
            table.df.select(col(key).alias("key"), pos.alias("pos"), "__b", *table.weights.values())
            .where("pos IS NOT NULL")
            .groupBy("key", "pos")
            .agg(*table.sums())
        )
        here = lambda w: F.when(table.n(w) > 0, F.col("pos"))
        spans = held.groupBy("key").agg(
            *self.per_world("first", lambda w: F.min(here(w))),
            *self.per_world("last", lambda w: F.max(here(w))),
            *self.per_world("held", lambda w: F.count(here(w))),
        )
        broken = lambda w: ranges.sequence_broken(
            F.col(f"first{w}"), F.col(f"last{w}"), F.col(f"held{w}"), **limits
        )
        counts = spans.agg(
            *self.per_world("n", lambda w: F.count_if((F.col(f"held{w}") > 0) & broken(w)))
        )
        return self.rows(
            counts,
            "sequence",
            name,
            self._count("n"),
            self._failing("n"),
            column=F.lit(rp.DEVELOPMENT),
            section="check7",
        )

    def _numeric(self, column: str) -> DataFrame:
        kind, limits = self.tables.refs[rp.MIN_LOAD].schema[column].dataType, rp.MIN_LOAD_LIMITS
        v = col(column)
        number = v.cast("double") if is_numeric(kind) else as_number(v)
        found = self._sums(
            self.refs[rp.MIN_LOAD],
            {
                "bad": (v.isNotNull() & number.isNull()).cast("int"),
                "n": number.isNotNull().cast("int"),
                "below": F.when(number < limits["ceiling"], 1).otherwise(0),
            },
        )
        below = lambda w: F.coalesce(percent(F.col(f"below{w}"), F.col(f"n{w}")), F.lit(100.0))
        return self.rows(
            found,
            "numeric_share",
            rp.MIN_LOAD,
            self._count("bad"),
            lambda w: ranges.numeric_status(F.col(f"bad{w}"), below(w), limits["min_pct"]),
            column=F.lit(column),
            section="check7",
        )

    def key_coverage(self) -> list[DataFrame]:
        columns = sorted(roles.with_prefix(self.schema, rp.MODELLING_PREFIX))
        if not self.measure or not columns:
            return []
        parts = []
        for keys in {tuple(k) for k in self.world_keys.values()}:
            worlds = [w for w in self.worlds if tuple(self.world_keys[w]) == keys]
            fact = self.fact
            groups = fact.df
            if set(keys) != set(self.keys):
                groups = groups.groupBy(*[col(k) for k in keys]).agg(*fact.sums(), *fact.measures())
            for c in columns:
                blank = is_blank(col(c))
                counts = groups.agg(
                    *[F.count_if(blank & (fact.n(w) > 0)).alias(f"n{w}") for w in worlds],
                    *[
                        F.coalesce(F.sum(F.when(blank & (fact.n(w) > 0), fact.m(w))), F.lit(0)).alias(f"m{w}")
                        for w in worlds
                    ],
                )
                parts.append(
                    self.rows(
                        counts,
                        "key_coverage",
                        F.lit(None).cast("string"),
                        self._count("n"),
                        lambda w: F.when(F.col(f"m{w}") > 0, "WARNING").otherwise("PASS"),
                        column=F.lit(c),
                        section="check8",
                        worlds=worlds,
                    )
                )
        return parts


def scenario_matrix(tables: TableSet, scenarios: Sequence[Scenario]) -> DataFrame:
    """One row per scenario and finding: what a run over the changed tables would find.

    Columns scenario, section, check, table, column, status and n_bad, equal to
    those of ``run_checks`` over each scenario's own tables.  A scenario
    without changes is the baseline.  Scenarios are few; each adds its signed
    rows and a few sums to every check.
    """
    names = [s.name for s in scenarios]
    if len(set(names)) != len(names):
        raise ValueError(f"scenarios of one name: {names}")
    if not scenarios:
        return local_rows(tables.fact.sparkSession, [], OUTCOME)
    if any(rp.FACT in s.dropped for s in scenarios):
        raise ValueError("without the fact there is nothing to check")
    m = _Matrix(tables, scenarios)
    spark = m.spark

    def gathered(check: Callable[[], list[DataFrame]]) -> list[Row]:
        parts = check()  # findings of all scenarios: bounded by the schemas
        return reduce(DataFrame.unionByName, parts).collect() if parts else []

    with ThreadPoolExecutor(len(m.checks())) as pool:
        jobs = [pool.submit(inheritable_thread_target(spark)(gathered), c) for c in m.checks()]
        found = [r for job in jobs for r in job.result()]
    rows = [
        (names[r["world"]], *(r[c] for c in ("section", "check", "table", "column", "status", "n_bad")))
        for r in found
        if r["table"] == rp.MAPPING or r["table"] not in scenarios[r["world"]].dropped
    ]
    return local_rows(spark, rows, OUTCOME)
