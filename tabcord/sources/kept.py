"""A pre-aggregated fact that is kept up to date by reading changed files only.

For every file of the fact its own sums per key are kept beside the totals, and
a ledger of the files they came from, each with its length and time of change.
A refresh compares the ledger with the folder: files that were added or changed
are read and added, the kept sums of files that were removed or changed are
taken away again.  Both meet with their signs in one grouping with the totals
before.  Sums are whole numbers or decimals, so taking away is exact and the
result equals a rebuild in every digit.

A refresh is a new generation of parts, totals and ledger; the ledger is written
last, so a refresh that fails leaves the generation before in force.  The folder
is listed again after reading: if a file changed meanwhile, the refresh starts
over, so a ledger never names a state of a file other than the one that was summed.
One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import clean, col
from ..functions.durable import materialise, remove

LEDGER = "file string, length bigint, modified timestamp, gen bigint"
TRIES = 3


class FilesKeepChanging(RuntimeError):
    """Files of the fact changed during every attempt to read them."""


def plain_path(path: Column) -> Column:
    """A path with one slash behind its scheme, however Spark wrote it."""
    return F.regexp_replace(path, "^([A-Za-z0-9+.-]+:)/+", "$1/")


def source_file() -> Column:
    """The file a row was read from, as :func:`listing` names it."""
    coded = F.col("_metadata.file_path")
    return plain_path(F.url_decode(F.replace(coded, F.lit("+"), F.lit("%2B"))))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(file, length, modified) of the files below a folder; no content is read."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER).drop("gen")
    return files.select(
        plain_path(F.col("path")).alias("file"),
        "length",
        F.col("modificationTime").alias("modified"),
    )


def parquet_files(spark: SparkSession, folder: str, files: Sequence[str]) -> DataFrame:
    """Given Parquet files of a folder, with the folder's partition columns."""
    return spark.read.option("basePath", folder).parquet(*files)


@dataclass
class KeptAggregate:
    """Sums of a fact folder per key, kept below ``path``.

    ``exact`` names the decimal type of a floating measure.  ``read`` opens
    given files of the folder (Parquet by default).  ``last_read`` has the files
    that the last refresh read.
    """

    spark: SparkSession
    folder: str
    path: str
    keys: Sequence[str]
    measure: str
    rows_as: str = "n_rows"
    exact: str | None = None
    read: Callable[[SparkSession, str, Sequence[str]], DataFrame] = parquet_files
    last_read: list[str] = field(default_factory=list)

    # -- generations ------------------------------------------------------------

    def _place(self, kind: str, gen: int) -> str:
        return f"{self.path}/{kind}/{gen:08d}"

    def generation(self) -> int:
        """The generation in force, 0 before the first refresh."""
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/ledger/*/_SUCCESS")
        system = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = system.globStatus(place) or []
        return max((int(f.getPath().getParent().getName()) for f in found), default=0)

    def ledger(self, gen: int | None = None) -> DataFrame:
        gen = self.generation() if gen is None else gen
        if not gen:
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(self._place("ledger", gen))

    def is_current(self) -> bool:
        """Whether the folder holds exactly the files that were summed."""
        now, held = listing(self.spark, self.folder), self.ledger().drop("gen")
        return now.exceptAll(held).isEmpty() and held.exceptAll(now).isEmpty()

    # -- sums -------------------------------------------------------------------

    def _summed(self, files: Sequence[str]) -> DataFrame:
        """(file, keys, measure, values, rows): the sums of each given file."""
        rows = self.read(self.spark, self.folder, files)
        kind = rows.schema[self.measure].dataType
        value = clean(rows, self.measure)
        if self.exact:
            value, kind = value.cast(self.exact), T.DataType.fromDDL(self.exact)
        if isinstance(kind, T.DecimalType):
            total = T.DecimalType(38, kind.scale)
        elif isinstance(kind, T.IntegralType):
            total = T.LongType()
        else:
            raise ValueError(f"sums of {kind.simpleString()} need a decimal type: exact=...")
        cells = rows.select(
            source_file().alias("__file"),
            *[clean(rows, k).alias(k) for k in self.keys],
            value.alias("__value"),
        )
        return cells.groupBy("__file", *[col(k) for k in self.keys]).agg(
            F.coalesce(F.sum("__value"), F.lit(0)).cast(total).alias("__total"),
            F.count("__value").alias("__values"),
            F.count(F.lit(1)).alias("__rows"),
        )

    def _signed(self, parts: DataFrame, sign: int) -> DataFrame:
        sums = ("__total", "__values", "__rows")
        kinds = {c: parts.schema[c].dataType for c in sums}
        return parts.select(
            *[col(k) for k in self.keys],
            *[(F.col(c) * sign).cast(kinds[c]).alias(c) for c in sums],
        )

    def _merged(self, parts: list[DataFrame]) -> DataFrame:
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        kinds = {c: whole.schema[c].dataType for c in ("__total", "__values", "__rows")}
        sums = [F.sum(c).cast(k).alias(c) for c, k in kinds.items()]
        return whole.groupBy(*[col(k) for k in self.keys]).agg(*sums).where("__rows > 0")

    def refresh(self) -> DataFrame:
        """Bring the sums up to date and return them."""
        for _ in range(TRIES):
            if self._refreshed():
                return self.result()
        raise FilesKeepChanging(self.folder)

    def _refreshed(self) -> bool:
        spark, before = self.spark, self.generation()
        now = materialise(listing(spark, self.folder), "listing")
        held = self.ledger(before)
        same = ["file", "length", "modified"]
        fresh = now.join(held, same, "left_anti")
        gone = held.join(now, same, "left_anti")
        # the names of changed files: Spark's own reader takes them from the driver too
        files = sorted(r["file"] for r in fresh.select("file").collect())
        gens = sorted(r["gen"] for r in gone.select("gen").distinct().collect())
        self.last_read = files
        if not files and not gens:
            return True
        gen, changes = before + 1, []
        if files:
            self._summed(files).write.mode("overwrite").parquet(self._place("parts", gen))
            parts = spark.read.parquet(self._place("parts", gen))
            own = fresh.select(F.col("file").alias("__file"))
            if not parts.join(own, "__file", "left_anti").isEmpty():
                raise RuntimeError("sums of files that are not listed")
            changes.append(self._signed(parts, 1))
        for g in gens:
            parts = spark.read.parquet(self._place("parts", g))
            lost = gone.where(F.col("gen") == g).select(F.col("file").alias("__file"))
            changes.append(self._signed(parts.join(lost, "__file", "left_semi"), -1))
        if before:
            changes.append(spark.read.parquet(self._place("totals", before)))
        self._merged(changes).write.mode("overwrite").parquet(self._place("totals", gen))
        again = listing(spark, self.folder)
        if not (again.exceptAll(now).isEmpty() and now.exceptAll(again).isEmpty()):
            return False
        kept = held.join(now, same, "left_semi")
        added = fresh.select(*same, F.lit(gen).cast("bigint").alias("gen"))
        ledger = kept.unionByName(added).repartition(1)
        ledger.write.mode("overwrite").parquet(self._place("ledger", gen))
        self._clear(gen)
        return True

    def _clear(self, gen: int) -> None:
        """Remove parts without a file in the ledger, and generations before the last."""
        named = {r["gen"] for r in self.ledger(gen).select("gen").distinct().collect()}
        for g in range(1, gen + 1):
            if g not in named:
                remove(self.spark, self._place("parts", g))
            if g < gen - 1:
                remove(self.spark, self._place("totals", g))
                remove(self.spark, self._place("ledger", g))

    def result(self) -> DataFrame:
        """Keys, the summed measure (null over no value) and the number of rows."""
        gen = self.generation()
        if not gen:
            raise LookupError(f"{self.folder} never held a file")
        total = F.when(F.col("__values") > 0, F.col("__total"))
        return self.spark.read.parquet(self._place("totals", gen)).select(
            *[col(k) for k in self.keys],
            total.alias(self.measure),
            F.col("__rows").alias(self.rows_as),
        )
