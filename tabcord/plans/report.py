"""What a run writes besides its findings: every row behind them, and scratch tables."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import local_rows
from ..functions.durable import exists, materialise, new_path, remove
from ..rules import rulepack as rp

DETAIL = T.StructType(
    [
        *[T.StructField(n, T.StringType()) for n in ("check", "table", "column", "record")],
        T.StructField("n_rows", T.LongType()),
        T.StructField("measure", T.DoubleType()),
        T.StructField("pct", T.DoubleType()),
    ]
)


@dataclass
class Report:
    """Folder and limits of a run; collects the full rows behind its findings.

    A finding shows at most ``evidence_rows`` rows (``top_rows`` for unmatched
    keys); all of them are in the details.
    """

    spark: SparkSession
    folder: str = ""
    evidence_rows: int = rp.EVIDENCE_ROWS
    top_rows: int = rp.TOP_ROWS
    parts: list[DataFrame] = field(default_factory=list)

    def __post_init__(self):
        self.folder = self.folder or new_path(self.spark, "run")

    def stash(self, df: DataFrame, name: str) -> DataFrame:
        """Store an intermediate until the run ends."""
        return materialise(df, name, f"{self.folder}/scratch/{uuid.uuid4().hex}/{name}")

    def keep(self, df: DataFrame, check: str | Column, **values: Column | str) -> DataFrame:
        """Store the full rows behind a finding and open what was stored."""
        check = F.lit(check) if isinstance(check, str) else check
        given = {"check": check, **values}
        cells = []
        for f in DETAIL.fields:
            v = given.get(f.name, F.lit(None))
            cells.append((F.col(v) if isinstance(v, str) else v).cast(f.dataType).alias(f.name))
        place = f"{self.folder}/details/{uuid.uuid4().hex}"
        stored = materialise(df.select(*cells), "details", place)
        self.parts.append(stored)
        return stored

    def details(self) -> DataFrame:
        out = local_rows(self.spark, [], DETAIL)
        for part in self.parts:
            out = out.unionByName(part)
        return out

    def stored_details(self) -> DataFrame:
        """The details below the folder, whoever kept them."""
        place = f"{self.folder}/details"
        if not exists(self.spark, place):
            return local_rows(self.spark, [], DETAIL)
        return self.spark.read.schema(DETAIL).option("recursiveFileLookup", True).parquet(place)

    def clear(self) -> None:
        """Remove the intermediates; details and findings stay."""
        remove(self.spark, f"{self.folder}/scratch")
