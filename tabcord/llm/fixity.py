"""Merkle fixity audit of WARC archives.

Records are laid out in WARC files with byte offsets.  For every file a tree
of SHA-256 digests is built: a leaf covers one record and its offset range, a
node covers ``fan_out`` consecutive children.  Two replicas are compared from
the roots down; only children of mismatching nodes are looked at, level by
level, until the damaged records are found.

All steps are SQL functions, groupings and joins.  A node has at most
``fan_out`` children, and pages are dealt to files by id, url and body, so a
file holds a bounded expected number of different records, whatever id or url
many pages share; only copies equal in all three stay together.  Null urls and
bodies count as empty; a null id is written as such; repeated records are
separate records, ordered by id, url and digest.  Long bodies are records like
others.  Empty tables have no files and no damage.  Other columns of the pages
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import materialise

FAN_OUT = 16


def record_text(page_id: Column, url: Column, body: Column) -> Column:
    """One WARC record: header, body, and the two line ends that close it."""
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        page_id,
        F.lit(">\r\nWARC-Target-URI: "),
        url,
        F.lit("\r\nContent-Length: "),
        F.octet_length(F.encode(body, "UTF-8")).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def file_of(page_id: Column, url: Column, body: Column, files: int) -> Column:
    """The file of a page: 32 bits of an MD5 digest, modulo the number of files."""
    own = F.md5(F.encode(body, "UTF-8"))
    digest = F.md5(F.encode(F.concat(page_id, F.lit(" "), url, F.lit(" "), own), "UTF-8"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % files).cast("int")


def archive(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    body_col: str = "html",
    records_per_file: int = 2048,
) -> DataFrame:
    """(page_id, file, record): every page as a WARC record and the file it belongs to.

    The number of files follows the number of pages.
    """
    files = max(1, -(-pages.count() // records_per_file))
    page_id = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    url, body = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (url_col, body_col))
    return pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        file_of(page_id, url, body, files).alias("file"),
        record_text(page_id, url, body).alias("record"),
    )


def laid_out(records: DataFrame) -> DataFrame:
    """(page_id, file, seq, offset, length, digest, record): records at their place in a file.

    Records of a file are ordered by id and digest; records that agree in both
    are interchangeable.  Only what is selected from the result is shuffled.
    """
    data = F.encode("record", "UTF-8")
    rows = records.select(
        "page_id",
        "file",
        F.octet_length(data).cast("long").alias("length"),
        F.sha2(data, 256).alias("digest"),
        "record",
    )
    order = Window.partitionBy("file").orderBy("page_id", "digest")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(
        "page_id",
        "file",
        (F.row_number().over(order) - 1).cast("long").alias("seq"),
        F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"),
        "length",
        "digest",
        "record",
    )


def manifest(records: DataFrame) -> DataFrame:
    """(page_id, file, seq, offset, length, digest) of records, in file order."""
    return laid_out(records).drop("record")


def leaves(records: DataFrame) -> DataFrame:
    """(file, level 0, place, node) of a manifest."""
    node = F.sha2(F.concat_ws(":", "offset", "length", "digest").cast("binary"), 256)
    return records.select(
        "file", F.lit(0).alias("level"), F.col("seq").alias("place"), node.alias("node")
    )


def tree(records: DataFrame, levels: int, fan_out: int = FAN_OUT) -> DataFrame:
    """(file, level, place, node): all nodes up to the root of each file."""
    level = leaves(records)
    out = level
    for k in range(1, levels + 1):
        level = level.groupBy("file", F.floor(F.col("place") / fan_out).alias("place")).agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("place", "node"))),
                    lambda x: F.concat_ws(":", x["place"], x["node"]),
                ),
                ",",
            ).alias("held")
        )
        level = level.select(
            "file",
            F.lit(k).alias("level"),
            "place",
            F.sha2(F.col("held").cast("binary"), 256).alias("node"),
        )
        out = out.unionAll(level)
    return out


def height(records: DataFrame, fan_out: int = FAN_OUT) -> int:
    """Levels above the leaves, so that every file has one root."""
    most = records.agg(F.max("seq")).first()[0] or 0
    levels = 1
    while fan_out**levels <= most:
        levels += 1
    return levels


def mismatches(
    ours: DataFrame, theirs: DataFrame, levels: int, fan_out: int = FAN_OUT
) -> tuple[DataFrame, list[int]]:
    """(file, place, damage) of leaves that differ, and how many nodes each level compared.

    Both trees are stored; a level reads only children of nodes that differ.
    """
    suspects: DataFrame | None = None
    looked = []
    for k in range(levels, -1, -1):
        a = ours.where(F.col("level") == k).select("file", "place", F.col("node").alias("a"))
        b = theirs.where(F.col("level") == k).select("file", "place", F.col("node").alias("b"))
        if suspects is not None:
            parent = suspects.select("file", F.col("place").alias("parent"))
            a, b = (
                t.withColumn("parent", F.floor(F.col("place") / fan_out))
                .join(parent, ["file", "parent"], "left_semi")
                .drop("parent")
                for t in (a, b)
            )
        both = materialise(a.join(b, ["file", "place"], "full_outer"), f"level{k}")
        looked.append(both.count())
        suspects = both.where(~F.col("a").eqNullSafe(F.col("b")))
    damage = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra")
    return suspects.select("file", "place", damage.otherwise("corrupt").alias("damage")), looked


def audit(ours: DataFrame, theirs: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """Compare two manifests; every record of ours with its state in the replica.

    (page_id, warc_file, warc_offset, length, digest, status): status is ok,
    corrupt or missing; records that only the replica has are added as extra.
    A replica's manifest keeps the sequence numbers and offsets of the original,
    so a lost record leaves a gap and does not shift the others.
    """
    ours, theirs = materialise(ours, "ours"), materialise(theirs, "theirs")
    levels = height(ours.select("seq").unionAll(theirs.select("seq")), fan_out)
    trees = [materialise(tree(m, levels, fan_out), "tree") for m in (ours, theirs)]
    found, _ = mismatches(*trees, levels, fan_out)
    found = materialise(found.withColumnRenamed("place", "seq"), "damage")
    states = ours.join(found, ["file", "seq"], "left").withColumn(
        "status", F.coalesce("damage", F.lit("ok"))
    )
    extra = theirs.join(found.where("damage = 'extra'"), ["file", "seq"]).withColumn(
        "status", F.lit("extra")
    )
    columns = [
        "page_id",
        F.col("file").alias("warc_file"),
        F.col("offset").alias("warc_offset"),
        "length",
        "digest",
        "status",
    ]
    return states.select(*columns).unionAll(extra.select(*columns))


def stored_manifest(replica: DataFrame) -> DataFrame:
    """The manifest of stored records (page_id, file, seq, offset, record), digests taken anew."""
    data = F.encode("record", "UTF-8")
    return replica.select(
        "page_id",
        "file",
        "seq",
        "offset",
        F.octet_length(data).cast("long").alias("length"),
        F.sha2(data, 256).alias("digest"),
    )
