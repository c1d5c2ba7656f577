import hashlib

import pytest

from tabcord.llm import fixity, queries


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_matches_sql(spark, sf, folder):
    duckdb = pytest.importorskip("duckdb")
    where = sf.replace("sf0.001", folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{where}/pages.parquet'")
    df = queries.op5_fixity(spark, where)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(queries.ORACLE["op5_fixity"])
    assert got == rows_of([d[0] for d in res.description], res.fetchall())


def pages(spark, n):
    rows = [(i, f"http://h/{i}", "body %d é " % i * (i % 7)) for i in range(n)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def stored(spark, records, change):
    rows = fixity.laid_out(records).select("page_id", "file", "seq", "offset", "record")
    held = [r.asDict() for r in rows.collect()]
    return fixity.stored_manifest(
        spark.createDataFrame(
            change(held), "page_id long, file int, seq long, offset long, record string"
        )
    )


def test_audit_finds_each_damage_and_descends_only_there(spark):
    records = fixity.archive(pages(spark, 300), records_per_file=100).cache()
    index = fixity.manifest(records).cache()

    def change(rows):
        out = [dict(r) for r in rows if r["page_id"] != 17]
        for r in out:
            if r["page_id"] == 40:
                r["record"] += "x"
        last = max(r["seq"] for r in out if r["file"] == 1)
        return [*out, {**out[0], "page_id": 999, "file": 1, "seq": last + 1}]

    theirs = stored(spark, records, change).cache()
    got = {(r.page_id, r.status) for r in fixity.audit(index, theirs, 4).collect()}
    assert {g for g in got if g[1] != "ok"} == {(17, "missing"), (40, "corrupt"), (999, "extra")}
    assert len(got) == 301
    levels = fixity.height(index.select("seq").unionAll(theirs.select("seq")), 4)
    trees = [fixity.tree(m, levels, 4).cache() for m in (index, theirs)]
    _, looked = fixity.mismatches(*trees, levels, 4)
    assert looked[0] == 3 and max(looked) <= 3 * 4 and len(looked) == levels + 1


def test_equal_replicas_end_at_the_roots(spark):
    index = fixity.manifest(fixity.archive(pages(spark, 50))).cache()
    trees = [fixity.tree(index, 2).cache()] * 2
    found, looked = fixity.mismatches(*trees, 2)
    assert found.count() == 0 and looked == [1, 0, 0]


def test_record_layout(spark):
    row = fixity.archive(spark.createDataFrame([(1, "u", "é")], "page_id long, url string, html string"))
    text = row.first().record
    head, body = text.split("\r\n\r\n", 1)
    assert head.startswith("WARC/1.1\r\n") and "Content-Length: 2" in head
    assert body == "é\r\n\r\n"
    entry = fixity.manifest(row).first()
    assert entry.digest == hashlib.sha256(text.encode()).hexdigest()
    assert (entry.offset, entry.length, entry.seq) == (0, len(text.encode()), 0)


def test_odd_pages(spark):
    odd = spark.createDataFrame(
        [(None, None, None), (1, None, ""), (1, None, ""), (2, "u", "x" * 100_000), (3, "u", None)],
        "page_id long, url string, html string",
    )
    records = fixity.archive(odd).cache()
    index = fixity.manifest(records).cache()
    assert index.count() == 5 and index.select("file", "seq").distinct().count() == 5
    theirs = stored(spark, records, lambda rows: rows)
    assert {r.status for r in fixity.audit(index, theirs).collect()} == {"ok"}
    none = fixity.archive(odd.limit(0))
    empty = fixity.manifest(none)
    assert fixity.audit(empty, empty).count() == 0


def test_pages_without_id_and_url_spread_over_files(spark):
    rows = spark.range(20_000).selectExpr(
        "CASE WHEN id % 2 = 1 THEN id END AS page_id",
        "CASE WHEN id % 2 = 1 THEN 'u' || id END AS url",
        "'body ' || id AS html",
        "'own' AS file",
        "id AS record",
    )
    sizes = [r["count"] for r in fixity.archive(rows).groupBy("file").count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 2400
