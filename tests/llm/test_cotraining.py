import numpy as np

from tabcord.llm import cotraining as ct

from .conftest import ODD


def test_bad_documents_are_found(spark, sf):
    where = sf.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{where}/documents.parquet")
    labels = spark.read.parquet(f"{where}/labels.parquet")
    got = {r.doc_id: r for r in ct.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    good = {r.doc_id: r.quality == 1 and r.toxic == 0 for r in labels.collect()}
    kept = np.mean([got[d].accepted for d, g in good.items() if g])
    found = np.mean([not got[d].accepted for d, g in good.items() if not g])
    assert kept > 0.95 and found > 0.8
    assert all(0 <= r.score <= 1 and 0 <= r.p_text <= 1 and 0 <= r.p_meta <= 1 for r in got.values())


def test_views_teach_each_other():
    rng = np.random.default_rng(4)
    n = 600
    y = rng.integers(0, 2, n)
    text = np.column_stack([y + rng.normal(0, 0.2, n), rng.normal(size=n)])
    meta = np.column_stack([y + rng.normal(0, 0.5, n), rng.normal(size=n)])
    known = np.where(np.arange(n) < 12, y, -1)
    fold = np.zeros(n, bool)
    alone = ct.cotrain(text, meta, known, fold, 0, 0.1, 0.9)["meta"]
    taught = ct.cotrain(text, meta, known, fold, 4, 0.1, 0.9)["meta"]
    right = lambda w: np.mean((ct.margins(meta, w) > 0) == (y == 1))
    assert right(taught) >= right(alone) - 0.02 and right(taught) > 0.8


def test_a_taught_view_is_better():
    rng = np.random.default_rng(14)
    n = 900
    y = rng.integers(0, 2, n)
    text = np.column_stack([y + rng.normal(0, 0.2, n), rng.normal(size=n)])
    meta = np.column_stack([y + rng.normal(0, 0.5, n), rng.normal(size=(n, 40))])
    known = np.where(np.arange(n) < 12, y, -1)
    fold = np.zeros(n, bool)
    right = lambda w: np.mean((ct.margins(meta, w) > 0) == (y == 1))
    alone = right(ct.cotrain(text, meta, known, fold, 0, 0.1, 0.9)["meta"])
    taught = right(ct.cotrain(text, meta, known, fold, 4, 0.1, 0.9)["meta"])
    assert taught > alone + 0.05 and taught > 0.8


def test_a_table_is_scored_like_its_rows_alone(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = ct.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    for r in ct.score_rows(docs, model).limit(60).collect():
        own = r.row
        rates, owners, codes = ct.view_of_text([own.text or ""])
        # the text view, one column at a time
        total = model.text[-1]
        known = {int(c): i for i, c in enumerate(model.words)}
        total += sum(model.text[known[int(c)]] for c in codes if int(c) in known)
        first = len(model.words)
        for k, edges in enumerate(model.edges):
            value = rates[0, k]
            bin_ = len(edges) + 1 if np.isnan(value) else sum(e <= value for e in edges)
            total += model.text[first + bin_]
            first += len(edges) + 2
        meta, first = model.meta[-1], 0
        for table, value in zip(model.categories, (own.lang, own.source), strict=True):
            meta += model.meta[first + table.get(str(value), len(table))]
            first += len(table) + 1
        edges = model.number_edges[0]
        meta += model.meta[first + sum(e <= own.n_chars for e in edges)]
        both = [
            m * model.calibration[k][0] + model.calibration[k][1]
            for k, m in (("text", total), ("meta", meta))
        ]
        last = both[0] * model.combine[0] + both[1] * model.combine[1] + model.combine[2]
        want = 0.0 if np.isnan(rates[0, 0]) else 1 / (1 + np.exp(-last))
        assert abs(r.score - want) < 1e-9
        assert r.accepted == (not np.isnan(rates[0, 0]) and r.score >= model.cut)


def test_confident_rows_are_the_surest():
    p = np.array([0.99, 0.97, 0.5, 0.01, 0.98, 0.02])
    free = np.array([True, True, True, True, False, True])
    assert ct.confident(p, free, 0.2, 0.95) == {0: 1, 3: 0}


def test_text_view_counts_words_and_stems():
    rates, owners, codes = ct.view_of_text(["Tree tree TREE", "", "treehouse oak oak"])
    assert np.isnan(rates[1]).all() and rates[0][4] > 0 and rates[0][3] > 0.5
    first, last = set(codes[owners == 0].tolist()), set(codes[owners == 2].tolist())
    assert len(first) == 1 and len(last) == 5  # two words, three stems of treehouse


def test_cut_spares_the_good():
    p = np.array([0.1, 0.2, 0.3, 0.6, 0.7, 0.8])
    y = np.array([0, 0, 1, 0, 1, 1])
    assert 0.2 < ct.best_cut(p, y, 0.0) < 0.3
    assert 0.6 < ct.best_cut(p, y, 0.4) < 0.7
    assert ct.best_cut(p, np.ones(6, int), 0.1) == 0.0


def test_a_repeated_id_gives_one_row_of_the_sample(spark, docs, sf, monkeypatch):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    sizes = []
    real = ct.sample_views

    def counted(rows):
        sizes.append((rows.count(), rows.select("id").distinct().count()))
        return real(rows)

    monkeypatch.setattr(ct, "sample_views", counted)
    ct.train(docs.unionAll(docs).unionAll(docs), labels, per_class=20, pool=30)
    assert sizes[0][0] == sizes[0][1] <= 70


def test_odd_tables(spark, odd, none):
    labels = spark.createDataFrame(
        [(4, 1, 0), (5, 1, 0), (6, 1, 0), (7, 0, 0), (8, 0, 1), (9, 0, 0), (None, 1, 1), (1, None, 0)],
        "doc_id long, quality int, toxic int",
    )
    rows = ct.classify(odd, labels).collect()
    assert len(rows) == len(ODD)
    assert not any(r.accepted or r.score for r in rows if r.doc_id in (1, 2, 3))
    kept = ct.keep_accepted(odd, labels)
    assert kept.columns == odd.columns
    assert kept.count() == sum(r.accepted for r in rows)
    unlabelled = ct.classify(odd, labels.limit(0)).collect()
    assert {r.accepted for r in unlabelled if r.doc_id not in (1, 2, 3)} == {True}
    assert ct.classify(none, labels).count() == 0
    bare = ct.classify(odd, labels, categories=(), numbers=()).collect()
    assert len(bare) == len(ODD)


def test_every_category_of_the_sample_has_a_column():
    model = ct.Model(np.zeros(0, np.uint64), [])
    cats = [[f"s{i:03d}" for i in range(300)]]
    model.categories = [{v: i for i, v in enumerate(sorted(set(cats[0])))}]
    model.number_edges = []
    found = model.meta_matrix(cats, [])
    assert found.shape == (300, 301) and (found.sum(axis=0)[:300] == 1).all()
    model.meta = np.arange(302.0)
    assert (model.meta_margins(cats, []) == ct.margins(found, model.meta)).all()
