import re

import numpy as np

from tabcord.llm import forest

from .conftest import ODD


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            inside.update(range(i, i + 8))
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        dup,
        len(inside),
    )


def test_counts_equal_plain_ones(docs):
    rows = [r.text for r in docs.where("n_chars < 4000").collect()] + [
        r[1] for r in ODD if r[0] != 7
    ]
    got = forest.rule_counts([t or "" for t in rows])[:, :5].tolist()
    assert [tuple(g) for g in got] == [plain_counts(t) for t in rows]


def test_repeated_words_of_a_loop():
    ids = np.array(list(range(10)) * 3 + [77])
    assert forest.repeated_words(ids) == 30
    assert forest.repeated_words(np.arange(50)) == 0
    assert forest.repeated_words(np.zeros(9, np.int64)) == 9
    assert forest.repeated_words(np.zeros(8, np.int64)) == 0


def plain_path(f, tree, row):
    node = 0
    while f.feature[tree, node] >= 0:
        node = 2 * node + 1 + int(row[f.feature[tree, node]] >= f.value[tree, node])
    return f.length[tree, node]


def test_scores_are_mean_paths():
    x = np.random.default_rng(1).normal(size=(200, 3))
    x[0] = 9
    f = forest.grow(x, 40, 64)
    scores = f.scores(x)
    for i in (0, 5, 77):
        mean = np.mean([plain_path(f, t, x[i]) for t in range(40)])
        assert abs(scores[i] - 2 ** (-mean / f.expected)) < 1e-12
    assert scores[0] == scores.max()


def test_threshold_spares_the_good():
    bins = [(10, 90, 1), (20, 9, 4), (30, 1, 95)]
    assert forest.threshold(bins, 0.01) == 30
    assert forest.threshold([(10, 90, 1), (20, 9, 50), (30, 1, 49)], 0.10) == 20
    assert forest.threshold([(10, 5, 0)], 0.01) > 2000


def test_verdicts(spark, sf, docs, odd, none):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in forest.verdicts(docs, labels).collect()}
    assert len(got) == docs.count()
    for r in got.values():
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)
    known = {r.doc_id: r.quality for r in labels.collect()}
    good = [d for d, q in known.items() if q == 1 and d in got and not got[d].base_failed]
    assert sum(got[d].kept for d in good) >= 0.97 * len(good)
    for frame in (odd, odd.select("doc_id", "text")):
        rows = forest.verdicts(frame, labels.limit(0)).collect()
        assert len(rows) == len(ODD)
        assert not any(r.kept for r in rows if r.doc_id in (1, 2, 3, 4, 7))
    assert forest.verdicts(none, labels).count() == 0
