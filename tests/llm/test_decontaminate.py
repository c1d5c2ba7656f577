import itertools
import re

import numpy as np

from tabcord.llm import decontaminate as dc


def words(text):
    return " " + " ".join(re.findall(r"[^\W_]+", (text or "").lower())) + " "


def test_whole_items_are_found_as_by_brute_force(spark, sf):
    where = sf.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{where}/documents.parquet")
    items = spark.read.parquet(f"{where}/benchmark.parquet")
    texts = {r.item_id: words(r.text) for r in items.collect()}
    want = {
        (r.doc_id, str(i)) for r in docs.collect() for i, t in texts.items() if t in words(r.text)
    }
    got = {(r.doc_id, r.item_id) for r in dc.overlaps(docs, items).collect()}
    assert want and want <= got
    assert {d for d, _ in got} == {d for d, _ in want}


def make(rng, n):
    return [f"w{rng.integers(0, 5000)}" for _ in range(n)]


def test_substitutions_are_tolerated_and_chance_is_not(spark):
    rng = np.random.default_rng(8)
    items = [make(rng, n) for n in (40, 30, 25, 18, 8, 3)]
    docs, want = [], set()
    for i, item in enumerate(items[:4]):
        for changes in (0, 2, 4):
            copy = list(item)
            for at in rng.choice(len(item), changes if len(item) > 20 else changes // 2, False):
                copy[at] = "changed"
            docs.append(" ".join(make(rng, 60) + copy + make(rng, 50)))
            want.add((len(docs) - 1, str(i)))
    docs.append(" ".join(make(rng, 30) + items[4] + make(rng, 30)))  # short item, whole
    want.add((len(docs) - 1, "4"))
    docs.append(" ".join(make(rng, 30) + items[5] + make(rng, 30)))  # three words, whole
    want.add((len(docs) - 1, "5"))
    docs.append(" ".join(make(rng, 30) + items[5][:2] + make(rng, 30)))  # but not two of them
    docs.append(" ".join(make(rng, 30) + items[0][:9] + make(rng, 30)))  # too small a part
    docs.append(" ".join(make(rng, 30) + items[0][10:30]))  # a long part
    want.add((len(docs) - 1, "0"))
    docs += [" ".join(make(rng, 200)) for _ in range(10)]
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(
        [(i, " ".join(t).upper()) for i, t in enumerate(items)], "item_id long, text string"
    )
    got = dc.overlaps(table, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    whole = next(r for r in got if r.doc_id == 0)
    assert (whole.first_word, whole.end_word, whole.n_equal) == (60, 100, 40)
    left = dc.clean(table, bench).collect()
    assert {r.doc_id for r in left} == set(range(len(docs))) - {d for d, _ in want}


def test_best_segment():
    equal = np.array([1, 0, 0, 0, 1, 1, 1, 1, 0, 1, 1, 1, 1, 0, 0], bool)
    assert dc.best_segment(equal) == (8, 4, 13)


def test_every_placement_of_substitutions_is_accepted():
    rng = np.random.default_rng(1)
    for n in range(5, 26):
        need = min(13, -(-n * 4 // 5))
        changes = min(n // 5, n - need)
        places = itertools.combinations(range(n), changes)
        if n > 20:
            places = (rng.choice(n, changes, False) for _ in range(500))
        for place in places:
            equal = np.ones(n, bool)
            equal[list(place)] = False
            found, a, b = dc.copied_segment(equal, need, 0.8)
            assert found == equal[a:b].sum() >= max(need, 0.8 * (b - a))


def test_a_segment_is_accepted_as_by_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(400):
        n = int(rng.integers(1, 40))
        equal = rng.random(n) < rng.choice([0.3, 0.7, 0.8])
        want = any(
            equal[a:b].sum() >= max(13, 0.8 * (b - a) - 1e-9)
            for a, b in itertools.combinations(range(n + 1), 2)
        )
        assert (dc.copied_segment(equal, 13, 0.8) is not None) == want


def test_masks_spare_a_window_for_every_placement():
    for n in range(5, 26):
        changes = min(n // 5, n - min(13, -(-n * 4 // 5)))
        left = np.array([sum(1 << p for p in c) for c in itertools.combinations(range(n), changes)])
        for mask in dc.masks_of(n):
            window = int(mask[::-1], 2)
            for at in range(n - len(mask) + 1):
                left = left[left & (window << at) != 0]
        assert not len(left), n


def test_short_items_with_a_substitution_are_found_whatever_the_other_items(spark):
    rng = np.random.default_rng(4)
    items = [make(rng, n) for n in (5, 8, 11, 12)]
    docs, want = [], set()
    for i, item in enumerate(items):
        for at in range(len(item)):
            copy = [*item[:at], "changed", *item[at + 1 :]]
            want.add((len(docs), str(i)))
            docs.append(" ".join(make(rng, 20) + copy + make(rng, 20)))
    letters = [chr(0x4E00 + c) for c in rng.integers(0, 5000, 60)]
    want.add((len(docs), "4"))
    docs.append("".join([*letters[:29], "x", *letters[30:]]))
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    rows = [(i, " ".join(t)) for i, t in enumerate(items)] + [(4, "".join(letters[20:40]))]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dc.overlaps(table, bench).collect()} == want
    alone = dc.overlaps(table, bench.where("item_id = 2")).collect()
    assert {(r.doc_id, r.item_id) for r in alone} == {w for w in want if w[1] == "2"}


def test_odd_tables(spark, odd, none):
    text = "a text whose id is null and has some more words in it"
    bench = spark.createDataFrame(
        [(1, text), (None, "Hello, world! It's 42 naïve été endoftext x"), (2, None), (2, ""), (3, "one")],
        "item_id long, text string",
    )
    got = dc.contaminated(odd, bench).collect()
    assert {r.doc_id for r in got} == {None, 4, 5}
    longer = dc.contaminated(odd, bench, min_words=5).collect()
    assert {r.doc_id for r in longer} == {None, 5}
    kept = dc.clean(odd, bench)
    assert kept.columns == odd.columns
    assert kept.count() == odd.count() - 4
    assert dc.clean(odd, bench.limit(0)).count() == odd.count()
    assert dc.clean(none, bench).count() == 0


def test_equal_items_are_verified_once_and_reported_each(spark, monkeypatch):
    rng = np.random.default_rng(6)
    item = make(rng, 20)
    docs = [(i, " ".join(make(rng, 10) + item + make(rng, 10))) for i in range(30)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(item)) for i in range(40)], "item_id long, text string")
    verified = []
    plain = dc.verify
    monkeypatch.setattr(
        dc, "verify", lambda pairs, *a: verified.append(pairs.count()) or plain(pairs, *a)
    )
    got = dc.overlaps(table, bench).collect()
    assert len({(r.doc_id, r.item_id) for r in got}) == len(got) == 1200
    assert verified == [30]


def test_the_prefilter_follows_the_benchmark():
    assert dc.address_bits(0) == dc.address_bits(10**6) == 25
    assert dc.address_bits(30_000_000) == 28 and dc.address_bits(10**10) == 29


def test_clashing_columns_of_the_benchmark(odd, frame):
    text = "a text whose id is null and has some more words in it"
    bench = frame("item_id long, text string, codes string, doc_id long", (1, text, "x", 5))
    assert [r.doc_id for r in dc.contaminated(odd, bench).collect()] == [None]
