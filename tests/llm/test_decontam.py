"""Decontamination against every window of every document."""

import random
from collections import Counter

from plenum.llm.decontam import contaminated, without_contaminated

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def shingles(words, k=5):
    return Counter(tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))) if words else Counter()


def brute(docs, items):
    best = {}
    for d, text in docs:
        words = (text or "").lower().split()
        for item, passage in items:
            own = (passage or "").lower().split()
            if d is None or item is None or not own:
                continue
            theirs = shingles(own)
            for start in range(max(len(words) - len(own) + 1, 1)):
                window = shingles(words[start : start + len(own)])
                both, whole = sum((window & theirs).values()), sum((window | theirs).values())
                if both and 5 * both >= 4 * whole:
                    best[d, item] = max(best.get((d, item), (0, 0, 0)), (both / whole, -start, len(own)))
    return sorted((d, i, -start, n, round(s, 9)) for (d, i), (s, start, n) in best.items())


def test_against_all_windows(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(rng.randint(15, 60)))) for i in range(12)] + [(20, None), (21, ""), (22, "three short words"), (None, "no id here at all"), (23, "tick tock " * 10)]
    docs = [(900, None), (901, ""), (902, "THREE  short\twords"), (903, items[0][1].upper()), (904, "tick tock " * 12), (905, "w " * 100_000), (None, items[1][1])]
    for d in range(60):
        own = items[d % 12][1].split()
        for _ in range(d % 4):
            own[rng.choice([0, 1, len(own) - 1, rng.randrange(len(own))])] = word()
        before, after = ([word() for _ in range(rng.randrange(40))] for _ in range(2))
        docs.append((d, " ".join([*before, *own[: rng.choice([len(own), len(own), 8])], *after])))
    docs.append(docs[-1])
    table = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], DOCS + ", n int, start int")
    got = contaminated(table, spark.createDataFrame(items, ITEMS))
    want = brute(docs, items)
    assert sorted((r.doc_id, r.item_id, r.start, r.n_words, round(r.similarity, 9)) for r in got.collect()) == want
    kept = without_contaminated(table, spark.createDataFrame(items, ITEMS))
    assert kept.columns == table.columns
    leaked = {d for d, *_ in want}
    assert sorted((str(r.doc_id) for r in kept.collect())) == sorted(str(d) for d, _ in docs if d not in leaked)


def test_recall_just_over_the_limit(spark):
    """Pairs of similarity 0.80 to 0.85: at least nine of ten are found, and those of the next rows not at all."""
    rng, items, docs = random.Random(8), [], []
    for i in range(150):
        own = [f"t{rng.randrange(5000)}" for _ in range(60)]
        items.append((i, " ".join(own)))
        edited = list(own)
        for at in rng.sample(range(60), 1 + i % 3):
            edited[at] = f"e{i}"
        docs.append((i, " ".join([*[f"b{rng.randrange(5000)}" for _ in range(30)], *edited, *[f"a{rng.randrange(5000)}" for _ in range(30)]])))
    want = [w for d, i in zip(docs, items) for w in brute([d], [i])]  # other items have other words
    got = contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    got = {(r.doc_id, r.item_id, r.start, r.n_words, round(r.similarity, 9)) for r in got}
    near = [w for w in want if w[4] < 0.85]
    assert len(near) > 30 and len(got & set(near)) >= 0.9 * len(near) and got <= set(want)


def test_many_items_alike(spark):
    """Items and windows of one size that share most of their shingles."""
    rng = random.Random(9)
    common = [f"c{i}" for i in range(40)]
    items = [(i, " ".join([*common[:35], *[f"i{i}w{j}" for j in range(5 * (i % 3))], *common[35:]])) for i in range(30)]
    docs = [(i, " ".join([*[f"r{rng.randrange(900)}" for _ in range(20)], *items[i][1].split(), "end"])) for i in range(30)]
    got = contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted((r.doc_id, r.item_id, r.start, r.n_words, round(r.similarity, 9)) for r in got) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c d e f g")], DOCS), spark.createDataFrame([(1, "a b c d e f g")], ITEMS)
    assert contaminated(docs.limit(0), items).count() == 0 and contaminated(docs, items.limit(0)).count() == 0
    assert without_contaminated(docs, items.limit(0)).count() == 1 and contaminated(docs, items).count() == 1


def test_reordered_parts_have_no_aligned_window(spark):
    first, second = ([f"{c}{i}" for i in range(30)] for c in "pq")
    noise = [f"n{i}" for i in range(200)]
    docs = [(1, " ".join([*noise[:100], *second, *first, *noise[100:]])), (2, " ".join([*second[:10], *noise])), (3, " ".join([*second, *first]))]
    items = [(1, " ".join([*first, *second]))]
    table, known = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    got = contaminated(table, known).collect()
    assert sorted((r.doc_id, r.item_id, r.start, r.n_words, round(r.similarity, 9)) for r in got) == brute(docs, items)
    assert {(r.doc_id, r.start) for r in got} == {(1, 100), (3, 0)}
    assert [r.doc_id for r in without_contaminated(table, known).collect()] == [2]
