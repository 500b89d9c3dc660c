"""SimHash: fingerprints bit by bit, and components against all pairs."""

import random

import xxhash

from plenum.llm.components import connected_components
from plenum.llm.simhash import fingerprint, keep_first, near_duplicates, similar_texts

SCHEMA = "doc_id long, text string"


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(docs, radius=3):
    fps = [fingerprint(t) for _, t in docs]
    part = list(range(len(docs)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                part[max(a, b)] = min(a, b)
    ids = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            ids[find(i)] = min(ids.get(find(i), d), d)
    return sorted([(d, f"{fps[i]:016x}", ids.get(find(i))) for i, (d, _) in enumerate(docs)], key=repr)


def corpus():
    rng = random.Random(3)
    base = [[f"w{rng.randrange(400)}" for _ in range(300)] for _ in range(12)]
    docs = [(None, None), (None, "only words of a row without id"), (900, ""), (901, None), (902, "  \t "), (903, "One"), (904, "one"), (905, "x " * 70_000)]
    for n in range(60):
        words = list(base[n % 12])
        for _ in range(rng.randrange(3)):
            words[rng.randrange(300)] = f"w{rng.randrange(400)}"
        docs.append((n, " ".join(words)))
    return docs + docs[-3:]


def test_fingerprint_bits():
    for _, text in corpus():
        assert fingerprint(text) == slow_fingerprint(text)
    assert fingerprint("É a b") != fingerprint("é a b") and fingerprint("A b C") == fingerprint("a B c")


def test_components_against_all_pairs(spark):
    docs = corpus()
    got = sorted([tuple(r) for r in near_duplicates(spark.createDataFrame(docs, SCHEMA)).collect()], key=repr)
    assert got == brute(docs)


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def similarity(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def similar_groups(docs):
    """The smallest id of the group of each (id, text), by all pairs."""
    rows = sorted({(d, t or "") for d, t in docs if d is not None})
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if similarity(rows[i][1], rows[j][1]) >= 0.8:
                old, new = sorted([group[i], group[j]])[::-1]
                group = [new if g == old else g for g in group]
    return {row: rows[g][0] for row, g in zip(rows, group)}


def edited(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"n{rng.randrange(10**6)}"
    return " ".join(words)


def test_keep_first_keeps_one_of_each_group(spark):
    docs = corpus() + [(7, "another text of document seven, unlike its first one")]
    odd = spark.createDataFrame([(d, t, 1, "x", "y", "z") for d, t in docs], "doc_id long, text string, fp int, root string, kept_id string, digest string")
    kept = keep_first(odd)
    assert kept.columns == odd.columns
    ids = sorted(r.doc_id for r in kept.where("doc_id is not null").collect())
    assert ids == sorted([*set(similar_groups(docs).values()), 7]) and kept.where("doc_id is null").count() == 2


def test_similar_texts_against_all_pairs(spark):
    rng = random.Random(11)
    base = [[f"v{rng.randrange(5000)}" for _ in range(rng.randint(40, 400))] for _ in range(25)]
    texts = [" ".join(base[i % 25]) if i < 50 else edited(rng, base[i % 25], rng.choice([1, 2, 3, 12])) for i in range(150)]
    texts += [" ".join(b) + " " + " ".join(f"t{rng.randrange(5000)}" for _ in range(len(b) // 12)) for b in base]
    docs = list(enumerate(texts))
    found = spark.createDataFrame(docs, SCHEMA)
    rows = similar_texts(found).collect()
    tops = {}
    for r in rows:
        tops[r["root"]] = min(tops.get(r["root"], r["first"]), r["first"])
    got = {(r["first"], texts[r["first"]]): tops[r["root"]] for r in rows}
    want = similar_groups(docs)
    assert got == {k: want[k] for k in got} and len(got) == len(set(texts))


def test_pairs_just_over_the_limit_meet(spark):
    rng, docs, pairs = random.Random(12), [], []
    while len(pairs) < 120:
        words = [f"v{rng.randrange(9000)}" for _ in range(250)]
        a, b = " ".join(words), edited(rng, words, rng.randint(3, 6))
        if 0.8 <= similarity(a, b) < 0.85:
            pairs.append((2 * len(pairs), 2 * len(pairs) + 1))
            docs += [(pairs[-1][0], a), (pairs[-1][1], b)]
    kept = {r.doc_id for r in keep_first(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert sum(b not in kept for _, b in pairs) >= 0.9 * len(pairs) and kept >= {a for a, _ in pairs}


def test_dense_group_of_one_half(spark):
    """Texts whose fingerprints are all within three bits of each other come out as one component, without all their pairs."""
    base = 0x0123456789ABCDEF
    prints = [base ^ (1 << i) ^ (1 << j) for i in range(32, 44) for j in range(i)][:300]
    from plenum.llm.simhash import components, hamming_links, _contracted, _pivot_links

    nodes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long").distinct()
    rooted = nodes.selectExpr("fp", "fp AS root")
    assert _contracted(rooted, _pivot_links(rooted, 3, 0), "fp").select("root").distinct().count() < 20 < hamming_links(rooted, 3).count()
    got = {r.fp: r.root for r in components(nodes).collect()}
    part = {p: p for p in got}
    for a in got:
        for b in got:
            if (a ^ b).bit_count() <= 3:
                low, high = sorted([part[a], part[b]])
                part = {k: low if v == high else v for k, v in part.items()}
    assert got == part


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(empty).count() == 0 and keep_first(empty).count() == 0


def test_long_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(5, 5), (205, 200)]
    got = {tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {(i, 0) for i in range(61)} | {(100 + i, 100) for i in range(80)} | {(200, 200), (205, 200)}
    assert got == want
