import random

from statuta.llm.near_dup import banding, keep_one, near_dup_groups, sketches
from statuta.llm.words import shingle_set


def groups_by_brute_force(rows, pct):
    sets = {i: frozenset(shingle_set(t).tolist()) for i, t in rows}
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= pct * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_groups_around_the_threshold(docs_of):
    rng, rows = random.Random(5), []
    for _ in range(3):
        base = [f"w{rng.randrange(900)}" for _ in range(100)]
        for _ in range(40):
            words = list(base)
            for _ in range(rng.randrange(5)):
                words[rng.randrange(100)] = f"z{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "a b"), (904, "A \t b"), (905, "long " * 30_000)]
    rng.shuffle(rows)
    got = near_dup_groups(docs_of(rows), threshold_pct=85).collect()
    expected = groups_by_brute_force(rows, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_nulls_repeats_and_empty(docs_of):
    got = near_dup_groups(docs_of([(None, "a b c"), (7, "a b c"), (7, "a b c"), (3, "x")])).collect()
    assert sorted((r.doc_id is None, r.component_id, r.kept) for r in got if r.doc_id != 3) == [(False, 7, True), (False, 7, True), (True, None, True)]
    assert near_dup_groups(docs_of([])).count() == 0
    kept = keep_one(docs_of([(1, "one two three"), (2, "one two three"), (None, "one two three")]))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1] and "n_words" in kept.columns


def test_texts_under_one_id_are_one_document(docs_of, spark):
    one, two = "a b c d e f g", "p q r s t u v"
    got = near_dup_groups(docs_of([(5, one), (5, two), (5, ""), (3, one), (9, two), (9, two), (7, "x")])).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got if r.n_shingles} == {(5, 3, False), (3, 3, True), (9, 3, False), (7, 7, True)} and len(got) == 7
    assert [(r.component_id, r.kept) for r in got if not r.n_shingles] == [(5, True)]
    docs = spark.createDataFrame([(1, one, "g", "h"), (2, one, "g", "h"), (4, two, None, None)], "doc_id long, text string, gone string, _gone string")
    kept = keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4]


def test_components_of_a_hub_and_a_chain(spark, tmp_path):
    from statuta.llm.components import connected_components
    from statuta.llm.shared import Scratch

    edges = [(0, k) for k in range(1, 2000)] + [(k, k + 1) for k in range(3000, 3060)] + [(5000, 5000), (None, 1), (3000, 3001)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"), "cc").collect()}
    assert got == {k: 0 for k in range(2000)} | {k: 3000 for k in range(3000, 3061)}


def test_sketch_fills_and_estimates():
    a, b = shingle_set(" ".join(map(str, range(2000)))), shingle_set(" ".join(map(str, range(500, 2500))))
    tiny = shingle_set("one")
    made = sketches([a, b, tiny], 512)
    assert (made < 2**64 - 1).all()
    true = len(set(a) & set(b)) / len(set(a) | set(b))
    assert abs((made[0] == made[1]).mean() - true) < 0.1
    bands, rows = banding(85)
    assert (1 - 0.85**rows) ** bands <= 1e-6
