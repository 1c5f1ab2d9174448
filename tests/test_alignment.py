import random

import numpy as np
import pytest

from statuta.operators import alignment as A, tiled_alignment as T

SCHEMA = "document_id string, item_id string, item_order int, match_key string"


def _lists(rng, n):
    """A list of statements and a reference list made of it: parts joined, split, dropped, changed and added."""
    words = "plan norma zona medida fuente plazo control aire agua suelo ley y de la".split()
    keys = [" ".join(rng.choices(words, k=rng.randrange(0, 9))) for _ in range(n)]
    out, k = [], 0
    while k < len(keys):
        r, own = rng.random(), keys[k].split()
        if r < 0.2 and k + 1 < len(keys):
            out.append(" ".join(keys[k : k + 2]))
            k += 1
        elif r < 0.35:
            out += [" ".join(own[: len(own) // 2]), " ".join(own[len(own) // 2 :])]
        elif r < 0.5:
            out.append(" ".join(rng.choices(words, k=4)))
        elif r < 0.9:
            out.append(keys[k])
        k += 1
    return keys, out


@pytest.mark.parametrize("tile", [2, 5, 32])
def test_tiles_give_the_blocks_of_the_full_programme(monkeypatch, tile):
    """Without Spark: tiles by hand, any size."""
    monkeypatch.setattr(T, "TILE", tile)
    rng = random.Random(tile)
    for _ in range(12):
        a, b = _lists(rng, rng.randrange(1, 14))
        programme = T.Programme(len(a), len(b), A.BLOCK_PENALTY)
        for i in range(len(a)):
            similar = np.full((A.MAX_CANDIDATES, A.MAX_REFERENCES, len(b)), -1.0)
            ti = i // tile
            low = max(0, ti * tile - A.MAX_CANDIDATES + 1)
            for tj in range(-(-len(b) // tile)):
                start = max(0, tj * tile - A.MAX_REFERENCES + 1)
                made = T.tile_similarities(a[low : (ti + 1) * tile], b[start : (tj + 1) * tile], (ti * tile - low, tj * tile - start))
                similar[:, :, tj * tile : tj * tile + made.shape[3]] = made[:, :, i - ti * tile]
            programme.add(similar)
        got = [(list(range(w, x)), list(range(y, z)), s) for w, x, y, z, s in programme.blocks()]
        assert got == A.align_texts(a, b)


def test_documents_are_aligned_as_by_the_full_programme(spark):
    rng = random.Random(11)
    lists = {f"D{k}": _lists(rng, n) for k, n in enumerate([1, 3, 20, 40, 75])} | {"only": (["a b", ""], []), "none": ([], ["x y z"])}
    rows = [[(d, f"{'cr'[side]}{k}", k, key or None) for d, both in lists.items() for k, key in enumerate(both[side])] for side in (0, 1)]
    made = T.align(*(spark.createDataFrame(r, SCHEMA) for r in rows)).collect()
    got = {d: [(r.candidate_ids, r.reference_ids, r.similarity, r.relationship) for r in sorted(made, key=lambda r: r.block) if r.document_id == d] for d in lists}
    for d, (a, b) in lists.items():
        want = [([f"c{i}" for i in p], [f"r{j}" for j in q], s, A.relationship(len(p), len(q), s)) for p, q, s in A.align_texts(a, b)]
        assert got[d] == want, d


def test_a_long_document_is_many_tiles(spark):
    n = 400
    keys = [f"palabra{k} norma{k % 7} plazo{k % 11} medida" for k in range(n)]
    left = spark.createDataFrame([("D", f"{k:04d}", k, key) for k, key in enumerate(keys)], SCHEMA)
    right = left.filter("item_order % 10 <> 3")
    made = T.align(left, right).collect()
    assert sum(r.relationship == "exact" for r in made) >= 0.7 * n
    assert sorted(x for r in made for x in r.candidate_ids) == [f"{k:04d}" for k in range(n)]
