"""Pairs with hubs: each pair of classes once, and no link lost."""

import random

from resultmart.llm.near_dup import _hub_pairs, near_duplicates


def test_mutual_hubs_make_one_pair(spark):
    spot = lambda place, n=10: place << 32 | n
    # 1 and 2 are each other's hub, 3 has the hub 1; rows of the hub itself and of sets that are too short don't count
    rows = [(7, spot(0), 1, spot(0), 1), (7, spot(1), 2, spot(0), 1), (8, spot(1), 1, spot(0), 2), (8, spot(0), 2, spot(0), 2), (7, spot(0), 3, spot(0), 1), (9, spot(0, 2), 4, spot(0), 1)]
    found = _hub_pairs(spark.createDataFrame(rows, "token long, spot long, cid long, hub_spot long, hub long"), 80).collect()
    assert sorted((r.a, r.b, r.p, r.q) for r in found) == [(1, 2, spot(1), spot(0)), (3, 1, spot(0), spot(0))]


def test_no_lists_make_no_pairs(spark):
    assert _hub_pairs(spark.createDataFrame([], "token long, spot long, cid long, hub_spot long, hub long"), 80).count() == 0


def test_pairs_that_meet_before_their_hub(spark):
    """Classes share rare shingles in lists of other hubs; pairs at the threshold are linked all the same."""
    rng, sets = random.Random(0), []
    for f in range(400):
        n = rng.choice([5, 6, 8, 9, 10, 12, 15, 18, 20, 27, 30])
        pool = [f"f{f}w{i}" for i in range(n + rng.choice([2, 3, 4, 5]))]
        sets += [(f, set(rng.sample(pool, min(len(pool), n + rng.randint(-1, 1))))) for _ in range(5)]
    reached = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i - i % 5, i):
            a, b = sets[i][1], sets[j][1]
            if 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((reached[i], reached[j]))
                reached = [low if x == high else x for x in reached] if low != high else reached
    rows = [(i, " ".join(sorted(x))) for i, (_, x) in enumerate(sets)]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=1).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in found} == {(i, len(x), reached[i]) for i, (_, x) in enumerate(sets)}
