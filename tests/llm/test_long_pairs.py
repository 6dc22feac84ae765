"""Pairs of the long bands: every pair of different components that shares a band, once, however many bands it shares."""

import random
from itertools import combinations

from petrichor.llm import minhash


def test_every_pair_once(spark):
    rng = random.Random(3)
    none = [0] * (minhash.PIECES // 64)
    rows = [(i, rng.choice([0, 0, 0, 1, 2, i]), 100, none, rng.sample(range(-20, 20), 6)) for i in range(60)]
    rows += [(60, 60, 40, none, rows[0][4]), (61, 61, 100, [-1] * len(none), rows[0][4]), (62, 62, 100, none, [99])]  # size, signature, no band
    far = spark.createDataFrame(rows, "rep bigint, component bigint, n bigint, pieces array<bigint>, bands array<bigint>")
    got = [(r.a, r.b) for r in minhash._long_pairs(far, 80).collect()]
    want = {(y[0], x[0]) for x, y in combinations(rows[:60], 2) if x[1] != y[1] and set(x[4]) & set(y[4])}
    assert len(got) == len(set(got))
    assert set(got) == want
