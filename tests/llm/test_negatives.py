"""Operator 12: exact scores from residues; mined rows against plain Python."""

import numpy as np
import pytest

from chatlens.llm import negatives as N


def brute(rows, positives=5, negatives=5):
    """rows: (vec_id, label, v) after labelling; anchors are asked once, with their smallest row."""
    found = set()
    asked = {}
    for vec_id, label, v in rows:
        if vec_id % 100 == 0:
            asked[vec_id] = min(asked.get(vec_id, (label, v)), (label, v))
    for anchor, (label, v) in asked.items():
        scored = [(-sum(int(x) * int(y) for x, y in zip(v, w)), i, one) for i, one, w in rows if i != anchor]
        best = sorted((s, i) for s, i, one in scored if one == label)[:positives]
        for order, (score, positive) in enumerate(best, 1):
            inside = sorted((s, i) for s, i, one in scored if one != label and 80 * -score <= 100 * -s <= 100 * -score)
            for rank, (s, i) in enumerate(inside[:negatives], 1):
                found.add((anchor, positive, rank, i, -score, -s, order))
    return found


def test_residues_give_the_exact_product():
    rng = np.random.default_rng(3)
    for width, size in ((1, 10), (64, 300), (700, 10**6), (20, 3 * 10**8)):
        a, b = (rng.integers(-size, size, (n, width)).astype(float) for n in (7, 9))
        bound = int(np.sqrt((a**2).sum(1).max() * (b**2).sum(1).max())) + 1
        want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
        assert N.exact_scores(a, b, N.primes_for(bound)).tolist() == want


def test_the_extremes_of_the_range_come_back():
    primes = N.primes_for(10**6)
    product = int(np.prod([int(p) for p in primes], dtype=object))
    values = np.array([0, 1, -1, 10**6, -(10**6), (product - 1) // 2, -(product - 1) // 2])
    assert N.reconstruct([(values % p)[None, :] for p in primes], primes)[0].tolist() == values.tolist()


def test_sums_of_a_run_stay_exact_in_float32():
    assert (N.primes_for(1)[0] // 2) ** 2 * N.RUN < 2**24


SCHEMA = "vec_id long, embedding array<float>, label int, rank int"


@pytest.mark.parametrize("cells", [N.BLOCK_CELLS, 8 * 13])
def test_mined_rows_equal_plain_python(spark, cells):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(6, 8))
    rows = []
    for i in range(400):
        v = base[rng.integers(6)] + rng.normal(size=8) * 0.3
        # A label with a third of all rows, ties by rounding, repeated rows and ids.
        rows.append((int(i), [float(np.float32(round(x, 1))) for x in v], 3 if i % 3 == 0 else int(rng.integers(10)), 1))
    rows += [rows[100], rows[100], rows[7], (200, rows[8][1], 5, 1)]
    rows += [(1000, None, 1, 1), (1100, [1.0, None], 1, 1), (1200, [float("nan")] * 8, 1, 1), (None, [1.0] * 8, 1, 1), (1300, [1.0] * 8, None, 1)]
    vectors = N.labelled_vectors(spark.createDataFrame(rows, SCHEMA))
    got = N.hard_negatives(vectors, vectors.filter("vec_id % 100 = 0"), block_cells=cells)
    plain = [(r["vec_id"], r["label"], tuple(r["v"])) for r in vectors.collect()]
    assert len(plain) == 404
    listed = [tuple(r) for r in got.collect()]
    want = brute(plain)
    assert set(listed) == want and len(listed) >= len(want) > 50


def test_labels_turn_every_seventh(spark):
    rows = [(i, [0.5], i % 10, 0) for i in range(20)]
    got = {r["vec_id"]: (r["label"], r["v"]) for r in N.labelled_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[7] == (8, [128.0]) and got[8][0] == 8 and got[14][0] == 5 and got[0][0] == 1


def test_lone_and_empty_tables(spark):
    empty = N.labelled_vectors(spark.createDataFrame([], SCHEMA))
    assert N.hard_negatives(empty, empty).collect() == []
    lone = N.labelled_vectors(spark.createDataFrame([(100, [1.0, 2.0], 1, 0)], SCHEMA))
    assert N.hard_negatives(lone, lone).collect() == []


def test_scores_beyond_64_bits_are_refused(spark):
    huge = N.labelled_vectors(spark.createDataFrame([(100, [1e15], 1, 0), (1, [1e15], 1, 0)], SCHEMA))
    with pytest.raises(ValueError, match="64 bits"):
        N.hard_negatives(huge, huge)
