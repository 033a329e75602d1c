"""Groups of similar proposals against all pairs, and components against a plain search."""

import random

import numpy as np
import pytest
from tallyforge.operators import similar
from tallyforge.operators.graph import components


def plain_groups(links, nodes):
    near = {n: set() for n in nodes}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    found = {}
    for start in sorted(nodes):
        open_ = [start]
        while open_:
            n = open_.pop()
            if n not in found:
                found[n] = start
                open_ += near[n]
    return found


def test_components_of_paths_stars_and_random_links(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 140)] + [(900, n) for n in range(200, 260)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    links += [(5, 5), (7, 8), (8, 7), (7, 8)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame([*links, (None, 3), (3, None)], "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a != b]
    assert got == plain_groups(real, {n for e in real for n in e})
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def of_all_pairs(vectors, threshold):
    ids = list(vectors)
    unit = np.array([vectors[i] / np.linalg.norm(vectors[i]) for i in ids])
    near = np.argwhere(np.triu(unit @ unit.T >= threshold, 1))
    return plain_groups([(ids[a], ids[b]) for a, b in near], ids), len(near)


def groups(spark, vectors, **named):
    rows = [(int(i), [float(x) for x in v]) for i, v in vectors.items()]
    return {r["id"]: r["group_id"] for r in similar.similar_groups(spark.createDataFrame(rows, "id long, vector array<double>"), **named).collect()}


@pytest.mark.parametrize("threshold", [0.9, 0.97])
def test_groups_equal_those_of_all_pairs(spark, threshold):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((60, 24))
    vectors = {i: centres[i % 60] * rng.uniform(0.5, 3) + rng.standard_normal(24) * rng.uniform(0.1, 0.5) for i in range(500)}
    want, links = of_all_pairs(vectors, threshold)
    assert links > 100 and groups(spark, vectors, threshold=threshold) == want


def test_a_third_of_all_rows_in_one_group_with_hubs_and_blocks(spark, monkeypatch):
    """A dense group whose ends are not linked directly, many copies, and every key that several rows share spread out."""
    monkeypatch.setattr(similar, "HUB", 5)
    monkeypatch.setattr(similar, "MAX_HUBS", 1000)
    monkeypatch.setattr(similar, "BLOCK", 7)
    rng = np.random.default_rng(4)
    turn = np.linspace(0, 0.9, 120)
    vectors = {2 * i: np.array([np.cos(a), np.sin(a), 0, 0, 0, 0]) for i, a in enumerate(rng.permutation(turn))}
    vectors |= {2 * i + 1: rng.standard_normal(6) for i in range(100)}
    vectors |= {1000 + i: np.array([0, 0, 0, 0, 1.0, 1.0]) for i in range(90)}
    want, _ = of_all_pairs(vectors, 0.999)
    got = groups(spark, vectors, threshold=0.999, bits=4)
    assert got == want and sum(g == 1000 for g in got.values()) >= 90 and sum(g == 0 for g in got.values()) >= 120


def test_links_between_groups_of_a_bucket_are_found(spark):
    """Of four in a bucket the smallest is linked with one; the other two are linked with each other and with that one."""
    at = lambda degrees: np.array([np.cos(np.radians(degrees)), np.sin(np.radians(degrees))])
    vectors = {1: at(10), 2: at(18), 3: at(26), 4: at(34)}
    assert groups(spark, vectors, threshold=float(np.cos(np.radians(8.5))), bits=1) == {1: 1, 2: 1, 3: 1, 4: 1}
    assert groups(spark, vectors, threshold=float(np.cos(np.radians(7.5))), bits=1) == {1: 1, 2: 2, 3: 3, 4: 4}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, -0.0]), (3, [0.0, 0.0]), (4, [-0.0, 0.0]), (5, None), (6, []), (7, [1.0, None]), (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [1.0, 0.0, 0.0]), (11, [5.0, 0.0, 0.0]), (None, [1.0, 0.0]), (12, None), (12, [3.0, 0.0]), (13, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = {r["id"]: (r["group_id"], r["kept"]) for r in similar.similar_groups(df).collect()}
    assert got == {i: (i, True) for i in range(1, 14)} | {2: (1, False), 11: (10, False), 12: (1, False)}
    assert similar.similar_groups(df.limit(0)).collect() == [] and similar.similar_groups(df.filter("id in (3, 5)")).count() == 2


def test_bands_keep_the_promised_chance():
    for threshold in (0.8, 0.9, 0.99):
        for bits in (8, 16, 30):
            same = 1 - np.arccos(threshold) / np.pi
            bands = similar.bands_for(threshold, bits, 1e-3)
            assert (1 - same**bits) ** bands <= 1e-3 < (1 - same**bits) ** (bands - 1)
    with pytest.raises(ValueError):
        similar.bands_for(1.0, 8)


def test_keys_have_spare_bits_and_known_sizes_are_not_counted_again(spark, monkeypatch):
    taken = []
    keys = similar._keys
    monkeypatch.setattr(similar, "_keys", lambda bits, bands, seed: taken.append((bits, bands)) or keys(bits, bands, seed))
    vectors = spark.createDataFrame([(i, [float(i % 37 + 1), float(i % 11), float(i % 5)]) for i in range(1024)], "id long, vector array<double>")
    similar.similar_groups(vectors)
    assert taken == [(10 + similar.SPARE_BITS, similar.bands_for(0.95, 10 + similar.SPARE_BITS))]
    rows, other = vectors.selectExpr("id % 9 AS k", "id"), spark.range(9).selectExpr("id AS k", "id * 2 AS twice")
    sizes = rows.groupBy("k").agg({"*": "count"}).toDF("k", "n")
    assert sorted(similar._joined(rows, other, "k", sizes=sizes).collect()) == sorted(similar._joined(rows, other, "k").collect())
