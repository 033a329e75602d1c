"""Deduplication, fingerprints, lines and licences against brute force; defined results for odd rows."""

import hashlib
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tallyforge.llm import components, exact_dedup, fingerprints, fuse_filter, license_scan, line_dedup, near_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, keep_id long, kept string"


def corpus(seed=3):
    """Texts with exact and near copies, repeated and slightly changed lines, licences, and odd rows."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = [line(n) for n in (1, 2, 4, 8, 20, 40)]
    texts = []
    for i in range(120):
        lines = [line(rng.randint(1, 30)) for _ in range(rng.randint(1, 6))]
        lines += rng.sample(shared, rng.randint(0, 2))
        if i % 9 == 0:
            words = shared[5].split()
            words[rng.randrange(40)] = "changed"
            lines.append(" ".join(words))
        if i % 11 == 0:
            lines.append(rng.choice(list(license_scan.TEMPLATES.values())))
        texts.append("\n".join(lines))
    for i in range(40):
        words = texts[i].split(" ")
        words[rng.randrange(len(words))] = "edit"
        texts.append(" ".join(words) if i % 2 else texts[i].upper())
    texts += [None, "", "", " \n\t", "one", "ONE", "éÀ é", "ÉÀ é", "x " * 30000, "a\nb\na\n\n"]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 - 30, t, None, None) for i, t in corpus()]
    return spark.createDataFrame([*rows, rows[5], (None, "one", None, None)], SCHEMA).repartition(5)


def texts_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def test_exact_groups(docs):
    groups = defaultdict(list)
    for i, t in texts_of(docs):
        groups[t.translate(LOWER)].append(i)
    rows = exact_dedup.groups_of(docs).collect()
    assert len(rows) == sum(map(len, groups.values()))
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in rows:
        ids = by_sha[r["text_sha256"]]
        best = max((i for i in ids if i is not None), default=None)
        assert r["keep_id"] == best and r["group_size"] == len(ids) and r["kept"] == (r["doc_id"] == best)
    assert exact_dedup.keep(docs).count() == len(groups)
    assert exact_dedup.keep(docs).columns == docs.columns


def test_equal_digests_of_different_texts_are_told_apart(docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "digest", lambda text: F.lit("same"))
    rows = exact_dedup.groups_of(docs).collect()
    groups = defaultdict(set)
    for i, t in texts_of(docs):
        groups[t.translate(LOWER)].add(i)
    want = {i: max(x for x in ids if x is not None) for ids in groups.values() for i in ids if i is not None}
    assert {r["doc_id"]: r["keep_id"] for r in rows if r["doc_id"] is not None} == want


def test_fuse_filter_has_no_false_negatives_and_few_false_positives():
    keys = np.random.default_rng(1).integers(0, 2**63, 40000, dtype=np.uint64)
    made = fuse_filter.build(keys[:20000])
    assert made.may_contain(keys[:20000]).all()
    assert made.may_contain(keys[20000:]).mean() < 0.01
    assert not fuse_filter.build(keys[:0]).may_contain(keys[:5]).any()
    for n in range(1, 12):
        assert fuse_filter.build(keys[:n]).may_contain(keys[:n]).all()


def shingles(text):
    words = WORDS.findall(text.translate(LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def smallest_reachable(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("block", [4, 512])
def test_near_duplicates_equal_brute_force(docs, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    sets = {i: shingles(t) for i, t in texts_of(docs) if i is not None}
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = smallest_reachable(sets, edges)
    rows = [r for r in near_dedup.groups_of(docs).collect() if r["doc_id"] is not None]
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (r["doc_id"] == want[r["doc_id"]]) for r in rows)


def test_near_duplicates_from_80_percent(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:30], "edit", *words[31:]])), (3, " ".join(words[::-1]))]
    sets = [shingles(t) for _, t in rows]
    assert 80 * len(sets[0] | sets[1]) <= 100 * len(sets[0] & sets[1]) < 85 * len(sets[0] | sets[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in near_dedup.keep(docs).collect()} == {1, 3}
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.groups_of(docs, percent=80).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.groups_of(docs).collect()} == {1: 1, 2: 2, 3: 3}


def test_bands_and_signature_bound_follow_from_the_threshold():
    assert [(t.bands, t.agree) for t in map(near_dedup.Threshold, (85, 80))] == [(20, 66), (29, 90)]
    for percent in range(50, 100):
        t = near_dedup.Threshold(percent)
        assert (1 - (percent / 100) ** near_dedup.ROWS) ** t.bands <= near_dedup.MISS
    with pytest.raises(ValueError):
        near_dedup.Threshold(0)


def test_components_of_a_long_chain_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(5, 5), (100, 101), (101, 100)]
    got = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r["node"]: r["component"] for r in got} == {i: 0 for i in range(61)} | {100: 100, 101: 100}


@pytest.mark.parametrize("size", [1 << 10, 32 << 20])
def test_fingerprints_of_edited_texts(docs, monkeypatch, size):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", size)
    rows = texts_of(docs)
    ordered = [(r["doc_id"], r["text"] or "") for r in docs.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).orderBy(F.desc_nulls_last("doc_id"), F.desc("h")).collect()]
    want = defaultdict(set)
    for k, (i, t) in enumerate(ordered):
        half, following = len(t) // 2, ordered[(k + 1) % len(ordered)][1]
        want[i].add((len(t), hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()))
    got, prints = defaultdict(set), {}
    for r in fingerprints.fingerprints(docs).collect():
        got[r["doc_id"]].add((r["n_chars"], r["edited_sha256"]))
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        prints[r["doc_id"]] = r["fingerprint"]
    assert got == want
    texts = dict(rows)
    assert len(set(prints.values())) == len({texts[i] for i in prints})


def test_fingerprints_are_homomorphic():
    of = fingerprints.Fingerprint.of
    assert of("a line\nother\nthird").encoded() == of("third\na line\nother").encoded()
    assert of("a line\nother").insert(of("third")).encoded() == of("third\na line\nother").encoded()
    assert of("a line\nother\nthird").delete(of("other")).encoded() == of("a line\nthird").encoded()
    assert of("x\nx").encoded() != of("x").encoded() and of(None).encoded() == of("").encoded()
    long = "some words of a text that goes on for a while " * 5
    assert of(long).near(of(long + " more")) > 0.9 > 0.3 > of(long).near(of("quite another story, told by nobody"))


def test_lines_equal_their_sql(docs, spark, monkeypatch):
    rows = [(i, t) for i, t in texts_of(docs) if i is not None]
    with duckdb.connect() as con:
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?)", sorted(set(rows)))
        want = sorted(con.execute(line_dedup.ORACLE_SQL).fetchall())
    unique = spark.createDataFrame(sorted(set(rows)), "doc_id long, text string").repartition(3)
    for hot, large in ((512, 4096), (2, 3)):
        monkeypatch.setattr(line_dedup, "HOT_ROWS", hot)
        monkeypatch.setattr(line_dedup, "LARGE_MEETING", large)
        got = sorted(tuple(r) for r in line_dedup.lines_of(unique).collect())
        assert got == want


def test_lines_of_odd_rows_and_removal(spark):
    rows = [(2, "same line here\nother words"), (1, "SAME line here\n\nsame line here"), (None, "same line here"), (3, None), (2, "same line here\nother words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("none", "x")
    got = {(r["doc_id"], r["line"]): (r["first_doc_id"], r["first_line"], r["kept"]) for r in line_dedup.lines_of(docs).collect()}
    assert got[(1, 0)] == (1, 0, True) and got[(1, 1)] == (1, 1, True) and got[(1, 2)] == (1, 0, False)
    assert got[(2, 0)] == (1, 0, False) and got[(2, 1)] == (2, 1, True) and got[(None, 0)] == (1, 0, False) and got[(3, 0)] == (3, 0, True)
    left = {(r["doc_id"], r["text"], r["removed_lines"]) for r in line_dedup.remove(docs).collect()}
    assert (1, "SAME line here\n", 1) in left and (2, "other words", 1) in left and (3, None, 0) in left
    assert line_dedup.lines_of(docs.limit(0)).count() == 0


def test_licences_equal_their_sql(docs):
    rows = sorted({(i, t) for i, t in texts_of(docs) if i is not None})
    with duckdb.connect() as con:
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
        want = con.execute(license_scan.oracle_sql()).fetchall()
    assert len(want) > 8
    assert {tuple(r) for r in license_scan.scan(docs).collect() if r["doc_id"] is not None} == set(want)


def test_licences_survive_edits_long_texts_and_comment_marks(spark):
    mit = license_scan.TEMPLATES["mit"]
    words = mit.split()
    marked = "\n".join(" * " + " ".join(words[i : i + 9]) for i in range(0, len(words), 9))
    edited = mit.replace("including without limitation", "including, but")
    rows = [(1, marked), (2, "pad " * 20000 + edited), (3, " ".join(words[: len(words) // 2])), (4, None), (5, "")]
    found = {r["doc_id"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["license"] == "mit"}
    assert found == {1, 2}


def test_band_settings_guarantee_what_they_say():
    for n in range(1, 300):
        c = license_scan.size_classes([n])[n]
        least = license_scan.needed(n) / (c.width + n - license_scan.needed(n))
        assert c.width >= n and (1 - least**license_scan.ROWS) ** c.bands <= license_scan.MISS


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for rows in (exact_dedup.groups_of(empty), near_dedup.groups_of(empty), fingerprints.fingerprints(empty), license_scan.scan(empty)):
        assert rows.count() == 0
