"""Odd tables for every operator: tiny partitions, clashing column names, repeated ids; features and updates against plain loops."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tallyforge.llm import _linear, _text, exact_dedup, fingerprints, fuse_filter, license_scan, line_dedup, mixing, near_dedup, packing, quality, queries, toxicity, warc
from tallyforge.llm.queries import tokenizer_definition

SHORT = ["", "a", "a b", "a b c", "a b c d", "a b c d e", "a b c d e f", None]
OPERATORS = {
    "packing": lambda d: packing.pack(d, tokenizer_definition()),
    "mixing": lambda d: mixing.repeated(mixing.mix(d)),
    "toxicity": lambda d: toxicity.classify(d, toxicity.fit(d, d.select("doc_id", F.lit(1).alias("label")))),
    "quality": lambda d: quality.classify(d, quality.fit(d, d.select("doc_id", F.lit(1).alias("label")))),
    "exact_dedup": exact_dedup.keep,
    "fingerprints": fingerprints.fingerprints,
    "near_dedup": near_dedup.keep,
    "line_dedup": line_dedup.remove,
    "license_scan": license_scan.scan,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_partitions_of_one_short_row(spark, name):
    rows = [(i, t, "s") for i, t in enumerate(SHORT)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(len(rows), "doc_id")
    found = OPERATORS[name](docs).collect()
    if name in ("packing", "toxicity", "quality", "fingerprints", "line_dedup"):
        assert {r["doc_id"] for r in found} == set(range(len(SHORT)))
    if name in ("exact_dedup", "near_dedup"):
        assert len({(r["text"] or "") for r in found}) == len({t or "" for t in SHORT})


@pytest.mark.parametrize("texts", [["a b c"], ["a b"], ["w " * 700_000, "a b"], ["a b c", "A B C", "a  b\tc"], [None], []])
def test_near_dedup_of_few_words_in_a_chunk(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.groups_of(docs).collect()}
    words = [" ".join((t or "").lower().split()) for t in texts]
    assert got == {i: (int(bool(w)), words.index(w) if w else i) for i, w in enumerate(words)}


def test_a_licence_of_two_words_is_found():
    index = license_scan.Index([("x", "MIT License")])
    assert index.names == ["x"] and len(index.sets[0]) == 1


def test_shingles_of_any_number_of_words():
    for n in range(9):
        for first, end, data, offsets in _text.chunks(pa.array([" ".join("abcdefghi"[:n]), "", "x y"])):
            hashes, rows, _, _ = _text.words(data, offsets)
            found, at = _text.shingles(hashes, rows, end - first, 5)
            assert np.bincount(at, minlength=3).tolist() == [max(1, n - 4) if n else 0, 0, 1]


def test_hashes_of_words_do_not_depend_on_how_they_are_taken(monkeypatch):
    data = np.frombuffer(b"some words and averyverylongwordindeed x " * 40, dtype=np.uint8)
    want = _text.words(data, np.array([0, len(data)]))[0]
    for size in (1, 7, 64):
        monkeypatch.setattr(_text, "HASH_BYTES", size)
        assert (_text.words(data, np.array([0, len(data)]))[0] == want).all()


NAMES = [
    "_id", "_sha", "_digest", "_salt", "_text", "_doc", "_gone", "_offset", "_key", "_bucket", "_before", "_epochs", "_cut", "_source", "_words", "key", "bucket", "offset", "own_source", "own_bucket", "words", "before",
    "epochs", "cut", "digest", "dropped_id", "dropped_sha", "line_doc", "gone", "others", "epoch", "component_id", "n_shingles", "rep", "keep_id", "kept", "label", "Before", "line", "ids", "sequence_id", "_range", "_copy", "_hash",
]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, f"{'same text of a few words ' * 4 if i % 3 == 0 else f'other text {i} of some words '}\nline {i % 2} here", f"s{i % 2}") for i in range(12)]
    docs = spark.createDataFrame([*rows, rows[0], (None, None, None)], "doc_id long, text string, source string")
    return docs.select("*", *[F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")).alias(n) for n in NAMES if n != "Before"])


@pytest.mark.parametrize("name", ["mixing", "exact_dedup", "near_dedup", "line_dedup", "toxicity", "quality"])
def test_clashing_columns_are_kept(clashing, name):
    made = OPERATORS[name](clashing)
    kept = [n for n in NAMES if n != "Before" and not (name == "mixing" and n == "epoch")]
    assert set(kept) <= set(made.columns)
    rows = made.collect()
    assert rows and all(r[n] == (None if r["doc_id"] is None else f"{n} of {r['doc_id']}") for r in rows for n in kept)


@pytest.mark.parametrize("name", ["packing", "fingerprints", "license_scan"])
def test_clashing_columns_do_not_matter(clashing, name):
    assert {tuple(r) for r in OPERATORS[name](clashing.withColumnRenamed("ids", "Ids")).select("doc_id").collect()} <= {(i,) for i in [*range(12), None]}


def test_pipeline_stages_keep_clashing_columns(spark, clashing, tmp_path):
    import corpus_pipeline

    clashing.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).write.parquet(f"{tmp_path}/labels.parquet")
    more = [c for c in ("size", "source_size", "target", "taken", "score", "predicted") if c not in clashing.columns]
    docs = clashing.select("*", *[F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")).alias(n) for n in more])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, str(tmp_path))
        assert made.columns == docs.columns, name
        rows = made.collect()
        assert all(r[n] == f"{n} of {r['doc_id']}" for r in rows if r["doc_id"] is not None for n in (*more, "epoch", "others", "_id")), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0


def test_pages_with_clashing_columns_and_ids(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x", 7), (1, "u", "x", 7), (None, None, None, None)], "page_id long, url string, html string, refers_to long").withColumn("_id", F.lit(1)).withColumn("payload", F.lit("p"))
    warc.write(pages, f"file://{tmp_path}/w")
    assert warc.read(spark, f"file://{tmp_path}/w").filter("kind = 'record'").count() == 3


def test_one_id_with_several_texts_links_them(spark):
    a, b, c = ("one two three four five six seven", "red green blue white black brown grey", "up down left right in out over")
    docs = spark.createDataFrame([(2, a), (5, a), (5, b), (7, b), (9, c), (8, c), (9, a + " x"), (1, "alone")], "doc_id long, text string")
    got = [(r["doc_id"], r["component_id"]) for r in near_dedup.groups_of(docs).collect()]
    assert sorted(got) == [(1, 1), (2, 2), (5, 2), (5, 2), (7, 2), (8, 8), (9, 8), (9, 8)]


def test_registered_near_dedup_equals_its_sql(spark):
    with duckdb.connect() as con:
        con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
        want = Counter(con.execute(near_dedup.ORACLE_SQL).fetchall())
    assert Counter(tuple(r) for r in queries.op8_near_dedup(spark, "/root/testdata/sf0.001").collect()) == want


def test_sets_much_larger_than_their_slack_are_linked(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 1 << 12)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 3000)]
    rows = []
    for i in range(12):
        edited = list(words)
        for at in rng.integers(0, 3000, 20 + 3 * i):
            edited[at] = f"edit{i}{at}"
        rows.append((i, " ".join(edited)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(2996)} for _, t in rows]
    edges = {(a, b) for a in range(12) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    parent = list(range(12))
    for _ in range(12):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.groups_of(docs).collect()} == dict(enumerate(parent))


def test_a_batch_is_compared_with_a_stored_snapshot(spark, monkeypatch):
    old = spark.createDataFrame([(1, "one"), (2, "two"), (3, "Three")], "doc_id long, text string")
    new = spark.createDataFrame([(4, "ONE"), (5, "four"), (6, "four"), (7, "three")], "doc_id long, text string")
    known = exact_dedup.ingest([], old)
    batch = exact_dedup.ingest([known], new)
    assert known.unequal.isEmpty() and batch.unequal.isEmpty()
    assert {r["n"] for r in batch.groups.collect()} == {1, 2} and "filters" not in batch.__dict__
    met = exact_dedup.screened(batch.groups, known).join(known.groups.select("digest"), "digest")
    assert sorted(r["keep_id"] for r in met.collect()) == [4, 7]
    rows = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.merged([known, batch]).collect()}
    assert rows == {1: (4, 2), 2: (2, 1), 3: (7, 2), 4: (4, 2), 5: (6, 2), 6: (6, 2), 7: (7, 2)}
    # equal digests of different texts are found when the batch is taken in
    monkeypatch.setattr(exact_dedup, "digest", lambda text: F.lit("same"))
    known = exact_dedup.ingest([], old.filter("doc_id = 1"))
    assert known.unequal.isEmpty()
    assert [r["digest"] for r in exact_dedup.ingest([known], new.filter("doc_id = 5")).unequal.collect()] == ["same"]
    assert exact_dedup.ingest([known], new.filter("doc_id = 4")).unequal.isEmpty()


def test_screening_lets_every_known_digest_through():
    keys = np.arange(1, 70_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert fuse_filter.build(keys).may_contain(keys).all()


def test_toxicity_features_equal_a_plain_count():
    texts = ["Hello hello HELLO", "ab", "", "aaaaaaaaaaaaaaaa", "é日本 x" * 3]
    mask = 2**32 - 1

    def places(text):
        codes, counts = [ord(c) for c in text.lower()], Counter()
        for n in toxicity.SIZES:
            for i in range(len(codes) - n + 1):
                h = sum(c * int(f) for c, f in zip(codes[i : i + n], toxicity._FACTORS, strict=False)) & mask
                counts[(h ^ (h >> 15)) * (0x85EBCA6B + 2 * n) & mask] += 1
        out = set()
        for run, n in counts.items():
            for k in range(toxicity.LEVELS):
                if n >= 1 << k:
                    part = (run + int(toxicity._LEVEL[k])) & mask
                    out.add(((part ^ (part >> 13)) * 0xC2B2AE35 & mask) >> (32 - toxicity.BITS))
        return sorted(out)

    assert [x.tolist() for x in toxicity.features(pa.array(texts))] == [places(t) for t in texts]


def test_quality_features_equal_a_plain_count():
    texts = ["Good good words, WELL  said!! said", "", "!!!", "AB ab Ab\nab 12 é"]

    def code(token):
        return int(_text.hash_runs(np.frombuffer(token.encode(), dtype=np.uint8), np.array([0]), np.array([len(token.encode())]))[0])

    def features(text):
        tokens, raw = [], [t for t in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[^\s0-9A-Za-z\x80-\U0010ffff]+", text)]
        lowered = [code("".join(c.lower() if c.isascii() else c for c in t)) for t in raw]
        for i, t in enumerate(raw):
            shouted = sum(c.isascii() and c.isupper() for c in t) > 1 and not any(c.isascii() and c.islower() for c in t)
            again = i > 0 and lowered[i] == lowered[i - 1]
            tokens.append(int(quality._AGAIN) if again else int(quality._CAPITALS) if shouted else lowered[i])
        pairs = [(a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) % 2**64 for a, b in zip(tokens[:-1], tokens[1:], strict=True)]
        hashed = np.array(tokens + pairs, dtype=np.uint64)
        return sorted(set((_text.mix64(hashed) >> np.uint64(64 - quality.BITS)).astype(int).tolist())) if len(hashed) else []

    assert [x.tolist() for x in quality.features(pa.array(texts))] == [features(t) for t in texts]


def test_updates_follow_the_regularised_leader():
    rng = np.random.default_rng(8)
    learner = _linear.FollowTheLeader(6, alpha=0.7, beta=1.0, l1=0.05, l2=0.01)
    z, n = [0.0] * 7, [0.0] * 7
    for _ in range(60):
        at = np.sort(rng.permutation(7)[:3])
        x, y = rng.random(3), int(rng.integers(2))
        w = [0.0 if abs(z[i]) <= 0.05 else (np.sign(z[i]) * 0.05 - z[i]) / ((1.0 + n[i] ** 0.5) / 0.7 + 0.01) for i in at]
        p = 1 / (1 + np.exp(-sum(a * b for a, b in zip(w, x, strict=True))))
        for i, wi, xi in zip(at, w, x, strict=True):
            g = (p - y) * xi
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.7 * wi
            n[i] += g * g
        learner.learn(at, x, y)
    assert learner.z.tolist() == pytest.approx(z) and learner.n.tolist() == pytest.approx(n)


def test_mixing_within_two_words_of_any_target(spark):
    rows = [(i, "w " * (1 + i % 5), f"s{i % 7}") for i in range(700)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r["taken"] - r["target"]) <= 0.5


def test_templates_are_read_from_a_table_in_blocks(spark, tmp_path, monkeypatch):
    names = [f"t{i}" for i in range(7)]
    texts = [" ".join(f"w{i}x{k}" for k in range(30)) for i in range(7)]
    spark.createDataFrame([*zip(names, texts, strict=True), ("none", None)], "license string, text string").write.parquet(f"{tmp_path}/t")
    library = license_scan.templates_from(spark, f"{tmp_path}/t")
    assert library == sorted(zip(names, texts, strict=True))
    docs = spark.createDataFrame([(i, f"before {t} after") for i, t in enumerate(texts)], "doc_id long, text string")
    want = {(i, n) for i, n in enumerate(names)}
    for at_once, blocks in ((1024, 8), (2, 2), (3, 1)):
        monkeypatch.setattr(license_scan, "TEMPLATES_AT_ONCE", at_once)
        monkeypatch.setattr(license_scan, "BLOCKS_AT_ONCE", blocks)
        assert {(r["doc_id"], r["license"]) for r in license_scan.scan(docs, library).collect()} == want
    monkeypatch.setattr(license_scan, "LIBRARY_BYTES", 10)
    with pytest.raises(ValueError):
        license_scan.templates_from(spark, f"{tmp_path}/t")


def test_minima_are_only_taken_where_a_template_may_be(spark, monkeypatch):
    index = license_scan.Index(list(license_scan.TEMPLATES.items()))
    taken = []
    hashed = license_scan.Index.hashed
    monkeypatch.setattr(license_scan.Index, "hashed", lambda self, shingles: taken.append(len(shingles)) or hashed(self, shingles))
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    text = " ".join(rng.choice(words, 40_000))
    own = " ".join(license_scan.TEMPLATES["zlib-whole"].split()[:-3])
    for before, after in (("", text), (text, ""), (text, text)):
        raw = np.frombuffer(f"{before} {own} {after}".encode(), dtype=np.uint8)
        found, _ = license_scan._shingles(raw, np.array([0, len(raw)]))
        taken.clear()
        _, template = index.candidates(found)
        assert index.names.index("zlib-whole") in template and 0 < sum(taken) < 10_000
    taken.clear()
    at, template = index.candidates(license_scan._shingles(np.frombuffer(text.encode(), dtype=np.uint8), np.array([0, len(text)]))[0])
    assert not len(at) and not len(template) and not taken


def test_whole_licences_are_found(spark):
    docs = spark.createDataFrame(list(enumerate(license_scan.TEMPLATES.values())), "doc_id long, text string")
    found = {(r["doc_id"], r["license"]) for r in license_scan.scan(docs).collect()}
    assert set(enumerate(license_scan.TEMPLATES)) <= found


def test_piece_checks_are_of_the_ids(spark):
    rows = packing.pack(spark.createDataFrame([(1, "x y"), (1, "x y"), (None, None)], "doc_id long, text string"), tokenizer_definition()).collect()
    assert Counter(r["doc_id"] for r in rows)[1] >= 2 and all(len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) >= 0 for r in rows)
