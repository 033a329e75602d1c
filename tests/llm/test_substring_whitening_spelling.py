"""Repeated passages, whitening and spelling variants against plain versions, and their odd tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallyforge.llm import spelling, substring_dedup, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _plain_removal(texts):
    words = [WORD.findall(t or "") for t in texts]
    starts = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - 34) if starts[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def _passages(seed):
    """Texts of few and of many words, with passages of 34, 35 and more words in common, loops of words, and whole copies."""
    rng = np.random.default_rng(seed)
    take = lambda n, most: [f"w{i}" for i in rng.integers(0, most, n)]
    shared = [take(n, 10**6) for n in (34, 35, 36, 50, 90)]
    texts = []
    for i in range(60):
        parts = [take(int(rng.integers(0, 60)), 10**6)]
        for _ in range(int(rng.integers(0, 4))):
            a = shared[int(rng.integers(len(shared)))]
            cut = int(rng.integers(0, 4))
            parts += [a[cut:], take(int(rng.integers(0, 20)), 10**6)]
        texts.append(" ".join(sum(parts, [])))
    loops = [" ".join(["a"] * 34), " ".join(["a"] * 35), " ".join(["b"] * 36), "x y z " * 40, "é ß " * 30, " ".join(take(400, 2)), " ".join(take(3000, 3)), " ".join(take(500, 2))]
    return [*texts, *loops, texts[3], texts[3], loops[3], loops[7] + "\t", None, None, "", " \n ", "one"]


@pytest.mark.parametrize(("group", "sorted_", "batch"), [(1 << 15, 1 << 15, 10000), (2, 16, 7), (1 << 15, 1, 1), (0, 1, 3), (9, 40, 11)])
def test_removed_words_equal_brute_force(spark, monkeypatch, group, sorted_, batch):
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    monkeypatch.setattr(substring_dedup, "SORTED", sorted_)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        texts = _passages(group + batch)
        rows = substring_dedup.removed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [tuple(r)[1:] for r in sorted(rows)] == _plain_removal(texts)


def test_spans_and_kept_text_of_a_passage(spark):
    shared = " ".join(f"s{i}" for i in range(35))
    docs = spark.createDataFrame([(1, f"a b {shared} c"), (2, f"{shared}\n d"), (3, "alone")], "doc_id long, text string")
    told = {r["kept"]: [(s["first"], s["end"]) for s in r["spans"]] for r in substring_dedup.without_repeats(docs).collect()}
    assert told == {"a b c": [(2, 37)], "d": [(0, 35)], "alone": []}


def test_odd_tables_of_substring_dedup(spark):
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(1, text), (1, text), (None, text), (None, None), (2, "w " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("key", "h", "n", "anchors", "windows", "copies", "kept", "spans", "listed", "at"):
        docs = docs.withColumn(name, F.lit(name))
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.removed(docs).collect())
    assert got == {(1, 40, 40): 2, (None, 40, 40): 1, (None, 0, 0): 1, (2, 200_000, 200_000): 1}
    assert substring_dedup.removed(docs.limit(0)).count() == 0


def _check_whitening(spark, vectors, components=16):
    rows = [(i, v) for i, v in enumerate(vectors)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)).collect()
    length = Counter(len(v) for v in vectors if _finite(v)).most_common(1)[0][0]
    x = {i: [int(np.floor(64.0 * float(np.float32(c)))) + 1_000_000 for c in v] for i, v in rows if _finite(v) and len(v) == length}
    fit = np.array(sorted(set(map(tuple, x.values()))), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (fit * n - sums).astype(np.float64) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, int((values > 1e-13 * values[0]).sum()))
    assert len(got) == k * len(x)
    signs = {}
    for r in got:
        i, c = r["vec_id"], r["component"] - 1
        want = float((np.array([n * a - s for a, s in zip(x[i], sums, strict=True)], dtype=object).astype(np.float64) / n) @ axes[:, c] / np.sqrt(values[c]))
        assert r["n"] == n and r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x[i], sums, strict=True))
        assert abs(r["whitened"]) == pytest.approx(abs(want), rel=1e-6, abs=1e-6)
        if abs(want) > 1e-3:
            assert signs.setdefault(c, r["whitened"] * want > 0) == (r["whitened"] * want > 0)
        assert r["explained"] == pytest.approx(values[c] / values.sum(), rel=1e-6) and r["identity_error"] <= 1e-4


def _finite(v):
    return v is not None and all(c is not None and np.isfinite(c) for c in v)


def test_whitening_equals_a_plain_decomposition(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 20)) @ np.diag(np.linspace(3, 0.5, 20)) + rng.normal(size=20)
    vectors = [[float(np.float32(c)) for c in v] for v in base]
    nan, inf = float("nan"), float("inf")
    odd = [None, [None] * 20, [nan] * 20, [inf] + [0.0] * 19, [1.0] * 7, []]
    _check_whitening(spark, vectors + vectors[:40] + [vectors[0]] * 30 + odd)


def test_whitening_of_few_vectors_and_dimensions(spark):
    _check_whitening(spark, [[0.5, 1.0, -2.0], [1.5, 1.0, 4.0], [2.5, 1.0, 7.0], [0.5, 1.0, -2.0]])  # rank 2
    _check_whitening(spark, [[1e6, -3.0], [0.0, 5.0], [7.0, 6.0]])
    _check_whitening(spark, [[a / 7, b / 3, a / 7 + b / 3, a / 7 - 2 * b / 3] for a in map(float, range(-70, 70, 7)) for b in (-3.0, 0.0, 6.0)])  # rank 2, no axis of it a dimension
    whiten = lambda rows: whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("x", F.lit(1)).withColumn("w", F.lit(2)))
    assert {r["deviation"] for r in whiten([(1, [1e9]), (2, [0.0]), (3, [1.0])]).collect()} == {None}  # beyond a long
    assert whiten([(1, [1.0, 2.0]), (2, [1.0, 2.0])]).count() == 0
    assert whiten([(1, None)]).count() == 0 and whiten([]).count() == 0 and whiten([(1, [])]).count() == 0
    assert [(r["vec_id"], r["component"], round(abs(r["whitened"]), 9)) for r in whiten([(None, [0.0]), (None, [2.0])]).collect()] == [(None, 1, 1.0)] * 2


def _plain_variants(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    near = defaultdict(set)
    for a in n:
        for b in n:
            if a != b and len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1:
                near[a].add(b)
            if len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a))):
                near[a].add(b)
                near[b].add(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda b: (-n[b], b), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def test_variants_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    letters = list("abcdeéß")
    stems = ["".join(rng.choice(letters, int(rng.integers(7, 11)))) for _ in range(12)] + ["aaaaaaa", "aaaaaaaa", "abababab", "babababa"]
    docs = []
    for i in range(400):
        out = []
        for _ in range(30):
            w = list(stems[int(rng.integers(len(stems)) ** 2 // len(stems))])
            for _ in range(int(rng.integers(0, 4)) // 2 if rng.random() < 0.3 else 0):
                at = int(rng.integers(len(w)))
                w[at : at + int(rng.integers(0, 2))] = rng.choice(letters, int(rng.integers(0, 2))).tolist()
            out.append("".join(w).upper() if i % 9 == 0 else "".join(w))
        docs.append((i, " ".join(out)))
    docs += [(None, "abcdefg abcdefg abcdefh abcdefh"), (900, None), (901, ""), (902, "short 1234567"), (902, "straßebahn" * 300), (902, "straßebahn" * 300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for name in ("word", "n", "key", "run", "h", "id", "l"):
        frame = frame.withColumn(name, F.lit(name))
    got = [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(frame.repartition(5)).collect()]
    assert len(got) == len(set(got)) and set(got) == _plain_variants(docs)
    assert sum(f is not None for _, f, *_ in got) > 20
    assert spelling.variants(frame.limit(0)).count() == 0


def test_forms_are_followed_to_the_last(spark):
    counts = [("abcdefgh", 2), ("abcdefgx", 20), ("abcdefyx", 200), ("abcdezyx", 2000)]
    found = spelling.variants(spark.createDataFrame([(-5, f"{w} " * n) for w, n in counts], "doc_id long, text string")).collect()
    told = {r["word"]: (r["form"], r["root"]) for r in found}
    if all(zlib.crc32(f"-5:{w}".encode()) % 31 for w, _ in counts):
        assert told == {"abcdefgh": ("abcdefgx", "abcdezyx"), "abcdefgx": ("abcdefyx", "abcdezyx"), "abcdefyx": ("abcdezyx", "abcdezyx"), "abcdezyx": (None, "abcdezyx")}


def test_keys_of_anagrams_are_equal_and_edits_change_them(spark):
    keys = {r["w"]: r["k"] for r in spark.createDataFrame([(w,) for w in ("listens", "silents", "listenz", "listen", "")], "w string").select("w", spelling.anagram_key(F.filter(F.split("w", ""), lambda c: c != "")).alias("k")).collect()}
    assert keys["listens"] == keys["silents"] and keys["listens"] - keys["listen"] == ord("s") ** 5
    assert keys["listenz"] - keys["listens"] == ord("z") ** 5 - ord("s") ** 5 and keys[""] == 0
