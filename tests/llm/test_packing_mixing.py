"""Packing and mixing against what their contracts say, worked out row by row."""

import random
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tallyforge.llm import mixing, packing
from tallyforge.llm.queries import tokenizer_definition

SCHEMA = "doc_id long, text string, source string, sequence_id long"
ODD = [
    (1, "Alpha beta gamma. Alpha, beta!! it's 12 o'clock $$$", "a", 1),
    (2, None, None, 1),
    (3, "", "b", 1),
    (4, " \t\n", "b", 1),
    (5, "long words " * 6000, "a", 1),
    (6, "Alpha beta gamma. Alpha, beta!! it's 12 o'clock $$$", "a", 1),
    (7, "日本 éÀß <|endoftext|> x́", "c", 1),
]


def test_tokenizer_equals_the_library_on_whole_texts():
    tokenizer = packing.Tokenizer(tokenizer_definition())
    texts = [t for _, t, *_ in ODD if t] + ["I'M  'S.S' ab's, a.b,c!! ½² \u0085 ʼn", "'''", "a" * 500]
    for text, ids in zip(texts, tokenizer.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == tokenizer.own.encode(text, add_special_tokens=False).ids


def test_tokenizer_equals_the_library_on_random_strings():
    tokenizer, rng = packing.Tokenizer(tokenizer_definition()), random.Random(5)
    alphabet = [*"abzABZ019 '\"!<|>()[]{}#$%&*+,-./:;=?@^_`~\n\t", *"éÀßİıÅŉªºµ×÷½²ñçøÿĿ̸́̇\u0085 日ﬁΣς😀", "<|endoftext|>", "<|startoftext|>", "'s", "'LL", "don't", "</w>", "İ[", "Å̊", "hello", "x)"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    for text, ids in zip(texts, tokenizer.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == tokenizer.own.encode(text, add_special_tokens=False).ids, text


def test_every_token_lies_in_one_piece_and_windows_are_full(spark):
    docs = spark.createDataFrame(ODD + [(100 + i, f"word{i} shared tokens here " * (i % 50), "a", 0) for i in range(400)], SCHEMA)
    rows = packing.pack(docs, tokenizer_definition(), window=256, shard_units=64).collect()
    own = packing.Tokenizer(tokenizer_definition()).own
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    ids = {k: np.array([*own.encode(t, add_special_tokens=False).ids, 2], "<u4") for k, t in texts.items()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(part.tobytes()) == zlib.crc32(r["ids"]) and r["doc_tokens"] == len(ids[r["doc_id"]])
    for doc, all_ids in ids.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at == len(all_ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 256 or at & (at - 1) == 0


def _bm25(rng, units):
    return packing.Bm25(rng.integers(1, 60, packing.VOCABULARY), 100, float(np.mean([len(u) for u in units])))


def _score(bm25, terms, unit):
    """BM25 of a unit for a query of distinct terms, from the formula."""
    total = 0.0
    for t in terms:
        tf, idf = int((unit == t).sum()), float(bm25.idf[t])
        total += idf * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(unit) / bm25.mean))
    return total


def test_bm25_scores_equal_the_formula():
    rng = np.random.default_rng(1)
    units = [rng.integers(3, 40, n).astype("<u2") for n in (4, 1, 30, 9, 600)]
    bm25 = _bm25(rng, units)
    shard, terms = packing.Shard.of([(u.tobytes(), None) for u in units], bm25)
    for query in (terms[0], terms[2][:3], terms[0][:0]):
        assert shard.scores(query) == pytest.approx([_score(bm25, query, u) for u in units], rel=1e-5)
    kept = np.array([True, False, True, True, False])
    assert shard.only(kept).scores(terms[2]) == pytest.approx(shard.scores(terms[2])[kept])
    _, token, n = packing._profiles([(units[4].tobytes(), None)])
    whole, _ = packing.Shard.of([(units[4][-5:].tobytes(), packing._packed(token, n)), (units[2].tobytes(), None)], bm25)
    assert whole.scores(terms[2]) == pytest.approx(shard.scores(terms[2])[[4, 2]])
    heaviest = [sorted((t for t in set(u.tolist()) if bm25.idf[t] > 0 and bm25.shared[t]), key=lambda t: (-np.float32(_score(bm25, [t], u)), t))[:2] for u in units]
    assert [list(x) for x in bm25.leading([(u.tobytes(), None) for u in units])] == [[*x, -1, -1][:2] for x in heaviest]


def test_windows_are_filled_by_the_best_unused_neighbours():
    rng = np.random.default_rng(4)
    units = [(i, 0, rng.integers(3, 60, rng.integers(4, 20)).astype("<u2").tobytes(), 0, None) for i in range(90)]
    ids = [np.frombuffer(u[2], dtype="<u2") for u in units]
    bm25, used, rest, number = _bm25(rng, ids), set(), None, 0
    for window in packing._Packer(bm25, 64).take(units):
        seed, at = rest or (next(i for i in range(90) if i not in used), 0)
        used.add(seed)
        scores = [_score(bm25, np.unique(ids[seed]), x) for x in ids]
        want, room, rest = [(seed, at, min(64, len(ids[seed]) - at))], 64 - len(ids[seed]) + at, None
        for u in sorted((u for u in range(90) if u not in used), key=lambda u: (-round(scores[u], 9), u)):
            if room <= 0:
                break
            used.add(u)
            want.append((u, 0, min(room, len(ids[u]))))
            rest = (u, room) if room < len(ids[u]) else None
            room -= len(ids[u])
        assert [(u[0], a, n) for u, a, n in window] == want
        number += 1
    assert number > 10


def test_neighbours_share_a_window_over_many_shards(spark):
    tokenizer = packing.Tokenizer(tokenizer_definition())
    rng = np.random.default_rng(6)
    words = [t[:-4] for t, i in sorted(tokenizer.own.get_vocab().items(), key=lambda x: x[1]) if t.endswith("</w>") and t[:-4].isascii() and t[:-4].isalpha()]
    topics = rng.permutation(words[2000:6000])[: 20 * 8].reshape(20, 8)
    rows = [(i, " ".join([*topics[i % 20], words[-1 - 40 * j]]), "a", 0) for j, i in enumerate(rng.permutation(40).tolist())]
    length = max(len(x) // 2 for x in tokenizer.encode([t for _, t, *_ in rows])) + 1
    windows = defaultdict(set)
    for r in packing.pack(spark.createDataFrame(rows, SCHEMA), tokenizer_definition(), window=2 * length, shard_units=10).collect():
        windows[r["sequence_id"]].add(r["doc_id"])
    assert sum(any({i, i + 20} <= x for x in windows.values()) for i in range(20)) >= 14


def test_leading_units_fill_the_room():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 9, 500)
    for scores in (rng.random(500), rng.integers(0, 4, 500).astype(float), np.zeros(500)):
        order = np.argsort(-scores, kind="stable")
        for room in (1, 40, 700, 10**6):
            want = order[: int(np.searchsorted(np.cumsum(lengths[order]), room)) + 1]
            assert packing.leading(scores, lengths, room).tolist() == want.tolist()


def test_empty_table_packs_nothing(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), tokenizer_definition()).count() == 0


def _targets(sizes, cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weights = {s: i % 3 + 1 for i, s in enumerate(order)}
    fixed, total = {}, sum(sizes.values())
    while True:
        left = total - sum(fixed.values())
        free = [s for s in order if s not in fixed]
        share = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / share > cap * sizes[s]]
        if not over:
            return fixed | {s: left * weights[s] / share for s in free}
        fixed |= {s: cap * sizes[s] for s in over}


def test_mix_meets_its_targets_and_cuts_exactly(spark):
    rows = [(i, "w " * (i % 17), ["s0", "s1", "s2", None][min(i % 40, 3)], 0) for i in range(3000)] + [(9000, None, "s0", 0), (9000, None, "s0", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs, rows_per_bucket=16).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    wanted = _targets(dict(sizes))
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(wanted[r["source"]])
    for source, words in taken.items():
        assert abs(words - wanted[source]) <= 0.5
    again = mixing.mix(docs.repartition(7), rows_per_bucket=16).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in got)
    texts = mixing.repeated(mixing.mix(docs, rows_per_bucket=16)).groupBy("source").agg({"text": "count"}).collect()
    assert {r["source"] for r in texts} == {s for s, n in taken.items() if n}
    words = sum(len((r["text"] or "").split()) for r in mixing.repeated(mixing.mix(docs, rows_per_bucket=16)).collect())
    assert words == sum(taken.values())


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert {r["taken"] for r in mixing.mix(spark.createDataFrame([(1, None, None, 0), (2, " ", "x", 0)], SCHEMA)).collect()} == {0}


def test_copies_of_a_document_do_not_share_a_window(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").dropDuplicates(["text"])
    rows = packing.pack(docs.unionByName(docs), tokenizer_definition()).select("doc_id", "start", "sequence_id").collect()
    windows = Counter((r["doc_id"], r["sequence_id"]) for r in rows if r["start"] == 0)
    assert sum(windows.values()) == 2 * docs.count() and sum(n > 1 for n in windows.values()) <= 2


_HELD = """
import random, re
import pyarrow as pa
from tallyforge.llm import packing
from tallyforge.llm.queries import tokenizer_definition
definition, rng = tokenizer_definition(), random.Random(1)
words = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(20000)]
packing.Tokenizer.shared(definition).encode([" ".join(words)])
held = lambda: int(re.search("RssAnon:\\\\s+(\\\\d+)", open("/proc/self/status").read())[1]) >> 10
before = held()
batch = pa.record_batch({"doc_id": list(range(1024)), "text": [" ".join(rng.choices(words, k=480)) for _ in range(1024)]})
for _ in packing._tokenise([batch, batch], definition, 4096):
    pass
del _
print(held() - before)
"""


def test_a_worker_does_not_keep_what_tokenising_took():
    """25 MB of Arrow's pool before, beside 5 MB of texts."""
    assert int(subprocess.run([sys.executable, "-c", _HELD], capture_output=True, text=True, check=True).stdout) < 15


def test_whole_windows_come_some_at_a_time_without_old_words():
    tokenizer = packing.Tokenizer.shared(tokenizer_definition())
    tokenizer.older = {"old": b""}
    n = 2 * packing.ROWS_HELD + 5
    ids = [np.array([i, 7], "<u2").tobytes() for i in range(n)]
    rows = pa.record_batch({"doc_id": list(range(n)), "start": [0] * n, "ids": ids, "doc_tokens": [2] * n, "sequence_id": list(range(n))})
    got = list(packing._widened(iter([rows, rows.slice(0, 0)])))
    assert [b.num_rows for b in got] == [packing.ROWS_HELD, packing.ROWS_HELD, 5] and not tokenizer.older
    assert [r["ids"] for b in got for r in b.to_pylist()] == [np.array([i, 7], "<u4").tobytes() for i in range(n)]
