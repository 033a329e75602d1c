"""The corpus pipeline against a plain version of each stage, each on its own input."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from tallyforge.llm import packing, quality
from tallyforge.llm._linear import in_fold
from tallyforge.llm.queries import tokenizer_definition

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's name with its input and its result, as rows."""
    import corpus_pipeline

    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path_factory.mktemp('stages')}/{name}"
        stage(spark, docs, SF).write.parquet(path)
        made = spark.read.parquet(path)
        out[name] = docs.collect(), made.collect()
        docs = made
    return out


def test_quality_keeps_what_the_classifier_accepts(spark, stages):
    before, after = stages["quality_classifier"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("quality").alias("label")).filter(~in_fold("doc_id", 3, 1))
    accepted = {r["doc_id"] for r in quality.classify(docs, quality.fit(docs, labels)).filter("predicted = 1").collect()}
    assert Counter(after) == Counter(r for r in before if r["doc_id"] in accepted) and len(after) < len(before)


def test_of_equal_texts_the_largest_id_stays(stages):
    before, after = stages["exact_dedup"]
    best = {}
    for r in before:
        text = (r["text"] or "").translate(LOWER)
        best[text] = max(best.get(text, -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == sorted(best.values())


def test_of_near_duplicates_the_smallest_id_stays(stages):
    before, after = stages["near_dedup"]
    sets = {}
    for r in before:
        words = WORD.findall((r["text"] or "").translate(LOWER))
        sets[r["doc_id"]] = frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()
    group = {i: i for i in sets}
    for a in sorted(sets):
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    assert sorted(r["doc_id"] for r in after) == sorted(i for i, g in group.items() if i == g)


def _targets(sizes):
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in sizes if s not in fixed]
        share = {s: (total - sum(fixed.values())) * weights[s] / sum(weights[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in over}


def test_the_mix_is_cut_at_each_exact_budget(stages):
    before, after = stages["mix_sources"]
    rows, sizes = defaultdict(list), defaultdict(int)
    for r in before:
        n = len(WORD.findall(r["text"] or ""))
        rows[r["source"]].append((hashlib.md5(f"mix:{r['doc_id']}".encode()).hexdigest(), r["doc_id"], n, r["text"]))
        sizes[r["source"]] += n
    want = Counter()
    for source, target in _targets(dict(sizes)).items():
        left = int(target + 0.5)
        while left > 0 and sizes[source]:
            for _, doc_id, n, text in sorted(rows[source]):
                if not n or left <= 0:
                    continue
                want[doc_id, text if n <= left else text[: [m.end() for m in WORD.finditer(text)][left - 1]]] += 1
                left -= min(n, left)
    assert Counter((r["doc_id"], r["text"]) for r in after) == want


def test_packing_takes_each_token_once(stages):
    before, after = stages["packing"]
    own = packing.Tokenizer(tokenizer_definition()).own
    want = Counter()
    for r in before:
        want[r["doc_id"]] += len(own.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    got, sequences = Counter(), defaultdict(list)
    for r in after:
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        got[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 4096 or at & (at - 1) == 0
