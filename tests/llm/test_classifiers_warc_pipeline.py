"""Classifiers by held-out accuracy, archives by round trip and damage, the pipeline stage by stage."""

import base64
import gzip
import hashlib
import io
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.fs
import pytest
from pyspark.sql import functions as F
from tallyforge.llm import _linear, quality, queries, toxicity, warc

SF = "/root/testdata/sf0.01"
ROOT = str(Path(__file__).resolve().parents[2])


@pytest.mark.parametrize(("module", "good", "bad"), [(quality, "plain words follow one another in this text", "BUY BUY BUY now now now"), (toxicity, "you are a worthless fool", "a calm and friendly remark")])
def test_a_classifier_learns_a_clear_rule_and_scores_unseen_texts(spark, module, good, bad):
    rows = [(i, f"{good if i % 2 else bad} number {i * 37 % 101}", i % 2) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    labels = docs.select("doc_id", "label").filter("doc_id < 200")
    model = module.fit(docs, labels)
    scored = module.classify(docs.withColumn("score", F.lit("clash")), model).collect()
    assert all(0 <= r["score"] <= 1 for r in scored)
    assert sum(r["predicted"] == r["label"] for r in scored if r["doc_id"] >= 200) == 100


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_take_odd_rows(spark, module):
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "text"), (3, "y" * 100000), (3, "twice")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (3, 0), (3, 1)], "doc_id long, label int")
    rows = module.classify(odd, module.fit(odd, labels)).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    nothing = module.fit(odd, labels.limit(0))
    assert {r["score"] for r in module.classify(odd, nothing).collect()} == {0.5}
    assert module.classify(odd.limit(0), nothing).count() == 0


@pytest.mark.parametrize(("query", "label", "modulus", "remainder", "least"), [(queries.op4_toxicity, "toxic", 4, 2, 0.9), (queries.op7_quality, "quality", 3, 1, 0.9)])
def test_registered_classifiers_on_held_out_rows(spark, query, label, modulus, remainder, least):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = query(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == remainder) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= least * len(held)


@pytest.mark.parametrize(("query", "label", "least"), [(queries.op4_toxicity, "toxic", 0.85), (queries.op7_quality, "quality", 0.8)])
def test_both_labels_are_found_in_held_out_rows(spark, query, label, least):
    """Most toxicity labels are 0, so that accuracy alone says little."""
    large = SF.replace("0.01", "0.1")
    labels = spark.read.parquet(f"{large}/labels.parquet").select("doc_id", F.col(label).alias("label"))
    held = query(spark, large).filter("held_out").join(labels, "doc_id").groupBy("label").agg(F.avg((F.col("predicted") == F.col("label")).cast("int")).alias("found"))
    found = {r["label"]: round(r["found"], 3) for r in held.collect()}
    assert min(found.values()) >= least, found


def test_log_count_ratios_follow_the_counts():
    import numpy as np

    rows = [(1, np.array([3, 4])), (1, np.array([3])), (0, np.array([4])), (0, np.array([5]))] * 20
    ratios = toxicity.log_count_ratios(rows)
    assert ratios[3] > 1 and ratios[5] < -1 and abs(ratios[4]) < 0.01 and abs(ratios[6]) < 0.01


def test_follow_the_leader_shrinks_useless_weights_to_zero():
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [(int(y), np.array([y, 2 + int(rng.integers(50))])) for y in rng.integers(0, 2, 500)]
    model = _linear.train(rows, 6, None, 3, 1.0, 1.0, 5.0, 1e-3)
    assert model.weights[1] > 0 > model.weights[0] and (model.weights[2:] == 0).mean() > 0.8


PAGES = [(5, "http://a/x y", "<p>one</p>"), (1, "http://b", "<p>one</p>"), (9, None, None), (7, "http://c", ""), (8, "http://d", "é" * 3000), (3, "http://e", "WARC/1.1\r\n\r\n")]


def test_archives_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    warc.write(pages, f"file://{tmp_path}/a", roll_bytes=400)
    rows = {r["page_id"]: r for r in warc.read(spark, f"file://{tmp_path}/a").filter("kind = 'record'").collect()}
    assert len(rows) == len(PAGES)
    for page_id, _, html in PAGES:
        data = (html or "").encode()
        first = min(p for p, _, h in PAGES if (h or "") == (html or ""))
        r = rows[page_id]
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == page_id else ("revisit", first))
        assert r["payload"] == (data if first == page_id else None)
    assert warc.read(spark, f"file://{tmp_path}/a").filter("kind = 'gap'").count() == 0
    many = {r["page_id"]: r["record_type"] for r in [*_written(spark, pages, tmp_path, 11)]}
    assert many[5] == many[1] == many[7] == many[9] == "response"


def _written(spark, pages, tmp_path, least):
    warc.write(pages, f"file://{tmp_path}/least", min_bytes=least)
    return warc.read(spark, f"file://{tmp_path}/least").collect()


def _salvaged(raw, zipped):
    return list(warc.salvage(pa.PythonFile(io.BytesIO(raw), mode="r"), zipped))


def _archive(members, zipped):
    """The bytes of an archive of members, each of some records, and (start, end, inner_start, inner_end) of each record."""
    raw, spans = b"", []
    for records in members:
        inner, start = b"".join(records), len(raw)
        raw += gzip.compress(inner, mtime=0) if zipped else inner
        at = 0
        for r in records:
            spans.append((start, None, at, at + len(r)) if zipped else (start + at, start + at + len(r), None, None))
            at += len(r)
    return raw, spans


def _ids(found):
    return [x[5].get("x-page-id") for x in found if x[0] == "record"]


RECORDS = [warc.record(i, f"http://x/{i}", f"page {i} ".encode() * 20, None) for i in range(6)]


def test_every_undamaged_record_of_a_plain_archive_is_recovered():
    raw, spans = _archive([RECORDS], False)
    for at in range(0, len(raw), 7):
        damaged = bytearray(raw)
        damaged[at] ^= 0xFF
        found = _salvaged(bytes(damaged), False)
        hit = next(i for i, (a, b, *_) in enumerate(spans) if a <= at < b)
        intact = [str(i) for i in range(6) if i != hit]
        # the damaged one may be there too, where no check looks, such as in its date
        assert [i for i in _ids(found) if i in intact] == intact and len(_ids(found)) <= 6
        assert [(a, b) for _, a, b, *_ in found] == spans_of(found, len(raw))
    assert _ids(_salvaged(b"junk" + raw[:-5], False)) == list("01234")
    assert _salvaged(b"", False) == [] == _salvaged(b"", True)


def spans_of(found, size):
    """The places found, if they follow one another from 0 to ``size``."""
    edges = [0, *[x[2] for x in found]]
    assert edges[-1] == size
    return list(zip(edges[:-1], edges[1:], strict=True))


@pytest.mark.parametrize("split", [1, 6])
def test_every_record_that_can_be_inflated_is_recovered(split):
    members = [RECORDS[i : i + split] for i in range(0, 6, split)]
    raw, spans = _archive(members, True)
    starts = sorted({s[0] for s in spans})
    for at in range(0, len(raw), 5):
        damaged = bytearray(raw)
        damaged[at] ^= 0xFF
        found = _salvaged(bytes(damaged), True)
        hit = max(s for s in starts if s <= at)
        other = [str(i) for i, s in enumerate(spans) if s[0] != hit]
        assert [i for i in _ids(found) if i in other] == other
        inflated = b""
        machine = zlib.decompressobj(31)
        for i in range(hit, len(raw)):
            try:
                inflated += machine.decompress(bytes(damaged[i : i + 1]))
            except zlib.error:
                break
        whole = [str(i) for i, s in enumerate(spans) if s[0] == hit and inflated[s[2] : s[3]] == RECORDS[i]]
        assert set(whole) <= set(_ids(found))


def test_bad_digests_cut_members_and_digest_forms():
    broken = RECORDS[2].replace(b"page 2", b"page X", 1)
    one, _ = _archive([[*RECORDS[:2], broken, *RECORDS[3:]]], True)
    found = _salvaged(one, True)
    assert _ids(found) == list("01345")
    gap = next(x for x in found if x[0] == "gap")
    first = len(RECORDS[0]) + len(RECORDS[1])
    assert gap[:5] == ("gap", 0, None, first, first + len(broken)) and "digest" in gap[5]
    whole, _ = _archive([RECORDS], True)
    cut = _salvaged(whole[:-20], True)
    assert _ids(cut)[:5] == list("01234") and [x for x in cut if x[0] == "gap"][-1][2] == len(whole) - 20
    block = RECORDS[0].partition(b"\r\n\r\n")[2][:-4]
    hexed = RECORDS[0].replace(b"Block-Digest: sha1:" + warc.sha1_base32(block).encode(), b"Block-Digest: sha1:" + hashlib.sha1(block).hexdigest().encode())
    assert hexed != RECORDS[0] and _ids(_salvaged(hexed, False)) == ["0"]
    bare = b"WARC/1.1\r\nX-Page-ID: 7\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    assert _ids(_salvaged(gzip.compress(bare), True)) == ["7"]
    spoilt = bytearray(gzip.compress(bare))
    spoilt[-6] ^= 1
    assert _ids(_salvaged(bytes(spoilt), True)) == []


def test_a_member_that_inflates_to_very_much_is_not_held():
    bomb = gzip.compress(bytes(1 << 27))
    raw = bomb + gzip.compress(RECORDS[0])
    assert _ids(_salvaged(raw, True)) == ["0"]
    member = warc._Inflated(warc._Bytes(pa.PythonFile(io.BytesIO(bomb), mode="r")), 0)
    assert warc._find(member, b"WARC/1.", 0) is None and member.size == 1 << 27 and len(member.window) < 1 << 22


def test_a_long_claim_is_checked_before_it_is_held():
    good = [warc.record(i, f"http://h/{i}", b"abc" * i, None) for i in range(3)]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    parts = [packer.compress(b"".join(good) + b"WARC/1.1\r\nContent-Length: 900000000\r\n\r\n")]
    parts += [packer.compress(bytes(1_000_000)) for _ in range(300)]
    data = b"".join([*parts, packer.compress(good[0]), packer.flush()])
    code = f"import resource, sys, pyarrow as pa; from tallyforge.llm import warc; print([x[0] for x in warc.salvage(pa.BufferReader(sys.stdin.buffer.read()), True)], resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10)"
    told = subprocess.run([sys.executable, "-c", code], input=data, capture_output=True, check=True, cwd=ROOT).stdout.decode().strip().rsplit(" ", 1)
    assert told[0] == "['record', 'record', 'record', 'gap', 'record']"
    assert int(told[1]) < 300  # MB; the member inflates to 300 MB


def test_false_claims_take_linear_time_and_long_blocks_are_recovered(monkeypatch):
    held = []
    monkeypatch.setattr(warc._Bytes, "get", lambda self, start, n, f=warc._Bytes.get: held.append(n) or f(self, start, n))
    line = b"WARC/1.1\r\nContent-Length: 1000000\r\nX-Filler: " + b"y" * 150 + b"\r\n\r\n"
    got = [x[0] for x in warc.salvage(pa.BufferReader(line * 10_000), False)]
    assert got == ["gap"]
    assert sum(held) < 40 * len(line) * 10_000
    monkeypatch.setattr(warc, "HELD_BYTES", 1 << 12)
    pages = [warc.record(i, "u" * (9_000 * i), bytes([65 + i]) * 20_000 * i, None) for i in range(4)]
    broken = pages[3].replace(b"DDDD", b"DDXD", 1)
    for zipped in (False, True):
        data = b"".join([pages[0], pages[1], broken, pages[2], pages[3]])
        data = gzip.compress(data) if zipped else data
        assert [x[0] for x in warc.salvage(pa.BufferReader(data), zipped)] == ["record", "record", "gap", "record", "record"]


def test_a_page_with_a_very_long_url_is_read_back(spark, tmp_path):
    url = "data:," + "u" * 3_000_000
    warc.write(spark.createDataFrame([(1, url, "x")], "page_id long, url string, html string"), f"file://{tmp_path}/long")
    assert [len(r["target_uri"]) for r in warc.read(spark, f"file://{tmp_path}/long").collect()] == [len(url)]


def test_registered_archive_query_equals_its_sql(spark):
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
        want = Counter(con.execute(warc.ORACLE_SQL).fetchall())
    assert Counter(tuple(r) for r in queries.op3_warc(spark, SF).collect()) == want


def test_pipeline_stages_take_effect_and_keep_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF)
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        docs.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        seen.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
        if name == "exact_dedup":
            assert docs.groupBy(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).count().filter("count > 1").isEmpty()
        if name == "mix_sources":
            size = lambda d: d.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n"))
            own, mixed = ({r["source"]: r["n"] for r in size(d).collect()} for d in (before, docs))
            weights = {s: i % 3 + 1 for i, s in enumerate(sorted(own))}
            share = sum(own.values()) / sum(weights.values())
            if all(weights[s] * share <= 3 * own[s] for s in own):
                assert all(abs(mixed[s] - weights[s] * share) <= 1 for s in own)
        if name == "packing":
            assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").isEmpty()
    assert seen[0] > seen[1] > seen[2] > seen[3]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    for table in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
