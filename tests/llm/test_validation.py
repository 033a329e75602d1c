"""Cross-validation inside the training rows against a plain loop."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tallyforge.llm import _linear, toxicity, validation

BASE = dict(scale=toxicity.log_count_ratios, epochs=2, alpha=2.0, beta=1.0, l1=0.1, l2=1e-3)
SETTINGS = {"all": BASE, "twice": {**BASE, "least_rows": 2}}


def test_folds_equal_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    words = ["good", "fine", "calm", "awful", "nasty", "vile"]
    texts = {i: " ".join(words[j] for j in rng.integers(0, 3, 12) + (3 if i % 4 == 0 else 0)) + f" {i}" for i in range(60)}
    labels = [(i, int(i % 4 == 0)) for i in texts] + [(3, None), (None, 1), (999, 1), (7, 0)]
    docs = spark.createDataFrame([*texts.items(), (1000, "no label")], "doc_id long, text string")
    got = validation.cross_validated(docs, spark.createDataFrame(labels, "doc_id long, label int"), toxicity.features, toxicity.BITS, SETTINGS, 1000, 0.5, folds=3)
    got = {(r["setting"], r["fold"]): r for r in got.collect()}
    rows = {i: (int(i % 4 == 0), next(iter(toxicity.features(pa.array([t])))).astype(np.int32)) for i, t in texts.items()}
    own = {i: zlib.crc32(f"fold {i}".encode()) % 3 for i in texts}
    assert len(got) == 6
    for (name, fold), r in got.items():
        model = _linear.train([rows[i] for i in texts if own[i] != fold], toxicity.BITS, **{"least_rows": 1, **SETTINGS[name]})
        out = [i for i in texts if own[i] == fold]
        p = model.scores(rows[i][1] for i in out)
        y = np.array([rows[i][0] for i in out])
        assert (r["rows"], r["positives"], r["named"], r["found"]) == (len(out), y.sum(), (p >= 0.5).sum(), ((p >= 0.5) & (y == 1)).sum())
        assert abs(r["loss"] + np.log(np.where(y == 1, p, 1 - p)).sum()) < 1e-9 and r["found"] == r["positives"]


def test_no_labels_give_no_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = docs.select("doc_id", F.lit(None).cast("int").alias("label"))
    assert validation.cross_validated(docs, none, toxicity.features, toxicity.BITS, SETTINGS, 10, 0.5).collect() == []
