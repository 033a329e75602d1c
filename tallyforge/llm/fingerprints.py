"""Homomorphic multiset fingerprints of documents.

A paragraph is a line of a text. Each is hashed to a wide vector of two parts: 16 lanes of 64 uniform bits (from
SHAKE-128 of the paragraph), summed modulo 2**64, which tell equal texts; and 256 lanes that add +1 or -1 at a hashed
place for every run of 8 code points of the paragraph (its start padded), summed modulo 2**32, whose cosine estimates
likeness. A document's fingerprint is the sum over its paragraphs: their order does not matter, and paragraphs are
inserted or deleted by adding or subtracting their vectors.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

EXACT_LANES, LIKENESS_LANES, RUN = 16, 256, 8
#: A range of rows has about so many bytes of text, less where the session has more cores than ranges and more beyond
#: ``MOST_RANGES``; a task goes through it row by row.
RANGE_BYTES, LEAST_BYTES, MOST_RANGES = 32 << 20, 1 << 18, 1 << 16
#: Ranges by number of rows, of which those by bytes are made up.
FINE = 4
_FACTORS = np.random.Generator(np.random.PCG64(11)).integers(1, 2**32, RUN, dtype=np.uint32) | np.uint32(1)
_LOWEST = -(2**63)


class Fingerprint:
    """exact: uint64 lanes; likeness: uint32 lanes. Addition and subtraction wrap."""

    __slots__ = ("exact", "likeness")

    def __init__(self, exact: np.ndarray, likeness: np.ndarray):
        self.exact, self.likeness = exact, likeness

    @classmethod
    def of(cls, text: str | None) -> Fingerprint:
        text = text or ""
        digests = b"".join(hashlib.shake_128(p.encode("utf-8", "surrogatepass")).digest(8 * EXACT_LANES) for p in text.split("\n"))
        exact = np.frombuffer(digests, dtype="<u8").reshape(-1, EXACT_LANES).sum(axis=0, dtype=np.uint64)
        pad = "\n" * (RUN - 1)
        codes = np.frombuffer((pad + text.replace("\n", pad)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        m = len(codes) - RUN + 1
        if m <= 0:
            return cls(exact, np.zeros(LIKENESS_LANES, dtype=np.uint32))
        h = codes[:m] * _FACTORS[0]
        for j in range(1, RUN):
            h += codes[j : j + m] * _FACTORS[j]
        h = h[codes[RUN - 1 :] != 10]
        h ^= h >> np.uint32(16)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        h *= np.uint32(0xC2B2AE35)
        # the places by sign: 0 to 255 add one, 256 to 511 take one away
        both = np.bincount(h >> np.uint32(23), minlength=2 * LIKENESS_LANES)
        return cls(exact, (both[:LIKENESS_LANES] - both[LIKENESS_LANES:]).astype(np.uint32))

    def insert(self, paragraphs: Fingerprint) -> Fingerprint:
        return Fingerprint(self.exact + paragraphs.exact, self.likeness + paragraphs.likeness)

    def delete(self, paragraphs: Fingerprint) -> Fingerprint:
        return Fingerprint(self.exact - paragraphs.exact, self.likeness - paragraphs.likeness)

    def near(self, other: Fingerprint) -> float:
        """1 for equal fingerprints, else the cosine of the likeness lanes, 0 where that is negative or undefined."""
        if np.array_equal(self.exact, other.exact) and np.array_equal(self.likeness, other.likeness):
            return 1.0
        a, b = (x.likeness.view(np.int32).astype(np.float64) for x in (self, other))
        size = math.sqrt((a @ a) * (b @ b))
        return max(0.0, min(1.0, float(a @ b) / size)) if size else 0.0

    def encoded(self) -> str:
        return base64.b64encode(self.exact.astype("<u8").tobytes() + self.likeness.astype("<u4").tobytes()).decode()

    @classmethod
    def decoded(cls, text: str) -> Fingerprint:
        raw = base64.b64decode(text)
        return cls(np.frombuffer(raw[: 8 * EXACT_LANES], dtype="<u8"), np.frombuffer(raw[8 * EXACT_LANES :], dtype="<u4"))


def edited(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by the first as many code points of ``following``, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _range_ends(docs: DataFrame) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """The least and greatest (id, hash) of ranges of about equal bytes, in order: four numbers for each range.

    They are found from ids, hashes and lengths alone: ranges of equal numbers of rows, ``FINE`` for each wanted, are put
    together until they have their bytes.
    """
    rows = docs.select("_id", "_hash", F.octet_length("text").cast("long").alias("_bytes"))
    total = rows.agg(F.sum("_bytes")).first()[0] or 0
    parts = max(1, min(MOST_RANGES, max(math.ceil(total / RANGE_BYTES), min(docs.sparkSession.sparkContext.defaultParallelism, total // LEAST_BYTES))))
    first = F.struct("_id", "_hash")
    fine = rows.repartitionByRange(FINE * parts, F.col("_id").desc(), F.col("_hash").desc()).groupBy(F.spark_partition_id()).agg(F.min(first).alias("low"), F.max(first).alias("high"), F.sum("_bytes").alias("n"))
    ends: list[tuple[tuple[int, int], tuple[int, int]]] = []
    filled = total
    for low, high, n in sorted((tuple(x["low"]), tuple(x["high"]), x["n"]) for x in fine.select("low", "high", "n").collect()):
        if ends and filled + n / 2 <= total / parts:
            ends[-1], filled = (ends[-1][0], high), filled + n
        else:
            ends.append((low, high))
            filled = n
    return ends


def _in_order(docs: DataFrame) -> DataFrame:
    """Rows in ranges of falling (doc_id, hash of the text), one range a partition and sorted; each range ends with a copy
    of the row after it. Texts move once."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.coalesce("doc_id", F.lit(_LOWEST)).cast("long").alias("_id"), F.xxhash64(text).alias("_hash"))
    ends = _range_ends(rows)
    last = max(0, len(ends) - 1)
    shared = rows.sparkSession.sparkContext.broadcast([np.array([x[i] for x in ends], dtype=np.int64).reshape(-1, 2) for i in (0, 1)])

    def place(batches):
        lows, highs = shared.value
        for batch in batches:
            id_, hash_ = (batch.column(c).to_numpy() for c in ("_id", "_hash"))
            # the last range whose least key is not above a row's; equal ids are told apart by the hashes
            at, above = (np.searchsorted(lows[:, 0], id_, side=x) for x in ("left", "right"))
            for i in np.flatnonzero(above > at):
                at[i] += np.searchsorted(lows[at[i] : above[i], 1], hash_[i], side="right")
            at -= 1
            heads = np.flatnonzero((highs[at] == np.stack((id_, hash_), axis=1)).all(axis=1))
            yield _placed(batch, last - at, False)
            if len(heads):  # a range's first row also goes behind the range before it
                yield _placed(batch.take(pa.array(heads)), (last - at[heads] - 1) % (last + 1), True)

    placed = rows.mapInArrow(place, "_range int, _copy boolean, doc_id long, text string, _id long, _hash long")
    return placed.repartitionById(last + 1, F.col("_range")).sortWithinPartitions("_copy", F.desc("_id"), F.desc("_hash"), "text")


def _placed(batch: pa.RecordBatch, ranges: np.ndarray, copy: bool) -> pa.RecordBatch:
    names = ["doc_id", "text", "_id", "_hash"]
    columns = [pa.array(ranges.astype(np.int32)), pa.array(np.full(batch.num_rows, copy)), batch.column("doc_id").cast(pa.int64()), *[batch.column(c) for c in names[1:]]]
    return pa.RecordBatch.from_arrays(columns, ["_range", "_copy", *names])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text takes its new half from the next document by falling doc_id; the last one's next is the first.
    Defined cases: a null text is empty; an empty text's fingerprint is that of one empty paragraph; rows with equal
    ids follow each other by the falling xxhash64 of their texts; rows without id come last; a single row is its own
    next; an empty table gives no rows; other columns do not matter.
    """

    def pairs(batches) -> Iterator[tuple[int | None, str, Fingerprint, str, Fingerprint]]:
        """Each row with the next one of its range; a copy at the range's end is only ever a next one."""
        before = None
        for batch in batches:
            for doc_id, text, copy in zip(*(batch.column(c) for c in ("doc_id", "text", "_copy")), strict=True):
                doc_id, text, copy = doc_id.as_py(), text.as_py(), copy.as_py()
                if before and before[3]:
                    return
                mark = Fingerprint.of(text)
                if before:
                    yield before[0], before[1], before[2], text, mark
                before = doc_id, text, mark, copy

    def work(batches):
        done = []
        for doc_id, text, mark, following, after in pairs(batches):
            new = edited(text, following)
            edit = mark if new == text else Fingerprint.of(new)
            done.append((doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), mark.encoded(), edit.encoded(), mark.near(edit), mark.near(after)))
            if len(done) == 256:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), kinds, strict=True)], names)
                done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), kinds, strict=True)], names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return _in_order(docs).mapInArrow(work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
