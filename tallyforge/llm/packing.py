"""Lexical retrieval packing: a sharded BM25 index returns each seed's unused neighbours, which greedily fill its window.

A document is tokenised and its whole windows are sequences at once; what is left, shorter than a window, is a unit. A
unit is known to the index by its whole document, whatever part of it is left, and weights come from counts over all
documents. Units are ordered over the cluster by the two tokens that weigh most in them, so that those which share
their most telling tokens lie together, and consecutive runs of up to ``SHARD_UNITS`` units are the shards of the
inverted index. A task holds one shard at a time and packs it: the next unused unit is the seed, and the unused units
of the shard follow by their BM25 score against it until the window is full. Copies, units of one document
or of equal texts, do not share a window while any other unit is left in the shard. The unit that does not fit is cut, and
its rest is the next seed, so only the end of a partition can leave a window open; that one is cut into sequences of
powers of two, which need no padding.

A seed's neighbours come from its own shard, never from the others, so the time grows in proportion to the corpus; the
README says how near that comes to an index of everything.
"""

from __future__ import annotations

import bisect
import itertools
import math
import os
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ._spark import stored

WINDOW = 4096
END = 2
VOCABULARY = 1 << 16
#: A shard of the index ends at so many tokens or units, which bounds its memory.
SHARD_TOKENS, SHARD_UNITS = 1 << 23, 1 << 12
#: Partitions of units: one for each shard, and beyond so many partitions (half a billion units) several shards in turn.
MAX_PARTITIONS = 1 << 17
#: Units for each partition from which the partitions' borders are estimated; borders only place units.
BORDER_UNITS = 8
K1, B = 1.2, 0.75
CACHED_WORDS = 450_000
PART_BYTES = 4 << 20
#: Units or whole windows that a task holds as rows at once, beside its shard.
ROWS_HELD = 1024
_tokenizers: dict = {}


def _give_back(words: bool = False) -> None:
    """What a Python worker has no use for goes back to the system, as it lives on after its task.

    Arrow's pool keeps what it freed. ``words``: in steps that do not tokenise, those that tokenizers have not met lately;
    the rest stay for the next job, as learning them anew takes longer than all else in tokenising.
    """
    if words:
        for tokenizer in _tokenizers.values():
            tokenizer.older = {}
    pa.default_memory_pool().release_unused()


class Tokenizer:
    """Token ids of texts as little-endian 16-bit numbers.

    The tokenizer drops white space and no token spans it, so a text's ids are those of its parts between blanks. Parts
    met lately are kept in two generations of a bounded size; new ones are encoded together, with a mark between them.
    """

    MARK = "\ue000"

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Own, pre_tokenizers

        self.own, self.known, self.older = Own.from_str(definition), {"": b""}, {}
        # parts of Latin-1 letters in lower case need no normaliser and are whole words
        self.plain = Own.from_str(definition)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.mark = self._ids(self.MARK).tolist()
        self.ends = np.zeros(VOCABULARY, dtype=bool)
        self.ends[[i for token, i in self.own.get_vocab().items() if token.endswith("</w>")]] = True

    @classmethod
    def shared(cls, definition: str) -> Tokenizer:
        """One for each Python worker, kept over its tasks."""
        key = hash(definition)
        if key not in _tokenizers:
            _tokenizers[key] = cls(definition)
        return _tokenizers[key]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        plain = [_lower(t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ") for t in texts]
        split = pc.split_pattern(_parted(pa.array(plain, pa.large_string())), " ")
        coded = split.flatten().dictionary_encode()
        parts = coded.dictionary.to_pylist()
        missing = set(parts).difference(self.known)
        if missing:
            if len(self.known) + len(missing) > CACHED_WORDS:
                self.older, self.known = self.known, {"": b""}
                missing = set(parts) - {""}
            self._recall(missing)
            self._learn(list(missing))
        ids = pa.array(map(self.known.__getitem__, parts), pa.large_binary(), size=len(parts)).take(coded.indices)
        offsets = np.frombuffer(ids.buffers()[1], dtype=np.int64)[ids.offset : ids.offset + len(ids) + 1]
        bounds = offsets[split.offsets.to_numpy()].tolist()
        raw = memoryview(ids.buffers()[2] or b"")
        return [bytes(raw[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]

    def _recall(self, parts: set[str]) -> None:
        """Takes what the older generation knows of ``parts`` over, and out of them."""
        if self.older:
            found = parts & self.older.keys()
            self.known.update(zip(found, map(self.older.__getitem__, found), strict=True))
            parts -= found

    def _learn(self, new: list[str]) -> None:
        """Encodes new parts together. One of letters alone ends at its one end-of-word token, others at a mark."""
        words = [p for p in new if p.isalpha() and self.MARK not in p]
        for i in range(0, len(words), 2000):
            some = words[i : i + 2000]
            joined = " ".join(some)
            ids = self._ids(joined, self.plain if joined == _lower(joined) and _latin(joined) else self.own)
            self._keep(some, ids, np.append(0, np.flatnonzero(self.ends[ids]) + 1), 0)
        others = [p for p in new if not p.isalpha() and self.MARK not in p]
        for i in range(0, len(others), 2000):
            some = others[i : i + 2000]
            ids = self._ids(f" {self.MARK} ".join(some))
            m = len(self.mark)
            at = np.ones(max(0, len(ids) - m + 1), dtype=bool)
            for j, x in enumerate(self.mark):
                at &= ids[j : len(ids) - m + 1 + j] == x
            self._keep(some, ids, np.concatenate(([0], np.flatnonzero(at) + m, [len(ids) + m])), m)
        self._keep_each([p for p in new if self.MARK in p])

    def _ids(self, text: str, by=None) -> np.ndarray:
        return np.array((by or self.own).encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u2")

    def _keep(self, parts: list[str], ids: np.ndarray, bounds: np.ndarray, gap: int) -> None:
        if len(bounds) != len(parts) + 1:  # some part does not end as supposed
            return self._keep_each(parts)
        raw = ids.tobytes()
        self.known.update(zip(parts, [raw[a:b] for a, b in zip((2 * bounds[:-1]).tolist(), (2 * (bounds[1:] - gap)).tolist(), strict=True)], strict=True))

    def _keep_each(self, parts: list[str]) -> None:
        for part in parts:
            self.known[part] = self._ids(part).tobytes()


#: Bytes of letters: a-z, A-Z, and the second byte of those from U+00C0 to U+00FF, which follows 0xC3.
_LETTER, _SECOND = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SECOND[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] = True
#: Never in one token with a letter; the apostrophe is, in tokens such as 's.
_MARK = np.zeros(256, dtype=bool)
_MARK[[ord(c) for c in string.punctuation if c != "'"]] = True


def _parted(texts: pa.LargeStringArray) -> pa.LargeStringArray:
    """The texts with a space between letters and marks next to each other, so that fewer different parts are left.

    Tokens of the special kind, <|...|>, hold both; texts with their opening marks are left as they are.
    """
    offsets, raw = np.frombuffer(texts.buffers()[1], dtype=np.int64)[: len(texts) + 1], texts.buffers()[2]
    if raw is None or not offsets[-1]:
        return texts
    data = np.frombuffer(raw, dtype=np.uint8)[: offsets[-1]]
    mark, begins, ends = _MARK[data], _LETTER[data], _LETTER[data]
    pair = (data[:-1] == 0xC3) & _SECOND[data[1:]]
    begins[:-1] |= pair
    ends[1:] |= pair
    gap = np.zeros(len(data), dtype=bool)
    gap[1:] = (ends[:-1] & mark[1:]) | (mark[:-1] & begins[1:])
    gap[offsets[:-1][offsets[:-1] < len(data)]] = False
    special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
    for row in np.unique(np.searchsorted(offsets, special, side="right") - 1).tolist():
        gap[offsets[row] : offsets[row + 1]] = False
    at = np.flatnonzero(gap)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets + np.searchsorted(at, offsets)), pa.py_buffer(np.insert(data, at, 32)))


def _lower(text: str) -> str:
    """Lower-cased as the tokenizer does it, where that is sure: in Latin-1 every character is composed and maps alone."""
    return text.lower() if _latin(text) else text


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_UNIT = "doc_id long, start long, ids binary, doc_tokens long, profile binary, kind string"
_KEYED = "part int, first int, second int, doc_id long, start long, ids binary, doc_tokens long, profile binary"
_PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, seed_doc_id long"
_PROFILE = np.dtype([("token", "<u2"), ("n", "<u4")])


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    names = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[t]) for x, (_, t) in zip(zip(*rows, strict=True), names, strict=True)], [n for n, _ in names])


def _tokenise(batches: Iterator[pa.RecordBatch], definition: str, window: int) -> Iterator[pa.RecordBatch]:
    """Rows of kind 'whole' (a full window), 'unit' (what is left) and 'counts' (a partition's document counts by token).

    A unit that is not its whole document carries the counts of that document's tokens as its profile.
    """
    tokenizer = Tokenizer.shared(definition)
    counts = np.zeros(VOCABULARY, dtype=np.int64)
    end = np.array([END], dtype="<u2").tobytes()
    for batch in batches:
        for part in _in_parts(batch):
            rows, coded = [], [ids + end for ids in tokenizer.encode(part.column("text").to_pylist())]
            unit, token, times = _profiles([(ids, None) for ids in coded])
            counts += np.bincount(token, minlength=VOCABULARY)
            for i, (doc_id, ids) in enumerate(zip(part.column("doc_id").to_pylist(), coded, strict=True)):
                n = len(ids) // 2
                cut = n - n % window
                rows += [(doc_id, s, ids[2 * s : 2 * (s + window)], n, None, "whole") for s in range(0, cut, window)]
                if cut < n:
                    own = slice(*np.searchsorted(unit, (i, i + 1))) if cut else None
                    rows.append((doc_id, cut, ids[2 * cut :], n, _packed(token[own], times[own]) if cut else None, "unit"))
            yield _batch(rows, _UNIT)
            del rows, coded, unit, token, times
            _give_back()
    yield _batch([(None, None, counts.tobytes(), None, None, "counts")], _UNIT)


def _tokenised(docs: DataFrame, definition: str, window: int) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda batches: _tokenise(batches, definition, window), _UNIT)


def _in_parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of at most 1024 rows and about ``PART_BYTES`` of text; a longer text is one of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < batch.num_rows:
        before = int(ends[first - 1]) if first else 0
        end = min(first + 1024, max(first + 1, int(np.searchsorted(ends, before + PART_BYTES, side="right"))))
        yield batch.slice(first, end - first)
        first = end


def _statistics(tokenised: DataFrame) -> Bm25:
    """Weights from all documents; at most one number per token of the vocabulary is gathered."""

    def spread(batches):
        _give_back(words=True)
        for batch in batches:
            for ids in batch.column("ids").to_pylist():
                counts = np.frombuffer(ids, dtype=np.int64)
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["token", "n"])

    counts = np.zeros(VOCABULARY, dtype=np.int64)
    for row in tokenised.filter("kind = 'counts'").select("ids").mapInArrow(spread, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():
        counts[row["token"]] = row["n"]
    tokens = tokenised.filter("kind <> 'counts'").agg(F.sum(F.octet_length("ids") / 2)).first()[0]
    documents = int(counts[END])  # each has it
    return Bm25(counts, documents, float(tokens or 0) / max(1, documents))


def _profiles(units: list[tuple[bytes, bytes | None]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, token, how often) of the distinct tokens of each of up to 65,536 units (ids, or if given the profile)."""
    owner = np.repeat(np.arange(len(units), dtype=np.uint32), [0 if profile else len(ids) // 2 for ids, profile in units])
    keys = owner << np.uint32(16)
    keys |= np.frombuffer(b"".join([ids for ids, profile in units if not profile]), dtype="<u2")
    keys.sort()
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
    found = [((keys[first] >> np.uint32(16)).astype(np.int64), (keys[first] & np.uint32(0xFFFF)).astype(np.int64), np.diff(np.append(first, len(keys))))]
    for i, (_, profile) in enumerate(units):
        if profile:
            part = np.frombuffer(profile, dtype=_PROFILE)
            found.append((np.full(len(part), i), part["token"].astype(np.int64), part["n"].astype(np.int64)))
    unit, token, n = (np.concatenate(x) for x in zip(*found, strict=True))
    if len(found) > 1:
        order = np.argsort(unit, kind="stable")
        unit, token, n = unit[order], token[order], n[order]
    return unit, token, n


def _packed(token: np.ndarray, n: np.ndarray) -> bytes:
    out = np.empty(len(token), dtype=_PROFILE)
    out["token"], out["n"] = token, n
    return out.tobytes()


class Bm25:
    """BM25 weights by the counts of a whole corpus: in how many documents each token is, of so many of a mean length."""

    def __init__(self, counts: np.ndarray, documents: int, mean: float):
        idf = np.log((documents - counts + 0.5) / (counts + 0.5)) if documents else np.zeros(VOCABULARY)
        #: A token in half of the documents or more has no weight, so leaving it out changes no score.
        self.idf, self.mean, self.shared = np.maximum(idf, 0.0).astype(np.float32), mean, counts > 1

    def weights(self, units: list[tuple[bytes, bytes | None]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit, token, weight) of the tokens with any weight in each unit's document, in order."""
        unit, token, n = _profiles(units)
        length = np.bincount(unit, n, len(units))
        idf = self.idf[token].astype(np.float64)
        some = idf > 0
        unit, token, n, idf = unit[some], token[some], n[some], idf[some]
        return unit, token, idf * n * (K1 + 1) / (n + K1 * (1 - B + B * length[unit] / self.mean))

    def leading(self, units: list[tuple[bytes, bytes | None]]) -> list[tuple[int, int]]:
        """The two tokens that weigh most in each unit of those that other documents have, of equal ones the lower, else -1."""
        unit, token, weight = self.weights(units)
        some = self.shared[token]
        unit, token, weight = unit[some], token[some], weight[some]
        out, some = np.full((len(units), 2), -1), np.unique(unit)
        if len(some):
            # less is heavier: the weight's bits turned round, then the token
            order = ((np.uint64(0xFFFFFFFF) - weight.astype(np.float32).view(np.uint32).astype(np.uint64)) << np.uint64(16)) | token.astype(np.uint64)
            bounds, none = np.searchsorted(unit, some), np.uint64(2**64 - 1)
            for i in range(2):
                best = np.minimum.reduceat(order, bounds)
                out[some, i] = np.where(best == none, -1, (best & np.uint64(0xFFFF)).astype(np.int64))
                order[order == np.repeat(best, np.diff(np.append(bounds, len(unit))))] = none
        return [tuple(x) for x in out.tolist()]


class Shard:
    """The inverted index of some units: for each token the units that have it, with their BM25 weights."""

    def __init__(self, size: int, bounds: np.ndarray, units: np.ndarray, weights: np.ndarray):
        self.size, self.bounds, self.units, self.weights = size, bounds, units, weights

    @classmethod
    def of(cls, units: list[tuple[bytes, bytes | None]], bm25: Bm25) -> tuple[Shard, list[np.ndarray]]:
        """The index and each unit's weighty tokens."""
        found = []
        for first in range(0, len(units), 256):
            unit, token, weight = bm25.weights(units[first : first + 256])
            found.append((unit + first, token, weight))
        unit, token, weight = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(token, kind="stable")
        shard = cls(len(units), np.append(0, np.cumsum(np.bincount(token, minlength=VOCABULARY))), unit[order], weight[order])
        return shard, np.split(token, np.searchsorted(unit, np.arange(1, len(units))))

    def only(self, kept: np.ndarray) -> Shard:
        """The index of the units that ``kept`` marks, numbered anew."""
        some, number = kept[self.units], np.cumsum(kept) - 1
        return Shard(int(kept.sum()), np.append(0, np.cumsum(some))[self.bounds], number[self.units[some]], self.weights[some])

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """Every unit's BM25 score for a query of distinct tokens."""
        spans = [slice(a, b) for a, b in zip(self.bounds[terms].tolist(), self.bounds[terms + 1].tolist(), strict=True) if a < b]
        if not spans:
            return np.zeros(self.size)
        return np.bincount(np.concatenate([self.units[x] for x in spans]), np.concatenate([self.weights[x] for x in spans]), self.size)


def leading(scores: np.ndarray, lengths: np.ndarray, room: int) -> np.ndarray:
    """The best units, best first and of equal ones the first, up to the one that fills ``room``; all where none does."""
    k = 32
    while k < len(scores):
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores > least)  # ties at the bound wait for a larger k
        at = at[np.argsort(-scores[at], kind="stable")]
        filled = np.cumsum(lengths[at])
        if len(at) and filled[-1] >= room:
            return at[: int(np.searchsorted(filled, room)) + 1]
        k *= 4
    at = np.argsort(-scores, kind="stable")
    return at[: int(np.searchsorted(np.cumsum(lengths[at]), room)) + 1]


class _Packer:
    """Fills windows over a partition's shards; ``take`` gives the full ones, ``finish`` what is left open."""

    def __init__(self, bm25: Bm25, window: int):
        self.bm25, self.window = bm25, window
        self.open: list[tuple] = []  # (unit, from, length) of the open window
        self.room, self.seed_terms = window, None

    def _blocked(self, copies: list[np.ndarray]) -> np.ndarray:
        """Which units of a shard are copies of what the open window holds; ``copies``: labels by document and text, and which have an id."""
        ids, texts = zip(*(_labels(unit) for unit, _, _ in self.open), strict=True)
        return (np.isin(copies[0], [x for x in ids if x is not None]) & copies[2]) | np.isin(copies[1], texts)

    def _place(self, unit: tuple, at: int) -> int:
        """Puts what fits of ``unit`` (doc_id, start, ids, doc_tokens, profile) from ``at`` on; returns where it stops."""
        n = min(self.room, len(unit[2]) // 2 - at)
        self.open.append((unit, at, n))
        self.room -= n
        return at + n

    def take(self, units: list[tuple]) -> Iterator[list[tuple]]:
        shard, terms = Shard.of([(u[2], u[4]) for u in units], self.bm25)
        sizes = np.array([len(u[2]) // 2 for u in units], dtype=np.int64)
        used, pointer, rest = np.zeros(len(units), dtype=bool), 0, None
        labels = [_labels(u) for u in units]
        copies = [np.array([x or 0 for x, _ in labels], dtype=np.int64), np.array([x for _, x in labels], dtype=np.int64), np.array([x is not None for x, _ in labels])]
        indexed = np.arange(len(units))  # the units that the index still holds
        while True:
            if not self.open:
                if rest is None:
                    while pointer < len(units) and used[pointer]:
                        pointer += 1
                    if pointer == len(units):
                        return
                    rest, used[pointer] = (pointer, 0), True
                seed, at = rest
                rest = None
                self.seed_terms = terms[seed]
                self._place(units[seed], at)
            if self.room:
                scores, blocked = shard.scores(self.seed_terms), self._blocked(copies)
                while self.room:
                    free = ~used[indexed] & ~blocked[indexed]
                    if not free.any():  # only copies are left
                        free = ~used[indexed]
                        blocked[:] = False
                    left = indexed[free]
                    if not len(left):
                        break
                    for u in left[leading(scores[free], sizes[left], self.room)].tolist():
                        if blocked[u]:  # a copy of one placed just now
                            continue
                        used[u] = True
                        if (end := self._place(units[u], 0)) < sizes[u]:
                            rest = (u, end)
                        if not self.room:
                            break
                        blocked |= (copies[2] & copies[2][u] & (copies[0] == copies[0][u])) | (copies[1] == copies[1][u])
                if 2 * int((~used[indexed]).sum()) < len(indexed):
                    shard, indexed = shard.only(~used[indexed]), indexed[~used[indexed]]
            if self.room:
                return
            yield self.open
            self.open, self.room = [], self.window

    def finish(self) -> Iterator[list[tuple]]:
        """The open window as sequences of falling powers of two."""
        left, parts = self.window - self.room, self.open
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            own = []
            while size:
                unit, at, n = parts[0]
                own.append((unit, at, min(n, size)))
                parts = ([(unit, at + size, n - size)] if n > size else []) + parts[1:]
                size -= min(n, size)
            yield own


def _labels(unit: tuple) -> tuple[int | None, int]:
    """What tells a unit's copies: its document's id, if it has one, and a hash of its text's tokens."""
    return unit[0], hash((unit[2], unit[3], unit[4]))


def _pieces(sequence_id: int, parts: list[tuple]) -> Iterator[tuple]:
    at, seed = 0, parts[0][0][0]
    for unit, first, n in parts:
        yield unit[0], unit[1] + first, n, _wide(unit[2][2 * first : 2 * (first + n)]), unit[3], sequence_id, at, seed
        at += n


def _widened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of whole windows, some rows at a time: a batch of 10,000 has 160 MB of them."""
    _give_back(words=True)
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS_HELD):
            some = (batch.column(c).slice(i, ROWS_HELD).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens", "sequence_id"))
            yield _batch([(doc_id, start, len(ids) // 2, _wide(ids), doc_tokens, sequence_id, 0, doc_id) for doc_id, start, ids, doc_tokens, sequence_id in zip(*some, strict=True)], _PIECE)


def _wide(ids: bytes) -> bytes:
    return np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes()


def _shards(batches, shard_tokens: int, shard_units: int) -> Iterator[list[tuple]]:
    units, tokens = [], 0
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS_HELD):
            for row in zip(*(batch.column(c).slice(i, ROWS_HELD).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens", "profile")), strict=True):
                units.append(row)
                tokens += len(row[2]) // 2
                if tokens >= shard_tokens or len(units) == shard_units:
                    yield units
                    units, tokens = [], 0
    if units:
        yield units


def _placed(units: DataFrame, bm25: Bm25, shard_units: int) -> DataFrame:
    """The units by partition, ordered by their leading tokens; a partition is about a shard.

    The partitions' borders are (first, second, a hash for each row) of ``BORDER_UNITS`` sampled units a partition, so
    units of one hot token, or all alike, are spread as well, and leading tokens are worked out once.
    """
    count = units.count()
    parts = max(1, min(MAX_PARTITIONS, math.ceil(count / shard_units)))
    hashed = units.withColumn("mixed", F.xxhash64(F.monotonically_increasing_id()))
    borders: list[tuple] = []
    if parts > 1:
        sampled = hashed.select("ids", "profile", "mixed").sample(min(1.0, 2 * BORDER_UNITS * parts / count), seed=7)

        def keys(batches):
            _give_back(words=True)
            for batch in batches:
                for i in range(0, batch.num_rows, 256):
                    some = batch.slice(i, 256)
                    best = bm25.leading(list(zip(some.column("ids").to_pylist(), some.column("profile").to_pylist(), strict=True)))
                    yield _batch([(*two, mixed) for two, mixed in zip(best, some.column("mixed").to_pylist(), strict=True)], "first int, second int, mixed long")

        found = sorted(tuple(r) for r in sampled.mapInArrow(keys, "first int, second int, mixed long").collect())
        borders = [found[len(found) * i // parts] for i in range(1, parts)] if found else []

    def place(batches):
        _give_back(words=True)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                best = bm25.leading(list(zip(some.column("ids").to_pylist(), some.column("profile").to_pylist(), strict=True)))
                part = [bisect.bisect_right(borders, (*two, mixed)) for two, mixed in zip(best, some.column("mixed").to_pylist(), strict=True)]
                keys = [pa.array(x, pa.int32()) for x in (part, [x for x, _ in best], [x for _, x in best])]
                yield pa.RecordBatch.from_arrays([*keys, *some.columns[:5]], [c.split()[0] for c in _KEYED.split(", ")])

    keyed = hashed.select("doc_id", "start", "ids", "doc_tokens", "profile", "mixed").mapInArrow(place, _KEYED)
    return keyed.repartitionById(parts, F.col("part")).sortWithinPartitions("first", "second", "doc_id", "start", "doc_tokens", "ids").drop("part", "first", "second")


def pack(docs: DataFrame, definition: str, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, shard_units: int = SHARD_UNITS) -> DataFrame:
    """Pieces of the sequences that hold all of ``docs``: doc_id, start, length, ids, doc_tokens, sequence_id, offset, seed_doc_id.

    ``definition`` is a tokenizer's JSON, of at most 65,536 tokens; every document ends with id 2. ids are
    little-endian unsigned 32-bit numbers. Each id of each document lies in exactly one piece.

    Defined cases: a null or empty text is the end id alone; rows of equal doc_id, or without one, are packed each;
    an empty table gives no rows; other columns do not matter; a document of any length is cut at whole windows.
    """
    tokenised = stored(_tokenised(docs, definition, window), "pack-tokens")
    bm25 = _statistics(tokenised)

    def fill(batches):
        _give_back(words=True)
        packer, number, base = _Packer(bm25, window), 0, TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        full = (parts for units in _shards(batches, shard_tokens, shard_units) for parts in packer.take(units))
        for parts in itertools.chain(full, packer.finish()):
            rows += _pieces(2 * (base + number), parts)
            number += 1
            if len(rows) >= 1024:
                yield _batch(rows, _PIECE)
                rows = []
        if rows:
            yield _batch(rows, _PIECE)

    packed = _placed(tokenised.filter("kind = 'unit'"), bm25, shard_units).mapInArrow(fill, _PIECE)
    whole = tokenised.filter("kind = 'whole'").select("doc_id", "start", "ids", "doc_tokens", (2 * F.monotonically_increasing_id() + 1).alias("sequence_id"))
    return packed.unionByName(whole.mapInArrow(_widened, _PIECE))
