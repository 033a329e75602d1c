"""Passages that repeat, by prefix-partitioned suffix trees over words.

A window of 35 words repeats if it starts at two places. Trees hold a sample of the suffixes: in every window the least of
its 16 sequences of 20 words (by hash, the first of equal ones) is its anchor, so that equal windows have theirs at the
same place, and only suffixes that start at an anchor are indexed, with the words on their left that a window may begin
with. They are split by prefixes of variable length: the anchor's 20 words where a prefix has at most ``GROUP`` suffixes,
and where it has more, all 35 words of each window, which is as deep as a node matters; such a group is one node and only
counted. A prefix that occurs once is no group. Each other group's tree is built in memory: its suffixes are sorted by
words, neighbours' common prefixes give the internal nodes, and of a node at least 35 - o words deep the leaves that share
the o words on their left start the same window.

Texts that are equal as a whole are taken once with the number of their copies. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._spark import stored
from ._text import SPACE, chunks, hash_runs, mix64, row_bounds, runs, string_column

#: Words of a window and of an anchor, and the anchors a window chooses from.
WINDOW, PREFIX = 35, 20
CHOICE = WINDOW - PREFIX + 1
#: Suffixes of a prefix that are sorted in memory together, some 30 MB with their words.
GROUP = 1 << 15
#: Suffixes that are sorted at once: whole groups up to about so many.
SORTED = 1 << 15
_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_LEFT = _U64(0xD6E8FEB86659FD93)


class _Words:
    """The words of some rows: hashes, where they lie, and the bounds of each row's words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        self.starts, self.ends = runs(~SPACE[data], offsets)
        self.hashes = hash_runs(data, self.starts, self.ends)
        self.rows = np.searchsorted(offsets, self.starts, side="right") - 1
        self.bounds = row_bounds(self.rows, len(offsets) - 1)

    def sequences(self, k: int) -> np.ndarray:
        """A hash of every ``k`` words in a row of words, whatever texts they lie in."""
        n = max(0, len(self.hashes) - k + 1)
        out = np.zeros(n, dtype=np.uint64)
        for j in range(k):
            out += self.hashes[j : j + n] * _U64(pow(_BASE, j, 2**64))
        return mix64(out)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, word, first window, last window) of each anchor, windows by the word they start at."""
        n = len(self.hashes) - WINDOW + 1
        if n <= 0:
            return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
        g = self.sequences(PREFIX)
        best, step = np.arange(len(g)), 1
        while step < CHOICE:  # the least of twice as many each time
            a, b = best[:-step], best[step:]
            best, step = np.where(g[b] < g[a], b, a), step * 2
        at = np.flatnonzero(self.rows[:n] == self.rows[WINDOW - 1 :])
        chosen = best[at]
        first = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1]))) if len(at) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(at)) - 1 if len(at) else first
        return g[chosen[first]], chosen[first], at[first], at[last]


def _words_of(column) -> Iterator[tuple[int, int, _Words]]:
    for first, end, data, offsets in chunks(column):
        yield first, end, _Words(data, offsets)


def _lists(values: np.ndarray, rows: np.ndarray, n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(row_bounds(rows, n).astype(np.int32)), pa.array(values))


def _blobs(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary value of the 64-bit entries [start, start + length) for each pair."""
    shift = np.cumsum(lengths) - lengths
    taken = values[np.arange(int(lengths.sum())) - np.repeat(shift, lengths) + np.repeat(starts, lengths)]
    offsets = np.append(shift, lengths.sum()) * 8
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(taken.astype("<u8").tobytes())])


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(key, text, copies): each text once, keyed by its SHA-256; a null text is empty."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.unhex(F.sha2(text, 256)).alias("key"), text.alias("text")).groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))


def _anchors_of(texts: DataFrame) -> DataFrame:
    """(key, anchors): the hashes of each text's anchors, in order."""

    def work(batches):
        for batch in batches:
            for first, end, words in _words_of(batch.column("text")):
                g, at, _, _ = words.anchors()
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(first, end - first), _lists(g.view(np.int64), words.rows[at], end - first)], ["key", "anchors"])

    return texts.select("key", "text").mapInArrow(work, "key binary, anchors array<long>").filter(F.size("anchors") > 0)


def _suffixes(texts: DataFrame, repeated: DataFrame) -> DataFrame:
    """Rows of two kinds for the anchors that repeat.

    A suffix of a group: its prefix, key and word, and the words before and behind the anchor that its windows have. A
    window of a prefix with too many suffixes: prefix and more, a hash of 128 bits of its 35 words, key and first word.
    """

    def work(batches):
        for batch in batches:
            listed = batch.column("listed")
            for first, end, words in _words_of(batch.column("text")):
                g, at, p0, p1 = words.anchors()
                part = listed.slice(first, end - first)
                numbers, big = part.flatten().field("i").to_numpy(), part.flatten().field("big").to_numpy(zero_copy_only=False)
                begin = row_bounds(words.rows[at], end - first)
                lengths = part.value_lengths().to_numpy()
                pick = np.repeat(begin[:-1], lengths) + numbers
                keys = np.repeat(np.arange(end - first), lengths)
                some = batch.column("key").slice(first, end - first)
                small, a = pick[~big], at[pick[~big]]
                none = pa.nulls(len(small), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g[small].view(np.int64)), none, some.take(pa.array(keys[~big])), pa.array((a - words.bounds[words.rows[a]]).astype(np.int32)),
                     _blobs(words.hashes, p0[small], a - p0[small]), _blobs(words.hashes, a + PREFIX, p1[small] + WINDOW - a - PREFIX)], _SUFFIX)
                if big.any():
                    many, size = pick[big], (p1 - p0 + 1)[pick[big]]
                    p = np.repeat(p0[many] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
                    two = words.sequences(WINDOW)[p], mix64(words.sequences(WINDOW - 1)[p] + words.hashes[p + WINDOW - 1] * _LEFT)
                    empty = pa.array([b""] * len(p), pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(two[0].view(np.int64)), pa.array(two[1].view(np.int64)), some.take(pa.array(np.repeat(keys[big], size))), pa.array((p - words.bounds[words.rows[p]]).astype(np.int32)), empty, empty], _SUFFIX)

    return texts.select("key", "text").join(repeated.hint("merge"), "key").mapInArrow(work, "prefix long, more long, key binary, at int, before binary, behind binary")


_SUFFIX = ["prefix", "more", "key", "at", "before", "behind"]


def _padded(column: pa.Array, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """(rows of CHOICE - 1 words, zero where there are fewer, and the number of words); ``backwards`` from the last one on."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    values = np.frombuffer(column.buffers()[2] or b"", dtype="<u8", count=int(offsets[-1]) // 8) if len(column) else np.zeros(0, np.uint64)
    starts, n = offsets[:-1] // 8, np.diff(offsets) // 8
    place = np.arange(CHOICE - 1)
    at = starts[:, None] + (n[:, None] - 1 - place if backwards else place)
    inside = place < n[:, None]
    if not len(values):
        return np.zeros(inside.shape, np.uint64), n
    return np.where(inside, values[np.clip(at, 0, len(values) - 1)], _U64(0)), n


def windows_of_groups(prefix: np.ndarray, before: pa.Array, behind: pa.Array) -> np.ndarray:
    """For each suffix of some whole groups a bit o for each repeated window that starts o words before its anchor."""
    left, most = _padded(before, True)
    right, n = _padded(behind, False)
    least = CHOICE - 1 - n
    order = np.lexsort([right[:, j] for j in range(CHOICE - 2, -1, -1)] + [prefix])
    prefix, left, right, least, most = prefix[order], left[order], right[order], least[order], most[order]
    alike = np.cumprod(right[1:] == right[:-1], axis=1).sum(axis=1)
    common = np.concatenate(([0], np.where(prefix[1:] == prefix[:-1], PREFIX + alike, 0)))  # words shared with the suffix before
    found, lefts = np.zeros(len(order), dtype=np.int64), np.zeros(len(order), dtype=np.uint64)
    for o in range(CHOICE):
        if o:
            lefts = mix64(lefts * _LEFT + left[:, o - 1])
        deep = common >= WINDOW - o
        inner = deep | np.append(deep[1:], False)  # leaves of internal nodes so deep
        leaf = np.flatnonzero(inner & (least <= o) & (o <= most))
        node = np.cumsum(~deep)[leaf]
        by = np.lexsort((lefts[leaf], node))
        same = (node[by][1:] == node[by][:-1]) & (lefts[leaf][by][1:] == lefts[leaf][by][:-1])
        twice = np.append(same, False) | np.concatenate(([False], same))
        found[leaf[by[: len(twice)][twice[: len(by)]]]] |= 1 << o
    out = np.zeros(len(order), dtype=np.int64)
    out[order] = found
    return out


def _group_windows(suffixes: DataFrame) -> DataFrame:
    """(key, at, windows) of the suffixes that start a repeated window, from the trees of all groups."""

    def told(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        before, behind = (table.column(c).chunk(0) for c in ("before", "behind"))
        windows = windows_of_groups(table.column("prefix").to_numpy(), before, behind)
        some = pa.array(np.flatnonzero(windows))
        return pa.RecordBatch.from_arrays([table.column("key").chunk(0).take(some), table.column("at").chunk(0).take(some), pa.array(windows[windows > 0])], ["key", "at", "windows"])

    def work(batches):
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            prefix = batch.column("prefix").to_numpy()
            last = int(np.searchsorted(prefix, prefix[-1]))  # where the last group begins, which may go on
            begins = last > 0 or not held or held[-1].column("prefix")[-1].as_py() != prefix[0]
            if rows + last >= SORTED and begins:
                if rows + last:
                    yield told(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held, rows, batch = [], 0, batch.slice(last)
            held.append(batch)
            rows += batch.num_rows
        if rows:
            yield told(pa.Table.from_batches(held))

    return suffixes.select("prefix", "key", "at", "before", "behind").repartition("prefix").sortWithinPartitions("prefix").mapInArrow(work, "key binary, at int, windows long")


def repeated_windows(texts: DataFrame) -> DataFrame:
    """(key, windows): for each text with windows that also start elsewhere in ``texts``, structs of a word and a bit for
    each such window, bit o for the one that starts o words before it."""
    anchors = stored(_anchors_of(texts), "substring-anchors", tidy=True)
    each = anchors.select("key", F.posexplode("anchors").alias("i", "h"))
    # stored, so that a frequent prefix is split: a join deals out skewed keys anew only where both sides are shuffled for it
    counts = stored(each.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "substring-prefixes", tidy=True)
    met = each.join(counts.hint("merge"), "h").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("i", (F.col("n") > GROUP).alias("big")))).alias("listed"))
    suffixes = stored(_suffixes(texts, stored(met, "substring-met", tidy=True)), "substring-suffixes", tidy=True)
    single = suffixes.filter("more IS NOT NULL").select("prefix", "more", "key", "at")
    twice = stored(single.groupBy("prefix", "more").agg(F.count("*").alias("n")).filter("n > 1").select("prefix", "more"), "substring-twice", tidy=True)
    single = single.join(twice.hint("merge"), ["prefix", "more"]).select("key", "at", F.lit(1).cast("long").alias("windows"))
    found = _group_windows(suffixes.filter("more IS NULL")).unionByName(single)
    return stored(found.groupBy("key").agg(F.collect_list(F.struct("at", "windows")).alias("windows")), "substring-windows", tidy=True)


def without_repeats(docs: DataFrame) -> DataFrame:
    """Per distinct text: key (see :func:`distinct_texts`), n_words, n_removed, spans and kept.

    spans are the maximal runs of removed words, (first, end) by number from 0; kept is the text of the other words,
    joined by one space. A text that stands in several rows repeats as a whole if it has a window.
    """
    texts = stored(distinct_texts(docs), "substring-texts", tidy=True)
    joined = texts.join(repeated_windows(texts).hint("merge"), "key", "left")

    def work(batches):
        for batch in batches:
            copies = batch.column("copies").to_numpy()
            for first, end, words in _words_of(batch.column("text")):
                part = batch.column("windows").slice(first, end - first)
                n, counts = len(words.hashes), np.diff(words.bounds)
                entries = part.flatten()
                owner = np.repeat(np.arange(end - first), np.nan_to_num(part.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
                at, bits = (entries.field(c).to_numpy().astype(np.int64) for c in ("at", "windows"))
                edge = np.zeros(n + WINDOW + 1, dtype=np.int64)
                for o in range(CHOICE):
                    some = bits >> o & 1 == 1
                    begin = words.bounds[owner[some]] + at[some] - o
                    np.add.at(edge, begin, 1)
                    np.add.at(edge, begin + WINDOW, -1)
                gone = np.cumsum(edge)[:n] > 0
                gone |= np.repeat((copies[first:end] > 1) & (counts >= WINDOW), counts)
                yield _told(batch.column("key").slice(first, end - first), words, gone, counts)

    return joined.mapInArrow(work, "key binary, n_words long, n_removed long, spans array<struct<first: int, end: int>>, kept string")


def _told(keys: pa.Array, words: _Words, gone: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    removed = np.add.reduceat(np.append(gone, False).astype(np.int64), words.bounds[:-1]) * (counts > 0)
    edge = np.concatenate(([True], (gone[1:] != gone[:-1]) | (words.rows[1:] != words.rows[:-1]), [True])) if len(gone) else np.array([True])
    at = np.flatnonzero(edge)
    begin, end = (x[gone[at[:-1]]] for x in (at[:-1], at[1:])) if len(gone) else (at[:0], at[:0])
    origin = words.bounds[words.rows[begin]]
    spans = pa.StructArray.from_arrays([pa.array((x - origin).astype(np.int32)) for x in (begin, end)], ["first", "end"])
    spans = pa.ListArray.from_arrays(pa.array(row_bounds(words.rows[begin], len(counts)).astype(np.int32)), spans)
    # every kept word with the space behind it, copied at once; a text's last space is left out
    kept = np.flatnonzero(~gone)
    lengths = words.ends[kept] - words.starts[kept] + 1
    shift = np.cumsum(lengths) - lengths
    source = np.repeat(words.starts[kept] - shift, lengths) + np.arange(int(lengths.sum()))
    data = np.append(words.data, np.uint8(32))[source]
    data[shift + lengths - 1] = 32
    bounds = np.searchsorted(words.rows[kept], np.arange(len(counts) + 1))
    ends = np.append(shift, len(data))
    raw = data.tobytes()
    texts = [raw[ends[a] : ends[b] - 1].decode("utf-8", "surrogatepass") if b > a else "" for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return pa.RecordBatch.from_arrays([keys, pa.array(counts.astype(np.int64)), pa.array(removed), spans, pa.array(texts, pa.string())], ["key", "n_words", "n_removed", "spans", "kept"])


def removed(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256.

    Defined cases: a null text is empty and has no words; a text of fewer words than a window loses none; rows with equal
    texts, also with one id or none, each have their result and repeat each other; windows that overlap themselves count
    as two starts; an empty table gives no rows; other columns do not matter. A task holds a text's words as a whole, some
    60 bytes a word.
    """
    told = without_repeats(docs).select("key", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    told = stored(told, "substring-told", tidy=True)
    rows = docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("key"))
    return rows.join(told.hint("merge"), "key").select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE_SQL = """WITH d AS (SELECT row_number() OVER () AS row_, doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
  starts AS (SELECT row_, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35),
  windows AS (SELECT row_, p, sha256(array_to_string(list_slice(w, p, p + 34), ' ')) AS h FROM starts JOIN d USING (row_)),
  twice AS (SELECT h FROM windows GROUP BY 1 HAVING count(*) > 1),
  gone AS (SELECT row_, list(DISTINCT i) AS gone FROM (SELECT row_, unnest(range(p, p + 35)) AS i FROM windows JOIN twice USING (h)) GROUP BY 1),
  kept AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, CASE WHEN gone IS NULL THEN w ELSE
    list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END AS kept FROM d LEFT JOIN gone USING (row_))
  SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM kept"""
