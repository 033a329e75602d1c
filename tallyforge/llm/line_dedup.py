"""Line dedup by an exact set-similarity join on the words of lines.

A line's tokens are its distinct words, in order of rarity over the whole corpus. Two lines with Jaccard similarity t or
more share a token among the first |x| - ceil(t|x|) + 1 of each (prefix), differ in size by at most the factor t
(length), and at their first shared token enough of either must be left (positional). Lines of one token set are one
class, of which the first line in the order of (doc_id, line) stands for all.

The join has two rounds. Rows of the first carry a token, a size, a position and 128 bits of parity of the set, which
bound the difference of two sets from below; it only finds out which classes have any candidate at which token. The
second fetches the full sets of those and counts links at the first shared token of each pair, so a link counts once
and no pair leaves a task. A token in the prefixes of very many lines is dealt to blocks that meet two by two.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _text
from ._spark import free, stored

PERCENT = 80
TABLE = 1 << 18
#: Tables of counts move in so many blocks, so that their sums are spread.
TABLE_BLOCKS = 16
SEEN_LINES = 400_000
#: A block of a hot token has about so many entries; a meeting of more than ``LARGE_MEETING`` is dealt to blocks anew.
HOT_ROWS, LARGE_MEETING = 512, 4096
ROWS_PER_SHARD, LEAST_SHARDS = 1 << 17, 8
PAIRS_AT_ONCE = 1 << 18
#: Meetings of so many rows are counted by matrices rather than by pairs.
DENSE_ROWS = 32
FILTER_BITS = 1 << 24
SALTS = 16
#: Lines without a doc_id are later than all others.
_NO_ID = 2**63 - 1
_U64 = np.uint64
_LOW40 = _U64((1 << 40) - 1)
_LINE = "doc_id long, line int, d1 long, d2 long, n_words int, tokens binary, counts binary"


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each line, its number in the row, offsets of lines) for a run of texts; an empty text is one empty line."""
    breaks = np.flatnonzero(data == 10)
    rows = np.concatenate((np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, side="right") - 1))
    starts = np.concatenate((offsets[:-1], breaks + 1))
    order = np.lexsort((rows, starts))
    rows, starts = rows[order], starts[order]
    first = np.searchsorted(rows, np.arange(len(offsets) - 1))
    return rows, np.arange(len(rows)) - first[rows], np.append(starts, len(data))


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (_text.mix64(tokens & _LOW40) >> _U64(64 - 18)).astype(np.int64)


def _table_rows(table: np.ndarray, width: int) -> Iterator[tuple[int, bytes]]:
    parts = table.reshape(TABLE_BLOCKS, -1)
    for k in np.flatnonzero(parts.any(axis=1)):
        yield int(k), parts[k].astype(f"<i{width}").tobytes()


def _adder(width: int):
    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(TABLE // TABLE_BLOCKS, dtype=np.int64)
        for x in table.column("counts").to_pylist():
            total += np.frombuffer(x, dtype=f"<i{width}")
        return pa.table({"block": table.column("block").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    return add


def _summed(parts: DataFrame, width: int) -> np.ndarray:
    """The sum of the tables that tasks left as rows (block, counts): ``TABLE`` numbers, whatever the corpus."""
    schema = "block int, counts binary"
    # in two steps, so that no task receives the tables of all tasks
    halfway = parts.withColumn("part", F.spark_partition_id() % 64).groupBy("block", "part").applyInArrow(_adder(width), schema)
    out = np.zeros((TABLE_BLOCKS, TABLE // TABLE_BLOCKS), dtype=np.int64)
    for row in halfway.groupBy("block").applyInArrow(_adder(8), schema).collect():
        out[row["block"]] = np.frombuffer(row["counts"], dtype=np.int64)
    return out.ravel()


def word_counts(docs: DataFrame) -> np.ndarray:
    """How often words of each of ``TABLE`` hash classes occur in all of ``docs``."""

    def count(batches):
        table = np.zeros(TABLE, dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in _text.chunks(batch.column("text")):
                table += np.bincount(_bucket(_text.words(data, offsets)[0]), minlength=TABLE)
        rows = list(_table_rows(table, 8))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["block", "counts"])

    return _summed(docs.select("text").mapInArrow(count, "block int, counts binary"), 8)


def prefix_length(size: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return size - (percent * size + 99) // 100 + 1


def _least_shared(sizes: np.ndarray, percent: int) -> np.ndarray:
    """The intersection that a link of two sets of so many tokens together needs at least."""
    return -(-(percent * sizes) // (100 + percent))


def _sorted_sets(data: np.ndarray, loff: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, bounds, d1, d2) of lines: distinct words as 40-bit numbers, rarest first, and a 128-bit digest of each set."""
    hashes, rows, _, _ = _text.words(data, loff)
    n = len(loff) - 1
    tokens = hashes & _LOW40
    rarity = (np.minimum(counts[_bucket(hashes)], (1 << 24) - 1).astype(np.uint64) << _U64(40)) | tokens
    order = np.argsort(rarity)
    small = rows.astype(np.uint16) if n < 1 << 16 else rows
    order = order[np.argsort(small[order], kind="stable")]
    tokens, rows = tokens[order], rows[order]
    keep = np.ones(len(tokens), dtype=bool)
    keep[1:] = (tokens[1:] != tokens[:-1]) | (rows[1:] != rows[:-1])
    tokens, rows = tokens[keep], rows[keep]
    bounds = _text.row_bounds(rows, n)
    d1, d2 = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        d1[some] = np.add.reduceat(_text.mix64(tokens ^ _U64(0x5851F42D4C957F2D)), bounds[some])
        d2[some] = np.add.reduceat(_text.mix64(tokens * _U64(0x9E3779B97F4A7C15) + _U64(77)), bounds[some])
    return tokens, bounds, d1.view(np.int64), d2.view(np.int64)


def _packed(tokens: np.ndarray, bounds: np.ndarray, wanted: np.ndarray) -> pa.Array:
    """Token sets of five bytes a token, null for rows not wanted."""
    sizes = np.where(wanted, np.diff(bounds), 0)
    raw = np.ascontiguousarray(tokens[np.repeat(wanted, np.diff(bounds))]).view(np.uint8).reshape(-1, 8)[:, :5]
    offsets = np.append(0, np.cumsum(5 * sizes)).astype(np.int64)
    valid = pa.py_buffer(np.packbits(wanted, bitorder="little").tobytes())
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(wanted), [valid, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))]).cast(pa.binary())


def _unpacked(column) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, bounds) of packed sets, none of them null."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    wide = np.zeros((len(raw) // 5, 8), dtype=np.uint8)
    wide[:, :5] = raw.reshape(-1, 5)
    return wide.view(np.uint64).ravel(), (offsets - offsets[0]) // 5


def _described(docs: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """A row for each line; its set only where the task has not lately met it. Each task's last row counts prefix tokens."""

    def describe(batches):
        table = np.zeros(TABLE, dtype=np.int64)
        seen: OrderedDict = OrderedDict()
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            for first, end, data, offsets in _text.chunks(batch.column("text")):
                rows, numbers, loff = _lines(data, offsets)
                tokens, bounds, d1, d2 = _sorted_sets(data, loff, counts)
                size = np.diff(bounds)
                new = np.zeros(len(rows), dtype=bool)
                for i, key in enumerate(zip(d1.tolist(), d2.tolist(), strict=True)):
                    if size[i]:
                        if key in seen:
                            seen.move_to_end(key)
                        else:
                            seen[key] = new[i] = True
                while len(seen) > SEEN_LINES:
                    seen.popitem(last=False)
                at, _ = _prefixes(bounds, np.flatnonzero(new), percent)
                table += np.bincount(_bucket(tokens[at]), minlength=TABLE)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, end - first).take(pa.array(rows)), pa.array(numbers, pa.int32()), pa.array(d1), pa.array(d2), pa.array(size, pa.int32()), _packed(tokens, bounds, new), pa.nulls(len(rows), pa.binary())],
                    names,
                )
        found = list(_table_rows(table, 4))
        empty = [pa.nulls(len(found), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())]
        yield pa.RecordBatch.from_arrays([empty[0], pa.array([k for k, _ in found], pa.int32()), *empty[1:], pa.array([x for _, x in found], pa.binary())], names)

    names = [x.split()[0] for x in _LINE.split(", ")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(describe, _LINE)


def _prefixes(bounds: np.ndarray, rows: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(where each prefix token of ``rows`` lies, how many each row has)."""
    size = bounds[rows + 1] - bounds[rows]
    n = prefix_length(size, percent)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(bounds[rows], n) + place, n


_FIELDS = [("key", "<u4"), ("d1", "<i8"), ("low", "<u8"), ("high", "<u8"), ("size", "<i4"), ("pos", "<i4"), ("side", "u1")]


def _parity(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, of which its tokens flip one each: two sets differ in as many tokens as bits, or in more."""
    bit = (tokens >> _U64(20)) & _U64(127)
    one = _U64(1) << (bit & _U64(63))
    return tuple(np.bitwise_xor.reduceat(np.where(half, one, _U64(0)), bounds[:-1]) for half in (bit < 64, bit >= 64))


def _may_link(low: np.ndarray, high: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    return np.bitwise_count(low[i] ^ low[j]).astype(np.int64) + np.bitwise_count(high[i] ^ high[j]) <= most


def _spread(x: dict[str, np.ndarray], blocks: np.ndarray, shards: int) -> pa.RecordBatch:
    """(shard, data) of entries whose key is dealt to ``blocks`` blocks, of which each two meet, and each meets itself."""
    many = np.repeat(np.arange(len(blocks)), blocks)
    other = np.arange(len(many)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    x = {c: v[many] for c, v in x.items()}
    block = (_text.mix64(x["d1"].view(np.uint64)) % blocks[many].astype(np.uint64)).astype(np.int64)
    meeting = (np.minimum(block, other) << 31) | np.maximum(block, other)
    mixed = _text.mix64(x["key"] + _text.mix64(meeting.astype(np.uint64)))
    shard = ((mixed >> _U64(32)) % _U64(shards)).astype(np.int64)
    # 0: the lower block of a meeting, 1: the higher one, 2: a block meeting itself
    x |= {"key": mixed & _U64(0xFFFFFFFF), "side": np.where(block == other, 2, block > other)}
    order = np.argsort(shard, kind="stable")
    ends = np.searchsorted(shard[order], np.arange(shards + 1))
    raw = [x[c][order].astype(t) for c, t in _FIELDS]
    full = np.flatnonzero(np.diff(ends))
    data = [b"".join([v[ends[s] : ends[s + 1]].tobytes() for v in raw]) for s in full]
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(data, pa.binary())], ["shard", "data"])


def _dealt(sets: DataFrame, blocks: np.ndarray, shards: int, percent: int) -> DataFrame:
    """(shard, data): prefix entries as columns of bytes. Entries of a hot token go to every meeting of their block."""

    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, bounds = _unpacked(batch.column("tokens"))
            size, d1 = np.diff(bounds), batch.column("d1").to_numpy()
            low, high = _parity(tokens, bounds)
            at, n = _prefixes(bounds, np.arange(len(size)), percent)
            row = np.repeat(np.arange(len(size)), n)
            token, pos = tokens[at], at - bounds[row]
            x = {"key": token, "d1": d1[row], "low": low[row], "high": high[row], "size": size[row], "pos": pos}
            yield _spread(x, blocks[_bucket(token)], shards)

    return sets.select("d1", "tokens").mapInArrow(deal, "shard int, data binary")


def _entries(blobs: list[bytes]) -> dict[str, np.ndarray]:
    width = sum(np.dtype(t).itemsize for _, t in _FIELDS)
    parts: dict[str, list] = {c: [] for c, _ in _FIELDS}
    for blob in blobs:
        n, at = len(blob) // width, 0
        for c, t in _FIELDS:
            parts[c].append(np.frombuffer(blob, dtype=t, count=n, offset=at))
            at += n * np.dtype(t).itemsize
    return {c: np.concatenate(x) for c, x in parts.items()}


def _pairs(key: np.ndarray, size: np.ndarray, side: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one key that pass the length filter, a bounded number at a time; entries are sorted by (key, size)."""
    mark = (key.astype(np.uint64) << _U64(32)) | size.astype(np.uint64)
    least = (key.astype(np.uint64) << _U64(32)) | ((percent * size.astype(np.int64) + 99) // 100).astype(np.uint64)
    low = np.searchsorted(mark, least)
    n = np.arange(len(key)) - low
    total = np.cumsum(n)
    a = 0
    while a < len(key):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS_AT_ONCE)))
        part = n[a:b]
        i = np.repeat(np.arange(a, b), part)
        j = np.arange(len(i)) - np.repeat(np.cumsum(part) - part, part) + np.repeat(low[a:b], part)
        ok = (side[i] == 2) | (side[i] != side[j])
        yield i[ok], j[ok]
        a = b


_OPEN = "meeting long, d1 long, pos int, side int, low long, high long, size int, m int"


def _searched(dealt: DataFrame, shards: int, percent: int, final: bool) -> DataFrame:
    """Entries that have a candidate in their meeting by all filters, m null; with their m those of large meetings."""

    def search(shard: int, blobs: list[bytes]) -> pa.RecordBatch:
        x = _entries(blobs)
        order = np.lexsort((x["d1"], x["size"], x["key"]))
        x = {c: v[order] for c, v in x.items()}
        same = (x["key"][1:] == x["key"][:-1]) & (x["size"][1:] == x["size"][:-1]) & (x["d1"][1:] == x["d1"][:-1])
        keep = np.append(True, ~same)
        x = {c: v[keep] for c, v in x.items()}
        m = np.unique(x["key"], return_inverse=True, return_counts=True)[1:]
        m = m[1][m[0]]
        large = (m > LARGE_MEETING) & (x["side"] == 2) & (not final)
        found = large.copy()
        here = np.flatnonzero(~large)
        y = {c: v[here] for c, v in x.items()}
        size, pos = y["size"].astype(np.int64), y["pos"].astype(np.int64)
        for i, j in _pairs(y["key"], size, y["side"], percent):
            need = _least_shared(size[i] + size[j], percent)
            ok = np.minimum(size[i] - pos[i], size[j] - pos[j]) >= need
            i, j, need = i[ok], j[ok], need[ok]
            ok = _may_link(y["low"], y["high"], i, j, size[i] + size[j] - 2 * need)
            found[here[i[ok]]] = True
            found[here[j[ok]]] = True
        x = {c: v[found] for c, v in x.items()}
        x["meeting"] = (np.int64(shard) << 32) | x["key"].astype(np.int64)
        columns = [pa.array(x[c].view(np.int64) if c in ("low", "high") else x[c].astype(t)) for c, t in zip(names[:-1], (np.int64, np.int64, np.int32, np.int32, None, None, np.int32), strict=True)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(m[found].astype(np.int32), mask=~large[found])], names)

    def work(batches):
        now, blobs = None, []
        for batch in batches:
            for shard, data in zip(batch.column("shard").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if shard != now and blobs:
                    yield search(now, blobs)
                    blobs = []
                now = shard
                blobs.append(data)
        if blobs:
            yield search(now, blobs)

    names = [x.split()[0] for x in _OPEN.split(", ")]
    return dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(work, _OPEN)


def _open(dealt: DataFrame, shards: int, percent: int) -> DataFrame:
    """(meeting, d1, pos, side) of all entries that have a candidate; large meetings are split by their own size first."""
    once = stored(_searched(dealt, shards, percent, final=False), "line-open")
    found, large = (once.filter(x).select("meeting", "d1", "pos", "side") for x in ("m IS NULL", "m IS NOT NULL"))
    if large.isEmpty():
        return found

    def deal(batches):
        for batch in batches:
            x = {c: batch.column(c).to_numpy() for c in ("meeting", "d1", "low", "high", "size", "pos", "m")}
            x |= {"key": x.pop("meeting").view(np.uint64), "low": x["low"].view(np.uint64), "high": x["high"].view(np.uint64)}
            yield _spread(x, -(-x.pop("m").astype(np.int64) // HOT_ROWS), shards)

    further = _searched(once.filter("m IS NOT NULL").mapInArrow(deal, "shard int, data binary"), shards, percent, final=True)
    # the keys of both rounds are hashes; the second's are told apart by their sign
    return stored(found.unionByName(further.select((-1 - F.col("meeting")).alias("meeting"), "d1", "pos", "side")), "line-open")


def _sets_of(sets: DataFrame, open_: DataFrame) -> DataFrame:
    """The distinct sets that may be in ``open_``, screened by a bitmap of fixed size before they move."""

    def place(d1: np.ndarray) -> np.ndarray:
        return (_text.mix64(d1.view(np.uint64)) % _U64(FILTER_BITS)).astype(np.int64)

    def mark(batches):
        bits = np.zeros(FILTER_BITS, dtype=bool)
        for batch in batches:
            bits[place(batch.column("d1").to_numpy())] = True
        parts = np.packbits(bits).reshape(64, -1)
        full = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([parts[k].tobytes() for k in full], pa.binary())], ["block", "bits"])

    def either(table: pa.Table) -> pa.Table:
        total = np.zeros(FILTER_BITS // 64 // 8, dtype=np.uint8)
        for x in table.column("bits").to_pylist():
            total |= np.frombuffer(x, dtype=np.uint8)
        return pa.table({"block": table.column("block").slice(0, 1), "bits": pa.array([total.tobytes()], pa.binary())})

    marks = open_.select("d1").mapInArrow(mark, "block int, bits binary").withColumn("part", F.spark_partition_id() % 64)
    marks = marks.groupBy("block", "part").applyInArrow(either, "block int, bits binary").groupBy("block").applyInArrow(either, "block int, bits binary")
    packed = np.zeros((64, FILTER_BITS // 64 // 8), dtype=np.uint8)
    for row in marks.collect():
        packed[row["block"]] = np.frombuffer(row["bits"], dtype=np.uint8)
    packed = packed.ravel()

    def screen(batches):
        for batch in batches:
            at = place(batch.column("d1").to_numpy())
            yield batch.filter(pa.array((packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1))

    return sets.select("d1", "d2", "tokens").mapInArrow(screen, "d1 long, d2 long, tokens binary").dropDuplicates(["d1", "d2"])


class _Members:
    """Which tokens which rows have, to count what pairs of rows share."""

    def __init__(self, tokens: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        row = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
        self.tokens, self.starts, self.sizes = tokens, starts, sizes
        self.marks = np.sort(_text.mix64(tokens[at] + _text.mix64(row.astype(np.uint64))))

    def shared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if not len(self.marks):
            return np.zeros(len(i), dtype=np.int64)
        if len(i) > PAIRS_AT_ONCE // 8:
            return np.concatenate([self.shared(i[a : a + PAIRS_AT_ONCE // 8], j[a : a + PAIRS_AT_ONCE // 8]) for a in range(0, len(i), PAIRS_AT_ONCE // 8)])
        n = self.sizes[i]
        pair = np.repeat(np.arange(len(i)), n)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[i], n)
        wanted = _text.mix64(self.tokens[at] + _text.mix64(j[pair].astype(np.uint64)))
        hit = self.marks[np.minimum(np.searchsorted(self.marks, wanted), len(self.marks) - 1)] == wanted
        return np.bincount(pair[hit], minlength=len(i))


def _all_pairs(tokens: np.ndarray, starts: np.ndarray, size: np.ndarray, pos: np.ndarray, percent: int) -> np.ndarray | None:
    """Which rows of a meeting are links that share no token before ``pos``, by a product of matrices; None if too large."""
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size)
    row = np.repeat(np.arange(len(size)), size)
    found, column = np.unique(tokens[at], return_inverse=True)
    if len(size) * max(len(size), len(found)) > 1 << 24:
        return None
    early = at - starts[row] < pos[row]
    shared = []
    for part in (slice(None), early):
        has = np.zeros((len(size), len(found)), dtype=np.float32)
        has[row[part], column[part]] = 1
        shared.append(has @ has.T)
    return (shared[0] >= _least_shared(size[:, None] + size, percent)) & (shared[1] == 0)


def _linked(rows: DataFrame, percent: int) -> DataFrame:
    """(d1, d2, links, earlier) from rows of (meeting, pos, side, d1, d2, first_doc, first_line, tokens), sorted by meeting."""

    def count(table: pa.Table) -> pa.RecordBatch:
        tokens, bounds = _unpacked(table.column("tokens").combine_chunks())
        key = np.unique(table.column("meeting").to_numpy(), return_inverse=True)[1]
        order = np.lexsort((np.diff(bounds), key))
        pos, side, d1, d2, doc, line = (table.column(c).to_numpy()[order] for c in ("pos", "side", "d1", "d2", "first_doc", "first_line"))
        key, starts, size, pos = key[order], bounds[:-1][order], np.diff(bounds)[order], pos.astype(np.int64)
        low, high = (x[order] for x in _parity(tokens, bounds))
        rank = np.empty(len(size), dtype=np.int64)
        rank[np.lexsort((line, doc))] = np.arange(len(size))
        links, earlier = np.zeros(len(size), dtype=np.int64), np.zeros(len(size), dtype=np.int64)
        ends = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
        sparse = np.ones(len(key), dtype=bool)
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            if b - a >= DENSE_ROWS and (met := _all_pairs(tokens, starts[a:b], size[a:b], pos[a:b], percent)) is not None:
                sparse[a:b] = False
                met &= (side[a:b, None] == 2) | (side[a:b, None] != side[a:b])
                met &= (d1[a:b, None] != d1[a:b]) | (d2[a:b, None] != d2[a:b])
                links[a:b] = met.sum(axis=1)
                earlier[a:b] = (met & (rank[a:b] < rank[a:b, None])).sum(axis=1)
        at = np.flatnonzero(sparse)
        key, side, low, high, d1_, d2_, starts, size, pos = (x[at] for x in (key, side, low, high, d1, d2, starts, size, pos))
        before, whole = _Members(tokens, starts, pos), _Members(tokens, starts, size)
        for i, j in _pairs(key, size, side, percent):
            need = _least_shared(size[i] + size[j], percent)
            ok = (np.minimum(size[i] - pos[i], size[j] - pos[j]) >= need) & _may_link(low, high, i, j, size[i] + size[j] - 2 * need)
            ok = np.flatnonzero(ok & ((d1_[i] != d1_[j]) | (d2_[i] != d2_[j])))
            i, j, need = i[ok], j[ok], need[ok]
            # a pair that shares a rarer token counts where it meets by that one
            first = before.shared(i, j) == 0
            i, j, need = i[first], j[first], need[first]
            linked = whole.shared(i, j) >= need
            i, j = at[i[linked]], at[j[linked]]
            np.add.at(links, np.concatenate((i, j)), 1)
            np.add.at(earlier, np.where(rank[i] < rank[j], j, i), 1)
        some = links > 0
        return pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (d1, d2, links, earlier)], ["d1", "d2", "links", "earlier"])

    def work(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(x.nbytes for x in held) < 4 << 20:
                continue
            table = pa.Table.from_batches(held)
            last = int(np.searchsorted(table.column("meeting").to_numpy(), table.column("meeting")[-1].as_py()))
            if last:
                yield count(table.slice(0, last))
                held = table.slice(last).to_batches()
        if held:
            yield count(pa.Table.from_batches(held))

    return rows.mapInArrow(work, "d1 long, d2 long, links long, earlier long")


def lines_of(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per line: doc_id, line (from 0), first_doc_id and first_line of its class, links, kept.

    Lines end at line feeds. A line goes if an earlier one in the order of (doc_id, line), kept or not, has a similarity
    of ``percent`` or more; ``links`` counts the other classes at that similarity to its own.

    Defined cases: a line without words (and a null or empty text, which is one such line) is linked with nothing and
    stays, its class being itself; rows of one doc_id that have the same line at the same number share its fate; rows
    without doc_id come last and their lines are later than equal ones; an empty table gives no rows; other columns do
    not matter; a line of any length is one set.
    """
    docs = docs.select("doc_id", "text")
    described = stored(_described(docs, word_counts(docs), percent), "line-sets")
    prefixes = _summed(described.filter("counts IS NOT NULL").select(F.col("line").alias("block"), "counts"), 4)
    lines = described.filter("counts IS NULL").drop("counts")
    sets = lines.filter("tokens IS NOT NULL")
    # what a hash class has beyond the usual is taken for that of one token
    blocks = np.maximum(1, -(-(prefixes - 4 * int(prefixes.mean())) // HOT_ROWS))
    # an entry goes to every meeting of its block
    shards = max(LEAST_SHARDS, math.ceil(int((prefixes * blocks).sum()) / ROWS_PER_SHARD))
    open_ = _open(_dealt(sets, blocks, shards, percent), shards, percent)
    per_doc = F.lit(2**31).cast("decimal(11,0)")
    place = F.coalesce(F.col("doc_id"), F.lit(_NO_ID)).cast("decimal(20,0)") * per_doc + F.col("line")
    classes = lines.filter("n_words > 0").groupBy("d1", "d2").agg(F.min(place).alias("_place"), F.count("*").alias("n"))
    classes = classes.withColumn("first_line", F.pmod("_place", per_doc).cast("int"))
    classes = stored(classes.select("d1", "d2", "n", ((F.col("_place") - F.col("first_line")) / per_doc).cast("long").alias("first_doc"), "first_line"), "line-classes")
    rows = open_.join(_sets_of(sets, open_), "d1").join(classes, ["d1", "d2"])
    counted = stored(_linked(rows.repartition("meeting").sortWithinPartitions("meeting"), percent), "line-links")
    counted = counted.groupBy("d1", "d2").agg(F.sum("links").alias("links"), F.sum("earlier").alias("earlier"))
    classes = classes.join(counted, ["d1", "d2"], "left").withColumn("links", F.coalesce("links", F.lit(0).cast("long"))).withColumn("_stays", F.coalesce("earlier", F.lit(0)) == 0)
    # a class of one line is that line; the lines of others find theirs by a salted key
    salted = classes.filter("n > 1").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select("d1", "d2", "_salt", "first_doc", "first_line", "links", "_stays")
    single = classes.filter("n = 1").select(_id("first_doc").alias("doc_id"), F.col("first_line").alias("line"), "first_doc", "first_line", "links", "_stays")
    words = lines.filter("n_words > 0").select("doc_id", "line", "d1", "d2").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "line"), F.lit(SALTS)).cast("int"))
    found = words.join(salted, ["d1", "d2", "_salt"]).select("doc_id", "line", "first_doc", "first_line", "links", "_stays").unionByName(single)
    kept = F.col("_stays") & (F.coalesce("doc_id", F.lit(_NO_ID)) == F.col("first_doc")) & (F.col("line") == F.col("first_line"))
    found = found.select("doc_id", "line", _id("first_doc").alias("first_doc_id"), "first_line", "links", kept.alias("kept"))
    blank = lines.filter("n_words = 0").select("doc_id", "line", F.col("doc_id").alias("first_doc_id"), F.col("line").alias("first_line"), F.lit(0).cast("long").alias("links"), F.lit(True).alias("kept"))
    return found.unionByName(blank)


def _id(column: str):
    return F.when(F.col(column) != _NO_ID, F.col(column))


def remove(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with the lines that go taken out of ``text``, and ``removed_lines``, their number; all rows stay.

    A column named ``removed_lines`` is replaced, any others are kept, whatever they are called.
    """
    docs = docs.drop("removed_lines")
    own, gone = free(docs, "line_doc", "gone")
    lines = lines_of(docs, percent).filter("NOT kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.collect_set("line").alias(gone)).withColumnRenamed("doc_id", own)
    joined = docs.join(lines, F.col("doc_id") == F.col(own), "left")
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(gone, i)), "\n")
    joined = joined.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(left))
    return joined.withColumn("removed_lines", F.coalesce(F.array_size(gone), F.lit(0))).drop(gone, own)


#: Prefixes of 80 percent in the order of (number of lines that have a word, word); a plain join on them is exact.
ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(range(len(s)))::INT AS line, unnest(s) AS t
  FROM (SELECT doc_id, string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10)) AS s FROM documents)),
w AS (SELECT doc_id, line, list_sort(list_distinct(regexp_extract_all(t, '[^ 	-
]+'))) AS s FROM l),
c AS (SELECT s, min((doc_id, line)) AS f, row_number() OVER (ORDER BY min((doc_id, line))) AS id FROM w WHERE len(s) > 0 GROUP BY s),
t AS (SELECT id, len(s) AS m, unnest(s) AS x FROM c),
n AS (SELECT x, count(*) AS n FROM t GROUP BY x),
p AS (SELECT id, m, x FROM (SELECT id, m, t.x, row_number() OVER (PARTITION BY id ORDER BY n, t.x) AS r FROM t JOIN n ON t.x = n.x) WHERE r <= m - (80 * m + 99) // 100 + 1),
k AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.x = b.x AND a.id < b.id AND 100 * least(a.m, b.m) >= 80 * greatest(a.m, b.m)),
e AS (
  SELECT a, b FROM (SELECT a, b, len(list_intersect(x.s, y.s)) AS i, len(x.s) + len(y.s) AS u FROM k JOIN c x ON x.id = a JOIN c y ON y.id = b)
  WHERE 100 * i >= 80 * (u - i)),
g AS (SELECT id, count(*) AS links, count(*) FILTER (WHERE other < id) AS earlier FROM (SELECT a AS id, b AS other FROM e UNION ALL SELECT b, a FROM e) GROUP BY id)
SELECT w.doc_id, w.line, coalesce(c.f[1], w.doc_id) AS first_doc_id, coalesce(c.f[2], w.line)::INT AS first_line, coalesce(g.links, 0)::BIGINT AS links,
  len(w.s) = 0 OR (coalesce(g.earlier, 0) = 0 AND c.f = (w.doc_id, w.line)) AS kept
FROM w LEFT JOIN c ON w.s = c.s LEFT JOIN g ON c.id = g.id
"""
