"""Removal of repeated byte strings by threshold-bounded interval expansion on Burrows-Wheeler transforms.

Every window of `length` bytes is filed under its anchor, the least hash among its 32-byte grams,
so equal windows always meet, whatever stands around them.  Consecutive windows with the same gram are
a segment.  Anchors that occur once are dropped.  Of segments with equal bytes the first place stays
and the others go as a whole: those within a batch of documents at once, so that a passage that very
many documents share is one row for each batch, and the rest where their anchors meet.

The bytes of segments whose anchor has others are cut from the documents of their first places and
laid end to end, and a breadth-first backward extension on the transform of that text finds the
ends of the intervals of suffixes that share 1, 2, 3 ... bytes.  It stops at `length`: what no end
divides shares that much, and of such windows all but the first go.

An anchor with more segments than one transform should hold is dealt anew: its segments are cut
again by the least hash of grams twice as long, as often as that is needed.  Grams as long as a
window end this, since segments that share one are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, materialize, n_partitions, returned

LENGTH = 100
GRAM = 32
#: Bytes hashed at once, bytes in one transform.
STEP, TRANSFORM = 1 << 18, 1 << 18
#: Segments of one anchor that one transform takes; those of fuller anchors are cut again by longer grams.
FULL = 2_000
#: Bits of the filter that keeps most anchors that occur once out of the shuffle; its size is fixed.
FILTER_BITS = 27

ANCHOR_BITS = 60
PLACE_BITS = 20
#: Bits of an anchor that name its bucket where anchors are counted, at least.
BUCKET_BITS = 12

_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_TURN = np.random.default_rng(8).integers(1, 1 << 63, 48, dtype=np.uint64) | np.uint64(1)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the gram bytes from each place of data (uint8) that has so many."""
    h = _BYTE[data]
    size = 1
    for turn in _TURN:
        step = min(size, gram - size)
        if not step:
            break
        h = (h[:-step] * turn) ^ h[step:]
        h ^= h >> np.uint64(31)
        h *= turn
        size += step
    return h ^ (h >> np.uint64(29))


def anchors(hashes: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window of so many grams, and its gram's place.

    Of equal least hashes the leftmost counts, so that a window that occurs twice has two places.
    Hashes are compared by their upper bits, above those that hold a place here.
    """
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while size < span:
        step = min(size, span - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    place = (least & low).astype(np.int64)
    return (hashes >> np.uint64(64 - ANCHOR_BITS))[place], place


def gram_sizes(length: int) -> list[int]:
    """Sizes of the grams of each round of dealing, up to a whole window."""
    sizes = [min(GRAM, length)]
    while sizes[-1] < length:
        sizes.append(min(2 * sizes[-1], length))
    return sizes


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], bytes]]:
    """Runs of texts, long ones in overlapping parts: (indices, offsets of the parts, bytes)."""
    which, offsets, parts, held = [], [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(0, len(text) - length + 1), STEP):
            part = text[at : at + STEP + length - 1]
            if held and held + len(part) > STEP + length:
                yield which, offsets, parts
                which, offsets, parts, held = [], [], [], 0
            which.append(i)
            offsets.append(at)
            parts.append(part)
            held += len(part)
    if parts:
        yield which, offsets, parts


def segments(texts: list[bytes], length: int, gram: int, wanted=None) -> Iterator[tuple]:
    """Segments of texts: (text index, start, windows, anchor, all bytes of this run, place there).

    All but the bytes are arrays.  wanted, if given, takes an array of anchors and says which to keep.
    """
    for which, offsets, parts in _pieces(texts, length):
        joined = b"".join(parts)
        sizes = np.array([len(p) for p in parts])
        first = np.cumsum(sizes) - sizes
        hashes = gram_hashes(np.frombuffer(joined, np.uint8), gram)
        anchor, place = anchors(hashes, length - gram + 1)
        begins = np.zeros(len(anchor) + 1, bool)
        begins[1:-1] = place[1:] != place[:-1]
        begins[first] = True
        closed = first + sizes - length + 1  # one after the last window of each part
        begins[np.minimum(closed, len(anchor))] = True
        at = np.flatnonzero(begins[:-1])
        n = np.diff(np.append(at, len(anchor)))
        part = np.searchsorted(first, at, side="right") - 1
        keep = at < closed[part]
        if wanted is not None:
            keep &= wanted(anchor[at])
        at, n, part = at[keep], n[keep], part[keep]
        yield np.array(which)[part], at - first[part] + np.array(offsets)[part], n, anchor[at], joined, at


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of text by their first depth symbols at least; text has symbols 0 to 256, 0 ends a part."""
    n = len(text)
    wide = np.zeros(n + 6, np.int64)
    wide[:n] = text
    rank = np.zeros(n, np.int64)
    for k in range(7):
        rank = rank << 9 | wide[k : k + n]
    size, order = 7, np.argsort(rank)
    # suffixes that are equal so far have the place of the first of them as rank
    new = np.r_[True, np.diff(rank[order]) != 0]
    tied = np.arange(n)
    rank = np.zeros(n, np.int64)
    while True:
        first = tied[new][np.cumsum(new) - 1]
        rank[order[tied]] = first + 1
        tied = tied[~(new & np.r_[new[1:], True])]
        if size >= depth or not len(tied):
            return order
        own = order[tied]
        onward = np.where(own + size < n, rank[np.minimum(own + size, n - 1)], 0)
        key = rank[own] * (n + 1) + onward
        by = np.argsort(key)
        order[tied] = own[by]
        new = np.r_[True, np.diff(key[by]) != 0]
        size *= 2


def interval_ends(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether a suffix in order begins an interval: it shares less than length symbols with the one before.

    Breadth-first by the number of shared symbols: the intervals of suffixes that begin with a
    string of k symbols give those of k + 1 by all symbols that stand before them in the text.
    An interval is only extended when it has set a new end, so that each end is paid for once.
    """
    n = len(text)
    before = text[order - 1].astype(np.int16)  # the transform
    back = np.argsort(before, kind="stable").astype(np.int32)  # where the suffixes stand that are one shorter
    symbols = before[back]
    step = np.empty(n, np.int32)  # where the suffix that is one longer stands
    step[back] = np.arange(n, dtype=np.int32)
    ends = np.zeros(n + 1, bool)
    ends[0] = ends[n] = True
    lo, hi = np.array([0]), np.array([n])
    for _ in range(length):
        size = hi - lo
        numbers = np.arange(1, len(lo) + 1, dtype=np.int32)
        if size.sum() > n // 16:  # look at all places, in the order of the longer suffixes
            change = np.zeros(n + 1, np.int32)
            change[lo] += numbers
            change[hi] -= numbers
            own = np.cumsum(change[:-1], dtype=np.int32)[back]
            longer = np.flatnonzero((own != 0) & (symbols != 0))  # nothing goes over the end of a part
            own = own[longer]
        else:  # sort the few that are inside
            where = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
            own = np.repeat(numbers, size)
            part = before[where] != 0
            longer, own = step[where[part]], own[part]
            by = np.argsort(longer)
            longer, own = longer[by], own[by]
        if not len(longer):
            break
        symbol = symbols[longer]
        first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (symbol[1:] != symbol[:-1])])
        new_lo, new_hi = longer[first], longer[np.append(first[1:], len(longer)) - 1] + 1
        fresh = ~ends[new_hi]
        ends[new_hi] = True
        ends[new_lo] = True
        lo, hi = new_lo[fresh], new_hi[fresh]
        if not len(lo):
            break
    return ends[:n]


def _documents(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, and its bytes; documents stand in line by the first two."""
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("bytes"))
    return rows.select("doc_id", F.hash("bytes").alias("h"), "bytes")


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column(batch.schema.get_field_index("bytes")).to_pylist()


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(key, rows) of runs of batches by their first column, which is sorted."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        key = np.asarray(batch.column(0))
        starts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for lo, hi in zip(starts, starts[1:], strict=False):
            if lo == hi:
                continue
            if held and key[lo] != now:
                yield now, held
                held = []
            now = key[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield now, held


def repeated_anchors(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """anchor: the anchors of two segments at least.  docs has bytes.

    Tasks ship their anchors as packed arrays by bucket, twice if they have met them twice.
    """
    n = n_partitions(docs.sparkSession)
    bits = min(24, max(BUCKET_BITS, int(np.ceil(np.log2(4 * n)))))
    width = -(-(ANCHOR_BITS - bits) // 8)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s[3] for s in segments(_texts(batch), length, min(GRAM, length))]
            if not found:
                continue
            every = np.sort(np.concatenate(found))
            # no more than two of each
            every = every[np.r_[True, True, every[2:] != every[:-2]][: len(every)]]
            bucket = (every >> np.uint64(ANCHOR_BITS - bits)).astype(np.int64)
            low = every.view(np.uint8).reshape(-1, 8)[:, :width]
            at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            parts = [low[a:b].tobytes() for a, b in zip(at, [*at[1:], len(every)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array(parts, pa.binary())], ["bucket", "low"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_key(batches):
            raw = b"".join(x for r in rows for x in r.column(1).to_pylist())
            wide = np.zeros((len(raw) // width, 8), np.uint8)
            wide[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
            low = np.sort(wide.reshape(-1).view(np.uint64) & np.uint64((1 << (ANCHOR_BITS - bits)) - 1))
            twice = np.unique(low[1:][low[1:] == low[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array((np.uint64(bucket) << np.uint64(ANCHOR_BITS - bits) | twice).astype(np.int64))], ["anchor"])

    packed = docs.mapInArrow(pack, "bucket long, low binary").repartition(n, "bucket").sortWithinPartitions("bucket")
    return packed.mapInArrow(count, "anchor long")


def anchor_filter(found: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit map of 2**bits places with the places of the anchors set; others may share them.

    Its size is fixed.  It is put together in tasks, block by block, and only saves shuffling.
    """
    block = max(0, bits - 9)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _by_key(batches):
            bit = np.zeros(1 << block, np.uint8)
            for r in rows:
                bit[np.asarray(r.column(1)) & ((1 << block) - 1)] = 1
            yield pa.RecordBatch.from_pydict({"block": [int(key)], "bits": [np.packbits(bit).tobytes()]})

    place = F.col("anchor").bitwiseAND(F.lit((1 << bits) - 1))
    placed = found.select(F.shiftright(place, block).alias("block"), place.alias("place"))
    n = n_partitions(found.sparkSession)
    rows = placed.repartition(n, "block").sortWithinPartitions("block").mapInArrow(fill, "block long, bits binary").collect()
    out = np.zeros((1 << (bits - block), (1 << block) // 8), np.uint8)
    for r in rows:  # 512 at most
        out[r.block] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def _test(filter_bits: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    place = anchor & np.uint64(len(filter_bits) * 8 - 1)
    return (filter_bits[place >> np.uint64(3)] >> (7 - (place & np.uint64(7)).astype(np.uint8))) & 1 == 1


#: A segment, or a range of windows to go if seg is null; its bytes if they are at hand, and in facts its number
#: among the segments of its anchor.
SEGMENTS = "anchor long, seg long, doc_id long, h int, start long, windows int, body binary"
FACTS = SEGMENTS + ", number int"
RANGES = "doc_id long, h int, lo long, hi long"


def _batch(anchor, seg, doc, h, start, windows, body=None, number=None) -> pa.RecordBatch:
    n = len(doc)
    seg = pa.nulls(n, pa.int64()) if seg is None else pa.array(seg, pa.int64())
    body = pa.nulls(n, pa.binary()) if body is None else body
    cols = [pa.array(anchor, pa.int64()), seg, pa.array(doc, pa.int64()), pa.array(h, pa.int32()), pa.array(start, pa.int64())]
    cols += [pa.array(windows, pa.int32()), body]
    names = ["anchor", "seg", "doc_id", "h", "start", "windows", "body"]
    if number is not None:
        cols, names = [*cols, pa.array(number, pa.int32())], [*names, "number"]
    return pa.RecordBatch.from_arrays(cols, names)


def _bodies_of(found: tuple, length: int) -> list[bytes]:
    _, _, n, _, joined, at = found
    return [joined[a:b] for a, b in zip(at.tolist(), (at + n + length - 1).tolist(), strict=True)]


def _kept_segments(docs: DataFrame, length: int, found: DataFrame) -> DataFrame:
    """The segments of docs whose anchor the filter lets through, the first of equal ones in a batch, and ranges for the others."""
    from xxhash import xxh3_64_intdigest

    known = docs.sparkSession.sparkContext.broadcast(anchor_filter(found))
    gram = min(GRAM, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = lambda a: _test(known.value, a)
        for batch in batches:
            ids, h, texts = np.asarray(batch.column(0)), np.asarray(batch.column(1)), _texts(batch)
            line = np.lexsort((h, ids))
            parts = []
            for part in segments([texts[i] for i in line.tolist()], length, gram, wanted):
                body = _bodies_of(part, length)
                parts.append((*part[:4], np.fromiter(map(xxh3_64_intdigest, body), np.uint64, len(body))))
            if not parts:
                continue
            which, start, n, anchor, seg = (np.concatenate(x) for x in zip(*parts, strict=True))
            doc, h = ids[line][which], h[line][which]
            # rows stand in the order of their places, so the first of equal segments is the first row
            key = seg * _TURN[0] ^ anchor
            by = np.argsort(key, kind="stable")
            head = np.r_[True, key[by][1:] != key[by][:-1]]
            first = np.empty(len(by), np.int64)
            first[by] = by[head][np.cumsum(head) - 1]
            own = np.arange(len(by))
            yield _batch(*(x[own == first] for x in (anchor.view(np.int64), seg.view(np.int64), doc, h, start, n)))
            late = np.flatnonzero((doc != doc[first]) | (h != h[first]) | (start != start[first]))
            if len(late):
                doc, h, lo, hi = doc[late], h[late], start[late], start[late] + n[late]
                new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]) | (lo[1:] != hi[:-1])])
                hi = hi[np.append(new[1:], len(late)) - 1]
                yield _batch(doc[new] * 31 + h[new], None, doc[new], h[new], lo[new], hi - lo[new])

    return docs.mapInArrow(run, SEGMENTS)


def _segments_of(bodies: DataFrame, length: int, gram: int) -> DataFrame:
    """The segments that grams of another size cut segments into, with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            ids, h, start = (np.asarray(batch.column(k)) for k in (2, 3, 4))
            for part in segments(batch.column(6).to_pylist(), length, gram):
                which, at, n, anchor, _, _ = part
                body = _bodies_of(part, length)
                seg = np.fromiter(map(xxh3_64_intdigest, body), np.uint64, len(body))
                yield _batch(
                    anchor.view(np.int64), seg.view(np.int64), ids[which], h[which], start[which] + at, n, pa.array(body, pa.binary())
                )

    return bodies.mapInArrow(run, SEGMENTS)


def _first_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows of SEGMENTS sorted by anchor, segment and place: the first places of segments whose anchor has others, and ranges.

    Rows are looked at once, and nothing is held but the last of them.
    """
    last = None  # anchor, segment, its first place, number
    pending: pa.RecordBatch | None = None  # the first segment of an anchor, until another one comes
    for batch in batches:
        if not batch.num_rows:
            continue
        is_range = batch.column(1).is_null().to_numpy(zero_copy_only=False)
        if is_range.any():
            part = batch.filter(pa.array(is_range))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.nulls(part.num_rows, pa.int32())], [*part.schema.names, "number"])
            batch = batch.filter(pa.array(~is_range))
            if not batch.num_rows:
                continue
        anchor, seg, doc, h, start, windows = (batch.column(k).to_numpy() for k in range(6))
        n = len(anchor)
        old = last or (None, None, None, None, None, -1)
        new_anchor = np.r_[last is None or anchor[0] != old[0], anchor[1:] != anchor[:-1]]
        new = new_anchor | np.r_[last is None or seg[0] != old[1], seg[1:] != seg[:-1]]
        at = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        place = [np.where(at >= 0, x[at], -1 if o is None else o) for x, o in ((doc, old[2]), (h, old[3]), (start, old[4]))]
        late = np.flatnonzero(~new & ((doc != place[0]) | (h != place[1]) | (start != place[2])))
        if len(late):
            yield _batch(anchor[late], None, doc[late], h[late], start[late], windows[late], None, np.zeros(len(late), np.int32))
        number = np.cumsum(new) - 1
        base = np.maximum.accumulate(np.where(new_anchor, number, -1))
        number = np.where(base >= 0, number - base, number + old[5] + 1)
        last = (anchor[-1], seg[-1], place[0][-1], place[1][-1], place[2][-1], int(number[-1]))
        facts = np.flatnonzero(new)
        if not len(facts):
            continue
        num = number[facts]
        rows = batch.take(pa.array(facts))
        rows = pa.RecordBatch.from_arrays([*rows.columns, pa.array(num, pa.int32())], [*rows.schema.names, "number"])
        if pending is not None:
            if num[0]:
                yield pending
            pending = None
        if num[-1] == 0:
            pending = rows.slice(len(facts) - 1)
            rows, num = rows.slice(0, len(facts) - 1), num[:-1]
            alone = (num == 0) & (np.r_[num[1:], 0] == 0)
        else:
            alone = (num == 0) & (np.r_[num[1:], 1] == 0)
        yield rows.filter(pa.array(~alone))


def _bodies(docs: DataFrame, facts: DataFrame, length: int) -> DataFrame:
    """facts with the bytes of each segment, cut from the document of its first place.

    A document that docs repeats gives its segments as often.
    """
    lists = [F.collect_list(c).alias(c) for c in ("anchor", "seg", "start", "windows", "number")]
    by_doc = facts.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(*lists)
    rows = docs.join(by_doc, (F.col("doc_id") == F.col("_id")) & (F.col("h") == F.col("_h")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                lists = [batch.column(k) for k in range(3, 8)]
                own = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists[0].offsets)))
                anchor, seg, start, windows, number = (x.flatten() for x in lists)
                texts = _texts(batch)
                lo, ends = np.asarray(start), np.asarray(start) + np.asarray(windows) + length - 1
                body = [texts[i][a:b] for i, a, b in zip(own.tolist(), lo.tolist(), ends.tolist(), strict=True)]
                ids, h = (np.asarray(batch.column(k))[own] for k in (0, 1))
                yield _batch(anchor, np.asarray(seg), ids, h, start, windows, pa.array(body, pa.binary()), number)

    return rows.select("doc_id", "h", "bytes", "anchor", "seg", "start", "windows", "number").mapInArrow(run, FACTS)


def later_windows(data: np.ndarray, sizes: np.ndarray, windows: np.ndarray, age: np.ndarray, start: np.ndarray, length: int):
    """(segment, first window, last window) arrays of runs of windows that also begin earlier in these segments.

    data holds the segments' bytes one after the other; age is the rank of their documents.
    """
    n = len(sizes)
    own = np.repeat(np.arange(n), sizes + 1)
    first = np.cumsum(sizes + 1) - sizes - 1
    place = np.arange(len(own)) - first[own]
    text = np.zeros(len(own), np.int64)
    text[place < sizes[own]] = data.astype(np.int64) + 1  # a zero ends each segment
    order = suffix_order(text, length)
    group = np.cumsum(interval_ends(text, order, length))
    whole = place[order] < windows[own[order]]
    at, group = order[whole], group[whole]
    when = age[own[at]] << 40 | (start[own[at]] + place[at])
    head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    oldest = np.repeat(np.minimum.reduceat(when, head), np.diff(np.append(head, len(when))))
    late = np.sort(at[when > oldest])
    if not len(late):
        return late, late, late
    cut = np.flatnonzero(np.r_[True, np.diff(late) != 1])
    lo, hi = late[cut], late[np.append(cut[1:], len(late)) - 1]
    return own[lo], place[lo], place[hi]


def _whole_anchors(batches: Iterator[pa.RecordBatch], enough: int) -> Iterator[pa.Table]:
    """Tables of whole anchors, in their order, that have enough bytes each."""
    held: list[pa.RecordBatch] = []
    now, size = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.asarray(batch.column(0))
        ends = np.cumsum(pc.binary_length(batch.column(6)).to_numpy(zero_copy_only=False))
        starts = np.flatnonzero(np.r_[key[0] != now, key[1:] != key[:-1]])
        at, base = 0, 0
        for s in starts.tolist():
            upto = int(ends[s - 1]) if s else 0
            if size + upto - base > enough:
                if s > at:
                    held.append(batch.slice(at, s - at))
                yield pa.Table.from_batches(held)
                held, size, at, base = [], 0, s, upto
        held.append(batch.slice(at))
        size += int(ends[-1]) - base
        now = key[-1]
    if held:
        yield pa.Table.from_batches(held)


def _transform_tasks(length: int, transform: int):
    """Ranges of windows that begin earlier, from rows of FACTS sorted by anchor and segment."""

    def found(table: pa.Table) -> pa.RecordBatch:
        anchor, seg, doc, h, start, windows = (table.column(k).to_numpy() for k in range(6))
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | (seg[1:] != seg[:-1])]  # a repeated document gives rows again
        body = table.column(6)
        if not new.all():
            body = body.filter(pa.array(new))
            doc, h, start, windows = doc[new], h[new], start[new], windows[new]
        body = pa.concat_arrays(body.chunks)
        sizes = pc.binary_length(body).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.frombuffer(body.buffers()[1], np.int32, len(body) + 1, 4 * body.offset)
        data = np.frombuffer(body.buffers()[2], np.uint8)[cuts[0] : cuts[-1]]
        by = np.lexsort((h, doc))
        rank = np.empty(len(by), np.int64)
        rank[by] = np.cumsum(np.r_[0, (doc[by][1:] != doc[by][:-1]) | (h[by][1:] != h[by][:-1])])
        own, lo, hi = later_windows(data, sizes, windows, rank, start, length)
        cols = [pa.array(doc[own]), pa.array(h[own]), pa.array(start[own] + lo), pa.array(start[own] + hi)]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "h", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_anchors(batches, transform):
            yield found(table)

    return run


def repeated_windows(docs: DataFrame, length: int = LENGTH, full: int = FULL) -> DataFrame:
    """(doc_id, h, lo, hi): windows of length bytes, by first and last start, that also start earlier.

    Earlier is in a document that stands before by doc_id and h, or before in the same one.  docs has
    doc_id, h and bytes.  Ranges may touch and overlap.
    """
    found = materialize(repeated_anchors(docs, length), "anchors")
    every, out = _kept_segments(docs, length, found), None
    sizes = gram_sizes(length)
    for gram, longer in zip(sizes, [*sizes[1:], None], strict=True):
        met = _together(every, "anchor", "seg", "doc_id", "h", "start").mapInArrow(_first_places, FACTS)
        met = materialize(met, "places")
        ranges = met.where("seg is null").select("doc_id", "h", F.col("start").alias("lo"), (F.col("start") + F.col("windows") - 1).alias("hi"))
        facts = met.where("seg is not null")
        bodies = _bodies(docs, facts, length) if out is None else facts
        crowded = facts.where(F.col("number") == full).select("anchor") if longer else None  # an anchor is here once
        split = crowded is not None and crowded.limit(1).count() > 0
        if split:
            bodies = materialize(bodies, "bodies")
            every = _segments_of(bodies.join(crowded, "anchor", "left_semi").select(facts.columns[:7]), length, longer)
            bodies = bodies.join(crowded, "anchor", "left_anti")
        found = _together(bodies, "anchor", "seg").mapInArrow(_transform_tasks(length, TRANSFORM), RANGES)
        out = ranges.unionAll(found) if out is None else out.unionAll(ranges).unionAll(found)
        if not split:
            break
    return out


def _together(rows: DataFrame, *order: str) -> DataFrame:
    """rows dealt by the first column and sorted in each task.

    Dealt by a hash of it, so that this exchange is never taken for one that is there already.
    """
    n = n_partitions(rows.sparkSession)
    return rows.repartition(n, F.xxhash64(order[0])).sortWithinPartitions(*order)


def _cut(data: pd.Series, ranges: pd.Series, length: pd.Series) -> pd.DataFrame:
    kept, spans = [], []
    for raw, pairs, size in zip(data, ranges, length, strict=True):
        if pairs is None:
            kept.append(None)
            spans.append([])
            continue
        found: list[list[int]] = []
        for r in pairs:
            lo, hi = r["lo"], min(r["hi"] + size, len(raw))
            if lo >= len(raw):
                continue
            if found and lo <= found[-1][1]:
                found[-1][1] = max(found[-1][1], hi)
            else:
                found.append([lo, hi])
        ends = [0, *(x for f in found for x in f), len(raw)]
        kept.append(b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)))
        spans.append([{"start": a, "end": b} for a, b in found])
    return pd.DataFrame({"kept": kept, "spans": spans})


def remove_repeats(docs: DataFrame, length: int = LENGTH, full: int = FULL) -> DataFrame:
    """docs with spans (start and end of the removed runs of bytes, in order) and kept (the other bytes).

    A byte goes if a string of length bytes around it also starts earlier: in a document with a
    smaller doc_id or before in the same one; strings never reach over a document's end and are
    judged on the input.  A null or empty text has no bytes.  Rows without a doc_id are not compared and
    lose nothing.  Rows that repeat a doc_id with the same text are one document and lose the same; of
    different texts of one doc_id, that with the smaller hash comes first.  Columns of docs go through,
    but for spans and kept, which are replaced.  No rows give no rows.
    """
    ranges = repeated_windows(_documents(docs), length, full)
    by_doc = ranges.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("ranges"))
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(carried(docs).alias("row"), F.col("doc_id").cast("long").alias("id"), text.alias("bytes"))
    rows = rows.join(by_doc, (F.col("id") == F.col("doc_id")) & (F.hash("bytes") == F.col("h")), "left")
    cut = F.pandas_udf(_cut, "kept binary, spans array<struct<start: long, end: long>>")
    some = F.col("ranges").isNotNull()  # only texts that lose bytes go through Python
    done = rows.withColumn("cut", cut(F.when(some, F.col("bytes")), "ranges", F.lit(length)))
    return returned(done, docs.columns, {"spans": F.col("cut.spans"), "kept": F.when(some, F.col("cut.kept")).otherwise(F.col("bytes"))})
