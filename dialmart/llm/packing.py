"""Best-two-fit packing of token pieces into sequences of a fixed capacity.

Which lengths share a sequence depends only on how many pieces have each length, and there are
at most `capacity` lengths.  So the packing is worked out on that histogram, whose size the
corpus does not change; each kind of sequence found is repeated while its lengths last, which
is what filling sequences one by one would do.  Pieces then take their places by their rank
among the pieces of the same length, counted in two levels so that no task holds a whole length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, line_up, materialize, returned
from .tokens import token_pieces


def _fullest_pair(present: np.ndarray, counts: np.ndarray, room: int) -> tuple[int, int] | None:
    """Two unpacked lengths with the largest sum that room holds."""
    low = present[present < room]
    if not len(low):
        return None
    at = np.searchsorted(low, room - low, side="right") - 1
    ok = at >= 0
    a, b = low[ok], low[at[ok]]
    ok = (a != b) | (counts[a] >= 2)
    if not ok.all():  # a length that is left once pairs with the next smaller one instead
        retry = ~ok & (np.searchsorted(low, a) > 0)
        b = np.where(retry, low[np.maximum(np.searchsorted(low, a) - 1, 0)], b)
        ok |= retry
    if not ok.any():
        return None
    a, b = a[ok], b[ok]
    best = int(np.argmax(a + b))
    return int(a[best]), int(b[best])


def plan_sequences(counts: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
    """(how often, [(length, pieces of it)]) of each kind of sequence.

    counts[n] is the number of pieces of length n, for n from 0 to the capacity.
    Lengths of 0 take no room and are not planned.
    """
    counts = counts.astype(np.int64).copy()
    capacity = len(counts) - 1
    counts[0] = 0
    kinds: list[tuple[int, list[tuple[int, int]]]] = []
    present = np.flatnonzero(counts)
    while len(present):
        fill: dict[int, int] = {}
        gap = capacity
        at = len(present)
        while gap and at:
            at = min(at, int(np.searchsorted(present, gap, side="right")))
            if not at:
                break
            n = int(present[at - 1])
            fill[n] = min(int(counts[n]), gap // n)
            gap -= n * fill[n]
            at -= 1
        if gap:
            left = counts.copy()
            for n, k in fill.items():
                left[n] -= k
            smallest = min(fill)
            pair = _fullest_pair(np.flatnonzero(left), left, gap + smallest)
            if pair and sum(pair) > smallest:
                fill[smallest] -= 1
                for n in pair:
                    fill[n] = fill.get(n, 0) + 1
                fill = {n: k for n, k in fill.items() if k}
        times = min(int(counts[n]) // k for n, k in fill.items())
        for n, k in fill.items():
            counts[n] -= times * k
        kinds.append((times, sorted(fill.items(), reverse=True)))
        present = present[counts[present] > 0]
    return kinds


def _runs(kinds: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows length, first rank, pieces a sequence, first sequence, offset; by length and rank."""
    rows, taken, sequence = [], {}, 0
    for times, fill in kinds:
        offset = 0
        for n, k in fill:
            rows.append((n, taken.get(n, 0), k, sequence, offset))
            taken[n] = taken.get(n, 0) + times * k
            offset += n * k
        sequence += times
    out = np.array(rows, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """pieces with sequence_id and offset, one output row for each input row.

    pieces has an integer column length from 1 to capacity; rows with another length or a null
    one get null places.  Repeated rows are pieces of their own.  Other columns are carried along
    whatever they hold and are called, but for sequence_id and offset, which are replaced.  Within a
    sequence the offsets have no gaps and start at 0.  No rows give no rows.
    """
    length = F.col("length").cast("long")
    size = F.when(length.between(1, capacity), length).otherwise(F.lit(0)).cast("int")
    numbered = materialize(
        pieces.select(carried(pieces).alias("row"), size.alias("size"), F.monotonically_increasing_id().alias("number")), "pieces"
    )
    counts = np.zeros(capacity + 1, np.int64)
    for n, k in numbered.groupBy("size").count().collect():  # a row for each length
        counts[n] = k
    ranked = line_up(numbered, "size", ["number"], "ranked")
    return _place(ranked, _runs(plan_sequences(counts)), pieces.columns, capacity)


def _place(ranked: DataFrame, runs: np.ndarray, columns: list[str], capacity: int) -> DataFrame:
    shift = 1 << 40
    # the table of runs is bounded by the capacity alone, as is the histogram
    known = ranked.sparkSession.sparkContext.broadcast((runs[:, 0] * shift + runs[:, 1], runs))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        keys, table = known.value
        n = length.to_numpy(np.int64)
        r = rank.to_numpy(np.int64)
        good = (n >= 1) & (n <= capacity)
        seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        if good.any():
            at = np.searchsorted(keys, n[good] * shift + r[good], side="right") - 1
            _, first, each, sequence, offset = table[at].T
            seq[good] = sequence + (r[good] - first) // each
            off[good] = offset + (r[good] - first) % each * n[good]
        return pd.DataFrame(
            {"sequence_id": pd.Series(seq).where(good).astype("Int64"), "offset": pd.Series(off).where(good).astype("Int64")}
        )

    placed = ranked.withColumn("place", place(F.col("size").cast("long"), "rank"))
    return returned(placed, columns, {"sequence_id": F.col("place.sequence_id"), "offset": F.col("place.offset")})


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = True
) -> DataFrame:
    """Token pieces of whole documents with their places, and with their ids unless told otherwise.

    Null, empty and repeated texts and null doc_ids are as token_pieces says; of docs only doc_id and
    text are used.
    """
    return pack(token_pieces(docs, tokenizer_path, end_id, capacity, with_ids), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its token ids, from pieces that carry ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return (
        packed.where("sequence_id is not null")
        .groupBy("sequence_id")
        .agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
    )
