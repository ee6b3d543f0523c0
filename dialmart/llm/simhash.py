"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components.

A fingerprint is cut into blocks.  Two fingerprints at `radius` or fewer bits apart agree on all
but `radius` blocks at least, so they share the value of some choice of the others; rows meet on
these shared values and the Hamming distance decides.  Equal fingerprints are one row from the
start.  Where rows meet, only enough links to hold each group together are written, and a meeting
place with more rows than one task should hold is split into parts that meet two by two.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, materialize, n_partitions, returned
from .components import connected_components

BITS = 64
#: Fingerprints that meet in one place before it is split.
PLACE = 4_096
#: Hashes whose bits are summed at once.
STEP = 1 << 16


def _majority(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of hashes; starts are the runs' first indices, no run is empty."""
    sizes = np.diff(np.append(starts, len(hashes)))
    out = np.zeros(len(starts), np.uint64)
    for bit in range(BITS):
        on = np.add.reduceat(((hashes >> np.uint64(bit)) & np.uint64(1)).astype(np.int32), starts)
        out |= (2 * on.astype(np.int64) > sizes).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """The columns of docs before text (doc_id, or others too) and fingerprint (a long of 64 bits) of each row.

    Words are runs of anything but ASCII white space, A-Z lower-cased; shingles of so many words,
    joined by a space, count each time they occur.  A text with fewer words is one shingle, a null
    or blank one has fingerprint 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        space = b" ".join
        for batch in batches:
            prints = np.zeros(batch.num_rows, np.uint64)
            hashes: list[np.ndarray] = []
            rows: list[int] = []
            held = 0

            def flush():
                if rows:
                    starts = np.cumsum([0] + [len(h) for h in hashes[:-1]])
                    prints[rows] = _majority(np.concatenate(hashes), starts)
                hashes.clear()
                rows.clear()

            texts = pc.cast(batch.column(batch.num_columns - 1), pa.large_binary())
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                w = text.lower().split() if text else ()
                if not w:
                    continue
                n = max(1, len(w) - words + 1)
                shingles = map(space, zip(*(w[k : n + k] for k in range(words)), strict=True)) if len(w) >= words else (space(w),)
                hashes.append(np.fromiter((xxh64_intdigest(s, seed) for s in shingles), np.uint64, n))
                rows.append(i)
                held += n
                if held >= STEP:
                    flush()
                    held = 0
            flush()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints.view(np.int64))], [*keys, "fingerprint"])

    keys = [c for c in ("doc_id", "text_key") if c in docs.columns]
    cols = docs.select(*[F.col(c).cast("long") for c in keys], F.col("text").cast("string"))
    return cols.mapInArrow(run, ", ".join(f"{c} long" for c in [*keys, "fingerprint"]))


def _masks(blocks: int, radius: int) -> list[int]:
    """Bit masks of every choice of blocks - radius of the blocks, as signed longs."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    each = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
    masks = [sum(c) for c in combinations(each, blocks - radius)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def blocks_for(n: int, radius: int = 3) -> int:
    """So many blocks that fingerprints meet few others by chance.

    Any number of blocks above the radius finds all pairs, so this only weighs the rows that each
    fingerprint sends against those that it meets in vain.
    """
    blocks = radius + 1
    while blocks < 8 and n / 2 ** (BITS * (blocks - radius) / blocks) > 0.25:
        blocks += 1
    return blocks


def _group_links(ids: np.ndarray, prints: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that hold together what hangs together in one meeting place."""
    out = []
    left = np.arange(len(ids))
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            p = reached.pop()
            near = np.bitwise_count(prints[left] ^ prints[p]) <= radius
            if near.any():
                hit = left[near]
                out.append((np.full(len(hit), ids[p]), ids[hit]))
                reached.extend(hit)
                left = left[~near]
    return out


def _place_links(radius: int):
    """Links in a partition that is sorted by meeting place."""

    def links(keys: np.ndarray, ids: np.ndarray, prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
        size = np.diff(np.append(first, len(keys)))
        for at, n in zip(first[size > 8], size[size > 8], strict=True):
            out += _group_links(ids[at : at + n], prints[at : at + n], radius)
        small = np.repeat(size <= 8, size)
        group = np.repeat(np.arange(len(size)), size)
        for step in range(1, 8):
            a = np.flatnonzero(small[:-step] & (group[:-step] == group[step:]))
            near = np.bitwise_count(prints[a] ^ prints[a + step]) <= radius
            out.append((ids[a[near]], ids[a[near] + step]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["u", "v"]
        held: list[np.ndarray] = []

        def found(rows: np.ndarray) -> pa.RecordBatch:
            got = links(rows[:, :4], rows[:, 4], rows[:, 5].copy().view(np.uint64)) if len(rows) > 1 else []
            u, v = (np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.int64) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1)
            if held:
                rows = np.concatenate([*held, rows])
            cut = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(1))
            if len(cut):  # the last place may go on in the next batch
                yield found(rows[: cut[-1] + 1])
                rows = rows[cut[-1] + 1 :]
            held = [rows]
        if held:
            yield found(held[0])

    return run


def near_links(prints: DataFrame, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """(u, v) links among rows (id, fingerprint) of distinct fingerprints that join all close pairs.

    Two ids hang together by these links exactly if they do by all pairs within the radius.
    """
    blocks = blocks or blocks_for(prints.count(), radius)
    masks = F.lit(_masks(blocks, radius))
    keyed = prints.select(
        F.col("id"), F.col("fingerprint"), F.posexplode(F.transform(masks, lambda m: m.bitwiseAND(F.col("fingerprint"))))
    ).select("id", "fingerprint", F.col("pos").cast("long").alias("t"), F.col("col").alias("key"))
    full = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > PLACE)
    parts = F.ceil(F.coalesce(F.col("n"), F.lit(1)) / F.lit(PLACE)).cast("int")
    met = (
        keyed.join(full, ["t", "key"], "left")
        .withColumn("parts", parts)
        .withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts").cast("long")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "t",
            "key",
            F.least("part", "other").cast("long").alias("lo"),
            F.greatest("part", "other").cast("long").alias("hi"),
            "id",
            "fingerprint",
        )
    )
    dealt = met.repartition(n_partitions(prints.sparkSession), "t", "key", "lo", "hi")
    dealt = dealt.sortWithinPartitions("t", "key", "lo", "hi", "id")
    return dealt.mapInArrow(_place_links(radius), "u long, v long")


def _components(docs: DataFrame, words: int, radius: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The rows' doc_id, text_key and fingerprint, and for each fingerprint its group and, of its rows that have an id, the first (id, text_key).

    Fingerprints, not doc_ids, are what links join, so unlike texts that share a doc_id stay apart.
    """
    rows = keyed_rows(docs)
    prints = materialize(fingerprints(rows, words, seed), "simhash")
    same = prints.groupBy("fingerprint").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_key"))).alias("first"))
    same = materialize(same, "fingerprints")
    found = connected_components(near_links(same.where("first is not null").select(F.col("fingerprint").alias("id"), "fingerprint"), radius))
    groups = same.join(found, F.col("fingerprint") == F.col("node"), "left")
    return prints, groups.select("fingerprint", F.coalesce("component", "fingerprint").alias("group"), "first")


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (long) and component_id, the smallest doc_id that links reach.

    Links join fingerprints at radius or fewer differing bits; blank texts all have fingerprint 0
    and are linked like any other.  Rows without a doc_id keep their fingerprint and get a null
    component unless a document with an id shares it.  Unlike texts that share a doc_id are
    documents of their own.  No rows give no rows.
    """
    prints, groups = _components(docs, words, radius, seed)
    groups = materialize(groups, "groups")
    least = groups.groupBy("group").agg(F.min("first.doc_id").alias("component_id"))
    roots = groups.join(least, "group").select(F.col("fingerprint").alias("_f"), "component_id")
    return prints.join(roots, prints["fingerprint"] == roots["_f"]).select("doc_id", "fingerprint", "component_id")


def keyed_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text, null as empty) and text: together what tells documents apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"), text.alias("text"))


def only_these(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of docs without a doc_id, and one row of each (doc_id, text_key) in kept, with all their columns."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(carried(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"))
    named = rows.where("doc_id is not null").join(kept.select("doc_id", "text_key"), ["doc_id", "text_key"], "left_semi")
    one = named.groupBy("doc_id", "text_key").agg(F.first("row").alias("row")).select("row")
    return returned(one.unionAll(rows.where("doc_id is null").select("row")), docs.columns)


def keep_one(docs: DataFrame, words: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """docs without near-duplicates: of each component only one document, of those with its smallest doc_id.

    Null and empty texts have fingerprint 0 and are alike.  Rows that repeat a doc_id and are alike are
    copies too; unlike texts that share a doc_id are documents of their own.  Rows without a doc_id
    can't be told apart and stay as they are.  All columns go through, whatever they are called.  No
    rows give no rows.
    """
    _, groups = _components(docs, words, radius, seed)
    return only_these(docs, groups.groupBy("group").agg(F.min("first").alias("first")).where("first is not null").select("first.*"))
