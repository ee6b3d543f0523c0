"""Embedding near-dedup by product quantisation.

Coarse inverted lists (cut once more where there are very many vectors), residual subspace codes, asymmetric distances from lookup tables over
several probed lists, and an exact cosine for what these let through.  Every vector stands in its
own list and visits the lists that it probes; a pair is looked at where one's own list is probed
by the other.  If that holds both ways, each side counts the pair as a visitor; if it holds one way,
the visitor counts it for both, so that both ends count the same links.  The code's error is kept with it, so the lookup distance never discards a pair that the
exact cosine would keep: only probing can miss one.  Lists meet their visitors block by block; a
block pair gives each visitor a count and only enough links to hold its groups together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, n_partitions
from .components import connected_components

#: Vectors of a list, or visitors of it, in one block.
BLOCK = 4_096
#: Lists whose sizes, a row each, are sent to all tasks; those of more lists are joined.
FEW_LISTS = 1 << 16
#: Pairs whose cosine is taken at once.
PAIRS = 1 << 18


@dataclass(frozen=True)
class Settings:
    """max_train bounds the vectors that the lists and codes are fitted on; all vectors are indexed.

    Lists number a per_list-th of the vectors.  Beyond max_lists each list is cut again, by the nearest
    of at most max_parts centres of what is left of its vectors, which all lists share; then probes grow
    with the root of the parts.
    """

    threshold: float = 0.9
    probes: int = 16
    per_list: int = 100
    max_lists: int = 4096
    max_parts: int = 4096
    subspaces: int = 8
    codewords: int = 256
    max_train: int = 20_000
    rounds: int = 8
    seed: int = 11


def _near(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0.0)


def _k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([_near(x[i : i + 4096], centres).argmin(1) for i in range(0, len(x), 4096)])
        n = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


@dataclass(frozen=True)
class Index:
    lists: np.ndarray
    parts: np.ndarray  # of each list: centres of what is left of its vectors; list p of l is l * len(parts) + p
    words: np.ndarray  # subspace, codeword, dimension within
    edges: np.ndarray  # first dimension of each subspace, and the end

    def centre(self, which: np.ndarray) -> np.ndarray:
        return self.lists[which // len(self.parts)] + self.parts[which % len(self.parts)]

    def probe(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The nearest lists of each row, its own first."""
        d = _near(x, self.lists)
        k = len(self.parts)
        n = min(probes, d.shape[1])
        top = np.argpartition(d, n - 1, 1)[:, :n]
        if k == 1:
            return np.take_along_axis(top, np.take_along_axis(d, top, 1).argsort(1, kind="stable"), 1).astype(np.int32)
        left = x[:, None] - self.lists[top]  # row, list, dimension
        d = _near(left.reshape(-1, x.shape[1]), self.parts).reshape(len(x), -1)
        n = min(d.shape[1], probes * int(np.ceil(np.sqrt(k))))
        near = np.argpartition(d, n - 1, 1)[:, :n]
        near = np.take_along_axis(near, np.take_along_axis(d, near, 1).argsort(1, kind="stable"), 1)
        return (np.take_along_axis(top, near // k, 1) * k + near % k).astype(np.int32)

    def residual_codes(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of rows in their lists, and the distance from each row to what its code stands for."""
        residual = x - self.centre(own)
        codes = np.empty((len(x), len(self.words)), np.uint8)
        error = np.zeros(len(x))
        for s, words in enumerate(self.words):
            part = residual[:, self.edges[s] : self.edges[s + 1]]
            w = words[:, : part.shape[1]]
            d = _near(part, w)
            codes[:, s] = d.argmin(1)
            error += ((part - w[codes[:, s]]) ** 2).sum(1)
        return codes, np.sqrt(error)

    def lookup(self, x: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Distances of rows to coded members of one list, from a table for each row and subspace."""
        residual = x - self.centre(np.array([which]))
        out = np.zeros((len(x), len(codes)))
        for s, words in enumerate(self.words):
            part = residual[:, self.edges[s] : self.edges[s + 1]]
            out += _near(part, words[:, : part.shape[1]])[:, codes[:, s]]
        return np.sqrt(out)


def _fit(x: np.ndarray, n: int, s: Settings) -> Index:
    rng = np.random.default_rng(s.seed)
    dim = x.shape[1]
    lists = _k_means(x, int(np.clip(n // s.per_list, 16, s.max_lists)), s.rounds, rng)
    residual = x - lists[np.concatenate([_near(x[i : i + 4096], lists).argmin(1) for i in range(0, len(x), 4096)])]
    k = int(np.clip(-(-n // (s.per_list * s.max_lists)), 1, s.max_parts))
    parts = _k_means(residual, k, s.rounds, rng) if k > 1 else np.zeros((1, dim))
    own = np.concatenate([_near(residual[i : i + 4096], parts).argmin(1) for i in range(0, len(x), 4096)])
    residual = residual - parts[own]
    m = min(s.subspaces, dim)
    edges = np.linspace(0, dim, m + 1).round().astype(int)
    words = np.zeros((m, min(s.codewords, len(x)), np.diff(edges).max()))
    for k in range(m):
        part = residual[:, edges[k] : edges[k + 1]]
        words[k, :, : part.shape[1]] = _k_means(part, words.shape[1], s.rounds, rng)
    return Index(lists, parts, words, edges)


def _units(column: pa.Array) -> np.ndarray:
    return _unit_rows(np.asarray(column.flatten(), np.float64).reshape(len(column), -1))


def _unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # against overflow of the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _assign(reps: DataFrame, index: Index, s: Settings) -> DataFrame:
    """id, n, raw, home, probes, codes and error of each vector; raw are its components as they came, which is all that tasks send on."""
    known = reps.sparkSession.sparkContext.broadcast(index)  # max_lists, max_parts and the codewords bound it
    step = max(16, 1024 // len(index.parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = known.value
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                x = _units(batch.column(2))
                top = ix.probe(x, s.probes)
                codes, error = ix.residual_codes(x, top[:, 0])
                ends = np.arange(len(x) + 1, dtype=np.int32)
                arrays = [
                    batch.column(0),
                    batch.column(1),
                    pa.array([np.asarray(v.values).tobytes() for v in batch.column(2)], pa.binary()),
                    pa.array(top[:, 0]),
                    pa.ListArray.from_arrays(pa.array(ends * top.shape[1]), pa.array(top.reshape(-1))),
                    pa.array([c.tobytes() for c in codes], pa.binary()),
                    pa.array(error),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "n", "raw", "home", "probes", "codes", "error"])

    schema = "id long, n long, raw binary, home int, probes array<int>, codes binary, error double"
    return reps.select("id", "n", "embedding").mapInArrow(run, schema)


def _meet(assigned: DataFrame, n_lists: int) -> DataFrame:
    """Members (role 0) and visitors (role 1) of each list, dealt into pairs of blocks."""
    visits = assigned.select("home", F.explode("probes").alias("list"))
    sizes = visits.groupBy("list").agg(F.sum((F.col("home") == F.col("list")).cast("long")).alias("m"), F.count("*").alias("v"))
    lists = sizes.where("m > 0").select(
        "list",
        F.ceil(F.col("m") / BLOCK).cast("int").alias("mb"),
        F.ceil(F.col("v") / BLOCK).cast("int").alias("vb"),
    )
    rows = assigned.withColumn("list", F.explode("probes"))
    # of a visitor only its components, its home and its number go to the lists
    for c in ("codes", "probes", "error"):
        rows = rows.withColumn(c, F.when(F.col("home") == F.col("list"), F.col(c)))
    rows = rows.join(F.broadcast(lists) if n_lists <= FEW_LISTS else lists, "list")
    spread = F.xxhash64("id")
    members = (
        rows.where("home = list")
        .withColumn("a", F.pmod(spread, F.col("mb").cast("long")).cast("int"))
        .withColumn("b", F.explode(F.sequence(F.lit(0), F.col("vb") - 1)))
        .withColumn("role", F.lit(0))
    )
    visitors = (
        rows.withColumn("b", F.pmod(spread, F.col("vb").cast("long")).cast("int"))
        .withColumn("a", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)))
        .withColumn("role", F.lit(1))
        .withColumns({"codes": F.lit(None).cast("binary"), "probes": F.lit(None).cast("array<int>"), "error": F.lit(None).cast("double")})
    )
    columns = ["list", "a", "b", "role", "id", "n", "raw", "home", "probes", "codes", "error"]
    return members.select(columns).unionAll(visitors.select(columns))


def _links_of_block(ix: Index, which: int, members: dict, visitors: dict, threshold: float):
    """Copies that visitors, then members link to, and links that hold the groups of this block together."""
    counts = np.zeros(len(visitors["id"]), np.int64)
    back = np.zeros(len(members["id"]), np.int64)  # for pairs that meet in this list only
    links: list[tuple[np.ndarray, np.ndarray]] = []
    m = len(members["id"])
    if not m:
        return counts, back, links
    far = np.sqrt(max(0.0, 2 - 2 * threshold)) + members["error"] + 1e-6
    step = max(1, PAIRS // m)
    group = np.arange(m)  # of members, by links through visitors so far
    for at in range(0, len(counts), step):
        x = visitors["unit"][at : at + step]
        r, c = np.nonzero(ix.lookup(x, which, members["codes"]) <= far)
        other = members["id"][c] != visitors["id"][at + r]
        r, c = r[other], c[other]
        close = np.empty(len(r), bool)
        for k in range(0, len(r), PAIRS // 16):
            cut = slice(k, k + PAIRS // 16)
            close[cut] = np.einsum("ij,ij->i", x[r[cut]], members["unit"][c[cut]]) >= threshold
        r, c = r[close], c[close]
        np.add.at(counts, at + r, members["n"][c])
        lone = ~(members["probes"][c] == visitors["home"][at + r, None]).any(1)
        np.add.at(back, c[lone], visitors["n"][at + r[lone]])
        if len(r):
            first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            root = c[np.repeat(first, np.diff(np.append(first, len(r))))]
            links.append((visitors["id"][at + r[first]], members["id"][c[first]]))
            # the other members of a visitor's links hang on its first one, unless they do already
            new = group[c] != group[root]
            a, b = c[new], root[new]
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                gi, gj = group[i], group[j]
                if gi != gj:
                    links.append((members["id"][[i]], members["id"][[j]]))
                    group[group == gi] = gj
    return counts, back, links


def _compare(index_of, threshold: float, kind: type):
    """kind: the type of the components that are sent."""

    def whole(rows: list[pa.RecordBatch]) -> tuple[dict, dict]:
        table = pa.Table.from_batches(rows)
        role = np.asarray(table["role"])
        out = []
        for want in (0, 1):
            part = table.filter(pa.array(role == want)).combine_chunks()
            n = part.num_rows
            get = lambda c: part[c].to_numpy() if n else np.zeros(0, np.int64)
            side = {c: get(c) for c in ("id", "n", "home")}
            side["unit"] = _unit_rows(np.frombuffer(b"".join(part["raw"].to_pylist()), kind).astype(np.float64).reshape(n, -1)) if n else None
            if want == 0:
                side["error"] = get("error")
            if want == 0 and n:
                side["codes"] = np.frombuffer(b"".join(part["codes"].to_pylist()), np.uint8).reshape(n, -1)
                side["probes"] = np.asarray(part["probes"].chunk(0).flatten()).reshape(n, -1)
            out.append(side)
        return out[0], out[1]

    def found(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        members, visitors = whole(rows)
        counts, back, links = _links_of_block(index_of(), rows[0].column(0)[0].as_py(), members, visitors, threshold)
        ids, counts = np.concatenate([visitors["id"], members["id"]]), np.concatenate([counts, back])
        hit = counts > 0
        u = np.concatenate([ids[hit], *(link[0] for link in links)])
        v = np.concatenate([counts[hit], *(link[1] for link in links)])
        is_count = np.arange(len(u)) < hit.sum()
        return pa.RecordBatch.from_arrays(
            [pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(is_count)], ["u", "v", "is_count"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(k)) for k in range(3)], 1)
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(starts, starts[1:], strict=False):
                key = tuple(keys[lo])
                if held and key != now:
                    yield found(held)
                    held = []
                now = key
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield found(held)

    return run


def near_vectors(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of vectors (vec_id, embedding).

    Two vectors of one length link if their cosine in double precision is threshold or more and
    probing brings them together; each length has an index of its own, so lengths should be few.
    n_links counts the other rows linked, copies included; component_id is the smallest vec_id that
    links reach, itself included, and kept says whether it is the row's own.  Vectors that are null,
    empty, zero or hold a null or a component that isn't finite link with nothing, as do rows without
    a vec_id, whose component_id is null.  Repeated rows are vectors of their own, and so are
    different vectors that share a vec_id.  Further columns are left out.  No rows give no rows.
    """
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kept).alias("embedding"))
    ok = (F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0) & F.col("vec_id").isNotNull()
    rows = rows.select("vec_id", F.when(F.coalesce(ok, F.lit(False)), e).alias("embedding"))
    key = F.coalesce(F.xxhash64("embedding"), F.lit(0))
    rows = rows.select(
        "vec_id",
        "embedding",
        F.when(e.isNull(), F.xxhash64("vec_id")).otherwise(key).alias("h1"),  # rows that link with nothing are spread
        F.xxhash64("embedding", F.lit(5)).alias("h2"),
        e.isNotNull().alias("used"),
    )
    rows = materialize(rows, "vectors")
    # equal vectors are one row here
    reps = rows.where("used").groupBy("h1", "h2").agg(
        F.min("vec_id").alias("vec_id"), F.count("*").alias("n"), F.any_value("embedding").alias("embedding")
    )
    reps = materialize(reps.withColumn("id", F.monotonically_increasing_id()), "reps")
    pairs = None
    for row in reps.groupBy(F.size(e).alias("dim")).count().where("count > 1").orderBy("dim").collect():
        found = _links(reps.where(F.size(e) == row.dim), row["count"], settings)
        pairs = found if pairs is None else pairs.unionAll(found)
    classes = reps.select("h1", "h2", "id", "n", F.lit(0).cast("long").alias("others"), F.col("vec_id").alias("component"))
    if pairs is not None:
        counts = pairs.where("is_count").groupBy(F.col("u").alias("id")).agg(F.sum("v").alias("others"))
        nodes = connected_components(pairs.where("not is_count").select("u", "v"))
        members = reps.select("h1", "h2", "id", "n", "vec_id").join(nodes, F.col("id") == F.col("node"), "left")
        members = members.withColumn("root", F.coalesce("component", "id")).drop("node", "component")
        least = members.groupBy("root").agg(F.min("vec_id").alias("component"))
        classes = members.join(least, "root").join(counts, "id", "left").select("h1", "h2", "id", "n", "others", "component")
    classes = classes.select(
        F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("links"), "component"
    )
    linked = rows.join(classes, F.col("used") & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
    component = F.coalesce("component", "vec_id")
    return linked.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def _links(reps: DataFrame, n: int, s: Settings) -> DataFrame:
    """Of n vectors of one length: (u, v, is_count), where v is how many others u links to, or the other end of a link."""
    spark = reps.sparkSession
    sample = reps.select("embedding").orderBy(F.xxhash64("h1", F.lit(s.seed)), "h1", "h2").limit(s.max_train)
    index = _fit(_units(sample.toArrow()["embedding"].combine_chunks()), n, s)
    assigned = materialize(_assign(reps, index, s), "codes")
    known = spark.sparkContext.broadcast(index)
    met = _meet(assigned, len(index.lists) * len(index.parts)).repartition(n_partitions(spark), "list", "a", "b").sortWithinPartitions("list", "a", "b", "role")
    kind = np.float32 if reps.schema["embedding"].dataType.elementType.simpleString() == "float" else np.float64
    found = met.mapInArrow(_compare(lambda: known.value, s.threshold, kind), "u long, v long, is_count boolean")
    return materialize(found, "links")
