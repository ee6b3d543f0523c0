"""A Merkle manifest of a dataset: leaves appended in order, witnesses that later siblings extend.

Each group (a source) has a tree over its leaves in the order of their keys; the groups' subroots are the
leaves of one tree above.  Runs of `fanout` nodes become their parent.  A block of fanout^BLOCK_LEVELS
leaves is one aligned append stream: a node that joins an open run takes the digests before it as the
left part of its partial witness, each later sibling extends the right part, and the run's completion
hands the step to all witnesses below.  Block roots, made by many tasks at once, are further appends to a stream
of the same kind, until a group has one node.  What stands above a block comes down to it as
one row, so that no leaf row carries more than its digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import line_up, materialize, n_partitions, named

FANOUT = 16
#: Levels of the tree that one task makes of a stream of leaves: blocks of 4096.
BLOCK_LEVELS = 3
STEPS = "array<struct<left:string,right:string>>"


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Path:
    """A witness as a list of steps: the digests left and right of the node on each level."""

    def __init__(self):
        self.steps: list[tuple[str, str]] = []

    def extend(self, left: str, right: str) -> None:
        self.steps.append((left, right))


class Proof:
    """A witness that is only hashed, and the digest that it folds a leaf to so far."""

    def __init__(self, leaf: str):
        self.seen, self.folded = hashlib.sha256(), leaf

    def extend(self, left: str, right: str) -> None:
        self.seen.update((left + right).encode())
        self.folded = _h(left + self.folded + right)


class Node:
    """A node in an open run: its partial witness of this level, and the witnesses of all leaves below."""

    __slots__ = ("below", "digest", "left", "right")

    def __init__(self, digest: str, left: str, below: list):
        self.digest, self.left, self.right, self.below = digest, left, [], below


class Frontier:
    """The open subtrees of an append stream, a run for each level.

    levels: how many levels a whole stream is folded, however short it is; None: until one node remains.
    """

    def __init__(self, fanout: int, levels: int | None):
        self.fanout, self.levels = fanout, levels
        self.open: list[list[Node]] = [[]]

    def append(self, digest: str, below: list, level: int = 0) -> None:
        if level == len(self.open):
            self.open.append([])
        run = self.open[level]
        for earlier in run:
            earlier.right.append(digest)
        run.append(Node(digest, "".join(n.digest for n in run), below))
        if len(run) == self.fanout:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        for node in run:
            right = "".join(node.right)
            for witness in node.below:
                witness.extend(node.left, right)
        self.append(_h("".join(n.digest for n in run)), [w for n in run for w in n.below], level + 1)

    def close(self) -> str:
        """The root: open runs are completed as they are, from below."""
        level = 0
        while True:
            run = self.open[level]
            if level == self.levels or (self.levels is None and len(run) == 1 and not any(self.open[level + 1 :])):
                return run[0].digest
            if run:
                self._complete(level)
            level += 1


def _streams(fanout: int, witness, finish):
    """A task over rows (g, block, rank, digest, other, doc_id, head) sorted by g, block and rank.

    The first row of each block has rank -1 and its head; witness(row) makes what follows a leaf upward.
    """
    size = fanout**BLOCK_LEVELS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head, frontier, rows = None, None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if (row["g"], row["block"]) != now:
                    if rows:
                        yield finish(now, head, frontier.close(), rows)
                    now, head, rows = (row["g"], row["block"]), row["head"], []
                    frontier = Frontier(fanout, None if head["n"] <= size else BLOCK_LEVELS)
                    continue
                made = witness(row)
                rows.append((row, made))
                frontier.append(row["digest"], [made])
        if rows:
            yield finish(now, head, frontier.close(), rows)

    return run


def _batch(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


_STEP = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
_HEAD = f"struct<n:bigint,steps:{STEPS},subroot:string,root:string>"
_ROOTS = pa.schema([("g", pa.string()), ("rank", pa.int64()), ("digest", pa.string()), ("below", pa.int64())])
_PATHS = pa.schema([("g", pa.string()), ("rank", pa.int64()), ("below", pa.int64()), ("steps", _STEP), ("subroot", pa.string()), ("root", pa.string())])
_PROOFS = pa.schema(
    [("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("steps", _STEP)]
)


def _dealt(nodes: DataFrame, heads: DataFrame, fanout: int) -> DataFrame:
    """Nodes (g, rank, digest, and other, doc_id if they have them) behind the head of their block."""
    size = F.lit(fanout**BLOCK_LEVELS)
    none = {"other": "string", "doc_id": "long"}
    body = nodes.select(
        "g", F.floor(F.col("rank") / size).alias("block"), "rank", "digest",
        *[F.col(c) if c in nodes.columns else F.lit(None).cast(t).alias(c) for c, t in none.items()],
        F.lit(None).cast(_HEAD).alias("head"),
    )
    first = heads.select("g", "block", F.lit(-1).cast("long").alias("rank"), F.lit("").alias("digest"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()], "head")
    every = body.unionAll(first).repartition(n_partitions(nodes.sparkSession), "g", "block")
    return every.sortWithinPartitions("g", "block", "rank")


def _head(n, steps=None, subroot=None, root=None) -> F.Column:
    null = F.lit(None)
    return F.struct(
        F.col(n).alias("n"), (null.cast(STEPS) if steps is None else F.col(steps)).alias("steps"),
        (null if subroot is None else F.col(subroot)).cast("string").alias("subroot"), (null if root is None else F.col(root)).cast("string").alias("root"),
    ).alias("head")


def _blocks(n: F.Column, fanout: int) -> F.Column:
    return F.ceil(n / F.lit(fanout**BLOCK_LEVELS)).cast("long")


def _up(nodes: DataFrame, counts: DataFrame, fanout: int) -> DataFrame:
    """g, rank, digest of block roots, and below, the number of nodes of the group on the level below."""

    def finish(now, head, root, rows):
        return _batch(_ROOTS, [{"g": now[0], "rank": now[1], "digest": root, "below": head["n"]}])

    heads = counts.select("g", F.explode(F.sequence(F.lit(0).cast("long"), _blocks(F.col("n"), fanout) - 1)).alias("block"), _head("n"))
    found = _dealt(nodes, heads, fanout).mapInArrow(_streams(fanout, lambda row: Path(), finish), "g string, rank long, digest string, below long")
    return materialize(found, "block-roots")


def climb(nodes: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """The tables of nodes from the given one (g, rank, digest) up to that with one node for each group."""
    counts = nodes.groupBy("g").agg(F.count("*").alias("n"))
    counts = materialize(counts, "leaf-counts")
    tables = [nodes]
    while True:
        tables.append(_up(tables[-1], counts, fanout))
        counts = counts.select("g", _blocks(F.col("n"), fanout).alias("n"))
        if not counts.where("n > 1").limit(1).count():
            return tables


def _down(tables: list[DataFrame], top: DataFrame, fanout: int) -> DataFrame:
    """Heads (g, block, head) for the blocks of the lowest table; top has g, steps, subroot and root of each group."""
    now = tables[-1].join(top, "g").select("g", "rank", "below", "steps", "subroot", "root")

    def finish(now, head, root, rows):
        same = {"g": now[0], "subroot": head["subroot"], "root": head["root"]}
        return _batch(_PATHS, [same | {"rank": r["rank"], "below": r["doc_id"], "steps": _steps(made, head["steps"])} for r, made in rows])

    for table in tables[-2:0:-1]:
        heads = now.select("g", F.col("rank").alias("block"), _head("below", "steps", "subroot", "root"))
        nodes = table.withColumnRenamed("below", "doc_id")  # goes along with its node
        paths = _dealt(nodes, heads, fanout).mapInArrow(_streams(fanout, lambda row: Path(), finish), f"g string, rank long, below long, steps {STEPS}, subroot string, root string")
        now = materialize(paths, "paths")
    return now.select("g", F.col("rank").alias("block"), _head("below", "steps", "subroot", "root"))


def leaf_digest(docs: DataFrame, fields: list[str], changed: dict[str, F.Column] | None = None) -> F.Column:
    """SHA-256, in hex, of the fields one after another: - for a null, else its bytes, a colon and the value."""
    parts = []
    for c in fields:
        value = (changed or {}).get(c, named(c)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


@dataclass
class Manifest:
    """Tables of nodes by level: leaves (g, rank, doc_id, digest, other), block roots, ..., and those of the tree of groups."""

    levels: list[DataFrame]
    groups: list[DataFrame]
    fanout: int

    def proofs(self, with_steps: bool = False) -> DataFrame:
        """For each leaf: doc_id, leaf, subroot, root, proof_sha256 (of all siblings on the way up), folded_root and, if asked for, steps.

        folded_root is made of other, the leaf as it is found now, and the original siblings.
        """
        summit = self.groups[-1].select("g", F.array().cast(STEPS).alias("steps"), F.lit(None).alias("subroot"), F.col("digest").alias("root"))
        heads = _down(self.groups, summit, self.fanout)
        paths = _dealt(self.groups[0], heads, self.fanout).mapInArrow(_streams(self.fanout, lambda row: Path(), _group_paths), f"g string, steps {STEPS}, subroot string, root string")
        heads = _down(self.levels, materialize(paths, "group-paths"), self.fanout)
        found = _dealt(self.levels[0], heads, self.fanout).mapInArrow(
            _streams(self.fanout, lambda row: Both(Proof(row["other"]), Path() if with_steps else None), _finish_proofs),
            f"doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, steps {STEPS}",
        )
        return found if with_steps else found.drop("steps")


def manifest(docs: DataFrame, fields: list[str], group: str = "source", now: dict[str, F.Column] | None = None, fanout: int = FANOUT) -> Manifest:
    """The trees over all rows of docs: in each group (null first, then by bytes) leaves by doc_id, then by digest.

    fields are hashed in their order.  now gives columns as they are found at a later time; folded roots are made of
    these.  Repeated rows are leaves of their own; a null doc_id comes first.  Further columns are left out.  No rows
    give no leaves and no root.
    """
    g = F.when(named(group).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), named(group).cast("string")))
    leaf = leaf_digest(docs, fields)
    rows = docs.select(g.alias("g"), F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("digest"), (leaf_digest(docs, fields, now) if now else leaf).alias("other"))
    leaves = materialize(line_up(rows, "g", ["doc_id", "digest", "other"], "leaves"), "leaves")
    levels = climb(leaves, fanout)
    subroots = levels[-1].select(F.lit("").alias("g"), "digest", F.col("g").alias("other"))
    top = materialize(line_up(subroots, "g", ["other"], "subroots"), "subroots")
    return Manifest(levels, climb(top, fanout), fanout)


class Both:
    """A proof, and the path if that is asked for."""

    __slots__ = ("path", "proof")

    def __init__(self, proof: Proof, path: Path | None):
        self.proof, self.path = proof, path

    def extend(self, left: str, right: str) -> None:
        self.proof.extend(left, right)
        if self.path:
            self.path.extend(left, right)


def _steps(path: Path, above: list[dict]) -> list[dict]:
    return [{"left": a, "right": b} for a, b in path.steps] + above


def _group_paths(now, head, root, rows):
    schema = pa.schema([("g", pa.string()), ("steps", _STEP), ("subroot", pa.string()), ("root", pa.string())])
    return _batch(schema, [{"g": r["other"], "subroot": r["digest"], "steps": _steps(made, head["steps"]), "root": head["root"]} for r, made in rows])


def _finish_proofs(now, head, root, rows):
    out = []
    for row, made in rows:
        for step in head["steps"]:
            made.extend(step["left"], step["right"])
        found = {"proof_sha256": made.proof.seen.hexdigest(), "folded_root": made.proof.folded, "steps": made.path and _steps(made.path, [])}
        out.append({"doc_id": row["doc_id"], "leaf": row["digest"], "subroot": head["subroot"], "root": head["root"]} | found)
    return _batch(_PROOFS, out)
