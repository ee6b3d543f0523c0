"""Spelling variants: words one edit apart, found in a trie of letter-group counts.

A word is a vector: how many of its letters fall in each of GROUPS groups.  One inserted, deleted or
replaced letter adds at most one to a single count and takes at most one from another, so all near words lie
within a surplus of one and a deficit of one.  The trie's levels are the successive counts; a search
goes down from the root, spends its surplus or its deficit where a child's count differs by one, and
verifies the words of the leaves that it reaches letter by letter.

The trie is dealt out by the counts of its first levels, so many that no piece holds more words than a
task should; a search visits the pieces that its budget reaches, and of two pieces only the words of one search
the other.  Words with equal counts in all levels that are still too many are dealt by a hash into parts, and
a search visits all of these.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, n_partitions

#: Letters in groups that occur about equally often in Latin text; any other letter is in the last.
GROUPS = ["e", "a", "i", "t", "n", "o", "s", "r", "lk", "dw", "hv", "ub", "cg", "mf", "pyjq"]
LEVELS = len(GROUPS) + 1
#: Words of one piece of the trie, searches that go down it at once, and candidates that are verified at once.
PIECE = 40_000
SEARCHES = 4_096
CANDIDATES = 200_000
#: Letters of the longest word that is compared as a row of a table; longer ones are compared one by one.
WIDE = 64
#: Different words that a task counts before it passes them on.
COUNTED = 1 << 18

_LETTERS = "".join(map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]))
#: By Latin-1 byte: A-Z lower-cased, other letters themselves, all else a space.
_FOLD = bytes(ord(chr(b).lower()) if 65 <= b <= 90 else b if chr(b) in _LETTERS else 32 for b in range(256))
_OF_LETTER = np.full(256, LEVELS - 1, np.int64)
for _k, _group in enumerate(GROUPS):
    _OF_LETTER[list(_group.encode())] = _k


def _runs(text: str) -> list[bytes]:
    """Maximal runs of letters, A-Z lower-cased, as Latin-1."""
    return text.encode("latin-1", "replace").translate(_FOLD).split()


def _altered(word: bytes, h: int, every: int) -> bytes:
    at = h % len(word)
    return word[:at] + word[at + 1 :] if h % every == 0 else word


def word_counts(docs: DataFrame, min_letters: int = 5, min_n: int = 3, every: int = 97) -> DataFrame:
    """word and n (long): words of so many letters that occur so often in all texts.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased.  Where `every` divides the CRC-32 h of
    the doc_id, a colon and the word, the letter at h modulo the length is left out.  A null text has no words; a null
    doc_id is hashed as an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[bytes, int] = {}

        def out():
            words = pa.array([w.decode("latin-1") for w in counted], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(counted.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(*batch.columns, strict=True):
                doc, text = doc.as_py(), text.as_py()
                start = zlib.crc32(b"%d:" % doc if doc is not None else b":")
                n: dict[bytes, int] = {}
                for word in _runs(text or ""):
                    n[word] = n.get(word, 0) + 1
                for word, times in n.items():
                    whole = word if word.isascii() else word.decode("latin-1").encode()
                    word = _altered(word, zlib.crc32(whole, start), every)
                    if len(word) >= min_letters:
                        counted[word] = counted.get(word, 0) + times
                if len(counted) >= COUNTED:
                    yield out()
                    counted.clear()
        if counted:
            yield out()

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_n)


def _counts(words: list[bytes]) -> np.ndarray:
    """A row for each word: its letters by group."""
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    letters = np.frombuffer(b"".join(words), np.uint8)
    return np.bincount(owner * LEVELS + _OF_LETTER[letters], minlength=len(words) * LEVELS).reshape(-1, LEVELS)


def is_near(a: bytes, b: bytes) -> bool:
    """Whether one inserted, deleted or replaced letter makes b of a."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


class Table:
    """Words as rows of letters, from the left and from the right, so that many pairs are verified at once."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.size = np.array([len(w) for w in words], np.int64)
        short = [w if len(w) <= WIDE else b"" for w in words]
        self.left = self._rows([w.ljust(WIDE, b"\0") for w in short])
        self.right = self._rows([w.rjust(WIDE, b"\0") for w in short])

    @staticmethod
    def _rows(words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(words), np.uint8).reshape(-1, WIDE)


def _near(a: Table, i: np.ndarray, b: Table, j: np.ndarray) -> np.ndarray:
    """is_near of a's words i and b's words j."""
    size, other = a.size[i], b.size[j]
    out = np.zeros(len(i), bool)
    for k in np.flatnonzero(np.maximum(size, other) > WIDE):
        out[k] = is_near(a.words[i[k]], b.words[j[k]])
    k = np.flatnonzero((np.maximum(size, other) <= WIDE) & (abs(size - other) <= 1))
    if len(k):
        width = max(1, int(np.maximum(size, other)[k].max()))
        differs = a.left[i[k], :width] != b.left[j[k], :width]
        same = ~differs.any(1)
        prefix = np.where(same, width, differs.argmax(1))
        differs = (a.right[i[k], WIDE - width :] != b.right[j[k], WIDE - width :])[:, ::-1]
        suffix = np.where(differs.any(1), differs.argmax(1), width)
        # letters beyond a word's ends are equal, so both may count too many
        longest = np.maximum(size, other)[k]
        out[k] = ~same & (np.minimum(prefix, longest) + np.minimum(suffix, longest) >= longest - 1)
    return out


class Trie:
    """The trie of some words: on each level the nodes of their distinct prefixes of counts, in order."""

    def __init__(self, words: list[bytes]):
        rows = _counts(words)
        order = np.lexsort(rows.T[::-1])
        self.table = Table([words[k] for k in order])
        rows = rows[order]
        node = np.zeros(len(rows), np.int64)
        #: For each level the sorted keys (parent, count) of its nodes.
        self.keys, self.wide = [], int(rows.max(initial=0)) + 2
        for level in range(LEVELS):
            keys, node = np.unique(node * self.wide + rows[:, level], return_inverse=True)
            self.keys.append(keys)
        self.ends = np.cumsum(np.bincount(node)) if len(rows) else np.zeros(0, np.int64)

    def search(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of numbers, of words and of the trie's words, whose counts lie within the budget."""
        rows = _counts(words)
        who, node = np.arange(len(words)), np.zeros(len(words), np.int64)
        surplus, deficit = np.ones(len(words), bool), np.ones(len(words), bool)
        for level, keys in enumerate(self.keys):
            own = rows[who, level]
            found = []
            for spend, allowed in ((0, np.ones(len(who), bool)), (1, surplus), (-1, deficit & (own > 0))):
                at = np.flatnonzero(allowed & (own + spend < self.wide))
                key = node[at] * self.wide + own[at] + spend
                child = np.searchsorted(keys, key)
                hit = child < len(keys)
                hit[hit] = keys[child[hit]] == key[hit]
                at = at[hit]
                found.append((who[at], child[hit], surplus[at] & (spend != 1), deficit[at] & (spend != -1)))
            who, node, surplus, deficit = (np.concatenate(x) for x in zip(*found, strict=True))
        size = np.diff(self.ends, prepend=0)[node]
        upto = np.cumsum(size)
        at = 0
        while at < len(node):  # so many leaves that their words are few enough, or one
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CANDIDATES, "right")))
            n = size[at:to]
            place = np.repeat(self.ends[node[at:to]] - np.cumsum(n), n) + np.arange(int(n.sum()))
            yield np.repeat(who[at:to], n), place
            at = to


#: What a row of a piece does: it is one of its words, or searches it from the same or from another piece.
HELD, OWN, FOREIGN = 0, 1, 2


class Piece:
    """One piece of the trie while its searches pass: what was found for its own words by searches from other pieces."""

    def __init__(self, words: list[tuple[bytes, int]]):
        self.trie = Trie([w for w, _ in words])
        n = dict(words)
        self.n = [n[w] for w in self.trie.table.words]
        self.found: dict[int, list] = {}

    def answers(self, asking: list[tuple[bytes, int, int]]) -> list[tuple]:
        """(word, n_near, form_n, form) of the searches that find some."""
        asked = Table([w for w, _, _ in asking])
        words, out = self.trie.table.words, {}
        for i, j in self.trie.search(asked.words):
            hit = _near(asked, i, self.trie.table, j)
            for a, b in zip(i[hit].tolist(), j[hit].tolist(), strict=True):
                word, n, role = asking[a]
                _note(out, a, self.n[b], words[b])
                if role == FOREIGN:  # the other piece's word is not looked for from here
                    _note(self.found, b, n, word)
        return [(asking[a][0], *x) for a, x in out.items()]

    def own(self) -> list[tuple]:
        return [(self.trie.table.words[b], *x) for b, x in self.found.items()]


def _note(found: dict[int, list], at: int, n: int, word: bytes) -> None:
    """Count a near word of word `at`, and keep the one of largest n, then the smallest."""
    x = found.setdefault(at, [0, n, word])
    x[0] += 1
    if (-n, word) < (-x[1], x[2]):
        x[1:] = n, word


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (piece, part, role, word, n) sorted by the first three: the words of a piece, then those that search it.

    Gives word, n_near and the best near word (n, then smallest) of all that find some or are found from another piece.
    """
    now, words, piece, asking = None, [], None, []

    def answers() -> list[tuple]:
        nonlocal piece, asking
        if not asking:
            return []
        piece = piece or Piece(words)
        got, asking = piece.answers(asking), []
        return got

    def shown(rows: list[tuple]) -> pa.RecordBatch:
        word, near, n, form = zip(*rows, strict=True) if rows else ((), (), (), ())
        columns = [[w.decode("latin-1") for w in word], near, n, [w.decode("latin-1") for w in form]]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["word", "n_near", "form_n", "form"])

    for batch in batches:
        for key, part, role, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (key, part) != now:
                yield shown(answers() + (piece.own() if piece else []))
                now, words, piece = (key, part), [], None
            if role == HELD:
                words.append((word.encode("latin-1"), n))
                continue
            asking.append((word.encode("latin-1"), n, role))
            if len(asking) >= SEARCHES:
                yield shown(answers())
    yield shown(answers() + (piece.own() if piece else []))


def _vector(word: str) -> F.Column:
    """A word's counts by group, as an array of ints; the last is of the letters in none."""
    size = F.length(word)
    counts = [size - F.length(F.translate(word, g, "")) for g in GROUPS]
    return F.array(*counts, F.length(F.translate(word, "".join(GROUPS), ""))).cast("array<int>")


def _reached(depth: int) -> F.Column:
    """The first `depth` counts of all vectors within the budget of `vector`, as keys."""
    changes = [[0] * depth]
    for a in range(depth):
        changes += [[d if k == a else 0 for k in range(depth)] for d in (1, -1)]
        changes += [[1 if k == a else -1 if k == b else 0 for k in range(depth)] for b in range(depth) if b != a]
    first = [F.col("vector")[k] for k in range(depth)]
    keys = [F.when(F.least(F.lit(0), *[c + F.lit(d) for c, d in zip(first, change, strict=True) if d < 0]) >= 0 if -1 in change else F.lit(True),
                   F.concat_ws(",", *[(c + F.lit(d)).cast("string") for c, d in zip(first, change, strict=True)])) for change in changes]
    return F.array_compact(F.array(*keys))


def _key(depth: int) -> F.Column:
    return F.concat_ws(",", *[F.col("vector")[k].cast("string") for k in range(depth)])


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near (long, how many words are one edit apart), form and form_n (the one of largest n, then smallest), of words that have any.

    words has word, different in all rows, of letters below U+0100, and n.
    """
    spark = words.sparkSession
    vectors = materialize(words.select("word", "n", _vector("word").alias("vector")), "vectors")
    depth = 2
    while depth < LEVELS:  # so many levels that no piece is too large
        most = vectors.groupBy(_key(depth).alias("piece")).count().agg(F.max("count")).first()[0]
        if (most or 0) <= PIECE:
            break
        depth += 1
    pieces = vectors.groupBy(_key(depth).alias("piece")).agg(F.count("*").alias("size"))
    pieces = materialize(pieces.select("piece", F.ceil(F.col("size") / PIECE).cast("int").alias("parts")), "pieces")
    held = vectors.select(_key(depth).alias("piece"), "word", "n").join(pieces, "piece")
    part = F.pmod(F.xxhash64("word"), F.col("parts").cast("long")).cast("int")
    held = held.select("piece", part.alias("part"), F.lit(HELD).alias("role"), "word", "n")
    # of two pieces the words of one search the other, which finds the pairs of both
    reached = F.filter(_reached(depth), lambda p: p >= _key(depth))
    asking = vectors.select(F.explode(reached).alias("piece"), _key(depth).alias("own"), "word", "n").join(pieces, "piece")
    role = F.when(F.col("piece") == F.col("own"), OWN).otherwise(FOREIGN)
    asking = asking.select("piece", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), role.alias("role"), "word", "n")
    dealt = held.unionAll(asking).repartition(n_partitions(spark), "piece", "part").sortWithinPartitions("piece", "part", "role", "word")
    found = dealt.mapInArrow(_search, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("rank"), "form"))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return found.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.rank")).alias("form_n"))


def follow(forms: DataFrame) -> DataFrame:
    """word and root: the end of the chain word, form, form's form, ...; forms has word and form, and no chain is a ring.

    Chains halve in each round, so there are as many rounds as the logarithm of the longest has bits.
    """
    now = materialize(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("_word"), F.col("root").alias("_root")).where("_word <> _root")
        onward = now.join(ahead, F.col("root") == F.col("_word"), "left")
        onward = materialize(onward.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "roots")
        now = onward.select("word", "root")
        if not onward.where("moved").limit(1).count():
            return now


def variants(docs: DataFrame, min_letters: int = 5, min_n: int = 3, every: int = 97, times: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n and root of each word of word_counts().

    A word's form is its near word of largest n (ties: the smallest) if that occurs `times` times as often at least,
    else null; its root is where forms lead.  Repeated rows count again, further columns are left out, and no rows
    give no rows.
    """
    words = materialize(word_counts(docs, min_letters, min_n, every), "words")
    near = materialize(near_words(words), "near-words")
    joined = words.join(near.withColumnRenamed("word", "_word"), F.col("word") == F.col("_word"), "left").drop("_word")
    enough = F.col("form_n") >= times * F.col("n")
    joined = joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n")
    )
    joined = materialize(joined, "forms")
    roots = follow(joined).withColumnRenamed("word", "_word")
    return joined.join(roots, F.col("word") == F.col("_word")).drop("_word")
