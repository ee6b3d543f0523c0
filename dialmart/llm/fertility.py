"""Quality rules by tokeniser fertility: how public vocabularies cut a text tells whether it is prose of its language.

Every word (a run of anything but ASCII white space) is encoded by itself, as it stands after a space,
with two public vocabularies: a byte-level one for many languages and one whose letters fall back to bytes.
A text's measures are characters per token by each, the share of byte-fallback tokens, and the
entropy of its tokens by each.  Bands come from all measured texts: within a language and a class of length
(a power of two of words), what lies `reach` quartile distances outside the quartiles is rejected, but
nothing nearer to the median than `floor` of it.  Equal measures count once, so copies move no band.  A
group with fewer than `least` different measures takes its language's bands, then its script's, then
fixed wide ones.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, materialize, returned

#: Fixed parameters of the base rules: a text with fewer words, or a larger share of words in repeated windows, fails.
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
WINDOW = 3
SYMBOLS = b"#*$%&|<>"
#: Words that a worker keeps the tokens of.
CACHE_ENTRIES = 1 << 19
#: Bytes of text whose words are held at once.
STEP = 1 << 20
#: Characters of the longest piece of a word that is given to an encoder; a longer word is cut into such pieces.
LONGEST = 4096

MEASURES = ["chars_per_token", "chars_per_piece", "byte_share", "token_entropy", "piece_entropy"]
FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, script string, "
    + ", ".join(f"{m} int" for m in MEASURES)
)
#: Bands where too few texts of a script are at hand; thousandths, as all measures.  Letters of scripts that a vocabulary lacks are bytes.
WIDE = {"Latin": [(1000, 12000), (1000, 12000), (0, 300), (2000, 20000), (2000, 20000)]}
WIDEST = [(100, 50000), (100, 50000), (0, 1000), (1000, 20000), (1000, 20000)]
#: First code points of the blocks by which a script is told.
BLOCKS = [
    (0x0, "Common"), (0x41, "Latin"), (0x5B, "Common"), (0x61, "Latin"), (0x7B, "Common"), (0xC0, "Latin"), (0x250, "Common"),
    (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x780, "Common"),
    (0x900, "Devanagari"), (0x980, "Indic"), (0xE00, "Thai"), (0xE80, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Common"),
    (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0x20000, "Han"),
]
_STARTS = np.array([b[0] for b in BLOCKS], np.uint32)
_NAMES = sorted({b[1] for b in BLOCKS})
_OF_BLOCK = np.array([_NAMES.index(b[1]) for b in BLOCKS])


class Vocabularies:
    """Tokens of single words by both vocabularies, remembered up to a bound."""

    def __init__(self, ranks_path: str, pieces_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        pieces = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        n = pieces.get_piece_size()
        self.is_byte = np.array([pieces.is_byte(i) for i in range(n)])
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        size[list(ranks.values())] = list(map(len, ranks))
        shown = [1 if self.is_byte[i] else len(pieces.id_to_piece(i).replace("\u2581", " ").encode()) for i in range(n)]
        #: For each vocabulary what encodes texts that begin with a space, and its tokens' lengths in bytes.
        self.encoders = [
            (lambda texts: encoding.encode_ordinary("".join(texts)), size),
            (lambda texts: list(chain.from_iterable(pieces.encode([t[1:] for t in texts], num_threads=1))), np.array(shown)),  # it puts a space first itself
        ]
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.tokens = [Flat(), Flat()]

    def learn(self, words: set[bytes]) -> None:
        """Make the tokens of all these words known; older words may be forgotten."""
        new = [w for w in words if w not in self.number]
        if len(self.number) + len(new) > CACHE_ENTRIES and self.number:
            self.clear()
            new = list(words)
        if not new:
            return
        for (encode, size), flat in zip(self.encoders, self.tokens, strict=True):
            flat.add(*_tokens_of(new, encode, size))
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))


def _tokens_of(words: list[bytes], encode, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all words, one after another, and how many each has.

    They are encoded in one call as a text of words with a space before each.  If a token of that goes over
    the end of a word, or stands for other bytes than the text's, they are encoded one by one.
    """
    ends = np.cumsum([len(w) + 1 for w in words])
    if max(map(len, words)) <= LONGEST:
        ids = np.array(encode([" " + b" ".join(words[i : i + 200]).decode("utf-8", "replace") for i in range(0, len(words), 200)]), np.int64)
        reached = np.cumsum(size[ids])
        at = np.searchsorted(reached, ends)
        if len(reached) and reached[-1] == ends[-1] and (reached[at] == ends).all():
            return ids, np.diff(at + 1, prepend=0)
    each = []
    for w in words:
        text = " " + w.decode("utf-8", "replace")
        parts = [text[i : i + LONGEST] for i in range(0, len(text), LONGEST)]
        each.append([i for k, part in enumerate(parts) for i in encode([part if not k else " " + part])])
    return np.array([i for x in each for i in x], np.int64), np.array(list(map(len, each)))


class Flat:
    """Lists of ids, one after another in an array that grows."""

    def __init__(self):
        self.ids, self.ends, self.used, self.n = np.zeros(1024, np.int32), np.zeros(1024, np.int64), 0, 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        ends = self.used + np.cumsum(sizes)
        self.ids, self.used = _appended(self.ids, self.used, ids), self.used + len(ids)
        self.ends, self.n = _appended(self.ends, self.n, ends), self.n + len(ends)

    def of(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of those lists, one after another."""
        ends = self.ends[numbers]
        starts = np.where(numbers > 0, self.ends[numbers - 1], 0)
        sizes = ends - starts
        before = np.cumsum(sizes) - sizes
        return self.ids[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


def _appended(array: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    if used + len(more) > len(array):
        array = np.concatenate([array[:used], np.zeros(max(len(array), len(more)), array.dtype)])
    array[used : used + len(more)] = more
    return array


def _entropy(ids: np.ndarray) -> float:
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    return float(-(share * np.log2(share)).sum())


def script_of(text: str) -> str:
    """The script of most letters; Common where a text has none."""
    if text.isascii():
        return "Latin" if any(map(str.isalpha, text)) else "Common"
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    n = np.bincount(_OF_BLOCK[np.searchsorted(_STARTS, points, "right") - 1], minlength=len(_NAMES))
    n[_NAMES.index("Common")] = 0
    return _NAMES[int(n.argmax())] if n.any() else "Common"


def repeated_words(numbers: np.ndarray) -> int:
    """Words that stand in a window of three which is found twice or more."""
    n = len(numbers)
    if n <= WINDOW:
        return 0
    if numbers.max() < 1 << 21:  # three numbers go into 64 bits
        key = (numbers[:-2] << 42) | (numbers[1:-1] << 21) | numbers[2:]
    else:
        _, numbers = np.unique(numbers, return_inverse=True)
        _, pair = np.unique(numbers[:-2] * n + numbers[1:-1], return_inverse=True)
        key = pair * n + numbers[2:]
    _, key, times = np.unique(key, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(times[key] > 1)
    covered = np.zeros(n, bool)
    for k in range(WINDOW):
        covered[twice + k] = True
    return int(covered.sum())


def _measure(text: str, data: bytes, words: list[bytes], vocabularies: Vocabularies) -> tuple:
    symbols = sum(map(data.count, SYMBOLS))
    if not words:
        return (0, 0, symbols, 0, 0, True, "Common", *[None] * len(MEASURES))
    numbers = np.fromiter(map(vocabularies.number.__getitem__, words), np.int64, len(words))
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = [line for line in data.split(b"\n") if line.strip()]
    repeated = repeated_words(numbers)
    tokens, pieces = (flat.of(numbers) for flat in vocabularies.tokens)
    failed = len(words) < MIN_WORDS or 100 * repeated > MAX_REPEATED_PERCENT * len(words)
    share = vocabularies.is_byte[pieces].mean()
    found = [chars / len(tokens), chars / len(pieces), share, _entropy(tokens), _entropy(pieces)]
    thousandths = [min(10**8, round(1000 * x)) for x in found]
    return (len(words), chars, symbols, len(lines) - len(set(lines)), repeated, failed, script_of(text), *thousandths)


def _measured(texts: pa.Array, vocabularies: Vocabularies) -> Iterator[tuple]:
    """_measure() of each text; about STEP bytes are split into words at once."""
    at = 0
    while at < len(texts):
        held, seen, size = [], set(), 0
        while at < len(texts) and size < STEP:
            text = texts[at].as_py() or ""
            data = text.encode("utf-8", "replace")
            held.append((text, data, words := data.split()))
            seen.update(words)
            size, at = size + len(data), at + 1
        vocabularies.learn(seen)
        for text, data, words in held:
            yield _measure(text, data, words, vocabularies)


_OPEN: dict[tuple[str, str], Vocabularies] = {}


def measures(ranks_path: str, pieces_path: str):
    """A column function from a text to the struct FIELDS; a null text has no words, and a text without words no measures."""

    @F.arrow_udf(FIELDS_TYPE)
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        key = (ranks_path, pieces_path)
        if key not in _OPEN:
            _OPEN[key] = Vocabularies(*key)
        for batch in texts:
            columns = list(zip(*_measured(batch, _OPEN[key]), strict=True)) or [()] * len(ARROW)
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], fields=ARROW)

    return run


_ARROW_TYPES = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "int": pa.int32()}
ARROW = [pa.field(*(lambda n, t: (n, _ARROW_TYPES[t]))(*f.split())) for f in FIELDS.split(", ")]
FIELDS_TYPE = f"struct<{FIELDS.replace(' ', ':').replace(',:', ',')}>"


def _group(m: str = "m") -> list[F.Column]:
    """A text's language (null: none), its script, and its class of length."""
    size = F.floor(F.log2(F.greatest(F.col(f"{m}.n_words"), F.lit(1)))).cast("int")
    return [F.coalesce(F.nullif(F.lower(F.trim(F.col("lang").cast("string"))), F.lit("")), F.lit("-")).alias("_lang"), F.col(f"{m}.script").alias("_script"), size.alias("_class")]


def fit_bands(measured: DataFrame, reach: float = 3.0, floor: float = 0.1, least: int = 200) -> DataFrame:
    """_lang, _script, _class, and the bands (array of lo and hi, in the order of MEASURES) of such texts.

    measured has lang and m.  Texts that fail the base rules count for no band.  Quartiles are exact and over all texts.
    """
    rows = materialize(
        measured.where("not m.base_failed").select(*_group(), *[F.col(f"m.{c}") for c in MEASURES]).distinct(), "measures"
    )
    levels = [
        F.concat_ws("\t", F.lit("class"), "_lang", F.when(F.col("_lang") == "-", F.col("_script")).otherwise(""), F.col("_class").cast("string")),
        F.concat_ws("\t", F.lit("lang"), "_lang", F.when(F.col("_lang") == "-", F.col("_script")).otherwise("")),
        F.concat_ws("\t", F.lit("script"), "_script"),
    ]
    each = rows.select(F.explode(F.array(*levels)).alias("_key"), *MEASURES)
    quartiles = each.groupBy("_key").agg(F.count("*").alias("_n"), *[F.percentile(c, [0.25, 0.5, 0.75]).alias(c) for c in MEASURES])

    def fence(c: str) -> F.Column:
        low, mid, high = (F.col(c)[k] for k in range(3))
        slack = reach * (high - low)
        least_hi = F.lit(50.0) if c == "byte_share" else F.lit(0.0)  # a few bytes are no fault
        return F.struct(F.least(low - slack, mid * (1 - floor)).alias("lo"), F.greatest(high + slack, mid * (1 + floor), least_hi).alias("hi"))

    fitted = quartiles.where(F.col("_n") >= least).select("_key", F.array(*map(fence, MEASURES)).alias("bands"))
    # every group that has texts, also those that fail the base rules, takes the first level that has bands
    groups = measured.select(*_group()).distinct()
    for k, level in enumerate(levels):
        groups = groups.withColumn(f"_key{k}", level).join(fitted.select(F.col("_key").alias(f"_key{k}"), F.col("bands").alias(f"_bands{k}")), f"_key{k}", "left")
    fixed = lambda bands: F.array(*[F.struct(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for lo, hi in bands])
    wide = F.lit(None)
    for script, bands in WIDE.items():
        wide = F.when(F.col("_script") == script, fixed(bands))
    found = F.coalesce(*[F.col(f"_bands{k}") for k in range(len(levels))], wide, fixed(WIDEST))
    return materialize(groups.select("_lang", "_script", "_class", found.alias("bands")), "bands")


def judged(measured: DataFrame, bands: DataFrame) -> DataFrame:
    """measured with kept: the base rules hold and every measure lies within its group's band."""
    lang, script, size = _group()
    rows = measured.withColumns({"_l": lang, "_s": script, "_c": size})
    joined = rows.join(bands, (F.col("_l") == F.col("_lang")) & (F.col("_s") == F.col("_script")) & (F.col("_c") == F.col("_class")), "left")
    inside = F.lit(True)
    for k, c in enumerate(MEASURES):
        inside = inside & F.col(f"m.{c}").between(F.col("bands")[k]["lo"], F.col("bands")[k]["hi"])
    return joined.withColumn("kept", ~F.col("m.base_failed") & F.coalesce(inside, F.lit(False))).select(*measured.columns, "kept")


def quality(docs: DataFrame, ranks_path: str, pieces_path: str, reach: float = 3.0, floor: float = 0.1, least: int = 200) -> DataFrame:
    """doc_id, FIELDS (measures in thousandths), kept: the verdict on each row of docs.

    A null or blank text has no words and fails the base rules.  A null language is its text's script.  Repeated
    rows get the same verdict, ties at a band's end are kept, and further columns of docs are left out.  No rows
    give no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    measured = materialize(texts.select("doc_id", "lang", measures(ranks_path, pieces_path)("text").alias("m")), "fertility")
    found = judged(measured, fit_bands(measured, reach, floor, least))
    return found.select("doc_id", "lang", "m.*", "kept")


def keep_good(docs: DataFrame, ranks_path: str, pieces_path: str, reach: float = 3.0, floor: float = 0.1, least: int = 200) -> DataFrame:
    """The rows of docs, with all their columns, that quality() keeps."""
    rows = docs.select(carried(docs).alias("row"), F.col("lang").cast("string").alias("lang"), measures(ranks_path, pieces_path)(F.col("text").cast("string")).alias("m"))
    measured = materialize(rows, "fertility")
    found = judged(measured, fit_bands(measured, reach, floor, least))
    return returned(found.where("kept"), docs.columns)
