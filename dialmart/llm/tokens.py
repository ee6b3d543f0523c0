"""Token ids of whole texts, inside Arrow tasks.

The ids are those of the `tokenizers` library for the whole text.  Its word-level BPE looks at
one pre-token at a time, so a text made of Latin letters, digits and ASCII signs is cut into
pre-tokens here and each distinct one is given to the library's model once per worker; the
cache is bounded.  Any other text goes to the library word by word (white space never joins
words in this vocabulary), and texts that spell out a special token go to it whole.  All this holds
for the normalizer and pre-tokenizer that stand below; with a tokenizer file that has others, every
text goes to the library whole.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_ENTRIES = 1 << 20

_LETTERS = "a-zß-öø-ÿ"
_PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-ÿ]*")
_PRE_TOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")
_SPACE = re.compile("[ \t\n\r]+")
#: What a tokenizer file must say for the short cut to hold.
_NORMALIZER = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
    {"type": "Lowercase"},
]
_PRE_TOKENIZER = [
    {
        "type": "Split",
        "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
        "behavior": "Removed",
        "invert": True,
    },
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def _is_known(told: dict) -> bool:
    parts = lambda name, inner: (told.get(name) or {}).get(inner)
    model = told["model"]
    return (
        parts("normalizer", "normalizers") == _NORMALIZER
        and parts("pre_tokenizer", "pretokenizers") == _PRE_TOKENIZER
        and not (told.get("truncation") or told.get("padding") or model.get("dropout"))
        and model["type"] == "BPE"
        and not any(t["normalized"] or t["single_word"] for t in told["added_tokens"])
    )


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, spare = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in table:
            table[b] = chr(spare)
            spare += 1
    return [table[b] for b in range(256)]


class WordTokenizer:
    """Whole-text ids of one tokenizer file, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known = _is_known(json.loads(self.tokenizer.to_str()))
        self.letters = _byte_letters()
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.cache: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _pre_token(self, piece: str) -> bytes:
        got = self.parts.get(piece)
        if got is not None:
            return got
        shown = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
        got = np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()
        if len(self.parts) >= CACHE_ENTRIES // 4:
            self.parts.clear()
        self.parts[piece] = got
        return got

    def _plain_word(self, word: str) -> bytes:
        return b"".join(self._pre_token(p) for p in _PRE_TOKEN.findall(word))

    def _plain(self, text: str) -> bytes:
        words = text.lower().split()
        cache = self.cache
        try:
            return b"".join(map(cache.__getitem__, words))
        except KeyError:
            new = {w for w in words if w not in cache}
        if len(cache) + len(new) > CACHE_ENTRIES:
            cache.clear()
            new = set(words)
        cache.update((w, self._plain_word(w)) for w in new)
        return b"".join(map(cache.__getitem__, words))

    def _other_word(self, word: str) -> bytes:
        if _PLAIN.fullmatch(word):
            return self._plain(word)
        got = self.words.get(word)
        if got is None:
            if len(self.words) >= CACHE_ENTRIES // 8:
                self.words.clear()
            got = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
            if len(word) < 64:
                self.words[word] = got
        return got

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.known or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if _PLAIN.fullmatch(text):
            return self._plain(text)
        return b"".join(self._other_word(w) for w in _SPACE.split(text) if w)


_OPEN: dict[str, WordTokenizer] = {}


def tokenizer_for(path: str) -> WordTokenizer:
    """One tokenizer for each Python worker, kept between tasks."""
    if path not in _OPEN:
        _OPEN[path] = WordTokenizer(path)
    return _OPEN[path]


def token_pieces(
    docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, with_ids: bool = True
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (array<int>).

    A document is its ids, then end_id; a document longer than capacity is cut into pieces of
    capacity ids, the last of which may be shorter.  A null or empty text is end_id alone.
    Repeated rows give repeated pieces; a null doc_id stays null.  Further columns of docs are left
    out.  No rows give no rows.
    """
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long"
    schema += ", ids array<int>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = tokenizer_for(tokenizer_path), int(end_id).to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = tok.encode(text) + end
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part), part))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            arrays = [
                pa.array(cols[0], pa.int64()),
                pa.array(cols[1], pa.int32()),
                pa.array(cols[2], pa.int64()),
                pa.array(cols[3], pa.int32()),
                pa.array(cols[4], pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                flat = np.frombuffer(b"".join(cols[5]), "<i4")
                ends = np.concatenate([[0], np.cumsum(np.array(cols[3], np.int64))]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
