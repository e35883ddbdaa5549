"""BPE encoding and decoding in batched numpy merge rounds.

Texts are split by the tokenizer file's rules in flat code-point arrays: a class
table finds runs of letters, single digits and runs of other signs. Distinct
words that were not met before are encoded together: the symbols of all of them
lie in one flat array; in each round the key of every neighbouring pair is
looked up by binary search over the sorted keys of the merge table, and each
word merges its lowest-ranked pair. A word's ids are kept for later batches, in
a store of bounded size.

Defined results: a null or empty text has no ids and decodes to the empty text.
The strings of special tokens inside a text become their ids, as the tokenizers
library has it by default. Repeated rows and ties need no rule: every row is
encoded by itself; a very long text is encoded whole; an empty table gives no rows. Extra columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdanta.llm.cluster import short_batches
from verdanta.llm.textbatch import gather, run_hashes

#: Words whose ids a worker keeps; beyond that it starts anew.
STORE_WORDS = 400_000
#: Code points split at once.
CHUNK_CHARS = 1 << 18

LETTER, DIGIT, BLANK, SIGN = 0, 1, 2, 3
#: The contractions that the split pattern names, in its order (fixed by the tokenizer file).
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: White space by Unicode's property.
BLANKS = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    first = np.array([LETTER if (c := unicodedata.category(chr(i))[0]) == "L" else DIGIT if c == "N" else SIGN for i in range(0x110000)], np.uint8)
    first[list(BLANKS)] = BLANK
    return first


def normalised(text: str) -> str:
    """NFC, then lower case character by character (a capital sigma has no final form here)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            text = text.replace("Σ", "σ")
    return text.lower()


def split_words(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the words in an array of code points."""
    n = len(units)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes()[units]
    start = np.empty(n, bool)
    start[0] = True
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    mark = np.flatnonzero(start & (units == 0x27))
    mark = mark[mark + 1 < n]
    mark = mark[kind[mark + 1] == LETTER]
    if len(mark):
        a = units[mark + 1]
        b = np.where(mark + 2 < n, units[np.minimum(mark + 2, n - 1)], 0)
        length = np.zeros(len(mark), np.int64)
        for c in CONTRACTIONS:
            fits = (a == ord(c[0])) & ((b == ord(c[1])) if len(c) == 2 else True)
            length[(length == 0) & fits] = len(c)
        mark, length = mark[length > 0], length[length > 0]
        start[mark + 1] = False
        after = mark + 1 + length
        start[after[after < n]] = True
    starts = np.flatnonzero(start)
    lengths = np.diff(np.append(starts, n))
    keep = kind[starts] != BLANK
    return starts[keep], lengths[keep]


class WordBpe:
    """The vocabulary and merges of a tokenizer file, with a bounded store of encoded words."""

    def __init__(self, raw: bytes) -> None:
        spec = json.loads(raw)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {i: t for t, i in (vocab | self.special).items()}
        self.size = max(tokens) + 1
        suffix = model["end_of_word_suffix"]
        letters = byte_letters()
        self.first = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        into = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.into = keys[order], order.astype(np.int64), into[order]
        self.none = len(keys)
        spelled = [tokens.get(i, "").encode() + b" " for i in range(self.size)]
        self.spelling = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelling_at = np.concatenate([[0], np.cumsum([len(x) for x in spelled])])
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        self.ids, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words: ``symbols`` has the words' first symbols one after another."""
        n = len(lengths)
        word = np.repeat(np.arange(n), lengths)
        done_s, done_w = [], []
        while len(symbols):
            inner = word[:-1] == word[1:]
            key = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), self.none - 1)
            rank = np.where(inner & (self.keys[at] == key), self.rank[at], self.none)
            rank = np.append(rank, self.none)
            begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low = np.minimum.reduceat(rank, begin)
            size = np.diff(np.append(begin, len(word)))
            open_ = np.repeat(low < self.none, size)
            if not open_.all():
                done_s.append(symbols[~open_])
                done_w.append(word[~open_])
            hit = np.flatnonzero((rank == np.repeat(low, size)) & open_)
            if len(hit):
                # a pair of equal symbols can overlap itself: of a chain of hits every second one merges
                fresh = np.append(True, hit[1:] != hit[:-1] + 1)
                since = np.arange(len(hit)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
                hit = hit[since % 2 == 0]
                symbols = symbols.copy()
                symbols[hit] = self.into[at[hit]]
                open_[hit + 1] = False
            symbols, word = symbols[open_], word[open_]
        if not done_s:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        s, w = np.concatenate(done_s), np.concatenate(done_w)
        order = np.argsort(w, kind="stable")
        return s[order].astype(np.int32), np.bincount(w, minlength=n)

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Put new words into the store."""
        raw = [w.encode() for w in words]
        lengths = np.array([len(x) for x in raw], np.int64)
        units = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.first[units]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[units[ends]]
        ids, sizes = self.merge(symbols, lengths)
        place = np.arange(len(self.at) - 1, len(self.at) - 1 + len(words))
        self.ids = np.concatenate([self.ids, ids])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
        known, places = np.concatenate([self.known, hashes]), np.concatenate([self.place, place])
        order = np.argsort(known, kind="stable")
        self.known, self.place = known[order], places[order]

    def encode_chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of normalised texts one after another, and how many each has."""
        joined = "\n".join(texts)
        units = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts, lengths = split_words(units)
        begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        hashes = run_hashes(units, starts, lengths)
        distinct, sample, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > STORE_WORDS:
            self.clear()
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        if len(self.known):
            new = self.known[np.minimum(at, len(self.known) - 1)] != distinct
        if new.any():
            self.learn(distinct[new], [joined[starts[i] : starts[i] + lengths[i]] for i in sample[new]])
        place = self.place[np.searchsorted(self.known, distinct)]
        ids, sizes = gather(self.ids, self.at, place[which])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return ids, np.diff(ends[np.searchsorted(starts, begin)])

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of whole texts."""
        pieces: list[tuple[int, str | int]] = []
        for i, t in enumerate(texts):
            if t and self._split and "<|" in t:
                pieces += [(i, self.special[x] if x in self.special else x) for x in self._split.split(t) if x]
            elif t:
                pieces.append((i, t))
        found: list[list[np.ndarray]] = [[] for _ in texts]
        todo: list[tuple[int, str]] = []

        def flush() -> None:
            if todo:
                ids, sizes = self.encode_chunk([t for _, t in todo])
                for (i, _), part in zip(todo, np.split(ids, np.cumsum(sizes)[:-1])):
                    found[i].append(part)
                todo.clear()

        room = CHUNK_CHARS
        for i, x in pieces:
            if isinstance(x, int):
                flush()
                found[i].append(np.array([x], np.int32))
            else:
                todo.append((i, normalised(x)))
                room -= len(x)
            if room < 0 or isinstance(x, int):
                flush()
                room = CHUNK_CHARS
        flush()
        return [p[0] if len(p) == 1 else np.concatenate(p) if p else np.zeros(0, np.int32) for p in found]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The decoded text in UTF-8: the tokens' strings with a blank between (the file names no decoder)."""
        return gather(self.spelling, self.spelling_at, ids.astype(np.int64))[0].tobytes()[:-1]


_here: dict[str, WordBpe] = {}


def _coder(raw: bytes) -> WordBpe:
    key = hashlib.md5(raw).hexdigest()
    if key not in _here:
        _here.clear()
        _here[key] = WordBpe(raw)
    return _here[key]


def encode(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", ids: bool = False) -> DataFrame:
    """Encode and decode every whole text.

    ``tokenizer`` is the path of a tokenizer file that the driver can read; its
    content, of fixed size, goes to the executors as a broadcast variable.
    Returns per row: doc_id, n_tokens, ids_sha256, decoded_sha256, and with
    ``ids`` the token ids and the decoded text themselves.
    """
    short_batches(docs.sparkSession)
    with open(tokenizer, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    extra = [pa.field("ids", pa.list_(pa.int32())), pa.field("decoded", pa.string())] if ids else []
    fields = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string()), *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                coded = coder.encode_batch(part.column(1).to_pylist())
                plain = [coder.decode_bytes(x) for x in coded]
                out = [
                    part.column(0),
                    pa.array([len(x) for x in coded], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in coded]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in plain]),
                ]
                if ids:
                    out += [pa.array(coded, pa.list_(pa.int32())), pa.array([x.decode() for x in plain], pa.string())]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", *(f.name for f in fields)])
        coder.clear()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    more = ", ids array<int>, decoded string" if ids else ""
    return rows.mapInArrow(run, f"doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
