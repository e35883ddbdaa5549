r"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (3 to 5, with word ends) and itself,
each hashed to one of ``2**bits`` buckets; a word's vector is the mean of its
buckets' vectors and a text's vector the mean of its words'. A softmax layer
gives the two classes. Embeddings and layer are learnt together by stochastic
gradient descent, so a misspelling that was never seen shares most of its n-gram
vectors with the word it comes from. Every bucket of the sampled texts is learnt,
however few texts have it; the decay keeps the rare ones small.

As everything up to the softmax is a mean, the trained model folds into one
number per bucket, and a text is scored from one number per distinct word.

The model is fitted on a bounded sample: at most ``per_class`` labelled rows of
each label, the same at any size of input, chosen by a hash of the id, with their
whole texts, and never a held-out row; the driver gets each such text as its
distinct words and their counts. Scoring reads every row's whole text. Defined
results: a null or empty text is scored from the bias alone; a very long text is
read and scored whole; a doc_id labelled more than once is toxic if one of its
labels is; a doc_id with several rows is learnt from once, by the smallest text,
and each of its rows is scored; with no labelled row of one class, every score is
the other class's smoothed share; an empty table gives no rows. Columns of any
name come through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdanta.llm.cluster import fold, short_batches
from verdanta.llm.textbatch import find_words, gather, mix, powers, run_hashes, text_chunks

BITS = 18
DIM = 8
FOLDS = 5
PER_CLASS = 2500
EPOCHS = 10
RATE = 0.05
#: A text's mean is multiplied by this before the softmax: a toxic word is one of a hundred.
GAIN = 40.0
#: Words of zero value that every text is averaged with: a text of two words says little.
PRIOR_WORDS = 10
#: Words whose values a task keeps, and new words whose buckets are looked up at once.
STORE_WORDS, NEW_WORDS = 500_000, 10_000


def words_of(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " ")


def word_buckets(words: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words one after another, and how many each word has."""
    joined = "".join(f"<{w}>" for w in words)
    units = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    first = np.cumsum(sizes) - sizes
    left = np.repeat(first + sizes, sizes) - np.arange(len(units))  # units to the word's end
    owner = np.repeat(np.arange(len(words)), sizes)
    base = powers(8)
    found, owners = [run_hashes(units, first, sizes)], [np.arange(len(words))]
    for n in (3, 4, 5):
        if len(units) >= n:
            total = sum(units[k : len(units) - n + 1 + k].astype(np.uint64) * base[k + 1] for k in range(n)) + np.uint64(n)
            ok = left[: len(units) - n + 1] >= n
            found.append(mix(total[ok]))
            owners.append(owner[: len(units) - n + 1][ok])
    bucket, who = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(who, kind="stable")
    return (bucket[order] & np.uint64((1 << bits) - 1)).astype(np.int64), np.bincount(who, minlength=len(words))


def chunk_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its start, its end, each row's bounds in them)."""
    starts, ends, bounds = find_words(data, offsets)
    return run_hashes(data, starts, ends - starts), starts, ends, bounds


class WordValues:
    """The folded model: a number for each word, kept once it was computed."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        self.bits = len(values).bit_length() - 1
        self.known, self.value = np.zeros(0, np.uint64), np.zeros(0)

    def __call__(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        distinct, sample, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > STORE_WORDS:
            self.known, self.value = np.zeros(0, np.uint64), np.zeros(0)
        at = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
        new = self.known[at] != distinct if len(self.known) else np.ones(len(distinct), bool)
        if new.any():
            raw, where, parts = data.tobytes(), sample[new], []
            for i in range(0, len(where), NEW_WORDS):
                own = where[i : i + NEW_WORDS]
                buckets, sizes = word_buckets([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[own], ends[own])], self.bits)
                parts.append(np.add.reduceat(self.values[buckets], np.cumsum(sizes) - sizes) / sizes)
            fresh = np.concatenate(parts)
            known = np.concatenate([self.known, distinct[new]])
            order = np.argsort(known, kind="stable")
            self.known, self.value = known[order], np.concatenate([self.value, fresh])[order]
        return self.value[np.searchsorted(self.known, distinct)][which]


def text_means(values: WordValues, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    hashes, starts, ends, bounds = chunk_words(data, offsets)
    if not len(hashes):
        return np.zeros(len(offsets) - 1)
    total = np.concatenate([[0.0], np.cumsum(values(data, hashes, starts, ends))])
    n = np.diff(bounds)
    return (total[bounds[1:]] - total[bounds[:-1]]) / (n + PRIOR_WORDS)


class Sample:
    """Texts as word numbers and weights, and each word's buckets once, however many texts have it."""

    def __init__(self, texts: Iterable[tuple[Sequence[str], Sequence[int]]], bits: int = BITS) -> None:
        known: dict[str, int] = {}
        self.docs: list[tuple[np.ndarray, np.ndarray]] = []
        for words, counts in texts:
            ids = np.array([known.setdefault(w, len(known)) for w in words], np.int32)
            counts = np.asarray(counts, np.float64)
            self.docs.append((ids, (counts / (counts.sum() + PRIOR_WORDS)).astype(np.float32)))
        words, parts, sizes = list(known), [], []
        del known
        for i in range(0, len(words), NEW_WORDS):
            bucket, n = word_buckets(words[i : i + NEW_WORDS], bits)
            parts.append(bucket.astype(np.int32))
            sizes.append(n)
        self.buckets = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self.at = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, np.int64)


def _summed(values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, the rows of ``values`` summed by key)."""
    order = np.argsort(keys, kind="stable")
    at = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
    return keys[order][at], np.add.reduceat(values[order], at, axis=0)


def train(texts: Iterable[tuple[Sequence[str], Sequence[int]]], toxic: np.ndarray, prior: float, bits: int = BITS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7, decay: float = 1e-4, batch: int = 16) -> tuple[np.ndarray, float]:
    """(a number per bucket, bias): the folded model, its bias moved to the share ``prior`` of toxic rows.

    A text is given as its distinct words and their counts.
    """
    toxic = np.asarray(toxic, np.float32)
    share = float(toxic.mean()) if len(toxic) else 0.0
    if share in (0.0, 1.0):
        smooth = (toxic.sum() + 0.5) / (len(toxic) + 1)
        return np.zeros(1 << bits, np.float32), float(np.log(smooth / (1 - smooth)))
    rng = np.random.default_rng(seed)
    embed = np.zeros((1 << bits, dim), np.float32)
    layer = (rng.standard_normal((dim, 2)) * 0.5).astype(np.float32)
    bias = np.log(np.array([1 - share, share], np.float32))
    sample = Sample(texts, bits)
    docs = sample.docs
    square = np.full(1 << bits, 1e-6, np.float32)
    square2, square3 = np.full_like(layer, 1e-2), np.full_like(bias, 1e-2)
    steps = epochs * -(-len(docs) // batch)
    done = 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for a in range(0, len(order), batch):
            own = order[a : a + batch]
            step = rate * (1 - done / steps)
            done += 1
            sizes = np.array([len(docs[i][0]) for i in own])
            if not sizes.sum():
                continue
            weight = np.concatenate([docs[i][1] for i in own]) * np.float32(GAIN)
            row = np.repeat(np.arange(len(own)), sizes)
            words, which = np.unique(np.concatenate([docs[i][0] for i in own]), return_inverse=True)
            index, n = gather(sample.buckets, sample.at, words)
            first = np.cumsum(n) - n
            vectors = np.add.reduceat(embed[index], first, axis=0) / n[:, None].astype(np.float32)
            hidden = np.zeros((len(own), dim), np.float32)
            full = sizes > 0
            hidden[full] = np.add.reduceat(vectors[which] * weight[:, None], (np.cumsum(sizes) - sizes)[full], axis=0)
            logits = hidden @ layer + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), toxic[own].astype(int)] -= 1
            _, back = _summed((p @ layer.T / len(own))[row] * weight[:, None], which)  # by word
            touched, grad = _summed(np.repeat(back / n[:, None].astype(np.float32), n, axis=0), index)
            grad += np.float32(decay) * embed[touched]
            square[touched] += (grad * grad).mean(1)
            embed[touched] -= step * grad / np.sqrt(square[touched])[:, None]
            grad2, grad3 = hidden.T @ p / len(own), p.mean(0)
            square2 += grad2 * grad2
            square3 += grad3 * grad3
            layer -= step * grad2 / np.sqrt(square2)
            bias -= step * grad3 / np.sqrt(square3)
    folded = (embed @ (layer[:, 1] - layer[:, 0])) * np.float32(GAIN)
    shift = np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return folded.astype(np.float32), float(bias[1] - bias[0] + shift)


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text as its distinct words with a blank between, and how often it has them."""
    for batch in batches:
        for part in (batch.slice(i, 100) for i in range(0, batch.num_rows, 100)):
            own = [Counter(t.split()) for t in part.column(2).to_pylist()]
            words = pa.array([" ".join(c) for c in own], pa.string())
            counts = pa.array([np.fromiter(c.values(), np.int32, len(c)).tobytes() for c in own], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), words, counts], names=["_id", "_toxic", "words", "counts"])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", per_class: int = PER_CLASS, folds: int = FOLDS, **options) -> tuple[np.ndarray, float]:
    """Train on the bounded sample of rows outside the held-out fold."""
    short_batches(docs.sparkSession)
    marks = labels.select(F.col(doc_id).cast("long").alias("_id"), F.col(label).cast("int").alias("_toxic")).where("_id is not null and _toxic in (0, 1)")
    marks = marks.groupBy("_id").agg(F.max("_toxic").alias("_toxic")).where(fold(F.col("_id"), folds) != 0)
    counts = {r[0]: r[1] for r in marks.groupBy("_toxic").count().collect()}
    chosen = None
    for k in (0, 1):
        part = marks.where(F.col("_toxic") == k).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"))
    rows = rows.join(F.broadcast(chosen), "_id")  # at most two times per_class ids
    rows = rows.groupBy("_id", "_toxic").agg(F.min("_text").alias("_text"))  # a repeated id counts once
    sample = rows.select("_id", "_toxic", words_of(F.col("_text")).alias("_text")).mapInArrow(_histograms, "_id long, _toxic int, words string, counts binary")
    sample = sample.toArrow().sort_by("_id")
    prior = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
    texts = ((w.as_py().split(), np.frombuffer(c.as_py(), np.int32)) for w, c in zip(sample.column("words"), sample.column("counts")))
    return train(texts, sample.column("_toxic").to_numpy(), prior, **options)


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with a column ``name`` between 0 and 1; one of that name is replaced."""
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # 2**bits numbers

    @F.arrow_udf("double")
    def scored(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        folded, bias = shared.value
        values = WordValues(folded)
        for column in columns:
            out = np.zeros(len(column))
            for a, b, data, offsets in text_chunks(column):
                out[a:b] = text_means(values, data, offsets)
            yield pa.array(1 / (1 + np.exp(-np.clip(out + bias, -500, 500))))

    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() != name]
    return docs.select(*[F.col(f"`{c}`") for c in kept], scored(words_of(F.col(f"`{text}`"))).alias(name))


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    rows = score(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), fit(docs, labels, text, doc_id), keep=["doc_id"])
    return rows.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
