r"""LM scoring: a log-bilinear neural model, trained in numpy with noise-contrastive estimation.

Tokens are words (runs without white space, A-Z lower-cased) and one end after
each text. The model's symbols are the ``SYMBOLS`` most frequent words, the end,
and ``BUCKETS`` classes of all other words by their last bytes. With r the
context vectors and q the word vectors, the score of symbol w after symbol v is
(C r_v) . q_w + b_w; batched matrix products of all contexts with all symbols
give log-probabilities, normalised exactly by their sum. A word of a class has
its class's probability times its share (c + 0.1) / (sum + 0.1) among the words
of that class; one such share is left for all words never seen.

Everything gathered from the corpus covers all training texts: the counts of all
words, and the counts of all pairs of neighbouring symbols. Noise-contrastive
estimation draws its pairs from these counts, so training takes the same time at
any size. The pair counts are at most (SYMBOLS + BUCKETS + 1)**2 numbers; the
counts of the ``FREQUENT`` most frequent words are broadcast, those of other
words meet the texts' words in a shuffled join.

Defined results: a null, empty or blank text is the end token alone; a very long
text is scored whole; a null doc_id counts as the empty text in the fold; every
row of equal rows is scored; words of equal count are ranked by their hash; with
no training text all words are unknown and the model is uniform; an empty table
gives no rows. Extra columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdanta.llm.cluster import checkpoint, fold, least_of_top, short_batches
from verdanta.llm.textbatch import LOWER, text_chunks, word_hashes

FOLDS = 10
SYMBOLS, BUCKETS = 1000, 127
FREQUENT = 1 << 18
#: The end token's own hash: no word has it but by chance of 2**-64.
END = -0x5851F42D4C957F2D
DIM, STEPS, BATCH, NOISE, RATE = 32, 3000, 1024, 128, 0.2


def bucket_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each word's class: by its last three bytes."""
    code = np.zeros(len(ends), np.int64)
    for k in (1, 2, 3):
        at = ends - k
        code = code * 257 + np.where(at >= starts, LOWER[data[np.maximum(at, 0)]].astype(np.int64) + 1, 0)
    return (code * 2654435761 >> 7) % BUCKETS


def words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, word hashes, their classes, rows' bounds in them) by chunks."""
    for a, b, data, offsets in text_chunks(column):
        hashes, starts, ends, bounds = word_hashes(data, offsets)
        yield a, b, hashes.view(np.int64), bucket_of(data, starts, ends), bounds


def count_words(docs: DataFrame) -> DataFrame:
    """(w, g, c): every training token's hash, class and count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [(h, g) for _, _, h, g, _ in words(batch.column(0))]
            h = np.concatenate([x for x, _ in parts] + [np.full(batch.num_rows, END, np.int64)])
            g = np.concatenate([x for _, x in parts] + [np.full(batch.num_rows, -1, np.int64)])
            del parts
            w, first, c = np.unique(h, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(g[first].astype(np.int32)), pa.array(c)], names=["w", "g", "c"])

    return docs.mapInArrow(run, "w long, g int, c long").groupBy("w").agg(F.min("g").alias("g"), F.sum("c").alias("c"))


class Lexicon:
    """The frequent words: hash, count, and the symbol of the most frequent ones."""

    def __init__(self, w: np.ndarray, c: np.ndarray, g: np.ndarray) -> None:
        rank = np.lexsort((w, -c))
        symbol = np.full(len(w), -1, np.int64)
        real = rank[w[rank] != END][:SYMBOLS]
        symbol[real] = np.arange(len(real))
        symbol[w == END] = SYMBOLS
        by = np.argsort(w)
        self.w, self.c, self.symbol, self.g = w[by], c[by], symbol[by], g[by]

    def __call__(self, hashes: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, counts) of words; a count is -1 where the word is not a frequent one."""
        if not len(self.w):
            return SYMBOLS + 1 + classes, np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.w, hashes), len(self.w) - 1)
        known = self.w[at] == hashes
        symbol = np.where(known, self.symbol[at], -1)
        return np.where(symbol >= 0, symbol, SYMBOLS + 1 + classes), np.where(known, self.c[at], -1)


M = SYMBOLS + 1 + BUCKETS


def with_ends(symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, symbols with the ends, rows' bounds in them); the first context of a row is the end."""
    n = len(bounds) - 1
    row = np.repeat(np.arange(n), np.diff(bounds))
    out = np.full(len(symbols) + n, SYMBOLS, np.int64)
    out[np.arange(len(symbols)) + row] = symbols
    context = np.empty_like(out)
    context[1:] = out[:-1]
    context[:1] = SYMBOLS
    return context, out, bounds + np.arange(n + 1)


def count_pairs(docs: DataFrame, lexicon) -> DataFrame:
    """(cell, c): how often each symbol follows each; cell is context * M + symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex: Lexicon = lexicon.value
        for batch in batches:
            total = np.zeros(M * M, np.int64)
            for _, _, hashes, classes, bounds in words(batch.column(0)):
                context, symbol, _ = with_ends(lex(hashes, classes)[0], bounds)
                total += np.bincount(context * M + symbol, minlength=M * M)
            cell = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(total[cell])], names=["cell", "c"])

    return docs.mapInArrow(run, "cell int, c long").groupBy("cell").agg(F.sum("c").alias("c"))


def train(cells: np.ndarray, counts: np.ndarray, dim: int = DIM, steps: int = STEPS, batch: int = BATCH, noise: int = NOISE, rate: float = RATE, seed: int = 11) -> np.ndarray:
    """The table of log-probabilities [context, symbol], by noise-contrastive estimation from pair counts."""
    rng = np.random.default_rng(seed)
    unigram = np.bincount(cells % M, counts, M) + 0.1
    prior = unigram / unigram.sum()
    bias = np.log(prior)
    if not len(cells):
        return np.tile(bias - np.log(np.exp(bias).sum()), (M, 1)).astype(np.float32)
    bias = bias.astype(np.float32)
    context = (rng.standard_normal((M, dim)) * 0.1).astype(np.float32)
    link = np.eye(dim, dtype=np.float32)
    word = (rng.standard_normal((M, dim)) * 0.1).astype(np.float32)
    squares = [np.full_like(x, 1e-3) for x in (context, link, word, bias)]
    cumulative = np.cumsum(counts / counts.sum())
    noise_cumulative = np.cumsum(prior)
    log_noise = np.log(prior).astype(np.float32)
    for step in range(steps):
        drawn = cells[np.minimum(np.searchsorted(cumulative, rng.random(batch)), len(cells) - 1)]
        v, w = np.divmod(drawn, M)
        z = np.minimum(np.searchsorted(noise_cumulative, rng.random(noise)), M - 1)
        hidden = context[v] @ link
        # log odds of "from the data" against "one of the noise draws"; each noise draw serves the whole batch
        real = (hidden * word[w]).sum(1) + bias[w] - log_noise[w] - np.float32(np.log(noise))
        fake = hidden @ word[z].T + (bias[z] - log_noise[z] - np.float32(np.log(noise)))
        up = 1 / (1 + np.exp(np.clip(real, -40, 40)))  # pull of the real pairs
        down = -1 / (1 + np.exp(-np.clip(fake, -40, 40)))  # push of the noise
        g_hidden = up[:, None] * word[w] + down @ word[z]
        g_word = np.zeros_like(word)
        np.add.at(g_word, w, up[:, None] * hidden)
        np.add.at(g_word, z, down.T @ hidden)
        g_bias = (np.bincount(w, up, M) + np.bincount(z, down.sum(0), M)).astype(np.float32)
        g_link = context[v].T @ g_hidden
        g_context = np.zeros_like(context)
        np.add.at(g_context, v, g_hidden @ link.T)
        now = np.float32(rate * (1 - step / steps))
        for value, grad, square in zip((context, link, word, bias), (g_context, g_link, g_word, g_bias), squares):
            grad /= np.float32(batch)
            square += grad * grad
            value += now * grad / np.sqrt(square)
    logits = (context @ link).astype(np.float64) @ word.T + bias
    logits -= logits.max(1, keepdims=True)
    return (logits - np.log(np.exp(logits).sum(1, keepdims=True))).astype(np.float32)


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", folds: int = FOLDS) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    short_batches(spark)
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    training = named.where(fold(F.col("doc_id"), folds) != 0).select("text")
    counts = checkpoint(count_words(training))
    total, distinct = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    total = total or 0
    top = counts.where((F.col("c") >= least_of_top(counts, "c", FREQUENT)) | (F.col("w") == END))
    top = top.toPandas()  # at most FREQUENT rows and the end
    lex = Lexicon(*(top[c].to_numpy(np.int64) for c in ("w", "c", "g")))
    lexicon = spark.sparkContext.broadcast(lex)
    mass = np.full(BUCKETS, 0.1)
    for g, x in counts.where("g >= 0").groupBy("g").agg(F.sum(F.col("c") + 0.1)).collect():  # one row for each class
        mass[g] += x
    named_symbols = (lex.symbol >= 0) & (lex.symbol < SYMBOLS)
    np.subtract.at(mass, lex.g[named_symbols], lex.c[named_symbols] + 0.1)
    pairs = count_pairs(training, lexicon).toPandas()  # at most M * M rows
    table = train(pairs["cell"].to_numpy(np.int64), pairs["c"].to_numpy(np.float64)) / np.float32(np.log(10))
    model = spark.sparkContext.broadcast((table, np.log10(mass)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex: Lexicon = lexicon.value
        table, mass = model.value
        flat = table.ravel()
        ends = int(lex.c[lex.symbol == SYMBOLS].sum())
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                n = part.num_rows
                tokens, known, base, own, rare = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n), []
                for a, b, hashes, classes, bounds in words(part.column(1)):
                    symbol, count = lex(hashes, classes)
                    context, every, at = with_ends(symbol, bounds)
                    add = lambda x, y: np.diff(np.concatenate([[0], np.cumsum(x)])[y])
                    tokens[a:b] = np.diff(at)
                    known[a:b] = add(count > 0, bounds) + (ends > 0)
                    logs = np.where(count >= 0, np.log10(np.maximum(count, 0) + 0.1), 0.0)
                    base[a:b] = add(logs, bounds) + np.log10(ends + 0.1)
                    classed = symbol > SYMBOLS
                    own[a:b] = add(flat[context * M + every].astype(np.float64), at) + add(np.where(classed, logs - mass[classes], 0.0), bounds)
                    missing = np.flatnonzero(count < 0)
                    rare += np.split(hashes[missing], np.searchsorted(missing, bounds[1:-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tokens), pa.array(known), pa.array(base), pa.array(own), pa.array(rare, pa.list_(pa.int64()))], names=["doc_id", "n_tokens", "n_known", "base", "own", "rare"])

    rows = named.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base double, own double, rare array<long>")
    rows = checkpoint(rows.withColumn("row", F.monotonically_increasing_id()))
    unseen = float(np.log10(0.1))
    each = rows.select("row", F.explode("rare").alias("w")).groupBy("row", "w").agg(F.count(F.lit(1)).alias("k"))
    met = each.join(counts.select("w", "c"), "w").groupBy("row").agg(F.sum("k").alias("met"), F.sum(F.col("k") * (F.log10(F.col("c") + 0.1) - unseen)).alias("more"))
    out = rows.join(met, "row", "left")
    more = F.coalesce("more", F.lit(0.0)) + F.size("rare") * F.lit(unseen)
    norm = float(np.log10(total + 0.1 * (distinct + 1)))
    return out.select(
        "doc_id",
        (fold(F.col("doc_id"), folds) == 0).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("met", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * norm).alias("base_score"),
        (F.col("own") + more).alias("score"),
    )
