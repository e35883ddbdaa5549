"""Calls to outside models behind one interface, with caches keyed by content; offline defaults need no network.

A provider is a Python function from a list of dictionaries to a list of the
same length. It runs in ``mapInPandas`` on distinct requests only; answers are
joined back, so a repeated request costs one call.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdanta.functions import vocab as V

Provider = Callable[[list[dict]], list[dict]]
VERDICT = "verification string, confidence string, explanation string"
ENRICHMENT = "metric string, unit string, datatype string, applicability string"


def offline_category(items: list[dict]) -> list[dict]:
    return [{"category": "Other"} for _ in items]


def offline_verdict(items: list[dict]) -> list[dict]:
    return [{"verification": "Disagree", "confidence": "Low", "explanation": "Verification skipped"} for _ in items]


def offline_enrichment(items: list[dict]) -> list[dict]:
    return [{"metric": None, "unit": None, "datatype": None, "applicability": None} for _ in items]


def call(requests: DataFrame, provider: Provider, answer: str, chunk: int = 15) -> DataFrame:
    """``requests`` with the answer's columns; a chunk whose call fails, or answers at another length, gets nulls."""
    names = [c.split()[0] for c in answer.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), chunk):
                part = frame.iloc[a : a + chunk]
                try:
                    found = provider(part.to_dict("records"))
                    if len(found) != len(part):
                        raise ValueError("another number of answers")
                except Exception:  # a provider may fail in any way; the work goes on without it
                    found = [{} for _ in range(len(part))]
                yield part.assign(**{n: [x.get(n) for x in found] for n in names})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields)
    return requests.mapInPandas(run, f"{schema}, {answer}")


def misses(requests: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct requests that the cache doesn't have."""
    return requests.select(*keys).distinct().join(cache.select(*keys), keys, "left_anti")


def through_cache(requests: DataFrame, cache: DataFrame, keys: list[str], provider: Provider, answer: str) -> tuple[DataFrame, DataFrame]:
    """(requests with answers, new cache entries): cached answers first, calls for the distinct misses only."""
    names = [c.split()[0] for c in answer.split(", ")]
    new = call(misses(requests, cache, keys), provider, answer)
    known = cache.select(*keys, *names).unionByName(new)
    return requests.join(known, keys, "left"), new


def classify_concepts(concepts: DataFrame, cache: DataFrame, provider: Provider = offline_category) -> tuple[DataFrame, DataFrame]:
    """Categories of concepts without a keyword; an answer that is no category counts as Other."""
    out, new = through_cache(concepts, cache, ["concept"], provider, "category string")
    valid = F.when(F.col("category").isin(V.CATEGORIES), F.col("category")).otherwise("Other")
    return out.withColumn("category", valid), new.withColumn("category", valid)


def enrich(items: DataFrame, provider: Provider = offline_enrichment, least: int = 15, most: int = 1500) -> DataFrame:
    """Items (id, text) with metric, unit, datatype and applicability; texts of under ``least`` characters aren't asked about, of longer ones the first ``most`` characters are."""
    asked = items.where(F.length("text") >= least).select(F.left("text", F.lit(most)).alias("text")).distinct()
    found = call(asked, provider, ENRICHMENT)
    return items.withColumn("_t", F.left("text", F.lit(most))).join(found.withColumnRenamed("text", "_t"), "_t", "left").drop("_t")


def verify(mappings: DataFrame, provider: Provider = offline_verdict) -> DataFrame:
    """Mappings (pair_id, ...) with a verdict; no or a malformed answer counts as Disagree, Low."""
    out = call(mappings, provider, VERDICT)
    return out.withColumns(
        {
            "verification": F.when(F.col("verification").isin("Agree", "Disagree"), F.col("verification")).otherwise("Disagree"),
            "confidence": F.when(F.col("verification").isNull(), "Low").when(F.col("confidence").isin("High", "Medium", "Low"), F.col("confidence")).otherwise("Medium"),
            "explanation": F.coalesce("explanation", F.lit("Verification skipped or failed")),
        }
    )


def verify_one(provider: Provider, item: dict) -> tuple[str, str]:
    """(verification, explanation) of a single mapping."""
    found = provider([item])[0]
    return found.get("verification", "Disagree"), found.get("explanation", "")


def open_items(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work that the checkpoint doesn't have: only unfinished batches run again."""
    return items.join(done.select(*keys), keys, "left_anti")


def prompts(batch_items: DataFrame, head: str) -> DataFrame:
    """(model, batch, prompt, key): one numbered prompt for each batch, and its cache key."""
    line = F.format_string("%d. %s <-> %s", F.col("pos"), F.col("s_label"), F.col("t_label"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda x: x["l"]), "\n")
    out = batch_items.groupBy("model", "batch").agg(F.concat(F.lit(head + "\n"), lines).alias("prompt"))
    return out.withColumn("key", F.concat_ws(":", "model", F.md5("prompt")))


def schedule(models: DataFrame) -> DataFrame:
    """Models in their scheduling order, unknown ones last by name."""
    place = F.array_position(F.array(*[F.lit(m) for m in V.ANNOTATORS]), F.col("model"))
    return models.withColumn("place", F.when(place == 0, 1000).otherwise(place)).orderBy("place", "model")


def status(has_key: Column, http: Column, done: Column) -> Column:
    """A provider's state from its key, its last HTTP status and whether its items are done."""
    return (
        F.when(~has_key, "Skipped").when(done, "Completed").when(http == 429, "Rate Limited").when(http == 402, "No Credits").when(http == 401, "Invalid API Key").when(http == 403, "Permission Denied").when(http.isNull() | (http < 400), "Available").otherwise("Offline")
    )


def with_retries(send: Callable[[], tuple[int, dict, object]], tries: int = 5, sleep: Callable[[float], None] = time.sleep, noise: Callable[[], float] = random.random) -> object:
    """The body of the first good reply of ``send`` (status, headers, body).

    Too many requests: wait as told, up to 30 s, or 5 s doubling; server errors:
    3 s doubling; a lost connection: three more tries, a timeout two; refusals
    (401, 402, 403) and other errors end it.
    """
    lost = late = 0
    for k in range(tries):
        try:
            code, headers, body = send()
        except TimeoutError:
            late += 1
            if late > 2:
                raise
            sleep(15.0)
            continue
        except ConnectionError:
            lost += 1
            if lost > 3:
                raise
            sleep(3.0 * 2**k)
            continue
        if code < 400:
            return body
        if code == 429:
            told = str(headers.get("Retry-After", ""))
            sleep(min(30.0, float(told)) if told.replace(".", "", 1).isdigit() else 5.0 * 2**k + noise())
        elif code >= 500:
            sleep(3.0 * 2**k)
        else:
            raise PermissionError(f"refused with status {code}")
    raise ConnectionError("no good reply")


def embed_missing(texts: DataFrame, cache: DataFrame, encode: Callable[[list[str]], list[list[float]]] | None = None, size: int = 768) -> tuple[DataFrame, DataFrame]:
    """(texts with embeddings, new cache rows), keyed by md5 of the text; without an encoder zeros."""
    keyed = texts.withColumn("key", F.md5("text"))
    todo = keyed.select("key", "text").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = encode(frame["text"].tolist()) if encode else [[0.0] * size for _ in range(len(frame))]
            yield pd.DataFrame({"key": frame["key"], "embedding": found})

    new = todo.mapInPandas(run, "key string, embedding array<float>")
    return keyed.join(cache.select("key", "embedding").unionByName(new), "key", "left"), new
