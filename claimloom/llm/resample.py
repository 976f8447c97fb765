"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

A text's features are its words and punctuation runs, their bigrams, and trigrams of shapes (case, length,
digits, which punctuation, equal to the one before), hashed into BUCKETS. The raw model counts the features of all
documents, the target model those of the good documents of a bounded sample of labelled rows; a document's
log importance weight is the sum over its features of log p_target - log p_raw. The cut on weights that parts the
sample's good and bad documents best says how many of all documents are wanted, k; these are drawn by Gumbel top-k, that is, the k documents with the largest weight plus Gumbel noise, which samples without
replacement in proportion to the weights' exponentials. The noise comes from a hash of the id.

Counts leave a task as at most BUCKETS rows; the driver sees BUCKETS sums, the sample's weights and the histograms
(65,536 rows at most, four times) by which the exact k-th largest key is found among any number.

Defined results: null, empty and featureless texts have weight 0 and compete as such, with one word less than any
text like the target's; ties with the k-th key are all kept, so repeated rows share their fate; a very long text weighs as the
sum of its features; of rows that share a labelled id the least weight sets the cut; null labels are
no labels; without labelled rows of both kinds all documents are kept. Extra columns are passed through by
keep_documents and ignored by score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import common

BUCKETS, SAMPLE, SEED = 1 << 16, 20_000, 17
_TOKEN = re.compile(r"\w+|[^\w\s]+")


class TokenCodes(dict):
    """token -> 32 bits of hash of its lower case, and its shape above them."""

    def __missing__(self, token: str) -> int:
        if len(self) > 300_000:
            self.clear()
        if token[0].isalnum() or token[0] == "_":
            shape = 1 if token.isdigit() else 2 if token.islower() else 3 if token.istitle() else 4 if token.isupper() else 5
            shape = shape * 4 + min(3, len(token) // 4)
        else:
            shape = 24 + xxhash.xxh32_intdigest(token) % 232
        found = self[token] = xxhash.xxh32_intdigest(token.lower()) | shape << 32
        return found


def features(text: bytes | None, codes: TokenCodes) -> np.ndarray:
    """Buckets of all features of a text."""
    tokens = _TOKEN.findall(text.decode()) if text else []
    if not tokens:
        return np.empty(0, np.int64)
    code = np.fromiter(map(codes.__getitem__, tokens), np.uint64, len(tokens))
    word = code & np.uint64(0xFFFFFFFF)
    shape = code >> np.uint64(32)
    shape[1:] = np.where(word[1:] == word[:-1], np.uint64(0), shape[1:])
    both = word[:-1] * np.uint64(0x9E3779B1) + word[1:] + np.uint64(1 << 40)
    three = (shape[:-2] << np.uint64(16) | shape[1:-1] << np.uint64(8) | shape[2:]) + np.uint64(1 << 50)
    mixed = np.concatenate([word, both, three]) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def sample_of(labels: DataFrame, label_col: str, size: int, id_col: str) -> dict:
    """id -> label of at most `size` labelled rows, the first by hash of id."""
    rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).cast("int").alias("y"))
    return {r[0]: r[1] for r in rows.orderBy(F.xxhash64(id_col), id_col).limit(size).collect()}


def fit(docs: DataFrame, sample: dict, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """log p_target - log p_raw of every bucket."""
    good = docs.sparkSession.sparkContext.broadcast({k for k, y in sample.items() if y > 0})

    def rows(parts: Iterator) -> Iterator[dict[str, list]]:
        codes, target = TokenCodes(), good.value
        sums = np.zeros((2, BUCKETS), np.int64)
        for keys, texts in parts:
            for key, text in zip(keys, texts):
                counts = np.bincount(features(text, codes), minlength=BUCKETS)
                sums[0] += counts
                if key in target:
                    sums[1] += counts
        at = np.flatnonzero(sums[0])
        yield {"bucket": at, "raw": sums[0][at], "target": sums[1][at]}

    counted = common.map_text(docs, rows, "bucket long, raw long, target long", id_col, text_col)
    sums = np.zeros((2, BUCKETS))
    for r in counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        sums[:, r.bucket] = r.raw, r.target
    good.unpersist()
    raw = (sums[0] + 1) / (sums[0].sum() + BUCKETS)
    # the target is smoothed towards the raw model
    return np.log((sums[1] + raw * BUCKETS) / (sums[1].sum() + BUCKETS)) - np.log(raw)


def ordered(x: np.ndarray) -> np.ndarray:
    """int64 in the order of float64."""
    bits = (x + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def noise(key: object, seed: int) -> float:
    u = (xxhash.xxh64_intdigest(str(key), seed) + 0.5) / 2.0**64
    return float(-np.log(-np.log(u)))


def weigh(keys: list, texts: list[bytes | None], ratio: np.ndarray, codes: TokenCodes, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Log weights, and with Gumbel noise."""
    w = np.array([ratio[f].sum() if len(f := features(t, codes)) else 0.0 for t in texts])
    return w, w + np.array([noise(k, seed) for k in keys])


def weights(docs: DataFrame, ratio: np.ndarray, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, log_weight, gumbel_key, and the key as an ordered long."""
    given = docs.sparkSession.sparkContext.broadcast(ratio)

    def rows(parts: Iterator) -> Iterator[dict[str, list]]:
        codes = TokenCodes()
        for keys, texts in parts:
            w, g = weigh(keys, texts, given.value, codes, seed)
            yield {id_col: keys, "log_weight": w, "gumbel_key": g, "ordered_key": ordered(g)}

    return common.map_text(docs, rows, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, log_weight double, gumbel_key double, ordered_key long", id_col, text_col)


def kth_largest(df: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest long, by histograms of 16 bits at a time; None if there are fewer."""
    if k < 1:
        return None
    prefix = None
    for shift in (48, 32, 16, 0):
        part = F.shiftright(F.col(column), shift)
        inside = df if prefix is None else df.where(F.shiftright(F.col(column), shift + 16) == prefix)
        bins = sorted(((r.p, r.n) for r in inside.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()), reverse=True)
        for prefix, n in bins:
            if k <= n:
                break
            k -= n
        else:
            return None
    return prefix


def best_cut(weight: np.ndarray, good: np.ndarray) -> float | None:
    """The weight with the best mean of good shares above and bad shares below it, in the middle of its gap."""
    if good.all() or not good.any():
        return None
    order = np.argsort(weight, kind="stable")
    weight, good = weight[order], good[order]
    # a cut before place i: good from i on are kept, bad before i are rejected
    gain = np.append(0, np.cumsum(np.where(good, -1 / good.sum(), 1 / (~good).sum())))
    gain[1:-1][weight[1:] == weight[:-1]] = -1
    i = int(np.argmax(gain))
    return float(weight[0] - 1 if i == 0 else weight[-1] + 1 if i == len(weight) else (weight[i - 1] + weight[i]) / 2)


def selection(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[DataFrame, np.ndarray, int | None]:
    """Weights of all documents, the ratio of the models, and the least key of those that are kept (None: all are)."""
    chosen = sample_of(labels, label_col, sample, id_col)
    ratio = fit(docs, chosen, id_col, text_col)
    found = common.cut(weights(docs, ratio, seed, id_col, text_col))
    spark = docs.sparkSession
    known = spark.createDataFrame(list(chosen.items()) or [(None, 0)], docs.select(F.col(id_col), F.lit(0).alias("y")).schema)
    labelled = found.join(F.broadcast(known), id_col).groupBy(id_col, "y").agg(F.min("log_weight").alias("w"))  # a row to each of at most `sample` ids
    judged = sorted((r.w, r.y) for r in labelled.collect())
    least = best_cut(np.array([w for w, _ in judged]), np.array([y > 0 for _, y in judged], bool))
    if least is None:
        return found, ratio, None
    k = found.where(F.col("log_weight") >= least).count()
    return found, ratio, kth_largest(found, "ordered_key", k)


def score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, log_weight, gumbel_key, kept: one row per row of docs."""
    found, _, least = selection(docs, labels, **options)
    return found.withColumn("kept", F.lit(True) if least is None else F.col("ordered_key") >= least).drop("ordered_key")


def keep_documents(docs: DataFrame, labels: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents drawn, with all their columns. Weights are computed again beside the texts rather than joined to them."""
    _, ratio, least = selection(docs, labels, seed=seed, id_col=id_col, text_col=text_col, **options)
    if least is None:
        return docs
    given, codes = docs.sparkSession.sparkContext.broadcast(ratio), TokenCodes()

    def drawn(keys: list, texts: list[bytes | None]) -> list[bool]:
        return (ordered(weigh(keys, texts, given.value, codes, seed)[1]) >= least).tolist()

    return common.keep_rows(docs, drawn, id_col, text_col)


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
