"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

A document's set holds its distinct 5-word shingles, as 64-bit hashes. The sketch has BINS coordinates. In
round i every shingle is hashed to one coordinate with a value led by i; a coordinate keeps its least
value, so what a round fills no later round changes, and rounds stop once all are filled. After BINS rounds,
one more round per coordinate that is still empty hashes every shingle to it: all coordinates fill, however
small the set, and the share of equal coordinates estimates the Jaccard similarity with concentration as of
independent samples.

Documents with equal sets (a 128-bit sum of hashes) form a class, represented by its smallest id, by one
aggregate; only representatives go on. Each has a key per band of ROWS coordinates; with 25 bands of 5 a pair
at the limit of 0.85 shares no key once in two million times. Documents that share a key are a bucket. In
a bucket all members are compared with its hub, the member with the largest buckets, so that a bucket costs as
many comparisons as it has members. Those comparisons bound all others: two members share at most the smaller of
their parts in the hub, and of their other shingles at most the smaller number that is not theirs alone. Members
whose component then differs from the hub's and that could reach the limit with some set of the bucket are compared with the members of other
components that the bounds leave. So every pair of a bucket is compared, already linked, or proven to be apart: nothing is
capped. Comparisons are exact, on full sets, and components come from rounds of large-star and small-star.

Defined results: a document without words has an empty set, is its own component and kept; one with fewer
than five words has the whole sequence as its one shingle; repeated rows and equal texts are linked. Rows that
share an id count as one document (linked by the smallest of their texts). A null id is left out of linking and not
kept. Extra columns are passed through by keep_documents and ignored by components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import common

WIDTH, BINS, BANDS, ROWS, PERCENT = 5, 128, 25, 5, 85
MARKS = 1 << 22  # hashes of ids that are told apart when texts are picked
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.arange(1, 2 * BINS + 1, dtype=np.uint64) * _MUL


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hashes of words, computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def shingles(words: list[bytes], hashes: WordHashes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(width, len(words))
    out = h[: len(h) - size + 1].copy()
    for i in range(1, size):
        out = out * _MUL + h[i : len(h) - size + 1 + i]
    return np.unique(mix(out + np.uint64(size)))


def sketch(s: np.ndarray) -> np.ndarray:
    """BINS coordinates of a set that is not empty."""
    out = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    done, at_once = 0, max(1, min(BINS, -(-600 // len(s))))
    while done < BINS:
        i = np.arange(done, min(BINS, done + at_once))
        z = mix(s[None, :] ^ _SEEDS[i][:, None])
        value = (i.astype(np.uint64) << np.uint64(48))[:, None] | (z >> np.uint64(16))
        np.minimum.at(out, (z & np.uint64(BINS - 1)).astype(np.intp).ravel(), value.ravel())
        done = int(i[-1]) + 1
        if out.max() != np.iinfo(np.uint64).max:
            return out
    for b in np.flatnonzero(out == np.iinfo(np.uint64).max):
        out[b] = np.uint64(BINS + b) << np.uint64(48) | (mix(s ^ _SEEDS[BINS + b]) >> np.uint64(16)).min()
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    rows = coordinates[: BANDS * ROWS].reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = mix(key * _MUL + rows[:, i])
    return key.astype(np.int64)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (set size), f1, f2 (the set's fingerprint), bands."""

    def rows(parts: Iterator) -> Iterator[dict[str, list]]:
        hashes = WordHashes()
        for keys, texts in parts:
            out: dict[str, list] = {"id": keys, "n": [], "f1": [], "f2": [], "bands": []}
            for t in texts:
                s = shingles(common.words(t), hashes)
                out["n"].append(len(s))
                out["f1"].append(int(mix(s).sum(dtype=np.uint64).astype(np.int64)))
                out["f2"].append(int(mix(s ^ _MUL).sum(dtype=np.uint64).astype(np.int64)))
                out["bands"].append(band_keys(sketch(s)) if len(s) else [])
            yield out

    return common.map_text(docs, rows, f"id {docs.schema[id_col].dataType.simpleString()}, n long, f1 long, f2 long, bands array<long>", id_col, text_col)


def sets(docs: DataFrame) -> DataFrame:
    """id and the full set of each row of docs (id, text)."""

    def rows(parts: Iterator) -> Iterator[dict[str, list]]:
        hashes = WordHashes()
        for keys, texts in parts:
            yield {"id": keys, "s": [shingles(common.words(t), hashes).astype(np.int64) for t in texts]}

    return common.map_text(docs, rows, f"id {docs.schema['id'].dataType.simpleString()}, s array<long>", "id", "text", 4 << 20)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs (id, text) with an id of ids. Texts whose id's mark, one of MARKS, no id has are dropped where they lie, so no more than the
    others are shuffled, whether the ids are few enough to be broadcast or not; the join by id is exact."""
    mark = F.pmod(F.xxhash64("id"), F.lit(MARKS))
    marks = ids.select(mark.alias("mark")).distinct()
    return docs.join(F.broadcast(marks), mark == F.col("mark"), "left_semi").join(ids, "id", "left_semi")


def similar(a: str, b: str, percent: int):
    """Can sets of these sizes reach the limit?"""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def compared(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The pairs (a, b) with i, the size of the intersection of their full sets, and the sizes n and b_n."""
    left, right = full.select(F.col("id").alias("a"), F.col("s").alias("sa")), full.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    inter = F.size(F.array_intersect("sa", "sb")).cast("long")
    return pairs.join(right, "b").join(left, "a").select("a", "b", inter.alias("i"), F.size("sa").cast("long").alias("n"), F.size("sb").cast("long").alias("b_n"))


def reaches(common_size, n, b_n, percent: int):
    """Is an intersection of this size at least percent of the union?"""
    return common_size * 100 >= (n + b_n - common_size) * percent


def lone_shingles(full: DataFrame, ids: DataFrame) -> DataFrame:
    """id, u: how many of its shingles no other document of ids has (documents without any are left out)."""
    each = full.join(ids, "id", "left_semi").select("id", F.explode("s").alias("s"))
    return each.groupBy("s").agg(F.count("*").alias("k"), F.min("id").alias("id")).where("k = 1").groupBy("id").agg(F.count("*").alias("u"))


def connected(links: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) of all ids in links (a, b)."""
    edges = common.cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large, old = common.cut(large.where("u > v").distinct()), edges
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = common.cut(small.where("u > v").distinct())
        common.discard(old, large)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = now


def components(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs."""
    found = common.cut(sketches(docs, id_col, text_col))
    some = found.where("n > 0 and id is not null")
    classes = common.cut(some.groupBy("f1", "f2").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.first("bands").alias("bands")))
    rows = classes.select("id", "n", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    rows = common.cut(rows.join(shared, "key"))
    # a bucket's hub: the member whose keys are shared the most
    fame = rows.groupBy("id").agg(F.sum("m").alias("fame"))
    hubs = rows.join(fame, "id").groupBy("key").agg(F.min(F.struct((-F.col("fame")).alias("fame"), "id", "n")).alias("top"), F.min("n").alias("least_n"))
    hubs = common.cut(hubs.select("key", F.col("top.id").alias("hub"), F.col("top.n").alias("hub_n"), "least_n"))
    members = texts_of(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), common.cut(rows.select("id").distinct()))
    full = common.cut(sets(members.groupBy("id").agg(F.min("text").alias("text"))))
    pairs = rows.join(hubs, "key").where((F.col("id") != F.col("hub")) & similar("n", "hub_n", percent)).select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    with_hub = common.cut(compared(pairs, full))
    links = with_hub.where(reaches(F.col("i"), F.col("n"), F.col("b_n"), percent)).select("a", "b")
    first = connected(links)
    # members that the hub's component does not hold, against the other components of the bucket
    own = rows.join(hubs, "key").join(first, "id", "left").select("key", "id", "n", "hub", "hub_n", "least_n", F.coalesce("component", "id").alias("c"))
    of_hub = first.select(F.col("id").alias("hub"), F.col("component").alias("hub_c"))
    own = own.join(of_hub, "hub", "left").withColumn("out", F.col("c") != F.coalesce("hub_c", "hub"))
    own = common.cut(own.join(own.where("out").select("key").distinct(), "key", "left_semi"))
    lone = lone_shingles(full, own.select("id").distinct())
    known = with_hub.select(F.col("a").alias("id"), F.col("b").alias("hub"), "i")
    own = own.join(lone, "id", "left").join(known, ["id", "hub"], "left").withColumn("u", F.coalesce("u", F.lit(0)))
    # bounds of what another set can share: shingles of the hub, and others that are not lone; without a comparison either may be all but the lone ones
    of_the_hub = F.coalesce(F.when(F.col("id") == F.col("hub"), F.col("n")), "i", F.least(F.col("n") - F.col("u"), F.col("hub_n")))
    others = F.when(F.col("id") == F.col("hub"), F.lit(0)).otherwise(F.col("n") - F.col("u") - F.coalesce("i", F.lit(0)))
    own = own.select("key", "id", "n", "c", "out", "least_n", (F.col("n") - F.col("u")).alias("most"), of_the_hub.alias("in_hub"), others.alias("beside"))
    # those that can reach the limit with no set of the bucket are done
    own = common.cut(own.where(reaches(F.col("most"), F.col("n"), F.greatest("least_n", "most"), percent)))
    outside = own.where("out").select("key", *[F.col(x).alias(f"b_{x}") for x in ("id", "n", "c", "most", "in_hub", "beside")])
    shared_most = F.least(F.col("most"), F.col("b_most"), F.least("in_hub", "b_in_hub") + F.least("beside", "b_beside"))
    rest = own.join(outside, "key").where((F.col("c") != F.col("b_c")) & reaches(shared_most, F.col("n"), F.col("b_n"), percent))
    rest = common.cut(rest.select(F.least("id", "b_id").alias("a"), F.greatest("id", "b_id").alias("b")).distinct())
    more = compared(rest, full).where(reaches(F.col("i"), F.col("n"), F.col("b_n"), percent)).select("a", "b")
    links = links.unionByName(common.cut(more))
    linked = connected(links)
    classes = classes.select("f1", "f2", "id").join(linked, "id", "left").select("f1", "f2", F.coalesce("component", "id").alias("component"))
    out = found.where("id is not null").select("id", "n", "f1", "f2").join(classes, ["f1", "f2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (component == F.col("id")).alias("kept"))
    none = found.where("id is null").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(False).alias("kept"))
    return out.unionByName(none)


def keep_documents(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, with all columns; of rows that repeat the kept id, all."""
    gone = components(docs, percent, id_col, text_col).where(~F.col("kept")).select(id_col)
    return docs.where(F.col(f"`{id_col}`").isNotNull()).join(common.cut(gone.distinct()), id_col, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_fast_similarity_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(common.table(spark, sf_dir, "documents"))
