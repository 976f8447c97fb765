"""Spelling variants: symmetric-delete join of words, and the chain of forms from every word to its root.

1. One pass over the texts counts words; a task sends the counts of its distinct words, as often as they fill its table.
2. Every word emits itself and its distinct single deletions as keys. Words that share a key are joined on it, and pairs at a distance of exactly
   one stay (two words one apart share exactly one key, so no pair comes twice). A key is shared by few words however large the
   corpus: the words with a given deletion differ by one letter in one place, so there are at most (length + 1) * 90 of them.
3. The pairs of a word give its near words and its form, the most frequent near word if that has at least twice its occurrences. Forms are joined
   to forms, doubling the distance each time, until none moves: counts at least double along a chain, so seven joins suffice for counts of 64 bits.

All joins are sort-merge joins by hint: both sides grow with the corpus, and Spark judges a written table by its compressed bytes, which for words
and keys are a fraction of what a broadcast would hold in the driver.

Null and empty texts have no words; repeated rows count each; a null id counts as the empty text in the checksum. Ties between
near words of equal counts go to the first in code-point order. Very long texts are read whole. No texts give no rows. Other
columns of documents, whatever their names, are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import common

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LETTERS, LEAST_COUNT = 5, 3
#: A run loses a letter where this divides its checksum.
MISSPELT = 97
#: Distinct words that a task holds before it sends them on.
HELD = 300_000


def spelled(doc: int | None, text: bytes) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of one text, after the deletions that the checksum of document and run asks for."""
    start = zlib.crc32(b"%b:" % (b"" if doc is None else str(doc).encode()))
    for run, n in Counter(RUN.findall(text.lower().decode("utf-8", "replace"))).items():
        h = zlib.crc32(run.encode(), start)
        if h % MISSPELT == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the words of at least so many letters and occurrences."""

    def counts(parts: Iterator[tuple[list, list[bytes | None]]]) -> Iterator[dict[str, list]]:
        held: Counter = Counter()
        for ids, texts in parts:
            for doc, text in zip(ids, texts):
                for word, n in spelled(doc, text) if text else ():
                    if len(word) >= least_letters:
                        held[word] += n
                if len(held) >= HELD:
                    yield {"word": list(held), "n": list(held.values())}
                    held.clear()
        if held:
            yield {"word": list(held), "n": list(held.values())}

    rows = common.map_text(docs, counts, "word string, n long", id_col, text_col)
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def keys_of(words: DataFrame) -> DataFrame:
    """key, word, n: a word itself and its distinct single deletions."""
    size = F.length("word")
    without = F.transform(F.sequence(F.lit(1), size), lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, size)))
    return words.where(size > 0).select(F.explode(F.array_distinct(F.concat(F.array("word"), without))).alias("key"), "word", "n")


def near_pairs(words: DataFrame) -> DataFrame:
    """word, near, near_n: every word beside each word that is one inserted, deleted or replaced letter away."""
    keys = keys_of(words)
    other = keys.select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = keys.select("key", "word").join(other.hint("merge"), "key").where(F.col("word") != F.col("near"))
    return pairs.where(F.levenshtein("word", "near", 1) == 1).select("word", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of words with a form (word, form): each round joins what a word has reached to what that has reached."""
    reached = common.cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = common.cut(reached.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        common.discard(reached)
        reached = after
        if after.where("moved").isEmpty():
            return after.drop("moved")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = common.cut(word_counts(docs, id_col, text_col, least_letters, least_count))
    first = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), first.alias("best"))
    leads = -F.col("best.less") >= 2 * F.col("n")
    rows = words.join(near.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(leads, F.col("best.form")).alias("form"), F.when(leads, -F.col("best.less")).cast("long").alias("form_n")
    )
    rows = common.cut(rows)
    out = rows.join(roots(rows.where("form is not null")).hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_symmetric_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(common.table(spark, sf_dir, "documents"))


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE_SQL = f"""
    with recursive tab as (select list(list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) order by i) as t from range(256) r(i)),
    runs as (select doc_id, run, count(*) as c from (select doc_id, unnest(regexp_extract_all(translate(text, {_LETTERS}), '[a-zÀ-ÿ]+')) as run from documents) group by all),
    summed as (
      select run, c, xor(4294967295, list_reduce(list_transform(string_split(coalesce(cast(doc_id as varchar), '') || ':', ''), lambda x: unicode(x)) ||
        flatten(list_transform(string_split(run, ''), lambda x: case when unicode(x) < 128 then [unicode(x)] else [195, unicode(x) - 64] end)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295)) as h from runs, tab),
    spelled as (select case when h % 97 = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, c from summed),
    words as (select word, cast(sum(c) as bigint) as n from spelled where length(word) >= 5 group by word having sum(c) >= 3),
    keys as (select distinct word, n, unnest(list_prepend(word, list_transform(range(length(word)), lambda i: left(word, i) || substr(word, i + 2)))) as key from words),
    near as (select distinct a.word, b.word as near, b.n from keys a join keys b using (key) where a.word <> b.word
      and (length(a.word) <> length(b.word) or list_sum(list_transform(range(length(a.word)), lambda i: cast(substr(a.word, i + 1, 1) <> substr(b.word, i + 1, 1) as integer))) = 1)),
    best as (select word, count(*) as n_near, first(near order by n desc, near) as near, max(n) as near_n from near group by word),
    forms as (select word, n, coalesce(n_near, 0) as n_near, case when near_n >= 2 * n then near end as form, case when near_n >= 2 * n then near_n end as form_n from words left join best using (word)),
    walk as (select word, word as at from forms union all select w.word, f.form from walk w join forms f on f.word = w.at where f.form is not null),
    ends as (select w.word, w.at as root from walk w join forms f on f.word = w.at where f.form is null)
    select word, form, root, n, n_near, form_n from forms join ends using (word)"""
