"""Quality rules from a suffix array over each text's words.

The words of a slice of documents, each document with word ids of its own and closed by a mark, form
one sequence; prefix doubling sorts its suffixes, and the ranks of every doubling step give the longest common
prefix of neighbours. The deepest LCP interval that holds a suffix is as long as the larger of its
two neighbouring LCPs: that is the longest repeat that starts at the word. The spans of the repeats
of at least min_words words are united per document; a document is rejected if the union covers more
than max_fraction of its words, or if one repeat is longer than max_longest words.
Ids and marks differ between documents, so no repeat crosses them, and slicing does not change a result.

Defined results: null, empty and blank texts have no words, fail the base rule (fewer than 50 words)
and are not kept. Repeated rows are judged alike. Extra columns are passed through by keep_documents
and ignored by score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from claimloom.llm import common

#: Deleting these leaves one byte per code point of a word: UTF-8 continuation bytes and the six blanks.
_NOT_WORD_CHARS = bytes(range(0x80, 0xC0)) + b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"

MIN_WORDS, MAX_FRACTION, MAX_LONGEST = 5, 0.4, 100


def longest_repeats(seq: np.ndarray) -> np.ndarray:
    """For each place of a sequence whose last element is unique: the length of the longest run from there that also starts elsewhere.

    seq holds ids; document marks are ids that occur once.
    """
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    group = np.empty(n, np.int64)

    def regroup(places: np.ndarray, starts: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Give sorted places the rank of their run's first; returns the places of runs longer than one. starts: true where a run begins."""
        first = np.flatnonzero(starts)
        size = np.diff(np.append(first, len(places)))
        group[places] = np.repeat(base[first], size)
        return places[np.repeat(size > 1, size)]

    ordered = seq[order]
    active = regroup(order, np.append(True, ordered[1:] != ordered[:-1]), np.arange(n))
    levels, step = [group.astype(np.int32)], 1
    while len(active):
        key = group[active] * n + group[active + step]
        by = np.argsort(key, kind="stable")
        places, key = active[by], key[by]
        own = group[places]
        # ranks stay global: a run's first rank is its group's rank plus its offset in the group
        new_group = np.append(True, own[1:] != own[:-1])
        offset = np.arange(len(places)) - np.maximum.accumulate(np.where(new_group, np.arange(len(places)), 0))
        active = regroup(places, np.append(True, key[1:] != key[:-1]), own + offset)
        step *= 2
        if len(active):
            levels.append(group.astype(np.int32))
    suffixes = np.empty(n, np.int64)
    suffixes[group] = np.arange(n)
    at = np.flatnonzero(levels[0][suffixes[1:]] == levels[0][suffixes[:-1]])
    left, right = suffixes[at].copy(), suffixes[at + 1].copy()
    lcp, common_len = np.zeros(n + 1, np.int64), np.zeros(len(at), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = np.flatnonzero(levels[k][left] == levels[k][right])
        for x in (left, right, common_len):
            x[same] += 1 << k
    lcp[at + 1] = common_len
    out = np.empty(n, np.int64)
    out[suffixes] = np.maximum(lcp[:-1], lcp[1:])
    return out


def covered(length: np.ndarray, least: int, span: int | None = None) -> np.ndarray:
    """True for the places inside a repeat of at least `least`; span: count only so many places from each start."""
    starts = np.flatnonzero(length >= least)
    delta = np.zeros(len(length) + 1, np.int64)
    delta[starts] += 1
    np.subtract.at(delta, starts + (length[starts] if span is None else span), 1)
    return np.cumsum(delta[:-1]) > 0


def measure(texts: list[bytes | None], min_words: int = MIN_WORDS) -> dict[str, np.ndarray]:
    """Per text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered, longest_repeat."""
    ids: dict[bytes, int] = {}
    tokens = [t.split() if t else [] for t in texts]
    n_words = np.array([len(x) for x in tokens], np.int64)
    ends = np.cumsum(n_words + 1) - 1
    total = int(ends[-1]) + 1 if len(texts) else 0
    seq = np.empty(total, np.int64)
    inner = np.ones(total, bool)
    inner[ends] = False
    seq[inner] = np.fromiter((ids.setdefault(w, len(ids)) for x in tokens for w in x), np.int64, int(n_words.sum()))
    seq[inner] += np.repeat(np.arange(len(texts)) * len(ids), n_words)  # a word of another document is another word
    seq[ends] = len(texts) * len(ids) + np.arange(len(texts))
    length = longest_repeats(seq) if total else seq
    starts = ends - n_words
    total_by = lambda flags: np.add.reduceat(flags.astype(np.int64), starts) if total else n_words
    dup_lines = []
    for t in texts:
        seen: set[bytes] = set()
        n = 0
        for line in t.split(b"\n") if t and b"\n" in t else ():
            if line in seen:
                n += 1
            elif line and not line.isspace():
                seen.add(line)
        dup_lines.append(n)
    return {
        "n_words": n_words,
        "word_chars": np.array([len(t.translate(None, _NOT_WORD_CHARS)) if t else 0 for t in texts], np.int64),
        "n_symbols": np.array([len(t) - len(t.translate(None, _SYMBOLS)) if t else 0 for t in texts], np.int64),
        "n_dup_lines": np.array(dup_lines, np.int64),
        "n_repeat_words": total_by(covered(length, 3, 3)),
        "n_covered": total_by(covered(length, min_words)),
        "longest_repeat": np.maximum.reduceat(length, starts) if total else n_words,
    }


def verdicts(m: dict[str, np.ndarray], max_fraction: float, max_longest: int) -> tuple[np.ndarray, np.ndarray]:
    """base_failed and kept."""
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    return failed, ~failed & (m["n_covered"] <= max_fraction * m["n_words"]) & (m["longest_repeat"] <= max_longest)


def score(docs: DataFrame, min_words: int = MIN_WORDS, max_fraction: float = MAX_FRACTION, max_longest: int = MAX_LONGEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures and verdicts, one row per row of docs, no shuffle."""
    longs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat")

    def rows(parts: Iterator) -> Iterator[dict[str, list]]:
        for keys, texts in parts:
            m = measure(texts, min_words)
            failed, kept = verdicts(m, max_fraction, max_longest)
            yield {id_col: keys, **m, "base_failed": failed, "kept": kept}

    schema = ", ".join([f"{id_col} {docs.schema[id_col].dataType.simpleString()}", *(f"{c} long" for c in longs), "base_failed boolean, kept boolean"])
    return common.map_text(docs, rows, schema, id_col, text_col, 2 << 20)


def keep_documents(docs: DataFrame, min_words: int = MIN_WORDS, max_fraction: float = MAX_FRACTION, max_longest: int = MAX_LONGEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    return common.keep_rows(docs, lambda _, texts: verdicts(measure(texts, min_words), max_fraction, max_longest)[1].tolist(), id_col, text_col)


def op6_suffix_array_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"))
