"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton holds every run of words of every test item. A document's words stream through it;
after each word the state and the matching length say which is the longest run ending there that
some item has. A matching length of at least the window (13 words) means that a window of an item
ends there; a shorter item is one window as a whole, and is found on the state's suffix links.
The spans of all windows are united; a document whose hit words reach the coverage limit is contaminated.

The automata are built from blocks of items of about BLOCK_WORDS words, dealt by the hash of the item's id, and each block is
broadcast by itself: the driver collects one block at a time, a worker holds one automaton at a time but keeps the words of every block that it has
read, so the benchmark's words, not its automata, must fit a worker. Documents are read once however many blocks there are. With several blocks
a worker builds each automaton once for every slice (64 MB of text, or an Arrow batch if that is smaller). No shuffle.

Defined results: null texts have no words; items with a null id, a null text or no words are left out;
repeated items count once by id; a document without words is not contaminated; ties are kept apart by nothing, as every
occurrence counts; a very long document is searched whole, and repeated rows are judged alike. Extra columns, whatever their names, are
passed through by keep_documents and clean_documents and ignored by score; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import common

WINDOW, BLOCK_WORDS, WORD_BYTES = 13, 200_000, 6


class SuffixAutomaton:
    """Of the items [(id, words)]; items below the window count as one window each."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.window = [-1], [0], window
        for _, item in items:
            last = 0
            for word in item:
                last = self._extend(last, word)
        n = len(self.link)
        #: Of the state whose runs include one of the window's length: the items that have it.
        self.full: list[set[str] | None] = [None] * n
        #: (length, id) of the short items that are one of the state's runs as a whole.
        self.short: list[list[tuple[int, str]] | None] = [None] * n
        for key, item in items:
            state = 0
            for i, word in enumerate(item):
                state = self.next[state][word]
                if i + 1 >= window:
                    at = self._at_window(state)
                    self.full[at] = (self.full[at] or set()) | {key}
            if len(item) < window:
                self.short[state] = (self.short[state] or []) + [(len(item), key)]
        #: For each state, where to look: the state of its window, and the nearest state up the links with short items.
        self.windowed, self.shorts = [0] * n, [0] * n
        for state in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[state]
            self.windowed[state] = self.windowed[up] or (state if self.length[up] < window <= self.length[state] else 0)
            self.shorts[state] = state if self.short[state] else self.shorts[up]
        self.ends = [bool(a or b) for a, b in zip(self.windowed, self.shorts)]

    def _at_window(self, state: int) -> int:
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def _extend(self, last: int, word: bytes) -> int:
        """Append a word after the run that ends in last; the state of the longer run."""
        nxt, link, length = self.next, self.link, self.length
        if word in nxt[last]:
            there = nxt[last][word]
            return there if length[there] == length[last] + 1 else self._split(last, word, there)
        new = len(link)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and word not in nxt[at]:
            nxt[at][word] = new
            at = link[at]
        if at >= 0:
            there = nxt[at][word]
            link[new] = there if length[there] == length[at] + 1 else self._split(at, word, there)
        return new

    def _split(self, at: int, word: bytes, there: int) -> int:
        """A copy of the state there, for its runs that are no longer than the one through at."""
        copy = len(self.link)
        self.next.append(dict(self.next[there]))
        self.link.append(self.link[there])
        self.length.append(self.length[at] + 1)
        self.link[there] = copy
        while at >= 0 and self.next[at].get(word) == there:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans (first, last) of item windows among the words, and the ids of their items."""
        nxt, link, lengths, ends, root = self.next, self.link, self.length, self.ends, self.next[0]
        spans, items, state, run, window = [], set(), 0, 0, self.window
        for i, word in enumerate(words):
            to = nxt[state].get(word)
            if to is None:
                if word not in root:
                    state = run = 0
                    continue
                while to is None:
                    state = link[state]
                    to = nxt[state].get(word)
                run = lengths[state]
            state = to
            run += 1
            if ends[state]:
                longest = 0
                # the state's runs share their ends; of those, only runs up to the matching length are in the text
                if run >= window and self.windowed[state]:
                    longest = window
                    items |= self.full[self.windowed[state]]
                at = self.shorts[state]
                while at:
                    for size, key in self.short[at]:
                        if size <= run:
                            longest = max(longest, size)
                            items.add(key)
                    at = self.shorts[link[at]]
                if longest:
                    spans.append((i - longest + 1, i))
        return spans, items


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


_BUILT: dict[tuple[str, int], SuffixAutomaton] = {}


class Benchmark:
    """Broadcast blocks of items; searches a slice of documents against each block in turn."""

    def __init__(self, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, id_col: str = "item_id", text_col: str = "text") -> None:
        self.key, self.window, self.blocks = uuid.uuid4().hex, window, []
        sc = items.sparkSession.sparkContext
        slim = items.select(F.col(id_col).cast("string").alias("k"), F.col(text_col).cast("binary").alias("t")).where("k is not null and t is not null").distinct()
        # as many blocks as the items' bytes need, dealt by hash; the driver holds the items of one block at a time
        total = slim.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
        n = max(1, -(-total // (block_words * WORD_BYTES)))
        slim = slim.withColumn("block", F.pmod(F.xxhash64("k"), F.lit(n)))
        for k in range(n):
            own = sorted((r.k, bytes(r.t)) for r in slim.where(F.col("block") == k).select("k", "t").collect())
            block = [(key, words) for key, text in own if (words := common.alnum_words(text))]
            if block:
                self.blocks.append(sc.broadcast(block))

    @property
    def slice_bytes(self) -> int:
        """Text to search at a time: with several blocks more, so that each automaton is built less often."""
        return 2 << 20 if len(self.blocks) < 2 else 64 << 20

    def automaton(self, k: int) -> SuffixAutomaton:
        if (self.key, k) not in _BUILT:
            _BUILT.clear()  # one at a time
            _BUILT[self.key, k] = SuffixAutomaton(self.blocks[k].value, self.window)
        return _BUILT[self.key, k]

    def search(self, texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """(n_words, united spans, items) of each text."""
        tokens = [common.alnum_words(t) for t in texts]
        spans: list[list] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        for k in range(len(self.blocks)):
            find = self.automaton(k).find
            for i, words in enumerate(tokens):
                found, keys = find(words)
                if found:
                    spans[i] += found
                    items[i] |= keys
        return [(len(w), united(s), k) for w, s, k in zip(tokens, spans, items)]


def contaminated(n_words: int, n_hit: int, coverage_parts: int) -> bool:
    return n_hit > 0 and coverage_parts * n_hit >= n_words


def score(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage_parts: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids, spans of hit words (first, last)."""
    bench = Benchmark(items, window)

    def rows(parts: Iterator) -> Iterator[dict[str, list]]:
        for keys, texts in parts:
            found = bench.search(texts)
            hits = [sum(b - a + 1 for a, b in s) for _, s, _ in found]
            ids = [sorted(k) for _, _, k in found]
            yield {
                id_col: keys, "n_words": [n for n, _, _ in found], "n_hit": hits, "n_items": [len(x) for x in ids],
                "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids],
                "contaminated": [contaminated(n, h, coverage_parts) for (n, _, _), h in zip(found, hits)],
                "item_ids": ids, "spans": [[{"first": a, "last": b} for a, b in s] for _, s, _ in found],
            }
        _BUILT.clear()  # the worker goes on to other stages

    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<string>, spans array<struct<first:int,last:int>>"
    return common.map_text(docs, rows, schema, id_col, text_col, bench.slice_bytes)


def keep_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage_parts: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not contaminated, unchanged, with all their columns."""
    bench = Benchmark(items, window)

    def clean(_: list, texts: list[bytes | None]) -> list[bool]:
        return [not contaminated(n, sum(b - a + 1 for a, b in s), coverage_parts) for n, s, _ in bench.search(texts)]

    return common.keep_rows(docs, clean, id_col, text_col, bench.slice_bytes)


def without_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the spans (first, last) of its words; what stands between words stays."""
    places = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(common.ALNUM_TABLE))]
    for first, last in reversed(spans):
        text = text[: places[first][0]] + text[places[last][1] :]
    return text


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage_parts: int = 20, span_words: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not contaminated, with all their columns, their texts without united spans of span_words or more words.

    Words that a cut brings together are searched again, so that no such span is left."""
    bench = Benchmark(items, window)

    def cleaned(texts: list[bytes | None]) -> Iterator[dict]:
        """Of each text: is it kept, and its new form if it has one."""
        found = bench.search(texts)
        keep = [not contaminated(n, sum(y - x + 1 for x, y in s), coverage_parts) for n, s, _ in found]
        at, new = {i: s for i, (_, s, _) in enumerate(found) if keep[i]}, {}
        while at := {i: long for i, s in at.items() if (long := [x for x in s if x[1] - x[0] + 1 >= span_words])}:
            for i, long in at.items():
                new[i] = without_words(new.get(i, texts[i]), long)
            at = {i: s for i, (_, s, _) in zip(at, bench.search([new[i] for i in at]))}
        return ({"keep": k, "new": new[i].decode() if i in new else None} for i, k in enumerate(keep))

    @F.arrow_udf("struct<keep:boolean,new:string>")
    def judged(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("keep", pa.bool_()), ("new", pa.string())])
        for column in columns:
            yield pa.array([r for part in common.text_slices(column, bench.slice_bytes) for r in cleaned(common.utf8(part))], kind)
        _BUILT.clear()  # the worker goes on to other stages
        common.release()

    # nondeterministic for the optimiser, so that it is not run once for the filter and once for the text
    taken = {c.lower() for c in docs.columns}
    text, verdict = F.col(f"`{text_col}`"), next(c for k in range(len(taken) + 1) if (c := f"verdict_{k}") not in taken)
    rows = docs.withColumn(verdict, judged.asNondeterministic()(text)).where(F.col(verdict)["keep"])
    return rows.withColumn(text_col, F.coalesce(F.col(verdict)["new"], text)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
