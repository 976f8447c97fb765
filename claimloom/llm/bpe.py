"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list. For every adjacent pair that some merge joins, the
list position goes into the bucket of that merge's rank, and a two-level bitmap over ranks
(words of 256 bits under a summary word) marks the buckets that hold entries. Find-first-set on the bitmap gives the next rank; entries
whose pair has changed since are stale and skipped. Each merge costs a constant number of word
operations, so a pre-token of a megabyte is as cheap per byte as a short one.

Defined results: null and empty texts have no ids, and the hashes are those of the empty string.
Repeated rows give repeated results; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from heapq import heappop, heappush

import regex
from pyspark.sql import DataFrame, SparkSession

from claimloom.llm import common

#: Whitespace, letters and numbers below U+0250, as Unicode has them (fixed values).
_SPACE = r"\t-\r \x85\xa0"
_LETTER = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_NUMBER = r"0-9\xb2\xb3\xb9\xbc-\xbe"
#: Pre-tokens in a generation where encoding is all that a worker does: new ones come for ever in a large corpus, and merging one costs as much as forty lookups.
REMEMBERED_ALONE = 400_000
BIT = [1 << i for i in range(4096)]
_BEYOND = re.compile("[^\x00-ɏ]")
#: The pre-token pattern with these classes spelled out, for texts that lie below U+0250.
_NEAR = re.compile(
    rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+"
    rf"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)


class ByteBpe:
    """Encoder and decoder for a rank file in tiktoken's format."""

    #: Pre-tokens that a worker remembers in each of two generations, and the longest of them. A full young
    #: generation becomes the old one; what is asked for again moves back, so frequent pre-tokens stay.
    REMEMBERED, REMEMBERED_CHARS = 150_000, 48

    def __init__(self, path: str, pattern: str, remembered: int = REMEMBERED) -> None:
        self.remembered = remembered
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.decimals = [str(i) for i in range(len(self.tokens))]
        self.single = [self.ranks.get(bytes([b]), -1) for b in range(256)]
        self.pairs: dict[int, int] = {}
        self.words = (len(self.tokens) >> 8) + 1
        self.near = _NEAR.findall if pattern == common_pattern() else None
        self.full = regex.compile(pattern).findall
        self.seen: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def split(self, text: str) -> list[str]:
        return self.near(text) if self.near and not _BEYOND.search(text) else self.full(text)

    def join_rank(self, left: int, right: int) -> int:
        """The rank of the merge that joins two tokens; -1 if there is none. self.pairs remembers it."""
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        rank = self.pairs[left << 20 | right] = self.ranks.get(self.tokens[left] + self.tokens[right], -1)
        return rank

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one pre-token. The queue's steps stand in this loop: a call for each would double the time."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        n, pairs, join = len(piece), self.pairs, self.join_rank
        ids = [self.single[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        due = [-1] * n  # the rank of the merge of the token here with the one after it; -1: none, or the token is gone
        buckets: dict[int, list[int]] = {}
        low, summary = [0] * self.words, 0
        left = ids[0]
        for i in range(n - 1):
            right = ids[i + 1]
            if (rank := pairs.get(left << 20 | right)) is None:
                rank = join(left, right)
            left = right
            if rank >= 0:
                due[i] = rank
                if rank in buckets:
                    buckets[rank].append(i)  # in ascending order, so each list is a heap
                else:
                    buckets[rank] = [i]
                    word = rank >> 8
                    low[word] |= BIT[rank & 255]
                    summary |= BIT[word]
        while summary:
            word = (summary & -summary).bit_length() - 1
            bits = low[word]
            rank = (word << 8) + (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                low[word] = bits = bits & (bits - 1)
                if not bits:
                    summary &= summary - 1
            if due[i] != rank:
                continue
            gone = after[i]
            ids[i] = rank
            ids[gone] = due[gone] = due[i] = -1
            after[i] = right = after[gone]
            if right < n:
                before[right] = i
                if (new := pairs.get(rank << 20 | ids[right])) is None:
                    new = join(rank, ids[right])
                if new >= 0:
                    due[i] = new
                    if new in buckets:
                        heappush(buckets[new], i)
                    else:
                        buckets[new] = [i]
                        word = new >> 8
                        low[word] |= BIT[new & 255]
                        summary |= BIT[word]
            if (left := before[i]) >= 0:
                if (new := pairs.get(ids[left] << 20 | rank)) is None:
                    new = join(ids[left], rank)
                due[left] = new
                if new >= 0:
                    if new in buckets:
                        heappush(buckets[new], left)
                    else:
                        buckets[new] = [left]
                        word = new >> 8
                        low[word] |= BIT[new & 255]
                        summary |= BIT[word]
        return tuple([x for x in ids if x >= 0])

    def encode(self, text: str) -> list[int]:
        seen, out = self.seen, []
        extend = out.extend
        for piece in self.split(text):
            if (ids := seen.get(piece)) is None:
                if (ids := self.old.get(piece)) is None:
                    ids = self.merge(piece.encode())
                if len(piece) <= self.REMEMBERED_CHARS:
                    if len(seen) >= self.remembered:
                        self.old, self.seen = seen, {}
                        seen = self.seen
                    seen[piece] = ids
            extend(ids)
        return out

    def decode(self, ids: list[int]) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


def common_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


_LOADED: dict[tuple[str, str, int], ByteBpe] = {}


def loaded(path: str, pattern: str, remembered: int = ByteBpe.REMEMBERED) -> ByteBpe:
    """One encoder per worker process and number of pre-tokens that it remembers."""
    if (path, pattern, remembered) not in _LOADED:
        _LOADED[path, pattern, remembered] = ByteBpe(path, pattern, remembered)
    return _LOADED[path, pattern, remembered]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, remembered: int = ByteBpe.REMEMBERED) -> DataFrame:
    """doc_id, n_tokens, ids (only with_ids), ids_sha256, decoded_sha256, round_trip: one row per row of docs, no shuffle. A worker remembers the ids of up to twice `remembered` pre-tokens."""
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_tokens long, " + "ids array<int>, " * with_ids + "ids_sha256 string, decoded_sha256 string, round_trip boolean"

    def rows(parts: Iterator) -> Iterator[dict[str, list]]:
        bpe = loaded(ranks_path, pattern, remembered)
        for keys, texts in parts:
            out: dict[str, list] = {k: [] for k in (id_col, "n_tokens", "ids", "ids_sha256", "decoded_sha256", "round_trip")}
            for key, text in zip(keys, texts):
                with common.without_gc():
                    ids = bpe.encode((text or b"").decode())
                back = bpe.decode(ids)
                decimals = bpe.decimals
                out[id_col].append(key)
                out["n_tokens"].append(len(ids))
                if with_ids:
                    out["ids"].append(ids)
                out["ids_sha256"].append(hashlib.sha256(" ".join([decimals[i] for i in ids]).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
                out["round_trip"].append(back == (text or b""))
            yield out

    return common.map_text(docs, rows, schema, id_col, text_col, 2 << 20)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of each row's ids; null ids give a null text."""
    import pyarrow as pa

    slim = encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids"))

    def run(batches: Iterator) -> Iterator:
        bpe = loaded(ranks_path, pattern)
        for b in batches:
            texts = [None if ids is None else bpe.decode(ids).decode("utf-8", "replace") for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.string())], names=[id_col, "text"])

    return slim.mapInArrow(run, f"{id_col} {encoded.schema[id_col].dataType.simpleString()}, text string")


def op9_bpe_rank_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    out = encode(common.table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN, with_ids=False, remembered=REMEMBERED_ALONE)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
