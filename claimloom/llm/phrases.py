"""Repeated passages by prefix-free parsing: rolling-hash triggers cut texts into phrases, equal strings are found in the dictionary of phrases.

A string of `length` bytes (50) that starts at some place of a text is a window. The trigger of a window is the 20-byte string in it with the least rolling
hash, the first of equals. Equal windows have equal triggers, and next windows mostly share theirs: the windows of one trigger, a stretch of
text, are a phrase (about fifteen of them, never more than 31). Every window lies in one phrase and knows nothing but its own bytes.

1. parse: documents are packed into parts of 8 MB, sorted by id, and written once, bucketed by part; later steps read them without a shuffle.
2. dictionary: a part sends its distinct phrases (trigger, hash of content, least document). By trigger they give each phrase's first document
   in the corpus. A phrase that repeats an earlier document is removed as a whole, so copies cost no more than their phrases.
3. suffix order: only where one trigger has several contents from several documents can parts of phrases be equal. There the first part with a phrase sends
   its bytes, and the suffixes of all phrases of a bucket are sorted together, as deep as a window. Runs of equal ones give each window
   its first document; the parse has given the phrase's. What comes back is a bit for each window.
4. Each part marks the bytes of removed windows and keeps the rest.

Where the suffix array of the whole corpus would be one order, this is one for each bucket of triggers, since windows of different triggers differ. A trigger
with more than 16 contents in one part is hot: there every distinct window goes to a bucket of its own hash, one from each part, so
no bucket gets a group that grows with the documents. Equal contents are taken as equal if both their trigger and a 64-bit hash agree;
windows within contents are compared byte by byte.

Documents: null and empty texts have no windows, and texts are whole, of any length (long ones are parsed in pieces that overlap by a window). Rows
of one id are one document: they remove nothing from each other. A null id counts as the largest long. No documents give no
rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import functools
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import common

LENGTH, GRAM = 50, 20
FULL, SEND, HOT, MASK = range(4)
LAST_ID = (1 << 63) - 1


class Sizes(NamedTuple):
    """How the work is cut; no result depends on it."""

    part: int = 8 << 20  # bytes of text in a part
    step: int = 1 << 20  # bytes hashed at a time, at most 2 << 20
    bucket: int = 16 << 20  # bytes of text for each bucket of triggers
    gather: int = 64 << 20  # bytes of text of which a task sends the phrases together
    contents: int = 16  # contents of one trigger in one part beyond which it is hot


_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


@functools.cache
def _tables(step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte, and the powers of the base and of its inverse modulo 2**64."""
    n = step + 1
    power = lambda b: np.concatenate([np.ones(1, _U), np.cumprod(np.full(n - 1, b, _U))])
    return mixed(np.arange(1, 257, dtype=_U)) | _U(1), power(_BASE), power(pow(_BASE, -1, 1 << 64))


def mixed(h: np.ndarray) -> np.ndarray:
    for _ in range(2):
        h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def triggers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 20) -> tuple[np.ndarray, ...]:
    """(place, windows, trigger, content) of the phrases of texts data[start:end], which lie side by side and are at most step bytes."""
    of_byte, power, inverse = _tables(step)
    n, wide = len(data), LENGTH - GRAM + 1
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U)
    sums = np.zeros(n + 1, _U)
    np.cumsum(of_byte[data] * power[:n], out=sums[1:])
    grams = mixed((sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1])
    place = _U((1 << 21) - 1)
    least, w = (grams & ~place) | np.arange(len(grams), dtype=_U), 1  # the first of equals: places are in the low bits
    while 2 * w <= wide:
        least, w = np.minimum(least[:-w], least[w:]), 2 * w
    if w < wide:
        least = np.minimum(least[: len(least) - (wide - w)], least[wide - w :])
    at, edge, long = (least & place).astype(np.int64), np.zeros(n + 1, np.int32), ends - starts >= LENGTH
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, ends[long] - LENGTH + 1, -1)
    windows = np.flatnonzero(np.cumsum(edge[: len(at)]))  # those within one text
    at = at[windows]
    new = np.flatnonzero(np.diff(at, prepend=-1))
    count, first = np.diff(np.append(new, len(at))), windows[new]
    content = (sums[first + count + LENGTH - 1] - sums[first]) * inverse[first]
    return first, count, grams[at[new]], mixed(content + count.astype(_U) * _U(0xA0761D6478BD642F))


class Part:
    """Documents in order of their ids: text side by side, and its phrases."""

    def __init__(self, row: dict, sizes: Sizes) -> None:
        self.id, self.ids, self.sizes = row["part"], row["ids"], sizes
        self.docs = np.array([LAST_ID if x is None else x for x in self.ids], np.int64)
        self.ends = np.cumsum(np.array(row["sizes"], np.int64)) if row["sizes"] else np.zeros(0, np.int64)
        self.starts = self.ends - np.array(row["sizes"], np.int64)
        size = int(self.ends[-1]) if len(self.ends) else 0
        self.text = pa.decompress(row["texts"], size, "zstd", asbytes=True) if size else b""
        found, data = [], np.frombuffer(self.text, np.uint8)
        for at, upto, starts, ends in self._steps():
            first, *rest = triggers(data[at:upto], starts - at, ends - at, sizes.step)
            found.append((first + at, *rest))
        columns = [np.concatenate(c) for c in zip(*found)] if found else triggers(data[:0], self.starts[:0], self.ends[:0])
        self.first, self.count, self.trigger, self.content = columns
        self.doc = self.docs[np.searchsorted(self.starts, self.first, "right") - 1] if len(self.first) else np.zeros(0, np.int64)
        #: Of the distinct contents: value, first phrase, which has the least document; and of each phrase the number of its content.
        self.contents, self.lead, self.which = np.unique(self.content, return_index=True, return_inverse=True)

    def _steps(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Stretches of at most a step; a longer text in stretches that overlap by a window less a byte."""
        i, step = 0, self.sizes.step
        while i < len(self.ends):
            s, e = int(self.starts[i]), int(self.ends[i])
            if e - s > step:
                for at in range(s, e - LENGTH + 1, step - LENGTH + 1):
                    upto = min(at + step, e)
                    yield at, upto, np.array([at]), np.array([upto])
                i += 1
                continue
            j = int(np.searchsorted(self.ends, s + step, "right"))
            yield s, int(self.ends[j - 1]), self.starts[i:j], self.ends[i:j]
            i = j

    def crowded(self) -> np.ndarray:
        """The triggers with more contents here than may be sent."""
        values, times = np.unique(self.trigger[self.lead], return_counts=True)
        return values[times > self.sizes.contents]

    def hot_windows(self, contents: np.ndarray) -> tuple[np.ndarray, ...]:
        """(content number, place in phrase, place in text, representative) of the windows of hot contents and of crowded triggers; a representative is the first equal window."""
        chosen = np.flatnonzero(np.isin(self.contents, contents) | np.isin(self.trigger[self.lead], self.crowded()))
        chosen = chosen[np.argsort(self.lead[chosen])]  # by document
        count = self.count[self.lead[chosen]]
        number, within = np.repeat(chosen, count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        place = self.first[self.lead[number]] + within
        order, new = ordered(np.frombuffer(self.text, np.uint8), place)
        leads = np.minimum.reduceat(order, np.flatnonzero(new)) if len(order) else order
        same = np.empty(len(order), np.int64)
        same[order] = leads[np.cumsum(new) - 1] if len(order) else 0
        return number, within, place, same


def ordered(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes of data at places, as deep as a window, and where in it a new string begins."""
    if not len(places):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)
    keys = [np.ascontiguousarray(eight[places + at]).view(">u8").ravel().astype(_U) for at in [*range(0, LENGTH - 8, 8), LENGTH - 8]]
    order, new = np.lexsort(keys[::-1]), np.zeros(len(places), bool)
    new[0] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, new


def packed(docs: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """part, n_bytes, ids, sizes, texts: documents in parts of at most so many bytes, or one document, in each sorted by id."""
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def part() -> pa.RecordBatch:
            held.sort(key=lambda x: LAST_ID if x[0] is None else x[0])
            texts = b"".join(t for _, t in held)
            row = {"part": uuid.uuid4().int >> 65, "n_bytes": len(texts), "ids": [i for i, _ in held], "sizes": [len(t) for _, t in held], "texts": pa.compress(texts, "zstd", asbytes=True)}
            held.clear()
            return pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int64()), ("n_bytes", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("texts", pa.binary())]))

        for b in common.slices(batches, "text", most):
            for id_, text in zip(b.column("id").to_pylist(), common.utf8(b.column("text"))):
                text = text or b""
                if held and size + len(text) > most:
                    yield part()
                    size = 0
                held.append((id_, text))
                size += len(text)
        if held:
            yield part()
        common.release()

    return slim.mapInArrow(run, "part long, n_bytes long, ids array<long>, sizes array<long>, texts binary")


def _table(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, schema)], pa.schema(schema))


def _by(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, places in order) of each key."""
    order = np.argsort(keys, kind="stable")
    values, starts = np.unique(keys[order], return_index=True)
    for value, at in zip(values, np.split(order, starts[1:])):
        yield int(value), at


_FOUND = [("part", pa.int64()), ("kind", pa.int32()), ("content", pa.binary()), ("mask", pa.binary())]
FOUND = "part long, kind int, content binary, mask binary"
_PHRASES = [("bucket", pa.int32()), ("hot", pa.bool_()), ("parts", pa.list_(pa.int64())), ("part", pa.binary()), ("trigger", pa.binary()), ("content", pa.binary()), ("doc", pa.binary())]


def dictionary(parts: DataFrame, buckets: int, sizes: Sizes) -> DataFrame:
    """Rows of packed columns, one for a bucket of triggers and some parts: their distinct phrases, each with its least document there; or, as hot, triggers only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            ids = [p for p, *_ in held]
            for hot in (False, True):
                place = np.concatenate([np.full(len(h[1 + hot][0]), k, np.int32) for k, h in enumerate(held)])
                trigger, content, doc = (np.concatenate([h[1 + hot][c] for h in held]) for c in range(3))
                rows = []
                for bucket, at in _by((trigger % _U(buckets)).astype(np.int32)):
                    rows.append((bucket, hot, ids, place[at].tobytes(), (trigger[at] // _U(buckets)).astype(np.uint32).tobytes(), content[at].tobytes(), np.diff(doc[at], prepend=0).tobytes()))
                yield from _table(_PHRASES, rows).to_batches()
            held.clear()

        for batch in batches:
            for row in batch.to_pylist():
                p = Part(row, sizes)
                trigger, doc, crowded = p.trigger[p.lead], p.doc[p.lead], p.crowded()
                few, none = ~np.isin(trigger, crowded), np.zeros(len(crowded), np.int64)
                held.append((p.id, (trigger[few], p.contents[few], doc[few]), (crowded, none.astype(_U), none)))
                size += row["n_bytes"]
                if size >= sizes.gather:
                    yield from sent()
                    size = 0
        if held:
            yield from sent()
        common.release()

    return parts.mapInArrow(run, "bucket int, hot boolean, parts array<long>, part binary, trigger binary, content binary, doc binary")


_FOUND = [("part", pa.int64()), ("kind", pa.int32()), ("content", pa.binary()), ("mask", pa.binary())]


def _grouped(work):
    """work on a group, with memory handed back to the system after it, since workers live on for other stages."""

    def run(group: pa.Table) -> pa.Table:
        out = work(group)
        common.release()
        return out

    return run


def _cogrouped(work):
    """As _grouped, for a part and what it has been told."""

    def run(row: pa.Table, told: pa.Table) -> pa.Table:
        out = work(row, told)
        common.release()
        return out

    return run


def first_documents(buckets: int):
    """One bucket of the dictionary -> what parts have to know: contents that an earlier document has (FULL), contents to send (SEND), contents of triggers that are hot elsewhere (HOT)."""

    def run(group: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[], [], [], []]
        hot = [np.zeros(0, np.uint32)]
        for r in group.to_pylist():
            if r["hot"]:
                hot.append(np.frombuffer(r["trigger"], np.uint32))
                continue
            ids = np.array(r["parts"], np.int64)[np.frombuffer(r["part"], np.int32)]
            for column, values in zip(found, (ids, np.frombuffer(r["trigger"], np.uint32), np.frombuffer(r["content"], _U), np.cumsum(np.frombuffer(r["doc"], np.int64)))):
                column.append(values)
        if not found[0]:
            return _table(_FOUND, [])
        part, trigger, content, doc = map(np.concatenate, found)
        order = np.lexsort((part, doc, content, trigger))
        part, trigger, content, doc = part[order], trigger[order], content[order], doc[order]
        new = np.ones(len(part), bool)
        new[1:] = (trigger[1:] != trigger[:-1]) | (content[1:] != content[:-1])
        lead = np.flatnonzero(new)  # of each content the entry of its first document
        heads = np.flatnonzero(np.diff(trigger[lead].astype(np.int64), prepend=-1))
        several = np.minimum.reduceat(doc[lead], heads) != np.maximum.reduceat(doc[lead], heads)
        several = np.repeat(several, np.diff(np.append(heads, len(lead))))
        busy, which, rows = np.isin(trigger, np.concatenate(hot)), np.cumsum(new) - 1, []
        later = doc > doc[lead][which]  # the rows of one document can lie in several parts, and are first together
        for kind, at in ((FULL, np.flatnonzero(later)), (SEND, np.flatnonzero(several[which] & ~later & ~busy)), (HOT, np.flatnonzero(busy))):
            rows += [(to, kind, content[at[of]].tobytes(), None) for to, of in _by(part[at])]
        return _table(_FOUND, rows)

    return run


def _contents(told: pa.Table, kind: int) -> np.ndarray:
    return np.concatenate([np.zeros(0, _U), *(np.frombuffer(r["content"], _U) for r in told.to_pylist() if r["kind"] == kind)])


_SENT = [("bucket", pa.int32()), ("part", pa.int64()), ("content", pa.binary()), ("within", pa.binary()), ("count", pa.binary()), ("doc", pa.binary()), ("text", pa.binary())]
SENT = "bucket int, part long, content binary, within binary, count binary, doc binary, text binary"


def sent_phrases(buckets: int, sizes: Sizes):
    """A part, and what it has been told -> the bytes of the phrases to send, by bucket of triggers, and of each distinct window of hot ones, by bucket of its hash."""

    def run(row: pa.Table, told: pa.Table) -> pa.Table:
        if not row.num_rows:
            return _table(_SENT, [])
        p, rows = Part(row.to_pylist()[0], sizes), []

        def send(bucket: np.ndarray, number: np.ndarray, within: np.ndarray, count: np.ndarray, place: np.ndarray) -> None:
            for b, at in _by(bucket):
                text = b"".join([p.text[i : i + n + LENGTH - 1] for i, n in zip(place[at].tolist(), count[at].tolist())])
                rows.append((b, p.id, p.contents[number[at]].tobytes(), within[at].astype(np.uint8).tobytes(), count[at].astype(np.uint8).tobytes(), p.doc[p.lead[number[at]]].tobytes(), text))

        number = np.flatnonzero(np.isin(p.contents, _contents(told, SEND)))
        lead = p.lead[number]
        send((p.trigger[lead] % _U(buckets)).astype(np.int64), number, np.zeros(len(lead), np.int64), p.count[lead], p.first[lead])
        number, within, place, same = p.hot_windows(_contents(told, HOT))
        lone = np.flatnonzero(same == np.arange(len(same)))
        if len(lone):
            hashes = np.array([hash_of(p.text[i : i + LENGTH]) for i in place[lone].tolist()], np.int64)
            send(hashes % buckets, number[lone], within[lone], np.ones(len(lone), np.int64), place[lone])
        return _table(_SENT, rows)

    return run


def hash_of(window: bytes) -> int:
    return zlib.crc32(window)


def masks(group: pa.Table) -> pa.Table:
    """Phrases of one bucket -> for each part, contents with a bit for each window that an earlier document has: all suffixes sorted, each run's least document."""
    columns: list[list] = [[], [], [], [], [], []]
    for r in group.to_pylist():
        content = np.frombuffer(r["content"], _U)
        for column, values in zip(columns, (np.full(len(content), r["part"], np.int64), content, np.frombuffer(r["within"], np.uint8), np.frombuffer(r["count"], np.uint8), np.frombuffer(r["doc"], np.int64), np.frombuffer(r["text"], np.uint8))):
            column.append(values)
    if not columns[0]:
        return _table(_FOUND, [])
    part, content, within, count, doc, text = map(np.concatenate, columns)
    count = count.astype(np.int64)
    size = count + LENGTH - 1
    owner = np.repeat(np.arange(len(count)), count)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    order, new = ordered(text, (np.cumsum(size) - size)[owner] + inside)
    docs = doc[owner]
    least = np.minimum.reduceat(docs[order], np.flatnonzero(new))
    first = np.empty(len(order), np.int64)
    first[order] = least[np.cumsum(new) - 1]
    earlier = np.where(first < docs, _U(1) << (inside + within[owner]).astype(_U), _U(0))
    mask = np.bitwise_or.reduceat(earlier, np.cumsum(count) - count)
    some = np.flatnonzero(mask)
    return _table(_FOUND, [(to, MASK, content[some[of]].tobytes(), mask[some[of]].tobytes()) for to, of in _by(part[some])])


_KEPT = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())]
KEPT = "doc_id long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary"


def kept_bytes(sizes: Sizes):
    """A part, and what it has been told -> its documents without removed bytes."""

    def run(row: pa.Table, told: pa.Table) -> pa.Table:
        if not row.num_rows:
            return _table(_KEPT, [])
        p = Part(row.to_pylist()[0], sizes)
        later = p.doc > p.doc[p.lead][p.which]
        whole = later | np.isin(p.contents, _contents(told, FULL))[p.which]
        bits = np.zeros(len(p.contents), _U)
        for r in told.to_pylist():
            if r["kind"] == MASK:
                np.bitwise_or.at(bits, np.searchsorted(p.contents, np.frombuffer(r["content"], _U)), np.frombuffer(r["mask"], _U))
        # an equal window of the part that was not sent has the fate of the one that was, or repeats it
        number, within, _, same = p.hot_windows(_contents(told, HOT))
        doc = p.doc[p.lead[number]]
        gone = (doc > doc[same]) | ((bits[number[same]] >> within[same].astype(_U)) & _U(1) > 0)
        np.bitwise_or.at(bits, number[gone], _U(1) << within[gone].astype(_U))
        edge = np.zeros(len(p.text) + 1, np.int32)
        np.add.at(edge, p.first[whole], 1)
        np.add.at(edge, p.first[whole] + p.count[whole] + LENGTH - 1, -1)
        some = np.flatnonzero(~whole & (bits[p.which] > 0))
        for k in range(LENGTH - GRAM + 1):
            at = p.first[some[(bits[p.which[some]] >> _U(k)) & _U(1) > 0]] + k
            np.add.at(edge, at, 1)
            np.add.at(edge, at + LENGTH, -1)
        covered = np.cumsum(edge[:-1]) > 0
        rows = []
        for id_, s, e in zip(p.ids, p.starts.tolist(), p.ends.tolist()):
            turns = np.flatnonzero(np.diff(covered[s:e], prepend=False, append=False)) if e > s else np.zeros(0, np.int64)
            spans = [{"start": a, "stop": b} for a, b in zip(turns[::2].tolist(), turns[1::2].tolist())]
            keep = [0, *turns.tolist(), e - s]
            rows.append((id_, e - s, spans, b"".join([p.text[s + a : s + b] for a, b in zip(keep[::2], keep[1::2])])))
        return _table(_KEPT, rows)

    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: Sizes = Sizes()) -> DataFrame:
    """doc_id, n_bytes, spans (start, stop in bytes) that repeat a document with a smaller id, and the bytes kept, of each row.

    Its working tables lie in the shared folder; they have to stay until the result is written, so release_tables() removes them."""
    spark = docs.sparkSession
    folder, name = f"{common.shared_dir(spark)}/parts-{uuid.uuid4().hex}", f"claimloom_parts_{uuid.uuid4().hex}"
    places = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed(docs, id_col, text_col, sizes.part).write.bucketBy(places, "part").option("path", folder).saveAsTable(name)
    parts = spark.table(name)
    size = parts.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    buckets = max(1, -(-size // sizes.bucket))
    told = common.cut(dictionary(parts, buckets, sizes).groupBy("bucket").applyInArrow(_grouped(first_documents(buckets)), FOUND))
    sent = parts.groupBy("part").cogroup(told.where(F.col("kind").isin(SEND, HOT)).groupBy("part")).applyInArrow(_cogrouped(sent_phrases(buckets, sizes)), SENT)
    mask = common.cut(sent.groupBy("bucket").applyInArrow(_grouped(masks), FOUND))
    last = told.where(F.col("kind") != SEND).unionByName(mask)
    out = parts.groupBy("part").cogroup(last.groupBy("part")).applyInArrow(_cogrouped(kept_bytes(sizes)), KEPT)
    parts.cut_path = folder
    out.working = (name, (parts, told, mask))
    return out


def release_tables(out: DataFrame) -> None:
    """Remove the working tables of without_repeats, once its result has been written."""
    name, tables = out.working
    out.sparkSession.sql(f"drop table if exists {name}")
    common.discard(*tables)


def op12_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(common.table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    out = common.cut(found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")))
    release_tables(found)
    return out


#: Every window as hexadecimal text, its first document, and the runs of covered bytes; null ids come last.
ORACLE_SQL = """
    with docs as (select row_number() over () as row, doc_id, coalesce(doc_id, 9223372036854775807) as o, hex(encode(coalesce(text, ''))) as h from documents),
    places as (select row, o, unnest(range(length(h) // 2 - 49)) as i from docs where length(h) >= 100),
    windows as (select p.row, p.o, i, substr(h, 2 * i + 1, 100) as w from places p join docs using (row)),
    firsts as (select w, min(o) as first from windows group by w),
    hits as (select row, i from windows join firsts using (w) where o > first),
    runs as (select row, i, i - coalesce(lag(i) over (partition by row order by i), -100) > 50 as begins from hits),
    numbered as (select row, i, sum(cast(begins as integer)) over (partition by row order by i) as n from runs),
    spans as (select row, n, min(i) as a, max(i) + 50 as b from numbered group by row, n),
    gaps as (
      select row, coalesce(lag(b) over (partition by row order by a), 0) as a, a as b from spans
      union all select row, max(b), 1000000000000 from spans group by row),
    kept as (select g.row, string_agg(substr(h, 2 * a + 1, cast(least(2 * (b - a), 2 * length(h)) as bigint)), '' order by a) as h from gaps g join docs using (row) group by g.row)
    select doc_id, length(d.h) // 2 as n_bytes, coalesce(s.n_removed, 0) as n_removed, coalesce(s.n_spans, 0) as n_spans, sha256(unhex(coalesce(k.h, d.h))) as kept_sha256
    from docs d left join kept k using (row) left join (select row, cast(sum(b - a) as bigint) as n_removed, count(*) as n_spans from spans group by row) s using (row)"""
