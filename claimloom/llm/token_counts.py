"""Token counts by a compiled finite-state transducer.

The tokenizer, pre-token pattern and byte-level merges together, becomes a deterministic
transducer over characters whose transitions carry emitted-token counts: after any prefix, the
sum of the counts is the number of tokens that the library would give if the text ended there
(so a count can be negative when a merge takes back a token). States and transitions are
compiled when a text first needs them and kept in the worker.

Within a pre-token the state rests on one property of byte-pair merges: a token sequence is the
encoding of its bytes if and only if every two neighbours in it are the encoding of theirs. So the
last token of every prefix is determined by the last tokens of the few prefixes at which a later
token could still start, and those, with their counts relative to now, are the state.

A long text is cut into chunks. Right after a blank that follows a non-blank, the state does not
depend on what came before; so a chunk's state map is its head up to that point, the count from
there on, and the state at its end. Two maps compose by running the second's head from the first's
end; composition is associative, and a prefix scan over the chunks gives each chunk's state and count.

What a worker has compiled is bounded within a text too: after every piece of a stretch without blanks, and before every chunk, a
worker with too many transitions starts afresh from the present state, which a few byte strings and counts describe.

Defined results: null and empty texts have no tokens; very long texts are counted whole, with or without blanks; repeated rows and equal
texts are counted alike, each row by itself; no rows give no rows; other columns are not read. The special token's string inside a text
counts as that one token and separates what stands beside it, which is the library's default.
"""

from __future__ import annotations

import gc
import json
import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from claimloom.llm import common

#: Unicode white space (fixed values).
BLANKS = frozenset("\t\n\x0b\x0c\r \x85\xa0                　")

_BLANK_THEN_SPACE = re.compile("[" + "".join(sorted(BLANKS)) + "] ")


def byte_letters() -> dict[str, int]:
    """The characters by which byte-level vocabulary files write bytes: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Merges:
    """What the transducer asks of the vocabulary: tokens, their proper prefixes, and whether two tokens can stand side by side."""

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        letters, model = byte_letters(), spec["model"]
        raw = lambda s: bytes(letters[c] for c in s)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.tokens = {bytes([b]) for b in letters.values()} | {a + b for a, b in self.rank}
        self.prefixes = {t[:i] for t in self.tokens for i in range(1, len(t))}
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.beside: dict[tuple[bytes, bytes], bool] = {}
        self.made: dict[bytes, tuple[bytes, bytes, int]] = {}

    def parts(self, token: bytes) -> tuple[bytes, bytes, int]:
        """The two tokens that the last merge of a token's encoding joins, and that merge's rank; for a byte, two empty ones and -1."""
        found = self.made.get(token)
        if found is None:
            parts, last = [token[i : i + 1] for i in range(len(token))], (b"", b"", -1)
            while len(parts) > 1:
                rank, at = min((self.rank.get((parts[i], parts[i + 1]), 1 << 40), i) for i in range(len(parts) - 1))
                last = (parts[at], parts[at + 1], rank)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            found = self.made[token] = last
        return found

    def fits(self, left: bytes, right: bytes) -> bool:
        """Is the encoding of both together these two tokens? The merges that made them are undone from the last one on: a merge across
        the border would have come first if its rank is below that of what is undone (or equal, when that stands to its right)."""
        found = self.beside.get((left, right))
        if found is None:
            if len(self.beside) > 500_000:
                self.beside.clear()
            found, at, a, b = True, 1 << 40, left, right
            while True:
                if self.rank.get((a, b), 1 << 40) < at:
                    found = False
                    break
                (_, end, of_left), (start, _, of_right) = self.parts(a), self.parts(b)
                if of_left < 0 and of_right < 0:
                    break
                if of_left > of_right:
                    at, a = of_left, end
                else:
                    at, b = of_right + 1, start
            self.beside[left, right] = found
        return found


class Inner:
    """State inside a pre-token: the suffix that could begin a token, and for each place in it the last token there and the count there less the count now."""

    __slots__ = ("suffix", "last", "steps")

    def __init__(self, suffix: bytes, last: tuple) -> None:
        self.suffix, self.last, self.steps = suffix, last, {}


class State(dict):
    """A transducer state: character -> (next state, emitted count); missing transitions are compiled on first use."""

    __slots__ = ("machine", "kind", "data")

    def __init__(self, machine: Transducer, kind: str, data: tuple) -> None:
        self.machine, self.kind, self.data = machine, kind, data

    def __missing__(self, ch: str) -> tuple[State, int]:
        self.machine.transitions += 1
        found = self[ch] = self.machine.compile(self, ch)
        return found


class WordCounts(dict):
    """word -> what a space and the word add to the count after a non-blank. A full young generation becomes the old
    one; what is asked for again moves back, so frequent words stay."""

    def __init__(self, machine: Transducer) -> None:
        self.machine, self.old = machine, {}

    def __missing__(self, word: str) -> int:
        found = self.old.get(word)
        if found is None:
            found = self.map_of(word)[1]
            if len(word) > self.machine.WORD_CHARS:
                return found
        if len(self) >= self.machine.WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found

    def map_of(self, word: str) -> tuple[State, int]:
        """Where a space and the word lead after a non-blank, and what they add."""
        return self.machine.steps(self.machine.start[" "][0], word, self.machine.start[" "][1])


class Transducer:
    #: Compiled transitions a worker keeps; beyond them it starts afresh, after the piece of so many characters that it reads.
    MOST, PIECE = 900_000, 1 << 14
    #: Characters of a chunk; words whose counts a worker remembers in each of two generations, and the longest of them.
    CHUNK, WORDS, WORD_CHARS = 1 << 16, 600_000, 40

    def __init__(self, path: str) -> None:
        self.merges = Merges(path)
        self.reset()

    def reset(self) -> None:
        self.transitions = 0
        self.states: dict[tuple, State] = {}
        self.inner: dict[tuple, Inner] = {}
        self.empty = self.inner_state(b"", ((None, 0),))
        self.start = self.state("fresh", ())
        self.words = WordCounts(self)

    def state(self, kind: str, data: tuple) -> State:
        key = (kind, *map(id, data[:2]), *data[2:]) if kind == "blank" else (kind, *(id(x) if isinstance(x, Inner) else x for x in data))
        if key not in self.states:
            self.states[key] = State(self, kind, data)
        return self.states[key]

    def inner_state(self, suffix: bytes, last: tuple) -> Inner:
        if (suffix, last) not in self.inner:
            self.inner[suffix, last] = Inner(suffix, last)
        return self.inner[suffix, last]

    def step(self, at: Inner, byte: int) -> tuple[Inner, int]:
        """Read one byte within a pre-token."""
        if byte in at.steps:
            return at.steps[byte]
        tail = at.suffix + bytes([byte])
        for n in range(len(tail), 0, -1):
            token = tail[-n:]
            if token not in self.merges.tokens or at.last[n - 1] is None:
                continue
            before, count = at.last[n - 1]
            if before is None or self.merges.fits(before, token):
                break
        emitted = count + 1
        while tail and tail not in self.merges.prefixes:
            tail = tail[1:]
        last = [(token, 0)]  # and nothing for the places at which no token can start any more
        for k in range(1, len(tail) + 1):
            place = at.last[k - 1]
            last.append((place[0], place[1] - emitted) if place and tail[-k:] in self.merges.prefixes else None)
        last = tuple(last)
        at.steps[byte] = self.inner_state(tail, last), emitted
        return at.steps[byte]

    def read(self, at: Inner, text: str) -> tuple[Inner, int]:
        total = 0
        for b in text.encode():
            at, n = self.step(at, b)
            total += n
        return at, total

    @staticmethod
    def class_of(ch: str) -> str:
        major = unicodedata.category(ch)[0]
        return "blank" if ch in BLANKS else "letter" if major == "L" else "number" if major == "N" else "other"

    def fresh(self, ch: str) -> tuple[State, int]:
        """A pre-token begins with ch."""
        kind, (at, n) = self.class_of(ch), self.read(self.empty, ch)
        if kind == "blank":
            return self.state("blank", (self.empty, at, ch, n)), n
        return self.state("quote" if ch == "'" else kind, (at,)), n

    def compile(self, state: State, ch: str) -> tuple[State, int]:
        kind, is_a = state.kind, self.class_of(ch)
        if kind == "blank":  # a run of blanks: without its last one, with it, the last one, what that one counts
            shorter, run, last, n = state.data
            if is_a == "blank":
                at, more = self.read(run, ch)
                return self.state("blank", (run, at, ch, more)), more
            if last == " ":  # it belongs to what follows
                at, more = self.read(self.empty, " " + ch)
                return self.state(is_a, (at,)), more - n
            to, more = self.fresh(ch)
            return to, more - n + self.read(self.empty, last)[1]
        if kind == "quote":  # an apostrophe at a pre-token's start: perhaps 's, 't, 'm, 'd
            if ch in "stmd":
                return self.start, self.read(self.empty, "'" + ch)[1] - 1
            if ch in "lvr":
                at, more = self.read(self.empty, ch)
                return self.state("clitic", (at, ch, more)), more
            kind = "other"
        elif kind == "clitic":  # perhaps 'll, 've, 're
            _, first, n = state.data
            if first + ch in ("ll", "ve", "re"):
                return self.start, self.read(self.empty, "'" + first + ch)[1] - 1 - n
            kind = "letter"
        if kind == is_a:
            at, more = self.read(state.data[0], ch)
            return self.state(kind, (at,)), more
        return self.fresh(ch)

    @staticmethod
    def described(state: State) -> tuple:
        """The state without what was compiled from it."""
        return state.kind, *((x.suffix, x.last) if isinstance(x, Inner) else x for x in state.data)

    def revived(self, described: tuple) -> State:
        return self.state(described[0], tuple(self.inner_state(*x) if isinstance(x, tuple) else x for x in described[1:]))

    def bounded(self) -> bool:
        """Start afresh if there is too much; True if so."""
        if self.transitions <= self.MOST:
            return False
        self.reset()
        gc.collect()
        return True

    def steps(self, state: State, text: str, total: int = 0) -> tuple[State, int]:
        if len(text) > self.PIECE:
            for i in range(0, len(text), self.PIECE):
                state, total = self.steps(state, text[i : i + self.PIECE], total)
                if self.transitions > self.MOST:
                    now = self.described(state)
                    del state  # it holds all that was compiled from it
                    self.bounded()
                    state = self.revived(now)
            return state, total
        for ch in text:
            state, n = state[ch]
            total += n
        return state, total

    def run(self, state: State, text: str) -> tuple[State, int]:
        """Read a text. A space after a non-blank leads to the same state always, so the maps of a space and a word are remembered.

        Where no word is empty or ends in a blank, every word is read after a non-blank, and the count is the sum over the words."""
        first, *rest = text.split(" ")
        if rest and first and first[-1] not in BLANKS and not _BLANK_THEN_SPACE.search(text):
            total = self.steps(state, first)[1] + sum(map(self.words.__getitem__, rest[:-1]))
            state, n = self.words.map_of(rest[-1])
            return state, total + n
        state, total = self.steps(state, first)
        for word in rest:
            state, n = self.steps(state, " " + word) if state.kind == "blank" else self.words.map_of(word)
            total += n
        return state, total

    def chunk_map(self, text: str) -> tuple[str, tuple | None, int]:
        """(head, end state as described, count after the head); without an end state all of the text is head."""
        self.bounded()
        for i in range(1, len(text)):
            if text[i] in BLANKS and text[i - 1] not in BLANKS:
                state, n = self.run(self.start[text[i]][0], text[i + 1 :])
                return text[: i + 1], self.described(state), n
        return text, None, 0

    def compose(self, one: tuple, two: tuple) -> tuple:
        if one[1] is None:
            return one[0] + two[0], two[1], two[2]
        self.bounded()
        state, n = self.run(self.revived(one[1]), two[0])
        return one[0], self.described(state) if two[1] is None else two[1], one[2] + n + two[2]

    def scan(self, maps: list[tuple]) -> list[tuple]:
        """Inclusive prefix scan: pairs are composed, the half as many are scanned, and each odd place gets one more step."""
        if len(maps) < 2:
            return maps
        half = self.scan([self.compose(maps[i], maps[i + 1]) for i in range(0, len(maps) - 1, 2)])
        return [maps[0] if i == 0 else half[i // 2] if i % 2 else self.compose(half[i // 2 - 1], maps[i]) for i in range(len(maps))]

    def count(self, text: str) -> int:
        self.bounded()
        total, parts = 0, [text]
        for special in self.merges.special:
            parts = [q for p in parts for q in p.split(special)] if special in text else parts
        total = len(parts) - 1
        for part in parts:
            if len(part) <= self.CHUNK:
                total += self.run(self.start, part)[1]
            else:
                cuts = [self.chunk_map(part[i : i + self.CHUNK]) for i in range(0, len(part), self.CHUNK)]
                head, _, n = self.scan(cuts)[-1]
                total += self.run(self.start, head)[1] + n
        return total


_COMPILED: dict[str, Transducer] = {}


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit): one row per row of docs, no shuffle."""

    def rows(parts: Iterator) -> Iterator[dict[str, list]]:
        if path not in _COMPILED:
            _COMPILED[path] = Transducer(path)
        machine = _COMPILED[path]
        for keys, texts in parts:
            with common.without_gc():
                n = [machine.count(t.decode()) if t else 0 for t in texts]
            yield {id_col: keys, "n_bytes": [len(t or b"") for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return common.map_text(docs, rows, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean", id_col, text_col)


def op5_token_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    return count_tokens(common.table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.json"))
