"""Toxicity scores: Levenshtein automata intersected with a lexicon trie, weighed by context.

The lexicon is learned. Over a bounded sample of labelled training documents, words and prefixes are
counted by documents and by the variety of their contexts in toxic ones (a 64-bit map of hashed
neighbours, so that copies of one document count once); those that vary and are far more frequent in
toxic documents are terms, of any length, prefixes as stems of any ending. How many contexts are asked for follows the number of toxic documents
in the sample: ten from 60 on, a sixth of them below, four at least. A word is run through the determinised product of the lexicon's trie and the
Levenshtein automata of all its terms at once (one edit from 5 letters on, two from 8): a state is the
set of trie places reachable with the fewest edits, and transitions are made when first needed.

Each term has a weight for exact and one for misspelled hits, its log odds in the sample, so a term
whose neighbours by edits are ordinary words loses them. A hit in quotation marks, or shortly after a
verb of reporting, counts by a factor that the sample gives, low where it shows no such hits. A
document's evidence, the bounded sums of its distinct words' weights for exact and for misspelled hits, goes into
a logistic regression fitted on the sample, held near plain addition where the sample says little; its
slopes are never negative, so that more evidence never lowers a score.

Defined results: null, empty and wordless texts get the score of a document without hits; null labels
train nothing; without training rows there are no terms and all scores are the same, below 0.5.
Repeated rows are scored alike, and repeated labels of an id count once, by the largest; of rows that share a
labelled id one, the least text, is learned from. Terms of equal counts are all kept, so ties need no order. A very
long text is read as any other, and its sums are bounded. A document's id, language, source and labels are not inputs.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import common

#: Bound of what is learned from: labelled training rows. All their terms that pass the limits below are kept.
SAMPLE = 20_000
STEMS = (3, 4, 5, 6, 7, 8)  # lengths of prefixes that may be terms
LEAST_LIFT = 6.0  # of the share of toxic documents over that of others
#: A term is in at least so many toxic documents and contexts: one in SHARE of the sample's toxic documents, but from FLOOR to MOST_VARIETY.
SHARE, FLOOR, MOST_VARIETY = 6, 4, 10
EXACT_MOST, FUZZY_MOST, SUM_MOST = 7.0, 5.5, 20.0
WINDOW = 4  # words before a hit that are its context
_STRIP = " \t\r\n\x0b\x0c!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~“”„«»‘’¡¿…"
_QUOTES = frozenset("\"“”„«»")
#: Verbs of reporting in the languages at hand (fixed values).
_REPORTS = frozenset("said says wrote called quote quoted sagte schrieb nannte zitierte dit disait écrit cita dijo escribió llamó citó".split())


def tokens(text: bytes | None) -> list[str]:
    return text.decode().split() if text else []


def bare(token: str) -> str:
    return token.strip(_STRIP).lower()


def most_edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


def least_variety(n_toxic: int) -> int:
    return min(MOST_VARIETY, max(FLOOR, -(-n_toxic // SHARE)))


class Place:
    """A node of the trie; word, stem: the term that ends here; reach: the most edits of the terms below."""

    __slots__ = ("children", "word", "stem", "reach")

    def __init__(self) -> None:
        self.children: dict[str, Place] = {}
        self.word = self.stem = None
        self.reach = 0


class Lexicon:
    MOST = 200_000  # transitions kept

    def __init__(self, terms: list[tuple[str, bool]]) -> None:
        """terms: (text, is it a stem)."""
        self.root = Place()
        for term, is_stem in terms:
            at, reach = self.root, most_edits(term)
            at.reach = max(at.reach, reach)
            for ch in term:
                at = at.children.setdefault(ch, Place())
                at.reach = max(at.reach, reach)
            setattr(at, "stem" if is_stem else "word", term)
        self._start()

    def _start(self) -> None:
        self.made = 0
        self.known: dict[tuple, tuple] = {}
        self.start = self._state(self._closed({self.root: 0}), {})

    @staticmethod
    def _closed(edits: dict[Place, int]) -> dict[Place, int]:
        """With the places reached by leaving out letters of terms."""
        todo = list(edits.items())
        while todo:
            place, e = todo.pop()
            if edits[place] == e and e < place.reach:
                for child in place.children.values():
                    if e + 1 <= child.reach and e + 1 < edits.get(child, 99):
                        edits[child] = e + 1
                        todo.append((child, e + 1))
        return edits

    def _state(self, edits: dict[Place, int], stems: dict[str, int]) -> tuple:
        """(places with edits, stems passed with edits, transitions)."""
        for place, e in edits.items():
            if place.stem and e <= most_edits(place.stem) and e < stems.get(place.stem, 99):
                stems = stems | {place.stem: e}
        key = (frozenset((id(p), e) for p, e in edits.items()), frozenset(stems.items()))
        if key not in self.known:
            self.known[key] = (edits, stems, {})
        return self.known[key]

    def _step(self, state: tuple, ch: str) -> tuple:
        edits: dict[Place, int] = {}
        for place, e in state[0].items():
            for letter, child in place.children.items():
                cost = e + (letter != ch)
                if cost <= child.reach and cost < edits.get(child, 99):
                    edits[child] = cost
            if e + 1 <= place.reach and e + 1 < edits.get(place, 99):
                edits[place] = e + 1
        self.made += 1
        state[2][ch] = to = self._state(self._closed(edits), state[1])
        return to

    def match(self, word: str) -> dict[str, int]:
        """Terms within their edits of the word (stems: of one of its prefixes), with the fewest edits."""
        if self.made > self.MOST:
            self._start()
        state = self.start
        for ch in word:
            to = state[2].get(ch)
            state = to if to is not None else self._step(state, ch)
            if not state[0]:
                break
        else:
            found = dict(state[1])
            for place, e in state[0].items():
                if place.word and e <= most_edits(place.word):
                    found[place.word] = min(e, found.get(place.word, 99))
            return found
        return state[1]


def quoted(words: list[str], i: int) -> bool:
    """Is the word in quotation marks, or does a verb of reporting or an opening mark stand shortly before it?"""
    if not _QUOTES.isdisjoint(words[i]):
        return True
    near = words[max(0, i - WINDOW) : i]
    return sum(c in _QUOTES for w in near for c in w) % 2 == 1 or any(bare(w) in _REPORTS for w in near)


def hits(lexicon: Lexicon, texts: list[bytes | None]) -> list[dict[tuple[str, bool], dict[str, int]]]:
    """Per text: (bare word, is it quoted) -> terms with edits. Distinct words of the slice are matched once."""
    docs = [tokens(t) for t in texts]
    flagged = {}
    for token in set().union(*docs):
        if found := lexicon.match(bare(token)):
            flagged[token] = found
    out = []
    for words in docs:
        found = {}
        if not flagged.keys().isdisjoint(words):
            for i, token in enumerate(words):
                if token in flagged:
                    found[bare(token), quoted(words, i)] = flagged[token]
        out.append(found)
    return out


def _odds(yes: float, no: float, n_yes: int, n_no: int) -> float:
    return float(np.log((yes + 1) / (n_yes + 2)) - np.log((no + 0.5) / (n_no + 2)))


def evidence(model: dict, found: dict) -> list[float]:
    """1, and the sums of exact and of misspelled weights, each at most SUM_MOST."""
    sums, weights = [0.0, 0.0], model["weights"]
    for (_, said), terms in found.items():
        # a word counts by its strongest term
        w, exact = max((weights[t, e == 0], e == 0) for t, e in terms.items())
        sums[not exact] += w * (model["quoted"] if said else 1.0)
    return [1.0, min(SUM_MOST, sums[0]), min(SUM_MOST, sums[1])]


def fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: np.ndarray) -> np.ndarray:
    """Logistic regression drawn to prior, by Newton steps that are halved until the loss falls; slopes stay at or above zero."""

    def loss(beta: np.ndarray) -> float:
        z = x @ beta
        return float(np.logaddexp(0, z).sum() - y @ z + (ridge * (beta - prior) ** 2).sum() / 2)

    beta, now = prior.copy(), loss(prior)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(ridge), x.T @ (p - y) + ridge * (beta - prior))
        for k in range(30):
            to = beta - step / 2**k
            to[1:] = np.maximum(to[1:], 0)
            if (then := loss(to)) < now - 1e-9:
                break
        else:
            return beta
        beta, now = to, then
    return beta


PRIOR, RIDGE = np.array([-4.0, 0.8, 0.9]), np.array([0.1, 10.0, 10.0])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """Terms, weights, context factor and regression from at most `sample` labelled rows (the first by hash of id)."""
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(sample)
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    # one document to each of at most `sample` ids, however often an id repeats
    rows = common.cut(slim.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text")).select("y", "text"))
    n = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    n0, n1 = n.get(0, 0), sum(c for y, c in n.items() if y)

    def spread(parts: Iterator) -> Iterator[dict[str, list]]:
        """Documents and contexts of words and prefixes, by label; prefixes are marked by a star."""
        seen: dict[str, list[int]] = {}
        signed = lambda v: v - (1 << 64) if v >> 63 else v
        out = lambda: {"name": list(seen), "other": [v[0] for v in seen.values()], "toxic": [v[1] for v in seen.values()], "contexts": [signed(v[2]) for v in seen.values()]}
        for sides, texts in parts:
            for side, text in zip(sides, texts):
                before, marks = "", defaultdict(int)
                for word in map(bare, tokens(text)):
                    marks[word] |= 1 << (zlib.crc32(before.encode()) & 63)
                    before = word
                for word in list(marks):
                    tail = 1 << (zlib.crc32(word.encode()) & 63)
                    for k in STEMS:
                        if len(word) > k:
                            marks[word[:k] + "*"] |= tail
                for name, mark in marks.items():
                    got = seen.get(name)
                    if got is None:
                        got = seen[name] = [0, 0, 0]
                    got[side > 0] += 1
                    if side > 0:
                        got[2] |= mark
            if len(seen) > 300_000:
                yield out()
                seen.clear()
        if seen:
            yield out()

    lift = (F.col("toxic") + 0.5) / (F.col("other") + 0.5) * ((n0 + 1) / (n1 + 1))
    found = common.map_text(rows, spread, "name string, other long, toxic long, contexts long", "y")
    found = found.groupBy("name").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"), F.bit_or("contexts").alias("contexts"))
    least = least_variety(n1)
    found = found.where((F.bit_count("contexts") >= least) & (F.col("toxic") >= least) & (lift >= LEAST_LIFT) & ~F.col("name").isin("", "*"))
    counted = {r.name: r.toxic for r in found.collect()}
    stems = {m: c for m, c in counted.items() if m.endswith("*")}
    # of nested stems with nearly the same documents, the longest
    names = {m for m, c in counted.items() if m not in stems or not any(len(o) > len(m) and o.startswith(m[:-1]) and 10 * d >= 9 * c for o, d in stems.items())}
    entries = sorted((m.removesuffix("*"), m.endswith("*")) for m in names)
    entries = [e for e in entries if e[1] or (e[0], True) not in entries]

    def tally(parts: Iterator) -> Iterator[dict[str, list]]:
        lexicon, total = Lexicon(entries), defaultdict(lambda: [0, 0])
        for sides, texts in parts:
            for side, doc in zip(sides, hits(lexicon, texts)):
                for key in {(t, "exact" if e == 0 else "fuzzy") for m in doc.values() for t, e in m.items()} | {("", "quoted" if said else "plain") for (_, said), m in doc.items() if 0 in m.values()}:
                    total[key][side > 0] += 1
        yield {"term": [k[0] for k in total], "kind": [k[1] for k in total], "other": [v[0] for v in total.values()], "toxic": [v[1] for v in total.values()]}

    tallied = common.map_text(rows, tally, "term string, kind string, other long, toxic long", "y").groupBy("term", "kind").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    counts = defaultdict(lambda: (0, 0), {(r.term, r.kind): (r.toxic, r.other) for r in tallied.collect()})

    def weigh(term: str, exact: bool) -> float:
        w = min(EXACT_MOST, max(0.0, _odds(*counts[term, "exact"], n1, n0)))
        toxic, other = counts[term, "fuzzy"]
        # misspelled: a little less, and nothing where words that differ by an edit or two are ordinary ones
        rare = other <= 1 + n0 / 10_000 or _odds(toxic, other, n1, n0) >= np.log(10 * LEAST_LIFT)
        return float(w if exact else min(FUZZY_MOST, max(0.0, w - 1.5)) * rare)

    said, plain = (_odds(*counts["", k], n1, n0) for k in ("quoted", "plain"))
    model = {
        "terms": entries, "beta": PRIOR,
        "weights": {(t, e): weigh(t, e) for t, _ in entries for e in (True, False)},
        "quoted": min(1.0, max(0.2, said / plain)) if plain > 0 and sum(counts["", "quoted"]) > 20 else 0.25,
    }

    def features(parts: Iterator) -> Iterator[dict[str, list]]:
        lexicon = Lexicon(entries)
        for sides, texts in parts:
            yield {"y": sides, "x": [evidence(model, doc) for doc in hits(lexicon, texts)]}

    if n0 and n1:
        data = common.map_text(rows, features, "y int, x array<double>", "y").collect()  # at most `sample` rows
        x, y = np.array([r.x for r in data]), np.array([float(r.y > 0) for r in data])
        by = np.lexsort((*x.T, y))  # sums in one order, whatever the order of rows
        model["beta"] = fit(x[by], y[by], PRIOR, RIDGE)
    return model


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted, n_hits, terms: one row per row of docs, no shuffle."""

    def rows(parts: Iterator) -> Iterator[dict[str, list]]:
        lexicon = Lexicon(model["terms"])
        for keys, texts in parts:
            found = hits(lexicon, texts)
            x = np.array([evidence(model, f) for f in found]).reshape(-1, len(PRIOR))
            scores = 1 / (1 + np.exp(-np.clip(x @ model["beta"], -30, 30)))
            yield {id_col: keys, "score": scores, "predicted": (scores >= 0.5).astype(int), "n_hits": [len(f) for f in found], "terms": [sorted({t for m in f.values() for t in m}) for f in found]}

    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, score double, predicted int, n_hits long, terms array<string>"
    return common.map_text(docs, rows, schema, id_col, text_col)


def op8_levenshtein_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = learn(docs, labels.where(~common.held_out("doc_id", 5, 0)))
    return score(docs, model).select("doc_id", common.held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")
