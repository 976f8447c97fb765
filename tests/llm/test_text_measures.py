"""Operators that judge one text at a time, against libraries and brute force."""

import base64
import hashlib
import re
from collections import Counter, defaultdict

import cases
import public_tokenizers
import pytest

from claimloom.llm import bpe, decontaminate, repetition, token_counts, toxicity


def both(spark, small):
    """(DataFrame, its (id, text) pairs) of the edge cases and of a whole table."""
    yield cases.documents(spark), cases.texts()
    yield spark.read.parquet(f"{small}/documents.parquet"), cases.pairs(small)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_token_counts_are_the_library_s(spark, small, monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for docs, known in both(spark, small):
        want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in known]
        assert rows(token_counts.count_tokens(docs, path), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    monkeypatch.setattr(token_counts.Transducer, "CHUNK", 7)
    machine = token_counts.Transducer(path)
    for _, t in cases.texts():
        assert machine.count((t or "")[:3000]) == len(library.encode((t or "")[:3000], add_special_tokens=False).ids)
    assert token_counts.count_tokens(cases.empty(spark), path).count() == 0


def test_bpe_is_the_library_s_and_comes_back(spark, small):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for docs, known in both(spark, small):
        want = [(i, len(ids := library.encode_ordinary(t or "")), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode()), True) for i, t in known]
        got = bpe.encode(docs, path, public_tokenizers.PATTERN)
        assert rows(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip") == sorted(want, key=repr)
    back = bpe.decode(bpe.encode(cases.documents(spark), path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    assert rows(back, "doc_id", "text") == sorted([(i, t or "") for i, t in cases.texts()], key=repr)
    assert bpe.encode(cases.empty(spark), path, public_tokenizers.PATTERN).count() == 0


def repeats(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words by definition."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i : i + 3])].append(i)
    hit = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    n, r = len(words), len(hit)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, r, n < 50 or 100 * r > 50 * n


def longest(words):
    """Longest repeat, and words inside repeats of five or more, by trying all lengths."""
    best, inside = 0, set()
    for size in range(1, len(words)):
        at = defaultdict(list)
        for i in range(len(words) - size + 1):
            at[tuple(words[i : i + size])].append(i)
        found = [i for v in at.values() if len(v) > 1 for i in v]
        if not found:
            break
        best = size
        if size >= 5:
            inside |= {i + k for i in found for k in range(size)}
    return best, len(inside)


def test_repetition(spark, small):
    for docs, known in both(spark, small):
        got = rows(repetition.score(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert got == sorted([(i, *repeats(t)) for i, t in known], key=repr)
    some = [(i, t) for i, t in [*cases.texts(), *cases.pairs(small)] if len((t or "").split()) < 400]
    m = repetition.measure([t.encode() if t is not None else None for _, t in some])
    assert list(zip(m["longest_repeat"].tolist(), m["n_covered"].tolist())) == [longest((t or "").encode().split()) for _, t in some]
    docs = cases.documents(spark)
    kept = repetition.keep_documents(docs)
    assert kept.columns == docs.columns
    assert rows(kept, "doc_id") == rows(repetition.score(docs).where("kept"), "doc_id")
    assert {r[0] for r in rows(kept, "doc_id")} >= {6, 7, 8} and repetition.score(cases.empty(spark)).count() == 0


def contamination(known, items, window=13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for key, text in items:
        w = split(text)
        if key is not None and w:
            for i in range(max(1, len(w) - window + 1)):
                windows[tuple(w[i : i + window])].add(str(key))
    sizes = {len(w) for w in windows}
    for key, text in known:
        w, hit, found = split(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if keys := windows.get(tuple(w[i : i + size])):
                    hit.update(range(i, i + size))
                    found |= keys
        yield key, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_decontamination(spark, small, monkeypatch):
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    own = [(1, "w1 w2"), (2, " ".join(cases.prose(1, 200)[20:50])), (2, " ".join(cases.prose(1, 200)[20:50])), (3, None), (4, "..."), (None, "one"), (5, "one two three"), (6, "two"), (7, "aa " * 20), (8, " ".join(cases.prose(3, 40, 5000)))]
    for block in (200_000, 10):
        monkeypatch.setattr(decontaminate.Benchmark.__init__, "__defaults__", (13, block, "item_id", "text"))
        items = spark.createDataFrame(own, "item_id long, text string")
        assert rows(decontaminate.score(cases.documents(spark), items), *columns) == sorted(contamination(cases.texts(), own), key=repr)
        docs, bench = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
        want = sorted(contamination(cases.pairs(small), cases.pairs(small, "benchmark", "item_id")), key=repr)
        assert rows(decontaminate.score(docs, bench), *columns) == want and any(w[-1] for w in want)
    kept = decontaminate.keep_documents(docs, bench)
    assert kept.columns == docs.columns and {r[0] for r in rows(kept, "doc_id")} == {w[0] for w in want if not w[-1]}
    assert decontaminate.score(cases.empty(spark), items.limit(0)).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automata_find_what_edit_distance_finds():
    terms = [("stupid", False), ("horrible", True), ("abc", False), ("nastiest", False), ("slimy", True)]
    lexicon = toxicity.Lexicon(terms)
    words = ["stupid", "stupd", "sstupid", "sttuppid", "horribly", "horrribleness", "abc", "abd", "nastest", "natest", "slimyx", "slmy", "", "z", "stup", "orrible"]
    for w in words:
        want = {}
        for term, stem in terms:
            e = min(distance(w[:k], term) for k in (range(len(w) + 1) if stem else [len(w)]))
            if e <= toxicity.most_edits(term):
                want[term] = e
        assert lexicon.match(w) == want, w


def test_toxicity_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    got = toxicity.op8_levenshtein_lexicon(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    bad = [r for r in got if r.toxic]
    assert sum(r.predicted for r in bad) > 0.8 * len(bad) and sum(r.predicted != r.toxic for r in got) < 0.1 * len(got)
    docs = cases.documents(spark)
    labels = spark.createDataFrame([(6, 1), (7, None), (9, 0)], "doc_id long, toxic int")
    for given in (labels, labels.limit(0)):
        scored = toxicity.score(docs, toxicity.learn(docs, given)).collect()
        assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.score(cases.empty(spark), toxicity.learn(cases.empty(spark), labels)).count() == 0


def _counted_terms(texts: list[tuple[str, int]]) -> tuple[list[str], dict[str, float]]:
    """Terms by the rules and weights of exact hits, by plain counting; a star marks a stem."""
    import math
    import zlib

    docs, n = {}, [sum(not y for _, y in texts), sum(bool(y) for _, y in texts)]
    for i, (text, y) in enumerate(texts):
        words = [w.strip(toxicity._STRIP).lower() for w in (text or "").split()]
        for before, w in zip(["", *words], words):
            for name, mark in [(w, before)] + [(w[:k] + "*", w) for k in range(3, 9) if len(w) > k]:
                of = docs.setdefault(name, (set(), set(), set()))
                of[bool(y)].add(i)
                if y:
                    of[2].add(zlib.crc32(mark.encode()) % 64)
    least = min(10, max(4, math.ceil(n[1] / 6)))
    found = {m: len(b) for m, (a, b, c) in docs.items() if min(len(b), len(c)) >= least and m.strip("*") and (len(b) + 0.5) / (len(a) + 0.5) * (n[0] + 1) / (n[1] + 1) >= 6}
    kept = {m for m, c in found.items() if not (m[-1] == "*" and any(o[-1] == "*" and len(o) > len(m) and o.startswith(m[:-1]) and 10 * d >= 9 * c for o, d in found.items()))}
    kept = sorted(m for m in kept if m[-1] == "*" or m + "*" not in kept)
    log = lambda m: math.log((len(docs[m][1]) + 1) / (n[1] + 2)) - math.log((len(docs[m][0]) + 0.5) / (n[0] + 2))
    return kept, {m: min(7.0, max(0.0, log(m))) for m in kept if m[-1] != "*"}


def test_terms_of_small_tables_are_found_by_counting(spark):
    import zlib

    for sf in ("sf0.001", "sf0.01"):
        docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
        known = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 != 0}
        terms, weights = _counted_terms([(r.text, known[r.doc_id]) for r in docs.collect() if r.doc_id in known])
        model = toxicity.learn(docs, labels.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"))
        assert sorted(t + "*" * stem for t, stem in model["terms"]) == terms and len(terms) >= 5
        assert all(abs(model["weights"][t, True] - w) < 1e-9 for t, w in weights.items())
        scored = toxicity.score(docs, model)
        assert scored.select("score").distinct().count() > 2
        # labels of these tables are noisy: of the documents with two terms or more nearly all are toxic and are found
        clear = scored.where("size(terms) >= 2").join(labels, "doc_id").collect()
        assert sum(r.predicted for r in clear if r.toxic) > 0.9 * sum(r.toxic for r in clear)
    short = [(i, f"{'xy' if i < 30 else 'ab'} w{i} v{i * 7}") for i in range(200)]
    docs = spark.createDataFrame(short, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 30)) for i, _ in short], "doc_id long, toxic int")
    # the word before xy is none in these texts, so its one context is not enough; with others it is a term of two letters
    assert ("xy", False) not in toxicity.learn(docs, labels)["terms"]
    varied = docs.selectExpr("doc_id", "concat('u', doc_id * 3, ' ', text) as text")
    assert toxicity.learn(varied, labels)["terms"] == [("xy", False)]


def test_toxicity_is_the_sum_over_words_by_edit_distance():
    """The whole score of texts from a model, with every word held against every term."""
    terms = [("stupid", False), ("horrible", True), ("abc", False), ("slimy", True)]
    weights = {(t, e): w for (t, _), w in zip(terms, (6.0, 4.0, 3.0, 2.0)) for e in (True, False)}
    weights |= {(t, False): w / 2 for (t, e), w in weights.items() if e}
    model = {"terms": terms, "weights": weights, "quoted": 0.25, "beta": [-4.0, 0.5, 0.75]}
    texts = [None, "", "Stupid horribly stupid", 'He "stupid" ok', "she said that stupd thing", "abd abc! slimyness", "horrrible " * 50 + "sstupid", "plain words only"]
    import math

    for text, x in zip(texts, (toxicity.evidence(model, f) for f in toxicity.hits(toxicity.Lexicon(terms), [t.encode() if t is not None else None for t in texts]))):
        sums, tokens, done = [0.0, 0.0], (text or "").split(), set()
        for i, token in enumerate(tokens):
            word = token.strip("!\"").lower()
            near = tokens[max(0, i - 4) : i]
            said = '"' in token or sum(w.count('"') for w in near) % 2 == 1 or any(w.lower() in ("said", "wrote") for w in near)
            if (word, said) in done:
                continue
            done.add((word, said))
            found = []
            for term, stem in terms:
                e = min(distance(word[:k], term) for k in (range(len(word) + 1) if stem else [len(word)]))
                if e <= (0 if len(term) < 5 else 1 if len(term) < 8 else 2):
                    found.append((weights[term, e == 0], e == 0))
            if found:
                w, exact = max(found)
                sums[not exact] += w * (0.25 if said else 1.0)
        assert x == [1.0, min(20.0, sums[0]), min(20.0, sums[1])], text
        assert math.isfinite(sum(a * b for a, b in zip(x, model["beta"])))


def test_slopes_are_found_and_never_negative():
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.column_stack([np.ones(500), rng.uniform(0, 10, 500), rng.uniform(0, 3, 500)])
    y = (x[:, 1] > 5).astype(float)
    beta = toxicity.fit(x, y, toxicity.PRIOR, toxicity.RIDGE)
    assert (beta[1:] >= 0).all() and ((x @ beta > 0) == (y > 0)).mean() > 0.97
    assert (toxicity.fit(x, 1 - y, toxicity.PRIOR, toxicity.RIDGE)[1:] >= 0).all()


def test_token_counts_of_odd_texts(monkeypatch):
    import random

    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, machine = Tokenizer.from_file(path), token_counts.Transducer(path)
    r = random.Random(4)
    pieces = ["a", "b", "the", " ", "  ", "\n", "\t", "'s", "'", "'ll", "é", "日", "1", "23", ".", "!?", "ing", "'re x", "\u3000", "<|endoftext|>"]
    for _ in range(3000):
        t = "".join(r.choice(pieces) for _ in range(r.randrange(14)))
        assert machine.count(t) == len(library.encode(t, add_special_tokens=False).ids), t
    monkeypatch.setattr(token_counts.Transducer, "WORDS", 20)
    machine = token_counts.Transducer(path)
    for t in ("x" * 70_000, "日本語" * 30_000, " ".join(cases.prose(8, 500))):
        assert machine.count(t) == len(library.encode(t, add_special_tokens=False).ids)


def test_a_pre_token_of_a_megabyte(monkeypatch):
    import random

    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(2)
    text = "".join(r.choices("etaoinshrdlu", k=1 << 20))
    assert bpe.ByteBpe(path, public_tokenizers.PATTERN).encode(text) == library.encode_ordinary(text)


if __name__ == "__main__":
    pytest.main([__file__])


def test_token_counts_start_afresh_within_a_text():
    """A worker with few transitions allowed starts afresh many times in one text, with and without blanks, and counts the same."""
    import random

    from tokenizers import Tokenizer

    path, rnd = public_tokenizers.path("byte_bpe_50k.json"), random.Random(5)
    library, machine = Tokenizer.from_file(path), token_counts.Transducer(path)
    machine.MOST, machine.PIECE, machine.CHUNK = 300, 7, 50
    most = 0
    for _ in range(150):
        text = "".join(rnd.choice(rnd.choice(["ab cde\n\t'sltvre12  .,<|éß漢", "AbCdEf0123+/"])) for _ in range(rnd.choice([5, 40, 200, 900])))
        assert machine.count(text) == len(library.encode(text, add_special_tokens=False).ids)
        most = max(most, machine.transitions)
    assert 300 < most < 500


def test_bpe_remembers_as_many_pre_tokens_as_it_is_told_to():
    path, words = public_tokenizers.path("byte_bpe_50k.tiktoken"), [f" zq{chr(97 + k)}xv" for k in range(15)]
    for remembered, again in ((20, 0), (3, 15)):
        encoder, merged = bpe.ByteBpe(path, public_tokenizers.PATTERN, remembered), []
        merge, encoder.merge = encoder.merge, lambda piece: merged.append(piece) or merge(piece)
        first = encoder.encode("".join(words))
        assert len(merged) == 15 and encoder.encode("".join(words)) == first and len(merged) == 15 + again
    assert bpe.REMEMBERED_ALONE > bpe.ByteBpe.REMEMBERED
