"""Operators that look at the whole corpus, against brute force, SQL and held-out rows."""

import zlib
from collections import Counter, defaultdict
from math import log10

import cases
import numpy as np
import oracle
import pytest

from claimloom.llm import language_model, near_dedup, resample, url_filter, warc


def test_near_duplicates_are_those_of_all_pairs(spark, small):
    def brute(known, percent=85):
        sets = {}
        for i, t in known:
            w = (t or "").encode().lower().split()
            sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        parent = {i: i for i in sets}

        def top(i):
            while parent[i] != i:
                i = parent[i]
            return i

        ids = sorted(i for i in sets if sets[i])
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                if min(len(sets[a]), len(sets[b])) * 100 >= max(len(sets[a]), len(sets[b])) * percent and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    x, y = sorted((top(a), top(b)))
                    parent[y] = x
        return {i: (len(s), top(i), top(i) == i) for i, s in sets.items()}

    chain = [(i, " ".join(cases.prose(9, 300)[i : i + 200])) for i in range(100, 160, 4)]  # neighbours are close, ends are not
    apart = [(1000 + i, " ".join(w if k % 24 or k < 3 * i else f"v{i}-{k}" for k, w in enumerate(cases.prose(5, 240)))) for i in range(60)]
    own = [(i, t) for i, t in cases.texts() if i is not None] + chain + apart
    mine = spark.createDataFrame([(*x, "clash") for x in own], "doc_id long, text string, id string")
    for docs, known in ((mine, own), (spark.read.parquet(f"{small}/documents.parquet"), cases.pairs(small))):
        want = brute(known)
        got = near_dedup.components(docs).collect()
        assert len(got) == len(known)
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want
        kept = near_dedup.keep_documents(docs)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, w in want.items() if w[2]}
    assert {r.doc_id: r.kept for r in near_dedup.components(cases.documents(spark)).collect()}[None] is False
    assert near_dedup.components(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("size", [1, 2, 50, 3000])
def test_sketches_estimate_similarity(size):
    rng = np.random.default_rng(size)
    a = np.unique(rng.integers(0, 1 << 62, size * 2).astype(np.uint64))
    b = a[size // 2 :]
    got = np.mean(near_dedup.sketch(a) == near_dedup.sketch(b))
    assert abs(got - len(b) / len(a)) < 0.2
    assert (near_dedup.sketch(a) < np.iinfo(np.uint64).max).all()


def test_resampling_is_a_sort_by_noisy_weights(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    known = cases.pairs(small)
    good = {r.doc_id for r in labels.collect() if r.quality}
    codes, sums = resample.TokenCodes(), np.zeros((2, resample.BUCKETS))
    found = {i: resample.features((t or "").encode(), codes) for i, t in known}
    for i, f in found.items():
        np.add.at(sums[0], f, 1)
        if i in good:
            np.add.at(sums[1], f, 1)
    raw = (sums[0] + 1) / (sums[0].sum() + resample.BUCKETS)
    ratio = np.log((sums[1] + raw * resample.BUCKETS) / (sums[1].sum() + resample.BUCKETS)) - np.log(raw)
    got = {r.doc_id: r for r in resample.score(docs, labels).collect()}
    keys = {i: ratio[f].sum() + resample.noise(i, resample.SEED) for i, f in found.items()}
    assert all(abs(got[i].gumbel_key - k) < 1e-6 for i, k in keys.items())
    n = sum(r.kept for r in got.values())
    assert {i for i, r in got.items() if r.kept} == set(sorted(keys, key=keys.get, reverse=True)[:n])
    kept = resample.keep_documents(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_resampling_keeps_good_documents(spark):
    folder = "/root/testdata/sf0.01"
    got = resample.op1_importance_resampling(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("kept", "quality").collect()
    assert sum(r.kept for r in got if r.quality) >= 0.95 * sum(r.quality for r in got) and sum(not r.kept for r in got if not r.quality) >= 0.8 * sum(1 - r.quality for r in got)
    docs, none = cases.documents(spark), spark.createDataFrame([], "doc_id long, quality int")
    assert resample.score(docs, none).where("kept").count() == docs.count()
    labels = spark.createDataFrame([(6, 1), (2, 0), (None, 1), (7, None)], "doc_id long, quality int")
    assert resample.score(docs, labels).count() == docs.count() and resample.keep_documents(docs, labels).columns == docs.columns
    assert resample.score(cases.empty(spark), labels).count() == 0


def test_kth_largest(spark):
    values = [5, -3, 1 << 40, 5, -(1 << 60), 0]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert [resample.kth_largest(df, "v", k) for k in range(8)] == [None, *sorted(values, reverse=True), None]


def test_language_model(spark, small, monkeypatch):
    known = cases.pairs(small)
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in known}
    tokens = {i: [*(t or "").encode().lower().split(), b""] for i, t in known}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    total, kinds = counts.total(), len(counts)
    for hot in (language_model.HOT, 50):  # with nearly all counts broadcast, and with nearly all joined
        monkeypatch.setattr(language_model, "HOT", hot)
        got = {r.doc_id: r for r in language_model.op2_context_mixing(spark, small).collect()}
        for i, ws in tokens.items():
            r = got[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(w in counts for w in ws), total)
            assert abs(r.base_score - sum(log10((counts[w] + 1) / (total + kinds + 1)) for w in ws)) < 1e-6 * len(ws)


def test_language_model_beats_word_counts_on_held_out_texts(spark):
    r = language_model.op2_context_mixing(spark, "/root/testdata/sf0.1").where("held_out").selectExpr("sum(score) as model", "sum(base_score) as base").first()
    assert r.model > r.base


def test_host_reputation(spark, small):
    con = oracle.connect(small)
    assert oracle.difference(url_filter.op3_host_reputation(spark, small), con, url_filter.ORACLE_SQL) is None
    cases_ = [
        (1, None, "", "", None), (2, "no scheme", "", "", None), (3, "HTTP://A.ORG?x#y", "a.org", "", None), (4, "http://A.Org/x/y?z", "a.org", "/x/y", "org/"), (5, "http://b.example.org/es/q", "b.example.org", "/es/q", "example.org/es/"),
        (6, "http://badexample.org/es/q", "badexample.org", "/es/q", "org/"), (7, "http://example.org/en/1x", "example.org", "/en/1x", "example.org/en/1"), (8, "x://c.com/de/", "c.com", "/de/", "com/de/"), (9, "x://c.com/fr", "c.com", "/fr", None), (9, "x://c.com/fr", "c.com", "/fr", None),
    ]
    pages = spark.createDataFrame([(a, b) for a, b, *_ in cases_], "page_id long, url string")
    outcomes = spark.createDataFrame([(9, 0)] * 40 + [(1, 1)] * 40 + [(77, 1), (None, 0), (2, None)], "page_id long, good int")
    got = sorted((r.page_id, r.host, r.path, r.rule) for r in url_filter.judge(pages, outcomes).collect())
    assert got == sorted((a, c, d, e) for a, _, c, d, e in cases_)
    verdict = {r.page_id: r.verdict for r in url_filter.judge(pages, outcomes).collect()}
    assert verdict[9] == "block" and verdict[1] == "allow" and verdict[5] == "block" and verdict[8] == "block" and verdict[4] == "allow"
    assert {r.verdict for r in url_filter.judge(pages, outcomes.limit(0)).where("rule is null").collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), outcomes).count() == 0


def test_archives(spark, small, tmp_path):
    con = oracle.connect(small)
    assert oracle.difference(warc.op7_warc_shards(spark, small), con, warc.ORACLE_SQL) is None
    page = "<p>" + "x" * 200
    rows = [(5, "u", page, 1), (3, None, page, 1), (9, "u v\n", page, 1), (9, "u", page, 1), (1, "u", None, 1), (2, "u", "", 1), (4, "u", "short", 1), (6, "u", "short", 1), (7, "u", "ü" * 70, 1), (8, "u", "é" * 20_000, 1), (None, "u", "t", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, shard int")
    bytes_of = []
    for name, n in (("a", 1), ("b", 5)):
        warc.write(pages.repartition(n), f"file://{tmp_path}/{name}", file_bytes=300, shard_bytes=2000)
        bytes_of.append({p.name: p.read_bytes() for p in sorted((tmp_path / name).glob("*.gz"))})
    assert bytes_of[0] == bytes_of[1] and len(bytes_of[0]) > 3
    read = warc.read(spark, f"file://{tmp_path}/a")
    assert sorted(((r.page_id, r.payload.decode()) for r in read.where("record_type = 'response'").collect()), key=repr) == sorted(((a, c or "") for a, _, c, _ in rows if not (c == page and a != 3)), key=repr)
    assert sorted((r.page_id, r.refers_to, r.payload_bytes) for r in warc.resolved(read).where("record_type = 'revisit'").collect()) == [(5, 3, 203), (9, 3, 203), (9, 3, 203)]
    warc.write(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.read(spark, f"file://{tmp_path}/none").count() == 0


def test_pipeline(spark, small):
    import corpus_pipeline as cp

    from claimloom.llm import bpe, decontaminate, repetition

    assert [name for name, _ in cp.STAGES] == ["quality_rules", "quality_classifier", "near_duplicates", "decontamination", "tokenization"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want, columns = docs, docs.columns
    for (name, stage), left in zip(cp.STAGES[:-1], (
        lambda d: repetition.score(d).where("kept"), lambda d: resample.score(d, spark.read.parquet(f"{small}/labels.parquet")).where("kept"), lambda d: near_dedup.components(d).where("kept"),
        lambda d: decontaminate.score(d, spark.read.parquet(f"{small}/benchmark.parquet")).where("not contaminated"),
    )):
        got = stage(spark, want, small)
        assert got.columns == columns
        assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(r.doc_id for r in left(want).select("doc_id").collect()), name
        want = got.cache()
    got = {r.doc_id: r.decoded_sha256 for r in cp.run(spark, small).collect()}
    import hashlib

    assert got == {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in want.collect()} and got
    with pytest.raises(AttributeError):
        bpe.no_such_name


def test_ids_may_be_text_and_near_copies_of_a_hub_are_all_linked(spark):
    base = cases.prose(11, 150)
    rows = [("b", " ".join(base))]
    for k in range(120):  # from one changed word to twenty, some of them the same in many copies
        words = list(base)
        for j in range(k // 6 + 1):
            words[(j * 7 + k) % 150] = f"same{j % 5}" if k % 2 else f"x{k}-{j}"
        rows.append((f"c{k:03}", " ".join(words)))
    got = {r.doc_id: r.component_id for r in near_dedup.components(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    want = {i: i for i in sets}
    for _ in sets:
        before = dict(want)
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    want[a] = min(want[a], want[b])
        if want == before:
            break
    assert got == want and len(set(want.values())) > 3


def test_importance_weights_are_those_of_counters(spark, small):
    """Features, models, weights, the cut and k, each from the docstring's rules and none from the operator's code."""
    import re

    import xxhash

    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))

    def shape(token):
        if token[0].isalnum() or token[0] == "_":
            kind = 1 if token.isdigit() else 2 if token.islower() else 3 if token.istitle() else 4 if token.isupper() else 5
            return kind * 4 + min(3, len(token) // 4)
        return 24 + xxhash.xxh32_intdigest(token) % 232

    def bag(text):
        tokens = re.findall(r"\w+|[^\w\s]+", text or "")
        word = [xxhash.xxh32_intdigest(t.lower()) for t in tokens]
        form = [0 if i and word[i] == word[i - 1] else shape(t) for i, t in enumerate(tokens)]
        raw = word + [a * 0x9E3779B1 + b + (1 << 40) for a, b in zip(word, word[1:])] + [(a << 16 | b << 8 | c) + (1 << 50) for a, b, c in zip(form, form[1:], form[2:])]
        return Counter((x * 0x9E3779B97F4A7C15) % (1 << 64) >> 48 for x in raw)

    bags = {i: bag(t) for i, t in cases.pairs(small)}
    label = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    raw, target = Counter(), Counter()
    for i, b in bags.items():
        raw.update(b)
        if label.get(i, 0) > 0:
            target.update(b)
    n_raw, n_target, buckets = raw.total() + (1 << 16), target.total() + (1 << 16), 1 << 16
    p = lambda f: (raw[f] + 1) / n_raw
    weight = {i: sum(k * (np.log((target[f] + p(f) * buckets) / n_target) - np.log(p(f))) for f, k in b.items()) for i, b in bags.items()}
    judged = sorted((weight[i], y > 0) for i, y in label.items() if i in weight)
    good, bad = sum(y for _, y in judged), sum(not y for _, y in judged)
    cuts = [judged[0][0] - 1, *((a[0] + b[0]) / 2 for a, b in zip(judged, judged[1:])), judged[-1][0] + 1]
    worth = lambda c: sum(y for w, y in judged if w >= c) / good + sum(not y for w, y in judged if w < c) / bad
    best = max(worth(c) for c in cuts)
    got = {r.doc_id: r for r in resample.score(docs, labels).collect()}
    assert all(abs(got[i].log_weight - w) < 1e-6 * max(1, abs(w)) for i, w in weight.items())
    kept = sum(r.kept for r in got.values())
    assert kept in {sum(w >= c for w in weight.values()) for c in cuts if worth(c) > best - 1e-9}
    assert {i for i, r in got.items() if r.kept} == set(sorted(got, key=lambda i: -got[i].gumbel_key)[:kept])


def test_hosts_that_are_credibly_worse_are_blocked_and_hot_ones_are_dealt_evenly(spark):
    rows = [(i, f"http://{'hot' if i % 3 == 0 else f'h{i % 40}'}.{'bad' if i % 40 < 4 else 'good'}.net/x{i}") for i in range(2000)]
    pages = spark.createDataFrame([(a, b, "clash", "clash") for a, b in rows], "page_id long, url string, host string, bound string")
    outcomes = spark.createDataFrame([(i, int(i % 40 >= 4 or i % 9 == 0), "clash") for i in range(0, 2000, 2)], "page_id long, good int, host string")
    got = {r.page_id: r for r in url_filter.judge(pages, outcomes).collect()}
    assert len(got) == 2000 and {r.verdict for i, r in got.items() if ".bad." in rows[i][1]} == {"block"} and {r.verdict for i, r in got.items() if ".good." in rows[i][1]} == {"allow"}
    assert {r.verdict for r in url_filter.judge(pages, outcomes.withColumn("good", outcomes.good * 0 + 1)).collect()} == {"allow"}


def test_shards_are_even_whatever_the_ids(spark, tmp_path):
    rows = [(k, "u", f"{k} " * 60) for k in range(300)] + [(10**15, "u", "far")] + [(77, "u", f"same id {k} " * 30) for k in range(150)] + [(None, "u", f"no id {k} " * 30) for k in range(150)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write(pages, f"file://{tmp_path}/a", shard_bytes=20_000)
    names = sorted(p.name for p in (tmp_path / "a").glob("*.gz"))
    sizes = Counter()
    for p in (tmp_path / "a").glob("*.gz"):
        sizes[p.name[:11]] += sum(len(body) + warc.RECORD_BYTES for _, body in warc.records_of(p.read_bytes()))
    assert len(names) > 10 and max(sizes.values()) < 50_000
    read = warc.read(spark, f"file://{tmp_path}/a").collect()
    assert sorted(((r.page_id, r.payload.decode()) for r in read), key=repr) == sorted(((a, c) for a, _, c in rows), key=repr)
    assert all(r.payload_digest == r.header_digest for r in read)


def test_shards_roll_by_compressed_size(spark, tmp_path):
    """Files and shards in the proportion of the defaults, on text that compresses little."""
    import random

    rng, scale = random.Random(5), 1024
    rows = [(k, "u", "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=2000))) for k in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    assert warc.SHARD_BYTES >= 4 * warc.FILE_BYTES
    warc.write(pages, f"file://{tmp_path}/a", file_bytes=warc.FILE_BYTES // scale, shard_bytes=warc.SHARD_BYTES // scale)
    files = {p.name: p.stat().st_size for p in (tmp_path / "a").glob("*.gz")}
    shards = Counter(name[:11] for name in files)
    assert len(shards) > 2 and sorted(shards.values())[len(shards) // 2] >= 2 and max(files.values()) <= warc.FILE_BYTES // scale
    # a file is closed only when the next record does not fit
    assert all(size > warc.FILE_BYTES // scale - 4096 for name, size in files.items() if f"{name[:12]}{int(name[12:16]) + 1:04d}{name[16:]}" in files)
    read = warc.read(spark, f"file://{tmp_path}/a").collect()
    assert sorted((r.page_id, r.payload.decode()) for r in read) == sorted((a, c) for a, _, c in rows)


def test_pipeline_stages_at_the_edges(spark, small):
    import corpus_pipeline as cp

    docs = cases.documents(spark).selectExpr("*", "n as n_chars", "h as verdict_0", "h as Verdict_1")
    for docs_ in (docs, docs.limit(0)):
        for name, stage in cp.STAGES[:-1]:
            got = stage(spark, docs_, small)
            assert got.columns == docs_.columns and got.count() <= docs_.count(), name
        assert cp.STAGES[-1][1](spark, docs_, small).count() == docs_.count()
    kept = {name: [r.doc_id for r in stage(spark, docs, small).collect()] for name, stage in cp.STAGES[:-1]}
    assert not {1, 2, 3, 4, 15} & set(kept["quality_rules"])  # null, empty, blank and short texts fail the base rule
    assert {1, 2, 3, 4, 6} <= set(kept["near_duplicates"]) and not {5, 7, None} & set(kept["near_duplicates"])  # 5 twice says what 4 says
    assert {1, 2, 3} <= set(kept["decontamination"])


def test_bounds_of_shards_come_from_distinct_keys_and_have_a_limit(spark, tmp_path, monkeypatch):
    rows = [(None, "u", "all the same " * 20)] * 500 + [(k, "u", f"{k} " * 60) for k in range(1000)]
    small = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(f"coalesce(page_id, {warc.NO_ID}) as page_id", "sha2(html, 256) as digest", "cast(length(html) as long) as size")
    bounds = warc.shard_bounds(small, 20_000)
    assert 20 < len(bounds) < 100 and bounds == sorted(set(bounds))
    monkeypatch.setattr(warc, "MOST_SHARDS", 5)
    assert 2 <= len(warc.shard_bounds(small, 20_000)) <= 8
