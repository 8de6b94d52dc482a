"""The operators on small tables, with nulls, empty and long texts, ties and repeated rows, against brute force."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folia.llm import bpe, decontaminate, graph, html_text, maxent, minhash, quality, rules, secrets, sharding, substrings


SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    shared = " ".join(word() for _ in range(25))
    rows = []
    for k in range(60):
        words = [word() for _ in range(rng.randint(20, 120))]
        if k % 3 == 0:
            words[5:5] = shared.split()
        rows.append((k, " ".join(words)))
    for k in range(60, 75):  # near and exact copies
        words = rows[k - 60][1].split()
        for _ in range(k % 4):
            words[rng.randrange(len(words))] = word()
        rows.append((k, " ".join(words)))
    rows += [(80, None), (81, ""), (82, " \n\t"), (83, "two words"), (84, "two words"), (85, "x" * 70), (86, "y" + "x" * 70), (87, "ab " * 5000)]
    rng.shuffle(rows)
    return rows + [rows[0], (None, rows[3][1]), (None, None)]


def test_sharding(frame, corpus):
    rows = sharding.shard(frame(corpus), 24).collect()
    assert len(rows) == len(corpus) and {r.law for r in rows} == {"key"}
    slots = {}
    for r in rows:
        assert 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in corpus)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == sizes


def test_jump_hash(spark):
    def jump(key, n):
        key, b, j = key & (1 << 64) - 1, -1, 0
        while j < n:
            b = j
            key = key * 2862933555777941757 + 1 & (1 << 64) - 1
            j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
        return b

    keys = [0, 1, -1, 2**63 - 1, -(2**63)] + [random.Random(k).randrange(-(2**63), 2**63) for k in range(200)]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump_shards(F.col("k"), [1, 24, 25]).alias("s")).collect()
    assert all(r.s == [jump(r.k, n) for n in (1, 24, 25)] for r in got)


def brute_components(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return sets, {i: root(i) for i in sets}


def test_near_duplicates(frame, corpus):
    sets, want = brute_components([r for r in corpus if r[0] is not None], 4, 80)
    rows = minhash.near_duplicates(frame(corpus), size=4).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_near_duplicates_settled_in_units(frame, corpus, monkeypatch):
    """All links come from tiles of large buckets: no leader, no guest and no small bucket finds one."""
    _, want = brute_components([r for r in corpus if r[0] is not None], 4, 80)
    none = lambda pairs, nodes, percent: pairs.filter("false").select(F.col("a").alias("u"), F.col("b").alias("v"))
    monkeypatch.setattr(minhash, "_confirmed", none)
    monkeypatch.setattr(minhash, "FEW", 0)
    for tile in (2, 4096):
        monkeypatch.setattr(minhash, "TILE", tile)
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(corpus), size=4).collect() if r.doc_id is not None}
        assert got == want


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 101), (101, 100), (7, 7)] + [(200, k) for k in range(201, 220)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(31)}, 100: 100, 101: 100, **{k: 200 for k in range(200, 220)}}


def brute_repeats(rows):
    seen, out = set(), {}
    for i, t in sorted(r for r in set(rows) if r[0] is not None):
        b = (t or "").encode()
        own = [b[k : k + 50] for k in range(len(b) - 49)]
        cover = bytearray(len(b))
        for k, w in enumerate(own):
            if w in seen:
                cover[k : k + 50] = b"\1" * 50
        seen.update(own)
        kept = bytes(x for x, c in zip(b, cover) if not c)
        out[i] = (len(b), sum(cover), len([1 for x in bytes(cover).split(b"\0") if x]), hashlib.sha256(kept).hexdigest())
    return out


def test_substrings(frame, corpus, monkeypatch):
    want = brute_repeats([(i, t) for i, t in corpus])
    got = substrings.remove_repeats(frame(corpus), parts=5).collect()
    assert len(got) == len(corpus)
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]


def test_bpe(frame, corpus):
    path, pattern = bpe.public_ranks()
    rows = bpe.decode(bpe.encode(frame(corpus), path, pattern).select("doc_id", "text", "bpe.*"), "ids", path, pattern).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        b = (r.text or "").encode()
        assert bytes(r.decoded) == b and r.decoded_sha256 == hashlib.sha256(b).hexdigest() and r.n_tokens == len(r.ids)


def test_secret_ledger(frame, tmp_path):
    ledger = str(tmp_path / "ledger")
    secret = "my password: hunter2000 ok"
    first = [(1, secret), (2, secret), (3, None), (4, "")]
    rows = {r.doc_id: r.secrets for r in secrets.scan(frame(first), ledger).collect()}
    assert rows[1].n_assign == rows[2].n_assign == 1 and rows[1].spans == "assign:3:23" and rows[3].spans == rows[4].spans == ""
    spark = frame(first).sparkSession
    assert spark.read.parquet(ledger).count() == 2
    again = secrets.scan(frame([*first, (5, "AKIA" + "A" * 20)]), ledger)
    assert {r.doc_id: r.secrets.n_access for r in again.collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1}
    assert spark.read.parquet(ledger).count() == 3
    secrets.scan(frame(first), ledger, version=2).count()
    assert spark.read.parquet(ledger).filter("rules = 2").count() == 2
    clean = again.select("doc_id", secrets.redacted(F.col("text"), F.col("secrets.spans")).alias("t")).collect()
    assert {r.doc_id: r.t for r in clean} == {1: "my [secret] ok", 2: "my [secret] ok", 3: None, 4: "", 5: "[secret]"}


def test_ledger_takes_only_new_texts(spark, tmp_path):
    """Blobs of the ledger are not scanned again, new ones are appended once."""
    docs = spark.createDataFrame([(k, f"token: abcdefgh{k % 7}") for k in range(50)], "doc_id long, text string")
    ledger = str(tmp_path / "ledger")
    first = {r.doc_id: r.secrets for r in secrets.scan(docs, ledger).collect()}
    more = docs.unionByName(spark.createDataFrame([(100, "password = hunter22"), (101, None)], "doc_id long, text string"))
    again = {r.doc_id: r.secrets for r in secrets.scan(more, ledger).collect()}
    assert {k: again[k] for k in first} == first and again[100].n_assign == 1 and again[101].spans == ""
    assert spark.read.parquet(ledger).count() == 7 + 2


def test_quality_rules(spark, frame, corpus):
    rows = rules.judge(frame(corpus)).collect()
    assert len(rows) == len(corpus) and all(not r.kept for r in rows if r.base_failed)
    rng = random.Random(7)
    usual = [(k, " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(3, 8))) for _ in range(90)) + ".") for k in range(300)]
    odd = [(1000, " ".join(f"{t}###" for t in usual[0][1].split()))]
    kept = {r.doc_id: r.kept for r in rules.judge(frame(usual + odd)).collect()}
    assert not kept[1000] and all(kept[k] for k in range(300))
    assert {r.doc_id for r in rules.keep_good(frame(usual + odd)).collect()} == set(range(300))


def test_quality_rules_of_rare_languages(spark):
    rng = random.Random(8)
    usual = [" ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(3, 8))) for _ in range(90)) + "." for _ in range(310)]
    rows = [(k, t, "aa" if k < 300 else "bb", "s") for k, t in enumerate(usual)] + [(1000, " ".join(f"{t}###" for t in usual[0].split()), "bb", "s")]
    got = rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert all(r.distance is not None for r in got) and [r.doc_id for r in got if not r.kept] == [1000]


def test_language_model(frame, corpus):
    rows = maxent.score(frame(corpus)).collect()
    words = lambda t: [*(t or "").encode().lower().split(), b""]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    counts = Counter(w for i, t in corpus if not held(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in corpus:
        own = words(t)
        want[i, held(i), len(own), sum(w in counts for w in own), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(r.score < 0 for r in rows)


def test_language_model_tail(frame, corpus, monkeypatch):
    want = {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in maxent.score(frame(corpus[:30])).collect()}
    monkeypatch.setattr(maxent, "HEAD", 5)
    assert {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in maxent.score(frame(corpus[:30])).collect()} == want


def test_language_model_is_one_of_the_table(frame, corpus):
    """Scores don't depend on how the rows are cut into tasks, and held-out texts gain on the base."""
    rng = random.Random(9)
    follows = {f"v{k}": [f"v{rng.randrange(300)}" for _ in range(3)] for k in range(300)}

    def text():
        words = ["v1"]
        while len(words) < 80:
            words.append(rng.choice(follows[words[-1]]))
        return " ".join(words)

    docs = frame([(k, text()) for k in range(300)])
    one, many = ({r.doc_id: r for r in maxent.score(docs.repartition(n)).collect()} for n in (1, 16))
    assert all(abs(one[k].score - many[k].score) < 1e-3 for k in one)
    held = [r for r in one.values() if r.held_out]
    assert sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held) > 0.3


def test_classifier(spark, frame, corpus):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)] + [(61, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(frame(corpus), labels).collect()
    assert len(rows) == len(corpus) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert {r.score for r in quality.classify(frame(corpus), labels.filter("false")).collect()} == {0.5}


def test_classifier_on_held_out_labels(spark):
    """Area under the curve of the held-out labels of the small tables."""
    if not os.path.isdir(SMALL):
        pytest.skip("no tables here")
    docs, labels = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "labels"))
    rows = quality.classify(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    good, bad = ([r.score for r in rows if r.quality == k] for k in (1, 0))
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad)) > 0.97


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "<p>a&lt;b", "m"), (2, None, "m"), (3, "", "m")], "page_id int, html string, main string")
    assert {r.page_id: (r.main.text, r.main.n_chars) for r in html_text.extract(pages).collect()} == {1: ("a<b", 3), 2: ("", 0), 3: ("", 0)}


def test_decontamination_pieces(spark, frame, corpus):
    items = spark.createDataFrame([(k, t) for k, t in corpus if k in (1, 2, 4, 80, 81)], "item_id long, text string")
    one = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame(corpus), items).collect()}
    pieces = frame(corpus).select("doc_id", F.explode(decontaminate.hits(frame(corpus), items, piece_bytes=300)).alias("h")).select("doc_id", "h.item_id")
    assert {(1, 1), (2, 2), (4, 4), (61, 1), (62, 2)} <= one and {(r.doc_id, r.item_id) for r in pieces.collect()} == one


def test_empty_tables(spark, frame):
    empty = frame([])
    path, pattern = bpe.public_ranks()
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert sharding.shard(empty, 24).count() == minhash.near_duplicates(empty).count() == substrings.remove_repeats(empty).count() == 0
    assert bpe.encode(empty, path, pattern).count() == secrets.scan(empty).count() == rules.judge(empty).count() == 0
    assert maxent.score(empty).count() == quality.classify(empty, labels).count() == 0
    assert decontaminate.leaks(empty, spark.createDataFrame([], "item_id long, text string")).count() == 0
