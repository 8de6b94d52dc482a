"""The pipeline on a small table, against brute force, with nulls, copies, repeated rows, long texts and clashing names."""

import base64
import hashlib
import random

import corpus_pipeline
import pytest

from folia.llm import bpe, secrets


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    text = lambda n: " ".join(word() for _ in range(n)) + "."
    good = {k: text(rng.randint(60, 120)) for k in range(300)}
    items = [(1, text(30) + "? " + text(8)), (2, None), (3, text(25))]
    good[10] += " password: hunter2000x " + text(5)
    good[11] += " " + items[0][1]
    good[12] = text(20) + " " + items[2][1].upper() + " " + text(40)
    near = good[20].split()
    near[40] = "changed"
    rows = [(k, t) for k, t in good.items()]
    rows += [(400, None), (401, ""), (402, "too short"), (403, good[30]), (404, " ".join(near)), (405, text(30000)), (406, text(9) * 30)]
    rows += [(407, " ".join(f"{w}##" for w in good[0].split())), rows[50], (None, text(80))]
    rng.shuffle(rows)
    folder = tmp_path_factory.mktemp("tables")
    extra = "secrets string, n_tokens int, bpe string, _blob string, _row string"
    columns = "doc_id long, text string, lang string, source string, n_chars long, " + extra
    table = [(i, t, "xx", "s", None if t is None else len(t), "a", 1, "b", "c", "d") for i, t in rows]
    spark.createDataFrame(table, columns).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], columns).write.parquet(f"{folder}/none/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/none/benchmark.parquet")
    return str(folder), rows


def test_pipeline(spark, made):
    import tiktoken

    folder, rows = made
    got = corpus_pipeline.run(spark, folder).collect()
    gone = {400, 401, 402, 406, 407, 403, 404, 11, 12}
    want = [(i, t) for i, t in rows if i not in gone]
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in want)
    path, pattern = bpe.public_ranks()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = dict(want)
    for r in got:
        text = texts[r.doc_id]
        for a, b, _ in reversed(secrets.find(text)):
            text = text[:a] + secrets.MARK + text[b:]
        assert r.text == text and r.n_chars == len(text) and (text != texts[r.doc_id]) == (r.doc_id == 10)
        assert r.ids == library.encode_ordinary(text) and r._n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.secrets, r.n_tokens, r.bpe, r._blob, r._row) == ("a", 1, "b", "c", "d")


def test_pipeline_of_an_empty_table(spark, made):
    rows = corpus_pipeline.run(spark, made[0] + "/none")
    assert rows.count() == 0 and rows.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_keep_the_columns(spark, made):
    docs = spark.read.parquet(f"{made[0]}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, made[0]).columns == docs.columns
