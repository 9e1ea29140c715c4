from __future__ import annotations

import os

import pytest
from test_exact import LOWER
from test_near import brute as near_brute

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_the_run_equals_its_stages_by_brute_force(spark):
    import base64

    import public_tokenizers as P
    import tiktoken

    import corpus_pipeline
    from scriptloom.llm import quality
    from test_decontam import brute as leak_brute

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality").filter(corpus_pipeline.fold(5) != 0)
    score = quality.fit(docs, labels).scorer()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    left = [r for r, s in zip(rows, score([t for _, t in rows])[0], strict=True) if s >= quality.THRESHOLD]
    last = {}
    for i, t in left:
        k = (t or "").translate(LOWER)
        last[k] = max(last.get(k, i), i)
    left = [r for r in left if r[0] in set(last.values())]
    names = {c for _, c, _ in near_brute(left)}
    left = [r for r in left if r[0] in names]
    held = {k for k, *_ in leak_brute(left, [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()])}
    left = [r for r in left if r[0] not in held]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(corpus_pipeline.VOCABULARY), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == {i: len(library.encode_ordinary(t or "")) for i, t in left}
    assert 0 < len(left) < len(rows)


def tables(spark, folder, docs, labels, items, schema):
    for name, rows, kind in (("documents", docs, schema), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, kind).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


ODD = "doc_id long, text string, lang string, source string, n_chars long, key string, print int, score string"


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    import corpus_pipeline

    prose = "the small house stands by the old river where nine boats lie waiting for the morning tide to carry them away"
    item = "Where do the nine old boats of the quiet river lie when the tide is out?"
    docs = [(1, prose.upper()), (2, prose), (2, prose), (3, prose + " now"), (4, None), (5, ""), (6, "so " + item + " they ask"), (None, "another text of its own that nobody else has written"), (7, "long " * 60_000), (None, None)]
    rows = [(i, t, None, None, None, "k", 1, None) for i, t in docs]
    labels = [(i, 1, 0) for i in range(8)] + [(None, 1, None), (3, None, None)]
    tables(spark, tmp_path, rows, labels, [(1, item), (2, None), (3, "")], ODD)
    got = sorted((str(r.doc_id), r.n_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    # of the prose and its near copy the class of the smallest key that is left; of the empty texts the largest key; the leak is gone
    assert [i for i, _ in got] == ["2", "5", "7", "None"] and [n for i, n in got if i == "5"] == [0]


def test_empty_tables_give_no_rows(spark, tmp_path):
    import corpus_pipeline

    tables(spark, tmp_path, [], [], [], ODD)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() == 0 and got.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    tables(spark, tmp_path, [(1, "some text", None, None, None, None, None, None)], [], [], ODD)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 1
