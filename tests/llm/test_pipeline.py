"""The corpus pipeline against what brute force says of a small corpus."""

import hashlib

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from lurelens.llm import bpe

from .test_llm import brute_classes


def test_pipeline(spark, tmp_path):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    item = " ".join(word() for _ in range(14))
    good = [" ".join(word() for _ in range(60)) + "." for _ in range(40)]
    copies = [good[0], good[1].upper().lower(), good[2].replace(good[2].split()[5], "changed")]
    leaks = [good[3] + " " + item, "Start " + item.upper() + " end"]
    bad = ["!! ".join(word().upper() for _ in range(60)) for _ in range(40)]
    texts = good + copies + leaks + bad
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 45), 0) for i in range(len(texts))], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = [i for i, t in enumerate(texts) if not t.isupper() and "!!" not in t]
    classes = brute_classes([texts[i] for i in kept])
    kept = [i for k, i in enumerate(kept) if classes[k] == k]
    kept = [i for i in kept if item not in texts[i].lower()]
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    found = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert found == {i: encoding.encode_ordinary(texts[i]) for i in kept}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_stages_decide_by_row(spark, tmp_path):
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    item = " ".join(word() for _ in range(14))
    good = [" ".join(word() for _ in range(60)) + "." for _ in range(46)]
    bad = ["!! ".join(word().upper() for _ in range(60)) for _ in range(46)]
    spark.createDataFrame([(i, int(i < 40)) for i in range(80)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    (_, judge), (_, dedup), (_, decontaminate) = corpus_pipeline.STAGES[:3]

    def left(stage, rows):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
        return sorted((tuple(r) for r in stage(spark, docs, str(tmp_path)).collect()), key=str)

    trained = list(enumerate(good[:40] + bad[:40]))
    odd = [(None, good[40]), (None, bad[40]), (90, good[41]), (90, bad[41]), (None, good[40])]
    assert left(judge, trained + odd) == sorted(trained[:40] + [odd[0], odd[2], odd[4]], key=str)
    near = good[0].replace(good[0].split()[5], "changed")
    rows = [(5, good[0]), (5, good[0]), (None, good[0]), (3, near), (None, good[1]), (None, good[1]), (7, good[2]), (7, good[3]), (8, None)]
    assert left(dedup, rows) == sorted([(3, near), (None, good[1]), (7, good[2]), (7, good[3]), (8, None)], key=str)
    rows = [(1, good[0] + " " + item), (1, good[0]), (None, item), (None, good[1]), (2, good[2]), (2, good[2])]
    assert left(decontaminate, rows) == sorted([rows[1], rows[3], rows[4], rows[5]], key=str)


def test_last_stage_decodes(spark, tmp_path):
    texts = ["Hello world", "zażółć 日本 ½\n", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: r["decoded_sha256"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()}
    assert found == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(texts)}
