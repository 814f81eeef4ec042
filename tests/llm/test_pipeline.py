"""The pipeline stage by stage against its operators and plain code, and the registered queries against DuckDB."""

import hashlib
import struct

import duckdb
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from logloom.llm import mixing, quality, secret_scan
from logloom.llm.bpe import Codec
from logloom.llm.common import table
from logloom.llm.queries import ORACLE_SQL, QUERIES, RANKS
from tests.llm.test_ops import DOCS, brute_components, docs_of, prose


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_pipeline_by_stages(spark, tiny):
    docs = table(spark, tiny, "documents").where("doc_id < 120").cache()
    steps = [f for _, f in corpus_pipeline.STAGES]
    first = steps[0](spark, docs, tiny).cache()
    assert first.columns == docs.columns
    assert ids(first) == ids(quality.classify(docs, table(spark, tiny, "labels")).where("kept"))
    second = steps[1](spark, first, tiny).cache()
    want = brute_components({r["doc_id"]: r["text"] for r in first.collect()})
    assert ids(second) == sorted(i for i, (_, c) in want.items() if i == c)
    third = steps[2](spark, second, tiny).cache()
    before, after = ({r["doc_id"]: r for r in d.collect()} for d in (second, third))
    assert set(before) == set(after)
    for i, r in after.items():
        spans = secret_scan.scan_texts([before[i]["text"]])[0]
        assert (r["text"] == before[i]["text"]) == (not spans)
        assert not spans or r["n_chars"] == len(r["text"])
    fourth = steps[3](spark, third, tiny).cache()
    assert ids(fourth) == ids(mixing.decide(third).where("kept"))
    last = steps[4](spark, fourth, tiny).collect()
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=Codec.load(RANKS, public_tokenizers.PATTERN).ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in fourth.collect()}
    assert len(last) == len(texts)
    for r in last:
        own = plain.encode_ordinary(texts[r["doc_id"]])
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(own)}I", *own)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_near_duplicate_stage_at_its_threshold(spark, tiny):
    texts = {}
    for n in (44, 45, 46, 50, 57, 61, 70):  # shingles; one word in the middle changed leaves (n - 5) / (n + 5)
        words = [f"w{n}x{i}" for i in range(n + 4)]
        texts[len(texts)] = " ".join(words)
        texts[len(texts)] = " ".join(["changed" if i == 20 else w for i, w in enumerate(words)])
    want = sorted(i for i, (_, c) in brute_components(texts, 80).items() if i == c)
    assert want == [0, 1, 2, 4, 6, 8, 10, 12]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in texts.items()], DOCS)
    assert ids(corpus_pipeline.near_duplicate_stage(spark, docs, tiny)) == want


def test_stages_meet_odd_rows(spark, tiny):
    docs = docs_of(spark, [prose(i, 40) for i in range(6)] + ["token = abcdefghij " + prose(9, 30)])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tiny).count() <= docs.count()
    empty = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, tiny).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries(spark, tiny, name):
    found = QUERIES[name](spark, tiny)
    got = sorted(repr([r[c] for c in sorted(found.columns)]) for r in found.collect())
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "embeddings"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
        cursor = con.execute(ORACLE_SQL[name])
        theirs = [d[0] for d in cursor.description]
        assert got == sorted(repr([dict(zip(theirs, r, strict=True))[c] for c in sorted(theirs)]) for r in cursor.fetchall())
    else:
        table_name, key = ("pages", "page_id") if name.startswith("op8") else ("documents", "doc_id")
        assert found.select(key).exceptAll(table(spark, tiny, table_name).select(key)).count() == 0 and len(got) == table(spark, tiny, table_name).count()
        assert found.where(F.col(key).isNull()).count() == 0
