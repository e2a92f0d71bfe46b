"""Each stage of the pipeline against the operator's own brute force, over its own input."""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import test_benchmark
import test_credentials
import test_neardup
from llm_rows import SMALL

import corpus_pipeline as P
from flowwatch.llm import quality


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()), key=str)


def redact(text):
    base = test_credentials.brute(text, 200)[4]
    out, at = [], 0
    for span in filter(None, base.split(",")):
        start, end = map(int, span.split(":")[1:])
        if start >= at:
            out += [text[at:start], "[secret]"]
        at = max(at, end)
    return "".join(out) + text[at:] if text is not None else None


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = spark.createDataFrame(
        [(None, "no id here but words enough to be kept by all of the stages", "en", None, 3), (90_000, None, None, "s", None), (90_001, "", "en", "s", 0)],
        docs.schema,
    )
    docs = docs.union(extra).union(docs.limit(3))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    for name, stage in P.STAGES[:-1]:
        before = rows(docs)
        after = P.keep(stage(spark, docs, SMALL), f"test-{name}")
        assert after.columns == docs.columns
        got = rows(after)
        if name == "quality":
            kept = {(r.doc_id, r.text) for r in quality.judged(docs).where("quality.kept").collect()}
            want = [r for r in before if r[:2] in kept]
        elif name == "neardup":
            gone = {r[0] for r in test_neardup.brute([r[:2] for r in before]) if not r[3]}
            want = [r for r in before if r[0] not in gone]
        elif name == "benchmark":
            bad = {(r[0], n) for n, r in enumerate(test_benchmark.brute([(k, r[1]) for k, r in enumerate(before)], items, 10)) if r[5]}
            want = [r for k, r in enumerate(before) if k not in {b[0] for b in bad}]
        else:
            want = sorted(((r[0], redact(r[1]), r[2], r[3], len(redact(r[1])) if r[1] is not None else r[4]) for r in before), key=str)
        assert got == want, name
        assert 0 < len(got) <= len(before)
        docs = after
    mixed = P.STAGES[-1][1](spark, docs, SMALL).collect()
    assert len(mixed) == len(got)
    assert {r.doc_id: r.size for r in mixed} == {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in got}


def test_empty(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.collect() == []
        if "text" not in docs.columns:
            break
