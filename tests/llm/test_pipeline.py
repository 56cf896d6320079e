"""The pipeline's stages one after the other, each against what it must do to its own input."""

import re
import sys
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parent)]
from test_documents import shingle_set  # noqa: E402

import corpus_pipeline  # noqa: E402
from chatlens.llm.common import table  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, None
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = {r["doc_id"]: r for r in docs.collect()}
        after = table(stage(spark, docs, SF), f"test-{name}")
        if number < 4:
            assert after.columns == columns and after.schema.simpleString() == docs.schema.simpleString()
        found = after.collect()
        if name == "language_id":
            assert len(found) == len(rows)
        elif name == "line_dedup":
            lines = [line.strip() for r in found for line in (r["text"] or "").split("\n") if line.strip()]
            assert len(lines) == len(set(lines))
            before = {line.strip() for r in rows.values() for line in r["text"].split("\n")}
            assert set(lines) <= before
        elif name == "ngram_jaccard_join":
            sets = [shingle_set(r["text"]) for r in found]
            for i, x in enumerate(sets):
                assert not any(x and y and 100 * len(x & y) >= 75 * len(x | y) for y in sets[:i])
        elif name == "mixing":
            assert {r["doc_id"] for r in found} <= set(rows)
            words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in found)
            have = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in rows.values())
            assert abs(words - 1.5 * have) <= 20
        else:
            assert {r["doc_id"] for r in found} == set(rows)
        docs = after
    assert corpus_pipeline.run(spark, SF).columns == docs.columns
