import hashlib
import os
import sys
import zlib

import numpy as np
import pytest
from test_bag_minhash import brute_classes
from test_lines_packing import brute_lines

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline as cp  # noqa: E402
from threadlens.llm import decontaminate as dc  # noqa: E402
from threadlens.llm.tokens import BatchEncoder  # noqa: E402

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, matches int, lost string"


def rows_of(df):
    return {r.doc_id: r.text for r in df.collect()}


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before each stage and what the last one returns."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for _, stage in cp.STAGES:
        out.append(docs)
        docs = stage(spark, docs, SMALL)
        docs = cp.materialize(docs, "pipeline-test")
    return [*out, docs]


def test_order_and_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["language ID", "line dedup", "MinHash near-dedup", "benchmark decontamination",
                                         "best-fit packing"]
    assert all(s.columns == stages[0].columns and s.dtypes == stages[0].dtypes for s in stages[:-1])


def test_language_keeps_texts_with_letters(stages):
    before, after = rows_of(stages[0]), rows_of(stages[1])
    assert {d for d, t in before.items() if t and len(t.split()) > 8 and any(c.isalpha() for c in t)} <= set(after)


def test_lines_as_by_brute_force(stages):
    want = {d: kept for d, _, _, kept in brute_lines(list(rows_of(stages[1]).items()))}
    assert rows_of(stages[2]) == want
    assert all(r.n_chars == len(r.text) for r in stages[2].collect() if r.text != rows_of(stages[1])[r.doc_id])


def test_one_of_each_class_stays(stages):
    before = rows_of(stages[2])
    classes = brute_classes(list(before.items()))
    assert set(rows_of(stages[3])) == {d for d in before if classes[d] == d}


def test_contaminated_go(spark, stages):
    items = [dc.normal(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    before, after = rows_of(stages[3]), rows_of(stages[4])
    exact = {d for d, t in before.items() if any(i in dc.normal(t or "") for i in items)}
    assert exact and not exact & set(after) and len(before) - len(after) <= len(exact) + 1


def test_packed_ids_are_those_of_the_documents(stages):
    encoder = BatchEncoder(cp.TOKENIZER)
    pieces = stages[5].toPandas()
    assert set(pieces.doc_id) == set(rows_of(stages[4]))
    for doc, text in list(rows_of(stages[4]).items())[:40]:
        ids = np.append(encoder.encode(text or ""), 0).astype("<u4")
        own = pieces[pieces.doc_id == doc].sort_values("piece")
        assert own.length.sum() == len(ids)
        for p in own.itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[p.start:p.start + p.length].tobytes())
    assert pieces.groupby("sequence_id").length.sum().max() <= 2048


def test_run_gives_what_the_stages_give(spark, stages):
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    a, b = (hashlib.sha256(df.select(key).orderBy(key).toPandas().to_csv().encode()).hexdigest()
            for df in (cp.run(spark, SMALL), stages[5]))
    assert a == b


def test_odd_rows_in_every_stage(spark):
    rows = [(None, "Some words that stay here, of a text without an id.", None, None, None, None, None, None),
            (1, None, "en", "a", 0, "s", 1, "g"), (2, "", "en", "a", 0, "s", 1, "g"), (3, "12 34", "de", "a", 5, "s", 1, "g"),
            (4, "the of and a text " * 9000, "en", "a", 1, "s", 1, "g"), (5, "the of and a text", "en", "a", 1, "s", 1, "g"),
            (5, "the of and a text", "en", "a", 1, "s", 1, "g")]
    for _, stage in cp.STAGES:
        df = spark.createDataFrame(rows, SCHEMA)
        out = stage(spark, df, SMALL)
        assert stage is cp.STAGES[-1][1] or out.columns == df.columns
        assert out.count() > 0
        assert stage(spark, df.limit(0), SMALL).count() == 0
