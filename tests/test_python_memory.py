"""What Python workers hold: keyword_search has none, an index takes texts in small parts, and a kept text goes to the language model once."""

import pyarrow as pa

from cairn.llm import language_id
from cairn.operators import postings as P
from cairn.plans import search
from tests.test_oracles import DATA


def test_keyword_search_needs_no_python(spark):
    plan = search.keyword_search(spark, DATA)._jdf.queryExecution().toString()
    assert "mapinarrow" not in plan.lower()


def test_terms_come_in_small_parts():
    b = pa.RecordBatch.from_pydict({"id": list(range(1000)), "text": ["a b a"] * 1000})
    out = list(P._forward(iter([b])))
    assert max(x.num_rows for x in out) <= P.ROWS < 1000 and sum(x.num_rows for x in out) == 1000


def test_a_kept_text_goes_once(spark):
    rows = spark.createDataFrame([(1, "the end"), (2, None)], "doc_id long, text string")
    out = language_id.predict(rows, None, ["doc_id", "text"])
    assert "__text" not in out._jdf.queryExecution().toString()
    assert sorted(tuple(r) for r in out.collect()) == [(1, "the end", "und", 0.0), (2, None, "und", 0.0)]
