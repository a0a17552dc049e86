"""Table functions in SQL give the rows of the DataFrame functions, and hand-made rows."""

import pytest
from pyspark.sql import functions as F

from cairn.functions import tables
from cairn.functions import texts as X
from cairn.plans import text as P
from cairn.sources import tables as S

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def registered(spark):
    tables.register(spark)


def test_chunks_from_sql_are_those_of_the_query(spark):
    S.sources(spark, SF).select("id", F.concat(F.lit("# "), "type", F.lit("\n"), "text").alias("text")).createOrReplaceTempView("headed")
    got = spark.sql("select h.id, c.* from headed h, lateral chunk_text(h.text) c").collect()
    want = P.chunk_documents(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 200


def test_chunks_by_hand(spark):
    text = "intro line\n# One\nalpha beta gamma\n## Two\ndelta\n# Three\nend"
    spark.createDataFrame([("a", text), ("b", None), ("c", "")], "id string, text string").createOrReplaceTempView("made")
    got = sorted(map(tuple, spark.sql("select m.id, c.* from made m, lateral chunk_text(m.text, 40, 5) c").collect()))
    assert got == [("a", 0, 0, 11, ""), ("a", 1, 11, 34, "One"), ("a", 2, 34, 47, "One > Two"), ("a", 3, 47, 58, "Three")]
    assert all(text.encode()[x[2] : x[3]] for x in got) and b"".join(text.encode()[x[2] : x[3]] for x in got) == text.encode()


def test_sensitive_spans(spark):
    text = "mail a@b.org, 4111 1111 1111 1111 or 4111 1111 1111 1112, token=abc"
    spark.createDataFrame([("a", text), ("b", None)], "id string, text string").createOrReplaceTempView("told")
    got = sorted(map(tuple, spark.sql("select s.* from told t, lateral sensitive_spans(t.text) s").collect()), key=lambda x: x[1])
    assert got == [("EMAIL", 5, 12, "a@b.org"), ("CARD", 14, 33, "4111 1111 1111 1111"), ("SECRET", 58, 67, "token=abc")]
    assert X.redact(text) == "mail [EMAIL_1], [CARD_1] or 4111 1111 1111 1112, [SECRET_1]"
