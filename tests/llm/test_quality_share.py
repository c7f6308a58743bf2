import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from geotide.llm import quality  # noqa: E402


def host(times):
    """A host of 40 documents, repeated with fresh bodies: a line in 15 % of them and one in 2.5 %."""
    rows = []
    for k in range(40 * times):
        body = " ".join(f"b{k}x{j}" for j in range(15))
        top = "share this page now\n" if k % 40 < 6 else "a rare line here\n" if k % 40 == 6 else ""
        rows.append((k, top + body, "a"))
    return rows


def test_size_of_the_host_leaves_the_verdict_unchanged(spark):
    for times in (1, 10, 60):
        docs = spark.createDataFrame(host(times), "doc_id long, text string, source string")
        gone = {r["doc_id"]: r["n_removed_words"] for r in quality.quality(docs).collect()}
        assert gone == {k: 4 if k % 40 < 6 else 0 for k in range(40 * times)}, times


def test_a_handful_of_documents_loses_no_line(spark):
    docs = spark.createDataFrame(host(1)[:3], "doc_id long, text string, source string")
    assert {r["n_removed_words"] for r in quality.quality(docs).collect()} == {0}
