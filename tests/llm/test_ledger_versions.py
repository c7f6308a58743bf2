import os
import sys
from dataclasses import replace

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from geotide.llm import secrets  # noqa: E402


def test_spans_of_a_superseded_rule_leave_a_kept_ledger(spark):
    docs = spark.createDataFrame([(1, "ACME1234 ACME12345678"), (2, "nothing")], "doc_id long, text string")
    one = (secrets.Rule("acme", 1, "ACME[0-9]{4,}"),)
    two = (replace(one[0], version=2, pattern="ACME[0-9]{8,}"),)
    ledger = secrets.BlobLedger(spark)

    def found(rules):
        got = ledger.findings(docs, rules=rules).collect()
        return {r["doc_id"]: [(s["start"], s["end"], s["kind"]) for s in r["spans"]] for r in got}

    ledger.scan(docs, rules=one)
    before = {1: [(0, 8, "acme"), (9, 21, "acme")], 2: []}
    assert found(one) == before
    ledger.scan(docs, rules=two)
    assert found(two) == {1: [(9, 21, "acme")], 2: []}
    assert found(one) == before
    assert ledger.unseen(docs, "text", two).count() == 0
