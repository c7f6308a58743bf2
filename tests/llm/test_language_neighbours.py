import os
import sys

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from geotide.llm import language  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_a_word_scores_the_same_beside_any_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs)
    texts = [r["text"] for r in docs.collect()]
    words = sorted({w for t in texts for w in t.split() if len(w) < 9 and w.isalpha()})[:200]

    def scores(some):
        data = [t.encode() for t in some]
        at = np.concatenate([[0], np.cumsum([len(d) for d in data])])
        return list(zip(*language.score_chunk(model, np.frombuffer(b"".join(data), np.uint8), at)))

    for k, word in enumerate(words):
        alone = scores([word])[0]
        near = scores([texts[k % len(texts)], word, "", words[-k - 1], word])
        assert near[1] == alone and near[4] == alone, word


def test_counts_do_not_cross_document_ends(spark):
    schema = "text string, lang string"
    both = language.train(spark.createDataFrame([("abcd", "x"), ("efgh", "y")], schema).coalesce(1))
    apart = language.train(spark.createDataFrame([("abcd", "x"), ("", "x"), ("efgh", "y"), ("", "y")], schema).repartition(4))
    assert (both.logs == apart.logs).all()
