import os
import random
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from geotide.llm import licenses  # noqa: E402

BSD = ("Redistribution and use in source and binary forms, with or without\n"
       "modification, are permitted provided that the following conditions are met:")
MPL = (" * This Source Code Form is subject to the terms of the Mozilla Public\n"
       " * License, v. 2.0. If a copy of the MPL was not distributed with this file")
CASES = [
    (BSD, "bsd"), (MPL, "mpl-2.0"), ("Licensed\nunder the Apache\nLicense, Version\n2.0", "apache-2.0"),
    ("Licensed under CC BY 4.0.", "cc-by"), ("Licensed under CC BY-SA 4.0.", "cc-by"), ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"),
    ("Released under the Apache License.", ""), ("Released under the MIT License.", "mit"), ("Released under MIT\nLicense.", "mit"),
    ("Licensed under the Apache License, Version 1.0.", ""),
    ("Licensed under a Creative Commons Attribution License.", ""),
    ("This work is licensed under the Mozilla Public License version 3.", ""),
    # the words of a template far apart on one line
    ("redistribution and use " + "x " * 30 + "in source and binary forms " + "y " * 30 + "with or without modification are permitted", ""),
]


def labels(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan_licenses(docs).collect()}


def test_wrapped_headers_and_near_licenses(spark):
    got = labels(spark, [t for t, _ in CASES])
    assert {k: x for k, (x, _) in got.items()} == {k: x for k, (_, x) in enumerate(CASES)}


def test_no_start_is_lost(spark):
    """Headers at every place around the ends of blocks, against all windows."""
    texts = []
    for n in [*range(70, 135), *range(185, 225)]:
        texts += [" ".join(["x"] * n) + f"\n{BSD if n % 2 else MPL}" + " y" * (n % 7)]
    rng = random.Random(1)
    words = sorted({w for _, s in licenses.TEMPLATES for w in s.split()})
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(0, 260))) for _ in range(60)]
    for _, s in licenses.TEMPLATES:
        for _ in range(12):
            t = s.split()
            for _ in range(rng.randint(0, 5)):
                t.insert(rng.randrange(len(t)), rng.choice(["x", *words]))
            for _ in range(rng.randint(0, 3)):
                t.pop(rng.randrange(len(t)))
            texts.append(" ".join(["x"] * rng.randint(0, 230) + t + ["y"] * rng.randint(0, 50)))
    got = labels(spark, texts)
    for k, text in enumerate(texts):
        w, want, score = text.lower().replace(",", " ").replace(".", " ").replace("*", " ").replace(":", " ").split(), set(), 0.0
        for phrase, label in licenses.BASE_PHRASES:
            if f" {phrase} " in f" {' '.join(w)} ":
                want.add(label)
                score = 1.0
        for label, s in licenses.TEMPLATES:
            full = set(s.split())
            own = full & licenses.DISTINGUISHING or full
            for i in range(len(w)):
                window = set(w[i:i + len(s.split()) + licenses.SLACK])
                if own <= window and len(window & full) >= 0.8 * len(full) - 1e-9:
                    want.add(label)
                    score = max(score, len(window & full) / len(full))
        assert got[k] == (",".join(sorted(want)), score), text
