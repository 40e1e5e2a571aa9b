"""What the fit of language identification holds in the driver."""

import random
import tracemalloc

import numpy as np
from voxloom.llm.language_id import features, sample_features

SCHEMA = "doc_id long, text string, lang string"


def test_sampled_features_are_no_python_numbers(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=8000)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else "de") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    sample_features(docs, 1)  # imports and code come once
    tracemalloc.start()
    got = sample_features(docs, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * sum(len(f) for _, f, _ in got)
    told = lambda rows: sorted((lang, f.tolist(), n.tolist()) for lang, f, n in rows)
    assert told(got) == told(("en" if i % 2 else "de", *features([t])[1:]) for i, t in enumerate(texts))
    assert all(np.all(np.diff(f) > 0) for _, f, _ in got)
