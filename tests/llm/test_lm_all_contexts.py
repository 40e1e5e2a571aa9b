"""op6 keeps every context: scores over more contexts than one process's tree keeps by default."""

import random

import pytest
from pyspark.sql import functions as F

import one_process_tree
from voxloom.llm import lm_scoring


@pytest.mark.parametrize("shortcut", [0, 500, 1 << 20])
def test_scores_come_from_all_contexts(spark, monkeypatch, shortcut):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz .,0123456789"
    texts = ["".join(rng.choice(letters) for _ in range(1000)) for _ in range(10)] * 2  # contexts that occur twice, too many to keep
    texts += [texts[0][:500] + "".join(rng.choice(letters) for _ in range(50)), "never ~ seen", "", None]
    df = spark.createDataFrame([(i, t, i >= 20) for i, t in enumerate(texts)], "doc_id long, text string, out boolean")
    monkeypatch.setattr(lm_scoring, "SHORTCUT", shortcut)
    got = {r.doc_id: r.score for r in lm_scoring.score(df, F.col("out")).collect()}
    counts = lm_scoring.training_counts(df.filter("not out").select("text")).filter("gram IS NOT NULL").select("gram", "n")
    tree = one_process_tree.grow(counts, 1 << 40)  # test_context_tree_weighting_against_the_recursion holds this against the definition
    assert len(tree.child) // 256 > 3 << 13
    for i, want in enumerate(one_process_tree.code_lengths(tree, lm_scoring.lowered(texts))):
        assert got[i] == pytest.approx(want, rel=1e-4), texts[i]
    capped = one_process_tree.code_lengths(one_process_tree.grow(counts, 3 << 13), lm_scoring.lowered(texts))
    assert any(got[i] != pytest.approx(x, rel=1e-4) for i, x in enumerate(capped))
