"""What Python workers hold beside an executor's heap."""

import os
import subprocess
import sys

import corpus_pipeline
from voxloom.llm.common import BATCH_BYTES, BATCH_SETTING, SMALL_BATCH

THREADS = """
import os, random
import pyarrow as pa, public_tokenizers
from voxloom.llm import packing
rng = random.Random(3)
texts = pa.array([" ".join("".join(rng.choices("abcdefghij12", k=8)) for _ in range(3000)) for _ in range(4)])
packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json")).parts(texts)
before = len(os.listdir("/proc/self/task"))
packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json")).encode(texts)
print(len(os.listdir("/proc/self/task")) - before)
"""


def test_the_tokenizer_starts_no_threads():
    env = {k: v for k, v in os.environ.items() if k not in ("TOKENIZERS_PARALLELISM", "RAYON_NUM_THREADS")}
    top = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    done = subprocess.run([sys.executable, "-c", THREADS], env=env | {"PYTHONPATH": top}, capture_output=True, text=True, timeout=120)
    assert done.stdout.split()[-1:] == ["0"], done.stderr


def test_late_stages_get_small_batches(spark, docs):
    was = spark.conf.get(BATCH_SETTING)
    try:
        for name in ("secret_scan", "best_fit_packing"):
            spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
            dict(corpus_pipeline.STAGES)[name](spark, docs, "")
            assert int(spark.conf.get(BATCH_SETTING)) <= SMALL_BATCH
    finally:
        spark.conf.set(BATCH_SETTING, was)
