"""Byte-level BPE against the tiktoken library: rows with every awkward case, all code points, long words, small dictionaries."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from voxloom.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, ids string, words string, known string"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(PATH), special_tokens={})


def wanted(library, rows):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for doc, text in rows:
        ids = library.encode_ordinary(text or "")
        yield doc, len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha((text or "").encode()), ids


@pytest.fixture(scope="module")
def texts(rows):
    rng = random.Random(4)
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    out = [(i, t) for i, t, _ in rows]
    out += [(2000 + i, "".join(every[i : i + 4096])) for i in range(0, 0x32000, 4096)]
    out += [(5000 + i, "".join(f"a{c} {c}1" for c in every[i : i + 997])) for i in range(0, 0x20000, 997)]
    letters = "the and ä ñ 漢字かな ß é 0123456789'!?.\n\t\u0085  \x1c\x00abcdefgh"
    out += [(9000 + i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    out += [(9500, "x" * 5000), (9501, "".join(rng.choice("abcdefghijklmnop") for _ in range(3000))), (9502, " " * 3000 + "a" + "\n" * 200), (9503, "漢字" * 400), (9504, "don't we're I'LL x's's")]
    return out


def test_every_code_point_alone(spark, library):
    """Each with a letter, a space and a digit beside it: the usual pattern and the one for new characters."""
    rows = [(i, f"a{chr(i)} {chr(i)}1") for i in range(0x32000) if not 0xD800 <= i < 0xE000]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = table.select("doc_id", byte_bpe.words(F.col("text"), spark).alias("words")).toPandas()
    text = dict(rows)
    for i, words in zip(got.doc_id, got.words):
        assert "".join(words) == text[i]
        assert [x for w in words for x in library._core_bpe.encode_single_piece(w.encode())] == library.encode_ordinary(text[i])


@pytest.mark.parametrize("size", [byte_bpe.DICTIONARY, 300, 0])
def test_against_the_library(spark, texts, library, monkeypatch, size):
    monkeypatch.setattr(byte_bpe, "DICTIONARY", size)
    some = texts if size > 300 else texts[:120] + texts[-300:]
    table = spark.createDataFrame([(i, t, "x", "y", None) for i, t in some], SCHEMA).repartition(3)
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in byte_bpe.encode_decode(table, PATH, keep_ids=True).collect()]
    assert sorted(got, key=repr) == sorted(wanted(library, some), key=repr)


def test_fold_and_heap_agree(spark, library):
    rng = random.Random(9)
    known = byte_bpe.ranks(PATH)
    words = [bytes(rng.choice(b"abcdeinrst \xc3\xa9") for _ in range(rng.randint(1, 40))).decode(errors="ignore") or "a" for _ in range(300)]
    table = spark.createDataFrame([(w,) for w in words], "w string").select("w", byte_bpe.fold(F.col("w"), byte_bpe.rank_maps(PATH)).alias("ids"))
    for r in table.collect():
        assert r.ids == byte_bpe.merge_long(r.w.encode(), known) == list(library._core_bpe.encode_single_piece(r.w.encode()))


def test_no_rows(spark, empty):
    assert byte_bpe.encode_decode(empty, PATH).count() == 0
