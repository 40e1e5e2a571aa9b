"""Words that the library gets by lines have the ids that it gives them one by one."""

import random

import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from voxloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = "İstanbul क़ाला ऩ Ωmega ﬁne Σίσυφος ΣΑΣ 각 각 漢字 ét́ ́x ǅ ß ẞ \U0001d400bc ªº ñandú ẛ̣ क़लम ͅα don't we'll 12ab ab12 ½ Ⅷ w</w>x </w> a\x01b \x01   a b 　 \u0085".split(" ")


def words(rng, n):
    return list(dict.fromkeys("".join(rng.choices("abcdefghijklmnopqrstuvwxyzñéß", k=rng.randint(1, 14))) for _ in range(n)))


def ids_of(encoder, texts):
    ids, sizes = encoder.encode(pa.array(texts))
    at = 0
    for n in sizes.tolist():
        yield ids[at : at + n].tolist()
        at += n


def test_words_of_letters_go_by_lines(monkeypatch):
    encoder, library, calls = packing.WordEncoder(PATH), Tokenizer.from_file(PATH), []
    by_library = encoder.by_library
    monkeypatch.setattr(encoder, "by_library", lambda texts: calls.extend(texts) or by_library(texts))
    texts = [" ".join(words(random.Random(i), 1500)) for i in range(3)]
    assert list(ids_of(encoder, texts)) == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(calls) < 200 < 4000 < len(encoder.codes)


@pytest.mark.parametrize("line", [1, 3, 64, 1000])
def test_odd_letters_are_as_the_library_has_them(monkeypatch, line):
    if hasattr(packing, "LINE"):
        monkeypatch.setattr(packing, "LINE", line)
    encoder, library = packing.WordEncoder(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(9)
    for _ in range(6):
        some = words(rng, 300) + ODD + ["".join(rng.choices(ODD, k=2)) for _ in range(60)]
        rng.shuffle(some)
        texts = [*some, " ".join(some), "", None, "<|endoftext|> " + some[0]]
        assert list(ids_of(encoder, texts)) == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_parts_are_encoded_without_lines_where_words_have_no_last_token():
    encoder, library = packing.WordEncoder(PATH), Tokenizer.from_file(PATH)
    encoder.lines_told_apart = False
    text = " ".join(words(random.Random(1), 400))
    assert list(ids_of(encoder, [text])) == [library.encode(text, add_special_tokens=False).ids]
