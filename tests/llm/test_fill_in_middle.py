"""Fill-in-middle against a loop over texts, on rows with every awkward case and on texts beyond a block."""

import hashlib
import re

import numpy as np
import pytest

from voxloom.llm import fill_in_middle as fim

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def by_hand(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = sha(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, sha(text), sha(text), text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(tokens[a:b]) for a, b in ((0, low), (low, high), (high, n)))
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"
    return doc_id, n, form, len(pre), len(mid), sha(out), sha(text), out


@pytest.fixture(scope="module")
def all_rows(rows):
    more = [(1000 + i, t, "en") for i, t in enumerate(["<P", "a <P> b", "<M>", "x<", "< P>", " \n", "a\u0085b c d", "\x00 \x0b\x1c", "é", "\n\nword\n\n", "a b", " a"] * 6)]
    return rows + more + [(1, rows[1][1], "en"), (None, "a few words here", "en"), (None, "a few words here", "en")]


@pytest.mark.parametrize("block", [fim.BLOCK, 7])
def test_against_a_loop(spark, all_rows, monkeypatch, block):
    monkeypatch.setattr(fim, "BLOCK", block)
    some = all_rows if block > 7 else all_rows[:30] + all_rows[-40:]
    table = spark.createDataFrame([(i, t, lang, "h1", None) for i, t, lang in some], "doc_id long, text string, form string, h1 string, n long").repartition(3)
    got = sorted((tuple(r) for r in fim.fill_in_middle(table, keep_output=True).collect()), key=repr)
    want = sorted(((*x[:-1], bytearray(x[-1].encode())) for x in (by_hand(i, t) for i, t, _ in some)), key=repr)
    assert got == want
    assert {x[2] for x in want} == {"plain", "psm", "spm"}


def test_blocks_and_batches():
    """Cuts at every place, over parts that blocks split, with texts of all forms side by side."""
    rng, raw = np.random.default_rng(3), []
    bounds, forms, at = [], [], 0
    for i in range(200):
        text = bytes(rng.integers(97, 123, rng.integers(0, 40), dtype=np.uint8))
        low, high = sorted(rng.integers(0, len(text) + 1, 2))
        bounds.append((at, at + low, at + high, at + len(text)))
        forms.append(["plain", "psm", "spm"][i % 3])
        raw.append(text)
        at += len(text)
    flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
    out, begins = fim.scatter(flat, np.array(bounds), np.array(forms))
    for i, (s, low, high, e) in enumerate(bounds):
        pre, mid, suf = (bytes(flat[a:b]) for a, b in ((s, low), (low, high), (high, e)))
        want = {"plain": pre + mid + suf, "psm": b"<P>" + pre + b"<S>" + suf + b"<M>" + mid, "spm": b"<S>" + suf + b"<P>" + pre + b"<M>" + mid}[forms[i]]
        assert bytes(out[begins[i] : begins[i + 1]]) == want
    back, places = fim.gather(out, begins, np.array(forms))
    assert bytes(back) == bytes(flat) and [b[0] for b in bounds] + [at] == places.tolist()
    with pytest.raises(ValueError):
        fim.gather(out[:-1], np.append(begins[:-1], begins[-1] - 1), np.array(["psm"] * len(forms)))


def test_no_rows(empty):
    assert fim.fill_in_middle(empty).count() == 0
