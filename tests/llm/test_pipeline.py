"""The stages one after the other, and each of the copy stages against brute force on rows with every awkward case."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from voxloom.llm import queries

CLASHES = "doc_id long, text string, lang string, source string, n_chars long, key string, row string, text_sha256 string, id string, stays string, component string"


def test_stages(spark, docs, rows):
    now, sizes = docs, []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, "").persist()
        assert now.columns == columns
        sizes.append(now.count())
        kept = [(r.doc_id, r.text) for r in now.collect()]
        ids = Counter(i for i, _ in kept)
        if name == "language_id":
            assert not {400, 401, 402, 501, 502} & set(ids) and {0, 405, 407, 600} <= set(ids)
        if name == "exact_dedup":
            norm = Counter(re.sub(r"[\x20\x09-\x0D]+", " ", t) for _, t in kept)
            assert max(norm.values()) == 1 and ids[0] == 1 and 100 not in ids and 500 not in ids
        if name == "jaccard_join":
            assert {0, 8, 39, 408} <= set(ids) and not {600 + i for i in range(1, 8)} & set(ids)
    assert sizes == sorted(sizes, reverse=True) and sizes[2] == sizes[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, now, "")
    assert Counter(i for i, n in Counter((r.doc_id, r.piece) for r in packed.collect()).items() if n > 1) == Counter()
    assert {r.doc_id for r in packed.collect()} == set(ids)


@pytest.fixture(scope="module")
def awkward(spark, rows):
    """Repeated rows of one text and id, null ids in one component, two texts of the smallest id, empty texts."""
    shared = rows[30][1] + " more words that come after it"
    more = [(None, shared, "en"), (None, shared + " x", "en"), (7, shared + " y", "en"), (7, shared + " z", "en"), (7, shared + " z", "en")]
    lone = "a text that only rows without any number have, and that twice or so"
    more += [(None, lone, "fr"), (None, lone, "fr"), (900, None, None), (900, None, None), (901, "  ", "en")]
    full = [(i, t, lang, "s", None if t is None else len(t), *["own"] * 6) for i, t, lang in rows + more]
    return full, spark.createDataFrame(full, CLASHES).repartition(3).persist()


def test_exact_copies_by_brute_force(spark, awkward):
    full, df = awkward
    groups = defaultdict(list)
    for r in full:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append((r[0] is None, r[0] or 0, r[1] or "", r))
    got = [tuple(r) for r in corpus_pipeline.drop_exact_copies(spark, df, "").collect()]
    assert Counter((r[0], r[1] or "", *r[5:]) for r in got) == Counter((x[3][0], x[2], *x[3][5:]) for x in (min(g, key=lambda x: x[:3]) for g in groups.values()))


def test_near_copies_by_brute_force(spark, awkward):
    full, df = awkward
    words = [(r[1] or "").lower().split() for r in full]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in words]
    root = list(range(len(full)))
    for _ in range(6):
        for i in range(len(full)):
            for j in range(i):
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, df, "").collect())
    want = Counter((full[i][0], full[i][1]) for i in range(len(full)) if not sets[i])
    for c in set(root):
        group = [full[i] for i in range(len(full)) if root[i] == c and sets[i]]
        if group:
            least = min((r[0] is None, r[0] or 0) for r in group)
            kept = [x for x in got if x in {(r[0], r[1]) for r in group}]
            assert len(kept) == 1 and got[kept[0]] == 1 and (kept[0][0] is None, kept[0][0] or 0) == least
            want[kept[0]] += 1
    assert got == want


def test_no_rows(spark, empty):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_registered_names():
    found = [int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()]
    assert sorted(found) == list(range(1, 14))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
