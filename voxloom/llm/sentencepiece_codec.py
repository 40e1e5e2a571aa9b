"""Encoding and decoding with merge-type SentencePiece vocabularies.

A score-ordered agenda of adjacent symbol pairs does the merging. No piece of such a vocabulary goes on after a
non-space with a space, so a text falls apart into stretches that are encoded on their own and remembered. Every
stretch is checked against the sentencepiece library when a worker first meets it.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import documents, in_batches, slices

MARK = "▁"
#: Stretches that a worker remembers before it starts afresh (some 120 MB).
REMEMBERED = 600_000
ROWS = 512
STRETCH = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
#: Stretches beyond this many characters get an agenda of their own; the others share matrices.
LONG = 64
NONE, NEVER, WIDE = -1, 1 << 40, 1 << 24


class Agenda:
    """The vocabulary of one model file and the merging of adjacent symbol pairs by score."""

    def __init__(self, path: str):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        special = lambda i: lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i)
        self.ids = {lib.id_to_piece(i): i for i in range(n) if not special(i)}
        scores = {p: lib.get_score(i) for p, i in self.ids.items()}
        self.byte_ids = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.begin, self.end = lib.bos_id(), lib.eos_id()
        if any(c == "\n" or (c == MARK and p[i] != MARK) for p in self.ids if len(p) > 1 for i, c in enumerate(p[1:])):
            raise ValueError("pieces of this vocabulary go across spaces or lines")
        # Symbols: pieces by id, then single characters of pieces that are none themselves. Best score, lowest rank.
        singles = sorted({c for p in self.ids for c in p} - self.ids.keys())
        self.symbols = self.ids | {c: n + i for i, c in enumerate(singles)}
        self.text_of = {i: p for p, i in self.symbols.items()}
        order = {x: r for r, x in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs = sorted(
            (self.symbols[p[:i]] * WIDE + self.symbols[p[i:]], order[scores[p]], k)
            for p, k in self.ids.items()
            for i in range(1, len(p))
            if p[:i] in self.symbols and p[i:] in self.symbols
        )
        self.keys, self.ranks, self.merged = (np.array(x, dtype=np.int64) for x in zip(*pairs))
        self.codes = np.full(0x110000, NONE, dtype=np.int64)
        for p, i in self.symbols.items():
            if len(p) == 1:
                self.codes[ord(p)] = i
        self.packed: dict[str, bytes] = {}

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of pairs; the rank is NEVER where they make no piece."""
        key = left * WIDE + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(known, self.ranks[at], NEVER), self.merged[at]

    def merge_long(self, stretch: str) -> list[tuple[int, int]]:
        """Symbols of one long stretch with a heap as agenda: best score first, then leftmost."""
        symbols = self.codes[np.frombuffer(stretch.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        rank, into = self.look_up(symbols[:-1], symbols[1:])
        agenda = [(r, i, i + 1, int(symbols[i]), int(symbols[i + 1]), m) for i, (r, m) in enumerate(zip(rank.tolist(), into.tolist())) if r < NEVER]
        heapq.heapify(agenda)
        symbols, alive = symbols.tolist(), [True] * n
        while agenda:
            _, left, right, a, b, both = heapq.heappop(agenda)
            if not (alive[left] and alive[right]) or (symbols[left], symbols[right], after[left]) != (a, b, right):
                continue  # one of the two has been merged since
            symbols[left], alive[right], after[left] = both, False, after[right]
            if after[right] < n:
                before[after[right]] = left
            for x, y in ((before[left], left), (left, after[left])):
                if x >= 0 and y < n:
                    r, m = self.look_up(np.array([symbols[x]]), np.array([symbols[y]]))
                    if r[0] < NEVER:
                        heapq.heappush(agenda, (int(r[0]), x, y, symbols[x], symbols[y], int(m[0])))
        return [(s, i) for i, (s, ok) in enumerate(zip(symbols, alive)) if ok]

    def merge_many(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of stretches of like length, and which of them are left, one row each.

        Each row holds the agenda of its stretch: in every round its best pair, the leftmost of equals, is merged
        and the pairs beside it get new ranks, until no row has a pair left.
        """
        n, wide = len(stretches), max(map(len, stretches))
        flat = np.frombuffer("".join(s.ljust(wide, "\n") for s in stretches).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        long = np.array([len(s) for s in stretches])
        symbols = self.codes[flat].reshape(n, wide)
        alive = np.arange(wide) < long[:, None]
        symbols[~alive] = NONE
        rank, into = np.full((n, wide), NEVER), np.zeros((n, wide), dtype=np.int64)
        rank[:, :-1], into[:, :-1] = self.look_up(symbols[:, :-1], symbols[:, 1:])
        before = np.tile(np.arange(-1, wide - 1), (n, 1))
        after = np.tile(np.arange(1, wide + 1), (n, 1))
        rows = np.arange(n)
        while len(rows):
            left = rank[rows].argmin(axis=1)
            going = rank[rows, left] < NEVER
            rows, left = rows[going], left[going]
            right = after[rows, left]
            symbols[rows, left] = into[rows, left]
            alive[rows, right] = False
            rank[rows, right] = NEVER
            following = after[rows, right]
            after[rows, left] = following
            inside = following < wide
            before[rows[inside], following[inside]] = left[inside]
            ahead = np.where(inside, symbols[rows, np.minimum(following, wide - 1)], NONE)
            rank[rows, left], into[rows, left] = self.look_up(symbols[rows, left], ahead)
            back = before[rows, left]
            has = back >= 0
            r, b = rows[has], back[has]
            rank[r, b], into[r, b] = self.look_up(symbols[r, b], symbols[r, left[has]])
        return symbols, alive

    def add(self, new: list[str]) -> None:
        """Work out and remember the packed ids (little-endian 32-bit) of new stretches."""
        new = sorted(new, key=len)
        at = 0
        while at < len(new):
            if len(new[at]) > LONG:
                self.remember(new[at], self.merge_long(new[at]))
                at += 1
                continue
            to = at
            while to < len(new) and to - at < 20_000 and len(new[to]) <= min(LONG, len(new[at]) + 4):
                to += 1
            symbols, alive = self.merge_many(new[at:to])
            plain = (~alive | ((symbols >= 0) & (symbols < WIDE // 2) & (symbols < self.library.get_piece_size()))).all(axis=1)
            flat, ends = symbols[alive].astype("<u4").tobytes(), np.cumsum(alive.sum(axis=1)) * 4
            for k, (stretch, end, ok) in enumerate(zip(new[at:to], ends.tolist(), plain.tolist())):
                if ok:
                    self.packed[stretch] = flat[(ends[k - 1] if k else 0) : end]
                else:
                    self.remember(stretch, [(int(symbols[k, i]), i) for i in np.flatnonzero(alive[k])])
            at = to

    def remember(self, stretch: str, found: list[tuple[int, int]]) -> None:
        """Symbols that are no pieces become the ids of their bytes."""
        ids: list[int] = []
        for symbol, i in found:
            piece = self.text_of.get(symbol, stretch[i])
            ids += [self.ids[piece]] if piece in self.ids else [self.byte_ids[b] for b in piece.encode()]
        self.packed[stretch] = np.array(ids, dtype="<u4").tobytes()

    def check(self, new: list[str]) -> None:
        """Compare stretches with the library, which puts a space before a text; no piece has a line end."""
        skip = len(self.library.encode("\n"))
        for spaced in (True, False):
            part = [s for s in new if (s[0] == MARK) == spaced and s != MARK]
            told = self.library.encode([s[1:].replace(MARK, " ") if spaced else "\n" + s for s in part], num_threads=1)
            told = told if spaced else [x[skip:] for x in told]
            mine = b"".join(map(self.packed.__getitem__, part))
            if np.fromiter(chain.from_iterable(told), dtype="<u4").tobytes() != mine:
                wrong = [s for s, x in zip(part, told) if self.packed[s] != np.array(x, dtype="<u4").tobytes()]
                raise ValueError(f"stretches differ from the sentencepiece library: {wrong[:3]}")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of whole texts, without begin and end; new stretches are checked."""
        if len(self.packed) > REMEMBERED:
            self.packed.clear()
        cut = [STRETCH.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if new := list(set().union(*cut) - self.packed.keys()):
            self.add(new)
            self.check(new)
        return [b"".join(map(self.packed.__getitem__, x)) for x in cut]


@lru_cache(maxsize=2)
def agenda(path: str) -> Agenda:
    return Agenda(path)


def encode_decode(docs: DataFrame, model: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 (and ids with keep_ids) for each row of docs.

    Null and empty texts give the begin and end ids alone and decode to nothing. Rows are independent: repeated
    rows and null doc_ids come back as given, empty tables give no rows, and extra columns are ignored. A stretch
    on which agenda and library differ stops the job with an error.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def run(batches):
        codec = agenda(model)
        ends = [np.array([i], dtype="<u4").tobytes() for i in (codec.begin, codec.end)]
        for batch in batches:
            for part in slices(batch, ROWS):
                packed = [ends[0] + x + ends[1] for x in codec.encode([t or "" for t in part.column("text").to_pylist()])]
                ids = [np.frombuffer(x, dtype="<u4").tolist() for x in packed]
                decoded = [codec.library.decode(x) for x in ids]
                columns = [
                    part.column("doc_id").cast(pa.int64()),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in packed]),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]),
                ] + ([pa.array(ids, pa.list_(pa.int32()))] if keep_ids else [])
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    return in_batches(docs).select("doc_id", "text").mapInArrow(run, schema)


def op4_sentencepiece(spark, sf_dir):
    return encode_decode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
