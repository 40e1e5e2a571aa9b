"""Best-fit packing of tokenised documents into sequences by the sum-of-squares rule."""

from __future__ import annotations

import os
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from .common import SMALL_BATCH, documents, in_batches, slices, written

CAPACITY = 4096
END_ID = 1
#: Pieces that one group packs: groups are this large for any corpus, only their number grows.
GROUP = 50_000
#: Parts of words that a worker remembers; then those go that only one slice of texts had.
REMEMBERED = 1 << 17
ROWS = 512
#: What the last token of each word ends with, and no other token; words of letters that the library gets as one text.
LAST, LINE = "</w>", 64
#: The strings of special tokens, which the library looks for before it cuts words.
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
#: Bytes as the library's normaliser sees them: line ends and tabs are spaces, A-Z are lower-case.
PLAIN = np.frombuffer(bytes.maketrans(b"\t\n\rABCDEFGHIJKLMNOPQRSTUVWXYZ", b"   abcdefghijklmnopqrstuvwxyz"), dtype=np.uint8)
LETTERS, MARKS = (np.isin(np.arange(256), np.frombuffer(x, dtype=np.uint8)) for x in (b"abcdefghijklmnopqrstuvwxyz", b".,;:!?*#$%&|<>\"()"))


class WordEncoder:
    """Ids of whole texts; a batch's words are told apart in Arrow, and each is encoded by the library once.

    The pre-tokenizer drops white space, never joins across it, and cuts between a letter and a mark, so a text's ids
    are its parts' ids in order. Texts that hold the string of a special token go to the library whole. A call for
    each part costs more than its merges, so parts of letters alone go by lines. The library works in one thread: tasks
    fill the cores, and its threads would keep memory of their own in every worker.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith(LAST)]] = True
        self.lines_told_apart = all(c + LAST in vocabulary for c in ByteLevel.alphabet())
        self.codes: dict[str, int] = {"": 0}
        self.ids = np.zeros(0, dtype=np.uint32)  # of all known parts, one after the other
        self.start, self.count = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        self.slices = np.full(1, 2)  # how many slices had each part

    def by_library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), dtype=np.uint32), np.fromiter(map(len, found), dtype=np.int64, count=len(found))

    def by_lines(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Those of the words whose ids a line of many words tells, their ids and the number of each one's.

        Each word gives at least one last token. A line with as many of them as words has one a word; the words of
        other lines are left out: the library cuts one of them, as it decomposes a letter.
        """
        lines = [words[i : i + LINE] for i in range(0, len(words), LINE)]
        ids, count = self.by_library([" ".join(x) for x in lines])
        line, last = np.repeat(np.arange(len(lines)), count), self.last[ids]
        told = np.bincount(line[last], minlength=len(lines)) == [len(x) for x in lines]
        ids, last = ids[told[line]], last[told[line]]
        return [w for x, known in zip(lines, told) if known for w in x], ids, np.diff(np.flatnonzero(last), prepend=-1)

    def add(self, new: list[str]) -> None:
        words, ids, count = self.by_lines([w for w in new if w.isalpha()] if self.lines_told_apart else [])
        if len(words) < len(new):
            known = set(words)
            others = [w for w in new if w not in known]
            more, many = self.by_library(others)
            new, ids, count = words + others, np.concatenate([ids, more]), np.concatenate([count, many])
        self.codes.update(zip(new, range(len(self.count), len(self.count) + len(new))))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, ids])
        self.slices = np.concatenate([self.slices, np.zeros(len(new), dtype=np.int64)])

    def shrink(self) -> None:
        keep = np.flatnonzero(self.slices > 1)
        if len(keep) > REMEMBERED // 2:
            keep = keep[:1]
        names = list(self.codes)
        self.codes = {names[i]: k for k, i in enumerate(keep.tolist())}
        self.ids = self.ids[gathered(self.start[keep], self.count[keep])]
        self.count = self.count[keep]
        self.start, self.slices = np.cumsum(self.count) - self.count, np.full(len(keep), 1)
        self.slices[0] = 2

    def parts(self, texts: pa.Array) -> pa.ListArray:
        """The parts of each text that the library encodes on their own, with empty ones between spaces."""
        n, data = len(texts), texts.buffers()[2]
        bounds = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=texts.offset + n + 1)[texts.offset :]
        flat = PLAIN[np.frombuffer(data or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]]
        letter = LETTERS[flat]
        # Latin letters of two bytes, without the signs for times and divided by.
        letter[1:] |= (flat[:-1] == 0xC3) & (flat[1:] >= 0x80) & (flat[1:] != 0x97) & (flat[1:] != 0xB7)
        cuts = np.flatnonzero(letter[:-1] & MARKS[flat[1:]]) + 1
        bounds = bounds - bounds[0]
        bounds = (bounds + np.searchsorted(cuts, bounds)).astype(np.int32)
        return pc.split_pattern(pa.StringArray.from_buffers(n, pa.py_buffer(bounds), pa.py_buffer(np.insert(flat, cuts, 32))), " ")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the number of each text's."""
        if len(self.codes) > REMEMBERED:
            self.shrink()
        texts = pc.fill_null(texts.cast(pa.string()), "")
        parts = self.parts(texts)
        told = parts.flatten().dictionary_encode()
        kinds = told.dictionary.to_pylist()
        if new := [w for w in kinds if w not in self.codes]:
            self.add(new)
        code = np.fromiter(map(self.codes.__getitem__, kinds), dtype=np.int64, count=len(kinds))
        self.slices[code] += 1
        code = code[told.indices.to_numpy()]
        count = self.count[code]
        ids = self.ids[gathered(self.start[code], count)]
        row = np.repeat(np.arange(len(texts)), parts.value_lengths().to_numpy())
        sizes = np.bincount(row, count, len(texts)).astype(np.int64)
        special = pc.or_(*[pc.match_substring(texts, x, ignore_case=True) for x in SPECIAL]).to_numpy(zero_copy_only=False)
        if special.any():
            each = np.split(ids, np.cumsum(sizes)[:-1])
            for i in np.flatnonzero(special):
                each[i] = self.by_library([texts[int(i)].as_py()])[0]
            ids, sizes = np.concatenate(each), np.array([len(x) for x in each])
        return ids, sizes


def gathered(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run of so many, one run after the other."""
    return np.arange(count.sum(), dtype=np.int32) + np.repeat((start - (np.cumsum(count) - count)).astype(np.int32), count)


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each document's pieces, its end id included."""

    def run(batches):
        encoder = word_encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, ROWS):
                ids, sizes = encoder.encode(part.column("text"))
                ends = np.cumsum(sizes + 1)  # with the end id of each text
                packed = np.insert(ids, np.cumsum(sizes), end_id).astype("<u4").tobytes()
                many = -(-(sizes + 1) // capacity)
                row = np.repeat(np.arange(len(sizes)), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                length = np.minimum(capacity, sizes[row] + 1 - start)
                at = (ends - sizes - 1)[row] + start
                crc = [zlib.crc32(packed[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return in_batches(docs, SMALL_BATCH).select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, in the given order.

    A length goes where the sum over gaps of the squared number of open bins with that gap becomes smallest: into
    a bin of some gap that fits, or a new bin. Of equals the smallest gap wins, so a new bin comes last.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    opened = 0
    for i, s in enumerate(lengths.tolist()):
        # Taking a bin from gap g and giving one to gap g - s changes the sum by 2 * (count[g - s] - count[g] + 1),
        # or by 1 - 2 * count[g] where that fills it, as full bins are not open.
        change = 2 * (count[: capacity - s + 1] - count[s:] + 1)
        change[0] = 1 - 2 * count[s]
        change[count[s:] == 0] = 1 << 40
        new = 2 * count[capacity - s] + 1 if s < capacity else 0
        best = int(change.argmin())
        if change[best] <= new:
            gap = best + s
            b = bins[gap].pop()
            count[gap] -= 1
        else:
            gap, b = capacity, opened
            opened += 1
        where[i], offset[i] = b, capacity - gap
        if gap > s:
            bins[gap - s].append(b)
            count[gap - s] += 1
    return where, offset


def pack(cut: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """cut with sequence_id and offset. Pieces are dealt to groups of about `group`, each packed on its own.

    They are dealt by row, so that rows of one doc_id, or of none, do not fill a group.
    """
    cut = written(cut.withColumn("row", F.monotonically_increasing_id()))
    groups = max(1, -(-cut.count() // group))
    dealt = cut.withColumn("dealt", F.pmod(F.xxhash64("row"), F.lit(groups))).drop("row")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        where, offset = sum_of_squares(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=pdf["dealt"] * (1 << 32) + where, offset=offset).drop(columns="dealt")

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("dealt").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece with its place in a sequence of at most capacity tokens.

    Null and empty texts are one piece, the end id alone. Repeated rows are packed as often as given; null
    doc_ids come back as null. An empty table gives no rows; extra columns are ignored.
    """
    return pack(pieces(docs, tokenizer, capacity), capacity)


def op7_best_fit_packing(spark, sf_dir):
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
