"""Byte-level BPE: ranked merges folded over the bytes of words by Spark's higher-order functions.

Texts fall into words by a pattern. The words of the corpus are counted, and the frequent ones are folded once each
into a dictionary of a bounded size that every task holds; a word that it lacks is folded where it stands. Ranks come
from one literal, an array of small maps, so that a look-up reads a few entries. Ids become text as the pieces of a
binary column that lie side by side.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, in_batches, slices, written

#: Maps that the ranks are dealt over, by xxhash64 as Spark computes it (seed 42).
MAPS, SPARK_SEED = 1 << 13, 42
NEVER, WIDE = (1 << 31) - 1, 1 << 32
#: Words of more bytes are merged with a heap: the fold of a word takes the square of its bytes.
LONG = 48
#: Words that the dictionary holds at most (some 30 MB).
DICTIONARY = 1 << 20
#: Stands for a word that the dictionary lacks.
HOLE = -1
ROWS, ELEMENTS = 4096, 1 << 21


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        found = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if not all(bytes([i]) in found for i in range(256)) or sorted(found.values()) != list(range(len(found))):
        raise ValueError("a byte-level vocabulary has every byte, and ranks without gaps")
    return found


def rank_maps(path: str) -> Column:
    """The ranks as a literal: an array of maps from the hexadecimal digits of a piece to its rank."""
    dealt: list[dict[str, int]] = [{} for _ in range(MAPS)]
    for piece, rank in ranks(path).items():
        digits = piece.hex().upper()
        dealt[xxhash.xxh64_intdigest(digits.encode(), seed=SPARK_SEED) % MAPS][digits] = rank
    return F.from_json(F.lit(json.dumps(dealt)), "array<map<string,int>>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(word: Column, maps: Column) -> Column:
    """The ids of a word that is not empty: the leftmost pair of the lowest rank merges until no pair is a piece.

    The state has a number for each piece, the rank of its pair with the next one before the place where it begins, and
    one for the end; so the least number is the pair to merge. A word that is a piece itself is that piece.
    """

    def merged(table: Column) -> Column:
        return let(F.hex(word), lambda digits: folded(digits, table))

    def folded(digits: Column, table: Column) -> Column:
        n = F.octet_length(word)

        def rank(piece: Column) -> Column:
            held = F.get(table, F.xxhash64(piece).bitwiseAND(F.lit(MAPS - 1)).cast("int"))
            return F.coalesce(F.element_at(held, piece), F.lit(NEVER))

        between = lambda a, b: digits.substr(a * 2 + 1, (b - a) * 2)
        entry = lambda r, at: r.cast("long") * WIDE + at
        place = lambda x: x.bitwiseAND(F.lit(WIDE - 1)).cast("int")
        last = F.array(entry(F.lit(NEVER), n - 1), entry(F.lit(NEVER), n))
        pairs = F.transform(F.sequence(F.lit(0), n - 2), lambda i: entry(rank(digits.substr(i * 2 + 1, F.lit(4))), i))
        start = F.when(n > 1, F.concat(pairs, last)).otherwise(last)

        def step(state: Column, _: Column) -> Column:
            def merge(least: Column) -> Column:
                return F.when(least < NEVER * WIDE, let(F.array_position(state, least).cast("int") - 1, join)).otherwise(state)

            def join(k: Column) -> Column:
                """The pieces k and k + 1 become one; its pairs with those beside it get their ranks."""
                at = lambda d: place(F.get(state, k + d))
                pair = lambda a, b: F.when(F.size(state) > k + b, rank(between(at(a), at(b)))).otherwise(F.lit(NEVER))
                put = lambda x, i: F.when(i == k, entry(pair(0, 3), place(x))).when(i == k - 1, entry(pair(-1, 2), place(x))).otherwise(x)
                return F.transform(F.filter(state, lambda x, i: i != k + 1), put)

            return let(F.array_min(state), merge)

        done = F.aggregate(F.sequence(F.lit(2), n), start, step)
        cut = lambda d: F.transform(F.sequence(F.lit(0), F.size(d) - 2), lambda i: rank(between(place(F.get(d, i)), place(F.get(d, i + 1)))))
        return let(rank(digits), lambda whole: F.when(whole < NEVER, F.array(whole)).otherwise(let(done, cut)))

    return let(maps, merged)


def merge_long(word: bytes, known: dict[bytes, int]) -> list[int]:
    """The same merges with a heap, for long words: lowest rank first, then leftmost."""
    if word in known:
        return [known[word]]
    n = len(word)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := known.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, a, to = heapq.heappop(heap)
        if not alive[a] or end[a] >= to or end[end[a]] != to:
            continue  # one of the two has been merged since
        alive[end[a]], end[a] = False, to
        if to < n:
            before[to] = a
        for left in (before[a], a):
            if left >= 0 and end[left] < n and (r := known.get(word[left : end[end[left]]])) is not None:
                heapq.heappush(heap, (r, left, end[end[left]]))
    return [known[word[i : end[i]]] for i in range(n) if alive[i]]


@lru_cache(maxsize=4)
def _patterns(spark: SparkSession, pattern: str) -> tuple[str, str, str]:
    """A tiktoken pattern for Spark, the same with the letters and numbers that are newer than the JVM's, and a class
    that finds texts which need the second: it takes several times as long, as it tries each range of new characters."""
    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    single = {bytes([i]): i for i in range(256)}
    full, known = pattern, r"\p{Cn}"
    for kind in (r"\p{L}", r"\p{N}"):
        found = tiktoken.Encoding("kind", pat_str=kind, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)
        newer = F.regexp_replace(F.lit(bytes(found).decode()), kind, "")
        newer, assigned = spark.range(1).select(newer, F.regexp_replace(newer, r"\p{Cn}", "")).first()
        spans: list[list[int]] = []
        for c in map(ord, newer):
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
        added = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in spans)
        known += "".join(rf"\x{{{ord(c):X}}}" for c in assigned)
        inside, out = False, ""
        for part in full.replace(kind, f"\0{kind}\0").replace("[", "\0[\0").replace("]", "\0]\0").split("\0"):
            inside = part == "[" or (inside and part != "]")
            out += (f"{kind}{added}" if inside else f"[{kind}{added}]") if part == kind else part
        full = out
    return f"(?U){pattern}", f"(?U){full}", f"[{known}]"


def words(text: Column, spark: SparkSession, pattern: str = public_tokenizers.PATTERN) -> Column:
    """The matches of a tiktoken pattern in a text, in order; null has none."""
    usual, full, newer = _patterns(spark, pattern)
    whole = F.coalesce(text, F.lit(""))
    matches = lambda p: F.regexp_extract_all(whole, F.lit(p), F.lit(0))
    return F.when(whole.rlike(newer), matches(full)).otherwise(matches(usual))


def frequent(docs: DataFrame, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(word): the most frequent words of at most LONG bytes, DICTIONARY of them at most."""
    every = docs.select(F.explode(words(F.col("text"), docs.sparkSession, pattern)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counted = written(every.filter(F.octet_length("word") <= LONG).withColumn("rarity", -F.floor(F.log2("n") * 8)))
    room, least = DICTIONARY, None
    for r in counted.groupBy("rarity").agg(F.count("*").alias("many")).orderBy("rarity").collect():  # some hundred rows
        if r.many > room:
            break
        room, least = room - r.many, r.rarity
    return counted.filter(F.lit(False) if least is None else F.col("rarity") <= least).select("word")


def _per_row(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Where the values of each row begin (and the last end), from how many items rows have and what items hold."""
    ends = np.concatenate([[0], np.cumsum(values)])
    return ends[np.concatenate([[0], np.cumsum(lengths)])]


def looked_up(held: pa.Table, batch: pa.RecordBatch) -> pa.RecordBatch:
    """doc_id, known (packed ids with HOLE for each word that the dictionary lacks) and missing (those words)."""
    listed = batch.column("words")
    lengths = pc.list_value_length(listed).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = listed.flatten()
    at = pc.index_in(flat, value_set=held["word"].chunk(0))
    lacking = pc.is_null(at)
    ids = held["ids"].chunk(0)
    found = pc.take(ids, pc.fill_null(at, len(ids) - 1))
    sizes = pc.list_value_length(found).to_numpy(zero_copy_only=False)
    packed = found.flatten().to_numpy(zero_copy_only=False).astype("<i4")
    places = _per_row(sizes.astype(np.int64), lengths)
    known = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer((places * 4).astype("<i8")), pa.py_buffer(packed)])
    gaps = _per_row(lacking.to_numpy(zero_copy_only=False).astype(np.int64), lengths)
    missing = pa.ListArray.from_arrays(pa.array(gaps, pa.int32()), flat.filter(lacking))
    return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), known.cast(pa.binary()), missing], names=["doc_id", "known", "missing"])


def filled(batch: pa.RecordBatch, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows, one after the other, and where each row begins (and the last ends)."""
    packed = batch.column("known")
    lengths = pc.binary_length(packed).to_numpy(zero_copy_only=False).astype(np.int64) // 4
    flat = np.frombuffer(b"".join(x.as_buffer() for x in packed), dtype="<i4")
    folded = batch.column("folded").flatten()
    if folded.null_count:
        long = iter(batch.column("long").flatten().to_pylist())
        folded = pa.array([x if x is not None else merge_long(next(long).encode(), known) for x in folded.to_pylist()], pa.list_(pa.int32()))
    sizes = np.ones(len(flat), dtype=np.int64)
    sizes[flat == HOLE] = pc.list_value_length(folded).to_numpy(zero_copy_only=False)
    ids = np.repeat(flat, sizes)
    ids[ids == HOLE] = folded.flatten().to_numpy(zero_copy_only=False)
    return ids, _per_row(sizes, lengths)


def decoded(ids: np.ndarray, places: np.ndarray, pieces: pa.Array) -> list[memoryview]:
    """The bytes of each row's ids: the pieces side by side."""
    if not len(ids):
        return [memoryview(b"")] * (len(places) - 1)
    side_by_side = pieces.take(pa.array(ids))
    offsets = np.frombuffer(side_by_side.buffers()[1], dtype="<i8")[places]
    data = memoryview(side_by_side.buffers()[2])
    return [data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def encode_decode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 (and ids with keep_ids) for each row of docs.

    Null and empty texts have no ids. Rows are independent: repeated rows and null doc_ids come back as given, extra
    columns are ignored, an empty table gives no rows. Long texts are split and joined in time that grows with their
    size; a word of more than LONG bytes takes a heap of its size.
    """
    spark = docs.sparkSession
    maps = rank_maps(path)
    entries = frequent(docs, pattern).select("word", fold(F.col("word"), maps).alias("ids")).toArrow().combine_chunks()
    hole = pa.table({"word": pa.array([""]), "ids": pa.array([[HOLE]], pa.list_(pa.int32()))})  # no word is empty
    held = pa.concat_tables([t.cast(hole.schema) for t in (entries, hole)]).combine_chunks()
    sent = spark.sparkContext.broadcast(held)

    def look_up(batches):
        for batch in batches:
            for part in slices(batch, ROWS, ELEMENTS, "words"):
                yield looked_up(sent.value, part)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def assemble(batches):
        known = ranks(path)
        pieces = pa.array(sorted(known, key=known.get), pa.large_binary())
        for batch in batches:
            for part in slices(batch, ROWS, column="known"):
                ids, places = filled(part, known)
                raw = memoryview(ids.astype("<u4")).cast("B")
                columns = [
                    part.column("doc_id"),
                    pa.array(np.diff(places), pa.int64()),
                    pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(places[:-1].tolist(), places[1:].tolist())], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded(ids, places, pieces)], pa.string()),
                ] + ([pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(ids, pa.int32()))] if keep_ids else [])
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    cut = in_batches(docs).select("doc_id", words(F.col("text"), spark, pattern).alias("words"))
    open_ = cut.mapInArrow(look_up, "doc_id long, known binary, missing array<string>")
    short = lambda w: F.octet_length(w) <= LONG
    folded = F.transform("missing", lambda w: F.when(short(w), fold(w, maps)))
    told = open_.select("doc_id", "known", folded.alias("folded"), F.filter("missing", lambda w: ~short(w)).alias("long"))
    return told.mapInArrow(assemble, schema)


def op11_byte_bpe(spark, sf_dir):
    return encode_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
