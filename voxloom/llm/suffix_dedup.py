"""Removal of long repeated byte strings with a logarithmic family of suffix arrays.

Any SPAN-byte string holds an anchor: the place of the smallest K-byte hash among its K-byte strings. Equal strings
have equal anchors. The strings around an anchor fall into PARTS by how far it is from their start; those of a part
share their middle bytes (the core), so only parts whose core occurs twice can hold a repeated string. Parts whose
whole neighbourhood (all their SPAN-byte strings) occurs twice are settled by that; of the others the neighbourhoods
go, by core, to shards that hold suffix arrays. There each new batch gets a suffix array, is merge-scanned against
the existing levels for strings of SPAN common bytes, and levels of like size merge.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, forget, give_back, id_filter, in_batches, passes, slices, written

SPAN, K = 200, 32
LEFT = SPAN - K  # bytes before an anchor that a string around it can start
PARTS = 2
#: The least and the most bytes from the start of a part's strings to their anchor.
LEAST = [(LEFT + 1) * p // PARTS for p in range(PARTS)]
MOST = [x - 1 for x in LEAST[1:]] + [LEFT]
ROWS = 256
#: Bytes of neighbourhoods that get a suffix array of their own, and bytes a shard is meant for.
BATCH_BYTES, SHARD_BYTES = 1 << 20, 8 << 20
#: Cores with more neighbourhoods than this are compared by windows over all tasks, not in one shard.
SHARED_BY = 50_000
BASE = 0x9E3779B97F4A7C15
U = np.uint64


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse, modulo 2 ** 64."""
    inverse = pow(BASE, -1, 1 << 64)
    out = []
    for b in (BASE, inverse):
        p = np.full(n, b, dtype=U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of each `width` neighbours, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = pick(x[: len(x) - step], x[step:])
        done += step
    return x


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, place, part, core hash and neighbourhood hash of every part with strings of every anchor."""
    at_least = [i for i, t in enumerate(texts) if len(t) >= SPAN]
    if not at_least:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none
    sizes = np.array([len(texts[i]) for i in at_least])
    flat = np.frombuffer(b"".join(texts[i] for i in at_least), dtype=np.uint8)
    n = len(flat)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    text = np.repeat(np.arange(len(sizes)), sizes)
    power, inverse = powers(n + 1)
    total = np.concatenate([np.zeros(1, dtype=U), np.cumsum((flat.astype(U) + U(1)) * power[:n], dtype=U)])
    left_over = ends[text] - np.arange(n)  # bytes to the end of the text
    grams = mix((total[K:] - total[: n - K + 1]) * inverse[: n - K + 1])
    grams[left_over[: n - K + 1] < K] = ~U(0)
    least = sliding(grams, SPAN - K + 1, np.minimum)
    least[left_over[: len(least)] < SPAN] = 0
    pad = np.zeros(SPAN - K, dtype=U)
    most = sliding(np.concatenate([pad, least, pad]), SPAN - K + 1, np.maximum)
    at = np.flatnonzero(grams == most[: len(grams)])
    found = []
    for part, (least_to, most_to) in enumerate(zip(LEAST, MOST)):
        low, high = np.maximum(starts[text[at]], at - most_to), np.minimum(ends[text[at]], at + SPAN - least_to)
        some = high - low >= SPAN
        low, high, place = low[some], high[some], at[some]
        owner, first = text[place], place - least_to
        core = mix(mix((total[place + SPAN - most_to] - total[first]) * inverse[first]) ^ U(part + 1))
        around = mix(mix((total[high] - total[low]) * inverse[low]) ^ ((place - low) * 1024 + (high - low)).astype(U))
        found.append((np.array(at_least)[owner], place - starts[owner], np.full(len(place), part), core.astype(np.int64), around.astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found))


def utf8(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def found_anchors(docs: DataFrame) -> DataFrame:
    """A row for each part of an anchor (core, around, key, pos, part), and one without core for each document."""
    names = ["key", "doc_id", "n_bytes", "sha256", "core", "around", "pos", "part"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int8()]

    def run(batches):
        for batch in batches:
            for part in slices(batch, ROWS):
                texts = utf8(part.column("text").to_pylist())
                keys, n = part.column("key").to_numpy(), part.num_rows
                head = [part.column("key"), part.column("doc_id").cast(pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
                yield pa.RecordBatch.from_arrays(head + [pa.nulls(n, t) for t in types[4:]], names=names)
                text, pos, side, core, around = anchors(texts)
                if len(text):
                    empty = [pa.nulls(len(text), t) for t in types[1:4]]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[text]), *empty, pa.array(core), pa.array(around), pa.array(pos.astype(np.int32)), pa.array(side.astype(np.int8))], names=names)

    schema = "key long, doc_id long, n_bytes long, sha256 string, core long, around long, pos int, part byte"
    return docs.mapInArrow(run, schema)


def in_filter(df: DataFrame, column: str, bits: np.ndarray) -> DataFrame:
    """The rows whose value may be in the filter."""
    sent = df.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(passes(sent.value, batch.column(column).to_numpy())))

    return df.mapInArrow(run, df.schema)


class Level:
    """A suffix array: the string starts of some neighbourhoods, sorted by the names of their SPAN-byte strings.

    The order is that of 64-bit names, not of letters: equal strings stand together either way. keys are the sorted
    names, items and places the neighbourhood and the start of each.
    """

    def __init__(self, keys: np.ndarray, items: np.ndarray, places: np.ndarray):
        self.keys, self.items, self.places = keys, items, places

    @classmethod
    def of(cls, texts: list[bytes], items: np.ndarray, lefts: np.ndarray) -> Level:
        """The suffix array of a batch.

        Neighbourhoods of one text overlap, so a string's name holds how far its anchor is from its start: the same
        string of a text never meets itself through two anchors, and any two equal strings still meet.
        """
        sizes = np.array([len(t) for t in texts])
        flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
        n = len(flat)
        power, inverse = powers(n + 1)
        total = np.concatenate([np.zeros(1, dtype=U), np.cumsum((flat.astype(U) + U(1)) * power[:n], dtype=U)])
        number = np.maximum(sizes - SPAN + 1, 0)
        owner = np.repeat(np.arange(len(texts)), number)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
        at = np.repeat(np.cumsum(sizes) - sizes, number) + place
        name = mix((total[at + SPAN] - total[at]) * inverse[at])
        keys = mix(name ^ (lefts[owner] - place).astype(U) * U(BASE))
        order = np.argsort(keys)
        return cls(keys[order], items.astype(np.int32)[owner[order]], place[order].astype(np.int16))

    def merged(self, other: Level) -> Level:
        """Both arrays as one, by a merge of sorted runs."""
        theirs = np.searchsorted(self.keys, other.keys)
        theirs += np.arange(len(theirs))
        ours = np.ones(len(self.keys) + len(other.keys), dtype=bool)
        ours[theirs] = False

        def both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            out = np.empty(len(ours), dtype=a.dtype)
            out[ours], out[theirs] = a, b
            return out

        return Level(both(self.keys, other.keys), both(self.items, other.items), both(self.places, other.places))


class SuffixLevels:
    """Suffix arrays of sizes that grow geometrically, and the repeated strings found so far.

    first[i] and last[i]: the smallest and the largest start of a repeated SPAN-byte string in item i; -1: none.
    """

    def __init__(self):
        self.levels: list[Level] = []
        self.first = np.zeros(0, dtype=np.int64)
        self.last = np.zeros(0, dtype=np.int64)

    def add(self, texts: list[bytes], lefts: np.ndarray) -> None:
        """Sort a batch, scan it against every level, and merge it with the levels that are no larger."""
        known = len(self.first)
        self.first = np.append(self.first, np.full(len(texts), SPAN * 8))
        self.last = np.append(self.last, np.full(len(texts), -1))
        carry = Level.of(texts, np.arange(known, known + len(texts)), lefts)
        same = np.append(carry.keys[1:] == carry.keys[:-1], False)
        self.note(carry, same | np.append(False, same[:-1]))
        for level in self.levels:
            self.scan(carry, level)
        for level in sorted(self.levels, key=lambda x: len(x.keys)):
            if len(level.keys) <= len(carry.keys):
                self.levels.remove(level)
                carry = level.merged(carry)
        self.levels.append(carry)

    def scan(self, a: Level, b: Level) -> None:
        """Walk two sorted arrays together and note the strings that both hold."""
        if len(a.keys) and len(b.keys):
            at = np.minimum(np.searchsorted(b.keys, a.keys), len(b.keys) - 1)
            hit = b.keys[at] == a.keys
            self.note(a, hit)
            shared = np.unique(at[hit])  # where b's run of each common name begins
            edge = np.zeros(len(b.keys) + 1, dtype=np.int8)
            edge[shared] += 1
            np.subtract.at(edge, np.searchsorted(b.keys, b.keys[shared], side="right"), 1)
            self.note(b, np.cumsum(edge[:-1], dtype=np.int8) > 0)

    def note(self, level: Level, hit: np.ndarray) -> None:
        np.minimum.at(self.first, level.items[hit], level.places[hit])
        np.maximum.at(self.last, level.items[hit], level.places[hit])


def resolve(open_items: DataFrame, shards: int) -> DataFrame:
    """(key, low, high): what repeated strings cover of each neighbourhood."""
    names = ["key", "low", "high"]

    def run(batches):
        index, items, texts, total = SuffixLevels(), [], [], 0

        def flush():
            nonlocal texts, total
            if texts:
                index.add(texts, np.array([pos - start for _, pos, start, _ in items[len(items) - len(texts) :]]))
            texts, total = [], 0

        for batch in batches:
            for part in slices(batch, ROWS * 16, column="bytes"):
                for key, pos, start, wanted, around in zip(*(part.column(c).to_pylist() for c in ("key", "pos", "start", "open", "bytes"))):
                    items.append((key, pos, start, wanted))
                    texts.append(around)
                    total += len(around)
                    if total >= BATCH_BYTES:
                        flush()
        flush()
        rows = [(items[i][0], items[i][2] + index.first[i], items[i][2] + index.last[i] + SPAN) for i in np.flatnonzero(index.last >= 0) if items[i][3]]
        del index, items
        give_back()
        types = (pa.int64(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, types)], names=names)

    return open_items.repartition(shards, "core").select("key", "pos", "start", "open", "bytes").mapInArrow(run, "key long, low int, high int")


def resolve_by_windows(open_items: DataFrame) -> DataFrame:
    """As resolve, for cores that too many texts share: every string is counted by its digest over all tasks."""
    windows = open_items.select("key", "pos", "start", "open", "bytes", F.explode(F.sequence(F.lit(0), F.length("bytes") - SPAN)).alias("low"))
    place = F.col("pos") - F.col("start") - F.col("low")  # as in Level.of
    string = F.md5(F.substring("bytes", F.col("low") + 1, F.lit(SPAN)))
    windows = windows.select("key", "start", "open", (F.col("start") + F.col("low")).alias("low"), F.concat_ws(":", string, place).alias("window"))
    repeated = windows.groupBy("window").count().filter("count > 1").select("window")
    hits = windows.filter("open").join(repeated, "window", "left_semi")
    return hits.groupBy("key", "start").agg(F.min("low").alias("low"), (F.max("low") + SPAN).alias("high")).drop("start")


def start_of() -> Column:
    """Where the neighbourhood of an anchor's part starts, by pos and part."""
    return F.greatest(F.lit(0), F.col("pos") - F.element_at(F.array(*map(F.lit, MOST)), F.col("part") + 1))


def end_of() -> Column:
    """Where it ends, if the text does not end before."""
    return F.col("pos") + SPAN - F.element_at(F.array(*map(F.lit, LEAST)), F.col("part") + 1)


def neighbourhoods(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """core, key, pos, start, open and bytes for the wanted (key, pos, part, core, open)."""
    place = F.struct("pos", start_of().alias("start"), end_of().alias("end"), "core", "open")
    listed = wanted.groupBy("key").agg(F.collect_list(place).alias("places"))  # at most a text's length
    texts = in_filter(docs.select("key", "text"), "key", id_filter(listed, "key")).dropDuplicates(["key"])

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, ROWS)):
            rows = []
            for key, text, places in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "places"))):
                raw = (text or "").encode("utf-8", "surrogatepass")
                for p in places:
                    rows.append((p["core"], key, p["pos"], p["start"], p["open"], raw[p["start"] : p["end"]]))
                    if len(rows) == 10_000:
                        yield packed(rows)
                        rows = []
            if rows:
                yield packed(rows)

    def packed(rows):
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["core", "key", "pos", "start", "open", "bytes"])

    return texts.join(listed, "key").mapInArrow(run, "core long, key long, pos int, start int, open boolean, bytes binary")


def cut_out(docs: DataFrame, spans: DataFrame, keep_text: bool) -> DataFrame:
    """key, n_removed, n_spans and kept_sha256 (and the kept bytes) of the documents that lose bytes."""
    listed = spans.groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    texts = in_filter(docs.select("key", "text"), "key", id_filter(listed, "key")).dropDuplicates(["key"])
    names = ["key", "n_removed", "n_spans", "kept_sha256"] + ["kept_bytes"] * keep_text

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, ROWS)):
            rows = []
            for key, text, cuts in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "spans"))):
                raw = (text or "").encode("utf-8", "surrogatepass")
                kept, at, removed, runs = [], 0, 0, 0
                for low, high in sorted((s["low"], min(s["high"], len(raw))) for s in cuts):
                    if low > at or not runs:
                        kept.append(raw[at:low])
                        runs += 1
                        at = low
                    removed += max(0, high - at)
                    at = max(at, high)
                kept = b"".join([*kept, raw[at:]])
                rows.append((key, removed, runs, hashlib.sha256(kept).hexdigest()) + (kept,) * keep_text)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))], names=names)

    return texts.join(listed, "key").mapInArrow(run, "key long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * keep_text)


def remove_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """Per row of docs: n_bytes, n_removed, n_spans and kept_sha256 (and kept_bytes of changed rows with keep_text).

    Every byte goes that a SPAN-byte string covers which also starts elsewhere in the table, in the same text too;
    strings are judged on the input. Null and texts shorter than SPAN lose nothing. Repeated rows repeat each
    other's strings, so they lose all of these, each as often as given; null doc_ids come back as null. An empty
    table gives no rows; extra columns are ignored.
    """
    docs = in_batches(docs).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    found = written(found_anchors(docs))
    every = found.filter("core IS NOT NULL").select("core", "around", "key", "pos", "part")
    twice = written(every.groupBy("core").count().filter("count > 1").select("core"))
    near = written(in_filter(every, "core", id_filter(twice, "core")))
    kinds = near.groupBy("core", "around").agg(F.count("*").alias("n"), F.min(F.struct("key", "pos", "part")).alias("one"))
    cores = kinds.groupBy("core").agg(F.sum("n").alias("all"), F.sum((F.col("n") == 1).cast("long")).alias("open"), F.count("*").alias("kinds"))
    told = written(kinds.join(cores.filter("all > 1"), "core"))
    settled = near.join(told.filter("n > 1").select("core", "around"), ["core", "around"], "left_semi")
    wanted = told.filter("open > 0 AND kinds > 1").select("one.key", "one.pos", "one.part", "core", (F.col("n") == 1).alias("open"), "kinds")
    crowded = wanted.filter(F.col("kinds") > SHARED_BY).select("core").distinct()
    asked = wanted.drop("kinds")
    many = crowded.limit(1).count() > 0
    some = asked.join(crowded, "core", "left_anti") if many else asked
    solved = resolve(neighbourhoods(docs, some), some.count() * (SPAN + LEFT // PARTS) // SHARD_BYTES + 1)
    if many:
        solved = solved.unionByName(resolve_by_windows(neighbourhoods(docs, asked.join(crowded, "core", "left_semi"))))
    spans = written(settled.select("key", start_of().alias("low"), end_of().alias("high")).unionByName(solved))
    forget(twice, near, told)
    changed = cut_out(docs, spans, keep_text)
    rows = found.filter("core IS NULL").select("key", "doc_id", "n_bytes", "sha256")
    zero = F.lit(0).cast("long")
    return rows.join(changed, "key", "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"),
        *(["kept_bytes"] if keep_text else []),
    )


def op2_suffix_dedup(spark, sf_dir):
    return remove_repeats(documents(spark, sf_dir))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS x FROM documents),
w AS (SELECT doc_id, i, md5(x[i + 1 : i + 200]) AS k FROM (SELECT doc_id, x, unnest(range(0, octet_length(x) - 199)) AS i FROM d)),
dup AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
f AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM w SEMI JOIN dup USING (k)),
g AS (SELECT doc_id, i, sum(CASE WHEN step <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM f),
r AS (SELECT doc_id, min(i) AS lo, max(i) + 200 AS hi FROM g GROUP BY doc_id, run),
c AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM r),
k AS (SELECT doc_id, sum(hi - lo) AS removed, count(*) AS spans, string_agg(hex(x[before + 1 : lo]), '' ORDER BY lo) AS kept, max(hi) AS last FROM c JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, octet_length(x) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(CASE WHEN removed IS NULL THEN x ELSE unhex(kept || hex(x[last + 1 :])) END) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
