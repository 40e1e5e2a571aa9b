"""Language-model scores: context-tree weighting over bytes, beside a smoothed word model.

Each byte is eight binary decisions. Every context of 0 to DEPTH earlier bytes has Krichevsky-Trofimov estimates
for the decisions, and context-tree weighting mixes the estimates of all depths. Counts cover all training
documents and the tree has every context that occurs: it is a set of tables, one a depth, with a row for each
context and decision. They are summed up from depth to depth and mixed on the way back, which gives each string
of DEPTH + 1 bytes its cost; texts meet the costs in a join. The costs of the most frequent strings are also sent
to all tasks, which spares most rows of that join and changes no score.
"""

from __future__ import annotations

from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, in_batches, slices, written

DEPTH = 5
#: Strings whose costs are sent to all tasks, and the slots of the table in which a task finds them.
SHORTCUT, SLOT_BITS, PROBES = 1 << 20, 22, 4
#: A byte that no UTF-8 text holds stands before and after each text.
EDGE = 0xFF
#: Words whose counts are sent to all tasks: the most frequent ones of at most FREQUENT_BYTES bytes.
FREQUENT, FREQUENT_BYTES = 1 << 17, 32
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
END = b""  # the end token: no word is empty
ROWS = 256
MERGE_AT = 1 << 21


def lowered(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass").translate(LOWER) for t in texts]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts, each after DEPTH edge bytes and before one, and the places of what is predicted."""
    edge = bytes([EDGE])
    flat = np.frombuffer(b"".join(edge * DEPTH + t + edge for t in texts), dtype=np.uint8)
    inside = np.ones(len(flat), dtype=bool)
    starts = np.cumsum([0] + [len(t) + DEPTH + 1 for t in texts[:-1]])
    inside[(starts[:, None] + np.arange(DEPTH)).ravel()] = False
    return flat, np.flatnonzero(inside)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
    return grams[first], np.add.reduceat(counts, first)


def grams_at(flat: np.ndarray, places: np.ndarray) -> np.ndarray:
    """DEPTH + 1 bytes that end at each place, the last byte lowest."""
    wide = flat.astype(np.int64)
    gram = wide[places]
    for k in range(1, DEPTH + 1):
        gram = gram | (wide[places - k] << (8 * k))
    return gram


def training_counts(docs: DataFrame) -> DataFrame:
    """Counts (word, null, n) for tokens and (null, gram, n) for DEPTH + 1 bytes.

    Rows with held_out, where docs has that column, teach nothing: their grams are there, with n = 0 if no other
    row has them.
    """

    def run(batches):
        words: Counter = Counter()
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def out(word, gram, n):
            return pa.RecordBatch.from_arrays([pa.array(word, pa.binary()), pa.array(gram, pa.int64()), pa.array(n, pa.int64())], names=["word", "gram", "n"])

        for batch in batches:
            for part in slices(batch, ROWS):
                texts = lowered(part.column("text").to_pylist())
                held = part.column("held_out").to_pylist()
                teach = [t for t, out_ in zip(texts, held) if not out_]
                for t in teach:
                    words.update(t.split())
                words[END] += len(teach)
                if teach:
                    parts.append(np.unique(grams_at(*joined(teach)), return_counts=True))
                if len(teach) < len(texts):
                    gram = np.unique(grams_at(*joined([t for t, out_ in zip(texts, held) if out_])))
                    parts.append((gram, np.zeros(len(gram), dtype=np.int64)))
                if sum(len(g) for g, _ in parts) > MERGE_AT:
                    parts = [merged(parts)]
                    if len(parts[0][0]) > MERGE_AT // 2:
                        yield out([None] * len(parts[0][0]), *parts.pop())
                if len(words) > MERGE_AT // 4:
                    yield out(list(words.keys()), [None] * len(words), list(words.values()))
                    words.clear()
        if parts:
            gram, n = merged(parts)
            yield out([None] * len(gram), gram, n)
        words = +words  # without words that were not counted
        yield out(list(words.keys()), [None] * len(words), list(words.values()))

    held_out = F.col("held_out") if "held_out" in docs.columns else F.lit(False)
    partial = docs.select("text", held_out.alias("held_out")).mapInArrow(run, "word binary, gram long, n long")
    return written(partial.groupBy("word", "gram").agg(F.sum("n").alias("n")))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Log of the gamma function for positive x, by Stirling's series after a shift by 8."""
    product = np.ones_like(x)
    for k in range(8):
        product *= x + k
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(product)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of any sequence with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - np.log(np.pi) - log_gamma(zeros + ones + 1.0)


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The estimate that the next bit is one."""
    return (ones + 0.5) / (zeros + ones + 1.0)


def most_frequent(df: DataFrame, count: str, n: int) -> DataFrame:
    """The rows with the largest counts, n at most: as many whole eighths of an octave of counts as fit.

    Only the sizes of these classes (a few hundred rows) come to the driver, and nothing is sorted.
    """
    octave = F.floor(8 * F.log2(count))
    lowest, total = None, 0
    for r in sorted(df.groupBy(octave.alias("octave")).count().collect(), key=lambda r: -r["octave"]):
        total += r["count"]
        if total > n:
            break
        lowest = r["octave"]
    return df.limit(0) if lowest is None else df.filter(octave >= lowest)


def mask(depth: int) -> int:
    """The bits of a node name (context << 8 | node) that name the same decision after so many bytes of context."""
    return (1 << 8 * (depth + 1)) - 1


def whole_contexts(batches):
    """Tables of batches that come sorted by context, cut only where the context changes.

    A context of DEPTH - 1 bytes has 256 * 256 strings and 255 nodes at most, so a table is bounded.
    """
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        context = rest.column("context").to_numpy()
        cut = int(np.searchsorted(context, context[-1]))
        if cut:
            yield rest.slice(0, cut)
            rest = rest.slice(cut)
    if rest is not None:
        yield rest


def deepest_nodes(gram: np.ndarray, n: np.ndarray):
    """Names of the nodes after DEPTH bytes, for each gram the places of its eight nodes and its bits there, and the
    zeros and ones of each node."""
    k, byte = np.arange(8), (gram & 0xFF)[:, None]
    node = (gram & ~0xFF)[:, None] | (1 << k) | (byte >> (8 - k))
    bit = byte >> (7 - k) & 1
    names, at = np.unique(node.ravel(), return_inverse=True)
    ones = np.bincount(at, (bit * n[:, None]).ravel(), len(names))
    both = np.bincount(at, np.repeat(n, 8), len(names))
    return names, at.reshape(-1, 8), bit, both - ones, ones


NODES = "node long, zeros double, ones double, total double, stop double"


def node_rows(node, zeros, ones, longer) -> pa.RecordBatch:
    """Rows of NODES: total is the log of the weighted probability, longer the sum of the totals one byte deeper."""
    own = log_kt(zeros, ones)
    total = np.logaddexp(own, longer) - np.log(2)
    stop = np.exp(np.minimum(own - np.log(2) - total, 0))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (node, zeros, ones, total, stop)], names=["node", "zeros", "ones", "total", "stop"])


def gram_costs(grams: DataFrame) -> DataFrame:
    """gram, n and the log10 of the probability of its last byte after the others, with all contexts in the tree.

    A decision without counts has probability one half at every depth, and log weight 0: grams with n = 0 get their
    costs and change no other's.
    """

    def above(batches):
        for t in whole_contexts(batches):
            names, _, _, zeros, ones = deepest_nodes(t.column("gram").to_numpy(), t.column("n").to_numpy())
            up, at = np.unique(names & mask(DEPTH - 1), return_inverse=True)
            yield node_rows(up, *(np.bincount(at, x, len(up)) for x in (zeros, ones, log_kt(zeros, ones))))

    def weigh(batches):
        for b in batches:
            yield node_rows(*(b.column(c).to_numpy() for c in ("node", "zeros", "ones", "total")))

    def finish(batches):
        for t in whole_contexts(batches):
            node = t.filter(pc.is_valid(t.column("node")))
            gram = t.filter(pc.is_valid(t.column("gram")))
            order = np.argsort(node.column("node").to_numpy())
            up, mixed, left = (node.column(c).to_numpy()[order] for c in ("node", "mixed", "left"))
            g, n = gram.column("gram").to_numpy(), gram.column("n").to_numpy()
            names, at, bit, zeros, ones = deepest_nodes(g, n)
            parent = np.searchsorted(up, names & mask(DEPTH - 1))
            one = mixed[parent] + left[parent] * kt(zeros, ones)
            cost = np.log10(np.where(bit == 1, one[at], 1 - one[at])).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n), pa.array(cost)], names=["gram", "n", "cost"])

    def by_context(df: DataFrame) -> DataFrame:
        return df.repartition("context").sortWithinPartitions("context")

    latest = F.shiftright("gram", 8).bitwiseAND(mask(DEPTH - 2)).alias("context")
    levels = {DEPTH - 1: written(by_context(grams.select(latest, "gram", "n")).mapInArrow(above, NODES))}
    for depth in range(DEPTH - 2, -1, -1):
        shorter = levels[depth + 1].groupBy(F.col("node").bitwiseAND(mask(depth)).alias("node"))
        sums = shorter.agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "total")])
        levels[depth] = written(sums.mapInArrow(weigh, NODES))
    one = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1)
    walked = levels[0].select("node", (F.col("stop") * one).alias("mixed"), (1 - F.col("stop")).alias("left"))
    for depth in range(1, DEPTH):
        up = walked.withColumnRenamed("node", "up")
        rows = levels[depth].withColumn("up", F.col("node").bitwiseAND(mask(depth - 1))).join(up, "up")
        mixed = F.col("mixed") + F.col("left") * F.col("stop") * one
        walked = rows.select("node", mixed.alias("mixed"), (F.col("left") * (1 - F.col("stop"))).alias("left"))
    nothing = F.lit(None)
    nodes = walked.select(
        F.shiftright("node", 8).alias("context"), "node", "mixed", "left", nothing.cast("long").alias("gram"), nothing.cast("long").alias("n")
    )
    strings = grams.select(
        latest, nothing.cast("long").alias("node"), nothing.cast("double").alias("mixed"), nothing.cast("double").alias("left"), "gram", "n"
    )
    return written(by_context(nodes.unionByName(strings)).mapInArrow(finish, "gram long, n long, cost double"))


class Shortcut:
    """Costs of some grams, found by hash; a gram that gets no slot is left to the join."""

    def __init__(self, grams: np.ndarray, costs: np.ndarray):
        self.grams = np.full(1 << SLOT_BITS, -1, dtype=np.int64)
        self.costs = np.zeros(1 << SLOT_BITS)
        slot = self.slots(grams)
        for _ in range(PROBES):
            free = np.flatnonzero(self.grams[slot] < 0)
            self.grams[slot[free]] = grams[free]
            self.costs[slot[free]] = costs[free]  # of grams with one slot the last stays, here and above
            lost = self.grams[slot] != grams
            grams, costs, slot = grams[lost], costs[lost], (slot[lost] + 1) & ((1 << SLOT_BITS) - 1)

    @staticmethod
    def slots(grams: np.ndarray) -> np.ndarray:
        return ((grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def get(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cost of each gram, 0 where it is not here, and the places of those that are not."""
        slot = self.slots(grams)
        found = self.grams[slot] == grams
        out = np.where(found, self.costs[slot], 0.0)
        away = np.flatnonzero(~found)
        slot = slot[away]
        for _ in range(PROBES - 1):
            slot = (slot + 1) & ((1 << SLOT_BITS) - 1)
            found = self.grams[slot] == grams[away]
            out[away[found]] = self.costs[slot[found]]
            away, slot = away[~found], slot[~found]
        return out, away


def text_costs(shortcut: Shortcut, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The cost of each text's grams that the shortcut has; text, gram and number of those that it has not."""
    grams = grams_at(*joined(texts))
    sizes = [len(t) + 1 for t in texts]
    cost, away = shortcut.get(grams)
    total = np.add.reduceat(cost, np.cumsum([0] + sizes[:-1]))
    row = np.repeat(np.arange(len(texts)), sizes)[away]
    pairs, n = np.unique(row << (8 * (DEPTH + 1)) | grams[away], return_counts=True)
    return total, pairs >> (8 * (DEPTH + 1)), pairs & mask(DEPTH), n


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """Word-model and context-tree scores of every row of docs, learnt from the rows that are not held out.

    Null and empty texts are the end token alone. Repeated rows teach as often as given and come back as given; a
    null held_out counts as false. With no training row all bytes are equally likely and each token has
    probability 1. An empty table gives no rows; extra columns are ignored.
    """
    docs = in_batches(docs).select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = training_counts(docs)
    words = counts.filter("word IS NOT NULL").select("word", F.col("n").alias("c"))
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    floor = total + 0.1 * (distinct + 1)
    often = most_frequent(words.filter(F.length("word") <= FREQUENT_BYTES), "c", FREQUENT).toArrow()  # as columns: rows would take many times the memory
    frequent = {w: log10((c + 0.1) / floor) for w, c in zip(often.column("word").to_pylist(), often.column("c").to_pylist())}
    costs = gram_costs(counts.filter("gram IS NOT NULL").select("gram", "n"))
    top = most_frequent(costs.filter("n > 0"), "n", SHORTCUT).select("gram", "cost").toArrow()
    sent = docs.sparkSession.sparkContext.broadcast((frequent, top.column("gram").to_numpy(), top.column("cost").to_numpy()))
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "word", "gram", "n"]
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, word binary, gram long, n long"

    def run(batches):
        known, *common = sent.value
        shortcut = Shortcut(*common)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, ROWS):
                texts = lowered(part.column("text").to_pylist())
                docs_out, rare = [], []
                for t in texts:
                    tokens = Counter(t.split())
                    tokens[END] = 1
                    seen, base = 0, 0.0
                    for w, n in tokens.items():
                        value = known.get(w)
                        if value is None:
                            rare.append((row, w, n))
                        else:
                            seen += n
                            base += n * value
                    docs_out.append((row, sum(tokens.values()), seen, base))
                    row += 1
                rows, n_tokens, n_known, base_score = zip(*docs_out)
                n = len(rows)
                cost, at, gram, times = text_costs(shortcut, texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows, pa.int64()), part.column("doc_id").cast(pa.int64()), part.column("held_out"),
                        pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base_score, pa.float64()),
                        pa.array(cost), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
                    ],
                    names=names,
                )
                empty = lambda size: [pa.nulls(size, t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows[0] + at), *empty(len(at)), pa.nulls(len(at), pa.binary()), pa.array(gram), pa.array(times)], names=names
                    )
                if rare:
                    rows, w, n = zip(*rare)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows, pa.int64()), *empty(len(rows)), pa.array(w, pa.binary()), pa.nulls(len(rows), pa.int64()), pa.array(n, pa.int64())],
                        names=names,
                    )

    scored = written(docs.mapInArrow(run, schema))
    # Words outside the table of frequent ones get their counts by a join on the word.
    rare = (
        scored.filter("word IS NOT NULL")
        .select("row", "word", "n")
        .join(words, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("rare_known"),
            F.sum(F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(floor))).alias("rare_score"),
        )
    )
    # And so do grams outside the shortcut their costs.
    other = (
        scored.filter("gram IS NOT NULL")
        .select("row", "gram", F.col("n").alias("times"))
        .join(costs, "gram")
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.col("cost")).alias("other_score"))
    )
    return (
        scored.filter("word IS NULL AND gram IS NULL")
        .drop("word", "gram", "n")
        .join(rare, "row", "left")
        .join(other, "row", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
            F.lit(total).cast("long").alias("train_tokens"),
            (F.col("base_score") + F.coalesce("rare_score", F.lit(0.0))).alias("base_score"),
            (F.col("score") + F.coalesce("other_score", F.lit(0.0))).alias("score"),
        )
    )


def op6_lm_scoring(spark, sf_dir):
    return score(documents(spark, sf_dir), F.crc32(F.col("doc_id").cast("string")) % 10 == 0)
