"""Exact n-gram Jaccard join of documents, using relations between sets to skip work.

Documents with the same shingle set are one node. Inverted lists hold each node under the rarest shingles of its set
(prefix filter). Answers come first for a central set of each list: sets that link with it are one component and need
no comparison among themselves, and what two sets share with the same central set bounds what they share with each
other. The lists of what is left are cut into blocks by size and position, and only blocks meet that sizes and
positions allow: entries far back in a list never meet each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, forget, id_filter, in_batches, passes, slices, written
from .components import components
from .shingles import U, mix, shingle_sets

#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Shingles with at least 1 / HOT of all are ordered by frequency, after the others: at most HOT of them.
HOT = 1 << 22
ROWS = 256
#: Distinct shingles of a task that are counted at once.
COUNTED = 1 << 19
#: Entries that are made at once.
ENTRIES = 1 << 17
#: Lists of a node that look for its central set: so many of the shortest and so many of the longest.
ASKED = 2
#: Longer lists are cut into blocks by size and position.
LONG_LIST = 128
#: 64-bit words of the sketch that goes with every list entry. Sets of up to SMALL elements have parities of their
#: elements there, which never rule out a link. Larger ones have a bit of the smallest hash in each of 256 parts of
#: the hash range: linked sets differ in 32 of these bits on average, and in more than DIFFER with a chance of 4e-20.
SKETCH, SMALL, DIFFER = 4, 256, 88
#: Entries of the same set before each entry that go with it, so that a pair is made where it first meets.
BEFORE = 3
MARKS = (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)


def lengths(text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Set sizes and where each set starts."""
    size = np.bincount(text, minlength=n)
    return size, np.cumsum(size) - size


def set_names(hashed: np.ndarray, size: np.ndarray, start: np.ndarray, mark: int) -> np.ndarray:
    """64-bit names of whole sets; 0 for the empty set. Another mark gives other names."""
    total = np.concatenate([np.zeros(1, dtype=U), np.cumsum(mix(hashed ^ U(mark)), dtype=U)])
    return np.where(size > 0, mix((total[start + size] - total[start]) + size.astype(U)) | U(1), U(0)).astype(np.int64)


def squeezed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens and the sums of their counts."""
    token, seen = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(token, kind="stable")
    token, seen = token[order], seen[order]
    first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    return token[first], np.add.reduceat(seen, first)


def described(docs: DataFrame) -> DataFrame:
    """A row for each document (key, doc_id, n, name, second), and rows (token, seen) for shingles frequent in a task.

    name and second are two 64-bit names of the set. A shingle that makes up 1 / HOT of all makes up as much of some
    task's, so none of these is missed.
    """
    names = ["key", "doc_id", "n", "name", "second", "token", "seen"]

    def run(batches):
        tokens, total = [], 0
        for batch in batches:
            for part in slices(batch, ROWS):
                text, hashed = shingle_sets(part.column("text").to_pylist())
                size, start = lengths(text, part.num_rows)
                both = [pa.array(set_names(hashed, size, start, m)) for m in MARKS]
                empty = [pa.nulls(part.num_rows, pa.int64())] * 2
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("doc_id").cast(pa.int64()), pa.array(size.astype(np.int64)), *both, *empty], names=names)
                total += len(hashed)
                if len(hashed):
                    tokens.append(np.unique(hashed, return_counts=True))
                if sum(len(t) for t, _ in tokens) > COUNTED:
                    token, seen = squeezed(tokens)
                    often = seen > max(1, total // HOT // 4)
                    tokens = [(token[often], seen[often])]
        if tokens:
            token, seen = squeezed(tokens)
            often = seen >= max(2, total // HOT)
            empty = [pa.nulls(int(often.sum()), pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([*empty, pa.array(token[often].astype(np.int64)), pa.array(seen[often].astype(np.int64))], names=names)

    return docs.mapInArrow(run, "key long, doc_id long, n long, name long, second long, token long, seen long")


def clashing_names(names: DataFrame) -> list[int]:
    """The names that stand for more than one set: hardly any, however many sets there are."""
    ends = names.groupBy("name").agg(F.min("second").alias("a"), F.max("second").alias("b"))
    return [r[0] for r in ends.filter("a <> b").collect()]


def renamed(df: DataFrame, clashes: list[int]) -> DataFrame:
    """df (name, second, ...) with one name for each set: where names clash, both are hashed to another."""
    if not clashes:
        return df.drop("second")
    return df.withColumn("name", F.when(F.col("name").isin(clashes), F.xxhash64("name", "second")).otherwise(F.col("name"))).drop("second")


def parities(hashed: np.ndarray, n: int) -> np.ndarray:
    """A bitmap with the parity of the elements at each place; its length is the power of two from 2 * n up."""
    width = max(64 * SKETCH, 1 << int(2 * n - 1).bit_length())
    odd = np.bincount((hashed & U(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def least_bits(text: np.ndarray, hashed: np.ndarray, n: int) -> np.ndarray:
    """A bit of the smallest hash of each text in each part of the hash range; hashes rise within a text."""
    parts = 64 * SKETCH
    cell = text * parts + (hashed >> U(64 - int(parts).bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, dtype=np.int64)
    bit = np.zeros(n * parts, dtype=np.uint8)
    bit[cell[first]] = (hashed[first] >> U(20)).astype(np.uint8) & 1
    return np.packbits(bit.reshape(n, parts), axis=1).view(np.int64)


def prefix_sets(docs: DataFrame, hot: np.ndarray, nodes: np.ndarray) -> DataFrame:
    """(name, second, n, tokens, bits, sketch) of rows that pass the filter of nodes: tokens are the set's prefix."""
    sent = docs.sparkSession.sparkContext.broadcast((hot, nodes))
    names = ["name", "second", "n", "tokens", "bits", "sketch"]
    many = pa.list_(pa.int64())

    def run(batches):
        often, keep = sent.value
        seen: set[int] = set()
        for batch in batches:
            batch = batch.filter(pa.array(passes(keep, batch.column("key").to_numpy())))
            for part in slices(batch, ROWS):
                text, hashed = shingle_sets(part.column("text").to_pylist())
                size, start = lengths(text, part.num_rows)
                name, second = (set_names(hashed, size, start, m) for m in MARKS)
                # A set once a task where that is easily told; what is left of repeats is harmless.
                fresh = np.zeros(part.num_rows, dtype=bool)
                for i, pair in enumerate(zip(name.tolist(), second.tolist())):
                    fresh[i] = size[i] > 0 and pair not in seen
                    seen.add(pair)
                if len(seen) > COUNTED:
                    seen.clear()
                # The global order: others by hash, then the frequent ones by rising frequency.
                rank = np.zeros(len(hashed), dtype=np.int64)
                if len(often):
                    slot = np.minimum(np.searchsorted(often["token"], hashed), len(often) - 1)
                    rank = np.where(often["token"][slot] == hashed, often["rank"][slot], 0)
                ordered = hashed[np.lexsort((hashed, rank, text))]
                prefix = size - -(-PERCENT * size // 100) + 1
                some = np.flatnonzero(fresh)
                tokens = [ordered[start[i] : start[i] + prefix[i]].astype(np.int64) for i in some]
                bits = [parities(hashed[start[i] : start[i] + size[i]], int(size[i])) for i in some]
                least = least_bits(text, hashed, part.num_rows)
                sketch = [np.bitwise_xor.reduce(b.reshape(-1, SKETCH), axis=0) if size[i] <= SMALL else least[i] for i, b in zip(some, bits)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name[some]), pa.array(second[some]), pa.array(size[some].astype(np.int64)), pa.array(tokens, many), pa.array(bits, many), pa.array(sketch, many)],
                    names=names,
                )

    return docs.select("key", "text").mapInArrow(run, "name long, second long, n long, tokens array<long>, bits array<long>, sketch array<long>")


def entries(sets: DataFrame, listed: np.ndarray, carried: list[str]) -> DataFrame:
    """(token, pos and the carried columns) for the tokens of each set that pass the filter.

    Carried columns before0, before1, ... are made here: the tokens of the set's entries before each, or null.
    """
    sent = sets.sparkSession.sparkContext.broadcast(listed)
    kinds = dict(sets.dtypes) | {f"before{k}": "bigint" for k in range(BEFORE)}

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 1 << 16, ENTRIES, "tokens")):
            tokens = batch.column("tokens")
            flat = tokens.flatten().to_numpy()
            long = tokens.value_lengths().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), long)
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(long) - long, long)
            keep = np.flatnonzero(passes(sent.value, flat))
            if "places" in batch.schema.names:
                pos = batch.column("places").flatten().to_numpy()
            flat, row, pos = flat[keep], row[keep], pos[keep]
            columns = [pa.array(flat), pa.array(pos.astype(np.int64))]
            for c in carried:
                if c.startswith("before"):
                    k = int(c[6:]) + 1
                    earlier = np.concatenate([np.zeros(min(k, len(flat)), dtype=np.int64), flat[:-k]])
                    other = np.append(np.full(min(k, len(row)), -1), row[:-k]) != row
                    columns.append(pa.array(earlier, mask=other))
                else:
                    columns.append(batch.column(c).take(pa.array(row)))
            yield pa.RecordBatch.from_arrays(columns, names=["token", "pos", *carried])

    return sets.mapInArrow(run, "token long, pos long" + "".join(f", {c} {kinds[c]}" for c in carried))


def memberships(sets: DataFrame, shared: DataFrame) -> DataFrame:
    """A row for each node in a list: name, n, central (mean length of its lists), tokens, places and counts."""
    met = entries(sets.select("name", "n", "tokens"), id_filter(shared, "token"), ["name", "n"]).join(shared, "token")
    once = met.groupBy("token", "name").agg(F.min("pos").alias("pos"), F.min("n").alias("n"), F.max("seen").alias("seen"))
    items = F.sort_array(F.collect_list(F.struct("pos", "token", "seen")))  # as long as the prefix at most
    rows = once.groupBy("name").agg(F.min("n").alias("n"), F.sum("seen").alias("all"), items.alias("items"))
    prefix = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1
    return rows.select(
        "name", "n", (F.col("all") / prefix).alias("central"), F.col("items.token").alias("tokens"), F.col("items.pos").alias("places"), F.col("items.seen").alias("counts")
    )


def size_block(n: str) -> Column:
    """Sets that can link are in the same or in neighbouring blocks."""
    return F.floor(F.log(n) / float(np.log(100 / PERCENT)) + 1e-9).cast("int")


def size_fits(a: str, b: str) -> Column:
    """Whether sets of these sizes can link: 100 * smaller >= PERCENT * larger."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def enough(shared: Column, n_a: str, n_b: str) -> Column:
    """Whether so many shared elements make a link."""
    return (100 + PERCENT) * shared >= PERCENT * (F.col(n_a) + F.col(n_b))


def central_pairs(members: DataFrame) -> DataFrame:
    """For each node the central set of the lists it asks that it meets most often."""
    by = lambda sign: F.slice(F.array_sort(F.transform(F.arrays_zip("tokens", "counts"), lambda x: F.struct((sign * x["counts"]).alias("k"), x["tokens"].alias("t")))), 1, ASKED)
    asked = F.array_distinct(F.concat(F.transform(by(1), lambda x: x["t"]), F.transform(by(-1), lambda x: x["t"])))
    probes = members.select("name", "n", "central", size_block("n").alias("block"), F.explode(asked).alias("token"))
    merit = F.col("central").cast("decimal(20,3)") * 1_000_000 + F.pmod("name", F.lit(1_000_000))  # ties by name
    centre = probes.groupBy("token", "block").agg(F.max_by("name", merit.cast("double")).alias("centre"), F.max_by("n", merit.cast("double")).alias("n_c"), F.max("central").alias("c"), F.count("*").alias("many"))
    met = probes.join(centre.filter("many > 1"), ["token", "block"]).filter((F.col("name") != F.col("centre")) & size_fits("n", "n_c"))
    votes = met.groupBy("name", "centre").agg((F.count("*") * 1_000_000 + F.least(F.max("c"), F.lit(999_999.0))).alias("votes"))
    best = votes.groupBy("name").agg(F.max_by("centre", "votes").alias("centre"))
    return best.select(F.least("name", "centre").alias("a"), F.greatest("name", "centre").alias("b")).distinct()


def bits_fit(n_a: str, n_b: str, bits_a: str, bits_b: str) -> Column:
    """Whether bitmaps leave open that two sets link: |A xor B| is at least the number of bits that differ.

    Sets that can link differ by one doubling in bitmap length at most; the longer one then folds onto the shorter.
    """

    def folded(x):
        half = (F.size(x) / 2).cast("int")
        return F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))

    def differ(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda acc, k: acc + k)

    x, y = F.col(bits_a), F.col(bits_b)
    apart = F.when(F.size(x) == F.size(y), differ(x, y)).when(F.size(x) > F.size(y), differ(folded(x), y)).otherwise(differ(x, folded(y)))
    return enough(F.floor((F.col(n_a) + F.col(n_b) - apart) / 2), n_a, n_b)


def left_open(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that bitmaps of the whole sets do not rule out."""
    pairs = written(pairs)
    names = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    some = sets.select("name", "n", "bits").join(names, "name", "left_semi").dropDuplicates(["name"])
    one = some.select(F.col("name").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    two = some.select(F.col("name").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    return pairs.join(one, "a").join(two, "b").filter(bits_fit("n_a", "n_b", "bits_a", "bits_b")).select("a", "b")


def node_sets(docs: DataFrame, wanted: DataFrame, clashes: list[int]) -> DataFrame:
    """(name, tokens): the whole sets of the wanted nodes (name, key)."""
    sent = docs.sparkSession.sparkContext.broadcast(id_filter(wanted, "key"))

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(passes(sent.value, batch.column("key").to_numpy())))
            for part in slices(batch, ROWS):
                text, hashed = shingle_sets(part.column("text").to_pylist())
                size, start = lengths(text, part.num_rows)
                both = [pa.array(set_names(hashed, size, start, m)) for m in MARKS]
                tokens = pa.ListArray.from_arrays(pa.array(np.append(start, len(hashed)).astype(np.int32)), pa.array(hashed.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*both, tokens], names=["name", "second", "tokens"])

    found = renamed(docs.select("key", "text").mapInArrow(run, "name long, second long, tokens array<long>"), clashes)
    return found.join(wanted.select("name"), "name", "left_semi").dropDuplicates(["name"])


def compare(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, clashes: list[int]) -> DataFrame:
    """(a, b, n_a, n_b, shared, linked) for pairs, from whole sets."""
    asked = written(pairs)
    names = asked.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    wanted = written(nodes.join(names, "name", "left_semi"))
    sets = written(node_sets(docs, wanted, clashes))
    one = sets.select(F.col("name").alias("a"), F.col("tokens").alias("of_a"))
    two = sets.select(F.col("name").alias("b"), F.col("tokens").alias("of_b"))
    met = asked.join(one, "a").join(two, "b")
    counted = met.select("a", "b", F.size("of_a").alias("n_a"), F.size("of_b").alias("n_b"), F.size(F.array_intersect("of_a", "of_b")).alias("shared"))
    out = written(counted.withColumn("linked", enough(F.col("shared"), "n_a", "n_b")))
    forget(asked, wanted, sets)
    return out


def cross_pairs(members: DataFrame, sets: DataFrame, found: DataFrame) -> DataFrame:
    """All pairs of a list that are in different components, unless block, size, position or sketch rule them out.

    In a list the largest component's nodes meet the others, not each other.
    """
    sizes = found.groupBy("component").agg(F.count("*").alias("many"))
    known = found.join(sizes, "component").select(F.col("node").alias("name"), "component", "many")
    sketches = sets.select("name", *[F.col("sketch")[k].alias(f"s{k}") for k in range(SKETCH)]).dropDuplicates(["name"])
    placed = members.join(known, "name", "left").withColumns({"component": F.coalesce("component", "name"), "many": F.coalesce("many", F.lit(1))})
    placed = written(placed.join(sketches, "name").drop("central", "counts"))
    rows = placed.select("component", "many", F.explode("tokens").alias("token"))
    mixed = rows.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max_by("component", "many").alias("main"), F.count("*").alias("length"))
    mixed = written(mixed.filter("low <> high").select("token", "main", "length"))
    earlier = [f"before{k}" for k in range(BEFORE)]
    carried = ["name", "n", "component", *[f"s{k}" for k in range(SKETCH)], *earlier]
    some = entries(placed.drop("many"), id_filter(mixed, "token"), carried).join(mixed, "token")
    far = 7 * F.col("pos") > F.col("n")  # 7 * (pos_a + pos_b) <= n_a + n_b for the first shingle that a pair shares
    long = F.col("length") > LONG_LIST
    block = size_block("n")
    right = some.withColumn("cell", F.when(long, 2 * block + far.cast("int")).otherwise(-1))
    near_cells = F.flatten(F.transform(F.array(block - 1, block, block + 1), lambda b: F.array(2 * b, 2 * b + 1)))
    far_cells = F.transform(F.array(block - 1, block, block + 1), lambda b: 2 * b)
    cells = F.when(~long, F.array(F.lit(-1))).when(far, far_cells).otherwise(near_cells)
    left = some.filter("component <> main").withColumn("cell", F.explode(cells))
    a = left.select("token", "cell", *[F.col(c).alias(f"{c}_a") for c in ("pos", *carried)])
    b = right.select("token", "cell", "main", *[F.col(c).alias(f"{c}_b") for c in ("pos", *carried)])
    apart = sum((F.bit_count(F.col(f"s{k}_a").bitwiseXOR(F.col(f"s{k}_b"))) for k in range(1, SKETCH)), F.bit_count(F.col("s0_a").bitwiseXOR(F.col("s0_b"))))
    # A shingle that both have just before says that they have met already.
    met_before = F.greatest(F.lit(False), *[F.coalesce(F.col(f"{x}_a") == F.col(f"{y}_b"), F.lit(False)) for x in earlier for y in earlier])
    met = a.join(b, ["token", "cell"]).filter(
        (F.col("component_a") != F.col("component_b"))
        & ((F.col("component_b") == F.col("main")) | (F.col("name_a") < F.col("name_b")))
        & ~met_before
        & size_fits("n_a", "n_b")
        & (7 * (F.col("pos_a") + F.col("pos_b")) <= F.col("n_a") + F.col("n_b"))
        & F.when((F.col("n_a") <= SMALL) & (F.col("n_b") <= SMALL), enough(F.floor((F.col("n_a") + F.col("n_b") - apart) / 2), "n_a", "n_b"))
        .when((F.col("n_a") > SMALL) & (F.col("n_b") > SMALL), apart <= DIFFER)
        .otherwise(True)
    )
    return met.select(F.least("name_a", "name_b").alias("a"), F.greatest("name_a", "name_b").alias("b")).distinct()


def derived(pairs: DataFrame, answers: DataFrame) -> DataFrame:
    """Pairs not compared yet that answers through a common neighbour r leave open.

    If u shares i with r and v shares j with r, they share at most min(i, j) + min(|u| - i, |v| - j).
    """
    fresh = pairs.join(answers.select("a", "b"), ["a", "b"], "left_anti")
    told = answers.select(F.col("a").alias("u"), F.col("b").alias("r"), F.col("shared").alias("i"), F.col("n_a").alias("n")).unionByName(
        answers.select(F.col("b").alias("u"), F.col("a").alias("r"), F.col("shared").alias("i"), F.col("n_b").alias("n"))
    )
    # A hub has many answers: each node tells only of the neighbour that it shares most with.
    nearest = told.groupBy("u").agg(F.max_by(F.struct("r", "i", "n"), "i").alias("x")).select("u", "x.*")
    of = lambda x: nearest.select(F.col("u").alias(x), F.col("r").alias(f"r_{x}"), F.col("i").alias(f"i_{x}"), F.col("n").alias(f"n_{x}"))
    both = fresh.join(of("a"), "a", "left").join(of("b"), "b", "left")
    most = F.least("i_a", "i_b") + F.least(F.col("n_a") - F.col("i_a"), F.col("n_b") - F.col("i_b"))
    out = F.coalesce((F.col("r_a") == F.col("r_b")) & ~enough(most, "n_a", "n_b"), F.lit(False))
    return both.filter(~out).select("a", "b")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """Per row of docs: n_shingles, component_id, component (a number, equal for linked sets; null for none) and key.

    key is xxhash64(doc_id, text).

    Two documents link when their shingle sets have a Jaccard similarity of PERCENT or more, ties included; a
    component has the smallest doc_id that links reach. Null texts and texts without a word have an empty set and
    are alone. Repeated rows have equal sets and come back as given; null doc_ids name no component unless all ids
    of it are null. An empty table gives no rows; extra columns are ignored.
    """
    docs = in_batches(docs).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    first = written(described(docs))
    told = first.filter("token IS NULL").drop("token", "seen")
    clashes = clashing_names(told)
    rows = renamed(told, clashes)
    nodes = written(rows.filter("n > 0").groupBy("name").agg(F.min("key").alias("key")))
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = first.filter("token IS NOT NULL").groupBy("token").agg(F.sum("seen").alias("seen")).filter(F.col("seen") >= max(8, total // HOT))
    often = frequent.toArrow()  # HOT rows at most
    token, seen = (often.column(c).to_numpy() for c in ("token", "seen"))
    order = np.lexsort((token, seen))
    hot = np.empty(len(token), dtype=[("token", "u8"), ("rank", "i4")])
    hot["token"], hot["rank"] = token[order].astype(U), np.arange(1, len(token) + 1)
    hot = np.sort(hot, order="token")
    sets = written(renamed(prefix_sets(docs, hot, id_filter(nodes, "key")), clashes))
    lists = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("seen"))
    shared = written(lists.filter("seen > 1"))
    members = written(memberships(sets, shared))
    forget(shared)
    answers = compare(docs, left_open(central_pairs(members), sets), nodes, clashes)
    found = written(components(answers.filter("linked")))
    rest = derived(cross_pairs(members, sets, found), answers)
    more = compare(docs, left_open(rest, sets), nodes, clashes)
    links = answers.unionByName(more).filter("linked")
    # Names get the smallest doc_id of their component before rows come in, so that no join has a hot component.
    found = components(links).withColumnRenamed("node", "name")
    ids = rows.filter("n > 0").groupBy("name").agg(F.min("doc_id").alias("least_id"))
    named = written(ids.join(found, "name", "left").withColumn("component", F.coalesce("component", "name")))
    forget(members, sets, answers, more)
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    labels = written(named.select("name", "component").join(least, "component"))
    placed = rows.join(labels, "name", "left")
    component_id = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return placed.select("doc_id", F.col("n").alias("n_shingles"), component_id.alias("component_id"), "component", "key")


def op3_jaccard_join(spark, sf_dir):
    return jaccard_components(documents(spark, sf_dir)).drop("key", "component")


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, greatest(len(w) - 4, 1) + 1)]) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT r.doc_id, b FROM reach r JOIN both_ways ON a = other)
SELECT doc_id, n AS n_shingles, min(other) AS component_id FROM reach JOIN n USING (doc_id) GROUP BY 1, 2
"""
