"""Voice similarity, matching against registered voices, and joining of speakers that are one person."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..config import EngineConfig
from ..functions.assign import assign, assign_listed
from ..functions.vectors import normalise


def centroids(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """The mean of the unit vectors per key, scaled to unit length."""
    unit = vectors.select(*keys, F.posexplode(normalise(F.col("embedding"))).alias("pos", "x"))
    means = unit.groupBy(*keys, "pos").agg(F.avg("x").alias("x"))
    listed = means.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("centroid"))
    return listed.withColumn("centroid", normalise(F.col("centroid")))


#: Vectors of one side that are scored against as many of the other at once.
BLOCK = 1024


def _cosines(a: list, b: list) -> np.ndarray:
    """Cosines of all of a with all of b; -1 where the lengths differ or a vector is null or zero."""
    grid = np.full((len(a), len(b)), -1.0)
    long_a, long_b = (np.array([0 if v is None else len(v) for v in side]) for side in (a, b))
    for n in set(long_a[long_a > 0]) & set(long_b[long_b > 0]):
        i, j = np.flatnonzero(long_a == n), np.flatnonzero(long_b == n)
        x, y = (np.array([side[k] for k in at], dtype=float) for side, at in ((a, i), (b, j)))
        norms = np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))
        grid[np.ix_(i, j)] = np.where(norms > 0, x @ y.T / np.where(norms > 0, norms, 1.0), -1.0)
    return grid


def best_scores(probes: DataFrame, profiles: DataFrame, probe_keys: list[str], profile_key: str, most: int, keep: str | None = None) -> DataFrame:
    """score for each probe and profile: the mean of the (at most `most`) best cosines with the profile's vectors.

    Both sides are dealt into blocks whose number follows from their sizes, a profile's vectors into one block, and
    each block of probes meets each block of profiles in a task of its own as a matrix product. Probe keys name one row
    each; a profile has a bounded number of vectors (retain). keep names a column of probes: only so many of a probe's
    best profiles leave a task, and of those of all tasks again only so many stay.
    """
    blocks, shards = (max(1, -(-side.count() // BLOCK)) for side in (probes, profiles))
    dealt = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    limit = F.col(keep).cast("long") if keep else F.lit(1 << 62)
    left = probes.select(*probe_keys, F.col("embedding").alias("_a"), limit.alias("_keep"), dealt(blocks, *probe_keys, "embedding").alias("_block"), every(shards).alias("_shard"))
    right = profiles.select(F.col(profile_key).alias("_profile"), F.col("embedding").alias("_b"), every(blocks).alias("_block"), dealt(shards, profile_key).alias("_shard"))

    def run(l: pa.Table, r: pa.Table) -> pa.Table:
        names = [*probe_keys, "_keep", profile_key, "score"]
        if not l.num_rows or not r.num_rows:  # a block of one side that no other meets
            return pa.table({c: pa.array([], pa.null()) for c in names}).cast(empty)
        grid = _cosines(l["_a"].to_pylist(), r["_b"].to_pylist())
        named = r["_profile"].combine_chunks().dictionary_encode(null_encoding="encode")
        code, n = named.indices.to_numpy(), len(named.dictionary)
        score = np.stack([np.sort(grid[:, code == c], axis=1)[:, -most:].mean(axis=1) for c in range(n)], axis=1)
        place = np.empty_like(score, dtype=np.int64)  # of each profile among those of the probe
        np.put_along_axis(place, np.argsort(-score, axis=1, kind="stable"), np.arange(n)[None, :], axis=1)
        row, profile = np.nonzero(place < l["_keep"].to_numpy()[:, None])
        return pa.table([l[k].take(row) for k in (*probe_keys, "_keep")] + [named.dictionary.take(profile), score[row, profile]], names=names)

    kinds = dict(probes.dtypes) | {profile_key: dict(profiles.dtypes)[profile_key], "_keep": "long"}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*probe_keys, "_keep", profile_key)) + ", score double"
    empty = to_arrow_schema(StructType.fromDDL(schema))
    found = left.groupBy("_block", "_shard").cogroup(right.groupBy("_block", "_shard")).applyInArrow(run, schema)
    if keep:
        w = Window.partitionBy(*probe_keys).orderBy(F.desc("score"), profile_key)
        found = found.withColumn("_n", F.row_number().over(w)).filter("_n <= _keep")
    return found.select(*probe_keys, profile_key, "score")


def candidates(labels: DataFrame, profiles: DataFrame, profile_key: str = "profile", rec: str = "rec_id") -> DataFrame:
    """(rec, label, speech_sec, profile, score): each label's best profiles, as many as its recording has labels, two at least.

    labels: rec, label, speech_sec, embedding. A best one-to-one assignment exists among these: where a label is given
    a profile beyond them, one of its own is free. A label without any profile to go with has one row with nulls.
    """
    many = F.greatest(F.count("*").over(Window.partitionBy(rec)), F.lit(2))
    wanted = labels.withColumn("_many", many)
    best = best_scores(wanted, profiles, [rec, "label"], profile_key, 2, "_many").withColumnRenamed(profile_key, "profile")
    return labels.select(rec, "label", "speech_sec").join(best, [rec, "label"], "left")


def top2_scores(probes: DataFrame, profiles: DataFrame, probe_keys: list[str], profile_key: str) -> DataFrame:
    """The mean of the two best cosines of each probe with each profile (one if it has one vector)."""
    return best_scores(probes, profiles, probe_keys, profile_key, 2)


def similarities(probes: DataFrame, speakers: DataFrame, probe_keys: list[str], speaker_key: str) -> DataFrame:
    """The larger of the best cosine with a speaker's vectors and the cosine with their centroid."""
    single = best_scores(probes, speakers, probe_keys, speaker_key, 1).withColumnRenamed("score", "best")
    middle = centroids(speakers, [speaker_key]).withColumnRenamed("centroid", "embedding")
    whole = best_scores(probes, middle, probe_keys, speaker_key, 1).withColumnRenamed("score", "to_centroid")
    return single.join(whole, [*probe_keys, speaker_key]).select(*probe_keys, speaker_key, F.greatest("best", "to_centroid").alias("similarity"))


def decisions(scores: DataFrame, rec: str, label: str, profile: str, threshold: float, margin: float) -> DataFrame:
    """matched and reason for assigned rows (score, runner_up): threshold first, then the margin to the runner-up.

    A column `short`, where there is one, says whose speech was too short for any match.
    """
    low = F.col("score") < threshold
    close = (F.col("runner_up") > 0) & (F.col("score") - F.col("runner_up") < margin)
    short = F.col("short") if "short" in scores.columns else F.lit(False)
    reason = F.when(short, "too_short").when(low, "below_threshold").when(close, "too_close").otherwise("")
    return scores.select(rec, label, profile, "score", "runner_up", (reason == "").alias("matched"), reason.alias("reason"))


def match(scores: DataFrame, cfg: EngineConfig = EngineConfig(), rec: str = "rec_id") -> DataFrame:
    """One-to-one matches of a recording's labels to profiles from (rec, label, speech_sec, profile, score).

    scores hold all profiles or each label's best ones, as `candidates` gives them. Labels with too little speech score
    -1 throughout. The assignment has the largest total; threshold and margin come after it, so a rejected pair still
    holds its profile, but only a matched one is shown. Labels left over score 0, without a reason unless their speech
    was too short. A row with a null profile stands for a label that has no profile to go with.
    """
    every = scores.select(rec, "label", (F.col("speech_sec") < cfg.min_speech_sec).alias("short")).groupBy(rec, "label").agg(F.max("short").alias("short"))
    scores = scores.filter("profile IS NOT NULL")
    gated = scores.withColumn("score", F.when(F.col("speech_sec") < cfg.min_speech_sec, F.lit(-1.0)).otherwise(F.col("score")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        listed = {label: dict(zip(g["profile"], g["score"])) for label, g in pdf.sort_values(["label", "profile"]).groupby("label", sort=True)}
        out = []
        for (label, found), profile in zip(listed.items(), assign_listed(list(listed.values()))):
            others = [s for p, s in found.items() if p != profile]
            told = (profile, found[profile], max(others, default=0.0)) if profile is not None else (None, 0.0, 0.0)
            out.append((pdf[rec].iloc[0], label, *told))
        return pd.DataFrame(out, columns=[rec, "label", "profile", "score", "runner_up"]).astype({"profile": object})

    kinds = dict(scores.dtypes)
    schema = f"{rec} {kinds[rec]}, label {kinds['label']}, profile {kinds['profile']}, score double, runner_up double"
    assigned = gated.select(rec, "label", "profile", "score").groupBy(rec).applyInPandas(run, schema)
    whole = every.join(assigned, [rec, "label"], "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("score", "runner_up")})
    told = decisions(whole, rec, "label", "profile", cfg.match_threshold, cfg.match_margin)
    alone = F.col("profile").isNull()
    reason = F.when(alone & (F.col("reason") != "too_short"), "").otherwise(F.col("reason"))
    told = told.withColumn("matched", F.col("matched") & ~alone).withColumn("reason", reason)
    return told.withColumn("profile", F.when(F.col("matched"), F.col("profile")))


def _unit(v) -> np.ndarray:
    x = np.asarray(v, dtype=float)
    n = np.linalg.norm(x)
    return x / n if n else x


class Stitcher:
    """The speakers of a recording so far: their unit vectors, one for each chunk that a voice was heard in, and seconds."""

    def __init__(self, threshold: float, vectors: list[list[np.ndarray]] | None = None, seconds: list[float] | None = None):
        self.threshold, self.vectors, self.seconds = threshold, vectors or [], seconds or []

    def add(self, labels: list[tuple[str, object, float]]) -> list[tuple[str, str, float | None]]:
        """(label, speaker, score) for the labels (label, embedding, seconds) of the next chunk.

        Labels with a voice are assigned to the speakers so far with the largest total similarity and taken if it
        reaches the threshold; all others are new speakers, numbered by label, those with a voice first.
        """
        has = lambda e: e is not None and len(e) > 0
        rows = sorted(labels, key=lambda r: (not has(r[1]), r[0]))
        probes = [_unit(e) for _, e, _ in rows if has(e)]
        known = [s for s, v in enumerate(self.vectors) if v]
        grid = np.full((len(probes), len(known)), -1.0)
        for b, s in enumerate(known):
            each = np.array(self.vectors[s])
            for a, probe in enumerate(probes):
                grid[a, b] = max((each @ probe).max(), float(_unit(each.mean(axis=0)) @ probe))
        taken = {a: (known[b], float(grid[a, b])) for a, b in assign(grid) if grid[a, b] >= self.threshold}
        out = []
        for i, (label, _, seconds) in enumerate(rows):
            s, score = taken.get(i, (len(self.vectors), None))
            if score is None:
                self.vectors.append([])
                self.seconds.append(0.0)
            if i < len(probes):
                self.vectors[s].append(probes[i])
            self.seconds[s] += seconds
            out.append((label, f"SPEAKER_{s:02d}", score))
        return out

    def voices(self) -> list[tuple[str, list[float] | None, float]]:
        """(speaker, unit mean of the vectors, seconds) of all speakers."""
        mean = lambda v: _unit(np.mean(v, axis=0)).tolist() if v else None
        return [(f"SPEAKER_{s:02d}", mean(v), t) for s, (v, t) in enumerate(zip(self.vectors, self.seconds))]


def seconds_of(value) -> float:
    """Seconds of speech; null and NaN are none."""
    return 0.0 if value is None or value != value else float(value)


def stitch(parts: DataFrame, cfg: EngineConfig = EngineConfig(), rec: str = "rec_id") -> DataFrame:
    """speaker and score for each (rec, chunk_idx, label): labels of successive chunks joined by voice (Stitcher).

    parts: rec, chunk_idx, ord, label, embedding, speech_sec. score is how alike a label is to the speaker it was joined
    to, and null where it is a new one.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        stitcher, out = Stitcher(cfg.stitch_threshold), []
        for chunk_idx, chunk in pdf.groupby("chunk_idx", sort=True):
            labels = [(r.label, r.embedding, seconds_of(r.speech_sec)) for r in chunk.itertuples()]
            out += [(pdf[rec].iloc[0], chunk_idx, *x) for x in stitcher.add(labels)]
        return pd.DataFrame(out, columns=[rec, "chunk_idx", "label", "speaker", "score"])

    kinds = dict(parts.dtypes)
    schema = f"{rec} {kinds[rec]}, chunk_idx {kinds['chunk_idx']}, label {kinds['label']}, speaker string, score double"
    return parts.select(rec, "chunk_idx", "ord", "label", "embedding", "speech_sec").groupBy(rec).applyInPandas(run, schema)


def merged_voices(parts: DataFrame, mapping: DataFrame, rec: str = "rec_id") -> DataFrame:
    """(rec, speaker, embedding, speech_sec) of the speakers that chunks were stitched to.

    parts: rec, chunk_idx, label, embedding, speech_sec; mapping: rec, chunk_idx, label, speaker. The embedding is the
    unit mean of the unit vectors, null for a speaker without a voice; null seconds are none.
    """
    named = mapping.select(rec, "chunk_idx", "label", "speaker").join(parts.select(rec, "chunk_idx", "label", "embedding", "speech_sec"), [rec, "chunk_idx", "label"], "left")
    seconds = named.groupBy(rec, "speaker").agg(F.sum(F.coalesce("speech_sec", F.lit(0.0))).alias("speech_sec"))
    middle = centroids(named.filter("size(embedding) > 0"), [rec, "speaker"]).withColumnRenamed("centroid", "embedding")
    return seconds.join(middle, [rec, "speaker"], "left").select(rec, "speaker", "embedding", "speech_sec")


def stitch_notes(mapping: DataFrame, rec: str = "rec_id") -> DataFrame:
    """(rec, chunks, speakers, joined, sample): how a recording was stitched, with its first three joins as text."""
    joined = F.col("score").isNotNull()
    note = F.format_string("chunk %d: %s is %s (%.2f)", (F.col("chunk_idx") + 1).cast("int"), "label", "speaker", F.bround("score", 2))
    ranked = mapping.withColumn("_k", F.when(joined, F.row_number().over(Window.partitionBy(rec, joined).orderBy("chunk_idx", "label"))))
    first = F.sort_array(F.collect_list(F.when(F.col("_k") <= 3, F.struct("_k", note.alias("t")))))
    told = ranked.groupBy(rec).agg(
        F.count_distinct("chunk_idx").alias("chunks"), F.count_distinct("speaker").alias("speakers"), F.count_if(joined).alias("joined"), first.alias("first")
    )
    more = F.when(F.col("joined") > 3, F.concat(F.lit(" and "), (F.col("joined") - 3).cast("string"), F.lit(" more"))).otherwise("")
    return told.select(rec, "chunks", "speakers", "joined", F.concat(F.array_join(F.transform("first", lambda x: x["t"]), ", "), more).alias("sample"))


def collapse(voices: DataFrame, apart: DataFrame, cfg: EngineConfig = EngineConfig(), rec: str = "rec_id") -> DataFrame:
    """root for each (rec, label): the most alike speakers merge, pair by pair, while alike enough.

    voices: rec, label, embedding, speech_sec; apart: rec, a, b that speak at once and never merge, nor what is
    merged into them. Of equal pairs the first by label merges; the smaller label stays, with a centroid weighted
    by speech. A threshold of 0 or less merges nothing. step and score tell when and how alike a label was merged;
    labels that stay have nulls there, and the embedding and seconds that they have in the end.
    """
    listed = apart.groupBy(rec).agg(F.collect_set(F.array(F.least("a", "b"), F.greatest("a", "b"))).alias("apart"))
    joined = voices.join(listed, rec, "left").select(rec, "label", "embedding", "speech_sec", "apart")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("label")
        has_voice = pdf["embedding"].map(lambda v: v is not None and len(v) > 0)
        root = dict(zip(pdf["label"], pdf["label"]))
        seconds = dict(zip(pdf["label"], map(seconds_of, pdf["speech_sec"])))
        voiced = pdf[has_voice]
        names = list(voiced["label"])
        vectors = np.array([_unit(v) for v in voiced["embedding"]])
        merged: dict[str, tuple[int, float]] = {}
        if cfg.merge_threshold > 0 and len(names) > 1:
            place = {x: i for i, x in enumerate(names)}
            barred = np.eye(len(names), dtype=bool)
            for x, y in pdf["apart"].iloc[0] if pdf["apart"].iloc[0] is not None else []:
                if x in place and y in place:
                    barred[place[x], place[y]] = barred[place[y], place[x]] = True
            alike = np.where(barred, -np.inf, vectors @ vectors.T)
            while True:
                upper = np.where(np.triu(np.ones_like(barred), 1), alike, -np.inf)
                i, j = divmod(int(upper.argmax()), len(names))
                if not upper[i, j] >= cfg.merge_threshold:
                    break
                keeper, gone = names[i], names[j]
                merged[gone] = (len(merged) + 1, float(upper[i, j]))
                share = np.maximum([seconds[keeper], seconds[gone]], 1e-6)
                vectors[i] = _unit(share @ vectors[[i, j]])
                seconds[keeper] += seconds.pop(gone)
                barred[i] |= barred[j]
                barred[j] = True
                barred |= barred.T
                fresh = np.where(barred[i], -np.inf, vectors @ vectors[i])
                alike[i], alike[:, i], alike[j], alike[:, j] = fresh, fresh, -np.inf, -np.inf
                root = {x: keeper if r == gone else r for x, r in root.items()}
        left = {x: v.tolist() for x, v in zip(names, vectors) if x not in merged}
        rows = [(pdf[rec].iloc[0], x, root[x], *merged.get(x, (None, None)), left.get(x), seconds.get(x)) for x in pdf["label"]]
        return pd.DataFrame(rows, columns=[rec, "label", "root", "step", "score", "embedding", "speech_sec"])

    kinds = dict(voices.dtypes)
    schema = f"{rec} {kinds[rec]}, label {kinds['label']}, root {kinds['label']}, step int, score double, embedding array<double>, speech_sec double"
    return joined.groupBy(rec).applyInPandas(run, schema)


def single_speaker(labels: DataFrame, rec: str = "rec_id") -> DataFrame:
    """(rec, label): the label with most speech, or where it has no voice, the first label that has one.

    Labels (rec, label, speech_sec, embedding) are in their own order; of equal seconds the first label counts. A null
    speech_sec is no speech. Recordings without any voice have no row.
    """
    voice = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    most = F.min(F.when(F.col("speech_sec").isNotNull(), F.struct((-F.col("speech_sec")).alias("less"), "label", voice.alias("voice"))))
    told = labels.groupBy(rec).agg(most.alias("most"), F.min(F.when(voice, F.col("label"))).alias("first"))
    chosen = F.when(F.col("most.voice"), F.col("most.label")).otherwise(F.col("first"))
    return told.filter("first IS NOT NULL").select(rec, chosen.alias("label"))
