"""Speakers, voiceprints, jobs and settings as tables: each change gives the next version of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import count, prefixes, running


def fold(name: Column) -> Column:
    """For comparing names: ASCII letters in lower case only."""
    return F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def list_speakers(speakers: DataFrame, voiceprints: DataFrame) -> DataFrame:
    """Every speaker with the number of voiceprints and their seconds of speech."""
    sums = voiceprints.groupBy("speaker_id").agg(F.count("*").alias("n"), F.sum("speech_sec").alias("sec"))
    joined = speakers.join(sums, speakers["id"] == sums["speaker_id"], "left")
    return joined.select("id", "name", F.coalesce("n", F.lit(0)).alias("voiceprints"), F.coalesce("sec", F.lit(0.0)).alias("speech_sec"))


def retain(voiceprints: DataFrame, keep: int) -> DataFrame:
    """The newest `keep` voiceprints of each speaker."""
    w = Window.partitionBy("speaker_id").orderBy(F.desc("id"))
    return voiceprints.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= keep).drop("_n")


def profiles(speakers: DataFrame, voiceprints: DataFrame) -> DataFrame:
    """Voiceprints with the names of their speakers; where lengths differ, those of the newest one's length."""
    newest = voiceprints.groupBy("speaker_id").agg(F.max_by("dim", "id").alias("dim"))
    same = voiceprints.join(newest, ["speaker_id", "dim"])
    named = speakers.select(F.col("id").alias("speaker_id"), "name")
    return same.join(named, "speaker_id").select("speaker_id", "name", F.col("id").alias("voiceprint_id"), "dim", "embedding")


def numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """rows with dense numbers from 1 in the order of the MD5 of a key that no two rows share.

    The first three hexadecimal digits deal rows into 4,096 slots; their counts give each slot its first number.
    """
    hashed = rows.withColumn("_md5", F.md5(F.col(key).cast("binary"))).withColumn("_slot", F.conv(F.substring("_md5", 1, 3), 16, 10).cast("long"))
    return running(hashed, [], ["_slot", "_md5"], 1, {name: count()}).drop("_md5", "_slot")


def upsert_speakers(speakers: DataFrame, names: DataFrame, now: Column) -> DataFrame:
    """speakers and a new row, with the next ids, for each name that no speaker has in any case."""
    fresh = names.select(F.trim("name").alias("name")).filter("name <> ''").withColumn("_key", fold(F.col("name")))
    fresh = fresh.groupBy("_key").agg(F.min("name").alias("name"))
    fresh = fresh.join(speakers.select(fold(F.col("name")).alias("_key")).distinct(), "_key", "left_anti")
    top = speakers.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    placed = numbered(fresh, "_key", "_n").join(F.broadcast(top))  # one row
    added = placed.select((F.col("_top") + F.col("_n")).cast("long").alias("id"), "name", now.alias("created_at"), now.alias("updated_at"))
    return speakers.unionByName(added, allowMissingColumns=True)


def find_speakers(speakers: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (ask, id, name) with found_id and found_name: the speaker with the id, or else with the name in any case.

    Of several speakers of one name the first counts; who is not there has nulls.
    """
    by_id = speakers.select("id", F.struct(F.col("id").alias("i"), F.col("name").alias("n")).alias("_by_id"))
    by_name = speakers.groupBy(fold(F.trim("name")).alias("_key")).agg(F.min(F.struct(F.col("id").alias("i"), F.col("name").alias("n"))).alias("_by_name"))
    met = asked.withColumn("_key", fold(F.trim("name"))).join(by_id, "id", "left").join(by_name, "_key", "left")
    found = F.when(F.col("id").isNotNull(), F.col("_by_id")).otherwise(F.col("_by_name"))
    return met.select("ask", "id", "name", found["i"].alias("found_id"), found["n"].alias("found_name"))


def rename_speaker(speakers: DataFrame, speaker_id, name: str, now: Column) -> DataFrame:
    hit = F.col("id") == speaker_id
    return speakers.withColumns({"name": F.when(hit, F.lit(name)).otherwise(F.col("name")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))})


def rename_speakers(speakers: DataFrame, wishes: DataFrame, now: Column) -> DataFrame:
    """speakers with the names of wishes (id, name), one for an id, and when that was.

    Wishes without a name, and names that another speaker has already in any case, change nothing.
    """
    asked = wishes.select("id", F.trim("name").alias("name")).filter("name <> ''")
    fine = asked.join(rename_clash(speakers, asked).select("id"), "id", "left_anti").withColumnRenamed("name", "_new")
    met = speakers.join(fine, "id", "left")
    changed = F.col("_new").isNotNull()
    told = met.withColumns({"name": F.coalesce("_new", "name"), "updated_at": F.when(changed, now).otherwise(F.col("updated_at"))})
    return told.select(speakers.columns)


def rename_clash(speakers: DataFrame, wishes: DataFrame) -> DataFrame:
    """Wished names (id, name) that another speaker has already in any case."""
    taken = speakers.select(F.col("id").alias("_other"), fold(F.trim("name")).alias("_key"))
    met = wishes.withColumn("_key", fold(F.trim("name"))).join(taken, "_key").filter(F.col("_other") != F.col("id"))
    return met.select("id", "name").distinct()


def delete_speakers(speakers: DataFrame, voiceprints: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the speakers in gone (id)."""
    return speakers.join(gone, "id", "left_anti"), voiceprints.join(gone.select(F.col("id").alias("speaker_id")), "speaker_id", "left_anti")


def enroll(voiceprints: DataFrame, new: DataFrame, keep: int) -> DataFrame:
    """Voiceprints of the same sources are replaced, whoever had them; then each speaker keeps the newest ones."""
    others = voiceprints.join(new.select("source").distinct(), "source", "left_anti")
    return retain(others.select(voiceprints.columns).unionByName(new.select(voiceprints.columns)), keep)


def latest_jobs(events: DataFrame) -> DataFrame:
    """The last state of each job from its log (id, seq, status, ...)."""
    rest = [c for c in events.columns if c not in ("id", "seq")]
    return events.groupBy("id").agg(F.max_by(F.struct(*rest), "seq").alias("s")).select("id", *[f"s.{c}" for c in rest])


#: The states of a job before and after events, and what each action needs and makes. `stop` is a stop of the engine.
JOB_STATES = ("none", "queued", "running", "done", "error")
JOB_ACTIONS = {
    "submit": {"none": "queued"},
    "start": {"queued": "running"},
    "finish": {"running": "done"},
    "fail": {"running": "error"},
    "retry": {"done": "queued", "error": "queued"},
    "stop": {"queued": "error", "running": "error"},
}


def job_history(log: DataFrame, width: int = 4096) -> DataFrame:
    """log (id, seq, action) with before, after and outcome of each event, jobs of any length over many tasks.

    An action that the state before does not allow changes nothing: it is `active` for a job that is queued or running,
    `missing` for one that was never submitted, else `ignored`; others are `ok`. Each event is a function from states to
    states; functions compose over the events of a job (scans.prefixes), and what comes before an event applied to
    `none` is the state that it meets. seq is a number of its own for each event of a job; unknown actions change nothing.
    """
    number = {s: i for i, s in enumerate(JOB_STATES)}
    effect = {a: [float(number[moves.get(s, s)]) for s in JOB_STATES] for a, moves in JOB_ACTIONS.items()}
    as_array = lambda x: F.array(*map(F.lit, x))
    element = as_array([float(i) for i in range(len(JOB_STATES))])
    for action, to in effect.items():
        element = F.when(F.col("action") == action, as_array(to)).otherwise(element)
    before = prefixes(log.select("id", "seq", element.alias("element")), ["id"], "seq", width, lambda one, two: two[one.astype(int)])
    states = as_array(list(JOB_STATES))
    met = log.join(before, ["id", "seq"]).withColumn("_before", F.coalesce(F.get("before", F.lit(0)), F.lit(0.0)).cast("int"))
    after = F.get(element, F.col("_before")).cast("int")
    told = met.select("id", "seq", "action", F.get(states, F.col("_before")).alias("before"), F.get(states, after).alias("after"))
    outcome = (
        F.when(F.col("before") != F.col("after"), "ok")
        .when(F.col("before").isin("queued", "running"), "active")
        .when(F.col("before") == "none", "missing")
        .otherwise("ignored")
    )
    return told.withColumn("outcome", outcome)


def reset_stale(jobs: DataFrame, message: str) -> DataFrame:
    """Jobs that were queued or running when the engine stopped are errors."""
    stale = F.col("status").isin("queued", "running")
    return jobs.withColumns({"error": F.when(stale, F.lit(message)).otherwise(F.col("error")), "status": F.when(stale, "error").otherwise(F.col("status"))})


def name_taken(names: DataFrame, jobs: DataFrame) -> DataFrame:
    """The names that a queued or running job has."""
    return names.join(jobs.filter(F.col("status").isin("queued", "running")), "name", "left_semi")


def free_names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """For each wanted name the first of name, name-2, name-3, ... that is not taken."""
    w = Window.partitionBy("name").orderBy("k")
    suffix = r"^(.*?)(?:-([1-9][0-9]*))?$"
    used = taken.select(F.col("name").alias("whole")).distinct()
    as_base = used.select(F.col("whole").alias("name"), F.lit(1).alias("k"))
    as_numbered = used.select(F.regexp_extract("whole", suffix, 1).alias("name"), F.expr(f"try_cast(regexp_extract(whole, r'{suffix}', 2) AS int)").alias("k")).filter("k >= 2")
    held = as_base.unionByName(as_numbered).join(wanted.select("name").distinct(), "name", "left_semi").distinct()
    # The numbers taken without a gap from 1 on end one before the first free number.
    run = held.withColumn("n", F.row_number().over(w)).filter("k = n").groupBy("name").agg((F.max("k") + 1).alias("k"))
    found = wanted.select("name").distinct().join(run, "name", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    return found.select("name", F.when(F.col("k") == 1, F.col("name")).otherwise(F.concat("name", F.lit("-"), F.col("k").cast("string"))).alias("free"))


def upsert_settings(settings: DataFrame, changes: DataFrame) -> DataFrame:
    new = changes.select("key", F.col("value").alias("_new"))
    return settings.join(new, "key", "full_outer").select("key", F.coalesce("_new", "value").alias("value"))


def propagate_names(results: DataFrame, speakers: DataFrame) -> DataFrame:
    """Speaker entries of results (rec_id, label, speaker_id, display) with the names that speakers have now."""
    named = speakers.select(F.col("id").alias("speaker_id"), F.col("name").alias("_name"))
    joined = results.join(named, "speaker_id", "left")
    changed = F.col("_name").isNotNull() & (F.col("_name") != F.col("display"))
    return joined.select("rec_id", "label", "speaker_id", F.coalesce("_name", "display").alias("display"), changed.alias("changed"))


def changed_results(named: DataFrame) -> DataFrame:
    """(speaker_id, results): how many results the names of propagate_names change, for each speaker with a change."""
    return named.filter("changed").groupBy("speaker_id").agg(F.count_distinct("rec_id").alias("results"))


def voiceprints_by_age(voiceprints: DataFrame) -> DataFrame:
    """Voiceprints with n, their place among those of their speaker, the newest first."""
    return voiceprints.withColumn("n", F.row_number().over(Window.partitionBy("speaker_id").orderBy(F.desc("id"))).cast("long"))


def speaker_names(speakers: DataFrame) -> DataFrame:
    """The names alone, as a prompt takes them."""
    return speakers.select("name")
