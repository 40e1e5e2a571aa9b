"""Registered queries of payloads, merged chunks, notes, keys and split segments with the SQL that checks each."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxloom.config import EngineConfig
from voxloom.functions import text as names
from voxloom.operators import attach, labelling, payload, registry, scans, silence, textfilter, timeline, voices
from voxloom.plans import inputs
from voxloom.plans.catalogue import DAY, HOUR, PLAN, PRINTS, REGIONS, WORDS, _parts, _prints, _regions, _speakers, query
from voxloom.plans.inputs import TURNS, table
from voxloom.sources import results, wavespan


@query("""
WITH w AS (SELECT conv_id, turn, i, turn * 60 + i / CAST(7 AS DOUBLE) AS s, CASE WHEN (turn + i) % 4 <> 0 THEN turn * 60 + (i + 1) / CAST(7 AS DOUBLE) END AS e FROM conversations, range(0, 3) t(i)),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS word_idx FROM w WHERE e IS NOT NULL)
SELECT c.conv_id AS rec_id, c.turn AS seg_idx, CAST(c.turn * 60 AS DOUBLE) AS "start", CAST(c.turn * 60 + (c.turn % 5 + 1) * 12 AS DOUBLE) AS "end",
       CAST(word_idx AS INTEGER) AS word_idx, 'w' || i AS word, round(s, 3) AS word_start, round(e, 3) AS word_end
FROM conversations c LEFT JOIN k ON k.conv_id = c.conv_id AND k.turn = c.turn WHERE trim(c.text) <> ''""")
def payload_segments(spark, sf_dir):
    """Segments of three words, some of which have no end; one row a word that stays."""
    at = lambda i: F.col("seg_idx") * 60 + i / F.lit(7.0)
    word = lambda i: F.struct(
        F.lit(f"w{i}").alias("word"), at(F.lit(i)).alias("start"), F.when((F.col("seg_idx") + i) % 4 != 0, at(F.lit(i + 1))).alias("end"), F.col("label").alias("speaker"), F.lit(0.5).alias("score")
    )
    seg = inputs.segments(spark, sf_dir).withColumns({"speaker": F.col("label"), "words": F.array(*[word(i) for i in range(3)])})
    rows = payload.payload_segments(seg).select("rec_id", "seg_idx", "start", "end", F.posexplode_outer("words").alias("word_idx", "w"))
    return rows.select("rec_id", "seg_idx", "start", "end", "word_idx", "w.word", F.col("w.start").alias("word_start"), F.col("w.end").alias("word_end"))


@query("""
SELECT event_id, CASE WHEN event_id % 5 = 0 AND event_id % 7 > 3 THEN CAST(event_id % 7 - 3 AS BIGINT) END AS number, event_id % 5 IN (0, 4) AND NOT (event_id % 5 = 0 AND event_id % 7 = 3) AS prompt FROM events""")
def form_values(spark, sf_dir):
    """Numbers from -3 to 3 with spaces beside them, and words that say yes or no."""
    kind = F.col("event_id") % 5
    number = F.concat(F.lit(" "), (F.col("event_id") % 7 - 3).cast("string"), F.lit(" "))
    said = F.when(kind == 0, number).when(kind == 1, "Off").when(kind == 2, " FALSE").when(kind == 3, "").otherwise("yes")
    return table(spark, sf_dir, "events").select("event_id", payload.positive_int(said).alias("number"), payload.wants_prompt(said).alias("prompt"))


@query("""SELECT conv_id, turn, round(12 + 76 * CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS DOUBLE) / count(*) OVER (PARTITION BY conv_id), 6) AS percent FROM conversations""")
def progress(spark, sf_dir):
    w = Window.partitionBy("conv_id")
    nth = F.row_number().over(w.orderBy("turn")) - 1
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(payload.progress(nth, F.count("*").over(w)), 6).alias("percent"))


def _chunked(spark, sf_dir):
    t = inputs.turns(spark, sf_dir)
    return t.select("rec_id", (F.col("event_id") % 4).alias("chunk_idx"), F.col("speaker").alias("label"), "start", "end")


def _mapping(spark, sf_dir):
    """Labels of a chunk and the speakers they are, some of them the same."""
    labels = _chunked(spark, sf_dir).select("rec_id", "chunk_idx", "label").distinct()
    return labels.withColumn("speaker", F.concat(F.lit("SPEAKER_0"), ((F.length("label") + F.col("chunk_idx")) % 3).cast("string")))


CHUNKED = f"""{TURNS}, t AS (SELECT rec_id, event_id % 4 AS chunk_idx, speaker AS label, s, e, 'SPEAKER_0' || ((len(speaker) + event_id % 4) % 3) AS speaker FROM turns)"""


@query(f"""WITH {CHUNKED} SELECT rec_id, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY s, e, chunk_idx, label) - 1 AS BIGINT) AS turn_idx, speaker, s AS "start", e AS "end" FROM t""")
def merged_turns(spark, sf_dir):
    return payload.merged_turns(_chunked(spark, sf_dir), _mapping(spark, sf_dir))


@query(f"WITH {CHUNKED} SELECT rec_id, speaker, CAST(sum(e - s) AS DOUBLE) AS speech_sec FROM t GROUP BY 1, 2")
def merged_speech(spark, sf_dir):
    speech = _chunked(spark, sf_dir).groupBy("rec_id", "chunk_idx", "label").agg(F.sum(F.col("end") - F.col("start")).cast("double").alias("speech_sec"))
    return payload.merged_speech(speech, _mapping(spark, sf_dir))


@query(f"""WITH {CHUNKED}, l AS (SELECT rec_id, chunk_idx, min(label) AS a, max(label) AS b FROM t GROUP BY 1, 2 HAVING min(label) <> max(label)),
m AS (SELECT DISTINCT rec_id, chunk_idx, label, speaker FROM t)
SELECT l.rec_id, l.chunk_idx, x.speaker AS a, y.speaker AS b FROM l JOIN m x ON x.rec_id = l.rec_id AND x.chunk_idx = l.chunk_idx AND x.label = l.a
JOIN m y ON y.rec_id = l.rec_id AND y.chunk_idx = l.chunk_idx AND y.label = l.b WHERE x.speaker <> y.speaker""")
def carried_overlaps(spark, sf_dir):
    """The first and the last label of each chunk speak at once."""
    pairs = _chunked(spark, sf_dir).groupBy("rec_id", "chunk_idx").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b")
    return payload.carried_overlaps(pairs, _mapping(spark, sf_dir))


@query("""
WITH w AS (SELECT doc_id // 5 AS rec_id, doc_id % 5 AS idx, n_chars >= 200 AND n_chars % 100 >= 50 AS good FROM documents)
SELECT rec_id, idx FROM w WHERE good UNION ALL SELECT rec_id, NULL FROM w GROUP BY 1 HAVING NOT bool_or(good)""")
def usable_windows(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    windows = d.select(F.floor(F.col("doc_id") / 5).alias("rec_id"), (F.col("doc_id") % 5).alias("idx"), F.col("n_chars").alias("length"), (F.col("n_chars") % 100 / 100).alias("rms"))
    return payload.usable_windows(windows, 200, 0.5)


@query(f"""
WITH {PLAN}, n AS (SELECT rec_id, max(e0 - s0) AS longest FROM runs GROUP BY 1)
SELECT q.rec_id, CASE WHEN sp - fl < 25 THEN 'narrow_range' WHEN longest IS NULL THEN 'no_speech' WHEN longest < 4 THEN 'too_short' END AS note FROM q LEFT JOIN n USING (rec_id)""")
def plan_notes(spark, sf_dir):
    """One frame an hour, a "second" of 3600 samples: runs under four hours are too short."""
    cfg = EngineConfig(trim_min_dynamic_db=25.0, trim_min_silence_sec=12.0, trim_pad_sec=2.0, trim_min_speech_sec=4.0)
    levels = inputs.hourly_levels(spark, sf_dir)
    return silence.notes(levels, levels.select("rec_id").distinct().withColumn("total", F.lit(10**10).cast("long")), HOUR, HOUR, cfg)


@query("""SELECT page_id, sha256(concat_ws(chr(31), url, CAST(strlen(html) AS VARCHAR), CAST(page_id * 3 // 2 AS VARCHAR), '0.8', '0.25', '0.3', '0.1', '12.0', '80.0')) AS key_hash FROM pages""")
def stage_keys(spark, sf_dir):
    """Pages as sound files, changed at halves of seconds, with the settings of the silence plan."""
    parts = results.audio_key(F.col("url"), F.octet_length("html"), F.col("page_id") * 1.5) + results.trim_key(EngineConfig())
    return table(spark, sf_dir, "pages").select("page_id", results.key_hash(*parts).alias("key_hash"))


@query(f"WITH {PRINTS} SELECT id, speaker_id, source, CAST(row_number() OVER (PARTITION BY speaker_id ORDER BY id DESC) AS BIGINT) AS n FROM prints")
def voiceprints_by_age(spark, sf_dir):
    return registry.voiceprints_by_age(_prints(spark, sf_dir)).select("id", "speaker_id", "source", "n")


@query(f"WITH {PRINTS} SELECT name FROM speakers")
def speaker_names(spark, sf_dir):
    return registry.speaker_names(_speakers(spark, sf_dir))


@query(f"""
WITH {TURNS}, {WORDS},
items AS (SELECT rec_id, word_id AS seg_idx, i, ws + i * 5000 AS ws, ws + i * 5000 + 61 AS we FROM words, range(0, 3) r(i) WHERE word_id % 5 <> 0
          UNION ALL SELECT rec_id, word_id, -1, ws - 7, ws + 10100 FROM words WHERE word_id % 5 = 0),
x AS (SELECT w.rec_id, seg_idx, i, ws, we, speaker, turn_idx, least(we, e) - greatest(ws, s) AS ov, greatest(s - (ws + we) / 2.0, (ws + we) / 2.0 - e, 0) AS d
      FROM items w JOIN turns t ON w.rec_id = t.rec_id),
sp AS (SELECT rec_id, seg_idx, i, ws, we, CASE WHEN max(ov) > 0 THEN arg_max(speaker, ov * 1000000 - turn_idx) ELSE arg_min(speaker, d * 1000000 + turn_idx) END AS speaker FROM x GROUP BY 1, 2, 3, 4, 5),
f AS (SELECT *, CASE WHEN lag(speaker) OVER (PARTITION BY rec_id, seg_idx ORDER BY i) = speaker THEN 0 ELSE 1 END AS fresh FROM sp),
p AS (SELECT *, sum(fresh) OVER (PARTITION BY rec_id, seg_idx ORDER BY i) - 1 AS part_idx, sum(fresh) OVER (PARTITION BY rec_id, seg_idx) AS n FROM f),
r AS (SELECT p.rec_id, seg_idx, CAST(part_idx AS BIGINT) AS part_idx, speaker, CASE WHEN n = 1 THEN w.ws - 7 ELSE min(p.ws) END AS "start", CASE WHEN n = 1 THEN w.ws + 10100 ELSE max(p.we) END AS "end",
       CASE WHEN n = 1 THEN 'A b c.' ELSE string_agg(chr(CAST(97 + i AS INTEGER)), ' ' ORDER BY i) END AS text,
       coalesce(string_agg(chr(CAST(97 + i AS INTEGER)) || ':' || p.ws || ':' || p.we || ':' || speaker, ' ' ORDER BY i) FILTER (i >= 0), '') AS words
FROM p JOIN words w ON w.rec_id = p.rec_id AND w.word_id = seg_idx GROUP BY p.rec_id, seg_idx, part_idx, speaker, n, w.ws)
SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY "start", seg_idx, part_idx) - 1 AS place FROM r""")
def attach_segments(spark, sf_dir):
    """Segments of three words; every fifth segment's words have no times."""
    t = inputs.turns(spark, sf_dir)
    at = F.col("start") + F.pmod(F.col("event_id") * 977, F.lit(40000)) - 20000
    seg = t.select("rec_id", F.col("event_id").alias("seg_idx"), (at - 7).alias("start"), (at + 10100).alias("end"), F.lit("A b c.").alias("text"))
    nth = seg.select("rec_id", "seg_idx", (F.col("start") + 7).alias("at"), F.posexplode(F.array(*map(F.lit, "abc"))).alias("word_idx", "word"))
    begin = F.when(F.col("seg_idx") % 5 != 0, F.col("at") + F.col("word_idx") * 5000)
    words = nth.select("rec_id", "seg_idx", "word_idx", "word", begin.alias("start"), (begin + 61).alias("end"))
    shown = F.array_join(F.transform("words", lambda w: F.concat_ws(":", w["word"], w["start"], w["end"], w["speaker"])), " ")
    return attach.attach_segments(seg, words, t, HOUR).withColumn("words", shown)


@query(f"""WITH {PRINTS}, r AS (SELECT conv_id AS rec_id, role AS label, conv_id % 12 AS speaker_id, 'Person ' || (conv_id % 5) AS display FROM conversations GROUP BY 1, 2)
SELECT speaker_id, count(DISTINCT rec_id) AS results FROM r JOIN speakers s ON s.id = r.speaker_id WHERE s.name <> display GROUP BY 1""")
def changed_results(spark, sf_dir):
    """How many results a change of names would write anew."""
    r = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("rec_id"), F.col("role").alias("label"), (F.col("conv_id") % 12).alias("speaker_id"), F.concat(F.lit("Person "), (F.col("conv_id") % 5).cast("string")).alias("display")
    )
    return registry.changed_results(registry.propagate_names(r.distinct(), _speakers(spark, sf_dir)))


@query(f"""WITH {REGIONS}, t AS (SELECT DISTINCT user_id AS rec_id, 3000000000 AS total FROM events),
k AS (SELECT rec_id, min(s) AS s, max(e) AS e FROM regions WHERE rec_id % 3 <> 0 GROUP BY 1)
SELECT rec_id, coalesce(s, 0) AS "start", coalesce(e, total) AS "end" FROM t LEFT JOIN k USING (rec_id)""")
def timeline_span(spark, sf_dir):
    """Every third recording has no regions and spans its total."""
    totals = table(spark, sf_dir, "events").select(F.col("user_id").alias("rec_id")).distinct().withColumn("total", F.lit(3_000_000_000))
    return timeline.span(_regions(spark, sf_dir).filter("rec_id % 3 <> 0"), totals)


@query("""
WITH RECURSIVE e AS (SELECT user_id AS id, event_id AS seq, ['submit', 'start', 'finish', 'fail', 'retry', 'stop', 'start'][event_id * 7919 % 7 + 1] AS action,
                            row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
h(id, i, seq, action, before, after) AS (
  SELECT id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), '', '', 'none' FROM e GROUP BY 1
  UNION ALL
  SELECT e.id, e.i, e.seq, e.action, h.after, CASE
    WHEN e.action = 'submit' AND h.after = 'none' THEN 'queued' WHEN e.action = 'start' AND h.after = 'queued' THEN 'running'
    WHEN e.action = 'finish' AND h.after = 'running' THEN 'done' WHEN e.action = 'fail' AND h.after = 'running' THEN 'error'
    WHEN e.action = 'retry' AND h.after IN ('done', 'error') THEN 'queued' WHEN e.action = 'stop' AND h.after IN ('queued', 'running') THEN 'error' ELSE h.after END
  FROM h JOIN e ON e.id = h.id AND e.i = h.i + 1)
SELECT id, seq, action, before, after, CASE WHEN before <> after THEN 'ok' WHEN before IN ('queued', 'running') THEN 'active' WHEN before = 'none' THEN 'missing' ELSE 'ignored' END AS outcome
FROM h WHERE i > 0""")
def job_history(spark, sf_dir):
    """Every user's events as actions on a job, in groups of 5,000 event numbers."""
    actions = F.array(*map(F.lit, ("submit", "start", "finish", "fail", "retry", "stop", "start")))
    e = table(spark, sf_dir, "events")
    log = e.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.get(actions, (F.col("event_id") * 7919 % 7).cast("int")).alias("action"))
    return registry.job_history(log, 5000)


VOICED = """p AS (SELECT vec_id // 20 AS rec_id, vec_id // 5 % 4 AS chunk_idx, 'S' || (vec_id % 5) AS label, CASE WHEN vec_id % 11 <> 0 THEN CAST(embedding AS DOUBLE[]) END AS v, vec_id % 7 + 1 AS sec,
              'SPEAKER_0' || ((vec_id % 5 + vec_id // 5 % 4) % 3) AS speaker FROM embeddings)"""


def _stitched(spark, sf_dir):
    """Labels of chunks with the speakers that they were stitched to, and scores for some."""
    nth = F.substring("label", 2, 1).cast("int")
    parts = _parts(spark, sf_dir)
    speaker = F.concat(F.lit("SPEAKER_0"), ((nth + F.col("chunk_idx")) % 3).cast("string"))
    score = F.when((F.col("chunk_idx") > 0) & (nth != 2), (nth + 1) / 8.0)
    return parts, parts.select("rec_id", "chunk_idx", "label", speaker.alias("speaker"), score.alias("score"))


@query(f"""
WITH {VOICED}, u AS (SELECT rec_id, speaker, unnest(range(0, 64)) AS pos, unnest([x / sqrt(list_dot_product(v, v)) FOR x IN v]) AS x FROM p WHERE v IS NOT NULL),
m AS (SELECT rec_id, speaker, pos, avg(x) AS x FROM u GROUP BY 1, 2, 3), n AS (SELECT rec_id, speaker, sqrt(sum(x * x)) AS n FROM m GROUP BY 1, 2),
s AS (SELECT rec_id, speaker, CAST(sum(sec) AS DOUBLE) AS speech_sec FROM p GROUP BY 1, 2)
SELECT s.rec_id, s.speaker, speech_sec, CAST(m.pos AS INTEGER) AS pos, round(m.x / n.n, 6) AS x FROM s LEFT JOIN m USING (rec_id, speaker) LEFT JOIN n USING (rec_id, speaker)""")
def merged_voices(spark, sf_dir):
    """One row for each number of a speaker's embedding."""
    found = voices.merged_voices(*_stitched(spark, sf_dir))
    return found.select("rec_id", "speaker", "speech_sec", F.posexplode_outer("embedding").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query(f"""
WITH {VOICED}, q AS (SELECT *, CASE WHEN chunk_idx > 0 AND label <> 'S2' THEN (CAST(label[2:2] AS INTEGER) + 1) / 8.0 END AS score FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY rec_id, score IS NOT NULL ORDER BY chunk_idx, label) AS k FROM q)
SELECT rec_id, count(DISTINCT chunk_idx) AS chunks, count(DISTINCT speaker) AS speakers, count(score) AS joined,
       coalesce(string_agg(printf('chunk %d: %s is %s (%.2f)', chunk_idx + 1, label, speaker, CAST(score AS DOUBLE)), ', ' ORDER BY k) FILTER (score IS NOT NULL AND k <= 3), '')
       || CASE WHEN count(score) > 3 THEN ' and ' || (count(score) - 3) || ' more' ELSE '' END AS sample FROM r GROUP BY 1""")
def stitch_notes(spark, sf_dir):
    return voices.stitch_notes(_stitched(spark, sf_dir)[1])


@query("""
WITH l AS (SELECT conv_id, string_agg(role || ' : ' || text || chr(10), '' ORDER BY turn) AS text, count(*) AS n FROM conversations GROUP BY 1)
SELECT CAST(conv_id AS VARCHAR) AS rec_id, CASE WHEN conv_id % 2 = 0 THEN 'txt' ELSE 'TXT' END AS fmt, conv_id || '.txt' AS name, text AS content FROM l
UNION ALL SELECT CAST(conv_id + 1000000 AS VARCHAR), 'json', NULL, NULL FROM l""")
def downloads(spark, sf_dir):
    """The text of every conversation's result, and as many requests for results that are not there."""
    line = F.struct(F.col("turn").alias("line_idx"), F.col("role").alias("name"), "text")
    r = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("rec_id")).agg(F.collect_list(line).alias("lines"))
    number = F.col("rec_id").cast("long")
    there = r.select("rec_id", F.when(number % 2 == 0, "txt").otherwise("TXT").alias("fmt"))
    gone = r.select((number + 1000000).cast("string").alias("rec_id"), F.lit("json").alias("fmt"))
    return results.download(r, there.unionByName(gone))


def _labelled(spark, sf_dir):
    """Labels of conversations with letters; some get a speaker by id, some by name, some lose theirs."""
    seg = inputs.segments(spark, sf_dir).withColumn("label", F.concat("label", (F.col("seg_idx") % 2).cast("string")))
    first = seg.groupBy("rec_id", "label").agg(F.min("seg_idx").alias("label_idx"))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    held = F.when(F.col("rec_id") % 4 == 1, F.lit(1).cast("long"))
    entries = first.join(v, "rec_id", "left").select(
        "rec_id", "label", "label_idx", held.alias("speaker_id"), F.when(held.isNotNull(), F.concat(F.lit("Person 1 "), "label")).alias("display"),
        F.concat(F.lit("Voice "), "label").alias("anon"), held.isNotNull().alias("matched"), F.lit(False).alias("manual"), F.lit("").alias("reason"),
        (F.col("label_idx") + 5.0).alias("total_speech"), F.when(F.col("label_idx") < 2, F.col("embedding")).alias("embedding"),
    )
    kind = (F.col("rec_id") + F.col("label_idx")) % 5
    wishes = first.filter(kind < 4).select(
        "rec_id", "label", F.when(kind == 1, F.concat(F.lit(" Guest "), (F.col("rec_id") % 50).cast("string"))).when(kind == 2, "PERSON 2").otherwise(" ").alias("name"),
        F.when(kind == 0, (F.col("rec_id") % 12).cast("long")).alias("speaker_id"),
    )
    return labelling.label_speakers(entries, wishes, _speakers(spark, sf_dir), _prints(spark, sf_dir), seg, F.lit("2024-01-02"))


LABELLED = f"""{PRINTS}, seg AS (SELECT conv_id AS rec_id, turn AS seg_idx, role || (turn % 2) AS label, trim(text) AS text FROM conversations),
f AS (SELECT rec_id, label, min(seg_idx) AS label_idx, (rec_id + min(seg_idx)) % 5 AS kind FROM seg GROUP BY 1, 2),
w AS (SELECT f.*, CASE kind WHEN 0 THEN s.name WHEN 1 THEN 'Guest ' || (rec_id % 50) WHEN 2 THEN 'PERSON 2' WHEN 3 THEN '' END AS name,
             kind = 4 OR (kind = 0 AND s.name IS NULL) AS left_alone FROM f LEFT JOIN speakers s ON kind = 0 AND s.id = rec_id % 12),
shown AS (SELECT rec_id, label, label_idx, CASE WHEN left_alone THEN CASE WHEN rec_id % 4 = 1 THEN 'Person 1 ' || label END WHEN name <> '' THEN name END AS name, name AS wished, left_alone FROM w)"""


@query(f"""WITH {LABELLED}, d AS (SELECT seg.*, coalesce(name, 'Voice ' || label) AS name FROM seg JOIN shown USING (rec_id, label) WHERE seg.text <> ''),
g AS (SELECT *, CASE WHEN lag(name) OVER (PARTITION BY rec_id ORDER BY seg_idx) = name THEN 0 ELSE 1 END AS fresh FROM d),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY rec_id ORDER BY seg_idx) - 1 AS line_idx FROM g)
SELECT rec_id, CAST(line_idx AS BIGINT) AS line_idx, min_by(label, seg_idx) AS label, name, count(*) AS n_segments, string_agg(text, ' ' ORDER BY seg_idx) AS text FROM n GROUP BY rec_id, line_idx, name""")
def relabelled_lines(spark, sf_dir):
    """The lines of all results after their speakers were named."""
    return _labelled(spark, sf_dir).lines.drop("start", "end")


@query(f"""WITH {LABELLED}, e AS (SELECT 'result:' || rec_id || ':' || shown.label AS source, wished, label_idx, left_alone, embedding IS NOT NULL AND label_idx < 2 AS heard FROM shown LEFT JOIN embeddings ON vec_id = rec_id),
people AS (SELECT name FROM speakers UNION SELECT DISTINCT wished FROM e WHERE NOT left_alone AND wished <> '' AND lower(wished) NOT IN (SELECT lower(name) FROM speakers)),
made AS (SELECT source, p.name, CAST(label_idx + 5 AS DOUBLE) AS speech_sec, row_number() OVER (ORDER BY md5(source)) + (SELECT max(id) FROM prints) AS id
         FROM e JOIN people p ON lower(p.name) = lower(wished) WHERE NOT left_alone AND wished <> '' AND heard),
every AS (SELECT source, s.name, speech_sec, prints.id, prints.speaker_id FROM prints LEFT JOIN speakers s ON s.id = prints.speaker_id WHERE source NOT IN (SELECT source FROM e WHERE NOT left_alone)
          UNION ALL SELECT source, name, speech_sec, id, NULL FROM made),
k AS (SELECT *, row_number() OVER (PARTITION BY coalesce(name, CAST(speaker_id AS VARCHAR)) ORDER BY id DESC) AS n FROM every)
SELECT id, source, name, speech_sec FROM k WHERE n <= 10""")
def relabelled_voiceprints(spark, sf_dir):
    """The voiceprints that are kept then, with the names of their speakers."""
    told = _labelled(spark, sf_dir)
    names = told.speakers.select(F.col("id").alias("speaker_id"), "name")
    return told.voiceprints.join(names, "speaker_id", "left").select("id", "source", "name", "speech_sec")


@query(f"""WITH {PRINTS}, a AS (SELECT c_custkey AS ask, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 15 AS BIGINT) END AS id, ' PERSON ' || (c_custkey % 14) AS name FROM customer)
SELECT ask, a.id, a.name, CASE WHEN a.id IS NOT NULL THEN i.id ELSE n.id END AS found_id, CASE WHEN a.id IS NOT NULL THEN i.name ELSE n.name END AS found_name
FROM a LEFT JOIN speakers i ON i.id = a.id LEFT JOIN speakers n ON lower(n.name) = lower(trim(a.name))""")
def find_speakers(spark, sf_dir):
    """Customers ask for a speaker, a third of them by number."""
    key = F.col("c_custkey")
    asked = table(spark, sf_dir, "customer").select(key.alias("ask"), F.when(key % 3 == 0, (key % 15).cast("long")).alias("id"), F.concat(F.lit(" PERSON "), (key % 14).cast("string")).alias("name"))
    return registry.find_speakers(_speakers(spark, sf_dir), asked)


@query(f"""WITH {PRINTS}, w AS (SELECT id, CASE WHEN id % 4 = 0 THEN ' ' WHEN id % 3 = 0 THEN 'person ' || (id + 1) ELSE 'Guest ' || id END AS name FROM speakers WHERE id % 5 <> 1)
SELECT s.id, CASE WHEN trim(w.name) <> '' AND NOT EXISTS (SELECT 1 FROM speakers o WHERE o.id <> s.id AND lower(o.name) = lower(trim(w.name))) THEN trim(w.name) ELSE s.name END AS name,
       CASE WHEN trim(w.name) <> '' AND NOT EXISTS (SELECT 1 FROM speakers o WHERE o.id <> s.id AND lower(o.name) = lower(trim(w.name))) THEN '2024-01-02' ELSE '2024-01-01' END AS updated_at
FROM speakers s LEFT JOIN w ON w.id = s.id""")
def rename_speakers(spark, sf_dir):
    s = _speakers(spark, sf_dir)
    name = F.when(F.col("id") % 4 == 0, " ").when(F.col("id") % 3 == 0, F.concat(F.lit("person "), (F.col("id") + 1).cast("string"))).otherwise(F.concat(F.lit("Guest "), F.col("id").cast("string")))
    return registry.rename_speakers(s, s.filter("id % 5 <> 1").select("id", name.alias("name")), F.lit("2024-01-02")).select("id", "name", "updated_at")


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d') AS name FROM events""")
def default_names(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", names.default_name(F.col("ts")).alias("name"))


SOUND = """n AS (SELECT user_id AS rec_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place FROM events)"""


def _sound(spark, sf_dir, size):
    """(rec_id, block, at, samples): every user's values in order, in blocks of a size."""
    moment = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("rec_id"), "value", moment.alias("moment"), "event_id")
    placed = scans.running(e, ["rec_id"], ["moment", "event_id"], 10 * DAY * 1_000_000, {"n": scans.count()}).withColumn("at", F.col("n") - 1)
    block = F.floor(F.col("at") / size)
    listed = F.sort_array(F.collect_list(F.struct("at", "value")))
    rows = placed.groupBy("rec_id", block.alias("block")).agg(listed.alias("x"))
    return rows.select("rec_id", "block", (F.col("block") * size).alias("at"), F.transform("x", lambda x: x["value"]).alias("samples"))


@query(f"""WITH {SOUND}, f AS (SELECT rec_id, place // 4 AS frame_idx, avg(value * value) AS p, count(*) AS n FROM n GROUP BY 1, 2)
SELECT rec_id, frame_idx, round(10 * log10(p + 1e-10), 6) AS db FROM f WHERE n = 4""")
def frame_levels(spark, sf_dir):
    """Frames of four values, from blocks of sixteen; a rest of a frame is left out."""
    levels = silence.block_levels(_sound(spark, sf_dir, 16), 16, 4)
    return levels.withColumn("db", F.round("db", 6))


@query(f"""WITH {SOUND}, r AS (SELECT rec_id, 3 AS s, 9 AS e, 0 AS off FROM n WHERE rec_id % 3 <> 0 GROUP BY 1 UNION ALL SELECT rec_id, 14, 40, 6 FROM n WHERE rec_id % 3 <> 0 GROUP BY 1)
SELECT n.rec_id, off + place - s AS pos, value FROM n JOIN r ON r.rec_id = n.rec_id AND place >= s AND place < e UNION ALL SELECT rec_id, place, value FROM n WHERE rec_id % 3 = 0""")
def kept_sound(spark, sf_dir):
    """Sound in blocks of eight samples cut to two regions, over the borders of blocks; every third recording has none."""
    blocks = _sound(spark, sf_dir, 8)
    spans = F.inline(F.array(*[F.struct(F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end")) for a, b in ((3, 9), (14, 40))]))
    regions = blocks.select("rec_id").distinct().filter("rec_id % 3 <> 0").select("rec_id", spans)
    cut = wavespan.kept(blocks, timeline.offsets(regions), "rec_id")
    return cut.select("rec_id", "at", F.posexplode("samples").alias("i", "value")).select("rec_id", (F.col("at") + F.col("i")).alias("pos"), "value")


@query("""WITH v AS (SELECT conv_id, turn, text, CASE WHEN turn % 3 = 1 THEN 'drop' WHEN turn % 3 = 2 THEN 'suspect' ELSE 'keep' END AS verdict FROM conversations)
SELECT conv_id, turn, text, verdict, 'suspects stay' AS setting FROM v WHERE verdict <> 'drop' UNION ALL SELECT conv_id, turn, text, verdict, 'suspects go' FROM v WHERE verdict = 'keep'
UNION ALL SELECT conv_id, turn, text, verdict, 'all stay' FROM v""")
def cleaned(spark, sf_dir):
    """The segments that stay under each setting."""
    c = table(spark, sf_dir, "conversations")
    told = c.select("conv_id", "turn", "text", F.when(F.col("turn") % 3 == 1, "drop").when(F.col("turn") % 3 == 2, "suspect").otherwise("keep").alias("verdict"))
    settings = {"suspects stay": EngineConfig(), "suspects go": EngineConfig(drop_suspect=True), "all stay": EngineConfig(drop_hallucination=False)}
    parts = [textfilter.clean(told, cfg).withColumn("setting", F.lit(name)) for name, cfg in settings.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
