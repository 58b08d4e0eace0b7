"""Queries on notes: cleanup, measures, tracks. Each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleanup as C
from ..operators import measure as M
from ..operators import merge as G
from ..operators.run import process
from ..schema import DRUM_TO_GM, TRACK, CleanupParams
from ..sources.notes import GRIDDED_SQL, NOTES_SQL, gridded, notes

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

ROW = ["song_id", "track", "note_id", "pitch", "velocity"]


def _q(name: str, sql: str | None = None, source: str = NOTES_SQL):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = f"WITH RECURSIVE notes AS ({source}), {sql}" if sql.lstrip()[0] != "S" else f"WITH notes AS ({source}) {sql}"
        return f

    return add


def _timed(df, *more):
    return df.select(*ROW, F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"), *more)


TIMED = "song_id, track, note_id, pitch, velocity, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s"

# The cleanup, one common table for each step.
FLOOR = "floored AS (SELECT * FROM notes WHERE velocity >= 15)"
DEOV = "deov AS (SELECT * REPLACE (least(end_s, coalesce(lead(start_s) OVER (PARTITION BY song_id, track, pitch ORDER BY start_s, note_id), end_s)) AS end_s), end_s > lead(start_s) OVER (PARTITION BY song_id, track, pitch ORDER BY start_s, note_id) AS trimmed FROM {0})"
CAP = "capped AS (SELECT * EXCLUDE (nxt) REPLACE (CASE WHEN end_s - start_s > 1.0 AND nxt < end_s THEN nxt ELSE end_s END AS end_s), end_s - start_s > 1.0 AND nxt < end_s AS capped FROM (SELECT *, min(start_s) OVER (PARTITION BY song_id, track ORDER BY start_s RANGE BETWEEN 1e-6::double FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM {0}))"
SWEEP = "swept AS (SELECT * FROM {0} WHERE end_s - start_s >= 0.02)"
LEGATO = "tied AS (SELECT * EXCLUDE (nxt) REPLACE (CASE WHEN nxt - end_s > 0 AND nxt - end_s <= 0.125 THEN nxt - 0.005::double ELSE end_s END AS end_s), coalesce(nxt - end_s > 0 AND nxt - end_s <= 0.125, false) AS extended FROM (SELECT a.*, (SELECT min(b.start_s) FROM {0} b WHERE b.song_id = a.song_id AND b.track = a.track AND b.start_s > a.end_s - 1e-9::double) AS nxt FROM {0} a))"
MEASURES = """{1}_isle AS (SELECT *, sum(fresh) OVER (PARTITION BY song_id, track ORDER BY start_s, note_id ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN start_s > max(end_s) OVER (PARTITION BY song_id, track ORDER BY start_s, note_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) OR row_number() OVER (PARTITION BY song_id, track ORDER BY start_s, note_id) = 1 THEN 1 ELSE 0 END AS fresh FROM {0})),
{1}_sound AS (SELECT song_id, track, sum(b - a) AS sounding, max(b) - min(a) AS span, sum(n) AS n FROM (SELECT song_id, track, island, min(start_s) AS a, max(end_s) AS b, count(*) AS n FROM {1}_isle GROUP BY ALL) GROUP BY ALL),
{1}_m AS (SELECT song_id, track, count(*) AS n, round(median(end_s - start_s), 4) AS median_duration, CASE WHEN max(end_s) - min(start_s) > 0 THEN round(sum(end_s - start_s) / (max(end_s) - min(start_s)), 3) ELSE 0 END AS polyphony,
  round(avg(least(start_s - 0.125 * floor(start_s / 0.125), 0.125 - (start_s - 0.125 * floor(start_s / 0.125))) / 0.125), 4) AS grid_error FROM {0} GROUP BY ALL),
{1} AS (SELECT m.song_id, m.track, m.n, m.median_duration, m.polyphony, CASE WHEN s.n < 2 OR s.span <= 0 THEN 0 ELSE round(greatest(0, 1 - sounding / span), 4) END AS silence_ratio, m.grid_error FROM {1}_m m JOIN {1}_sound s USING (song_id, track))"""


@_q("velocity_floor", f"SELECT {TIMED} FROM notes WHERE velocity >= 15")
def velocity_floor(spark, d):
    return _timed(C.velocity_floor(notes(spark, d)))


@_q("min_duration", f"SELECT {TIMED} FROM notes WHERE end_s - start_s >= 0.3")
def min_duration(spark, d):
    return _timed(C.min_duration(notes(spark, d), 0.3))


@_q("de_overlap", f"{DEOV.format('notes')} SELECT {TIMED}, coalesce(trimmed, false) AS trimmed FROM deov")
def de_overlap(spark, d):
    return _timed(C.de_overlap(notes(spark, d)), F.col("trimmed_de_overlap").alias("trimmed"))


@_q("duration_cap", f"{CAP.format('notes')} SELECT {TIMED}, coalesce(capped, false) AS trimmed FROM capped")
def duration_cap(spark, d):
    return _timed(C.duration_cap(notes(spark, d)), F.col("trimmed_duration_cap").alias("trimmed"))


@_q("legato", f"{LEGATO.format('notes')} SELECT {TIMED}, extended FROM tied")
def legato(spark, d):
    return _timed(C.legato(notes(spark, d)), F.col("extended_legato").alias("extended"))


@_q("quantize", f"""q AS (SELECT *, (round_even(start_s / 0.125, 0) * 0.125 - start_s) * 0.5 AS d FROM notes),
r AS (SELECT * REPLACE (start_s + d AS start_s, CASE WHEN d <> 0 AND end_s + d <= start_s + d THEN start_s + d + 0.02 ELSE end_s + d END AS end_s), d <> 0 AS quantized FROM q) SELECT {TIMED}, quantized FROM r""")
def quantize(spark, d):
    return _timed(C.quantize(notes(spark, d)), "quantized")


# Note by note, with those kept that still sound.
MONO = """o AS (SELECT *, row_number() OVER (PARTITION BY song_id, track ORDER BY start_s, pitch, note_id) AS i FROM notes),
v AS (SELECT song_id, track, i, note_id, true AS kept, [struct_pack(e := end_s, p := pitch, s := start_s)] AS live FROM o WHERE i = 1 UNION ALL
 SELECT song_id, track, i, note_id, NOT hit, CASE WHEN hit THEN live ELSE list_append(list_filter(live, lambda x: x.e > start_s), struct_pack(e := end_s, p := pitch, s := start_s)) END
 FROM (SELECT o.*, v.live, len(list_filter(v.live, lambda x: x.s < o.end_s AND o.start_s < x.e AND x.p < o.pitch)) > 0 AS hit FROM v JOIN o ON o.song_id = v.song_id AND o.track = v.track AND o.i = v.i + 1))"""


@_q("monophonic", f"{MONO} SELECT {TIMED} FROM o JOIN (SELECT song_id, track, i FROM v WHERE kept) USING (song_id, track, i)")
def monophonic(spark, d):
    """A greedy fold over survivors."""
    return _timed(C.monophonic(notes(spark, d)))


@_q("clean_notes", f"{FLOOR}, {DEOV.format('floored')}, {CAP.format('deov')}, {SWEEP.format('capped')}, {LEGATO.format('swept')} SELECT {TIMED} FROM tied")
def clean_notes(spark, d):
    return _timed(C.clean(notes(spark, d), CleanupParams(legato=True)))


@_q("process_notes", f"{FLOOR}, {DEOV.format('floored')}, {CAP.format('deov')}, {SWEEP.format('capped')}, {LEGATO.format('swept')} SELECT {TIMED} FROM tied")
def process_notes(spark, d):
    """A whole run at a given tempo, without a grid."""
    return _timed(process(notes(spark, d), tempo=120.0, params=CleanupParams(legato=True), fit_grid=False).notes)


# The cleanup's limits in beats, at each song's own tempo.
OWN_TEMPO = "(CASE WHEN song_id % 2 = 0 THEN 60 ELSE 200 END)"


@_q("process_two_tempi", f"{FLOOR}, {DEOV.format('floored')}, {CAP.format('deov').replace('> 1.0', f'> 120.0 / {OWN_TEMPO}')}, {SWEEP.format('capped')}, {LEGATO.format('swept').replace('<= 0.125', f'<= 15.0 / {OWN_TEMPO}')} SELECT {TIMED} FROM tied")
def process_two_tempi(spark, d):
    """A whole run in which every other song goes at 60 and at 200, without a grid."""
    n = notes(spark, d)
    tempi = n.select("song_id").distinct().withColumn("bpm", F.when(F.col("song_id") % 2 == 0, 60.0).otherwise(200.0))
    return _timed(process(n, tempo=tempi, params=CleanupParams(legato=True), fit_grid=False).notes)


@_q("clean_notes_stats", f"{FLOOR}, {DEOV.format('floored')}, {CAP.format('deov')}, {SWEEP.format('capped')}, {MEASURES.format('swept', 'measured')} SELECT * FROM measured")
def clean_notes_stats(spark, d):
    return C.measures(C.clean(notes(spark, d)))


@_q("cleanup_stats", f"""{FLOOR}, {DEOV.format('floored')}, {CAP.format('deov')}, {SWEEP.format('capped')}, {MEASURES.format('notes', 'b')}, {MEASURES.format('swept', 'a')},
n AS (SELECT song_id, track, count(*) AS notes_before, CAST(sum(CASE WHEN velocity < 15 THEN 1 ELSE 0 END) AS BIGINT) AS dropped_velocity_floor FROM notes GROUP BY ALL),
t AS (SELECT song_id, track, CAST(sum(CASE WHEN trimmed THEN 1 ELSE 0 END) AS BIGINT) AS trimmed_de_overlap, CAST(sum(CASE WHEN capped THEN 1 ELSE 0 END) AS BIGINT) AS trimmed_duration_cap, CAST(sum(CASE WHEN end_s - start_s < 0.02 THEN 1 ELSE 0 END) AS BIGINT) AS dropped_too_short FROM capped GROUP BY ALL)
SELECT n.*, coalesce(t.trimmed_de_overlap, 0) AS trimmed_de_overlap, coalesce(t.trimmed_duration_cap, 0) AS trimmed_duration_cap, coalesce(t.dropped_too_short, 0) AS dropped_too_short, coalesce(a.n, 0) AS notes_after,
 b.median_duration AS median_duration_before, b.polyphony AS polyphony_before, b.silence_ratio AS silence_ratio_before, b.grid_error AS grid_error_before,
 coalesce(a.median_duration, 0) AS median_duration_after, coalesce(a.polyphony, 0) AS polyphony_after, coalesce(a.silence_ratio, 0) AS silence_ratio_after, coalesce(a.grid_error, 0) AS grid_error_after
FROM n LEFT JOIN t USING (song_id, track) LEFT JOIN b USING (song_id, track) LEFT JOIN a USING (song_id, track)""")
def cleanup_stats(spark, d):
    return C.stats(notes(spark, d))


@_q("median_duration", "SELECT song_id, track, count(*) AS n, round(median(end_s - start_s), 4) AS median_duration FROM notes GROUP BY ALL")
def median_duration(spark, d):
    return M.median_duration(notes(spark, d))


@_q("polyphony", "SELECT song_id, track, CASE WHEN max(end_s) - min(start_s) > 0 THEN round(sum(end_s - start_s) / (max(end_s) - min(start_s)), 3) ELSE 0 END AS polyphony FROM notes GROUP BY ALL")
def polyphony(spark, d):
    return M.polyphony(notes(spark, d))


@_q("silence_ratio", f"{MEASURES.format('notes', 'measured')} SELECT song_id, track, silence_ratio FROM measured")
def silence_ratio(spark, d):
    return M.silence_ratio(notes(spark, d))


@_q("grid_error", f"{MEASURES.format('notes', 'measured')} SELECT song_id, track, grid_error FROM measured")
def grid_error(spark, d):
    return M.grid_error(notes(spark, d))


@_q("quantization_error", "e AS (SELECT song_id, track, least(start_s - 0.0625 * floor(start_s / 0.0625), 0.0625 - (start_s - 0.0625 * floor(start_s / 0.0625))) / 0.0625 AS e FROM notes) SELECT song_id, track, '1/32' AS grid, count(*) AS n, round(avg(e), 4) AS mean, round(median(e), 4) AS median FROM e GROUP BY song_id, track")
def quantization_error(spark, d):
    return M.quantization_error(notes(spark, d), den=8)


DEDUPE = """o AS (SELECT song_id, track, start_s, row_number() OVER (PARTITION BY song_id, track ORDER BY start_s, note_id) AS r FROM notes),
kept AS (SELECT song_id, track, r, start_s AS held, true AS keep FROM o WHERE r = 1
 UNION ALL SELECT o.song_id, o.track, o.r, CASE WHEN o.start_s - k.held > 0.03::double THEN o.start_s ELSE k.held END, o.start_s - k.held > 0.03::double FROM kept k JOIN o ON o.song_id = k.song_id AND o.track = k.track AND o.r = k.r + 1),
onsets AS (SELECT song_id, track, held AS t FROM kept WHERE keep)"""


@_q("onset_dedupe", f"{DEDUPE} SELECT song_id, track, round(t, 6) AS t FROM onsets")
def onset_dedupe(spark, d):
    return M.onset_dedupe(notes(spark, d)).select(*TRACK, F.round("t", 6).alias("t"))


@_q("track_counts", "SELECT s.song_id, t.track, count(n.note_id) AS n FROM (SELECT DISTINCT song_id FROM notes) s CROSS JOIN (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view', 'empty']) AS track) t LEFT JOIN notes n ON n.song_id = s.song_id AND n.track = t.track GROUP BY ALL")
def track_counts(spark, d):
    n = notes(spark, d)
    named = n.select("song_id").distinct().select("song_id", F.explode(F.array(*[F.lit(t) for t in ("click", "error", "purchase", "signup", "view", "empty")])).alias("track"))
    return M.track_counts(n, named)


@_q("notes_per_window", "SELECT song_id, track, CAST(floor(start_s / 5.0) AS BIGINT) AS \"window\", count(*) AS n, min(pitch) AS low, max(pitch) AS high FROM notes GROUP BY ALL".replace("SELECT", "SELECT", 1))
def notes_per_window(spark, d):
    return M.notes_per_window(notes(spark, d))


@_q("max_note_shift", """q AS (SELECT *, start_s + (round_even(start_s / 0.125, 0) * 0.125 - start_s) * 0.5 AS moved FROM notes),
a AS (SELECT song_id, track, start_s, row_number() OVER (PARTITION BY song_id, track ORDER BY start_s, note_id) AS r FROM q), b AS (SELECT song_id, track, moved, row_number() OVER (PARTITION BY song_id, track ORDER BY moved, note_id) AS r FROM q)
SELECT song_id, track, round(max(abs(start_s - moved)), 6) AS max_shift FROM a JOIN b USING (song_id, track, r) GROUP BY song_id, track""")
def max_note_shift(spark, d):
    n = notes(spark, d)
    return M.max_note_shift(n, C.quantize(n))


# Tracks and stems. Event types stand for stems.
STEM = {"click": "drums", "error": "bass", "purchase": "vocals", "signup": "other", "view": "strings"}
STEM_SQL = "CASE track " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STEM.items()) + " END"
NAME_SQL = "CASE {0} WHEN 'vocals' THEN 'melody' WHEN 'other' THEN 'comping' ELSE {0} END"
PROGRAM_SQL = "CASE {0} WHEN 'vocals' THEN 53 WHEN 'bass' THEN 33 WHEN 'guitar' THEN 25 ELSE 0 END"
RANK_SQL = "CASE {0} WHEN 'melody' THEN 0 WHEN 'bass' THEN 1 WHEN 'guitar' THEN 2 WHEN 'piano' THEN 3 WHEN 'comping' THEN 4 WHEN 'drums' THEN 5 ELSE 4.5 END"


def _stems(spark, d):
    return notes(spark, d).withColumn("track", F.create_map(*[F.lit(x) for kv in STEM.items() for x in kv])[F.col("track")])


@_q("merge_tracks", f"""s AS (SELECT *, {STEM_SQL} AS stem FROM notes), m AS (SELECT song_id, {NAME_SQL.format('stem')} AS track, note_id, pitch, velocity, {PROGRAM_SQL.format('stem')} AS program, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, start_s AS raw FROM s)
SELECT * EXCLUDE (raw), row_number() OVER (PARTITION BY song_id, track ORDER BY raw, pitch, note_id) AS place, CAST({RANK_SQL.format('track')} AS DOUBLE) AS rank FROM m""")
def merge_tracks(spark, d):
    return _timed(G.merge_tracks(_stems(spark, d)), "program", F.col("place").cast("long").alias("place"), "rank")


@_q("track_spec", f"s AS (SELECT DISTINCT song_id, {STEM_SQL} AS stem FROM notes) SELECT song_id, stem, {NAME_SQL.format('stem')} AS track, {PROGRAM_SQL.format('stem')} AS program, CASE {NAME_SQL.format('stem')} WHEN 'melody' THEN 73 WHEN 'bass' THEN 33 WHEN 'guitar' THEN 25 ELSE 0 END AS play_program FROM s")
def track_spec(spark, d):
    s = _stems(spark, d).select("song_id", F.col("track").alias("stem")).distinct()
    return s.select("song_id", "stem", G.track_name(F.col("stem")).alias("track"), G.track_program(F.col("stem")).alias("program"), G.play_program(G.track_name(F.col("stem"))).alias("play_program"))


@_q("plan_stems", f"""s AS (SELECT DISTINCT song_id, {STEM_SQL} AS stem FROM notes), j AS (SELECT *, CASE WHEN stem IN ('bass', 'guitar', 'piano', 'other') THEN 'pitched' WHEN stem = 'drums' THEN 'skipped' ELSE 'ignored' END AS job FROM s)
SELECT song_id, stem, job, CASE WHEN job = 'pitched' THEN CASE stem WHEN 'bass' THEN 2 WHEN 'guitar' THEN 3 WHEN 'piano' THEN 4 ELSE 5 END ELSE 0 END AS place, CASE WHEN job = 'skipped' THEN concat('stem ''', stem, ''' skipped: drums are off') ELSE '' END AS warning FROM j""")
def plan_stems(spark, d):
    out = G.plan_stems(_stems(spark, d).select("song_id", F.col("track").alias("stem")), vocals=False, drums=False)
    return out.select("song_id", "stem", "job", F.coalesce("place", F.lit(0)).alias("place"), F.coalesce("warning", F.lit("")).alias("warning"))


@_q("part_order", f"s AS (SELECT song_id, {NAME_SQL.format(STEM_SQL)} AS track, min(note_id) AS arrival FROM notes GROUP BY ALL) SELECT song_id, track, CAST(row_number() OVER (PARTITION BY song_id ORDER BY {RANK_SQL.format('track')}, arrival, track) - 1 AS INT) AS track_index FROM s")
def part_order(spark, d):
    t = _stems(spark, d).groupBy("song_id", G.track_name(F.col("track")).alias("track")).agg(F.min("note_id").alias("arrival"))
    return G.track_index(t).select("song_id", "track", "track_index")


@_q("assign_channels", f"""s AS (SELECT song_id, {NAME_SQL.format(STEM_SQL)} AS track, min(note_id) AS arrival FROM notes GROUP BY ALL), i AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY {RANK_SQL.format('track')}, arrival, track) - 1 AS idx FROM s),
k AS (SELECT *, (sum(CASE WHEN track = 'drums' THEN 0 ELSE 1 END) OVER (PARTITION BY song_id ORDER BY idx) - 1) % 15 AS k FROM i) SELECT song_id, track, CAST(idx AS INT) AS track_index, CAST(CASE WHEN track = 'drums' THEN 9 WHEN k >= 9 THEN k + 1 ELSE k END AS INT) AS channel FROM k""")
def assign_channels(spark, d):
    t = _stems(spark, d).groupBy("song_id", G.track_name(F.col("track")).alias("track")).agg(F.min("note_id").alias("arrival"))
    return G.assign_channels(G.track_index(t).withColumn("is_drum", F.col("track") == "drums")).select("song_id", "track", "track_index", "channel")


@_q("shift_offset", f"m AS (SELECT * REPLACE (start_s + song_id * 0.25 AS start_s, end_s + song_id * 0.25 AS end_s) FROM notes) SELECT {TIMED} FROM m")
def shift_offset(spark, d):
    return _timed(G.shift(notes(spark, d), F.col("song_id") * F.lit(0.25)))


@_q("clip_window", f"m AS (SELECT * REPLACE (start_s - 60 AS start_s, end_s - 60 AS end_s) FROM notes), c AS (SELECT * REPLACE (greatest(start_s, 0) AS start_s, least(end_s, 90) AS end_s) FROM m WHERE end_s > 0 AND start_s < 90) SELECT {TIMED} FROM c")
def clip_window(spark, d):
    return _timed(G.clip(G.shift(notes(spark, d), F.lit(-60.0)), 90.0))


@_q("section_slice", f"m AS (SELECT * REPLACE (start_s - 30 AS start_s, end_s - 30 AS end_s) FROM notes WHERE start_s >= 30 AND start_s < 120) SELECT {TIMED} FROM m")
def section_slice(spark, d):
    return _timed(G.section(notes(spark, d), 30.0, 120.0))


@_q("gm_remap", f"SELECT song_id, track, note_id, CAST(CASE pitch {' '.join(f'WHEN {a} THEN {b}' for a, b in DRUM_TO_GM.items())} ELSE pitch END AS INT) AS pitch FROM notes WHERE is_drum")
def gm_remap(spark, d):
    return notes(spark, d).where("is_drum").select(*TRACK, "note_id", G.gm_drum(F.col("pitch")).alias("pitch"))


@_q("drum_family", "SELECT song_id, CASE WHEN pitch IN (35, 36) THEN 'kick' WHEN pitch BETWEEN 37 AND 40 THEN 'snare' WHEN pitch IN (42, 44, 46) THEN 'hihat' WHEN pitch IN (41, 43, 45, 47, 48, 50) THEN 'tom' WHEN pitch IN (49, 52, 55, 57) THEN 'crash' WHEN pitch IN (51, 53, 59) THEN 'ride' ELSE 'other' END AS family, count(*) AS n FROM notes WHERE is_drum GROUP BY ALL")
def drum_family(spark, d):
    return notes(spark, d).where("is_drum").groupBy("song_id", G.drum_family(F.col("pitch")).alias("family")).agg(F.count("*").alias("n"))


@_q("sparse_tracks", "SELECT song_id, track, count(*) AS n, round(max(end_s), 6) AS seconds, avg(velocity) / 127.0 > 0.001 AND max(end_s) * 1200 / 240.0 >= 8 AND count(*) < max(end_s) * 1200 / 240.0 / 4 AS sparse FROM notes GROUP BY ALL")
def sparse_tracks(spark, d):
    a = notes(spark, d).groupBy(*TRACK).agg(F.count("*").alias("n"), F.max("end_s").alias("s"), (F.avg("velocity") / 127.0).alias("rms"))
    return a.select(*TRACK, "n", F.round("s", 6).alias("seconds"), G.is_sparse(F.col("n"), F.col("s"), 1200.0, F.col("rms")).alias("sparse"))


@_q("silent_tracks", "SELECT song_id, track, 0 AS n, CASE WHEN song_id % 2 = 0 THEN printf('silent at %.1f dBFS', 20 * log10(greatest(0.0001 * (1 + song_id), 1e-12))) ELSE '' END AS warning FROM notes GROUP BY song_id, track")
def silent_tracks(spark, d):
    a = notes(spark, d).select(*TRACK).distinct().withColumns({"n": F.lit(0), "rms": F.when(F.col("song_id") % 2 == 0, 0.0001 * (1 + F.col("song_id"))).otherwise(0.5)})
    return a.select(*TRACK, "n", F.coalesce(G.silent(F.col("n"), F.col("rms")), F.lit("")).alias("warning"))


@_q("fallback_merge", f"c AS (SELECT song_id, track FROM notes GROUP BY ALL HAVING count(*) < 190), f AS (SELECT * REPLACE (pitch + 12 AS pitch) FROM notes WHERE velocity >= 40) SELECT {TIMED} FROM (SELECT * FROM notes WHERE (song_id, track) NOT IN (SELECT (song_id, track) FROM c) UNION ALL SELECT * FROM f WHERE (song_id, track) IN (SELECT (song_id, track) FROM c))")
def fallback_merge(spark, d):
    n = notes(spark, d)
    few = n.groupBy(*TRACK).agg(F.count("*").alias("c")).where("c < 190").select(*TRACK)
    return _timed(G.fallback_merge(n, n.where("velocity >= 40").withColumn("pitch", (F.col("pitch") + 12).cast("int")), few))


@_q("dedupe_hits", f"h AS (SELECT DISTINCT song_id, track, round(floor(start_s), 6) AS start_s, pitch % 8 + 40 AS pitch, velocity // 64 * 64 AS velocity FROM notes WHERE is_drum) SELECT song_id, track, start_s, CAST(CASE pitch {' '.join(f'WHEN {a} THEN {b}' for a, b in DRUM_TO_GM.items())} ELSE pitch END AS INT) AS pitch, CAST(least(greatest(velocity, 1), 127) AS INT) AS velocity FROM h")
def dedupe_hits(spark, d):
    h = notes(spark, d).where("is_drum").withColumns({"start_s": F.floor("start_s").cast("double"), "pitch": (F.col("pitch") % 8 + 40).cast("int"), "velocity": F.expr("CAST(velocity DIV 64 * 64 AS INT)")})
    return G.dedupe_hits(h)


BROKEN_SQL = "n AS (SELECT * REPLACE (CASE WHEN note_id % 11 = 0 THEN NULL ELSE start_s END AS start_s, CASE WHEN note_id % 7 = 0 THEN NULL WHEN note_id % 5 = 0 THEN start_s - 0.02 WHEN note_id % 3 = 0 THEN start_s + 0.001 ELSE end_s END AS end_s) FROM notes)"


@_q("validate_notes", f"{BROKEN_SQL}, v AS (SELECT * REPLACE (CASE WHEN end_s IS NULL THEN start_s + 0.01 WHEN start_s > end_s THEN greatest(end_s, start_s + 0.01) WHEN NOT is_drum AND end_s - start_s < 0.01 THEN start_s + 0.01 ELSE end_s END AS end_s) FROM n WHERE start_s IS NOT NULL) SELECT {TIMED} FROM v")
def validate_notes(spark, d):
    s, e, i = F.col("start_s"), F.col("end_s"), F.col("note_id")
    broken = notes(spark, d).withColumn("end_s", F.when(i % 7 == 0, None).when(i % 5 == 0, s - F.lit(0.02)).when(i % 3 == 0, s + F.lit(0.001)).otherwise(e)).withColumn("start_s", F.when(i % 11 == 0, None).otherwise(s))
    return _timed(G.validate_notes(broken))


@_q("trim_overlapping", f"m AS (SELECT * REPLACE (least(end_s, coalesce(lead(start_s) OVER (PARTITION BY song_id, program, pitch, is_drum ORDER BY start_s, note_id), end_s)) AS end_s) FROM notes) SELECT {TIMED} FROM m WHERE start_s < end_s")
def trim_overlapping(spark, d):
    return _timed(G.trim_overlapping(notes(spark, d)))


@_q("track_ends", "SELECT song_id, track, round(min(start_s), 6) AS first_s, round(max(end_s), 6) AS last_s, round(max(max(end_s)) OVER (PARTITION BY song_id), 6) AS duration FROM notes GROUP BY song_id, track")
def track_ends(spark, d):
    return M.ends(notes(spark, d)).select(*TRACK, *(F.round(c, 6).alias(c) for c in ("first_s", "last_s", "duration")))


@_q("event_order", "SELECT song_id, track, note_id, row_number() OVER (PARTITION BY song_id ORDER BY start_s, is_drum, program, pitch, track, note_id) - 1 AS place FROM (SELECT * REPLACE (floor(start_s) AS start_s, note_id % 5 AS program) FROM notes)")
def event_order(spark, d):
    """Starts as whole seconds, so that the further keys decide."""
    n = notes(spark, d).withColumns({"start_s": F.floor("start_s").cast("double"), "program": F.col("note_id") % 5})
    return G.in_event_order(n).select(*TRACK, "note_id", "place")


@_q(
    "grid_places",
    """g AS (SELECT song_id, 60 + 12 * song_id AS bpm, 0.25 * (song_id % 3) AS anchor, 2 + song_id % 4 AS pulses FROM (SELECT DISTINCT song_id FROM notes)),
st AS (SELECT n.song_id, track, note_id, bpm, pulses, CAST(floor(round((start_s - anchor) / (60.0::double / bpm / 4), 6)) AS BIGINT) AS step FROM notes n JOIN g USING (song_id))
SELECT song_id, track, note_id, CAST(floor(step / (4 * pulses)) AS BIGINT) AS bar, CAST(floor((step - 4 * pulses * CAST(floor(step / (4 * pulses)) AS BIGINT)) / 4) AS BIGINT) AS pulse, step - 4 * CAST(floor(step / 4) AS BIGINT) AS sixteenth,
 round(60.0 / bpm, 6) AS pulse_s, round(60.0 / bpm * pulses, 6) AS bar_s, round(15.0 / bpm, 6) AS sixteenth_s FROM st""",
)
def grid_places(spark, d):
    """Each song with a tempo, an anchor and a number of pulses of its own."""
    n, i = notes(spark, d), F.col("song_id")
    grids = n.select("song_id").distinct().select("song_id", (60 + 12 * i).cast("double").alias("bpm"), ((i % 3) * F.lit(0.25)).alias("anchor"), (2 + i % 4).alias("pulses"))
    return M.places(n, grids).select(*TRACK, "note_id", "bar", "pulse", "sixteenth", *(F.round(c, 6).alias(c) for c in ("pulse_s", "bar_s", "sixteenth_s")))
