"""Queries on audio blocks, onset strength, matching, tokens and files. Samples are made from events by rule."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import fixed
from ..operators import merge as G
from ..operators import signal as A
from ..operators import strength as S
from ..operators.measure import onset_dedupe
from ..operators.tokens import tracked_notes as tracked
from ..schema import LAG_WINDOW, TRACK
from ..sources import midi, wav
from ..sources.notes import NOTES_SQL, notes
from .note_queries import DEDUPE

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SR = 32
SAMPLES_SQL = f"s AS (SELECT song_id, track AS stem, note_id, row_number() OVER (PARTITION BY song_id, track ORDER BY note_id) - 1 AS i, ((note_id * 37) % 200 - 100) / 150.0::double AS x FROM notes)"


def blocks(spark, d):
    place = F.row_number().over(Window.partitionBy(*TRACK).orderBy("note_id")) - 1
    s = notes(spark, d).select("song_id", F.col("track").alias("stem"), "note_id", place.alias("i"), (((F.col("note_id") * 37) % 200 - 100) / F.lit(150.0)).alias("x"))
    listed = s.groupBy("song_id", "stem", F.floor(F.col("i") / SR).alias("block_id")).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("a"))
    return listed.select("song_id", "stem", F.lit(0).alias("channel"), "block_id", F.col("block_id").cast("double").alias("t0"), F.lit(SR).alias("sr"), F.transform("a", lambda e: e["x"]).alias("samples"))


def _q(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = f"WITH RECURSIVE notes AS ({NOTES_SQL}), {sql}"
        return f

    return add


@_q("rms_db", f"{SAMPLES_SQL} SELECT song_id, stem, round(sqrt(sum(x * x) / count(*)), 6) AS rms, round(20 * log10(greatest(sqrt(sum(x * x) / count(*)), 1e-9)), 4) AS db FROM s GROUP BY ALL")
def rms_db(spark, d):
    return A.rms(blocks(spark, d)).select("song_id", "stem", F.round("rms", 6).alias("rms"), F.round("db", 4).alias("db"))


@_q("stem_levels", f"{SAMPLES_SQL} SELECT song_id, stem, (i // {SR}) // 2 AS \"window\", round(sqrt(sum(x * x) / count(*)), 6) AS rms, round(20 * log10(greatest(sqrt(sum(x * x) / count(*)), 1e-9)), 4) AS db FROM s GROUP BY ALL")
def stem_levels(spark, d):
    return A.stem_levels(blocks(spark, d), 2.0).select("song_id", "stem", "window", F.round("rms", 6).alias("rms"), F.round("db", 4).alias("db"))


@_q("louder_stems", f"{SAMPLES_SQL} SELECT song_id, stem, (max(i) // {SR}) + 1 AS blocks FROM s GROUP BY ALL HAVING 20 * log10(sqrt(sum(x * x) / count(*))) >= -8.3")
def louder_stems(spark, d):
    return A.louder_than(blocks(spark, d), -8.3).groupBy("song_id", "stem").agg(F.count("*").alias("blocks"))


@_q("mixdown", f"{SAMPLES_SQL}, m AS (SELECT song_id, i, sum(x) AS x FROM s WHERE stem <> 'view' GROUP BY ALL), g AS (SELECT song_id, CASE WHEN max(abs(x)) > 0.99 THEN 0.99 / max(abs(x)) ELSE 1 END AS gain FROM m GROUP BY song_id) SELECT song_id, i // {SR} AS block_id, i % {SR} AS i, round(x * gain, 6) + 0.0::double AS x FROM m JOIN g USING (song_id)")
def mixdown(spark, d):
    return A.mixdown(blocks(spark, d), ("view",)).select("song_id", "block_id", F.posexplode("samples").alias("i", "x")).select("song_id", "block_id", F.col("i").cast("long").alias("i"), (F.round("x", 6) + F.lit(0.0)).alias("x"))


@_q("mono_downmix", f"{SAMPLES_SQL}, j AS (SELECT a.song_id, a.i, 0.5 * (a.x + b.x) AS x FROM s a JOIN s b ON a.song_id = b.song_id AND a.i = b.i AND a.stem = 'click' AND b.stem = 'error') SELECT song_id, i // {SR} AS block_id, round(sum(x), 6) AS total, count(*) AS n FROM j GROUP BY ALL")
def mono_downmix(spark, d):
    b = blocks(spark, d)
    two = b.where("stem = 'click'").select("song_id", "block_id", F.col("samples").alias("l")).join(b.where("stem = 'error'").select("song_id", "block_id", F.col("samples").alias("r")), ["song_id", "block_id"])
    m = two.select("song_id", "block_id", F.filter(A.mono(F.col("l"), F.col("r")), lambda x: x.isNotNull()).alias("m"))
    return m.select("song_id", "block_id", F.round(F.aggregate("m", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.size("m").cast("long").alias("n"))


@_q("wave_peaks", f"{SAMPLES_SQL}, n AS (SELECT song_id, stem, count(*) AS n FROM s GROUP BY ALL) SELECT song_id, stem, i * 20 // n AS bucket, round(max(abs(x)), 6) AS peak FROM s JOIN n USING (song_id, stem) WHERE i % 4 = 0 GROUP BY ALL")
def wave_peaks(spark, d):
    return A.wave_peaks(blocks(spark, d), 20, 4).select("song_id", "stem", "bucket", F.round("peak", 6).alias("peak"))


QUIET = "CASE WHEN i // 32 < 2 OR i // 32 > 4 THEN x * 0.001 ELSE x END"


@_q("silence_trim", f"{SAMPLES_SQL}, b AS (SELECT song_id, i // {SR} AS b, max(i) AS last, sqrt(sum(power({QUIET}, 2)) / count(*)) AS r FROM s GROUP BY ALL), t AS (SELECT *, max(r) OVER (PARTITION BY song_id) AS top FROM b) SELECT song_id, min(b)::double AS \"begin\", round(max((last + 1) / {SR}.0), 6) AS \"end\" FROM t WHERE 20 * log10(r / top) > -50 GROUP BY song_id")
def silence_trim(spark, d):
    b = blocks(spark, d)
    quiet = b.withColumn("samples", F.when((F.col("block_id") < 2) | (F.col("block_id") > 4), F.transform("samples", lambda x: x * F.lit(0.001))).otherwise(F.col("samples")))
    return A.silence_bounds(quiet).select("song_id", "begin", F.round("end", 6).alias("end"))


ENV_SQL = "env AS (SELECT song_id, track, CAST(frame AS BIGINT) AS frame, exp(-abs(((frame * 0.003::double - 0.05::double) / 0.5::double) - round_even((frame * 0.003::double - 0.05::double) / 0.5::double, 0)) * 20) AS v FROM (SELECT DISTINCT song_id, track FROM notes), (SELECT unnest(range(20000)) AS frame))"


def strength(tracks):
    """tracks(song_id, track, last) -> a frame for each number up to the last."""
    t = (F.col("frame") * F.lit(0.003) - F.lit(0.05)) / F.lit(0.5)
    return tracks.select(*TRACK, F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("frame")).withColumn("v", F.exp(-F.abs(t - F.rint(t)) * 20))


def envelope(spark, d):
    return strength(notes(spark, d).select(*TRACK).distinct().withColumn("last", F.lit(19999).cast("long")))


@_q("onset_envelope", f"{ENV_SQL} SELECT song_id, track, frame, round((v - avg(v) OVER (PARTITION BY song_id, track)) / (stddev_pop(v) OVER (PARTITION BY song_id, track) + 1e-9), 5) AS v FROM env")
def onset_envelope(spark, d):
    return A.z_score(envelope(spark, d)).select(*TRACK, "frame", F.round("v", 5).alias("v"))


# Frames of 16 samples every 4, as sums over sines; mel bands; rises from frame to frame, half a window later.
N_FFT, HOP, MELS, LOCAL = 16, 4, 4, 16
_FILTERS = ", ".join(f"({m}, {k}, {w!r}::double)" for m, row in enumerate(A.mel_filters(SR, N_FFT, MELS).tolist()) for k, w in enumerate(row) if w)
STRENGTH_SQL = f"""{SAMPLES_SQL}, fl(m, k, w) AS (VALUES {_FILTERS}), ends AS (SELECT song_id, stem, count(*) AS n FROM s GROUP BY ALL),
fr AS (SELECT song_id, stem, unnest(range(n // {HOP} + 1)) AS f FROM ends), j AS (SELECT unnest(range({N_FFT})) AS j),
cut AS (SELECT fr.song_id, fr.stem, f, j, x * (0.5 - 0.5 * cos(2 * pi() * j / {N_FFT})) AS x FROM fr, j JOIN s ON s.song_id = fr.song_id AND s.stem = fr.stem AND s.i = f * {HOP} - {N_FFT // 2} + j),
dft AS (SELECT song_id, stem, f, k, power(sum(x * cos(2 * pi() * k * j / {N_FFT})), 2) + power(sum(x * sin(2 * pi() * k * j / {N_FFT})), 2) AS p FROM cut, (SELECT unnest(range({N_FFT // 2 + 1})) AS k) GROUP BY ALL),
mel AS (SELECT fr.song_id, fr.stem, fr.f, b.m, 10 * log10(greatest(coalesce(sum(p * w), 0), 1e-10)) AS db FROM fr CROSS JOIN (SELECT unnest(range({MELS})) AS m) b LEFT JOIN fl ON fl.m = b.m LEFT JOIN dft ON dft.song_id = fr.song_id AND dft.stem = fr.stem AND dft.f = fr.f AND dft.k = fl.k GROUP BY ALL),
cl AS (SELECT song_id, stem, f, m, greatest(db, max(db) OVER (PARTITION BY song_id, stem) - 80) AS db FROM mel), up AS (SELECT song_id, stem, f, avg(greatest(coalesce(d, 0), 0)) AS v FROM (SELECT *, db - lag(db) OVER (PARTITION BY song_id, stem, m ORDER BY f) AS d FROM cl) GROUP BY ALL),
env AS (SELECT fr.song_id, fr.stem, fr.f AS frame, coalesce(v, 0) AS v FROM fr LEFT JOIN up ON up.song_id = fr.song_id AND up.stem = fr.stem AND up.f = fr.f - {N_FFT // (2 * HOP)})"""


def sound_strength(spark, d):
    return S.onset_strength(blocks(spark, d), HOP / SR, N_FFT, MELS)


@_q("onset_strength", f"{STRENGTH_SQL} SELECT song_id, stem, frame, round(frame * {HOP} / {SR}.0, 6) AS t, round(v, 5) AS v FROM env")
def onset_strength(spark, d):
    """From the sound itself: spectra of frames that cross blocks."""
    return sound_strength(spark, d).select("song_id", "stem", "frame", F.round("t", 6).alias("t"), F.round("v", 5).alias("v"))


@_q("tempogram", f"""{STRENGTH_SQL}, x AS (SELECT a.song_id, a.stem, a.frame, j, b.v * (0.5 - 0.5 * cos(2 * pi() * j / {LOCAL})) AS x FROM env a, (SELECT unnest(range({LOCAL})) AS j) JOIN env b ON a.song_id = b.song_id AND a.stem = b.stem AND b.frame = a.frame - {LOCAL // 2} + j),
ac AS (SELECT a.song_id, a.stem, a.frame, b.j - a.j AS lag, sum(a.x * b.x) AS c FROM x a JOIN x b ON a.song_id = b.song_id AND a.stem = b.stem AND a.frame = b.frame AND b.j >= a.j GROUP BY ALL),
nm AS (SELECT song_id, stem, lag, CASE WHEN max(c) OVER w > 1e-12 THEN c / max(c) OVER w ELSE c END AS c FROM ac WINDOW w AS (PARTITION BY song_id, stem, frame)), n AS (SELECT song_id, stem, count(*) AS n FROM env GROUP BY ALL)
SELECT song_id, stem, CAST(l.lag AS INT) AS lag, round(coalesce(c, 0) / n, 6) AS strength FROM n CROSS JOIN (SELECT unnest(range({LOCAL})) AS lag) l LEFT JOIN (SELECT song_id, stem, lag, sum(c) AS c FROM nm GROUP BY ALL) t USING (song_id, stem, lag)""")
def tempogram(spark, d):
    """How strongly the sound repeats after each lag, on the mean of all windows of 16 frames."""
    return S.tempogram(sound_strength(spark, d), LOCAL).select("song_id", "stem", "lag", F.round("strength", 6).alias("strength"))


@_q("audio_tempo")
def audio_tempo(spark, d):
    """Tempo of each stem's sound; held against clicks of known tempi in the tests."""
    found, _ = S.audio_tempo(blocks(spark, d), HOP / SR, 64, N_FFT, MELS)
    return found.select("song_id", "stem", F.round("bpm", 3).alias("bpm"))


@_q("trim_frames", f"""{SAMPLES_SQL}, q AS (SELECT song_id, i, {QUIET} AS x FROM s), ends AS (SELECT song_id, max(i) + 1 AS n FROM q GROUP BY ALL), fr AS (SELECT song_id, n, unnest(range(n // 8 + 1)) AS f FROM ends),
p AS (SELECT song_id, i // 8 AS c, sum(x * x) AS p FROM q GROUP BY ALL), m AS (SELECT fr.song_id, n, f, coalesce(sum(p), 0) / 32 AS m FROM fr LEFT JOIN p ON p.song_id = fr.song_id AND p.c BETWEEN f - 2 AND f + 1 GROUP BY ALL),
t AS (SELECT *, max(m) OVER (PARTITION BY song_id) AS top FROM m) SELECT song_id, round(min(f) * 8 / 32.0, 6) AS "begin", round(max(least((f + 1) * 8, n)) / 32.0, 6) AS "end" FROM t WHERE 10 * log10(greatest(m, 1e-10)) - 10 * log10(greatest(top, 1e-10)) > -50 GROUP BY song_id""")
def trim_frames(spark, d):
    """Silence at both ends by frames of 32 samples every 8, across blocks."""
    quiet = blocks(spark, d).withColumn("samples", F.when((F.col("block_id") < 2) | (F.col("block_id") > 4), F.transform("samples", lambda x: x * F.lit(0.001))).otherwise(F.col("samples")))
    return S.trim_bounds(quiet, 50.0, 8, 4).select("song_id", F.round("begin", 6).alias("begin"), F.round("end", 6).alias("end"))


LAG_STEPS = int(2 * LAG_WINDOW / 0.001 + 1e-6) + 1
LAGS = f"""o AS (SELECT song_id, track, round_even(start_s * 2, 0) / 2 AS start_s, row_number() OVER (PARTITION BY song_id, track ORDER BY round_even(start_s * 2, 0), note_id) AS r FROM notes), onsets AS (SELECT DISTINCT song_id, track, start_s AS t FROM o),
x AS (SELECT song_id, track, i, (t - ({-LAG_WINDOW}::double + i * 0.001::double)) / 0.003::double AS x FROM onsets, (SELECT unnest(range({LAG_STEPS})) AS i)),
w AS (SELECT song_id, track, i, x - floor(x) AS f, floor(x) AS frame, exp(-abs((floor(x) * 0.003 - 0.05::double) / 0.5 - round_even((floor(x) * 0.003 - 0.05::double) / 0.5, 0)) * 20) AS v,
 exp(-abs(((floor(x) + 1) * 0.003 - 0.05::double) / 0.5 - round_even(((floor(x) + 1) * 0.003 - 0.05::double) / 0.5, 0)) * 20) AS u FROM x),
z AS (SELECT song_id, track, i, avg(CASE WHEN frame < 0 THEN 0 ELSE v * (1 - f) + u * f END) AS score FROM w GROUP BY ALL)"""


@_q("audio_lag", f"{LAGS} SELECT song_id, track, round({-LAG_WINDOW}::double + arg_max(i, struct_pack(s := round(score, 9), j := -i)) * 0.001::double, 3) AS lag, round(arg_max(score, struct_pack(s := round(score, 9), j := -i)), 5) AS score FROM z GROUP BY ALL")
def audio_lag(spark, d):
    """601 lags of every onset. Onsets lie half a second apart at least, so none is a chord's."""
    regular = onset_dedupe(notes(spark, d).withColumn("start_s", F.rint(F.col("start_s") * 2) / 2))
    # Every lag of the last onset is within the envelope.
    ends = regular.groupBy(*TRACK).agg(F.ceil((F.max("t") + LAG_WINDOW) / 0.003 + 1).alias("last"))
    return A.audio_lag(regular, strength(ends), 0.003).select(*TRACK, F.round("lag", 3).alias("lag"), F.round("score", 5).alias("score"))


# Pair by pair, nearest first, with the notes used so far.
F1 = """est AS (SELECT song_id, track, note_id, start_s + ((note_id * 13) % 11 - 5) / 100.0::double AS t FROM notes WHERE note_id % 7 <> 0),
p AS (SELECT n.song_id, n.track, n.note_id AS a, e.note_id AS b, row_number() OVER (PARTITION BY n.song_id, n.track ORDER BY abs(n.start_s - e.t), n.start_s, n.note_id, e.t, e.note_id) AS i FROM notes n JOIN est e ON n.song_id = e.song_id AND n.track = e.track AND abs(n.start_s - e.t) <= 0.05::double),
g AS (SELECT song_id, track, 0::BIGINT AS i, []::BIGINT[] AS ua, []::BIGINT[] AS ub FROM (SELECT DISTINCT song_id, track FROM p) UNION ALL
 SELECT p.song_id, p.track, p.i, CASE WHEN list_contains(ua, a) OR list_contains(ub, b) THEN ua ELSE list_append(ua, a) END, CASE WHEN list_contains(ua, a) OR list_contains(ub, b) THEN ub ELSE list_append(ub, b) END FROM g JOIN p ON p.song_id = g.song_id AND p.track = g.track AND p.i = g.i + 1),
m AS (SELECT song_id, track, CAST(max(len(ua)) AS BIGINT) AS m FROM g GROUP BY ALL), r AS (SELECT song_id, track, count(*) AS r FROM notes GROUP BY ALL), e AS (SELECT song_id, track, count(*) AS e FROM est GROUP BY ALL)
SELECT song_id, track, coalesce(r, 0) AS r, coalesce(e, 0) AS e, coalesce(m, 0) AS m, round(2 * coalesce(m, 0) / (coalesce(r, 0) + coalesce(e, 0)), 6) AS f1 FROM r FULL JOIN e USING (song_id, track) LEFT JOIN m USING (song_id, track)"""


@_q("onset_f1", F1)
def onset_f1(spark, d):
    """Greedy one-to-one matching, nearest first."""
    n = notes(spark, d)
    moved = n.where("note_id % 7 <> 0").withColumn("start_s", F.col("start_s") + ((F.col("note_id") * 13) % 11 - 5) / F.lit(100.0))
    return A.onset_f1(n, moved).select(*TRACK, "r", "e", "m", F.round("f1", 6).alias("f1"))


def tokens(spark, d):
    listed = notes(spark, d).groupBy("song_id").agg(F.array_sort(F.collect_list(F.struct("note_id", "pitch", "velocity"))).alias("a"))
    flat = F.flatten(F.transform("a", lambda n: F.array((4 + n["note_id"] % 296).cast("int"), (300 + n["pitch"]).cast("int"), (400 + n["velocity"]).cast("int"))))
    return listed.select(F.col("song_id").alias("clip_id"), F.concat(F.array(F.lit(2)), flat, F.array(F.lit(3))).alias("tokens"))


@_q("decode_tokens", "n AS (SELECT song_id, note_id, pitch, velocity, row_number() OVER (PARTITION BY song_id ORDER BY note_id) - 1 AS k FROM notes) SELECT song_id AS clip_id, k AS note_id, pitch, velocity, round((note_id % 296) / 100.0::double, 6) AS start_s, round((note_id % 296) / 100.0::double + 0.1::double, 6) AS end_s FROM n")
def decode_tokens(spark, d):
    return A.decode_tokens(tokens(spark, d)).select("clip_id", "note_id", "pitch", "velocity", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))


def model_events(spark, d):
    """Tokens of a model that writes five seconds at a time and ties all even pitches over every seam."""
    frame, chunk = F.rint(F.col("start_s") * 100), F.floor(F.col("start_s") / 5)
    n = notes(spark, d).select(*TRACK, "note_id", "pitch", "velocity", frame.cast("int").alias("frame"), chunk.alias("chunk"))
    ends = n.groupBy(*TRACK).agg(F.max("chunk").alias("end"))
    n = n.join(ends, TRACK).withColumns({"seek": F.col("chunk") * 5.0, "next_seek": F.when(F.col("chunk") < F.col("end"), (F.col("chunk") + 1) * 5.0)})
    place = F.row_number().over(Window.partitionBy(*TRACK, "chunk").orderBy("frame", "note_id")) * 10 + 100
    token = lambda i, kind, value: F.struct((F.col("place") + i).cast("long").alias("i"), F.lit(kind).alias("type"), value.cast("int").alias("value"))
    body = n.withColumn("place", place).withColumn("e", F.explode(F.array(token(0, "shift", F.col("frame") - F.col("chunk") * 500), token(1, "program", F.lit(0)), token(2, "velocity", F.col("velocity")), token(3, "pitch", F.col("pitch")))))
    ties = F.concat(F.array(token(0, "program", F.lit(0))), F.transform(F.sequence(F.lit(0), F.lit(120), F.lit(2)), lambda p: F.struct((p + 1).cast("long").alias("i"), F.lit("pitch").alias("type"), p.cast("int").alias("value"))), F.array(F.struct(F.lit(130).cast("long").alias("i"), F.lit("tie").alias("type"), F.lit(0).alias("value"))))
    head = n.select(*TRACK, "chunk", "seek", "next_seek").distinct().withColumn("place", F.lit(0)).withColumn("e", F.explode(ties))
    body = body.withColumn("e", F.struct((F.col("e.i") + 1000).alias("i"), F.col("e.type").alias("type"), F.col("e.value").alias("value")))
    return head.unionByName(body, allowMissingColumns=True).select(*TRACK, "chunk", "seek", "next_seek", "e.*")


@_q("tracked_notes", """n AS (SELECT song_id, track, note_id, pitch, CAST(round_even(start_s * 100, 0) AS BIGINT) AS frame, CAST(floor(start_s / 5) AS BIGINT) AS chunk FROM notes), e AS (SELECT song_id, track, max(chunk) AS last FROM n GROUP BY ALL), c AS (SELECT DISTINCT song_id, track, chunk FROM n),
o AS (SELECT n.* FROM n JOIN e USING (song_id, track) WHERE chunk = last OR frame < (chunk + 1) * 500), x AS (SELECT *, lead(frame) OVER (PARTITION BY song_id, track, pitch ORDER BY chunk, frame, note_id) AS again FROM o)
SELECT x.song_id, x.track, 0 AS program, pitch, round(frame / 100.0::double, 4) AS start_s, round(coalesce(least(again, CASE WHEN pitch % 2 = 1 THEN c.chunk * 500 END), frame + 1) / 100.0::double, 4) AS end_s FROM x LEFT JOIN c ON c.song_id = x.song_id AND c.track = x.track AND c.chunk = x.chunk + 1""")
def tracked_notes(spark, d):
    """Notes over the seams of a model's chunks: the next of their pitch or the first seam not tied over ends them."""
    return tracked(model_events(spark, d)).select(*TRACK, "program", "pitch", F.round("start_s", 4).alias("start_s"), F.round("end_s", 4).alias("end_s"))


@_q("chunked_audio", f"{SAMPLES_SQL} SELECT song_id, stem, i // 96 AS chunk, 96 AS n, round(sum(x), 5) AS total, round(sum(x * (i % 96)), 4) AS weighted FROM s GROUP BY ALL")
def chunked_audio(spark, d):
    """Chunks of 96 samples, the last filled up with zeros."""
    c = A.chunked(blocks(spark, d).withColumn("first", F.col("block_id") * SR), 96)
    add = lambda a, x: a + x
    zero = F.lit(0.0)
    return c.select("song_id", "stem", "chunk", F.size("samples").alias("n"), F.round(F.aggregate("samples", zero, add), 5).alias("total"), F.round(F.aggregate(F.transform("samples", lambda x, i: x * i), zero, add), 4).alias("weighted"))


@_q("midi_roundtrip", """d AS (SELECT * REPLACE (start_s * 3 + note_id % 2 * 400 AS start_s) FROM notes), t AS (SELECT song_id, track, pitch, velocity, CAST(round_even(note_id * 0.25 * 960, 0) AS BIGINT) AS a FROM d)
SELECT song_id, track, count(*) AS n, CAST(sum(pitch) AS BIGINT) AS pitches, CAST(sum(velocity) AS BIGINT) AS velocities, round(sum(a / 960.0), 4) AS starts FROM t GROUP BY ALL""")
def midi_roundtrip(spark, d):
    """Notes written as files and read again; every note at a time of its own, as a pitch can't sound twice."""
    apart = notes(spark, d).withColumn("start_s", F.col("note_id") * F.lit(0.25)).withColumn("end_s", F.col("start_s") + 0.1)
    files = midi.to_files(apart)

    def parsed(frames):
        import pandas as pd

        for frame in frames:
            for song, data in zip(frame["song_id"], frame["midi"]):
                for some in midi.slabs((song, row[2], row[6], row[7], row[10]) for row in midi.rows("", bytes(data))):
                    yield pd.DataFrame(some, columns=["song_id", "track", "pitch", "velocity", "start_s"])

    back = files.mapInPandas(parsed, "song_id long, track string, pitch int, velocity int, start_s double")
    return back.groupBy(*TRACK).agg(F.count("*").alias("n"), F.sum("pitch").alias("pitches"), F.sum("velocity").alias("velocities"), F.round(F.sum("start_s"), 4).alias("starts"))


@_q("wav_roundtrip", f"{SAMPLES_SQL}, p AS (SELECT song_id, stem, CASE WHEN x < 0 THEN trunc(x * 32768) ELSE trunc(x * 32767) END / 32768 AS y FROM s) SELECT song_id, stem, count(*) AS n, round(sum(y), 5) AS total, round(count(*) / {SR}.0, 6) AS seconds FROM p GROUP BY ALL")
def wav_roundtrip(spark, d):
    """Samples written as 16-bit WAV and read again."""

    def again(rate, x):
        data = wav.encode(rate, x)
        _, y = wav.decode(data)
        return [{"n": len(y), "total": round(float(y.astype(float).sum()), 5), "seconds": round(wav.duration(data), 6)}]

    return A.by_stem(blocks(spark, d), again, "n long, total double, seconds double").select("song_id", "stem", "n", "total", "seconds")


@_q("spectral_share", f"""{SAMPLES_SQL}, n AS (SELECT song_id, stem, count(*) AS n FROM s GROUP BY ALL), k AS (SELECT song_id, stem, n, unnest(range(n // 2 + 1)) AS k FROM n),
p AS (SELECT song_id, stem, k, any_value(n) AS n, power(sum(x * cos(2 * pi() * ((k * i) % n) / n)), 2) + power(sum(x * sin(2 * pi() * ((k * i) % n) / n)), 2) + 1e-12 AS p FROM k JOIN s USING (song_id, stem) GROUP BY ALL)
SELECT song_id, stem, round(coalesce(sum(p) FILTER (k * {SR} / n >= 5 AND k * {SR} / n < 10), 0) / sum(p), 6) AS share, round(exp(avg(ln(p))) / avg(p), 6) AS flatness FROM p GROUP BY ALL""")
def spectral_share(spark, d):
    """Share of the power between 5 and 10 Hz, and flatness, of each stem."""

    def share(rate, x):
        a, b = A.spectral_share(x, rate, 5.0, 10.0)
        return [{"share": round(a, 6), "flatness": round(b, 6)}]

    return A.by_stem(blocks(spark, d), share, "share double, flatness double").select("song_id", "stem", "share", "flatness")


@_q("freeze_notes", "m AS (SELECT song_id, track, pitch, velocity, note_id, start_s - 20 AS a, end_s - 20 AS b FROM notes), c AS (SELECT *, greatest(a, 0) AS s, least(b, 40) AS e FROM m WHERE b > 0 AND a < 40) SELECT song_id, track, count(*) AS n, concat('[', string_agg(concat('[', printf('%.4f', s), ',', printf('%.4f', e), ',', pitch, ',', velocity, ']'), ',' ORDER BY s, pitch, note_id), ']') AS notes FROM c GROUP BY ALL")
def freeze_notes(spark, d):
    n = G.clip(G.shift(notes(spark, d), F.lit(-20.0)), 40.0)
    row = F.concat(F.lit("["), fixed(F.col("start_s"), 4), F.lit(","), fixed(F.col("end_s"), 4), F.lit(","), F.col("pitch").cast("string"), F.lit(","), F.col("velocity").cast("string"), F.lit("]"))
    listed = n.groupBy(*TRACK).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("start_s", "pitch", "note_id", row.alias("j")))).alias("a"))
    return listed.select(*TRACK, "n", F.concat(F.lit("["), F.array_join(F.transform("a", lambda x: x["j"]), ","), F.lit("]")).alias("notes"))
