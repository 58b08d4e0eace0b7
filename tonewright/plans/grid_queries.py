"""Queries on the constant grid. Most run on the notes with a planted grid of 114 beats a minute."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import grid as G
from ..operators.measure import onset_dedupe
from ..schema import SEARCH_HIGH, SEARCH_LOW, SEARCH_STEP, TEMPO_PRIOR, TRACK
from ..sources.notes import ANCHOR, BPM, GRIDDED_SQL, NOTES_SQL, SIX, gridded, notes
from .note_queries import DEDUPE, ROW

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SIX_SQL, ANCHOR_SQL = f"{SIX!r}::double", f"{ANCHOR}::double"
BEAT = 60.0 / BPM


def _q(name: str, sql: str | None = None, source: str = GRIDDED_SQL):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = f"WITH RECURSIVE notes AS ({source}), {sql}" if sql.lstrip()[0] != "S" else f"WITH notes AS ({source}) {sql}"
        return f

    return add


def fmod(x: str, s: str) -> str:
    return f"(({x}) - ({s}) * floor(({x}) / ({s})))"


def signed(t: str) -> str:
    return f"({fmod(f'{t} - {ANCHOR_SQL} + {SIX_SQL} / 2', SIX_SQL)} - {SIX_SQL} / 2)"


@_q("alignment", f"{DEDUPE} SELECT song_id, track, count(*) AS n, round(sqrt(power(avg(cos(2 * pi() * t / {SIX_SQL})), 2) + power(avg(sin(2 * pi() * t / {SIX_SQL})), 2)), 6) AS r, round(atan2(avg(sin(2 * pi() * t / {SIX_SQL})), avg(cos(2 * pi() * t / {SIX_SQL}))), 6) AS phase FROM onsets GROUP BY song_id, track")
def alignment(spark, d):
    return G.alignment(onset_dedupe(gridded(spark, d)), SIX).select(*TRACK, "n", F.round("r", 6).alias("r"), F.round("phase", 6).alias("phase"))


PERIODS = "p AS (SELECT i, (60 / 112.0::double / 4) * (0.97::double + i * (0.06::double / 6000)) AS six FROM (SELECT unnest(range(6001)) AS i))"
FITS = f"""{PERIODS}, z AS (SELECT song_id, track, i, six, avg(cos(2 * pi() * t / six)) AS x, avg(sin(2 * pi() * t / six)) AS y, count(*) AS n FROM onsets, p GROUP BY ALL),
f AS (SELECT song_id, track, arg_max(struct_pack(bpm := 60 / (4 * six), r := sqrt(x * x + y * y), n := n), struct_pack(r := sqrt(x * x + y * y), j := -i)) AS b FROM z GROUP BY ALL)"""


@_q("grid_fit", f"{DEDUPE}, {FITS} SELECT song_id, track, b.n AS n, round(b.bpm, 4) AS bpm, round(b.r, 6) AS r FROM f")
def grid_fit(spark, d):
    return G.fit(onset_dedupe(gridded(spark, d)), 112.0).select(*TRACK, "n", F.round("bpm", 4).alias("bpm"), F.round("r", 6).alias("r"))


N_TEMPI = math.ceil((math.log(SEARCH_HIGH) - math.log(SEARCH_LOW)) / SEARCH_STEP)
# All tempi; of the runs of near-best ones the peak nearest the prior; then the periods around it.
SEARCHED = f"""s AS (SELECT i, exp(ln({SEARCH_LOW}::double) + i * {SEARCH_STEP}::double) AS bpm FROM (SELECT unnest(range({N_TEMPI})) AS i)), z AS (SELECT song_id, track, i, bpm, sqrt(power(avg(cos(2 * pi() * t * bpm / 15)), 2) + power(avg(sin(2 * pi() * t * bpm / 15)), 2)) AS r FROM onsets, s GROUP BY ALL),
good AS (SELECT *, i - row_number() OVER (PARTITION BY song_id, track ORDER BY i) AS run FROM (SELECT *, max(r) OVER (PARTITION BY song_id, track) AS top FROM z) WHERE r >= 0.95 * top), peak AS (SELECT song_id, track, arg_max(bpm, struct_pack(r := r, j := -i)) AS bpm, arg_max(i, struct_pack(r := r, j := -i)) AS i FROM good GROUP BY song_id, track, run),
near AS (SELECT song_id, track, arg_min(bpm, struct_pack(d := abs(ln(bpm / {TEMPO_PRIOR})), i := i)) AS bpm FROM peak GROUP BY ALL), c AS (SELECT song_id, track, i, 15 / bpm * (0.998::double + i * (0.004::double / 2000)) AS six FROM near, (SELECT unnest(range(2001)) AS i)),
f AS (SELECT song_id, track, i, six, count(*) AS n, sqrt(power(avg(cos(2 * pi() * t / six)), 2) + power(avg(sin(2 * pi() * t / six)), 2)) AS r FROM onsets JOIN c USING (song_id, track) GROUP BY ALL)"""


@_q("grid_search", f"{DEDUPE}, {SEARCHED} SELECT song_id, track, max(n) AS n, round(15 / arg_max(six, struct_pack(r := r, j := -i)), 4) AS bpm, round(max(r), 6) AS r FROM f GROUP BY song_id, track")
def grid_search(spark, d):
    return G.fit(onset_dedupe(gridded(spark, d))).select(*TRACK, "n", F.round("bpm", 4).alias("bpm"), F.round("r", 6).alias("r"))


@_q("fit_tracks", f"{DEDUPE}, {FITS} SELECT song_id, arg_max(track, b.r) AS track, round(arg_max(b.bpm, b.r), 4) AS bpm, round(max(b.r), 6) AS r, count(*) AS n_tracks FROM f WHERE b.n >= 64 GROUP BY song_id")
def fit_tracks(spark, d):
    return G.fit_tracks(onset_dedupe(gridded(spark, d)), 112.0).select("song_id", "track", F.round("bpm", 4).alias("bpm"), F.round("r", 6).alias("r"), "n_tracks")


# A tempo of its own for each song, over all that the contract allows, and a guess one part in a hundred above it.
OWN_BPM = "(20 + 42 * song_id)::double"
OWN_GRID = f"""SELECT * EXCLUDE (start_s, six) REPLACE (end_s AS end_s), {ANCHOR_SQL} + round_even(start_s / six, 0) * six + (velocity % 5 - 2) / 1000::double AS start_s FROM (SELECT *, 15 / {OWN_BPM} AS six FROM ({NOTES_SQL}))"""
OWN_FITS = f"""p AS (SELECT song_id, i, (60 / ({OWN_BPM} * 1.01::double) / 4) * (0.97::double + i * (0.06::double / 6000)) AS six FROM (SELECT DISTINCT song_id FROM notes), (SELECT unnest(range(6001)) AS i)),
z AS (SELECT song_id, track, i, six, avg(cos(2 * pi() * t / six)) AS x, avg(sin(2 * pi() * t / six)) AS y, count(*) AS n FROM onsets JOIN p USING (song_id) GROUP BY ALL),
f AS (SELECT song_id, track, arg_max(struct_pack(bpm := 60 / (4 * six), r := sqrt(x * x + y * y), n := n), struct_pack(r := sqrt(x * x + y * y), j := -i)) AS b FROM z GROUP BY ALL)"""


@_q("fit_by_song", f"{DEDUPE}, {OWN_FITS} SELECT song_id, track, b.n AS n, round(b.bpm, 4) AS bpm, round(b.r, 6) AS r FROM f", OWN_GRID)
def fit_by_song(spark, d):
    """A table of tempi, 20 to 398: each song's onsets meet the periods around its own."""
    own = (F.lit(20) + 42 * F.col("song_id")).cast("double")
    n = notes(spark, d).withColumn("_six", 15 / own)
    n = n.withColumn("start_s", F.lit(ANCHOR) + F.rint(F.col("start_s") / F.col("_six")) * F.col("_six") + (F.col("velocity") % 5 - 2) / F.lit(1000.0)).drop("_six")
    guesses = n.select("song_id").distinct().withColumn("bpm", own * 1.01)
    return G.fit(onset_dedupe(n), guesses).select(*TRACK, "n", F.round("bpm", 4).alias("bpm"), F.round("r", 6).alias("r"))


# For the pulse, its half and its third: the best track's grid, its anchor on the busiest sixteenth, and how far that track's onsets lie from its pulses.
PULSES = f"""{PERIODS}, z AS (SELECT song_id, track, d, i, six / d AS six, avg(cos(2 * pi() * t * d / six)) AS x, avg(sin(2 * pi() * t * d / six)) AS y FROM onsets, p, (SELECT unnest([1, 2, 3]) AS d) GROUP BY ALL HAVING count(*) >= 64),
f AS (SELECT song_id, track, d, arg_max(struct_pack(six := six, x := x, y := y, r := sqrt(x * x + y * y)), struct_pack(r := sqrt(x * x + y * y), j := -i)) AS b FROM z GROUP BY ALL),
g0 AS (SELECT song_id, d, arg_max(track, b.r) AS track, arg_max(b, b.r) AS b FROM f GROUP BY song_id, d HAVING max(b.r) >= 0.5), g1 AS (SELECT song_id, d, track, b.six AS six, b.r AS r, {fmod('atan2(b.y, b.x) / (2 * pi()) * b.six', 'b.six')} AS anchor FROM g0),
busy AS (SELECT song_id, d, CAST({fmod('round_even((t - anchor) / six, 0)', '4')} AS INT) AS k, count(*) AS n FROM onsets JOIN (SELECT song_id, d, six, anchor FROM g1) USING (song_id) GROUP BY ALL),
g2 AS (SELECT g1.*, anchor + k * six AS on_beat FROM g1 JOIN (SELECT song_id, d, arg_max(k, struct_pack(n := n, j := -k)) AS k FROM busy GROUP BY ALL) USING (song_id, d)),
s1 AS (SELECT song_id, track, d, 15 / max(six) AS bpm, max(on_beat) AS anchor, max(r) AS r, avg(abs({fmod('t - on_beat + 2 * six', '(4 * six)')} - 2 * six)) AS po FROM g2 JOIN onsets USING (song_id, track) GROUP BY ALL)"""


def _finer(before: str, d: int, name: str) -> str:
    """The coarser pulse kept so far, unless that of factor ``d`` is clearly nearer and mostly played."""
    return f"""{name}f AS (SELECT * FROM s1 WHERE d = {d}), {name}e AS (SELECT f.song_id, f.track, 60 / f.bpm AS p, f.anchor AS fa, 60 / k.bpm AS c, k.anchor AS ca, min(t) AS a, max(t) AS b FROM {name}f f JOIN {before} k ON f.song_id = k.song_id JOIN onsets o ON o.song_id = f.song_id AND o.track = f.track GROUP BY ALL HAVING count(*) >= 2),
{name}x AS (SELECT song_id, track, p, fa + k * p AS x FROM (SELECT *, unnest(range(CAST(ceil((a - fa) / p) AS BIGINT), CAST(floor((b - fa) / p) AS BIGINT) + 1)) AS k FROM {name}e) WHERE abs({fmod('fa + k * p - ca + c / 2', 'c')} - c / 2) > p / 4),
{name}o AS (SELECT song_id, avg(CASE WHEN (SELECT min(abs(t - x.x)) FROM onsets n WHERE n.song_id = x.song_id AND n.track = x.track) <= x.p / 4 THEN 1.0 ELSE 0.0 END) AS filled FROM {name}x x GROUP BY song_id),
{name} AS (SELECT coalesce(k.song_id, f.song_id) AS song_id, CASE WHEN k.song_id IS NULL OR coalesce(f.po < 0.5 * k.po AND f.po < k.po - 0.002 AND coalesce(filled, 0) >= 0.6, false) THEN struct_pack(track := f.track, d := f.d, bpm := f.bpm, anchor := f.anchor, r := f.r, po := f.po)
 ELSE struct_pack(track := k.track, d := k.d, bpm := k.bpm, anchor := k.anchor, r := k.r, po := k.po) END AS b FROM {before} k FULL JOIN {name}f f ON k.song_id = f.song_id LEFT JOIN {name}o o ON o.song_id = k.song_id),
{name}u AS (SELECT song_id, b.track AS track, b.d AS d, b.bpm AS bpm, b.anchor AS anchor, b.r AS r, b.po AS po FROM {name})"""


@_q("fit_pulse", f"{DEDUPE}, {PULSES}, k1 AS (SELECT * FROM s1 WHERE d = 1), {_finer('k1', 2, 'two')}, {_finer('twou', 3, 'three')} SELECT song_id, track, CAST(d AS INT) AS factor, round(bpm, 4) AS bpm, round(r, 6) AS r, round(po, 6) AS pulse_offset FROM threeu")
def fit_pulse(spark, d):
    """Bar in eighths: pulse, half and third compared."""
    return G.fit_pulse(onset_dedupe(gridded(spark, d)), 112.0, den=8).select("song_id", "track", "factor", F.round("bpm", 4).alias("bpm"), F.round("r", 6).alias("r"), F.round("pulse_offset", 6).alias("pulse_offset"))


@_q("align_to_beats", f"{DEDUPE}, k AS (SELECT song_id, CAST({fmod(f'round_even((t - {ANCHOR_SQL}) / {SIX_SQL}, 0)', '4')} AS INT) AS k, count(*) AS n FROM onsets GROUP BY ALL) SELECT song_id, arg_max(k, struct_pack(n := n, j := -k)) AS k, round({ANCHOR_SQL} + arg_max(k, struct_pack(n := n, j := -k)) * {SIX_SQL}, 6) AS anchor FROM k GROUP BY song_id")
def align_to_beats(spark, d):
    n = gridded(spark, d)
    grids = n.select("song_id").distinct().withColumns({"bpm": F.lit(BPM), "anchor": F.lit(ANCHOR)})
    return G.align_to_beats(onset_dedupe(n), grids).select("song_id", "k", F.round("anchor", 6).alias("anchor"))


@_q("pulse_offset", f"{DEDUPE} SELECT song_id, track, round(avg(abs({fmod(f't - {ANCHOR_SQL} + {BEAT!r} / 2', repr(BEAT))} - {BEAT!r} / 2)), 6) AS pulse_offset FROM onsets GROUP BY song_id, track")
def pulse_offset(spark, d):
    n = gridded(spark, d)
    grids = n.select("song_id").distinct().withColumns({"bpm": F.lit(BPM), "anchor": F.lit(ANCHOR)})
    return G.pulse_offset(onset_dedupe(n), grids, TRACK).select(*TRACK, F.round("pulse_offset", 6).alias("pulse_offset"))


P2 = BEAT / 2


@_q("off_fill", f"""{DEDUPE}, e AS (SELECT song_id, track, min(t) AS a, max(t) AS b FROM onsets GROUP BY ALL HAVING count(*) >= 2),
x AS (SELECT song_id, track, {ANCHOR_SQL} + k * {P2!r} AS x FROM (SELECT *, unnest(range(CAST(ceil((a - {ANCHOR_SQL}) / {P2!r}) AS BIGINT), CAST(floor((b - {ANCHOR_SQL}) / {P2!r}) AS BIGINT) + 1)) AS k FROM e)),
offp AS (SELECT * FROM x WHERE abs({fmod(f'x - {ANCHOR_SQL} + {BEAT!r} / 2', repr(BEAT))} - {BEAT!r} / 2) > {P2!r} / 4)
SELECT o.song_id, o.track, round(avg(CASE WHEN (SELECT min(abs(t - o.x)) FROM onsets n WHERE n.song_id = o.song_id AND n.track = o.track) <= {P2!r} / 4 THEN 1.0 ELSE 0.0 END), 6) AS off_fill FROM offp o GROUP BY ALL""")
def off_fill(spark, d):
    n = gridded(spark, d)
    grids = n.select(*TRACK).distinct().withColumns({"fine_bpm": F.lit(2 * BPM), "fine_anchor": F.lit(ANCHOR), "coarse_bpm": F.lit(BPM), "coarse_anchor": F.lit(ANCHOR)})
    return G.off_fill(onset_dedupe(n), grids).select(*TRACK, F.round("off_fill", 6).alias("off_fill"))


FIRST = ANCHOR - math.ceil(ANCHOR / BEAT) * BEAT
OFFSET = math.ceil(ANCHOR / BEAT)


def chroma_sql(source: str, first: str, beat: str) -> str:
    """Seconds of each pitch class in each pulse of ``source``, whose pulses begin at ``first``."""
    return f"""pit AS (SELECT * FROM {source} WHERE NOT is_drum), fin AS (SELECT song_id, CAST(ceil((max(end_s) - {first}) / {beat}) AS BIGINT) - 1 AS last FROM pit GROUP BY song_id),
spread AS (SELECT song_id, pitch, start_s, end_s, unnest(range(greatest(CAST(floor((start_s - {first}) / {beat}) AS BIGINT), 0), least(CAST(floor((end_s - {first}) / {beat}) AS BIGINT), last) + 1)) AS beat FROM pit JOIN fin USING (song_id)),
ov AS (SELECT song_id, beat, pitch % 12 AS pc, least(end_s, {first} + beat * {beat} + {beat}) - greatest(start_s, {first} + beat * {beat}) AS w FROM spread),
chroma AS (SELECT song_id, beat, pc, sum(w) AS w FROM ov WHERE w > 0 GROUP BY ALL)"""


CHROMA = chroma_sql("notes", f"{FIRST!r}::double", f"{BEAT!r}::double")
CHANGED = """nrm AS (SELECT song_id, beat, sqrt(sum(w * w)) AS norm FROM chroma GROUP BY ALL), dot AS (SELECT a.song_id, a.beat, sum(a.w * b.w) AS dot FROM chroma a JOIN chroma b ON a.song_id = b.song_id AND a.pc = b.pc AND a.beat = b.beat + 1 GROUP BY ALL),
chg AS (SELECT song_id, beat, coalesce(change, 0) AS change FROM (SELECT song_id, unnest(range(last + 1)) AS beat FROM fin) LEFT JOIN
 (SELECT x.song_id, x.beat, 1 - coalesce(dot, 0) / x.norm / y.norm AS change FROM nrm x JOIN nrm y ON x.song_id = y.song_id AND x.beat = y.beat + 1 LEFT JOIN dot ON dot.song_id = x.song_id AND dot.beat = x.beat) USING (song_id, beat))"""
CHANGE = f"{CHROMA}, {CHANGED}"


@_q("chroma", f"{CHROMA} SELECT song_id, beat, CAST(pc AS INT) AS pc, round(w, 6) AS w FROM chroma")
def chroma(spark, d):
    return G.chroma(gridded(spark, d), BPM, ANCHOR).select("song_id", "beat", "pc", F.round("w", 6).alias("w"))


@_q("harmonic_change", f"{CHANGE} SELECT song_id, beat, round(abs(change), 5) AS change FROM chg")
def harmonic_change(spark, d):
    return G.harmonic_change(gridded(spark, d), BPM, ANCHOR).select("song_id", "beat", F.round(F.abs("change"), 5).alias("change"))


PHASE_TAIL = "r AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY score DESC, pulse DESC) AS r FROM sc) SELECT song_id, max(CASE WHEN r = 1 THEN pulse END) AS phase, round(CASE WHEN max(score) > 0 THEN (max(score) - max(CASE WHEN r = 2 THEN score END)) / max(score) ELSE 0 END, 5) AS confidence, round({0} + max(CASE WHEN r = 1 THEN pulse END) * {1}, 6) AS anchor FROM r GROUP BY song_id"


@_q("bar_phase", f"{CHANGE}, sc AS (SELECT song_id, CAST({fmod(f'beat - {OFFSET}', '4')} AS INT) AS pulse, avg(change) AS score FROM chg GROUP BY ALL), " + PHASE_TAIL.format(ANCHOR_SQL, f"{BEAT!r}"))
def bar_phase(spark, d):
    return G.bar_phase(gridded(spark, d), BPM, ANCHOR).select("song_id", "phase", F.round("confidence", 5).alias("confidence"), F.round("anchor", 6).alias("anchor"))


@_q("bar_phase_groups", f"""{CHANGE}, h AS (SELECT song_id, CAST({fmod(f'beat - {OFFSET}', '7')} AS INT) AS pulse, avg(change) AS v FROM chg GROUP BY ALL),
a AS (SELECT song_id, CAST({fmod(f'round_even((start_s - {ANCHOR_SQL}) / {BEAT!r}, 0)', '7')} AS INT) AS pulse, sum(velocity / 127.0::double) AS v FROM notes GROUP BY ALL),
hg AS (SELECT x.song_id, x.pulse, x.v + 0.5 * (y.v + z.v) / 2 AS v FROM h x JOIN h y ON x.song_id = y.song_id AND y.pulse = (x.pulse + 2) % 7 JOIN h z ON x.song_id = z.song_id AND z.pulse = (x.pulse + 4) % 7),
ag AS (SELECT x.song_id, x.pulse, x.v + 0.5 * (y.v + z.v) / 2 AS v FROM a x JOIN a y ON x.song_id = y.song_id AND y.pulse = (x.pulse + 2) % 7 JOIN a z ON x.song_id = z.song_id AND z.pulse = (x.pulse + 4) % 7),
sc AS (SELECT song_id, pulse, hg.v / max(hg.v) OVER (PARTITION BY song_id) + 0.5 * ag.v / max(ag.v) OVER (PARTITION BY song_id) AS score FROM hg JOIN ag USING (song_id, pulse)), """ + PHASE_TAIL.format(ANCHOR_SQL, f"{BEAT!r}"))
def bar_phase_groups(spark, d):
    return G.bar_phase(gridded(spark, d), BPM, ANCHOR, (2, 2, 3)).select("song_id", "phase", F.round("confidence", 5).alias("confidence"), F.round("anchor", 6).alias("anchor"))


@_q("accent_profile", f"a AS (SELECT song_id, CAST({fmod(f'round_even((start_s - {ANCHOR_SQL}) / {BEAT!r}, 0)', '4')} AS INT) AS pulse, sum(velocity / 127.0::double) AS accent FROM notes GROUP BY ALL) SELECT s.song_id, s.pulse, round(coalesce(accent, 0), 6) AS accent FROM (SELECT song_id, CAST(unnest(range(4)) AS INT) AS pulse FROM (SELECT DISTINCT song_id FROM notes)) s LEFT JOIN a USING (song_id, pulse)")
def accent_profile(spark, d):
    return G.accent_profile(gridded(spark, d), BPM, ANCHOR, 4).select("song_id", "pulse", F.round("accent", 6).alias("accent"))


LATE = f"late AS (SELECT song_id, track, median({signed('start_s')}) AS latency FROM notes GROUP BY ALL)"


@_q("latency", f"{LATE} SELECT song_id, track, round(latency, 6) + 0.0::double AS latency, round(latency + round_even((0.2 - latency) / {SIX_SQL}, 0) * {SIX_SQL}, 6) AS hinted FROM late")
def latency(spark, d):
    n = gridded(spark, d)
    plain = G.latency(n, BPM, ANCHOR)
    return plain.join(G.latency(n, BPM, ANCHOR, F.lit(0.2)).withColumnRenamed("latency", "hinted"), TRACK).select(*TRACK, (F.round("latency", 6) + F.lit(0.0)).alias("latency"), F.round("hinted", 6).alias("hinted"))


@_q("grid_fit_ms", f"{LATE} SELECT song_id, track, round(median(abs({signed('start_s - latency')})) * 1000, 4) AS grid_fit_ms FROM notes JOIN late USING (song_id, track) GROUP BY song_id, track")
def grid_fit_ms(spark, d):
    n = gridded(spark, d)
    return G.fit_ms(n, G.latency(n, BPM, ANCHOR), BPM, ANCHOR).select(*TRACK, F.round("grid_fit_ms", 4).alias("grid_fit_ms"))


@_q("offset_16th", f"SELECT song_id, track, round(avg(abs({signed('start_s')} / {SIX_SQL})), 6) AS offset_16th FROM notes GROUP BY song_id, track")
def offset_16th(spark, d):
    return G.offset_16th(gridded(spark, d), BPM, ANCHOR).select(*TRACK, F.round("offset_16th", 6).alias("offset_16th"))


@_q("use_map", f"SELECT song_id, track, CASE WHEN song_id = 3 THEN true ELSE avg(abs({signed('start_s')} / {SIX_SQL})) > 0.08 AND (song_id % 4 = 0 OR song_id / 100.0 >= 0.02) END AS use_map FROM notes GROUP BY song_id, track")
def use_map(spark, d):
    o = G.offset_16th(gridded(spark, d), BPM, ANCHOR)
    offset = F.when(F.col("song_id") == 3, None).otherwise(F.col("offset_16th"))
    gain = F.when(F.col("song_id") % 4 != 0, F.col("song_id") / 100.0)
    return o.select(*TRACK, G.use_map(offset, gain).alias("use_map"))


HALF_SQL = f"({SIX_SQL} / 2)"
SNAP = f"""{LATE}, mv AS (SELECT n.*, greatest(0, {ANCHOR_SQL} + round_even((start_s - latency - {ANCHOR_SQL}) / {SIX_SQL}, 0) * {SIX_SQL}) AS a, {ANCHOR_SQL} + round_even((end_s - latency - {ANCHOR_SQL}) / {HALF_SQL}, 0) * {HALF_SQL} AS b FROM notes n JOIN late USING (song_id, track)),
st AS (SELECT * EXCLUDE (b), greatest(a + {HALF_SQL}, b) AS b, CAST(round_even((a - {ANCHOR_SQL}) / {SIX_SQL}, 0) AS BIGINT) AS step FROM mv), rk AS (SELECT *, row_number() OVER (PARTITION BY song_id, track, step, pitch ORDER BY velocity DESC, note_id) AS r FROM st)"""
SNAPPED = "song_id, track, note_id, pitch, velocity, step, round(a, 6) AS start_s, round(b, 6) AS end_s"


@_q("snap", f"{SNAP} SELECT {SNAPPED} FROM rk WHERE NOT is_drum OR r = 1")
def snap(spark, d):
    n = gridded(spark, d)
    return G.snap(n, G.latency(n, BPM, ANCHOR), BPM, ANCHOR).select(*ROW, "step", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))


@_q("snap_drums", f"{SNAP} SELECT {SNAPPED} FROM rk WHERE is_drum AND r = 1")
def snap_drums(spark, d):
    n = gridded(spark, d).where("is_drum").withColumn("pitch", F.col("pitch"))
    return G.snap(n, G.latency(n, BPM, ANCHOR), BPM, ANCHOR).select(*ROW, "step", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))


# The whole stage: the best track's grid, its anchor on the busiest sixteenth, notes in pulses, bar one, latency.
APPLIED = f"""{DEDUPE}, {PERIODS}, z AS (SELECT song_id, track, i, six, avg(cos(2 * pi() * t / six)) AS x, avg(sin(2 * pi() * t / six)) AS y, count(*) AS n FROM onsets, p GROUP BY ALL HAVING count(*) >= 64),
f AS (SELECT song_id, track, arg_max(struct_pack(six := six, x := x, y := y, r := sqrt(x * x + y * y)), struct_pack(r := sqrt(x * x + y * y), j := -i)) AS b FROM z GROUP BY ALL),
g0 AS (SELECT song_id, arg_max(track, b.r) AS track, arg_max(b, b.r) AS b FROM f GROUP BY song_id HAVING max(b.r) >= 0.5), g1 AS (SELECT song_id, track, b.six AS six, {fmod('atan2(b.y, b.x) / (2 * pi()) * b.six', 'b.six')} AS anchor FROM g0),
busy AS (SELECT song_id, CAST({fmod('round_even((t - anchor) / six, 0)', '4')} AS INT) AS k, count(*) AS n FROM onsets JOIN (SELECT song_id, six, anchor FROM g1) USING (song_id) GROUP BY ALL),
g AS (SELECT g1.song_id, g1.track AS source_track, 15 / six AS bpm, anchor + k * six AS anchor, ceil((anchor + k * six) / (4 * six)) AS base FROM g1 JOIN (SELECT song_id, arg_max(k, struct_pack(n := n, j := -k)) AS k FROM busy GROUP BY song_id) USING (song_id)),
flat AS (SELECT n.* REPLACE ((start_s - anchor) * bpm / 60 + base AS start_s, (end_s - anchor) * bpm / 60 + base AS end_s), bpm, anchor, base FROM notes n JOIN g USING (song_id)),
late AS (SELECT song_id, track, median({fmod('start_s + 0.125::double', '0.25::double')} - 0.125::double) AS latency FROM flat GROUP BY ALL)"""


def twice(c: str):
    """Rounded to five digits, then to four, as the SQL does: 0.0907473 gives 0.0908."""
    return F.round(F.round(c, 5) * 10000) / 10000


@_q("grid_apply", f"""{APPLIED}, {chroma_sql('flat', '0.0::double', '1.0::double')}, {CHANGED}, sc AS (SELECT song_id, CAST({fmod('beat', '4')} AS INT) AS pulse, avg(change) AS score FROM chg GROUP BY ALL), ph AS (WITH {PHASE_TAIL.format('0', '0')}),
ms AS (SELECT song_id, round(sum(round(latency * 60000 / bpm, 2)), 1) AS latency_ms, round(sum(round(fit * 60000 / bpm, 2)), 1) AS grid_fit_ms, count(*) AS n_tracks FROM (SELECT song_id, track, bpm, max(latency) AS latency, median(abs({fmod('start_s - latency + 0.125::double', '0.25::double')} - 0.125::double)) AS fit FROM flat JOIN late USING (song_id, track) GROUP BY ALL) GROUP BY song_id)
SELECT s.song_id, g.bpm IS NOT NULL AS fitted, 'constant' AS tempo, round(bpm, 3) AS bpm, phase AS bar_one, round({fmod('g.anchor + (phase - base) * 60 / bpm', '(240 / bpm)')}, 4) AS first_bar, round(confidence, 4) AS confidence, source_track, n_tracks, latency_ms, grid_fit_ms
FROM (SELECT DISTINCT song_id FROM notes) s LEFT JOIN g USING (song_id) LEFT JOIN ph USING (song_id) LEFT JOIN ms USING (song_id)""")
def grid_apply(spark, d):
    """The whole constant-grid stage on the planted grid, from a guess of 112."""
    info, _ = G.apply(gridded(spark, d), 112.0)
    total = lambda c: F.round(F.aggregate(F.transform("tracks", lambda t: t[c]), F.lit(0.0), lambda a, x: a + x), 1).alias(c)
    return info.select("song_id", "fitted", "tempo", F.round("bpm", 3).alias("bpm"), "bar_one", F.round("first_bar", 4).alias("first_bar"), twice("confidence").alias("confidence"), "source_track", F.size("tracks").alias("n_tracks"), total("latency_ms"), total("grid_fit_ms"))


@_q("grid_apply_notes", f"""{APPLIED}, mv AS (SELECT n.*, greatest(0, round_even((start_s - latency) * 4, 0) / 4) AS a, round_even((end_s - latency) * 8, 0) / 8 AS b FROM flat n JOIN late USING (song_id, track)), st AS (SELECT * EXCLUDE (b), greatest(a + 0.125::double, b) AS b, row_number() OVER (PARTITION BY song_id, track, round_even(a * 4, 0), pitch ORDER BY velocity DESC, note_id) AS r FROM mv),
whole AS (SELECT song_id, track, note_id, pitch, velocity, greatest(0, anchor + (a - base) * 60 / bpm) AS a, greatest(0, anchor + (b - base) * 60 / bpm) AS b FROM st WHERE NOT is_drum OR r = 1 UNION ALL SELECT song_id, track, note_id, pitch, velocity, start_s, end_s FROM notes WHERE song_id NOT IN (SELECT song_id FROM g))
SELECT song_id, track, note_id, pitch, velocity, round(a, 4) AS start_s, round(b, 4) AS end_s FROM whole""")
def grid_apply_notes(spark, d):
    _, snapped = G.apply(gridded(spark, d), 112.0)
    return snapped.select(*TRACK, "note_id", "pitch", "velocity", F.round("start_s", 4).alias("start_s"), F.round("end_s", 4).alias("end_s"))
