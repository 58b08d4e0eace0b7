"""Queries on tempo maps and tempo. The beats of each song drift around 120 a minute by rule."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import tempo as T
from ..operators import tempo_map as P
from ..operators.measure import onset_dedupe
from ..schema import OCTAVE_RATIOS, SUBDIVISIONS, TRACK
from ..sources.notes import ANCHOR, BPM, GRIDDED_SQL, NOTES_SQL, gridded, notes
from .note_queries import DEDUPE

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
N_BEATS = 520
BEATS_SQL = f"beats AS (SELECT song_id, CAST(k AS INT) AS k, 0.3::double + k * 0.5::double + 0.03::double * sin(k / 7.0::double + song_id) AS t FROM (SELECT DISTINCT song_id FROM notes), (SELECT unnest(range({N_BEATS})) AS k))"
BEAT = 60.0 / BPM


def beats_of(spark, d):
    songs = notes(spark, d).select("song_id").distinct()
    return songs.select("song_id", F.explode(F.sequence(F.lit(0), F.lit(N_BEATS - 1))).alias("k")).withColumn("t", F.lit(0.3) + F.col("k") * F.lit(0.5) + F.lit(0.03) * F.sin(F.col("k") / F.lit(7.0) + F.col("song_id")))


def _q(name: str, sql: str | None = None, source: str = NOTES_SQL):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = f"WITH RECURSIVE notes AS ({source}), {sql}" if sql.lstrip()[0] != "S" else f"WITH notes AS ({source}) {sql}"
        return f

    return add


def fmod(x: str, s: str) -> str:
    return f"(({x}) - ({s}) * floor(({x}) / ({s})))"


SEG = f"{BEATS_SQL}, seg AS (SELECT *, lead(t) OVER (PARTITION BY song_id ORDER BY k) AS t_next FROM beats)"
# Position by joining each time to the segment that holds it, with the edge segments open.
PLACE = f"""{SEG}, open AS (SELECT song_id, k, t, t_next, CASE WHEN k = 0 THEN -1e300 ELSE t END AS lo, CASE WHEN k = {N_BEATS - 2} THEN 1e300 ELSE t_next END AS hi FROM seg WHERE t_next IS NOT NULL),
placed AS (SELECT n.song_id, n.track, n.note_id, n.velocity, n.start_s, o.k + (n.start_s - o.t) / (o.t_next - o.t) AS position FROM notes n JOIN open o ON n.song_id = o.song_id AND n.start_s >= o.lo AND n.start_s < o.hi)"""


@_q("map_position", f"{PLACE} SELECT song_id, track, note_id, round(position, 6) AS position FROM placed")
def map_position(spark, d):
    return P.position(notes(spark, d), beats_of(spark, d), "start_s").select(*TRACK, "note_id", F.round("position", 6).alias("position"))


@_q("map_time", f"{SEG}, w AS (SELECT song_id, track, note_id, start_s * 2 - 3 AS place, greatest(0, least(CAST(floor(start_s * 2 - 3) AS BIGINT), {N_BEATS - 2})) AS k FROM notes) SELECT w.song_id, w.track, w.note_id, round(s.t + (w.place - w.k) * (s.t_next - s.t), 6) AS t FROM w JOIN seg s ON s.song_id = w.song_id AND s.k = w.k")
def map_time(spark, d):
    places = notes(spark, d).withColumn("position", F.col("start_s") * 2 - 3)
    return P.time_at(places, beats_of(spark, d)).select(*TRACK, "note_id", F.round("t", 6).alias("t"))


@_q("map_offset", f"{PLACE} SELECT song_id, round(avg(abs(position * 4 - round_even(position * 4, 0))), 6) AS offset_16th FROM placed GROUP BY song_id")
def map_offset(spark, d):
    return P.offset_16th(notes(spark, d), beats_of(spark, d)).select("song_id", F.round("offset_16th", 6).alias("offset_16th"))


@_q("on_the_pulse", f"{PLACE}, q AS (SELECT song_id, CAST({fmod('round_even(position * 4, 0)', '4')} AS INT) AS q, count(*) AS n FROM placed GROUP BY ALL) SELECT song_id, arg_max(q, struct_pack(n := n, j := -q)) AS q FROM q GROUP BY song_id")
def on_the_pulse(spark, d):
    return P.on_the_pulse(notes(spark, d).select("song_id", F.col("start_s").alias("t")), beats_of(spark, d))


@_q("bar_lines", f"{BEATS_SQL} SELECT song_id, k, (k - 2) // 4 AS bar, round(t, 6) AS t FROM beats WHERE k >= 2 AND (k - 2) % 4 = 0")
def bar_lines(spark, d):
    return P.bar_lines(beats_of(spark, d), 4, 2).select("song_id", "k", "bar", F.round("t", 6).alias("t"))


@_q("bpm_range", f"{BEATS_SQL}, g AS (SELECT song_id, 240.0 / (lead(t) OVER (PARTITION BY song_id ORDER BY k) - t) AS bpm FROM beats WHERE k >= 2 AND (k - 2) % 4 = 0) SELECT song_id, round(min(bpm), 6) AS low, round(max(bpm), 6) AS high FROM g GROUP BY song_id")
def bpm_range(spark, d):
    return P.bpm_range(beats_of(spark, d), 4, 2).select("song_id", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@_q("first_bar", f"{SEG} SELECT song_id, min(k) AS k, round(min(t), 6) AS t FROM seg WHERE k >= 1 AND (k - 1) % 4 = 0 AND t >= 2 * (t_next - t) GROUP BY song_id")
def first_bar(spark, d):
    return P.first_bar(beats_of(spark, d), 4, 1).select("song_id", "k", F.round("t", 6).alias("t"))


@_q("shift_bar", f"SELECT DISTINCT song_id, round({ANCHOR} + (song_id % 3) * {BEAT!r}, 6) AS anchor, CAST((2 + song_id % 3) % 4 AS INT) AS first FROM notes")
def shift_bar(spark, d):
    n = F.col("song_id") % 3
    return notes(spark, d).select("song_id").distinct().select("song_id", F.round(F.lit(ANCHOR) + n * F.lit(BEAT), 6).alias("anchor"), F.pmod(2 + n, F.lit(4)).cast("int").alias("first"))


def _grids(spark, d):
    return notes(spark, d).select("song_id").distinct().withColumns({"bpm": F.lit(100.0) + 3 * F.col("song_id"), "anchor": F.lit(ANCHOR) + F.col("song_id") / F.lit(4.0)})


GRIDS_SQL = f"grids AS (SELECT DISTINCT song_id, 100.0::double + 3 * song_id AS bpm, {ANCHOR}::double + song_id / 4.0::double AS anchor FROM notes)"


@_q("stamp_constant", f"""{GRIDS_SQL}, p AS (SELECT *, 360.0 / bpm AS bar, {fmod('anchor', '360.0 / bpm')} AS first FROM grids), r AS (SELECT *, CASE WHEN first >= bar / 2 THEN first ELSE first + bar END AS pickup FROM p)
SELECT song_id, 0 AS tick, round(180 / pickup, 6) AS qpm FROM r UNION ALL SELECT song_id, 2880, round(bpm * 4 / 8, 6) FROM r""")
def stamp_constant(spark, d):
    return P.stamp_constant(_grids(spark, d), 6, 8).select("song_id", "tick", F.round("qpm", 6).alias("qpm"))


@_q("restamp_tempo", f"""{GRIDS_SQL}, n AS (SELECT song_id, 60.0::double + 40 * song_id AS bpm, anchor FROM grids WHERE 60 + 40 * song_id BETWEEN 20 AND 400), p AS (SELECT *, 360.0 / bpm AS bar, {fmod('anchor', '360.0 / bpm')} AS first FROM n), r AS (SELECT *, CASE WHEN first >= bar / 2 THEN first ELSE first + bar END AS pickup FROM p)
SELECT song_id, 0 AS tick, round(180 / pickup, 6) AS qpm FROM r UNION ALL SELECT song_id, 2880, round(bpm * 4 / 8, 6) FROM r""")
def restamp_tempo(spark, d):
    """A tempo of the user's own, where it is in range."""
    grids = _grids(spark, d)
    own = grids.select("song_id", (F.lit(60.0) + 40 * F.col("song_id")).alias("bpm"))
    return P.restamp(grids, own, 6, 8).select("song_id", "tick", F.round("qpm", 6).alias("qpm"))


@_q("move_bar", f"{GRIDS_SQL} SELECT song_id, round(anchor + (song_id - 4) * 60 / bpm, 6) AS anchor FROM grids WHERE abs(song_id - 4) < 4")
def move_bar(spark, d):
    """Bar one moved by whole pulses, by less than a bar."""
    grids = _grids(spark, d)
    return P.shift_bar(grids, grids.select("song_id", (F.col("song_id") - 4).alias("beats")), 4).select("song_id", F.round("anchor", 6).alias("anchor"))


@_q("stamp_map", f"""{SEG}, b AS (SELECT song_id, min(k) AS k0, min(t) AS t0 FROM seg WHERE k >= 1 AND (k - 1) % 4 = 0 AND t >= 2 * (t_next - t) GROUP BY song_id)
SELECT song_id, CAST(0 AS BIGINT) AS tick, round(240 / t0, 5) AS qpm FROM b UNION ALL SELECT seg.song_id, CAST(3840 + (k - k0) * 960 AS BIGINT), round(60 / (t_next - t), 5) FROM seg JOIN b ON b.song_id = seg.song_id WHERE k >= k0 AND t_next IS NOT NULL""")
def stamp_map(spark, d):
    return P.stamp_map(beats_of(spark, d), 4, 4, 1).select("song_id", "tick", F.round("qpm", 5).alias("qpm"))


@_q("bar_series", f"{GRIDS_SQL}, f AS (SELECT *, 240.0 / bpm AS bar, {fmod('anchor - 10', '240.0 / bpm')} AS first FROM grids) SELECT song_id, CAST(k AS INT) AS bar, round(first + k * bar, 6) AS t FROM (SELECT *, unnest(range(CAST(floor((30 - first) / bar) AS BIGINT) + 1)) AS k FROM f)")
def bar_series(spark, d):
    return P.bar_series(_grids(spark, d), 4, 30.0, 10.0).select("song_id", "bar", F.round("t", 6).alias("t"))


@_q("smooth_beats", f"{BEATS_SQL}, s AS (SELECT song_id, k, regr_intercept(t, k) OVER w + regr_slope(t, k) OVER w * k AS t FROM beats WINDOW w AS (PARTITION BY song_id ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT song_id, k, round(t, 5) AS t FROM s")
def smooth_beats(spark, d):
    return P.smooth(beats_of(spark, d), 2).select("song_id", "k", F.round("t", 5).alias("t"))


# The pulses that each gap lacks, gap by gap, with the last seven gaps put out; then both ends.
EXTENDED = f"""{BEATS_SQL}, b AS (SELECT song_id, t, row_number() OVER (PARTITION BY song_id ORDER BY k) AS i FROM beats WHERE k % 50 < 44), g AS (SELECT song_id, i, t, lead(t) OVER (PARTITION BY song_id ORDER BY i) - t AS gap FROM b),
r AS (SELECT song_id, 0::BIGINT AS i, 0.0::double AS t, 0.0::double AS p, 0::BIGINT AS n, []::DOUBLE[] AS heard FROM (SELECT DISTINCT song_id FROM b) UNION ALL
 SELECT song_id, i, t, p, n, (list_concat(heard, list_concat([p FOR x IN range(n)], [gap - n * p])))[-7:] FROM (SELECT *, CASE WHEN len(heard) > 1 AND p > 0 THEN greatest(0, CAST(ceil(gap / p - 1.5) AS BIGINT)) ELSE 0 END AS n
  FROM (SELECT g.song_id, g.i, g.t, g.gap, r.heard, CASE WHEN len(r.heard) > 1 THEN list_aggregate(r.heard, 'median') ELSE g.gap END AS p FROM r JOIN g ON g.song_id = r.song_id AND g.i = r.i + 1 WHERE g.gap IS NOT NULL))),
body AS (SELECT song_id, t + p * j AS t FROM (SELECT *, unnest(range(n + 1)) AS j FROM r WHERE i > 0) UNION ALL SELECT song_id, max(t) FROM b GROUP BY song_id),
e AS (SELECT song_id, min(t) AS a, max(t) AS z, list_sort(list(t))[2] - min(t) AS head, max(t) - list_reverse_sort(list(t))[2] AS tail FROM body GROUP BY song_id),
whole AS (SELECT * FROM body UNION ALL SELECT song_id, a - head * j FROM (SELECT *, unnest(range(1, CAST(ceil((a + 3) / head) AS BIGINT) + 1)) AS j FROM e) UNION ALL SELECT song_id, z + tail * j FROM (SELECT *, unnest(range(1, CAST(ceil(4 / tail) AS BIGINT) + 1)) AS j FROM e))"""


@_q("extend_beats", f"{EXTENDED} SELECT song_id, CAST(row_number() OVER (PARTITION BY song_id ORDER BY t) - 1 AS INT) AS k, round(t, 6) AS t FROM whole")
def extend_beats(spark, d):
    """Pulses filled in and run on past both ends, after six of every fifty were taken away."""
    b = beats_of(spark, d).where("k % 50 < 44")
    ends = b.groupBy("song_id").agg(F.lit(-3.0).alias("low"), (F.max("t") + 4.0).alias("high"))
    return P.extend(b, ends).select("song_id", "k", F.round("t", 6).alias("t"))


def on_pulses(spark, d):
    """Notes moved onto the pulses of a steady 114, a few milliseconds off by velocity; ``pulse`` tells which."""
    k = F.rint(F.col("start_s") / F.lit(BEAT))
    n = notes(spark, d).withColumn("pulse", k.cast("long")).withColumn("start_s", F.lit(ANCHOR) + k * F.lit(BEAT) + (F.col("velocity") % 5 - 2) / F.lit(1000.0))
    return n.withColumn("end_s", F.col("start_s") + 0.1)


def recovered(n, beats):
    """How many of each song's pulses that have notes, but for the first and the last, have a beat within 20 ms."""
    ends = n.groupBy("song_id").agg(F.min("pulse").alias("a"), F.max("pulse").alias("b"))
    inner = n.join(ends, "song_id").where("pulse > a AND pulse < b").select("song_id", "pulse").distinct()
    k = F.rint((F.col("t") - ANCHOR) / F.lit(BEAT))
    hit = beats.where(F.abs(F.col("t") - ANCHOR - k * F.lit(BEAT)) <= 0.02).select("song_id", k.cast("long").alias("pulse")).distinct()
    return inner.join(hit, ["song_id", "pulse"], "left_semi").groupBy("song_id").agg(F.count("*").alias("pulses"))


# All of them.
INNER_PULSES = f"p AS (SELECT song_id, CAST(round_even(start_s / {BEAT!r}::double, 0) AS BIGINT) AS pulse FROM notes), e AS (SELECT *, min(pulse) OVER (PARTITION BY song_id) AS a, max(pulse) OVER (PARTITION BY song_id) AS b FROM p) SELECT song_id, count(DISTINCT pulse) AS pulses FROM e WHERE pulse > a AND pulse < b GROUP BY song_id"


@_q("track_beats_planted", INNER_PULSES)
def track_beats_planted(spark, d):
    """The tracker finds every pulse that was planted."""
    n = on_pulses(spark, d)
    return recovered(n, P.track_beats(n.drop("pulse"), BPM))


@_q("fit_map_planted", INNER_PULSES)
def fit_map_planted(spark, d):
    """A map through tracked pulses holds every pulse that was planted."""
    n = on_pulses(spark, d)
    return recovered(n, P.fit_map(n.drop("pulse"), n.drop("pulse"), BPM))


@_q("track_beats")
def track_beats(spark, d):
    """A dynamic program over frames: tested on songs with known pulses."""
    return P.track_beats(gridded(spark, d), BPM).select("song_id", "k", F.round("t", 3).alias("t"))


@_q("fit_map")
def fit_map(spark, d):
    n = gridded(spark, d)
    return P.fit_map(n.where("is_drum"), n, BPM).select("song_id", "k", F.round("t", 4).alias("t"))


@_q("map_gain")
def map_gain(spark, d):
    n = gridded(spark, d)
    return P.map_gain(n, n, BPM, ANCHOR).select("song_id", *[F.round(c, 4).alias(c) for c in ("constant", "map", "gain")])


@_q("tempo_regression", f"{BEATS_SQL} SELECT song_id, count(*) AS n, round(60 / regr_slope(t, k), 6) AS bpm FROM beats GROUP BY song_id")
def tempo_regression(spark, d):
    return T.regression(beats_of(spark, d)).select("song_id", "n", F.round("bpm", 6).alias("bpm"))


RATIOS_SQL = "(VALUES " + ", ".join(f"({k}, {float(r)!r}::double)" for k, r in enumerate(OCTAVE_RATIOS)) + ") AS r(i, ratio)"


@_q("tempo_candidates", f"""t AS (SELECT DISTINCT song_id, 47.0::double + 21 * song_id AS bpm FROM notes), c AS (SELECT song_id, bpm, i, ratio, bpm * ratio AS candidate FROM t, {RATIOS_SQL} WHERE bpm * ratio BETWEEN 50 AND 200),
o AS (SELECT *, row_number() OVER (PARTITION BY song_id, round_even(candidate, 0) ORDER BY i) AS r FROM c), k AS (SELECT song_id, candidate, ratio, 1 / (1 + abs(candidate - 120)) AS score FROM o WHERE r = 1),
u AS (SELECT * FROM k UNION ALL SELECT song_id, CASE WHEN bpm < 50 THEN bpm * power(2, ceil(log2(50 / bpm))) ELSE bpm / power(2, ceil(log2(bpm / 200))) END AS candidate, candidate / bpm, 1.0 FROM t WHERE song_id NOT IN (SELECT song_id FROM k))
SELECT song_id, round(candidate, 6) AS candidate, round(ratio, 6) AS ratio, round(score / max(score) OVER (PARTITION BY song_id), 6) AS score FROM u""")
def tempo_candidates(spark, d):
    t = notes(spark, d).select("song_id").distinct().withColumn("bpm", F.lit(47.0) + 21 * F.col("song_id"))
    out = T.candidates(t, 1 / (1 + F.abs(F.col("candidate") - 120)))
    return out.select("song_id", *[F.round(c, 6).alias(c) for c in ("candidate", "ratio", "score")])


@_q("octave_fold", "b AS (SELECT note_id, 1 + (note_id * 37) % 900 AS bpm FROM notes) SELECT note_id, round(CASE WHEN bpm < 50 THEN bpm * power(2, ceil(log2(50.0 / bpm))) WHEN bpm > 200 THEN bpm / power(2, ceil(log2(bpm / 200.0))) ELSE bpm END, 6) AS bpm FROM b")
def octave_fold(spark, d):
    return notes(spark, d).select("note_id", F.round(T.octave_fold((1 + (F.col("note_id") * 37) % 900).cast("double")), 6).alias("bpm"))


@_q("circular_phase", f"a AS (SELECT song_id, track, sum((0.3 + 0.7 * velocity / 127) * cos(2 * pi() / {BEAT!r} * start_s)) AS x, sum((0.3 + 0.7 * velocity / 127) * sin(2 * pi() / {BEAT!r} * start_s)) AS y FROM notes GROUP BY ALL) SELECT song_id, track, round({fmod(f'atan2(y, x) / (2 * pi()) * {BEAT!r} + {BEAT!r}', repr(BEAT))}, 6) AS phase FROM a", GRIDDED_SQL)
def circular_phase(spark, d):
    return T.circular_phase(gridded(spark, d), BEAT).select(*TRACK, F.round("phase", 6).alias("phase"))


_USED = [s for s in SUBDIVISIONS if 0.5 / (2 * s) >= 0.04]


@_q("onset_delay", f"""{SEG}, e AS (SELECT song_id, min(t) AS a, max(t) AS b FROM beats GROUP BY song_id), late AS (SELECT song_id, k, t + 0.012 AS t FROM beats WHERE k % 2 = 0),
o AS (SELECT DISTINCT l.song_id, floor(l.t * 1000 + 0.5) / 1000 AS t FROM late l), i AS (SELECT o.* FROM o JOIN e USING (song_id) WHERE o.t >= a AND o.t <= b),
w AS (SELECT i.song_id, s.k + (i.t - s.t) / (s.t_next - s.t) AS p FROM i JOIN seg s ON s.song_id = i.song_id AND i.t >= s.t AND i.t < s.t_next),
x AS (SELECT song_id, s, avg(cos(2 * pi() * {fmod('p * s', '1')})) AS x, avg(sin(2 * pi() * {fmod('p * s', '1')})) AS y, count(*) AS n FROM w, (SELECT unnest({_USED}) AS s) GROUP BY ALL),
b AS (SELECT song_id, arg_max(struct_pack(s := s, x := x, y := y, n := n), struct_pack(c := sqrt(x * x + y * y), j := -s)) AS b FROM x GROUP BY song_id)
SELECT song_id, b.s AS subdivision, round(sqrt(b.x * b.x + b.y * b.y), 5) AS concentration, round(CASE WHEN b.n >= 40 AND sqrt(b.x * b.x + b.y * b.y) >= 0.5 AND abs(atan2(b.y, b.x) / (2 * pi() * b.s) * 0.5) <= 0.04 THEN atan2(b.y, b.x) / (2 * pi() * b.s) * 0.5 END, 5) AS delay FROM b""")
def onset_delay(spark, d):
    b = beats_of(spark, d)
    late = b.where("k % 2 = 0").select("song_id", (F.col("t") + F.lit(0.012)).alias("t"))
    return T.onset_delay(late, b, 120.0).select("song_id", "subdivision", F.round("concentration", 5).alias("concentration"), F.round("delay", 5).alias("delay"))


@_q("browser_tempo")
def browser_tempo(spark, d):
    """Autocorrelation of an onset train: tested on click tracks of known tempo."""
    return T.onset_tempo(gridded(spark, d)).select("song_id", "bpm", F.round("beat0", 4).alias("beat0"))


@_q("resolve_tempo", "s AS (SELECT DISTINCT song_id FROM notes) SELECT song_id, CAST(CASE WHEN song_id % 4 = 0 THEN 90 WHEN song_id % 3 = 0 THEN 100 WHEN song_id % 2 = 0 THEN 110 ELSE 120 END AS DOUBLE) AS bpm, CASE WHEN song_id % 4 = 0 THEN 'user' WHEN song_id % 3 = 0 OR song_id % 2 = 0 THEN 'detected' ELSE 'default' END AS source, CASE WHEN song_id % 4 = 0 THEN '' WHEN song_id % 3 = 0 THEN 'drums' WHEN song_id % 2 = 0 THEN 'mix' ELSE '' END AS analyzed_stem FROM s")
def resolve_tempo(spark, d):
    i = F.col("song_id")
    songs = notes(spark, d).select("song_id").distinct().select("song_id", F.when(i % 4 == 0, 90.0).alias("user_bpm"), F.when(i % 3 == 0, 100.0).alias("drums_bpm"), F.when(i % 2 == 0, 110.0).alias("mix_bpm"))
    return T.resolve(songs).withColumn("analyzed_stem", F.coalesce("analyzed_stem", F.lit("")))


POS = f"((start_s - {ANCHOR}::double) / {BEAT!r}::double)"


@_q("beat_histogram", f"SELECT song_id, track, CAST({fmod(f'round_even({fmod(POS, '1')} * 12, 0)', '12')} AS INT) AS bin, count(*) AS n FROM notes GROUP BY ALL", GRIDDED_SQL)
def beat_histogram(spark, d):
    return T.beat_histogram(gridded(spark, d), BPM, ANCHOR)


@_q("subdivision_offsets", f"SELECT song_id, track, division, round(avg(abs({POS} * division - round_even({POS} * division, 0))), 6) AS offset FROM notes, (SELECT unnest([2, 3, 4, 6]) AS division) GROUP BY ALL", GRIDDED_SQL)
def subdivision_offsets(spark, d):
    return T.subdivision_offsets(gridded(spark, d), BPM, ANCHOR).select(*TRACK, "division", F.round("offset", 6).alias("offset"))


@_q("pulse_histogram", f"u AS (SELECT song_id, track, CAST({fmod(f'round_even({POS}, 0)', '4')} AS INT) AS pulse, count(*) AS n FROM notes WHERE (NOT is_drum OR pitch IN (35, 36)) AND abs({POS} - round_even({POS}, 0)) < 0.2 GROUP BY ALL) SELECT s.song_id, s.track, s.pulse, coalesce(n, 0) AS n FROM (SELECT song_id, track, CAST(unnest(range(4)) AS INT) AS pulse FROM (SELECT DISTINCT song_id, track FROM notes)) s LEFT JOIN u USING (song_id, track, pulse)", GRIDDED_SQL)
def pulse_histogram(spark, d):
    return T.pulse_histogram(gridded(spark, d), BPM, ANCHOR, 4)


@_q("tempo_per_8_bars", f"{BEATS_SQL}, b AS (SELECT song_id, k // 4 AS bar, t FROM beats WHERE k % 4 = 0) SELECT song_id, CAST(bar // 8 AS BIGINT) AS part, count(*) AS n, round(240 / regr_slope(t, bar), 5) AS bpm FROM b GROUP BY ALL HAVING count(*) >= 2")
def tempo_per_8_bars(spark, d):
    return T.tempo_per_bars(P.bar_lines(beats_of(spark, d), 4), 4).select("song_id", "part", "n", F.round("bpm", 5).alias("bpm"))
