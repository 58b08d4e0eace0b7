"""Schemas, parameters and the constants that every operator shares.

Times are seconds as doubles. A note's ``note_id`` is its place in the input and the last
key of every order, so ties fall as in a stable sort.
"""

from __future__ import annotations

from dataclasses import dataclass

TRACK = ["song_id", "track"]

NOTES = "song_id long, track string, note_id long, pitch int, velocity int, start_s double, end_s double, is_drum boolean, program int"
TRACKS = "song_id long, track string, track_index int, program int, is_drum boolean"
BEATS = "song_id long, k int, t double"
GRIDS = "song_id long, bpm double, anchor double, num int, den int, groups array<int>"
ONSET_ENV = "song_id long, track string, frame long, t double, v double"
AUDIO_BLOCKS = "song_id long, stem string, channel int, block_id long, t0 double, sr int, samples array<float>"
JOB_EVENTS = "job_id string, seq long, stage string, message string, part struct<name:string,drum:boolean,notes:array<array<double>>>"

# Thresholds of the behaviour contract.
CHORD_TOL = 0.03  # s: onsets nearer than this to the last kept one belong to it
MIN_ONSETS = 64
MIN_ALIGNMENT = 0.5
TEMPO_PRIOR = 120.0
RESOLUTION = 960  # ticks per quarter
PULSE_TOL = 0.002
FINER_GAIN = 0.5
OFF_FILL = 0.6
ACCENT_WEIGHT = 0.5
GROUP_WEIGHT = 0.5
MAP_THRESHOLD = 0.08
MAP_GAIN = 0.02
MAP_SR = 200
MAP_TIGHTNESS = 400
MAP_GAP, MAP_RECENT = 1.5, 8  # pulses beyond which a gap is filled; pulses whose gaps tell the local one
PHASE_WARN, SOURCE_LAG_WARN = 0.2, 0.1  # confidence of bar one, and seconds off its audio, that are worth a warning
LAG_WINDOW = 0.3
FRAME_RATE, LEAST_NOTE = 100, 0.01  # frames of a second in a model's tokens, and seconds of its shortest note
LAG_MIN_SCORE = 1.0
FIT_SPAN, FIT_STEPS = 0.03, 6001
SEARCH_LOW, SEARCH_HIGH, SEARCH_STEP = 60.0, 200.0, 1e-4
MIN_BPM, MAX_BPM, DEFAULT_TEMPO = 50.0, 200.0, 120.0
OCTAVE_RATIOS = (0.5, 1.0, 2.0, 1.5, 2 / 3)
SUBDIVISIONS = (1, 2, 3, 4, 6, 8, 12, 16, 24)
SILENT_RMS = 1e-3
DENOMINATORS = (1, 2, 4, 8, 16, 32)

# Parts by stem, their General MIDI programs, and the order of parts.
TRACK_SPEC = {"vocals": ("melody", 53), "bass": ("bass", 33), "other": ("comping", 0), "guitar": ("guitar", 25), "piano": ("piano", 0), "drums": ("drums", 0)}
TRACK_ORDER = ("melody", "bass", "guitar", "piano", "comping", "drums")
PITCHED_STEMS = ("vocals", "bass", "guitar", "piano", "other")
UNPITCHED_STEMS = ("drums",)

# Drum classes of a transcription model to General MIDI drums.
DRUM_TO_GM = {35: 35, 36: 36, 37: 37, 38: 38, 39: 39, 40: 40, 41: 41, 42: 42, 43: 44, 44: 46, 45: 47, 46: 49, 47: 50, 48: 51, 49: 52, 50: 54, 51: 55, 52: 56, 53: 58, 54: 60, 55: 69, 56: 71, 57: 73, 58: 75, 59: 78, 60: 80}


# The steps' names, which are on, and their limits.
@dataclass(frozen=True)
class CleanupParams:
    """Steps of the cleanup and their limits; tempo in quarters a minute."""

    tempo: float = 120.0
    velocity_floor: int = 15
    monophonic: bool = False
    mono_keep: str = "lowest"
    quantize: bool = False
    quantize_division: int = 4
    quantize_strength: float = 0.5
    quantize_keep_duration: bool = True
    de_overlap: bool = True
    duration_cap: bool = True
    max_duration_beats: float = 2.0
    min_duration: float = 0.02
    legato: bool = False
    legato_max_gap_beats: float = 0.25
    legato_gap: float = 0.005

    @property
    def beat(self) -> float:
        return 60.0 / self.tempo

    @property
    def step(self) -> float:
        return self.beat / self.quantize_division


def dealt(df, *keys: str):
    """Rows dealt out by key over all shuffle partitions. For groups that cost much more to work on
    than to move: by their few bytes alone they would be packed into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
