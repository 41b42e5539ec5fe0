"""Lengths, pitches and keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorelake.functions.vocabulary import KEY_NAMES, SHARP_ORDER, WHOLE_TICKS

# Note denominators by rhythm code, rest denominators by rest code.
NOTE_DENOMINATORS = (4, 8, 16, 32, 64, 128, 2, 1)
REST_DENOMINATORS = (4, 8, 16, 32, 2)
# Note names from C, and chromatic names with flats and with sharps ("-" is a flat).
STEP_NAMES = ("C", "D", "E", "F", "G", "A", "B")
FLAT_NAMES = ("C", "D-", "D", "E-", "E", "F", "G-", "G", "A-", "A", "B-", "B")
SHARP_NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
# Chromatic position of each step; shift of the staff position per clef code.
STEP_SEMITONES = (0, 2, 4, 5, 7, 9, 11)
CLEF_SHIFT = {0: 6, -1: 12, -2: 8}
# Steps (C = 0) in the order sharps and flats are added.
SHARP_STEPS = (3, 0, 4, 1, 5, 2, 6)
FLAT_STEPS = (6, 2, 5, 1, 4, 0, 3)
# Staff code of each note name in the reference octave, treble and bass.
TREBLE_CODES = {"C": -1, "D": 0, "E": 1, "F": 2, "G": 3, "A": 4, "B": 5}
BASS_CODES = {"C": -3, "D": -2, "E": -1, "F": 0, "G": 1, "A": 2, "B": 3}
TREBLE_NAMES = ("D", "E", "F", "G", "A", "B", "C")
BASS_NAMES = ("F", "G", "A", "B", "C", "D", "E")


def pick(values, index: Column) -> Column:
    """Entry of a fixed list by 0-based index column."""
    return F.get(F.array(*(F.lit(v) for v in values)), index.cast("int"))


def ticks(code: Column, has_dot: Column, is_rest: Column) -> Column:
    """Exact length in ticks; a dot lengthens by half."""
    note = pick([WHOLE_TICKS // d for d in NOTE_DENOMINATORS], code)
    rest = pick([WHOLE_TICKS // d for d in REST_DENOMINATORS], code)
    plain = F.when(is_rest, rest).otherwise(note).cast("long")
    return F.when(has_dot, F.floor(plain * 3 / 2)).otherwise(plain)


def clef_shift(clef: Column) -> Column:
    out = F.lit(0)
    for code, shift in CLEF_SHIFT.items():
        out = F.when(clef == code, shift).otherwise(out)
    return out


def diatonic(pitch: Column, clef: Column) -> Column:
    """Steps above C5 of a staff position (0 is B4 in treble) read in a clef."""
    return pitch - clef_shift(clef) - 1


def step_of(steps: Column) -> Column:
    return F.pmod(steps, F.lit(7))


def octave_of(steps: Column) -> Column:
    return F.floor(steps / 7) + 5


def midi(step: Column, octave: Column, alter: Column) -> Column:
    return pick(STEP_SEMITONES, step) + 12 * (octave + 1) + alter


def pitch_name(step: Column, octave: Column, alter: Column) -> Column:
    mark = F.when(alter > 0, "#").when(alter < 0, "-").otherwise("")
    return F.concat(pick(STEP_NAMES, step), mark, octave.cast("string"))


def transposed_name(midi_number: Column, fifths: Column, sharp: Column) -> Column:
    """Name after moving by -7·fifths semitones (mod 12), spelled with sharps or flats."""
    moved = midi_number + F.pmod(-fifths * 7, F.lit(12))
    index = F.pmod(moved, F.lit(12))
    return F.concat(F.when(sharp, pick(SHARP_NAMES, index)).otherwise(pick(FLAT_NAMES, index)),
                    (F.floor(moved / 12) - 1).cast("string"))


def key_alter(step: Column, fifths: Column) -> Column:
    """Alteration of a step by the key signature."""
    sharp_rank = pick([SHARP_STEPS.index(s) for s in range(7)], step)
    flat_rank = pick([FLAT_STEPS.index(s) for s in range(7)], step)
    return F.when((fifths > 0) & (sharp_rank < fifths), 1).when((fifths < 0) & (flat_rank < -fifths), -1).otherwise(0)


def fifths_of_key(name: Column) -> Column:
    """Number of fifths of a key name; 0 for unknown names."""
    out = F.array_position(F.array(*(F.lit(k) for k in KEY_NAMES)), name).cast("int")
    return F.when(F.coalesce(out, F.lit(0)) > 0, out - 8).otherwise(0)


def key_of_fifths(fifths: Column) -> Column:
    return pick(KEY_NAMES, fifths + 7)


def key_notes(fifths: Column) -> Column:
    """The altered note names of a key, in order."""
    sharps = F.array(*(F.lit(n) for n in SHARP_ORDER))
    return F.when(fifths >= 0, F.slice(sharps, F.lit(1), F.abs(fifths))).otherwise(
        F.slice(F.reverse(sharps), F.lit(1), F.abs(fifths)))


def staff_code(note: Column, *, bass: bool = False) -> Column:
    """`note-C5_quarter` to `n6`, rests to `r0`."""
    codes, base = (BASS_CODES, 2) if bass else (TREBLE_CODES, 4)
    names = list(codes)
    letter = F.array_position(F.array(*(F.lit(n) for n in names)), F.substring(note, 6, 1)).cast("int") - 1
    value = pick(list(codes.values()), letter) + (F.substring(note, 7, 1).try_cast("int") - base) * 7
    return F.when(note.startswith("rest"), "r0").when(note.startswith("note"), F.concat(F.lit("n"), value.cast("string")))


def note_of_staff_code(code: Column, *, bass: bool = False) -> Column:
    names, base = (BASS_NAMES, 2) if bass else (TREBLE_NAMES, 4)
    value = F.substring(code, 2, 8).try_cast("int")
    return F.when(code.startswith("n"), F.concat(
        pick(names, F.pmod(value, F.lit(7))), (F.floor((value + 1) / 7) + base).cast("string")))


def detect_key(run: Column, clef: Column) -> Column:
    """±n of a run of accidentals (array of `pos`, `shift`), NULL when it fits no key.

    Leading accidentals that cannot open a key are skipped; the rest must follow the order of
    sharps or of flats, within 1.2 steps or across the octave edge.
    """
    def step(a: Column) -> Column:
        value = a["pos"] - clef_shift(clef) - 1
        return value - 7 * F.floor(value / 7)

    opens = F.transform(run, lambda a: ((a["shift"] == 1) & (F.abs(step(a) - SHARP_STEPS[0]) <= 1))
                        | ((a["shift"] == -1) & (F.abs(step(a) - FLAT_STEPS[0]) <= 1)))
    first = F.array_position(opens, F.lit(True)).cast("int")
    steps = F.transform(F.slice(run, F.greatest(first, F.lit(1)), F.size(run)), step)

    def follows(order) -> Column:
        # a run longer than seven starts over
        return F.forall(F.transform(steps, lambda p, i: (F.abs(p - pick(order, i % 7)) < 1.2)
                                    | (p - pick(order, i % 7) > 5.8)), lambda ok: ok)

    n = F.size(run) - first + 1
    return F.when((first > 0) & follows(SHARP_STEPS), n).when((first > 0) & follows(FLAT_STEPS), -n)
