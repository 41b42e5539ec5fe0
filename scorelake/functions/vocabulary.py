"""Names, thresholds and tables that results depend on."""

from __future__ import annotations

# Default confidence per symbol class.
CLASS_CONFIDENCE = {
    "accent": 0.55, "staccato": 0.45, "tenuto": 0.45, "staccatissimo": 0.40, "marcato": 0.45,
    "fermata": 0.45, "caesura": 0.45, "trill": 0.40, "turn": 0.40, "inverted_turn": 0.40,
    "mordent": 0.40, "dynamic": 0.40, "down_bow": 0.40, "up_bow": 0.40, "arpeggio": 0.40,
    "pedal_start": 0.45, "pedal_stop": 0.45, "fingering_0": 0.45, "fingering_1": 0.45,
    "fingering_2": 0.45, "fingering_3": 0.45, "fingering_4": 0.45, "fingering_5": 0.45,
    "tremolo_1": 0.45, "tremolo_2": 0.45, "tremolo_3": 0.45, "tremolo_4": 0.45,
    "crescendo": 0.40, "diminuendo": 0.40,
}

# Classes that span two note groups.
SPANNING_CLASSES = ("crescendo", "diminuendo")
DYNAMIC_LETTER_PREFIX = "dynamic_letter_"
# Fixed value: the grammar of dynamic marks.
DYNAMIC_PATTERN = "^(p{1,4}|f{1,4}|m[pf]|s?f{1,3}[pz]?|r?f{1,2}z?)$"

# Association and curve limits, in staff units.
MAX_HORIZONTAL_UNITS = 2.5
MAX_VERTICAL_UNITS = 4.0
FALLBACK_UNIT = 12.0
CURVE_VERTICAL_UNITS = 5.5
MAX_TIE_SPAN_UNITS = 6.5
XML_CONFIDENCE = 0.45

# Exact note lengths. A whole note has 80640 = 2^8 * 3^2 * 5 * 7 ticks.
WHOLE_TICKS = 80640

# Order in which sharps are added to a key; flats use the reverse.
SHARP_ORDER = ("F", "C", "G", "D", "A", "E", "B")
# Key name per number of fifths, -7 to 7.
KEY_NAMES = ("CbM", "GbM", "DbM", "AbM", "EbM", "BbM", "FM", "CM", "GM", "DM", "AM", "EM", "BM", "F#M", "C#M")
