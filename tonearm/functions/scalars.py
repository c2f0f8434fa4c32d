"""Scalar expressions over columns; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOSSLESS = (".flac", ".wav", ".alac", ".ape", ".wv")


def nocase(c: Column) -> Column:
    """ASCII case folding only, as the library's sort order has it."""
    return F.translate(c, UPPER, LOWER)


def like_nocase(c: Column, text: str) -> Column:
    """Substring match without ASCII case; % and _ in ``text`` are wildcards."""
    return nocase(c).like("%" + text.translate(str.maketrans(UPPER, LOWER)) + "%")


def extension(path: Column) -> Column:
    """Lower-case extension with its point; a name that only begins with a point has none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]*)$", 1))


def escape_path(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def duration_text(seconds: Column) -> Column:
    """Hours and minutes; no hours below one."""
    h, m = F.floor(seconds / 3600).cast("long").cast("string"), F.floor(seconds % 3600 / 60).cast("long").cast("string")
    return F.when(seconds.isNull(), "-").when(seconds >= 3600, F.concat(h, F.lit("h "), m, F.lit("m"))).otherwise(F.concat(m, F.lit("m")))


def size_text(size: Column) -> Column:
    """Bytes in decimal units, one place."""
    unit = lambda n, name: F.concat(F.format_string("%.1f", size / n), F.lit(f" {name}"))
    return F.when(size.isNull(), "-").when(size >= 1_000_000_000, unit(1e9, "GB")).when(size >= 1_000_000, unit(1e6, "MB")).otherwise(unit(1e3, "KB"))


def bitrate_text(rate: Column) -> Column:
    return F.when(rate.isNull(), "-").otherwise(F.concat(F.round(rate / 1000, 0).cast("long").cast("string"), F.lit(" kbps")))


def corrected_bpm(bpm: Column) -> Column:
    """Half and double tempo errors."""
    return F.when(bpm < 60, bpm * 2).when(bpm > 200, bpm / 2).otherwise(bpm)


def rms_energy(energy: Column, n: Column) -> Column:
    return F.when(n <= 0, F.lit(0.0)).otherwise(F.least(F.sqrt(energy / n), F.lit(1.0)))


def effective_cutoff(cutoff: Column, cliff: Column, full: float = 21_000.0) -> Column:
    """Null if unmeasured; the whole band if there is a cliff but no cutoff."""
    return F.when(cliff.isNotNull(), F.coalesce(cutoff, F.lit(full)))


def is_missing(c: Column, positive: bool = False, text: bool = False) -> Column:
    out = c.isNull()
    if positive:
        out = out | (c <= 0)
    if text:
        out = out | (c == "")
    return F.coalesce(out, F.lit(True))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """L2-normalised."""
    return F.zip_with(a, F.array_repeat(norm(a) + 1e-12, F.size(a)), lambda x, n: x / n)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, within 0..2; 1 if a vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(1.0)).otherwise(1 - F.least(F.greatest(dot(a, b) / n, F.lit(-1.0)), F.lit(1.0)))


# Enharmonic names, and the semitone of each key.
ALIASES = {"Db": "C#", "D#": "Eb", "Gb": "F#", "G#": "Ab", "A#": "Bb"}
SEMITONES = {"C": 0, "C#": 1, "D": 2, "Eb": 3, "E": 4, "F": 5, "F#": 6, "G": 7, "Ab": 8, "A": 9, "Bb": 10, "B": 11}


def normal_key(key: Column) -> Column:
    out = key
    for a, b in ALIASES.items():
        out = F.when(key == a, b).otherwise(out)
    return out


def fifths(key: Column, scale: Column) -> Column:
    """Place on the circle of fifths; a minor key counts as its relative major; null if unknown."""
    name, semitone = normal_key(key), F.lit(None).cast("int")
    for k, s in SEMITONES.items():
        semitone = F.when(name == k, s).otherwise(semitone)
    major = F.when(scale == "minor", (semitone + 3) % 12).otherwise(semitone)
    return (major * 7) % 12


def key_distance(ka: Column, sa: Column, kb: Column, sb: Column) -> Column:
    """Steps on the circle of fifths, 0..6; 6 if either is unknown."""
    d = F.abs(fifths(ka, sa) - fifths(kb, sb))
    return F.coalesce(F.least(d, 12 - d), F.lit(6))


# Double-precision rational approximation of the normal distribution function (Hart 1968, in West's form).
NUMERATOR = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
DENOMINATOR = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def normal_cdf(x: Column) -> Column:
    a = F.abs(x)
    horner = lambda coefficients: reduce(lambda s, c: s * a + c, coefficients[1:], F.lit(coefficients[0]))
    tail = F.exp(-a * a / 2) * horner(NUMERATOR) / horner(DENOMINATOR)
    tail = F.when(a < 7.07106781186547, tail).otherwise(F.lit(0.0))
    return F.when(x > 0, 1 - tail).otherwise(tail)


def bpm_jump(a: Column, b: Column) -> Column:
    """Tempo step that allows for double and half time."""
    return F.least(F.abs(a - b), F.abs(2 * a - b), F.abs(a - 2 * b))


def tempo_word(bpm: Column, low: Column, high: Column) -> Column:
    return F.when(bpm < low, "Slow").when(bpm > high, "Upbeat").otherwise("Mid-tempo")


def energy_word(energy: Column, low: Column, high: Column) -> Column:
    return F.when(energy < low, "Calm").when(energy > high, "Energetic").otherwise("Moderate")
