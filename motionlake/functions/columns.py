"""Column -> Column helpers used across operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from motionlake import spec

TINY = 1e-8


def masked_mean(value: Column, mask: Column, weight: Column | None = None) -> Column:
    """Aggregate: sum(v m w) / sum(m w), 0 when the weights sum to (almost) nothing."""
    m = mask if weight is None else mask * weight
    total = F.sum(m)
    return F.when(total < TINY, 0.0).otherwise(F.sum(value * m) / total)


def ratio_or(num: Column, den: Column, default: float | None) -> Column:
    return F.when(den > TINY, num / den).otherwise(F.lit(default))


def norm(*parts: Column) -> Column:
    total = parts[0] * parts[0]
    for p in parts[1:]:
        total = total + p * p
    return F.sqrt(total)


def clipped_acos(cosine: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def finite(value: Column) -> Column:
    """Null instead of NaN or infinity."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def half_even(value: Column) -> Column:
    """Round to the nearest integer, ties to even."""
    return F.rint(value)


def score(distance: Column, offset: Column, alpha: Column) -> Column:
    """Calibrated 0..100 score of a correction distance."""
    return F.lit(100.0) * F.exp(-alpha * F.greatest(distance - offset, F.lit(0.0)))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def file_stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot does not start a suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def file_suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^.]+)$", 1))


def natural_key(text: Column) -> Column:
    """Sort key in which digit runs compare as numbers and letters ignore case.

    A run of digits becomes a control character, the count of its digits without leading
    zeros, and those digits, so numbers of any length compare by size. The control
    character makes a text that ends there sort before any longer text, as comparing the
    parts one by one would.
    """
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), F.lit(1))

    def part(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+", "")
        number = F.concat(F.lit("\u0001"), F.lpad(F.length(digits).cast("string"), 10, "0"), digits)
        return F.when(run.rlike(r"^\d"), number).otherwise(run)

    return F.array_join(F.transform(runs, part), "")


def direction(x: Column, y: Column, z: Column) -> Column:
    """Named main direction of a correction vector; the first axis wins ties."""
    ax, ay, az = F.abs(x), F.abs(y), F.abs(z)
    side = F.when(x > 0, "toward_dominant_side").otherwise("toward_non_dominant_side")
    lift = F.when(y > 0, "raise").otherwise("lower")
    depth = F.when(z > 0, "forward").otherwise("backward")
    return (
        F.when(norm(x, y, z) < 0.01, "minimal_change")
        .when((ax >= ay) & (ax >= az), side)
        .when(ay >= az, lift)
        .otherwise(depth)
    )


def hand_note(handedness: Column) -> Column:
    hand = F.lower(handedness)
    return (
        F.when(hand == "left", spec.HAND_NOTE["left"])
        .when(hand == "right", spec.HAND_NOTE["right"])
        .otherwise(spec.HAND_NOTE_UNKNOWN)
    )


def annotation_state(exists: Column, score_value: Column, feedback: Column, correction: Column) -> Column:
    """unannotated / in_progress / annotated; text of only white space counts as empty."""
    written = (F.regexp_replace(F.coalesce(feedback, F.lit("")), r"\s", "") != "") | (
        F.regexp_replace(F.coalesce(correction, F.lit("")), r"\s", "") != ""
    )
    return (
        F.when(~exists, "unannotated")
        .when(score_value.isNotNull() & written, "annotated")
        .otherwise("in_progress")
    )


def seeded_order(key: Column, seed: int) -> Column:
    """Deterministic pseudo-random order: the MD5 of key and seed."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def seeded_unit(key: Column, salt: str) -> Column:
    """Deterministic uniform draw in (0, 1) from the first 12 hex digits of an MD5."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f"#{salt}"))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def seeded_normal(key: Column, salt: str) -> Column:
    """Standard normal draw (Box-Muller) from two independent uniform draws."""
    u, v = seeded_unit(key, salt + "u"), seeded_unit(key, salt + "v")
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * 3.141592653589793 * v)
