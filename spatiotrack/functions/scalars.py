"""Column functions of the range, weight and score chain. All are JVM expressions, null-safe and NaN-safe."""

from __future__ import annotations

import math
import unicodedata
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import DEFAULTS, DISTANCE_MARK, NO_READING, OFFLINE_STATES, UNIT_METRES, Settings


#: Letters that consist of an ASCII letter and a mark, by Unicode's own decomposition.
_MARKED = [chr(c) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if (d := unicodedata.normalize("NFKD", chr(c)))[0].isascii() and d[0].islower() and all(map(unicodedata.combining, d[1:]))]
#: And letters that stand for one or two without being made of them.
_SINGLE = {"ø": "o", "đ": "d", "ł": "l", "ħ": "h", "ı": "i", "ð": "d"}
DIGRAPHS = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th"}
ACCENTS = ("".join([*_MARKED, *_SINGLE]), "".join([*(unicodedata.normalize("NFKD", c)[0] for c in _MARKED), *_SINGLE.values()]))


def number(state: Column) -> Column:
    """A reading's number, null where the state is no number."""
    return state.try_cast("double")


def finite(c: Column) -> Column:
    """Null instead of NaN: Spark orders NaN above all numbers, so range guards need this first."""
    return F.when(~F.isnan(c), c)


def device_of(entity_id: Column) -> Column:
    """What stands before the mark, without the domain. No patterns: they took more time than all else of a reading."""
    at = F.instr(entity_id, DISTANCE_MARK)
    head = F.when(at > 0, F.left(entity_id, at - 1)).otherwise(entity_id)
    return F.when(head.startswith("sensor."), F.substr(head, F.lit(len("sensor.") + 1))).otherwise(head)


def scanner_of(entity_id: Column) -> Column:
    """What stands behind the first mark, null without one."""
    at = F.instr(entity_id, DISTANCE_MARK)
    return F.when(at > 0, F.substr(entity_id, at + len(DISTANCE_MARK)))


def metres(value: Column, unit: Column) -> Column:
    """A length in metres; an unknown unit counts as metres."""
    by = F.lit(1.0)
    for name, factor in UNIT_METRES.items():
        if factor != 1.0:
            by = F.when(unit == name, factor).otherwise(by)
    return value * by


def corrected(value: Column, correction: Column) -> Column:
    return value * F.coalesce(F.when(finite(correction) > 0, correction), F.lit(1.0))


def tracker_height(h: Column, s: Settings = DEFAULTS) -> Column:
    return F.coalesce(F.when(finite(h).between(0, s.tracker_height_max), h), F.lit(s.tracker_height_m))


def horizontal(slant: Column, height: Column, tracker: Column, s: Settings = DEFAULTS) -> Column:
    """The slant range projected onto the floor, where the receiver's height is known and plausible."""
    dz = height - tracker
    return F.when(finite(height).between(0, s.receiver_height_max), F.sqrt(F.greatest(slant * slant - dz * dz, F.lit(0.0)))).otherwise(slant)


def normalized(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"^\s+|\s+$", ""))


def scanner_token(slug: Column) -> Column:
    """Hardware token at the end of a scanner's slug, null if there is none."""
    last = F.lower(F.element_at(F.split(slug, "_"), -1))
    return F.when(last.rlike("^[0-9a-f]{5,12}$"), last)


def address_tail(address: Column) -> Column:
    """Last six hexadecimal digits of an address, null if there are fewer."""
    digits = F.regexp_replace(F.lower(address), "[^0-9a-f]", "")
    return F.when(F.length(digits) >= 6, F.right(digits, F.lit(6)))


def token_matches(token: Column, address: Column) -> Column:
    """Same vendor part, and the last byte of the address at most three above the token's; any case, hexadecimal only."""
    tail, tok = address_tail(address), F.right(F.lower(token), F.lit(6))
    gap = F.pmod(F.conv(F.right(tail, F.lit(2)), 16, 10).cast("int") - F.conv(F.right(tok, F.lit(2)), 16, 10).cast("int"), F.lit(256))
    return F.coalesce(tok.rlike("^[0-9a-f]{6}$") & (F.left(tail, F.lit(4)) == F.left(tok, F.lit(4))) & (gap <= 3), F.lit(False))


def token_tails(token: Column) -> Column:
    """The address tails that a token matches: the same vendor part, the last byte up to three above; none for a token that is not hexadecimal."""
    tok = F.right(F.lower(token), F.lit(6))
    last = F.conv(F.right(tok, F.lit(2)), 16, 10).cast("int")
    tails = F.array(*[F.concat(F.left(tok, F.lit(4)), F.lpad(F.lower(F.hex(F.pmod(last + i, F.lit(256)))), 2, "0")) for i in range(4)])
    return F.when(tok.rlike("^[0-9a-f]{6}$"), tails)


def slugify(name: Column) -> Column:
    """Lower case, accents dropped, everything else but ASCII letters and digits to single underscores, none at the ends."""
    plain = F.translate(F.lower(name), *ACCENTS)
    for letter, two in DIGRAPHS.items():
        plain = F.replace(plain, F.lit(letter), F.lit(two))
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def looks_online(state: Column) -> Column:
    return F.coalesce(~F.lower(F.trim(state)).isin(*OFFLINE_STATES), F.lit(False))


def has_reading(state: Column) -> Column:
    return ~F.coalesce(state, F.lit("")).isin(*NO_READING)


def jump_weight(r: Column, previous: Column, least: Column, s: Settings = DEFAULTS) -> Column:
    a, b = F.greatest(r, least), F.greatest(previous, least)
    x = (F.greatest(a / b, b / a) - 1) / s.jump_tolerance
    return F.when(previous.isNull(), F.lit(1.0)).otherwise(1 / (1 + x * x))


def min_weight_radius(scale: Column, s: Settings = DEFAULTS) -> Column:
    return F.when(scale != 0, scale * s.min_weight_radius_m).otherwise(F.lit(1e-3))


def fit_quality(rms_m: Column, s: Settings = DEFAULTS) -> Column:
    x = rms_m / s.residual_scale_m
    return 1 / (1 + x * x)


def correction_factor(f: Column, s: Settings = DEFAULTS) -> Column:
    return F.round(F.least(F.lit(s.factor_max), F.greatest(F.lit(s.factor_min), f)), 4)


def bias_db(factor: Column) -> Column:
    return F.round(-30 * F.log10(factor), 1)


def _least_above(k: int) -> float:
    """The least double that is not below k/20."""
    return k / 20 if Fraction(k / 20) >= Fraction(k, 20) else math.nextafter(k / 20, 1.0)


def distance_label(m: Column, unit: str = "m") -> Column:
    """One decimal, rounded by the exact value of the double and half-way away from zero, as toFixed(1) does."""
    value = m.cast("double") * (1.0 if unit == "m" else 3.28084)
    size = F.abs(value)
    # Doubles from 2**53 on are whole; what is left of smaller ones above their floor is exact.
    plain = size < float(1 << 53)
    whole = F.floor(F.when(plain, size))
    part = size - whole
    tenth = sum(((part >= _least_above(k)).cast("long") for k in range(1, 20, 2)), F.lit(0))
    label = F.concat(F.when(value < 0, "-").otherwise(""), (whole + F.when(tenth == 10, 1).otherwise(0)).cast("string"), F.lit("."), (tenth % 10).cast("string"), F.lit(f" {unit}"))
    return F.when(plain, label).otherwise(F.format_string(f"%.1f {unit}", value))


def error_hue(share: Column) -> Column:
    """Blue (reads short) over green to red (reads long)."""
    return 240 - (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), share)) + 1) * 120


def error_band(hue: Column, stale: Column) -> Column:
    return F.when(stale, "stale").when(hue < 90, "red").when(hue > 150, "blue").otherwise("green")


def golden_hue(i: Column) -> Column:
    return F.pmod(F.round(F.pmod(i * 137.508, F.lit(360.0))), F.lit(360.0)).cast("int")


def recency_bucket(i: Column, points: Column) -> Column:
    return F.least(F.lit(7), F.floor((i - 1) / F.greatest(points - 1, F.lit(1)) * 8).cast("int"))


def legacy_id(entity_id: Column) -> Column:
    """An entity id whose name was doubled by mistake."""
    return entity_id.rlike(r"^sensor\.(.+)_\1_bps_(zone|floor)$")


def updated_or_zero(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def grid_step(scale: Column, zoom: Column, feet: Column, least_px: float = 45.0) -> Column:
    """struct<units, px>: of a grid in metres or feet, the fewest whole units a line that are ``least_px`` apart on screen; null without a scale."""
    unit = F.when(feet, scale * 0.3048).otherwise(scale)
    units = F.greatest(F.lit(1), F.ceil(F.lit(least_px) / (unit * zoom)).cast("int"))
    return F.when((scale > 0) & (zoom > 0), F.struct(units.alias("units"), (units * unit).alias("px")))
