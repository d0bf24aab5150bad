"""Text, number and theme expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.strip removes.
WHITE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


@dataclass(frozen=True)
class Hazard:
    """A theme matches if it contains a marker; it is strong if it equals one of `exact` or ends with one of `endings` and doesn't start with `barred`."""

    markers: tuple[str, ...]
    exact: tuple[str, ...]
    endings: tuple[str, ...]
    barred: str | None = None


#: Theme markers by hazard. More hazards can be registered here.
HAZARDS = {
    "flood": Hazard(("FLOOD",), ("FLOOD",), ("_FLOOD", "_FLOODS", "_FLOODING", "_FLASH_FLOODS"), "WB_"),
    "wildfire": Hazard(("WILDFIRE", "FOREST_FIRE", "WILD_FIRE"), (), ("_WILDFIRE", "_WILDFIRES", "_FOREST_FIRE", "_WILD_FIRE")),
}
STRENGTHS = {"weak": 1, "high": 2}


def trimmed(col: Column | str) -> Column:
    return F.btrim(col, F.lit(WHITE))


def blank_to_null(col: Column | str) -> Column:
    return F.nullif(trimmed(col), F.lit(""))


def number(col: Column | str) -> Column:
    """A decimal number, else null."""
    t = trimmed(col)
    return F.when(t.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))


def integer(col: Column | str) -> Column:
    t = trimmed(col)
    return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("bigint"))


def record_time(col: Column | str) -> Column:
    """yyyyMMddHHmmss as a timestamp without time zone; exactly 14 digits, else null."""
    t = trimmed(col)
    parsed = F.try_to_timestamp(F.when(t.rlike("^[0-9]{14}$"), t), F.lit("yyyyMMddHHmmss"))
    return parsed.cast("timestamp_ntz")


def before_comma(col: Column | str) -> Column:
    return F.substring_index(col, ",", 1)


def theme_tokens(*columns: Column) -> Column:
    """Distinct upper-case themes of semicolon-separated fields, in order; offsets after a comma are cut."""
    joined = F.concat_ws(";", *(F.coalesce(c, F.lit("")) for c in columns))
    tokens = F.transform(F.split(joined, ";"), lambda x: F.upper(trimmed(before_comma(x))))
    return F.array_distinct(F.filter(tokens, lambda x: x != ""))


def _any(tests: list[Column]) -> Column:
    found = F.lit(False)
    for t in tests:
        found = found | t
    return found


def matched_themes(themes: Column | str, hazard: str) -> Column:
    h = HAZARDS[hazard]
    return F.filter(themes, lambda t: _any([F.contains(t, F.lit(m)) for m in h.markers]))


def match_strength(matched: Column | str, hazard: str) -> Column:
    """high, weak, or null for no match."""
    h = HAZARDS[hazard]

    def strong(t: Column) -> Column:
        ends = _any([F.endswith(t, F.lit(e)) for e in h.endings])
        allowed = ~F.startswith(t, F.lit(h.barred)) if h.barred else F.lit(True)
        return _any([t == e for e in h.exact]) | (ends & allowed)

    return F.when(F.size(matched) > 0, F.when(F.exists(matched, strong), "high").otherwise("weak"))


def strength_rank(strength: Column) -> Column:
    return F.when(strength == "high", STRENGTHS["high"]).when(strength == "weak", STRENGTHS["weak"]).otherwise(0)


def hour_of(col: Column | str) -> Column:
    return F.date_trunc("hour", col).cast("timestamp_ntz")


def six_hours_of(col: Column | str) -> Column:
    """Start of the six-hour bucket."""
    start = F.date_trunc("day", col).cast("timestamp_ntz")
    return (start + F.make_dt_interval(hours=(F.floor(F.hour(col) / 6) * 6).cast("int"))).cast("timestamp_ntz")


def iso(col: Column | str) -> Column:
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")


def flags(*named: tuple[str, Column]) -> Column:
    """Names of the conditions that hold, in order."""
    return F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in named)), lambda x: x.isNotNull())
