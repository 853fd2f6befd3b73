"""Timestamp texts to instants, as native column expressions.

A text is cleaned, matched against every layout below, and turned into the array of all readings that
are valid for it: none for damaged text, one for most, two for a wall clock that the zone shows twice,
and those of every layout that has the text, such as both orders of day and month. A reading is its
layout, its pass through a repeated hour (0 outside of one) and its instant (microseconds since 1970,
UTC). Nothing here depends on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from timberline.functions.stage import staged
from timberline.functions.text import BLANKS

# fixed values: month abbreviations
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
# fixed values: zone abbreviations of daylight time, which is the first pass of a repeated hour
DAYLIGHT = r"^([a-z]{1,3}dt|cest|eest|west|mest|bst)$"

DAY_US = 86_400_000_000
_ZONE = r"(z|utc|[+-]\d\d:?\d\d|[a-z]{2,5})?"
_FRAC = r"(?:[.,](\d{1,9}))?"

#: name -> (pattern over the cleaned lower-case text, groups in order)
LAYOUTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "iso": (rf"^(\d{{4}})[-/](\d\d)[-/](\d\d)[t ](\d\d):(\d\d):(\d\d){_FRAC} ?{_ZONE}$", ("y", "m", "d", "h", "mi", "s", "f", "z")),
    "bsd": (rf"^([a-z]{{3}}) (\d{{1,2}}) (\d\d):(\d\d):(\d\d){_FRAC}$", ("mon", "d", "h", "mi", "s", "f")),
    "clf": (rf"^(\d{{1,2}})/([a-z]{{3}})/(\d{{4}}):(\d\d):(\d\d):(\d\d){_FRAC} ?{_ZONE}$", ("d", "mon", "y", "h", "mi", "s", "f", "z")),
    "ctime": (rf"^[a-z]{{3}} ([a-z]{{3}}) (\d{{1,2}}) (\d\d):(\d\d):(\d\d){_FRAC} (\d{{4}})$", ("mon", "d", "h", "mi", "s", "f", "y")),
    "us": (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),? (\d{{1,2}}):(\d\d):(\d\d){_FRAC} ?(am|pm)?$", ("m", "d", "y", "h", "mi", "s", "f", "ap")),
    "short": (r"^(\d\d)(\d\d)(\d\d) (\d\d)(\d\d)(\d\d)$", ("yy", "m", "d", "h", "mi", "s")),
    "mail": (rf"^(?:[a-z]{{3}}, ?)?(\d{{1,2}}) ([a-z]{{3}}) (\d{{4}}) (\d\d):(\d\d):(\d\d){_FRAC} ?{_ZONE}$", ("d", "mon", "y", "h", "mi", "s", "f", "z")),
    "basic": (rf"^(\d{{4}})(\d\d)(\d\d)t(\d\d)(\d\d)(\d\d){_FRAC}{_ZONE}$", ("y", "m", "d", "h", "mi", "s", "f", "z")),
    "eu": (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),? (\d{{1,2}}):(\d\d):(\d\d){_FRAC} ?(am|pm)?$", ("d", "m", "y", "h", "mi", "s", "f", "ap")),
    "dotted": (r"^(\d{4})-(\d\d)-(\d\d)-(\d\d)\.(\d\d)\.(\d\d)(?:\.(\d{1,9}))?$", ("y", "m", "d", "h", "mi", "s", "f")),
}
#: layouts of numbers between slashes, by the order that they stand for; only these share texts
ORDERS = {"mdy": "us", "dmy": "eu"}
READS = "array<struct<layout:int,pass:int,us:bigint>>"
_EPOCH = r"^(\d{10}|\d{13}|\d{16}|\d{10}\.\d{1,9})$"
_FIELDS = ("y", "yy", "m", "mon", "d", "h", "mi", "s", "f", "z", "ap")


def clean(text: Column) -> Column:
    """Lower case, without blanks and brackets around it, inner runs of blanks as one."""
    return F.regexp_replace(F.lower(F.trim(text, F.lit(BLANKS + "[](){}<>"))), r"\s+", " ")


def _parts(t: Column, layouts: list[str]) -> Column:
    """The text's fields by every layout that has it; a field is '' where the layout has none."""
    found = []
    for name in layouts:
        pattern, groups = LAYOUTS[name]
        at = {g: i for i, g in enumerate(groups, 1)}
        template = "|".join(f"${at[f]}" if f in at else "" for f in _FIELDS)
        found.append(F.when(t.rlike(pattern), F.split(F.concat(F.regexp_replace(t, pattern, template), F.lit("|" + name)), r"\|")))
    return F.array_compact(F.array(*found))


def _int(c: Column) -> Column:
    return F.when(c != "", c).cast("int")


def _micros(fraction: Column) -> Column:
    return F.substring(F.rpad(fraction, 6, "0"), 1, 6).cast("bigint")


def _date(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970, or null for an impossible date."""
    text = F.concat(F.lpad(y.cast("string"), 4, "0"), F.lit("-"), F.lpad(m.cast("string"), 2, "0"), F.lit("-"), F.lpad(d.cast("string"), 2, "0"))
    return F.unix_date(text.try_cast("date"))


def utc_of(wall: Column, zone: Column) -> Column:
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall), zone))


def wall_of(us: Column, zone: Column) -> Column:
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone))


def with_readings(df, text: str, zone: Column, opened: Column, orders: tuple[str, ...] = ("mdy",)):
    """Adds columns of each row's readings.

    ``_reads`` all valid readings (empty: none), in the order of ``LAYOUTS`` and of time; ``_unit`` the
    precision in microseconds; ``_fold`` the local day number where a reading is in a repeated hour (else
    null). ``zone``: IANA name, null for UTC. ``opened``: TIMESTAMP_NTZ in UTC, which years left out are
    counted from. ``orders``: what numbers between slashes can be.
    """
    layouts = [n for n in LAYOUTS if n not in ORDERS.values() or n in [ORDERS[o] for o in orders]]
    df = df.withColumns({"_z": F.coalesce(F.nullif(F.trim(zone), F.lit("")), F.lit("UTC")), "__opened": opened.cast("timestamp_ntz")})
    df = staged(staged(df, {"_t": clean(F.col(text))}), {"_p": _parts(F.col("_t"), layouts)})
    opened_us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', __opened)")
    df = staged(df, {"_open": F.when(F.exists("_p", lambda x: x[len(_FIELDS)] == "bsd"), F.floor(wall_of(opened_us, F.col("_z")) / F.lit(DAY_US)).cast("int"))})
    epoch = F.col("_t").rlike(_EPOCH)
    digits = F.regexp_extract(F.col("_t"), r"^(\d+)", 1)
    whole = F.when(epoch & digits.rlike(r"^\d{10,16}$"), digits).cast("bigint")
    epoch_us = (
        F.when(F.length(digits) == 10, whole * 1_000_000 + F.coalesce(F.when(F.col("_t").contains("."), _micros(F.substring_index(F.col("_t"), ".", -1))), F.lit(0)))
        .when(F.length(digits) == 13, whole * 1000)
        .otherwise(whole)
    )
    df = staged(df, {"_epoch": F.when(epoch, epoch_us)})
    slots = max(1, len(set(orders) & set(ORDERS)))  # the other layouts have no text in common
    reads, folds, units = [], [], []
    for i in range(slots):
        df = _reading(df, i)
        a, b, two, lay = (F.col(f"_{x}{i}") for x in ("a", "b", "two", "lay"))
        one = F.when(two, 1).otherwise(0)
        reads += [F.when(a.isNotNull(), F.struct(lay.alias("layout"), one.alias("pass"), a.alias("us"))), F.when(b.isNotNull(), F.struct(lay.alias("layout"), F.lit(2).alias("pass"), b.alias("us")))]
        folds.append(F.when(two, F.floor(F.col(f"_w{i}") / F.lit(DAY_US)).cast("bigint")))
        units.append(F.col(f"_unit{i}"))
    made = [f"_{x}{i}" for i in range(slots) for x in ("a", "b", "two", "lay", "w", "unit")]
    df = staged(df, {"_reads": F.array_compact(F.array(*reads)).cast(READS), "_fold": F.coalesce(*folds), "_unit": F.coalesce(*units)})
    return df.drop("_t", "_p", "_z", "_epoch", "__opened", "_open", *made)


def _reading(df, i: int):
    """The one or two instants of the i-th layout that has the text: ``_a`` and ``_b`` with its number."""
    name = {x: f"_{x}{i}" for x in ("q", "y", "m", "d", "us", "zt", "len", "lay", "read", "fixed", "w", "ca", "cb", "a", "b", "two", "unit")}
    df = staged(df, {name["q"]: F.get("_p", F.lit(i))})
    p = {f: F.col(name["q"])[k] for k, f in enumerate((*_FIELDS, "layout"))}
    month = F.coalesce(_int(p["m"]), F.when(p["mon"] != "", F.array_position(F.array(*[F.lit(x) for x in MONTHS]), p["mon"]).cast("int")))
    year = F.coalesce(_int(p["y"]), _int(p["yy"]) + 2000)
    hour = _int(p["h"])
    clock = F.when(p["ap"] == "", F.when(hour <= 23, hour)).when((hour >= 1) & (hour <= 12), hour % 12 + F.when(p["ap"] == "pm", 12).otherwise(0))
    of_day = F.when((_int(p["mi"]) <= 59) & (_int(p["s"]) <= 59), (clock * 3600 + _int(p["mi"]) * 60 + _int(p["s"])).cast("bigint") * 1_000_000) + F.when(p["f"] != "", _micros(p["f"])).otherwise(0)
    numbers = F.create_map(*[F.lit(x) for kv in enumerate(LAYOUTS) for x in kv[::-1]])
    lay = F.coalesce(F.try_element_at(numbers, p["layout"]), F.lit(len(LAYOUTS)))
    df = staged(df, {name["y"]: year, name["m"]: month, name["d"]: _int(p["d"]), name["us"]: of_day, name["zt"]: p["z"], name["len"]: F.length(p["f"]), name["lay"]: lay})
    y0 = F.year(F.date_from_unix_date(F.col("_open")))
    m, d, zt = (F.col(name[x]) for x in ("m", "d", "zt"))

    def first(years: int) -> Column:
        tries = [_date(y0 + k, m, d) for k in range(years + 1)]
        return F.coalesce(*[F.when(x >= F.col("_open"), x) for x in tries])

    yearless = F.when((m == 2) & (d == 29), first(8)).otherwise(first(1))
    day = F.when(F.col(name["lay"]) == list(LAYOUTS).index("bsd"), yearless).otherwise(_date(F.col(name["y"]), m, d))
    df = staged(df, {name["read"]: day.cast("bigint") * DAY_US + F.col(name["us"])})
    sign = F.when(zt.startswith("-"), -1).otherwise(1)
    is_offset = zt.rlike(r"^[+-]")
    hh, mm = F.substring(zt, 2, 2), F.substring(zt, -2, 2)
    offset = F.when(is_offset & (F.when(is_offset, hh).cast("int") <= 18) & (F.when(is_offset, mm).cast("int") <= 59), sign * (F.when(is_offset, hh).cast("bigint") * 3600 + F.when(is_offset, mm).cast("bigint") * 60) * 1_000_000).when(zt.isin("z", "utc"), F.lit(0).cast("bigint"))
    zoned = is_offset | zt.isin("z", "utc")
    stated = F.when(zoned, F.col(name["read"]) - offset)
    df = staged(df, {name["fixed"]: F.coalesce(F.col("_epoch"), stated) if i == 0 else stated})
    fixed, z, w = F.col(name["fixed"]), F.col("_z"), F.col(name["w"])
    df = staged(df, {name["w"]: F.when(fixed.isNotNull(), wall_of(fixed, z)).when(~F.coalesce(zoned, F.lit(False)), F.col(name["read"]))})
    # the zone's offsets a day before and after: the two that a change between them can leave valid
    before = w - (wall_of(w - DAY_US, z) - (w - DAY_US))
    after = w - (wall_of(w + DAY_US, z) - (w + DAY_US))
    ca, cb = F.col(name["ca"]), F.col(name["cb"])
    df = staged(df, {name["ca"]: F.least(before, after), name["cb"]: F.greatest(before, after)})
    df = staged(df, {name["ca"]: F.when(wall_of(ca, z) == w, ca), name["cb"]: F.when((ca != cb) & (wall_of(cb, z) == w), cb)})
    abbreviated = (zt != "") & ~zoned
    daylight = zt.rlike(DAYLIGHT)
    two = ca.isNotNull() & cb.isNotNull()
    # a stated instant is one reading, a zone abbreviation chooses among two
    a = F.when(fixed.isNotNull(), F.when(~two | (fixed == ca), fixed)).when(two & abbreviated & ~daylight, None).when(two, ca).otherwise(F.coalesce(ca, cb))
    b = F.when(fixed.isNotNull(), F.when(two & (fixed != ca), fixed)).when(two & ~(abbreviated & daylight), cb)
    unit = F.pow(F.lit(10), F.greatest(F.lit(0), 6 - F.col(name["len"])))
    df = staged(df, {name["a"]: a, name["b"]: b, name["two"]: two, name["unit"]: (F.when(F.col("_epoch").isNotNull(), F.lit(1)).otherwise(unit) if i == 0 else unit).cast("bigint")})
    return df.drop(*[name[x] for x in ("q", "y", "m", "d", "us", "zt", "len", "read", "fixed", "ca", "cb")])
