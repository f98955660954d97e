"""Column builders: names, dates, coordinates, lists and display strings. All are
built-in expressions, so they stay inside generated code and fold into scans."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the catalogue's input formats.
UUID = r"^([0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12})"
VIDEO_EXTENSIONS = ("MOV", "MP4", "M4V", "AVI", "MKV", "3GP")
EXTENSION_ALIASES = {"JPEG": "JPG"}
PLACEHOLDERS = ("parse error", "file not found", "image encode failed", "")
EPOCH_2001 = 978307200
MAX_ITEMS, MAX_CHARS = 60, 120


def strip(c: Column) -> Column:
    """Trim all white space (trim() takes spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def uuid_of(name: Column) -> Column:
    """Upper-cased UUID at the start of a file name, else null."""
    return F.nullif(F.upper(F.regexp_extract(name, UUID, 1)), F.lit(""))


def is_key(c: Column) -> Column:
    """Has it the shape of a key: 8 to 36 hex digits and dashes."""
    return F.coalesce(F.length(c).between(8, 36) & (F.translate(F.lower(c), "0123456789abcdef-", "") == ""), F.lit(False))


def norm_ext(ext: Column) -> Column:
    """Upper case without leading dots, aliases collapsed."""
    up = F.upper(F.regexp_replace(ext, r"^\.+", ""))
    out = up
    for alias, name in EXTENSION_ALIASES.items():
        out = F.when(up == alias, F.lit(name)).otherwise(out)
    return out


def media_class(ext: Column) -> Column:
    return F.when(norm_ext(ext).isin(*VIDEO_EXTENSIONS), "video").otherwise("image")


def first_truthy(*cols: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cols))


def first_present(*cols: Column) -> Column:
    """First value that is not null (an empty one counts)."""
    return F.coalesce(*cols)


def _shape(c: Column) -> Column:
    """Every digit as a 9, so that a form can be compared as text."""
    return F.translate(c, "012345678", "999999999")


def video_date(*cols: Column) -> Column:
    """First value of the form date, time and optional offset: struct(text, offset)."""

    def one(c: Column) -> Column:
        text, offset = F.substring(c, 1, 19), F.substring(c, 20, 1 << 30)
        fits = (_shape(text) == "9999:99:99 99:99:99") & _shape(offset).isin("", "+99:99", "-99:99")
        return F.when(fits, F.struct(text.alias("text"), F.nullif(offset, F.lit("")).alias("offset")))

    return F.coalesce(*map(one, cols))


def parse_exif_ts(text: Column, offset: Column) -> Column:
    """`YYYY:MM:DD HH:MM:SS` -> struct(date, time, iso); null fields where it isn't a date.
    Wall-clock time is kept; the offset, where known, ends the ISO string."""
    ts = F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss"))
    date, time = F.date_format(ts, "yyyy-MM-dd"), F.date_format(ts, "HH:mm:ss")
    iso = F.concat(date, F.lit("T"), time, F.coalesce(offset, F.lit("")))
    return F.struct(date.alias("date"), time.alias("time"), iso.alias("iso"))


def signed_by_ref(value: Column, ref: Column, negative: str) -> Column:
    """Negative where the hemisphere letter says so and the value is still positive."""
    return F.when((ref == negative) & (value > 0), -value).otherwise(value)


def ref_letter(value: Column, positive: str, negative: str) -> Column:
    return F.when(value >= 0, positive).when(value < 0, negative)


def _decimal(c: Column) -> Column:
    """A sign, digits and perhaps a fraction as a number; null for any other form."""
    return F.when(c.rlike(r"\A[+-]?[0-9]+(\.[0-9]+)?\z"), c.try_cast("double"))


def _coord(text: Column) -> Column:
    """Two or three numbers with white space between, or each with its sign and nothing
    between (a slash may end those)."""

    def parts(t: Column) -> Column:
        signed = F.substring(t, 1, 1).isin("+", "-") & ~t.rlike(r"\s")
        spread = strip(F.regexp_replace(F.when(t.endswith("/"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t), "([+-])", " $1"))
        return F.split(F.when(signed, spread).otherwise(t), r"\s+")

    def spot(numbers: Column) -> Column:
        lat, lon = (F.try_element_at(numbers, F.lit(i)) for i in (1, 2))
        ok = F.size(numbers).between(2, 3) & ~F.exists(numbers, lambda x: x.isNull()) & lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))
        return F.when(ok, F.struct(lat.alias("lat"), lon.alias("lon")))

    return once(once(strip(text), lambda t: F.transform(parts(t), _decimal)), spot)


def parse_coord_text(*cols: Column) -> Column:
    """First of several texts that holds valid coordinates ("lat lon [alt]" or ISO 6709):
    struct(lat, lon). Out of range and 0,0 are passed over."""
    return F.coalesce(*(_coord(c) for c in cols))


def no_sentinel(value: Column, sentinel: float = -180.0) -> Column:
    return F.nullif(value, F.lit(sentinel))


def source_label(first: Column, second: Column, a: str, b: str) -> Column:
    """Which source has the value; 0.0 counts as missing."""
    has = lambda c: c.isNotNull() & (c != 0)
    return F.when(has(first) & has(second), "both").when(has(first), a).when(has(second), b)


def fill_falsy(first: Column, second: Column) -> Column:
    return F.when(first.isNotNull() & (first != 0), first).otherwise(second)


def one_or_many(json: Column, path: str) -> Column:
    """A key of a variant that holds a scalar or a list, as a list without nulls."""
    many = F.try_variant_get(json, path, "array<string>")
    one = F.try_variant_get(json, path, "string")
    return F.filter(F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>")), lambda x: x.isNotNull())


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once a row: what stands outside of a function of elements
    is worked out anew for each element."""
    return F.transform(F.array(c), f)[0]


def ordered_ci_distinct(a: Column) -> Column:
    """First spelling of each value, compared in lower case, order kept. By sorting: array_position
    looks through the list for each value, and ends each search by an exception."""

    def kept(a: Column) -> Column:
        at = F.filter(F.transform(a, lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("i"))), lambda p: p["low"].isNotNull())
        first = lambda s: F.filter(s, lambda p, k: (k == 0) | (p["low"] != F.get(s, k - 1)["low"]))
        places = F.sort_array(F.transform(once(F.sort_array(at), first), lambda p: p["i"]))
        return F.transform(places, lambda i: a[i])

    return once(a, kept)


def minus_ci(a: Column, gone: Column) -> Column:
    """Values whose trimmed lower case is not in gone; duplicates and spelling stay."""
    low = F.transform(gone, lambda x: F.lower(strip(x)))
    return once(low, lambda low: F.filter(a, lambda x: ~F.array_contains(low, F.lower(strip(x)))))


def clean_list(a: Column) -> Column:
    """At most 60 items, inner white space collapsed, 120 characters each, blanks and
    repeats (in lower case) dropped."""
    cut = F.transform(F.slice(a, 1, MAX_ITEMS), lambda x: F.substring(F.regexp_replace(strip(x), r"\s+", " "), 1, MAX_CHARS))
    return ordered_ci_distinct(F.filter(cut, lambda x: x.isNotNull() & (x != "")))


def json_list(c: Column) -> Column:
    """A JSON array of strings; null, malformed or other JSON is an empty list."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def clean_text(c: Column, placeholders: Iterable[str] = PLACEHOLDERS) -> Column:
    """Null for placeholder texts, the text as it is otherwise."""
    return F.when(F.lower(strip(c)).isin(*placeholders), None).otherwise(c)


def text_or(c: Column, other: Column, bad: Iterable[str]) -> Column:
    """Exact-case stop set, then a second column."""
    return F.coalesce(F.when(~c.isin(*bad), c), other)


def display_place(aoi: Column, city: Column, state: Column, country: Column, code: Column, name: Column) -> Column:
    """Area, city and state (US) or country without repeats; else the raw name."""
    tail = F.when(code == "US", state).otherwise(country)
    parts = F.array_compact(F.array(blank_to_null(aoi), blank_to_null(city), blank_to_null(tail)))
    return F.coalesce(F.nullif(F.array_join(ordered_ci_distinct(parts), ", "), F.lit("")), blank_to_null(name))


def year_of(date: Column) -> Column:
    return F.substring(date, 1, 4)


def date_parts(ts: Column) -> Column:
    """struct(year, month, day) of a timestamp, as numbers."""
    return F.struct(F.year(ts).alias("year"), F.month(ts).alias("month"), F.dayofmonth(ts).alias("day"))


def seconds_2001(x: Column) -> Column:
    """Seconds since 2001 (UTC) as a timestamp."""
    return F.timestamp_seconds(x + F.lit(EPOCH_2001))


def year_2001(x: Column) -> Column:
    """Four digits, as many as it takes after 9999 (where the format would add a plus)."""
    at = seconds_2001(x)
    year = F.when(F.year(at) > 9999, F.year(at).cast("string")).otherwise(F.date_format(at, "yyyy"))
    return F.coalesce(year, F.lit("unknown"))


def change_key(*cols: Column) -> Column:
    """One comparable key of several signals; nulls are values."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def leading_int(c: Column) -> Column:
    """"3 people" -> 3; anything else 0."""
    return F.coalesce(F.try_element_at(F.split(strip(c), r"\s+"), F.lit(1)).try_cast("int"), F.lit(0))


def location_guess(parts: Column, confidence: Column) -> Column:
    """"a, b (confidence: 80%)", halves to the even percent; without the suffix where the
    confidence isn't a number."""
    text = F.nullif(F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), ", "), F.lit(""))
    number = F.coalesce(confidence, F.lit("0")).try_cast("double")
    return F.when(number.isNull(), text).otherwise(F.concat(text, F.lit(" (confidence: "), F.format_string("%.0f%%", F.bround(number * 100)), F.lit(")")))


def without_confidence(c: Column) -> Column:
    return F.trim(F.substring_index(c, "(", 1))


def retime_iso(existing: Column, date: Column) -> Column:
    """The date half replaced; null where the old value doesn't begin with a date."""
    return F.when(existing.rlike(r"^\d{4}-\d{2}-\d{2}"), F.concat(date, F.substring(existing, 11, 1 << 30)))


def valid_date(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(c, "yyyy-MM-dd").isNotNull(), F.lit(False))


def share_name(key: Column, date: Column, time: Column, ext: Column) -> Column:
    """A readable file name from date and time, else from the key."""
    digits = F.nullif(F.regexp_replace(F.coalesce(time, F.lit("")), "[^0-9]", ""), F.lit(""))
    dated = F.concat(F.nullif(date, F.lit("")), F.coalesce(F.concat(F.lit("-"), digits), F.lit("")))
    return F.concat(F.regexp_replace(F.coalesce(dated, key), r"[^\p{L}\p{N}_-]", ""), F.lit("."), ext)


def letters_only(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z]", "")


def year_window(year: Column, windows: Sequence[str]) -> Column:
    """Export window of a year: before 1980 one window; null where not configured."""
    y = year.try_cast("int")
    w = F.when(y < 1980, "pre1980").otherwise(y.cast("string"))
    return F.when(w.isin(*windows), w)


def window_bounds(window: Column) -> Column:
    """[from, to) dates of a window."""
    y = window.try_cast("int")
    start = F.when(window == "pre1980", F.make_date(F.lit(1800), F.lit(1), F.lit(1))).otherwise(F.make_date(y, F.lit(1), F.lit(1)))
    end = F.when(window == "pre1980", F.make_date(F.lit(1980), F.lit(1), F.lit(1))).otherwise(F.make_date(y + 1, F.lit(1), F.lit(1)))
    return F.struct(start.alias("from_date"), end.alias("to_date"))


def without_matching(a: Column, pattern: str) -> Column:
    return F.filter(a, lambda x: ~x.rlike(pattern))


def without_words(text: Column, names: Column) -> Column:
    """Whole-word removal of every part of the names, in any case; spaces and edge marks
    tidied."""
    parts = F.filter(F.flatten(F.transform(names, lambda n: F.split(n, r"\s+"))), lambda p: p != "")
    quoted = lambda p: F.concat(F.lit(r"(?i)\b\Q"), p, F.lit(r"\E\b"))
    gone = F.aggregate(parts, text, lambda acc, p: F.regexp_replace(acc, quoted(p), F.lit("")))
    return F.regexp_replace(F.regexp_replace(gone, r"\s+", " "), r"^[ ,-]+|[ ,-]+$", "")


CONTEXT_LABELS = {"date": "Date: ", "place": "Place: ", "point": "Coordinates: ", "people": "People: ", "none": "(nothing known)"}


def context_text(date: Column, place: Column, lat: Column, lon: Column, people: Column, labels: dict[str, str] = CONTEXT_LABELS) -> Column:
    """Context lines of one row for a model: its date, its place or else its coordinates,
    and its people, each after its label."""
    at = F.when(lat.isNotNull() & lon.isNotNull(), F.format_string("%.4f, %.4f", lat, lon))
    told = {"date": F.nullif(date, F.lit("")), "place": place, "point": F.when(place.isNull(), at), "people": F.when(F.size(people) > 0, F.array_join(people, ", "))}
    lines = F.concat_ws("\n", *[F.concat(F.lit(labels[k]), v) for k, v in told.items()])
    return F.coalesce(F.nullif(lines, F.lit("")), F.lit(labels["none"]))


def listing_label(guess: Column, city: Column, country: Column) -> Column:
    return F.coalesce(F.nullif(guess, F.lit("")), F.nullif(F.concat_ws(", ", F.nullif(city, F.lit("")), F.nullif(country, F.lit(""))), F.lit("")))


def label_or_code(label: Column, code: Column, prefix: str = "scene_") -> Column:
    """A label from a joined dimension, else a generated one."""
    return F.coalesce(label, F.concat(F.lit(prefix), code.cast("string")))


def metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular distance."""
    dy = (lat2 - lat1) * F.lit(111320.0)
    dx = (lon2 - lon1) * F.lit(111320.0) * F.cos(F.radians((lat1 + lat2) / F.lit(2.0)))
    return F.sqrt(dx * dx + dy * dy)


def cell(c: Column, size: float = 0.01) -> Column:
    return F.floor(c / F.lit(size)).cast("long")
