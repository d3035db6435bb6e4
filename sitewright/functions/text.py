"""Names, labels and messages as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewright.functions.geometry import C, _c


def clean_text(value: C) -> Column:
    """Trimmed of all white space; null where blank or the word null."""
    v = F.regexp_replace(_c(value).cast("string"), r"^\s+|\s+$", "")
    return F.when((v != "") & (F.lower(v) != "null"), v)


def slug_ascii(value: C, longest: int = 40) -> Column:
    """A name's letters and digits joined by hyphens, for text that is ASCII already; an error if nothing is left."""
    v = F.regexp_replace(F.regexp_replace(_c(value), r"^\s+|\s+$", ""), r"\s+", "-")
    v = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[^A-Za-z0-9-]", ""), "-{2,}", "-"), "^-|-$", "")
    v = F.regexp_replace(F.substring(v, 1, longest), "-$", "")
    return F.when(v != "", v).otherwise(F.raise_error(F.lit("a name has no usable characters")).cast("string"))


#: Letters that decomposition leaves alone.
LETTERS = {"ß": "ss", "æ": "ae", "Æ": "AE", "ø": "o", "Ø": "O", "œ": "oe", "Œ": "OE", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D"}


@F.pandas_udf(T.StringType())
def to_ascii(value: pd.Series) -> pd.Series:
    """Letters without their marks; what has no ASCII form goes."""
    table = str.maketrans(LETTERS)
    return value.map(lambda v: None if v is None else unicodedata.normalize("NFKD", v.translate(table)).encode("ascii", "ignore").decode())


def slugify(value: C, longest: int = 40) -> Column:
    return slug_ascii(to_ascii(_c(value)), longest)


def fingerprint(numbers: Sequence[C | float], categories: C, types: C) -> Column:
    """Eight hex digits that name a tiling: seven decimals of each number, and the two lists, sorted."""
    parts = [F.format_string("%.7f", _c(n)) for n in numbers]
    lists = [F.array_join(F.array_sort(_c(x)), ",") for x in (categories, types)]
    return F.substring(F.sha2(F.concat_ws("|", *parts, *lists), 256), 1, 8)


def coordinate_stem(box: Column) -> Column:
    return F.format_string("%.4f_%.4f_%.4f_%.4f", box["x0"], box["y0"], box["x1"], box["y1"])


def file_part(name: C) -> Column:
    """A name that is safe in a file's name."""
    return F.regexp_replace(_c(name), "[^A-Za-z0-9_-]", "_")


def version_year(version: C) -> Column:
    return F.when(_c(version).rlike(r"^\d{4}-"), F.substring(_c(version), 1, 4).cast("int"))


def share_text(share: C) -> Column:
    """How much of a site is covered; percent are rounded half up."""
    s = _c(share)
    percent = F.floor(s * 100 + 0.5).cast("string")
    return F.when(s >= 0.995, F.lit("the whole site")).when(s < 0.005, F.lit("under 1% of the site")).otherwise(F.concat(percent, F.lit("% of the site")))


#: Fixed value: the order in which grades are listed before all others.
GRADES = ("I", "II*", "II")


def grades_text(counts: C) -> Column:
    """``map<grade, count>`` as one line: known grades in their order, then the others by name."""
    m = _c(counts)
    known = F.filter(F.array(*[F.lit(g) for g in GRADES]), lambda g: F.map_contains_key(m, g))
    others = F.array_sort(F.filter(F.map_keys(m), lambda k: ~k.isin(*GRADES)))
    say = lambda k: F.concat(k, F.lit(" "), F.element_at(m, k).cast("string"))
    return F.array_join(F.concat(F.transform(known, lambda k: F.concat(F.lit("Grade "), say(k))), F.transform(others, say)), ", ")


def duration_text(seconds: C) -> Column:
    s = _c(seconds)
    return F.when(s < 60, F.concat(F.bround(s, 0).cast("long").cast("string"), F.lit(" s"))).otherwise(F.concat(F.bround(s / 60, 0).cast("long").cast("string"), F.lit(" min")))


def redact(text: C, secret: C) -> Column:
    """A message without an access key: neither the given one nor what follows a key's name in a query string."""
    t = F.regexp_replace(_c(text), r"(?i)(api_?key|token|secret)=[^&\s\"']+", "$1=***")
    s = _c(secret)
    return F.when(F.length(s) > 0, F.replace(t, s, F.lit("***"))).otherwise(t)


def status_kind(status: C) -> Column:
    """Kind of failure that an HTTP status stands for."""
    s = _c(status)
    return F.when(s == 429, "rate_limited").when(s.isin(401, 403), "not_authorised").when(s >= 500, "service_error").otherwise("refused")


def retry_seconds(header: C) -> Column:
    """Seconds of a Retry-After header, at least 0; null where it is no number."""
    seconds = _c(header).try_cast("double")
    return F.when(seconds.isNotNull(), F.greatest(F.lit(0.0), seconds))


def place_names(address: C) -> Column:
    """struct<region, site> of an address map, by the first part that is not blank."""
    a = _c(address)
    first = lambda *keys: F.coalesce(*[F.nullif(F.element_at(a, F.lit(k)), F.lit("")) for k in keys], F.lit(""))
    return F.struct(first("county", "state_district", "state").alias("region"), first("suburb", "town", "village", "city").alias("site"))


def attribution(template: C, date: C) -> Column:
    """A source's statement with its date and year filled in."""
    t = F.replace(_c(template), F.lit("{date}"), _c(date))
    return F.replace(t, F.lit("[year]"), F.substring(_c(date), 1, 4))
