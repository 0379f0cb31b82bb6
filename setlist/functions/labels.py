"""Labels, dates and display strings as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name of each pitch class, by key number 0..11.
PITCH_CLASSES = ["C", "C♯", "D", "E♭", "E", "F", "F♯", "G", "A♭", "A", "B♭", "B"]
# Mode number to label.
MODE_NAMES = {0: "major", 1: "minor"}
# A date inside a playlist title, the layout of a date in a page address, an album's address.
TITLE_DATE = r"(?d)^.*(20\d{2}-\d{2}-\d{2}).*$"
PATH_DATE = "yyyy-M-d"
ALBUM_URL = "https://open.spotify.com/album/"


def title_date(name: Column) -> Column:
    """Date written in a title; the last one if there are several, null if none or no real date."""
    return F.try_to_date(F.regexp_extract(name, TITLE_DATE, 1), "yyyy-MM-dd")


def path_date(text: Column) -> Column:
    """Date from an address part such as `2021-4-5`; null if it is not one."""
    return F.try_to_date(text, PATH_DATE)


def date_parts(day: Column) -> list[Column]:
    """`date` as zero-padded text plus year, month and day numbers."""
    return [
        F.date_format(day, "yyyy-MM-dd").alias("date"),
        F.year(day).alias("year"),
        F.month(day).alias("month"),
        F.dayofmonth(day).alias("day"),
    ]


def key_label(key: Column) -> Column:
    """Pitch name of a key number; negative numbers count back from the end, others give ''."""
    n = len(PITCH_CLASSES)
    names = F.array(*map(F.lit, PITCH_CLASSES))
    return F.when(key.between(-n, n - 1), F.get(names, F.pmod(key, F.lit(n)))).otherwise("")


def mode_label(mode: Column) -> Column:
    label = F.lit("")
    for number, name in MODE_NAMES.items():
        label = F.when(mode == number, name).otherwise(label)
    return label


def key_mode_label(key: Column, mode: Column) -> Column:
    return F.concat(key_label(key), F.lit(" "), mode_label(mode))


def album_url(spotify_id: Column) -> Column:
    return F.concat(F.lit(ALBUM_URL), spotify_id)


def thousands(number: Column) -> Column:
    return F.format_number(number, 0)


def filled(text: Column) -> Column:
    """True where there is some text: neither null nor empty."""
    return F.coalesce(text != "", F.lit(False))


def entity_label(name: Column, kind: str) -> Column:
    return F.concat(name, F.lit(f" ({kind})"))


def track_label(name: Column, artists: Column) -> Column:
    return F.concat(name, F.lit(" by "), artists)


def threshold_flag(value: Column, limit: float, above: str = "red", otherwise: str = "lightgrey") -> Column:
    """`above` where the value exceeds the limit, else `otherwise`, also for null."""
    return F.when(value > limit, above).otherwise(otherwise)
