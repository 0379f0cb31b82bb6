import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from setlist.functions import bins, labels
from setlist.functions.images import pick_image
from setlist.functions.text import FOLD_FROM, FOLD_TO, query_words, tokens


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("name, day", [
    ("X 2020-01-02 re 2021-03-04 y", date(2021, 3, 4)),
    ("none", None),
    ("2020-13-45", None),
    ("1999-01-02", None),
    ("a 2020-01-02 b\nc", None),
    ("a 2020-01-02\n", date(2020, 1, 2)),
    (None, None),
])
def test_title_date(spark, name, day):
    assert one(spark, labels.title_date(F.lit(name).cast("string"))) == day


@pytest.mark.parametrize("text, day", [
    ("2021-4-5", date(2021, 4, 5)), ("2021-04-05", date(2021, 4, 5)), ("2021-2-30", None), ("x", None), ("2021-4", None), ("2021-4-5-6", None),
])
def test_path_date(spark, text, day):
    assert one(spark, labels.path_date(F.lit(text))) == day


@pytest.mark.parametrize("key, label", [(-1, "B"), (0, "C"), (11, "B"), (-12, "C"), (12, ""), (-13, ""), (None, ""), (3, "E♭")])
def test_key_label(spark, key, label):
    assert one(spark, labels.key_label(F.lit(key).cast("int"))) == label


@pytest.mark.parametrize("mode, label", [(0, "major"), (1, "minor"), (2, ""), (None, "")])
def test_mode_label(spark, mode, label):
    assert one(spark, labels.mode_label(F.lit(mode).cast("int"))) == label


def test_small_labels(spark):
    assert one(spark, labels.thousands(F.lit(1234567))) == "1,234,567"
    assert one(spark, labels.key_mode_label(F.lit(None).cast("int"), F.lit(None).cast("int"))) == " "
    assert one(spark, labels.threshold_flag(F.lit(None).cast("double"), 0.9)) == "lightgrey"
    assert one(spark, labels.threshold_flag(F.lit(0.9), 0.9)) == "lightgrey"
    assert one(spark, labels.filled(F.lit(""))) is False
    assert one(spark, labels.filled(F.lit(None).cast("string"))) is False
    assert one(spark, labels.album_url(F.lit("x"))).endswith("/album/x")


@pytest.mark.parametrize("bounds, url", [
    (dict(pixels=640), "b"), (dict(pixels=300), None), (dict(max_size=640, min_size=100), "b"), (dict(min_size=9000), None),
    (dict(), "a"), (dict(max_size=0, min_size=0), "a"), (dict(max_size=100), "c"), (dict(pixels=300, min_size=1), None),
])
def test_pick_image(spark, bounds, url):
    images = F.from_json(
        F.lit('[{"url":"a","width":640},{"url":"b","width":640},{"url":"c","width":64}]'), "array<struct<url:string,width:int,height:int>>"
    )
    assert one(spark, pick_image(images, **bounds)) == url


def test_pick_image_of_none(spark):
    none = F.lit(None).cast("array<struct<url:string,width:int,height:int>>")
    empty = F.array().cast("array<struct<url:string,width:int,height:int>>")
    for images in (none, empty):
        for bounds in (dict(), dict(pixels=1), dict(min_size=1)):
            assert one(spark, pick_image(images, **bounds)) is None


@pytest.mark.parametrize("text, toks", [
    ("Rock-n-Roll Ghost", ["rock", "n", "roll", "ghost"]),
    ("BJÖRK Björk", ["bjork", "bjork"]),
    ("İstanbul éclair éclair", ["istanbul", "eclair", "eclair"]),
    ("Straße Ærø ﬁn Łódź Øre ệt", ["straße", "ærø", "ﬁn", "łodz", "øre", "ệt"]),
    ("½ x² _a_b's", ["½", "x²", "a", "b", "s"]),
    ("!", []), ("", []),
])
def test_tokens(spark, text, toks):
    assert one(spark, tokens(F.lit(text))) == toks


def test_fold_table_is_one_to_one():
    assert len(FOLD_FROM) == len(FOLD_TO) == len(set(FOLD_FROM))


def test_query_words(spark):
    assert one(spark, query_words(F.lit('  a"b  c\td '))) == ["a", "b", "c", "d"]


def _step(low, high):
    """The binning rule by trial: the smallest of 1, 2, 5 x 10^k that needs at most ten bins."""
    span = high - low if high > low else (abs(low) or 1.0)
    return min(s for k in range(-8, 9) for s in (10.0**k, 2 * 10.0**k, 5 * 10.0**k) if span / s <= 10 + 1e-9)


@pytest.mark.parametrize("low, high", [(0, 1), (0, 0.999), (0.2, 0.97), (-60, 0), (-7.3, 12.9), (3, 3.05), (0, 1234), (5, 5), (0.001, 0.0042)])
def test_bin_step(spark, low, high):
    got = one(spark, bins.bin_step(F.lit(float(low)), F.lit(float(high))))
    assert math.isclose(got, _step(low, high), rel_tol=1e-9)


def test_bin_number_puts_the_top_in_the_last_bin(spark):
    args = [F.lit(x) for x in (0.0, 1.0, 0.1)]
    assert [one(spark, bins.bin_number(F.lit(v), *args)) for v in (0.0, 0.05, 0.3, 0.95, 1.0)] == [0, 0, 3, 9, 9]
