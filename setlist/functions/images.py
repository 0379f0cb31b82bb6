"""Choice of one image out of an `images` column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_image(images: Column) -> Column:
    return F.get(images, F.lit(0))["url"]


def image_of_width(images: Column, pixels: int) -> Column:
    """Image of exactly this width; the last one if several have it."""
    return F.try_element_at(F.filter(images, lambda i: i["width"] == pixels), F.lit(-1))["url"]


def widest_image(images: Column, max_size: int | None, min_size: int | None) -> Column:
    """Widest image inside the bounds; among equal widths the greatest url."""
    def fits(image: Column) -> Column:
        ok = image["width"].isNotNull()
        if max_size:
            ok = ok & (image["width"] <= max_size)
        if min_size:
            ok = ok & (image["width"] >= min_size)
        return ok

    sized = F.transform(F.filter(images, fits), lambda i: F.struct(i["width"], i["url"]))
    return F.array_max(sized)["url"]


def pick_image(
    images: Column, pixels: int | None = None, max_size: int | None = None, min_size: int | None = None
) -> Column:
    """Url of one image: by exact width, else by bounds, else the first. A bound of 0 is no bound."""
    if pixels:
        return image_of_width(images, pixels)
    if max_size or min_size:
        return widest_image(images, max_size, min_size)
    return first_image(images)
