"""Small column helpers: text, vectors, buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket_label(value: Column, bounds: Sequence[tuple[int, int | None]], labels: Sequence[str] | None = None) -> Column:
    """Name of the closed range a value falls in; NULL outside all of them."""
    out = None
    for i, (low, high) in enumerate(bounds):
        if labels:
            name = labels[i]
        elif high is None:
            name = f"{low}+"
        else:
            name = str(low) if low == high else f"{low}-{high}"
        hit = value >= low if high is None else value.between(low, high)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def bucket_ordinal(value: Column, bounds: Sequence[tuple[int, int | None]]) -> Column:
    return bucket_label(value, bounds, [f"{i:04d}" for i in range(len(bounds))]).cast("int")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def l2_normalise(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def shout(name: Column) -> Column:
    return F.upper(name)


def squeeze(name: Column) -> Column:
    """Two blanks become one, once through the text."""
    return F.replace(name, F.lit("  "), F.lit(" "))


def only_digits(code: Column) -> Column:
    return F.coalesce(code.rlike("^[0-9]+$"), F.lit(False))


def option_list(names: Column, ids: Column) -> Column:
    """Numbered candidate lines out of two parallel arrays."""
    rows = F.arrays_zip(names.alias("n"), ids.alias("c"))
    lines = F.transform(
        rows,
        lambda r, i: F.concat(
            F.lit("  OPTION "), (i + 1).cast("string"), F.lit(": "), r["n"],
            F.lit(" (category_id: "), r["c"].cast("string"), F.lit(")"),
        ),
    )
    return F.concat_ws("\n", lines)


def tile_name(image_id: Column, x: Column, y: Column) -> Column:
    return F.format_string("tile_%05d_%04d_%04d", image_id, x, y)


def crop_name(image_id: Column, ann_id: Column) -> Column:
    return F.format_string("crop_img%05d_ann%06d", image_id, ann_id)


def catalogue_name(category_id: Column, code: Column) -> Column:
    return F.concat(F.format_string("cat%03d_", category_id), code)


def truncated(text: Column, length: int) -> Column:
    """The first ``length`` characters."""
    return F.left(text, F.lit(length))


BLANKS = " \t\n\r\x0b\x0c"


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def without_fence(text: Column) -> Column:
    """Content of the first fenced block, or the trimmed text."""
    text = strip(text)
    inner = F.coalesce(F.try_element_at(F.split(text, "```"), F.lit(2)), F.lit(""))
    inner = F.when(inner.startswith("json"), F.substring(inner, 5, 2147483647)).otherwise(inner)
    return F.when(text.contains("```"), strip(inner)).otherwise(text)


def grid_values(text: Column) -> Column:
    """``"0.1,0.2"`` to one row per number."""
    return F.explode(F.transform(F.split(text, ","), lambda v: F.trim(v).cast("double")))


SPREAD = 1 << 32


def mixed(value: Column, seed: int) -> Column:
    """A repeatable scatter of whole ids over 0 .. 2**32 - 1: the head of an MD5 sum, which other
    engines compute as well. Neighbouring ids and neighbouring seeds give unrelated numbers.
    """
    text = F.concat(F.lit(f"{seed}:"), value.cast("bigint").cast("string"))
    return F.conv(F.left(F.md5(text.cast("binary")), F.lit(8)), 16, 10).cast("bigint")


def unit(value: Column, seed: int) -> Column:
    """A repeatable number in [0, 1) from a whole id."""
    return mixed(value, seed) / F.lit(float(SPREAD))
