"""Cutting images into overlapping square tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlore.functions import geometry as G
from boxlore.functions.scalars import mixed, tile_name
from boxlore.operators.ranking import ranked

EMPTY_SHARE = 0.20


def _origins(side: Column, tile: int, stride: int, low: Column | None = None, high: Column | None = None) -> Column:
    """Tile origins along one side: the grid and the tile flush with the far edge.

    ``low`` and ``high`` keep only tiles that reach into that range.
    """
    last = F.floor((side - tile) / F.lit(float(stride))).cast("int")
    first = F.lit(0)
    if low is not None:
        first = F.greatest(first, F.floor((low - tile) / F.lit(float(stride))).cast("int"))
        last = F.least(last, F.floor(high / F.lit(float(stride))).cast("int"))
    grid = F.when(first <= last, F.transform(F.sequence(F.least(first, last), last), lambda k: k * stride)).otherwise(
        F.array().cast("array<int>"))
    return F.array_distinct(F.concat(grid, F.array((side - tile).cast("int"))))


def _too_small(tile: int) -> Column:
    return (F.col("width") < tile) | (F.col("height") < tile)


def tile_grid(images: DataFrame, tile: int, stride: int) -> DataFrame:
    """Tile origins of every image.

    An image with a side shorter than the tile gets the single tile (0, 0), also when its other
    side is longer; the uncovered rest is part of the definition.
    """
    one = F.array(F.lit(0))
    axis = lambda side: F.when(_too_small(tile), one).otherwise(_origins(F.col(side), tile, stride))
    # A row becomes many; few small rows would all be given to one task.
    dealt = images.repartition(int(images.sparkSession.conf.get("spark.sql.shuffle.partitions")), "image_id")
    return dealt.withColumn("tile_x", F.explode(axis("width"))).withColumn("tile_y", F.explode(axis("height")))


def tile_annotations(anns: DataFrame, images: DataFrame, tile: int, stride: int, min_share: float = 0.5, min_side: float = 10) -> DataFrame:
    """Boxes of every tile in tile coordinates.

    A box computes which tiles it reaches, so tiles and boxes of an image are never paired up:
    the work is the number of results, also for an image with very many boxes.
    """
    one = F.array(F.lit(0))
    b = G.box_of()
    rows = anns.join(images.select("image_id", "width", "height"), "image_id")
    rows = rows.withColumn("tile_x", F.explode(F.when(_too_small(tile), one).otherwise(_origins(F.col("width"), tile, stride, b.x, b.x2))))
    rows = rows.withColumn("tile_y", F.explode(F.when(_too_small(tile), one).otherwise(_origins(F.col("height"), tile, stride, b.y, b.y2))))
    local, kept = G.clip_to_tile(b, F.col("tile_x"), F.col("tile_y"), tile, min_share, min_side)
    return rows.where(kept).select("image_id", "tile_x", "tile_y", "ann_id", "category_id", *G.named(local))


def tile_counts(anns: DataFrame, images: DataFrame, tile: int, stride: int) -> DataFrame:
    """All tiles with the number of boxes they hold."""
    held = tile_annotations(anns, images, tile, stride).groupBy("image_id", "tile_x", "tile_y").agg(F.count("*").alias("n"))
    # Tiles compress so well that partitions chosen by their bytes would hold any number of them.
    parts = int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = tile_grid(images, tile, stride).select("image_id", "file_name", "tile_x", "tile_y").repartition(parts, "image_id", "tile_x", "tile_y")
    return every.join(held, ["image_id", "tile_x", "tile_y"], "left").select(
        tile_name(F.col("image_id"), F.col("tile_x"), F.col("tile_y")).alias("tile"), "image_id", "file_name", "tile_x", "tile_y",
        F.lit(tile).alias("tile_size"), F.coalesce("n", F.lit(0)).alias("n_annotations"))


def empty_tile_cap(tiles: DataFrame, share: float = EMPTY_SHARE, seed: int = 42) -> DataFrame:
    """A repeatable choice of empty tiles, at most ``share`` of the number of filled ones."""
    allowed = tiles.agg(F.floor(F.count_if(F.col("n_annotations") > 0) * F.lit(share))).scalar()
    empty = tiles.where(F.col("n_annotations") == 0)
    spread = mixed(F.col("image_id") * 10007 + F.col("tile_x") * 101 + F.col("tile_y"), seed)
    order = [F.col("_o").asc(), F.col("image_id").asc(), F.col("tile_x").asc(), F.col("tile_y").asc()]
    return ranked(empty.withColumn("_o", spread), [], order, rank="_rank").where(F.col("_rank") <= allowed).drop("_rank", "_o")


def tile_dataset(anns: DataFrame, images: DataFrame, split: DataFrame, tile: int, stride: int, seed: int = 42) -> DataFrame:
    """Kept tiles of the training images: every filled one and the capped empty ones."""
    train = images.join(split.where(F.col("split") == "train"), "image_id", "left_semi")
    tiles = tile_counts(anns.join(train.select("image_id"), "image_id", "left_semi"), train, tile, stride)
    return tiles.where(F.col("n_annotations") > 0).unionByName(empty_tile_cap(tiles, seed=seed))
