"""Image metadata: region tables, boxes, tiling estimates, modality lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.functions.text import col


def normalised_box(x: Column, y: Column, w: Column, h: Column, height: Column, width: Column) -> Column:
    """xywh pixels -> xyxy in hundredths of the image, truncated."""
    pct = lambda v: (v * 100).cast("int")
    return F.array(pct(x / width), pct(y / height), pct((x + w) / width), pct((y + h) / height))


def box_text(box: Column) -> Column:
    return F.concat(F.lit("{<"), F.array_join(F.transform(box, lambda v: v.cast("string")), "><"), F.lit(">}"))


def region_rows(refs: DataFrame, annotations: DataFrame, images: DataFrame, *, dataset: str, split_by: str,
                split: str = "train") -> DataFrame:
    """refs x annotations x images by key, one row per sentence, id = dataset-split-image-sentence.

    Plain equi-joins: Spark broadcasts a side only where its measured size allows.
    """
    image = F.lpad(F.col("image_id").cast("string"), 12, "0")
    sent_id = F.array_join(F.split("sent", " "), "_")
    return (refs.where(F.col("split") == split).join(annotations.select("ann_id", "bbox"), "ann_id")
            .join(images, "image_id")
            .select("ref_id", "ann_id", "bbox", "height", "width", image.alias("image"),
                    F.posexplode("sentences").alias("sent_no", "sent"))
            .withColumn("id", F.concat(F.lit(f"{dataset}-{split_by}-"), "image", F.lit("-"), sent_id)))


def select_refs(refs: DataFrame, *, images: DataFrame | None = None, categories: DataFrame | None = None,
                ids: DataFrame | None = None, split: str = "") -> DataFrame:
    """References by image, category and ref ids (semi joins) and by split name."""
    out = refs
    for keys, name in ((images, "image_id"), (categories, "category_id"), (ids, "ref_id")):
        if keys is not None:
            out = out.join(keys.select(name), name, "left_semi")
    if not split:
        return out
    s = F.col("split")
    if split in ("testA", "testB", "testC"):
        return out.where(F.contains(s, F.lit(split[-1])))
    if split == "test":
        return out.where(F.contains(s, F.lit("test")))
    if split in ("testAB", "testBC", "testAC", "train", "val"):
        return out.where(s == split)
    raise ValueError(f"no such split {split!r}")


def select_annotations(annotations: DataFrame, *, images: DataFrame | None = None,
                       categories: DataFrame | None = None, refs: DataFrame | None = None) -> DataFrame:
    out = annotations
    for keys, name in ((images, "image_id"), (categories, "category_id"), (refs, "ann_id")):
        if keys is not None:
            out = out.join(keys.select(name), name, "left_semi")
    return out


def instruction_fanout(regions: DataFrame, patterns: tuple[str, ...], *, identify: bool = False) -> DataFrame:
    """Each region with each pattern: adds ``pattern``, ``human`` and ``answer``.

    The patterns are an array literal that is exploded, so the fan-out needs no join.
    """
    box = box_text(F.col("box"))
    asked, answer = (box, F.col("sent")) if identify else (F.col("sent"), box)
    prompts = [F.concat(*_slots(p, asked), F.lit("\n<image>")) for p in patterns]
    return regions.select("*", answer.alias("answer"), F.posexplode(F.array(*prompts)).alias("pattern", "human"))


def _slots(pattern: str, value: Column) -> list[Column]:
    head, tail = pattern.split("{}")
    return [F.lit(head), value, F.lit(tail)]


def eval_ids(regions: DataFrame, image_root: str = "coco/train2017/") -> DataFrame:
    """Evaluation rows: image and id from the last but one part of ``img_id``."""
    image = F.element_at(F.split("img_id", "_"), -2)
    return regions.withColumn("image", F.concat(F.lit(image_root), image, F.lit(".jpg"))).withColumn(
        "id", F.concat(image, F.lit("-"), "sent"))


def ratio_candidates(low: int, high: int) -> list[tuple[int, int]]:
    """Tile grids (i, j) with ``low <= i*j <= high``, by area, then i."""
    grids = [(i, j) for i in range(1, high + 1) for j in range(1, high // i + 1) if low <= i * j]
    return sorted(grids, key=lambda g: (g[0] * g[1], g[0]))


def closest_grid(width: Column | str, height: Column | str, *, low: int = 1, high: int = 12, size: int = 448) -> Column:
    """Tile grid whose aspect ratio is closest; a later tie wins only if the image is large enough for it."""
    w, h = col(width).cast("double"), col(height).cast("double")
    grids = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ratio_candidates(low, high)])
    state = "struct<i:int,j:int,diff:double>"
    start = F.struct(F.lit(1).alias("i"), F.lit(1).alias("j"), F.lit(float("inf")).alias("diff")).cast(state)

    def step(best: Column, g: Column) -> Column:
        diff = F.abs(w / h - g["i"] / g["j"])
        closer = diff < best["diff"]
        tie = (diff == best["diff"]) & (w * h > F.lit(0.5 * size * size) * g["i"] * g["j"])
        return F.when(closer | tie, F.struct(g["i"].alias("i"), g["j"].alias("j"), diff.alias("diff")).cast(state)) \
            .otherwise(best)

    return F.aggregate(grids, start, step)


def vision_tiles(grid: Column, *, thumbnail: bool = True, always: bool = False) -> Column:
    """Tiles of a grid; the thumbnail is added for more than one tile, or ``always`` (estimates)."""
    tiles = grid["i"] * grid["j"]
    if not thumbnail:
        return tiles
    return tiles + 1 if always else F.when(tiles > 1, tiles + 1).otherwise(tiles)


def patch_tokens(size: int = 448, patch: int = 14, downsample: float = 0.5) -> int:
    return int((size // patch) ** 2 * downsample ** 2)


def modality_length(n_text: Column, has_image: Column, n_image: Column) -> Column:
    """Signed length: text + image tokens, or minus the text tokens of a text-only row."""
    return F.when(has_image, n_text + n_image).otherwise(-n_text)
