"""Image assets that a plan cuts out of a page's picture: which boxes, without which texts, and how clear around an ellipse."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.pictures import per_image
from . import relations as R
from .images import to_png
from .inpaint import cleaned

#: A crop with more text than this isn't cleaned; one of a module that is only partly an image is then no asset.
TEXT_SHARE = 0.20
#: How much of an element a box covers that owns it.
OWNED = 0.75
UNTOUCHED = ("logo", "decorative_text")


def snapped_boxes(modules: DataFrame, regions: DataFrame) -> DataFrame:
    """modules (page_id, pos, x1, ...) with the box of the region that they snap to, if there is one, and snapped."""
    found = R.snapped(modules, regions).select("page_id", F.col("a_pos").alias("pos"), F.col("b_pos").alias("region"))
    box = regions.select("page_id", F.col("pos").alias("region"), *(F.col(c).alias(f"r_{c}") for c in ("x1", "y1", "x2", "y2")))
    met = modules.join(found.join(box, ["page_id", "region"]).drop("region"), ["page_id", "pos"], "left").withColumn("snapped", F.col("r_x1").isNotNull())
    return met.withColumns({c: F.coalesce(f"r_{c}", c) for c in ("x1", "y1", "x2", "y2")}).drop("r_x1", "r_y1", "r_x2", "r_y2")


def held(owners: DataFrame, e: DataFrame) -> DataFrame:
    """(page_id, pos, texts, ellipses, z): of each owner the editable texts that its box covers, its covered ellipses, and the highest layer below it.

    A text is editable if it isn't part of a whole badge, has words, is sure enough and isn't a logo or decoration.
    """
    box = ("x1", "y1", "x2", "y2")
    inner = e.select("page_id", *(F.col(c).alias(f"b_{c}") for c in ("pos", *box, "type", "z_index", "text", "role", "confidence")))
    p = owners.select("page_id", "pos", *box).join(inner, "page_id").where((G.coverage(G.box("b_"), G.box()) >= OWNED) & (F.col("pos") != F.col("b_pos")))
    badge = p.where("b_type = 'ellipse'").select("page_id", "pos", *(F.col(f"b_{c}").alias(f"c_{c}") for c in box))
    text = p.where("b_type = 'text'")
    in_badge = text.join(badge, ["page_id", "pos"]).where(G.coverage(G.box("b_"), G.box("c_")) >= 0.85).select("page_id", "pos", "b_pos").distinct()
    editable = text.join(in_badge, ["page_id", "pos", "b_pos"], "left_anti").where((F.trim("b_text") != "") & (F.col("b_confidence") >= 0.5) & ~F.col("b_role").isin(*UNTOUCHED))
    spot = F.struct(F.col("b_pos").alias("pos"), *(F.col(f"b_{c}").alias(c) for c in box))
    texts = editable.groupBy("page_id", "pos").agg(F.sort_array(F.collect_list(spot)).alias("texts"))
    rest = p.groupBy("page_id", "pos").agg(F.max("b_z_index").alias("z"), F.sort_array(F.collect_list(F.when(F.col("b_type") == "ellipse", spot))).alias("ellipses"), F.count_if(~F.col("b_type").isin("text", "ellipse")).alias("others"))
    return owners.select("page_id", "pos").join(texts, ["page_id", "pos"], "left").join(rest, ["page_id", "pos"], "left")


ASSET = [("pos", pa.int32()), *((c, pa.int32()) for c in ("x", "y", "width", "height", "z")), ("texts", pa.int32()), ("text_share", pa.float64()), ("cleaned", pa.bool_()), ("painted", pa.int64()), ("clear", pa.int64()), ("sha256", pa.string())]


def crop_of(image: np.ndarray, owner: dict) -> dict | None:
    """The asset of one owner; None if it isn't one."""
    x1, y1, x2, y2 = max(0, owner["x1"]), max(0, owner["y1"]), min(image.shape[1], owner["x2"]), min(image.shape[0], owner["y2"])
    if x1 >= x2 or y1 >= y2:
        return None
    crop, mask = image[y1:y2, x1:x2].copy(), np.zeros((y2 - y1, x2 - x1), bool)
    for t in owner["texts"] or []:
        a, b = max(0, t["x1"] - x1), min(x2 - x1, t["x2"] - x1)
        c, d = max(0, t["y1"] - y1), min(y2 - y1, t["y2"] - y1)
        if a < b and c < d:
            pad = min(12, max(2, round((b - a) * 0.05)))
            mask[max(0, c - 2) : d + 3, max(0, a - pad) : b + pad + 1] = True
    share = float(mask.mean())
    if share > TEXT_SHARE and owner["strategy"] == "mixed_component":
        return None
    clean, painted = bool(mask.any()) and share <= TEXT_SHARE, 0
    if clean:
        crop, painted = cleaned(crop, mask)
    alpha = np.full(crop.shape[:2], 255, np.uint8)
    if len(owner["ellipses"] or []) == 1 and not owner["others"]:  # what is outside of it is clear
        s = owner["ellipses"][0]
        yy, xx = np.ogrid[y1:y2, x1:x2]
        a, b = max(0.5, (s["x2"] - s["x1"]) / 2), max(0.5, (s["y2"] - s["y1"]) / 2)
        alpha[((xx - (s["x1"] + s["x2"] - 1) / 2) / a) ** 2 + ((yy - (s["y1"] + s["y2"] - 1) / 2) / b) ** 2 > 1] = 0
    digest = hashlib.sha256(to_png(crop) + to_png(alpha)).hexdigest()
    return {"pos": owner["pos"], "x": x1, "y": y1, "width": x2 - x1, "height": y2 - y1, "z": (owner["z"] or 1) + 1, "texts": len(owner["texts"] or []) if share <= TEXT_SHARE else 0, "text_share": round(share, 6), "cleaned": clean, "painted": painted, "clear": int((alpha == 0).sum()), "sha256": digest}


def cut_out(images: DataFrame, owners: DataFrame) -> DataFrame:
    """page_id and ASSET of owners (page_id, pos, strategy, x1, y1, x2, y2, texts, ellipses, others, z), cut from their page's image."""
    of_page = owners.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("pos", "strategy", "x1", "y1", "x2", "y2", "z", "others", "texts", "ellipses"))).alias("owners"))

    def of(image: np.ndarray, owners: Sequence[dict]) -> dict:
        made = [a for a in (crop_of(image, o) for o in owners) if a is not None]
        return {n: [a[n] for a in made] for n, _ in ASSET}

    return per_image(images.join(of_page, "page_id"), ASSET, of)
