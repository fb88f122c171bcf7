"""What a user may plug in: recognisers, painters, layout and segment finders, vision models, text cleaners, by name.

A provider is a class that says whether it can run, and whose objects turn a batch of rows into a batch of rows. What it
returns and whether it is available are asked of the class; an object is made once in each task, on the executor, so a
model is loaded there and never shipped. Rows go through in Arrow batches. Beside stand-ins for models there are engines
without one: a painter, a layout finder and a segment finder over whole images.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import ClassVar, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..operators import edges, inpaint, pieces
from .pictures import image_of


class Provider(Protocol):
    """name: what a registry knows it by; schema: what run() returns; one that isn't available is passed over."""

    name: ClassVar[str]
    schema: ClassVar[str]

    @classmethod
    def available(cls) -> bool: ...

    def run(self, rows: pd.DataFrame) -> pd.DataFrame: ...


#: Bytes, about, that a provider gets at a time, and for how many of them a letter counts: words of it are objects that take tens of bytes a letter.
PART_BYTES, LETTER = 4 << 20, 16


def parts(rows: pd.DataFrame, most: int = PART_BYTES) -> Iterator[pd.DataFrame]:
    """rows in parts of about so many bytes of texts and pixels, for what is made of them can be many times as large; a larger row is a part of its own."""
    size = sum((rows[c].map(lambda v: LETTER * len(v) if isinstance(v, str) else len(v) if isinstance(v, bytes) else 0) for c in rows.columns if rows[c].dtype == object and c != "data"), pd.Series(64, rows.index))
    if {"data", "shapes"} & set(rows.columns):
        size = size + 3 * rows["width"].astype("int64") * rows["height"]
    begin = held = 0
    for i, n in enumerate(size.tolist()):
        if held and held + n > most:
            yield rows.iloc[begin:i].reset_index(drop=True)
            begin, held = i, 0
        held += n
    if held:
        yield rows.iloc[begin:].reset_index(drop=True)


class Registry:
    """Providers of one kind, in the order in which they are tried."""

    def __init__(self, kind: str) -> None:
        self.kind = kind
        self.made: dict[str, Callable[[], Provider]] = {}

    def add(self, name: str, make: Callable[[], Provider]) -> None:
        """make: a class or a function without arguments, which a test or a user may put in another's place."""
        self.made[name] = make

    def take(self, names: list[str]) -> tuple[str, Callable[[], Provider]]:
        """The first of names that is there and available. Classes are asked without an object being made; of another factory one is made and asked."""
        for name in names:
            if (make := self.made.get(name)) and (make if hasattr(make, "available") else make()).available():
                return name, make
        raise LookupError(f"no {self.kind} among {names} is ready")

    def apply(self, df: DataFrame, names: list[str]) -> DataFrame:
        """df through the first provider that is ready."""
        _, make = self.take(names)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            provider = make()
            for rows in batches:
                yield from map(provider.run, parts(rows))

        return df.mapInPandas(run, (make if hasattr(make, "schema") else make()).schema)


OCR, INPAINTING, VISION, LAYOUT, SEGMENTS, CLEANERS = (Registry(k) for k in ("recogniser", "painter", "vision model", "layout finder", "segment finder", "text cleaner"))


class _Ready:
    @classmethod
    def available(cls) -> bool:
        return True


class Missing:
    """Stands for an engine that isn't installed."""

    name, schema = "missing", "page_id bigint"

    @classmethod
    def available(cls) -> bool:
        return False

    def run(self, rows: pd.DataFrame) -> pd.DataFrame:
        raise RuntimeError("not installed")


class WordBoxes(_Ready):
    """Recognises the words that a row already has, a box for each by its place."""

    name, schema = "words", "page_id bigint, pos int, nth int, word string, x1 double, confidence double"

    def run(self, rows: pd.DataFrame) -> pd.DataFrame:
        words = pc.split_pattern(pa.array(rows["text"], pa.large_string()), " ")
        word, row = pc.list_flatten(words), pc.list_parent_indices(words).to_numpy()
        nth = np.arange(len(word)) - words.offsets.to_numpy()[row]
        some = pc.not_equal(word, "").to_numpy(False)
        row, nth = row[some], nth[some]
        return pd.DataFrame({
            "page_id": rows["page_id"].to_numpy()[row], "pos": rows["pos"].to_numpy()[row].astype("int32"), "nth": nth.astype("int32"),
            "word": word.filter(pa.array(some)).to_pandas(), "x1": rows["x1"].to_numpy(float)[row] + 9.0 * nth, "confidence": 0.8,
        })


class MeanPaint(_Ready):
    """Fills masked pixels with the row's mean."""

    name, schema = "mean", "page_id bigint, v double"

    def run(self, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"page_id": rows["page_id"], "v": rows["total"] / rows["n"]})


class TypeVision(_Ready):
    """Says what an element is by its own type."""

    name, schema = "types", "page_id bigint, pos int, label string, confidence double"

    def run(self, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"page_id": rows["page_id"], "pos": rows["pos"], "label": "a " + rows["type"], "confidence": rows["confidence"].where(rows["type"] != "line", 0.5)})


class Halves(_Ready):
    """Regions: the left and the right half of a page, by an element's middle."""

    name, schema = "halves", "page_id bigint, pos int, region string"

    def run(self, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"page_id": rows["page_id"], "pos": rows["pos"], "region": ((rows["x1"] + rows["x2"]) / 2 < 480).map({True: "left", False: "right"})})


class Boxes(_Ready):
    """Segments: the boxes themselves, with their area."""

    name, schema = "boxes", "page_id bigint, pos int, area double"

    def run(self, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"page_id": rows["page_id"], "pos": rows["pos"], "area": (rows["x2"] - rows["x1"]) * (rows["y2"] - rows["y1"])})


class Spaces(_Ready):
    """Cleans a text's white space."""

    name, schema = "spaces", "page_id bigint, pos int, text string"

    def run(self, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"page_id": rows["page_id"], "pos": rows["pos"], "text": rows["text"].str.strip().str.upper()})


def _image(row: pd.Series) -> np.ndarray:
    return image_of(row["shapes"] if row.get("data") is None else row["data"], row["width"], row["height"])


class Marching(_Ready):
    """Paints the boxes of each image: flat surroundings by their median, others from the rim inwards. Returns the image."""

    name, schema = "marching", "page_id bigint, width int, height int, data binary, painted bigint"

    def run(self, rows: pd.DataFrame) -> pd.DataFrame:
        images, masks = [], []
        for _, r in rows.iterrows():
            images.append(_image(r))
            masks.append(np.zeros(images[-1].shape[:2], bool))
            for b in r["boxes"] if r["boxes"] is not None else []:
                masks[-1][max(0, b["y1"]) : max(0, b["y2"]), max(0, b["x1"]) : max(0, b["x2"])] = True
        made = inpaint.cleaned_all(images, masks)
        out = {"data": [image.tobytes() for image, _ in made], "painted": [n for _, n in made]}
        return rows[["page_id", "width", "height"]].assign(**out)


class Contours(_Ready):
    """Regions of a page: the boxes of its outermost contours that are 1.5 % of it and more, the largest first."""

    name, schema = "contours", "page_id bigint, nth int, role string, x int, y int, width int, height int"

    def run(self, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, r in rows.iterrows():
            image = _image(r)
            boxes = []
            for points, outermost in edges.borders(edges.canny(image, 60, 160)):
                (x1, y1), (x2, y2) = np.min(points, axis=0).tolist(), np.max(points, axis=0).tolist()
                w, h = x2 - x1 + 1, y2 - y1 + 1
                if outermost and w * h >= r["width"] * r["height"] * 0.015 and w >= 24 and h >= 18:
                    boxes.append((w * h, x1, y1, w, h))
            for k, (_, x, y, w, h) in enumerate(sorted(boxes, key=lambda b: (-b[0], b[2], b[1]))[:40]):
                out.append((r["page_id"], k + 1, "wide_region" if w / h > 2.8 else "tall_region" if w / h < 0.35 else "content_region", x, y, w, h))
        return pd.DataFrame(out, columns=["page_id", "nth", "role", "x", "y", "width", "height"]).astype({c: "int32" for c in ("nth", "x", "y", "width", "height")})


class Pieces(_Ready):
    """Segments of a page: its pieces off the ground's colour, with the first of each one's group."""

    name, schema = "pieces", "page_id bigint, piece int, x1 int, y1 int, x2 int, y2 int, pixels bigint, root int"

    def run(self, rows: pd.DataFrame) -> pd.DataFrame:
        columns = ["piece", "x1", "y1", "x2", "y2", "pixels", "root"]
        parts = [pd.DataFrame({"page_id": r["page_id"], **{c: v for c, v in pieces.pieces_of(_image(r), np.zeros((r["height"], r["width"]), bool)).items() if c in columns}}) for _, r in rows.iterrows()]
        out = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=["page_id", *columns])
        return out[["page_id", *columns]].astype({c: "int64" if c in ("pixels", "page_id") else "int32" for c in out.columns if c in ("page_id", *columns)})


for _registry, _class in ((OCR, WordBoxes), (INPAINTING, MeanPaint), (VISION, TypeVision), (LAYOUT, Halves), (SEGMENTS, Boxes), (CLEANERS, Spaces)):
    _registry.add("missing", Missing)
    _registry.add(_class.name, _class)
for _registry, _class in ((INPAINTING, Marching), (LAYOUT, Contours), (SEGMENTS, Pieces)):
    _registry.add(_class.name, _class)
