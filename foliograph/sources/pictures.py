"""Whole images, one a row: page_id, width, height, and data - a byte for each pixel of a grey image, three for a colour one - or shapes to draw it from."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .views import elements, table

#: Vectors of an embedding that make one image, a row of pixels each.
ROWS = 64
GROUND = 255


def spread(df: DataFrame, key: str) -> DataFrame:
    """df by key in so many partitions that costly work on few, small rows is shared out; Spark sizes partitions by bytes else."""
    session = df.sparkSession
    return df.repartition(max(4 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions"))), key)


def whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that come ordered by page_id, as tables of whole pages: as many as a batch holds, and the page that went on from the batch before."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("page_id").cast(pa.int64()).fill_null(-(1 << 63)).to_numpy()
        ended = int(np.searchsorted(ids, ids[-1]))
        if held and (ended or held[-1].column("page_id")[0] != batch.column("page_id")[0]):
            held.append(batch.slice(0, ended))
            yield pa.Table.from_batches(held)
            held = []
        elif ended:
            yield pa.Table.from_batches([batch.slice(0, ended)])
        held.append(batch.slice(ended))
    if held:
        yield pa.Table.from_batches(held)


def mosaics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey images of the embeddings: ROWS vectors in a row are the rows of an image; the last image may have fewer."""
    grey = F.transform("embedding", lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((e.cast("double") + 1) * 127.5).cast("int"))))
    rows = table(spark, sf_dir, "embeddings").select(F.expr(f"vec_id div {ROWS}").alias("page_id"), F.col("vec_id").alias("at"), grey.alias("v"))
    one = spread(rows, "page_id").groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("r"))
    data = F.unhex(F.array_join(F.transform(F.flatten("r.v"), lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    return one.select("page_id", F.size(F.element_at("r.v", 1)).alias("width"), F.size("r").alias("height"), data.alias("data"))


#: Their pixels for DuckDB, as the common table expression mo.
MOSAICS = f"""mo AS (SELECT vec_id // {ROWS} AS page_id, CAST(p AS INT) AS px, CAST(vec_id % {ROWS} AS INT) AS py, least(255, greatest(0, CAST(floor((CAST(e AS DOUBLE) + 1) * 127.5) AS INT))) AS v
  FROM (SELECT vec_id, unnest(range(0, len(embedding))) AS p, unnest(embedding) AS e FROM embeddings))"""


#: Ellipses that a task remembers: so many, and of so many pixels at most.
ELLIPSES, ELLIPSE_PIXELS = 4096, 8192


def _round(width: int, height: int) -> np.ndarray:
    yy, xx = np.ogrid[:height, :width]
    a, b = max(0.5, width / 2), max(0.5, height / 2)
    return ((xx - (width - 1) / 2) / a) ** 2 + ((yy - (height - 1) / 2) / b) ** 2 <= 1


_remembered = functools.lru_cache(ELLIPSES)(_round)


def ellipse(x1: int, y1: int, x2: int, y2: int, width: int, height: int) -> np.ndarray:
    """The pixels of the ellipse in a box, of that part of the box that lies on an image of a size."""
    whole = (_remembered if (x2 - x1) * (y2 - y1) <= ELLIPSE_PIXELS else _round)(x2 - x1, y2 - y1)
    return whole[max(0, -y1) : height - y1, max(0, -x1) : width - x1]


def drawn(width: int, height: int, shapes: Sequence[dict]) -> np.ndarray:
    """Filled boxes and ellipses, one over the other, on a light ground. Each channel is a stretch of its own in memory, which numpy goes through much faster."""
    planes = np.full((3, height, width), GROUND, np.uint8)
    for s in shapes:
        x1, y1, x2, y2 = max(0, s["x1"]), max(0, s["y1"]), min(width, s["x2"]), min(height, s["y2"])
        if x1 >= x2 or y1 >= y2:
            continue
        rgb = s["rgb"] >> 16 & 255, s["rgb"] >> 8 & 255, s["rgb"] & 255
        inside: bool | np.ndarray = True
        if s["type"] == "ellipse":
            inside = ellipse(s["x1"], s["y1"], s["x2"], s["y2"], width, height)
        for plane, level in zip(planes, rgb, strict=True):
            if inside is True:
                plane[y1:y2, x1:x2] = level
            else:
                np.copyto(plane[y1:y2, x1:x2], level, where=inside)
    return planes.transpose(1, 2, 0)


def placed(spark: SparkSession, sf_dir: str, width: int = 480, height: int = 270, e: DataFrame | None = None) -> DataFrame:
    """elements, or e, in pixels of their picture, with a colour. Every second ellipse is a circle."""
    e = elements(spark, sf_dir) if e is None else e
    at = {c: (F.col(c) * (width if c[0] == "x" else height) / (960 if c[0] == "x" else 540)).cast("int") for c in ("x1", "y1", "x2", "y2")}
    round_ = F.least(at["x2"] - at["x1"], F.lit(36)) + 26
    circle = (F.col("type") == "ellipse") & (F.col("element_id") % 2 == 0)
    x2, y2 = F.when(circle, at["x1"] + round_).otherwise(at["x2"]), F.when(circle, at["y1"] + round_).otherwise(at["y2"])
    rgb = (F.col("element_id") * 67 % 200) * 65536 + (F.col("element_id") * 131 % 200) * 256 + F.col("element_id") * 193 % 200
    return e.withColumns({"x1": at["x1"], "y1": at["y1"], "x2": x2, "y2": y2, "rgb": rgb.cast("int")})


def rows_where(shown: Column | str, *fields: Column | str) -> Column:
    """The fields of a page's rows for which shown is true, as an array in their order."""
    return F.sort_array(F.collect_list(F.when(F.expr(shown) if isinstance(shown, str) else shown, F.struct(*fields))))


def layers(shown: Column) -> Column:
    """What is to be drawn of a page's placed elements, from the lowest layer up."""
    return rows_where(shown, "z_index", "pos", "type", "x1", "y1", "x2", "y2", "rgb")


def sketched(e: DataFrame, shown: Column, width: int = 480, height: int = 270, **more: Column) -> DataFrame:
    """Colour images of placed elements as the shapes that they are drawn from, and further aggregates of a page's rows; a page without shapes is blank.

    A picture is drawn by the task that looks at it. Pixels are never shuffled or joined: of so few colours they are
    compressed to so little that Spark would take whole tables of them for small ones, and broadcast those.
    """
    pages = spread(e, "page_id").groupBy("page_id").agg(layers(shown).alias("shapes"), *(c.alias(n) for n, c in more.items()))
    return pages.select("page_id", F.lit(width).alias("width"), F.lit(height).alias("height"), "shapes", *more)


def pictures(spark: SparkSession, sf_dir: str, width: int = 480, height: int = 270, **more: Column) -> DataFrame:
    """Colour images of the pages: what is visible."""
    return sketched(placed(spark, sf_dir, width, height), F.col("visible"), width, height, **more)


def image_of(given: bytes | np.ndarray | Sequence[dict], width: int, height: int) -> np.ndarray:
    """An image of its pixels' bytes, or drawn from shapes."""
    if not isinstance(given, (bytes, memoryview, pa.Buffer)):
        return drawn(width, height, given)
    flat = np.frombuffer(given, np.uint8)
    return flat.reshape(height, width, 3) if len(flat) == 3 * width * height else flat.reshape(height, width)


@functools.cache
def letters(pen: int, height: int) -> np.ndarray:
    """Where the ink is, (kind, row, column), of the eight kinds of letters, and of a space: upright bars, level bars and gaps by three bits of a letter's code."""
    step = 5 * pen + 6
    ink = np.zeros((9, height, step), bool)
    for kind in range(8):
        ink[kind, 4 : height - 4, :pen] = True  # a stem
        for there, y in ((kind & 1, 4), (True, height // 2 - pen // 2), (kind & 2, height - 4 - pen)):
            if there:
                ink[kind, y : y + pen, : step - 4] = True
        if kind & 4:
            ink[kind, 4 : height - 4, step - 4 - pen : step - 4] = True
    return ink


def lettered(text: str, pen: int, height: int = 36, ink: tuple[int, int, int] = (30, 30, 60)) -> np.ndarray:
    """A line of text as upright bars, level bars and gaps by each letter's code, drawn with a pen of so many pixels. Each channel is a stretch of its own in memory."""
    step = 5 * pen + 6
    planes = np.full((3, height, max(1, step * len(text) + 8)), GROUND, np.uint8)
    if text:
        code = np.fromiter(map(ord, text), np.int32, len(text))
        kind = code & 1 | code >> 1 & 2 | code >> 1 & 4
        kind[[k for k, c in enumerate(text) if c.isspace()]] = 8
        drawn_ = letters(pen, height).transpose(1, 0, 2)[:, kind].reshape(height, -1)
        for plane, level in zip(planes, ink, strict=True):
            plane[:, 4:-4] -= drawn_ * np.uint8(GROUND - level)
    return planes.transpose(1, 2, 0)


def plain(column: pa.Array) -> list:
    """A column as Python values; structs in lists go field by field, which takes a third of the time."""
    if not (pa.types.is_list(column.type) and pa.types.is_struct(column.type.value_type)) or column.values.null_count:
        return column.to_pylist()
    rows = column.flatten()
    names = [f.name for f in rows.type]
    made = [dict(zip(names, v, strict=True)) for v in zip(*(rows.field(k).to_pylist() for k in range(len(names))), strict=True)]
    ends = np.cumsum([n or 0 for n in column.value_lengths().to_pylist()]).tolist()
    return [made[a:b] if some else None for a, b, some in zip([0, *ends], ends, column.is_valid().to_pylist(), strict=False)]


#: Rows that a task makes before it hands them on: a batch for each image would cost more than its rows.
HELD = 4096


def per_images(images: DataFrame, fields: Sequence[tuple[str, pa.DataType]], of: Callable[..., Sequence[dict[str, Sequence]]], most: int = 32) -> DataFrame:
    """page_id and fields: the rows that of(images, **lists of further columns) makes of each image. A task holds so many images at a time as `most` says."""
    schema = pa.schema([("page_id", pa.int64()), *fields])
    more = [c for c in images.columns if c not in ("page_id", "width", "height", "data", "shapes")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                some = batch.slice(begin, 64)
                column = {n: some.column(i) if n == "data" else plain(some.column(i)) for i, n in enumerate(some.schema.names)}
                for first in range(0, some.num_rows, most):
                    which = range(first, min(first + most, some.num_rows))
                    drawn_ = []
                    for k in which:
                        pixels = column["data"][k] if "data" in column else None
                        drawn_.append(image_of(column["shapes"][k] if pixels is None or not pixels.is_valid else pixels.as_buffer(), column["width"][k], column["height"][k]))
                    for k, made in zip(which, of(drawn_, **{n: [column[n][k] for k in which] for n in more}), strict=True):
                        n = len(made[fields[0][0]])
                        held.append(pa.RecordBatch.from_arrays([pa.array([column["page_id"][k]] * n, pa.int64()), *(made[c] if isinstance(made[c], pa.Array) else pa.array(made[c], kind) for c, kind in fields)], schema=schema))
                        rows += n
                    if rows >= HELD:
                        yield pa.concat_batches(held)
                        held, rows = [], 0
        if held:
            yield pa.concat_batches(held)

    return images.mapInArrow(run, from_arrow_schema(schema))


def per_image(images: DataFrame, fields: Sequence[tuple[str, pa.DataType]], of: Callable[..., dict[str, Sequence]]) -> DataFrame:
    """page_id and fields: the rows that of(image, **further columns) makes of each image. An image is what a task holds at a time."""
    return per_images(images, fields, lambda one, **more: [of(one[0], **{n: v[0] for n, v in more.items()})], most=1)


def grey(image: np.ndarray) -> np.ndarray:
    """Luma of a colour image in whole numbers; a grey image is its own."""
    if image.ndim == 2:
        return image
    luma = np.multiply(image[:, :, 0], 4899, dtype=np.int32)
    for k, share in ((1, 9617), (2, 1868)):
        luma += np.multiply(image[:, :, k], share, dtype=np.int32)
    luma += 8192
    luma >>= 14
    return luma.astype(np.uint8)
