"""Text, colour, number and payload functions, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that stand for others, and policies by role.
FONT_WEIGHTS = {"thin": 400, "light": 400, "regular": 400, "normal": 400, "medium": 500, "semibold": 600, "bold": 700, "black": 900}
WEIGHT_STEPS = (400, 500, 600, 700, 900)
ALIGNMENTS = {"left": "left", "start": "left", "center": "center", "centre": "center", "middle": "center", "right": "right", "end": "right"}
ROLE_FACTORS = {"main_title": 0.92, "subtitle": 0.88, "body_text": 0.82, "caption": 0.78}
LINE_SPACINGS = {"main_title": 1.04, "body_text": 1.12, "caption": 1.08}
REGION_WEIGHTS = {"main_title": 3.0, "text": 2.0, "image": 1.5}
STRATEGY_OF_TYPE = {"text": "editable_text", "image": "local_image", "rectangle": "native_shape", "ellipse": "native_shape", "line": "native_line"}
LAYER_OF_TYPE = {"image": 5, "rectangle": 3, "ellipse": 6, "line": 8, "text": 20}


def lookup(value: Column, table: Mapping, default: Column | None = None) -> Column:
    """What a table of constants has for a value."""
    out = None
    for k, v in table.items():
        out = F.when(value == k, F.lit(v)) if out is None else out.when(value == k, F.lit(v))
    return out if default is None else out.otherwise(default)


def fold_case(text: Column) -> Column:
    """Case folding of German sharp s beyond lower()."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def duplicate_key(text: Column) -> Column:
    """A text without white space and case; null below two characters."""
    key = fold_case(F.regexp_replace(text, "(?U)\\s+", ""))
    return F.when(F.length(key) >= 2, key)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def n_cjk(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, "[㐀-鿿]", ""))


def line_width(text: Column, size: Column) -> Column:
    """An estimate of a line's width: Han characters are as wide as high, others 0.56 of it."""
    cjk = n_cjk(text)
    return cjk * size + (F.length(text) - cjk) * size * 0.56


def fit_size(text: Column, size: Column, width: Column, least: float = 0.8) -> Column:
    """size, made smaller by 2 % at a time down to `least` of it until the text fits in width; 5 at least."""
    steps = F.sequence(F.lit(0), F.lit(11))
    tried = F.transform(steps, lambda k: size * F.pow(F.lit(0.98), k.cast("double")))
    fitting = F.filter(tried, lambda s: (line_width(text, s) <= width) | (s <= size * least))
    return F.greatest(F.lit(5.0), F.coalesce(F.get(fitting, F.lit(0)), size * least))


def font_size(text: Column, role: Column, width: Column, height: Column) -> Column:
    """Font size of a line from its box: by height and role, and by width."""
    by_height = height * lookup(role, ROLE_FACTORS, F.lit(0.82))
    by_width = 0.97 * width / F.greatest(line_width(text, F.lit(1.0)), F.lit(1.0))
    return F.least(F.greatest(F.least(by_height, by_width), F.lit(7.0)), F.lit(120.0))


def font_class(text: Column, role: Column) -> Column:
    return F.when(text.rlike("^[0-9\\s.,%+\\-/:]+$"), "monospace").when(role == "main_title", "display").when(role == "caption", "serif").otherwise("sans")


def first_available(wanted: list[str], available: Column, default: str) -> Column:
    return F.coalesce(F.get(F.filter(F.array(*map(F.lit, wanted)), lambda f: F.array_contains(available, f)), F.lit(0)), F.lit(default))


def join_texts(a: Column, b: Column) -> Column:
    """a and b, with a space where both ends are ASCII letters or digits."""
    return F.when(a.rlike("[A-Za-z0-9]$") & b.rlike("^[A-Za-z0-9]"), F.concat(a, F.lit(" "), b)).otherwise(F.concat(a, b))


def rgb(colour: Column, default: tuple[int, int, int]) -> tuple[Column, Column, Column]:
    """Channels of #RRGGBB; the default where it isn't one."""
    good = colour.rlike("^#[0-9A-Fa-f]{6}$")
    return tuple(F.when(good, F.conv(F.substring(colour, 2 + 2 * k, 2), 16, 10).cast("int")).otherwise(F.lit(default[k])) for k in range(3))


def to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02X%02X%02X", r, g, b)


def colour_distance(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0)).cast("double"))


def chebyshev(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return F.greatest(*(F.abs(x - y) for x, y in zip(a, b, strict=True)))


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def readable(colour: tuple[Column, ...], ground: tuple[Column, ...], least: float = 55.0) -> Column:
    """The text colour to use: as it is if its luma stands off the ground's, else near black or white."""
    own, under = luma(*colour), luma(*ground)
    return F.when(F.abs(own - under) >= least, to_hex(*colour)).when(under >= 128, F.lit("#111827")).otherwise(F.lit("#FFFFFF"))


def hue_distance(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.least(d, 180 - d)


def quantised(r: Column, g: Column, b: Column) -> Column:
    """4 bits a channel, rounded, packed to 12."""
    q = [F.least(F.shiftright(x + 8, 4), F.lit(15)) for x in (r, g, b)]
    return F.shiftleft(q[0], 8).bitwiseOR(F.shiftleft(q[1], 4)).bitwiseOR(q[2])


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue 0 to 179, saturation and value 0 to 255, in whole numbers."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = (top - low).cast("double")
    raw = F.when(span == 0, F.lit(0.0)).when(top == r, 60 * (g - b) / span).when(top == g, 120 + 60 * (b - r) / span).otherwise(240 + 60 * (r - g) / span)
    hue = F.pmod(F.floor((raw + F.when(raw < 0, 360.0).otherwise(0.0)) / 2 + 0.5), F.lit(180))
    return hue, F.when(top == 0, F.lit(0)).otherwise(F.floor(255 * span / F.greatest(top, F.lit(1)) + 0.5)), top


def digits(text: Column) -> Column:
    """All digits of a text as one number; null if there are none."""
    return F.expr("1") * F.regexp_replace(text, "[^0-9]", "").try_cast("bigint")


def final_confidence(vision: Column, ocr: Column, own: Column) -> Column:
    mixed = F.when(vision > 0, 0.35 * vision + 0.4 * ocr + 0.25 * own).otherwise(own)
    return F.least(F.greatest(mixed, F.lit(0.0)), F.lit(1.0))


def redact(text: Column, most: int = 1000) -> Column:
    """A message without keys and tokens."""
    out = F.regexp_replace(text, "(?i)(bearer\\s+)[A-Za-z0-9._-]+", "$1***")
    out = F.regexp_replace(out, "(?i)(api[_-]?key\\s*[=:]\\s*)[^\\s,;]+", "$1***")
    out = F.regexp_replace(out, "sk-[A-Za-z0-9]{6,}", "sk-***")
    return F.left(F.regexp_replace(out, "(?i)(password\\s*[=:]\\s*)[^\\s,;]+", "$1***"), F.lit(most))


def mask_key(key: Column) -> Column:
    """The first five and the last three characters; less of short keys."""
    n = F.length(key)
    return F.when(n <= 8, F.concat(F.left(key, F.lit(2)), F.lit("***"))).otherwise(F.concat(F.left(key, F.lit(5)), F.repeat(F.lit("*"), n - 8), F.right(key, F.lit(3))))


def probability(text: Column, default: float = 0.5) -> Column:
    """A number from 0 to 1 of high, medium, low, a percentage or a number up to 100."""
    number = F.regexp_replace(text, "%$", "").try_cast("double")
    share = F.when(text.endswith("%") | (number > 1), number / 100).otherwise(number)
    said = lookup(F.lower(text), {"high": 0.9, "medium": 0.6, "low": 0.3})
    return F.coalesce(said, F.when(share.between(0, 1), share), F.lit(default))


def plan_score(text: Column) -> Column:
    number = text.try_cast("double")
    scaled = F.when((number > 1) & (number <= 3), number / 3).otherwise(number)
    return F.coalesce(lookup(F.lower(text), {"low": 0.2, "medium": 0.5, "high": 0.8}), F.when(scaled.isNotNull(), F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0))))


def font_weight(text: Column) -> Column:
    """A weight by name, or the nearest step, the lower of equals; null if neither."""
    number = text.try_cast("double")
    nearest = F.array_min(F.array(*(F.struct(F.abs(number - w).alias("d"), F.lit(w).alias("w")) for w in WEIGHT_STEPS)))["w"]
    return F.coalesce(lookup(F.lower(text), FONT_WEIGHTS), F.when(number.isNotNull(), nearest))


def alignment(text: Column) -> Column:
    return F.coalesce(lookup(F.lower(text), ALIGNMENTS), F.lit("left"))


def number(text: Column) -> Column:
    """0 for whatever isn't a number."""
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def clamped(text: Column, low: float, high: float, default: float) -> Column:
    n = text.try_cast("double")
    return F.when(n.isNull() | F.isnan(n), F.lit(default)).otherwise(F.least(F.greatest(n, F.lit(low)), F.lit(high)))


def asset_name(src: Column) -> Column:
    """The file name of a source path without its query; null for one that climbs out of its folder."""
    path = F.element_at(F.split(src, "\\?"), 1)
    return F.when(~path.rlike("(^|/)\\.\\.(/|$)"), F.element_at(F.split(path, "/"), -1))


def data_url(content: Column, name: Column) -> Column:
    kind = F.when(F.lower(name).endswith(".png"), "image/png").when(F.lower(name).rlike("\\.jpe?g$"), "image/jpeg").when(F.lower(name).endswith(".webp"), "image/webp").otherwise("application/octet-stream")
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.regexp_replace(F.base64(content), "\\s", ""))


def outer_json(text: Column) -> Column:
    """The outermost object of a reply, without code fences."""
    return F.nullif(F.regexp_extract(text, "(?s)\\{.*\\}", 0), F.lit(""))
