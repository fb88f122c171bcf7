"""Main text of web pages: parser events to lines, tag ratios, smoothing, clustering."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._arrow import with_struct

# HTML's elements by how they are treated.
BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
FORMAT = frozenset("b i em strong span u s small sub sup code mark abbr cite q var kbd".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg math head title iframe object canvas audio video select textarea button".split())
FRAME = frozenset("nav aside footer form menu dialog fieldset".split())
ENDS_P = BLOCK - {"br", "button", "caption", "head", "html", "body", "option", "optgroup"}
SAME = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
# Words of class and id that mark what isn't the article.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar side aside widget widgets cookie cookies consent gdpr notice notices notification alert popup modal overlay comment comments commentlist disqus respond replies reply discussion share sharing social related recommended recommendations newsletter subscribe subscription signup login search form toolbar pagination pager skip copyright legal disclaimer tags".split())
#: Of these, what also holds of an article element: it is then a comment or a teaser; and what doesn't hold inside an article.
ARTICLE_MARKS = MARKS & frozenset("ad ads advert advertisement sponsor sponsored promo sidebar widget comment comments reply replies related recommended".split())
OUTER_MARKS = MARKS & frozenset("header masthead tags nav notice notices".split())
#: Marks that a word of OWN next to them takes back: a post's header, the text of a legal page.
WEAK_MARKS = MARKS & frozenset("header masthead tags notice notices legal copyright disclaimer search form".split())
OWN = frozenset("article post entry content story body text main title headline".split())
UNLESS = frozenset(("has", "with", "no"))
MAIN = frozenset(("article", "main"))
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
# Lines that head what follows an article.
AFTER = re.compile(r"(?:\d+\s+)?(?:comments?|replies|responses)(?:\s*\(\d+\))?|(?:leave|post|write) a (?:comment|reply)|(?:related|recommended|similar|more)(?: (?:articles?|posts?|stories|links|reading|content))?|(?:you may also like|read next|share this)(?: \w+)?", re.I)
COMMENTS = re.compile(r"(?:\d+\s+)?(?:comment|repl|respon|leave|post|write)", re.I)
#: Elements whose text is taken together when a part of the page is chosen.
HOLDS = frozenset("article body center dd div li main section table tbody td tr".split())


@dataclass
class Line:
    """One block of text, its tags, and where it stands."""

    parts: list[str] = field(default_factory=list)
    tags: int = 0
    linked: int = 0
    main: int = 0  # the number of the article that it stands in; 0: none
    mark: int = 0  # the number of the innermost marked element
    part: int = 0  # the number of the innermost element of HOLDS
    title: bool = False  # in h1
    text: str = ""


def _class_marks(value: str, marks: frozenset[str]) -> bool:
    for words in ([w.lower() for w in WORD.findall(x)] for x in value.split()):
        found = marks.intersection(words)
        if found and UNLESS.isdisjoint(words) and not (found <= WEAK_MARKS and not OWN.isdisjoint(words)):
            return True
    return False


def _vetoed(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """Whether the element, by what it is, can't be the article."""
    if tag in FRAME or tag in SILENT:
        return True
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and (value or "").lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value or "", re.I)):
            return True
        if name == "role" and (value or "").lower().strip() in ROLES:
            return True
    return False


def _marked(tag: str, attrs: list[tuple[str, str | None]], in_main: bool) -> bool:
    """Whether the element is named, by class or id, as a part that isn't the article."""
    if tag in ("html", "body", "main"):
        return False
    marks = ARTICLE_MARKS if tag == "article" else MARKS - OUTER_MARKS if in_main else MARKS
    return any(name in ("class", "id") and _class_marks(value or "", marks) for name, value in attrs)


class Open:
    """An open element."""

    __slots__ = ("tag", "silent", "main", "mark", "part", "gone")

    def __init__(self, tag: str, silent: bool, main: bool, mark: int, part: int) -> None:
        self.tag, self.silent, self.main, self.mark, self.part, self.gone = tag, silent, main, mark, part, False


class Lines(HTMLParser):
    """Collects the lines of a page. Elements that can't be the article leave none; each step takes a time that doesn't depend on the depth."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines = [Line()]
        self.open: list[Open] = []
        self.at: dict[str, list[int]] = {}  # where the open elements of a name stand
        self.blocks: list[int] = []  # where the open blocks stand
        self.marks, self.parts = [0], [0]  # the outer one of each, by number
        self.silent = self.main = self.links = self.mains = self.mark = self.part = 0

    def _break(self) -> None:
        if self.lines[-1].parts:
            self.lines.append(Line())
        line = self.lines[-1]
        line.tags = 0  # tags between blocks belong to none
        line.main, line.mark, line.part, line.title = self.mains if self.main else 0, self.mark, self.part, bool(self.at.get("h1"))

    def _close(self, x: Open) -> None:
        self.at[x.tag].pop()
        self.silent -= x.silent
        self.main -= x.main
        self.links -= x.tag == "a"
        if x.mark:
            self.mark = self.marks[x.mark]
        if x.part:
            self.part = self.parts[x.part]

    def _pop(self, k: int) -> None:
        """Closes the open elements from the k-th on."""
        while len(self.open) > k:
            x = self.open.pop()
            if not x.gone:
                self._close(x)
        while self.blocks and self.blocks[-1] >= k:
            self.blocks.pop()

    def _last(self, tags: Iterable[str]) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def _within(self, tags: Iterable[str], stop: Iterable[str]) -> int | None:
        """Where the innermost open element of tags stands, unless one of stop stands inside it."""
        k = self._last(tags)
        return k if k >= 0 and k >= self._last(stop) else None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.lines[-1].tags += tag not in FORMAT
        if tag in ENDS_P and (k := self._within(("p",), ("table", "td", "th", "button", "article", "section", "div"))) is not None:
            self._pop(k)
        if tag in SAME and (k := self._within(SAME[tag], ("ul", "ol", "dl", "table", "select"))) is not None:
            self._pop(k)
        if tag == "body" and self.at.get("head"):  # ends a head that was left open
            self._pop(self.at["head"][0])
        if tag in BLOCK:
            self._break()
        if tag in VOID:
            return
        silent, main = (tag == "header" and not self.main) or _vetoed(tag, attrs), tag in MAIN or ("role", "main") in attrs
        mark = part = 0
        if not silent and not self.silent and _marked(tag, attrs, self.main > 0):
            mark = len(self.marks)
            self.marks.append(self.mark)
            self.mark = mark
        if tag in HOLDS:
            part = len(self.parts)
            self.parts.append(self.part)
            self.part = part
        self.mains += main and not self.main  # a number for each outermost article
        self.at.setdefault(tag, []).append(len(self.open))
        if tag in BLOCK:
            self.blocks.append(len(self.open))
        self.open.append(Open(tag, silent, main, mark, part))
        self.silent += silent
        self.main += main
        self.links += tag == "a"
        if main or mark or tag in BLOCK:
            self._break()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.lines[-1].tags += tag not in FORMAT
        inline = tag not in BLOCK
        k = self._within((tag,), {"td", "th", "table"} - {tag} if tag != "table" else ())
        if k is not None and inline and tag != "a" and self.blocks and self.blocks[-1] > k:  # an inline element that spans blocks: only itself closes
            self._close(self.open[k])
            self.open[k].gone = True
        elif k is not None:
            marked = self.mark
            self._pop(k)
            if self.mark != marked:
                self._break()
        if tag in BLOCK:
            self._break()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            line = self.lines[-1]
            line.parts.append(data)
            line.linked += len(data) if self.links else 0


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing; beyond the ends the line counts as its last value."""
    radius = math.ceil(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, radius, mode="edge"), kernel / kernel.sum(), mode="valid")


def threshold(values: np.ndarray) -> float:
    """Splits values into two clusters of least squared distance to their means, by repeated means; the middle of the two."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        cut = (low + high) / 2
        upper = values > cut
        if not upper.any() or upper.all():
            return cut
        again = float(values[~upper].mean()), float(values[upper].mean())
        if again == (low, high):
            break
        low, high = again
    return (low + high) / 2


def _sums(outer: list[int], own: dict[int, int]) -> list[int]:
    """What each numbered element holds with all inside it; an inner element has a higher number than its outer one."""
    total = [own.get(k, 0) for k in range(len(outer))]
    for k in range(len(outer) - 1, 0, -1):
        total[outer[k]] += total[k]
    return total


def _unmarked(lines: list[Line], marks: list[int]) -> list[Line]:
    """Lines outside marked elements. Where no article is named, an element that holds most of the page's text is the article, whatever its mark."""
    own: dict[int, int] = {}
    for x in lines:
        own[x.mark] = own.get(x.mark, 0) + len(x.text)
    total = _sums(marks, own)
    named = any(x.main and not x.mark for x in lines)
    hides = [False] * len(marks)
    for k in range(1, len(marks)):
        hides[k] = hides[marks[k]] or named or 2 * total[k] <= total[0]
    return [x for x in lines if not hides[x.mark]]


def content(lines: list[Line], marks: list[int] | None = None, parts: list[int] | None = None) -> list[Line]:
    """The lines of the content region.

    Lines of marked elements go first. Tags that only format words count for none. The logs of the others' ratios of text outside links to tags are smoothed and split into
    two clusters; lines of the upper one are cores. Where a core stands in an element that names an article (article,
    main or role=main), the region is that element. Else it is the innermost element that holds two thirds of the
    cores' text, from the first to the last core and the short lines next to them, with the h1 before it. In a region
    short paragraphs and headings are the article's own, but lines below that are mostly links go, and what stands
    under a line like "Comments" or "Related" goes to the next core outside links, or to the end where it is comments.
    """
    for line in lines:
        line.text = " ".join("".join(line.parts).split())
    marks, parts = marks or [0], parts or [0]
    lines = _unmarked([x for x in lines if x.text], marks)
    if not lines:
        return []
    free = [max(0, len(x.text) - x.linked) for x in lines]
    smooth = smoothed(np.log1p(np.array([n / max(1, x.tags) for n, x in zip(free, lines, strict=True)], dtype=float)))
    is_core = smooth >= threshold(smooth)
    cores = np.flatnonzero(is_core)
    if named := {lines[k].main for k in cores} - {0}:
        chosen = [k for k, x in enumerate(lines) if x.main in named]
    else:
        chosen = _region(lines, [int(k) for k in cores], parts)
    out: list[Line] = []
    under = ""  # the line like "Related" that the next ones stand under
    for k in chosen:
        x = lines[k]
        linked = 2 * x.linked > sum(map(len, x.parts))
        if AFTER.fullmatch(x.text.rstrip(":")):
            under = x.text
        elif under and is_core[k] and not linked and not COMMENTS.match(under):
            under = ""
        if not under and (not linked or is_core[k]):
            out.append(x)
    return out


def _region(lines: list[Line], cores: list[int], parts: list[int]) -> list[int]:
    own: dict[int, int] = {}
    for k in cores:
        own[lines[k].part] = own.get(lines[k].part, 0) + len(lines[k].text)
    total = _sums(parts, own)
    inner = max((k for k in range(len(parts)) if 3 * total[k] >= 2 * total[0]), default=0)
    within = [False] * len(parts)
    within[inner] = True
    for k in range(inner + 1, len(parts)):
        within[k] = within[parts[k]]
    cores = [k for k in cores if within[lines[k].part]]
    first, last = cores[0], cores[-1]
    while first > 0 and lines[first - 1].tags <= 3 and within[lines[first - 1].part]:
        first -= 1
    while last + 1 < len(lines) and lines[last + 1].tags <= 3 and within[lines[last + 1].part]:
        last += 1
    title = next((k for k in range(first - 1, -1, -1) if lines[k].title), None)
    taken = [k for k in range(first, last + 1) if within[lines[k].part]]
    return taken if title is None or any(lines[k].title for k in taken) else [title, *taken]


def main_text(html: str | None) -> str:
    """The article of a page: white space inside a block as one space, trimmed, blocks joined in order by one space."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    return " ".join(x.text for x in content(parser.lines, parser.marks, parser.parts))


MAIN_TEXT = pa.struct([("text", pa.string()), ("n_chars", pa.int64())])


def html_text(df: DataFrame, html_col: str = "html", out_col: str = "extracted") -> DataFrame:
    """df with out_col: struct<text, n_chars> of each whole page; "" and 0 for null, empty or text-free pages.

    A page of any length is parsed whole, in linear time. Rows are independent, so repeats get equal results; an empty df
    stays empty. An out_col already there is replaced, other columns pass through, whatever their names.
    """

    def of(column: pa.Array) -> list[dict]:
        texts = [main_text(x) for x in column.to_pylist()]
        return [{"text": t, "n_chars": len(t)} for t in texts]

    return with_struct(df, html_col, out_col, MAIN_TEXT, of)
