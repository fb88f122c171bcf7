"""Project folders as a Spark data source: <root>/<project>/slides/page_<n>.json.

The root is a folder that the driver and all executors have mounted at the same place. A page's file is whole at any
time: tasks write new pages under names of their own, and the driver renames them once all tasks have ended well.
"""

from __future__ import annotations

import glob
import json
import os
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

FORMAT = "layout_projects"
SCHEMA = "project string, page int, document string"
PROJECT, PAGE = re.compile(r"[0-9a-f]+"), re.compile(r"page_([1-9][0-9]*)\.json")
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def local(path: str) -> str:
    """The mounted folder that a path or file: address names."""
    at = urlparse(path)
    if at.scheme not in ("", "file"):
        raise ValueError(f"project folders must be mounted; {at.scheme}: can't be")
    return unquote(at.path) if at.scheme else path


def slides(root: str, project: str) -> str:
    """A project's folder of pages; its name is of hexadecimal digits, so it can't lead elsewhere."""
    if not PROJECT.fullmatch(project):
        raise ValueError(f"not a project: {project!r}")
    return os.path.join(root, project, "slides")


#: Partitions of a read; where there are more projects, a partition has several.
MOST = 1000


@dataclass
class Projects(InputPartition):
    names: list[str]

    def __init__(self, names: list[str]) -> None:
        super().__init__(names)
        self.names = names


class PageReader(DataSourceReader):
    """A partition for each project, or for several of very many; conditions on the project are applied before its folder is listed, those on the page before a file is opened."""

    def __init__(self, root: str, schema: StructType) -> None:
        self.root, self.columns = root, schema.fieldNames()
        self.projects: set[str] | None = None
        self.pages: set[int] | None = None
        if unknown := set(self.columns) - {"project", "page", "document"}:
            raise ValueError(f"pages have no {sorted(unknown)}")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            name = getattr(f, "attribute", None)
            if values is None or name not in (("project",), ("page",)):
                yield f
            elif name == ("project",):
                self.projects = values if self.projects is None else self.projects & values
            else:
                self.pages = values if self.pages is None else self.pages & values

    def partitions(self) -> Sequence[InputPartition]:
        if self.projects is not None:
            found = [p for p in self.projects if isinstance(p, str) and PROJECT.fullmatch(p)]
        else:
            found = [e.name for e in os.scandir(self.root) if e.is_dir() and PROJECT.fullmatch(e.name)] if os.path.isdir(self.root) else []
        names = sorted(p for p in found if os.path.isdir(slides(self.root, p)))
        size = -(-len(names) // MOST) or 1
        return [Projects(names[k : k + size]) for k in range(0, len(names), size)]

    def read(self, partition: Projects | None) -> Iterator[tuple]:
        for project in partition.names if partition is not None else ():  # there may be no project
            yield from self._pages(project)

    def _pages(self, project: str) -> Iterator[tuple]:
        at = slides(self.root, project)
        numbers = sorted(int(m[1]) for n in os.listdir(at) if (m := PAGE.fullmatch(n)))
        for n in numbers:
            if self.pages is not None and n not in self.pages:
                continue
            row = {"project": project, "page": n}
            if "document" in self.columns:
                with open(os.path.join(at, f"page_{n}.json"), encoding="utf-8") as file:
                    row["document"] = file.read()
            yield tuple(row[c] for c in self.columns)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class PageWriter(DataSourceWriter):
    """New and changed pages; those that aren't written stay as they are."""

    def __init__(self, root: str, schema: StructType) -> None:
        self.root, self.job, self.columns = root, uuid.uuid4().hex, schema.fieldNames()
        if set(self.columns) != {"project", "page", "document"}:
            raise ValueError(f"pages are written as {SCHEMA}")

    def write(self, iterator: Iterator[Row]) -> Written:
        """Each row under a name of this attempt; the same page twice in a task: the last one counts."""
        attempt, files = uuid.uuid4().hex, {}
        for row in iterator:
            r = row.asDict()
            if r["page"] is None or r["page"] < 1 or r["project"] is None or r["document"] is None:
                raise ValueError(f"not a page: {r['project']!r}, {r['page']!r}")
            json.loads(r["document"])
            at = slides(self.root, r["project"])
            os.makedirs(at, exist_ok=True)
            new = os.path.join(at, f".page_{r['page']}.{self.job}.{attempt}.tmp")
            with open(new, "w", encoding="utf-8") as file:
                file.write(r["document"])
                file.flush()
                os.fsync(file.fileno())
            files[os.path.join(at, f"page_{r['page']}.json")] = new
        return Written([(new, page) for page, new in files.items()])

    def commit(self, messages: list[Written | None]) -> None:
        """Renames all; if one can't be renamed, those before it get back what they were."""
        done: list[tuple[str, str | None]] = []
        try:
            for new, page in (f for m in messages if m is not None for f in m.files):
                old = f"{page}.{self.job}.old"
                if os.path.exists(page):
                    os.link(page, old)
                else:
                    old = None
                done.append((page, old))
                os.replace(new, page)
        except BaseException:
            for page, old in reversed(done):
                if old is not None:
                    os.replace(old, page)
                elif os.path.exists(page):
                    os.remove(page)
            self._cleared()
            raise
        for _, old in done:
            if old is not None:
                os.remove(old)
        self._cleared()  # of attempts that were not the ones that counted

    def abort(self, messages: list[Written | None]) -> None:
        self._cleared()

    def _cleared(self) -> None:
        for left in glob.glob(os.path.join(glob.escape(self.root), "*", "slides", f".page_*.{self.job}.*.tmp")):
            os.remove(left)


class ProjectSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def _root(self) -> str:
        return local(self.options["path"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return PageReader(self._root(), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("pages are replaced one by one; use mode append")
        return PageWriter(self._root(), schema)


def read_projects(spark: SparkSession, root: str) -> DataFrame:
    """(project, page, document) of all pages under root; no rows if there is no such folder."""
    spark.dataSource.register(ProjectSource)
    spark.conf.set(PUSHDOWN, True)
    return spark.read.format(FORMAT).load(root)


def write_projects(pages: DataFrame, root: str) -> None:
    """Writes pages (project, page, document); on failure every page is as it was."""
    pages.sparkSession.dataSource.register(ProjectSource)
    pages.select("project", "page", "document").write.format(FORMAT).mode("append").save(root)
