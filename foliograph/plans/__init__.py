"""The layout queries by name."""

from . import files, geometry, images, inputs, kernels, last, loops, more, pages, projects, raster, relations, rules, scalars, surfaces, text_rows
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "files", "geometry", "images", "inputs", "kernels", "last", "loops", "more", "pages", "projects", "raster", "relations", "rules", "scalars", "surfaces", "text_rows"]
