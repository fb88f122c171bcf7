"""Queries of what is written to and read from files, as far as tables show it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import store
from ..sources.views import ELEMENTS, elements
from .registry import add

add("snk05_fetch_allow_list", lambda s, d: elements(s, d).select("page_id", "pos", F.concat("type", F.lit("_"), F.col("pos").cast("string"), F.when(F.col("pos") % 3 == 0, ".png").when(F.col("pos") % 3 == 1, ".json").otherwise(".exe")).alias("name")).where(store.may_be_fetched(F.col("name"))), f"WITH {ELEMENTS} SELECT page_id, pos, type || '_' || CAST(pos AS VARCHAR) || CASE WHEN pos % 3 = 0 THEN '.png' ELSE '.json' END AS name FROM e WHERE pos > 0 AND pos % 3 < 2")
