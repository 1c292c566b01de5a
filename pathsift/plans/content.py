"""Content extractor job: pages in, one main-content row per page out.

One cycle of the stored model (``operators.training``) over all pages.  Queries
over the same pages share the stored tables: the model is trained once and read
by extraction, records, ratio log and reports.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import TRAIN_DOC_LIMIT
from ..operators.training import MODEL_TABLES, content_cycle
from ..session import ensure_checkpoint_dir
from ..shipping import code_digest
from ..sources.cycles import CycleStore


@dataclass
class ContentRun:
    """Stored tables of a run; ``nodes`` include the pages' marks."""
    nodes: DataFrame
    train: DataFrame
    items: DataFrame
    distances: DataFrame
    ratios: DataFrame
    model: DataFrame
    main: DataFrame


def read_run(store: CycleStore) -> ContentRun:
    return ContentRun(*(store.table(n) for n in ("nodes", "train_pages", "items", "distances", "ratios", "model", "extracts")))


def train_and_extract(pages_df: DataFrame, limit: int = TRAIN_DOC_LIMIT, keep_empty: bool = False,
                      name: str | None = None) -> ContentRun:
    """``pages_df``: ``(page_id, domain, html)``.  A store of this ``name``
    that has its cycle already is read, not made again."""
    spark = pages_df.sparkSession
    store = CycleStore(spark, f"{ensure_checkpoint_dir(spark)}/content/{name or uuid.uuid4().hex}", MODEL_TABLES)
    attempt = store.begin(0)
    if attempt is not None:
        content_cycle(store, attempt, pages_df, limit, keep_empty)
        attempt.commit()
    return read_run(store)


def stored_run(pages_df: DataFrame) -> ContentRun:
    """The stored run over exactly these pages, made on first use.  Its name is
    a digest of all rows and of the code, so other pages never meet it."""
    row = F.xxhash64("page_id", "domain", "html"), F.hash("html", "domain", "page_id")
    key = pages_df.agg(F.count("*"), F.bit_xor(row[0]), F.sum(row[0].cast("decimal(38,0)")), F.sum(row[1].cast("long"))).first()
    return train_and_extract(pages_df, name="-".join([code_digest(), *(str(v) for v in key)]))
