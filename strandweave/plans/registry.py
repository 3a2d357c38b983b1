"""All registered queries of the core."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandweave.plans import features, files, joins, matrices, preparation, tracks

FLAGSHIP = "a5_apa_pileup"
BOOKS = (features.book, joins.book, matrices.book, tracks.book, files.book)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return preparation.queries() | {k: f for b in BOOKS for k, f in b.queries.items()}


#: Queries over all lists or anchors, whose SQL is that of the query over one list without its condition.
WHOLE = ("j6b_contained_anchors", "j11_anchor_pairs_inter", "j12_window_pixels", "f18_pixel_mask", "j14_near_pixels", "a7_apa_1d", "t1_simple_max", "t3_coarse_to_fine")
ONE_LIST = r"list_id = 'A'|(?:\b\w+\.)?score >= 1\.8"


def oracle_sql() -> dict[str, str]:
    own = preparation.oracle_sql() | {k: s for b in BOOKS for k, s in b.sql.items()}
    return own | {f"{k}_all": re.sub(ONE_LIST, "true", own[k]) for k in WHOLE}
