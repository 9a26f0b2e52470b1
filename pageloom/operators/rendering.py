"""Which stored pages look like unrendered application shells."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import trim_ws
from .shred import shred

# Ids of common application mount points, and the least visible text.
MOUNT_IDS = ["root", "app", "__next", "__nuxt"]
MIN_TEXT_CHARS = 200


def needs_render(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``page_id, url, *keep, empty_mount, text_chars, needs_render`` per page.

    A page needs rendering when a mount point has no child element, or its body
    shows fewer than ``MIN_TEXT_CHARS`` characters. A page without html does not.
    """
    tree = shred(pages.select("page_id", "url", *keep, "html"), ("node_id", "end_id", "attrs"), ("body_text",))
    empty = F.exists(
        "nodes",
        lambda x: F.coalesce(F.try_element_at(x["attrs"], F.lit("id")).isin(MOUNT_IDS), F.lit(False))
        & (x["end_id"] == x["node_id"]),
    )
    chars = F.length(trim_ws(F.coalesce(F.col("body_text"), F.lit(""))))
    return tree.select(
        "page_id", "url", *keep, empty.alias("empty_mount"), chars.alias("text_chars"),
        ((F.size("nodes") > 0) & (empty | (chars < MIN_TEXT_CHARS))).alias("needs_render"),
    )
