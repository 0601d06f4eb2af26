"""The audit row: page facts joined with the render comparison and the flags of the origin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecensus.functions.text import quoted

SKIPPED_NOTE = "Rendered pages were not part of this run."
FAILED_RENDER = "The page itself could not be audited."

# The pages of an origin are split for the join with its flags into pieces of this many pages, or of one of
# so many shares of all pages if that is more. So no more than that many origins are split.
PIECE_PAGES = 100_000
SHARES = 1000

_NO_RENDER = (
    "CAST(NULL AS BOOLEAN) AS ok",
    "CAST(NULL AS BOOLEAN) AS skipped",
    "CAST(NULL AS STRING) AS render_error",
    "0 AS rendered_text_length",
    "CAST(array() AS ARRAY<STRING>) AS rendered_h1s",
    "0 AS rendered_json_ld_count",
)


def with_render(facts: DataFrame, rendered: DataFrame | None) -> DataFrame:
    """Compare static with rendered facts.

    Both sides are narrow fact rows, so the join on ``page_id`` moves no document. A page without
    a rendered row counts as skipped, and a failed page is never compared.
    """
    if rendered is None:
        joined = facts.selectExpr("*", *_NO_RENDER)
    else:
        joined = facts.join(rendered, "page_id", "left")
    compared = joined.withColumns(
        {
            "render_ok": F.expr("error IS NULL AND coalesce(ok, false)"),
            "render_skipped": F.expr("error IS NOT NULL OR coalesce(skipped, true)"),
            "render_error": F.expr(
                f"CASE WHEN error IS NOT NULL THEN {quoted(FAILED_RENDER)} "
                f"WHEN ok IS NULL THEN {quoted(SKIPPED_NOTE)} ELSE render_error END"
            ),
        }
    )
    grown = "greatest(0, rendered_text_length - visible_text_length)"
    added = "greatest(0, rendered_json_ld_count - json_ld_count)"
    changed = "array_join(h1s, '|') <> array_join(rendered_h1s, '|')"
    return compared.withColumns(
        {
            "text_growth": F.expr(f"CASE WHEN render_ok THEN {grown} ELSE 0 END"),
            "h1_changed": F.expr(f"render_ok AND {changed}"),
            "schema_blocks_added": F.expr(f"CASE WHEN render_ok THEN {added} ELSE 0 END"),
        }
    ).drop("ok", "skipped", "rendered_text_length", "rendered_h1s", "rendered_json_ld_count")


def heavy_origins(pages: DataFrame) -> DataFrame:
    """``origin, pieces`` of the origins whose pages make more than one piece, at most ``SHARES`` of them.

    A sketch of the most frequent origins is enough: its counts may be off a little, which makes the pieces a
    little larger or smaller. It is merged from what each task finds and reads addresses only.
    """
    counted = pages.agg(
        F.expr(f"approx_top_k(origin, {SHARES}, {10 * SHARES}) AS top"), F.count(F.lit(1)).alias("pages")
    )
    listed = counted.selectExpr("pages", "inline(top) AS (origin, n)")
    pieces = f"CAST(ceil(n / greatest({PIECE_PAGES}, pages / {SHARES})) AS INT)"
    return listed.selectExpr("origin", f"{pieces} AS pieces").where("pieces > 1")


def with_resource_flags(facts: DataFrame, flags: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Give each page the robots and sitemap flags of its origin; none is ``false``.

    ``pages`` is where origins are measured: any table with the ``origin`` of all pages that is cheap to read.

    One origin may own a large share of all pages. It is split into pieces by its measured size, and its flags
    are repeated once per piece; other origins are neither split nor repeated. On a stream, whose batches are
    small and cannot be measured ahead, nothing is split.
    """
    if facts.isStreaming:
        joined = facts.join(flags, "origin", "left")
    else:
        # Bounded by SHARES rows.
        heavy = F.broadcast(heavy_origins((facts if pages is None else pages).select("origin")))
        pieces = F.expr("coalesce(pieces, 1)")
        split_pages = facts.join(heavy, "origin", "left").withColumn("_piece", F.pmod(F.xxhash64("page_id"), pieces).cast("int"))
        split_flags = flags.join(heavy, "origin", "left").withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
        joined = split_pages.drop("pieces").join(split_flags.drop("pieces"), ["origin", "_piece"], "left").drop("_piece")
    return joined.withColumns(
        {name: F.expr(f"error IS NULL AND coalesce({name}, false)") for name in ("has_robots_txt", "has_sitemap")}
    )
