"""Audit notes: what could not be looked at, per page and per site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecensus.functions.text import quoted

SKIPPED = "The rendered page was not looked at in this run."
PAGE_NOTE = "On a page: "

# The note of an audit row, null when nothing was missed.
PAGE_NOTE_SQL = f"""CASE
  WHEN error IS NOT NULL THEN concat('Audit of the page failed: ', error)
  WHEN render_skipped THEN {quoted(SKIPPED)}
  WHEN NOT render_ok THEN concat('The rendered page was not available: ', coalesce(render_error, 'unknown error')) END"""

# The site's own note about a page that failed, null otherwise.
_RUN_NOTE_SQL = "CASE WHEN error IS NOT NULL THEN concat('Could not audit ', url, ': ', error) END"


def page_notes(audits: DataFrame) -> DataFrame:
    """One row per page with a note. A projection and a filter, nothing moves."""
    return audits.selectExpr("page_id", "origin", "url", f"{PAGE_NOTE_SQL} AS note").where(
        "note IS NOT NULL"
    )


def site_notes(pages: DataFrame) -> DataFrame:
    """Distinct notes of each site: first those of the run, then those of its pages.

    ``note_kind`` and ``first_pos`` give the order of first appearance.
    """
    both = (
        f"inline(array(named_struct('note_kind', 0, 'note', {_RUN_NOTE_SQL}), "
        f"named_struct('note_kind', 1, 'note', concat({quoted(PAGE_NOTE)}, {PAGE_NOTE_SQL}))))"
    )
    return (
        pages.selectExpr("origin", "page_pos", both)
        .where("note IS NOT NULL")
        .groupBy("origin", "note_kind", "note")
        .agg(F.min("page_pos").alias("first_pos"))
    )
