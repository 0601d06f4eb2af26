"""Runs become readable when they are finished, not before."""

import pytest
from pyspark.sql import functions as F

from pagecensus.plans import jobs
from pagecensus.sources import sinks
from tests.test_site_reports import RUN_TS, inputs


def numbers(spark, n):
    return spark.range(n).repartition(2)


def test_a_run_that_dies_leaves_the_one_before(spark, tmp_path):
    out = str(tmp_path)
    first = sinks.Run(spark, out, RUN_TS)
    first.write(numbers(spark, 3), "a")
    first.write(numbers(spark, 4), "b")
    with pytest.raises(LookupError):
        sinks.read_table(spark, out, "a")
    first.finish()
    second = sinks.Run(spark, out, RUN_TS)
    second.write(numbers(spark, 30), "a")
    second.stage(numbers(spark, 5), "c")
    with pytest.raises(Exception, match="divide|DIVIDE"):
        second.write(spark.range(5).select(F.expr("1 div (id - 3)")), "b")
    assert sinks.read_table(spark, out, "a").count() == 3
    assert sinks.read_table(spark, out, "b").count() == 4
    third = sinks.Run(spark, out, RUN_TS)
    third.write(numbers(spark, 7), "a")
    third.write(numbers(spark, 8), "b")
    third.finish()
    assert [sinks.read_table(spark, out, name).count() for name in "ab"] == [7, 8]
    # What the two runs before have left is gone, and so are the intermediate tables.
    assert {f.name for f in tmp_path.glob("[ab]/*/*")} == {f"run={third.name}"}
    assert not (tmp_path / sinks.INTERMEDIATE).exists()
    runs = {r.run: r.tables for r in sinks.finished_runs(spark, out).collect()}
    assert runs == {first.name: ["a", "b"], third.name: ["a", "b"]}


def test_runs_by_date(spark, tmp_path):
    out = str(tmp_path)
    for day, n in (("2024-05-01", 1), ("2024-05-02", 2)):
        run = sinks.Run(spark, out, f"{day} 00:00:00")
        run.write(numbers(spark, n), "a")
        run.finish()
    assert sinks.read_table(spark, out, "a").count() == 2
    assert sinks.read_table(spark, out, "a", "2024-05-01").count() == 1
    for name, day in (("a", "2024-05-03"), ("b", None)):
        with pytest.raises(LookupError):
            sinks.read_table(spark, out, name, day)


def test_a_job_killed_half_way(spark, tmp_path, monkeypatch):
    """The second job dies while it writes its tables; readers still get all tables of the first."""
    seeds, pages, site = inputs(spark)
    out = str(tmp_path)
    jobs.audit_sites(spark, seeds, pages, site, out, RUN_TS)
    names = ("sites", "site_pages", "pages_audited", "summaries", "run_summary", "site_markdown")
    before = {name: sorted(map(str, sinks.read_table(spark, out, name).collect())) for name in names}
    whole = sinks.Run.write

    def dies(run, table, name):
        if name == "pages_audited":
            raise KeyboardInterrupt
        return whole(run, table, name)

    monkeypatch.setattr(sinks.Run, "write", dies)
    with pytest.raises(KeyboardInterrupt):
        jobs.audit_sites(spark, seeds, pages.where("page_id < 1"), site, out, RUN_TS)
    monkeypatch.undo()
    assert {name: sorted(map(str, sinks.read_table(spark, out, name).collect())) for name in names} == before
    jobs.audit_sites(spark, seeds, pages.where("page_id < 1"), site, out, RUN_TS)
    assert sorted(map(str, sinks.read_table(spark, out, "site_pages").collect())) != before["site_pages"]
