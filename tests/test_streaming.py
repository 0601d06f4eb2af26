import uuid

from pagecensus.operators import findings
from pagecensus.plans.pipeline import audit_rows
from pagecensus.sources import snapshots
from pagecensus.streaming import arrivals
from tests.rows import crawl, resources


def test_arriving_snapshots_get_the_batch_findings(spark, tmp_path):
    site = resources(spark, [("https://a.example", "User-agent: *", 200, "<urlset>")])
    first = crawl(spark, [(n, f"https://a.example/{n}", f"<title>{n}</title>") for n in range(5)])
    second = crawl(spark, [{"page_id": 9, "url": "https://b.example/", "error": "timeout"}])
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    # The shared folder outlives a test run, so its name must be new.
    name = f"arrivals-{uuid.uuid4().hex}"
    for batch in (first, second):
        batch.write.mode("append").parquet(folder)
        stream = arrivals.read_arrivals(spark, folder)
        arrivals.write_findings(spark, stream, site, out, name).awaitTermination()
    got = spark.read.parquet(out)
    batch = findings.described_rows(findings.finding_rows(audit_rows(first.unionByName(second), site)))
    assert got.exceptAll(batch).count() == batch.exceptAll(got).count() == 0
    assert got.count() == batch.count() > 0


def at(rows, *moments):
    """The given snapshots with their times."""
    times = ', '.join(f'{k}L, ' + ('NULL' if v is None else repr(v)) for k, v in moments)
    return rows.selectExpr("*", f"CAST(element_at(map({times}), page_id) AS TIMESTAMP) AS fetched_at")


def batches(spark):
    """A first hour, a repeat of it with a new page, a jump of three hours, late and repeated pages, and the end."""
    pages = {n: (n, f"https://{'ab'[n % 2]}.example/{n}", f"<title>{n}</title>") for n in range(12)}
    plan = [
        [(0, "2024-05-01 10:05:00"), (1, "2024-05-01 10:10:00"), (2, "2024-05-01 10:59:59")],
        [(0, "2024-05-01 10:05:00"), (1, "2024-05-01 10:10:00"), (3, "2024-05-01 10:30:00")],
        [(4, "2024-05-01 14:00:00"), (5, "2024-05-01 13:10:00")],
        # 10:20 is more than an hour behind 14:00 and comes too late; 13:10 is a repeat, 13:20 is in time.
        [(6, "2024-05-01 10:20:00"), (5, "2024-05-01 13:10:00"), (7, "2024-05-01 13:20:00"), (1, "2024-05-01 10:10:00")],
        [(8, "2024-05-01 20:00:00"), (9, None)],
    ]
    return [at(crawl(spark, [pages[n] for n, _ in rows]), *rows) for rows in plan]


def test_counts_leave_out_late_and_repeated_snapshots(spark, tmp_path):
    site = resources(spark, [("https://a.example", "User-agent: *", 200, "<urlset>")])
    name = f"counts-{uuid.uuid4().hex}"
    sent = []
    for batch in batches(spark):
        batch.write.mode("append").parquet(f"{tmp_path}/in")
        sent.append(batch)
        stream = arrivals.read_arrivals(spark, f"{tmp_path}/in")
        arrivals.write_counts(spark, stream, site, f"{tmp_path}/out", name, lateness="1 hour").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    everything = sent[0]
    for batch in sent[1:]:
        everything = everything.unionByName(batch)
    # The batch over the same rows, without the one that came too late; its last window is still open.
    in_time = everything.where("page_id <> 6")
    want = arrivals.finding_counts(in_time, site, lateness="1 hour").where("window_end <= '2024-05-01 19:00:00'")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.agg({"pages": "sum"}).first()[0] == 7
    # All windows of the batch, the late page included.
    whole = arrivals.finding_counts(everything, site)
    assert whole.agg({"pages": "sum"}).first()[0] == 9


def test_counts_agree_with_the_findings(spark):
    pages = batches(spark)[0]
    site = resources(spark)
    counts = arrivals.finding_counts(pages, site).agg({c: "sum" for c in ("findings", "critical", "high", "medium", "low")}).first()
    rows = findings.described_rows(findings.finding_rows(audit_rows(pages, site)))
    by_severity = {r.severity.lower(): r["count"] for r in rows.groupBy("severity").count().collect()}
    assert counts["sum(findings)"] == sum(by_severity.values())
    assert all(counts[f"sum({s})"] == by_severity.get(s, 0) for s in ("critical", "high", "medium", "low"))
