"""What the registered queries land of the star tables, and how landed tables are joined."""

from conftest import SMALL
from pyspark.sql import functions as F

from mergelens.operators import interning
from mergelens.operators.normalize import Normalizer
from mergelens.plans import star
from mergelens.plans.queries import QUERIES
from mergelens.sources.staging import Staging


def test_queries_land_only_tables_they_read(spark):
    folder = f"{SMALL}/."  # a name of its own, under which nothing is landed yet
    rows = QUERIES["event_after_review"](spark, folder)
    landed = {what for _, what, sf_dir in star._LANDED if sf_dir == folder}
    assert landed == {"activity", "whole reviews", "whole timeline", "whole manifests"}
    assert sorted(rows.collect()) == sorted(QUERIES["event_after_review"](spark, SMALL).collect())
    every = star.whole_tables(spark, folder)
    assert every.commits.count() and every.files.count() and every.pull_requests.count() == 1500


def test_facts_are_not_broadcast_by_their_size_in_files(spark):
    """Two megabytes of a landed table are many rows; small tables still are broadcast."""
    staging = Staging(spark)
    facts = [staging.table(name, spark.range(250_000).selectExpr("id AS number", "xxhash64(id) AS at")) for name in "ab"]
    few = staging.table("few", spark.range(100).selectExpr("id AS number", "id AS user"))
    plans = [facts[0].join(other, "number")._jdf.queryExecution().executedPlan().toString() for other in (facts[1], few)]
    staging.close()
    assert "Broadcast" not in plans[0] and "BroadcastHashJoin" in plans[1]


def test_metrics_land_only_tables_they_read(spark):
    folder = f"{SMALL}/./."
    rows = QUERIES["review_iterations"](spark, folder)
    landed = {what for _, what, sf_dir in star._LANDED if sf_dir == folder}
    assert landed == {"activity", *(f"canonical {name}" for name in ("pull_requests", "reviews", "comments", "manifests"))}
    assert sorted(rows.collect()) == sorted(QUERIES["review_iterations"](spark, SMALL).collect())


def test_landed_children_need_no_join_with_their_pull_requests(spark):
    tables = star._windowed(spark, SMALL)
    for name in ("reviews", "commits", "timeline"):
        rows = getattr(tables, name)
        assert "Join" not in rows._jdf.queryExecution().executedPlan().toString()
        assert rows.count() == rows.join(tables.pull_requests.select("number"), "number", "left_semi").count() > 0


def test_batches_read_payloads_that_were_written_once(spark):
    one, two = star.raw_batches(spark, SMALL)
    for name in one:
        made = star.raw_table(spark, SMALL, name)
        assert set(one[name].inputFiles()) == set(two[name].inputFiles()), name
        assert not set(one[name].inputFiles()) & set(made.inputFiles()), name
    reviews = one["reviews"].unionByName(two["reviews"])
    assert sorted(map(str, reviews.collect())) == sorted(map(str, star.raw_table(spark, SMALL, "reviews").collect()))


def test_users_of_pull_requests_come_from_one_scan(spark, tmp_path):
    norm = Normalizer(star.MANIFEST)
    prs = Staging(spark, str(tmp_path / "staged")).table("prs", norm.pull_requests(star.raw_pull_requests(spark, SMALL)))
    mentions = interning.pr_mentions(prs)
    assert mentions._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    by_slot = {r.slot: r.n for r in mentions.groupBy("seen_at.slot").agg(F.count("*").alias("n")).collect()}
    every, merged = prs.count(), prs.filter("merged_by IS NOT NULL").count()
    assert merged and by_slot == {0: every, 1: every, 2: every, 3: merged, 4: every}
    owners = mentions.filter("seen_at.slot = 0").select("seen.type").distinct().collect()
    assert [r.type for r in owners] == ["Organization"]
