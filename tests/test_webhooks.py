import json

from revlens.sources.webhooks import MALFORMED, OK, REJECTED, read_pr_events
from revlens.streaming.jobs import scratch

PAYLOADS = [
    {"action": "opened", "pull_request": {"number": 7, "title": "T", "user": {"login": "ann"}},
     "repository": {"name": "r", "full_name": "o/r", "owner": {"login": "o"}}, "extra": 1},
    {"action": "closed", "repository": {"full_name": "o/r"}},
    {"action": "opened", "pull_request": None, "repository": {"full_name": "o/r"}},
]


def _write(spark, path):
    lines = [json.dumps(p) for p in PAYLOADS] + ['{"action": "opened", "pull_']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)


def test_read_pr_events_batch_and_stream(spark):
    path = scratch(spark, "webhooks")
    _write(spark, path)
    rows = sorted(read_pr_events(spark, path).collect(), key=lambda r: (r["parse_status"], r["action"]))
    got = [(r["parse_status"], r["action"], r["repo_name"], r["pr_number"], r["pr_title"], r["pr_author"]) for r in rows]
    assert got == [
        (MALFORMED, "", "", 0, "", ""),
        (OK, "closed", "o/r", 0, "", ""),
        (OK, "opened", "o/r", 7, "T", "ann"),
        (REJECTED, "opened", "o/r", 0, "", ""),
    ]
    q = (
        read_pr_events(spark, path, streaming=True)
        .writeStream.format("memory")
        .queryName("webhook_events_test")
        .option("checkpointLocation", scratch(spark, "webhooks-ckpt"))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    assert spark.sql("SELECT count(*) FROM webhook_events_test").first()[0] == 4
