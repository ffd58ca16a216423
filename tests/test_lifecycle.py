"""Batches over a folder: late, repeated, failed and expired ones, with a restart in between."""

import shutil
from datetime import datetime, timedelta, timezone

from larkspur.operators import ports
from larkspur.streaming import lifecycle


def test_lifecycle_with_restarts(spark, tmp_path):
    begun = datetime(2024, 5, 1, tzinfo=timezone.utc)
    at = lambda hours: begun + timedelta(hours=hours)
    client, folder, registry = ports.FolderBatches(str(tmp_path / "remote")), str(tmp_path / "events"), {}
    (tmp_path / "requests.jsonl").write_text("{}\n")
    for name in ("good", "late", "failed", "expired", "gone"):
        registry[name] = client.submit(str(tmp_path / "requests.jsonl"), name)
    ids = dict(registry)
    lifecycle.note(folder, [(b, "submitted") for b in ids.values()], at(0))

    def run():
        stream = lifecycle.changes(lifecycle.events(spark, folder), hours=24)
        lifecycle.land(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
        rows = spark.read.schema(lifecycle.CHANGES).parquet(str(tmp_path / "out")).collect()
        names = {v: k for k, v in ids.items()}
        out = {}
        for r in sorted(rows, key=lambda r: r["at"]):
            out.setdefault(names[r["batch_id"]], []).append((r["before"], r["after"]))
        return out

    lifecycle.poll(registry, client, folder, at(1))
    first = run()
    assert first == {name: [("none", "submitted"), ("submitted", "running")] for name in ids}

    # the stream is another one now; its states are the old ones
    shutil.copyfile(client.requests / f"{ids['good']}.jsonl", client.answers / f"{ids['good']}.jsonl")
    client.cancel(ids["gone"])
    del registry["failed"]
    lifecycle.note(folder, [(ids["failed"], "failed")], at(2))
    lifecycle.poll(registry, client, folder, at(2))
    lifecycle.poll(registry, client, folder, at(3))  # repeated
    second = run()
    assert second["good"][-1] == ("running", "completed") and len(second["good"]) == 3
    assert second["failed"][-1] == ("running", "failed") and second["gone"][-1] == ("running", "cancelled")
    assert second["late"] == first["late"] and second["expired"] == first["expired"]

    lifecycle.note(folder, [(ids["good"], "collected"), (ids["late"], "completed"), (ids["late"], "in_progress"), (ids["gone"], "completed")], at(23))
    third = run()
    assert third["good"][-1] == ("completed", "collected") and third["late"][-1] == ("running", "completed")
    assert third["gone"] == second["gone"]

    lifecycle.note(folder, [("another", "in_progress")], at(30))  # time goes on; an unknown batch changes nothing
    run()
    lifecycle.note(folder, [(ids["expired"], "completed"), (None, "submitted")], at(31))  # too late
    last = run()
    assert last["expired"][-1] == ("running", "expired") and len(last["expired"]) == 3
    assert {k: v for k, v in last.items() if k != "expired"} == {k: v for k, v in third.items() if k != "expired"}
