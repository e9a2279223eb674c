"""Arrival of files: once per content, retried after a failure."""

import json
import re

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql import types as T

import catalog.landing
from catalog.fixture import ORACLES
from tablecare.operators.validate import attribute
from tablecare.plans.registry import Registry
from tablecare.plans.run import revalidate
from tablecare.sources.scan import latest_batch, scan
from tablecare.sources.sinks import read_quarantine, read_report, read_runs
from tablecare.spec import RuleError, RunOptions, TableSpec, between, not_null, schema_of, unique
from tablecare.streaming.arrivals import (
    ContentLedger,
    arrivals,
    file_digests,
    row_digest,
    run_new_files,
    run_per_batch,
    stream_reasons,
)
from tablecare.streaming.key_ledger import KeyLedger
from tablecare.streaming.watch import run_on_arrival
from tests.oracle import connect, difference

SPEC = TableSpec("landing", ("id",), schema_of([("id", "integer"), ("x", "double")]))
RULES = [not_null("x"), between("x", 0, 10)]


@pytest.fixture()
def landing(tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    (folder / "a.csv").write_text("id,x\n1,5\n2,\n3,50\n")
    (folder / "b.csv").write_text("id,x\n4,7\n")
    (folder / "c.csv").write_text("id,x\n1,5\n2,\n3,50\n")  # the content of a.csv again
    (folder / "notes.txt").write_text("not ours")
    return folder


def test_identical_content_is_handled_once(spark, landing, tmp_path):
    (landing / "f.csv").write_text("id,x\n4,seven\n")
    (landing / "g.csv").write_text("id,x\n4,eight\n")  # parses to the same rows as f.csv
    ledger = ContentLedger(spark, str(tmp_path / "out"))
    seen = []

    def drain(checkpoint):
        run_new_files(
            spark, SPEC, str(landing), ledger, lambda p: seen.append(p.rsplit("/", 1)[1]), str(tmp_path / checkpoint)
        ).awaitTermination()

    drain("first")
    assert seen == ["a.csv", "b.csv", "f.csv", "g.csv"]
    (landing / "d.csv").write_text("id,x\n4,7\n")
    (landing / "e.csv").write_text("id,x\n5,1\n")
    drain("first")
    assert seen == ["a.csv", "b.csv", "f.csv", "g.csv", "e.csv"]
    # Even a stream that starts over finds nothing new.
    drain("second")
    assert seen == ["a.csv", "b.csv", "f.csv", "g.csv", "e.csv"]
    assert ledger.frame().count() == 5


def test_row_digest_counts_repeats(spark):
    def digest(*rows):
        return row_digest(spark.createDataFrame([(r,) for r in rows], "x int")).first()["digest"]

    assert digest(1, 2, 3) == digest(3, 1, 2)
    assert len({digest(1, 1), digest(2, 2), digest(1), digest(1, 1, 2, 2), digest(1, 2)}) == 5


def test_rules_beyond_a_row_are_refused_on_streams(spark, landing):
    stream = arrivals(spark, SPEC, str(landing / "*.csv"))
    for rule in (unique("id"), not_null("x", mostly=0.9)):
        with pytest.raises(RuleError):
            stream_reasons(stream, [*RULES, rule])


def test_full_pass_per_arrival(spark, landing, tmp_path):
    out, registry = str(tmp_path / "out"), Registry(spark, str(tmp_path / "registry"))
    registry.seed(RULES)

    def drain():
        run_on_arrival(
            spark, SPEC, registry, out, str(landing), options=RunOptions(repair_not_drop=True)
        ).awaitTermination()

    drain()
    drain()
    (only,) = read_runs(spark, out).collect()  # both files went through one run
    assert [p.rsplit("/", 1)[1] for p in json.loads(only["source_ref"])] == ["a.csv", "b.csv"]
    assert (only["failed_rule_count"], only["stop_reason"], only["total_rows"]) == (2, "clean", 4)
    assert [f.action for f in registry.active_fixes()] == ["fill_null", "impute_median"]
    per_file = {r["source_file"].rsplit("/", 1)[1]: r["row_count"] for r in read_report(spark, out, "sources").collect()}
    assert per_file == {"a.csv": 3, "b.csv": 1}
    clean = spark.read.parquet(f"{out}/clean/run_id={only['run_id']}")
    assert {r["source_file"].rsplit("/", 1)[1] for r in clean.collect()} == {"a.csv", "b.csv"}
    assert revalidate(spark, SPEC, registry, out, only["run_id"]).filter("NOT success").isEmpty()


def jobs_of(spark, tmp_path, n, name):
    folder = tmp_path / name
    folder.mkdir()
    for i in range(n):
        (folder / f"{i}.csv").write_text(f"id,x\n{i},{i}\n{i + 100},\n")
    out, registry = str(tmp_path / f"out-{name}"), Registry(spark, str(tmp_path / f"registry-{name}"))
    registry.seed([*RULES, unique("id")])
    query = run_on_arrival(spark, SPEC, registry, out, str(folder), options=RunOptions(repair_not_drop=True))
    query.awaitTermination()
    assert read_runs(spark, out).count() == 1
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(str(query.runId)))


def test_ten_files_cost_the_jobs_of_one(spark, tmp_path):
    one, ten = jobs_of(spark, tmp_path, 1, "one"), jobs_of(spark, tmp_path, 10, "ten")
    assert one > 10 and ten <= one + 3


def test_content_is_told_apart_at_any_piece_size(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    lines = [f"{i},{i * 7}" for i in range(3000)]
    body = "\n".join(lines)
    texts = {
        "a": body, "same": body, "newline": body + "\n", "reversed": "\n".join(lines[::-1]),
        "swapped": "\n".join([lines[1], lines[0], *lines[2:]]), "unparsed": body.replace("5,35\n", "5,35 \n", 1),
        "crlf": "\r\n".join(lines), "moved": "\n".join([*lines[500:], *lines[:500]]), "empty": "", "empty2": "", "blank": "\n",
        "twice": body + "\n" + body, "shorter": "\n".join(lines[:-1]), "equal lines": "x\n" * 999, "more equal lines": "x\n" * 1000,
    }
    for name, text in texts.items():
        (folder / f"{name}.csv").write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    seen = []
    for size in (before, "1000b", "4099b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        seen.append({r.path.rsplit("/", 1)[1]: r.digest for r in file_digests(spark, str(folder), "csv").collect()})
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == len(texts) - 2  # readers skip empty files
    by_digest = {}
    for name, digest in seen[0].items():
        by_digest.setdefault(digest, set()).add(name[:-4].replace("%20", " "))
    assert sorted(map(len, by_digest.values())) == [1] * (len(texts) - 4) + [2]
    assert {"a", "same"} in by_digest.values()


# -- key ledger ----------------------------------------------------------------------------


def test_key_ledger(spark, tmp_path):
    def rows(*keys):
        return spark.createDataFrame([(k, "v") for k in keys], "id int, v string")

    ledger = KeyLedger(spark, str(tmp_path), "t", T.StructType([T.StructField("id", T.LongType())]), buckets=8)
    assert ledger.frame().isEmpty() and ledger.flag(rows(1, 1, None), "b1").filter("repeated").isEmpty()
    assert ledger.commit(rows(1, 1, 2, None), "b1") == 2
    assert ledger.commit(rows(5, 6), "b1") == 0 and ledger.frame().count() == 2  # a committed id adds nothing
    got = {(r.id, r.repeated) for r in ledger.flag(rows(1, 2, 3, 3, None), "b2").collect()}
    assert got == {(1, True), (2, True), (3, False), (None, False)}
    assert ledger.commit(rows(2, 3), "b2") == 1
    assert {r.id for r in ledger.flag(rows(1, 2, 3), "b2").filter("repeated").collect()} == {1, 2}  # tried again
    assert ledger.commit(rows(None), "b3") == 0 and ledger.commits().count() == 3
    flagged = rows(1, 9).withColumn("dq_reasons", F.array(F.lit("other")))
    got = {r.id: r.dq_reasons for r in ledger.add_reason(flagged, "b4").collect()}
    assert got == {1: ["other", "unique on 'id' across batches"], 9: ["other"]}
    with pytest.raises(ValueError):
        KeyLedger(spark, str(tmp_path), "t", T.StructType([T.StructField("batch_id", T.LongType())]))


def test_a_batch_reads_only_the_buckets_of_its_keys(spark, tmp_path):
    keys = T.StructType([T.StructField("id", T.LongType())])
    ledger = KeyLedger(spark, str(tmp_path), "t", keys, buckets=16)
    ledger.commit(spark.range(0, 500), "b1")
    wanted = ledger._counted(spark.createDataFrame([(3,), (4,)], "id long"))
    buckets = {r.key_bucket for r in wanted.collect()}
    plan = ledger.before("b2", wanted)._jdf.queryExecution().executedPlan().toString()
    shown = re.search(r"PartitionFilters: \[(.*?)\]", plan).group(1)
    assert "key_bucket" in shown and "batch_id" in shown and all(str(b) in shown for b in buckets)
    assert {r.key_bucket for r in ledger.before("b2", wanted).collect()} == buckets and len(buckets) <= 2


def test_keys_of_earlier_batches_go_to_quarantine(spark, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    out, registry = str(tmp_path / "out"), Registry(spark, str(tmp_path / "registry"))
    registry.seed([not_null("x")])
    ledger = KeyLedger.of(spark, out, SPEC, buckets=4)

    def drain(name, text):
        (folder / name).write_text(text)
        run_on_arrival(spark, SPEC, registry, out, str(folder), key_ledger=ledger).awaitTermination()
        return read_runs(spark, out).orderBy("started_at").collect()[-1]["run_id"]

    drain("a.csv", "id,x\n1,5\n2,6\n")
    second = drain("b.csv", "id,x\n2,7\n3,8\n")
    assert [(r.id, r.Reason) for r in read_quarantine(spark, out, second).collect()] == [(2, "unique on 'id' across batches")]
    assert [r.id for r in spark.read.parquet(f"{out}/clean/run_id={second}").collect()] == [3]
    assert ledger.frame().count() == 3 and ledger.commits().count() == 2


def test_a_failed_run_is_tried_again(spark, landing, tmp_path):
    ledger = ContentLedger(spark, str(tmp_path / "out"))
    seen = []

    def broken(path):
        if path.endswith("b.csv"):
            raise RuntimeError("run failed")
        seen.append(path)

    with pytest.raises(StreamingQueryException):
        run_new_files(spark, SPEC, str(landing), ledger, broken, str(tmp_path / "cp")).awaitTermination()
    assert len(seen) == 1 and ledger.frame().count() == 1
    run_new_files(spark, SPEC, str(landing), ledger, seen.append, str(tmp_path / "cp")).awaitTermination()
    assert [p.rsplit("/", 1)[1] for p in seen] == ["a.csv", "b.csv"]


def test_streamed_reasons_equal_batch_reasons(spark, landing, tmp_path):
    out = str(tmp_path / "rows")
    stream = stream_reasons(arrivals(spark, SPEC, str(landing / "*.csv"), max_files=1), RULES)
    batches = []

    def append(batch, batch_id):
        batches.append(batch_id)
        batch.write.mode("append").parquet(out)

    run_per_batch(stream, append, str(tmp_path / "cp")).awaitTermination()
    assert len(batches) == 3
    rows = scan(spark, SPEC, str(landing / "*.csv"))
    expected = attribute(rows, RULES, RULES)
    streamed = spark.read.parquet(out)
    assert streamed.exceptAll(expected).isEmpty() and expected.exceptAll(streamed).isEmpty()


def test_digests_and_newest_file(spark, landing):
    digests = {r["path"].rsplit("/", 1)[1]: r["digest"] for r in file_digests(spark, str(landing), "csv").collect()}
    assert digests["a.csv"] == digests["c.csv"] != digests["b.csv"] and len(digests) == 3
    import os

    os.utime(landing / "b.csv", (2_000_000_000, 2_000_000_000))
    assert latest_batch(spark, SPEC, str(landing)).endswith("b.csv")


def test_a_batch_of_part_files_is_read_whole(spark, landing):
    import os

    folder = landing / "batch-7"
    folder.mkdir()
    for i in range(3):
        (folder / f"part-{i}.csv").write_text(f"id,x\n{i},1\n")
        os.utime(folder / f"part-{i}.csv", (2_000_000_000 + i, 2_000_000_000 + i))
    for directory in (str(landing), f"file:{landing}/"):
        newest = latest_batch(spark, SPEC, directory)
        assert newest.endswith("/batch-7") and scan(spark, SPEC, newest).count() == 3


def test_streams_need_a_schema(spark, landing):
    with pytest.raises(ValueError):
        arrivals(spark, TableSpec("t", ("id",)), str(landing))


def test_landed_folders_hold_files_of_bounded_size(spark, sf_dir, monkeypatch):
    # a folder was one file, sorted and written by one task
    landed = []
    monkeypatch.setattr(catalog.landing, "ARRIVAL_ROWS", 50)
    monkeypatch.setattr(catalog.landing, "land", lambda rows, folder, files, plain=catalog.landing.land: landed.append((folder, files)) or plain(rows, folder, files))
    got = catalog.landing.arrivals_run(spark, sf_dir)
    assert difference(got, connect(sf_dir), ORACLES["run_on_arrival"]) is None
    by_name = {folder.rsplit("/", 1)[1]: (folder, files) for folder, files in landed}
    bodies = {}
    for name in ("3", "copy-of-3"):
        folder, files = by_name[name]
        found = spark.read.text(f"{folder}/*.csv", wholetext=True).collect()
        assert files > 1 and len(found) == files
        assert max(r["value"].count("\n") for r in found) < 100
        bodies[name] = sorted(r["value"] for r in found)
    assert bodies["3"] == bodies["copy-of-3"]
