"""Data source and sink, probes by host, stream state, and the engine as SQL functions."""

import http.server
import json
import os
import threading
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from proseloom.functions.patterns import Options
from proseloom.operators import structure
from proseloom.plans import sql
from proseloom.plans.analyze import Analysis
from proseloom.plans.queries import notes
from proseloom.sources import files, probe
from proseloom.sources.datasource import ProseReader, ProseSource, ReportSink, ReportWriter, dealt
from proseloom.streaming import documents, targets

SF = "/root/testdata/sf0.001"
CORPUS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "corpus")


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# Data source


def test_reads_thousands_of_files(spark, tmp_path):
    spark.dataSource.register(ProseSource)
    for i in range(10_000):
        folder = tmp_path / f"d{i % 50}"
        folder.mkdir(exist_ok=True)
        (folder / f"{i}.md").write_text(f"﻿text number {i}", encoding="utf-8")
    (tmp_path / "_hidden.md").write_text("no")
    (tmp_path / "large.md").write_text("x" * 300_000)
    read = spark.read.format("prose").option("bytes", 100_000).load(str(tmp_path))
    assert read.columns == ["doc_id", "text", "size"] and read.count() == 10_001
    assert read.where("text = 'text number 777'").select("doc_id").collect() == [("d27/777.md",)]
    assert read.rdd.getNumPartitions() == 3


def test_partitions_by_size():
    parts = dealt([(f"f{i}", s, None) for i, s in enumerate([5, 100, 7, 30, 60, 1])], 64)
    assert [[f[1] for f in p.files] for p in parts] == [[100], [60], [30, 7, 5, 1]] and dealt([], 5) == []


def test_corpus_scan_with_labels(spark, tmp_path):
    spark.dataSource.register(ProseSource)
    read = spark.read.format("prose").option("manifest", f"{CORPUS}/manifest.json").load(f"{CORPUS}/cases")
    want = files.read_manifest(spark, f"{CORPUS}/manifest.json").orderBy("position").collect()
    got = read.orderBy("position").collect()
    assert [(r.doc_id, r.band, r.rules, r.known_gap, r.known_false_positives) for r in got] == [(r.file, r.band, r.rules, r.known_gap, r.known_false_positives) for r in want]
    scores = {r.doc_id: r.band for r in Analysis(read).scores().collect()}
    assert scores["watch-light-filler.md"] == "Watch" and len(scores) == 15
    (tmp_path / "m.json").write_text('{"cases": [{"file": "none.md"}]}')
    with pytest.raises(Exception, match="no document for the case none.md"):
        spark.read.format("prose").option("manifest", str(tmp_path / "m.json")).load(f"{CORPUS}/cases").collect()
    with pytest.raises(Exception, match="a manifest needs cases"):
        (tmp_path / "m.json").write_text('{"cases": []}')
        spark.read.format("prose").option("manifest", str(tmp_path / "m.json")).load(f"{CORPUS}/cases").collect()
    assert ProseReader({"path": "file://" + CORPUS}, ProseSource({}).schema()).path.startswith("file://")


def lines(path):
    return sorted(line for f in os.listdir(path) if f.startswith("reports-") for line in open(os.path.join(path, f), encoding="utf-8"))


def test_commits_reports_once(spark, tmp_path):
    spark.dataSource.register(ReportSink)
    reports = Analysis(docs(spark, "We grew 5%.", "calm", "Needless to say, it is important to note.")).reports()
    out = str(tmp_path / "out")
    reports.repartition(3).write.format("prose-reports").mode("append").save(out)
    want = sorted(r.json + "\n" for r in reports.collect())
    assert lines(out) == want and sorted(json.loads(x)["band"] for x in lines(out)) == ["Clean", "Slop", "Watch"]
    reports.limit(1).write.format("prose-reports").mode("append").save(out)
    assert len(lines(out)) == 4 and sum(f["lines"] for f in json.load(open(f"{out}/_reports.json"))) == 4
    reports.write.format("prose-reports").mode("overwrite").save(out)
    assert lines(out) == want and not [f for f in os.listdir(out) if f.startswith("_attempt")]
    # A task that was lost after it wrote, and ran again: only what is committed shows.
    writer = ReportWriter(str(tmp_path / "again"), False)
    row = lambda x: {"json": x}
    writer.write(iter([row("lost"), row("lost too")]))
    kept = [writer.write(iter([row("a")])), writer.write(iter([]))]
    assert not os.path.exists(tmp_path / "again" / "_reports.json")
    writer.commit(kept)
    assert lines(tmp_path / "again") == ["a\n"]
    failed = ReportWriter(str(tmp_path / "again"), False)
    failed.abort([failed.write(iter([row("b")]))])
    assert lines(tmp_path / "again") == ["a\n"]


# Probes


def asked_at(folder):
    out = []
    for name in os.listdir(folder):
        host, _, at = name.partition("@")
        out.append((host, float(at.split("#")[0])))
    return sorted(out)


def test_rate_by_host(spark, tmp_path):
    folder = str(tmp_path)

    def stub(method, url):
        host = url.split("/")[2]
        open(f"{folder}/{host}@{time.time()}#{time.perf_counter_ns()}", "w").close()
        time.sleep(0.01)
        return (404 if url.endswith("7") else 200), None

    urls = [(f"http://h{i % 3}.org/{i}",) for i in range(60)]
    limits = probe.Limits(rate=20)
    first = probe.answers(spark.createDataFrame(urls, "target string"), stub, limits=limits).collect()
    times = asked_at(folder)
    for host in ("h0.org", "h1.org", "h2.org"):
        own = sorted(t for h, t in times if h == host)
        assert len(own) == 20 and all(sum(a <= t < a + 1 for t in own) <= 21 for a in own) and own[-1] - own[0] > 0.8
    again = probe.answers(spark.createDataFrame(urls[::-1], "target string").repartition(5), stub, limits=limits).collect()
    assert sorted(first) == sorted(again) and sum(r.code == 404 for r in first) == 6


def test_busy_hosts_and_timeouts(tmp_path):
    seen = []

    def stub(method, url):
        seen.append((url, time.monotonic()))
        if "slow" in url:
            time.sleep(1)
        if "busy" in url and sum(u == url for u, _ in seen) == 1:
            return 429, "0.2" if "date" in url else "1, 9"
        if "always" in url:
            return 503, None
        if "far" in url:
            return 429, "3600"
        return 200, None

    limits = probe.Limits(rate=100, timeout=0.3, pause=0.05, retries=2)
    got = {t: (c, a, f) for t, c, a, f in probe.Asking(stub, limits).answers([("a", "busy"), ("a", "fine"), ("b", "slow"), ("c", "always"), ("d", "far")])}
    assert got == {"busy": (200, None, None), "fine": (200, None, None), "slow": (None, None, "no answer within 0.3 seconds"), "always": (503, None, None), "far": (429, "3600", None)}
    tries = [t for u, t in seen if u == "busy"]
    assert len(tries) == 2 and tries[1] - tries[0] >= 0.95 and sum(u == "always" for u, _ in seen) == 3 and sum(u == "far" for u, _ in seen) == 1
    assert probe.seconds_of("7, 9") == 7 and probe.seconds_of("Wed, 21 Oct 2015 07:28:00 GMT", 1445412470.0) == 10 and probe.seconds_of("soon") is None and probe.seconds_of(None) is None


def test_http_probe_keeps_to_public_addresses(monkeypatch):
    class Server(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            onward = {"/moved": "/ok", "/loop": "/loop", "/inside": "http://10.0.0.1/x"}.get(self.path)
            self.send_response(302 if onward else 429 if self.path == "/busy" else 200)
            if onward:
                self.send_header("Location", onward)
            for after in ("5", "6") if self.path == "/busy" else ():
                self.send_header("Retry-After", after)
            self.end_headers()

        do_HEAD = do_GET

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    ask = probe.http_probe(timeout=2)
    with pytest.raises(OSError, match="not a public address"):
        ask("HEAD", f"{at}/ok")
    real = probe.ipaddress.ip_address
    monkeypatch.setattr(probe.ipaddress, "ip_address", lambda a: real("8.8.8.8" if a == "127.0.0.1" else a))
    assert ask("HEAD", f"{at}/ok") == (200, None) and ask("GET", f"{at}/moved") == (200, None) and ask("GET", f"{at}/busy") == (429, "5")
    for path, why in (("/loop", "more than 5 redirects"), ("/inside", "not a public address")):
        with pytest.raises(OSError, match=why):
            ask("GET", at + path)
    server.shutdown()


# Streams


def test_targets_are_asked_once(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # Timers want batches without data, with which a run over what is available doesn't end.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    log = str(tmp_path / "log")
    os.mkdir(log)

    def stub(method, url):
        open(f"{log}/{url.split('/')[2]}@{time.time()}#{time.perf_counter_ns()}", "w").close()
        return (404 if "gone" in url else 200), None

    def run():
        found = targets.checked(documents.cited_targets(documents.arriving(spark, str(tmp_path / "in"))), stub, 3_600_000, probe.Limits(rate=50))
        query = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()

    docs(spark, "see http://a.org/x and http://a.org/x", "http://b.org/gone http://10.0.0.1/no").write.mode("append").parquet(str(tmp_path / "in"))
    run()
    docs(spark, "again http://a.org/x, new http://a.org/y").write.mode("append").parquet(str(tmp_path / "in"))
    run()
    run()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.target, r.code) for r in rows) == [("http://a.org/x", 200), ("http://a.org/y", 200), ("http://b.org/gone", 404)]
    assert Counter(h for h, _ in asked_at(log)) == {"a.org": 2, "b.org": 1}


# SQL


def test_sql_alone_scores(spark):
    names = sql.register(spark)
    assert "prose_score" in names
    notes(spark, SF).createOrReplaceTempView("notes")
    key = lambda df: sorted(map(repr, df.collect()))
    a = Analysis(notes(spark, SF))
    each = lambda made: spark.sql(f"SELECT doc_id, x.* FROM (SELECT doc_id, {made} AS a FROM notes) LATERAL VIEW OUTER explode(a) AS x WHERE x IS NOT NULL")
    scored = spark.sql("SELECT doc_id, s.* FROM (SELECT doc_id, prose_score(text) AS s FROM notes)")
    assert key(scored) == key(a.scores()) and key(each("prose_findings(text)")) == key(a.findings())
    assert key(each("prose_blocks(text)")) == key(a.blocks) and key(each("prose_claims(text)")) == key(a.claims) and key(each("prose_density(text)")) == key(a.density)
    assert key(each("prose_citations(text)")) == key(structure.citations(a.blocks)) and key(each("prose_dois(text)")) == key(structure.dois(a.blocks))
    plan = scored._jdf.queryExecution()
    assert "Python" not in plan.executedPlan().toString() and "Join" not in plan.executedPlan().toString() and plan.optimizedPlan().toString().count("regexp_extract_all(") == 6


def test_sql_scalars(spark):
    sql.register(spark, Options.from_json('{"filler": ["Synergy"]}'), "my_")
    row = spark.sql(
        "SELECT my_prose_tokens('The testing of Boxes') AS t, my_claim_kinds('It fell 5% because of rain') AS k, my_source_signal('so [12]') AS s, my_url_refusal('http://127.1/') AS u, my_url_refusal('http://a.org/') AS v, "
        "my_filler_hits('SYNERGY, needless to say') AS f, my_self_reported('We left at 14:08.') AS r, my_concrete_fact('We met Maria there') AS c, my_prose_tokens(CAST(NULL AS STRING)) AS n"
    ).first()
    assert tuple(row) == (["test", "box"], ["Number", "Causal"], "carries an inline citation", "loopback address", None, ["needless to say", "synergy"], True, True, None)
    cites = spark.sql("SELECT c.* FROM (SELECT my_prose_citations(text) AS a FROM VALUES ('see http://a.org/x, and\n\n```\nhttp://no.org\n```') AS d(text)) LATERAL VIEW explode(a) AS c").collect()
    assert [tuple(c) for c in cites] == [(0, "http://a.org/x", 4, 18)]
    assert spark.sql("SELECT count(*), sum(my_prose_score(text).score) FROM VALUES ('calm'), ('') AS d(text)").first() == (2, 0.0)
