import json
from datetime import datetime, timezone

from pyspark.sql import functions as F

from earshot import schemas
from earshot.operators import quality as Q
from earshot.plans import brief
from earshot.sources import normalise as M
from earshot.sources import payloads as P
from earshot.sources import tables as T
from earshot.streaming import streams

TERMS = {"Nubank": ["nu"], "Inter": []}


def runs(spark, *bodies):
    rows = [(i + 1, f"r{i + 1}", brand, source, body if isinstance(body, str) else json.dumps(body)) for i, (brand, source, body) in enumerate(bodies)]
    return spark.createDataFrame(rows, schemas.PAYLOAD)


def parsed(spark, source, body, brand="Nubank"):
    return M.parse(P.payload_items(runs(spark, (brand, source, body))), source, TERMS)


THREAD = [
    {"id": "t3_a", "dataType": "post", "title": "Nubank down", "body": "again", "username": "u1", "createdAt": "2024-01-02T00:00:00Z", "upVotes": "1,204", "numberOfComments": 2},
    {"id": "c1", "dataType": "Comment", "body": "same here", "postId": "t3_a", "createdAt": 1704153600000},
    {"id": "c2", "dataType": "comment", "body": "nu is fine", "url": "https://r.example/comments/a/x/"},
    {"id": "c3", "dataType": "comment", "body": "unrelated", "postId": "t3_zz"},
    {"id": "c4", "dataType": "comment", "body": "nubank!"},
    {"id": "c5", "dataType": "comment", "body": " "},
    {"error": "boom"},
]


def test_reddit_thread(spark):
    p = parsed(spark, "reddit", {"output": THREAD})
    got = {r["native_id"]: r for r in M.mentions(p).collect()}
    assert set(got) == {"t3_a", "c1", "c2", "c4"}
    assert got["t3_a"]["text"] == "Nubank down\n\nagain" and got["t3_a"]["engagement"] == {"upvotes": 1204, "comments": 2}
    assert (got["c1"]["match_kind"], got["c1"]["matched_terms"], got["c1"]["cluster_key"]) == ("inherited", ["nubank"], "t3_a")
    assert got["c1"]["published_at"] == datetime(2024, 1, 2)
    assert (got["c2"]["cluster_key"], got["c2"]["matched_terms"]) == ("t3_a", ["nu"])
    assert got["c4"]["cluster_key"] == got["c4"]["mention_id"]
    from earshot.operators.counts import parse_report

    r = parse_report(p).first()
    assert (r["cluster_key_fallbacks"], r["skipped_no_match"], r["skipped_no_text"]) == (1, 1, 2)
    assert Q.mention_violations(M.mentions(p)).count() == 0


def test_drift_voids_the_run_or_only_the_item(spark):
    body = [{"reviewId": "a", "text": "ok", "stars": 4, "publishedAtDate": "2024-01-01"}, {"reviewId": "b", "text": "x", "stars": "five", "publishedAtDate": None}]
    p = parsed(spark, "google_maps", body)
    assert M.mentions(p).count() == 0 and M.mentions(p, whole_run=False).count() == 1
    assert [(r["index"], r["reason"]) for r in M.drifted(p).collect()] == [(1, "stars is not an integer 1-5")]
    assert M.run_outcomes(p).first()["reason"] == "schema_drift"


def test_broken_bodies_are_drift(spark):
    for body in ("not json", '{"message": 1}', '{"items": {"a": 1}}'):
        assert [r["reason"] for r in M.drifted(parsed(spark, "youtube", body)).collect()] == ["no item list"]
    p = parsed(spark, "youtube", "[1, \"a\"]")
    assert {r["reason"] for r in M.drifted(p).collect()} == {"item is not an object"}
    assert parsed(spark, "youtube", "[]").count() == 0


def test_only_errors_is_empty(spark):
    p = parsed(spark, "facebook", [{"error": "no page"}, {"errorMessage": "x"}])
    assert M.run_outcomes(p).first()["reason"] == "empty" and M.mentions(p).count() == 0


def test_review_sources_match_as_entities(spark):
    body = {"reviews": [{"id": "x", "title": " T ", "content": "c", "stars": "2", "createdAt": "2024-01-01T10:00:00-02:00", "consumer": {"displayName": "Z"}, "source": {"url": "https://t.example/r/"}}, {"id": "y", "rating": 3}]}
    row = M.mentions(parsed(spark, "trustpilot", body)).collect()
    assert len(row) == 1
    r = row[0]
    assert (r["text"], r["rating"], r["match_kind"], r["matched_terms"], r["url"]) == ("T\n\nc", 2, "entity", ["nubank"], "https://t.example/r")
    assert r["published_at"] == datetime(2024, 1, 1, 12)


def test_result_count(spark):
    bodies = ['{"output": [1, 2]}', '{"output": {"data": [1]}}', '{"x": []}', None]
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    assert [r[0] for r in df.select(P.result_count()).collect()] == [2, 1, 0, 0]


def test_tables_round_trip(spark, folder):
    m = M.mentions(parsed(spark, "reddit", THREAD))
    m.write.json(f"{folder}/m")
    assert T.read_mentions(spark, f"{folder}/m").count() == 4
    for session in ("s1", "s2", "s1"):
        T.write_table(m, f"{folder}/t", session)
    assert T.read_table(spark, f"{folder}/t").count() == 8
    assert T.read_table(spark, f"{folder}/t", "s1").count() == 4


def test_log_and_labels_keep_the_last_line(spark, folder):
    from earshot.operators.ledger import fold_log

    with open(f"{folder}/runs.jsonl", "w") as out:
        for seq, status in ((1, "PENDING"), (2, "PENDING"), (1, "COMPLETED")):
            out.write(json.dumps({"local_seq": seq, "status": status}) + "\n")
    got = fold_log(T.read_log(spark, f"{folder}/runs.jsonl"))
    assert {r["local_seq"]: r["status"] for r in got.collect()} == {1: "COMPLETED", 2: "PENDING"}
    with open(f"{folder}/labels.jsonl", "w") as out:
        for label in ("neutral", "positive"):
            out.write(json.dumps({"brand": "b", "label": {"mention_id": "m", "label": label}}) + "\n")
    assert [r["label"] for r in T.read_labels(spark, f"{folder}/labels.jsonl").collect()] == ["positive"]


def test_lexicon_file(spark, folder):
    with open(f"{folder}/lex.txt", "w") as out:
        out.write("# note\n\n+\tGood Thing\n-\tbad\n+\tbad\n")
    lexicon = T.read_lexicon(spark, f"{folder}/lex.txt")
    assert sorted((r["term"], r["polarity"]) for r in lexicon.collect()) == [("bad", -1), ("bad", 1), ("good thing", 1)]
    assert [r["term"] for r in T.lexicon_conflicts(lexicon).collect()] == ["bad"]
    assert T.lexicon_conflicts(T.default_lexicon(spark)).count() == 0


def test_ledger_stream_over_two_runs(spark, folder):
    schema = "local_seq long, status string, n long"
    log = lambda: spark.readStream.schema(schema).json(f"{folder}/in").withColumn("write_seq", F.struct("n"))
    def add(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{folder}/in")
        streams.start_ledger_stream(log(), f"{folder}/state", f"{folder}/ck").awaitTermination()
        return {r["local_seq"]: r["status"] for r in streams.ledger_state(spark, f"{folder}/state").collect()}
    assert add("1", [(1, "PENDING", 1), (2, "PENDING", 2), (1, "DONE", 3)]) == {1: "DONE", 2: "PENDING"}
    assert add("2", [(2, "FAILED", 5), (3, "PENDING", 6)]) == {1: "DONE", 2: "FAILED", 3: "PENDING"}
    streams.compact_ledger(spark, f"{folder}/state", f"{folder}/small")
    assert streams.ledger_state(spark, f"{folder}/small").count() == 3


def test_spikes_of_closed_days(spark):
    rows = [(f"2024-01-{d:02d}", "a", 30 if d == 14 else 2, 9) for d in range(1, 15)]
    days = spark.createDataFrame(rows, "day string, brand string, n long, n_clusters long").withColumn("day", F.col("day").cast("date"))
    assert [str(r["day"]) for r in streams.stream_spikes(days).collect()] == ["2024-01-14"]


def test_whole_brief(spark):
    posts = [{"id": f"p{i}", "dataType": "post", "title": f"nubank story {i}", "body": "great app" if i % 2 else "bad scam", "createdAt": f"2024-01-{10 + i % 14:02d}T05:00:00Z"} for i in range(60)]
    bodies = runs(spark, ("Nubank", "reddit", {"output": posts + posts[:3]}), ("Inter", "reddit", [{"error": "none"}]), ("Nubank", "news", {"results": [{"url": "https://n.example/1?utm_source=z", "title": "Nubank grows"}]}))
    found = M.mentions(M.parse_all(P.payload_items(bodies), TERMS, ["reddit", "news"]))
    found = found.select("mention_id", "brand", "text").distinct().collect()
    kept = spark.createDataFrame(found, "mention_id string, brand string, text string")
    answer = lambda label: kept.select("mention_id", "brand", F.lit("ok").alias("status"), label.alias("label"), F.lit(True).alias("about_brand"), F.lit(0.9).alias("confidence"), F.lit("r").alias("rationale"))
    label = F.when(F.col("text").contains("great"), "positive").otherwise("negative")
    vectors = kept.select("brand", "mention_id", F.when(F.col("text").contains("great"), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("vector"))
    log = spark.createDataFrame([(i, f"r{i}", "apify", b, s, "COMPLETED", 3, "unreconciled") for i, (b, s) in enumerate([("Nubank", "reddit"), ("Inter", "reddit"), ("Nubank", "news")], 1)], "local_seq long, run_id string, provider string, brand string, source string, status string, n_results long, cost_source string").withColumns({"provider_http_status": F.lit(200), "cost_usd": F.lit(None).cast("double"), "billed_units": F.lit(None).cast("long"), "write_seq": F.struct(F.lit(1))})
    listing = spark.createDataFrame([(f"r{i}", datetime(2024, 1, 24), 0.1, 1, "COMPLETED", 200, i) for i in (1, 2, 3)], "run_id string, created_at timestamp, cost_usd double, billed_units long, status string, provider_http_status int, list_seq long")
    calls = spark.createDataFrame([("classify", 3, 900, 0.05)], "kind string, calls long, tokens long, cost_usd double")
    got = brief.run(spark, brief.Inputs(TERMS, ["reddit", "news"], datetime(2024, 1, 24), datetime(2024, 1, 24), datetime(2024, 1, 25), bodies, answer(label), answer(label), vectors, log, listing, calls), b=30)
    sov = {r["brand"]: r for r in got["share_of_voice"].collect()}
    # Inter got nothing from either source, so neither is a basis for comparison.
    assert sov["Inter"]["n"] == 0 and sov["Nubank"]["basis_sources"] == []
    sent = {r["brand"]: r for r in got["sentiment"].collect()}
    assert (sent["Nubank"]["pos"], sent["Nubank"]["neg"], sent["Nubank"]["n_confirmed"]) == (30, 31, 60)
    assert got["funnel"].first().asDict() == {"fetched": 64, "deduped": 61, "labelled": 61, "unlabelled": 0, "not_about_brand": 0, "irrelevant_label": 0, "refused": 0, "unparseable": 0, "error": 0, "dedup_native_id": 3, "dedup_url": 0, "dedup_text": 0}
    assert got["topics"].count() == 2 and got["top_mentions"].count() == 10
    assert got["verdict"].first()["verdict"] == "RECONCILED"
    assert abs(got["totals"].first()["total_usd"] - 0.35) < 1e-9
    reasons = {(r["brand"], r["source"], r["reason"]) for r in got["abstentions"].collect()}
    assert ("Inter", "reddit", "empty") in reasons and ("Inter", None, "below_minimum") in reasons
    assert got["drift"].count() == 0 and got["mention_counts"].count() > 0
    assert got["receipt_check"].first()["status"] == "ok"
    assert [r["source"] for r in got["coverage_gaps"].collect()] == ["x"] and got["notes"].count() == 1
    assert {r["brand"] for r in got["parse_report"].collect()} == {"Nubank", "Inter"}
    assert got["source_costs"].filter("n_mentions > 0").count() > 0


def test_run_bodies_are_read_with_their_run(spark, folder):
    from earshot.sources import payloads as P

    for run_id, body in (("r 1", '{"items": [{"id": "a"}, {"id": "b"}]}'), ("r2", "[]"), ("other", "[1]")):
        with open(f"{folder}/{run_id}.json", "w") as out:
            out.write(body)
    log = spark.createDataFrame([(7, "r 1", "acme", "news"), (8, "r2", "acme", "reddit"), (9, None, "acme", "reddit")], "local_seq long, run_id string, brand string, source string")
    items = P.payload_items(P.run_payloads(spark, folder, log)).collect()
    assert sorted((r["local_seq"], r["source"]) for r in items)[:2] == [(7, "news"), (7, "news")]


def test_embedding_runner(spark):
    from earshot.operators import vectors as V

    texts = spark.createDataFrame([("a",), ("bb",), ("a",)], "text string")
    cache = spark.createDataFrame([], "key string, vector array<double>")
    misses = V.embedding_misses(texts, cache, "m")
    got = V.embed_misses(misses, lambda batch: [[len(t), 1] for t in batch])
    assert sorted(r["vector"] for r in got.collect()) == [[1.0, 1.0], [2.0, 1.0]]
    assert V.embedding_misses(texts, got, "m").count() == 0


def test_later_batches_win(spark, folder):
    from pyspark.sql import functions as F

    from earshot import schemas
    from earshot.operators.ledger import fold_log
    from earshot.sources import tables as T

    base = spark.createDataFrame([(f"m{i}", "acme", "positive") for i in range(20)], "mention_id string, brand string, label string")
    T.write_labels(base.repartition(4), f"{folder}/labels", 0)
    T.write_labels(base.withColumn("label", F.lit("negative")).repartition(3), f"{folder}/labels", 1)
    assert {r.label for r in T.read_labels(spark, f"{folder}/labels").collect()} == {"negative"}
    log = spark.createDataFrame([(i, "PENDING") for i in range(20)], "local_seq long, status string")
    T.write_log(log.repartition(4), f"{folder}/log", 0)
    T.write_log(log.withColumn("status", F.lit("COMPLETED")).repartition(3), f"{folder}/log", 1)
    back = fold_log(T.read_log(spark, f"{folder}/log"))
    assert back.columns == schemas.columns(schemas.RUN)
    assert back.where("status = 'COMPLETED'").count() == back.count() == 20


def test_numbered_lines_are_short(spark, folder, monkeypatch):
    """Compressed part files of a bounded length; numbered lines carry no file name, winners no order."""
    from pathlib import Path

    from earshot.operators.ranking import keep_last
    from earshot.sources import tables as T

    monkeypatch.setattr(T, "LINES_PER_FILE", 30)
    log = spark.createDataFrame([(i, "PENDING") for i in range(100)], "local_seq long, status string")
    T.write_log(log.coalesce(1), f"{folder}/log", 0)
    parts = list(Path(f"{folder}/log").glob("part-*"))
    assert len(parts) == 4 and all(p.name.endswith(".json.gz") for p in parts)
    spark.createDataFrame([(7, "OLD")], "local_seq long, status string").write.mode("append").json(f"{folder}/log")
    lines = T.read_log(spark, f"{folder}/log")
    assert lines.where("write_seq.file IS NOT NULL").select("status").collect() == [("OLD",)]
    assert lines.select("write_seq").distinct().count() == 101
    last = keep_last(lines.select("local_seq", "status", "write_seq"), ["local_seq"], ["write_seq"], with_order=False)
    assert last.columns == ["local_seq", "status"] and last.where("status = 'PENDING'").count() == 100


def test_ledger_state_is_read_from_the_state_alone(spark, folder):
    schema = "local_seq long, status string, n long"
    log = lambda: spark.readStream.schema(schema).json(f"{folder}/in").withColumn("write_seq", F.struct("n"))

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{folder}/in")
        streams.start_ledger_stream(log(), f"{folder}/state", f"{folder}/ck").awaitTermination()
        state = streams.ledger_state(spark, f"{folder}/state")
        assert "batch=" not in state._jdf.queryExecution().executedPlan().toString()
        return {r["local_seq"]: (r["status"], r["n"]) for r in state.collect()}

    assert add([(1, "PENDING", 5), (2, "PENDING", 6)]) == {1: ("PENDING", 5), 2: ("PENDING", 6)}
    # Late lines, repeated ones and new ones.
    assert add([(1, "OLD", 2), (2, "PENDING", 6), (2, "DONE", 9), (2, "DONE", 9), (3, "PENDING", 1)]) == {1: ("PENDING", 5), 2: ("DONE", 9), 3: ("PENDING", 1)}
    assert add([(2, "OLD", 7)]) == {1: ("PENDING", 5), 2: ("DONE", 9), 3: ("PENDING", 1)}


def test_daily_stream_equals_the_batch_form(spark, folder):
    import random

    from earshot.operators import dedup
    from earshot.operators.events import daily_counts

    rng = random.Random(3)
    rows, refs = [], list(range(400))
    rng.shuffle(refs)
    for i in range(130):
        hour = i * 2
        for copy in range(rng.choice([1, 1, 2, 3, 4])):
            ref = refs.pop()
            rows.append((hour + rng.choice([0, 0, 3]), f"n{i}", f"b{i % 2}", f"c{rng.randrange(9)}", f"{ref // 7}#{ref % 7}"))
    rows.append((2000, "last", "b0", "c", "999#0"))
    schema = "hour long, native_id string, brand string, cluster_key string, raw_ref string"
    full = lambda df: df.select("*", F.lit("reddit").alias("source"), F.lit(None).cast("string").alias("url"), F.lit("").alias("text"), F.timestamp_seconds(F.col("hour") * 3600 + 1_700_000_000).alias("published_at")).drop("hour")
    # Copies come in any order within two days, in three files.
    rows.sort(key=lambda r: r[0] + rng.uniform(0, 40))
    stream = lambda: full(spark.readStream.schema(schema).json(f"{folder}/in"))
    for part in (rows[:90], rows[90:180], rows[180:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(f"{folder}/in")
        streams.start_daily_stream(stream(), f"{folder}/days", f"{folder}/ck").awaitTermination()
    got = {(str(r["day"]), r["brand"]): (r["n"], r["n_clusters"]) for r in streams.closed_days(spark, f"{folder}/days").collect()}
    kept = dedup.kept(dedup.dedup(full(spark.createDataFrame(rows, schema)))).withColumn("day", F.to_date("published_at"))
    want = {(str(r["day"]), r["brand"]): (r["n"], r["n_clusters"]) for r in daily_counts(kept).collect()}
    # The last row is not settled yet, and the day before it in the data has no later winner to close it.
    open_days = sorted({day for day, _ in want})[-2:]
    assert len(got) > 15 and got == {k: v for k, v in want.items() if k[0] not in open_days}


def test_identities_of_a_batch_are_held_without_python_calls(spark):
    schema = "native_id string, raw_ref string, published_at timestamp, cluster_key string"
    rows = [("a", "2#0", datetime(2024, 1, 5), "c2"), ("a", "1#7", datetime(2024, 1, 4), "c1"), ("b", "9#9", datetime(2024, 1, 6), "c3"), ("late", "0#0", datetime(2024, 1, 2), "c4"), ("none", "0#1", None, "c5")]
    more = {"source": F.lit("reddit"), "brand": F.lit("x"), "url": F.lit(None).cast("string"), "text": F.lit("")}
    us = lambda day: int(datetime(2024, 1, day, tzinfo=timezone.utc).timestamp()) * 1_000_000
    held = spark.createDataFrame([("reddit", "x", "dedup_native_id", "b", (5, us(3), "c0"), us(3), True)], streams._HELD)
    got = streams._hold(spark.createDataFrame(rows, schema).withColumns(more), held, us(2))
    assert "FlatMapGroups" not in got._jdf.queryExecution().optimizedPlan().toString()
    found = {r["dedup_key"]: (r["low"]["position"], r["low"]["cluster_key"], r["last"], r["done"]) for r in got.collect()}
    assert found == {"a": ((1 << 31) + 7, "c1", us(5), False), "b": (5, "c0", us(6), True)}


def test_texts_of_mentions_are_folded_and_matched_once(spark):
    posts = [{"id": f"p{i}", "caption": f"caf\u00e9 NUBANK\u00a0 {i}", "uploadedAt": 1_700_000_000} for i in range(6)]
    items = P.payload_items(runs(spark, ("Nubank", "tiktok", {"output": posts})))
    got = M.mentions(M.parse(items, "tiktok", TERMS), whole_run=False)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_fold_unicode(") == 1 and got.count() == 6


def test_own_adapter_through_the_data_source(spark, folder):
    from earshot.sources import normalise, runs as N

    class Forum:
        """A provider that sends threads of posts."""

        source = "forum"

        def items(self, body):
            threads = json.loads(body)["threads"]
            return [{"id": f"{t}-{i}", "said": text} for t, posts in threads.items() for i, text in enumerate(posts)]

    bodies = [
        (1, "r-1", "Nubank", "forum", json.dumps({"threads": {"a": ["nubank is fine", "so it is"], "b": ["no nubank"]}})),
        (2, "r2", "Inter Co", "forum", "not opened, not JSON"),
        (3, "r3", "Nubank", "youtube", json.dumps({"output": {"items": [{"id": "v1", "title": "nubank"}]}})),
        (4, "r4", "Nubank", "news", "not opened either"),
        (5, "r5", "Nubank", "youtube", json.dumps({"message": "none"})),
    ]
    N.write_runs(spark.createDataFrame(bodies, "local_seq long, run_id string, brand string, source string, body string"), f"{folder}/runs")
    N.install(spark, [Forum()])
    read = lambda: spark.read.format("listening_runs").load(f"{folder}/runs")
    got = read().filter("source = 'forum' AND brand = 'Nubank'").collect()  # the other forum run would fail
    assert [(r["local_seq"], r["run_id"], r["index"]) for r in got] == [(1, "r-1", 0), (1, "r-1", 1), (1, "r-1", 2)]
    lists = read().filter(F.col("source").isin("youtube")).orderBy("local_seq").collect()
    assert [(r["local_seq"], r["no_list"], r["index"]) for r in lists] == [(3, False, 0), (5, True, None)]
    assert read().filter("run_id = 'r3'").count() == 1 and read().filter("local_seq = 3 AND source = 'news'").count() == 0
    import pytest

    with pytest.raises(Exception, match="JSONDecodeError|Expecting value"):
        read().collect()

    def reading():
        return normalise.Reading(
            text=P.string("item", "said"), native_id=P.string("item", "id"), url=F.lit(None).cast("string"), handle=F.lit(None).cast("string"),
            published_at=F.lit(None).cast("timestamp"), engagement={}, drift={"id missing or empty": P.string("item", "id").isNull()},
        )

    normalise.register("forum", reading)
    try:
        found = M.mentions(M.parse(N.as_items(read().filter("source = 'forum' AND brand = 'Nubank'")), "forum", {"Nubank": []}))
        assert sorted(r["native_id"] for r in found.collect()) == ["a-0", "b-0"]
    finally:
        del normalise.READINGS["forum"]


def test_run_folders_are_one_file_a_body_and_bounded_tasks(spark, folder, monkeypatch):
    from pathlib import Path

    from earshot.sources import runs as N

    rows = [(i, f"r/{i % 9}", "A b=c", "news", json.dumps([{"id": i}])) for i in [*range(9), 4]]
    N.write_runs(spark.createDataFrame(rows, "local_seq long, run_id string, brand string, source string, body string"), f"{folder}/runs")
    assert len([f for f in Path(f"{folder}/runs").rglob("*") if f.is_file()]) == 10
    monkeypatch.setattr(N, "RUNS_PER_TASK", 4)
    monkeypatch.setattr(N, "_MIN_TASKS", 1)
    assert sorted(len(p.runs) for p in N._Reader(f"{folder}/runs", {}).partitions()) == [1, 4, 4]
    N.install(spark, [])
    got = spark.read.format(N.FORMAT).load(f"{folder}/runs").collect()
    assert sorted((r["local_seq"], r["run_id"], r["brand"], r["index"]) for r in got) == sorted((r[0], r[1], "A b=c", 0) for r in rows)


def test_terms_as_a_table_give_the_same_mentions(spark):
    from earshot.operators import terms as D

    posts = [{"id": f"p{i}", "dataType": "post" if i % 3 else "comment", "postId": f"p{i - 1}", "title": f"nubank story {i}", "body": f"roxinho {i}" if i % 2 else "nothing"} for i in range(20)]
    items = P.payload_items(runs(spark, ("Nubank", "reddit", {"output": posts}), ("Inter", "reddit", {"output": posts[:4]})))
    terms = {"Nubank": ["roxinho", "nubank story"], "Inter": ["nothing"]}
    one = M.mentions(M.parse(items, "reddit", terms)).orderBy("raw_ref", "brand").collect()
    two = M.mentions(M.parse(items, "reddit", D.brand_terms(D.brand_aliases(spark, terms)))).orderBy("raw_ref", "brand").collect()
    assert one == two and len(one) > 10


def test_a_null_text_does_not_void_its_run(spark, folder):
    from earshot.catalog import QUERIES

    rows = [(i, None if i == 105 else "a word of the b", "en", "src1", 15) for i in range(1, 200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    # 105 and 8 are items of one run, 50, 100 and 150 are errors on facebook.
    got = {r["source"]: r["n"] for r in QUERIES["u01_all_mentions"](spark, folder).collect()}
    assert got == {"youtube": 198, "tiktok": 198, "facebook": 195}
    assert {r["reason"] for r in QUERIES["src13_run_outcomes"](spark, folder).collect()} == {"none"}
