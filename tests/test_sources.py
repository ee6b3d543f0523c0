"""Readers, exports and streams on small files."""

from __future__ import annotations

import json
import struct
import wave
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dialmart.sources import artifacts, delimited, publication, workbook
from dialmart.streaming import dashboard, files, ingest


def test_encodings_and_delimiters(spark, tmp_path):
    body = "call_id;name\nc1;שלום\n;\nc2;x;extra\n"
    (tmp_path / "a.csv").write_bytes(body.encode("utf-8-sig"))
    (tmp_path / "b.csv").write_bytes(body.encode("cp1255"))
    (tmp_path / "c.csv").write_bytes(body.replace(";", "\t").encode("utf-16"))
    (tmp_path / "d.csv").write_bytes("call_id,name\nc1,שלום\n".encode() + "c2,שלום\n".encode("cp1255"))
    rows = delimited.read_any(spark, str(tmp_path)).orderBy("row_order").collect()
    by = {}
    for r in rows:
        by.setdefault(r.path[-5], []).append((r.fields["call_id"], r.fields["name"], r.surplus))
    assert by["a"] == by["b"] == by["c"] == [("c1", "שלום", 0), ("c2", "x", 1)]
    assert by["d"] == [("c1", "שלום", 0), ("c2", "שלום", 0)]


def test_call_metadata(spark, tmp_path):
    (tmp_path / "m.csv").write_text(
        "call_id,file_name,banker_channel,segment\nc1,a.wav,L,1\nc1,b.wav,L,2\nc2,a.wav,X,\nc3,,L,\nc4,a,R,\nc4,b,R,\n0501234567,a,,\n"
    )
    good, bad = delimited.call_metadata(spark, str(tmp_path / "m.csv"))
    assert sorted((r.call_id, r.segment) for r in good.collect()) == [("c1", 1), ("c1", 2)]
    assert {(r.code, r.n) for r in bad.collect()} == {("bad_channel", 1), ("no_file", 1), ("duplicate_call_id", 2), ("unsafe_call_id", 1)}


def test_ratings_and_labels(spark, tmp_path):
    (tmp_path / "r.csv").write_text("call_id,rater_id,a,b\nc1,R1,5,\nc1,R2,4,9\n")
    rows = delimited.human_ratings(spark, str(tmp_path / "r.csv"), ["a", "b"]).collect()
    assert sorted((r.rater_id, r.rater_ix, r.dim, r.score) for r in rows) == [("R1", 0, "a", 5), ("R2", 1, "a", 4)]
    (tmp_path / "l.csv").write_text("story_no,contact_no,category\n1,2,fee\n1,x,fee\n")
    with pytest.raises(Exception, match="unreadable label"):
        delimited.content_labels(spark, str(tmp_path / "l.csv"), ["fee"]).collect()


def test_contract_and_log(spark, tmp_path):
    (tmp_path / "interactions.csv").write_text("interaction_id,account_ref,started_at,channel,more\ni1,12/345,02/08/2026 16:04,phone,z\ni2,12/345,never,phone,z\n")
    (tmp_path / "call_segments.csv").write_text("call_key,file_name\nk,f.wav\n")
    (tmp_path / "messages.csv").write_text("correspondence_id,message_id,sent_at,direction\ncor-1,m1,2026-08-02,I\ncor-1,m2,?,O\n")
    got = delimited.journey_contract(spark, str(tmp_path))
    one = got["interactions"].collect()
    assert [(r.interaction_id, r.branch, r.account, r.at) for r in one] == [("i1", "12", "345", datetime(2026, 8, 2, 16, 4))]
    assert [(r.correspondence_id, r.message_id) for r in got["messages"].collect()] == [("COR-1", "m1")]
    assert [(r.code, r.n, r.examples) for r in got["issues"].collect()] == [("unreadable_start", 1, ["i2"])]
    rows = delimited.read_any(spark, str(tmp_path / "interactions.csv"))
    assert [r.column for r in delimited.dropped_columns(rows, ["interaction_id", "account_ref", "started_at", "channel"]).collect()] == ["more"]
    (tmp_path / "log.csv").write_text("ACC_KEY,TS_DT,UNIT_NO,BANKER_CODE,OP_KEY\na,02JUL2026:10:08:00,083,b,0201\n")
    log = delimited.activity_log(spark, str(tmp_path / "log.csv")).first()
    assert (log.at, log.unit, log.op) == (datetime(2026, 7, 2, 10, 8), "83", "201")


def test_artifacts(spark, tmp_path):
    for name, row in {"c1.json": {"call_id": "c1", "total": 5.0}, "c2.json": {"call_id": "other", "total": 1.0}}.items():
        (tmp_path / name).write_text(json.dumps(row))
    (tmp_path / "c3.json").write_text("{broken")
    rows = artifacts.stage_json(spark, str(tmp_path), "call_id string, total double")
    assert [r.call_id for r in rows.collect()] == ["c1"]
    cards = spark.createDataFrame([("a",), ("b",), ("c",)], "call_id string")
    results = spark.createDataFrame([("a", "success"), ("b", "failed"), ("d", None)], "call_id string, status string")
    assert sorted(r.call_id for r in artifacts.published(cards, results).collect()) == ["a", "c"]
    redacted = spark.createDataFrame([("a", True), ("b", None)], "call_id string, enabled boolean")
    wide = artifacts.gated_calls(results, cards, cards.limit(0), cards.limit(0), redacted)
    assert sorted((r.call_id, r.text_shown) for r in wide.collect()) == [("a", True), ("b", False), ("c", False), ("d", False)]


def test_recordings(spark, tmp_path):
    with wave.open(str(tmp_path / "A.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(struct.pack("<h", 16384) * 16000)
    (tmp_path / "b.wav").write_bytes(b"no wave")
    rows = {r.path[-5]: r for r in artifacts.probe_wav(spark, str(tmp_path)).collect()}
    assert (rows["A"].channels, rows["A"].seconds, rows["A"].loudness) == (2, 1.0, 0.5) and rows["b"].error
    assert {r.name for r in artifacts.audio_index(spark, str(tmp_path)).collect()} == {"a.wav", "a", "b.wav", "b"}
    (tmp_path / "t.rttm").write_text("SPEAKER c1 1 1.5 2.0 <NA> <NA> s1 <NA> <NA>\n# note\n")
    turn = artifacts.reference_turns(spark, str(tmp_path / "t.rttm")).first()
    assert (turn.call, turn.start, turn.end, turn.speaker) == ("c1", 1.5, 3.5, "s1")


def make_workbook(path, sheets):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>{names}</sheets></workbook>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>shared</t></si></sst>")
        for i, rows in enumerate(sheets.values(), 1):
            body = ""
            for r, cells in enumerate(rows, 1):
                inner = "".join(
                    f'<c r="{chr(65 + k)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' if v != "shared" else f'<c r="{chr(65 + k)}{r}" t="s"><v>0</v></c>'
                    for k, v in enumerate(cells)
                    if v is not None
                )
                body += f'<row r="{r}">{inner}</row>'
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")


def test_workbook(spark, tmp_path):
    make_workbook(
        tmp_path / "h.xlsx",
        {
            "m": [["UM-1", "COR-7", "02/08/2026", "I", "shared", "text"]],
            "f": [["CALL1", "rec.wav"]],
            "i": [["02/08/2026", "12", "345", "02/08/2026 10:00", "AB12", None, "2", "REC.WAV"]],
        },
    )
    rows = workbook.read_workbooks(spark, str(tmp_path))
    assert rows.count() == 3
    got = workbook.handoff_tables(rows)
    assert [(r.message_id, r.subject) for r in got["messages"].collect()] == [("UM-1", "shared")]
    assert [tuple(r) for r in got["files"].collect()] == [("CALL1", "rec.wav")]
    assert [(r.interaction_id, r.file_name, r.declared) for r in got["interactions"].collect()] == [("ab12", "rec.wav", "2")]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("=x", 1), ("y", 2)], "a string, b int")
    artifacts.write_csv(df.coalesce(1), str(tmp_path / "out"))
    part = next(p for p in (tmp_path / "out").iterdir() if p.suffix == ".csv")
    assert part.read_bytes() == b"a,b\r\n'=x,1\r\ny,2\r\n"
    reviews = spark.createDataFrame([("c", "r", 5)], "call_id string, rater_id string, score int")
    for _ in range(2):
        artifacts.append_reviews(spark, reviews, str(tmp_path / "reviews"))
    assert artifacts.reviews(spark, str(tmp_path / "reviews")).count() == 1
    # a second writer that had not seen the first one's rating appends it too; it counts once
    publication.publish(reviews.withColumn("score", reviews.score + 1), str(tmp_path / "reviews"), "reviews", "append")
    assert [r.score for r in artifacts.reviews(spark, str(tmp_path / "reviews")).collect()] == [5]
    assert artifacts.reviews(spark, str(tmp_path / "nothing")) is None
    for _ in range(2):
        artifacts.append_history(df, str(tmp_path / "history"))
    assert spark.read.json(str(tmp_path / "history")).count() == 4


def test_folder_stream_takes_each_file_once(spark, tmp_path):
    inbox, target, point = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"call_id": f"c{i % 1}", "v": i}) + "\n")
        stream = ingest.watch_folder(spark, inbox, "call_id string, v int")
        ingest.upsert_by_key(stream, "call_id", target, point).awaitTermination()
    rows = ingest.latest(spark, "call_id", target).collect()
    assert [(r.call_id, r.v) for r in rows] == [("c0", 1)]
    assert spark.read.parquet(target).count() == 2


def test_stream_sessions_agree_with_the_batch_rule(spark, tmp_path):
    t0 = datetime(2026, 7, 5, 10)
    folder = tmp_path / "log"
    schema = "account string, at timestamp, op string, banker string"
    schema = schema.replace("account string", "account long")
    batches = [[(0, "b"), (30, "b"), (61, "b")], [(62, "c"), (63, "c")], [(600, "c")], [(1200, "z")]]
    for i, rows in enumerate(batches):
        data = [(1, t0 + timedelta(minutes=m), "op", b) for m, b in rows]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(folder / f"p{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "*"))
    found = ingest.stream_sessions(stream, 30)
    query = found.writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    rows = sorted((r.first_at, r.ops, r.banker) for r in spark.table("closed").collect())
    want = [(0, 2, "b"), (61, 1, "b"), (62, 2, "c")]
    assert [(t0 + timedelta(minutes=m), n, b) for m, n, b in want] == rows[:3]


def test_vocabularies(spark):
    from dialmart.sources import vocabulary

    assert vocabulary.rubric([{"id": "a", "weight": 0.6, "gate": True}, {"id": "b", "weight": 0.4}]) == ({"a": 0.6, "b": 0.4}, ["a"])
    for bad in ([{"id": "a", "weight": 1.0}], [{"id": "a", "weight": 0.5, "gate": True}]):
        with pytest.raises(ValueError):
            vocabulary.rubric(bad)
    kinds = vocabulary.code_kinds(spark, {"open": ["0201"], "look": ["17"]})
    assert sorted(tuple(r) for r in kinds.collect()) == [("17", "look"), ("201", "open")]
    with pytest.raises(ValueError):
        vocabulary.code_kinds(spark, {"open": ["0201"], "look": ["201"]})
    cases = [("109", "109", "center"), ("136", "83", "back"), ("083", "83", "own"), ("55", "83", "other"), ("308", "83", "other"), ("171", "171", "own")]
    df = spark.createDataFrame(cases, "u string, o string, want string")
    got = df.select(vocabulary.unit_class(F.col("u"), F.col("o"), ["109"], ["136"]).alias("c"), "want").collect()
    assert all(r.c == r.want for r in got)


def test_retention_and_reproduction(spark, tmp_path):
    (tmp_path / "old.bin").write_bytes(b"x")
    assert artifacts.expired_files(spark, str(tmp_path), "2200-01-01").count() == 1
    assert artifacts.expired_files(spark, str(tmp_path), "1990-01-01").count() == 0
    a = spark.createDataFrame([(1, 2, "x"), (2, 2, None), (3, 1, "y")], "k int, v int, w string")
    b = spark.createDataFrame([(1, 2, "x"), (2, 3, "z")], "k int, v int, w string")
    assert sorted((r.k, r.differs) for r in artifacts.not_reproduced(a, b, "k").collect()) == [(2, ["v", "w"]), (3, ["missing"])]


def test_a_writer_that_dies_before_its_manifest_publishes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "runs")
    rows = lambda v: spark.createDataFrame([("a", v), ("b", v)], "call_id string, v int")
    assert publication.newest(spark, root, "cards") is None and publication.manifests(spark, root).count() == 0
    publication.publish(rows(1), root, "cards", "r1", {"code": "1"})

    def dies(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(publication, "_announce", dies)
        with pytest.raises(RuntimeError):
            publication.publish(rows(2), root, "cards", "r2")
    assert {r.v for r in publication.newest(spark, root, "cards").collect()} == {1}
    assert publication.every_row(spark, root, "cards").count() == 2
    publication.publish(rows(3).limit(1), root, "cards", "r3", {"code": "3"})
    assert sorted((r.call_id, r.v, r.run) for r in publication.by_key(spark, root, "cards", ["call_id"]).collect()) == [("a", 3, "r3"), ("b", 1, "r1")]
    assert [(m.run, m.rows, m.versions) for m in publication.manifests(spark, root).orderBy("published_at").collect()] == [("r1", 2, {"code": "1"}), ("r3", 1, {"code": "3"})]


def test_files_are_taken_when_settled(spark, tmp_path):
    inbox, log, target, bad, point = (str(tmp_path / n) for n in ("in", "log", "out", "quarantine", "checkpoint"))
    (tmp_path / "in").mkdir()
    put = lambda name, text: (tmp_path / "in" / name).write_text(text)
    list_at = lambda second: files.record_listing(spark, inbox, log, f"2026-01-01 00:{second // 60:02}:{second % 60:02}")

    def run():
        files.take_settled(spark, log, "k int", target, bad, point, 60).awaitTermination()
        names = lambda folder: sorted((r.path if "path" in r else r._path).rpartition("/")[2] for r in spark.read.parquet(folder).collect())
        return [names(f) if any((tmp_path / f).rglob("*.parquet")) else [] for f in (f"{target}/rows", bad)]

    put("whole.json", '{"k": 1}\n{"k": 2}\n')
    put("grows.json", '{"k": 3}\n')
    put("broken.json", '{"k": 4}\n{"k": \n')
    list_at(0)
    assert run() == [[], []]
    put("grows.json", '{"k": 3}\n{"k": 5}\n')
    list_at(61)  # a new query on the same checkpoint goes on from the state
    assert run() == [["whole.json"] * 2, ["broken.json"]]
    list_at(100)
    assert run() == [["whole.json"] * 2, ["broken.json"]]
    list_at(122)
    assert run() == [["grows.json"] * 2 + ["whole.json"] * 2, ["broken.json"]]


def test_streamed_figures_count_once(spark, tmp_path):
    inbox, target, merged, point = (str(tmp_path / n) for n in ("in", "figures", "merged", "checkpoint"))
    rows = lambda *r: spark.createDataFrame(r, "agent string, v double").coalesce(1).write.mode("append").parquet(inbox)
    rows(("a", 1.0), ("b", 5.0), ("a", None))

    def kept():
        stream = spark.readStream.schema("agent string, v double").parquet(inbox)
        dashboard.keep_figures(stream, ["agent"], "v", target, point).awaitTermination()
        return sorted(tuple(r) for r in dashboard.figures(spark, target, ["agent"]).collect())

    assert kept() == [("a", 1, 1.0, 1.0, 1.0), ("b", 1, 5.0, 5.0, 5.0)]
    rows(("a", 4.0))
    assert kept() == kept() == [("a", 2, 2.5, 1.0, 4.0), ("b", 1, 5.0, 5.0, 5.0)]
    dashboard.merge_batches(spark, target, merged, ["agent"])
    assert sorted(tuple(r) for r in dashboard.figures(spark, merged, ["agent"]).collect()) == kept()


def test_contract_files_need_their_columns(spark, tmp_path):
    put = lambda name, text: (tmp_path / name).write_text(text, encoding="utf-8")
    put("interactions.csv", "Interaction_ID,account_ref,started_at,channel,extra\ni1,1/2,2026-01-01 10:00,call,x\n")
    put("call_segments.csv", "call_key\nk\n")
    put("messages.csv", "correspondence_id,message_id,sent_at,direction\nc,m,2026-01-01 10:00,inbound\n")
    got = delimited.journey_contract(spark, str(tmp_path))
    assert [(r.code, r.n, r.examples) for r in got["issues"].collect()] == [("missing_columns", 1, ["call_segments: file_name"])]
    assert [tuple(r) for r in got["dropped"].collect()] == [("interactions", "extra")]
    assert [got[k].count() for k in ("call_segments", "messages")] == [0, 1]
    put("turns.csv", "start,end,speaker\n1.5,2.5,banker\n3,4,\n")
    turns = artifacts.reference_turns_csv(spark, str(tmp_path / "turns.csv"))
    assert sorted(tuple(r) for r in turns.collect()) == [("turns", 1.5, 2.5, "banker"), ("turns", 3.0, 4.0, "")]
