import json
import random
import re
from datetime import timedelta

from pyspark.sql import functions as F

from tests.helpers import ABSENT, ARRIVED, T0, VESSEL, event, events_df, feed_time, frame, frames_df, meta, position
from tidewake.functions import frames as fr
from tidewake.functions import times
from tidewake.operators import ingest as ing
from tidewake.schemas import EVENT_SCHEMA
from tidewake.sources import frames as fs
from tidewake.sources import log


def errors_of(spark, frames):
    rows = ing.validate(frames_df(spark, frames)).orderBy("n").collect()
    assert all(r["valid"] == (r["errors"] == []) for r in rows)
    return [r["errors"] for r in rows]


def test_validation_rules(spark):
    def given(**values):
        return frame(report=position(**values))

    whole = "Message.PositionReport is not an object"
    cases = [
        (frame(), []),
        (frame(about=ABSENT), ["MetaData is not an object", "missing top-level key: MetaData"]),
        (frame(message=ABSENT), [whole, "missing top-level key: Message"]),
        (frame(message={"PositionReport": "none"}), [whole]),
        (frame(about=[]), ["MetaData is not an object"]),
        (frame(about={}), ["missing MetaData key: MMSI", "missing MetaData key: time_utc"]),
        (frame(about=meta(mmsi=ABSENT)), ["missing MetaData key: MMSI"]),
        (frame(about=meta(at="yesterday")), ["unparseable time_utc: 'yesterday'"]),
        (frame(about=meta(at=None)), []),
        (frame(kind="Chatter"), ["unsupported MessageType: 'Chatter'"]),
        (frame(kind=None), ["unsupported MessageType: None"]),
        (frame(kind="ShipStaticData", about=ABSENT, message=ABSENT), []),
        (frame(kind="SubscriptionConfirmation", about={}, message={}), []),
        ("7", ["payload is not a JSON object"]),
        (given(cog=None), []), (given(cog=ABSENT), ["missing PositionReport key: Cog"]),
    ]
    for name, key, low, high in (("lat", "Latitude", -90, 90), ("lon", "Longitude", -180, 180), ("sog", "Sog", 0, None)):
        cases += [(given(**{name: low}), []), (given(**{name: low - 0.5}), [f"invalid {key}: {low - 0.5}"]),
                  (given(**{name: None}), [f"invalid {key}: None"]), (given(**{name: "3"}), [f"invalid {key}: '3'"]),
                  (given(**{name: ABSENT}), [f"invalid {key}: None", f"missing PositionReport key: {key}"]),
                  (given(**{name: 999.5 if high is None else high}), [])]
        if high is not None:
            cases.append((given(**{name: high + 0.5}), [f"invalid {key}: {high + 0.5}"]))
    assert errors_of(spark, [c for c, _ in cases]) == [w for _, w in cases]


def test_normalizing(spark):
    frames = [frame(), frame(about=meta(mmsi=211000009), report=position(heading=7, turn=-31)),
              frame(about=meta(mmsi=ABSENT, name=ABSENT), report=position(accuracy=0)), frame(about=meta(name=[1]))]
    a, b, c, d = ing.normalize(frames_df(spark, frames, ARRIVED + 2.25)).collect()
    assert (a.ship_name, a.mmsi, a.schema_version, a.source) == ("NOORDSTER", VESSEL, "1.0", "aisstream")
    assert (a.true_heading, a.rate_of_turn, a.ingested_at) == (None, None, ARRIVED + 2.25)
    assert (a.latitude, a.longitude, a.sog_knots, a.cog_degrees, a.nav_status) == (51.95, 4.05, 11.5, 275.5, 0)
    assert (a.position_accuracy, a.raim) == (True, False)
    assert (b.true_heading, b.rate_of_turn, b.mmsi) == (7.0, -31.0, "211000009")
    assert (c.ship_name, c.mmsi, c.position_accuracy, d.ship_name) == (None, "None", False, None)
    raw = json.loads(a.raw)
    assert raw.pop("_received_at") == ARRIVED + 2.25 and raw == frames[0]


def test_event_id_ignores_key_order_and_depends_on_arrival(spark):
    f = frame()
    shuffled = {k: f[k] for k in reversed(list(f))}
    df = frames_df(spark, [f, shuffled, {**f, "_received_at": 5.0}, {"_received_at": 5.0, **f}]).withColumn("v", F.try_parse_json("value"))
    rows = df.select(ing.event_id("v", "received_at").alias("a"), ing.event_id("v", F.lit(1.0)).alias("b"),
                     ing.event_id("v").alias("c")).collect()
    assert rows[0].a == rows[1].a != rows[0].b
    assert len({r.c for r in rows}) == 1 and len(rows[0].a) == 32
    # Only the frame's own stamp is left out, not a key of that name further inside.
    inner = [{"MetaData": {"_received_at": n}, "MessageType": "x"} for n in (1, 2)]
    df = frames_df(spark, inner).select(ing.event_id(F.try_parse_json("value")).alias("c"))
    assert df.distinct().count() == 2


def test_routes(spark):
    def late(seconds, **values):
        """A frame whose event time is so far from its arrival."""
        return frame(about=meta(at=feed_time(T0 + timedelta(seconds=seconds))), report=position(**values))

    ahead, behind = times.FUTURE_TOLERANCE_S, -times.STALE_TOLERANCE_S
    cases = [
        (frame(), "publish", None),
        (frame(kind="VoyageData"), "skip", None),
        ("null", "skip", None),
        (late(0, sog=-0.1), "dlq", "validation_failed"),
        (frame(about=meta(at=None)), "dlq", "unparseable_timestamp"),
        (late(ahead + 1), "dlq", "future_timestamp"),
        (late(ahead), "publish", None),
        (late(behind - 1), "dlq", "stale_timestamp"),
        (late(behind), "publish", None),
        (late(behind - 1, lat=91), "dlq", "validation_failed"),
    ]
    df = frames_df(spark, [c[0] for c in cases])
    routed = ing.ingest(df)
    got = [(r["_route"], r["_reason"]) for r in routed.collect()]
    assert got == [(r, w) for _, r, w in cases]
    assert ing.published(routed).count() == 3

    dlq = {r["_dlq_reason"]: json.loads(r["event"]) for r in ing.quarantined(routed).collect()}
    assert dlq["validation_failed"]["MessageType"] == "PositionReport"
    assert dlq["future_timestamp"]["message_type"] == "PositionReport"
    records = ing.ingest_records(routed).collect()
    assert sorted({r.topic for r in records}) == ["ais.dlq", "ais.raw"]
    for r in records:
        value = json.loads(r.value)
        if r.topic == "ais.raw":
            assert r.key == value["mmsi"] == VESSEL and len(value) == 18
        else:
            assert r.key is None and value["_dlq_source"] == "ingestion" and value["_dlq_timestamp"] > 0
            assert isinstance(value["event"], dict)


def test_dlq_envelope_round_trip(spark, tmp_path):
    df = spark.createDataFrame([('{"mmsi":"1"}',), ("{oops",)], "event string")
    dlq = log.to_dlq(df, F.col("event"), F.lit("validation_failed"), "ingestion")
    log.write_records(log.to_dlq_records(dlq), str(tmp_path / "log"))
    rows = {r["event"]: r for r in log.read_dlq(spark, str(tmp_path / "log")).collect()}
    assert set(rows) == {'{"mmsi":"1"}', '"{oops"'}
    assert all(r["_dlq_reason"] == "validation_failed" and r["_dlq_timestamp"] > 0 for r in rows.values())


def test_log_round_trip_and_poison(spark, tmp_path):
    path = str(tmp_path / "log")
    log.write_records(log.to_log_records(events_df(spark, [event(), event(event_id="e2", sog_knots=None)])), path)
    back = log.read_log(spark, path)
    assert sorted(back.select("event_id", "sog_knots").collect()) == [("e1", 5.0), ("e2", None)]

    def damaged(**changes):
        good = json.loads(back.filter("event_id = 'e1'").first()["_value"])
        return json.dumps({**good, **changes})

    cases = [
        (damaged(), None, None),
        (damaged(latitude="12.5"), None, None),
        (damaged(latitude="north"), "parquet_serialization_failed", "db_insert_failed"),
        (damaged(nav_status="x"), "parquet_serialization_failed", "db_insert_failed"),
        (damaged(event_id=None), None, "db_insert_failed"),
        (damaged(latitude=None), None, None),
        (damaged(sog_knots="fast"), "parquet_serialization_failed", "row_build_failed: sog_knots"),
        (damaged(sog_knots="fast", nav_status=1), "parquet_serialization_failed", "db_insert_failed"),
        (damaged(ingested_at="x", event_time="y"), "parquet_serialization_failed", "row_build_failed: ingested_at"),
        (damaged(ingested_at="x"), "parquet_serialization_failed", None),
        ("{oops", "parquet_serialization_failed", "row_build_failed: value"),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases] + [(None,)], "value string")
    decoded = log.decode_events(df)
    got = decoded.select(ing.poison_reason("archive"), ing.poison_reason("state")).collect()
    assert [tuple(r) for r in got] == [c[1:] for c in cases]
    good, bad = ing.split_poison(decoded, "state")
    assert (good.count(), bad.count()) == (4, 7)
    assert "_bad" not in good.columns


def test_frames_source(spark, tmp_path):
    folder = tmp_path / "frames"
    folder.mkdir()
    (folder / "a.jsonl").write_text(json.dumps({**frame(), "_received_at": 12.5}) + "\nnot json\n"
                                    + json.dumps(frame()) + "\n")
    df = fs.read_frames(spark, str(folder))
    stamps = sorted(r.received_at for r in df.collect())
    assert stamps[0] == 12.5 and stamps[1] > 1.7e9
    fs.sample_frames(df, 1, str(tmp_path / "sample"))
    sample = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "sample")).collect()]
    assert len(sample) == 1 and "_received_at" in sample[0]


def test_subscription_boxes(spark):
    df = events_df(spark, [event(), event(latitude=50.0), event(message_type="VoyageData")])
    assert fs.filter_subscription(df).count() == 2
    boxes = [[[0.0, 100.0], [2.0, 104.0]], [[60.0, 0.0], [55.0, 1.0]]]
    assert [r.latitude for r in fs.filter_subscription(df, boxes).collect()] == [1.0]


def test_typed_reading_equals_variant_reading(spark, monkeypatch):
    """Whatever the kinds of a frame's values, both tiers give the same fields and errors."""
    rng = random.Random(12)
    odd = [None, True, False, 0, 1, 7, -1, 2.5, "3", "x", "true", "12 knots", "", [1], {"a": 1}, 1e300, "NaN", ABSENT, "[x", 91, 181.5]
    frames = []
    for _ in range(700):
        report = position(lat=rng.uniform(-95, 95), lon=rng.uniform(-185, 185), turn=rng.choice([-128, 20, 0]))
        about = meta(mmsi=rng.choice([211000009, "211000009", 2.5, "007", VESSEL]))
        for part in (report, about):
            for key in rng.sample(sorted(part), rng.choice([0, 0, 1, 2])):
                value = rng.choice(odd)
                part.pop(key) if value is ABSENT else part.update({key: value})
        f = frame(kind=rng.choice(["PositionReport"] * 9 + ["VoyageData", None, 5]), about=about, report=report)
        text = json.dumps(f)
        frames.append(rng.choice([text] * 12 + [text.replace('"', "'"), text + " x", text[:-1], f"[{text}]", text.replace(": ", " :\n")]))
    df = frames_df(spark, frames)

    def both():
        fields = fr.with_errors(fr.with_fields(df)).drop("frame", "_typed", "_certain")
        return [str(r) for r in fields.orderBy("n").collect()]

    certain = fr.with_fields(df).where("frame is null and _is_frame").count()
    typed = both()
    monkeypatch.setattr(fr, "_plain", lambda report, about: F.lit(False))
    assert both() == typed and 50 < certain < 600


# ---- Decoding in two tiers ----------------------------------------------------------------

def _walks(df) -> int:
    """Values that the plan looks up by a path from the root of a VARIANT."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return len(re.findall(r"variant_get\([^,()]+, \$\.", plan))


def test_a_frames_objects_are_walked_once(spark):
    """Not once per value: that was most of the time of a frame with a defect."""
    fields = fr.with_fields(frames_df(spark, [frame()]))
    assert 0 < _walks(fields) <= 5
    assert fields.select("_mmsi", "_Sog").first() == (VESSEL, 11.5)


def test_written_records_are_read_typed_and_any_other_text_alike(spark):
    """A blank more, and the record is no longer what the ingest job writes: it is parsed as VARIANT and says the same."""
    odd = [{}, {"raw": '{"a": "\\u00e9 \\" x"}'}, {"mmsi": "007", "ship_name": "1.50"}, {"ship_name": "true", "raim": None},
           {"latitude": float("nan"), "sog_knots": float("-inf")}, {"event_id": None, "nav_status": None, "ingested_at": 1e-7},
           {"ship_name": "[1]", "raw": None, "event_time": ""}, {"longitude": -0.5, "position_accuracy": False}]
    written = log.to_log_records(events_df(spark, [event(**values) for values in odd]))
    plain = log.decode_events(written)
    other = log.decode_events(written.withColumn("value", F.concat("value", F.lit(" "))))
    columns = [*EVENT_SCHEMA.names, "_bad"]
    assert sorted(map(str, plain.select(columns).collect())) == sorted(map(str, other.select(columns).collect()))
    assert plain.select("_bad").distinct().collect() == [([],)]
    assert _walks(plain) == 0


def test_a_record_with_other_kinds_is_not_taken_as_typed(spark):
    rows = [('{"event_id":1.50,"raw":{"b": 1},"sog_knots":"12.5","raim":1}',), ('{"latitude":"north","nav_status":2.5}',), ("{broken",)]
    got = log.decode_events(spark.createDataFrame(rows, "value string")).select("event_id", "raw", "sog_knots", "raim", "_bad").collect()
    assert got[0] == ("1.5", '{"b":1}', 12.5, True, [])
    assert "latitude" in got[1]["_bad"] and got[2]["_bad"] == ["value"]


def test_an_escaped_arrival_stamp_is_no_content(spark):
    value = '{"\\u005freceived_at":1.0,"MessageType":"PositionReport"}'
    df = spark.createDataFrame([(value,), ('{"MessageType":"PositionReport"}',)], "value string").withColumn("frame", F.try_parse_json("value"))
    ids = df.select(ing.event_id("frame"), ing.event_id("frame", text="value")).collect()
    assert len({i for row in ids for i in row}) == 1
