import json

from pyspark.sql import functions as F

from ledgerline.operators import responses as rs

MESSAGES = [("m1", "s1"), ("m2", "s2"), ("m3", "s3"), ("m4", "s1")]


def answer(texts):
    said = {"s1": {"event_type": "offer", "company": "Acme, Inc.", "role": "N/A"}, "s2": {"event_type": "unknown", "company": "X"}, "s3": "no json"}
    return [json.dumps(next(v for k, v in said.items() if f"Subject: {k}" in t)) for t in texts]


def test_answers_are_kept_and_read(spark):
    messages = spark.createDataFrame([(i, s, "a@b.c", None, "body" * 2000) for i, s in MESSAGES], "message_id string, subject string, from_email string, from_name string, body_text string")
    requests = rs.request(messages, "prompt", "model-1")
    held = spark.createDataFrame([], rs.RESPONSE)
    new = rs.ask(requests, held, answer).persist()
    assert new.count() == 3 and rs.ask(requests, new, answer).count() == 0
    assert rs.ask(requests, held, lambda texts: 1 / 0).count() == 0
    found = {r.message_id: r for r in rs.interpret(requests, new, "v").collect()}
    assert (found["m1"].event_type, found["m1"].company_key, found["m1"].role, found["m1"].confidence, found["m1"].needs_review) == ("offer", "acme", None, 0.85, False)
    assert (found["m2"].company, found["m2"].confidence, found["m2"].needs_review) == ("X", 0.3, True)
    assert (found["m3"].event_type, found["m3"].confidence) == ("unknown", 0.0) and found["m4"].event_type == "offer"


def test_errors(spark):
    rows = spark.createDataFrame([(429, None), (503, None), (403, "rateLimitExceeded"), (403, None), (401, None), (404, None)], "s int, r string")
    assert [x.c for x in rows.select(rs.error_class(F.col("s"), F.col("r")).alias("c")).collect()] == ["transient", "transient", "transient", "auth", "auth", "permanent"]


def test_fingerprint_follows_the_prompt():
    assert rs.fingerprint("a", "d", "q4") != rs.fingerprint("b", "d", "q4") and rs.fingerprint("a", "d", "q4").endswith("-d-q4")


def test_the_triage_gate_drops_what_is_no_job_mail(spark):
    said = [("k1", {"event_type": "Offer ", "company": "Bank", "role": "Saver", "is_job_application_email": False}), ("k2", {"event_type": "offer", "company": "Zürich Works", "is_job_application_email": True}), ("k3", {"event_type": "party"})]
    responses = spark.createDataFrame([(k, json.dumps(a)) for k, a in said], rs.RESPONSE)
    requests = spark.createDataFrame([("m1", "k1"), ("m2", "k2"), ("m3", "k3")], "message_id string, key string")
    messages = spark.createDataFrame([("m1", "a@x.lever.co", {}), ("m2", "a@x.lever.co", {}), ("m3", "a@x.lever.co", {})], "message_id string, from_email string, headers map<string,string>")
    found = {r.message_id: r for r in rs.interpret(requests, responses, "v", messages).collect()}
    assert (found["m1"].event_type, found["m1"].company, found["m1"].role, found["m1"].confidence, found["m1"].needs_review) == ("unknown", None, None, 0.3, True)
    assert found["m1"].evidence == ["model.type.unknown", "model.triage.not_job_mail", "ats.from.lever"]
    assert (found["m2"].event_type, found["m2"].company_key, found["m2"].ats, found["m2"].confidence) == ("offer", "zurich works", "lever", 0.85)
    assert (found["m3"].event_type, found["m3"].confidence, found["m3"].ats, found["m3"].evidence) == ("unknown", 0.0, None, ["model.failed"])
