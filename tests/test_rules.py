import pytest
from pyspark.sql import functions as F

from ledgerline.operators import concepts, rules
from ledgerline.operators.concepts import encoded
from ledgerline.plans import mails
from ledgerline.plans.mails import PROBES
from ledgerline.schemas import EVENT_TYPES, MESSAGE
from tests.mails import rows
from tests.ruletexts import RULE_TEXTS

COLUMNS = [x.split()[0] for x in MESSAGE.replace("map<string,string>", "map").split(", ")]


def messages(spark, found):
    return spark.createDataFrame([tuple(r.get(c) for c in COLUMNS) for r in found], MESSAGE)


@pytest.fixture(scope="module")
def classified(spark):
    return {r.message_id: r for r in rules.classify(messages(spark, rows())).collect()}


@pytest.mark.parametrize("mail", rows(), ids=lambda m: m["message_id"])
def test_golden(classified, mail):
    found = classified[mail["message_id"]]
    assert (found.event_type, found.company, found.role, found.ats) == tuple(mail[k] for k in ("event_type", "company", "role", "ats"))


def test_rejection_outranks_the_acknowledgement_it_restates(classified):
    assert {"ack.subject.thanks_for_applying", "rej.body.not_moving_forward"} <= set(classified["a2"].evidence)


def test_unknown_has_no_fields_and_no_confidence(classified):
    found = classified["a7"]
    assert (found.confidence, found.company, found.company_key, found.needs_review) == (0.0, None, None, True)


def test_confidence_adds_up(classified):
    assert classified["a1"].confidence == 1.0  # vendor 35, subject 40, body 20, company 5
    assert classified["a5"].confidence == 0.6  # subject 40, body 20


def test_table():
    assert len(rules.RULES) == 52 and len({r.rule_id for r in rules.RULES}) == 52
    assert [sum(r.event_type == t for r in rules.RULES) for t in EVENT_TYPES] == [4, 14, 5, 11, 5, 7, 6, 0]


FIRES = RULE_TEXTS


def test_every_rule_fires_on_its_text_and_not_beside_it(spark):
    assert set(FIRES) == {r.rule_id for r in rules.RULES}
    found = spark.createDataFrame([(k, i, t) for k, pair in FIRES.items() for i, t in enumerate(pair)], "id string, i int, text string")
    got = {(r.id, r.i): r.ids for r in found.select("id", "i", rules.fired(*[encoded(F.array("text"))[0]] * 2).alias("ids")).collect()}
    assert [k for k in FIRES if k not in got[k, 0]] == [] and [k for k in FIRES if k in got[k, 1]] == []


def test_every_rule_is_probed():
    assert [p[0] for p in PROBES] == [r.rule_id for r in rules.RULES]
    assert set(rules.SAYINGS) == {r.rule_id for r in rules.RULES}


def test_a_word_has_one_concept():
    words = [w for x in concepts.CONCEPTS.values() for w in x.split()]
    assert len(words) == len(set(words)) == len([w for w in words if w == w.lower()])


@pytest.mark.parametrize("saying,good,bad", [("not 2 go", ["not going", "not a b moves"], ["not a b c going", "not. going", "go not"]), ("no 0 longer", ["no longer"], ["no much longer"]), ("have 0 number 0 unit", ["has 90 minutes"], ["has few minutes"])])
def test_sayings(spark, saying, good, bad):
    frame = spark.createDataFrame([(x,) for x in good + bad], "text string")
    got = {r.text: r.hit for r in frame.select("text", concepts.encoded(F.array("text"))[0].rlike(concepts.heard(saying)).alias("hit")).collect()}
    assert got == {x: x in good for x in good + bad}


EXTRACTED = [
    ("Thanks for applying to Coca-Cola", "", "Coca-Cola", None, None),
    ("Your application to Bank of Hours", "", "Bank of Hours", None, None),
    ("Hello", "Thank you for applying to Booking.com! We will write.", "Booking.com", None, None),
    ("Hello", "Bye,\nThe Quarry & Sons Recruiting Team\n", "Quarry & Sons", None, None),
    ("Hello", "You would join the team at Lumen Grid, as we said.", "Lumen Grid", None, None),
    ("Application for Senior Data Engineer, Platform", "", None, "Senior Data Engineer, Platform", None),
    ("News | Head of Growth", "", None, "Head of Growth", None),
    ("We met at noon", "your interest in the Growth Marketing role", None, "Growth Marketing", None),
    ("Welcome at Acme", "Job title: Cook (nights)\nLocation: Porto, PT", "Acme", "Cook (nights", "Porto"),
    ("Update (Austin, TX)", "thanks", None, None, "Austin, TX"),
    ("Update", "Our office in São Paulo is large", None, None, "São Paulo"),
    ("Your offer at our place", "The Senior Backend Engineer role has been filled", None, None, None),
]


def test_extraction(spark):
    frame = spark.createDataFrame([(i, s, b) for i, (s, b, *_) in enumerate(EXTRACTED)], "i int, subject string, body string")
    none = F.lit(None).cast("string")
    hear = concepts.encoded(F.array(F.lower("subject"), F.lower("body")))
    company = rules.extract_company(F.col("subject"), F.col("body"), none, none, none, hear[0], hear[1])
    got = frame.select("i", company["value"].alias("c"), rules.extract_role(F.col("subject"), F.col("body"), none)["value"].alias("r"), rules.extract_location(F.col("subject"), F.col("body"))["value"].alias("l")).collect()
    assert {r.i: (r.c, r.r, r.l) for r in got} == {i: tuple(x[2:]) for i, x in enumerate(EXTRACTED)}


def test_composite_takes_a_strictly_more_confident_fallback(spark):
    make = lambda xs: spark.createDataFrame(xs, "message_id string, confidence double, company string")
    primary, fallback = make([("a", 0.9, "p"), ("b", 0.4, "p"), ("c", 0.4, "p"), ("d", 0.1, "p")]), make([("a", 1.0, "f"), ("b", 0.5, "f"), ("c", 0.4, "f")])
    assert {r.message_id: r.company for r in rules.composite(primary, fallback).collect()} == {"a": "p", "b": "f", "c": "p", "d": "p"}


def test_messages_of_one_file_are_dealt_to_many_tasks(spark):
    customers = spark.range(200).withColumnRenamed("id", "c_custkey").coalesce(1)
    found = rules.classify(mails.messages(customers)).groupBy(F.spark_partition_id()).count().collect()
    assert len(found) == 2 * spark.sparkContext.defaultParallelism and sum(r["count"] for r in found) == 200
