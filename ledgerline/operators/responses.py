"""Classification by a language model: a keyed table of responses, the calls an injected function, and what a response says.

The call itself is any function from texts to JSON answers; it runs in batches on the executors, only for messages whose key
has no response yet. A failed call, an unreadable answer or a type outside the list gives a row of confidence zero. An answer may say
that the mail is none of an application's (the triage gate): then it is unknown, whatever fields the answer fills in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.sender import detect_vendor
from ledgerline.functions.text import clean_value, company_key, strip_accents
from ledgerline.schemas import EVENT_TYPES

#: Characters of a body that a prompt holds, and confidence by what an answer has.
BODY_CHARS = 2500
TYPED, WITH_COMPANY, WITH_ROLE, UNKNOWN = 0.70, 0.15, 0.10, 0.30

ANSWER = "event_type string, company string, role string, location string, is_job_application_email boolean"
RESPONSE = "key string, answer string"


def fingerprint(prompt: str, digest: str, quantization: str) -> str:
    """Version of a classifier: prompt, model digest and quantization."""
    return f"{hashlib.sha256(prompt.encode()).hexdigest()[:12]}-{digest}-{quantization}"


def request(messages: DataFrame, prompt: str, model: str) -> DataFrame:
    """(message_id, key, text): what is asked about each message, and the key under which its answer is kept."""
    text = F.concat_ws("\n", F.lit(prompt), F.concat(F.lit("From: "), F.coalesce("from_name", F.lit("")), F.lit(" <"), F.coalesce("from_email", F.lit("")), F.lit(">")), F.concat(F.lit("Subject: "), F.coalesce("subject", F.lit(""))), F.substring(F.coalesce("body_text", F.lit("")), 1, BODY_CHARS))
    return messages.select("message_id", text.alias("text")).withColumn("key", F.sha2(F.concat_ws("\x1f", F.lit(model), "text"), 256))


def ask(requests: DataFrame, responses: DataFrame, call: Callable[[list[str]], list[str | None]]) -> DataFrame:
    """(key, answer) to append to responses: the answers to requests that have none."""
    new = requests.select("key", "text").dropDuplicates(["key"]).join(responses.select("key"), "key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                answers = call(batch["text"].tolist())
            except Exception:  # fails closed: no answer is kept, so a later run asks again
                answers = [None] * len(batch)
            yield pd.DataFrame({"key": batch["key"], "answer": answers}).dropna()

    return new.mapInPandas(run, RESPONSE)


def interpret(requests: DataFrame, responses: DataFrame, version: str, messages: DataFrame | None = None) -> DataFrame:
    """One classification for each request, in the layout of the rules' ones; the vendor comes from messages' senders and headers, if given."""
    rows = requests.select("message_id", "key").join(responses, "key", "left").withColumn("a", F.from_json("answer", ANSWER))
    named = F.lower(F.trim("a.event_type"))
    mail = F.coalesce(F.col("a.is_job_application_email"), F.lit(True))
    kind = F.when(named.isin(EVENT_TYPES), F.when(mail, named).otherwise("unknown"))
    own = lambda c: F.when(kind.isNotNull() & mail, clean_value(F.col(f"a.{c}"))).alias(c)
    rows = rows.select("message_id", kind.alias("said"), mail.alias("mail"), own("company"), own("role"), own("location"))
    none = F.struct(F.lit(None).cast("string").alias("vendor"), F.array().cast("array<string>").alias("evidence"))
    if messages is None:
        rows = rows.withColumn("sender", none)
    else:
        senders = messages.select("message_id", detect_vendor(F.col("from_email"), F.col("headers")).alias("found"))
        rows = rows.join(senders, "message_id", "left").withColumn("sender", F.when(F.col("said").isNotNull(), F.coalesce("found", none)).otherwise(none))
    typed = F.coalesce(F.col("said") != "unknown", F.lit(False))
    bonus = F.when(F.col("company").isNotNull(), WITH_COMPANY).otherwise(0.0) + F.when(F.col("role").isNotNull(), WITH_ROLE).otherwise(0.0)
    score = F.when(F.col("said").isNull(), 0.0).when(~typed, UNKNOWN).otherwise(F.round(TYPED + bonus, 4))
    told = F.when(F.col("said").isNull(), F.lit("model.failed")).otherwise(F.concat(F.lit("model.type."), F.col("said")))
    fields = [F.when(F.col(c).isNotNull(), f"model.field.{c}") for c in ("company", "role")]
    evidence = F.concat(F.array_compact(F.array(told, F.when(~F.col("mail"), "model.triage.not_job_mail"), *fields)), F.col("sender.evidence"))
    return rows.select(
        "message_id",
        F.coalesce("said", F.lit("unknown")).alias("event_type"),
        "company",
        company_key(strip_accents(F.col("company"))).alias("company_key"),
        "role",
        "location",
        F.col("sender.vendor").alias("ats"),
        score.alias("confidence"),
        (~typed).alias("needs_review"),
        evidence.alias("evidence"),
        F.lit("model").alias("classifier_name"),
        F.lit(version).alias("classifier_version"),
    )


#: Reasons of a refusal that passes.
LIMITED = ["rateLimitExceeded", "userRateLimitExceeded", "quotaExceeded", "backendError"]


def error_class(status: Column, reason: Column) -> Column:
    """auth, transient or permanent: what a failed call of the mail API comes to."""
    limited = F.coalesce(reason.isin(LIMITED), F.lit(False))
    return F.when((status == 429) | (status >= 500) | ((status == 403) & limited), "transient").when(status.isin(401, 403), "auth").otherwise("permanent")
