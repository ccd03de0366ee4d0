"""Mail of known meaning, made of the customer table, and what each should be classified as, as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPANIES = ["Northwind Labs", "Quarry Systems", "Fjordworks", "Kestrel Robotics", "Lumen Grid"]
ROLES = ["Data Engineer", "Product Designer", "Backend Developer", "Site Reliability Engineer"]

#: Sender's name and address, reply-to, subject, body; then type, company, role, location, vendor and confidence as they should be.
#: {c}, {r} and {d} stand for a company, a role and the company's host name.
MAILS: list[tuple] = [
    ("{c}", "no-reply@greenhouse.io", None, "Thank you for applying to {c}", "Hi,\nWe have received your application for the {r} role.\n", "application_received", "{c}", "{r}", None, "greenhouse", 1.0),
    ("{c}", "no-reply@greenhouse.io", None, "Thank you for applying to {c}", "Unfortunately we will not be moving forward with your application.\n", "rejection", "{c}", None, None, "greenhouse", 0.6),
    ("Mara Lind", "mara@{d}.com", None, "Interview invitation: {r}", "We would like to invite you to an interview at our office in Lisbon. Please pick a time.\n", "interview", "{c}", None, "Lisbon", None, 0.6),
    ("Talent", "jobs@{d}.ai", None, "Your coding challenge", "Please complete the coding challenge on HackerRank. You have 3 days to complete it.\n", "assessment", "{c}", None, None, None, 0.6),
    ("Ines Roy", "ines@{d}.com", None, "Your offer", "We are delighted to offer you the {r} position. Your start date is May 4.\n", "offer", "{c}", None, None, None, 0.6),
    ("{c} Recruiting", "hello@{d}.io", None, "An exciting opportunity", "I came across your profile. Would you be open to a chat?\n", "recruiter_outreach", "{c}", None, None, None, 0.6),
    ("Deli Weekly", "news@deli.example", None, "Five soups for autumn", "Unfortunately the pumpkins are late this year.\n", "unknown", None, None, None, None, 0.0),
    ("{c}", "notify@mail.example", "x@hire.lever.co", "Application withdrawn", "Your application has been withdrawn at your request.\n", "withdrawn", "{c}", None, None, "lever", 1.0),
    ("Mara Lind", "mara@gmail.com", None, "Thanks for applying to {c} for the {r} role", "We are reviewing your application.\n", "application_received", "{c}", None, None, None, 0.65),
    ("Mara Lind", "mara@gmail.com", None, "{r} at {c}", "Thank you for your interest in the {r} role. The position has been filled.\nLocation: Porto, PT\n", "rejection", "{c}", "{r}", "Porto", None, 0.2),
    ("{c} Hiring Team", "jobs@{d}.com", None, "Application received | {r}", "We got your application.\nBased in Oslo\n", "application_received", "{c}", "{r}", "Oslo", None, 0.6),
    ("no-reply", "no-reply@{d}.com", None, "Schedule your phone interview", "Please share your availability for a call.\n\nThe {c} Talent Team\n", "interview", "{c}", None, None, None, 0.65),
    ("Priya Nair", "priya@{d}.com", None, "Reaching out", "I'm a technical recruiter with {c}. We're hiring a {r} and found your profile.\n", "recruiter_outreach", "{c}", None, None, None, 0.2),
    ("Jonas Falk via Workday", "acme@myworkday.com", None, "We regret: position filled (Remote)", "The role has been filled.\nPosition: {r}\n", "rejection", "Jonas Falk", "{r}", "Remote", "workday", 1.0),
]
FIELDS = ["from_name", "from_email", "reply_to", "subject", "body_text", "event_type", "company", "role", "location", "ats"]

#: Sender's address and reply-to; then the vendor, its evidence and the sender's label as they should be.
VENDOR_MAILS: list[tuple[str | None, str | None, str | None, str, str | None]] = [
    ("a@mail.greenhouse.io", None, "greenhouse", "ats.from.greenhouse", None),
    ("a@notgreenhouse.io", None, None, "", "notgreenhouse"),
    ("a@careers.acme.com", "x@hire.lever.co", "lever", "ats.replyto.lever", "acme"),
    ("a@ashbyhq.com", "b@ashbyhq.com", "ashby", "ats.from.ashby,ats.replyto.ashby", None),
    ("a@jobs.lever.co", "b@workable.com", "lever", "ats.from.lever", None),
    ("a@gmail.com", None, None, "", None),
    ("nobody", None, None, "", None),
    (None, "https://x.angel.co/u", "wellfound", "ats.replyto.wellfound", None),
]

#: For each rule words that fire it if no more than so many words lie between the first and the last of them.
PROBES = [
    ("wdr.subject.application_withdrawn", "application", "withdrawn", 2), ("wdr.body.you_withdrew", "you", "withdrew", 2), ("wdr.body.application_withdrawn", "application", "withdrawn", 3), ("wdr.body.at_your_request", "at your", "request", 1),
    ("rej.subject.not_moving_forward", "not", "moving forward", 2), ("rej.subject.unsuccessful", "not", "successful", 1), ("rej.subject.position_filled", "role", "filled", 3), ("rej.body.not_moving_forward", "not", "proceed with", 2),
    ("rej.body.decided_not_to", "decided not", "pursue", 1), ("rej.body.other_candidates", "other", "applicants", 2), ("rej.body.pursue_other_candidates", "pursuing other", "candidates", 2), ("rej.body.unfortunately", "unfortunately", "not offer", 8),
    ("rej.body.not_selected", "not", "shortlisted", 2), ("rej.body.no_longer_under_consideration", "no longer", "considered", 2), ("rej.body.not_a_match", "not", "match", 3), ("rej.body.position_filled", "vacancy", "closed", 3),
    ("rej.body.keep_resume_on_file", "keep cv", "file", 2), ("rej.body.wish_you_the_best", "wish", "luck", 4), ("off.subject.offer", "letter", "employment", 1), ("off.body.pleased_to_offer", "delighted", "offer", 2),
    ("off.body.extend_an_offer", "extend", "offer", 2), ("off.body.offer_letter", "offer", "letter", 0), ("off.body.start_date", "your start", "date", 0), ("itv.subject.interview_invitation", "invitation", "interview", 3),
    ("itv.subject.schedule_interview", "schedule", "interview", 3), ("itv.subject.phone_screen", "phone", "screen", 0), ("itv.subject.onsite", "onsite", "interview", 1), ("itv.subject.next_steps", "next", "steps", 0),
    ("itv.body.invite_to_interview", "invite", "interview", 4), ("itv.body.select_a_time", "pick", "timeslot", 1), ("itv.body.schedule_link", "link", "book", 4), ("itv.body.availability", "share", "availability", 2),
    ("itv.body.interview_scheduled", "interview", "confirmed", 1), ("itv.body.speak_with", "speak with", "engineers", 2), ("asm.subject.online_assessment", "coding", "exercise", 1), ("asm.subject.take_home", "take", "home", 0),
    ("asm.body.complete_the_assessment", "complete", "assessment", 3), ("asm.body.assessment_vendor", "codility", "", 99), ("asm.body.time_limit", "you have 90 minutes", "complete", 2), ("ack.subject.thanks_for_applying", "thanks", "applying", 3),
    ("ack.subject.application_received", "application", "confirmed", 1), ("ack.subject.we_got_your_application", "got", "application", 1), ("ack.body.thanks_for_applying", "appreciate", "interest", 3), ("ack.body.application_received", "application", "received", 2),
    ("ack.body.reviewing_application", "reviewing", "application", 1), ("ack.body.application_submitted", "application", "submitted", 3), ("rec.subject.opportunity", "exciting", "opportunity", 0), ("rec.subject.reaching_out", "reaching", "out", 0),
    ("rec.body.came_across_your_profile", "found", "profile", 2), ("rec.body.i_am_a_recruiter", "i'm", "recruiter", 2), ("rec.body.would_you_be_interested", "would you", "interested", 1), ("rec.body.we_are_hiring", "we're", "hiring", 1),
]


def _pick(values: list, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x).cast("string") for x in values]), (at + 1).cast("int"))


def _sql_pick(values: list, at: str) -> str:
    return f"([{', '.join('NULL' if x is None else _quoted(x) for x in values)}]::VARCHAR[])[({at}) + 1]"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def dealt(customer: DataFrame) -> DataFrame:
    """customer, in two tasks a core at least: a small file is one task, however long the mails made of it take."""
    tasks = 2 * customer.sparkSession.sparkContext.defaultParallelism
    return customer if customer.rdd.getNumPartitions() >= tasks else customer.repartition(tasks, "c_custkey")


def messages(customer: DataFrame) -> DataFrame:
    """A message for each customer, by its number."""
    customer, k = dealt(customer), F.col("c_custkey")
    company, role = _pick(COMPANIES, k % len(COMPANIES)), _pick(ROLES, k % 7 % len(ROLES))
    host = F.replace(F.lower(company), F.lit(" "), F.lit("-"))

    def field(i: int) -> Column:
        text = _pick([m[i] for m in MAILS], k % len(MAILS))
        for mark, value in (("{c}", company), ("{r}", role), ("{d}", host)):
            text = F.replace(text, F.lit(mark), value)
        return text

    none = F.lit(None).cast("string")
    headers = F.when(field(2).isNotNull(), F.create_map(F.lit("reply-to"), field(2))).otherwise(F.create_map().cast("map<string,string>"))
    return customer.select(F.concat(F.lit("m"), k.cast("string")).alias("message_id"), F.concat(F.lit("t"), k.cast("string")).alias("thread_id"), F.timestamp_seconds(F.lit(1704067200) + k).alias("received_at"), field(1).alias("from_email"), field(0).alias("from_name"), none.alias("to_email"), field(3).alias("subject"), field(4).alias("body_text"), F.lit("").alias("snippet"), F.array(F.lit("INBOX")).alias("labels"), headers.alias("headers"))


def expected_sql() -> str:
    """What classify should say of messages(customer)."""
    company, role = _sql_pick(COMPANIES, f"c_custkey % {len(COMPANIES)}"), _sql_pick(ROLES, f"c_custkey % 7 % {len(ROLES)}")
    t = f"c_custkey % {len(MAILS)}"
    field = lambda i: f"replace(replace({_sql_pick([m[i] for m in MAILS], t)}, '{{c}}', {company}), '{{r}}', {role})"
    score = f"([{', '.join(str(m[10]) for m in MAILS)}]::DOUBLE[])[({t}) + 1]"
    return f"""plain WITH x AS (SELECT concat('m', c_custkey) AS message_id, {field(5)} AS event_type, {field(6)} AS company, {field(7)} AS role, {field(8)} AS location, {field(9)} AS ats, {score} AS confidence FROM customer)
    SELECT message_id, event_type, company, lower(company) AS company_key, role, location, ats, confidence, confidence < 0.6 OR company IS NULL AS needs_review FROM x"""


def rule_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, rule_id, subject, body): a rule's words with up to ten long words of the document between them, where the rule looks."""
    at = F.col("doc_id") % len(PROBES)
    field = lambda i: _pick([p[i] for p in PROBES], at)
    between = F.slice(F.filter(F.split("text", " "), lambda w: w.rlike("^[a-z]{10,}$")), F.lit(1), (F.col("doc_id") % 11).cast("int"))
    said = F.array_join(F.filter(F.concat(F.array(field(1)), between, F.array(field(2))), lambda w: w != ""), " ")
    rows = documents.filter("text IS NOT NULL").select("doc_id", field(0).alias("rule_id"), said.alias("said"), F.split_part(field(0), F.lit("."), F.lit(2)).alias("scope"))
    return rows.select("doc_id", "rule_id", *[F.when(F.col("scope") == x, F.col("said")).otherwise("").alias(x) for x in ("subject", "body")])


def rules_sql() -> str:
    """Whether each document's rule fires: it does if no more words lie between than the probe allows."""
    at = f"doc_id % {len(PROBES)}"
    most = f"([{', '.join(str(p[3]) for p in PROBES)}])[({at}) + 1]"
    return f"""plain SELECT doc_id, {_sql_pick([p[0] for p in PROBES], at)} AS rule_id, least(len(list_filter(string_split(text, ' '), lambda w: regexp_full_match(w, '[a-z]{{10,}}'))), doc_id % 11) <= {most} AS fires
    FROM documents WHERE text IS NOT NULL"""


#: Mails around a company, a role and a place ({c}, {r}, {p}): subject, body; then what is to be found.
FRAMES = [
    ("Thanks for applying to {c}", "We have your application for the {r} role and will write soon.", "{c}", "{r}", None),
    ("{r} at {c}", "Good news.\nLocation: {p}, and elsewhere\n", "{c}", "{r}", "{p}"),
    ("Hello", "Your application to {c} was received. We liked your interest in the {r} position, and more.", "{c}", "{r}", None),
    ("Interview with {c}", "Our office in {p} is open.\nPosition: {r}\nBye", "{c}", "{r}", "{p}"),
    ("Update ({p}, TX)", "Nothing new so far.\n\nThe {c} Talent Team\n", "{c}", None, "{p}, TX"),
]


def extraction_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, subject, body): a frame filled with the first words of six to twelve small letters of each document that has four of them."""
    words = F.filter(F.split("text", " "), lambda w: w.rlike("^[a-z]{6,12}$"))
    rows = documents.select("doc_id", F.transform(words, F.initcap).alias("w")).filter(F.size("w") >= 4)
    values = {"{c}": F.concat_ws(" ", F.col("w")[0], F.col("w")[1]), "{r}": F.concat_ws(" ", F.col("w")[2], F.lit("Engineer")), "{p}": F.col("w")[3]}

    def field(i: int) -> Column:
        text = _pick([x[i] for x in FRAMES], F.col("doc_id") % len(FRAMES))
        for mark, value in values.items():
            text = F.replace(text, F.lit(mark), value)
        return text

    return rows.select("doc_id", field(0).alias("subject"), field(1).alias("body"))


def extraction_sql() -> str:
    """What was put into the frames."""
    cap = lambda i: f"upper(w[{i}][1:1]) || w[{i}][2:]"
    at = f"doc_id % {len(FRAMES)}"
    field = lambda i: f"replace(replace(replace({_sql_pick([x[i] for x in FRAMES], at)}, '{{c}}', {cap(1)} || ' ' || {cap(2)}), '{{r}}', {cap(3)} || ' Engineer'), '{{p}}', {cap(4)})"
    return f"""plain WITH d AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: regexp_full_match(x, '[a-z]{{6,12}}')) AS w FROM documents)
    SELECT doc_id, {field(2)} AS company, {field(3)} AS role, {field(4)} AS location FROM d WHERE len(w) >= 4"""


def vendor_mails(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey") % len(VENDOR_MAILS)
    reply = _pick([m[1] for m in VENDOR_MAILS], k)
    return customer.select("c_custkey", _pick([m[0] for m in VENDOR_MAILS], k).alias("from_email"), F.when(reply.isNotNull(), F.create_map(F.lit("reply-to"), reply)).alias("headers"))


def vendors_sql() -> str:
    field = lambda i: _sql_pick([m[i] for m in VENDOR_MAILS], f"c_custkey % {len(VENDOR_MAILS)}")
    return f"plain SELECT c_custkey, {field(2)} AS ats, {field(3)} AS evidence, {field(4)} AS label FROM customer"
