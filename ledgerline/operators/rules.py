"""Message classification: a rule table scored over encoded texts in one projection, precedence, extraction and confidence."""

from __future__ import annotations

from functools import cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.sender import DEPARTMENTS, clean_capture, clean_sender_name, detect_vendor, looks_like_person, sender_domain_label
from ledgerline.functions.text import company_key, let, normalize_text, one_of, strip_accents
from ledgerline.operators.concepts import encoded, heard
from ledgerline.schemas import EVENT_TYPES

VERSION = "1"


class Rule(NamedTuple):
    rule_id: str
    event_type: str
    scope: str  # subject or body
    pattern: str  # on the text that fired is given
    high_precision: bool = False


#: The events' rules in evidence order (id, type, scope, whether its precision is high).
TABLE: list[tuple[str, str, str, bool]] = [
    ("wdr.subject.application_withdrawn", "withdrawn", "subject", True),
    ("wdr.body.you_withdrew", "withdrawn", "body", False),
    ("wdr.body.application_withdrawn", "withdrawn", "body", False),
    ("wdr.body.at_your_request", "withdrawn", "body", False),
    ("rej.subject.not_moving_forward", "rejection", "subject", True),
    ("rej.subject.unsuccessful", "rejection", "subject", True),
    ("rej.subject.position_filled", "rejection", "subject", True),
    ("rej.body.not_moving_forward", "rejection", "body", False),
    ("rej.body.decided_not_to", "rejection", "body", False),
    ("rej.body.other_candidates", "rejection", "body", False),
    ("rej.body.pursue_other_candidates", "rejection", "body", False),
    ("rej.body.unfortunately", "rejection", "body", False),
    ("rej.body.not_selected", "rejection", "body", False),
    ("rej.body.no_longer_under_consideration", "rejection", "body", False),
    ("rej.body.not_a_match", "rejection", "body", False),
    ("rej.body.position_filled", "rejection", "body", False),
    ("rej.body.keep_resume_on_file", "rejection", "body", False),
    ("rej.body.wish_you_the_best", "rejection", "body", False),
    ("off.subject.offer", "offer", "subject", True),
    ("off.body.pleased_to_offer", "offer", "body", False),
    ("off.body.extend_an_offer", "offer", "body", False),
    ("off.body.offer_letter", "offer", "body", False),
    ("off.body.start_date", "offer", "body", False),
    ("itv.subject.interview_invitation", "interview", "subject", True),
    ("itv.subject.schedule_interview", "interview", "subject", True),
    ("itv.subject.phone_screen", "interview", "subject", True),
    ("itv.subject.onsite", "interview", "subject", True),
    ("itv.subject.next_steps", "interview", "subject", False),
    ("itv.body.invite_to_interview", "interview", "body", False),
    ("itv.body.select_a_time", "interview", "body", False),
    ("itv.body.schedule_link", "interview", "body", False),
    ("itv.body.availability", "interview", "body", False),
    ("itv.body.interview_scheduled", "interview", "body", False),
    ("itv.body.speak_with", "interview", "body", False),
    ("asm.subject.online_assessment", "assessment", "subject", True),
    ("asm.subject.take_home", "assessment", "subject", True),
    ("asm.body.complete_the_assessment", "assessment", "body", False),
    ("asm.body.assessment_vendor", "assessment", "body", False),
    ("asm.body.time_limit", "assessment", "body", False),
    ("ack.subject.thanks_for_applying", "application_received", "subject", True),
    ("ack.subject.application_received", "application_received", "subject", True),
    ("ack.subject.we_got_your_application", "application_received", "subject", True),
    ("ack.body.thanks_for_applying", "application_received", "body", False),
    ("ack.body.application_received", "application_received", "body", False),
    ("ack.body.reviewing_application", "application_received", "body", False),
    ("ack.body.application_submitted", "application_received", "body", False),
    ("rec.subject.opportunity", "recruiter_outreach", "subject", True),
    ("rec.subject.reaching_out", "recruiter_outreach", "subject", False),
    ("rec.body.came_across_your_profile", "recruiter_outreach", "body", False),
    ("rec.body.i_am_a_recruiter", "recruiter_outreach", "body", False),
    ("rec.body.would_you_be_interested", "recruiter_outreach", "body", False),
    ("rec.body.we_are_hiring", "recruiter_outreach", "body", False),
]
#: What each rule wants to hear within a sentence (see concepts.py).
SAYINGS: dict[str, list[str]] = {
    "wdr.subject.application_withdrawn": ["application 2 withdrawn/withdraw", "withdrawn/withdraw 2 application"],
    "wdr.body.you_withdrew": ["you/you_have 2 withdrawn"],
    "wdr.body.application_withdrawn": ["application 3 withdrawn"],
    "wdr.body.at_your_request": ["per 0 your 1 request"],
    "rej.subject.not_moving_forward": ["not 2 go 1 onward"],
    "rej.subject.unsuccessful": ["failed", "not 1 success"],
    "rej.subject.position_filled": ["job 3 closed"],
    "rej.body.not_moving_forward": ["not 2 go 2 onward/next", "not 2 go 1 with"],
    "rej.body.decided_not_to": ["decided 0 not 1 go/pursue"],
    "rej.body.other_candidates": ["other 2 person"],
    "rej.body.pursue_other_candidates": ["pursue 1 other 2 person", "go 2 with 1 other 2 person"],
    "rej.body.unfortunately": ["regret 8 not 3 go/chosen/consider/match/offer/pursue", "regret 8 other 2 person", "regret 8 failed", "regret 8 no 0 longer", "regret 8 job 3 closed"],
    "rej.body.not_selected": ["not 2 chosen"],
    "rej.body.no_longer_under_consideration": ["no 0 longer 2 consider"],
    "rej.body.not_a_match": ["not 3 match"],
    "rej.body.position_filled": ["job 3 closed"],
    "rej.body.keep_resume_on_file": ["keep 2 paper/application 2 file"],
    "rej.body.wish_you_the_best": ["wish 4 best"],
    "off.subject.offer": ["your 0 offer", "work/job 0 offer", "offer 0 letter", "offer/letter 1 work"],
    "off.body.pleased_to_offer": ["glad 2 offer/give"],
    "off.body.extend_an_offer": ["give 2 offer"],
    "off.body.offer_letter": ["offer 0 letter", "pay/offer 0 package"],
    "off.body.start_date": ["your/planned 0 begin 0 date"],
    "itv.subject.interview_invitation": ["invite 3 interview", "interview 0 invite"],
    "itv.subject.schedule_interview": ["plan 3 interview/screen"],
    "itv.subject.phone_screen": ["phone/recruiter 0 screen"],
    "itv.subject.onsite": ["onsite 1 interview", "virtual 0 onsite", "final 0 round"],
    "itv.subject.next_steps": ["next 0 steps"],
    "itv.body.invite_to_interview": ["invite 4 interview/talk/screen"],
    "itv.body.select_a_time": ["pick/plan 1 time"],
    "itv.body.schedule_link": ["link 4 plan"],
    "itv.body.availability": ["tell 2 free", "tell 1 your 1 time"],
    "itv.body.interview_scheduled": ["interview 1 settled"],
    "itv.body.speak_with": ["speak/talk 0 with 2 crew/recruiter"],
    "asm.subject.online_assessment": ["skill 1 test"],
    "asm.subject.take_home": ["takehome", "take 0 home"],
    "asm.body.complete_the_assessment": ["finish 3 test"],
    "asm.body.assessment_vendor": ["maker"],
    "asm.body.time_limit": ["you 1 have 0 number 0 unit 2 finish", "you_have 1 number 0 unit 2 finish"],
    "ack.subject.thanks_for_applying": ["thanks 3 apply/application"],
    "ack.subject.application_received": ["application 1 got/sent/settled", "got 1 application"],
    "ack.subject.we_got_your_application": ["got 1 application"],
    "ack.body.thanks_for_applying": ["thanks 3 apply/application/interest"],
    "ack.body.application_received": ["have/we/we_have 0 got 1 application", "application 2 got"],
    "ack.body.reviewing_application": ["review 1 it/application/paper"],
    "ack.body.application_submitted": ["application 3 sent"],
    "rec.subject.opportunity": ["attract/job 0 chance"],
    "rec.subject.reaching_out": ["reaching 0 out"],
    "rec.body.came_across_your_profile": ["found 2 paper"],
    "rec.body.i_am_a_recruiter": ["i_am 2 recruiter", "i 0 am 2 recruiter", "i_am 2 talent 0 partner"],
    "rec.body.would_you_be_interested": ["would 0 you 1 open", "are 0 you 0 open 0 to"],
    "rec.body.we_are_hiring": ["we_are 1 hiring", "we 0 are 1 hiring"],
}
#: The rules over texts that are encoded as concepts.
RULES: list[Rule] = [Rule(i, event_type, scope, heard(*SAYINGS[i]), high) for i, event_type, scope, high in TABLE]

# What names are made of, in the original text: case tells them from the words around, so no list of words does.
_WORD = r"[\p{Lu}\p{N}][\p{L}\p{N}&'’+-]*(?:\.[\p{L}\p{N}]+)*"
NAME = rf"{_WORD}(?:[ \t]+(?:(?:&|and|of)[ \t]+)?{_WORD}){{0,6}}"
#: A title has an occupation: a capitalized word with the ending of one, or a few words without such an ending.
_OCCUPATION = r"(?:\p{Lu}\p{L}*(?:er|or|ist|ant|ian|yst|ect|ive|ate)|Lead|Intern|Chief|Head|Hand|Clerk|Nurse|Cook|Chef|Counsel|Fellow|Staff)s?\b"
_TITLE_WORD = r"[\p{Lu}\p{N}][\p{L}\p{N}&'’+#./-]*"
TITLE = rf"(?:{_TITLE_WORD}[ \t]+){{0,7}}{_OCCUPATION}(?:[ \t]+(?:of[ \t]+)?{_TITLE_WORD}){{0,3}}(?:,[ \t]+{_TITLE_WORD}(?:[ \t]+{_TITLE_WORD}){{0,2}})?"
_BEFORE_JOB = rf"{_TITLE_WORD}(?:[ \t]+{_TITLE_WORD}){{0,7}}(?=[ \t]+(?i:job|opening|position|role)\b)"
_THE = r"(?:(?i:the|our|an?)[ \t]+)?"
#: The word before "at", "to" or "with" and a name, and what it makes of the name: (words, rule in a subject, rule in a body).
CUES = [
    ("applying", "applying apply applied", "co.subject.applying_to", "co.body.applying_to"),
    ("application", "application", "co.subject.application_at", "co.body.application_to"),
    ("talk", "call chat conversation interview screen", "co.subject.interview_with", None),
    ("place", "here hiring opening opportunity position recruiter role team", None, "co.body.here_at"),
]
#: Company rules that earn the confidence weight of a company.
PRECISE_COMPANY = ["co.ats.sender_name", "co.subject.applying_to", "co.subject.application_at", "co.body.applying_to", "co.body.application_to", "co.body.signature"]
#: Captures that are filler.
GENERIC_COMPANY = "a an application job our position role the this us you your".split()
GENERIC_ROLE = "application applying interview it job opening opportunity position role the this us you your".split()

#: Weights in hundredths.
WEIGHTS = {"vendor": 35, "subject": 40, "body": 20, "company": 5, "adjacent": -20}
THRESHOLD = 0.60


def fired(subject: Column, body: Column, rules: list[Rule] | None = None) -> Column:
    """Ids of all rules that match the subject or body, in table order; RULES read encoded texts, other tables what they are made for."""
    ids = [F.when((subject if r.scope == "subject" else body).rlike(r.pattern), r.rule_id) for r in (rules or RULES)]
    return F.array_compact(F.array(*ids))


def ranks_of(ids: Column, rules: list[Rule] | None = None) -> Column:
    """Distinct precedence ranks of the rules that fired, ascending."""
    of = lambda t: F.split(F.lit("\n".join(r.rule_id for r in (rules or RULES) if r.event_type == t)), "\n")
    types = {r.event_type for r in (rules or RULES)}
    ranks = [F.when(F.arrays_overlap(ids, of(t)), F.lit(i)) for i, t in enumerate(EVENT_TYPES) if t in types]
    return F.array_compact(F.array(*ranks))


def winner(ranks: Column) -> Column:
    """The type of highest precedence; unknown if no rule fired."""
    return F.coalesce(F.element_at(F.lit(EVENT_TYPES), F.array_min(ranks) + 1), F.lit("unknown"))


def confidence(event_type: Column, ids: Column, ranks: Column, vendor: Column, precise_company: Column, rules: list[Rule] | None = None) -> Column:
    """Additive score in hundredths, clamped to 0..1; unknown is 0."""
    rules = rules or RULES
    pick = lambda test: F.exists(ids, lambda x: F.coalesce(*[F.when(event_type == t, one_of(x, [r.rule_id for r in rules if r.event_type == t and test(r)])) for t in EVENT_TYPES]))
    adjacent = F.exists(ranks, lambda r: F.array_contains(ranks, r + 1))
    parts = {
        "vendor": vendor.isNotNull(),
        "subject": pick(lambda r: r.scope == "subject" and r.high_precision),
        "body": pick(lambda r: r.scope == "body"),
        "company": precise_company,
        "adjacent": adjacent,
    }
    total = sum((F.when(v, WEIGHTS[k]).otherwise(0) for k, v in parts.items()), F.lit(0))
    return F.when(event_type == "unknown", 0.0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), total)) / 100.0)


def _named(value: Column, rule_id: str) -> Column:
    """struct(value, rule), or null for no value."""
    return let(value, lambda v: F.when(v.isNotNull(), F.struct(v.alias("value"), F.lit(rule_id).alias("rule"))))


def clean_company(raw: Column) -> Column:
    """A name with its edges stripped; null for filler."""
    return let(clean_capture(raw), lambda x: F.when(~one_of(F.lower(x), GENERIC_COMPANY), x))


def clean_role(raw: Column) -> Column:
    """A title with its edges stripped; null for filler."""
    return let(clean_capture(raw), lambda x: F.when(~one_of(F.lower(x), GENERIC_ROLE), x))


def named_places(text: Column) -> Column:
    """(cue, name) of each word before "at", "to" or "with" and a name, in order."""
    found = F.regexp_extract_all(text, F.lit(rf"\p{{L}}+[ \t]+(?i:at|to|with)[ \t]+{_THE}{NAME}"), F.lit(0))
    part = lambda x, i: F.regexp_extract(x, rf"^(\p{{L}}+)[ \t]+(?i:at|to|with)[ \t]+{_THE}({NAME})$", i)
    return F.transform(found, lambda x: F.struct(F.lower(part(x, 1)).alias("cue"), part(x, 2).alias("name")))


def _after_cue(places: Column, subject: bool, thanks: Column) -> list[Column]:
    """For each kind of cue with a rule the first name that follows one."""
    out = []
    for kind, words, in_subject, in_body in CUES:
        rule = in_subject if subject else in_body
        if rule is None:
            continue
        name = F.get(F.filter(places, lambda x: one_of(x["cue"], words.split())), 0)["name"]  # noqa: B023
        if kind == "applying":  # precise only behind thanks; else it says as much as "application at"
            out.append(let(clean_company(name), lambda v: F.when(v.isNotNull(), F.struct(v.alias("value"), F.when(thanks, rule).otherwise(CUES[1][2 if subject else 3]).alias("rule")))))  # noqa: B023
        else:
            out.append(_named(clean_company(name), rule))
    return out


def signature(body: Column) -> Column:
    """struct(value, rule) of the last line that is a team's name: departments before the word tell more than the word alone."""
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: x.rlike(rf"^(?i:the[ \t]+)?{NAME}(?i:[ \t]+(?:crew|partners?|team))$"))

    def of(line: Column) -> Column:
        words = F.filter(F.split(line, "[ \t]+"), lambda w: F.lower(w) != "the")
        kept = F.array_max(F.transform(words, lambda w, i: F.when(~one_of(F.lower(w), [*DEPARTMENTS, "crew", "partner", "partners", "team", "university"]), i + 1).otherwise(0)))
        return let(F.struct(words.alias("words"), F.coalesce(kept, F.lit(0)).alias("n")), lambda p: F.struct(
            clean_company(F.array_join(F.slice(p["words"], F.lit(1), p["n"]), " ")).alias("value"),
            F.when(F.size(p["words"]) - p["n"] > 1, "co.body.signature").otherwise("co.body.team_signature").alias("rule"),
        ))

    return let(of(F.get(lines, F.size(lines) - 1)), lambda x: F.when(x["value"].isNotNull(), x))


def extract_company(subject: Column, body: Column, from_name: Column, from_email: Column, vendor: Column, heard_subject: Column, heard_body: Column) -> Column:
    """struct(value, rule) of the first usable source: vendor relay's display name, text, display name, domain."""
    shown = clean_sender_name(from_name)
    title = F.initcap(F.replace(sender_domain_label(from_email), F.lit("-"), F.lit(" ")))
    thanks = heard("thanks 3 apply")
    from_subject = let(named_places(subject), lambda p: F.coalesce(*_after_cue(p, True, heard_subject.rlike(thanks))))
    at_end = clean_company(F.nullif(F.regexp_extract(subject, rf"(?:@|(?i:\bat))[ \t]+{_THE}({NAME})[ \t.!]*$", 1), F.lit("")))
    in_body = let(named_places(body), lambda p: F.struct(*[x.alias(f"c{i}") for i, x in enumerate(_after_cue(p, False, heard_body.rlike(thanks)))]))
    return F.coalesce(
        F.when(vendor.isNotNull(), _named(shown, "co.ats.sender_name")),
        from_subject,
        _named(at_end, "co.subject.role_at_company"),
        let(F.struct(in_body.alias("p"), signature(body).alias("s")), lambda x: F.coalesce(x["p"]["c0"], x["p"]["c1"], x["s"], x["p"]["c2"])),
        let(shown, lambda x: F.when(~looks_like_person(x, from_email), _named(x, "co.sender.display_name"))),
        _named(title, "co.sender.domain"),
    )


#: (rule id, expression with the title as its group), by scope in order.
ROLES_IN_SUBJECT = [
    ("role.subject.application_for", rf"(?i:appl\w+)[ \t]+(?i:for)[ \t]+{_THE}({TITLE}|{_BEFORE_JOB})"),
    ("role.subject.interview_for", rf"(?i:assessment|interview|screen)[ \t]+(?i:for)[ \t]+{_THE}({TITLE}|{_BEFORE_JOB})"),
    ("role.subject.role_at_company", rf"^[ \t]*({TITLE})[ \t]+(?:@|(?i:at)[ \t]+\p{{Lu}})"),
    ("role.subject.delimited", rf"[|–—][ \t]*({TITLE})[ \t]*$"),
]
ROLES_IN_BODY = [
    ("role.body.application_for_role", rf"(?i:application)[ \t]+(?i:for)[ \t]+{_THE}({TITLE}|{_BEFORE_JOB})"),
    ("role.body.interest_in_role", rf"(?i:interest)[ \t]+(?i:in)[ \t]+{_THE}({TITLE}|{_BEFORE_JOB})"),
    ("role.body.position_label", r"(?m)^[ \t]*(?i:job title|position|role|title)[ \t]*:[ \t]*([^\n|]+)"),
]


def extract_role(subject: Column, body: Column, vendor: Column) -> Column:
    """struct(value, rule) of the first cue with a title behind it; with a vendor the body's cues come first."""
    titles = lambda text, rules: [_named(clean_role(F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))), rule) for rule, pattern in rules]
    from_subject, from_body = F.coalesce(*titles(subject, ROLES_IN_SUBJECT)), F.coalesce(*titles(body, ROLES_IN_BODY))
    both = F.struct(from_subject.alias("s"), from_body.alias("b"), vendor.isNotNull().alias("v"))
    return let(both, lambda x: F.when(x["v"], F.coalesce(x["b"], x["s"])).otherwise(F.coalesce(x["s"], x["b"])))


def extract_location(subject: Column, body: Column) -> Column:
    """struct(value, rule): a labelled place up to its first comma, a place or way of working in brackets, or where an office is."""
    label = F.get(F.split(F.regexp_extract(body, r"(?im)^[ \t]*location[ \t]*:[ \t]*(.+)$", 1), "[,|;]"), 0)
    bracket = F.regexp_extract(subject, r"[(][ \t]*((?i:remote|hybrid|on-?site)|\p{Lu}[^()]*,[ \t]*\p{Lu}{2,3})[ \t]*[)]", 1)
    town = F.regexp_extract(body, rf"\b(?i:based|located|office)[ \t]+in[ \t]+({_WORD}(?:[ \t]+{_WORD}){{0,3}}(?:,[ \t]*\p{{Lu}}{{2}}\b)?)", 1)
    found = [(label, "loc.body.label"), (bracket, "loc.subject.parenthetical"), (town, "loc.body.based_in")]
    return F.coalesce(*[_named(clean_capture(F.nullif(x, F.lit(""))), rule) for x, rule in found])


@cache
def _columns(session: int) -> list[dict[str, Column]]:
    """The steps of classify, columns by name. A plan of this size takes seconds to say through the gateway, so it is said once a session."""
    texts = [normalize_text(F.coalesce(x, F.lit(""))) for x in ("subject", "body_text")]
    known, vendor = F.col("event_type") != "unknown", F.col("_vendor.vendor")
    subject, body = F.col("_heard")[0], F.col("_heard")[1]
    return [
        {"_heard": encoded(F.array(*texts)), "_vendor": detect_vendor(F.col("from_email"), F.col("headers"))},
        {"_ids": fired(subject, body)},
        {"_ranks": ranks_of(F.col("_ids"))},
        {"event_type": winner(F.col("_ranks"))},
        {
            "_company": F.when(known, extract_company(F.col("subject"), F.col("body_text"), F.col("from_name"), F.col("from_email"), vendor, subject, body)),
            "_role": F.when(known, extract_role(F.col("subject"), F.col("body_text"), vendor)),
            "_location": F.when(known, extract_location(F.col("subject"), F.col("body_text"))),
        },
        {"confidence": confidence(F.col("event_type"), F.col("_ids"), F.col("_ranks"), vendor, F.coalesce(F.col("_company.rule").isin(PRECISE_COMPANY), F.lit(False)))},
    ]


def classify(messages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One classification for each message; unknown ones have no extracted fields."""
    rows = messages
    for step in _columns(id(messages.sparkSession.sparkContext)):
        rows = rows.withColumns(step)
    vendor = F.col("_vendor.vendor")
    evidence = F.concat(F.col("_vendor.evidence"), F.col("_ids"), F.array_compact(F.array("_company.rule", "_role.rule")))
    return rows.select(
        "message_id",
        "event_type",
        F.col("_company.value").alias("company"),
        company_key(strip_accents(F.col("_company.value"))).alias("company_key"),
        F.col("_role.value").alias("role"),
        F.col("_location.value").alias("location"),
        vendor.alias("ats"),
        "confidence",
        ((F.col("confidence") < threshold) | F.col("_company.value").isNull()).alias("needs_review"),
        evidence.alias("evidence"),
        F.lit("rules").alias("classifier_name"),
        F.lit(VERSION).alias("classifier_version"),
    )


def composite(primary: DataFrame, fallback: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """primary, and where it is below threshold the fallback's row if that is strictly more confident."""
    names = primary.columns
    p = primary.select("message_id", F.struct(*names).alias("p"))
    f = fallback.select("message_id", F.struct(*names).alias("f"))
    chosen = F.when(F.col("p.confidence") >= threshold, F.col("p")).when(F.col("f.confidence") > F.col("p.confidence"), F.col("f")).otherwise(F.col("p"))
    return p.join(f, "message_id", "left").select(chosen.alias("c")).select("c.*")
