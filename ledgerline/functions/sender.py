"""Sender functions: hosts, vendor detection, display names."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.text import company_key, let, one_of

#: Applicant-tracking vendors and the hosts that their mail comes from.
VENDORS: dict[str, list[str]] = {
    "greenhouse": ["greenhouse.io", "greenhouse-mail.io", "greenhousemail.io"],
    "lever": ["lever.co", "hire.lever.co", "levermail.com"],
    "workday": ["myworkday.com", "myworkdayjobs.com", "workday.com"],
    "ashby": ["ashbyhq.com", "ashbyhq.com.mail"],
    "smartrecruiters": ["smartrecruiters.com", "smartrecruiters.net"],
    "icims": ["icims.com", "icimsmail.com"],
    "taleo": ["taleo.net", "taleo.com"],
    "jobvite": ["jobvite.com", "jobvitemail.com"],
    "workable": ["workable.com", "workablemail.com"],
    "breezy": ["breezy.hr"],
    "bamboohr": ["bamboohr.com"],
    "recruitee": ["recruitee.com"],
    "teamtailor": ["teamtailor.com", "teamtailormail.com"],
    "jazzhr": ["jazzhr.com", "applytojob.com"],
    "dover": ["dover.com", "dover.io"],
    "rippling": ["rippling.com", "rippling-ats.com"],
    "wellfound": ["wellfound.com", "angel.co"],
    "linkedin": ["linkedin.com", "e.linkedin.com"],
    "indeed": ["indeed.com", "indeedemail.com"],
}
#: Headers that may name a vendor, in order, and how evidence calls them.
VENDOR_HEADERS = {"reply-to": "replyto", "list-unsubscribe": "unsubscribe", "return-path": "returnpath", "x-original-sender": "originalsender"}
#: Consumer mail hosts.
FREE_MAIL = "gmail.com googlemail.com yahoo.com hotmail.com outlook.com live.com icloud.com me.com aol.com proton.me protonmail.com".split()
#: Host labels that name a function.
FUNCTION_LABELS = "careers email hr jobs mail mailer no-reply noreply notifications recruiting smtp talent www".split()
#: Display names that carry no company.
GENERIC_SENDERS = ["careers", "do not reply", "donotreply", "hiring", "hiring team", "hr", "jobs", "no reply", "no-reply", "noreply", "notification", "notifications", "people team", "recruiting", "recruiting team", "recruitment", "talent", "talent acquisition", "team"]
#: Words that tell a company from a person.
CORPORATE_WORDS = "ai analytics bank capital cloud data digital dynamics health industries labs media networks robotics security software solutions studio studios systems technologies technology ventures works".split()
#: What is stripped from both ends of a captured name.
EDGES = " \t.,;:!?-–—'\"()"


def hosts(value: Column) -> Column:
    """Every host after an @ or //, lower case, without trailing dots."""
    return F.transform(F.regexp_extract_all(value, F.lit("(?:@|//)([A-Za-z0-9.-]+)"), F.lit(1)), lambda x: F.regexp_replace(F.lower(x), "[.]+$", ""))


def vendor_of_host(host: Column, vendors: dict[str, list[str]] | None = None) -> Column:
    """The vendor whose longest domain the host equals or lies under; null for none."""
    domains = F.from_json(F.lit(json.dumps({d: v for v, ds in (vendors or VENDORS).items() for d in ds})), "map<string,string>")

    def longest(labels: Column) -> Column:
        suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
        return F.get(F.array_compact(F.transform(suffixes, lambda x: F.try_element_at(domains, x))), 0)

    return let(F.split(host, "[.]"), longest)


def vendor_hits(from_email: Column, headers: Column) -> Column:
    """array<struct<vendor, rule>>: what each host of the From address and then of the headers says, in order."""

    def hits(value: Column, token: str) -> Column:
        named = F.transform(hosts(F.coalesce(value, F.lit(""))), lambda h: F.struct(vendor_of_host(h).alias("vendor"), F.lit(token).alias("rule")))
        return F.filter(named, lambda x: x["vendor"].isNotNull())

    parts = [hits(from_email, "from"), *[hits(F.try_element_at(headers, F.lit(h)), t) for h, t in VENDOR_HEADERS.items()]]
    return F.concat(*parts)


def detect_vendor(from_email: Column, headers: Column) -> Column:
    """struct(vendor, evidence): the first vendor told, and the rule ids of all that agree with it."""
    def told(found: Column) -> Column:
        first = F.get(found, 0)["vendor"]
        agreeing = F.array_distinct(F.transform(F.filter(found, lambda x: x["vendor"] == first), lambda x: F.concat(F.lit("ats."), x["rule"], F.lit("."), x["vendor"])))
        return F.struct(first.alias("vendor"), F.coalesce(agreeing, F.array().cast("array<string>")).alias("evidence"))

    return let(vendor_hits(from_email, headers), told)


def clean_capture(text: Column) -> Column:
    """Blanks collapsed, edges stripped; null unless 2 to 80 characters are left."""
    x = F.btrim(F.regexp_replace(text, "(?U)\\s+", " "), F.lit(EDGES))
    return let(x, lambda v: F.when(F.length(v).between(2, 80), v))


#: Words of departments at the end of a display name; "team" counts behind another of them only.
DEPARTMENTS = "acquisition career careers hiring hr jobs people recruiting recruitment talent".split()


def _behind_the_person(words: Column) -> Column:
    """What follows the first "at", "from" or "@" that has words on both sides; all words if there is none."""
    places = F.transform(words, lambda x, i: F.when((i > 0) & (i + 1 < F.size(words)) & F.lower(x).isin("at", "from", "@"), i))
    return let(F.array_min(places), lambda at: F.when(at.isNull(), words).otherwise(F.slice(words, at + 2, F.size(words))))


def _without_departments(words: Column) -> Column:
    """words without the departments at their end, in brackets or not."""
    named = F.transform(words, lambda x, i: F.when(~one_of(F.lower(F.btrim(x, F.lit("()"))), [*DEPARTMENTS, "team"]), i + 1).otherwise(0))
    team_alone = lambda n: (n + 1 == F.size(words)) & (F.lower(F.element_at(words, -1)) == "team")
    return let(F.coalesce(F.array_max(named), F.lit(0)), lambda n: F.when(team_alone(n) & (n > 0), words).otherwise(F.slice(words, F.lit(1), n)))


def clean_sender_name(name: Column) -> Column:
    """The company in a display name: what follows "at" or "from", without a relay ("via ...") and departments at its end; null for
    generic names and vendors."""
    x = F.btrim(F.regexp_replace(name, "(?U)\\s+", " "), F.lit(EDGES))
    x = F.get(F.split(F.regexp_replace(x, "(?i)\\s*[(]?\\b(?:via|through)\\s", "\n"), "\n"), 0)
    words = let(F.split(F.btrim(x, F.lit(EDGES)), " "), _behind_the_person)
    x = F.array_join(let(words, _without_departments), " ")
    return let(x, lambda v: F.when(~one_of(F.lower(v), [*GENERIC_SENDERS, *VENDORS, ""]), clean_capture(v)))


def sender_domain_label(from_email: Column) -> Column:
    """The label of the sender's host that names a company; null for consumer mail, vendors and bare names."""
    host = F.regexp_replace(F.trim(F.lower(F.regexp_extract(from_email, "@(.*)$", 1))), "[.]+$", "")
    def label(h: Column) -> Column:
        labels = F.split(h, "[.]")
        named = F.get(F.filter(F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0))), lambda x: ~one_of(x, FUNCTION_LABELS) & (F.length(x) >= 2)), 0)
        return F.when((h != "") & ~one_of(h, FREE_MAIL) & vendor_of_host(h).isNull() & (F.size(labels) >= 2), named)

    return let(host, label)


def looks_like_person(name: Column, from_email: Column) -> Column:
    """Two or three alphabetic words, none corporate, that share nothing with the sender's domain."""
    def human(p: Column) -> Column:
        words, label, key = p["words"], p["label"], p["key"]
        alphabetic = F.forall(words, lambda x: x.rlike("^\\p{L}+$"))
        corporate = F.exists(words, lambda x: one_of(F.lower(x), CORPORATE_WORDS))
        related = F.coalesce(F.contains(key, label) | F.contains(label, key), F.lit(False))
        return F.size(words).between(2, 3) & alphabetic & ~corporate & ~related

    key = F.replace(F.coalesce(company_key(name), F.lit("")), F.lit(" "), F.lit(""))
    return let(F.struct(F.split(name, " ").alias("words"), sender_domain_label(from_email).alias("label"), key.alias("key")), human)
