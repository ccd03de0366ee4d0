"""Messages of our own making, with what their classification should be."""

from datetime import datetime, timedelta, timezone

START = datetime(2026, 3, 2, 9, 0, tzinfo=timezone.utc)

#: (id, thread, from name, from address, subject, body, headers, type, company, role, vendor)
MAILS = [
    ("a1", "t1", "Northwind Labs", "no-reply@greenhouse.io", "Thank you for applying to Northwind Labs", "Hi,\nWe have received your application for the Data Engineer role.\n", {}, "application_received", "Northwind Labs", "Data Engineer", "greenhouse"),
    ("a2", "t1", "Northwind Labs", "no-reply@greenhouse.io", "Thank you for applying to Northwind Labs", "Unfortunately we will not be moving forward with your application.\n", {}, "rejection", "Northwind Labs", None, "greenhouse"),
    ("a3", "t2", "Mara Lind", "mara@fjordworks.com", "Interview invitation: Platform Engineer", "We would like to invite you to an interview. Please pick a time.\n", {}, "interview", "Fjordworks", None, None),
    ("a4", "t3", "Talent", "jobs@kestrel.ai", "Your coding challenge", "Please complete the coding challenge on HackerRank. You have 3 days to complete it.\n", {}, "assessment", "Kestrel", None, None),
    ("a5", "t4", "Ines Roy", "ines@lumen-grid.com", "Your offer", "We are delighted to offer you the role. Your start date is May 4.\n", {}, "offer", "Lumen Grid", None, None),
    ("a6", "t5", "Quarry Systems Recruiting", "hello@quarry.io", "An exciting opportunity", "I came across your profile. Would you be open to a chat?\n", {}, "recruiter_outreach", "Quarry Systems", None, None),
    ("a7", "t6", "Deli Weekly", "news@deli.example", "Five soups for autumn", "Unfortunately the pumpkins are late this year.\n", {}, "unknown", None, None, None),
    ("a8", "t7", "Northwind Labs", "notify@mail.example", "Application withdrawn", "Your application has been withdrawn at your request.\n", {"reply-to": "x@hire.lever.co"}, "withdrawn", "Northwind Labs", None, "lever"),
]
FIELDS = ("message_id", "thread_id", "from_name", "from_email", "subject", "body_text", "headers", "event_type", "company", "role", "ats")


def rows() -> list[dict]:
    out = [dict(zip(FIELDS, m)) for m in MAILS]
    for i, r in enumerate(out):
        r |= {"received_at": START + timedelta(days=i), "to_email": None, "snippet": "", "labels": ["INBOX"]}
    return out
