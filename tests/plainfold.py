"""Linking said plainly: one fold over all messages in order, which looks at every application each time."""

from __future__ import annotations

from datetime import timedelta
from typing import Any

from ledgerline.operators.linking import SIMILAR, WINDOW_DAYS, new_id


def similarity(a: set[str], b: set[str]) -> float:
    return 2.0 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def fold(rows: list[dict[str, Any]], now, window_days: int = WINDOW_DAYS) -> list[dict[str, Any]]:
    """rows in order, each with message_id, thread_id, event_type, received_at, company, company_key, role, words, location, ats."""
    apps: list[dict[str, Any]] = []
    by_thread: dict[str, list[dict]] = {}
    by_key: dict[str, list[dict]] = {}
    latest = lambda xs: max(xs, key=lambda a: (a["last"], a["id"]))
    out = []
    for r in rows:
        if r["event_type"] == "unknown" or r["company_key"] is None:
            out.append({"message_id": r["message_id"], "application_id": None, "created": False})
            continue
        app = None
        if by_thread.get(r["thread_id"]):
            app = latest(by_thread[r["thread_id"]])
        else:
            near = [a for a in by_key.get(r["company_key"], []) if now - a["last"] <= timedelta(days=window_days)]
            alike = [(s, a) for a in near if a["role"] is not None and r["role"] is not None and (s := similarity(a["words"], set(r["words"]))) >= SIMILAR]
            if alike:
                best = max(s for s, _ in alike)
                app = latest([a for s, a in alike if s == best])
            elif open_ones := [a for a in near if a["role"] is None or r["role"] is None]:
                app = latest(open_ones)
        created = app is None
        if created:
            app = {"id": new_id(r["company_key"], r["role"], r["message_id"]), "company": r["company"], "key": r["company_key"], "role": r["role"], "words": set(r["words"]), "location": r["location"], "ats": r["ats"], "last": r["received_at"]}
            apps.append(app)
            by_key.setdefault(app["key"], []).append(app)
        else:
            if app["role"] is None and r["role"] is not None:
                app["role"], app["words"] = r["role"], set(r["words"])
            app["location"] = r["location"] if app["location"] is None else app["location"]
            app["ats"] = r["ats"] if app["ats"] is None else app["ats"]
            app["last"] = max(app["last"], r["received_at"])
        threads = by_thread.setdefault(r["thread_id"], [])
        if app not in threads:
            threads.append(app)
        out.append({"message_id": r["message_id"], "application_id": app["id"], "created": created, "app": app})
    for x in out:
        a = x.pop("app", None)
        x.update({k: None if a is None else a[k] for k in ("company", "role", "location", "ats")} | {"company_key": None if a is None else a["key"]})
    return out
