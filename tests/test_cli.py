from datetime import datetime, timedelta, timezone

import pytest

from ledgerline import cli
from tests.mails import rows
from tests.test_io import write_mails

NOW = "2026-03-12T12:00:00+00:00"


def test_since():
    now = datetime(2026, 3, 1, tzinfo=timezone.utc)
    assert cli.since("3", now) == now - timedelta(days=3) and cli.since("2026-02-01", now) == datetime(2026, 2, 1, tzinfo=timezone.utc)
    with pytest.raises(ValueError):
        cli.since("soon", now)


def test_verbs(spark, tmp_path, capsys):
    write_mails(tmp_path / "in", rows())
    call = lambda *a: cli.main(["--store", str(tmp_path / "store"), "--now", NOW, *a], spark)
    assert call("sync", str(tmp_path / "in")) == 0
    assert call("list", "--status", "offer") == 0 and "Lumen Grid" in capsys.readouterr().out
    assert call("export", str(tmp_path / "a.csv")) == 0
    text = (tmp_path / "a.csv").read_text().splitlines()
    assert text[0].startswith("application_id,company,role") and len(text) == 6
    with pytest.raises(SystemExit):
        call("list", "--status", "nonsense")


def test_corrections_and_cursors(spark, tmp_path, capsys):
    from ledgerline.streaming import incremental

    write_mails(tmp_path / "in", rows())
    store = str(tmp_path / "store")
    call = lambda *a: cli.main(["--store", store, "--now", NOW, *a], spark)
    call("sync", str(tmp_path / "in"))
    capsys.readouterr()
    call("list")
    before = capsys.readouterr().out
    assert "Deli Weekly" not in before and before.count("\n") == 6
    call("correct", "a7", "--type", "offer", "--company", "Deli Weekly", "--role", "Cook")
    call("correct", "a5", "--type", "unknown")
    call("list")
    after = capsys.readouterr().out
    assert "Deli Weekly" in after and "Lumen Grid" not in after
    with pytest.raises(ValueError):
        incremental.set_override(spark, store, "a1", None, "nonsense")
    assert incremental.get_cursor(spark, store, "mail") is None
    for cursor in ("41", "97", None):
        incremental.set_cursor(spark, store, "mail", cursor)
        assert incremental.get_cursor(spark, store, "mail") == cursor and incremental.get_cursor(spark, store, "other") is None
