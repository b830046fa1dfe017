"""Bulk import of XML parts: ledger, quarantine, restarts."""

import datetime as dt

import pytest
from pyspark.sql import types as T

from docketspark.sources import registry

SCHEMA = T.StructType([T.StructField("inn", T.LongType()), T.StructField("name", T.StringType()), T.StructField("day", T.DateType())])


def record(inn, name="n", day="2026-08-01"):
    return f"<Doc><inn>{inn}</inn><name>{name}</name><day>{day}</day></Doc>"


def write(folder, name, *records, close="</File>"):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text('<?xml version="1.0" encoding="UTF-8"?>\n<File><Documents/>' + "\n".join(records) + close)


def run(spark, source, root, **options):
    return registry.import_registry(spark, f"file://{source}", f"file://{root}", "<Doc>", "</Doc>", SCHEMA, "inn", **options)


def rows(spark, root):
    return {(r.inn, r.name, r.day) for r in registry.registry(spark, f"file://{root}", SCHEMA, "inn", "day").collect()}


def fill(source):
    write(source, "a.xml", record(1, "a &amp; b"), record(2), "<Doc><inn>3</inn><name>open</Doc>", record("x"), "<Doc><name>no key</name></Doc>", "<Doc><inn>8</inn>", record(10))
    write(source, "b.xml", record(1, "newer", "2026-08-10"), record(2, "older", "2026-07-01"), record(4), record(4))
    write(source, "c.xml", record(5), "<Doc><inn>6</inn><na", close="")
    write(source, "d.xml")
    write(source, "notes.txt", record(9))


DAY = dt.date(2026, 8, 1)
WANT = {(1, "newer", dt.date(2026, 8, 10)), (2, "n", DAY), (10, "n", DAY), (4, "n", DAY), (5, "n", DAY)}


def test_import_sets_broken_records_apart(spark, tmp_path):
    fill(tmp_path / "in")
    assert run(spark, tmp_path / "in", tmp_path / "out") == 1
    assert rows(spark, tmp_path / "out") == WANT
    bad = registry.quarantine(spark, f"file://{tmp_path}/out", SCHEMA).collect()
    assert len(bad) == 3 and sum("open" in (r.record or "") for r in bad) == 1
    found = {r.path.rsplit("/", 1)[1]: (r.n_rows, r.n_broken, r.n_lost) for r in registry.ledger(spark, f"file://{tmp_path}/out").collect()}
    assert found == {"a.xml": (6, 3, 1), "b.xml": (4, 0, 0), "c.xml": (1, 0, 1), "d.xml": (0, 0, 0)}
    assert run(spark, tmp_path / "in", tmp_path / "out") == 0  # all parts are known


@pytest.mark.parametrize("written", [False, True])
def test_killed_import_resumes_to_the_same_table(spark, tmp_path, monkeypatch, written):
    """One batch is done; the next is killed before its rows or before its ledger entry is written. Then a part is added and one changes."""
    fill(tmp_path / "in")
    assert run(spark, tmp_path / "in", tmp_path / "out", batch_bytes=1, batches=1) == 1
    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(registry, "_batch_rows", killed) if written else m.setattr(registry, "_import_batch", killed)
        with pytest.raises(KeyboardInterrupt):
            run(spark, tmp_path / "in", tmp_path / "out", batch_bytes=1)
    assert rows(spark, tmp_path / "out") == {(1, "a & b", DAY), (2, "n", DAY), (10, "n", DAY)}  # what isn't in the ledger isn't seen
    assert run(spark, tmp_path / "in", tmp_path / "out", batch_bytes=1) == 3
    assert rows(spark, tmp_path / "out") == WANT
    write(tmp_path / "in", "b.xml", record(1, "corrected", "2026-08-10"), record(40))
    write(tmp_path / "in", "e.xml", record(7))
    assert run(spark, tmp_path / "in", tmp_path / "out") == 1
    assert rows(spark, tmp_path / "out") == WANT - {(1, "newer", dt.date(2026, 8, 10)), (4, "n", DAY)} | {(1, "corrected", dt.date(2026, 8, 10)), (40, "n", DAY), (7, "n", DAY)}


def test_nothing_to_import(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert run(spark, tmp_path / "in", tmp_path / "out") == 0
    assert rows(spark, tmp_path / "out") == set() and registry.ledger(spark, f"file://{tmp_path}/out").count() == 0
