"""A day run that is cut off at each of its steps and run again."""

import os
from pathlib import Path

import pytest

from sluicebox.plans import preprocess
from sluicebox.plans.preprocess import preprocess_day, read_published
from sluicebox.sources import staged_lines

DAY = "20180601"


def event(kind, i, **fields):
    return {"event_type": kind, "event_id": i, "application": {"version_name": "1.0.0"}, **fields}


@pytest.fixture
def day(spark, write_lines, tmp_path):
    """Two hours that disagree on a type, and a run over them."""
    write_lines("raw/2018/06/01/00/a.json", [event("a", 1, x=1), event("b", 2), "{broken", event("Event1", 3)])
    write_lines("raw/2018/06/01/01/a.json", [event("a", 4, x="t")])

    def run(target="events", **options):
        where = str(tmp_path / target)
        done = preprocess_day(
            spark, DAY, str(tmp_path / "raw"), where, hours=[0, 1], work=str(tmp_path / "work"), **options
        )
        rows = read_published(spark, where, DAY, place=True).collect()
        return done.skipped, sorted((r.event_id, r.x, r.et, r.hh) for r in rows)

    return run


def counted(monkeypatch, module, name, calls):
    real = getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **k: (calls.append(a), real(*a, **k))[1])


def failing(monkeypatch, name, after=0):
    """Let a step fail after some calls; gives a function that mends it."""
    real, calls = getattr(preprocess, name), []

    def step(*args, **options):
        calls.append(1)
        if len(calls) > after:
            raise RuntimeError("lost")
        return real(*args, **options)

    monkeypatch.setattr(preprocess, name, step)
    return lambda: monkeypatch.setattr(preprocess, name, real)


WANT = {("no type", None): 1, ("denied", None): 1}, [(1, "1", "a", "00"), (2, None, "b", "00"), (4, "t", "a", "01")]


@pytest.mark.parametrize(
    "step,after,lines,splits",
    [("stage_split", 0, 0, 2), ("stage_split", 1, 0, 1), ("find_groups", 0, 0, 0), ("publish_partitions", 0, 0, 0)],
)
def test_run_that_was_cut_off_goes_on(day, tmp_path, monkeypatch, step, after, lines, splits):
    mend = failing(monkeypatch, step, after)
    with pytest.raises(RuntimeError):
        day()
    mend()
    staged, split = [], []
    counted(monkeypatch, staged_lines, "stage_lines", staged)
    counted(monkeypatch, preprocess, "stage_split", split)
    assert day() == WANT
    assert (len(staged), len(split)) == (lines, splits)
    assert not list((tmp_path / "work").iterdir())


def test_changed_hour_is_read_again_and_no_other(day, write_lines, tmp_path, monkeypatch):
    mend = failing(monkeypatch, "find_groups")
    with pytest.raises(RuntimeError):
        day()
    mend()
    path = write_lines("raw/2018/06/01/01/a.json", [event("a", 5, x="u")])
    os.utime(path, (1, 1))
    staged, split = [], []
    counted(monkeypatch, staged_lines, "stage_lines", staged)
    counted(monkeypatch, preprocess, "stage_split", split)
    assert day()[1] == [(1, "1", "a", "00"), (2, None, "b", "00"), (5, "u", "a", "01")]
    assert [call[1] for call in staged] == [["01"]] and len(split) == 1


def test_other_rules_use_no_old_split(day, monkeypatch):
    mend = failing(monkeypatch, "find_groups")
    with pytest.raises(RuntimeError):
        day()
    mend()
    split = []
    counted(monkeypatch, preprocess, "stage_split", split)
    assert day(denied=["b"])[1] == [(1, "1", "a", "00"), (3, None, "Event1", "00"), (4, "t", "a", "01")]
    assert len(split) == 2  # one for each of the hours, which disagree


def test_step_that_left_output_without_an_end_is_done_again(day, tmp_path, monkeypatch):
    mend = failing(monkeypatch, "find_groups")
    with pytest.raises(RuntimeError):
        day()
    mend()
    for end in Path(tmp_path, "work").glob("*/split.*.json"):
        end.unlink()
    assert day() == WANT
