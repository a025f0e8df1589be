"""Stopping a step while it runs, and going on with it."""

import os
import signal
import threading
import time
from collections import Counter
from glob import glob

import pytest

from sigla import cli, stand_in
from sigla.plans import models, reports, steps
from sigla.sources import tables


def slow(folder, seconds):
    """A chooser that notes what it is asked, and takes its time; made in a function, so that workers get it whole."""

    class Slow:
        def choose(self, requests):
            for r in requests:
                with open(f"{folder}/{os.getpid()}-{threading.get_ident()}", "a") as out:
                    out.write(r.text + "\n")
                time.sleep(seconds)
            return ['{"1": "officium"}' for _ in requests]

    return Slow()


def noted(folder):
    return Counter(line for name in glob(f"{folder}/*") for line in open(name).read().splitlines())


@pytest.fixture
def job(spark, tmp_path):
    work = spark.createDataFrame([(3, k, f"of. {k}") for k in range(24)], "volume long, entry long, text string")
    asked = tmp_path / "asked"
    asked.mkdir()
    process = lambda chooser: lambda df: steps.step2(df, stand_in.glossary(spark), chooser)
    return work, str(asked), process, str(tmp_path / "checkpoint")


def interrupting(ready, times, pause=0.5):
    """Sends this process interrupts once ``ready`` is true."""

    def send():
        while not ready():
            time.sleep(0.05)
        for _ in range(times):
            os.kill(os.getpid(), signal.SIGINT)
            time.sleep(pause)

    thread = threading.Thread(target=send, daemon=True)
    thread.start()
    return thread


def test_first_interrupt_ends_the_batch_and_nothing_is_asked_twice(spark, job):
    work, asked, process, path = job
    before = signal.getsignal(signal.SIGINT)
    sender = interrupting(lambda: noted(asked), 1)
    with pytest.raises(steps.Interrupted, match=r"interrupted after 1 of \d+ batches"):
        steps.worked_off(work, process(slow(asked, 0.2)), path, every=6)
    sender.join()
    assert signal.getsignal(signal.SIGINT) is before
    kept, told = tables.done_in(spark, path).count(), noted(asked)
    assert 0 < kept < 24 and kept == len(told)
    done, failures = steps.worked_off(work, process(slow(asked, 0)), path, every=6)
    assert done.count() == 24 and failures.isEmpty()
    assert noted(asked) == Counter(f"of. {k}" for k in range(24))


def test_second_interrupt_leaves_at_once_and_keeps_earlier_batches(spark, job):
    work, asked, process, path = job
    steps.worked_off(work.where("entry < 6"), process(slow(asked, 0)), path)
    sender = interrupting(lambda: len(noted(asked)) > 6, 2)
    began = time.monotonic()
    with pytest.raises(steps.Interrupted, match="at once"):
        steps.worked_off(work, process(slow(asked, 5)), path)
    sender.join()
    assert time.monotonic() - began < 25
    assert sorted(r.entry for r in tables.done_in(spark, path).collect()) == list(range(6))
    done, _ = steps.worked_off(work, process(slow(asked, 0)), path)
    assert done.count() == 24


def test_no_batch_begins_when_the_time_is_up(spark, job):
    work, asked, process, path = job
    with pytest.raises(steps.Interrupted, match="out of time after 0 of"):
        steps.worked_off(work, process(slow(asked, 0)), path, every=6, until=time.time() - 1)
    assert not noted(asked)


def test_what_is_not_asked_in_time_comes_again(spark, job):
    work, asked, process, path = job
    late = steps.Until(slow(asked, 0), time.time() - 1)
    with pytest.raises(steps.Interrupted, match="24 entries were not asked about"):
        steps.worked_off(work, process(late), path, most_failures=0)
    assert not noted(asked) and tables.done_in(spark, path).isEmpty()
    done, _ = steps.worked_off(work, process(steps.Until(slow(asked, 0), time.time() + 600)), path)
    assert done.count() == 24


def test_preview_asks_nobody(spark, job):
    work, asked, process, _ = job
    told = reports.preview(process(steps.Preview())(work))
    assert "| 24 | 24 | 24 | 0 |" in told and told.count("[[1]] of.") == 3 and not noted(asked)


def test_a_call_without_an_answer_is_left():
    calls, never = [], threading.Event()

    def send(request):
        calls.append(request)
        if len(calls) < 3:
            never.wait(30)
        return "{}"

    model = models.Model(send, "m", spacing=0.0, again=2, patience=0.1)
    assert model.ask("", "p") == ("{}", 2)
    chooser = steps.Asking(models.Model(lambda r: never.wait(30), "m", spacing=0.0, again=0, patience=0.1), workers=2)
    request = steps.Request(2, "t", [], {}, "p", 1)
    began = time.monotonic()
    assert [type(a) for a in chooser.choose([request] * 4)] == [TimeoutError] * 4 and time.monotonic() - began < 5
    never.set()


def test_threads_do_not_share_a_moment():
    starts = []
    model = models.Model(lambda r: "{}", "m", spacing=0.05, sleep=lambda s: None)
    take = model.clock

    def clock():
        now = take()
        time.sleep(0.001)  # another thread could look at the same free moment here
        return now

    model.clock = clock
    chooser = steps.Asking(model, workers=8)
    first = take()
    chooser.choose([steps.Request(2, "t", [], {}, "p", 1)] * 16)
    starts.append(model.free - first)
    assert starts[0] >= 16 * 0.05


def test_switches_of_the_command_line(spark, tmp_path):
    a = cli.parser().parse_args(["step", "2", "i", "o", "c", "--every", "10", "--time-limit", "5", "--patience", "7", "--sender", "json:dumps", "--model", "gemma-4-x"])
    assert (a.every, a.time_limit) == (10, 5.0) and cli._chooser(a).model.patience == 7.0
    a = cli.parser().parse_args(["step", "2", "i", "o", "c", "--patience", "0", "--sender", "json:dumps", "--model", "gemma-4-x"])
    with pytest.raises(ValueError, match="above 0"):
        cli._chooser(a)
    at = lambda name: str(tmp_path / name)
    corpus = spark.createDataFrame([(3, 1, 0, "of. the.", None, "10300001-0")], "volume long, entry long, line_no long, head_text string, body_text string, line_id string")
    tables.write_csv(corpus, at("corpus"), write=True)
    tables.write_csv(stand_in.glossary(spark), at("known"), write=True, one_file=True)
    told = cli.main(["step", "2", at("corpus"), at("out"), at("check"), "--glossary", at("known"), "--preview", "--write"], spark)
    assert "## Preview" in told and not os.path.exists(at("check")) and not os.path.exists(at("out"))
    with pytest.raises(SystemExit, match="out of time"):
        cli.main(["step", "2", at("corpus"), at("out"), at("check"), "--glossary", at("known"), "--time-limit", "1e-9", "--write"], spark)
