from __future__ import annotations

import hashlib
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pagemill import fixtures
from pagemill.backends import failing_stub, stub
from pagemill.fixed_values import BATCH_MODEL_OPTIONS
from pagemill.functions.messages import api_messages, chat_text
from pagemill.operators import completions
from pagemill.operators.completions import _call_with_retries
from pagemill.operators.routing import route_categories
from pagemill.plans.synthesis import Synthesis
from pagemill.session import scratch_path
from pagemill.sources.answers import AnswerLog
from pagemill.sources.stages import StageStore

SF_DIR = "/root/testdata/sf0.001"
NO_WAIT = {"wait": (0.0, 0.0)}


def test_failed_prompts_alone_are_tried_again():
    calls = []

    def backend(prompts):
        calls.append(prompts)
        return [None if p == "bad" or (p == "slow" and len(calls) < 3) else p.upper() for p in prompts]

    got = _call_with_retries(backend, ["a", "bad", "slow"], 5, (0, 0), 64)
    assert got == [("A", 1), (None, 5), ("SLOW", 3)]
    assert calls == [["a", "bad", "slow"], ["bad", "slow"], ["bad", "slow"], ["bad"], ["bad"]]


def test_one_raising_prompt_does_not_take_others_with_it():
    def backend(prompts):
        if "poison" in prompts:
            raise RuntimeError("refused")
        return [p.upper() for p in prompts]

    assert _call_with_retries(backend, ["a", "poison", "b"], 5, (0, 0), 64) == [("A", 1), (None, 5), ("B", 1)]


def test_one_bad_prompt_costs_few_calls_and_one_wait_per_round(monkeypatch):
    waits, calls = [], []
    monkeypatch.setattr(completions.time, "sleep", waits.append)

    def backend(prompts):
        calls.append(len(prompts))
        if "p500" in prompts:
            raise RuntimeError("refused")
        return prompts

    got = _call_with_retries(backend, [f"p{i}" for i in range(1000)], 5, (1, 1), 64)
    assert got[500] == (None, 5) and got[:500] + got[501:] == [(f"p{i}", 1) for i in range(1000) if i != 500]
    # 16 calls, two for each halving of the one that raised, then the bad prompt alone.
    assert len(calls) == 16 + 2 * 6 + 4 and waits == [1] * 4


def test_wrong_number_of_answers_is_a_failure():
    assert _call_with_retries(lambda p: ["x"], ["a", "b"], 2, (0, 0), 64) == [("x", 1), ("x", 1)]


def test_each_row_is_sent_once_even_if_the_answer_is_filtered_and_used_twice(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def backend(prompts, temperature):
        import uuid

        (Path(log) / uuid.uuid4().hex).write_text("\n".join(prompts))
        return [f"{p}@{temperature}" for p in prompts]

    df = spark.range(50).withColumn("text", F.concat(F.lit("p"), "id"))
    done = completions.generate(
        df, F.col("text"), backend, options={"temperature": 0.6}, batch_size=7, concurrency=3, **NO_WAIT
    )
    kept = completions.succeeded(done).withColumn("length", F.length("completion")).filter("length > 2")
    assert {r.completion for r in kept.collect()} == {f"p{i}@0.6" for i in range(50)}
    sent = [line for f in log.iterdir() for line in f.read_text().splitlines()]
    assert sorted(sent) == sorted(f"p{i}" for i in range(50))


def run(spark, backend, root=None, **options):
    store = StageStore(spark, root or scratch_path(spark, "store"), "pages", "stub")
    return Synthesis(store, backend, generate_options=NO_WAIT, **options)


def pages(spark):
    return fixtures.webpages(spark, SF_DIR).select("seq", "webpage", F.lit("kept").alias("extra"))


def test_waves_do_not_change_the_result(spark):
    whole = run(spark, failing_stub).pairs(pages(spark)).orderBy("seq").collect()
    in_waves = run(spark, failing_stub, waves=3).pairs(pages(spark)).orderBy("seq").collect()
    assert in_waves == whole and whole


def test_a_second_run_goes_on_behind_the_finished_waves(spark):
    root = scratch_path(spark, "store")

    def fail_late(prompts):
        # Breaks the job itself, in the middle of the request stage.
        import os

        if any("most likely" in p for p in prompts):
            os._exit(1)
        return stub(prompts)

    with pytest.raises(Exception):
        run(spark, fail_late, root, waves=2).pairs(pages(spark)).count()
    first = run(spark, None, root)
    assert first.store.finished("author", 0) and first.store.finished("author", 1)
    assert first.store.finished("request", 0) and not first.store.finished("request", 1)

    def no_author_again(prompts):
        assert not any("infer the author's profile" in p for p in prompts)
        return stub(prompts)

    # Other waves than before: those of the first run are kept to.
    resumed = run(spark, no_author_again, root, waves=5).pairs(pages(spark)).orderBy("seq").collect()
    assert resumed == run(spark, stub).pairs(pages(spark)).orderBy("seq").collect()

    def never(prompts):
        raise AssertionError("all stages are finished")

    again = run(spark, never, root, waves=2).pairs(pages(spark)).orderBy("seq").collect()
    assert again == resumed


def test_failures_are_listed_and_other_columns_pass_through(spark):
    job = run(spark, failing_stub)
    sections = job.author(pages(spark))
    assert sections.columns == ["seq", "webpage", "extra", "author"]
    assert job.failed("author").count() == 200 - sections.count() > 0
    assert set(job.failed("author").columns) == {"seq", "attempts", "prompt_hash"}
    projected = run(spark, failing_stub, project=True)
    requests = projected.request(projected.author(pages(spark)))
    assert requests.columns == ["seq", "category", "webpage", "author", "request"]


def test_a_store_refuses_another_run(spark, tmp_path):
    root = scratch_path(spark, "store")
    run(spark, stub, root).author(pages(spark)).count()
    with pytest.raises(ValueError, match="pages"):
        run(spark, stub, root).author(pages(spark).filter("seq > 0"))
    for options, name in (({"seed": "x"}, "seed"), ({"clean": False}, "clean"), ({"section_method": "gaussian"}, "section")):
        with pytest.raises(ValueError, match=name):
            run(spark, stub, root, **options).author(pages(spark))
    with pytest.raises(ValueError, match="envelope"):
        run(spark, stub, root, envelope=lambda p: F.to_json(api_messages(p))).author(pages(spark))
    for name in ("one", "two"):
        (tmp_path / name).write_text('[{"webpage": "page"}]')
    job = run(spark, stub, root)
    assert job.ingest([str(tmp_path / "one")]).count() == 1
    with pytest.raises(ValueError, match="paths"):
        job.ingest([str(tmp_path / "one"), str(tmp_path / "two")])


@pytest.mark.parametrize("name", ["wave", "attempts", "prompt_hash", "completion"])
def test_reserved_columns_are_refused(spark, name):
    with pytest.raises(ValueError, match=name):
        run(spark, stub).author(pages(spark).withColumn(name, F.lit(1)))


def test_failed_rows_are_asked_again_by_the_next_run(spark):
    root = scratch_path(spark, "store")
    first = run(spark, failing_stub, root)
    before = first.pairs(pages(spark)).count()
    assert first.failed("author").count() > 0
    second = run(spark, stub, root)
    after = second.pairs(pages(spark)).collect()
    assert before < len(after) == len({r.seq for r in after}) == 200
    assert all(second.failed(stage).count() == 0 for stage in ("author", "request", "response", "refine"))


def test_bounded_calls_need_no_shuffle(spark):
    df = pages(spark)
    plan = completions.generate(df, F.col("webpage"), stub, concurrency=3)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Coalesce 3" in plan


def test_options_reach_the_backend(spark):
    def backend(prompts, stop, **others):
        return [f"{stop} {sorted(others)}"] * len(prompts)

    done = completions.generate(spark.range(1), F.lit("p"), backend, options=BATCH_MODEL_OPTIONS, **NO_WAIT)
    assert done.first()["completion"] == "['<|eot_id|>'] ['max_tokens', 'n', 'temperature', 'top_p']"


def test_uncleaned_completions(spark):
    cleaned, raw = (
        {r.seq: r.request for r in job.request(job.author(pages(spark))).collect()}
        for job in (run(spark, stub), run(spark, stub, clean=False))
    )
    assert any(v.startswith("Here is the reply:") for v in raw.values())
    assert not any(v.startswith(("Here is", "Here's", '"')) for v in cleaned.values())


@pytest.mark.parametrize(
    "envelope, start",
    [
        (lambda p: chat_text(p, "Meta-Llama-3-70B-Instruct"), "<|begin_of_text|>"),
        (lambda p: F.to_json(api_messages(p)), '[{"content":"You are a helpful assistant.","role":"system"}'),
    ],
)
def test_envelopes(spark, envelope, start):
    def echo(prompts):
        return prompts

    authors = run(spark, echo, envelope=envelope).author(pages(spark)).select("author").collect()
    assert all(r.author.startswith(start) for r in authors) and len(authors) == 200


def test_no_answers_at_all(spark):
    job = run(spark, lambda prompts: [None] * len(prompts))
    assert job.messages(pages(spark), wi_quota=4, wr_quota=2).count() == 0
    assert job.failed("author").count() == 200


def test_replay_and_resume(spark):
    """Two stages of 200 pages in four categories; a third of the answers is missing or under another key."""
    done = fixtures.completions(spark, SF_DIR)
    k = 200 // 6
    of = lambda n: "WI_all" if n < 2 * k else "WI_part" if n < 4 * k else "WR_all" if n < 5 * k else "WR_part"
    answered = {(n, "request") for n in range(200) if n % 10 != 9} | {(n, "response") for n in range(200) if n % 10 < 6}
    answered = {(n, stage) for n, stage in answered if n % 7 != 3 or of(n) == "WI_all"}
    keys = route_categories(pages(spark))
    keys = keys.withColumn("stage", F.lit("request")).unionByName(keys.withColumn("stage", F.lit("response")))
    attached = completions.attach_completions(keys, done).collect()
    assert {(r["seq"], r["stage"]) for r in attached if r["completion"]} == answered and len(attached) == 400
    assert all(r["completion"] in (None, f"{r['stage']} of page {r['seq']}") for r in attached)
    pending = completions.pending_rows(keys, done).collect()
    assert len(pending) == 400 - len(answered) and not {(r["seq"], r["stage"]) for r in pending} & answered
    other = keys.withColumn("category", F.lit("WR_refine"))
    assert completions.pending_rows(other, done).count() == 400


LOSES_A_TASK = """
import os, sys, uuid
from pathlib import Path

folder = Path(sys.argv[1])
sys.path.insert(0, sys.argv[2])
from pyspark.sql import functions as F
from pagemill.operators.completions import generate
from pagemill.session import local_session
from pagemill.sources.answers import AnswerLog

def backend(prompts):
    # The worker dies before its last call, once.
    if "p99" in prompts and not (folder / "died").exists():
        (folder / "died").touch()
        os._exit(1)
    (folder / "calls" / uuid.uuid4().hex).write_text("\\n".join(prompts))
    return [p.upper() for p in prompts]

spark = local_session("2,4", "lost")
df = spark.range(0, 100, 1, 2).withColumn("text", F.concat(F.lit("p"), "id"))
done = generate(df, F.col("text"), backend, batch_size=8, wait=(0, 0), log=AnswerLog(str(folder / "log")))
done.write.parquet(str(folder / "out"))
"""


def test_a_lost_task_sends_each_prompt_once(tmp_path, spark):
    (tmp_path / "calls").mkdir()
    script = tmp_path / "job.py"
    script.write_text(LOSES_A_TASK)
    command = [sys.executable, str(script), str(tmp_path), str(Path(__file__).resolve().parent.parent)]
    subprocess.run(command, check=True, timeout=300, capture_output=True)
    assert (tmp_path / "died").exists()
    sent = [line for f in (tmp_path / "calls").iterdir() for line in f.read_text().splitlines()]
    assert sorted(sent) == sorted(f"p{i}" for i in range(100))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r["text"], r["completion"], r["attempts"]) for r in rows} == {(f"p{i}", f"P{i}", 1) for i in range(100)}


def test_a_job_started_again_joins_what_the_log_has(spark, tmp_path):
    log = AnswerLog(f"file:{tmp_path}/log")
    assert log.table(spark) is None and log.of_partition(0) == {}
    df = spark.createDataFrame([(i, f"p{i % 7}" if i < 9 else None) for i in range(10)], "id bigint, text string").repartition(3)
    known = {f"p{k}": hashlib.sha256(f"p{k}".encode()).hexdigest() for k in range(7)}
    log.add(5, [(known["p1"], "kept 1", 2), (known["p2"], "kept 2", 1)])
    log.add(5, [(known["p1"], "later", 3)])
    log.add(77, [])
    assert log.of_partition(5) == {known["p1"]: log.of_partition(5)[known["p1"]], known["p2"]: ("kept 2", 1)}

    def backend(prompts):
        return [None if p is None else f"fresh {p}" for p in prompts]

    rows = completions.generate(df, F.col("text"), backend, log=log, **NO_WAIT).collect()
    got = {r["id"]: (r["completion"], r["attempts"]) for r in rows}
    assert got[1] == got[8] == ("kept 1", 2) and got[2] == ("kept 2", 1) and got[9] == (None, 5)
    assert all(got[i] == (f"fresh p{i % 7}", 1) for i in (0, 3, 4, 5, 6, 7))
    log.clear(spark)
    assert log.table(spark) is None


def test_logs_go_when_their_wave_is_written(spark, tmp_path):
    store = StageStore(spark, str(tmp_path), "pages", "stub")
    run(spark, failing_stub, str(tmp_path), waves=2).author(pages(spark))
    assert not list(tmp_path.glob("**/*.answers/wave=*")) and store.finished("author", 1)


def test_a_changed_column_is_another_run(spark):
    root = scratch_path(spark, "store")
    run(spark, stub, root).author(pages(spark))
    with pytest.raises(ValueError, match="pages"):
        run(spark, stub, root).author(pages(spark).withColumn("extra", F.lit("other")))
