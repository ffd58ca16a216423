"""Answers once, from a provider that fails, and a budget kept by four tasks."""

import os
import time

import numpy as np

from larkspur.operators import model_step


def provider(folder, bad=()):
    """Answers in upper case; every id's first call fails, those in `bad` while the flag is there."""

    def make():
        def chat(system, prompt):
            with open(f"{folder}/calls", "a") as log:
                log.write(f"{time.time()} {prompt}\n")
            if prompt in bad and os.path.exists(f"{folder}/flag"):
                raise RuntimeError("down")
            mark = f"{folder}/seen-{prompt}"
            if not os.path.exists(mark):
                open(mark, "w").close()
                raise TimeoutError("again")
            return f"{system}:{prompt.upper()}"

        return chat

    return make


def test_each_id_once(spark, tmp_path):
    folder, path = str(tmp_path), f"file://{tmp_path}/out"
    rows = [(f"i{k}", f"p{k}") for k in range(60)]
    prompts = spark.createDataFrame(rows + [("i3", "p3"), ("i4", "zz"), (None, "x"), ("n", None)], "id string, prompt string").repartition(5)
    open(f"{folder}/flag", "w").close()
    ask = lambda: model_step.answer_all(prompts, path, provider(folder, ("p7", "p8")), "s", batches=6)
    assert ask() == {"answered": 58, "asked": 58 * 2 + 2 * 3, "failed": 2}
    os.remove(f"{folder}/flag")
    assert ask() == {"answered": 60, "asked": 4, "failed": 0}
    assert ask() == {"answered": 60, "asked": 0, "failed": 0}
    got = [(r["id"], r["answer"]) for r in model_step.answers(spark, path).collect()]
    assert sorted(got) == sorted((i, f"s:{p.upper()}") for i, p in rows)
    assert model_step.answers(spark, f"{path}-none").count() == 0


def test_one_budget_for_four_tasks(spark, tmp_path):
    folder, path = str(tmp_path), f"file://{tmp_path}/out"
    prompts = spark.createDataFrame([(f"i{k}", f"p{k}") for k in range(40)], "id string, prompt string")
    budget = model_step.RateBudget(20, host="127.0.0.1")
    try:
        model_step.answer_all(prompts, path, provider(folder), "s", batches=4, budget=budget)
    finally:
        budget.close()
    times = np.sort([float(line.split()[0]) for line in open(f"{folder}/calls")])
    assert len(times) == 80
    for t in times:
        assert ((times >= t) & (times < t + 1.0)).sum() <= 24
    assert times[-1] - times[0] > 80 / 20 * 0.8
