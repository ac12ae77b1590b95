"""No answer is paid for twice: tasks that die, runs that begin again, twins."""

import os
import threading
import time
from collections import Counter
from dataclasses import dataclass

import pytest

from docweave.operators.external import MockLlm, call_llm, call_ocr
from docweave.operators.journal import Journal, call_key, unanswered


@dataclass
class Counting:
    """Notes each call in a folder, and dies at a given one."""

    folder: str
    dies_at: int = 0
    model: str = "counting"
    provider: str = "counting"

    def _note(self, what: str) -> None:
        name = f"{self.folder}/calls"
        with open(name, "a") as f:
            f.write(what + "\n")
        if self.dies_at and sum(1 for _ in open(name)) == self.dies_at:
            os._exit(1)

    def extract(self, prompt: str, **request) -> dict:
        self._note(prompt)
        return {"text": '{"said": "' + prompt + '"}', "prompt_tokens": 1, "completion_tokens": 2}

    def recognize(self, image, mime, detect) -> dict:
        self._note(bytes(image).decode())
        return {"reply": "seen " + bytes(image).decode(), "prompt_tokens": 3, "completion_tokens": 4}


def calls(folder):
    with open(f"{folder}/calls") as f:
        return Counter(f.read().split())


def test_task_that_dies(spark, tmp_path):
    prompts = spark.createDataFrame([(k, f"p{k}") for k in range(20)], "id int, prompt string").repartition(2)
    journal = Journal(str(tmp_path / "journal"), lease=0.5)
    with pytest.raises(Exception):  # noqa: B017
        call_llm(prompts, Counting(str(tmp_path), 9), ["id"], pool=1, journal=journal).collect()
    first = calls(tmp_path)
    answered = {p for p in first if journal.read(call_key("llm", "counting", {}, p))}
    assert sum(first.values()) >= 9 and answered and set(unanswered(journal.folder)) == {call_key("llm", "counting", {}, p) for p in set(first) - answered}
    rows = call_llm(prompts, Counting(str(tmp_path)), ["id"], pool=1, journal=journal).collect()
    assert sorted(r["id"] for r in rows) == list(range(20)) and all(f"p{r['id']}" in r["extracted"] and r["error"] is None for r in rows)
    both = calls(tmp_path)
    assert all(both[p] == 1 for p in answered) and all(both[f"p{k}"] == (2 if f"p{k}" in first and f"p{k}" not in answered else 1) for k in range(20))
    call_llm(prompts, Counting(str(tmp_path)), ["id"], journal=journal).collect()
    assert calls(tmp_path) == both and not unanswered(journal.folder)


def test_images_and_settings(spark, tmp_path):
    images = spark.createDataFrame([(k, f"i{k % 3}".encode(), "image/png", False) for k in range(3)], "id int, image binary, mime string, detect boolean")
    journal = Journal(str(tmp_path / "journal"))
    run = lambda df: sorted((r["id"], r["reply"], r["prompt_tokens"]) for r in call_ocr(df, Counting(str(tmp_path)), ["id"], journal=journal).collect())
    assert run(images) == run(images) == [(k, f"seen i{k}", 3) for k in range(3)]
    assert sum(calls(tmp_path).values()) == 3
    run(images.selectExpr("id", "image", "mime", "true AS detect"))  # another question
    assert sum(calls(tmp_path).values()) == 6


def test_failed_and_free_calls_are_not_kept(spark, tmp_path):
    class Failing(Counting):
        def extract(self, prompt, **request):
            self._note(prompt)
            raise ValueError("no")

    prompts = spark.createDataFrame([(1, "p")], "id int, prompt string")
    journal = Journal(str(tmp_path / "journal"), lease=0)
    for _ in range(2):
        assert call_llm(prompts, Failing(str(tmp_path)), ["id"], retries=0, journal=journal).first()["error"] == "ValueError: no"
    assert calls(tmp_path) == {"p": 2}
    call_llm(prompts, MockLlm(), ["id"], journal=Journal(str(tmp_path / "none"))).collect()
    assert not os.path.exists(tmp_path / "none")


def test_twins_wait_for_each_other(tmp_path):
    journal, asked = Journal(str(tmp_path), lease=30), []

    def call():
        asked.append(1)
        time.sleep(1)
        return {"x": "é"}

    found = []
    first = threading.Thread(target=lambda: found.append(journal.ask("k" * 64, call, "one")))
    first.start()
    time.sleep(0.4)
    found.append(journal.ask("k" * 64, call, "two"))
    first.join()
    assert found == [{"x": "é"}] * 2 and asked == [1]
    # A claim whose lease is over, of an owner that is gone.
    Journal(str(tmp_path), lease=0.3).write("z" * 64, "claim", {"owner": "gone", "at": time.time()})
    assert Journal(str(tmp_path), lease=0.3).ask("z" * 64, lambda: {"x": 2}, "three") == {"x": 2}
