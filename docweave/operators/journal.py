"""A journal of calls that cost: what came back is kept at once, so that a task that runs again does not pay again.

For each key there is a claim, written before the call, and an answer, written as soon as it is back, each a
file of its own in the shared folder (no store needs to append). An attempt that runs again, or a run that
begins again over the same folder, reads the answers first. A claim of another attempt that has no answer yet
is waited for as long as its lease lasts: it may be a twin that is still asking; after that its owner counts as
lost. Failed calls are not kept. A journal that cannot be written costs nothing but the safety.
"""

from __future__ import annotations

import hashlib
import json
import logging
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from docweave.sources.sink import file_system, put, replace

log = logging.getLogger("docweave.journal")
#: Seconds that a claim is respected, and between looks at it.
LEASE, LOOK = 60.0, 0.2


def call_key(*parts: object) -> str:
    """A key for what a call depends on; bytes go in as they are."""
    h = hashlib.sha256()
    for p in parts:
        data = p if isinstance(p, bytes) else json.dumps(p, sort_keys=True, ensure_ascii=False, default=str).encode()
        h.update(f"{len(data)}:".encode() + data)
    return h.hexdigest()


@dataclass(frozen=True)
class Journal:
    folder: str
    lease: float = LEASE

    def place(self, key: str, kind: str) -> str:
        return f"{self.folder.rstrip('/')}/{key[:2]}/{key}.{kind}"

    def read(self, key: str, kind: str = "answer") -> dict | None:
        from pyarrow.fs import FileType

        system, inner = file_system(self.place(key, kind))
        if system.get_file_info(inner).type == FileType.NotFound:
            return None
        with system.open_input_stream(inner) as f:
            return json.loads(f.read())

    def write(self, key: str, kind: str, content: dict) -> None:
        """Whole or not at all."""
        made = f"{self.place(key, kind)}-{uuid.uuid4().hex}"
        try:
            put(made, json.dumps(content, ensure_ascii=False).encode())
            replace(made, self.place(key, kind))
        except OSError as e:
            log.warning("%s of %s not kept: %s", kind, key, e)

    def ask(self, key: str, call: Callable[[], dict], owner: str) -> dict:
        """The answer that is kept, or that of call(), which is kept."""
        while (kept := self.read(key)) is None:
            claim = self.read(key, "claim")
            if claim is None or claim["owner"] == owner or time.time() - claim["at"] >= self.lease:
                self.write(key, "claim", {"owner": owner, "at": time.time()})
                kept = call()
                self.write(key, "answer", kept)
                break
            time.sleep(min(LOOK, self.lease))
        return kept


def attempt() -> str:
    """This attempt of this task."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return f"{context.stageId()}-{context.taskAttemptId()}" if context else "driver"


def unanswered(folder: str) -> list[str]:
    """Keys that were asked for without an answer: what a lost run may have paid for in vain."""
    from pyarrow import fs

    system, inner = file_system(folder)
    names = [f.base_name for f in system.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True)) if f.is_file]
    keys = {kind: {n.removesuffix(f".{kind}") for n in names if n.endswith(f".{kind}")} for kind in ("claim", "answer")}
    return sorted(keys["claim"] - keys["answer"])
