"""Records of runs outside Spark: hashes, seeds, a folder of parameters, metrics and tags for each run."""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import random
import shutil
import traceback
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from pathlib import Path

import numpy as np


def file_sha256(path: str | Path) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 16):
            h.update(part)
    return h.hexdigest()


def array_sha256(a: np.ndarray) -> str:
    """Of shape, type and content, whatever the memory layout."""
    a = np.ascontiguousarray(a)
    return hashlib.sha256(f"{a.shape}|{a.dtype.str}|".encode() + a.tobytes()).hexdigest()


@contextlib.contextmanager
def seeded(seed: int) -> Iterator[np.random.Generator]:
    """A generator of its own; the global states are seeded inside and put back after."""
    before = random.getstate(), np.random.get_state()
    random.seed(seed)
    np.random.seed(seed % 2**32)
    try:
        yield np.random.default_rng(seed)
    finally:
        random.setstate(before[0])
        np.random.set_state(before[1])


@dataclass
class Record:
    """What a run leaves. A failed or skipped run has no metrics; its failure says why."""

    run_id: str
    params: dict[str, object] = field(default_factory=dict)
    metrics: dict[str, float | None] = field(default_factory=dict)
    tags: dict[str, str] = field(default_factory=dict)
    status: str = "success"
    failure: dict[str, str] | None = None

    def failed(self, error: BaseException) -> Record:
        self.status, self.metrics = "failed", dict.fromkeys(self.metrics)
        self.failure = {"error_type": type(error).__name__, "error_message": str(error), "trace": "".join(traceback.format_exception(error))[-2000:]}
        return self


def save_record(root: str | Path, record: Record, artifacts: dict[str, str | Path] | None = None) -> Path:
    """root/run_id with params/, metrics/ and tags/, a file each, artifacts/ (copies of the given files by name), and the whole as
    JSON; written beside and moved into place. root is a folder of the driver's or one that it has mounted: a run has one record."""
    home = Path(root) / record.run_id
    for name, source in (artifacts or {}).items():
        (home / "artifacts").mkdir(parents=True, exist_ok=True)
        shutil.copyfile(source, home / "artifacts" / name)
    for kind, values in (("params", record.params), ("metrics", record.metrics), ("tags", record.tags)):
        (home / kind).mkdir(parents=True, exist_ok=True)
        for name, value in values.items():
            text = "" if value is None else f"{value:.6f}" if kind == "metrics" else str(value)
            (home / kind / name).write_text(text)
    part = home / "record.json.part"
    part.write_text(json.dumps(asdict(record), sort_keys=True, default=str))
    os.replace(part, home / "record.json")
    return home


def load_records(root: str | Path) -> list[Record]:
    """Records under root in order of run id; folders without a readable record are passed over."""
    out = []
    for path in sorted(Path(root).glob("*/record.json")):
        with contextlib.suppress(ValueError, TypeError):
            out.append(Record(**json.loads(path.read_text())))
    return out
