"""Run configuration: command line over file over default, and the paths a run may touch."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path

#: The one seed every run must carry.
GLOBAL_SEED = 619


@dataclass(frozen=True)
class RunConfig:
    """Settings of a run.  ``gallery_scope``, ``similarity``, ``correction`` and ``max_n`` fill gaps of the contract."""

    run_id: str = "run"
    seed: int = GLOBAL_SEED
    data_root: str = "data"
    output_root: str = "runs"
    gallery_scope: tuple[str, ...] = ("cell_line",)
    similarity: str = "cosine"  # or euclidean
    correction: str = "difference"  # or ratio
    max_n: int | None = None
    chunk_size: int = 2048
    batch_size: int = 32
    max_length: int = 1200
    knobs: dict = field(default_factory=dict)


def resolved(given: dict, config_file: str | None = None) -> RunConfig:
    """Values that are given win over the file's, those over the defaults; unknown ones go to ``knobs``."""
    read = json.loads(Path(config_file).read_text()) if config_file else {}
    both = read | {k: v for k, v in given.items() if v is not None}
    known = {f.name for f in fields(RunConfig)} - {"knobs"}
    return RunConfig(**{k: v for k, v in both.items() if k in known}, knobs={k: v for k, v in both.items() if k not in known})


def sequence_length(config: dict, args: dict) -> int:
    """The configured length, else the model's own ``max_seq_len`` or ``max_length``, else 1200."""
    for value in (config.get("max_length"), args.get("max_seq_len"), args.get("max_length")):
        if value is not None:
            return int(value)
    return 1200


def first_existing(candidates: dict[str, str]) -> tuple[str, str]:
    """(label, path) of the first candidate that exists, in the order given."""
    for label, path in candidates.items():
        if Path(path).exists():
            return label, path
    raise FileNotFoundError(f"none exists: {', '.join(f'{k}={v}' for k, v in candidates.items())}")


def within(path: str, roots: list[str], follow_links: bool = True) -> bool:
    """Whether a path lies under one of the roots; links are followed or only made absolute."""
    at = (lambda p: Path(p).resolve()) if follow_links else (lambda p: Path(p).absolute())
    return any(at(path).is_relative_to(at(r)) for r in roots)
