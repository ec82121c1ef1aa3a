"""Settings: a JSON file, over which a few environment variables win."""

from __future__ import annotations

import json
import os
import warnings
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from pathlib import Path

from ledgerlens.operators.boxes import ASPECT, LEAST_AREA, PADDING, REDS
from ledgerlens.sources.files import COLUMNS, SHEETS

# Variables that override settings where they aren't empty; names of our own win over older ones.
VARIABLES = {
    "input_dir": ["LEDGERLENS_INPUT_DIR", "CAPTURADOR_INPUT_DIR"],
    "output_dir": ["LEDGERLENS_OUTPUT_DIR", "CAPTURADOR_OUTPUT_DIR"],
    "quarantine_dir": ["LEDGERLENS_QUARANTINE_DIR", "CAPTURADOR_QUARANTINE_DIR"],
    "tesseract_cmd": ["TESSERACT_CMD"],
    "tessdata_prefix": ["TESSDATA_PREFIX"],
    "redis_url": ["REDIS_URL"],
}


@dataclass
class Settings:
    """ignored: keys of the file that no setting has."""

    input_dir: str = "documentos_ingresados"
    output_dir: str = "output"
    quarantine_dir: str = "quarantine"
    tesseract_cmd: str = "tesseract"
    tessdata_prefix: str = ""
    redis_url: str = "redis://localhost:6379/0"
    columns: list[str] = field(default_factory=lambda: list(COLUMNS))
    sheets: tuple[str, str] = SHEETS
    reds: list = field(default_factory=lambda: [[list(low), list(high)] for low, high in REDS])
    least_area: int = LEAST_AREA
    aspect: tuple[float, float] = ASPECT
    padding: int = PADDING
    files_per_batch: int = 1_000
    seconds_between_batches: int = 0
    ignored: list[str] = field(default_factory=list)

    def __post_init__(self):
        unknown = [c for c in self.columns if c not in COLUMNS]
        if unknown or len(self.sheets) != 2 or self.files_per_batch < 1 or self.seconds_between_batches < 0:
            raise ValueError(f"settings out of range: columns {unknown}, sheets {self.sheets}, files {self.files_per_batch}, seconds {self.seconds_between_batches}")
        colours = [c for pair in self.reds for c in pair]
        if any(len(c) != 3 or not 0 <= c[0] <= 180 or not all(0 <= x <= 255 for x in c[1:]) for c in colours) or self.least_area <= 0 or len(self.aspect) != 2:
            raise ValueError(f"settings out of range: reds {self.reds}, least area {self.least_area}, aspect {self.aspect}")


def load(path: str | None = None, environment: Mapping[str, str] = os.environ) -> Settings:
    """Settings of a file, defaults for what it lacks; without a file, defaults. Keys that aren't known are told by a warning, and in `ignored`."""
    said = json.loads(Path(path).read_text(encoding="utf-8")) if path and Path(path).exists() else {}
    known = {f.name for f in fields(Settings)} - {"ignored"}
    ignored = sorted(set(said) - known)
    if ignored:
        warnings.warn(f"settings that aren't known: {', '.join(ignored)}", stacklevel=2)
    found = {k: next((environment[v] for v in names if environment.get(v)), None) for k, names in VARIABLES.items()}
    said = {k: v for k, v in said.items() if k in known} | {k: v for k, v in found.items() if v}
    return Settings(**said, ignored=ignored)
