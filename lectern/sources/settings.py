"""Configuration and vocabulary files."""

from __future__ import annotations

import os
import re
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Least and greatest value of numeric settings; values outside are ignored.
RANGES = {
    "chunk_chars": (500, 50_000), "max_tags": (1, 32), "ocr_dpi": (72, 1200), "ocr_workers": (1, 64), "min_chars_per_page": (0, 10_000),
    "embed_batch": (1, 1024), "embed_tokens": (64, 32_768), "context_tokens": (512, 1_048_576), "watch_interval": (2, 86_400), "watch_enrich": (1, 1000),
}


@dataclass(frozen=True)
class Config:
    chunk_chars: int = 6000
    max_tags: int = 6
    ocr_dpi: int = 300
    ocr_workers: int = 3
    min_chars_per_page: int = 50
    embed_batch: int = 32
    embed_tokens: int = 1500
    context_tokens: int = 8192
    watch_interval: int = 5
    watch_enrich: int = 8

    def updated(self, **values) -> Config:
        """With the values that are known and inside their range."""
        ok = {k: int(v) for k, v in values.items() if k in RANGES and str(v).lstrip("-").isdigit() and RANGES[k][0] <= int(v) <= RANGES[k][1]}
        return replace(self, **ok)

    def save(self, path: str) -> None:
        text = "".join(f"{k}: {v}\n" for k, v in asdict(self).items())
        with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w") as f:
            f.write(text)


def _flat(path: Path) -> dict[str, str]:
    return dict(m.groups() for m in re.finditer(r"(?m)^(\w+):[ \t]*(\S.*?)[ \t]*$", path.read_text())) if path.exists() else {}


def load(flag: str | None = None, env: str = "LECTERN_CONFIG") -> Config:
    """From the file that the flag names, else the environment, else the working directory; flags win."""
    path = Path(flag or os.environ.get(env) or "config.yaml")
    known = {f.name for f in fields(Config)}
    return Config().updated(**{k: v for k, v in _flat(path).items() if k in known})


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(tag, description) of a vocabulary file; a missing file is an empty vocabulary."""
    p = Path(path)
    text = p.read_text() if p.exists() else ""
    found = {k.strip().lower(): v.strip().strip("\"'") for k, v in re.findall(r"(?m)^[ \t]+([^\s:#][^:\n]*):[ \t]*(.*)$", text)}
    return spark.createDataFrame(sorted(found.items()), "tag string, description string")


def save_vocabulary(df: DataFrame, path: str) -> None:
    rows = sorted((r["tag"].strip().lower(), r["description"] or "") for r in df.collect())
    Path(path).write_text("tags:\n" + "".join(f'  {k}: "{v}"\n' for k, v in rows))
