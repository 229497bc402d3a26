"""Repository settings: a two-level YAML subset, and the dimension table made from it."""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame, SparkSession, functions as F


def parse_yaml(text: str) -> dict:
    """Nested maps of scalars by indentation, which is all that the settings use."""
    root: dict = {}
    stack = [(-1, root)]
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#") or line.strip() == "---":
            continue
        m = re.match(r"^(\s*)([^:]+):(?:\s+(.*))?$", line)
        if not m:
            raise ValueError(f"not a setting: {line}")
        while stack[-1][0] >= len(m[1]):
            stack.pop()
        value = (m[3] or "").strip().strip("'\"")
        stack[-1][1][m[2].strip()] = value if m[3] else {}
        if not m[3]:
            stack.append((len(m[1]), stack[-1][1][m[2].strip()]))
    return root


def repositories(spark: SparkSession, text: str) -> DataFrame:
    """(slug, name, settings): one row for each repository; a file of settings is small by nature."""
    rows = [(slug, v.get("name") if isinstance(v, dict) else None, {k: str(x) for k, x in v.items() if not isinstance(x, dict)} if isinstance(v, dict) else {}) for slug, v in parse_yaml(text).items()]
    return spark.createDataFrame(rows, "slug string, name string, settings map<string, string>")


def known_only(files: DataFrame, repos: DataFrame) -> DataFrame:
    """Files whose repository folder is configured."""
    return files.join(repos.select(F.col("slug").alias("repository")), "repository", "left_semi")


class Cached:
    """A value that is made again after its time to live."""

    def __init__(self, make, seconds: float = 3600, clock=time.monotonic):
        self.make, self.seconds, self.clock, self.until = make, seconds, clock, None

    def get(self):
        if self.until is None or self.clock() >= self.until:
            self.value, self.until = self.make(), self.clock() + self.seconds
        return self.value
