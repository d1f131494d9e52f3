"""A folder of word lists and tables by name, with versions: what a corpus catalog knows, without a network."""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from saithong.sources import lexicons

_RECORDS = "catalog.json"


def safe_name(name: str) -> str:
    """A name as that of a file: other characters than letters, digits, dots, hyphens and underscores become underscores, leading dots go."""
    return "".join(c if c.isalnum() or c in "._-" else "_" for c in name).lstrip(".") or "_"


def safe_join(folder: str | os.PathLike, *parts: str) -> Path:
    """A path inside a folder; ValueError for one that leads out of it."""
    base = Path(folder).resolve()
    path = base.joinpath(*parts).resolve()
    if path != base and base not in path.parents:
        raise ValueError(f"{path} is outside of {base}")
    return path


class Catalog:
    """Lists in a folder: files as they lie there (name.txt, name.csv, ...), and versions that add() recorded. The folder is given, or named by SAITHONG_DATA, or ~/saithong-data."""

    def __init__(self, folder: str | os.PathLike | None = None):
        self.folder = Path(folder or os.environ.get("SAITHONG_DATA") or Path.home() / "saithong-data")

    def _records(self) -> dict[str, dict[str, str]]:
        path = self.folder / _RECORDS
        return json.loads(path.read_text("utf-8")) if path.exists() else {}

    def _write(self, records: dict[str, dict[str, str]]) -> None:
        self.folder.mkdir(parents=True, exist_ok=True)
        (self.folder / _RECORDS).write_text(json.dumps(records, indent=1, sort_keys=True), "utf-8")

    def __iter__(self) -> Iterator[str]:
        files = {p.stem for p in self.folder.glob("*.*") if p.name != _RECORDS} if self.folder.exists() else set()
        return iter(sorted(files | set(self._records())))

    def __contains__(self, name: str) -> bool:
        return self.path(name) is not None

    def detail(self, name: str, version: str = "") -> dict[str, str]:
        """{name, version, file} of a list; empty for an unknown one. Without a version the last in order."""
        versions = self._records().get(name, {})
        if versions:
            version = version or max(versions, key=lambda v: [int(x) if x.isdigit() else -1 for x in v.split(".")])
            return {"name": name, "version": version, "file": versions[version]} if version in versions else {}
        plain = sorted(self.folder.glob(f"{safe_name(name)}.*")) if not version and self.folder.exists() else []
        return {"name": name, "version": "", "file": plain[0].name} if plain and plain[0].name != _RECORDS else {}

    def path(self, name: str, version: str = "") -> Path | None:
        found = self.detail(name, version)
        return safe_join(self.folder, found["file"]) if found else None

    def add(self, name: str, file: str | os.PathLike, version: str = "1.0") -> Path:
        """Copies a file into the folder as a version of a list."""
        source = Path(file)
        target = safe_join(self.folder, f"{safe_name(name)}-{safe_name(version)}{source.suffix}")
        self.folder.mkdir(parents=True, exist_ok=True)
        shutil.copyfile(source, target)
        records = self._records()
        records.setdefault(name, {})[version] = target.name
        self._write(records)
        return target

    def remove(self, name: str) -> bool:
        """Deletes all recorded versions of a list; whether there were any."""
        records = self._records()
        versions = records.pop(name, {})
        for file in versions.values():
            safe_join(self.folder, file).unlink(missing_ok=True)
        if versions:
            self._write(records)
        return bool(versions)

    def lines(self, name: str) -> list[str]:
        """The lines of a list, trimmed, without comments and empty ones: for small lists that the driver needs."""
        path = self.path(name)
        if path is None:
            raise KeyError(name)
        rows = (line.split("#", 1)[0].strip() for line in path.read_text("utf-8-sig").splitlines())
        return [r for r in rows if r]

    def words(self, spark: SparkSession, name: str) -> DataFrame:
        """(word): a list as a table."""
        path = self.path(name)
        if path is None:
            raise KeyError(name)
        return lexicons.word_list(spark, str(path))
