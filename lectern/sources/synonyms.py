"""Synonym dictionaries from YAML files: word -> list of synonyms."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


class SynonymTable:
    """Entries of all files of a folder; an entry in two files is merged."""

    def __init__(self, entries: dict[str, list[str]] | None = None):
        self.entries = {k: list(v) for k, v in (entries or {}).items()}

    @classmethod
    def load(cls, folder: str) -> SynonymTable:
        import yaml

        table = cls()
        for path in sorted(Path(folder).glob("*.y*ml")):
            for word, synonyms in (yaml.safe_load(path.read_text(encoding="utf-8")) or {}).items():
                table.add(str(word), [str(s) for s in ([synonyms] if isinstance(synonyms, str) else synonyms or [])])
        return table

    def add(self, word: str, synonyms: list[str]) -> None:
        mine = self.entries.setdefault(word, [])
        mine += [s for s in dict.fromkeys(synonyms) if s not in mine]

    def get(self, word: str) -> list[str]:
        return list(self.entries.get(word, []))

    def save(self, path: str) -> None:
        import yaml

        Path(path).write_text(yaml.safe_dump(self.entries, allow_unicode=True, sort_keys=True), encoding="utf-8")

    def frame(self, spark: SparkSession) -> DataFrame:
        """(word, synonyms)."""
        return spark.createDataFrame(sorted(self.entries.items()), "word string, synonyms array<string>")
