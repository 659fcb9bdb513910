"""Pattern and motif banks: the built-in ones and YAML files of the user.

A language file ``<code>.yaml`` is looked for in the given directories in order; the first one
found is taken whole. Where there is none, English has its fixed bank and twelve other languages
have banks built by a rule (``sources.languages``).
"""

from __future__ import annotations

import os
import re
import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from quillsift.sources import fixed, languages as built

#: Directories that are searched first when none are given, separated as in PATH.
DIRECTORIES_VARIABLE = "QUILLSIFT_PATTERNS"


def default_directories(app: str = "quillsift") -> list[str]:
    """Where files of a language are looked for: the variable's directories, those of the user, those of the project."""
    named = [d for d in os.environ.get(DIRECTORIES_VARIABLE, "").split(os.pathsep) if d]
    return [*named, os.path.join("~", ".config", app, "patterns"), os.path.join(os.getcwd(), f".{app}", "patterns")]


def _valid(pattern: str) -> bool:
    try:
        re.compile(pattern, re.IGNORECASE)
    except re.error:
        return False
    return True


@dataclass
class Bank:
    """Patterns and motifs by category, in order, and settings by language."""

    patterns: dict[str, list[str]] = field(default_factory=dict)
    motifs: dict[str, list[str]] = field(default_factory=dict)
    settings: dict[str, dict] = field(default_factory=dict)
    by_language: list[tuple[str, str, str, str]] = field(default_factory=list)

    @classmethod
    def default(cls) -> Bank:
        """The bank without a choice of languages: English patterns, and the shorter motif list."""
        bank = cls.load(["en"], [])
        bank.motifs = {c: list(m) for c, m in fixed.DEFAULT_MOTIFS.items()}
        return bank

    @classmethod
    def load(cls, languages: list[str] | None = None, directories: list[str] | None = None, app: str = "quillsift") -> Bank:
        """The bank of ``languages`` (["en"] if None; "all" for every known one).

        A language without a bank, and a file that is not valid YAML, is skipped with a warning; an invalid
        expression is skipped. ``directories`` None stands for those of the user and the project, under the name ``app``. Equal expressions of two languages stay two entries.
        """
        languages = ["en"] if languages is None else languages
        if "all" in languages:
            languages = list(fixed.LANGUAGES)
        if directories is None:
            directories = default_directories(app)
        bank = cls()
        for language in languages:
            bank._add(language, _language_data(language, directories))
        return bank

    def _add(self, language: str, data: dict | None) -> None:
        if not isinstance(data, dict):
            warnings.warn(f"no pattern bank for language {language!r}", stacklevel=3)
            return
        if "settings" in data:
            self.settings[language] = data["settings"] or {}
        for kind, into in (("patterns", self.patterns), ("motifs", self.motifs)):
            for category, entries in (data.get(kind) or {}).items():
                kept = [str(e) for e in entries or [] if kind == "motifs" or _valid(str(e))]
                into.setdefault(category, []).extend(kept)
                self.by_language += [(language, kind, category, e) for e in kept]

    def uses_word_boundaries(self, language: str) -> bool:
        """Whether the language separates words; true where its file does not say."""
        return bool(self.settings.get(language, {}).get("word_boundaries", True))

    def motif_list(self) -> list[tuple[str, str]]:
        """(motif in lower case, category) in order."""
        return [(m.lower(), c) for c, motifs in self.motifs.items() for m in motifs]

    def frame(self, spark: SparkSession) -> DataFrame:
        """(language, kind, category, ord, entry): the bank as a small dimension table."""
        rows = [(language, kind, category, k, entry) for k, (language, kind, category, entry) in enumerate(self.by_language)]
        return spark.createDataFrame(rows, "language string, kind string, category string, ord int, entry string")


def _language_data(language: str, directories: list[str]) -> dict | None:
    for directory in directories:
        path = os.path.join(os.path.expanduser(directory), f"{language}.yaml")
        if os.path.exists(path):
            import yaml

            with open(path, encoding="utf-8") as f:
                try:
                    return yaml.safe_load(f)
                except yaml.YAMLError:
                    return None
    return {"patterns": fixed.PATTERNS, "motifs": fixed.MOTIFS} if language == "en" else built.bank(language)


def available_languages() -> list[str]:
    """Codes that "all" stands for."""
    return list(fixed.LANGUAGES)
