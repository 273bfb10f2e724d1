"""Settings of a study, read from a YAML or JSON file into one flat mapping."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

#: Marks a key that a file must give.
GIVEN = object()

# Sections and keys of a settings file, and what holds where a key isn't there.
DEFAULTS = {
    "data": {"root": GIVEN, "actigraphy_root": "data/raw/actigraphy"},
    "preprocessing": {"min_days_per_participant": GIVEN, "excluded_features": GIVEN},
    "split": {"seed": GIVEN, "n_folds": GIVEN},
    "output": {"results_dir": GIVEN, "eda_dir": GIVEN},
    "cv": {"n_splits": 5, "n_reps": 20, "fixture_dir": "config/folds_repeated"},
}


class SettingsError(ValueError):
    """A settings file lacks sections or keys."""


class Settings(Mapping):
    """Values by 'section.key'. Lists are tuples; what a file says beyond the known keys is left out."""

    def __init__(self, values: dict):
        self._values = dict(values)

    def __getitem__(self, name: str):
        return self._values[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._values)

    def __len__(self) -> int:
        return len(self._values)

    def section(self, name: str) -> dict:
        """The keys of one section."""
        return {k.partition(".")[2]: v for k, v in self._values.items() if k.startswith(f"{name}.")}


def settings_of(found: Mapping, source: str = "settings") -> Settings:
    """Settings out of nested mappings. All that is missing is named at once."""
    values, missing = {}, []
    for section, keys in DEFAULTS.items():
        given = found.get(section)
        if not isinstance(given, Mapping):
            if GIVEN in keys.values():
                missing.append(section)
            given = {}
        for key, default in keys.items():
            value = given.get(key, default)
            if value is GIVEN:
                missing.append(f"{section}.{key}")
            values[f"{section}.{key}"] = tuple(value) if isinstance(value, list) else value
    if missing:
        raise SettingsError(f"{source} lacks {', '.join(missing)}")
    return Settings(values)


def read_settings(path: str) -> Settings:
    """Settings of a file on the driver: JSON by its name, else YAML."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    if path.endswith(".json"):
        found = json.loads(text)
    else:
        import yaml

        found = yaml.safe_load(text)
    return settings_of(found or {}, path)
