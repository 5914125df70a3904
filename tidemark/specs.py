"""Rules as plain data: panels, code rules, text rules, studies, feature sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import timedelta


@dataclass(frozen=True)
class Panel:
    """Measured items that become one ``<stem>_first`` column each."""

    items: Mapping[object, str]

    @property
    def stems(self) -> list[str]:
        return list(self.items.values())

    @property
    def first_columns(self) -> list[str]:
        return [f"{stem}_first" for stem in self.stems]

    @property
    def missing_columns(self) -> list[str]:
        return [f"{stem}_missing" for stem in self.stems]


@dataclass(frozen=True)
class Codes:
    """Codes of one system: any of ``prefixes`` or inside any closed text range."""

    prefixes: Sequence[str] = ()
    ranges: Sequence[tuple[str, str]] = ()


@dataclass(frozen=True)
class CodeRule:
    """A flag raised when any code of an entity matches its system's codes."""

    name: str
    systems: Mapping[int, Codes]


@dataclass(frozen=True)
class TextRule:
    """A flag raised when lower-cased free text contains ``pattern``."""

    name: str
    pattern: str


@dataclass(frozen=True)
class Vitals:
    """Charted items: raw id -> name, unit conversion and plausible range."""

    items: Mapping[object, str]
    bounds: Mapping[str, tuple[float, float]]
    suffix: str = "_24h"
    # raw names that are merged into another one, Fahrenheit ones converted
    celsius: str = "temp_c"
    fahrenheit: str = "temp_f"
    temperature: str = "temp"

    @property
    def merged(self) -> dict[object, str]:
        """Raw id -> final name, both temperature scales under one."""
        scales = (self.celsius, self.fahrenheit)
        return {raw: self.temperature if name in scales else name for raw, name in self.items.items()}

    def ids(self, *names: str) -> list[object]:
        """Raw ids listed under any of the raw names."""
        return [raw for raw, name in self.items.items() if name in names]

    @property
    def stems(self) -> list[str]:
        return [f"{name}{self.suffix}" for name in self.bounds]

    @property
    def value_columns(self) -> list[str]:
        return [f"{stem}_{kind}" for stem in self.stems for kind in ("first", "min", "max")]

    @property
    def missing_columns(self) -> list[str]:
        return [f"{stem}_missing" for stem in self.stems]


@dataclass(frozen=True)
class Study:
    """Everything that differs between two schemas using the same operators."""

    core: Panel
    extended: Panel
    comorbidity: Sequence[CodeRule]
    weights: Mapping[str, int]
    chronic: Sequence[CodeRule]
    medications: Sequence[TextRule]
    procedures: Sequence[TextRule]
    vitals: Vitals
    window: timedelta
    split_cut: int
    entity: str = "hadm_id"
    subject: str = "subject_id"
    anchor: str = "admittime"
    label: str = "y_inhosp_death"
    score: str = "charlson_min"
    age: str = "age_at_admit"
    min_age: int = 18
    demographics: Sequence[str] = ()
    stay_columns: Sequence[str] = ()
    # (version, family) -> columns left out of that feature set
    left_out: Mapping[tuple[str, str], Sequence[str]] = field(default_factory=dict)


@dataclass(frozen=True)
class FeatureSet:
    """Model inputs by kind.  The tree family treats flags as plain numbers."""

    version: str
    family: str
    continuous: Sequence[str]
    binary: Sequence[str] = ()
    categorical: Sequence[str] = ()

    @property
    def columns(self) -> list[str]:
        return [*self.continuous, *self.binary, *self.categorical]


VERSIONS = ("V1", "V2", "V3", "V4", "V5", "V6")
FAMILIES = ("linear", "tree")


def feature_set(study: Study, version: str, family: str) -> FeatureSet:
    """Inputs of one model run, derived from the study's groups of columns."""
    if version not in VERSIONS or family not in FAMILIES:
        raise ValueError(f"unknown feature set {version}/{family}")
    panel = study.core if version == "V1" else study.extended
    numbers = [study.age, *panel.first_columns, study.score]
    flags: list[str] = []
    if version != "V1":
        flags += panel.missing_columns
    if version in ("V3", "V4", "V5", "V6"):
        flags += [rule.name for rule in (*study.medications, *study.procedures, *study.chronic)]
    if version in ("V4", "V5"):
        numbers += study.vitals.value_columns
        flags += study.vitals.missing_columns
    out = set(study.left_out.get((version, family), ()))
    numbers = [c for c in numbers if c not in out]
    flags = [c for c in flags if c not in out]
    if family == "tree":
        return FeatureSet(version, family, tuple(numbers + flags))
    return FeatureSet(version, family, tuple(numbers), tuple(flags))
