"""Extraction specs, target schemas and their Spark types."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import types as T

from .functions.transforms import check_transform

# The selector kinds a spec may use.
SELECTOR_TYPES = ("css", "xpath", "json_ld", "regex")
LINK_SELECTOR_TYPES = ("css", "xpath")


@dataclass(frozen=True)
class FieldRule:
    """How one target field is read from a page."""

    field: str
    selector: str
    selector_type: str
    attribute: str | None = None
    transform: str | None = None
    optional: bool = False

    def __post_init__(self) -> None:
        if self.selector_type not in SELECTOR_TYPES:
            raise ValueError(f"unknown selector type {self.selector_type!r}")
        check_transform(self.transform)


@dataclass(frozen=True)
class ExtractionSpec:
    """Recipe for turning pages of one template into rows."""

    field_rules: tuple[FieldRule, ...]
    container_selector: str | None = None
    container_selector_type: str = "css"
    confidence: float = 0.0
    notes: str | None = None
    next_page_selector: str | None = None
    next_page_selector_type: str = "css"
    next_page_attribute: str = "href"
    detail_url_field: str | None = None
    detail_field_rules: tuple[FieldRule, ...] = ()

    def __post_init__(self) -> None:
        if self.container_selector_type not in SELECTOR_TYPES:
            raise ValueError(f"unknown container selector type {self.container_selector_type!r}")
        if self.next_page_selector_type not in LINK_SELECTOR_TYPES:
            raise ValueError(f"next page selector must be css or xpath, got {self.next_page_selector_type!r}")

    def effective_rules(self) -> dict[str, FieldRule]:
        """Rules by field; a repeated field keeps its first place and its last rule."""
        return {rule.field: rule for rule in self.field_rules}

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)

    @staticmethod
    def from_dict(data: dict) -> ExtractionSpec:
        """Checked construction; unknown keys are ignored and missing ones get defaults."""
        known = {k: v for k, v in data.items() if k in ExtractionSpec.__dataclass_fields__}
        if "field_rules" not in known:
            raise ValueError("a spec needs field_rules")
        for key in ("field_rules", "detail_field_rules"):
            if key in known:
                known[key] = tuple(
                    FieldRule(**{k: v for k, v in r.items() if k in FieldRule.__dataclass_fields__})
                    for r in known[key]
                )
        return ExtractionSpec(**known)

    @staticmethod
    def from_json(text: str) -> ExtractionSpec:
        return ExtractionSpec.from_dict(json.loads(text))


_RULE_TYPE = T.StructType(
    [
        T.StructField("field", T.StringType()),
        T.StructField("selector", T.StringType()),
        T.StructField("selector_type", T.StringType()),
        T.StructField("attribute", T.StringType()),
        T.StructField("transform", T.StringType()),
        T.StructField("optional", T.BooleanType()),
    ]
)
#: For ``from_json`` over a column of stored specs.
SPEC_SCHEMA = T.StructType(
    [
        T.StructField("container_selector", T.StringType()),
        T.StructField("container_selector_type", T.StringType()),
        T.StructField("field_rules", T.ArrayType(_RULE_TYPE)),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("notes", T.StringType()),
        T.StructField("next_page_selector", T.StringType()),
        T.StructField("next_page_selector_type", T.StringType()),
        T.StructField("next_page_attribute", T.StringType()),
        T.StructField("detail_url_field", T.StringType()),
        T.StructField("detail_field_rules", T.ArrayType(_RULE_TYPE)),
    ]
)

# Item field kinds: 'str', 'int', 'url', 'datetime'.
_SPARK_TYPE = {"str": "string", "int": "bigint", "url": "string", "datetime": "string"}


@dataclass(frozen=True)
class ItemField:
    name: str
    kind: str
    required: bool = True

    def __post_init__(self) -> None:
        if self.kind not in _SPARK_TYPE:
            raise ValueError(f"unknown item field kind {self.kind!r}")

    @property
    def spark_type(self) -> str:
        return _SPARK_TYPE[self.kind]


@dataclass(frozen=True)
class ExtractionTarget:
    """The row schema a job is judged against, with its gates."""

    name: str
    fields: tuple[ItemField, ...]
    cardinality: str = "many"
    min_rows: int = 1
    required_fields: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.cardinality not in ("one", "many"):
            raise ValueError(f"cardinality must be 'one' or 'many', got {self.cardinality!r}")

    @property
    def floor(self) -> int:
        return self.min_rows if self.cardinality == "many" else 1


JOB_POSTINGS = ExtractionTarget(
    name="job_postings",
    fields=(
        ItemField("title", "str"),
        ItemField("company", "str"),
        ItemField("location", "str", required=False),
        ItemField("salary_min", "int", required=False),
        ItemField("salary_max", "int", required=False),
        ItemField("url", "url"),
        ItemField("posted_at", "datetime", required=False),
    ),
    required_fields=("title", "company", "url"),
)

#: Targets by name; add an entry to make a target available.
TARGETS: dict[str, ExtractionTarget] = {JOB_POSTINGS.name: JOB_POSTINGS}
