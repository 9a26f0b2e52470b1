"""Web-page extraction and template drift on Spark DataFrames."""

from .model import TARGETS, ExtractionSpec, ExtractionTarget, FieldRule, ItemField

__all__ = ["TARGETS", "ExtractionSpec", "ExtractionTarget", "FieldRule", "ItemField"]
