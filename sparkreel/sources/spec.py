"""Job specs: JSON documents decoded to a fixed schema, with defaults and unit conversions."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkreel.functions import easing
from sparkreel.functions.resolve import TRANSITIONS


class RenderError(Exception):
    """Base of all errors."""


class SpecError(RenderError):
    """A document that does not decode, or lacks a required field."""


class NoFrame(RenderError):
    """A probe found no frame at or after its time."""


class DecodeError(RenderError):
    """An input that cannot be read as frames."""


class NoVideo(RenderError):
    """An input that has no frames."""


class ImageError(RenderError):
    """An image that does not decode."""


class LutError(RenderError):
    """A lookup table that does not parse."""


#: The part of a spec that grades and resizes, as a schema for ``from_json``; other fields are ignored.
SCHEMA = """
output string, preset string, input string, codec string,
inputs array<struct<path:string, transition:struct<type:string, duration:double, ease:string>>>,
grade struct<brightness:double, contrast:double, saturation:double, tint:double, lutMix:double, lutPath:string>,
bypass struct<mirror:boolean, zoom:double, cropPct:double, colorTintDeg:double, noise:double, grain:double, edgeBlurSigma:double, edgeBlurBand:double>
"""
#: What a missing field means.
GRADE = {"brightness": 0.0, "contrast": 1.0, "saturation": 1.0, "tint": 0.0, "lutMix": 0.0}
BYPASS = {"mirror": False, "zoom": 1.0, "cropPct": 0.0, "colorTintDeg": 0.0, "noise": 0.0, "grain": 0.0, "edgeBlurSigma": 0.0, "edgeBlurBand": 0.12}


def decoded(text: Column) -> Column:
    """A struct of SCHEMA; a document that is no JSON fails the query."""
    return F.from_json(text, SCHEMA, {"mode": "FAILFAST"})


def grade_field(spec: Column, name: str) -> Column:
    """A grading value with its default; a table path with no amount means the whole table."""
    value = F.coalesce(spec["grade"][name], F.lit(GRADE[name]))
    return F.when(spec["grade"]["lutPath"].isNotNull() & (value == 0), 1.0).otherwise(value) if name == "lutMix" else value


def crop_fraction(spec: Column) -> Column:
    return F.coalesce(spec["bypass"]["cropPct"], F.lit(0.0)) / 100


def tint_radians(spec: Column) -> Column:
    """The grade's tint plus the bypass tint, which is in degrees."""
    return grade_field(spec, "tint") + F.radians(F.coalesce(spec["bypass"]["colorTintDeg"], F.lit(0.0)))


@dataclass
class Job:
    """A validated spec. ``warnings`` names what fell back to a default."""

    output: str
    preset: str
    inputs: list[dict]
    grade: dict
    bypass: dict
    tracks: dict = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


def parse_job(text: str) -> Job:
    """A spec document as a Job. Raises SpecError."""
    try:
        doc = json.loads(text)
        for name in ("output", "preset"):
            if not isinstance(doc[name], str):
                raise TypeError(name)
    except (ValueError, KeyError, TypeError) as e:
        raise SpecError(f"spec does not decode: {e}") from e
    inputs = doc.get("inputs") or ([{"path": doc["input"]}] if doc.get("input") else [])
    if not inputs or any("path" not in i for i in inputs):
        raise SpecError("one of input and inputs is needed, each with a path")
    warnings, seen = [], set()
    parts = []
    for i in inputs:
        tr = i.get("transition")
        if tr and "type" not in tr:
            raise SpecError("a transition needs a type")
        if tr and tr["type"] not in TRANSITIONS:
            warnings.append(f"unknown transition {tr['type']}")
            tr = None
        ease = (tr or {}).get("ease", "linear")
        parts.append({"path": i["path"], "transition": tr and tr["type"], "duration": (tr or {}).get("duration", 0.5), "ease": ease})
    tracks = {}
    for name, keys in (doc.get("animate") or {}).items():
        for k in keys:
            if "t" not in k or "v" not in k:
                raise SpecError("a keyframe needs t and v")
            ease = k.get("ease", "linear")
            if easing.parse(ease) is None and ease not in seen:
                seen.add(ease)
                warnings.append(f"unknown ease {ease}")
        scale = math.pi / 180 if name == "colorTintDeg" else 0.01 if name == "cropPct" else 1.0
        tracks[name] = [(float(k["t"]), float(k["v"]) * scale, k.get("ease", "linear")) for k in keys]
    grade = GRADE | (doc.get("grade") or {})
    if grade.get("lutPath") and not grade["lutMix"]:
        grade["lutMix"] = 1.0
    return Job(doc["output"], doc["preset"], parts, grade, BYPASS | (doc.get("bypass") or {}), tracks, warnings)


def argument(name: str, argv: list[str]) -> str | None:
    """The value after the first ``name``."""
    return argv[argv.index(name) + 1] if name in argv[:-1] else None
