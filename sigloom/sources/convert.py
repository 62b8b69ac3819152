"""Content converters: DOCX and table boxes to markdown; a registry that chains them."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _text(p: ElementTree.Element) -> str:
    out = []
    for e in p.iter():
        if e.tag == _W + "t":
            out.append(e.text or "")
        elif e.tag == _W + "tab":
            out.append("\t")
        elif e.tag == _W + "br":
            out.append("\n")
    return "".join(out)


def _paragraph(p: ElementTree.Element) -> str:
    style = p.find(f"{_W}pPr/{_W}pStyle")
    name = (style.get(_W + "val") or "") if style is not None else ""
    text = _text(p).strip()
    if not text:
        return ""
    if m := re.fullmatch(r"[Hh]eading ?([1-6])", name):
        return "#" * int(m[1]) + " " + text
    if name.lower() == "title":
        return "# " + text
    if p.find(f"{_W}pPr/{_W}numPr") is not None or name.lower().startswith("list"):
        level = p.find(f"{_W}pPr/{_W}numPr/{_W}ilvl")
        return "  " * int(level.get(_W + "val") if level is not None else 0) + "- " + text
    return text


def _table(t: ElementTree.Element) -> str:
    rows = [[_text(c).strip().replace("|", "\\|").replace("\n", " ") for c in r.findall(_W + "tc")] for r in t.findall(_W + "tr")]
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def docx_to_markdown(content: bytes) -> str | None:
    """Headings, lists, tables and paragraphs of a DOCX file; None if it isn't one."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    body = root.find(_W + "body")
    parts = [_table(e) if e.tag == _W + "tbl" else _paragraph(e) for e in (body if body is not None else []) if e.tag in (_W + "p", _W + "tbl")]
    return "\n\n".join(x for x in parts if x)


@F.pandas_udf(T.StringType())
def docx_markdown(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else docx_to_markdown(bytes(b)))


Converter = Callable[[DataFrame], DataFrame]
_CONVERTERS: list[tuple[str, str, int, Converter]] = []


def converter(source: str, target: str, priority: int = 0) -> Callable[[Converter], Converter]:
    def add(fn: Converter) -> Converter:
        _CONVERTERS.append((source, target, priority, fn))
        return fn

    return add


def find(source: str, target: str) -> Converter | None:
    """The converter of the highest priority."""
    fit = [c for c in _CONVERTERS if c[0] == source and c[1] == target]
    return max(fit, key=lambda c: c[2])[3] if fit else None


def convert(df: DataFrame, *formats: str) -> DataFrame:
    """df (content, ...) taken through a chain of formats; a missing step is an error."""
    for a, b in zip(formats[:-1], formats[1:]):
        fn = find(a, b)
        if fn is None:
            raise ValueError(f"no converter from {a} to {b}")
        df = fn(df)
    return df


@converter("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "text/markdown")
def _docx(df: DataFrame) -> DataFrame:
    return df.withColumn("content", docx_markdown("content"))


@converter("text/markdown", "text/plain")
def _markdown(df: DataFrame) -> DataFrame:
    plain = F.regexp_replace(F.regexp_replace("content", r"(?m)^#{1,6}\s+", ""), r"(\*\*|__|`)", "")
    return df.withColumn("content", plain)


@converter("text/html", "text/plain")
def _html(df: DataFrame) -> DataFrame:
    bare = F.regexp_replace("content", r"(?is)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    return df.withColumn("content", F.trim(F.regexp_replace(bare, r"\s+", " ")))
