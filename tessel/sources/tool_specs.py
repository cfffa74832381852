"""Specifications of tools from text and JSON files."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _type(description: str) -> str:
    d = description.lower()
    if any(w in d for w in ("number", "int", "float", "integer")):
        return "number"
    if "bool" in d:
        return "boolean"
    return "array" if "array" in d or "list" in d else "string"


def parse_spec(text: str, stem: str) -> dict:
    """name, description, parameters {type, properties, required} and, for HTTP tools, http_config of a line-oriented or JSON specification (X28, C9). required: [] means none (Q26)."""
    if text.lstrip().startswith("{"):
        spec = json.loads(text)
        return {"name": spec.get("name") or stem} | spec
    spec: dict = {"name": stem, "description": "", "parameters": {"type": "object", "properties": {}, "required": []}}
    url, method, inside = None, "GET", False
    for line in text.splitlines():
        key, colon, value = line.strip().partition(":")
        if not colon:
            continue
        value, low = value.strip(), key.strip().lower()
        if low in ("name", "description"):
            spec[low] = value.strip('"')
        elif low == "http_url":
            url = value
        elif low == "http_method":
            method = value.upper()
        elif low == "parameters":
            inside = True
        elif low == "required":
            spec["parameters"]["required"] = [x for x in (p.strip() for p in value.strip("[]").split(",")) if x]
        elif inside:
            spec["parameters"]["properties"][key.strip()] = {"type": _type(value), "description": value}
    if url:
        spec["http_config"] = {"url": url, "method": method}
    return spec


def read_specs(spark: SparkSession, folder: str) -> DataFrame:
    """(name, description, kind, url, method, required, properties as JSON) of the .txt and .json files of a folder."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, text in zip(b.column("path").to_pylist(), b.column("value").to_pylist(), strict=True):
                s = parse_spec(text, path.rsplit("/", 1)[-1].rsplit(".", 1)[0])
                h = s.get("http_config") or {}
                p = s.get("parameters") or {}
                rows.append((s["name"], s.get("description", ""), "http" if h else "local", h.get("url"), h.get("method"), p.get("required", []), json.dumps(p.get("properties", {}), ensure_ascii=False)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.string()] * 5 + [pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["name", "description", "kind", "url", "method", "required", "properties"])

    files = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").where(F.col("path").rlike("\\.(txt|json)$"))
    return files.mapInArrow(go, "name string, description string, kind string, url string, method string, required array<string>, properties string")
