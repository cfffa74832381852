"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Folder with the tokenizers' files; a parameter, as they are no part of this repository.
FOLDER = os.environ.get("TESSEL_TOKENIZERS", "/opt/tokenizers")
NAME = "byte_bpe_multi_50k.tiktoken"


@lru_cache(maxsize=4)
def encoder(path: str):
    """The tokenizer of a file of ranks, once per worker."""
    import importlib.util
    from pathlib import Path

    import tiktoken

    spec = importlib.util.spec_from_file_location("_tokenizer_files", Path(path).parent / "__init__.py")
    files = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(files)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(Path(path).stem, pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, text: str, keep: list[str], name: str = "tokens", path: str | None = None) -> DataFrame:
    """Columns ``keep`` and the number of tokens of ``text``; 0 for empty and null texts. Whole texts, in Arrow batches, the text itself not passed on."""
    path = path or f"{FOLDER}/{NAME}"
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + f", `{name}` bigint"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path).encode_ordinary
        for b in batches:
            n = [len(e(t)) if t else 0 for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(n, pa.int64())], names=[*keep, name])

    return df.select(*keep, text).mapInArrow(count, schema)
