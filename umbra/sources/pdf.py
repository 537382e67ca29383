"""PDF pages as units, where the optional reader is installed."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def available() -> bool:
    try:
        import pdfplumber  # noqa: F401
    except ImportError:
        return False
    return True


def read_units(files: DataFrame) -> DataFrame:
    """(path, content) to a unit for each page with text."""
    if not available():
        raise RuntimeError("reading PDF needs pdfplumber, which is not installed")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pdfplumber

        for pdf in batches:
            for doc_id, content in zip(pdf["doc_id"], pdf["content"]):
                with pdfplumber.open(io.BytesIO(content)) as book:
                    texts = [(i, page.extract_text() or "") for i, page in enumerate(book.pages, 1)]
                rows = [(doc_id, "source", f"page-{i:03d}", i - 1, t) for i, t in texts if t.strip()]
                yield pd.DataFrame(rows, columns=["doc_id", "part", "unit_id", "seq", "text"])

    return files.selectExpr("xxhash64(path) AS doc_id", "content").mapInPandas(run, "doc_id long, part string, unit_id string, seq int, text string")
