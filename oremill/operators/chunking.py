"""Chunking: paragraphs, then sentences, then words, filled greedily up to a size, with overlap.

Separators are kept, so that without overlap the chunks of a text concatenate to the text. Lengths are code points. A stateful
fold over a text, hence a vectorised UDF."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHARS_PER_TOKEN, LEAST = 4.2, 24
SCHEMA = "array<struct<chunk_index: int, content: string, start: int, stop: int>>"


def segments(text: str, most: int) -> Iterator[str]:
    """Parts of at most `most` characters where words allow, in order; together they are the text."""
    for paragraph in re.split(r"(?=(?<!\n)\n\n)", text):
        if len(paragraph) <= most:
            yield paragraph
            continue
        for sentence in re.split(r"(?<=[.!?])(?=\s)", paragraph):
            if len(sentence) <= most:
                yield sentence
                continue
            held = ""
            for word in re.findall(r"\s+|\S+", sentence):
                if held and len(held) + len(word) > most:
                    yield held
                    held = ""
                held += word
            if held:
                yield held


def chunk(text: str | None, most: int, overlap: int = 0, least: int = LEAST) -> list[dict]:
    if not text or not text.strip():
        return []
    bodies: list[str] = []
    for s in segments(text, most):
        if bodies and len(bodies[-1]) + len(s) <= most:
            bodies[-1] += s
        elif s:
            bodies.append(s)
    if len(bodies) > 1 and len(bodies[-1]) < least:
        runt = bodies.pop()
        bodies[-1] += runt
    out, at, before = [], 0, ""
    for body in bodies:
        tail = before[-overlap:] if overlap and out else ""
        if tail and len(before) > overlap and (gap := re.search(r"\s", tail)) and gap.start():
            tail = tail[gap.start() :]
        before = tail + body
        out.append({"content": before, "start": at, "stop": at + len(body)})
        at += len(body)
    return [{"chunk_index": i, **c} for i, c in enumerate(c for c in out if c["content"].strip())]


def chunks_of(text: Column, tokens: int = 512, overlap: int = 64) -> Column:
    most, over = round(tokens * CHARS_PER_TOKEN), round(overlap * CHARS_PER_TOKEN)

    @F.pandas_udf(SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: chunk(x, most, over))

    return run(text)


def chunk_documents(docs: DataFrame, id_col: str = "id", text: str = "content", tokens: int = 512, overlap: int = 64) -> DataFrame:
    """id, total_chunks, chunk_index, content, start, stop."""
    listed = docs.select(F.col(id_col), chunks_of(F.col(text), tokens, overlap).alias("c"))
    return listed.select(id_col, F.size("c").alias("total_chunks"), F.explode("c").alias("x")).select(id_col, "total_chunks", "x.*")
