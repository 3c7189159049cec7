"""Streaming of one answer: a driver-side protocol around a retrieval job."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

NOTHING = "知识库为空，请先入库文档。"


def stream_answer(blocks: list[dict], generate: Callable[[str], Iterator[str]], context: str, empty: bool = False) -> Iterator[tuple[str, Any]]:
    """Events of an answer: one ``retrieval``, deltas, one ``done``.

    An empty store gives only ``done``; no blocks give ``retrieval`` and ``done``.
    """
    if empty:
        yield "done", {"answer": NOTHING, "blocks": []}
        return
    yield "retrieval", blocks
    parts: list[str] = []
    if blocks:
        for delta in generate(context):
            parts.append(delta)
            yield "delta", delta
    yield "done", {"answer": "".join(parts), "blocks": blocks}


def sse(events: Iterator[tuple[str, Any]]) -> Iterator[str]:
    """Server-sent events; an exception becomes an ``error`` event and ends the stream."""
    import json

    try:
        for kind, data in events:
            yield f"event: {kind}\ndata: {json.dumps(data, ensure_ascii=False)}\n\n"
    except Exception as e:  # noqa: BLE001
        yield f"event: error\ndata: {json.dumps(str(e), ensure_ascii=False)}\n\n"


def sessions_of(pieces):
    """Whole answers of streamed pieces (session, ord, text, usage): rows (session, answer, usage), the text in order and the usage of the last piece that has one."""
    from pyspark.sql import functions as F

    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda p: F.coalesce(p["text"], F.lit("")))
    return pieces.groupBy("session").agg(F.array_join(parts, "").alias("answer"), F.max_by("usage", F.when(F.col("usage").isNotNull(), F.col("ord"))).alias("usage"))


async def answer_async(generate: Callable[[str], Any], context: str) -> dict:
    """One answer of an asynchronous source of (text, usage) pieces: its text, and the usage of the last piece that has one."""
    parts, usage = [], None
    async for text, used in generate(context):
        parts.append(text or "")
        usage = used or usage
    return {"answer": "".join(parts), "usage": usage}
