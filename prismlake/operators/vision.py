"""Descriptions of images by an outside service. Off unless configured: images leave the cluster."""

from __future__ import annotations

import base64
import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from prismlake.functions.parsers import chat_response, ollama_response
from prismlake.plans.config import VisionConfig

PROMPT = "Answer in exactly three lines.\nDESCRIPTION: what the picture shows, in a sentence, without naming real people\nTAGS: up to ten keywords, comma-separated\nTEXT: writing that can be read in it, or none"
#: Mark of a failed call in the description.
FAILED = "[vision error"


def request(config: VisionConfig, jpeg: bytes, ollama: bool = False) -> tuple[str, dict, dict, int]:
    """Address, headers, body and seconds to wait of the call for an image."""
    data = base64.b64encode(jpeg).decode()
    if ollama:
        return f"{config.endpoint.rstrip('/')}/api/generate", {}, {"model": config.model, "prompt": PROMPT, "images": [data], "stream": False}, 120
    picture = {"type": "image_url", "image_url": {"url": f"data:image/jpeg;base64,{data}"}}
    body = {"model": config.model, "max_tokens": config.max_tokens, "messages": [{"role": "user", "content": [{"type": "text", "text": PROMPT}, picture]}]}
    return config.endpoint, {"Authorization": f"Bearer {config.api_key}"} if config.api_key else {}, body, 60


def call(url: str, headers: dict, body: dict, seconds: int) -> tuple[str | None, str | None]:
    """The response's text, or an error text."""
    try:
        sent = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
        with urllib.request.urlopen(sent, timeout=seconds) as got:
            text = got.read().decode("utf-8", "replace")
        json.loads(text)
        return text, None
    except urllib.error.HTTPError as e:
        return None, f"{FAILED}: HTTP {e.code} {e.read().decode('utf-8', 'replace')[:200]}]"
    except (OSError, ValueError) as e:
        return None, f"{FAILED}: {e}]"


def describe(images: DataFrame, config: VisionConfig, ollama: bool = False, tasks: int = 4, send: Callable = call) -> DataFrame:
    """(file, description, tags, ocr_text) of images (file, jpeg); ``tasks`` calls at once at most; errors become descriptions."""
    if not config.usable():
        raise ValueError("an endpoint and a model are needed")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [send(*request(config, x, ollama)) for x in b["jpeg"]]
            yield pd.DataFrame({"file": b["file"].to_numpy(), "body": [x for x, _ in got], "error": [e for _, e in got]})

    found = images.select("file", "jpeg").coalesce(max(1, tasks)).mapInPandas(run, "file string, body string, error string")
    parsed = found.select("file", "error", (ollama_response if ollama else chat_response)(F.coalesce("body", F.lit("{}"))).alias("r"))
    failed = F.col("error").isNotNull()
    return parsed.select("file", F.when(failed, F.col("error")).otherwise(F.col("r.description")).alias("description"), F.when(failed, "").otherwise(F.col("r.tags")).alias("tags"), F.when(failed, "").otherwise(F.col("r.ocr_text")).alias("ocr_text"))
