"""What only an outside service or library can do, injected by the caller; all absent by default.

Every hook is a plain callable that ships to the workers with the options. A hook that fails
counts as one that said nothing, except ``transcribe`` and ``analyze``, whose failure fails the conversion.
"""

from __future__ import annotations

import base64
import json
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: what a captioning model is asked by default.
PROMPT = "Write a detailed caption for this image."


@dataclass(frozen=True)
class Hooks:
    #: image bytes and media type to a description
    caption: Callable[[bytes, str], str | None] | None = None
    #: image bytes to the text in it
    ocr: Callable[[bytes], str | None] | None = None
    #: bytes of a scanned PDF to the text of each page
    ocr_pdf: Callable[[bytes], list[str]] | None = None
    #: audio bytes and extension to what is said
    transcribe: Callable[[bytes, str], str | None] | None = None
    #: id of a video to its transcript
    transcript: Callable[[str], str | None] | None = None
    #: address of a video's caption track to its text
    captions: Callable[[str], str | None] | None = None
    #: bytes, media type and analyzer of an analysis service to Markdown
    analyze: Callable[[bytes, str, str], str | None] | None = None


#: Chat-completion services that caption images, with their addresses.
CAPTION_SERVICES = {
    "openai": "https://api.openai.com/v1", "ollama": "http://localhost:11434/v1", "lmstudio": "http://localhost:1234/v1",
    "openrouter": "https://openrouter.ai/api/v1", "groq": "https://api.groq.com/openai/v1", "mistral": "https://api.mistral.ai/v1",
}
MAX_CAPTION_BYTES = 16 << 20


def chat_caption(base: str, model: str, key: str = "", prompt: str = PROMPT, timeout: float = 60.0) -> Callable[[bytes, str], str | None]:
    """A captioning hook for a service with a chat-completions interface; failures give nothing."""

    def caption(data: bytes, mime: str) -> str | None:
        if len(data) > MAX_CAPTION_BYTES:
            return None
        content = [{"type": "text", "text": prompt}, {"type": "image_url", "image_url": {"url": f"data:{mime};base64,{base64.b64encode(data).decode()}"}}]
        body = json.dumps({"model": model, "messages": [{"role": "user", "content": content}]}).encode()
        request = urllib.request.Request(f"{base.rstrip('/')}/chat/completions", body, {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {}))
        try:
            with urllib.request.urlopen(request, timeout=timeout) as r:
                return json.load(r)["choices"][0]["message"]["content"]
        except (OSError, ValueError, KeyError, IndexError, TypeError):
            return None

    return caption


# -- routing to analysis services: small tables, joined by broadcast ------------------------------

# The kinds of file that analysis services take.
MODALITY = {
    "document": ["application/pdf", "image/jpeg", "image/png", "image/bmp", "image/tiff", "text/html", "text/plain", "text/markdown", "text/xml", "application/rtf", "message/rfc822", "application/vnd.ms-outlook", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/vnd.openxmlformats-officedocument.presentationml.presentation"],
    "audio": ["audio/wav", "audio/x-wav", "audio/mpeg", "audio/mp4", "audio/x-m4a", "audio/flac", "audio/ogg", "audio/aac", "audio/x-ms-wma"],
    "video": ["video/mp4", "video/x-m4v", "video/quicktime", "video/x-msvideo", "video/x-matroska", "video/webm", "video/x-flv", "video/x-ms-wmv"],
}
#: Types that go by two names.
CANONICAL = {"audio/x-wav": "audio/wav", "audio/x-m4a": "audio/mp4", "image/jpg": "image/jpeg", "application/xhtml+xml": "text/html", "application/xml": "text/xml", "text/rtf": "application/rtf"}
#: Kinds for which layout analysis, with text recognition of high resolution and formulas, makes sense.
LAYOUT = frozenset(["application/pdf", "image/jpeg", "image/png", "image/bmp", "image/tiff"])
ANALYZERS = {"document": "prebuilt-documentSearch", "audio": "prebuilt-audioSearch", "video": "prebuilt-videoSearch"}


def routing_table(spark: SparkSession) -> DataFrame:
    """mimetype, modality, analyzer and whether text recognition is asked for; a few dozen rows."""
    rows = [(m, k, ANALYZERS[k], m in LAYOUT) for k, ms in MODALITY.items() for m in ms]
    return spark.createDataFrame(rows, "mimetype string, modality string, analyzer string, recognise boolean")


def canonical_mime(mime: Column) -> Column:
    bare = F.lower(F.trim(F.substring_index(mime, ";", 1)))
    out = bare
    for alias, name in CANONICAL.items():
        out = F.when(bare == alias, name).otherwise(out)
    return out


def route(docs: DataFrame, mime: str = "mimetype") -> DataFrame:
    """``docs`` with modality, analyzer and recognise, null for types that no service takes."""
    key = docs.withColumn("_mime", canonical_mime(F.col(mime)))
    table = routing_table(docs.sparkSession).select(F.col("mimetype").alias("_mime"), "modality", "analyzer", "recognise").dropDuplicates(["_mime"])
    return key.join(F.broadcast(table), "_mime", "left").drop("_mime")
