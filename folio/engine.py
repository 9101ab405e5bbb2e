"""The library's front: convert one thing at a time here, or whole tables through Spark."""

from __future__ import annotations

import functools
import io
from collections.abc import Callable
from pathlib import Path
from typing import Any, BinaryIO
from urllib.parse import urlsplit

from pyspark.sql import DataFrame

from folio.functions import uri as uris
from folio.hooks import Hooks
from folio.plans import detect
from folio.plans.dispatch import convert_documents
from folio.plans.model import Info, Options, Result
from folio.plans.registry import SPECIFIC, Converter, Registry, formats
from folio.sources import fetch


class Folio:
    """Converts files, streams, addresses and tables to Markdown.

    ``enable_plugins`` loads installed plugins; hooks and options hold for all conversions, and every
    conversion can override the options.
    """

    def __init__(self, enable_builtins: bool = True, enable_plugins: bool = False, hooks: Hooks | None = None, guard: bool = True, fetcher: Callable[[str], fetch.Fetched] | None = None, **options: Any):
        self.registry = Registry(enable_builtins)
        self.options = Options(hooks=hooks, **options)
        #: what fetches from the web, for a session of the caller's own
        self.fetcher = fetcher or functools.partial(fetch.fetch, guard=guard)
        if enable_plugins:
            self.registry.load_plugins()

    def register_converter(self, converter: Converter, priority: float = SPECIFIC) -> None:
        self.registry.register(converter, priority)

    #: the older name
    register_page_converter = register_converter

    def formats(self) -> list[tuple[str, list[str], str]]:
        return formats(self.registry)

    def _run(self, data: bytes, info: Info, **options: Any) -> Result:
        chosen = self.options if not options else Options(**{**vars(self.options), **options})
        return self.registry.convert(data, info, chosen).result

    def convert(self, source: str | Path | BinaryIO | Any, info: Info | None = None, **options: Any) -> Result:
        """A path, an address, a response with headers and content, or a binary file object."""
        if isinstance(source, str):
            if source.strip().startswith(("http:", "https:", "file:", "data:")):
                return self.convert_uri(source, info, **options)
            return self.convert_local(source, info, **options)
        if isinstance(source, Path):
            return self.convert_local(source, info, **options)
        if hasattr(source, "headers") and hasattr(source, "url"):
            return self.convert_response(source, info, **options)
        if hasattr(source, "read") and not isinstance(source, io.TextIOBase):
            return self.convert_stream(source, info, **options)
        raise TypeError(f"can't convert a {type(source).__name__}: give a path, an address, a response or a binary file object")

    def convert_local(self, path: str | Path, info: Info | None = None, extension: str | None = None, url: str | None = None, **options: Any) -> Result:
        base = detect.base_info(str(path)).updated(info)
        if extension:
            base = base.updated(extension=detect.normal_extension(extension))
        return self._run(Path(path).read_bytes(), base.updated(url=url) if url else base, **options)

    def convert_stream(self, stream: BinaryIO, info: Info | None = None, extension: str | None = None, url: str | None = None, **options: Any) -> Result:
        """Reads from where the stream stands, and puts it back there if it can be sought."""
        at = stream.tell() if stream.seekable() else None
        data = stream.read()
        if at is not None:
            stream.seek(at)
        base = info or Info()
        base = base.updated(extension=detect.normal_extension(extension)) if extension else base
        return self._run(data, base.updated(url=url) if url else base, **options)

    def convert_uri(self, uri: str, info: Info | None = None, mock_url: str | None = None, **options: Any) -> Result:
        uri = uri.strip()
        scheme = urlsplit(uri).scheme
        if scheme == "file":
            host, path = uris.file_uri_to_path(uri)
            if host not in (None, "", "localhost"):
                raise ValueError(f"a file address with a host: {host}")
            return self.convert_local(path, info, url=mock_url, **options)
        if scheme == "data":
            mime, attributes, body = uris.parse_data_uri(uri)
            base = Info(mimetype=mime, charset=attributes.get("charset")).updated(info)
            return self._run(body, base.updated(url=mock_url) if mock_url else base, **options)
        if scheme in ("http", "https"):
            got = self.fetcher(uri)
            base = got.info.updated(info)
            return self._run(got.body, base.updated(url=mock_url) if mock_url else base, **options)
        raise ValueError(f"unsupported address: {uri[:100]}; http, https, file and data are known")

    #: the older name
    convert_url = convert_uri

    def convert_response(self, response: Any, info: Info | None = None, url: str | None = None, **options: Any) -> Result:
        """A response that has ``headers``, ``url`` and ``content`` or chunks."""
        body = b"".join(response.iter_content(chunk_size=512)) if hasattr(response, "iter_content") else response.read()
        return self._run(body, fetch.response_info(url or response.url, response.headers).updated(info), **options)

    def convert_table(self, docs: DataFrame) -> DataFrame:
        """doc_id, content and hint of any number of documents."""
        return convert_documents(docs, self.options, self.registry)
