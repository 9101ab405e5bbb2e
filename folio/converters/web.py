"""HTML pages, pages of some sites, and saved web archives."""

from __future__ import annotations

import base64
import binascii
import email
import email.policy
import json
import re
from urllib.parse import parse_qs, unquote, urlsplit

from folio.plans.detect import decode
from folio.plans.model import ConversionError, Info, Options, Result, asked
from folio.render.html_md import FURNITURE, main_content, parse, title_of, to_markdown

WIKIPEDIA = re.compile(r"^https?://[a-zA-Z]{2,3}\.wikipedia.org/")
BING = re.compile(r"^https://www\.bing\.com/search\?q=")
YOUTUBE = "https://www.youtube.com/watch?"


def youtube_url(url: str | None) -> bool:
    return unquote(url or "").replace(r"\?", "?").replace(r"\=", "=").startswith(YOUTUBE)


def page_markdown(html: str, options: Options) -> Result:
    root = parse(html)
    title = title_of(root)
    body = root.find("body") or root
    if options.main_content and (part := main_content(root)):
        return Result(to_markdown(part, options.keep_data_uris, FURNITURE), title)
    try:
        return Result(to_markdown(body, options.keep_data_uris), title)
    except (RecursionError, ValueError):
        if options.strict:
            raise
        return Result(body.text("\n").strip(), title, degraded=True)


def html(data: bytes, info: Info, options: Options) -> Result:
    return page_markdown(decode(data, info.charset, html=True), options)


def wikipedia(data: bytes, info: Info, options: Options) -> Result:
    """The article of a page under its title."""
    root = parse(decode(data, info.charset or "utf-8"))
    main, title = root.find("div", id="mw-content-text"), title_of(root)
    if main is None:
        return Result(to_markdown(root, options.keep_data_uris), title)
    named = root.find("span", cls="mw-page-title-main")
    if named is not None and named.text():
        title = named.text()
    return Result(f"# {title}\n\n" + to_markdown(main, options.keep_data_uris), title)


def _behind(href: str) -> str:
    """The address that a search engine's redirect link leads to."""
    u = parse_qs(urlsplit(href).query).get("u")
    if not u:
        return href
    raw = re.sub(r"[^A-Za-z0-9+/]", "", u[0][2:].strip().replace("-", "+").replace("_", "/"))
    try:
        return base64.b64decode(raw + "=" * (-len(raw) % 4)).decode()
    except (binascii.Error, UnicodeDecodeError):
        return href


def bing(data: bytes, info: Info, options: Options) -> Result:
    """The results of a search page."""
    root = parse(decode(data, info.charset or "utf-8"))
    for n in list(root.walk()):
        n.children = [c for c in n.children if isinstance(c, str) or not c.matches("cls", "algoSlug_icon")]
        if n.matches("cls", "tptt") and len(n.children) == 1 and isinstance(n.children[0], str):
            n.children[0] += " "
    results = []
    for block in root.find_all(cls="b_algo"):
        for a in block.find_all("a"):
            if a.attrs.get("href"):
                a.attrs["href"] = _behind(a.attrs["href"])
        lines = (x.strip() for x in to_markdown(block, options.keep_data_uris).split("\n"))
        results.append("\n".join(x for x in lines if x))
    query = parse_qs(urlsplit(info.url or "").query).get("q", [""])[0]
    return Result(f"## A Bing search for '{query}' found the following results:\n\n" + "\n\n".join(results), title_of(root))


def _first_key(data: object, key: str) -> object:
    stack = [data]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            if key in x:
                return x[key]
            stack += reversed(list(x.values()))
        elif isinstance(x, list):
            stack += reversed(x)
    return None


def _balanced(text: str, start: int) -> str | None:
    """The JSON object that begins at ``start``."""
    try:
        return text[start : start + json.JSONDecoder().raw_decode(text[start:])[1]]
    except ValueError:
        return None


def caption_track(tracks: list[dict]) -> dict | None:
    """Of caption tracks: English by hand, any English, any by hand, the first."""
    english = lambda t: str(t.get("languageCode", "")).lower().startswith("en")
    made = lambda t: t.get("kind") == "asr"
    for test in (lambda t: english(t) and not made(t), english, lambda t: not made(t), lambda t: True):
        if found := next((t for t in tracks if test(t)), None):
            return found
    return None


def _tracks(root) -> list[dict]:
    """The caption tracks that a video page's scripts list."""
    for script in root.find_all("script"):
        code = "".join(c for c in script.children if isinstance(c, str))
        if m := re.search(r'"captionTracks"\s*:\s*', code):
            try:
                found = json.JSONDecoder().raw_decode(code, m.end())[0]
            except ValueError:
                continue
            return [t for t in found if isinstance(t, dict)] if isinstance(found, list) else []
    return []


def youtube(data: bytes, info: Info, options: Options) -> Result:
    """Title, figures, description and, through a hook, the transcript of a video page."""
    root = parse(decode(data, info.charset or "utf-8"))
    meta = {"title": t} if (t := title_of(root)) else {}
    for n in root.find_all("meta"):
        key = next((n.attrs[a] for a in n.attrs if a in ("itemprop", "property", "name")), "")
        if key and n.attrs.get("content"):
            meta[key] = n.attrs["content"]
    for script in root.find_all("script"):
        code = "".join(c for c in script.children if isinstance(c, str))
        if "ytInitialData" in code:
            m = re.search(r"ytInitialData\s*=\s*(?=\{)", code)
            found = _balanced(code, m.end()) if m else None
            about = _first_key(json.loads(found), "attributedDescriptionBodyText") if found else None
            if isinstance(about, dict):
                meta["description"] = str(about.get("content", ""))
            break
    get = lambda *keys: next((meta[k] for k in keys if k in meta), None)
    title = get("title", "og:title", "name")
    if title is None:
        raise ConversionError("a video page without a title")
    out = ["# YouTube\n", f"\n## {title}\n" if title else ""]
    figures = [f"- **{name}:** {v}\n" for name, key in (("Views", "interactionCount"), ("Keywords", "keywords"), ("Runtime", "duration")) if (v := get(key))]
    if figures:
        out.append("\n### Video Metadata\n" + "".join(figures) + "\n")
    if about := get("description", "og:description"):
        out.append(f"\n### Description\n{about}\n")
    video = parse_qs(urlsplit(unquote(info.url or "").replace(r"\?", "?").replace(r"\=", "=")).query).get("v", [""])[0]
    transcript, said = getattr(options.hooks, "transcript", None), None
    if transcript and video:
        for _ in range(3):
            try:
                said = transcript(video)
                break
            except Exception:  # a provider may fail in any way
                continue
    if not said and (track := caption_track(_tracks(root))) and track.get("baseUrl"):
        said = asked(options.hooks, "captions", str(track["baseUrl"]))
    if said:
        out.append(f"\n### Transcript\n{said}\n")
    return Result("".join(out), get("title", "og:title", "name"))


def is_archive(data: bytes) -> bool:
    head = data[:2048].lower()
    return b"mime-version:" in head and b"content-type:" in head


def mhtml(data: bytes, info: Info, options: Options) -> Result:
    """The first HTML part of a saved page, or else its text."""
    message = email.message_from_bytes(data, policy=email.policy.compat32)
    parts = [p for p in message.walk() if not p.is_multipart()]
    part = next((p for p in parts if p.get_content_type() == "text/html"), None) or next((p for p in parts if p.get_content_type() == "text/plain"), None)
    if part is None or not parts:
        raise ConversionError("no HTML part in the archive")
    body = decode(part.get_payload(decode=True) or b"", part.get_content_charset(), html=True)
    if part.get_content_type() == "text/plain":
        return Result(body)
    out = page_markdown(body, options)
    return Result(out.markdown, out.title or message.get("Subject"), out.degraded)
