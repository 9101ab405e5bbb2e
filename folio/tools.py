"""What a tool server offers: plain functions, no server."""

from __future__ import annotations

from pathlib import Path

from folio.engine import Folio

# Characters of a page and of a preview.
PAGE, PREVIEW = 50_000, 500


def _inside(path: str) -> str:
    if ".." in Path(path).parts:
        raise ValueError("the path leads upwards")
    return path


def convert_to_markdown(uri: str, offset: int = 0, max_chars: int = PAGE, engine: Folio | None = None) -> str:
    """A page of the Markdown of an address or path, with a note on how to go on."""
    text = (engine or Folio()).convert(uri).markdown
    if offset and offset >= len(text):
        raise ValueError(f"there are only {len(text)} characters")
    body = text[offset : offset + max_chars]
    end = offset + len(body)
    return body if end >= len(text) else f"{body}\n\n[characters {offset} to {end} of {len(text)}; go on with offset={end}]"


def preview(uri: str, engine: Folio | None = None) -> str:
    got = (engine or Folio()).convert(uri)
    return f"Title: {got.title or '-'}\nCharacters: {len(got.markdown)}\n\n{got.markdown[:PREVIEW]}"


def unique_names(names: list[str], whole: bool = False) -> list[str]:
    """Output names in order: the stem or the whole name, the whole name where stems meet, then numbers."""
    bases = [Path(n.split("?")[0].split("#")[0]).name or "output" for n in names]
    stems = [b if whole else Path(b).stem or b for b in bases]
    out, used = [], set()
    for base, stem in zip(bases, stems, strict=True):
        name = f"{stem}.md" if f"{stem}.md" not in used else f"{base}.md"
        k = 1
        while name in used:
            name, k = f"{base}-{k}.md", k + 1
        used.add(name)
        out.append(name)
    return out


def convert_batch(uris: list[str], out_dir: str, engine: Folio | None = None) -> list[tuple[str, str, str]]:
    """Each input to its own file; input, file and "ok" or the failure."""
    folder, done = Path(_inside(out_dir)), []
    own = engine or Folio()
    folder.mkdir(parents=True, exist_ok=True)
    for uri, name in zip(uris, unique_names(uris, whole=True), strict=True):
        try:
            (folder / name).write_text(own.convert(uri).markdown + "\n", encoding="utf-8")
            done.append((uri, name, "ok"))
        except Exception as e:  # one bad input doesn't end the batch
            done.append((uri, name, f"FAILED: {e}"))
    return done


def supported_formats(engine: Folio | None = None) -> str:
    return "\n".join(f"{name}: {', '.join(ext) or '-'} ({notes})" for name, ext, notes in (engine or Folio()).formats())


def capabilities(engine: Folio | None = None) -> dict[str, bool | int]:
    """What an engine can do beyond reading formats; never with keys."""
    hooks = (engine or Folio()).options.hooks
    names = ("caption", "ocr", "ocr_pdf", "transcribe", "transcript", "analyze")
    return {"formats": len((engine or Folio()).formats())} | {n: getattr(hooks, n, None) is not None for n in names}
