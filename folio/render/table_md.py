"""Markdown tables."""

from __future__ import annotations

from collections.abc import Sequence


def safe_cell(value: str) -> str:
    """A cell on one line, with backslashes and pipes escaped."""
    return value.replace("\\", "\\\\").replace("|", "\\|").replace("\r\n", "<br>").replace("\r", " ").replace("\n", "<br>").strip()


def table(rows: Sequence[Sequence[str]], safe: bool = False) -> str:
    """The first row is the header; others are cut or filled to its width, or with ``safe`` all to the widest."""
    if not rows:
        return ""
    width = max(map(len, rows)) if safe else len(rows[0])
    if not width:
        return ""
    cells = [[*(safe_cell(c) if safe else c for c in r), *[""] * (width - len(r))][:width] for r in rows]
    lines = ["| " + " | ".join(r) + " |" for r in cells]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def aligned(rows: Sequence[Sequence[str]]) -> str:
    """A table whose columns are padded to their widest cell, of at least three characters."""
    if not rows:
        return ""
    width = max(map(len, rows))
    full = [[*r, *[""] * (width - len(r))] for r in rows]
    sizes = [max(3, *(len(r[i]) for r in full)) for i in range(width)]
    line = lambda r: "| " + " | ".join(c.ljust(s) for c, s in zip(r, sizes, strict=True)) + " |"
    return "\n".join([line(full[0]), "| " + " | ".join("-" * s for s in sizes) + " |", *map(line, full[1:])])
