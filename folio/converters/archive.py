"""Reading ZIP containers within budgets, and converting every file in one."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from folio.plans.detect import extension
from folio.plans.model import ConversionError, Info, Options, Result, Unsupported

# What is read of an archive at most, unless the caller trusts it.
MAX_ENTRIES, MAX_ENTRY, MAX_TOTAL, MAX_DEPTH = 4096, 128 << 20, 512 << 20, 4


# What stands in the place of what isn't read.
TOO_MANY = "> Archive has {n} entries; only the first {most} were processed."
TOO_LARGE = "> Skipped: entry exceeds the per-file size limit."
TOO_MUCH = "> Skipped: archive exceeds the {most}-MiB decompression limit."
UNREADABLE = "> Failed to read entry."
TOO_DEEP = "> Maximum archive recursion depth reached; contents not expanded."


@dataclass
class Entry:
    """A file of an archive; ``note`` says why there is no content."""

    name: str
    content: bytes | None
    note: str | None = None


class Container:
    """A ZIP file whose entries are read within the budgets, by declared and by actual size, or ``whole``."""

    def __init__(self, data: bytes, whole: bool = False):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, ValueError, OSError, EOFError) as e:
            raise ConversionError(f"not a ZIP container: {e}") from e
        self.total = 0
        self.whole = whole
        self.infos = self.zip.infolist()
        self.most = len(self.infos) if whole else MAX_ENTRIES
        self.names = [i.filename for i in self.infos[: self.most] if not i.is_dir()]
        #: said of the archive as a whole
        self.note = TOO_MANY.format(n=len(self.infos), most=MAX_ENTRIES) if len(self.infos) > self.most else None

    def __contains__(self, name: str) -> bool:
        return name in self.zip.NameToInfo

    def read(self, name: str) -> bytes | None:
        """The last entry of a name, or nothing where it is missing, corrupt or beyond the budget."""
        info = self.zip.NameToInfo.get(name)
        return None if info is None else self._read(info).content

    def _read(self, info: zipfile.ZipInfo) -> Entry:
        if not self.whole and info.file_size > MAX_ENTRY:
            return Entry(info.filename, None, TOO_LARGE)
        most = info.file_size if self.whole else min(MAX_ENTRY, MAX_TOTAL - self.total)
        try:
            with self.zip.open(info) as f:
                data = f.read(most + 1)
        except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, OSError, EOFError, ValueError):
            return Entry(info.filename, None, UNREADABLE)
        if len(data) > most:
            return Entry(info.filename, None, TOO_MUCH.format(most=MAX_TOTAL >> 20))
        self.total += len(data)
        return Entry(info.filename, data)

    def entries(self) -> Iterator[Entry]:
        """Every file in the archive's order, each by its own place: a name may occur twice. Beyond the budget it ends."""
        for info in self.infos[: self.most]:
            if not info.is_dir():
                entry = self._read(info)
                yield entry
                if entry.note and entry.note not in (TOO_LARGE, UNREADABLE):
                    return


def archive(data: bytes, info: Info, options: Options, convert: Callable[[bytes, Info, Options, int], Result], depth: int = 0) -> Result:
    """A section for every file that some converter reads, and a note for what is beyond the budgets.

    Degraded if anything was left out.
    """
    if data[:2] != b"PK":
        raise ConversionError("not a ZIP archive")
    head = f"Content from the zip file `{info.url or info.local_path or info.filename}`:\n\n"
    if depth >= MAX_DEPTH:
        return Result(head + TOO_DEEP, degraded=True)
    container = Container(data, options.whole_archives)
    out, degraded = [head], container.note is not None
    if container.note:
        out.append(container.note + "\n\n")
    for entry in container.entries():
        if entry.note:
            text, degraded = entry.note, True
        else:
            try:
                got = convert(entry.content, Info(filename=entry.name.rpartition("/")[2], extension=extension(entry.name)), options, depth + 1)
            except (Unsupported, ConversionError):
                degraded = True
                continue
            text, degraded = got.markdown, degraded or got.degraded
        out.append(f"## File: {entry.name}\n\n{text}\n\n")
    return Result("".join(out).strip(), degraded=degraded)
