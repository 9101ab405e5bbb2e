"""python -m folio FILE ... : convert to Markdown on the command line."""

from __future__ import annotations

import argparse
import codecs
import sys
from importlib.metadata import entry_points
from pathlib import Path

from folio import __version__
from folio.engine import Folio
from folio.plans.detect import normal_extension
from folio.plans.model import Info
from folio.plans.registry import PLUGIN_GROUP
from folio.tools import supported_formats, unique_names


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="folio", description="Convert files and addresses to Markdown.")
    p.add_argument("inputs", nargs="*", help="paths or addresses; standard input without any")
    p.add_argument("-v", "--version", action="version", version=f"folio {__version__}")
    p.add_argument("-o", "--output", help="file for the result")
    p.add_argument("-O", "--output-dir", help="folder for the results of several inputs")
    p.add_argument("-x", "--extension", help="extension of what is read, as a hint")
    p.add_argument("-m", "--mime-type", help="type of what is read, as a hint")
    p.add_argument("-c", "--charset", help="character set of what is read, as a hint")
    p.add_argument("-p", "--use-plugins", action="store_true", help="load installed plugins")
    p.add_argument("--list-plugins", action="store_true", help="list installed plugins")
    p.add_argument("--list-formats", action="store_true", help="list what can be converted")
    p.add_argument("--keep-data-uris", action="store_true", help="keep embedded images whole")
    p.add_argument("--main-content", action="store_true", help="render only the main part of pages")
    a = p.parse_args(argv)
    if a.list_plugins:
        print("\n".join(f"{e.name}: {e.value}" for e in entry_points(group=PLUGIN_GROUP)) or "no plugins are installed")
        return 0
    engine = Folio(enable_plugins=a.use_plugins, keep_data_uris=a.keep_data_uris, main_content=a.main_content)
    if a.list_formats:
        print(supported_formats(engine))
        return 0
    if a.mime_type and a.mime_type.count("/") != 1:
        p.error(f"not a type: {a.mime_type}")
    if a.charset:
        try:
            codecs.lookup(a.charset)
        except LookupError:
            p.error(f"not a character set: {a.charset}")
    info = Info(extension=normal_extension(a.extension), mimetype=a.mime_type, charset=a.charset)
    if len(a.inputs) > 1 and not a.output_dir:
        p.error("several inputs need --output-dir")
    if not a.inputs:
        return _emit(engine.convert_stream(sys.stdin.buffer, info).markdown, a.output)
    if not a.output_dir:
        try:
            return _emit(engine.convert(a.inputs[0], info).markdown, a.output)
        except Exception as e:  # said to the user, whatever it is
            print(f"{a.inputs[0]}: {e}", file=sys.stderr)
            return 1
    folder, bad = Path(a.output_dir), 0
    folder.mkdir(parents=True, exist_ok=True)
    for source, name in zip(a.inputs, unique_names(a.inputs), strict=True):
        try:
            _emit(engine.convert(source, info).markdown, str(folder / name))
            print(f"{source}: ok, {name}")
        except Exception as e:  # the batch goes on
            bad += 1
            print(f"{source}: FAILED: {e}", file=sys.stderr)
    return int(bad > 0)


def _emit(text: str, path: str | None) -> int:
    if path:
        Path(path).write_text(text, encoding="utf-8")
    else:
        sys.stdout.buffer.write(text.encode(sys.stdout.encoding or "utf-8", "replace") + b"\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
