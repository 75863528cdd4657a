"""Which files a scan reads. Runs on the driver: directories are pruned before they are listed."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

from echofold.sources.gitignore import GitIgnore

#: File name endings that are scanned, and those left out again.
SOURCE_ENDINGS = (".js", ".jsx", ".ts", ".tsx", ".mts", ".cts")
DECLARATION_ENDINGS = (".d.ts", ".d.mts", ".d.cts")


def is_source(name: str) -> bool:
    return name.endswith(SOURCE_ENDINGS) and not name.endswith(DECLARATION_ENDINGS)


def ignore_matcher(respect: bool) -> Callable[[str, bool], bool]:
    """Tests (path, is_directory) against the working directory's .gitignore; nothing outside is ignored."""
    try:
        with open(".gitignore", encoding="utf-8") as file:
            rules = GitIgnore(file.read()) if respect else None
    except OSError:
        rules = None
    if rules is None:
        return lambda path, is_directory: False

    def ignored(path: str, is_directory: bool) -> bool:
        relative = os.path.relpath(path).replace(os.sep, "/")
        if relative in ("", ".") or relative.startswith("../") or relative == ".." or os.path.isabs(relative):
            return False
        return rules.ignores(relative + "/" * is_directory)

    return ignored


def _below(folder: str, ignored: Callable[[str, bool], bool]) -> Iterator[str]:
    """Source files below a folder; symbolic links aren't followed, ignored folders aren't entered."""
    for item in os.scandir(folder):
        path = os.path.join(folder, item.name)
        if item.is_dir(follow_symlinks=False):
            if not ignored(path, True):
                yield from _below(path, ignored)
        elif item.is_file(follow_symlinks=False) and is_source(item.name) and not ignored(path, False):
            yield path


def source_files(paths: Iterable[str], respect_gitignore: bool = True) -> list[str]:
    """The files of a scan in code-unit order, each once under its first spelling.

    A missing path gives nothing; a file named as such is taken whatever the ignore rules say.
    """
    ignored = ignore_matcher(respect_gitignore)
    found: dict[str, str] = {}
    for path in paths:
        if os.path.isfile(path):
            listed = [path] if is_source(path) else []
        elif os.path.isdir(path):
            listed = sorted(map(os.path.normpath, _below(path, ignored)), key=code_units)
        else:
            listed = []
        for file in listed:
            found.setdefault(os.path.abspath(file), file)
    return sorted(found.values(), key=code_units)


def code_units(name: str) -> bytes:
    return name.encode("utf-16-be", "surrogatepass")
