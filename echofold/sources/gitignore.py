"""The patterns of one .gitignore file."""

from __future__ import annotations

import re
from functools import lru_cache


def _glob(pattern: str) -> str:
    """A regular expression for the glob of one pattern without its leading or trailing slash."""
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern.startswith("/**", i) and i + 3 == len(pattern):
            out, i = out + "/.+", i + 3
        elif ch == "*":
            while pattern.startswith("*", i + 1):
                i += 1
            out, i = out + "[^/]*", i + 1
        elif ch == "?":
            out, i = out + "[^/]", i + 1
        elif ch == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            negated = body[0] in "!^"
            body = body[negated:].replace("\\", "\\\\")
            out, i = out + f"(?!/)[{'^' * negated}{body}]", end + 1
        elif ch == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + re.escape(ch), i + 1
    return out


class GitIgnore:
    """Whether paths relative to the file's directory are ignored; directories end with a slash."""

    def __init__(self, text: str):
        self.rules: list[tuple[bool, bool, re.Pattern]] = []
        for line in text.splitlines():
            line = re.sub(r"(?<!\\) +$", "", line)
            if not line or line.startswith("#"):
                continue
            negated = line.startswith("!")
            line = line[negated:].removeprefix("\\") if line[negated:].startswith(("\\#", "\\!")) else line[negated:]
            only_directories = line.endswith("/")
            body = line.rstrip("/") if only_directories else line
            if not body:
                continue
            anchored = "/" in body
            regex = _glob(body.removeprefix("/"))
            self.rules.append((negated, only_directories, re.compile(regex if anchored else f"(?:.*/)?{regex}", re.I)))
        self.ignores = lru_cache(maxsize=None)(self._ignores)

    def _ignores(self, path: str) -> bool:
        """What is below an ignored directory can't be taken back in."""
        is_directory = path.endswith("/")
        plain = path.rstrip("/")
        parent = plain.rpartition("/")[0]
        if parent and self.ignores(parent + "/"):
            return True
        ignored = False
        for negated, only_directories, regex in self.rules:
            if (is_directory or not only_directories) and regex.fullmatch(plain):
                ignored = not negated
        return ignored
