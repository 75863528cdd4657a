"""Options of a scan and of the command line."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

from echofold.functions.numbers import leading_float, leading_integer

FORMATS = ("text", "edn", "json")


@dataclass(frozen=True)
class Options:
    paths: tuple[str, ...] = ("src",)
    threshold: float = 0.82
    min_lines: int = 4
    min_nodes: int = 20
    format: str = "text"
    help: bool = False
    fail_on_duplicates: bool = False
    respect_gitignore: bool = True
    min_locations: int = 2
    changed_from: str | None = None
    changed: tuple[str, ...] = ()
    explain_changed: bool = False

    def __post_init__(self):
        object.__setattr__(self, "paths", tuple(self.paths) or ("src",))
        object.__setattr__(self, "changed", tuple(self.changed))
        if not 0 < self.threshold <= 1:
            raise ValueError("threshold must be greater than 0 and at most 1")
        for name, least in (("minLines", self.min_lines), ("minNodes", self.min_nodes)):
            if least < 1:
                raise ValueError(f"{name} must be at least 1")
        if self.min_locations < 2:
            raise ValueError("minLocations must be at least 2")
        if self.changed_from is not None and self.changed:
            raise ValueError("--changed-from and --changed cannot be combined")

    @classmethod
    def of(cls, given: "Options | dict | None" = None, **more) -> "Options":
        """Options from some of the fields; the rest take their defaults."""
        if isinstance(given, Options):
            return given
        known = {f.name for f in fields(cls)}
        named = {k: v for k, v in {**(given or {}), **more}.items() if v is not None}
        if unknown := named.keys() - known:
            raise TypeError(f"unknown options: {', '.join(sorted(unknown))}")
        return cls(**named)

    @classmethod
    def parse(cls, *args: str) -> "Options":
        """Options from command-line arguments; of repeated ones the last counts, --changed adds up."""
        found: dict = {}
        paths: list[str] = []
        changed: list[str] = []
        rest = iter(args)
        for arg in rest:
            if arg in _VALUES:
                name, read = _VALUES[arg]
                found[name] = read(_value(rest, arg), arg)
            elif arg in _SWITCHES:
                found.update(_SWITCHES[arg])
            elif arg == "--changed":
                changed.append(_value(rest, arg))
            elif arg.startswith("-"):
                # Taken for a path, a mistyped flag would scan nothing and pass.
                raise ValueError(f"Unknown option: {arg}")
            else:
                paths.append(arg)
        return cls(paths=tuple(paths), changed=tuple(changed), **found)


def _value(rest: Iterator[str], option: str) -> str:
    for value in rest:
        return value
    raise ValueError(f"Missing value for {option}")


def _number(read: Callable[[str], float | None], label: str):
    def parse(text: str, option: str):
        if (value := read(text)) is None:
            raise ValueError(f"Invalid {label} for {option}")
        return value

    return parse


def _format(text: str, option: str) -> str:
    if text not in FORMATS:
        raise ValueError(f"Unknown format: {text}")
    return text


_VALUES = {
    "--threshold": ("threshold", _number(leading_float, "number")),
    "--min-lines": ("min_lines", _number(leading_integer, "integer")),
    "--min-nodes": ("min_nodes", _number(leading_integer, "integer")),
    "--min-locations": ("min_locations", _number(leading_integer, "integer")),
    "--format": ("format", _format),
    "--changed-from": ("changed_from", lambda text, option: text),
}
_SWITCHES = {
    **{f"--{name}": {"format": name} for name in FORMATS},
    "--explain-changed": {"explain_changed": True},
    "--fail-on-duplicates": {"fail_on_duplicates": True},
    "--no-gitignore": {"respect_gitignore": False},
    "--help": {"help": True},
    "-h": {"help": True},
}
