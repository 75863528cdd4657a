"""Git as a source of changes: plain git commands, run on the driver."""

from __future__ import annotations

import subprocess
from dataclasses import dataclass


@dataclass(frozen=True)
class GitProvider:
    root: str | None = None

    def run(self, *args: str) -> str:
        try:
            done = subprocess.run(["git", "-c", "core.quotePath=false", *args], cwd=self.root, capture_output=True)
        except FileNotFoundError:
            raise RuntimeError("no git command was found") from None
        if done.returncode != 0:
            said = done.stderr.decode("utf-8", "replace").strip()
            raise RuntimeError(said or f"git ended with {done.returncode}: {' '.join(args)}")
        return done.stdout.decode("utf-8", "surrogateescape")

    def repo_root(self) -> str:
        return self.run("rev-parse", "--show-toplevel").rstrip("\n")

    def verify_ref(self, ref: str) -> str:
        """The commit that ref names; a name that git would take for an option is refused."""
        if ref.startswith("-"):
            raise ValueError(f"{ref!r} can't be a ref: git would read it as an option")
        try:
            return self.run("rev-parse", "--verify", f"{ref}^{{commit}}").strip()
        except RuntimeError as error:
            raise RuntimeError(f"{ref} names no commit ({error})") from None

    def merge_base(self, ref: str) -> str:
        return self.run("merge-base", ref, "HEAD").strip()

    def diff_since(self, base: str) -> str:
        """From a commit to the working tree, so that line numbers are those of the files scanned."""
        return self.run("diff", "--no-color", "--no-ext-diff", "--no-textconv", "-U0", "-M", base, "--")

    def indexed_files(self, pathspecs: list[str]) -> set[str]:
        return set(self.run("ls-files", "-z", "--", *pathspecs).split("\0")) - {""}
