"""Token counts by prefix dynamic programming over a word-level BPE vocabulary.

For every prefix of a word the table holds the last token of the prefix's encoding and the exact
number of its tokens. A prefix ends with token t after a shorter prefix ending with token s exactly
when s followed by t is itself a stable encoding, so each entry follows from earlier ones and nothing
is encoded twice. Counts at every prefix answer truncation and budget questions by lookup.

The vocabulary file is a tokenizer JSON with byte-level BPE, a word-end suffix and a pre-tokenising
split. Its normaliser (NFC, white space, lower case) and its special tokens are read from it. Special
strings inside texts count as one token each, as is the library's default. Which code points are letters,
numbers and white space is asked of the library once, since its Unicode tables aren't Python's; texts with
a code point that it lower-cases otherwise are brought into normal form by the library.

Defined results: a null or empty text has no tokens. Rows are independent of each other; repeated
rows give repeated results, and no other column is read. Long words cost time and memory in
proportion to their length.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer
from tokenizers.pre_tokenizers import Split

from echofold.llm.common import map_batches, normal_text

CACHE_WORDS = 300_000
CACHE_PAIRS = 400_000
#: The classes that pre-tokenising patterns are made of.
CLASSES = (r"\p{L}", r"\p{N}", r"\s")


def code_points() -> list[str]:
    """Every character but the surrogates, which UTF-8 has none of."""
    return [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]


def ranges(found: set[str]) -> str:
    """Characters as the inside of a bracket expression."""
    out: list[list[int]] = []
    for c in sorted(map(ord, found)):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


@lru_cache(maxsize=1)
def library_classes() -> tuple[dict[str, str], set[str]]:
    """For each class a set expression that matches what the library's does; the characters on which they differ."""
    every, out, odd = "".join(code_points()), {}, set()
    for name in CLASSES:
        held = set("".join(piece for piece, _ in Split(Regex(f"{name}+"), "removed", invert=True).pre_tokenize_str(every)))
        here = set(regex.findall(name, every))
        out[name] = f"[{name}--[{ranges(here - held)}]]" if here - held else name
        if held - here:
            out[name] = f"[{out[name]}{ranges(held - here)}]"
        odd |= here ^ held
    return out, odd


def as_the_library(pattern: str) -> regex.Pattern:
    """A pre-tokenising pattern with the library's classes."""
    for name, same in library_classes()[0].items():
        pattern = pattern.replace(name, same)
    return regex.compile(pattern, regex.V1)


def otherwise_normal(normalizer) -> set[str]:
    """The characters whose normal form isn't that of Python's tables; white space is of no matter."""
    every = [c for c in code_points() if not c.isspace() and c != "|"]
    found = normalizer.normalize_str("|".join(every)).split("|")
    if len(found) != len(every):
        return set(every)
    return {c for c, form in zip(every, found) if form != plain_form(c)}


def plain_form(text: str) -> str:
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(hidden)) for b in range(256)]


class PrefixCounter:
    """Exact token counts of words, and of all their prefixes, for one vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or not model["end_of_word_suffix"]:
            raise ValueError(f"{path}: not a lower-casing BPE vocabulary with word ends")
        self.end = model["end_of_word_suffix"]
        self.vocab = frozenset(model["vocab"])
        self.longest = max(len(t.removesuffix(self.end)) for t in self.vocab)
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.split = as_the_library(split)
        self.plain_split = regex.compile(split)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.normalizer = Tokenizer.from_file(path).normalizer
        odd = library_classes()[1] | otherwise_normal(self.normalizer)
        self.odd = regex.compile(f"[{ranges(odd)}]").search if odd else lambda text: None
        self.latin = not any(ord(c) < 0x100 for c in odd)
        stand_in = byte_alphabet()
        self.of_byte = {b: c for b, c in enumerate(stand_in)}
        self.counts: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.stable: dict[tuple[str | None, str], bool] = {}

    def _symbols(self, token: str) -> list[str]:
        if token.endswith(self.end) and len(token) > len(self.end):
            body = token.removesuffix(self.end)
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def _merge(self, symbols: list[str]) -> list[str]:
        rank, never = self.rank, len(self.rank)
        while len(symbols) > 1:
            best, at = min((rank.get(pair, never), i) for i, pair in enumerate(zip(symbols, symbols[1:])))
            if best == never:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _follows(self, before: str | None, token: str) -> bool:
        """Whether before and then token is what their joint text is encoded to."""
        key = (before, token)
        known = self.stable.get(key)
        if known is None:
            if len(self.stable) > CACHE_PAIRS:
                self.stable.clear()
            if before is None:
                known = self._merge(self._symbols(token)) == [token]
            else:
                known = self._merge(list(before) + self._symbols(token)) == [before, token]
            self.stable[key] = known
        return known

    def _last(self, word: str, i: int, last: list[str | None], end: str) -> tuple[str, int]:
        """The last token of the first i symbols, and where it starts."""
        vocab, stable = self.vocab, self.stable
        for j in range(max(0, i - self.longest), i):
            token = word[j:i] + end
            if token in vocab:
                before = last[j]
                known = stable.get((before, token))
                if known or (known is None and self._follows(before, token)):
                    return token, j
        raise ValueError(f"no encoding of {word[:i]!r}")

    def open_table(self, word: str) -> tuple[list[str | None], list[int]]:
        """At each prefix of a word of byte stand-ins, not closed by a word end: last token and count."""
        last: list[str | None] = [None]
        count = [0]
        for i in range(1, len(word) + 1):
            token, j = self._last(word, i, last, "")
            last.append(token)
            count.append(count[j] + 1)
        return last, count

    def close(self, word: str, i: int, last: list[str | None], count: list[int]) -> int:
        """Tokens of the first i symbols as a whole word."""
        return count[self._last(word, i, last, self.end)[1]] + 1 if i else 0

    def stand_ins(self, word: str) -> str:
        return "".join(map(self.of_byte.__getitem__, word.encode("utf-8", "surrogatepass")))

    def word_count(self, word: str) -> int:
        known = self.counts.get(word)
        if known is None:
            if len(self.counts) > CACHE_WORDS:
                self.older, self.counts = self.counts, {}
            known = self.older.get(word)
            if known is None:
                units = self.stand_ins(word)
                last, count = self.open_table(units[:-1])
                known = self.close(units, len(units), last, count)
            self.counts[word] = known
        return known

    def is_odd(self, text: str) -> bool:
        """Whether the text holds a character on which the library's tables and Python's differ."""
        if self.latin:
            try:
                text.encode("latin-1")
                return False
            except UnicodeEncodeError:
                pass
        return self.odd(text) is not None

    def words(self, text: str) -> list[str]:
        """The words of a text, brought into normal form."""
        if text.isascii():
            return self.plain_split.findall(text.lower())
        if self.is_odd(text):
            return self.split.findall(self.normalizer.normalize_str(text))
        return self.plain_split.findall(plain_form(text))

    def segments(self, text: str) -> list[tuple[str, bool]]:
        """The text between special strings, and those strings (True)."""
        if self.special is None or "<" not in text:
            return [(text, False)]
        out, at = [], 0
        for match in self.special.finditer(text):
            out += [(text[at : match.start()], False), (match[0], True)]
            at = match.end()
        return [*out, (text[at:], False)]

    def count(self, text: str) -> int:
        total = 0
        for part, is_special in self.segments(text):
            if is_special:
                total += 1
            elif part:
                words = self.words(part)
                known = self.counts
                try:
                    total += sum([known[w] for w in words])
                except KeyError:
                    total += sum(map(self.word_count, words))
        return total

    def prefix_counts(self, text: str) -> list[int]:
        """Tokens of text[:i] for every i from 0 to the length of a text in normal form.

        A prefix that ends inside a word counts it as cut there. Prefixes that cut a character of
        several bytes don't arise, as i counts characters. Special strings aren't looked for.
        """
        out, total, at = [], 0, 0
        for start, stop in (m.span() for m in self.split.finditer(text)):
            out += [total] * (start - at)
            if text[start] == "'" and text[start + 1 : stop].isalpha():  # cut, a contraction splits otherwise
                out += [total + sum(map(self.word_count, self.words(text[start:i]))) for i in range(start, stop)]
                total += self.word_count(text[start:stop])
                at = stop
                continue
            units = self.stand_ins(text[start:stop])
            last, count = self.open_table(units)
            ends, n = [], 0
            for ch in text[start:stop]:
                ends.append(n)
                n += len(ch.encode("utf-8", "surrogatepass"))
            out += [total + self.close(units, n_bytes, last, count) for n_bytes in ends]
            total += self.close(units, n, last, count)
            at = stop
        return out + [total] * (len(text) - at + 1)

    def longest_prefix(self, text: str, budget: int) -> int:
        """The most characters of a text in normal form whose prefix has at most budget tokens."""
        counts = self.prefix_counts(text)
        return max(i for i, n in enumerate(counts) if n <= budget)


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = counter(path).count
        found = pa.array([count(t) for t in batch.column("text").to_pylist()], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), found], ["doc_id", "n_bytes", "n_tokens"])

    given = docs.select(docs[id_column].alias("doc_id"), normal_text(docs[text_column]).alias("text"))
    given = given.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    kind = given.schema["doc_id"].dataType.simpleString()
    return map_batches(given, work, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
