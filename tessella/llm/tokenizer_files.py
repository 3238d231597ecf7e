"""Reading published tokenizer files into the tables that the BPE operators need."""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import regex

#: What the regex engine of the tokenizer files takes for white space.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


@lru_cache(maxsize=1)
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Bytes that print in Latin-1 stand for themselves; the others take the
    characters from U+0100 on, in order.
    """
    own = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0x100
    for b in range(256):
        out.append(chr(b) if b in own else chr(extra))
        extra += b not in own
    return out


@dataclass
class BpeFile:
    """A parsed BPE file: vocabulary, merges in rank order, and how text is cut up."""

    vocab: dict[str, int]
    merges: list[tuple[str, str]]
    suffix: str
    specials: dict[str, int]
    word_level: bool

    @property
    def special_pattern(self) -> re.Pattern | None:
        names = sorted(self.specials, key=len, reverse=True)
        return re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None


def parse(raw: bytes) -> BpeFile:
    """Parse a ``tokenizers`` JSON file.

    Two kinds are known: byte-level pieces that keep their leading space, and
    lower-cased words with an end-of-word suffix. Anything else is refused.
    """
    spec = json.loads(raw)
    model = spec["model"]
    if model["type"] != "BPE" or model.get("byte_fallback") or model.get("dropout"):
        raise ValueError("only plain BPE models are supported")
    suffix = model.get("end_of_word_suffix") or ""
    kind = spec["pre_tokenizer"]["type"]
    word_level = bool(suffix) and kind == "Sequence"
    if not word_level and kind != "ByteLevel":
        raise ValueError(f"unknown pre-tokenizer {kind}")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return BpeFile(model["vocab"], merges, suffix, specials, word_level)


#: Pieces of a byte-level vocabulary.
BYTE_PIECES = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
)
#: Pieces of a lower-cased vocabulary of words; white space is dropped.
WORD_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")
WHITE_CHARS = frozenset(chr(i) for i in range(0x3001) if re.fullmatch(f"[{WHITE}]", chr(i)))
_WHITE_RUN = re.compile(f"[{WHITE}]+")
_OTHER_BLANKS = re.compile("[\x1c-\x1f]")
#: Where cutting a text at each space would change its runs of white space.
_JOINED_RUNS = re.compile(f"[{WHITE}] [{WHITE}]")


def lower(text: str) -> str:
    """Lower-case code point by code point, without the final-sigma rule."""
    if text.isascii() or "Σ" not in text:
        return text.lower()
    return "".join(c.lower() for c in text)


def word_chunks(text: str) -> list[str]:
    """Normalise and cut at white space; no piece crosses a cut."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    text = lower(text)
    return [c for c in _WHITE_RUN.split(text) if c] if _OTHER_BLANKS.search(text) else text.split()


def byte_chunks(text: str) -> tuple[str, list[str]] | None:
    """The text up to its first space, and what follows each space, where cutting there leaves all pieces as they are."""
    if _JOINED_RUNS.search(text):
        return None
    head, *rest = text.split(" ")
    return head, rest


class Memo(dict):
    """A dictionary that computes what it lacks. Once it is full, what was not asked for since it was last full is forgotten."""

    def __init__(self, compute, limit: int = 300_000):
        super().__init__()
        self.compute, self.limit = compute, limit
        self.before: dict = {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= 64:
            if len(self) >= self.limit:
                self.before = dict(self)
                self.clear()
            self[key] = value
        return value
