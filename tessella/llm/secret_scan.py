"""Secret scans: fixed patterns, and guess costs of values in credential contexts.

Fixed patterns find assignments, access keys and long hex strings. Beside them,
words that follow the mention of a credential are scored by a dynamic program
over segmentations: each position keeps the least number of guesses that
spells the value so far with words, dates, repeats, keyboard walks and
brute-force spans. Values that take many guesses are reported as ``guess``.
"""

from __future__ import annotations

import functools
import hashlib
import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import map_texts

KINDS = ("assign", "access", "hex", "guess")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_LONG_HEX = re.compile(r"[0-9a-f]{24}")
#: A credential is named, up to four joining words or signs follow, the last of them a link, then a value.
_NAME = re.compile(r"""\b(?:passwords?|passwd|pwd|passphrase|(?:api|access|private|secret)[ _-]?key|secret|token|credentials?)\b["']?""", re.IGNORECASE | re.ASCII)
_LINK = re.compile(r"""\x20*(?:is|was|to|as|are)\b|\x20*(?::=|=>|->|[:=])""", re.IGNORECASE | re.ASCII)
_JOINING = re.compile(r"""\x20+[A-Za-z]+(?:['-][A-Za-z]+)*["']?(?=[\x20:=])|\x20*(?::=|=>|->|[:=])""", re.ASCII)
_VALUE = re.compile(r"""\x20*["'`]?([^\s"'`<>]{8,})""")
JOINING = 4
_NAMED = re.compile(r"pass|pwd|secret|token|key|credential", re.IGNORECASE | re.ASCII)

#: log10 of the guesses from which a value counts as a secret.
LEAST_LOG10 = 10.0
#: Words cheapest to guess, most frequent first; the rank is the number of guesses. ``word_ranks`` has the others.
COMMON_WORDS = (
    "password admin welcome login secret token master dragon monkey letmein qwerty user test guest root "
    "default change changeme example sample dummy public private access account system server database "
    "service client summer winter spring autumn monday tuesday friday sunday january february march april june july "
    "august september october november december hello world love money king queen shadow football baseball soccer "
    "the and for with that this from your have not are was will can all one new key pass word code name value"
).split()
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/.](?:0?[1-9]|1[0-2])[-/.](?:19|20)\d\d|(?:19|20)\d\d")
#: Vocabularies whose whole words are the word list; tokens are numbered by how frequent they are, about.
VOCABULARIES = (("word_bpe_49k.json", "(.*)</w>"), ("byte_bpe_50k.json", "\u0120(.*)"))
_LONGEST_WORD = 20
#: Repeats that are tried one by one.
REPEATS = 16
# log10 of guesses: a further segment, where a walk starts, each further key of it
_FURTHER, _FIRST_KEY, _KEY = 0.48, math.log10(47), 0.5
_PLACE = {c: (y, x) for y, row in enumerate(_ROWS) for x, c in enumerate(row)}
_LEET = str.maketrans("0134579@$!", "oieastgasi")


def _near(a: str, b: str) -> bool:
    """Neighbours on the keyboard."""
    p, q = _PLACE.get(a), _PLACE.get(b)
    return p is not None and q is not None and a != b and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1


def _alphabet(part: str) -> float:
    """log10 of the guesses for one more character of this kind."""
    n = 10 * any(c.isdigit() for c in part) + 26 * any(c.islower() for c in part) + 26 * any(c.isupper() for c in part)
    n += 33 * any(not c.isalnum() for c in part)
    return math.log10(max(n, 10))


@functools.cache
def word_ranks() -> dict[str, float]:
    """log10 of the guesses for each word of the list, read from the tokenizers' vocabularies."""
    import public_tokenizers

    least: dict[str, int] = {}
    for name, whole in VOCABULARIES:
        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        for token, number in vocabulary.items():
            m = re.fullmatch(whole, token)
            if m and 3 <= len(m[1]) <= _LONGEST_WORD and m[1].isascii() and m[1].isalpha():
                word = m[1].lower()
                least[word] = min(number, least.get(word, number))
    ranks = {w: math.log10(2 + len(COMMON_WORDS) + i) for i, w in enumerate(sorted(least, key=lambda w: (least[w], w)))}
    return ranks | {w: math.log10(2 + i) for i, w in enumerate(COMMON_WORDS)}


def guess_cost(value: str, ranks: dict[str, float] | None = None) -> float:
    """log10 of the least guesses that a segmentation of ``value`` takes.

    Segments: a listed word (capitals and digits for letters cost a factor of
    2 each), a date, a repeated character or group (up to ``REPEATS`` times, or
    as often as it goes), a keyboard walk of three keys or more, or brute
    force. Each further segment but brute force costs a factor of 3. The empty
    value costs 0. The time is linear in the length.
    """
    n = len(value)
    ranks = word_ranks() if ranks is None else ranks
    small = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = small.translate(_LEET)
    per = _alphabet(value)
    best = [math.inf] * (n + 1)
    best[0] = 0.0
    # the least cost up to each place with a walk as last segment
    walk = [math.inf] * (n + 1)
    near = [False, *(_near(small[i - 1], small[i]) for i in range(1, n))]
    # how many characters up to each equal those 1, 2, 3 and 4 before them
    equal = {width: [0] * n for width in (1, 2, 3, 4)}
    for i in range(1, n):
        for width, run in equal.items():
            if i >= width and value[i] == value[i - width]:
                run[i] = run[i - 1] + 1
    for end in range(1, n + 1):
        # brute force, one more character
        cost = best[end - 1] + per
        for start in range(max(0, end - _LONGEST_WORD), end - 2):
            word = small[start:end]
            rank = ranks.get(word)
            if rank is None and (rank := ranks.get(plain[start:end])) is not None:
                rank += math.log10(2)
            if rank is not None:
                rank += math.log10(2) * (value[start:end] != word)
                cost = min(cost, best[start] + rank + _FURTHER * (start > 0))
        if end >= 2 and near[end - 1]:
            walk[end] = walk[end - 1] + _KEY
            if end >= 3 and near[end - 2]:
                walk[end] = min(walk[end], best[end - 3] + _FIRST_KEY + 2 * _KEY + _FURTHER * (end > 3))
            cost = min(cost, walk[end])
        for width in (1, 2, 3, 4):
            most = 1 + equal[width][end - 1] // width
            for times in {*range(2, min(most, REPEATS) + 1), most}:
                if times > 1 and times * width >= 3:
                    start = end - width * times
                    cost = min(cost, best[start] + width * per + math.log10(times) + _FURTHER * (start > 0))
        if value[end - 1].isdigit():
            for start in range(max(0, end - 10), end - 3):
                if value[start].isdigit() and _DATE.fullmatch(value, start, end):
                    cost = min(cost, best[start] + (4.4 if end - start > 4 else 2.1) + _FURTHER * (start > 0))
        best[end] = cost
    return best[n]


Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, by kind; code points, end exclusive."""
    out: list[Span] = []
    if _NAMED.search(text):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if _LONG_HEX.search(text):
        out += [("hex", *m.span()) for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    return out


def guessed_spans(text: str, least_log10: float = LEAST_LOG10, ranks: dict[str, float] | None = None) -> list[Span]:
    """Values in credential contexts that take at least ``10 ** least_log10`` guesses.

    Every value behind one of a name's joining words or signs is scored. Names
    inside a value that was scored don't open a context of their own.
    """
    out: list[Span] = []
    if not _NAMED.search(text):
        return out
    scored: dict[int, int] = {}
    for name in _NAME.finditer(text):
        if any(start <= name.start() < end for start, end in list(scored.items())[-JOINING:]):
            continue
        at = name.end()
        for _ in range(JOINING):
            if (link := _LINK.match(text, at)) and (m := _VALUE.match(text, link.end())) and m.start(1) not in scored:
                value = m[1].rstrip(".,;:!?)")
                scored[m.start(1)] = m.end(1)
                if len(value) >= 8 and guess_cost(value, ranks) >= least_log10:
                    out.append(("guess", m.start(1), m.start(1) + len(value)))
            if not (joining := _JOINING.match(text, at)):
                break
            at = joining.end()
    return out


def find_spans(text: str, least_log10: float = LEAST_LOG10, ranks: dict[str, float] | None = None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, each by start and then in the order of ``KINDS``.

    A guessed value that lies in a base span isn't repeated.
    """
    base = base_spans(text)
    more = [g for g in guessed_spans(text, least_log10, ranks) if not any(b[1] <= g[1] and g[2] <= b[2] for b in base)]
    rank = lambda s: (s[1], KINDS.index(s[0]), s[2])
    return sorted(base, key=rank), sorted(base + more, key=rank)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame, *, least_log10: float = LEAST_LOG10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scan every whole text; one row for each input row.

    Returns the id, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256`` (of
    the base spans) and ``spans`` (all of them). A null text counts as empty:
    no spans, the digest of nothing, an empty string. Null ids and repeated
    rows stay as they are; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    ranks = docs.sparkSession.sparkContext.broadcast(word_ranks())

    def work(batches):
        for batch in batches:
            counts, digests, spans = [], [], []
            for text in batch.column(1):
                base, every = find_spans(text.as_py() or "", least_log10, ranks.value)
                counts.append([sum(s[0] == k for s in base) for k in KINDS[:3]])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            n = [pa.array([c[i] for c in counts], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *n, pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    out = map_texts(docs, [F.col(id_col).alias("id"), F.col(text_col).alias("text")], work, f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return out.withColumnRenamed("id", id_col)


def redact_text(text: str, mask: str, least_log10: float = LEAST_LOG10, ranks: dict[str, float] | None = None) -> str:
    """The text with each run of overlapping spans replaced by ``mask``."""
    spans = find_spans(text, least_log10, ranks)[1]
    if not spans:
        return text
    parts, at = [], 0
    for _, start, end in spans:
        if start >= at:
            parts += [text[at:start], mask]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, *, mask: str = "[secret]", least_log10: float = LEAST_LOG10, text_col: str = "text") -> DataFrame:
    """``docs`` with every secret in ``text_col`` replaced; ``n_chars``, where there is one, is counted anew.

    Null texts stay null; all other columns pass through unchanged.
    """
    names = docs.columns
    others = [F.col(c) for c in names if c != text_col]
    ranks = docs.sparkSession.sparkContext.broadcast(word_ranks())

    def work(batches):
        for batch in batches:
            texts = [None if t.as_py() is None else redact_text(t.as_py(), mask, least_log10, ranks.value) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.columns[1:]], batch.schema.names)

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [docs.schema[text_col], *[docs.schema[c] for c in names if c != text_col]])
    out = map_texts(docs, [F.col(text_col), *others], work, types).select(*names)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out
