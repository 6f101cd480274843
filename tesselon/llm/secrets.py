"""Secret scans: fixed patterns, then guess costs of values in credential contexts.

The fixed patterns find assignments, access keys and long hexadecimal runs. A
value behind an identifier that holds a credential word is then segmented at least cost into
dictionary words, dates, repeats, keyboard walks, copies and brute-force spans; the cost
is how many guesses, as a power of ten, a cracker who knows such parts would
need. Values that cost enough are spans of kind ``guess``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import one_array

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile(rb"AKIA[A-Z0-9]+"), re.compile(rb"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
WORDS = rb"(?i:password|passwd|passphrase|passcode|pwd|pass|secret|token|api_?key|credentials?|auth|login|pin|private_?key)"
#: An identifier with a credential word anywhere in it, taken whole, so each is searched once.
NAME = rb"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]*?" + WORDS + rb")[A-Za-z0-9_]++"
#: What may introduce a credential, and the value behind it, which isn't an assignment of its own.
CONTEXT = re.compile(rb"(" + NAME + rb""")["']?\x20*(?:[:=]|is\b|->|=>)\x20*["']?(?!""" + NAME + rb"""["']?[:=]["']?[^\s"'<>,;]{4})([^\s"'<>,;]{4,})""")
#: A credential word that is a part of its own in an identifier: DB_PASSWORD, userPassword.
OWN = re.compile(rb"(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))" + WORDS + rb"(?:(?![A-Za-z])|(?<=[a-z])(?=[A-Z]))")
#: What words of prose are made of; the guess cost doesn't know most of them.
PROSE = re.compile(rb"[A-Za-z.'\x80-\xff-]+")
#: Any text without a match of this has no span (RE2 syntax).
ANY = r"""(?i)(pass|pwd|secret|token|api_?key|credential|auth|login|pin|private_?key)|(?-i:AKIA[A-Z0-9]{16})|(?-i:[0-9a-f]{24})"""

#: Costs at which a value is taken for a secret, in powers of ten.
GUESS_FROM = 8.0

# Common password parts in descending order of use, and keyboard rows.
COMMON = (
    "password qwerty letmein admin welcome login dragon monkey football master shadow sunshine princess "
    "baseball hello freedom whatever trustno secret test user guest root default changeme pass love money "
    "summer winter spring autumn monday friday january february march april june july august september "
    "october november december server database system token example sample demo temp hunter killer super "
    "world house home happy green blue black white orange silver golden flower cheese coffee computer "
    "internet michael jordan thomas george charlie andrew daniel jessica jennifer ashley "
    "iloveyou superman batman access mustang soccer hockey starwars ranger harley buster tigger pepper ginger "
    "matrix maggie cookie banana purple yellow diamond angel lovely family friend heaven phoenix tiger eagle "
    "lion wolf bear horse kitty puppy rocket thunder storm magic power king queen prince knight angels chelsea "
    "liverpool arsenal barcelona london paris berlin america england germany canada robert william david "
    "joshua matthew anthony richard martin samantha nicole michelle amanda hannah sophie maria laura alex "
    "sunday saturday tuesday thursday wednesday change manager service backup public private account office "
    "company oracle mysql linux windows google samsung apple android cisco docker"
).split()
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
#: Slanted columns of the keyboard, both ways.
COLUMNS = ("1qaz", "2wsx", "3edc", "4rfv", "5tgb", "6yhn", "7ujm", "8ik,", "9ol.", "0p;/", "zse4", "xdr5", "cft6", "vgy7", "bhu8", "nji9", "mko0", ",lp-", ".;[=")
LEET = str.maketrans({"4": "a", "@": "a", "8": "b", "3": "e", "6": "g", "1": "i", "0": "o", "5": "s", "$": "s", "7": "t"})
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d")
LONGEST_DATE = 10
LONGEST_BLOCK = 32


def _neighbours(rows: tuple[str, ...]) -> dict[str, set[str]]:
    found: dict[str, set[str]] = {}
    for row in rows:
        for a, b in zip(row, row[1:], strict=False):
            found.setdefault(a, set()).add(b)
            found.setdefault(b, set()).add(a)
    return found


NEXT, BELOW = _neighbours(ROWS), _neighbours(COLUMNS)


def ranked(words: Iterable[str]) -> dict[str, int]:
    """The rank of each word, from 1; letters stand for the digits that often replace them."""
    found: dict[str, int] = {}
    for w in words:
        found.setdefault(w.lower().translate(LEET), len(found) + 1)
    return found


RANK = ranked(COMMON)


def _alphabet(c: str) -> float:
    """How many characters the kind of ``c`` has."""
    if c.isdigit():
        return 10
    return 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 100


def _useful(begins: list[int], cost: Callable[[int], float], latest: int) -> float:
    """The least cost of the begins up to ``latest``; those above an earlier one's cost go."""
    least, kept = float("inf"), []
    for a in begins:
        if a > latest:
            kept.append(a)
        elif (own := cost(a)) < least:
            least = own
            kept.append(a)
    begins[:] = kept
    return least


def guess_cost(value: str, rank_of: dict[str, int] = RANK) -> float:
    """The least cost of ``value`` in powers of ten, over all segmentations.

    A brute-force character costs its alphabet; a word its rank, case pattern and
    digits for letters; a date ten thousand days; a walk along a row or column its
    first character, its kind and its length; more copies of the last characters
    (up to LONGEST_BLOCK; a single one twice at least) the block's length and their
    number. Each further part costs a little, so that fewer parts are preferred.

    A run is tried from its begin and from where another kind of part ends in it.
    Other begins are never cheaper: two parts of one run cost more than one, and so
    does a character before the run that belongs to it. Of two begins the earlier
    one gains as the run grows, so a later one that isn't cheaper now is given up.
    """
    n, longest = len(value), max(map(len, rank_of), default=0)
    lower = value.lower()
    plain = lower.translate(LEET)
    best = [0.0] + [float("inf")] * n
    ended: list[object] = [None] * (n + 1)  # the kind of the last part
    begins: list[list[int]] = [[], []]
    copied = [0] * (LONGEST_BLOCK + 1)  # how many characters are those a block before
    bases: dict[tuple[int, int], list[int]] = {}
    for k in range(1, n + 1):
        c = value[k - 1]
        cost, kind = best[k - 1] + log10(_alphabet(c)), None
        before = lower[k - 2] if k > 1 else ""
        for run, near in enumerate((NEXT, BELOW)):
            if lower[k - 1] not in near.get(before, ()):
                begins[run] = [k - 1]
            elif ended[k - 1] not in (None, run):
                begins[run].append(k - 1)
            own = _useful(begins[run], lambda a, k=k: best[a] + log10(_alphabet(value[a])) + 1.0 + log10(k - a) + 0.3, k - 3)
            if own < cost:
                cost, kind = own, run
        periods: list[int] = []
        for size in range(1, min(LONGEST_BLOCK, k - 1) + 1):
            if value[k - 1 - size] != c:
                if copied[size]:
                    copied[size] = 0
                    for place in range(size):
                        bases.pop((size, place), None)
                continue
            copied[size] += 1
            if copied[size] < size or any(size % p == 0 and copied[p] - copied[size] >= size - p for p in periods):
                continue  # copies of a shorter block cost less
            periods.append(size)
            known = bases.setdefault((size, k % size), [])
            if not known or ended[k - size] != -size:
                known.append(k - size)
            own = _useful(known, lambda a, k=k, size=size: best[a] + log10(size) + 0.5 + log10((k - a) // size + 1) + 0.3, k - max(size, 2))
            if own < cost:
                cost, kind = own, -size
        for size in range(3, min(longest, k) + 1):
            rank = rank_of.get(plain[k - size : k])
            if rank:
                part = value[k - size : k]
                turned = 0.0 if part.islower() or not part.isalpha() else 0.3 if part.istitle() or part.isupper() else 1.0
                swapped = 0.0 if lower[k - size : k] == plain[k - size : k] else 0.5
                if (own := best[k - size] + log10(rank + 1) + turned + swapped + 0.3) < cost:
                    cost, kind = own, "word"
        for size in range(4, min(LONGEST_DATE, k) + 1):
            if value[k - 1].isdigit() and DATE.fullmatch(value, k - size, k) and (own := best[k - size] + 4.0 + 0.3) < cost:
                cost, kind = own, "date"
        best[k], ended[k] = cost, kind
    return best[n]


Span = tuple[int, int, str]


def scan(data: bytes, guess_from: float = GUESS_FROM, rank_of: dict[str, int] = RANK) -> list[Span]:
    """(start, end, kind) in bytes, by start, then kind as listed, then end."""
    found: list[Span] = []
    for m in ASSIGN.finditer(data):
        if m.end(2) - m.start(2) >= LEAST["assign"]:
            found.append((m.start(), m.end(), "assign"))
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):
        least = LEAST[kind]
        found.extend((m.start(), m.end(), kind) for m in pattern.finditer(data) if m.end() - m.start() >= least)
    for m in CONTEXT.finditer(data):
        value = m.group(2).rstrip(b".!?)]}:")
        # In author or opinion the credential word is chance, so prose behind it says nothing.
        if PROSE.fullmatch(value) and not OWN.search(m.group(1)):
            continue
        if len(value) >= 4 and guess_cost(value.decode("utf-8", "replace"), rank_of) >= guess_from:
            found.append((m.start(2), m.start(2) + len(value), "guess"))
    found.sort(key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return found


def in_points(data: bytes, spans: list[Span]) -> list[Span]:
    """The same spans in code points."""
    if not spans or data.isascii():
        return spans
    begins = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
    return [(int(begins[a]), int(begins[b]), kind) for a, b, kind in spans]


def shown(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scanned(text: Column, guess_from: float = GUESS_FROM, words: Iterable[str] = COMMON) -> Column:
    """A struct of counts, base_sha256 and spans as a column."""
    rank_of = ranked(words)
    fields = ("n_assign", "n_access", "n_hex")
    schema = T.StructType([*(T.StructField(f, T.LongType()) for f in fields), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    nothing = hashlib.sha256(b"").hexdigest()

    @F.arrow_udf(schema)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = one_array(batch)
            n = len(texts)
            counts = np.zeros((3, n), np.int64)
            base, spans = [nothing] * n, [""] * n
            likely = np.flatnonzero(np.asarray(pc.match_substring_regex(texts, ANY)))
            for k, data in zip(likely.tolist(), texts.take(pa.array(likely)).cast(pa.binary()).to_pylist(), strict=True):
                found = in_points(data, scan(data, guess_from, rank_of))
                fixed = [s for s in found if s[2] != "guess"]
                for s in fixed:
                    counts[KINDS.index(s[2]), k] += 1
                base[k] = hashlib.sha256(shown(fixed).encode()).hexdigest()
                spans[k] = shown(found)
            yield pa.StructArray.from_arrays([*map(pa.array, counts), pa.array(base, pa.string()), pa.array(spans, pa.string())], schema.names)

    return run.asNondeterministic()(text)


def find_secrets(df: DataFrame, text_col: str = "text", guess_from: float = GUESS_FROM, words: Iterable[str] = COMMON) -> DataFrame:
    """All rows and columns of ``df`` plus a struct ``secrets`` (n_assign, n_access, n_hex, base_sha256, spans).

    Spans are kind:start:end in code points, end exclusive. ``words`` are the words
    that a cracker tries, the most common first; a list of leaked passwords makes
    the costs sharper than the short one that comes with the operator. Null text counts as
    empty and has none; very long texts are searched whole; repeated rows are each
    searched; an empty table gives an empty result. Other columns pass
    through, but one named ``secrets`` is replaced.
    """
    return df.withColumn("secrets", scanned(F.col(f"`{text_col}`"), guess_from, words))
