"""Secret scan: fixed patterns plus a token-efficiency test.

Base spans come from three patterns. The method adds ``random`` spans: runs of 20 or more
base64-like characters, of whatever classes, that a public tokenizer's vocabulary needs
a token for every ``max_ratio`` characters or fewer. Prose and code compress well, random
strings do not. Known digests (hexadecimal of a usual digest length) and identifiers
(UUIDs, paths of words) are left out. A path is one of words if its groups of over three
letters compress well too, or it has none.

A run is judged in what is left of it once UUIDs, digests and base spans are cut out. What is
not random as a whole is judged by its parts: stretches of groups between / + _ = - whose
tokens outweigh their characters at ``max_ratio``, so readable text joined to a secret does
not hide it. A rest of 8 characters or more that is part of one unbroken string with a hex or
access span counts together with that span.

Defined results: a null text counts as empty and has no spans; texts of any length are
scanned whole; repeated rows are scanned each; an empty table gives an empty result; other columns
are passed through, those named as an added column replaced.

The vocabulary is a file of tiktoken ranks, by default the byte-level one under /opt/tokenizers; its
path is a parameter, and only the driver reads it there.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import takewhile

import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import quoted, side_file, small_batches, spare_name

# fixed values: the patterns and lengths of the base kinds
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"  # the maximal runs [0-9a-f]+ of 16 or more
KINDS = ["assign", "access", "hex", "random"]
DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
UUID = r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}"
# the split pattern of the byte-level vocabulary
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_assign, _access, _hex = re.compile(ASSIGN, re.I | re.A), re.compile(ACCESS), re.compile(HEX)
_keyword = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)
_run = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_uuid = re.compile(UUID)
_group = r"(?:(?:[A-Z]?[a-z]+|[A-Z]+)[0-9]{0,2}|[0-9]{1,4})"  # a word, also as v2, or a short number
_words = re.compile(rf"{_group}(?:[/_=+-]+{_group})+[/=]*")
_atom = re.compile(r"[A-Za-z0-9]+[/+_=-]*|[/+_=-]+")
_digest = re.compile(r"(?<![A-Za-z0-9])[0-9a-fA-F]{32,}(?![A-Za-z0-9])")
_cuttable = re.compile(r"[0-9a-fA-F]{32}|[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-")
_letters = re.compile(r"[A-Za-z]{4,}")
SEPARATORS = "=/+_-"
MIN_RUN, MIN_REST = 20, 8

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_VOCABULARY_BYTES = 16 << 20


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    if _keyword.search(text):
        found += [("assign", m.start(), m.end()) for m in _assign.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _access.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", m.start(), m.end()) for m in _hex.finditer(text)]
    return sorted(found, key=_order)


def _order(span: tuple[str, int, int]) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


def n_tokens(run: str, encoding: tiktoken.Encoding) -> int:
    # long runs in pieces: the encoder's time grows faster than a piece's length
    return sum(len(encoding.encode_ordinary(run[i : i + 2000])) for i in range(0, len(run), 2000))


def is_words(run: str, encoding: tiktoken.Encoding, max_ratio: float) -> bool:
    if not _words.fullmatch(run):
        return False
    groups = _letters.findall(run)
    return not groups or sum(map(len, groups)) > max_ratio * sum(n_tokens(g, encoding) for g in groups)


def is_random(run: str, encoding: tiktoken.Encoding, max_ratio: float) -> bool:
    if is_words(run, encoding, max_ratio):
        return False
    return len(run) <= max_ratio * n_tokens(run, encoding)


def segments(scores: list[float]) -> list[tuple[int, int]]:
    """The maximal scoring segments, as (first, end): disjoint, linear time (Ruzzo and Tompa)."""
    done: list[tuple[int, int]] = []
    stack: list[tuple[int, int, float, float, int]] = []  # first, end, sums before and after, nearest lower one
    total = 0.0
    for i, x in enumerate(scores):
        before, total = total, total + x
        if x <= 0:
            continue
        first, low = i, before
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0:  # nothing before can grow any more
                done += [f[:2] for f in stack]
                stack = [(first, i + 1, low, total, -1)]
                break
            if stack[j][3] >= total:
                stack.append((first, i + 1, low, total, j))
                break
            first, low = stack[j][0], stack[j][2]
            del stack[j:]
    return done + [f[:2] for f in stack]


def random_parts(run: str, encoding: tiktoken.Encoding, max_ratio: float) -> list[tuple[int, int]]:
    """Where ``run`` is random: as a whole, or in stretches of its groups."""
    if len(run) < MIN_RUN:
        return []
    if is_random(run, encoding, max_ratio):
        return [(0, len(run))]
    groups = [m.span() for m in _atom.finditer(run)]
    # at max_ratio exactly a group counts as random
    scores = [max_ratio * n_tokens(run[s:e], encoding) - (e - s) + 1e-6 for s, e in groups]
    found = []
    for i, j in segments(scores):
        s, e = groups[i][0], groups[j - 1][1]
        whole = run[s:e]
        e = s + len(whole.rstrip(SEPARATORS[1:]))  # padding stays
        if e - s >= MIN_RUN and is_random(whole, encoding, max_ratio):
            found.append((s, e))
    return found


def rests(text: str, s: int, e: int, base: list[tuple[str, int, int]]) -> Iterator[tuple[int, int, bool]]:
    """What is left of a run without UUIDs, digests and base spans; True: cut off a hex or access span's own string."""
    run = text[s:e]
    cuts = [(max(a, s), min(b, e), k in ("hex", "access")) for k, a, b in base if a < e and s < b]
    cuts += [(s + m.start(), s + m.end(), False) for m in _uuid.finditer(run)]
    cuts += [(s + m.start(), s + m.end(), False) for m in _digest.finditer(run) if len(m.group()) in DIGEST_LENGTHS]
    at, glued = s, False
    for a, b, g in [*sorted(cuts), (e, e, False)]:
        if a > at:
            lo, hi = at, a
            own = glued and text[at] not in SEPARATORS or g and text[a - 1] not in SEPARATORS
            while at > s and lo < hi and text[lo] in SEPARATORS:
                lo += 1
            while a < e and lo < hi and text[hi - 1] in SEPARATORS:
                hi -= 1
            yield lo, hi, own
        if b > at:
            at, glued = b, g


def all_spans(text: str, encoding: tiktoken.Encoding, max_ratio: float = 2.0) -> list[tuple[str, int, int]]:
    base = base_spans(text)
    more, first = [], 0
    for m in _run.finditer(text):
        s, e = m.span()
        while first < len(base) and base[first][2] <= s:
            first += 1
        near = [base[i] for i in takewhile(lambda i: base[i][1] < e, range(first, len(base))) if s < base[i][2]]
        for lo, hi, own in rests(text, s, e, near) if near or _cuttable.search(m.group()) else [(s, e, False)]:
            if own and MIN_REST <= hi - lo < MIN_RUN:
                parts = [(0, hi - lo)] if is_random(text[lo:hi], encoding, max_ratio) else []
            else:
                parts = random_parts(text[lo:hi], encoding, max_ratio)
            more += [("random", lo + a, lo + b) for a, b in parts]
    return sorted(base + more, key=_order)


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        content = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(content) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path}: a vocabulary of over {MAX_VOCABULARY_BYTES} bytes")
    return content


_encodings: dict[str, tiktoken.Encoding] = {}


def encoding_of(name: str, content: bytes) -> tiktoken.Encoding:
    if name not in _encodings:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        _encodings[name] = tiktoken.Encoding("scan", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
    return _encodings[name]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    out, at = [], 0
    for _, s, e in sorted(spans, key=lambda x: x[1]):
        if s > at or not out:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def secret_scan(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, max_ratio: float = 2.0, redacted: str | None = None) -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, base_sha256 and spans; see the module.

    ``redacted``: with a mark given, ``text`` has each span replaced by it.
    """
    name = side_file(small_batches(docs), read_vocabulary(vocabulary), ".vocabulary")
    added = {"n_assign": "long", "n_access": "long", "n_hex": "long", "base_sha256": "string", "spans": "string"}
    docs = docs.drop(*added)
    fields = ", ".join(f"{k} {v}" for k, v in added.items()) + (", redacted string" if redacted is not None else "")

    @F.pandas_udf(fields)
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from pyspark import SparkFiles

        with open(SparkFiles.get(name), "rb") as f:
            encoding = encoding_of(name, f.read())
        for texts in batches:
            rows = []
            for t in texts:
                spans = all_spans(t or "", encoding, max_ratio)
                base = [x for x in spans if x[0] != "random"]
                kinds = [x[0] for x in base]
                row = [*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)]
                rows.append(row + ([redact(t, spans, redacted) if spans else t] if redacted is not None else []))
            yield pd.DataFrame(rows, columns=[*added, *(["redacted"] if redacted is not None else [])])

    scan = spare_name(docs, "_scan")
    out = docs.select("*", scanned(quoted(text)).alias(scan))
    kept = [F.col(scan)["redacted"].alias(text) if c == text and redacted is not None else quoted(c) for c in docs.columns]
    return out.select(*kept, *(F.col(scan)[c].alias(c) for c in added))
