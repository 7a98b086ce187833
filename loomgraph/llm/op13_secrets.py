"""Secrets in texts: assignments to secret names, access keys, long hex runs, and random strings that few characters a token give away.

Base kinds are plain patterns, leftmost and non-overlapping for each kind; what does not pass its test is dropped
and not tried again:

* assign: a secret's name, `:` or `=`, and a value of six characters or more;
* access: `AKIA` and capitals or digits, twenty characters or more;
* hex: 24 or more lower-case hex digits.

Beside them the token-efficiency test finds strings of other shapes. A vocabulary of byte pairs packs text that people
write into few tokens, and random text into many. A run of `[A-Za-z0-9+/=_-]` that mixes two kinds of characters
(capitals, small letters, digits) becomes a span of kind `random` where its characters for each token are few. Left out are
runs that touch a base span; known digests: hex of a digest's length, a run behind a name such as `sha256-`, UUIDs; and identifiers:
numbers, dates, versions and serials, whose pieces are short, and names and paths, whose letters stand in words. A long run is
encoded in pieces of PIECE characters, all of it.

Null texts are empty. Every row is scanned for itself: null, repeated and unordered ids, ties and texts of any length change nothing, and
other columns are ignored. Offsets are code points, ends exclusive. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base patterns, in the order of their kinds, with the group that is measured and its least length.
BASE = (
    ("assign", re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
_HEX = re.compile(r"[0-9a-f]{24,}")  # runs of hex digits that are shorter never pass
KINDS = (*(kind for kind, *_ in BASE), "random")

#: Hex digits of the common digests (MD5, SHA-1, SHA-2).
DIGESTS = frozenset((32, 40, 56, 64, 96, 128))
_RUN = re.compile(r"[A-Za-z0-9+/=_-]+")
_BEFORE = re.compile(r"(?ai:md5|sha-?(?:1|224|256|384|512)|blake2[bs]|integrity|digest|checksum|etag)[\s\"'(]*[-:=][\s\"']*$")
_INSIDE = re.compile(r"(?ai:md5|sha-?(?:1|224|256|384|512)|blake2[bs])[-=_]")
_UUID = re.compile(r"(?ai:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: Characters of a piece between separators, at most, in dates, versions and serial numbers.
SHORT = 8
#: Characters of a run that are encoded at once.
PIECE = 256
#: Characters before a run that are searched for the name of a digest.
NAME_REACH = 24


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds."""
    found = []
    for kind, pattern, group, least in BASE:
        pattern = _HEX if kind == "hex" else pattern
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
    return found


def is_digest(text: str, start: int, end: int) -> bool:
    """Is the run a digest: hex of a digest's length, a UUID, or what stands behind a digest's name?"""
    run = text[start:end]
    if len(run) in DIGESTS and re.fullmatch("(?ai:[0-9a-f]+)", run):
        return True
    return bool(_UUID.fullmatch(run) or _INSIDE.match(run) or _BEFORE.search(text[max(0, start - NAME_REACH) : start]))


def is_identifier(run: str) -> bool:
    """Is the run a number, a date, version or serial of pieces of SHORT characters at most, or a name of words?

    A name has three quarters of its letters in words of four or more, and its digits in groups.
    """
    if max(map(len, re.split("[-_/=+]", run))) <= SHORT:
        return True
    parts = _PART.findall(run)
    letters = sum(len(p) for p in parts if not p.isdigit())
    in_words = sum(len(p) for p in parts if len(p) >= 4 and not p.isdigit())
    changes = sum(1 for a, b in zip(run, run[1:], strict=False) if a.isalnum() and b.isalnum() and a.isdigit() != b.isdigit())
    return 4 * in_words >= 3 * letters and 8 * changes <= len(run)


def _mixed(run: str) -> bool:
    return any(map(str.isdigit, run)) + any(map(str.islower, run)) + any(map(str.isupper, run)) >= 2


def random_spans(text: str, base: list[tuple[str, int, int]], efficiency: Callable[[str], float], shortest: int, ratio: float) -> list[tuple[str, int, int]]:
    """(random, start, end) of the runs of `shortest` characters or more that the vocabulary packs at `ratio` characters a token or fewer."""
    taken = sorted((a, b) for _, a, b in base)
    found, at = [], 0
    for m in _RUN.finditer(text):
        start, end = m.span()
        if end - start < shortest:
            continue
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        # ends of base spans need not ascend: all that begin before this run's end are asked
        k, touches = at, False
        while k < len(taken) and taken[k][0] < end and not touches:
            touches, k = taken[k][1] > start, k + 1
        run = m[0]
        if not touches and _mixed(run) and not is_identifier(run) and not is_digest(text, start, end) and efficiency(run) <= ratio:
            found.append(("random", start, end))
    return found


def _encoder(path: str) -> Callable[[str], float]:
    """Characters for each token of a run under a tiktoken vocabulary."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    vocabulary = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def efficiency(run: str) -> float:
        tokens = sum(len(vocabulary.encode_ordinary(run[k : k + PIECE])) for k in range(0, len(run), PIECE))
        return len(run) / max(1, tokens)

    return efficiency


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def _scan(vocabulary: str, shortest: int, ratio: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        efficiency = _encoder(vocabulary)
        for batch in batches:
            counts, digests, spans = [[] for _ in KINDS], [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                base = base_spans(text)
                more = random_spans(text, base, efficiency, shortest, ratio)
                for k, kind in enumerate(KINDS):
                    counts[k].append(sum(1 for s in base + more if s[0] == kind))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(base + more))
            columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return run


def secret_spans(docs: DataFrame, vocabulary: str | None = None, shortest: int = 20, ratio: float = 2.0) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) of every document. docs: (doc_id, text).

    vocabulary: the path of a tiktoken file that all executors have.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    schema = f"doc_id bigint, {', '.join(f'n_{k} bigint' for k in KINDS)}, base_sha256 string, spans string"
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(_scan(vocabulary, shortest, ratio), schema)


def redacted(docs: DataFrame, vocabulary: str | None = None, shortest: int = 20, ratio: float = 2.0) -> DataFrame:
    """docs with every span in text replaced by its kind in brackets; null texts stay null, and nothing else changes."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        efficiency = _encoder(vocabulary)

        def clean(text: str) -> str:
            base = base_spans(text)
            out, last = [], 0
            for kind, start, end in sorted(base + random_spans(text, base, efficiency, shortest, ratio), key=lambda s: (s[1], -s[2])):
                if end <= last:
                    continue
                out.append(text[last:start] + f"[{kind}]" if start >= last else "")
                last = end
            return "".join(out) + text[last:]

        for batch in batches:
            texts = pa.array([None if t is None else clean(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if k == at else batch.column(k) for k in range(batch.num_columns)], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
