"""Token counts: a whole-token shortcut before byte-pair merging.

Offline, on the driver, every string of the vocabulary is proved or refuted: it is encoded
alone, and counts as a whole token when the library gives exactly its own id. A text is cut
into pre-tokens as the tokenizer's byte-level rule cuts it; those in the proved set count one
each, and only the rest are merged, each distinct one once per batch, by the library itself.

The cut is written for the characters whose class the regex module and the library agree on
(code points below 0x300 and general punctuation). Texts with others are first cut where any
character that no one takes for a space meets plain white space, where every pre-token ends. Of
the chunks, those of other characters are looked up in the proved set too, and encoded by the
library where they are not in it; the rest goes the short way. What a task remembers is bounded in
bytes, and long pieces are never remembered. Special strings
inside a text count one token each, as the library's default has it, and cut the text before
anything else. The proof is made once for each vocabulary file; its set is broadcast, and the
vocabulary bounds its size.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted
each; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIMIT = 512
#: The rule by which the byte-level tokenizer cuts texts; a fixed value of the vocabulary file.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points of plain texts, as ranges.
PLAIN = ((0, 0x2FF), (0x2010, 0x2027), (0x2030, 0x205E), (0x20AC, 0x20AC))
#: Code points besides plain spaces that one library or another takes, or once took, for a space; a fixed list.
DOUBTFUL = r"\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff"
#: Bytes of merged pieces, with an entry's own, that a task remembers before it starts anew; longer pieces are counted each time.
REMEMBERED = 64 << 20
LONGEST, ENTRY = 200, 200


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@cache
def whole_tokens(path: str) -> frozenset[str]:
    """The strings of the vocabulary that, encoded alone, are one token and one pre-token."""
    import regex

    tokenizer = _tokenizer(path)
    cut = regex.compile(PRE_TOKENS)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    ids = [i for i in range(tokenizer.get_vocab_size()) if i not in tokenizer.get_added_tokens_decoder()]
    strings = tokenizer.decode_batch([[i] for i in ids], skip_special_tokens=False)
    proved = set()
    encoded = tokenizer.encode_batch(strings, add_special_tokens=False)
    for i, text, e in zip(ids, strings, encoded, strict=True):
        if e.ids == [i] and "�" not in text and text not in special and cut.findall(text) == [text]:
            proved.add(text)
    return frozenset(proved)


@cache
def _plain_rule() -> tuple:
    """PRE_TOKENS for plain texts with its classes written out, which the standard library runs faster, a test for other characters, and where to cut texts that have them."""
    import regex

    def members(kind: str) -> str:
        found = [c for lo, hi in PLAIN for c in range(lo, hi + 1) if regex.fullmatch(kind, chr(c))]
        return "".join(f"\\u{c:04x}" for c in found)

    letters, digits, spaces = members(r"\p{L}"), members(r"\p{N}"), members(r"\s")
    rule = (
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{digits}]+| ?[^{spaces}{letters}{digits}]+"
        f"|[{spaces}]+(?![^{spaces}])|[{spaces}]+"
    )
    plain = "".join(f"\\u{lo:04x}-\\u{hi:04x}" for lo, hi in PLAIN)
    # a pre-token ends where white space follows on any other character
    return re.compile(rule), re.compile(f"[^{plain}]"), re.compile(f"(?<=[^{spaces}{DOUBTFUL}])(?=[{spaces}])")


@cache
def _merger(path: str):
    """The merge loop over the vocabulary's ranks, or None where the ids are not in the order of the merges."""
    model = json.loads(Path(path).read_text())["model"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    vocab = model["vocab"]
    ids = [vocab[a + b] for a, b in pairs]
    if any(x >= y for x, y in zip(ids[:-1], ids[1:], strict=True)) or model.get("ignore_merges"):
        return None
    import tiktoken
    from tokenizers.pre_tokenizers import ByteLevel

    # byte-level alphabets write printable bytes as themselves and the others, in order, from U+0100 on
    printable = {c for c in (*range(33, 127), *range(161, 173), *range(174, 256))}
    others = iter(range(256, 512))
    byte_of = {chr(b if b in printable else next(others)): b for b in range(256)}
    if set(byte_of) != set(ByteLevel.alphabet()):
        return None
    singles = {bytes([byte_of[c]]): vocab[c] for c in byte_of}
    ranks = singles | {bytes(byte_of[c] for c in a + b): vocab[a + b] for a, b in pairs}
    if max(singles.values()) > min(ids, default=1 << 60):
        return None
    # one pre-token comes at a time, and is one piece whatever it holds
    return tiktoken.Encoding("merges", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _count(path: str, proved) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, whole, merge = _tokenizer(path), proved.value, _merger(path)
        special = [t for t in tokenizer.get_added_tokens_decoder().values() if t.content]
        # tokens that take spaces along, or stand only as whole words, are left to the library
        strict = any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in special)
        marks = re.compile("|".join(re.escape(t.content) for t in sorted(special, key=lambda t: -len(t.content))) or r"(?!)")
        rule, odd, seams = _plain_rule()
        merged: dict[str, int] = {}
        held = 0

        def remembered(piece: str, count) -> int:
            nonlocal held
            m = merged.get(piece)
            if m is None:
                m = count(piece)
                if len(piece) <= LONGEST:
                    held += 4 * len(piece) + ENTRY
                    if held > REMEMBERED:
                        merged.clear()
                        held = 4 * len(piece) + ENTRY
                    merged[piece] = m
            return m

        def library(text: str) -> int:
            return len(tokenizer.encode(text, add_special_tokens=False).ids)

        def plain(text: str) -> int:
            total = 0
            for piece, n in Counter(rule.findall(text)).items():
                total += n if piece in whole else n * remembered(piece, lambda x: len(merge(x)))
            return total

        def mixed(text: str) -> int:
            total, run = 0, []
            for chunk in seams.split(text):
                if odd.search(chunk):
                    total += 1 if chunk in whole else remembered(chunk, library)
                else:
                    run.append(chunk)
                    if len(run) > 1000:
                        total, run = total + plain("".join(run)), []
            return total + plain("".join(run))

        def tokens(text: str) -> int:
            if merge is None or strict and marks.search(text):
                return library(text)
            parts = marks.split(text)
            return len(parts) - 1 + sum(mixed(x) if odd.search(x) else plain(x) for x in parts)

        for batch in batches:
            texts = batch.column("text").fill_null("")
            n_bytes, n_tokens = [], []
            for k in range(len(texts)):
                text = texts[k].as_py()
                n_bytes.append(len(text.encode()))
                n_tokens.append(tokens(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > LIMIT for n in n_tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return run


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document. path: a byte-level BPE .json file, at the same place on every machine."""
    spark: SparkSession = docs.sparkSession
    path = path or default_vocabulary()
    proved = spark.sparkContext.broadcast(whole_tokens(path))
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        _count(path, proved), "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
    )
