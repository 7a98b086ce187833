"""Chat formatting by schema fingerprints.

A layout is the set of nested field paths of a record: names joined by dots, [] after a list. Its
fingerprint is the SHA-256 of these paths in canonical order. Every path is hashed, and so are the
paths that a declarative mapping needs: of the mappings whose hashes a layout has all of, the one
with the most paths is selected, and turns the layout into canonical turns (role, text). Fields
that no mapping names change the fingerprint and nothing else. Typed tables are looked up once, from
their schema; JSON records one by one, from their own fields. All work is done by built-in functions.

Canonical turns are rendered as `<|role|>text<|end|>`. `~` escapes: `~` becomes `~0`, `<` `~1`,
`[` `~2` and, in roles, `|` `~3`, so no control string of this or another template survives
inside a text, and unescaping gives the text back exactly. The loss mask is a list of spans of
the formatted string, in code points: the texts of assistant turns.

Defined results: null texts and roles are empty; turns order by turn (null first), then role
and text; repeated rows are turns of their own; conversations with a null id form one group; an
empty list of messages gives no turns, as an empty array; records of an unknown layout, invalid
JSON and null get null and are given back by unmapped(); an empty table gives an empty table;
extra columns are ignored. A conversation is one string by nature and is built in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role: string, text: string>>"
END = "<|end|>"


def path_hash(path: str) -> str:
    """The hash of one nested path."""
    return hashlib.md5(path.encode()).hexdigest()


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns. turns: SQL over the variant column v; listed: the list that may be empty."""

    name: str
    paths: tuple[str, ...]
    turns: str
    listed: str | None = None


@dataclass(frozen=True)
class RowMapping:
    """How a table with a row for each turn becomes turns: the columns of these meanings."""

    name: str
    key: str
    order: str
    role: str
    text: str

    @property
    def paths(self) -> tuple[str, ...]:
        return (self.key, self.order, self.role, self.text)


def _text(path: str) -> str:
    return f"coalesce(try_variant_get(v, '$.{path}', 'string'), '')"


def _listed(path: str, role: str, text: str) -> str:
    roles = "CASE lower(m.{r}) WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' ELSE m.{r} END".format(r=role)
    return (
        f"transform(try_variant_get(v, '$.{path}', 'array<struct<{role}: string, {text}: string>>'), "
        f"m -> struct(coalesce({roles}, '') AS role, coalesce(m.{text}, '') AS text))"
    )


def _pair(question: str, answer: str) -> str:
    system = f"filter(array(struct('system' AS role, {_text('system')} AS text)), m -> try_variant_get(v, '$.system', 'string') IS NOT NULL)"
    return f"concat({system}, array(struct('user' AS role, {question} AS text), struct('assistant' AS role, {_text(answer)} AS text)))"


_ASKED = f"concat({_text('instruction')}, if({_text('input')} = '', '', concat('\\n\\n', {_text('input')})))"

#: Fixed layouts of public chat and instruction data.
MAPPINGS = (
    Mapping("messages", ("messages[].role", "messages[].content"), _listed("messages", "role", "content"), "messages"),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), _listed("conversations", "from", "value"), "conversations"),
    Mapping("dialog", ("dialog[].speaker", "dialog[].text"), _listed("dialog", "speaker", "text"), "dialog"),
    Mapping("prompt_response", ("prompt", "response"), _pair(_text("prompt"), "response")),
    Mapping("prompt_completion", ("prompt", "completion"), _pair(_text("prompt"), "completion")),
    Mapping("question_answer", ("question", "answer"), _pair(_text("question"), "answer")),
    Mapping("instruction", ("instruction", "output"), _pair(_ASKED, "output")),
)
ROW_MAPPINGS = (
    RowMapping("turns", "conv_id", "turn", "role", "text"),
    RowMapping("messages", "conversation_id", "position", "role", "content"),
    RowMapping("utterances", "dialog_id", "position", "speaker", "utterance"),
)


def fingerprint_paths(paths: Iterable[str]) -> str:
    """The fingerprint of a layout with these paths."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a typed table."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, at + "[]")
    return [at]


def select_row_mapping(schema: T.StructType) -> RowMapping | None:
    """The mapping with the most paths of those that a table's layout has all paths of."""
    have = {path_hash(p) for p in schema_paths(schema)}
    fits = [m for m in ROW_MAPPINGS if have.issuperset(path_hash(p) for p in m.paths)]
    return max(fits, key=lambda m: (len(m.paths), m.name), default=None)


_OBJECT = "map<string, variant>"
_KEYS = "coalesce(map_keys(try_variant_get({0}, '$', '" + _OBJECT + "')), cast(array() AS array<string>))"


def record_paths(v: str) -> str:
    """SQL: the sorted nested paths of a variant; objects are followed through one object or list of objects, and end in a leaf there.

    An empty list has the path name[], one of plain values name[]. and a list of objects one for each field that any of them has.
    """
    value = f"try_variant_get({v}, '$', '{_OBJECT}')[k]"
    listed = f"try_variant_get({value}, '$', 'array<variant>')"
    inner = f"flatten(transform({listed}, e -> {_KEYS.format('e')}))"
    own = _KEYS.format(value)
    return (
        f"array_sort(array_distinct(flatten(transform({_KEYS.format(v)}, k -> CASE "
        f"WHEN {listed} IS NOT NULL AND size({inner}) > 0 THEN transform({inner}, x -> concat(k, '[].', x)) "
        f"WHEN size({listed}) > 0 THEN array(concat(k, '[].')) WHEN {listed} IS NOT NULL THEN array(concat(k, '[]')) "
        f"WHEN size({own}) > 0 THEN transform({own}, x -> concat(k, '.', x)) ELSE array(k) END))))"
    )


def turns_of_records(records: DataFrame, key: str, record: str = "record") -> DataFrame:
    """(conv_id, fingerprint, layout, turns) of JSON records; turns is null for an unknown layout."""
    read = records.select(F.col(f"`{key}`").cast("bigint").alias("conv_id"), F.try_parse_json(F.col(f"`{record}`")).alias("v"))
    read = read.withColumn("paths", F.expr(record_paths("v"))).withColumn("hashes", F.expr("transform(paths, p -> md5(p))"))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for m in sorted(MAPPINGS, key=lambda m: (len(m.paths), m.name)):  # later ones win: those with more paths
        mine = _has(m.paths)
        if m.listed:
            mine = mine | _has((f"{m.listed}[]",))
        layout, turns = F.when(mine, m.name).otherwise(layout), F.when(mine, F.expr(m.turns).cast(TURNS)).otherwise(turns)
    fingerprint = F.when(F.col("v").isNotNull(), F.sha2(F.array_join("paths", "\n"), 256))
    return read.select("conv_id", fingerprint.alias("fingerprint"), layout.alias("layout"), turns.alias("turns"))


def _has(paths: Sequence[str]) -> Column:
    return F.size(F.array_except(F.array(*(F.lit(path_hash(p)) for p in paths)), "hashes")) == 0


def unmapped(records: DataFrame, key: str, record: str = "record") -> DataFrame:
    """(fingerprint, records) of the layouts that no mapping knows."""
    return turns_of_records(records, key, record).filter("turns is null").groupBy("fingerprint").agg(F.count("*").alias("records"))


def turns_of_rows(table: DataFrame) -> DataFrame:
    """(conv_id, fingerprint, layout, turns) of a typed table with a row for each turn."""
    mapping = select_row_mapping(table.schema)
    if mapping is None:
        raise ValueError(f"no mapping for the layout {sorted(schema_paths(table.schema))}")
    said = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(name) for c, name in ((mapping.role, "role"), (mapping.text, "text"))]
    rows = table.select(F.col(f"`{mapping.key}`").cast("bigint").alias("conv_id"), F.struct(F.col(f"`{mapping.order}`").alias("turn"), *said).alias("m"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("m")).select(
        "conv_id", F.lit(fingerprint_paths(schema_paths(table.schema))).alias("fingerprint"), F.lit(mapping.name).alias("layout"),
        F.expr("transform(m, x -> struct(x.role AS role, x.text AS text))").alias("turns"),
    )


def _escape(x: str) -> str:
    return f"replace(replace(replace({x}, '~', '~0'), '<', '~1'), '[', '~2')"


def _unescape(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '~3', '|'), '~2', '['), '~1', '<'), '~0', '~')"


#: Lengths are added up by blocks of so many turns, so that a long conversation does not cost its square.
_BLOCK = 256


def format_chats(turns: DataFrame) -> DataFrame:
    """Adds formatted and loss_mask, the spans (start from 0, chars) of the assistant texts."""
    parts = turns.withColumn("_parts", F.expr(
        f"transform(turns, t -> struct(t.role = 'assistant' AS trained, concat('<|', replace({_escape('t.role')}, '|', '~3'), '|>') AS mark, {_escape('t.text')} AS body))"
    ))
    sizes = parts.withColumn("_n", F.expr(f"transform(_parts, p -> length(p.mark) + length(p.body) + {len(END)})"))
    blocks = sizes.withColumn("_b", F.expr(
        f"transform(sequence(0, size(_n) DIV {_BLOCK}), b -> aggregate(slice(_n, 1, cast({_BLOCK} * b AS int)), 0, (a, x) -> a + x))"
    ))
    start = f"_b[cast(i DIV {_BLOCK} AS int)] + aggregate(slice(_n, cast(i DIV {_BLOCK} AS int) * {_BLOCK} + 1, i % {_BLOCK}), 0, (a, x) -> a + x)"
    spans = F.expr(
        f"transform(filter(transform(_parts, (p, i) -> struct(p.trained AS trained, {start} + length(p.mark) AS start, length(p.body) AS chars)), "
        "s -> s.trained), s -> struct(s.start AS start, s.chars AS chars))"
    )
    text = F.expr(f"array_join(transform(_parts, p -> concat(p.mark, p.body, '{END}')), '')")
    return blocks.withColumns({"formatted": text, "loss_mask": spans}).drop("_parts", "_n", "_b")


def read_chats(formatted: DataFrame) -> DataFrame:
    """Reads turns and the text under the loss mask back from formatted and loss_mask alone: adds turns_read and loss_text."""
    split = formatted.withColumn("_segments", F.expr(f"split(formatted, '{END.replace('|', '[|]')}', -1)"))
    turns = (
        f"transform(slice(_segments, 1, size(_segments) - 1), s -> struct({_unescape("substring(s, 3, locate('|>', s) - 3)")} AS role, "
        f"{_unescape("substring(s, locate('|>', s) + 2)")} AS text))"
    )
    loss = f"array_join(transform(loss_mask, m -> {_unescape('substring(formatted, m.start + 1, m.chars)')}), '')"
    return split.withColumns({"turns_read": F.expr(turns), "loss_text": F.expr(loss)}).drop("_segments")


def chat_digests(formatted: DataFrame) -> DataFrame:
    """The digests of read_chats(formatted)."""
    read = read_chats(formatted)
    said = F.expr("array_join(transform(turns_read, t -> concat(t.role, '\\n', t.text, '\\n')), '')")
    return read.select(
        "conv_id", F.size("turns_read").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
