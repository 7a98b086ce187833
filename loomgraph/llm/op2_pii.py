"""Personal data by weak supervision, in built-in functions only.

Base spans have fixed patterns: email, ip, card (14 to 19 digits that pass Luhn) and phone (10
to 15 digits). On top, candidates for two more kinds are collected: secret (long runs of key
characters) and number (long runs of digits that no base span covers). Labelers vote on each
candidate with -1, 0 or 1: its shape by regex, a gazetteer of known beginnings, the words
before it, and its mixture of characters. The votes are counted per pattern over all
documents; expectation-maximisation over the pattern counts (a few hundred at most, whatever
the input) estimates how reliable each labeler is, and a logistic span classifier is trained on
the posteriors. Compiled into a column expression, it decides which candidates become spans.
Base spans always stay.

Positions are code points from 0, end exclusive. Patterns are written so that they match what
the plain ones match, but never backtrack over long runs.

Defined results: null and empty texts have no spans; texts of any length are searched whole;
repeated rows are searched each; an empty table gives an empty table; extra columns are kept
by redacted() and ignored otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
#: kind: (pattern, a cheap test that a text can have a match)
PATTERNS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(text, '@')"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"text rlike '[0-9]\\.[0-9]'"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"text rlike '[0-9](?:[\\x20-]?[0-9]){13}'"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "contains(text, '+')"),
    "secret": (r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+", r"text rlike '[A-Za-z0-9_-]{20}'"),
    # with the letter behind it, so that a run that fails for its letter is passed over whole
    "number": (r"(?<![0-9A-Za-z])(?:\([0-9]{3}\) ?)?[0-9](?:[\x20.-]?[0-9]){6,}+[A-Za-z]?", r"text rlike '[0-9](?:[\\x20.-]?[0-9]){6}'"),
}
LEARNED_KINDS = ("secret", "number")
CONTEXT = 24
LABELERS = ("shape", "gazetteer", "context", "mixture")

_BYTE = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _keeps(kind: str) -> str:
    """SQL over s.body: does a match of this base kind count?"""
    if kind == "ip":
        return "s.body rlike " + _quoted(rf"^0*+{_BYTE}(?:\.0*+{_BYTE}){{3}}$".replace("0*+(?:", "0*(?:"))
    digits = "regexp_replace(s.body, '[^0-9]', '')"
    if kind == "phone":
        return f"length({digits}) BETWEEN 10 AND 15"
    if kind == "card":
        digit = f"cast(substring({digits}, length({digits}) - i, 1) AS int)"
        luhn = (
            f"aggregate(sequence(0, length({digits}) - 1), 0, (a, i) -> a + if(i % 2 = 0, {digit}, {digit} * 2 - if({digit} > 4, 9, 0))) % 10 = 0"
        )
        return f"if(length({digits}) BETWEEN 14 AND 19, {luhn}, false)"
    return "s.body rlike '[0-9]$'" if kind == "number" else "true"


_BLOCK = 256


def _matches(docs: DataFrame, kind: str) -> DataFrame:
    """Adds _<kind>: its matches as structs of start, stop and body, leftmost and not overlapping.

    A text is split at its matches; the lengths of what lies between and of the matches add up to
    the starts, by blocks, so that many matches in one text do not cost their square.
    """
    pattern, may = PATTERNS[kind]
    found = docs.withColumns({
        "_m": F.expr(f"if({may}, regexp_extract_all(text, {_quoted(pattern)}, 0), array())"),
        "_p": F.expr(f"if({may}, split(text, {_quoted(pattern)}, -1), array())"),
    })
    steps = found.withColumn("_n", F.expr("transform(_m, (m, i) -> length(_p[i]) + if(i = 0, 0, length(_m[i - 1])))"))
    blocks = steps.withColumn("_b", F.expr(
        f"if(size(_n) = 0, cast(array() AS array<int>), transform(sequence(0, (size(_n) - 1) DIV {_BLOCK}), "
        f"b -> aggregate(slice(_n, 1, cast({_BLOCK} * b AS int)), 0, (a, x) -> a + x)))"
    ))
    starts = blocks.withColumn("_s", F.expr(
        f"transform(_n, (x, i) -> _b[cast(i DIV {_BLOCK} AS int)] + aggregate(slice(_n, cast(i DIV {_BLOCK} AS int) * {_BLOCK} + 1, i % {_BLOCK} + 1), 0, (a, y) -> a + y))"
    ))
    return starts.withColumn(f"_{kind}", F.expr(
        f"filter(transform(_m, (m, i) -> struct(_s[i] AS start, _s[i] + length(m) AS stop, m AS body)), s -> {_keeps(kind)})"
    )).drop("_m", "_p", "_n", "_b", "_s")


#: Fixed vocabulary of the labelers.
KEY_WORDS = ("token", "secret", "password", "passwd", "api_key", "apikey", "key", "bearer", "credential", "auth")
NUMBER_WORDS = ("phone", "tel", "call", "mobile", "fax", "card", "account", "iban", "ssn", "passport", "id number", "contact")
OTHER_WORDS = ("isbn", "version", "page", "order", "sha256", "commit", "checksum", "line", "year", "build")
KEY_BEGINNINGS = ("sk-", "sk_", "pk_", "ghp_", "gho_", "AKIA", "ASIA", "AIza", "xox", "eyJ", "glpat-")
NUMBER_BEGINNINGS = ("(", "00", "555")


def _any(words: Sequence[str]) -> str:
    return "(?i)(?:^|[^a-z])(?:" + "|".join(words) + r")[^a-z]{0,6}$"


def _votes(kind: str) -> dict[str, str]:
    """SQL over c (start, stop, body, before): the votes of the labelers."""
    digits = "length(regexp_replace(c.body, '[^0-9]', ''))"
    if kind == "secret":
        return {
            "shape": f"CASE WHEN c.body rlike '^(?:[0-9a-f]{{32,}}|[0-9A-F]{{32,}})$' THEN 1 WHEN c.body rlike '^[A-Za-z]?[a-z-]+$' THEN -1 ELSE 0 END",
            "gazetteer": "CASE WHEN " + " OR ".join(f"startswith(c.body, '{b}')" for b in KEY_BEGINNINGS) + " THEN 1 ELSE 0 END",
            "context": f"CASE WHEN c.before rlike {_quoted(_any(KEY_WORDS))} THEN 1 WHEN c.before rlike {_quoted(_any(OTHER_WORDS))} THEN -1 ELSE 0 END",
            "mixture": f"CASE WHEN {digits} >= 4 AND c.body rlike '[A-Za-z]' THEN 1 WHEN {digits} = 0 THEN -1 ELSE 0 END",
        }
    return {
        "shape": r"CASE WHEN c.body rlike '^(?:\\([0-9]{3}\\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$' THEN 1 WHEN c.body rlike '^[0-9.]+$' AND contains(c.body, '.') THEN -1 ELSE 0 END",
        "gazetteer": "CASE WHEN " + " OR ".join(f"startswith(c.body, '{b}')" for b in NUMBER_BEGINNINGS) + " THEN 1 ELSE 0 END",
        "context": f"CASE WHEN c.before rlike {_quoted(_any(NUMBER_WORDS))} THEN 1 WHEN c.before rlike {_quoted(_any(OTHER_WORDS))} THEN -1 ELSE 0 END",
        "mixture": f"CASE WHEN {digits} BETWEEN 9 AND 19 THEN 1 WHEN {digits} > 19 THEN -1 ELSE 0 END",
    }


def with_spans(docs: DataFrame) -> DataFrame:
    """Adds _base (start, stop, rank, kind) and _candidates (start, stop, kind, votes, size) to docs with a column text."""
    out = docs
    for kind in PATTERNS:
        out = _matches(out, kind)
    base = ", ".join(
        f"transform(_{kind}, s -> struct(s.start AS start, s.stop AS stop, {rank} AS rank, '{kind}' AS kind))" for rank, kind in enumerate(BASE_KINDS)
    )
    out = out.withColumn("_base", F.expr(f"sort_array(concat({base}))"))
    free = "filter(_{0}, s -> NOT exists(_base, b -> b.start < s.stop AND s.start < b.stop))"
    sets = []
    for kind in LEARNED_KINDS:
        # a secret that is a number is a number
        own = free.format(kind) if kind == "number" else f"filter({free.format(kind)}, s -> s.body rlike '[A-Za-z]')"
        votes = ", ".join(f"{v} AS {name}" for name, v in _votes(kind).items())
        sets.append(
            f"transform(transform({own}, s -> struct(s.start AS start, s.stop AS stop, s.body AS body, "
            f"substring(text, greatest(1, s.start + 1 - {CONTEXT}), least(s.start, {CONTEXT})) AS before)), "
            f"c -> struct(c.start AS start, c.stop AS stop, '{kind}' AS kind, {votes}, least(3, length(c.body) DIV 12) AS size))"
        )
    return out.withColumn("_candidates", F.expr(f"concat({', '.join(sets)})")).drop(*(f"_{k}" for k in PATTERNS))


@dataclass(frozen=True)
class SpanModel:
    """Weights of the span classifier, and the labelers' estimated reliabilities."""

    weights: dict[tuple[str, object], float]
    reliabilities: dict[str, float]

    def accepts(self, c: str = "c") -> str:
        """SQL: does the classifier take the candidate c, for which one labeler at least has voted?"""
        terms = [
            f"CASE {c}.{name} " + " ".join(f"WHEN {v!r} THEN {w!r}D" for (n, v), w in sorted(self.weights.items(), key=str) if n == name) + " ELSE 0D END"
            for name in ("kind", *LABELERS, "size")
            if any(n == name for n, _ in self.weights)
        ]
        voted = " OR ".join(f"{c}.{name} > 0" for name in LABELERS)
        return f"({' + '.join(['0D', *terms])}) >= 0D AND ({voted})"


def train(docs: DataFrame) -> SpanModel:
    """The model of these documents. docs: as with_spans() returns them."""
    # explode() would bring a filter on the size along, and with it all these expressions once more and without their steps
    c = docs.select(F.explode_outer("_candidates").alias("c")).filter("c is not null").select("c.kind", *(f"c.{x}" for x in LABELERS), "c.size")
    rows = [tuple(r) for r in c.groupBy("kind", *LABELERS, "size").count().collect()]
    return fit(rows)


def fit(rows: Sequence[tuple], rounds: int = 100) -> SpanModel:
    """Expectation-maximisation and the classifier, over rows (kind, votes of LABELERS, size, count)."""
    if not rows:
        return SpanModel({("kind", k): -1.0 for k in LEARNED_KINDS}, {})
    k = len(LABELERS)
    rows = sorted(rows)
    # begin with the share of the votes cast, slightly doubtful
    belief = [1 / (1 + math.exp(-sum(r[1 : 1 + k]))) for r in rows]
    kinds = sorted({r[0] for r in rows})
    for _ in range(rounds):
        prior = {
            kind: (1 + sum(b * r[-1] for r, b in zip(rows, belief, strict=True) if r[0] == kind)) / (2 + sum(r[-1] for r in rows if r[0] == kind))
            for kind in kinds
        }
        chance = []  # of each labeler: (kind, label, vote) -> probability
        for j in range(k):
            table = {(kind, y, v): 1.0 for kind in kinds for y in (0, 1) for v in (-1, 0, 1)}
            for kind in kinds:
                table[kind, 1, 1] += 2.0  # labelers are presumed better than chance
                table[kind, 0, -1] += 2.0
            for r, b in zip(rows, belief, strict=True):
                table[r[0], 1, r[1 + j]] += b * r[-1]
                table[r[0], 0, r[1 + j]] += (1 - b) * r[-1]
            total = {(kind, y): sum(table[kind, y, v] for v in (-1, 0, 1)) for kind in kinds for y in (0, 1)}
            chance.append({key: n / total[key[:2]] for key, n in table.items()})
        after = []
        for r in rows:
            odds = math.log(prior[r[0]] / (1 - prior[r[0]]))
            odds += sum(math.log(chance[j][r[0], 1, r[1 + j]] / chance[j][r[0], 0, r[1 + j]]) for j in range(k))
            after.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        moved, belief = max(abs(x - y) for x, y in zip(belief, after, strict=True)), after
        if moved < 1e-9:
            break
    every = sum(r[-1] for r in rows)
    right = {
        name: sum(r[-1] * (b if r[1 + j] > 0 else 1 - b) for r, b in zip(rows, belief, strict=True) if r[1 + j]) / max(1, sum(r[-1] for r in rows if r[1 + j]))
        for j, name in enumerate(LABELERS)
    }
    weights: dict[tuple[str, object], float] = {}
    for _ in range(400):
        step: dict[tuple[str, object], float] = {}
        for r, b in zip(rows, belief, strict=True):
            keys = [("kind", r[0]), *((name, r[1 + j]) for j, name in enumerate(LABELERS)), ("size", r[1 + k])]
            z = sum(weights.get(x, 0.0) for x in keys)
            error = r[-1] / every * (b - 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            for x in keys:
                step[x] = step.get(x, 0.0) + error
        weights = {x: weights.get(x, 0.0) + 2.0 * (g - 1e-4 * weights.get(x, 0.0)) for x, g in step.items()}
    return SpanModel(weights, right)


def _all_spans(model: SpanModel) -> Column:
    """_base and the accepted candidates, by start; candidates that an earlier accepted one overlaps stay out of redaction only."""
    extra = f"transform(filter(_candidates, c -> {model.accepts()}), c -> struct(c.start AS start, c.stop AS stop, if(c.kind = 'secret', 4, 5) AS rank, c.kind AS kind))"
    return F.expr(f"sort_array(concat(_base, {extra}))")


def _joined(spans: str) -> str:
    """kind:start:end, by start and then kind as listed."""
    return f"array_join(transform(sort_array(transform({spans}, s -> struct(s.start AS start, s.rank AS rank, s.stop AS stop, s.kind AS kind))), s -> concat(s.kind, ':', s.start, ':', s.stop)), ',')"


def pii_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_learned, n_spans) of every document."""
    found = with_spans(docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text")))
    model = train(found)
    counts = [F.expr(f"cast(size(filter(_base, s -> s.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in BASE_KINDS]
    out = found.withColumn("_spans", _all_spans(model))
    return out.select(
        "doc_id", *counts, F.sha2(F.expr(_joined("_base")), 256).alias("base_sha256"), F.expr(_joined("_spans")).alias("spans"),
        (F.size("_spans") - F.size("_base")).cast("bigint").alias("n_learned"), F.size("_spans").cast("bigint").alias("n_spans"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind, as in <EMAIL>; n_chars, where it is a column, follows. A null text stays null."""
    columns = docs.columns
    plain = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row"), F.coalesce("text", F.lit("")).alias("text"))
    found = with_spans(plain)
    model = train(found)
    cut = (
        "aggregate(_spans, struct(0 AS at, cast(array() AS array<string>) AS parts), (a, s) -> if(s.stop <= a.at, a, struct(s.stop AS at, "
        "concat(a.parts, array(substring(text, a.at + 1, greatest(0, s.start - a.at)), concat('<', upper(s.kind), '>'))) AS parts)), "
        "a -> concat(array_join(a.parts, ''), substring(text, a.at + 1)))"
    )
    out = found.withColumn("_spans", _all_spans(model)).withColumn("_clean", F.expr(f"if(size(_spans) = 0, _row.text, {cut})"))
    picked = []
    for c in columns:
        if c == "text":
            picked.append(F.col("_clean").alias(c))
        elif c == "n_chars":
            picked.append(F.expr("if(size(_spans) = 0, _row.n_chars, length(_clean))").cast(docs.schema[c].dataType).alias(c))
        else:
            picked.append(F.col(f"_row.`{c}`").alias(c))
    return out.select(*picked)
