"""Small cases of every corpus operator against brute force, with nulls, ties, repeats and empty tables."""

import hashlib
import random
import re

import pytest

pytest.importorskip("loomgraph.llm")
from loomgraph.llm import (  # noqa: E402
    op1_chat, op2_pii, op3_url_filter, op4_quality, op5_token_counts, op6_fingerprints, op7_substring_dedup, op8_decontamination,
    op9_jaccard_join, op10_mixing,
)
from loomgraph.llm.components import connected_components  # noqa: E402

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, _row string"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 6, 9, 40, 120]))) for _ in range(25)]
    texts = []
    for _ in range(120):
        t = rng.choice(base).split()
        if rng.random() < 0.5:
            t[rng.randrange(len(t))] = "changed"
        texts.append(" ".join(t))
    texts += [None, "", " \n\t", "é" * 5, "x " * 20_000, "<|endoftext|> a@b.co 1.2.3.4 +1 (234) 555-1234 pays 4111 1111 1111 1111", texts[0], texts[0]]
    return [(i, t, "en", ["a", "b", None][i % 3], len(t or ""), "clash", None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_components(spark):
    edges = spark.createDataFrame([(3, 2), (2, 1), (9, 8), (8, 8), (7, 9), (7, 9)], "a bigint, b bigint")
    assert dict(connected_components(edges).collect()) == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7}


def test_jaccard(docs, rows, empty):
    sets = {r[0]: shingles(r[1]) for r in rows}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((label[a], label[b]))
                label = {i: x if k == y else k for i, k in label.items()}
    got = {r[0]: (r[1], r[2]) for r in op9_jaccard_join.jaccard_components(docs).collect()}
    assert got == {i: (len(s), label[i]) for i, s in sets.items()}
    assert op9_jaccard_join.jaccard_components(empty).count() == 0


def test_containment(spark, docs, rows, empty):
    items = [(i, r[1]) for i, r in enumerate(rows[::7])] + [(99, "w1"), (98, None), (97, "")]
    got = {(r[0], r[1]): r[3] for r in op8_decontamination.contained_items(docs, spark.createDataFrame(items, "item_id bigint, text string"), 500).collect()}
    want = {}
    for i, text in items:
        s = shingles(text)
        for r in rows:
            w = re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(LOWER))
            n = min(5, min((len(x) for x in s), default=5))
            have = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}
            if s and 100 * len(s & have) >= 75 * len(s):
                want[r[0], i] = len(s & have)
    assert got == want
    assert op8_decontamination.contained_items(empty, spark.createDataFrame([], "item_id bigint, text string")).count() == 0


def test_tokens(docs, rows, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(op5_token_counts.default_vocabulary())
    got = {r[0]: (r[1], r[2], r[3]) for r in op5_token_counts.token_counts(docs).collect()}
    for r in rows:
        n = len(library.encode(r[1] or "", add_special_tokens=False).ids)
        assert got[r[0]] == (len((r[1] or "").encode()), n, n > 512)
    assert op5_token_counts.token_counts(empty).count() == 0


def test_chats(spark):
    said = "</s>[INST] ok [/INST]~1<|end|>|<"
    table = spark.createDataFrame([(1, 1, "assistant", said, "x"), (1, 0, "us|er", None, "x"), (2, None, None, "a", "x"), (1, 1, "assistant", said, "x")], "conv_id bigint, turn bigint, role string, text string, turns string")
    got = {r[0]: r for r in op1_chat.chat_digests(op1_chat.format_chats(op1_chat.turns_of_rows(table))).collect()}
    whole = f"us|er\n\nassistant\n{said}\nassistant\n{said}\n"
    assert got[1]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[2]["loss_chars"]) == (3, 2 * len(said), 0)
    assert got[1]["loss_sha256"] == hashlib.sha256((said * 2).encode()).hexdigest()
    records = [(1, '{"prompt":"p","response":"r","system":"s"}'), (2, '{"dialog":[{"speaker":"human","text":"q"}]}'), (3, '{"y":[1,{"z":2}]}'), (4, "{"), (5, None)]
    read = {r[0]: r["turns"] for r in op1_chat.turns_of_records(spark.createDataFrame(records, "k int, record string"), "k").collect()}
    assert [tuple(t) for t in read[1]] == [("system", "s"), ("user", "p"), ("assistant", "r")]
    assert [tuple(t) for t in read[2]] == [("user", "q")] and read[3] is None and read[4] is None and read[5] is None
    more = [
        (1, '{"messages":[{"role":"user","content":"a","name":"x"},{"role":"gpt","content":null}],"source":"s","meta":{"b":1}}', "messages", [("user", "a"), ("assistant", "")]),
        (2, '{"messages":[]}', "messages", []), (3, '{"messages":[1]}', None, None), (4, '{"messages":"x"}', None, None),
        (5, '{"instruction":"i","output":"o","text":"t"}', "instruction", [("user", "i"), ("assistant", "o")]),
        (6, '{"text":"t","answer":"a","question":"q"}', "question_answer", [("user", "q"), ("assistant", "a")]),
    ]
    got = {r[0]: r for r in op1_chat.turns_of_records(spark.createDataFrame([r[:2] for r in more], "k int, record string"), "k").collect()}
    for k, _, layout, turns in more:
        assert got[k]["layout"] == layout and (None if got[k]["turns"] is None else [tuple(t) for t in got[k]["turns"]]) == turns
    other = spark.createDataFrame([(1, 0, "user", "hi", 5)], "dialog_id long, position long, speaker string, utterance string, extra int")
    assert op1_chat.turns_of_rows(other).first()["layout"] == "utterances"
    with pytest.raises(ValueError):
        op1_chat.turns_of_rows(other.drop("speaker"))
    long = spark.createDataFrame([(1, k, "assistant" if k % 2 else "user", f"t{k}" * (k % 5)) for k in range(1500)], "conv_id long, turn long, role string, text string")
    r = op1_chat.chat_digests(op1_chat.format_chats(op1_chat.turns_of_rows(long))).first()
    assert r["loss_sha256"] == hashlib.sha256("".join(f"t{k}" * (k % 5) for k in range(1, 1500, 2)).encode()).hexdigest()
    assert op1_chat.chat_digests(op1_chat.format_chats(op1_chat.turns_of_rows(table.limit(0)))).count() == 0


def test_pii(docs, rows, empty):
    got = {r[0]: r for r in op2_pii.pii_spans(docs).collect()}
    marked = next(r for r in rows if r[1] and "@" in r[1])
    r = got[marked[0]]
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1)
    assert got[rows[1][0]]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    clean = {r["doc_id"]: r for r in op2_pii.redacted(docs).collect()}
    assert clean[marked[0]]["text"].startswith("<|endoftext|> <EMAIL> <IP> <PHONE> pays <CARD>") and clean[marked[0]]["n_chars"] == len(clean[marked[0]]["text"])
    assert op2_pii.pii_spans(empty).count() == 0 and op2_pii.redacted(docs).columns == docs.columns


def test_urls(spark):
    urls = [None, "x", "http://A.Example.COM/en/7x?q", "http://example.com/en/8", "http://notexample.net/de/8", "https://m.example.net/de/81#t", "http://org/es/"]
    got = {r[0]: r for r in op3_url_filter.judged_urls(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")).collect()}
    assert [got[k]["rule"] for k in range(7)] == [None, None, "example.com/en/7", "com/en/", "net/de/", "example.net/de/8", "org/es/"]
    assert (got[0]["host"], got[0]["path"], got[0]["verdict"]) == ("", "", "allow")
    assert (got[2]["host"], got[2]["path"], got[2]["verdict"]) == ("a.example.com", "/en/7x", "allow")


def test_fingerprints(spark, docs, rows, empty):
    got = {r[0]: r for r in op6_fingerprints.edited_fingerprints(docs).collect()}
    texts = [r[1] or "" for r in rows]
    for k, text in enumerate(texts):
        half = len(text) // 2
        edited = text[: len(text) - half] + texts[(k + 1) % len(texts)][:half]
        assert got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert got[0]["fingerprint"] == got[len(rows) - 1]["fingerprint"] and got[len(rows) - 2]["near_next"] == 1.0
    assert op6_fingerprints.edited_fingerprints(empty).count() == 0
    parts = spark.createDataFrame([(0, "a b c\nd e"), (1, "d e"), (2, "a b c"), (3, "d e\na b c")], "k int, t string")
    f = {r["k"]: r["fingerprint"] for r in op6_fingerprints.fingerprints(parts, ["k"], "t").collect()}
    assert f[0] == f[3]
    row = spark.createDataFrame([(f[2], f[1], f[0])], "x string, y string, z string").select(op6_fingerprints.insert("x", "y"), op6_fingerprints.delete("z", "y")).first()
    assert row[0] == f[0] and row[1] == f[2]


def test_mix(docs, rows, empty):
    got = op10_mixing.mix(docs, keep=["source"]).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, op10_mixing.mix(docs.repartition(3), keep=["source"]).collect()))
    goal = op10_mixing.targets({"a": 100, "b": 10, None: 10})
    assert sum(goal.values()) == pytest.approx(120)  # 75, 30 and 15, and none above three times its size
    assert goal["a"] == pytest.approx(75)
    assert goal["b"] <= 30 and goal[None] <= 30
    assert op10_mixing.mix(empty).count() == 0


def test_quality_without_labels(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r["score"] for r in op4_quality.quality_scores(docs, labels).collect()} == {0.5}
    assert op4_quality.quality_scores(empty, labels).count() == 0


def test_quality_held_out(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [r for r in op4_quality.quality_scores(docs, labels).collect() if r["held_out"] and r["doc_id"] in known]
    assert sum(r["predicted"] == known[r["doc_id"]] for r in rows) >= 0.9 * len(rows)


def test_passages(spark, empty):
    rng = random.Random(3)
    words = [f"v{i}" for i in range(2000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = text(70)
    rows = [(0, f"{text(80)} {passage} {text(60)}"), (1, f"{text(30)}\n{text(40)} {passage}\n{text(50)}"), (2, text(300)), (3, None), (4, ""), (5, f"{passage}"), (5, f"{passage}")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = op7_substring_dedup.repeated_passages(docs).collect()
    assert {r["doc_id"] for r in got} == {1, 5} and {r["kept_doc_id"] for r in got} == {0}
    for r in got:
        cut = next(t for i, t in rows if i == r["doc_id"])[r["start"] : r["stop"]]
        assert cut in passage
    assert op7_substring_dedup.repeated_passages(empty).count() == 0


def test_short_and_periodic_passages(spark):
    rng = random.Random(11)
    word = lambda: f"u{rng.randrange(10**6)}"
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in range(45, 61) for _ in range(3)]
    passages += [" ".join(["again"] * 60), " ".join(["one", "more", "time"] * 20), " ".join(["and", "on"] * 30)]
    rows = []
    for k, p in enumerate(passages):
        rows += [(3 * k, f"{text(40)} {p} {text(25)}"), (3 * k + 1, f"{text(9)} {p} {text(70)}"), (3 * k + 2, f"{text(70)}")]
    # a middle document has more of the passage than the first one has
    long = text(90)
    rows += [(500, f"{text(30)} {' '.join(long.split()[20:45])} {text(30)}"), (501, f"{text(8)} {long}"), (502, f"{' '.join(long.split()[5:])} {text(40)}")]
    got = {r["doc_id"]: r for r in op7_substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = {3 * k + 1: (3 * k, p) for k, p in enumerate(passages) if len(p.split()) > 50} | {502: (501, " ".join(long.split()[5:]))}
    assert set(got) == set(want)
    of = dict(rows)
    for i, (first, p) in want.items():
        assert (of[i][got[i]["start"] : got[i]["stop"]], got[i]["words"], got[i]["kept_doc_id"]) == (p, len(p.split()), first)


def test_fingerprints_of_many_repeats(spark):
    line, other = "a b c d e f g h", " ".join(f"o{i}" for i in range(200))
    texts = [f"{'\n'.join([line] * n)}\n{other}" for n in (2500, 5000, 150_000, 300_000)]
    texts += ["\n".join([line] * n) for n in (2500, 150_000)] + ["z\n" * 40_000 + "z"]
    parts = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    f = {r["k"]: r["fingerprint"] for r in op6_fingerprints.fingerprints(parts, ["k"], "t").collect()}
    pairs = spark.createDataFrame([(f[0], f[1], f[4]), (f[2], f[3], f[5])], "x string, y string, z string")
    for k, r in enumerate(pairs.select(op6_fingerprints.likeness("x", "y"), op6_fingerprints.insert("x", "z"), op6_fingerprints.delete("y", "z")).collect()):
        assert r[0] > 0.99 and r[1] == f[2 * k + 1] and r[2] == f[2 * k]
    # one triple, whose count is the text's number of lines
    counts = [int(f[6][64 + 8 * i : 72 + 8 * i], 16) for i in range(64)]
    assert sorted(min(c, 2**32 - c) for c in counts) == [0] * 63 + [40_001]


def plain_spans(text):
    """(start, place of the kind, kind, end) of the base kinds, by the plain patterns."""
    found = []
    for k, (kind, pattern) in enumerate((
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    )):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(d) if i % 2 == 0 else int(d) * 2 - (9 if d > "4" else 0) for i, d in enumerate(reversed(digits))) % 10 == 0
            good = {
                "email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((m.start(), k, kind, m.end()))
    return sorted(found)


def test_base_spans_of_every_document(spark, rows, sf_dir):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + [(10**6 + r[0], r[1]) for r in rows]
    hard = [
        "a@b a@b.c. x@@y.z a.b@c-d.e.f@g.h", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.255 1.2.3", "4111-1111 1111-1111-1 4111 1111 1111 1111", "+1 (234) 555-1234) +12 +1--------- ++1 234 567 8901.",
        "1 " * 3000 + "x", "+" * 500, "a." * 2000 + "@b.c", "é1.1.1.1\U0001f600 9@8.7", "5 5" * 40,
    ]
    texts += [(2 * 10**6 + k, t) for k, t in enumerate(hard)]
    got = {r["doc_id"]: r for r in op2_pii.pii_spans(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for i, text in texts:
        want = plain_spans(text or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in want).encode()).hexdigest(), text
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(w[2] == k for w in want) for k in ("email", "ip", "card", "phone")]


def test_learned_spans(spark, sf_dir):
    """Secrets beside a key word are found, and nothing in texts without digits or keys."""
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    got = {r["doc_id"]: r["spans"] or "" for r in op2_pii.pii_spans(docs).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    secret = {i: [(m.start(1), m.end(1)) for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t)] for i, t in texts.items()}
    planted = [(i, f"secret:{a}:{b}") for i, spans in secret.items() for a, b in spans]
    assert planted and sum(s in got[i].split(",") for i, s in planted) >= 0.9 * len(planted)
    assert not any(got[i] for i, t in texts.items() if not re.search(r"[0-9@]", t))


def test_urls_of_every_page(spark, sf_dir):
    import numpy as np

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = op3_url_filter.judged_urls(pages).collect()
    urls = {r["page_id"]: r["url"] for r in pages.collect()}
    weights = op3_url_filter.train()
    assert len(got) == len(urls)
    for r in got:
        _, mark, rest = (urls[r["page_id"]] or "").partition("://")
        m = re.match(r"([^/?#]*)([^?#]*)", rest if mark else "", re.S)
        host, path = m[1].translate(LOWER), m[2]
        assert (r["host"], r["path"]) == (host, path)
        fits = []
        for verdict, rule in op3_url_filter.RULES:
            own, _, start = rule.partition("/")
            if (host == own or host.endswith("." + own)) and path.startswith("/" + start):
                fits.append((len(rule), rule, verdict))
        assert r["rule"] == (max(fits)[1] if fits else None)
        values, total, norm = [], weights[-1], 0
        for seed, text in ((1, host), (2, path)):  # the logit once more, n-gram by n-gram
            data = f"^{text}$".encode()
            for n in op3_url_filter.SIZES:
                for at in range(len(data) - n + 1):
                    h = (seed * 16 + n) & (2**64 - 1)
                    for b in data[at : at + n]:
                        h = (h * int(op3_url_filter._POWER) + b) & (2**64 - 1)
                    values.append(int(op3_url_filter.mix(np.array([h], np.uint64))[0]) >> (64 - op3_url_filter.LOG2_FEATURES))
        logit = sum(weights[v] for v in values) / max(1, len(values)) ** 0.5 + weights[-1]
        score = 1 / (1 + np.exp(-logit)) if host or path else 0.0
        assert r["score"] == pytest.approx(score, abs=1e-9)
        assert r["verdict"] == (max(fits)[2] if fits else "block" if score >= 0.5 else "allow")


def test_urls_learned_from_a_table(spark):
    rng = random.Random(5)
    bad, good = ["casino", "pills", "xxx", "jackpot", "spam", "win"], ["wiki", "docs", "news", "guide", "school", "museum"]
    rows = [(y, f"https://{rng.choice(w)}-{rng.choice(w)}{rng.randrange(99)}.test/{rng.choice(w)}/{rng.randrange(999)}") for y, w in ((1, bad), (0, good)) for _ in range(300)]
    rng.shuffle(rows)
    table = spark.createDataFrame([*rows[:300], (1, None), (None, "x")], "label int, url string")
    learned = op3_url_filter.labelled_rows(table)
    assert learned == sorted(rows[:300]) and op3_url_filter.accuracy(op3_url_filter.train(learned), rows[300:]) >= 0.9
    pages = spark.createDataFrame([(1, rows[300][1]), (1, rows[300][1]), (2, "http://a.test/" + "x" * 200_000)], "page_id long, url string")
    got = op3_url_filter.judged_urls(pages, table).collect()
    assert len(got) == 3 and {r["verdict"] for r in got if r["page_id"] == 1} == {"block" if rows[300][0] else "allow"}
    assert op3_url_filter.judged_urls(pages.limit(0), table).count() == 0


def test_rules_compiled(spark, docs):
    """The score expression against a plain evaluation of the rules."""
    import math

    rules = (op4_quality.Rule(((0, True, 1.5), (2, False, 0.25)), 0.75), op4_quality.Rule(((9, False, 0.5),), -1.25))
    model = op4_quality.QualityModel(0.3, rules)
    for r in op4_quality.with_statistics(docs, ["doc_id"]).withColumn("score", model.score()).collect():
        z = 0.3 + sum(rule.weight for rule in rules if all((r[op4_quality.STATISTICS[k]] > b) == above for k, above, b in rule.parts))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)))


def test_likeness_against_counts(docs, rows):
    """Near values are close to the exact cosine of the counts of word triples."""
    from collections import Counter

    def triples(text):
        out = Counter()
        for line in text.split("\n"):
            w = line.split(" ")
            out.update((w[k], *(w[k + 1 : k + 3] + [None, None])[:2]) for k in range(len(w)))
        return out

    def cosine(a, b):
        x, y = triples(a), triples(b)
        return sum(n * y[t] for t, n in x.items()) / (sum(n * n for n in x.values()) * sum(n * n for n in y.values())) ** 0.5

    texts = [r[1] or "" for r in rows]
    got = {r[0]: r for r in op6_fingerprints.edited_fingerprints(docs).collect()}
    off = []
    for k, text in enumerate(texts):
        after = texts[(k + 1) % len(texts)]
        half = len(text) // 2
        off += [abs(got[k]["near_next"] - cosine(text, after)), abs(got[k]["near_edited"] - cosine(text, text[: len(text) - half] + after[:half]))]
    assert sum(off) / len(off) < 0.1


def test_alike_paragraphs(spark):
    """Removals of paragraphs that are alike against brute force, and the texts without them."""
    rng = random.Random(4)
    words = [f"q{i}" for i in range(900)]
    base = [[rng.choice(words) for _ in range(rng.randrange(30, 49))] for _ in range(12)]
    lines, texts = [], []
    for i in range(90):
        own = []
        for _ in range(2):
            p = list(rng.choice(base))
            for _ in range(rng.randrange(0, 3)):
                p[rng.randrange(len(p))] = rng.choice(words)
            own.append(" ".join(p))
        lines += [(i, p) for p in own]
        texts.append((i, f"short head {i}\n{own[0]}\nmiddle {i}\n{own[1]}", "cut"))
    sets = [shingles(p) for _, p in lines]
    label = list(range(len(lines)))
    for a in range(len(lines)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and label[a] != label[b]:
                x, y = sorted((label[a], label[b]))
                label = [x if v == y else v for v in label]
    first = {}
    for (i, _), v in zip(lines, label, strict=True):
        first[v] = min(i, first.get(v, i))
    want = {(i, p) for (i, p), v in zip(lines, label, strict=True) if i > first[v]}
    docs = spark.createDataFrame(texts, "doc_id long, text string, _cut string")
    spans = op7_substring_dedup.repeated_passages(docs).collect()
    got = {(r["doc_id"], texts[r["doc_id"]][1][r["start"] : r["stop"]]) for r in spans}
    assert got <= want and len(got) >= 0.9 * len(want)
    cleaned = op7_substring_dedup.without_passages(docs)
    assert cleaned.columns == docs.columns
    left = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    for i, text, _ in texts:
        for _, p in (x for x in got if x[0] == i):
            text = text.replace(p, "", 1)
        assert left[i] == text


def test_mix_near_targets(spark):
    """Multipliers against a bisection of the dual, and the words that each source gives."""
    import math

    rng = random.Random(8)
    rows = [(i, "w " * rng.choice([1, 3, 20, 50, 400]), "a") for i in range(3000)] + [(i, "w " * (1 + i % 7), "b") for i in range(500)]
    rows += [(7, "a b c d e f", "c")] * 1000 + [(i, "x " * 40, None) for i in range(300)] + [(1, None, "d"), (2, "", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", op10_mixing.F.lit("clash"))
    got = op10_mixing.mix(docs, keep=["source"]).collect()
    sums = {}
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        sums.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    assert all(abs(taken - target) <= 0.01 * target for target, taken in sums.values())
    sizes = [len(t.split()) for _, t, s in rows if s == "a"]
    mean, goal = sum(sizes) / len(sizes), sums["a"][0]
    table = spark.createDataFrame([("a", n, sizes.count(n)) for n in set(sizes)], "_part string, size long, n long")
    tilt, scale = op10_mixing.balance(table, {"a": goal}, {"a": sum(sizes)})["a"]
    low, high = -50.0, 50.0
    for _ in range(200):
        at = (low + high) / 2
        low, high = (low, at) if sum(n * min(3.0, math.exp(min(2.0, at * n / mean))) for n in sizes) > goal else (at, high)
    assert scale == pytest.approx(mean) and tilt == pytest.approx(low, abs=1e-6)


def test_one_long_text():
    """Words of a text that is taken in pieces are those of the text as a whole."""
    import numpy as np

    from loomgraph.llm import shingles as module

    rng = random.Random(1)
    text = " ".join(rng.choice(["a", "bb", "é" * 50, "z" * 3000, "\n\t q"]) for _ in range(3000)) + "y" * 700_000 + "  end"
    data = np.frombuffer(text.encode(), np.uint8)
    for a, b in zip(module.words(data, np.array([0, len(data)])), module._words(data, np.array([0, len(data)])), strict=True):
        assert (a == b).all()


@pytest.mark.parametrize("name", sorted(__import__("loomgraph.llm.queries", fromlist=["x"]).ORACLE))
def test_sql_twins(spark, sf_dir, name):
    import duckdb

    from loomgraph.llm import queries

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    theirs = con.execute(queries.ORACLE[name])
    columns = [c[0] for c in theirs.description]
    ours = queries.QUERIES[name](spark, sf_dir)
    assert sorted(ours.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r) for r in ours.select(*columns).collect()))) == sorted(map(str, theirs.fetchall()))


def test_short_runs_and_paragraphs_by_parameter(spark):
    """Runs of 10 words inside other lines and lines of 20 words are found where the parameters ask for them, and not by default."""
    rng = random.Random(12)
    fresh = lambda n: " ".join(f"q{rng.randrange(1 << 40)}" for _ in range(n))
    run, shorter, line = fresh(10), fresh(9), fresh(20)
    rows = [(i, f"{fresh(30)} {run} {fresh(30)}") for i in range(4)] + [(i, f"{fresh(30)} {shorter} {fresh(30)}") for i in range(4, 8)]
    rows += [(i, f"{fresh(6)}\n{line}\n{fresh(6)}") for i in range(8, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert op7_substring_dedup.repeated_passages(docs).count() == 0
    got = {r["doc_id"]: rows[r["doc_id"]][1][r["start"] : r["stop"]] for r in op7_substring_dedup.repeated_passages(docs, run=10, paragraph_words=20).collect()}
    assert got == {i: run for i in range(1, 4)} | {i: line for i in range(9, 12)}
    got = {r["doc_id"]: rows[r["doc_id"]][1][r["start"] : r["stop"]] for r in op7_substring_dedup.repeated_passages(docs, run=1000, paragraph_words=20).collect()}
    assert got == {i: line for i in range(9, 12)}
    with pytest.raises(ValueError):
        op7_substring_dedup.repeated_passages(docs, paragraph_words=4)


def test_tokens_of_other_scripts(spark):
    """Counts equal the library's in any script and around every kind of space."""
    from tokenizers import Tokenizer

    rng = random.Random(8)
    signs = "ab Zé.,'1 \t\n\x1c\x85\xa0\u1680\u180e\u2003\u200b\u2028\u202f\u205f\u3000\ufeffЖлюαβ東京語عرदेे😀\u0301"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 60))) for _ in range(1500)]
    texts += ["Съешь ещё этих мягких французских булок " * 300, "東京語" * 3000, "ж" * 20000, " " * 5000 + "ж"]
    library = Tokenizer.from_file(op5_token_counts.default_vocabulary())
    want = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in op5_token_counts.token_counts(docs).collect()} == want
    chunks = op5_token_counts._plain_rule()[2].split(texts[1500])
    assert max(map(len, chunks)) <= 12
