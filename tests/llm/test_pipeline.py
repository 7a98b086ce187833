"""The pipeline on a small corpus: every stage against what brute force says of its own input."""

import random
import re

import pytest

pytest.importorskip("loomgraph.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from loomgraph.llm import blocks, op2_pii, op4_quality, op9_jaccard_join  # noqa: E402

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def groups(texts):
    """The smallest id that each id reaches by links."""
    sets = {i: shingles(t) for i, t in texts.items()}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: root(i) for i in sets}


def test_stages(spark, sf_dir, corpus, tmp_path):
    docs, columns = corpus, corpus.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        before, kept = {r["doc_id"]: r for r in docs.collect()}, {r["doc_id"]: r for r in after.collect()}
        assert set(kept) <= set(before) and (after.columns == columns or k == len(corpus_pipeline.STAGES) - 1)
        if name == "quality":
            scores = {r["doc_id"]: r["score"] for r in op4_quality.quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
            assert set(kept) == {i for i, s in scores.items() if s >= op4_quality.THRESHOLD} and 0 < len(kept) < len(before)
        elif name == "near_duplicates":
            assert set(kept) == {i for i, g in groups({i: r["text"] for i, r in before.items()}).items() if i == g}
        elif name == "decontamination":
            items = [w for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if (w := words(r["text"]))]
            sets = [({tuple(w[j : j + min(5, len(w))]) for j in range(max(1, len(w) - 4))}, min(5, len(w))) for w in items]
            hit = set()
            for i, r in before.items():
                w = words(r["text"])
                runs = {n: {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} for n in {n for _, n in sets}}
                if any(100 * len(s & runs[n]) >= 75 * len(s) for s, n in sets):
                    hit.add(i)
            assert set(kept) == set(before) - hit
        elif name == "privacy":
            assert set(kept) == set(before)
            mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
            assert not any(mail.search(r["text"] or "") for r in kept.values())
            touched = {r["doc_id"] for r in op2_pii.pii_spans(docs).collect() if r["spans"]}
            assert {i for i in kept if kept[i]["text"] != before[i]["text"]} == touched
        else:
            assert set(kept) == set(before)
            taken, largest = {}, {}
            for r in kept.values():
                assert r["size"] == len(words(r["text"])) and r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
                taken.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
                largest[r["source"]] = max(r["size"], largest.get(r["source"], 0))
            # sources have a few documents here, and whole ones are taken
            assert all(abs(got - want) <= max(0.05 * want, largest[s]) for s, (want, got) in taken.items())
        docs = after


def test_waves(spark, monkeypatch):
    """Many alike texts with every wave forced: the components stay those of brute force."""
    monkeypatch.setattr(blocks, "FEW", 0)
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([4, 8, 15, 30, 60, 150]))] for _ in range(9)]
    texts = {}
    for i in range(250):
        t = list(rng.choice(base[:3] if i % 2 else base))
        for _ in range(rng.randrange(0, 1 + len(t) // 20)):
            t[rng.randrange(len(t))] = rng.choice(vocabulary)
        texts[i] = " ".join(t)
    got = op9_jaccard_join.jaccard_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == groups(texts)


def test_near_duplicates_by_row(spark, sf_dir):
    """Repeated and null ids: one row of each group stays, and a text that links with nothing stays whatever its id is."""
    alike, clean = "a b c d e f g", "p q r s t u v w"
    rows = [(5, alike, "y"), (5, alike, "x"), (5, alike, "x"), (7, alike, "x"), (None, alike, "x"), (7, clean, "x"), (None, clean + " z", "x"), (8, "", "x"), (8, "", "x"), (9, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted(map(tuple, corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()), key=str)
    assert got == sorted([(5, alike, "x"), (7, clean, "x"), (8, "", "x"), (8, "", "x"), (9, None, "x")], key=str)


def test_near_duplicates_broadcast_by_hint_only(spark, sf_dir, monkeypatch):
    """Small joins on the way to the groups are shuffled; only the bitmaps of joins by id pass through the driver."""
    from loomgraph.llm import scratch

    save, seen = scratch.save, set()

    def watched(df, tag):
        if "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString():
            seen.add(tag)
        return save(df, tag)

    monkeypatch.setattr(scratch, "save", watched)
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(k, f"{text} {k}", "en", "a", 9) for k in range(6)] + [(9, "alone in here", "en", "a", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()) == [0, 9]
    assert seen <= {"sets", "named"}


def test_clashing_columns(spark, sf_dir):
    """Stages keep columns whose names are also those of working columns, nulls and repeated rows."""
    rows = [(1, None, "en", None, 0), (2, "a b c d e f g", None, "s", None), (2, "a b c d e f g", None, "s", None), (None, "a b c d e f g", "en", "s", 3), (4, "", "en", "s", 0)]
    docs = spark.createDataFrame(
        [(*r, 7, "x", 1.0, 5, 6, "b", [1.0], "t", "r") for r in rows],
        "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, class string, u double, _word int, _bit int, _bits string, _stats array<double>, _text string, row string",
    )
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        got = out.collect()
        # of the three rows of one text a single one stays
        assert len(got) == {"near_duplicates": 3}.get(name, 5) or name == "quality"
        assert all((r["_word"], r["_bit"], r["_bits"], r["_stats"], r["_text"], r["row"]) == (5, 6, "b", [1.0], "t", "r") for r in got)
    assert corpus_pipeline.mixture(spark, docs, sf_dir).count() == 5
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_shared_keys_in_any_batches(monkeypatch):
    """The scan of sorted keys gives the same rows however they are cut into batches."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(blocks, "MOST", 5)
    rng = random.Random(6)
    for _ in range(60):
        rows = sorted((rng.randrange(6) if rng.random() < 0.7 else rng.randrange(1000), rng.randrange(9)) for _ in range(rng.randrange(0, 120)))
        hot = {k: rng.choice([0, 0, 0, 3]) for k, _ in rows}
        of = {}
        for k, c in rows:
            of.setdefault(k, set()).add(c)
        want = sorted((k, c, 10 * c, 5 + hot[k] if hot[k] else min(5, len(of[k]))) for k in of for c in of[k] if len(of[k]) > 1 or hot[k])
        cuts = sorted(rng.randrange(len(rows) + 1) for _ in range(rng.randrange(0, 12)))
        batches = []
        for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            part = rows[a:b]
            cols = [[k for k, _ in part], [c for _, c in part], [10 * c for _, c in part]]
            batches.append(pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cols), pa.array([hot[k] for k, _ in part], pa.int32())], ["key", "class", "place", "hot"]))
        got = [tuple(r.values()) for batch in blocks._shared(iter(batches)) for r in batch.to_pylist()]
        assert sorted(got) == want and np.all(np.diff([g[0] for g in got]) >= 0)


def core_texts(n, seed=9):
    """Texts of 110 words, 106 shingles, that share the first 80 of these and link with nothing; every fortieth has a copy with one word changed."""
    rng = random.Random(seed)
    core = [f"c{k}" for k in range(84)]
    texts = {}
    for i in range(n):
        texts[2 * i] = " ".join(core + [f"u{i}x{rng.randrange(1 << 30)}" for _ in range(26)])
        if i % 40 == 0:
            texts[2 * i + 1] = texts[2 * i].rsplit(" ", 1)[0] + " other"
    return texts


def test_crowded_core_grows_with_documents(spark):
    """What meets at the keys of a crowd that does not link, counted before any filter, grows no faster than the crowd."""
    met = []
    for n in (500, 1500, 4500):
        texts = core_texts(n)
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        sets = docs.select("text").mapInArrow(op9_jaccard_join._sets, "class bigint, shingles array<bigint>")
        saved = op9_jaccard_join.scratch.save(sets, "sets")
        entries = blocks._crowd_entries(saved.selectExpr("class", "class AS component"), saved, 75)
        met.append((len(texts), blocks._crowd_meetings(entries).count()))
    assert all(pairs <= 60 * many for many, pairs in met), met
    assert all(y[1] / x[1] <= 1.1 * y[0] / x[0] for x, y in zip(met[:-1], met[1:], strict=True)), met


def test_crowded_core_components(spark, monkeypatch):
    """Links inside crowds that share a core, of many sizes, are those of brute force, with and without waves."""
    rng = random.Random(4)
    texts = core_texts(120)
    core = [f"c{k}" for k in range(84)]
    for i in range(1000, 1180):  # cores with tails of few values and many lengths, around the threshold
        texts[i] = " ".join(core[: rng.choice([60, 70, 84])] + [f"v{rng.randrange(3)}" for _ in range(rng.randrange(0, 40))])
    want = groups(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").cache()
    for waves, few, crowded in ((0, -1, 0), (blocks.WAVES, 0, 0), (blocks.WAVES, blocks.FEW, blocks.CROWDED)):
        for name, value in (("WAVES", waves), ("FEW", few), ("CROWDED", crowded)):
            monkeypatch.setattr(blocks, name, value)
        got = op9_jaccard_join.jaccard_components(docs).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert len(set(want.values())) < len(texts) - 20


def test_crowded_core_is_not_dealt(spark, monkeypatch):
    """What a crowd has in common is counted inside tasks: dealt by shingle is what its sets have besides, and the order is that of exact counts."""
    from collections import Counter

    texts = core_texts(400)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    sets = docs.select("text").mapInArrow(op9_jaccard_join._sets, "class bigint, shingles array<bigint>")
    saved = op9_jaccard_join.scratch.save(sets.selectExpr("class", "class AS component", "shingles"), "sets")
    own = {r["class"]: r["shingles"] for r in saved.collect()}
    often = Counter(x for values in own.values() for x in values)
    want = {c: (len(x), [v for _, v in sorted((often[v], v) for v in x if often[v] > 1)]) for c, x in own.items()}
    for heavy, most in ((blocks.HEAVY, 30), (200, 40), (1, 110)):
        monkeypatch.setattr(blocks, "HEAVY", heavy)
        ordered, dealt, _ = blocks._crowd_shared(saved)
        assert {r["class"]: (r["n"], r["shingles"]) for r in ordered.collect()} == {c: x for c, x in want.items() if x[1]}
        assert dealt.count() <= most * len(own)
    assert blocks._crowd_shared(saved.limit(0))[0].count() == 0
