"""URL filter: domain and path rules, and a logistic regression on hashed character n-grams.

Rules name a host and a path prefix. A rule fits its host and all its subdomains when the
url's path starts with the rule's, and the longest rule wins. Urls without a rule are judged by
a logistic regression on hashed n-grams of host and path, trained on the driver from a small
labelled table (LABELLED, or the caller's table of label and url, at most MOST_LABELLED rows; more
raise an error); its weights, of fixed size, are broadcast and urls are scored in Arrow batches.
accuracy() tells how the weights do on rows that they were not trained on.

Defined results: a null url, and one without "://", has an empty host and path, fits no rule and
is allowed; very long urls are scored whole; repeated rows are judged each; an empty table gives
an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shingles import mix

#: (verdict, rule): a rule is host/path.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
MOST_RULES = 1000
MOST_LABELLED = 100_000
LOG2_FEATURES = 16
SIZES = (3, 4, 5)
_LOWER = {65 + k: 97 + k for k in range(26)}

#: A small labelled table: 1 is blocked.
LABELLED = tuple(
    (label, url)
    for label, urls in (
        (1, """casino-bonus.test/win/free-spins spam-farm.test/buy/now cheap-pills.test/viagra/order adult-cams.test/live/xxx
            hot-singles.test/dating/tonight free-porn.test/videos/xxx spam.test/offers/click?id=1 best-casino.test/slots/jackpot
            win-prize.test/claim/free-money payday-loans.test/apply/fast replica-watches.test/cheap/rolex click-farm.test/ads/banner
            adserver.test/track/pixel tracker.test/click/redirect warez.test/crack/keygen torrent-hub.test/download/free
            phishing-login.test/verify/account malware.test/download/exe free-spam.test/offer/seo seo-farm.test/backlinks/buy
            link-farm.test/directory/seo spam-blog.test/cheap/pills poker-online.test/bet/win betting-tips.test/odds/bet
            xxx-tube.test/porn/clip escort-ads.test/city/adult lottery-winner.test/claim/prize crypto-giveaway.test/double/btc
            content-farm.test/seo/page spamfarm.test/en/1 spam-farm.test/de/2 spam-farm.test/fr/3 farm-spam.test/es/4""".split()),
        (0, """docs.test/guide/install wiki.test/page/history news.test/world/2021 blog.test/en/12 www.test/de/34.html m.test/fr/56
            university.test/research/papers library.test/catalog/item museum.test/visit/opening-hours weather.test/forecast/today
            blog.test/es/78/ www.test/en/90 journal.test/articles/10 science.test/news/space recipes.test/soup/tomato
            travel.test/city/paris school.test/courses/math health.test/topics/sleep sports.test/football/results forum.test/thread/42
            code.test/repo/readme api.test/reference/types music.test/album/review film.test/reviews/drama garden.test/tips/roses
            books.test/review/novel maps.test/route/train bank.test/branches/hours city.test/council/minutes m.test/en/7
            blog.test/post/hello-world www.test/about/contact static.test/fr/11.html""".split()),
    )
    for url in urls
)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host with A-Z lower-cased."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("`_url`"))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or null; rules are compiled into one expression."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # later ones win
        own, _, start = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, name).otherwise(verdict)
    return rule, verdict


_POWER = np.uint64(0x5851F42D4C957F2D)


def _features(texts: Iterable[bytes], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all n-grams of the texts, and how many each text has."""
    joined, ends = b"".join(b"^" + t + b"$" for t in texts), []
    at = 0
    for t in texts:
        at += len(t) + 2
        ends.append(at)
    data = np.frombuffer(joined, dtype=np.uint8).astype(np.uint64)
    end = np.repeat(np.array(ends), np.diff([0, *ends])) if ends else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(ends)), np.diff([0, *ends]))
    values, owners = [], []
    for n in SIZES:
        if len(data) < n:
            continue
        h = np.zeros(len(data) - n + 1, dtype=np.uint64) + np.uint64(seed * 16 + n)
        for j in range(n):
            h = h * _POWER + data[j : len(data) - n + 1 + j]
        fits = np.arange(len(h)) + n <= end[: len(h)]
        values.append((mix(h[fits]) >> np.uint64(64 - LOG2_FEATURES)).astype(np.int64))
        owners.append(owner[: len(h)][fits])
    if not values:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(values), np.concatenate(owners)


def _logits(weights: np.ndarray, hosts: list[bytes], paths: list[bytes]) -> np.ndarray:
    total, norm = np.zeros(len(hosts)), np.zeros(len(hosts))
    for seed, texts in ((1, hosts), (2, paths)):
        values, owners = _features(texts, seed)
        total += np.bincount(owners, weights[values], len(hosts))
        norm += np.bincount(owners, minlength=len(hosts))
    return total / np.sqrt(np.maximum(norm, 1)) + weights[-1]


def train(labelled: Sequence[tuple[int, str]] = LABELLED, rounds: int = 300, step: float = 1.0, ridge: float = 1e-3) -> np.ndarray:
    """Weights of the n-grams, the bias last, by gradient descent over a small table of (label, host/path)."""
    if len(labelled) > MOST_LABELLED:
        raise ValueError(f"more than {MOST_LABELLED} labelled urls")
    hosts, paths = _parts(u for _, u in labelled)
    label = np.array([y for y, _ in labelled], dtype=float)
    parts = [_features(texts, seed) for seed, texts in ((1, hosts), (2, paths))]
    values, owners = (np.concatenate(x) for x in zip(*parts, strict=True))
    scale = 1 / np.sqrt(np.maximum(np.bincount(owners, minlength=len(label)), 1))
    weights = np.zeros((1 << LOG2_FEATURES) + 1)
    for _ in range(rounds):
        z = np.bincount(owners, weights[values], len(label)) * scale + weights[-1]
        error = (label - 1 / (1 + np.exp(-z))) / len(label)
        weights[:-1] += step * (np.bincount(values, (error * scale)[owners], len(weights) - 1) - ridge * weights[:-1])
        weights[-1] += step * error.sum()
    return weights


def _parts(urls: Iterable[str]) -> tuple[list[bytes], list[bytes]]:
    """Hosts and paths of the urls of a labelled table, which may leave the scheme out."""
    bare = [u.partition("://")[2] if "://" in u else u for u in urls]
    cut = [re.match(r"([^/?#]*)([^?#]*)", u) for u in bare]
    return [m[1].translate(_LOWER).encode() for m in cut], [(m[2] or "/").encode() for m in cut]


def labelled_rows(table: DataFrame) -> list[tuple[int, str]]:
    """(label, url) of a labelled table, in a fixed order; null urls and labels other than 0 and 1 are left out."""
    rows = table.select(F.col("label").cast("int"), "url").filter("url is not null AND label in (0, 1)").limit(MOST_LABELLED + 1).collect()
    return sorted((r["label"], r["url"]) for r in rows)


def accuracy(weights: np.ndarray, labelled: Sequence[tuple[int, str]]) -> float:
    """The share of these urls that the weights judge as labelled."""
    hosts, paths = _parts(u for _, u in labelled)
    return float(np.mean((_logits(weights, hosts, paths) >= 0) == np.array([y == 1 for y, _ in labelled])))


def _judge(shared) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            hosts = [h.encode() for h in batch.column("host").to_pylist()]
            paths = [p.encode() for p in batch.column("path").to_pylist()]
            score = np.zeros(len(hosts))
            for a in range(0, len(hosts), 2000):
                score[a : a + 2000] = 1 / (1 + np.exp(-np.clip(_logits(weights, hosts[a : a + 2000], paths[a : a + 2000]), -500, 500)))
            score[[not h and not p for h, p in zip(hosts, paths, strict=True)]] = 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, "score"])

    return run


def judged_urls(pages: DataFrame, labelled: Sequence[tuple[int, str]] | DataFrame = LABELLED, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every page."""
    host, path = split_url(F.col("_url"))
    parts = pages.select(F.col("page_id").cast("bigint"), F.col("url").alias("_url")).select("page_id", host.alias("host"), path.alias("path"))
    weights = pages.sparkSession.sparkContext.broadcast(train(labelled_rows(labelled) if isinstance(labelled, DataFrame) else labelled))
    scored = parts.mapInArrow(_judge(weights), "page_id bigint, host string, path string, score double")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), "score")
