"""URL filter: rules by host and path, else logistic regression on character n-grams.

The model is fitted on a small labelled table; its size is limited by a parameter. Its
weights, one number per hash bucket, go to the tasks that judge the URLs where they are
read; nothing is exchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# (verdict, host, path): fits the host and its subdomains where the path starts so.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

# Words of the labelled table. URLs are built from them by rule, see ``labelled_urls``.
UNWANTED = "casino poker bets slots jackpot pills pharmacy cheap free win loans spam farm ads track click adult".split()
WANTED = "news docs wiki library school museum weather recipes city sports science garden history music travel then other".split()


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path of a URL; both empty without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(text, pattern, 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), F.regexp_extract(text, pattern, 2)


def _by_length(rules):
    return sorted(rules, key=lambda r: -len(r[1] + r[2]))


def fitting_rule(host: Column, path: Column, rules, value) -> Column:
    """``value(rule)`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in reversed(_by_length(rules)):
        fits = ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def labelled_urls(spark: SparkSession) -> DataFrame:
    """A small labelled table (url, unwanted): hosts of one or two words of either kind."""
    rows = []
    for unwanted, terms in ((1, UNWANTED), (0, WANTED)):
        for i, a in enumerate(terms):
            b = terms[(i + 5) % len(terms)]
            for host in (f"{a}-{b}", f"{b}{a}", a):
                for j, (sub, end) in enumerate((("www.", "com"), ("m.", "net"), ("", "org"))):
                    lang = ("en", "de", "fr", "es")[(i + j) % 4]
                    rows.append((f"https://{sub}{host}.example.{end}/{lang}/{37 * i + j}", unwanted))
    return spark.createDataFrame(rows, "url string, unwanted int")


def _hashed(text: str, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """Distinct buckets of the character n-grams of a text, marked at both ends."""
    codes = np.frombuffer(f"\x02{text}\x03".encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint64)
    found = []
    for n in sizes:
        if len(codes) >= n:
            h = np.full(len(codes) - n + 1, n, dtype=np.uint64)
            for j in range(n):
                h = h * np.uint64(0x100000001B3) + codes[j : len(codes) - n + 1 + j]
            h ^= h >> np.uint64(29)
            found.append((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits))
    return np.unique(np.concatenate(found)).astype(np.int64) if found else np.zeros(0, np.int64)


@dataclass(frozen=True)
class UrlModel:
    """Logistic regression: a weight per n-gram bucket, and a constant."""

    weights: np.ndarray
    constant: float
    sizes: tuple[int, ...]
    bits: int

    def score(self, hosts, paths) -> list[float]:
        """Probability that a URL is unwanted."""
        out = []
        for host, path in zip(hosts, paths):
            grams = _hashed(f"{host}\x01{path}", self.sizes, self.bits)
            z = self.constant + (self.weights[grams].sum() / np.sqrt(len(grams)) if len(grams) else 0.0)
            out.append(float(1 / (1 + np.exp(-z))))
        return out


def fit(
    labelled: DataFrame,
    max_labelled: int = 20_000,
    sizes: tuple[int, ...] = (3, 4, 5),
    bits: int = 16,
    rounds: int = 300,
    rate: float = 4.0,
    decay: float = 1e-4,
) -> UrlModel:
    """Fit on (url, unwanted); of more than ``max_labelled`` rows those of the least hash.

    Rows without URL or label are left out. The gradient runs over all rows at once in
    a fixed order, so the same table gives the same model.
    """
    host, path = host_and_path(F.col("url"))
    known = labelled.where("url is not null and unwanted is not null")
    order = F.xxhash64("url", "unwanted")
    rows = known.orderBy(order, "url", "unwanted").limit(max_labelled)
    rows = rows.select(host.alias("host"), path.alias("path"), "unwanted").collect()
    weights, constant = np.zeros(1 << bits), 0.0
    grams = [_hashed(f"{r.host}\x01{r.path}", sizes, bits) for r in rows]
    if not rows:
        return UrlModel(weights, constant, sizes, bits)
    y = np.array([float(r.unwanted) for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(g) for g in grams])
    column = np.concatenate(grams)
    value = 1 / np.sqrt(np.bincount(row, minlength=len(rows)))[row]
    for _ in range(rounds):
        z = np.bincount(row, weights[column] * value, len(rows)) + constant
        error = y - 1 / (1 + np.exp(-z))
        step = np.bincount(column, error[row] * value, 1 << bits) / len(rows)
        weights += rate * (step - decay * weights)
        constant += rate * error.mean() / 4
    return UrlModel(weights, float(constant), sizes, bits)


def judged(
    pages: DataFrame, model: UrlModel, rules=RULES, threshold: float = 0.7, keep: list[str] | None = None
) -> DataFrame:
    """Host, path, rule, verdict and score of every URL.

    A null URL or one without ``://`` has an empty host and path, no rule, and the model's
    verdict on no n-grams but the marks. Scores are rounded to six places.
    """
    keep = keep or ["page_id"]
    host, path = host_and_path(F.col("url"))
    split = pages.select(*keep, host.alias("host"), path.alias("path"))

    @F.pandas_udf("double")
    def unwanted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in batches:
            yield pd.Series(model.score(hosts, paths), dtype="float64")

    ruled = fitting_rule(F.col("host"), F.col("path"), rules, lambda r: r[0])
    scored = split.withColumn("score", F.round(unwanted("host", "path"), 6))
    learned = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select(
        *keep, "host", "path",
        fitting_rule(F.col("host"), F.col("path"), rules, lambda r: r[1] + r[2]).alias("rule"),
        F.coalesce(ruled, learned).alias("verdict"),
        "score",
    )
