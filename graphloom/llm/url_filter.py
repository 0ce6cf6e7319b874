"""URL filter: rules first, then a logistic regression on hashed character n-grams.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased.  Path: from
there up to `?`, `#` or the end.  A null url, or one without `://`, has both empty; such
an url gets no rule and is judged by the method like others.  A rule fits its host and all
subdomains where the path starts with the rule's path; the longest fitting rule wins.
Repeated rows are judged alike; an empty table gives no rows; other columns are kept out.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.training import SparseRows, logistic, sigmoid

#: Hashed columns, lengths of n-grams, rows of the labelled table that are used.
BITS, LENGTHS, MOST_LABELLED = 16, (3, 4, 5), 20_000

#: A small hand-made table of labelled urls: label (block or allow) and url.
LABELLED = Path(__file__).with_name("labelled_urls.tsv")


def labelled_urls(path: str | Path = LABELLED) -> list[tuple[str, int]]:
    """The rows (url, 1: block) of a small table of labelled urls."""
    rows = (line.split("\t") for line in Path(path).read_text("utf-8").splitlines() if line)
    return [(url, int(label == "block")) for label, url in rows]


def host(url: Column) -> Column:
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


_DIGITS = str.maketrans("123456789", "000000000")


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float

    def score(self, hosts, paths) -> np.ndarray:
        rows = [columns(h, p) for h, p in zip(hosts, paths)]
        return sigmoid(SparseRows(rows, len(self.weights)).dot(self.weights) + self.bias) if rows else np.zeros(0)


def columns(host: str, path: str) -> np.ndarray:
    """Hashed columns of the n-grams of host and path, each kind apart; all digits count as one."""
    found = set()
    path = path.translate(_DIGITS)
    for kind, text in ((b"h", f"^{host}$"), (b"p", f"^{path}$")):
        for n in LENGTHS:
            for i in range(len(text) - n + 1):
                found.add(zlib.crc32(kind + text[i : i + n].encode("utf-8", "replace")) & ((1 << BITS) - 1))
    return np.fromiter(found, np.int64, len(found))


def train(labelled: DataFrame, most: int = MOST_LABELLED) -> UrlModel:
    """Trains on at most `most` rows (url, label) of a labelled table, label 1: block."""
    rows = labelled.select(host(F.col("url")).alias("h"), path(F.col("url")).alias("p"), F.col("label").cast("int").alias("y"))
    rows = rows.where("y is not null").orderBy(F.xxhash64("h", "p"), "h", "p", "y").limit(most).collect()
    y = np.array([r.y for r in rows], float)
    return UrlModel(*logistic(SparseRows([columns(r.h, r.p) for r in rows], 1 << BITS), y, np.ones(len(y)), l2=0.02, steps=400))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], model: UrlModel, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the method's, 0 to 1, higher: block).

    `rules`: (verdict, host, path)."""
    df = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule = verdict = F.lit(None).cast("string")
    for says, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == rule_host) | F.col("host").endswith("." + rule_host)) & F.col("path").startswith(rule_path)
        rule, verdict = F.when(fits, rule_host + rule_path).otherwise(rule), F.when(fits, says).otherwise(verdict)

    @F.pandas_udf("double")
    def score(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series(model.score(hosts, paths))

    df = df.withColumn("rule", rule).withColumn("said", verdict).withColumn("score", score("host", "path"))
    return df.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
