"""URL filters: longest rule first, then a ratio of two character language models.

URLs that a rule decides are the labelled examples. For accepted and for rejected ones a
variable-order Markov model over bytes is fitted, with Witten-Bell smoothing from the empty
context to the longest one seen. The score of a URL is the difference of the two log
likelihoods per byte, and the threshold is calibrated on labelled URLs that were kept out of
the fit. The models are fitted on about `SAMPLE` labelled URLs of each verdict, chosen by a
hash of the URL, and hold at most `GRAMS` n-grams each, so they are bounded and broadcast.

Defined cases: a null URL, or one without `://`, has an empty host and path, no rule, and is
allowed, as there is nothing to judge. If one of the verdicts has no labelled example, all
URLs without a rule are allowed. Scores at the threshold are allowed. Repeated rows and ids
are judged each for itself. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Longest context, labelled URLs of each verdict for fit and calibration, n-grams kept of each.
ORDER, SAMPLE, GRAMS = 5, 100_000, 300_000
#: One labelled URL in so many calibrates the threshold.
CALIBRATION = 5
CACHE_WINDOWS = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains and paths that start with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rest_of(url: Column) -> Column:
    """What follows the first `://`; null if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(rest_of(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Index of the longest rule that fits, or null."""
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i].text), rules[i].text))
    fits = [
        F.when(((host == rules[i].host) | F.endswith(host, F.lit("." + rules[i].host))) & F.startswith(path, F.lit(rules[i].path)), F.lit(i))
        for i in order
    ]
    return F.coalesce(*fits)


@dataclass
class Markov:
    """Counts of n-grams (context and next byte) and, from them, of contexts and their types."""

    grams: dict[bytes, int]
    total: dict[bytes, int] = field(default_factory=dict)
    types: dict[bytes, int] = field(default_factory=dict)

    def __post_init__(self):
        for gram, c in self.grams.items():
            context = gram[:-1]
            self.total[context] = self.total.get(context, 0) + c
            self.types[context] = self.types.get(context, 0) + 1

    def log_p(self, window: bytes) -> float:
        """Log probability of the window's last byte after the bytes before it."""
        p, last = 1 / 256, len(window) - 1
        for k in range(last + 1):
            context = window[last - k : last]
            n = self.total.get(context)
            if n is None:
                break
            t = self.types[context]
            p = (self.grams.get(window[last - k :], 0) + t * p) / (n + t)
        return math.log(p)


@dataclass
class Ratio:
    accepted: Markov
    rejected: Markov
    threshold: float = 0.0

    def __post_init__(self):
        self.cache: dict[bytes, float] = {}

    def score(self, text: str) -> float:
        data = text.encode("utf-8", "surrogatepass")
        total = 0.0
        for i in range(len(data)):
            window = data[max(0, i - ORDER) : i + 1]
            value = self.cache.get(window)
            if value is None:
                if len(self.cache) >= CACHE_WINDOWS:
                    self.cache.clear()
                value = self.cache[window] = self.accepted.log_p(window) - self.rejected.log_p(window)
            total += value
        return total / max(1, len(data))


def _gram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, Counter] = {}
        for verdict, rest in zip(batch.column("verdict").to_pylist(), batch.column("rest").to_pylist(), strict=True):
            data = rest.encode("utf-8", "surrogatepass")
            counter = counts.setdefault(verdict, Counter())
            for k in range(1, ORDER + 2):
                counter.update(data[i : i + k] for i in range(len(data) - k + 1))
        rows = [(v, g, c) for v, counter in counts.items() for g, c in counter.items()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.binary(), pa.int64()), strict=True)], names=["verdict", "gram", "c"]
        )


def fit(urls: DataFrame, sample: int = SAMPLE, grams: int = GRAMS) -> Ratio | None:
    """From rows with a verdict and `rest`, what follows `://`. Null if a verdict has no rows."""
    rows = urls.where("verdict is not null and rest <> ''").withColumn("draw", F.pmod(F.xxhash64("rest"), F.lit(1_000_000)))
    share = rows.groupBy("verdict").agg((F.lit(1e6 * sample) / F.count(F.lit(1))).alias("below"))
    drawn = rows.join(share, "verdict").where("draw < below").select("verdict", "rest", F.pmod(F.xxhash64("rest", F.lit(1)), F.lit(CALIBRATION)).alias("fold"))
    counts = (
        drawn.where("fold > 0").select("verdict", "rest")
        .mapInArrow(_gram_batches, "verdict string, gram binary, c bigint")
        .groupBy("verdict", "gram").agg(F.sum("c").alias("c"))
    )
    top = Window.partitionBy("verdict").orderBy(F.desc("c"), "gram")
    held: dict[str, dict[bytes, int]] = {"allow": {}, "block": {}}
    for r in counts.withColumn("at", F.row_number().over(top)).where(F.col("at") <= grams).select("verdict", "gram", "c").collect():
        held[r.verdict][bytes(r.gram)] = r.c
    if not held["allow"] or not held["block"]:
        return None
    ratio = Ratio(Markov(held["allow"]), Markov(held["block"]))
    found = scored(drawn.where("fold = 0").select(F.col("verdict").alias("id"), "rest"), ratio).toPandas()
    ratio.threshold = _threshold(found["score"].to_numpy(), (found["id"] == "allow").to_numpy())
    return ratio


def _threshold(scores: np.ndarray, accepted: np.ndarray) -> float:
    """The cut with the best mean of both verdicts' shares of right decisions; 0 without both."""
    if not accepted.any() or accepted.all():
        return 0.0
    order = np.argsort(scores, kind="stable")
    s, a = scores[order], accepted[order]
    right = np.cumsum(~a) / (~a).sum() + 1 - np.cumsum(a) / a.sum()
    right[:-1][s[1:] == s[:-1]] = -1
    best = np.flatnonzero(right == right.max())
    at = int(best[len(best) // 2])
    return float((s[at] + s[at + 1]) / 2) if at + 1 < len(s) else float(s[at])


def scored(rows: DataFrame, ratio: Ratio) -> DataFrame:
    """Columns id and score of rows with columns id and rest."""
    held = rows.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [held.value.score(x) for x in batch.column("rest").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64())], names=["id", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, score double")


def judge(pages: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, score (null where a rule decided)."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    texts, verdicts = (F.array(*(F.lit(x) for x in column)) for column in ([r.text for r in rules], [r.verdict for r in rules]))
    ruled = (
        pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
        .select("page_id", host.alias("host"), path.alias("path"), F.coalesce(rest_of(F.col("url")), F.lit("")).alias("rest"))
        .withColumn("at", rule_of(F.col("host"), F.col("path"), rules))
        .select("page_id", "host", "path", "rest", F.get(texts, F.col("at")).alias("rule"), F.get(verdicts, F.col("at")).alias("verdict"))
    )
    ratio = fit(ruled.select("verdict", "rest"))
    decided = ruled.where("rule is not null").select("page_id", "host", "path", "rule", "verdict", F.lit(None).cast("double").alias("score"))
    rest = ruled.where("rule is null")
    if ratio is None:
        return decided.unionByName(rest.select("page_id", "host", "path", "rule", F.lit("allow").alias("verdict"), F.lit(0.0).alias("score")))
    open_rows = scored(rest.select(F.struct("page_id", "host", "path").alias("id"), "rest"), ratio)
    nothing = (F.col("id.host") == "") & (F.col("id.path") == "")
    passed = nothing | (F.col("score") >= ratio.threshold)
    return decided.unionByName(
        open_rows.select("id.*", F.lit(None).cast("string").alias("rule"), F.when(passed, "allow").otherwise("block").alias("verdict"), "score")
    )
