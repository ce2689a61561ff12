"""URL filter: rules, and a character language-model ratio for the urls that no rule decides.

Two smoothed variable-order Markov models over characters, one of accepted and one of rejected urls, are interpolated
over orders 0 to 3 (Witten-Bell). A url's score is the mean over its characters of the difference of log-probabilities.
The threshold is the middle of the best interval of balanced accuracy over the labelled urls' histogram of scores.
Characters are folded into a small alphabet, so a model is a dense table of at most len(ALPHABET)^4 numbers whatever the
size of the corpus; counts are summed per task before they are shuffled.

Labels: a url is rejected for training if a label of its host is one of `REJECT_TERMS`, else accepted.
A null url, or one without `://`, has an empty host and path; it has no characters, so the method allows it. Without
urls of both kinds the method allows all. Repeated rows are judged as rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import batches

#: (verdict, host, path); text of the rule is host + path. Fixed values of the policy.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Host words that mark a url as rejected, for training.
REJECT_TERMS = ["ad", "ads", "adult", "bet", "bets", "betting", "casino", "jackpot", "lottery", "pill", "pills", "poker", "porn", "sex", "slots", "spam", "viagra", "xxx"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: 0 stands for the start and for all other characters, 27 for digits.
ALPHABET = LOWER + "0./-_:%~+"
SIZE, ORDER = len(ALPHABET) + 1, 3
BINS, RANGE = 4001, 8.0

_CODE = np.zeros(256, np.int64)
for _i, _ch in enumerate(ALPHABET):
    _CODE[ord(_ch)] = _i + 1
_CODE[48:58] = ALPHABET.index("0") + 1


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest matching rule and its verdict, null where none matches."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        hit = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(hit, F.lit(h + p)).otherwise(rule), F.when(hit, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def with_parts(pages: DataFrame) -> DataFrame:
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    labelled = F.arrays_overlap(F.split("host", r"[.\-]"), F.array(*map(F.lit, REJECT_TERMS)))
    return parts.withColumns({"rule": rule, "rule_verdict": verdict, "rejected": labelled})


def grams(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all (ORDER + 1)-grams, each string led by starts, and the index of each gram's string."""
    raw = [s.encode() for s in strings]
    lengths = np.array([len(r) + ORDER for r in raw], np.int64)
    code = _CODE[np.frombuffer(b"".join(b"\0" * ORDER + r for r in raw), np.uint8)]
    gram = np.zeros(max(0, len(code) - ORDER), np.int64)
    for k in range(ORDER + 1):
        gram = gram * SIZE + code[k : len(code) - ORDER + k]
    owner = np.repeat(np.arange(len(raw)), lengths)
    whole = owner[: len(gram)] == owner[ORDER:]
    return gram[whole], owner[: len(gram)][whole]


def gram_counts(pages: DataFrame) -> DataFrame:
    """(rejected, gram, n) over all urls with characters, summed in each task first."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SIZE ** (ORDER + 1)), np.int32)
        for batch in batches(it, 20_000):
            gram, owner = grams(batch.column(0).to_pylist())
            kind = np.array(batch.column(1).to_pylist(), bool)[owner]
            for k in (0, 1):
                total[k] += np.bincount(gram[kind == bool(k)], minlength=total.shape[1]).astype(np.int32)
        kind, gram = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(gram), pa.array(total[kind, gram].astype(np.int64))], names=["rejected", "gram", "n"])

    text = pages.where((F.col("host") != "") | (F.col("path") != "")).select(F.concat("host", "path").alias("text"), "rejected")
    return text.mapInArrow(run, "rejected int, gram long, n long").groupBy("rejected", "gram").agg(F.sum("n").alias("n"))


def smoothed(counts: np.ndarray) -> np.ndarray:
    """Log-probabilities of the last character of each gram, interpolated from order 0 up."""
    full = counts.reshape((SIZE,) * (ORDER + 1)).astype(np.float64)
    lower = np.full(SIZE, 1 / SIZE)
    for order in range(ORDER + 1):
        c = full.sum(axis=tuple(range(ORDER - order))) if order < ORDER else full
        seen = c.sum(-1, keepdims=True)
        kinds = np.maximum((c > 0).sum(-1, keepdims=True), 1)
        lower = (c + kinds * lower) / (seen + kinds)
    return np.log(lower).reshape(-1)


def fit_ratio(counts: DataFrame) -> np.ndarray | None:
    """Accepted less rejected log-probability by gram, in float32; None without both kinds."""
    total = np.zeros((2, SIZE ** (ORDER + 1)), np.int64)
    rows = counts.toArrow()  # at most 2 * SIZE^4 rows
    total[rows["rejected"].to_numpy(), rows["gram"].to_numpy()] = rows["n"].to_numpy()
    if not total.any(1).all():
        return None
    return (smoothed(total[0]) - smoothed(total[1])).astype(np.float32)


def ratio_scores(strings: list[str], ratio: np.ndarray) -> np.ndarray:
    gram, owner = grams(strings)
    n = np.bincount(owner, minlength=len(strings))
    return np.bincount(owner, ratio[gram].astype(np.float64), len(strings)) / np.maximum(n, 1)


def calibrated(histogram: np.ndarray) -> float:
    """Score below which urls are blocked: middle of the best run of balanced accuracy. histogram: (2, BINS)."""
    accepted, rejected = (h.cumsum() / max(1, h.sum()) for h in histogram)
    gain = rejected - accepted
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float((best[0] + best[-1] + 2) / 2 / BINS * 2 * RANGE - RANGE)


def judge_urls(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row of pages."""
    parts = with_parts(pages)
    spark = pages.sparkSession
    ratio = fit_ratio(gram_counts(parts))
    if ratio is None:
        return parts.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(ratio)  # 4 * SIZE^4 bytes

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 20_000):
            strings = [h + p for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ratio_scores(strings, shared.value), pa.float64())], names=[*batch.schema.names, "score"])

    scored = parts.mapInArrow(score, "page_id long, host string, path string, rule string, rule_verdict string, rejected boolean, score double")
    cell = F.least(F.greatest(F.floor((F.col("score") + RANGE) / (2 * RANGE) * BINS), F.lit(0)), F.lit(BINS - 1))
    histogram = np.zeros((2, BINS))
    for row in scored.where((F.col("host") != "") | (F.col("path") != "")).groupBy("rejected", cell.alias("cell")).count().collect():  # at most 2 * BINS rows
        histogram[int(row["rejected"]), row["cell"]] = row["count"]
    limit = calibrated(histogram)
    empty = (F.col("host") == "") & (F.col("path") == "")
    own = F.when(~empty & (F.col("score") < limit), "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), "score")
