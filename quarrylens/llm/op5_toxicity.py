"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, maps homoglyphs of other scripts to Latin letters and
digits and signs inside words to the letters they stand for, and makes every
other run of non-letters one space. The lexicon holds word starts and whole
words, each with a smoothed log-odds weight learned from labelled rows; in one
word only the heaviest match counts. A match inside an exception phrase (given,
or learned as the context of a match in clean rows alone) counts nothing. The
sum of weights and the same normalised by the number of words go through a
logistic curve fitted on the same rows.

``max_rows`` labelled rows, chosen by a hash of the id, bound what is learned
from; everything is scored. Nulls and empty texts have no match and get the
curve's lowest value. Without rows of both labels every score is 0. Rows that
repeat are scored alike; labels that disagree on a doc_id all count. Texts are
scored whole, however long. Terms of equal strength enter the lexicon shortest
first, then in alphabetical order. An empty table gives no rows. Extra columns
are kept; where one has the name of a result, the result's name gets underscores.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm.common import Scratch, crc_mod, fresh

#: Labelled rows that are learned from, at most.
MAX_ROWS = 16_000
MIN_DOCS, MIN_ODDS = 3, 2.5
PREFIXES = range(4, 10)
THRESHOLD = 0.3
#: Given exceptions: benign phrases that hold a term.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "class clown fish", "clown fish")
#: Look-alikes of other scripts, in natural order.
HOMOGLYPHS = dict(zip("авекмнорстухіјѕԁӏαεικνορτυχ", "abekmhopctyxijsdlaeikvoptux", strict=True))
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SIGNS = {"@": "a", "$": "s"}
_TABLE = str.maketrans(HOMOGLYPHS | DIGITS)
_SIGN = regex.compile(r"[@$](?=\p{L})")
_OTHER = regex.compile(r"[^\p{L}]+")


def fold(text: str | None) -> str:
    """Folded words, each after one space, and a space at the end."""
    if not text:
        return " "
    t = text.lower().translate(_TABLE)
    if "@" in t or "$" in t:
        t = _SIGN.sub(lambda m: SIGNS[m[0]], t)
    t = _OTHER.sub(" ", t).strip(" ")
    return f" {t} " if t else " "


def candidates(folded: str) -> set[str]:
    """Starts (' abcd') and whole words (' abc ') of a folded text."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in PREFIXES if len(w) >= k)
    return out


def automaton(lexicon: dict[str, float], exceptions: set[str]) -> ahocorasick.Automaton | None:
    a = ahocorasick.Automaton()
    for term, weight in lexicon.items():
        a.add_word(term, (len(term), weight))
    for phrase in exceptions:
        a.add_word(f" {phrase} ", (len(phrase) + 2, None))
    if not len(a):
        return None
    a.make_automaton()
    return a


def weigh(folded: str, a: ahocorasick.Automaton | None) -> tuple[float, int]:
    """Sum of the heaviest match of each word outside exception phrases; number of words."""
    words = folded.count(" ") - 1
    if a is None or words <= 0:
        return 0.0, max(words, 0)
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (size, weight) in a.iter(folded):
        start = end - size + 1
        if weight is None:
            spared.append((start, end))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    if spared:
        best = {s: w for s, w in best.items() if not any(x <= s < y for x, y in spared)}
    return sum(best.values()), words


def traits(total: float | np.ndarray, words: int | np.ndarray) -> np.ndarray:
    return np.stack([np.ones_like(total, float), np.log1p(total), np.log1p(100.0 * np.asarray(total) / np.maximum(words, 1))], -1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps."""
    b = np.zeros(x.shape[1])
    penalty = np.diag([0.0] + [ridge] * (x.shape[1] - 1)) * 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * w[:, None]).T @ x + penalty + 1e-9 * np.eye(len(b)), x.T @ (y - p) - penalty @ b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """text, toxic of at most ``max_rows`` labelled rows, in the order of a hash; staged, so that documents are read once."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .select("doc_id", F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id", "toxic").limit(max_rows)
    )
    # at most max_rows rows of two numbers
    found = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = scratch.stage(found.select("text", "toxic", F.xxhash64(F.lit(5), "doc_id").alias("draw"), F.monotonically_increasing_id().alias("row")), "labelled")
    if rows.count() > max_rows:  # ids that repeat: the first max_rows again
        last = rows.select("draw", "row").orderBy("draw", "row").limit(max_rows).agg(F.max(F.struct("draw", "row")).alias("at")).first()["at"]
        rows = rows.where((F.col("draw") < last["draw"]) | ((F.col("draw") == last["draw"]) & (F.col("row") <= last["row"])))
    return rows.select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> dict:
    """Lexicon, learned exceptions and curve from at most ``max_rows`` labelled rows.

    Tables of terms and phrases that come to the driver are those of that many
    rows, so they are bounded by the sample, however large the corpus is.
    """
    sc = docs.sparkSession.sparkContext
    rows = sample(docs, labels, max_rows).repartition(sc.defaultParallelism)
    sizes = {int(r["toxic"]): r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    none = {"lexicon": {}, "exceptions": set(), "curve": None}
    if not sizes.get(1) or not sizes.get(0):
        return none

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            count = Counter(term for t in b["text"] for term in candidates(fold(t)))
            yield pd.DataFrame({"term": list(count), "n": list(count.values())})

    hot = rows.where("toxic = 1").select("text").mapInPandas(explode, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_DOCS).toPandas()
    toxic = dict(sorted(zip(hot["term"], hot["n"].tolist(), strict=True)))
    share = sc.broadcast(set(toxic))

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            count = Counter(term for t in b["text"] for term in candidates(fold(t)) & share.value)
            yield pd.DataFrame({"term": list(count), "n": list(count.values())})

    clean_df = rows.where("toxic = 0").select("text").mapInPandas(seen, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    clean = dict(zip(clean_df["term"], clean_df["n"].tolist(), strict=True))
    odds = {
        t: math.log((n + 0.5) / (sizes[1] + 1)) - math.log((clean.get(t, 0) + 0.5) / (sizes[0] + 1))
        for t, n in toxic.items()
    }
    base = sizes[1] / (sizes[0] + sizes[1])

    def surprise(bad: int, good: int) -> float:
        """Log-likelihood ratio of a term's toxic share against the base rate."""
        n = bad + good
        return 2 * (bad * math.log(bad / n / base) + (good * math.log(good / n / (1 - base)) if good else 0.0))

    # as many terms as candidates are tried, so the bar rises with their number
    bar = 2 * math.log(max(2, len(toxic)))
    strong = {t: w for t, w in odds.items() if w >= MIN_ODDS and surprise(toxic[t], clean.get(t, 0)) >= bar}
    lexicon: dict[str, float] = {}
    for t in sorted(strong, key=lambda t: (-toxic[t] * strong[t], len(t), t)):
        # a longer term that a shorter one covers as well adds nothing
        shorter = (t[:k] for k in range(5, len(t)))
        if not any(s in lexicon and toxic[s] >= toxic[t] and lexicon[s] >= strong[t] - 0.7 for s in shorter):
            lexicon[t] = strong[t]
    model = sc.broadcast(lexicon)

    def around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = automaton(model.value, set())
        for b in batches:
            found = []
            for t, y in zip(b["text"], b["toxic"], strict=True):
                f = fold(t)
                if a is None:
                    continue
                phrases = set()
                for s in {end - v[0] + 1 for end, v in a.iter(f)}:
                    tail = f[s + 1 :].split(" ", 2)[:2]
                    head = f[:s].rsplit(" ", 1)[-1]
                    if len(tail) == 2 and tail[1]:
                        phrases.add(" ".join(tail))
                    if head:
                        phrases.add(f"{head} {tail[0]}")
                found += [(p, int(y)) for p in phrases]
            yield pd.DataFrame(found, columns=["phrase", "toxic"])

    context = rows.mapInPandas(around, "phrase string, toxic int").groupBy("phrase").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    learned = context.where((F.col("bad") == 0) & (F.col("n") >= 5)).toPandas()
    exceptions = {fold(x).strip() for x in EXCEPTIONS} | set(learned["phrase"])
    both = sc.broadcast((lexicon, exceptions))

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = automaton(*both.value)
        for b in batches:
            got = [weigh(fold(t), a) for t in b["text"]]
            yield pd.DataFrame({"total": [x[0] for x in got], "words": [float(x[1]) for x in got], "toxic": b["toxic"]})

    # max_rows rows of three numbers, in a defined order
    table = rows.mapInPandas(measured, "total double, words double, toxic int").toPandas().sort_values(["total", "words", "toxic"])
    curve = logistic(traits(table["total"].to_numpy(), table["words"].to_numpy()), table["toxic"].to_numpy(float))
    return {"lexicon": lexicon, "exceptions": exceptions, "curve": curve}


def score(texts: list[str | None], model: dict, a: ahocorasick.Automaton | None) -> np.ndarray:
    if model["curve"] is None:
        return np.zeros(len(texts))
    got = np.array([weigh(fold(t), a) for t in texts], float).reshape(-1, 2)
    return 1 / (1 + np.exp(-np.clip(traits(got[:, 0], got[:, 1]) @ model["curve"], -30, 30)))


def with_toxicity(df: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """df with two last columns, score (double) and predicted (int); underscores are added to names that df has."""
    share = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxicity(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a = automaton(share.value["lexicon"], share.value["exceptions"])
        for s in parts:
            yield pd.Series(score(s.tolist(), share.value, a))

    name = fresh(df, "score")
    scored = df.select("*", toxicity(F.col(text_col)).alias(name))
    return scored.select("*", (F.col(name) >= THRESHOLD).cast("int").alias(fresh(scored, "predicted")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_mod("doc_id", 4) != 2)
    model = fit(docs, labels)
    return with_toxicity(docs.select("doc_id", "text"), model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
