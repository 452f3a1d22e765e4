"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams (1 to 3 characters of the lower-cased text, hashed to
``BUCKETS``) for each language over all training rows: each task adds up a dense
count matrix and emits its non-zero cells, which Spark sums. The smoothed
log-probability matrix (buckets x languages, a few hundred KB) is broadcast;
scoring looks up the rows of a batch's n-grams and adds them up by text.

The score is the posterior of the winning language with the evidence scaled to
that of ``EVIDENCE`` n-grams at most, so that a long text of mixed languages does
not come out as certain.

Null texts and texts without a letter give ``und`` with score 0; so does
everything when there is no training row. Rows with a null lang are not learned
from. Extra columns are kept by ``with_language``, clashing names included: the
new column's name gets underscores until it is free. Repeated rows are predicted
alike. A tie goes to the language that is first in alphabetical order. A very
long text is a slice of its own, read whole. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm.common import crc_mod, fresh

BUCKETS, ORDERS, EVIDENCE, SLICE_CHARS = 1 << 15, (1, 2, 3), 60.0, 1 << 19
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_SHIFT = np.uint64(64 - 15)
_LETTER = regex.compile(r"\p{L}")


def features(texts: list[str]) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """For slices of texts[i:j]: for each order the bucket of each n-gram and the n-grams' starts by text.

    An n-gram may reach over the end of its text into the two separators, which
    mark ends; it never holds another text's characters.
    """
    i = 0
    while i < len(texts):
        j, held = i, 0
        while j < len(texts) and (j == i or held + len(texts[j]) <= SLICE_CHARS):
            held += len(texts[j]) + 2
            j += 1
        part = texts[i:j]
        c = np.frombuffer(("\n\n".join(part) + "\n\n").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sizes = np.array([len(t) for t in part], np.int64)
        starts = np.cumsum(sizes + 2) - sizes - 2
        out = []
        h = np.zeros(len(c), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            m = len(c) - n + 1
            h = h[:m] + (c[n - 1 :] + np.uint64(n)) * _K[n - 1]
            if n in ORDERS:
                out.append((((h * _K[(n + 1) % 3]) >> _SHIFT).astype(np.int32), starts))
        yield i, j, [(idx, s) for idx, s in out], sizes
        i = j


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log-probability matrix of buckets x languages, log priors) from all rows with a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for b in batches:
            langs = b.column(1).to_pylist()
            texts = [(t or "").lower() for t in b.column(0).to_pylist()]
            for i, j, grams, sizes in features(texts):
                names = langs[i:j]
                known = sorted(set(names))
                code = np.array([known.index(x) for x in names], np.int64)
                for idx, starts in grams:
                    owner = np.repeat(code, sizes)
                    inside = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
                    ok = inside < len(idx)
                    both = np.bincount(owner[ok] * BUCKETS + idx[inside[ok]], minlength=len(known) * BUCKETS).reshape(-1, BUCKETS)
                    for k, name in enumerate(known):
                        total[name] = total.get(name, 0) + both[k]
                for name in names:
                    docs[name] = docs.get(name, 0) + 1
        for name, x in total.items():
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(x[at], docs[name]), pa.int64())],
                ["lang", "bucket", "n"],
            )

    cells = (
        rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
        .mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    )
    langs = sorted(cells["lang"].unique())
    n = np.zeros((BUCKETS, len(langs)))
    prior = np.zeros(len(langs))
    for k, name in enumerate(langs):
        own = cells[cells["lang"] == name]
        feature = own[own["bucket"] >= 0]
        n[feature["bucket"].to_numpy(), k] = feature["n"].to_numpy()
        prior[k] = own.loc[own["bucket"] < 0, "n"].sum()
    logp = np.log(n + 0.5) - np.log(n.sum(axis=0, keepdims=True) + 0.5 * BUCKETS) if len(langs) else n
    return langs, logp.astype(np.float32), np.log(prior / prior.sum()) if len(langs) else prior


def predict(texts: list[str | None], langs: list[str], logp: np.ndarray, prior: np.ndarray) -> tuple[list[str], np.ndarray]:
    names, scores = ["und"] * len(texts), np.zeros(len(texts))
    if not langs:
        return names, scores
    low = [(t or "").lower() for t in texts]
    for i, j, grams, sizes in features(low):
        total, n = np.zeros((j - i, len(langs))), np.zeros(j - i)
        full = sizes > 0
        for idx, starts in grams:
            # sums between the starts also hold n-grams of the separators, which are taken off again
            picked = logp[idx]
            edges = np.stack([starts[full], np.minimum(starts[full] + sizes[full], len(idx))], 1)
            good = edges[:, 1] > edges[:, 0]
            at = np.flatnonzero(full)[good]
            if len(at):
                flat = edges[good].ravel()
                cut = flat[:-1] if flat[-1] >= len(idx) else flat
                total[at] += np.add.reduceat(picked, cut, axis=0, dtype=np.float64)[::2]
                n[at] += edges[good, 1] - edges[good, 0]
        mean = total / np.maximum(n, 1)[:, None] * np.minimum(n, EVIDENCE)[:, None] + prior
        mean -= mean.max(axis=1, keepdims=True)
        p = np.exp(mean)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        for d in range(j - i):
            if n[d] and _LETTER.search(low[i + d]):
                names[i + d], scores[i + d] = langs[best[d]], float(p[d, best[d]])
    return names, scores


def with_language(df: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text_col: str = "text") -> DataFrame:
    """df with a last column _language (struct of lang and score); where df has that name, underscores are added."""
    share = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang:string,score:double>")
    def language(texts: pd.Series) -> pd.DataFrame:
        names, scores = predict(texts.tolist(), *share.value)
        return pd.DataFrame({"lang": names, "score": scores})

    return df.select("*", language(F.col(text_col)).alias(fresh(df, "_language")))


def train_rows(docs: DataFrame) -> DataFrame:
    return docs.where(crc_mod("doc_id", 5) != 0)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(train_rows(docs))
    return with_language(docs.select("doc_id", "text"), model).select(
        "doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), F.col("_language.lang").alias("lang_pred"), F.col("_language.score").alias("score")
    )
