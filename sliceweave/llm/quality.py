"""Text quality: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sliceweave.llm.common import bytes_of, hash_of_bytes, mix, runs_of, slices
from sliceweave.session import materialize

#: Places of the hashed n-grams, and words of an n-gram at most.
PLACES, LONGEST = 1 << 18, 2
#: A word that is the same as the one so many before it is an n-gram of its own kind, whatever the word.
REPEATS = (1, 2)
#: Bounds of the fit: about so many labelled documents of each class, dealt to so many learners; rounds of learning, after each of which learners are averaged.
FIT_DOCS, LEARNERS, ROUNDS = 12_000, 8, 3
#: Learning rate, its offset, and the penalties of the updates.
ALPHA, BETA, L1, L2 = 0.1, 1.0, 0.05, 1.0

# words are runs of letters, digits and bytes beyond ASCII, or of marks; white space parts them
_KIND = np.array([0 if b == 0x20 or 9 <= b <= 13 else 1 if chr(b).isalnum() or b >= 0x80 else 2 for b in range(256)], dtype=np.int8)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def held_out(id_col: Column) -> Column:
    """Rows that no fit may see: crc32 of the id as text is 0 modulo 5; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def places_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of all n-grams of all texts, text by text, and how many each has. Case counts; a word's marks are words of their
    own; a word said again also counts as that."""
    data, ends = bytes_of(texts)
    coded, _, counts = runs_of(data, ends, _KIND[data])
    hashes = hash_of_bytes(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, dtype=np.uint64)
    row = np.repeat(np.arange(len(counts)), counts)
    rows, grams, key = [row], [mix(hashes)], hashes
    for n in range(2, LONGEST + 1):
        at = np.flatnonzero(row[:-n + 1] == row[n - 1:])
        with np.errstate(over="ignore"):
            key = key[:-1] * _FACTOR + hashes[n - 1:]
        rows.append(row[at])
        grams.append(mix(key[at]))
    for gap in REPEATS:
        again = np.flatnonzero((row[gap:] == row[:-gap]) & (hashes[gap:] == hashes[:-gap]))
        rows.append(row[again])
        grams.append(np.full(len(again), mix(np.full(1, gap, dtype=np.uint64))[0]))
    where, whose = np.concatenate(grams), np.concatenate(rows)
    order = np.argsort(whose, kind="stable")
    return (where[order] & np.uint64(PLACES - 1)).astype(np.int64), np.bincount(whose, minlength=len(counts)).astype(np.int64)


class Learner:
    """The sums of follow-the-regularised-leader; the weights are what the sums make best, most of them 0."""

    def __init__(self, z: np.ndarray, n: np.ndarray):
        self.z, self.n = z, n

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: float, weight: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = weight * (p - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def sparse(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's vector: its places with their n-grams over the root of all, and a last place that always counts 1."""
    at, counts = np.unique(places, return_counts=True)
    return np.append(at, PLACES), np.append(counts / np.sqrt(max(len(places), 1)), 1.0)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(label, text, learner) of about FIT_DOCS documents of each class outside the held-out part, the same ones in every run."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("_of")).agg(F.min(F.col(label_col).cast("int")).alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for label, n in sizes.items():
        share = F.when(F.col("label") == label, min(1.0, FIT_DOCS / n)).otherwise(share)
    chosen = known.filter(F.col("label").isin(0, 1) & (F.pmod(F.xxhash64(F.lit(13), "_of"), F.lit(1_000_000)) < share * 1_000_000))
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    # of a size bounded by FIT_DOCS
    drawn = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_of"))
    # copies teach once
    drawn = drawn.groupBy(F.xxhash64("text").alias("copy"), "label").agg(F.min_by("text", "_doc").alias("text"))
    return drawn.select("label", "text", "copy", F.pmod("copy", F.lit(LEARNERS)).cast("int").alias("learner"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """Weights of the PLACES and the bias, from labelled documents outside the held-out part.

    A learner is a task with about an eighth of the sample, taken in the order of a hash; all learners start a round from
    the average of the last one. Both classes weigh the same in all. Labels other than 0 and 1, null labels and null texts
    teach nothing; of a document with both labels the lower one counts; without labelled documents all weights are 0. Rows
    with repeated ids all teach, texts alike once, and long texts are read whole.
    """
    sample = materialize(labelled_sample(docs, labels, id_col, text_col, label_col))
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    weight = {label: sum(sizes.values()) / (2 * n) for label, n in sizes.items()}
    many = sample.select("learner").distinct().count()
    z, n = np.zeros(PLACES + 1), np.zeros(PLACES + 1)
    context = docs.sparkSession.sparkContext
    for turn in range(ROUNDS):
        sent = context.broadcast((z, n))  # of PLACES numbers each

        def learn(frame: pd.DataFrame) -> pd.DataFrame:
            start_z, start_n = sent.value
            learner = Learner(start_z.copy(), start_n.copy())
            frame = frame.sort_values("copy")
            places, counts = [], []
            texts = pa.array(frame["text"], pa.string())
            for a, b in slices(texts):
                p, c = places_of(texts.slice(a, b - a))
                places.append(p.astype(np.int32))
                counts.append(c)
            places, ends = np.concatenate(places), np.cumsum(np.concatenate(counts))
            starts, labels_ = ends - np.concatenate(counts), frame["label"].to_numpy()
            for i in np.random.default_rng(turn).permutation(len(ends)):
                learner.learn(*sparse(places[starts[i]:ends[i]]), float(labels_[i]), weight[int(labels_[i])])
            at = np.flatnonzero(learner.n)
            return pd.DataFrame({"place": at, "z": learner.z[at], "n": learner.n[at]})

        got = sample.groupBy("learner").applyInPandas(learn, "place long, z double, n double")
        got = got.groupBy("place").agg(F.sum("z").alias("z"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("m")).toPandas()
        at = got["place"].to_numpy()
        # learners that did not meet a place still hold what they began with
        left = many - got["m"].to_numpy()
        new_z, new_n = z.copy(), n.copy()
        new_z[at] = (got["z"].to_numpy() + left * z[at]) / max(many, 1)
        new_n[at] = (got["n"].to_numpy() + left * n[at]) / max(many, 1)
        z, n = new_z, new_n
    return Learner(z, n).weights()


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", at: float = 0.3) -> DataFrame:
    """Rows (id, held_out, score, predicted) for every row of ``docs``: the chance of label 1, and whether it reaches ``at``.

    Whole texts are scored where they lie, each as the sparse dot product of its n-grams with the weights. Null and empty
    texts have the bias alone; rows alike are scored alike; a null id is kept; an empty table gives no rows; other columns
    are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))  # of PLACES numbers
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = StructType([source.schema["id"], StructField("score", DoubleType())])

    def run(batches):
        w = sent.value
        for batch in batches:
            for a, b in slices(batch.column(1)):
                places, counts = places_of(batch.column(1).slice(a, b - a))
                total, full = np.zeros(b - a), np.flatnonzero(counts)
                if len(full):
                    total[full] = np.add.reduceat(w[places], (np.cumsum(counts) - counts)[full])
                p = 1 / (1 + np.exp(-np.clip(total / np.sqrt(np.maximum(counts, 1)) + w[-1], -35, 35)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(p)], names=["id", "score"])

    scored = source.mapInArrow(run, schema)
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"))
