"""Toxicity by a subsequence string kernel with Nystroem landmarks and a support vector machine."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sliceweave.llm.common import mix, slices, words_of

#: A feature is three characters in order within SPAN of each other; every character between them costs the factor DECAY.
SPAN, DECAY = 6, 0.5
STEPS = [(j, k, DECAY ** (k - 2)) for k in range(2, SPAN) for j in range(1, k)]
#: Features are hashed to so many places.
PLACES = 1 << 20
#: Terms scored at once.
PART = 10_000
#: Bounds of the fit: labelled documents of each class, clean words by chance (and a quarter as many by frequency) and by score, landmarks of each class, rounds.
TOXIC_DOCS, CLEAN_DOCS, CLEAN_WORDS, HARD_WORDS, LANDMARKS, ROUNDS = 4000, 8000, 20_000, 4000, 192, 5
#: Raw score of a text without words; clean examples aim at -1.
NO_WORDS = -2.0
#: How much a term must explain, see explaining_terms.
LEAST_GAIN, LEAST_AGAIN, TERMS_A_TEXT = 2.0, 12.0, 12
MARKS = "\"'.,;:!?()[]{}<>|%#*$&@^~_-+=/\\`"


def subsequences(terms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All subsequences of the terms, ends marked: term numbers, places, weights; and a norm for each term.

    The norm takes the subsequences of a term as different ones, so it depends on the length alone.
    """
    marked = ["\x02" + t + "\x03" for t in terms]
    sizes = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    text = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(terms)), sizes)
    who, where, weight = [], [], []
    for j, k, w in STEPS:
        if len(text) <= k:
            continue
        ok = np.flatnonzero(owner[:-k] == owner[k:])
        code = text[ok] | (text[ok + j] << np.uint64(21)) | (text[ok + k] << np.uint64(42))
        who.append(owner[ok])
        where.append((mix(code) & np.uint64(PLACES - 1)).astype(np.int64))
        weight.append(np.full(len(ok), w))
    norm = sum(np.maximum(sizes - k, 0) * w * w for _, k, w in STEPS) if len(sizes) else np.zeros(0)
    empty = [np.zeros(0, dtype=np.int64)]
    return np.concatenate(who or empty), np.concatenate(where or empty), np.concatenate(weight or [np.zeros(0)]), np.sqrt(np.maximum(norm, 1.0))


class Kernel:
    """k(term, landmark): the inner product of their subsequence weights over both norms."""

    def __init__(self, landmarks: list[str]):
        who, where, weight, norm = subsequences(landmarks)
        self.columns, column = np.unique(where, return_inverse=True)
        self.rows = np.zeros((len(landmarks), len(self.columns)), dtype=np.float32)
        np.add.at(self.rows, (who, column), weight / norm[who])

    def __call__(self, terms: list[str]) -> np.ndarray:
        out = np.zeros((len(terms), len(self.rows)))
        for at in range(0, len(terms), 400):
            part = terms[at:at + 400]
            who, where, weight, norm = subsequences(part)
            column = np.searchsorted(self.columns, where)
            hit = self.columns[np.minimum(column, len(self.columns) - 1)] == where
            x = np.zeros((len(part), len(self.columns)), dtype=np.float32)
            np.add.at(x, (who[hit], column[hit]), (weight / norm[who])[hit])
            out[at:at + len(part)] = x @ self.rows.T
        return out

    def table(self, alpha: np.ndarray) -> np.ndarray:
        """The function sum of alpha over landmarks, as a weight for each place."""
        out = np.zeros(PLACES, dtype=np.float32)
        out[self.columns] = alpha @ self.rows
        return out


def term_scores(terms: list[str], table: np.ndarray, bias: float) -> np.ndarray:
    """Scores of the terms, PART of them at a time, since a term has some hundred subsequences."""
    out = np.full(len(terms), bias)
    for at in range(0, len(terms), PART):
        part = terms[at:at + PART]
        who, where, weight, norm = subsequences(part)
        out[at:at + len(part)] += np.bincount(who, weights=weight * table[where], minlength=len(part)) / norm
    return out


def fit_machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by Newton steps on the rows inside the margin; the last column of ``x`` is 1."""
    x1 = x  # its last column is 1
    w = np.zeros(x1.shape[1])
    flat = ridge * np.eye(len(w))
    flat[-1, -1] = 1e-8
    for _ in range(30):
        inside = y * (x1 @ w) < 1
        a = x1[inside] * weight[inside, None]
        new = np.linalg.solve(a.T @ x1[inside] + flat, a.T @ y[inside])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w[:-1], float(w[-1])


def terms_of(words: list[str]) -> list[str]:
    """Words in lower case without marks at their ends, and without marks inside if letters are left."""
    out = []
    for w in words:
        t = w.lower().strip(MARKS)
        if not t.isalnum():
            t = "".join(c for c in t if c.isalnum()) or w
        out.append(t)
    return out


def disguised(term: str) -> list[str]:
    """The term with a letter put in, and with a letter exchanged, at a place and by a letter that the term determines."""
    if len(term) < 4:
        return []
    h = hash_of(term)
    at, letter, other = 1 + h % (len(term) - 2), "xzqkj01v"[h // 64 % 8], "x1qk0jzv"[h // 512 % 8]
    return [term[:at + 1] + letter + term[at + 1:], term[:at] + other + term[at + 1:]]


def spaced_out(codes: np.ndarray, counts: np.ndarray, words: list[str]) -> tuple[list[str], np.ndarray]:
    """Runs of four or more single letters in a row, put together, with the row of each."""
    single = np.fromiter((len(w) == 1 and w.isalpha() for w in words), dtype=bool, count=len(words))[codes] if words else np.zeros(0, dtype=bool)
    row = np.repeat(np.arange(len(counts)), counts)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
    joined, rows = [], []
    for a, b in zip(edge[::2], edge[1::2]):
        if b - a >= 4:
            for r in np.unique(row[a:b]):
                part = codes[a:b][row[a:b] == r]
                if len(part) >= 4:
                    joined.append("".join(words[c] for c in part))
                    rows.append(r)
    return joined, np.array(rows, dtype=np.int64)


def best_terms(texts: pa.Array, table: np.ndarray, bias: float) -> np.ndarray:
    """The greatest score of any term of each text. A sentence scores as its best term, a text as its best sentence; a text
    without words scores NO_WORDS."""
    codes, counts, words = words_of(texts, lower=True)
    out = np.full(len(counts), NO_WORDS)
    if len(codes):
        scores = term_scores(terms_of(words), table, bias)[codes]
        full = np.flatnonzero(counts)
        starts = (np.cumsum(counts) - counts)[full]
        out[full] = np.maximum.reduceat(scores, starts)
        joined, rows = spaced_out(codes, counts, words)
        if joined:
            np.maximum.at(out, rows, term_scores(terms_of(joined), table, bias))
    return out


def held_out(id_col: str):
    """Rows that no fit may see: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(toxic, text) of at most about TOXIC_DOCS and CLEAN_DOCS labelled documents outside the held-out part, the same ones
    in every run. A document with both labels counts as toxic."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for label, most in ((1, TOXIC_DOCS), (0, CLEAN_DOCS)):
        share = F.when(F.col("toxic") == label, min(1.0, most / max(sizes.get(label, 0), 1))).otherwise(share)
    chosen = known.filter(F.pmod(F.xxhash64(F.lit(11), "_id"), F.lit(1_000_000)) < share * 1_000_000)
    # of a size bounded by the two constants
    return docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("toxic", "text")


class Model:
    """A weight per place of the subsequence table, a bias, and the slope and shift that turn scores into probabilities."""

    def __init__(self, table: np.ndarray, bias: float, slope: float, shift: float):
        self.table, self.bias, self.slope, self.shift = table, bias, slope, shift


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on sentences of labelled documents.

    A clean document has clean sentences only; a toxic one has at least one toxic sentence, and in it a toxic term, but the
    label does not say which. So examples are terms. Those of clean sentences are clean. Toxic ones are chosen from words
    that two or more toxic texts hold and hardly any clean one: again and again the one that explains most toxic texts which
    none before explains, so words that merely stand in copies of a toxic text are left out. Terms are compared by the kernel
    through landmarks, and also learnt with a letter put in or exchanged. After each round the clean words that look most toxic join the examples.
    """
    from sliceweave.session import materialize

    sample = materialize(labelled_sample(docs, labels, id_col, text_col, label_col).filter(F.col("text").isNotNull()).distinct())

    def words(frames):
        for frame in frames:
            out, held = [], 0
            for toxic, text in zip(frame["toxic"], frame["text"]):
                codes, counts, found = words_of(pa.array([text]), lower=True)
                terms = set(terms_of(found)) | set(spaced_out(codes, counts, found)[0])
                # copies of a text, near ones too, mostly share their smallest hash
                sign = min(map(hash_of, terms), default=0)
                out.append(pd.DataFrame({"toxic": toxic, "doc": np.int64(hash_of(text)), "sign": np.int64(sign), "term": sorted(terms)}))
                held += len(terms)
                if held > 50_000:
                    yield pd.concat(out)
                    out, held = [], 0
            if out:
                yield pd.concat(out)

    held = materialize(sample.mapInPandas(words, "toxic int, doc long, sign long, term string"))
    counts = held.groupBy("term").agg(F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good"))
    suspects = materialize(counts.filter("bad >= 2 and bad >= 4 * good"))
    rows = held.filter("toxic = 1").join(suspects, "term").select("doc", "sign", "term").collect()
    harmless = counts.filter("good > 0 and bad < 4 * good").select("term", "good")
    frequent = harmless.orderBy(F.desc("good"), "term").limit(CLEAN_WORDS // 4).collect()
    chance = harmless.orderBy(F.xxhash64("term"), "term").limit(CLEAN_WORDS).collect()
    clean = list(dict.fromkeys(r["term"] for r in frequent + chance))
    toxic = explaining_terms(rows)
    if not toxic or not clean:
        return Model(np.zeros(PLACES, dtype=np.float32), -1.0, 1.0, 0.0)
    hard: list[str] = []
    for turn in range(ROUNDS):
        examples = clean + hard
        known = set(examples)
        marks = [t for t, _ in toxic[:LANDMARKS]] + clean[:LANDMARKS // 2] + hard[:LANDMARKS]
        kernel = Kernel(marks)
        values, vectors = np.linalg.eigh(kernel(marks))
        good = values > 1e-4 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])
        bad = toxic + [(v, n / 4) for t, n in toxic for v in disguised(t) if v not in known]
        terms = [t for t, _ in bad] + examples
        x = np.ones((len(terms), root.shape[1] + 1))
        for at in range(0, len(terms), 5000):
            x[at:at + 5000, :-1] = kernel(terms[at:at + 5000]) @ root
        y = np.concatenate([np.ones(len(bad)), -np.ones(len(examples))])
        share = np.sqrt([n for _, n in bad])
        # both classes weigh the same in all
        line, bias = fit_machine(x, y, np.concatenate([share / share.sum(), np.full(len(examples), 1.0 / len(examples))]) * 2000)
        table = kernel.table(root @ line)
        if turn + 1 < ROUNDS:
            hard = _hardest(harmless.select("term"), table, bias, hard)

    def scored(frames):
        for frame in frames:
            texts = pa.array(frame["text"], pa.string())
            for a, b in slices(texts):
                yield pd.DataFrame({"toxic": frame["toxic"].iloc[a:b], "score": best_terms(texts.slice(a, b - a), table, bias)})

    got = sample.mapInPandas(scored, "toxic int, score double").toPandas()
    slope, shift = calibrate(got["score"].to_numpy(), got["toxic"].to_numpy().astype(float))
    return Model(table, bias, slope, shift)


def explaining_terms(rows: list) -> list[tuple[str, int]]:
    """Terms that explain the documents, with the documents that hold each. ``rows`` are (doc, sign, term).

    Greedily: a term is taken if it explains texts of weight LEAST_GAIN that none before explains, or of weight
    LEAST_AGAIN that fewer than TERMS_A_TEXT do, since a toxic text often holds several.
    """
    terms = sorted({r["term"] for r in rows})
    number = {t: i for i, t in enumerate(terms)}
    by_doc: dict[int, list[int]] = {}
    by_term: list[list[int]] = [[] for _ in terms]
    for r in rows:
        by_doc.setdefault(r["doc"], []).append(number[r["term"]])
        by_term[number[r["term"]]].append(r["doc"])
    # copies weigh as one text together
    sign = {r["doc"]: r["sign"] for r in rows}
    alike = Counter(sign.values())
    weight = {d: 1.0 / alike[s] for d, s in sign.items()}
    gain, out, told = np.zeros(len(terms)), [], dict.fromkeys(by_doc, 0)
    again = np.zeros(len(terms))
    for d, ts in by_doc.items():
        gain[ts] += weight[d]
        again[ts] += weight[d]
    free = np.ones(len(terms), dtype=bool)
    while len(terms):
        rank = np.where(free & ((gain >= LEAST_GAIN) | (again >= LEAST_AGAIN)), gain + again, -1.0)
        best = int(np.argmax(rank))
        if rank[best] < 0:
            break
        free[best] = False
        out.append((terms[best], len(by_term[best])))
        for d in by_term[best]:
            told[d] += 1
            if told[d] == 1:
                gain[by_doc[d]] -= weight[d]
            if told[d] == TERMS_A_TEXT:
                again[by_doc[d]] -= weight[d]
    return sorted(out, key=lambda t: (-t[1], t[0]))


def _hardest(harmless: DataFrame, table: np.ndarray, bias: float, known: list[str]) -> list[str]:
    """The clean terms with the greatest scores, HARD_WORDS at most, and those found before."""
    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"term": frame["term"], "score": term_scores(list(frame["term"]), table, bias) if len(frame) else []})

    top = harmless.mapInPandas(run, "term string, score double").orderBy(F.desc("score"), "term").limit(HARD_WORDS).collect()
    return list(dict.fromkeys([r["term"] for r in top] + known))


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def calibrate(score: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, both classes weighing the same, held back by a small penalty."""
    x = np.stack([score, np.ones(len(score))], axis=1)
    weight = np.where(label == 1, 0.5 / max(label.sum(), 1), 0.5 / max((1 - label).sum(), 1)) * 1000
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weight * (p - label)) + 0.05 * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", at: float = 0.3) -> DataFrame:
    """Rows (id, held_out, score, predicted) for every row of ``docs``.

    Whole texts are scored where they lie: the landmarks' weights are folded into one table, so a term costs its own
    subsequences only. Null and empty texts have the score of NO_WORDS, repeated rows
    the same one, an empty table gives no rows; other
    columns are not read.
    """
    table, bias, slope, shift = model.table, model.bias, model.slope, model.shift
    sent = docs.sparkSession.sparkContext.broadcast(table)  # of PLACES numbers
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), StructField("score", DoubleType())])

    def run(batches):
        weights = sent.value
        for batch in batches:
            for a, b in slices(batch.column(1)):
                raw = best_terms(batch.column(1).slice(a, b - a), weights, bias)
                p = 1 / (1 + np.exp(-np.clip(slope * raw + shift, -500, 500)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(p)], names=[id_col, "score"])

    scored = docs.select(id_col, text_col).mapInArrow(run, schema)
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"))
