"""Hierarchical language identification: the family first, then one-versus-one
linear support vector machines among the languages of that family.

Features are hashed character 1- to 3-grams of the whole lower-cased text (other
than letters count as one blank), square-rooted and scaled to length 1.  The
classifiers are fitted on a bounded sample: the ``PER_LANGUAGE`` training
documents of each language with the smallest id hashes."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkjourney.llm.common import by_batch, shipped, tidy

DIMENSIONS = 1 << 12
#: Bound of the training sample, documents a language.
PER_LANGUAGE = 400
#: Families of ISO 639-1 codes; a language not listed is its own family.
FAMILIES = {
    "germanic": "de nl en sv da no nb nn is af fy lb yi", "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg", "baltic": "lt lv", "celtic": "ga gd cy br", "uralic": "fi et hu",
    "indic": "hi ur bn pa gu mr ne", "turkic": "tr az kk ky uz tk", "semitic": "ar he am mt", "dravidian": "ta te kn ml",
}


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes.split()), lang)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x10000)])


def features(text: str, letter: np.ndarray) -> np.ndarray:
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    low = c < 0x10000
    c = np.where(low & letter[np.where(low, c, 0).astype(np.int64)], c, np.where(low, 0, c))
    c = c[(c != 0) | (np.concatenate(([1], c[:-1])) != 0)]  # one blank between words
    total = np.zeros(DIMENSIONS, np.float32)
    gram = np.zeros(0, np.uint64)
    for n in (1, 2, 3):
        if len(c) < n:
            break
        gram = c.copy() if n == 1 else gram[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1:]
        slot = (gram * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(52)
        total += np.bincount(slot.astype(np.int64), minlength=DIMENSIONS).astype(np.float32)
    total = np.sqrt(total)
    return total / max(float(np.linalg.norm(total)), 1e-9)


def linear_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Weights (bias last) of the squared-hinge linear machine, classes weighted
    alike, by accelerated gradient descent; y is +1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    rate = 1.0 / (4.0 + penalty)  # rows have length sqrt(2) at most
    w = ahead = np.zeros(x.shape[1], np.float32)
    for k in range(steps):
        slack = np.maximum(0.0, 1.0 - y * (x @ ahead))
        new = ahead - rate * (penalty * ahead - 2.0 * x.T @ (weight * y * slack))
        ahead = new + k / (k + 3.0) * (new - w)
        w = new.astype(np.float32)
        ahead = ahead.astype(np.float32)
    return w


class Model:
    def __init__(self, x: np.ndarray, langs: list[str]):
        langs = np.array(langs, dtype=object)
        self.members: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            self.members.setdefault(family_of(lang), []).append(lang)
        family = np.array([family_of(v) for v in langs], dtype=object)
        one = lambda own, y: linear_svm(x[own], np.where(y[own], 1.0, -1.0).astype(np.float32))
        every = np.ones(len(x), bool)
        self.family = {f: one(every, family == f) for f in self.members} if len(self.members) > 1 else {}
        self.pairs = {(a, b): one((langs == a) | (langs == b), langs == a)
                      for names in self.members.values() for a, b in itertools.combinations(names, 2)}

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """Language and score: the family's share of the logistic margins times the
        language's mean logistic margin over its rivals within the family."""
        chance = lambda w: 1.0 / (1.0 + np.exp(-4.0 * float(w[:-1] @ x + w[-1])))
        if not self.members:
            return "und", 0.0
        score, family = 1.0, next(iter(self.members))
        if self.family:
            by = {f: chance(w) for f, w in self.family.items()}
            family = max(by, key=lambda f: (by[f], f))
            score = by[family] / max(sum(by.values()), 1e-12)
        names = self.members[family]
        if len(names) > 1:
            wins = dict.fromkeys(names, 0.0)
            for (a, b), w in ((k, w) for k, w in self.pairs.items() if k[0] in wins):
                p = chance(w)
                wins[a] += p / (len(names) - 1)
                wins[b] += (1.0 - p) / (len(names) - 1)
            lang = max(names, key=lambda v: (wins[v], v))
            return lang, float(min(1.0, score * wins[lang]))
        return names[0], float(min(1.0, score))


def held_out():
    """The id's CRC-32 is divisible by 5 (a null id is held out)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """The model of the labelled documents that are not held out, from the
    ``per_language`` ones of each language with the smallest id hashes."""
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(
        "lang is not null and text is not null").where(~held_out())
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # one row a language
    # hashes are uniform, so those below a bound are about as many as wanted: no language is sorted
    wanted = per_language + 6 * math.sqrt(per_language) + 20
    share = {lang: min(1.0, wanted / n) for lang, n in sizes.items()}
    found: dict[str, list] = {}
    todo = sorted(sizes)
    while todo:
        bound = F.create_map(*[F.lit(x) for v in todo for x in (v, min(2**63 - 1, int(share[v] * 2.0**64) - 2**63))])
        near = labelled.select("lang", F.xxhash64("doc_id").alias("h"), "doc_id").where(F.col("lang").isin(todo) & (F.col("h") <= bound[F.col("lang")]))
        rows = near.distinct().collect()  # about ``wanted`` a language
        for v in todo:
            found[v] = sorted((r["h"], r["doc_id"]) for r in rows if r["lang"] == v)[:per_language]
        todo = [v for v in todo if len(found[v]) < per_language and share[v] < 1.0]
        share |= {v: min(1.0, 2 * share[v]) for v in todo}
    ids = sorted({i for own in found.values() for _, i in own})  # bounded: per_language times the languages
    if not ids:
        return Model(np.zeros((0, DIMENSIONS), np.float32), [])

    def vectors(batches):
        letter = _letters()
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang": b["lang"],
                                "x": [features(t, letter).astype(np.float16).tobytes() for t in b["text"]]})

    rows = (labelled.where(F.col("doc_id").isin(ids)).distinct().mapInPandas(tidy(vectors), "doc_id long, lang string, x binary")
            .orderBy("doc_id", "lang").toPandas())
    x = np.stack([np.frombuffer(v, np.float16) for v in rows["x"]]).astype(np.float32)
    return Model(x, rows["lang"].tolist())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row.  A null text, or one without a
    letter, is ``und`` with score 0; so is every row if nothing could be learned.
    A null doc_id counts as held out; repeated rows repeat; an empty table gives no
    rows; lang, source and doc_id are no inputs of a prediction."""
    load = shipped(docs.sparkSession, model)

    def predict(batches):
        letter, fitted = _letters(), load()
        for b in batches:
            got = [fitted.predict(features(t, letter)) if has_letter(t) else ("und", 0.0) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"],
                                "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInPandas(tidy(predict), "doc_id long, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that have a language (not ``und``), all columns; ``lang``
    becomes the prediction, also where a label contradicts it.  If nothing could be
    learned, no language is known and all rows stay as they are."""
    if not model.members:
        return docs
    load = shipped(docs.sparkSession, model)

    def change():
        letter, fitted = _letters(), load()

        def step(batch, texts):
            got = [fitted.predict(features(t, letter))[0] if has_letter(t) else "und" for t in texts]
            at = batch.schema.get_field_index("lang")
            batch = batch.set_column(at, batch.schema.field(at), pa.array(got, batch.schema.field(at).type))
            return batch.filter(pa.array([g != "und" for g in got], pa.bool_()))

        return step

    return by_batch(docs, change)
