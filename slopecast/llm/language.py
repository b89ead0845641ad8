"""Hierarchical language identification: family first, then one-versus-one support vectors."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from slopecast.llm.common import map_batches, ship
from slopecast.llm.svm import fit_hinge, gram_codes, sigmoid, slices

UNDETERMINED = "und"
GRAM = 3
BITS = 15
#: Documents of one language that the model is fitted on; the rest of the labelled ones are not read for it.
SAMPLE_PER_LANGUAGE = 400
#: Scale of frequencies, and steepness of the score.
SCALE = 20.0
STEEP = 4.0
#: A document with a lower score is rejected: no family or language claims it.
MIN_SCORE = 0.5

# Families of languages by ISO 639-1 code; a language without one is a family of its own.
FAMILIES = {
    "germanic": ("da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "uralic": ("et", "fi", "hu"),
    "celtic": ("br", "cy", "ga", "gd"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
}
_FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes}
_LETTER = re.compile(r"[^\W\d_]")
_KEEP = np.full(256, 32, np.uint8)
_KEEP[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_KEEP[128:] = np.arange(128, 256)


def family_of(language: str) -> str:
    return _FAMILY_OF.get(language.lower().split("-")[0], language)


def _codes(text: str) -> Iterator[np.ndarray]:
    """Codes of the byte trigrams of lower-case letters; all else is a space, and trigrams around a space are left out."""
    data = _KEEP[np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass"), np.uint8)]
    for part in slices(data.tobytes(), GRAM):
        yield gram_codes(part, GRAM, BITS)[part[1:len(part) - 1] != 32]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(codes, scaled frequencies) of the whole text."""
    total = np.zeros(1 << BITS, np.int64)
    for codes in _codes(text):
        total += np.bincount(codes, minlength=1 << BITS)
    found = np.flatnonzero(total)
    return found, total[found] * (SCALE / max(1, total.sum()))


@dataclass
class Model:
    """Weight columns of the family models (one against the rest) and of the pairs within families."""

    families: list[str]
    members: dict[str, list[str]]
    pairs: list[tuple[str, str]] = field(default_factory=list)
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score). The family with the largest margin, then the language with the most
        pair wins (ties: margin sum, then name). The score is the logistic of the least deciding margin."""
        if not text or not self.families or not _LETTER.search(text):
            return UNDETERMINED, 0.0
        sums, n = np.zeros(len(self.bias)), 0
        for codes in _codes(text):
            sums += self.weights[codes].sum(axis=0)
            n += len(codes)
        margins = sums * (SCALE / max(1, n)) + self.bias
        own = margins[:len(self.families)]
        best = int(np.argmax(own)) if len(self.families) > 1 else 0
        least = own[best] if len(self.families) > 1 else np.inf
        languages = self.members[self.families[best]]
        wins = {x: 0 for x in languages}
        total = dict.fromkeys(languages, 0.0)
        beaten = {x: np.inf for x in languages}
        for (a, b), m in zip(self.pairs, margins[len(self.families):]):
            if a in wins:
                winner, loser = (a, b) if m >= 0 else (b, a)
                wins[winner] += 1
                total[winner] += abs(m)
                total[loser] -= abs(m)
                beaten[winner] = min(beaten[winner], abs(m))
        language = min(languages, key=lambda x: (-wins[x], -total[x], x))
        least = min(least, beaten[language])
        return language, float(sigmoid(STEEP * least)) if np.isfinite(least) else 1.0


def fit(examples: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """Model from (language, codes, values); no examples give a model that knows no language."""
    languages = sorted({x[0] for x in examples})
    families = sorted({family_of(x) for x in languages})
    members = {f: [x for x in languages if family_of(x) == f] for f in families}
    model = Model(families, members, [p for f in families for p in itertools.combinations(members[f], 2)])
    dims = 1 << BITS
    columns = []
    rows = [(c, v) for _, c, v in examples]
    names = np.array([x[0] for x in examples])
    kin = np.array([family_of(x) for x in names])

    def side(mask: np.ndarray, positive: np.ndarray) -> np.ndarray:
        picked = np.flatnonzero(mask)
        signs = np.where(positive[picked], 1.0, -1.0)
        share = np.where(signs > 0, (signs > 0).mean(), (signs < 0).mean())
        return fit_hinge([rows[k] for k in picked], signs, dims, cost_of=0.5 / np.maximum(share, 1e-9))

    for f in families:
        columns.append(side(np.ones(len(rows), bool), kin == f) if len(families) > 1 else np.zeros(dims + 1))
    for a, b in model.pairs:
        columns.append(side((names == a) | (names == b), names == a))
    both = np.array(columns).T if columns else np.zeros((dims + 1, 0))
    model.weights, model.bias = np.ascontiguousarray(both[:-1]), both[-1]
    return model


def learn(docs: DataFrame, allowed: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on up to `sample` labelled documents of each language, those with the least id hashes.

    allowed tells the rows that may be learned from. Rows without label, text or letter do not count.
    Counts cover all rows; the sample is thinned by hash before it is ranked, so a frequent language
    is never gathered in one task.
    """
    labelled = docs.where(allowed & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    unit = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    drawn = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), unit.alias("unit")).join(F.broadcast(sizes), "lang")
    thin = drawn.where(F.col("unit") * F.col("n") < 3.0 * sample).where(F.col("text").rlike(r"\p{L}"))
    thin = thin.groupBy("lang", "unit").agg(F.min("text").alias("text"))  # a repeated id counts once here
    ranked = thin.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("unit"))).where(F.col("place") <= sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([c.tolist() for c, _ in found], pa.list_(pa.int32())), pa.array([v.tolist() for _, v in found], pa.list_(pa.float32()))],
                names=["lang", "codes", "vals"],
            )

    rows = map_batches(ranked.select("lang", "text"), run, "lang string, codes array<int>, vals array<float>").collect()
    rows.sort(key=lambda r: (r["lang"], r["codes"], r["vals"]))  # the order of arrival must not matter
    return fit([(r["lang"], np.array(r["codes"], np.int64), np.array(r["vals"], np.float64)) for r in rows])


def identified(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """Column of (lang_pred, score) for the whole text."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # size: 2 ** BITS x (families + pairs)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([held.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    # else Spark would run it once for a filter on the result and again for the result
    return predict.asNondeterministic()(F.col(text_col))


def rejected(found: str) -> Column:
    """Whether a prediction is refused: no letter, or no model that claims the text."""
    return (F.col(f"{found}.lang_pred") == UNDETERMINED) | (F.col(f"{found}.score") < MIN_SCORE)


def of_known_language(docs: DataFrame, allowed: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose language the model accepts; a null language is filled with the predicted one."""
    model = learn(docs, allowed, text_col, lang_col, id_col)
    found = docs.withColumn("__found", identified(docs, model, text_col)).where(~rejected("__found"))
    return found.withColumn(lang_col, F.coalesce(F.col(lang_col), F.col("__found.lang_pred"))).select(*docs.columns)
