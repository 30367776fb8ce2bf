"""Language identification: the family first, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.llm.common import column, slices, written

UNKNOWN = "und"
#: Families by language code; the codes are ISO 639-1. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb yi".split(), "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk".split(), "indic": "hi bn pa gu mr ne ur".split(), "turkic": "tr az kk ky uz tt".split(),
    "semitic": "ar he am mt".split(), "uralic": "fi et hu".split(), "baltic": "lt lv".split(), "celtic": "ga gd cy br".split(),
    "dravidian": "ta te kn ml".split(), "austronesian": "id ms jv tl mg".split(), "iranian": "fa ps ku tg".split()}

BUCKETS = 2048
#: ASCII other than lower-case letters parts words; the bytes of other characters belong to them.
_PLAIN = bytes(b if 0x61 <= b <= 0x7A or b > 0x7F else 0x20 for b in range(256))
_ODD = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def family_of(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((name for name, codes in FAMILIES.items() if code in codes), f"own:{lang}")


def has_letters(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def profiles(texts: Sequence[str | None]) -> np.ndarray:
    """Unit vectors: square roots of the counts of the byte bigrams, trigrams and four-grams of whole texts, hashed to BUCKETS."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for i, text in enumerate(texts):
        if not text:
            continue
        b = np.frombuffer(b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_PLAIN).split()) + b" ", np.uint8).astype(np.uint32)
        places, gram = [], b
        for n, odd in enumerate(_ODD, 1):
            gram = (gram[:-1] << np.uint32(8)) | b[n:]
            places.append((gram * odd) >> np.uint32(21))
        root = np.sqrt(np.bincount(np.concatenate(places), minlength=BUCKETS))
        out[i] = root / max(np.sqrt((root * root).sum()), 1e-9)
    return out


@dataclass(frozen=True)
class Duel:
    """A linear machine between two classes, and the logistic curve of its margins on rows that it wasn't fitted on."""
    first: str
    second: str
    weights: np.ndarray
    offset: float
    slope: float
    shift: float


@dataclass(frozen=True)
class Model:
    """The machines between families, and for each family those between its languages."""
    families: dict[str, tuple[str, ...]]
    between: tuple[Duel, ...]
    within: dict[str, tuple[Duel, ...]]


def _decided(x: np.ndarray, names: Sequence[str], duels: Sequence[Duel]) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of the class with most duels won, ties by the sum of probabilities and then by order, and the mean
    probability of its duels."""
    votes, chances = np.zeros((len(x), len(names))), np.zeros((len(x), len(names)))
    for duel in duels:
        chance = 1 / (1 + np.exp(-np.clip(duel.slope * (x @ duel.weights + duel.offset) + duel.shift, -50, 50)))
        a, b = names.index(duel.first), names.index(duel.second)
        chances[:, a] += chance
        chances[:, b] += 1 - chance
        votes[:, a] += chance >= 0.5
        votes[:, b] += chance < 0.5
    best = np.argmax(votes * len(names) + chances, axis=1)
    return best, chances[np.arange(len(x)), best] / (len(names) - 1) if len(names) > 1 else np.ones(len(x))


def predicted(texts: Sequence[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    names, langs, scores = sorted(model.families), [UNKNOWN] * len(texts), np.zeros(len(texts))
    read = np.array([has_letters(t) for t in texts], bool)
    if not names or not read.any():
        return langs, scores
    x = profiles(texts)
    family, sure = _decided(x, names, model.between)
    for i, name in enumerate(names):
        rows = np.flatnonzero(read & (family == i))
        lang, chance = _decided(x[rows], model.families[name], model.within[name])
        scores[rows] = sure[rows] * chance
        for row, code in zip(rows, lang):
            langs[row] = model.families[name][code]
    return langs, np.clip(scores, 0, 1)


def held_out(doc_id: str = "doc_id") -> Column:
    """The documents that nothing may be learned from; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def _profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in slices(batches, "text"):
        texts = column(piece, "text").to_pylist()
        full = [i for i, t in enumerate(texts) if has_letters(t)]
        rows = piece.take(pa.array(full, pa.int64()))
        values = profiles([texts[i] for i in full])
        yield pa.RecordBatch.from_arrays(
            [column(rows, "lang"), column(rows, "pick"), pa.ListArray.from_arrays(np.arange(0, values.size + 1, BUCKETS, dtype=np.int32), pa.array(values.ravel()))],
            names=["lang", "pick", "values"])


def sampled(docs: DataFrame, per_lang: int) -> DataFrame:
    """lang, pick, values: profiles of up to `per_lang` labelled documents of each language, those with the smallest hashes, written."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("lang", F.xxhash64("doc_id", "text").alias("pick"), "text")
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, 1.5 * per_lang / n + 20.0 / n))) for lang, n in sizes.items()], F.lit(0.0))
    some = labelled.where(F.pmod("pick", F.lit(1 << 30)) < share * (1 << 30)).mapInArrow(_profiled, "lang string, pick long, values array<float>")
    order = W.partitionBy("lang").orderBy("pick")
    return written(written(some.dropDuplicates(["lang", "pick"])).withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_lang).drop("place"))


def _duel(rows: DataFrame, first: str, second: str) -> Duel:
    """rows: class, pick, features. A quarter of the rows, by hash, is left for the curve of the margins."""
    both = rows.where(F.col("class").isin(first, second)).withColumn("label", (F.col("class") == first).cast("double"))
    apart = F.pmod(F.shiftright("pick", 32), F.lit(4)) == 0
    fitted = LinearSVC(maxIter=20, tol=1e-3, regParam=1e-4, standardization=False).fit(both.where(~apart))
    margins = fitted.transform(both.where(apart)).select("label", vector_to_array("rawPrediction")[1].alias("margin"))
    seen = margins.agg(F.countDistinct("label")).first()[0]
    slope, shift = 2.0, 0.0  # of a sample too small to be parted
    if seen == 2:
        curve = LogisticRegression(featuresCol="margins", maxIter=12, tol=1e-4, regParam=1e-3, standardization=False).fit(margins.select("label", array_to_vector(F.array("margin")).alias("margins")))
        slope, shift = float(curve.coefficients[0]), float(curve.intercept)
    return Duel(first, second, fitted.coefficients.toArray().astype(np.float32), float(fitted.intercept), max(slope, 1e-6), shift)


def learned(docs: DataFrame, per_lang: int = 1000) -> Model:
    """Fits on the labelled documents that are not held out; docs: doc_id, lang, text."""
    sample = sampled(docs, per_lang)
    langs = sorted(r.lang for r in sample.select("lang").distinct().collect())
    families: dict[str, tuple[str, ...]] = {}
    for lang in langs:
        families[family_of(lang)] = (*families.get(family_of(lang), ()), lang)
    rows = sample.select("lang", "pick", array_to_vector(F.col("values").cast("array<double>")).alias("features"))
    named = F.coalesce(*[F.when(F.col("lang").isin(*members), name) for name, members in families.items()], F.lit(""))
    between = tuple(_duel(rows.withColumn("class", named), a, b) for a, b in combinations(sorted(families), 2))
    within = {name: tuple(_duel(rows.withColumn("class", F.col("lang")), a, b) for a, b in combinations(members, 2)) for name, members in families.items()}
    return Model(families, between, within)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = 1000) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Linear machines between language families choose one, and machines between each two of its languages the language, by most
    duels won. The score is the product of the mean calibrated probabilities of the winner's duels in both steps. Only the text of
    a document counts. Learned from: text and lang of documents with a label whose id's CRC-32 does not leave 1 modulo 3, at most
    `per_lang` of each language, chosen by hash over all of them, whole texts. The share of texts read for the sample follows the
    counts, so its work does not grow with the table; the model has 8 KB a pair of classes.

    Scale: a text is read where it lies, nothing is shuffled but the sample.

    A null text, an empty one and one without letters is `und` with score 0, and so is all where nothing can be learned. A null
    doc_id is not held out and not learned from. Equal rows get equal results, each its own row. Other columns are not read.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    model = learned(plain, per_lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices((b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)), "text"):
            langs, scores = predicted(column(piece, "text").to_pylist(), model)
            yield pa.RecordBatch.from_arrays(
                [column(piece, "doc_id"), column(piece, "held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"])

    return plain.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
