"""Language identification in two steps: the family first, then the language within it.

A text is the counts of its letter sequences: lower-cased runs of letters, each between blanks,
give runs of one to ``LONGEST`` characters, which are hashed to ``WIDTH`` places. The features are
the logarithms of the counts, scaled to length 1. The whole text is counted, ``STEP`` characters
at a time.

Languages belong to families (``FAMILIES``; a language not listed is a family of its own, a tag
like ``en-GB`` goes by its first part). Linear support vector machines, fitted by Spark ML,
separate each pair of families, and each pair of languages of one family. The family with the
most votes is chosen, then the language with the most votes among those of the family; equal
votes go by the sum of margins, then by name. The score is the mean of the winner's logistic
margins against its rivals, of both steps, multiplied.

Fitting takes a bounded sample: ``per_language`` documents of each language, those with the
smallest hashes of their id, so that a task that runs again draws the same. All else is one pass
over the documents in which no row moves. The machines of all pairs are broadcast: ``WIDTH``
numbers (32 KB) each, as many as there are pairs of related languages.

Defined results: a null text and one without a letter are ``und`` with score 0, and so is every
text when nothing could be learnt. Where one language alone is learnt, every text with a letter
is of that language, with score 1. Documents without language, id or letters aren't learnt from.
Repeated rows are rows of their own. An empty table gives no rows. Other columns are carried on;
one named as a result is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmatch.config import materialize, ship_package
from textmatch.llm.common import join_groups, mix64, rows_with, table

WIDTH = 4096
LONGEST = 3
STEP = 1 << 20
PER_LANGUAGE = 500
UNKNOWN = "und"

# ISO 639 codes of languages by family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo af lb fy yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk tt",
    "indo-aryan": "hi bn ur mr gu pa ne si",
    "iranian": "fa ps ku tg",
    "dravidian": "ta te kn ml",
    "semitic": "ar he mt am",
    "sinitic": "zh yue wuu",
    "austronesian": "id ms jv tl",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_SHIFT = np.uint64(65 - WIDTH.bit_length())
_SEEDS = mix64(np.arange(LONGEST + 1, dtype=np.uint64))
_LETTERS = re.compile(r"[^\W\d_]+")


def family_of(lang: str) -> str:
    return _FAMILY.get(re.split("[-_]", lang.lower())[0], lang)


def counts(text: str | None) -> np.ndarray | None:
    """How often each hashed letter sequence occurs; None without a letter."""
    found = None
    rest = text or ""
    for start in range(0, len(rest), STEP):
        words = _LETTERS.findall(rest[start : start + STEP].lower())
        # Signs like a raised two or a half are in such runs, but aren't letters.
        if not any(any(map(str.isalpha, w)) for w in words):
            continue
        run = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
        found = np.zeros(WIDTH, np.int64) if found is None else found
        value = np.zeros(len(run), np.uint64)
        for n in range(1, LONGEST + 1):
            # One more character: 21 bits hold any.
            value = (value[: len(run) - n + 1] << np.uint64(21)) | run[n - 1 :]
            place = mix64(value ^ _SEEDS[n]) >> _SHIFT
            found += np.bincount(place.astype(np.int64), minlength=WIDTH)
    return found


def features(text: str | None) -> np.ndarray | None:
    found = counts(text)
    if found is None:
        return None
    weight = np.log1p(found)
    return weight / np.sqrt(weight @ weight)


@dataclass(frozen=True)
class Machines:
    """One-versus-one separators of some classes, in the order of their names."""

    classes: tuple[str, ...]
    weights: np.ndarray  # (pairs, WIDTH): positive for the first of a pair
    offsets: np.ndarray

    def choose(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The winning class and its score for each row of features."""
        n = len(self.classes)
        votes, sums, odds = (np.zeros((len(rows), n)) for _ in range(3))
        margins = rows @ self.weights.T + self.offsets
        for (a, b), m in zip(combinations(range(n), 2), margins.T):
            votes[:, a] += m >= 0
            votes[:, b] += m < 0
            sums[:, a] += m
            sums[:, b] -= m
            # A margin of one, where the machine leaves no slack, counts as 0.88.
            odds[:, a] += 1 / (1 + np.exp(np.clip(-2 * m, -50, 50)))
            odds[:, b] += 1 / (1 + np.exp(np.clip(2 * m, -50, 50)))
        best = np.lexsort((np.broadcast_to(-np.arange(n), votes.shape), sums, votes), axis=1)[:, -1]
        score = odds[np.arange(len(rows)), best] / max(1, n - 1) if n > 1 else np.ones(len(rows))
        return best, score


@dataclass(frozen=True)
class LanguageModel:
    families: Machines
    languages: dict[str, Machines]

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], list[float]]:
        found, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        some = [(i, x) for i, x in enumerate(map(features, texts)) if x is not None]
        if not some or not self.families.classes:
            return found, score
        at = np.array([i for i, _ in some])
        rows = np.stack([x for _, x in some])
        family, sure = self.families.choose(rows)
        for f, name in enumerate(self.families.classes):
            mine = np.flatnonzero(family == f)
            if len(mine):
                inner = self.languages[name]
                lang, more = inner.choose(rows[mine])
                for i, x, p in zip(at[mine].tolist(), lang.tolist(), (sure[mine] * more).tolist()):
                    found[i], score[i] = inner.classes[x], p
        return found, score


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> DataFrame:
    """(lang, body): of each language the ``per_language`` documents with the least hashes.

    A hash below twice the share that is wanted leaves a bounded number of candidates of each
    language, however frequent, before they are ranked. Only ids are ranked; texts come last.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{lang_col}`").cast("string").alias("lang"),
        F.col(f"`{text_col}`").alias("body"),
    ).where("id IS NOT NULL AND lang IS NOT NULL")
    rows = rows.where(F.col("body").rlike(r"\p{L}"))
    ids = materialize(rows.select("id", "lang", F.xxhash64("id").alias("hash")), "labelled")
    sizes = ids.groupBy("lang").agg(F.count("*").alias("n"))
    sizes = materialize(sizes.withColumn("share", 2 * per_language / F.col("n")), "languages")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    part = (F.col("hash") / float(1 << 64)) + 0.5
    near = join_groups(ids, sizes, ["lang"], total).where(part < F.col("share"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "id"))
    chosen = near.withColumn("place", place).where(F.col("place") <= per_language)
    return rows.join(F.broadcast(chosen.select("id", "lang").distinct()), ["id", "lang"], "left_semi")


def _machines(rows: DataFrame, label: str, classes: list[str]) -> Machines:
    """Fit one separator for each pair of ``classes``."""
    from pyspark.ml.classification import LinearSVC

    weights, offsets = [], []
    for a, b in combinations(classes, 2):
        pair = rows.where(F.col(label).isin(a, b))
        pair = pair.select((F.col(label) == a).cast("double").alias("label"), "features")
        fitted = LinearSVC(maxIter=50, regParam=1e-3, standardization=False).fit(pair)
        weights.append(fitted.coefficients.toArray())
        offsets.append(fitted.intercept)
    return Machines(tuple(classes), np.array(weights).reshape(-1, WIDTH), np.array(offsets))


def learn(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = PER_LANGUAGE,
) -> LanguageModel:
    """Fit on a bounded sample of the documents with a language."""
    from pyspark.ml.functions import array_to_vector

    ship_package(docs.sparkSession)

    def run(columns: list[pa.Array]) -> list[pa.Array]:
        return [pa.array([features(x) for x in columns[0].to_pylist()], pa.list_(pa.float64()))]

    field = T.StructField("numbers", T.ArrayType(T.DoubleType()))
    chosen = sample(docs, id_col, text_col, lang_col, per_language)
    rows = rows_with(chosen, ["body"], [field], run, carry=["lang"], slice_rows=64)
    rows = materialize(rows.where("numbers IS NOT NULL"), "letters")
    langs = sorted(r.lang for r in rows.select("lang").distinct().collect())
    names: dict[str, list[str]] = {}
    for lang in langs:
        names.setdefault(family_of(lang), []).append(lang)
    pairs = [F.lit(x) for lang in langs for x in (lang, family_of(lang))]
    family = F.element_at(F.create_map(*pairs), F.col("lang")) if langs else F.lit("")
    rows = rows.select("lang", family.alias("family"), array_to_vector("numbers").alias("features"))
    return LanguageModel(
        _machines(rows, "family", sorted(names)),
        {f: _machines(rows, "lang", own) for f, own in names.items()},
    )


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", carry=None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def run(columns: list[pa.Array]) -> list[pa.Array]:
        lang, score = handle.value.predict(columns[0].to_pylist())
        return [pa.array(lang, pa.string()), pa.array(score, pa.float64())]

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return rows_with(docs, [text_col], fields, run, carry, slice_rows=64)


def held_out(doc_id: str = "doc_id", folds: int = 5):
    """Whether a document belongs to the fold that is never learnt from; a null id doesn't."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(False))


def op13_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & ~held_out())
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return identify(rows, learn(known), carry=["doc_id", "held_out"])
