"""Hierarchical language identification.

A text is its frequencies of hashed three-byte runs (lower case; all but letters count as
space), as square roots, so each text is a unit vector. One-versus-one linear support
vector machines tell the family, then those of the family tell its languages. They are
fitted on the driver on at most about ``FIT_ROWS`` hash-chosen labelled documents of each
language; everything else covers every row, in one pass without a shuffle.

Defined cases: a null text and a text without a letter are ``und`` with score 0; where
nothing is labelled, all are; more than ``MOST_LANGUAGES`` languages raise; with one learned language every text with a letter is of it;
an unknown language code is a family of its own; repeated rows and null ids change
nothing; other columns are passed through by ``predict`` and not read otherwise.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_rows, text_bytes, trimmed

FIT_ROWS = 600
DIMS = 4096
#: Bytes of text and number of texts that are turned into vectors at once.
SLICE_BYTES, SLICE_TEXTS = 1 << 20, 256
#: Languages at most: their machines grow with the square of their number.
MOST_LANGUAGES = 500
UNKNOWN = "und"
EPOCHS, PENALTY = 300, 1e-4
# Families of ISO 639-1 codes.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "an ca co es fr gl it la oc pt ro sc",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "indic": "bn gu hi mr ne pa sa si ur",
    "turkic": "az kk ky tk tr tt uz",
    "semitic": "am ar he mt",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_LETTER = re.compile(r"[^\W\d_]")
_KEPT = np.full(256, 0x20, dtype=np.uint8)
_KEPT[97:123] = np.arange(97, 123)
_KEPT[128:] = np.arange(128, 256)


def _slots(raw: np.ndarray) -> np.ndarray:
    """The feature of each run of three bytes."""
    raw = raw.astype(np.uint32)
    run = (raw[:-2] * np.uint32(65_536) + raw[1:-1] * np.uint32(256) + raw[2:]) * np.uint32(2_654_435_761)
    return (run >> np.uint32(20)).astype(np.int64)  # 12 bits: DIMS


def features(texts: pa.Array) -> np.ndarray:
    """A unit vector for each text, all zeros without three bytes in a row; ``SLICE_BYTES`` are at work at once."""
    raw, offsets = text_bytes(pc.utf8_lower(texts))
    out = np.zeros((len(offsets) - 1, DIMS), dtype=np.float32)
    i = 0
    while i < len(out):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, side="right")) - 1)
        first, stop = int(offsets[i]), int(offsets[j])
        if stop - first > SLICE_BYTES:  # one long text, in pieces that overlap by two bytes
            pieces = (raw[k : min(k + SLICE_BYTES + 2, stop)] for k in range(first, stop - 2, SLICE_BYTES))
            count = sum(np.bincount(_slots(_KEPT[p]), minlength=DIMS) for p in pieces)
            out[i] = np.sqrt(count / (stop - first - 2))
        elif stop - first >= 3:
            slot = _slots(_KEPT[raw[first:stop]])
            for k in range(i, j):
                a, b = int(offsets[k]) - first, int(offsets[k + 1]) - first
                if b - a >= 3:
                    out[k] = np.sqrt(np.bincount(slot[a : b - 2], minlength=DIMS) / (b - 2 - a))
        i = j
    return out


def fit_svm(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, float]:
    """A linear SVM that tells ``first`` from ``second`` by subgradient steps on the mean hinge loss, both weighing the same; returns the averaged weights and bias."""
    w, b, mean_w, mean_b = np.zeros(first.shape[1], np.float32), 0.0, np.zeros(first.shape[1]), 0.0
    own, other = np.float32(0.5 / max(1, len(first))), np.float32(-0.5 / max(1, len(second)))
    for t in range(1, EPOCHS + 1):
        pull, push = own * (first @ w + b < 1), other * (second @ w + b > -1)
        rate = 20.0 / (1 + 0.05 * t)
        w = np.float32(1 - rate * PENALTY) * w + np.float32(rate) * (pull @ first + push @ second)
        b += 0.1 * rate * float(pull.sum() + push.sum())
        if 2 * t > EPOCHS:
            mean_w, mean_b = mean_w + w, mean_b + b
    return mean_w / (EPOCHS - EPOCHS // 2), mean_b / (EPOCHS - EPOCHS // 2)


class OneVersusOne:
    """Votes of a machine for each pair of classes; the margin of the winner's closest duel makes the confidence.

    The rows of a class follow each other, so that machines are fitted on views of ``x``.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.classes, starts = ([], []) if not len(y) else (part.tolist() for part in np.unique(y, return_index=True))
        stops = {a: b for a, b in zip(sorted(starts), [*sorted(starts)[1:], len(y)])}
        runs = [x[a : stops[a]] for a in starts]
        self.pairs = list(combinations(range(len(self.classes)), 2))
        fits = [fit_svm(runs[i], runs[j]) for i, j in self.pairs]
        self.w = np.array([w for w, _ in fits], dtype=np.float32).reshape(len(fits), x.shape[1])
        self.b = np.array([b for _, b in fits], dtype=np.float32)

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the class and a confidence in 0.5..1 for each row."""
        n, k = len(x), len(self.classes)
        wins, least, total = np.zeros((n, k)), np.full((n, k), np.inf), np.zeros((n, k))
        margins = x @ self.w.T + self.b
        for (i, j), m in zip(self.pairs, margins.T):
            wins[:, i] += m > 0
            wins[:, j] += m <= 0
            for c, s in ((i, m), (j, -m)):
                total[:, c] += s
                least[:, c] = np.minimum(least[:, c], s)
        best = np.argmax(wins + 1e-3 * np.tanh(total), axis=1)
        margin = least[np.arange(n), best]
        return best, np.maximum(0.5, 1 / (1 + np.exp(-2 * np.minimum(margin, 50))))


def by_family(lang: str) -> tuple[str, str]:
    return FAMILY_OF.get(lang, lang), lang


class LanguageModel:
    """The family machines and, for each family, its language machines; rows are in the order of ``by_family``."""

    def __init__(self, x: np.ndarray, langs: np.ndarray):
        family = np.array([by_family(v)[0] for v in langs.tolist()], dtype=object)
        self.families = OneVersusOne(x, family)
        self.within = {}
        for f in self.families.classes:
            at = np.flatnonzero(family == f)
            own = slice(at[0], at[-1] + 1)
            self.within[f] = OneVersusOne(x[own], langs[own])

    def __call__(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for i in range(0, len(texts), SLICE_TEXTS):
            own = self._some(texts.slice(i, SLICE_TEXTS))
            names += own[0]
            scores += own[1]
        return names, scores

    def _some(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        n = len(texts)
        names, scores = np.full(n, UNKNOWN, dtype=object), np.zeros(n)
        lettered = np.array([t is not None and _LETTER.search(t) is not None for t in texts.to_pylist()], dtype=bool)
        if self.families.classes:
            x = features(texts)
            family, sure = self.families(x)
            for f, name in enumerate(self.families.classes):
                pick = np.flatnonzero(lettered & (family == f))
                if len(pick):
                    lang, own = self.within[name](x[pick])
                    names[pick] = np.array(self.within[name].classes, dtype=object)[lang]
                    scores[pick] = sure[pick] * own
        return names.tolist(), scores.tolist()


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", fit_rows: int = FIT_ROWS, seed: int = 5) -> LanguageModel:
    """A model of ``labelled`` rows with a language: about ``fit_rows`` of each, chosen by hash of the id."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return LanguageModel(np.zeros((0, DIMS), np.float32), np.array([], dtype=object))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, float(fit_rows) / n)])

    def vectors(batches):
        with trimmed():
            for batch in batches:
                for i in range(0, batch.num_rows, SLICE_TEXTS):
                    texts, langs = (batch.column(c).slice(i, SLICE_TEXTS) for c in ("text", "lang"))
                    x = features(texts).astype(np.float16)
                    keep = [k for k, t in enumerate(texts.to_pylist()) if _LETTER.search(t)]
                    yield pa.RecordBatch.from_arrays([langs.take(pa.array(keep, pa.int64())), pa.array([x[k].tobytes() for k in keep], pa.binary())], names=["lang", "x"])

    drawn = arrow_rows(rows).where(draw < rate[F.col("lang")]).select("lang", "text").mapInArrow(vectors, "lang string, x binary").collect()
    with trimmed():
        drawn.sort(key=lambda r: (by_family(r["lang"]), bytes(r["x"])), reverse=True)
        langs = np.array([r["lang"] for r in reversed(drawn)], dtype=object)
        x = np.empty((len(drawn), DIMS), dtype=np.float32)
        for i in range(len(x)):
            x[i] = np.frombuffer(drawn.pop()["x"], np.float16)  # each row goes when it is copied
        return LanguageModel(x, langs)


def predict(df: DataFrame, model: LanguageModel, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``df`` with the predicted language and its score; columns of those names are replaced."""
    df = arrow_rows(df).drop(pred_col, score_col)
    names = df.columns
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded: a weight for each dimension and pair

    def one(batches):
        with trimmed():
            for batch in batches:
                lang, score = shared.value(batch.column(text_col))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, pred_col, score_col])

    schema = T.StructType([*df.schema.fields, T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())])
    return df.mapInArrow(one, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
