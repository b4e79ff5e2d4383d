"""Language identification by hierarchical discrimination.

First the language family is predicted, then one-versus-one linear support vector machines separate
the languages within it. Features are the relative frequencies of byte trigrams of the lower-cased
text, hashed to DIMS places. Training takes a bounded sample (PER_LANGUAGE texts of each language with
the smallest hashes of their ids); prediction reads every text whole.

Defined results: texts that are null or hold no letter are `und` with score 0; rows without a language
are not learned from; repeated rows get equal results; an empty training set makes every text `und`; texts of any
length are read whole; an empty table gives an empty one. Other columns, such as lang or source, are never inputs of
a prediction; one named as a result is an error. The driver trains a machine for each pair of families, and of
languages within a family, so a corpus should hold languages by the hundred at most.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import dropped, extended, written

DIMS = 1 << 13
#: Bound of the training sample: texts per language.
PER_LANGUAGE = 1200
#: Bytes handled at once in prediction; longer texts are summed over several such parts.
CHUNK = 1 << 20
UNKNOWN = "und"

#: Families of common languages; any other language is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "turkic": ("tr", "az", "kk", "uz"),
    "uralic": ("fi", "et", "hu"),
    "indic": ("hi", "bn", "mr", "ur", "pa", "gu"),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}

_LETTER = regex.compile(r"\p{L}").search
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[48:58] = 48
_FOLD[[9, 10, 11, 12, 13]] = 32


def codes(data: bytes) -> np.ndarray:
    """The hashed place of each byte trigram."""
    x = _FOLD[np.frombuffer(data, np.uint8)]
    if len(x) < 3:
        x = np.concatenate([x, np.full(3 - len(x), 32, np.uint32)])
    with np.errstate(over="ignore"):
        tri = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
        return (tri * np.uint32(2654435761)) >> np.uint32(32 - DIMS.bit_length() + 1)


#: A sparse feature vector: places and values.
Sparse = tuple[np.ndarray, np.ndarray]


def train_svm(rows: list[Sparse], y: np.ndarray, c: float = 10.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """A linear support vector machine (hinge loss) by dual coordinate descent over sparse rows; y is +1 or -1. The weights and the bias."""
    n = len(rows)
    w, bias, alpha = np.zeros(DIMS), 0.0, np.zeros(n)
    norm = [float(v @ v) + 1 for _, v in rows]
    bound = np.where(y > 0, c * n / 2 / max(1, (y > 0).sum()), c * n / 2 / max(1, (y < 0).sum()))
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(n).tolist():
            at, v = rows[i]
            a = min(max(alpha[i] + (1 - y[i] * (float(w[at] @ v) + bias)) / norm[i], 0.0), bound[i])
            change = a - alpha[i]
            if change:
                w[at] += change * y[i] * v
                bias += change * y[i]
                moved = max(moved, abs(change) / bound[i])
                alpha[i] = a
        if moved < 1e-3:
            break
    return w, bias


@dataclass
class Model:
    """Weights of all pairwise machines: over families first, then over the languages of each family."""

    families: list[str] = field(default_factory=list)
    languages: dict[str, list[str]] = field(default_factory=dict)
    #: machines as (group, i, j): group "" compares families, other groups the languages of that family
    machines: list[tuple[str, int, int]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((DIMS, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def decide(self, group: str, names: list[str], margins: np.ndarray) -> tuple[str, float]:
        """The name that wins most machines of a group, sums of margins break ties; the score is its mean chance to win."""
        if len(names) == 1:
            return names[0], 1.0
        votes, total, chance = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names))
        for k, (g, i, j) in enumerate(self.machines):
            if g == group:
                m = margins[k]
                p = 1 / (1 + np.exp(-3 * np.clip(m, -20, 20)))
                votes[i if m >= 0 else j] += 1
                total[i] += m
                total[j] -= m
                chance[i] += p
                chance[j] += 1 - p
        best = max(range(len(names)), key=lambda i: (votes[i], total[i], -i))
        return names[best], float(chance[best] / (len(names) - 1))

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """A row of margins per text: the mean over its trigrams of each machine's weights, and the bias."""
        out = np.zeros((len(texts), len(self.machines)))
        i = 0
        while i < len(texts):
            part, size = [], 0
            while i < len(texts) and (not part or size + len(texts[i]) <= CHUNK):
                part.append(texts[i])
                size += len(texts[i])
                i += 1
            first = i - len(part)
            if size > CHUNK:  # one long text, in parts that overlap by two bytes
                t, total, n = part[0], 0, 0
                for s in range(0, max(1, len(t) - 2), CHUNK):
                    c = codes(t[s : s + CHUNK + 2])
                    total, n = total + self.weights[c].sum(0, dtype=np.float64), n + len(c)
                out[first] = total / n + self.bias
                continue
            each = [codes(t) for t in part]
            n = np.array([len(c) for c in each])
            flat = self.weights[np.concatenate(each)]
            ends = np.concatenate([[0], np.cumsum(n)[:-1]])
            out[first:i] = np.add.reduceat(flat, ends, axis=0, dtype=np.float64) / n[:, None] + self.bias
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.families:
            return langs, scores
        rows = [k for k, t in enumerate(texts) if t and _LETTER(t)]
        if not rows:
            return langs, scores
        m = self.margins([texts[k].encode("utf-8", "replace") for k in rows])
        for k, margins in zip(rows, m, strict=True):
            family, p = self.decide("", self.families, margins)
            langs[k], q = self.decide(family, self.languages[family], margins)
            scores[k] = p * q
        return langs, scores


def sample(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(language, places, values) of the training sample: for each language the rows with the smallest hashed ids."""
    own = Window.partitionBy(lang).orderBy(F.xxhash64(F.col(key).cast("string")), key)
    usable = docs.where(train & F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0))
    # a hash lets through about three times as many ids as are wanted, so few are ranked however many rows there are
    rate = usable.groupBy(lang).agg(F.least(F.lit(1.0), 3.0 * per_language / F.count(F.lit(1)) + 1e-9).alias("_rate"))
    # both tables are written, so Spark knows their sizes and sends them to every task only if they are small
    rate = written(rate, "rates", clean=False)
    some = usable.select(key, lang).join(rate, lang).where(F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string"), F.lit(1)), 11).cast("double") / float(1 << 53) <= F.col("_rate"))
    ids = some.select(key, lang).withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= per_language).select(key).distinct()
    ids = written(ids, "sample-ids", clean=False)
    chosen = usable.join(ids, key, "left_semi").select(lang, text)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, places, values = [], [], []
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not _LETTER(t):
                    continue
                counts = np.bincount(codes(t.encode("utf-8", "replace")), minlength=DIMS)
                at = np.flatnonzero(counts)
                langs.append(name)
                places.append(at.astype(np.int32))
                values.append((counts[at] / counts.sum()).astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], names=["lang", "places", "values"])

    rows = chosen.mapInArrow(features, "lang string, places array<int>, values array<float>").toArrow()
    dropped(rate, ids)
    return [(name, at.values.to_numpy(), v.values.to_numpy()) for name, at, v in zip(rows.column(0).to_pylist(), rows.column(1), rows.column(2), strict=True)]


def fit(examples: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """The two-level model of a training sample of (language, places, values)."""
    if not examples:
        return Model()
    # an order of the examples that does not depend on how Spark delivered them
    examples = sorted(examples, key=lambda e: (zlib.crc32(e[1].tobytes() + e[2].tobytes()), e[0]))
    names = np.array([name for name, _, _ in examples])
    # frequencies are small numbers: they are scaled so that a typical text has length one
    scale = 1 / max(1e-9, float(np.median([np.linalg.norm(v) for _, _, v in examples])))
    rows = [(at, v * np.float32(scale)) for _, at, v in examples]
    family = np.array([FAMILY_OF.get(n, n) for n in names])
    model = Model(families=sorted(set(family.tolist())))
    weights, bias = [], []
    for group, labels, members in [("", family, model.families), *((f, names, sorted(set(names[family == f].tolist()))) for f in model.families)]:
        if group:
            model.languages[group] = members
        for i, j in combinations(range(len(members)), 2):
            of = np.flatnonzero((labels == members[i]) | (labels == members[j])).tolist()
            w, b = train_svm([rows[k] for k in of], np.where(labels[of] == members[i], 1.0, -1.0))
            model.machines.append((group, i, j))
            weights.append(w * scale)
            bias.append(b)
    if weights:
        model.weights, model.bias = np.stack(weights, 1).astype(np.float32), np.array(bias)
    return model


def identify(docs: DataFrame, model: Model, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """docs with the predicted language and a score from 0 to 1. The model (a few machines of DIMS weights) goes with the tasks."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = shared.value.predict(b.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, lang_out, score_out])

    for name in (lang_out, score_out):
        if name in docs.columns:
            raise ValueError(f"column {name} exists; choose another name")
    return docs.mapInArrow(run, extended(docs.schema, **{lang_out: "string", score_out: "double"}))
