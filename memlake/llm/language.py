"""Language identification by a string kernel.

The kernel of two texts is the share of character n-grams of length 1 to 3 that are present in
both (blended spectrum, presence only, normalised). Nyström features over landmark texts stand in
for it, kernel ridge regression is fitted one language against the rest, and texts are scored a
batch at a time: presence x landmarks, kernel x weights.

Letters are compared in lower case; everything else is one separator. Letters beyond the 62 most
frequent of the landmarks share one code.

Defined results: null text, or text without a letter, is `und` with score 0, and so is every text
where no labelled row exists; repeated rows score alike; a row without a language or a text is not
learned from; rows without doc_id are neither learned from nor held out. Work is linear in a text.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from memlake.llm import rows, spans

#: Bound on the labelled rows of each language that a model learns from, about; and on landmarks.
PER_LANGUAGE, LANDMARKS = 300, 40
RIDGE = 0.05
BASE = 64
GRAMS = BASE + BASE**2 + BASE**3
UNKNOWN = "und"


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """(lang, text) of about so many learnable rows of each language, chosen by hash. One count per
    language passes the driver, and the rows chosen."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    shares = [F.lit(v) for lang, n in known.groupBy("lang").count().collect() for v in (lang, per_language / n)]
    point = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    picked = known.where(point < F.create_map(*shares)[F.col("lang")]) if shares else known.limit(0)
    picked = picked.select("lang", "doc_id", "text")
    return [(lang, text) for lang, _, text in sorted(map(tuple, picked.collect()))]


class Model:
    """Landmarks, languages and weights; its methods score texts."""

    def __init__(self, letters: np.ndarray, grams: np.ndarray, landmarks: np.ndarray,
                 norms: np.ndarray, languages: list[str]):
        self.letters, self.grams, self.landmarks = letters, grams, landmarks
        self.norms, self.languages = norms, languages
        self.weights, self.bias = None, None

    def kernel(self, texts: list[str]) -> np.ndarray:
        seen, norms = presence(texts, self.letters, self.grams)
        return (seen @ self.landmarks.T.astype(np.float32)) / np.maximum(norms[:, None] * self.norms, 1)

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.kernel(texts) @ self.weights + self.bias


def letter_codes(texts: list[str]) -> np.ndarray:
    """Codes of the characters below 2^16: 0 for others than letters, 1 for rare ones, then the frequent."""
    counts = np.zeros(1 << 16, np.int64)
    for t in texts:
        code = spans.codes(t.lower())
        counts += np.bincount(code[code < 1 << 16], minlength=1 << 16)
    letter = np.array([chr(i).isalpha() for i in range(1 << 16)])
    out = letter.astype(np.int32)
    counts[~letter] = 0
    frequent = np.argsort(-counts, kind="stable")[:BASE - 2]
    frequent = frequent[counts[frequent] > 0]
    out[frequent] = np.arange(2, len(frequent) + 2)
    return out


def gram_ids(text: str, letters: np.ndarray) -> list[np.ndarray]:
    """Ids of a text's n-grams by length; a run of other characters is one separator."""
    code = letters[np.minimum(spans.codes(text.lower()), (1 << 16) - 1)]
    if len(code):
        code = code[np.concatenate(([True], (code[1:] != 0) | (code[:-1] != 0)))]
    two = code[:-1] * BASE + code[1:]
    return [code, BASE + two, BASE + BASE**2 + two[:-1] * BASE + code[2:]]


def presence(texts: list[str], letters: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the given n-grams each text has, and the root of how many different ones it has."""
    seen, norms = np.zeros((len(texts), len(grams)), np.float32), np.zeros(len(texts), np.float32)
    flags = np.zeros(GRAMS, bool)
    for i, t in enumerate(texts):
        found = gram_ids(t, letters)
        for g in found:
            flags[g] = True
        seen[i] = flags[grams]
        norms[i] = np.sqrt(np.count_nonzero(flags))
        for g in found:
            flags[g] = False
    return seen, norms


def fit(labelled: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Fit on (lang, text) rows; landmarks are the first texts of each language, as sampled."""
    labelled = [(lang, t) for lang, t in labelled if any(c.isalpha() for c in t)]
    if not labelled:
        return None
    languages = sorted({lang for lang, _ in labelled})
    marks = [t for k in languages for t in [t for lang, t in labelled if lang == k][:landmarks]]
    letters = letter_codes(marks)
    flags = np.zeros(GRAMS, bool)
    for t in marks:
        for g in gram_ids(t, letters):
            flags[g] = True
    grams = np.flatnonzero(flags)
    at, norms = presence(marks, letters, grams)
    own = (at @ at.T) / (norms[:, None] * norms)
    value, vector = np.linalg.eigh(own.astype(np.float64))
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    model = Model(letters, grams, at.astype(np.uint8), norms, languages)
    texts = [t for _, t in labelled]
    x = np.concatenate([model.kernel(texts[i:i + 256]) for i in range(0, len(texts), 256)]) @ root
    x1 = np.hstack([x, np.ones((len(x), 1))])
    y = np.array([[lang == k for k in languages] for lang, _ in labelled], float)
    # every language weighs alike, however many rows it has
    w = (y / y.sum(0)).sum(1)[:, None] * len(y) / len(languages)
    solved = np.linalg.solve(x1.T @ (w * x1) + ridge * np.eye(x1.shape[1]), x1.T @ (w * y))
    model.weights, model.bias = (root @ solved[:-1]).astype(np.float32), solved[-1].astype(np.float32)
    return model


def predict(texts: list[str], model: Model | None) -> tuple[list[str], list[float]]:
    lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    where = [i for i, t in enumerate(texts) if any(c.isalpha() for c in t)] if model else []
    for at in range(0, len(where), 256):
        some = where[at:at + 256]
        out = model.scores([texts[i] for i in some])
        for i, row in zip(some, out):
            best = int(row.argmax())
            lang[i], score[i] = model.languages[best], float(np.clip(row[best], 0, 1))
    return lang, score


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred and score beside its own columns (replacing columns of these names)."""
    docs = docs.drop("lang_pred", "score")
    schema = StructType(list(docs.schema.fields)).add("lang_pred", "string").add("score", "double")

    def make():
        def work(cols):
            lang, score = predict(rows.texts(cols["text"]), model)
            return cols | {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())}

        return work

    return rows.map_batches(docs, schema, make)
