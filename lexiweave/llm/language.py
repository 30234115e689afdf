"""Language identification: multinomial naive Bayes over hashed character n-grams.

Fit: the labelled documents of the training fold are thinned to about ``SAMPLE_DOCS`` by a hash of doc_id (a
documented bound on the fit alone), n-grams are counted per language and bucket in a fixed number of tasks, and the smoothed
log-probabilities form one float32 matrix (2^15 x languages) that is broadcast: its size does not depend on the corpus.
Score: whole texts, a window of characters at a time that carries the last n - 1 on, so every n-gram counts once; each window's n-grams
gather rows of the matrix and are summed per document in numpy. The posterior tempers the evidence to that of ``EVIDENCE``
n-grams, so mixed or odd texts do not all end at 1.

Cases: a null text or one without a letter is ``und`` with score 0; no training rows at all leave every text
``und`` with score 0; null labels are never learned; ties go to the first language in code-point order;
repeated rows get equal answers; extra columns are kept by ``identify`` and ignored by the query.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .shared import ship, tidy

SAMPLE_DOCS = 20_000
BUCKET_BITS = 15
ORDERS = (1, 2, 3)
SMOOTH = 0.5
EVIDENCE = 40.0
#: Characters scored at a time, and tasks that count the sample.
WINDOW = 400_000
FIT_TASKS = 16


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_prior: object
    log_prob: object


_letters: list = []


def _letter_table():
    import numpy as np

    if not _letters:
        table = np.zeros(0x110000, bool)
        table[[c for c in range(0x110000) if chr(c).isalpha()]] = True
        _letters.append(table)
    return _letters[0]


def gram_windows(text: str):
    """(hash buckets of n-grams, number of letters) of text, WINDOW characters at a time; each n-gram counts once, in the window of its last character.

    Characters that are no letters are one mark each run, and one mark stands before the first word."""
    import numpy as np

    text = text.lower()
    code, after_letter = np.empty(0, np.uint32), False
    for at in range(0, len(text), WINDOW):
        raw = np.frombuffer(text[at : at + WINDOW].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letter_table()[raw]
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # the first mark after a word stays
        keep[0] |= after_letter
        after_letter = bool(letter[-1])
        new = np.where(letter, raw, 32)[keep].astype(np.uint32)
        if not len(new):
            continue
        before = code[max(0, len(code) - max(ORDERS) + 1) :]
        if not len(before):
            new = np.concatenate([[np.uint32(32)], new])
        code = np.concatenate([before, new])
        h, found = np.zeros(len(code), np.uint32), []
        for order in range(1, max(ORDERS) + 1):
            h = (h[: max(0, len(code) - order + 1)] * np.uint32(0x9E3779B1)) ^ (code[order - 1 :] * np.uint32(0x85EBCA6B) + np.uint32(order))
            if order in ORDERS:
                own = h[max(0, len(before) - order + 1) :]
                found.append(((own ^ (own >> np.uint32(15))) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BUCKET_BITS))
        yield np.concatenate(found), int(letter.sum())


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from: labelled, and crc32 of doc_id's text not 1 modulo 3."""
    return docs.where("lang is not null and text is not null and not held_out")


def with_fold(docs: DataFrame) -> DataFrame:
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)))


def fit(docs: DataFrame, sample: int = SAMPLE_DOCS) -> Model:
    """Model of docs(doc_id, text, lang)."""
    import numpy as np
    import pyarrow as pa

    ship(docs.sparkSession)
    rows = training_rows(with_fold(docs))
    n = rows.select("doc_id").count()
    if n > sample:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("lang-fit")), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    size = 1 << BUCKET_BITS

    def count(batches):
        total: dict[str, object] = {}
        docs_of: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(*batch.columns):
                lang = lang.as_py()
                into = total.setdefault(lang, np.zeros(size, np.int64))
                docs_of[lang] = docs_of.get(lang, 0) + 1
                for h, _ in gram_windows(text.as_py()):
                    into += np.bincount(h, minlength=size)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([docs_of[x] for x in total]), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["lang", "n", "counts"])

    counted: dict[str, object] = {}
    number: dict[str, int] = {}
    for lang, n_docs, counts in rows.select("lang", "text").repartition(FIT_TASKS).mapInArrow(tidy(count), "lang string, n long, counts binary").toLocalIterator():
        counted[lang] = counted.get(lang, 0) + np.frombuffer(counts, np.int64)
        number[lang] = number.get(lang, 0) + n_docs
    languages = tuple(sorted(counted))
    if not languages:
        return Model((), None, None)
    counts = np.stack([counted[x] for x in languages], axis=1) + SMOOTH
    prior = np.array([number[x] for x in languages], float)
    return Model(languages, np.log(prior / prior.sum()), np.log(counts / counts.sum(axis=0)).astype(np.float32))


def score_texts(model: Model, texts) -> list[tuple[str, float]]:
    """(language, score) of each text."""
    import numpy as np

    found = []
    for text in texts:
        evidence, n_grams, letters = 0.0, 0, 0
        for h, n in gram_windows(text or ""):
            evidence = evidence + model.log_prob[h].sum(axis=0, dtype=np.float64) if model.languages else evidence
            n_grams, letters = n_grams + len(h), letters + n
        if not letters or not model.languages:
            found.append(("und", 0.0))
            continue
        at = evidence * min(1.0, EVIDENCE / n_grams) + model.log_prior
        p = np.exp(at - at.max())
        best = int(p.argmax())
        found.append((model.languages[best], float(p[best] / p.sum())))
    return found


def identify(docs: DataFrame, model: Model, into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the predicted language and its score; the matrix goes to each executor once. Columns of these names are replaced."""
    docs = docs.drop(*into)
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    at = docs.columns.index("text")

    def predict(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = score_texts(shared.value, part.column(at).cast(pa.string()).to_pylist())
                lang, score = zip(*found)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*part.schema.names, *into])

    schema = StructType([*docs.schema.fields, StructField(into[0], StringType()), StructField(into[1], DoubleType())])
    return docs.mapInArrow(tidy(predict), schema)
