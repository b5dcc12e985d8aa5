"""Language identification by error-correcting output codes (operator 2).

Every language has a codeword of bits. One binary n-gram classifier per bit says on which
side a text lies, and the language whose codeword fits the answers best is chosen.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearlog.llm.blocks import pack, unpack
from hearlog.llm.common import record_batches, unit_hash

BUCKETS = 1 << 16
UNKNOWN = "und"

#: Bytes that count as letters: ASCII letters and all bytes of longer characters; any other
#: is taken as a space.
_LETTERS = np.array(
    [b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype=np.uint8
)
_BLANK = 0x202020


def trigrams(text: bytes) -> np.ndarray:
    """The buckets of the text's byte trigrams, a space before and behind it; blanks left out."""
    data = _LETTERS[np.frombuffer(b" " + text + b" ", np.uint8)].astype(np.uint32)
    codes = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    codes = codes[codes != _BLANK]
    return ((codes * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def pieces(text: bytes, size: int = 1 << 20) -> Iterator[np.ndarray]:
    """Trigrams of a text of any length, a limited number at a time."""
    for at in range(0, max(1, len(text)), size):
        yield trigrams(text[at:at + size])


def codewords(languages: int, seed: int = 42) -> np.ndarray:
    """One row of +1 and -1 per language.

    Up to seven languages have the exhaustive code, all ways to cut them in two. More have
    the random code of 10 * log2(languages) bits, of 200 drawn, whose rows lie farthest apart.
    """
    if languages <= 7:
        bits = max(0, 2 ** (languages - 1) - 1)
        masks = np.arange(1, bits + 1)
        rows = [np.ones(bits)] + [np.where(masks >> k & 1, -1.0, 1.0) for k in range(languages - 1)]
        return np.array(rows[:languages]).reshape(languages, bits)
    random = np.random.default_rng(seed)
    bits = math.ceil(10 * math.log2(languages))
    best, apart = None, -1
    for _ in range(200):
        code = random.choice([-1.0, 1.0], size=(languages, bits))
        agree = code @ code.T
        np.fill_diagonal(agree, -bits)
        # neither two equal rows nor a bit that does not split
        distance = (bits - agree.max()) / 2 if (np.abs(code.sum(axis=0)) < languages).all() else -1
        if distance > apart:
            best, apart = code, distance
    return best


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits: log odds of the bit's two sides
    trust: np.ndarray  # languages x bits: how often the bit is right for the language

    def margins(self, text: bytes) -> np.ndarray:
        return sum(self.weights[found].sum(axis=0, dtype=np.float64) for found in pieces(text))

    def decode(self, margins: np.ndarray) -> tuple[str, float, float]:
        """Language, score, and how far behind the second language is, in loss.

        The loss of a bit is log(1 + exp(-margin * codeword bit)), weighted by how far the
        bit can be trusted for the language. The score is exp(-loss) over its sum.
        """
        if len(self.languages) == 1:
            return self.languages[0], 1.0, math.inf
        loss = (self.trust * np.logaddexp(0, -self.code * margins)).sum(axis=1)
        order = np.argsort(loss, kind="stable")
        odds = np.exp(loss[order[0]] - loss)
        return self.languages[order[0]], float(1 / odds.sum()), float(loss[order[1]] - loss[order[0]])


def prepared(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """``(doc, text, lang, remainder, letters)``; the text is lower-cased and binary."""
    return docs.select(
        F.col(id_col).alias("doc"),
        F.lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary").alias("text"),
        F.col(lang_col).alias("lang"),
        (F.crc32(F.col(id_col).cast("string")) % 3).alias("remainder"),
        F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"),
    )


def fit(rows: DataFrame, fit_rows: int = 4_000) -> Model:
    """A model from the labelled rows of ``prepared`` whose remainder is not 1.

    About ``fit_rows`` of them are used for each language, chosen by a digest of the id; a
    quarter of these only measures how far each bit can be trusted. Whole texts are used.
    What reaches the driver are sums per language, of fixed size.
    """
    labelled = rows.where("lang IS NOT NULL AND remainder <> 1 AND letters")
    counts = {row.lang: row["count"] for row in labelled.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if len(languages) < 2:
        one = np.ones((len(languages), 0))
        return Model(languages, one, np.zeros((BUCKETS, 0), np.float32), one)
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, fit_rows / counts[lang]))])
    sample = labelled.where(unit_hash("sample", F.col("doc")) < share[F.col("lang")])
    measures = unit_hash("measure", F.col("doc")) < 0.25

    sums = {lang: np.zeros(BUCKETS) for lang in languages}
    for row in _summed(sample.where(~measures), _histograms).collect():
        sums[row.lang] = unpack(row.sums, np.float64)
    shares = np.array([(sums[lang] + 0.1) / (sums[lang].sum() + 0.1 * BUCKETS) for lang in languages])
    code = codewords(len(languages))
    sides = [
        np.log(shares[code[:, b] > 0].mean(axis=0)) - np.log(shares[code[:, b] < 0].mean(axis=0))
        for b in range(code.shape[1])
    ]
    weights = np.array(sides, np.float32).T.copy()
    plain = Model(languages, code, weights, np.ones_like(code))
    right = np.ones_like(code)
    for row in _summed(sample.where(measures), lambda: _hits(plain)).collect():
        found = unpack(row.sums, np.float64)
        right[languages.index(row.lang)] = (found[1:] + 1) / (found[0] + 1)
    trust = right / right.sum(axis=1, keepdims=True) * code.shape[1]
    return Model(languages, code, weights, trust)


def _histograms():
    return lambda text: sum(np.bincount(found, minlength=BUCKETS).astype(float) for found in pieces(text))


def _hits(model: Model):
    """Of a text of a known language: 1, and per bit whether its classifier was right."""
    code = dict(zip(model.languages, model.code, strict=True))
    return lambda text, lang: np.concatenate(([1.0], (model.margins(text) * code[lang] > 0).astype(float)))


def _summed(rows: DataFrame, measure) -> DataFrame:
    """Per language the sum of an array of fixed size over all texts, added up in each task first."""
    arrow = pa.schema([("lang", pa.string()), ("sums", pa.binary())])
    takes_lang = measure is not _histograms

    def partial(batches):
        of = measure()
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                value = of(text.as_py(), lang) if takes_lang else of(text.as_py())
                sums[lang] = sums[lang] + value if lang in sums else value
        return record_batches(((lang, pack(value)) for lang, value in sums.items()), arrow, 1)

    def total(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = 0
        for batch in batches:
            for packed in batch.column("sums"):
                value = value + unpack(packed.as_py(), np.float64)
        yield pa.record_batch([pa.array([key[0].as_py()], pa.string()), pa.array([pack(value)], pa.binary())],
                              names=["lang", "sums"])

    return (
        rows.select("text", "lang").mapInArrow(partial, "lang string, sums binary")
        .groupBy("lang").applyInArrow(total, "lang string, sums binary")
    )


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    fit_rows: int = 4_000,
    ambiguous_below: float = 3.0,
) -> DataFrame:
    """One row per document: ``held_out``, ``lang_pred``, ``score``, ``ambiguous``.

    Learns from rows with a language whose crc32(id as text) mod 3 is not 1 (``fit``);
    ``held_out`` are those where it is 1. Predictions use the whole text and nothing else.
    A text that is null or has no letters, and any text where nothing could be learned, is
    ``und`` with score 0. ``ambiguous`` marks predictions whose loss is less than
    ``ambiguous_below`` under the second language's. Ties go to the first language by name.
    A null id is not held out and not learned from; rows with equal ids are rows of their
    own. Extra columns are not read.
    """
    rows = prepared(docs, id_col, text_col, lang_col)
    model = fit(rows, fit_rows)
    held_out = F.coalesce(F.col("remainder") == 1, F.lit(False))
    if not model.languages:
        return rows.select(
            F.col("doc").alias(id_col), held_out.alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"),
            F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"),
        )
    shared = docs.sparkSession.sparkContext.broadcast(model)
    arrow = pa.schema([
        ("doc", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()),
        ("score", pa.float64()), ("ambiguous", pa.bool_()),
    ])

    def predicted(batches):
        known = shared.value
        for batch in batches:
            for doc, held, letters, text in zip(*[batch.column(i) for i in range(4)], strict=True):
                lang, score, lead = UNKNOWN, 0.0, 0.0
                if letters.as_py():
                    lang, score, lead = known.decode(known.margins(text.as_py()))
                yield doc.as_py(), held.as_py(), lang, score, lead < ambiguous_below

    wanted: list[Column] = [F.col("doc").cast("long"), held_out, F.col("letters"), F.col("text")]
    return rows.select(*wanted).mapInArrow(
        lambda batches: record_batches(predicted(batches), arrow),
        "doc long, held_out boolean, lang_pred string, score double, ambiguous boolean",
    ).withColumnRenamed("doc", id_col)
