"""Language identification: averaged hashed subword embeddings under a linear softmax.

The model is fitted by stochastic gradient descent in numpy on a bounded sample of labelled
rows.  Because the document vector is an average and the softmax is linear, the fitted
model folds into one table of scores per subword bucket, and a text of any length is
scored whole from its bucket counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.bytestream import flat, release_unused, released
from plumbline.llm.frames import fresh, named, number_of, numbered

NONE = "und"
BUCKET_BITS = 15
SIZES = (2, 3, 4)
# Bounds of the sample the model is fitted on: labelled rows over all languages together.
FIT_ROWS = 6000
CALIBRATION_ROWS = 2000
SEED = 20265
PIECE = 1 << 20

# Bytes as the model sees them: A-Z in lower case, white space, digits and signs as blanks.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[:65] = _FOLD[91:97] = _FOLD[123:128] = 32


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # bucket x language: score of one subword
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, counts: np.ndarray) -> np.ndarray:
        return counts @ self.table / max(counts.sum(), 1) + self.bias


def bucket_counts(text: np.ndarray) -> np.ndarray:
    """How many subwords (byte n-grams) of one text fall into each bucket; stretches overlap
    so that none is missed, and memory stays small for texts of any length."""
    counts = np.zeros(1 << BUCKET_BITS, np.float64)
    widest = max(SIZES) - 1
    for at in range(0, max(len(text), 1), PIECE):
        code = _FOLD[text[at : at + PIECE + widest]].astype(np.uint32)
        gram = code.copy()
        for size in range(2, max(SIZES) + 1):
            gram = (gram[:-1] << np.uint32(8)) | code[size - 1 :]
            if size in SIZES:
                own = gram[:PIECE]  # a subword counts in the stretch where it begins
                hashed = (own ^ np.uint32(size * 0x1F123BB5)) * np.uint32(0x9E3779B1)
                counts += np.bincount(hashed >> np.uint32(32 - BUCKET_BITS), minlength=len(counts))
    return counts


def has_letter(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False))


# --- fitting -------------------------------------------------------------------------

_SPARSE = "lang string, fits boolean, buckets binary, amounts binary"


def _features(batches):
    for batch in batches:
        data, offsets = flat(batch.column("text"))
        buckets, amounts = [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            counts = bucket_counts(data[a:b])
            used = np.flatnonzero(counts)
            buckets.append(used.astype(np.uint16).tobytes())
            amounts.append((counts[used] / max(counts.sum(), 1)).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("fits"), pa.array(buckets, pa.binary()), pa.array(amounts, pa.binary())], names=["lang", "fits", "buckets", "amounts"])


def sample(labelled: DataFrame, fit_rows: int, calibration_rows: int) -> DataFrame:
    """Rows ``lang, fits, buckets, amounts`` of a hashed sample, spread evenly over languages.

    ``labelled`` has ``key, text, lang, fits``; ``fits`` tells rows to fit on from rows to
    calibrate on.  Rows are drawn by the hash of their key, so reruns agree.
    """
    per_lang = labelled.groupBy("lang", "fits").agg(F.count(F.lit(1)).alias("n")).collect()
    n_langs = max(len({r.lang for r in per_lang}), 1)
    share = F.lit(0.0)
    for r in per_lang:  # one row per language
        most = (fit_rows if r.fits else calibration_rows) / n_langs
        share = F.when((F.col("lang") == r.lang) & (F.col("fits") == r.fits), min(1.0, most / r.n)).otherwise(share)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "key"), 11) / F.lit(float(2**53))
    return labelled.where(draw < share).select("lang", "fits", "text").mapInArrow(released(_features), _SPARSE)


def _dense(rows: list) -> np.ndarray:
    x = np.zeros((len(rows), 1 << BUCKET_BITS), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r.buckets, np.uint16)] = np.frombuffer(r.amounts, np.float32)
    return x


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list, dim: int = 16, epochs: int = 12, rate: float = 2.0, batch: int = 64) -> Model:
    """Fit on sampled rows; rows with ``fits`` train, the others calibrate."""
    langs = sorted({r.lang for r in rows if r.fits})
    if not langs:
        return Model([], np.zeros((1 << BUCKET_BITS, 0)), np.zeros(0))
    place = {lang: i for i, lang in enumerate(langs)}
    rng = np.random.default_rng(SEED)
    # Collected rows come in no fixed order: sort them, so that reruns fit the same model.
    rows = sorted(rows, key=lambda r: (r.lang, r.buckets, r.amounts))
    own = [r for r in rows if r.fits]
    embed = rng.normal(0, 1, (1 << BUCKET_BITS, dim)).astype(np.float32)
    out = np.zeros((dim, len(langs)), np.float32)
    bias = np.zeros(len(langs), np.float32)
    steps = epochs * -(-len(own) // batch)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(own))
        for first in range(0, len(own), batch):
            some = [own[i] for i in order[first : first + batch]]
            x = _dense(some)
            want = np.array([place[r.lang] for r in some])
            hidden = x @ embed
            error = _softmax(hidden @ out + bias)
            error[np.arange(len(some)), want] -= 1
            pace = rate * (1 - step / steps)
            back = error @ out.T
            out -= pace * hidden.T @ error / len(some)
            bias -= pace * error.mean(axis=0)
            used = np.flatnonzero(x.any(axis=0))
            # An average spreads each gradient over thousands of subwords: scale it back up.
            embed[used] -= pace * 20 * (x[:, used].T @ back) / len(some)
            step += 1
    model = Model(langs, embed.astype(np.float64) @ out, bias.astype(np.float64))
    calibrate(model, [r for r in rows if not r.fits and r.lang in place] or own)
    return model


_MODEL = "langs array<string>, table binary, bias binary, temperature double, threshold double"


def _fitted(batches):
    """The model of all sampled rows, as one row."""
    rows = [Row(**r) for batch in batches for r in batch.to_pylist()]
    if rows:
        m = fit(rows)
        del rows
        release_unused()
        values = (m.langs, m.table.tobytes(), m.bias.tobytes(), float(m.temperature), float(m.threshold))
        types = (pa.list_(pa.string()), pa.binary(), pa.binary(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], t) for v, t in zip(values, types)], names=["langs", "table", "bias", "temperature", "threshold"]
        )


def _model_of(row: Row) -> Model:
    table, bias = np.frombuffer(row.table, np.float64), np.frombuffer(row.bias, np.float64)
    return Model(list(row.langs), table.reshape(1 << BUCKET_BITS, len(row.langs)), bias, row.temperature, row.threshold)


def calibrate(model: Model, rows: list, lost: float = 0.001) -> None:
    """Set the temperature that makes scores honest, and the score below which to reject.

    The temperature minimises the log loss on rows the fit has not seen; the threshold
    turns away at most the share ``lost`` of the rows it gets right.
    """
    place = {lang: i for i, lang in enumerate(model.langs)}
    z = np.array([
        np.frombuffer(r.amounts, np.float32).astype(np.float64) @ model.table[np.frombuffer(r.buckets, np.uint16)] + model.bias
        for r in rows
    ])
    want = np.array([place[r.lang] for r in rows])
    losses = {}
    for t in np.geomspace(0.2, 20, 81):
        p = _softmax(z / t)[np.arange(len(want)), want]
        losses[float(t)] = -np.log(np.maximum(p, 1e-12)).mean()
    model.temperature = min(losses, key=losses.get)
    p = _softmax(z / model.temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == want]
    floor = 1.0 / max(len(model.langs), 1)
    model.threshold = float(max(np.quantile(right, lost), floor)) if len(right) else floor


# --- predicting ----------------------------------------------------------------------


def _predictor(model, text: str, letter: str, lang: str, score: str, rejected: str):
    def predict(batches):
        m = model.value
        for batch in batches:
            data, offsets = flat(batch.column(text))
            letters = batch.column(letter).to_pylist()
            names, scores, turned_away = [], [], []
            for i, ok in enumerate(letters):
                if not ok or not m.langs:
                    names.append(NONE), scores.append(0.0), turned_away.append(True)
                    continue
                p = _softmax(m.logits(bucket_counts(data[offsets[i] : offsets[i + 1]])) / m.temperature)
                best = int(p.argmax())
                names.append(m.langs[best])
                scores.append(float(p[best]))
                turned_away.append(bool(p[best] < m.threshold))
            own = pa.RecordBatch.from_arrays(
                [*(c for c, name in zip(batch.columns, batch.schema.names) if name != letter), pa.array(names), pa.array(scores), pa.array(turned_away)],
                names=[*(name for name in batch.schema.names if name != letter), lang, score, rejected],
            )
            yield own

    return predict


def is_held_out(id_column: Column, parts: int = 3, part: int = 1) -> Column:
    """Rows set apart for judging the model: by the CRC-32 of the id as text."""
    return F.coalesce(F.crc32(id_column.cast("string")) % parts == part, F.lit(False))


def fit_on(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS, calibration_rows: int = CALIBRATION_ROWS) -> Model:
    """A model learned from labelled rows that are not held out.

    The sample is bounded by ``fit_rows`` and ``calibration_rows`` in expectation, spread
    over languages; null labels and null ids are left out.
    """
    crc = F.crc32(named(id_col).cast("string")) % 3
    labelled = docs.select(
        named(id_col).cast("string").alias("key"),
        named(text_col).alias("text"),
        named(lang_col).cast("string").alias("lang"),
        (crc == 0).alias("fits"),
    ).where((crc != 1) & F.col("lang").isNotNull())
    # One task fits: the driver sees the folded model alone, not the sampled rows.
    told = sample(labelled, fit_rows, calibration_rows).repartition(1).mapInArrow(released(_fitted), _MODEL).collect()
    return _model_of(told[0]) if told else fit([])


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """``docs`` with three more columns, whose names come second: language, score, rejected.

    Null texts and texts without a letter are ``und`` with score 0 and rejected, as is every
    text if the model has learned no language.  Other texts get a learned language and its
    calibrated probability; those below the model's threshold are marked rejected.  Only
    the text is looked at.  Empty tables give no rows.
    """
    names = [fresh(docs, n) for n in ("lang_pred", "score", "rejected")]
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    plain, text = numbered(docs), number_of(docs, text_col)
    schema = T.StructType(list(plain.schema.fields)).add("lang", "string").add("score", "double").add("rejected", "boolean")
    marked = plain.withColumn("letter", has_letter(F.col(text)))
    told = marked.mapInArrow(released(_predictor(shipped, text, "letter", "lang", "score", "rejected")), schema)
    return told.toDF(*docs.columns, *names), names
