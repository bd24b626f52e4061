"""Language identification by error-correcting output codes.

Each language gets a codeword of J bits. For every bit a binary n-gram classifier tells the
languages with that bit from those without: the mean, over a text's byte trigrams, of the log ratio
of their smoothed frequencies in the two camps (languages weigh the same within a camp). Trigram
counts come from all training texts, hashed into ``bins`` and summed in Spark; what reaches the
driver is languages x bins numbers.

Decoding is loss weighted: bit j counts for language l by the share of l's training texts on which
classifier j gets l's bit right, measured on a sample of about ``check_rows`` texts (a fifth of them at
most) that the trigram counts leave out. A language all of whose texts fall into the sample is counted from
them and gets even weights. Distance of l is the weighted mean logistic loss between the margins and l's
codeword; the nearest codeword wins. ``score`` is the softmin share of the winner, and a text is
``ambiguous`` when the runner-up is within ``doubt`` of it. Unless stated, doubt is set on the same
sample: at most a share ``false_rejections`` of its rightly decoded texts have a smaller gap to the
runner-up, and it is at most a tenth of their median gap (beyond that one language prevails).

Edge cases: null text or text without a letter is ``und`` with score 0; very long texts are
read whole, in bounded slices; ties between languages go to the first in code-point order; training
skips null languages and held-out ids (CRC-32 of the id's decimal text mod 5 is 0; a null id counts
as empty text); with no training text at all every text is ``und``; repeated rows keep their rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajens.llm.common import slices, table

_LETTER = regex.compile(r"\p{L}")
#: bytes: letters of ASCII in lower case, other ASCII as a space, the rest as it is
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SLICE = 1 << 20


def trigram_bins(data: bytes, bins: int) -> np.ndarray:
    """Bin of each byte trigram of ``data`` (length len(data) - 2)."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    x = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    return ((x * np.uint32(2654435761)) >> np.uint32(33 - bins.bit_length())).astype(np.int32)


def folded(text: bytes) -> bytes:
    return b" " + b" ".join(text.translate(_FOLD).split()) + b" "


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n x J matrix of +1/-1. Up to seven languages: the exhaustive code (every division of the
    languages once). More: random words, the best of 200 draws by least distance."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 7:
        cols = range(1, 1 << (n - 1))
        return np.array([[1 if l == n - 1 or not c >> l & 1 else -1 for c in cols] for l in range(n)], np.int8)
    rng, best, far = np.random.default_rng(seed), None, -1
    length = 10 * int(np.ceil(np.log2(n)))
    for _ in range(200):
        m = rng.choice(np.array([-1, 1], np.int8), (n, length))
        d = (length - m.astype(int) @ m.T) // 2 + np.eye(n, dtype=int) * length
        split = (abs(m.sum(axis=0)) < n).all()
        if split and d.min() > far:
            best, far = m, d.min()
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray       # languages x bits, +1/-1
    weights: np.ndarray    # bins x bits
    trust: np.ndarray      # languages x bits, rows sum to 1
    scale: float = 4.0
    doubt: float = 0.002


def fit(counts: dict[str, np.ndarray], bins: int, scale: float, doubt: float) -> Model:
    langs = sorted(counts)
    code = codewords(len(langs))
    freq = np.array([(counts[l] + 0.5) / (counts[l].sum() + 0.5 * bins) for l in langs]).reshape(len(langs), bins)
    weights = np.zeros((bins, code.shape[1]), np.float32)
    if len(langs) > 1:
        for j in range(code.shape[1]):
            up, down = freq[code[:, j] > 0].mean(axis=0), freq[code[:, j] < 0].mean(axis=0)
            weights[:, j] = np.log(up) - np.log(down)
    trust = np.full(code.shape, 1 / code.shape[1]) if len(langs) else np.zeros(code.shape)
    return Model(langs, code, weights, trust, scale, doubt)


def margins(texts: list[bytes], model: Model) -> np.ndarray:
    """Mean trigram weight per text and bit, texts x bits."""
    bins, bits = model.weights.shape
    sums, n = np.zeros((len(texts), bits)), np.zeros(len(texts))
    batch, owner, size = [], [], 0

    def flush():
        nonlocal batch, owner, size
        if batch:
            h = trigram_bins(b"".join(batch), bins)
            starts = np.cumsum([0, *map(len, batch)])[:-1]
            # the last two trigrams of a text reach into the next one: their starts are left out
            for j in range(bits):
                w = np.append(model.weights[:, j][h], np.zeros(2, np.float32))
                for s, l in zip(starts[1:], map(len, batch)):
                    w[s - 2:s] = 0
                np.add.at(sums[:, j], owner, np.add.reduceat(w, starts, dtype=np.float64))
        batch, owner, size = [], [], 0

    for i, t in enumerate(texts):
        data = folded(t)
        n[i] = max(1, len(data) - 2)
        for at in range(0, max(1, len(data) - 2), _SLICE):
            part = data[at:at + _SLICE + 2]
            if len(part) >= 3:
                batch.append(part)
                owner.append(i)
                size += len(part)
        if size >= _SLICE:
            flush()
    flush()
    return sums / n[:, None]


def decode(f: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the language, score, ambiguous) per row of margins."""
    loss = np.logaddexp(0, -model.scale * f[:, None, :] * model.code[None])
    dist = (loss * model.trust[None]).sum(axis=2)
    best = dist.argmin(axis=1)
    p = np.exp(-(dist - dist.min(axis=1, keepdims=True)) * model.scale)
    score = 1 / p.sum(axis=1)
    return best, score, gaps(f, model) < model.doubt


def gaps(f: np.ndarray, model: Model) -> np.ndarray:
    """How far the runner-up is behind, per row of margins."""
    if len(model.langs) < 2:
        return np.full(len(f), np.inf)
    loss = np.logaddexp(0, -model.scale * f[:, None, :] * model.code[None])
    near = np.sort((loss * model.trust[None]).sum(axis=2), axis=1)
    return near[:, 1] - near[:, 0]


#: gaps are counted in bins of a 32nd of a power of two, from 2^-30
_GAP_BINS, _LEAST_GAP = 32, -30


def doubt_of(counts: dict[int, int], false_rejections: float) -> float | None:
    """Largest doubt (a lower end of a bin) of the stated rate, from right decodings per gap bin."""
    total, below, most, median = sum(counts.values()), 0, None, None
    end = lambda b: 2.0 ** (b / _GAP_BINS + _LEAST_GAP)
    for b in sorted(counts):
        if most is None and below + counts[b] > false_rejections * total:
            most = end(b) if b > 0 else 0.0
        below += counts[b]
        if 2 * below >= total:
            median = end(b)
            break
    return None if median is None else min(most, 0.1 * median)


def held_out(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          bins: int = 1 << 14, check_rows: int = 4000, scale: float = 4.0, doubt: float | None = None, false_rejections: float = 0.001) -> Model:
    """Fit on the rows that are not held out and have a language; reads id, text and language only.
    ``bins``: a power of two. ``doubt``: set on the check sample if None."""
    taught = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = taught.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("binary").alias("text"),
                         F.col(id_col).alias("id"))
    drawn = sampled(check_rows, taught.count())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for b in slices(batches):
            by: dict[tuple, list] = {}
            for l, t, d in zip(*(b.column(i).to_pylist() for i in range(3))):
                by.setdefault((l, d), []).append(t)
            for l, texts in by.items():
                into = sums.setdefault(l, np.zeros(bins, np.int64))
                for t in texts:
                    data = folded(t)
                    for at in range(0, len(data) - 2, _SLICE):
                        into += np.bincount(trigram_bins(data[at:at + _SLICE + 2], bins), minlength=bins)
        for (l, d), c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([l] * len(at), pa.string()), pa.array([d] * len(at), pa.bool_()),
                                              pa.array(at.astype(np.int32)), pa.array(c[at])], names=["lang", "drawn", "bin", "n"])

    # one row per language, bin and whether drawn: 2 x languages x bins at most
    counted = (rows.select("lang", "text", drawn.alias("drawn")).mapInArrow(count, "lang string, drawn boolean, bin int, n long")
               .groupBy("lang", "drawn", "bin").agg(F.sum("n")).collect())
    counts: dict[str, np.ndarray] = {}
    apart = {l for l, d, *_ in counted if not d}
    for l, d, b, n in counted:
        if not d or l not in apart:
            counts.setdefault(l, np.zeros(bins))[b] = n
    model = fit(counts, bins, scale, Model.doubt if doubt is None else doubt)
    if len(model.langs) < 2:
        return model
    sample = rows.where(drawn & F.col("lang").isin(sorted(apart))).drop("id")
    index, signs = {l: i for i, l in enumerate(model.langs)}, model.code

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            f = margins(b.column(1).to_pylist(), model)
            lang = np.array([index[l] for l in b.column(0).to_pylist()], np.int64)
            ok = (f * signs[lang] > 0).astype(np.int64)
            for l in np.unique(lang):
                own = ok[lang == l]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(ok.shape[1], l)), pa.array(np.arange(ok.shape[1])),
                     pa.array(own.sum(axis=0)), pa.array(np.full(ok.shape[1], len(own)))], names=["l", "j", "ok", "n"])

    hits = (sample.mapInArrow(right, "l long, j long, ok long, n long").groupBy("l", "j")
            .agg(F.sum("ok").alias("ok"), F.sum("n").alias("n")).collect())
    acc = np.full(model.code.shape, 0.5)
    for l, j, ok, n in hits:
        acc[l, j] = (ok + 1) / (n + 2)
    model.trust = acc / acc.sum(axis=1, keepdims=True)
    if doubt is None:
        def gap_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                f = margins(b.column(1).to_pylist(), model)
                right = decode(f, model)[0] == np.array([index[l] for l in b.column(0).to_pylist()], np.int64)
                at = np.floor((np.log2(np.maximum(gaps(f, model)[right], 2.0 ** _LEAST_GAP)) - _LEAST_GAP) * _GAP_BINS)
                at, n = np.unique(at.astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n, pa.int64())], names=["bin", "n"])

        # a number per bin comes back, not the texts' gaps
        told = sample.mapInArrow(gap_bins, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
        set_to = doubt_of({r.bin: r.n for r in told}, false_rejections)
        model.doubt = model.doubt if set_to is None else set_to
    return model


def sampled(check_rows: int, n_texts: int):
    """Whether a row (id, text) is in the check sample: its hash falls in a share that gives about check_rows of
    n_texts rows, a fifth at most. The hash is of id and text, so copies are drawn each for itself."""
    share = int(min(0.2, check_rows / max(1, n_texts)) * (1 << 30))
    return F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < F.lit(share)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous), one row per input row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"),
                       F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda batches: _predict(batches, model, 2),
                           "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def _predict(batches: Iterator[pa.RecordBatch], model: Model, at: int) -> Iterator[pa.RecordBatch]:
    names = np.array([*model.langs, "und"], dtype=object)
    for b in slices(batches):
        texts = b.column(at).to_pylist()
        lettered = [i for i, t in enumerate(texts) if model.langs and t and _LETTER.search(t)]
        best = np.full(len(texts), len(model.langs))
        score, doubt = np.zeros(len(texts)), np.zeros(len(texts), bool)
        if lettered:
            best[lettered], score[lettered], doubt[lettered] = decode(
                margins([texts[i].encode() for i in lettered], model), model)
        yield pa.RecordBatch.from_arrays(
            [b.column(i) for i in range(at)] + [pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(doubt)],
            names=[*b.schema.names[:at], "lang_pred", "score", "ambiguous"])


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Rows whose language is told: neither ``und`` nor ambiguous. All columns are kept."""
    at, schema = docs.columns.index(text_col), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            said = next(_predict(iter([b.select([b.schema.names[at]])]), model, 0))
            keep = np.array([l != "und" for l in said.column(0).to_pylist()]) & ~np.array(said.column(2).to_pylist(), bool)
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)


def op8_langid(spark, sf_dir: str) -> DataFrame:
    """All documents, trained on those not held out."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
