"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

The features are lexicon densities, closeness of lexicon words to words of address, and rates of capitals, punctuation and
obfuscation. The lexicon is a short general one and what the labelled rows add: words and word beginnings that are much
commoner in toxic documents. Features of the training rows use what the other half of them taught, so that the trees see
the learned densities as they are on new documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granulo.llm import bytestats as B
from granulo.llm import hashing
from granulo.llm.boosting import Isotonic, Trees, fit_isotonic, fit_trees
from granulo.llm.common import chunks, in_arrow, stable
from granulo.llm.labels import remainder, training_rows

#: Most labelled rows that are learned from, and most entries that the learned lexicon has.
MAX_TRAIN, MAX_LEXICON = 20_000, 4096
#: Bytes of a word's beginnings, and words between an insult and a word of address that count as close.
STEMS, CLOSE = (4, 5, 6, 7, 8), 5
GENERAL = "idiot idiots idiota imbécile imbecile stupid stupido estúpido stupide moron scum loser pathetic worthless trash disgusting clown dumb fool jerk bastard crap damn ugly vermin trottel dummkopf abschaum connard crétin basura tonto".split()
ADDRESS = "you your yours yourself u ur tu te toi vous votre du dich dir ihr euch dein sie ihnen usted ustedes vos vosotros".split()
_GENERAL = np.array(sorted(map(hashing.one, GENERAL)), np.uint64)
_ADDRESS = np.array(sorted(map(hashing.one, ADDRESS)), np.uint64)
N_FEATURES = 20


@dataclass
class Lexicon:
    """Sorted hashes of words and beginnings with their log-odds. A beginning's hash also tells its length."""

    hashes: np.ndarray
    weights: np.ndarray

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.weights[at], 0.0)


NO_LEXICON = Lexicon(np.empty(0, np.uint64), np.empty(0))


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Of all letter words: hashes, hashes of their beginnings, the text each belongs to, and where each begins."""
    first, last = hashing.spans(B.LETTER[data], offsets)
    stems = [hashing.mix(hashing.hash_spans(data, first, np.minimum(last, first + k)) + np.uint64(k)) for k in STEMS]
    for k, s in zip(STEMS, stems):
        s[last - first < k] = 0
    return hashing.hash_spans(data, first, last), stems, np.searchsorted(offsets, first, "right") - 1, first


def features(data: np.ndarray, offsets: np.ndarray, lexicons: list[Lexicon], pick: np.ndarray | None = None) -> np.ndarray:
    """One row of N_FEATURES a text. ``pick`` names the lexicon of each text where there are several."""
    n = len(offsets) - 1
    h, stems, of, first = _terms(data, offsets)
    general = _among(h, _GENERAL)
    learned = np.zeros(len(h))
    stem = np.zeros(len(h))
    for k, lexicon in enumerate(lexicons):
        use = slice(None) if pick is None else pick[of] == k
        learned[use] = lexicon(h[use])
        for s in stems:
            stem[use] = np.maximum(stem[use], lexicon(s[use]))
    words = np.bincount(of, minlength=n)
    per_word = 1 / np.maximum(words, 1)
    count = lambda mask: np.bincount(of, mask, n)
    hit = general | (learned > 0) | (stem > 0)
    address = _among(h, _ADDRESS)
    seen = np.r_[0, np.cumsum(address)]
    head = np.searchsorted(of, np.arange(n + 1))
    place = np.arange(len(h))
    near = hit & (seen[np.minimum(place + CLOSE + 1, head[of + 1])] - seen[np.maximum(place - CLOSE, head[of])] > 0)
    top = np.zeros(n)
    np.maximum.at(top, of[hit], np.maximum(learned, stem)[hit])

    bytes_ = _byte_counts(data, offsets)
    per_byte, letters = 1 / np.maximum(np.diff(offsets), 1), np.maximum(bytes_["letter"], 1)
    return np.stack([
        count(general), count(general) * per_word, count(learned > 0), count(learned) * per_word, count(stem > 0), count(stem) * per_word,
        count(hit), count(hit) * per_word, top, count(near), count(near) * per_word, count(address) * per_word,
        bytes_["upper"] / letters, bytes_["symbol"] * per_byte, bytes_["shout"] * per_byte, bytes_["digit"] * per_byte,
        bytes_["between"] * per_word, bytes_["spaced"] * per_word, bytes_["runs"] * per_word, np.log1p(words),
    ], 1)


def _byte_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """How many bytes of each text are of each kind, a segment at a time with the two bytes on either side of it."""
    out = {n: np.zeros(len(offsets) - 1, np.int64) for n in ("letter", "upper", "symbol", "shout", "digit", "between", "spaced", "runs")}
    for start in range(0, len(data), B.SEGMENT):
        stop = min(start + B.SEGMENT, len(data))
        low = max(start - 2, 0)
        part = data[low : stop + 2]
        at = lambda mask, k: B.shifted(mask, k, np.clip(offsets - low, 0, len(part)))  # noqa: B023, E731
        letter, digit = B.LETTER[part], B.DIGIT[part]
        lone = letter & ~at(letter, -1) & ~at(letter, 1) & (part < 128)
        masks = {
            "letter": letter, "upper": B.upper_mask(part), "symbol": B.SYMBOL[part] | B.PUNCTUATION[part], "shout": part == ord("!"), "digit": digit,
            "between": at(letter, -1) & (digit | B.SYMBOL[part]) & at(letter, 1),  # letter, then one digit or mark, then letter
            "spaced": lone & (at(letter, -2) | at(letter, 2)),  # a letter by itself with another one two bytes away
            "runs": letter & at(letter, -2) & (part == at(part, -1)) & (part == at(part, -2)),
        }
        for name, mask in masks.items():
            out[name] += B.sums(mask[start - low : stop - low], np.clip(offsets, start, stop) - start)
    return out


def _count_terms(among: np.ndarray | None):
    """Over rows ``text, half``: for each word or beginning of a text (of the sorted hashes ``among``, if given), in how many texts of each half it is."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half = batch.column("half").to_numpy()
            for at, data, offsets in chunks(batch.column("text")):
                h, stems, of, _ = _terms(data, offsets)
                every, texts = np.concatenate([h, *stems]), np.tile(of, 1 + len(stems))
                use = every != 0 if among is None else _among(every, among) if len(among) else np.zeros(len(every), bool)
                every, texts = every[use], texts[use]
                pair = np.unique(np.stack([every, texts.astype(np.uint64)]), axis=1) if len(every) else np.empty((2, 0), np.uint64)
                rows = pair[1].astype(np.int64) + at
                term, of_term = np.unique(pair[0], return_inverse=True)
                cells = [np.bincount(of_term, half[rows] == b, len(term)).astype(np.int64) for b in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (term.view(np.int64), *cells)], names=["term", "c0", "c1"])

    return work


def learn_lexicons(rows: DataFrame) -> list[Lexicon]:
    """From ``text, y, half``: what half 1 teaches, what half 0 teaches, and what all teach.

    An entry is in three toxic texts at least (two of a half) and at least ten times as likely there as in clean ones. Terms of two toxic
    texts or more are known first (their hashes go to the driver and back, 8 bytes each, bounded by the sample); clean texts are counted
    for those. The best MAX_LEXICON are kept.
    """
    sizes = {(r["y"], r["half"]): r["n"] for r in rows.groupBy("y", "half").agg(F.count("*").alias("n")).collect()}

    def counted(y: int, among: np.ndarray | None, name: str) -> DataFrame:
        found = in_arrow(rows.where(F.col("y") == y).select("text", "half"), _count_terms(among), "term long, c0 long, c1 long")
        return found.groupBy("term").agg(F.sum("c0").alias(f"{name}0"), F.sum("c1").alias(f"{name}1"))

    toxic_terms = stable(counted(1, None, "b").where("b0 + b1 >= 2"))
    known = np.sort(toxic_terms.select("term").toArrow()["term"].to_numpy().view(np.uint64))
    counts = stable(toxic_terms.join(counted(0, known, "a"), "term", "left").fillna(0, ["a0", "a1"]))
    found = []
    for halves in ((1,), (0,), (0, 1)):
        clean, toxic = (sum(F.col(f"{c}{i}") for i in halves) for c in "ab")
        n_clean, n_toxic = (sum(sizes.get((y, i), 0) for i in halves) for y in (0, 1))
        odds = F.log((toxic + 0.1) / (n_toxic + 1.0)) - F.log((clean + 0.1) / (n_clean + 1.0))
        best = counts.select("term", odds.alias("w"), toxic.alias("t")).where((F.col("t") >= 1 + len(halves)) & (F.col("w") >= float(np.log(10))))
        best = best.orderBy(F.desc(F.col("w") * F.log1p("t")), "term").limit(MAX_LEXICON).select("term", "w").toPandas()
        h = best["term"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(h)
        found.append(Lexicon(h[order], best["w"].to_numpy(float)[order]))
    return found


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    calibration: Isotonic

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.calibration(self.trees.margin(features(data, offsets, [self.lexicon])))


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns from labelled documents whose crc32 remainder is not ``held_out``; at most about MAX_TRAIN of them.

    The driver receives the sample's features (some 3 MB) and lexicon, never texts. A fifth of the sample calibrates. Without
    labelled rows, or with one kind only, every score is below 0.5 unless the general lexicon's density says otherwise.
    """
    learn = remainder(F.col("doc_id"), folds) != held_out
    rows = training_rows(docs, labels, "toxic", learn, MAX_TRAIN, id_col, text_col)
    rows = rows.withColumn("half", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(2)).cast("long")).withColumn("y", F.col("y").cast("long"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(5)).cast("int"))
    lexicons = learn_lexicons(rows.select("text", "y", "half"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half = batch.column("half").to_numpy()
            for at, data, offsets in chunks(batch.column("text")):
                n = len(offsets) - 1
                x = features(data, offsets, lexicons[:2], half[at : at + n])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, n), batch.column("y").slice(at, n), batch.column("part").slice(at, n), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "part", "x"])

    got = in_arrow(rows.select("doc_id", "text", "y", "half", "part"), work, "doc_id long, y long, part int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(got["x"].tolist(), float).reshape(-1, N_FEATURES)
    y, fit = got["y"].to_numpy(float), got["part"].to_numpy() != 0
    if len(np.unique(y)) < 2:
        cut = np.zeros((1, 1), np.int64)
        cut[0, 0] = 7
        trees = Trees(cut, np.array([[0.02]]), np.array([[-2.0, 2.0]]), 0.0)
        return Model(NO_LEXICON, trees, fit_isotonic(np.empty(0), np.empty(0)))
    if len(np.unique(y[~fit])) < 2:
        fit = ~fit | fit
    trees = fit_trees(x[fit], y[fit])
    judge = ~fit if not fit.all() else fit
    return Model(lexicons[2], trees, fit_isotonic(trees.margin(x[judge]), y[judge]))


def score(docs: DataFrame, model: Model, folds: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text, or, with ``keep``, those columns of ``docs``, ``score`` and ``predicted``.

    One pass without a shuffle. Null texts score as empty ones; a null id is not held out; repeated rows score alike.
    ``keep`` may name any columns, whatever they are called: they are carried in a struct.
    """
    carried = F.struct(*[F.col(c) for c in keep]) if keep is not None else F.struct(F.col(id_col).cast("long").alias("doc_id"))
    rows = docs.select(carried.alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in chunks(batch.column("text")):
                n = len(offsets) - 1
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(at, n), pa.array(model.score(data, offsets))], names=["row", "score"])

    kind = rows.schema["row"].dataType.simpleString()
    out = in_arrow(rows, work, f"row {kind}, score double")
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    if keep is not None:
        return out.select(F.col("row"), "score", predicted)
    doc_id = F.col("row.doc_id")
    return out.select(doc_id.alias("doc_id"), F.coalesce(remainder(doc_id, folds) == held_out, F.lit(False)).alias("held_out"), "score", predicted)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
