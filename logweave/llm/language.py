"""Language identification by unigrams over subword pieces, all segmentations summed.

Each language gives every piece of a fixed public vocabulary a probability. A word's probability is the
sum over all its segmentations into pieces (forward algorithm); a text's is the product over its words.
The language with the largest posterior wins. Piece probabilities are fitted by expectation
maximisation over word counts of a bounded sample of labelled rows (``rows_per_language``); each step is
a Spark job over the word counts that gathers expected piece counts, at most languages x vocabulary rows.

Defined cases: null texts and texts without a letter are ``und`` with score 0; with no labelled row all
texts are ``und``; characters outside the vocabulary count alike in all languages; runs of letters of any length
are scored whole, those of over LONG characters one by one and rescaled as they go (nothing is learned from these);
repeated rows are scored alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.common import hash_share, id_crc, keep, mixed, slices

VOCABULARY = "piece_bpe_32k.model"
ROWS_PER_LANGUAGE = 600
STEPS = 3
SMOOTHING = 0.1
#: Characters up to which the chance of a word stays within the range of a double, and words are scored together.
LONG = 40
#: Runs of letters whose scores one worker remembers.
RUN_CACHE = 150_000
UNKNOWN = 1e-7
LETTERS = re.compile(r"[^\W\d_]+")
START = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)

_lattices: dict = {}


class Lattice:
    """All places of the vocabulary's pieces in words."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
        # others are in no run of letters
        self.pieces = [p for p in pieces if LETTERS.fullmatch(p.removeprefix(START) or "a")]
        self.longest = max(map(len, self.pieces))
        self.numbers = {p: i for i, p in enumerate(self.pieces)}
        hashes = np.array([self.hashes([p])[0][0, len(p)] for p in self.pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashed, self.number = hashes[order], order
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(mixed(hashes) >> np.uint64(42)).astype(np.int64)] = True

    @classmethod
    def at(cls, path: str) -> Lattice:
        if path not in _lattices:
            _lattices[path] = cls(path)
        return _lattices[path]

    @staticmethod
    def hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Prefix hashes of each word, and the words' lengths."""
        lengths = np.array([len(w) for w in words])
        codes = np.zeros((len(words), lengths.max()), np.uint64)
        flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
        codes[np.arange(codes.shape[1]) < lengths[:, None]] = flat + np.uint64(1)
        out = np.zeros((len(words), codes.shape[1] + 1), np.uint64)
        for t in range(codes.shape[1]):
            out[:, t + 1] = out[:, t] * BASE + codes[:, t]
        return out, lengths

    def places(self, words: list[str]) -> tuple[list[tuple[int, int, np.ndarray, np.ndarray]], np.ndarray]:
        """(start, end, rows of words, pieces), by end and start, and the words' lengths."""
        prefix, lengths = self.hashes(words)
        power = [np.uint64(1)]
        with np.errstate(over="ignore"):
            for _ in range(self.longest):
                power.append(power[-1] * BASE)
            out = []
            for end in range(1, prefix.shape[1]):
                for start in range(max(0, end - self.longest), end):
                    own = prefix[:, end] - prefix[:, start] * power[end - start]
                    rows = np.flatnonzero(self.maybe[(mixed(own) >> np.uint64(42)).astype(np.int64)] & (lengths >= end))
                    at = np.minimum(np.searchsorted(self.hashed, own[rows]), len(self.hashed) - 1)
                    good = self.hashed[at] == own[rows]
                    rows, pieces = rows[good], self.number[at[good]]
                    if start == end - 1:  # a character that is no piece is passed at a fixed price
                        unknown = np.setdiff1d(np.flatnonzero(lengths >= end), rows, assume_unique=True)
                        rows, pieces = np.concatenate([rows, unknown]), np.concatenate([pieces, np.full(len(unknown), len(self.pieces))])
                    if len(rows):
                        out.append((start, end, rows, pieces))
        return out, lengths

    def forward(self, words: list[str], chances: np.ndarray) -> tuple[np.ndarray, list, np.ndarray]:
        """alpha[end, word, language]. chances: a row for each piece and a last one for unknown characters."""
        places, lengths = self.places(words)
        alpha = np.zeros((lengths.max() + 1, len(words), chances.shape[1]))
        alpha[0] = 1
        for start, end, rows, pieces in places:
            alpha[end][rows] += alpha[start].take(rows, 0) * chances.take(pieces, 0)
        return alpha, places, lengths

    def log_chances(self, words: list[str], chances: np.ndarray) -> np.ndarray:
        """log P(word) in each language."""
        alpha, _, lengths = self.forward(words, chances)
        return np.log(alpha[lengths, np.arange(len(words))])

    def log_chance(self, word: str, chances: np.ndarray) -> np.ndarray:
        """log P(word) in each language of a word of any length."""
        alpha, scale = [np.ones(chances.shape[1])], np.zeros(chances.shape[1])  # of the last places
        for end in range(1, len(word) + 1):
            now = np.zeros(chances.shape[1])
            for back, before in enumerate(reversed(alpha), 1):
                piece = self.numbers.get(word[end - back : end], len(self.pieces) if back == 1 else None)
                if piece is not None:
                    now += before * chances[piece]
            alpha, scale = [a / now for a in [*alpha, now][-self.longest :]], scale + np.log(now)
        return scale

    def expected(self, words: list[str], counts: np.ndarray, chances: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in the words of one language."""
        alpha, places, lengths = self.forward(words, chances[:, None])
        alpha, beta = alpha[:, :, 0], np.zeros(alpha.shape[:2])
        every = np.arange(len(words))
        beta[lengths, every] = counts / alpha[lengths, every]
        out = np.zeros(len(chances))
        for start, end, rows, pieces in reversed(places):
            beta[start][rows] += beta[end][rows] * chances[pieces]
        for start, end, rows, pieces in places:
            np.add.at(out, pieces, alpha[start][rows] * chances[pieces] * beta[end][rows])
        return out[:-1]


def runs_of(text: str) -> list[str]:
    """Runs of letters in lower case."""
    return LETTERS.findall(text.lower())


def words_of(text: str) -> list[str]:
    """A text's runs of at most LONG characters, marked as starts."""
    return [w for run in runs_of(text) if len(w := START + run) <= LONG]


def by_length(words: list[str], most: int = 5_000) -> Iterator[list[int]]:
    """Places of words of like length, so that little is padded."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    for i in range(0, len(order), most):
        yield order[i : i + most]


class Model:
    def __init__(self, path: str, languages: list[str], priors: np.ndarray, chances: np.ndarray):
        self.path, self.languages, self.priors = path, languages, priors
        self.chances = np.vstack([chances, np.full((1, len(languages)), UNKNOWN)])
        self.known: dict[str, int] | None = None

    def __getstate__(self):
        return self.__dict__ | {"known": None, "rows": None}

    def learn(self, runs: list[str]) -> None:
        """Score runs of letters: a row of log chances, one for each language."""
        if self.known is None or len(self.known) + len(runs) > RUN_CACHE:
            self.known, self.rows = {}, np.zeros((0, len(self.languages)))
        logs, lattice = np.zeros((len(runs), len(self.languages))), Lattice.at(self.path)
        words = [START + r for r in runs]
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        for places in by_length([words[i] for i in short]):
            places = [short[i] for i in places]
            logs[places] = lattice.log_chances([words[i] for i in places], self.chances)
        for i, w in enumerate(words):
            if len(w) > LONG:
                logs[i] = lattice.log_chance(w, self.chances)
        self.known |= {r: len(self.rows) + i for i, r in enumerate(runs)}
        self.rows = np.vstack([self.rows, logs])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        split = [runs_of(t or "") for t in texts]
        every = set().union(*split)
        new = list(every - (self.known or {}).keys())
        if new:
            if self.known is not None and len(self.known) + len(new) > RUN_CACHE:
                self.known, new = None, list(every)
            self.learn(new)
        out = []
        for runs in split:
            if not runs:
                out.append(("und", 0.0))
                continue
            logs = self.rows[np.fromiter(map(self.known.__getitem__, runs), np.int64, len(runs))].sum(0) + self.priors
            best = int(logs.argmax())
            out.append((self.languages[best], float(1 / np.exp(logs - logs[best]).sum())))
        return out


def fit(labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, vocabulary: str | None = None) -> Model | None:
    """A model from rows of doc_id, text and lang; whole texts of about ``rows_per_language`` rows each."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    labelled = labelled.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    chosen = F.lit(False)
    for lang in languages:
        chosen = chosen | ((F.col("lang") == lang) & hash_share(F.col("doc_id"), min(1.0, rows_per_language / sizes[lang])))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = Counter()
            for lang, text in zip(batch["lang"], batch["text"]):
                counts.update((lang, w) for w in words_of(text))
            yield pd.DataFrame([(lang, w, n) for (lang, w), n in counts.items()], columns=["lang", "word", "n"])

    words = labelled.where(chosen).select("lang", "text").mapInPandas(count, "lang string, word string, n long")
    words = keep(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    lattice = Lattice.at(path)
    chances = np.full((len(lattice.pieces), len(languages)), 1 / len(lattice.pieces))
    for _ in range(STEPS):
        given = words.sparkSession.sparkContext.broadcast(chances)

        def uses(batches: Iterator[pd.DataFrame], given=given) -> Iterator[pd.DataFrame]:
            lattice, total = Lattice.at(path), {}
            for batch in batches:
                for lang, own in batch.groupby("lang"):
                    column = np.append(given.value[:, languages.index(lang)], UNKNOWN)
                    spelled, counts = own["word"].tolist(), own["n"].to_numpy(float)
                    for places in by_length(spelled):
                        total[lang] = total.get(lang, 0) + lattice.expected([spelled[i] for i in places], counts[places], column)
            for lang, uses in total.items():
                used = np.flatnonzero(uses)
                yield pd.DataFrame({"lang": lang, "piece": used, "uses": uses[used]})

        counts = np.full_like(chances, SMOOTHING)
        for r in words.mapInPandas(uses, "lang string, piece int, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).toLocalIterator():
            counts[r["piece"], languages.index(r["lang"])] += r["uses"]
        chances = counts / counts.sum(0)
    whole = sum(sizes.values())
    return Model(path, languages, np.log([sizes[x] / whole for x in languages]), chances)


def predicted(spark: SparkSession, model: Model | None, text: Column) -> Column:
    """A struct of lang_pred and score."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, out = batch.tolist(), []
            for a, b in slices([t or "" for t in texts]):
                out += shared.value.predict(texts[a:b]) if shared.value else [("und", 0.0)] * (b - a)
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    return predict(text)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(id_crc("doc_id") % 5 != 0).select("doc_id", "text", "lang")


def identified(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose language is ``und`` or less likely than ``least_score``, all columns kept."""
    guess = predicted(docs.sparkSession, fit(training_rows(docs)), F.col("text"))
    return docs.where((guess["lang_pred"] != "und") & (guess["score"] >= least_score))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(training_rows(docs))
    held = F.coalesce(id_crc("doc_id") % 5 == 0, F.lit(False)).alias("held_out")
    return docs.select("doc_id", held, predicted(spark, model, F.col("text")).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")
