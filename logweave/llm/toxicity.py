"""Toxicity by a support vector machine on a gap-weighted subsequence string kernel.

A text is its letters and digits in lower case, styled letters folded to plain ones (NFKC); whatever stands between them is one blank, a character like others.
A sentence is as toxic as its worst window, and a document as its worst sentence. Windows are runs of neighbouring
words with the blanks around them: every word, every pair of at most PIECE characters, and longer runs of at most
LINKED, so insults parted by blanks or signs ("st up id", "i-d-i-o-t") are windows too; runs of single characters are
also joined to a word; longer words are cut into overlapping windows of PIECE characters. The kernel of two windows
sums, over all subsequences of three characters with less than SPAN characters from first to last, DECAY to the power
of both lengths, so gapped spellings and ones with inserted characters stay near the plain one. The kernel is scaled by
each window's own norm (taken over occurrences). A Nyström map over landmark windows makes the machine linear. Because
the subsequence features can be listed, the fitted sum over landmarks folds into one weight for each feature: each
character of a text gets the weights of the subsequences that start there, by their span, and sums of these along the
text give all its windows at once.

Only documents have labels, so sentences are labelled in rounds: each toxic document gives the window that the machine
finds worst as a toxic example (at first: the word that toxic documents hold oftenest beyond their share); clean
documents give their worst windows and a sample of others. A logistic curve, weighted to the true share of labels, turns the
worst window's margin into a score. The sample of labelled rows is bounded by ``rows_per_class``.

Defined cases: texts that are null or have no window score 0; without labels of both classes every score
is 0; labels repeated for an id count once, as toxic if any row says so; null labels are left out;
a to z and the letters of Latin-1 have a class each, all others are hashed to CLASSES classes; a text of any length is
scored whole, in blocks of BLOCK characters.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.common import hash_share, id_crc, keep, slices

ROWS_PER_CLASS = 4000
LANDMARKS = 160
ROUNDS = 4
#: Words that the first labelling starts from.
TELLING = 5000
DECAY = 0.7
SPAN = 8
CLASSES, BLANK = 64, 31
PIECE, OVERLAP, LINKED = 24, 8, 14
#: Characters whose subsequences are summed at once, and characters of text that a task turns into classes at once.
BLOCK, SLICE = 1 << 17, 1 << 19
THRESHOLD = 0.3
#: Windows whose landmarks' features the driver gathers at once.
GATHERED = 40
PENALTY = 1.0
NOTHING = -9.0
FOUND = "toxic int, first binary, second binary, other binary, margin double"

OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
WEIGHTS = np.array([DECAY ** (b + 1) for _, b in OFFSETS], np.float32)
_class = np.full(0x10000, BLANK, np.uint8)


def _fill_classes() -> None:
    for i in range(len(_class)):
        if (c := chr(i)).isalnum():
            _class[i] = i - 96 if "a" <= c <= "z" else 27 + i % 3 if c.isdigit() else 32 + i % 32


_fill_classes()


#: The norm of windows of each length: the root of the sum of all subsequences' squared weights.
NORM = np.sqrt([max(1e-9, sum((n - b) * DECAY ** (2 * b + 2) for _, b in OFFSETS if b < n)) for n in range(PIECE + 3)])


def folded(text: str) -> str:
    """Lower case; styled letters (bold, script, circled, of full width) as the plain ones that they stand for."""
    return (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()


def classes(text: str) -> np.ndarray:
    """Classes of a text's characters."""
    out = [np.empty(0, np.uint8)]
    for i in range(0, len(text), SLICE):
        codes = np.frombuffer(text[i : i + SLICE].encode("utf-32-le", "surrogatepass"), "<u4")
        own = _class[np.minimum(codes, 0xFFFF)]
        if len(high := np.flatnonzero(codes > 0xFFFF)):
            known, at = np.unique(codes[high], return_inverse=True)
            own[high] = np.array([32 + c % 32 if chr(c).isalnum() else BLANK for c in known.tolist()], np.uint8)[at]
        out.append(own)
    return np.concatenate(out)


class Windows:
    """The windows of texts: classes of all characters, and kinds of windows, each (starts, ends, texts) in order of starts."""

    def __init__(self, texts: list[str]):
        lowered = [folded(t) for t in texts]
        x = classes("\n" + "\n".join(lowered) + "\n")
        live = np.flatnonzero((x != BLANK) | np.concatenate([[True], x[:-1] != BLANK]))
        x = x[live]
        blank = np.flatnonzero(x == BLANK)
        starts, ends = blank[:-1], blank[1:] + 1
        borders = np.cumsum([1] + [len(t) + 1 for t in lowered])
        text = np.searchsorted(borders, live[starts + 1], "right") - 1
        long = ends - starts > PIECE + 2
        self.kinds = [(starts[~long], ends[~long], text[~long])] + self.pieces(starts[long], ends[long], text[long])
        run = 2
        while run <= LINKED:
            s, e, t = starts[: 1 - run], ends[run - 1 :], text[: 1 - run]
            near = (e - s <= (PIECE if run == 2 else LINKED) + 2) & (t == text[run - 1 :])
            if not near.any() and run > 2:
                break
            self.kinds.append((s[near], e[near], t[near]))
            run += 1
        self.classes = x
        self.join_singles(starts[ends - starts == 3] + 1, text[ends - starts == 3])

    @staticmethod
    def pieces(starts: np.ndarray, ends: np.ndarray, text: np.ndarray) -> list[tuple]:
        """Overlapping windows of stretches of any length."""
        if not len(starts):
            return []
        n = np.maximum(1, -(-(ends - starts - 2 - OVERLAP) // (PIECE - OVERLAP)))
        first = np.repeat(starts, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * (PIECE - OVERLAP)
        return [(first, np.minimum(first + PIECE + 2, np.repeat(ends, n)), np.repeat(text, n))]

    def join_singles(self, at: np.ndarray, text: np.ndarray) -> None:
        """Runs of three single characters or more are windows of one word as well, behind all the others."""
        if len(at) < 3:
            return
        new = np.concatenate([[True], (np.diff(at) != 2) | (np.diff(text) != 0)])
        first, size = np.flatnonzero(new), np.diff(np.append(np.flatnonzero(new), len(at)))
        first, size = first[size > 2], size[size > 2]
        if not len(first):
            return
        # each joined word with a blank on either side
        places = np.concatenate([[0], np.cumsum(size + 2)])
        joined = np.full(places[-1], BLANK, np.uint8)
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        joined[np.repeat(places[:-1], size) + 1 + inside] = self.classes[at[np.repeat(first, size) + inside]]
        base = len(self.classes)
        self.classes = np.concatenate([self.classes, joined])
        self.kinds += self.pieces(base + places[:-1], base + places[1:], text[first])

    def margins(self, table: np.ndarray) -> list[np.ndarray]:
        """For each kind, the sum of each window's feature weights in ``table``, over its norm."""
        out = [np.empty(len(starts)) for starts, _, _ in self.kinds]
        for a in range(0, len(self.classes), BLOCK):
            within = [slice(*np.searchsorted(starts, (a, a + BLOCK))) for starts, _, _ in self.kinds]
            sums = along(self.classes[a : a + BLOCK + PIECE + 2].astype(np.int32), table)
            for (starts, ends, _), i, values in zip(self.kinds, within, out):
                s, e = starts[i] - a, ends[i] - a
                values[i] = sums.of(s, e) / NORM[e - s]
        return out

    def words(self) -> set[bytes]:
        """The classes of the distinct words of at most PIECE characters."""
        whole, (starts, ends, _) = self.classes.tobytes(), self.kinds[0]
        return {whole[a:b] for a, b in zip(starts.tolist(), ends.tolist())}

    def cut(self, kind: int, i: int) -> bytes:
        """The classes of a window."""
        starts, ends, _ = self.kinds[kind]
        return self.classes[starts[i] : ends[i]].tobytes()


class along:
    """Sums of the weights of all subsequences within windows of a row of classes."""

    def __init__(self, x: np.ndarray, table: np.ndarray):
        n = len(x)
        by_span = np.zeros((SPAN, n + 1))
        for a in range(1, min(SPAN - 1, n - 1)):
            pairs = (x[: n - a] << 12) | (x[a:] << 6)
            for b in range(a + 1, min(SPAN, n)):
                by_span[b, 1 : n - b + 1] += table.take(pairs[: n - b] | x[b:], mode="clip")
        by_span *= DECAY ** (np.arange(SPAN)[:, None] + 1)
        self.before = np.cumsum(by_span, 1)  # of the subsequences of a span that start before a place
        self.all = self.before.sum(0)
        self.ended = np.zeros(n + 1)  # of the subsequences that end before a place
        for b in range(2, min(SPAN, n)):
            self.ended[b:] += self.before[b, : n + 1 - b]

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        total = self.ended[ends] - self.all[starts]
        short = np.flatnonzero(ends - starts < SPAN - 1)
        s, e = starts[short], ends[short]
        total[short] = sum(self.before[b, np.maximum(e - b, s)] for b in range(2, SPAN)) - self.all[s]
        return total


def encoded(word: str) -> bytes:
    """The window of a single text, whatever it holds."""
    return np.concatenate([[np.uint8(BLANK)], classes(folded(word)), [np.uint8(BLANK)]]).astype(np.uint8).tobytes()


def features(windows: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places of windows, codes, weights) of all subsequences, for windows of like length; weight 0: none."""
    order = sorted(range(len(windows)), key=lambda i: len(windows[i]))
    for at in range(0, len(order), 4000):
        places = order[at : at + 4000]
        lengths = np.array([len(windows[i]) for i in places])
        n = int(lengths.max())
        chars = np.zeros((len(places), n + SPAN), np.int32)
        chars[:, :n][np.arange(n) < lengths[:, None]] = np.frombuffer(b"".join(windows[i] for i in places), np.uint8)
        codes = np.empty((len(places), len(OFFSETS), n), np.int32)
        weights = np.empty(codes.shape, np.float32)
        for k, (a, b) in enumerate(OFFSETS):
            x, y, z = chars[:, :n], chars[:, a : a + n], chars[:, b : b + n]
            codes[:, k] = (x << 12) | (y << 6) | z
            weights[:, k] = (z > 0) * WEIGHTS[k]
        yield np.array(places), codes.reshape(len(places), -1), weights.reshape(len(places), -1)


def kernel(windows: list[bytes], landmarks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """K(windows, landmarks); the codes that landmarks use; the landmarks' scaled features over those."""
    used, parts = np.zeros(CLASSES**3, bool), list(features(landmarks))
    for _, codes, weights in parts:
        used[codes[weights > 0]] = True
    column, kept = np.cumsum(used) - 1, np.flatnonzero(used)
    own = np.zeros((len(landmarks), len(kept)))
    for places, codes, weights in parts:
        norm = np.sqrt((weights**2).sum(1, keepdims=True))
        rows = np.repeat(places, codes.shape[1]).reshape(codes.shape)
        live = weights > 0
        np.add.at(own, (rows[live], column[codes[live]]), (weights / np.maximum(norm, 1e-6))[live])
    out = np.zeros((len(windows), len(landmarks)))
    for places, codes, weights in features(windows):
        norm = np.sqrt((weights**2).sum(1, keepdims=True))
        live = (weights > 0) & used[codes]
        rows = np.broadcast_to(np.arange(len(places))[:, None], codes.shape)[live]
        scaled, columns = (weights / np.maximum(norm, 1e-6))[live], column[codes[live]]
        starts = np.flatnonzero(np.diff(rows, prepend=-1))
        for a in range(0, len(starts), GATHERED):
            first, last = starts[a], starts[a + GATHERED] if a + GATHERED < len(starts) else len(rows)
            out[places[rows[starts[a : a + GATHERED]]]] = np.add.reduceat(own.T[columns[first:last]] * scaled[first:last, None], starts[a : a + GATHERED] - first)
    return out, kept, own


def fit_machine(toxic: list[bytes], clean: list[bytes], landmarks: list[bytes]) -> np.ndarray:
    """Feature weights of a squared-hinge machine on the Nyström map; the last is the threshold."""
    windows = toxic + clean
    across, kept, own = kernel(windows, landmarks)
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks)[0])
    root = vectors / np.sqrt(np.maximum(values, 1e-4)) @ vectors.T
    x = np.hstack([across @ root, np.ones((len(windows), 1))])
    y = np.array([1.0] * len(toxic) + [-1.0] * len(clean))
    cost = PENALTY * np.where(y > 0, len(y) / (2 * len(toxic)), len(y) / (2 * len(clean)))
    beta = np.zeros(x.shape[1])
    ridge = np.eye(len(beta))
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        live = y * (x @ beta) < 1
        a = x[live] * cost[live, None]
        new = np.linalg.solve(ridge + a.T @ x[live], a.T @ y[live])
        if np.allclose(new, beta, atol=1e-6):
            break
        beta = new
    table = np.zeros(CLASSES**3 + 1, np.float32)
    table[kept] = (root @ beta[:-1]) @ own
    table[-1] = beta[-1]
    return table


def calibrated(margin: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of best weighted likelihood, with a prior that keeps them finite."""
    x = np.stack([margin, np.ones(len(margin))], 1)
    hits, misses = weight[toxic > 0].sum(), weight[toxic == 0].sum()
    y = np.where(toxic > 0, (hits + 1) / (hits + 2), 1 / (misses + 2))
    ab = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weight * (p - y)) + 1e-3 * ab)
        ab = ab - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(ab[0]), float(ab[1])


class Model:
    def __init__(self, table: np.ndarray, slope: float, offset: float):
        self.table, self.slope, self.offset = table, slope, offset

    def worst(self, texts: list[str]) -> np.ndarray:
        """The margin of each text's worst window."""
        own, out = Windows(texts), np.full(len(texts), NOTHING)
        for (_, _, text), values in zip(own.kinds, own.margins(self.table[:-1])):
            if len(text):
                # texts are in order
                at = np.flatnonzero(np.diff(text, prepend=-1))
                out[text[at]] = np.maximum(out[text[at]], np.maximum.reduceat(values, at) + self.table[-1])
        return np.round(out, 9)  # a text's place in a block doesn't show

    def scores(self, texts: list[str]) -> np.ndarray:
        worst = self.worst(texts)
        return np.where(worst == NOTHING, 0.0, 1 / (1 + np.exp(-np.clip(self.slope * worst + self.offset, -30, 30))))


def sample(docs: DataFrame, labels: DataFrame, rows_per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, toxic and text of about ``rows_per_class`` labelled rows of each class, and the classes' true sizes."""
    labels = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = F.lit(False)
    for value, n in sizes.items():
        chosen = chosen | ((F.col("toxic") == value) & hash_share(F.col("id"), min(1.0, rows_per_class / n)))
    # at most about two classes times rows_per_class ids
    rows = docs.select("doc_id", "text").join(F.broadcast(labels.where(chosen)), F.col("doc_id") == F.col("id")).where("text is not null")
    return keep(rows.select("doc_id", "toxic", "text"), "labelled"), sizes


def telling(rows: DataFrame, most: int = TELLING) -> dict[bytes, float]:
    """The ``most`` words that toxic rows hold oftenest beyond their share of all rows, and by how many deviations.

    Words of a single toxic row tell nothing and are left out.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = [Counter(), Counter()]
            for toxic, text in zip(batch["toxic"], batch["text"]):
                seen[int(toxic > 0)].update(Windows([text]).words())
            yield pd.DataFrame([(w, n, kind) for kind in (0, 1) for w, n in seen[kind].items()], columns=["word", "n", "kind"])

    sizes = rows.agg(F.count_if(F.col("toxic") > 0).alias("toxic"), F.count("*").alias("rows")).first()
    words = rows.select("toxic", "text").mapInPandas(count, "word binary, n long, kind int").groupBy("word").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("kind")).alias("toxic"))
    expected = F.col("n") * F.lit(sizes["toxic"] / max(1, sizes["rows"]))
    found = words.where("toxic > 1").select("word", ((F.col("toxic") - expected) / F.sqrt(expected + 0.5)).alias("beyond"))
    return {bytes(r["word"]): r["beyond"] for r in found.where("beyond > 0").orderBy(F.desc("beyond"), "word").limit(most).collect()}


def first_windows(rows: DataFrame, beyond: dict[bytes, float]) -> pd.DataFrame:
    """What ``worst_windows`` gives, by the words in ``beyond``; toxic rows that hold none of them are left out."""
    shared = rows.sparkSession.sparkContext.broadcast(beyond)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            out = []
            for toxic, text in zip(batch["toxic"] > 0, batch["text"]):
                words = sorted(Windows([text]).words(), key=lambda w: (-known.get(w, 0.0), w))
                if words and (not toxic or words[0] in known):
                    out.append((int(toxic), words[0], words[min(1, len(words) - 1)], words[len(words) // 2], known.get(words[0], 0.0)))
            yield pd.DataFrame(out, columns=["toxic", "first", "second", "other", "margin"])

    return rows.select("toxic", "text").mapInPandas(find, FOUND).toPandas()


def worst_windows(rows: DataFrame, table: np.ndarray) -> pd.DataFrame:
    """toxic, the two worst windows, one other, and the worst margin of each labelled row."""
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        for batch in batches:
            out = []
            for toxic, text in zip(batch["toxic"], batch["text"]):
                own = Windows([text])
                values = own.margins(table[:-1])
                flat = np.concatenate(values)
                if len(flat):
                    kind, place = np.repeat(np.arange(len(values)), list(map(len, values))), np.concatenate([np.arange(len(v)) for v in values])
                    order = np.argsort(-flat, kind="stable")
                    cut = lambda i, own=own, kind=kind, place=place: own.cut(kind[i], place[i])
                    first = cut(order[0])
                    second = next((w for w in map(cut, order[1:]) if w != first), first)
                    out.append((int(toxic > 0), first, second, cut(order[len(order) // 2]), flat[order[0]] + table[-1]))
            yield pd.DataFrame(out, columns=["toxic", "first", "second", "other", "margin"])

    return rows.select("toxic", "text").mapInPandas(find, FOUND).toPandas()


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> Model | None:
    rows, sizes = sample(docs, labels, rows_per_class)
    if not sizes.get(0) or not sum(n for v, n in sizes.items() if v > 0):
        return None

    def ordered(found: pd.DataFrame) -> pd.DataFrame:
        return found.assign(**{c: found[c].map(bytes) for c in ("first", "second", "other")}).sort_values(["toxic", "first", "second"])

    found = ordered(first_windows(rows, telling(rows)))
    if found["toxic"].nunique() < 2:
        return None
    for _ in range(ROUNDS):
        bad, good = found[found["toxic"] == 1], found[found["toxic"] == 0]
        counts = bad["first"].value_counts().sort_index().sort_values(ascending=False, kind="stable")
        hard = good.sort_values("margin", ascending=False, kind="stable")["first"].drop_duplicates()
        landmarks = list(dict.fromkeys([*counts.index[: LANDMARKS * 3 // 4], *hard[: LANDMARKS // 4]]))
        table = fit_machine(bad["first"].tolist(), [*good["first"], *good["second"], *good["other"]], landmarks)
        found = ordered(worst_windows(rows, table))
    truth = found["toxic"].to_numpy()
    weight = np.where(truth > 0, sum(n for v, n in sizes.items() if v > 0) / (truth > 0).sum(), sizes[0] / (truth == 0).sum())
    return Model(table, *calibrated(found["margin"].to_numpy(), truth, weight * len(truth) / weight.sum()))


def scored(spark: SparkSession, model: Model | None, text: Column) -> Column:
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = [t or "" for t in batch]
            out = np.zeros(len(texts))
            if shared.value:
                for a, b in slices(texts, SLICE):
                    out[a:b] = shared.value.scores(texts[a:b])
            yield pd.Series(out)

    return score(text)


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.where(id_crc("doc_id") % 4 != 2)


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more, all columns kept."""
    model = fit(docs, training_labels(labels))
    return docs.where(scored(docs.sparkSession, model, F.col("text")) < threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held = F.coalesce(id_crc("doc_id") % 4 == 2, F.lit(False)).alias("held_out")
    score = scored(spark, model, F.col("text")).alias("score")
    return docs.select("doc_id", held, score).withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
