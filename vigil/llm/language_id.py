"""Operator 5 — language identification by segmentation-marginalised unigrams.

Every language gives each piece of a fixed public vocabulary a probability.  A
word's probability is the sum over all its segmentations into pieces, taken by
the forward algorithm; a text's score is the sum of its words' log
probabilities.  Piece probabilities are fitted by expectation maximisation on a
bounded sample of labelled rows (``FIT_ROWS`` per language, smallest hashes);
prediction covers every word of every text.

Words are runs of letters in lower case; runs over 64 letters are scored in
parts of 64.  A letter outside the vocabulary is a piece of its own with the
language's share of such letters.  Defined results: a text that is null or has no
letter is ``und`` with score 0; without labelled rows all are; rows with a null
label are never learned from; equal rows are equal; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import crc_of_id, stored
from vigil.session import ship_package

FIT_ROWS = 3000
EM_ROUNDS = 3
MAX_PIECE = 12
PART = 64
#: distinct words whose scores a worker keeps
CACHE = 400_000
#: per-letter factor that keeps forward sums within range
LIFT = 16.0

letters = re.compile(r"[^\W\d_]+").findall


class Vocabulary:
    """Pieces that consist of letters, as a trie in flat arrays."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        words = {sp.id_to_piece(i).lstrip("▁").lower() for i in range(sp.get_piece_size())
                 if not sp.is_control(i) and not sp.is_unknown(i) and not sp.is_byte(i)}
        self.pieces = sorted(w for w in words if 0 < len(w) <= MAX_PIECE and letters(w) == [w])
        chars = sorted({c for w in self.pieces for c in w})
        self.classes = {ord(c): i + 1 for i, c in enumerate(chars)}
        self.width = len(chars) + 1
        ends: dict[int, int] = {}
        edges: dict[int, int] = {}
        for p, w in enumerate(self.pieces):
            at = 0
            for c in w:
                key = at * self.width + self.classes[ord(c)]
                at = edges.setdefault(key, len(edges) + 1)
            ends[at] = p
        self.edge_keys = np.array(sorted(edges), dtype=np.int64)
        self.edge_to = np.array([edges[k] for k in sorted(edges)], dtype=np.int64)
        self.piece_at = np.full(len(edges) + 1, -1, dtype=np.int64)
        for node, p in ends.items():
            self.piece_at[node] = p
        self.lookup = np.zeros(0x110000, dtype=np.int32)
        self.lookup[list(self.classes)] = list(self.classes.values())
        self.unknown = len(self.pieces)                     # a letter outside the vocabulary

    def arcs(self, words: list[str]):
        """(start, end, piece) of every piece in the joined words, word ends, and the letters."""
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        size = np.fromiter(map(len, words), np.int64, len(words))
        stop = np.cumsum(size)
        end_of = np.repeat(stop, size)
        cls = self.lookup[np.minimum(code, 0x10FFFF)].astype(np.int64)
        at = np.arange(len(code))
        state = np.zeros(len(code), np.int64)
        odd = np.flatnonzero(cls == 0)
        found = [(odd, odd + 1, np.full(len(odd), self.unknown))]
        for n in range(MAX_PIECE):
            alive = at + n < end_of[at]
            at, state = at[alive], state[alive]
            c = cls[at + n]
            key = state * self.width + c
            i = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
            ok = (self.edge_keys[i] == key) & (c > 0)
            at, state = at[ok], self.edge_to[i[ok]]
            p = self.piece_at[state]
            hit = p >= 0
            found.append((at[hit], at[hit] + n + 1, p[hit]))
            if not len(at):
                break
        start, end, piece = (np.concatenate(x) for x in zip(*found))
        return start, end, piece, size, stop


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _steps(start: np.ndarray, size: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the arcs by their start within the word, and where each start begins."""
    rel = start - np.repeat(stop - size, size)[start]
    order = np.argsort(rel, kind="stable")
    return order, np.searchsorted(rel[order], np.arange(int(size.max(initial=0)) + 1))


def forward(v: Vocabulary, words: list[str], prob: np.ndarray):
    """log probability (words x languages) summed over all segmentations; prob: pieces x languages."""
    start, end, piece, size, stop = v.arcs(words)
    order, bounds = _steps(start, size, stop)
    start, end, piece = start[order], end[order], piece[order]
    # one cell before each word's letters: position i of word w is cell i + w
    word = np.repeat(np.arange(len(words)), size)
    cell_from, cell_to = start + word[start], end + word[start]
    alpha = np.zeros((int(stop[-1]) + len(words), prob.shape[1]))
    alpha[stop - size + np.arange(len(words))] = 1.0
    weight = prob[piece] * (LIFT ** (end - start))[:, None]
    for a, z in zip(bounds, bounds[1:]):
        np.add.at(alpha, cell_to[a:z], alpha[cell_from[a:z]] * weight[a:z])
    total = alpha[stop + np.arange(len(words))]
    return np.log(total) - (size * np.log(LIFT))[:, None], (alpha, cell_from, cell_to, piece, weight, bounds)


def expected_counts(v: Vocabulary, words: list[str], times: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in the words (one language; prob: pieces x 1)."""
    _, (alpha, cell_from, cell_to, piece, weight, bounds) = forward(v, words, prob)
    size = np.fromiter(map(len, words), np.int64, len(words))
    last = np.cumsum(size) + np.arange(len(words))
    beta = np.zeros(len(alpha))
    beta[last] = times / alpha[last, 0]
    w = weight[:, 0]
    out = np.zeros(len(prob))
    for a, z in zip(bounds[-2::-1], bounds[:0:-1]):
        np.add.at(beta, cell_from[a:z], beta[cell_to[a:z]] * w[a:z])
    np.add.at(out, piece, alpha[cell_from, 0] * w * beta[cell_to])
    return out


def words_of(text: str) -> list[str]:
    found = letters(text.lower())
    if any(len(w) > PART for w in found):
        found = [w[i:i + PART] for w in found for i in range(0, len(w), PART)]
    return found


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            counts.setdefault(lang, Counter()).update(words_of(text or ""))
        rows = [(g, w, n) for g, c in counts.items() for w, n in c.items()]
        cols = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()),
                                          pa.array(cols[2], pa.int64())], ["lang", "word", "n"])


def _expect(batches: Iterator[pa.RecordBatch], path: str, model: dict) -> Iterator[pa.RecordBatch]:
    v = vocabulary(path)
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        langs, words = np.asarray(b.column("lang").to_pylist(), object), b.column("word").to_pylist()
        n = b.column("n").to_numpy().astype(float)
        for g in set(langs):
            at = np.flatnonzero(langs == g)
            for lo in range(0, len(at), 20_000):
                part = at[lo:lo + 20_000]
                e = expected_counts(v, [words[i] for i in part], n[part], model[g][:, None])
                sums[g] = sums.get(g, 0) + e
    for g, e in sums.items():
        used = np.flatnonzero(e)
        yield pa.RecordBatch.from_arrays([pa.array([g] * len(used), pa.string()), pa.array(used),
                                          pa.array(e[used])], ["lang", "piece", "e"])


def fit(docs: DataFrame, path: str, learn, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang", fit_rows: int = FIT_ROWS, rounds: int = EM_ROUNDS) -> dict[str, np.ndarray]:
    """Piece probabilities of every language: one array of the vocabulary's size each."""
    ship_package(docs.sparkSession)
    v = vocabulary(path)
    rows = docs.where(learn & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"),
        F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 30)).alias("h"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    limit = F.create_map(*[F.lit(x) for g, n in sizes.items()
                           for x in (g, int((1 << 30) * min(1.0, fit_rows / n)))])
    sample = rows.where(F.col("h") < limit[F.col("lang")])
    counts = stored(sample.mapInArrow(_word_counts, "lang string, word string, n bigint")
                    .groupBy("lang", "word").agg(F.sum("n").alias("n")).repartition(24), "language-words")
    start = np.append(np.full(v.unknown, 1.0), 1.0) * 0.05 ** np.array([*map(len, v.pieces), 1])
    model = {g: start / start.sum() for g in sizes}
    for _ in range(rounds):
        found = counts.mapInArrow(partial(_expect, path=path, model=model), "lang string, piece bigint, e double") \
            .groupBy("lang", "piece").agg(F.sum("e").alias("e")).toPandas()
        for g, part in found.groupby("lang"):
            e = np.full(v.unknown + 1, 1e-3) * 0.5 ** np.array([*map(len, v.pieces), 1])
            e[part["piece"].to_numpy()] += part["e"].to_numpy()
            model[g] = e / e.sum()
    return model


class _Scorer:
    def __init__(self, path: str, langs: list[str], prob: np.ndarray):
        self.v, self.langs, self.prob = vocabulary(path), langs, prob
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(langs)))

    def learn(self, words: list[str]) -> None:
        missing = [w for w in dict.fromkeys(words) if w not in self.known]
        if len(self.known) + len(missing) > CACHE:
            self.known, self.rows = {}, np.zeros((0, len(self.langs)))
            missing = list(dict.fromkeys(words))
        for lo in range(0, len(missing), 20_000):
            part = missing[lo:lo + 20_000]
            self.known.update(zip(part, range(len(self.rows), len(self.rows) + len(part))))
            self.rows = np.concatenate([self.rows, forward(self.v, part, self.prob)[0]])


_scorers: dict[bytes, _Scorer] = {}


def _scorer(path: str, langs: list[str], prob: np.ndarray) -> _Scorer:
    import hashlib
    key = hashlib.blake2b(prob.tobytes() + "\0".join(langs).encode()).digest()
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = _Scorer(path, langs, prob)
    return _scorers[key]


def _predict(batches: Iterator[pa.RecordBatch], path: str, langs: list[str], prob: np.ndarray, text_col: str,
             keep: list[str], names: list[str]) -> Iterator[pa.RecordBatch]:
    s = _scorer(path, langs, prob)
    for b in batches:
        texts = b.column(text_col).to_pylist()
        pred, score = [], []
        for lo in range(0, len(texts), 128):
            split = [words_of(t or "") for t in texts[lo:lo + 128]]
            s.learn([w for ws in split for w in ws])
            for ws in split:
                if not ws:
                    pred.append("und")
                    score.append(0.0)
                    continue
                total = s.rows[np.fromiter(map(s.known.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
                total = np.exp(total - total.max())
                best = int(total.argmax())
                pred.append(langs[best])
                score.append(float(total[best] / total.sum()))
        yield pa.RecordBatch.from_arrays(
            [b.column(c) for c in keep] + [pa.array(pred, pa.string()), pa.array(score, pa.float64())], names)


def annotate(docs: DataFrame, model: dict[str, np.ndarray], path: str, text_col: str, pred: str, score: str,
             keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all, if not given) and the prediction of every row."""
    ship_package(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    if not model:
        return docs.select(*keep, F.lit("und").alias(pred), F.lit(0.0).alias(score))
    langs = sorted(model)
    prob = np.stack([model[g] for g in langs], axis=1)
    out = docs.select(*keep, F.lit("").alias(pred), F.lit(0.0).alias(score)).schema
    return docs.mapInArrow(partial(_predict, path=path, langs=langs, prob=prob, text_col=text_col, keep=keep,
                                   names=out.names), out)


def identify(docs: DataFrame, model: dict[str, np.ndarray], path: str, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """id, lang_pred, score of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return annotate(rows, model, path, "text", "lang_pred", "score", ["id"])


def held_out(id_col: str = "doc_id"):
    return F.coalesce(crc_of_id(id_col) % 3 == 1, F.lit(False))


def language_of(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows that are not held out."""
    model = fit(docs, path, ~held_out())
    return identify(docs, model, path).select(
        F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score")
