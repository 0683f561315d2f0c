"""Operator 3 — toxicity by Levenshtein automata over a lexicon trie.

The lexicon is learned: words, and stems shared by many words, that mark toxic
rows of a bounded labelled sample.  The trie of its terms is intersected with
the Levenshtein automata of the terms (one edit from five letters on, two from
eight; stems one edit from five letters on) and made deterministic, so one table walk per
distinct token finds exact and misspelled terms.  Words under four letters are no terms; a
term must mark toxic rows by its odds and stand between MIN_ROWS different pairs of
neighbours there, so that the words of one much copied text are none.  A window of words around each hit tells quotation from
use: reporting words or quotation marks weaken it.

A text's score is a logistic sum of the log odds of the kinds of hits it holds
(term, exact or misspelled, used or quoted), learned from the same rows.  What a misspelled
term weighs is learned from edits planted into those rows: the toxic rows whose planted edit
is met, against the other rows that hold a near spelling as they stand or planted.

Defined results: null and empty texts hold no hit and score like any text
without one; without labelled rows, or with one class only, all score 0; rows with a null
label or id are not learned from, repeated labels count each; equal texts score
equally; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import crc_of_id, stored
from vigil.session import ship_package

#: labelled rows the model is fitted on, at most (the smallest hashes)
FIT_ROWS = 20_000
#: a term marks toxic rows this much more often (log odds), in so many of them and between so
#: many different pairs of neighbours
MIN_ODDS, MIN_ROWS = 4.0, 5
#: share of the uses of a term that are taken to be misspelled
MISSPELT = 0.05
#: a kind of hit with lower log odds is no evidence
MIN_WEIGHT = 1.0
STEMS = (4, 5, 6)
#: words on each side that tell quotation from use
WINDOW = 6
CACHE = 600_000

# fixed values: marks and words that report speech
QUOTES = "\"“”„«»"
REPORTING = {
    "said", "says", "quote", "quoted", "quotes", "wrote", "word", "term", "called", "reported", "article",
    "dit", "mot", "citation", "cite", "sagte", "wort", "zitat", "zitiert", "dijo", "palabra", "cita",
}
EDGES = ".,;:!?()[]{}<>|*#&%'`‘’…" + QUOTES


def tokens_of(text: str) -> list[str]:
    return text.lower().split()


def bare(token: str) -> str:
    return token.strip(EDGES)


def edits(term: str) -> int:
    """Edits allowed to a term; to a stem, open to any continuation, one at most."""
    n = len(term.rstrip("*"))
    return 0 if n < 5 else 1 if n < 8 or term.endswith("*") else 2


class Automaton:
    """Deterministic automaton of all strings within the allowed edits of a term.

    A term that ends in ``*`` accepts any continuation.  States are sets of
    (trie node, edits spent); ``verdict`` holds the best accepted (edits, term)."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        nodes: list[dict[str, int]] = [{}]
        end: dict[int, list[int]] = {}
        reach: list[int] = [0]                       # edits some term below the node allows
        for t, term in enumerate(terms):
            at = 0
            k = edits(term)
            reach[0] = max(reach[0], k)
            for c in term.rstrip("*"):
                if c not in nodes[at]:
                    nodes[at][c] = len(nodes)
                    nodes.append({})
                    reach.append(0)
                at = nodes[at][c]
                reach[at] = max(reach[at], k)
            end.setdefault(at, []).append(t)
        self.alphabet = {c: i + 1 for i, c in enumerate(sorted({c for n in nodes for c in n}))}

        def closed(states: set[tuple[int, int]]) -> frozenset:
            todo = list(states)
            while todo:
                node, e = todo.pop()
                for child in nodes[node].values():
                    if e + 1 <= reach[child] and (child, e + 1) not in states:
                        states.add((child, e + 1))
                        todo.append((child, e + 1))
            least: dict[int, int] = {}
            for node, e in states:
                least[node] = min(e, least.get(node, e))
            return frozenset(least.items())

        def accepted(states: frozenset, stem: bool) -> tuple[int, int]:
            got = [(e, t) for node, e in states for t in end.get(node, ())
                   if e <= edits(terms[t]) and (not stem or terms[t].endswith("*"))]
            return min(got, default=(9, -1))

        first = (closed({(0, 0)}), (9, -1))          # (states, best stem passed so far)
        index = {first: 0}
        todo, table, verdict = [first], [], []
        while todo:
            here = todo.pop(0)
            states, passed = here
            passed = min(passed, accepted(states, True))
            verdict.append(min(passed, accepted(states, False)))
            row = [0] * (len(self.alphabet) + 1)
            for c, i in [(None, 0), *self.alphabet.items()]:
                new = set()
                for node, e in states:
                    if c in nodes[node]:
                        new.add((nodes[node][c], e))
                    if e + 1 <= reach[node]:
                        new.add((node, e + 1))
                        new.update((child, e + 1) for child in nodes[node].values() if e + 1 <= reach[child])
                nxt = (closed(new), passed)
                if nxt not in index:
                    index[nxt] = len(index)
                    todo.append(nxt)
                row[i] = index[nxt]
            table.append(row)
        self.table = np.asarray(table, np.int32)
        self.verdict = np.asarray(verdict, np.int32)
        self.lookup = np.zeros(0x110000, np.int32)
        for c, i in self.alphabet.items():
            self.lookup[ord(c)] = i

    def match(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(edits, term) of the best match of each word; term -1 for none."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        cls = self.lookup[np.minimum(code, 0x10FFFF)]
        start = np.cumsum(size) - size
        state = np.zeros(len(words), np.int32)
        order = np.argsort(-size, kind="stable")
        alive = len(words)
        for i in range(int(size.max(initial=0))):
            alive = int(np.searchsorted(-size[order[:alive]], -i, "left"))   # longer than i
            who = order[:alive]
            state[who] = self.table[state[who], cls[start[who] + i]]
        best = self.verdict[state]
        return best[:, 0], best[:, 1]


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and other rows hold each word and each stem (with *)."""
    for b in batches:
        seen = (Counter(), Counter())
        for toxic, text in zip(b.column("toxic").to_pylist(), b.column("text").to_pylist()):
            words = {w for w in map(bare, set(tokens_of(text or ""))) if len(w) >= 4}
            seen[toxic].update(words)
            seen[toxic].update({w[:n] + "*" for w in words for n in STEMS if len(w) > n})
        words = list(seen[1])                       # a term of no toxic row of any batch is no candidate
        words += [w for w in seen[0] if w not in seen[1]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array([seen[1][w] for w in words], pa.int64()),
             pa.array([seen[0][w] for w in words], pa.int64())], ["term", "t", "f"])


def _contexts(batches: Iterator[pa.RecordBatch], terms: frozenset) -> Iterator[pa.RecordBatch]:
    """The pairs of neighbours that each term has in toxic rows, once a batch."""
    for b in batches:
        seen = set()
        for toxic, text in zip(b.column("toxic").to_pylist(), b.column("text").to_pylist()):
            words = [bare(w) for w in tokens_of(text or "")] if toxic else []
            for i, w in enumerate(words):
                for term in (w, *(w[:n] + "*" for n in STEMS if len(w) > n)):
                    if term in terms:
                        seen.add((term, " ".join(words[max(0, i - 1):i] + ["_"] + words[i + 1:i + 2])))
        pairs = sorted(seen)
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)],
                                         ["term", "near"])


def odds(t, f, toxic: int, other: int):
    """Smoothed log odds of a thing seen in t toxic and f other rows."""
    return np.log((np.asarray(t) + 0.5) / (toxic + 1)) - np.log((np.asarray(f) + 0.5) / (other + 1))


def learn_lexicon(sample: DataFrame, toxic: int, other: int) -> list[str]:
    """Terms that mark toxic rows: stems where many words share one, else words."""
    counted = sample.mapInArrow(_terms, "term string, t bigint, f bigint") \
        .groupBy("term").agg(F.sum("t").alias("t"), F.sum("f").alias("f"))
    strong = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("f") + 0.5) / (other + 1)) >= MIN_ODDS
    found = counted.where((F.col("t") >= MIN_ROWS) & strong).toPandas()
    seen = dict(zip(found["term"], found["t"]))
    spread = sample.where("toxic = 1").mapInArrow(partial(_contexts, terms=frozenset(seen)), "term string, near string") \
        .groupBy("term").agg(F.count_distinct("near").alias("n")).where(F.col("n") >= MIN_ROWS).select("term").collect()
    seen = {r.term: seen[r.term] for r in spread}
    words = {w: t for w, t in seen.items() if not w.endswith("*")}
    under: dict[str, list[int]] = {}
    for w, t in words.items():
        for n in STEMS:
            under.setdefault(w[:n] + "*", []).append(t)
    stems = {}
    for s in sorted((s for s in seen if s.endswith("*")), key=len):
        if any(s[:n] + "*" in seen for n in STEMS if n < len(s) - 1):
            continue                                        # a shorter stem speaks for it
        if max(under.get(s, [0])) < 0.5 * seen[s]:          # else one word speaks for the stem
            # the longest stem that keeps nearly all its rows
            longer = [x for x in seen if x.endswith("*") and x.startswith(s[:-1]) and seen[x] >= 0.9 * seen[s]]
            stems[max(longer, key=len)] = seen[s]
    # a stem of four letters allows no edit, so words under it stay terms of their own
    rest = [w for w in words if not any(w[:n] + "*" in stems for n in STEMS if n >= 5 or len(w) < 5)]
    return sorted(rest) + sorted(stems)


_machines: dict[tuple, tuple] = {}


def machine(terms: list[str]):
    """The automaton of the terms and its cache of tokens, kept per worker."""
    key = tuple(terms)
    if key not in _machines:
        _machines.clear()
        _machines[key] = (Automaton(terms), {})
    return _machines[key]


def quoted(tokens: list[str], i: int) -> bool:
    """Whether the window around token i reports it instead of using it."""
    near = tokens[max(0, i - WINDOW):i + WINDOW + 1]
    marks = sum(any(q in t for q in QUOTES) for t in near)
    return tokens[i][0] in QUOTES or marks >= 2 or any(bare(t) in REPORTING for t in near)


def hits(texts: list[str], terms: list[str]) -> Iterator[set[tuple[int, int, int]]]:
    """For each text its kinds of hits: (term, misspelled, quoted)."""
    auto, known = machine(terms)
    split = [tokens_of(t) for t in texts]
    distinct = [set(s) for s in split]
    missing = list({t for d in distinct for t in d if t not in known})
    if len(known) + len(missing) > CACHE:
        known.clear()
        missing = list({t for d in distinct for t in d})
    if missing:
        e, t = auto.match([bare(m) for m in missing])
        known.update(zip(missing, np.where(t >= 0, 2 * t + (e > 0), -1).tolist()))
    for tokens, d in zip(split, distinct):
        if all(known[t] < 0 for t in d):
            yield set()
        else:
            yield {(known[t] // 2, known[t] % 2, int(quoted(tokens, i)))
                   for i, t in enumerate(tokens) if known[t] >= 0}


def misspelt(text: str, terms: list[str]) -> str | None:
    """The text with one edit in each exact term of five letters or more; None if it holds none.

    The hash of a word decides whether a letter goes, is doubled or becomes another one."""
    known = machine(terms)[1]
    out, changed = tokens_of(text), False
    for i, token in enumerate(out):
        word = bare(token)
        if known.get(token, -1) >= 0 and known[token] % 2 == 0 and len(word) >= 5:
            h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
            at, how = token.index(word) + h // 3 % len(word), h % 3
            middle = ("", token[at] * 2, "x" if token[at] != "x" else "y")[how]
            out[i], changed = token[:at] + middle + token[at + 1:], True
    return " ".join(out) if changed else None


def _kinds(batches: Iterator[pa.RecordBatch], terms: list[str]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seen, planted = (Counter(), Counter()), (Counter(), Counter())
        toxic, texts = b.column("toxic").to_pylist(), [t or "" for t in b.column("text").to_pylist()]
        for lo in range(0, len(texts), 128):
            part = texts[lo:lo + 128]
            edited = []
            for y, text, h in zip(toxic[lo:lo + 128], part, list(hits(part, terms))):
                seen[y].update(h or [(-1, 0, 0)])
                if h:
                    edited.append((y, misspelt(text, terms), h))
            edited = [(y, text, h) for y, text, h in edited if text is not None]
            for (y, _, h), new in zip(edited, list(hits([text for _, text, _ in edited], terms))):
                planted[y].update(k for k in new if k[1] and k not in h)
        kinds = sorted(set().union(*seen, *planted))
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[i] for k in kinds], pa.int32()) for i in range(3)] +
            [pa.array([c[k] for k in kinds], pa.int64()) for c in (seen[1], seen[0], planted[1], planted[0])],
            ["term", "misspelled", "quoted", "t", "f", "pt", "pf"])


def _scores(batches: Iterator[pa.RecordBatch], terms: list[str], weights: dict, none: float, prior: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, out = b.column("text").to_pylist(), []
        for lo in range(0, len(texts), 128):
            for h in hits([t or "" for t in texts[lo:lo + 128]], terms):
                found = sum(weights.get(k, 0.0) for k in h)
                z = prior + found if found else none
                out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.float64())], ["id", "score"])


def fit(docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", fit_rows: int = FIT_ROWS):
    """(terms, weights of the kinds of hits, log odds of a text without hits, of any text)."""
    known = labels.where(learn & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
    n = known.count()
    rate = int((1 << 30) * min(1.0, fit_rows / max(n, 1)))
    known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < rate)        # about fit_rows rows
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")) \
        .join(F.broadcast(known), "id").select("toxic", "text").dropDuplicates()   # copies count once
    sample = stored(rows, "labelled-sample")
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not other:
        return [], {}, -30.0, -30.0
    terms = learn_lexicon(sample, toxic, other)
    kinds = sample.mapInArrow(partial(_kinds, terms=terms),
                              "term int, misspelled int, quoted int, t bigint, f bigint, pt bigint, pf bigint") \
        .groupBy("term", "misspelled", "quoted").agg(*[F.sum(c).alias(c) for c in ("t", "f", "pt", "pf")]).collect()
    none = next(((r.t, r.f) for r in kinds if r.term < 0), (0, 0))
    base = float(np.log((none[0] + 0.5) / (none[1] + 0.5)))
    # one more near spelling in other rows than the sample shows: spellings not seen there occur
    seen = {(r.term, r.misspelled, r.quoted): (r.t + MISSPELT * r.pt, r.f + MISSPELT * r.pf + r.misspelled) for r in kinds if r.term >= 0}
    weights = {}
    for t in range(len(terms)):
        for m in (0, 1):
            plain = seen.get((t, m, 0), (0, 0))
            # a misspelling is no stronger evidence than the term; an unseen quotation counts a tenth
            own = float(odds(*plain, toxic, other)) if sum(plain) else 0.0
            own = min(own, weights[t, 0, 0]) if m else own
            weights[t, m, 0] = own
            q = seen.get((t, m, 1), (0, 0))
            weights[t, m, 1] = float(odds(*q, toxic, other)) if sum(q) else own / 10
    return terms, {k: w for k, w in weights.items() if w >= MIN_WEIGHT}, base, float(odds(toxic, other, 0, 0))


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1) of every row."""
    ship_package(docs.sparkSession)
    terms, weights, none, prior = model
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if not terms:
        return rows.select("id", F.lit(float(1 / (1 + np.exp(-none))) if none > -30 else 0.0).alias("score"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(partial(_scores, terms=terms, weights=weights, none=none, prior=prior), f"id {kind}, score double")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(crc_of_id(id_col) % 5 == 0, F.lit(False))


def toxicity_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; learned from rows not held out."""
    ship_package(docs.sparkSession)
    model = fit(docs, labels, ~held_out())
    return score(docs, model).select(
        F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
