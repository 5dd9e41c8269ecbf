"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Voters are lexicons and patterns. Some words are given; more words, and openings
of words, are mined where labelled training rows use them unevenly. A voter that
fires votes its side, or abstains. Labels choose voters and tell the toxic class's
share; the label model itself sees none. It takes the true class as hidden, on
labelled and unlabelled rows alike: expectation maximisation estimates how often
each voter fires in each class (its accuracy) and the covariance of voters within
classes (their correlations), so voters that fire together are not counted twice.
Its posteriors are the targets of a logistic classifier over terms of the text,
which is all that scoring needs.

Mining and fitting use a bounded sample: the ``fit_rows`` labelled and the
``free_rows`` unlabelled training rows of least hashed id. Every row's whole text
is scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, slices, text_or_empty

FOLDS, HELD = 5, 0
FIT_ROWS = 16_000
#: Unlabelled training rows that the label model and the classifier see too.
FREE_ROWS = 8_000
#: Frequent terms among the classifier's inputs.
COMMON = 400
#: Mined voters: at most so many on each side, each in so many sampled rows at least.
MINED, LEAST_ROWS = 250, 5
OPENINGS = (4, 5, 6, 7, 8)
#: Given lexicons, in no way complete: mining adds what a corpus uses.
LEXICONS = {
    "insults_en": "idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb fool filth vermin creep jerk coward",
    "insults_de": "idiot dumm dummkopf trottel abschaum müll wertlos erbärmlich widerlich versager arschloch",
    "insults_fr": "idiot imbécile stupide ordure déchet minable pathétique répugnant crétin abruti connard",
    "insults_es": "idiota imbécil estúpido basura escoria patético asqueroso perdedor inútil payaso cabrón",
    "threats": "kill hurt destroy die burn töten sterben tuer mourir matar morir",
    "second_person": "you your yourself du dich dein tu toi ton vous tú tus usted",
}
WORD = re.compile(r"[^\W\d_]+")
PATTERNS = {"shouting": re.compile(r"\b[A-Z]{4,}\b"), "bangs": re.compile(r"!{2,}"), "masked": re.compile(r"\w[*@#$]{1,4}\w"), "spaced": re.compile(r"\b(?:\w[.\-_ ]){4,}\w\b"), "stretched": re.compile(r"(\w)\1{3,}")}


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def terms_of(text: str) -> set[str]:
    """The lower-cased words of a text."""
    return set(WORD.findall(text.lower()))


def openings(word: str) -> list[str]:
    """What of a word is a candidate: itself, and its openings, marked by a hyphen."""
    return [word, *(f"{word[:n]}-" for n in OPENINGS if n < len(word))]


class Terms:
    """Tells which of some terms a text holds; ``lists`` may give a term several numbers."""

    def __init__(self, terms: list[str], lists: tuple[str, ...] = ()):
        self.by_term: dict[str, list[int]] = {}
        for i, words in enumerate(lists):
            for w in words.split():
                self.by_term.setdefault(w, []).append(i)
        for i, term in enumerate(terms, len(lists)):
            self.by_term.setdefault(term, []).append(i)
        self.known: dict[str, tuple[int, ...]] = {}

    def held(self, text: str) -> set[int]:
        found, known, by_term = set(), self.known, self.by_term
        for word in terms_of(text):
            hits = known.get(word)
            if hits is None:
                hits = tuple(sorted({i for t in openings(word) for i in by_term.get(t, ())}))
                if len(known) >= 500_000:
                    known.clear()
                known[word] = hits
            if hits:
                found.update(hits)
        return found


class Voters:
    """Tells which voters fire on a text: lexicons, then patterns, then mined terms."""

    def __init__(self, mined: list[str]):
        n = len(LEXICONS)
        self.terms = Terms(["", *[""] * (len(PATTERNS) - 1), *mined], tuple(LEXICONS.values()))
        self.patterns = list(enumerate(PATTERNS.values(), n))

    def fire(self, text: str) -> set[int]:
        """The voters that fire on a text."""
        fired = self.terms.held(text)
        fired.update(i for i, pattern in self.patterns if pattern.search(text))
        return fired


def sample(docs: DataFrame, labels: DataFrame, fit_rows: int, free_rows: int, id_col: str, text_col: str) -> DataFrame:
    """(text, toxic) of the sampled rows, toxic null where there is no label. Ids are bounded by both numbers and so may be broadcast."""
    given = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    known = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic is not null")
    known = known.where(fold(F.col("id")) != HELD).groupBy("id").agg(F.max("toxic").alias("toxic"))
    least = lambda df, n: df.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(n)
    chosen = checkpoint(least(known, fit_rows))
    # an unlabelled row gets its chance by its id's hash; a top list of as many as there may be labelled ones, less those that are
    free = given.select("id").where(F.col("id").isNotNull() & (fold(F.col("id")) != HELD))
    free = least(free.join(labels.select(F.col(id_col).alias("id")), "id", "left_anti").distinct(), free_rows).select("id", F.lit(None).cast("int").alias("toxic"))
    chosen = checkpoint(chosen.union(free))
    return checkpoint(given.join(F.broadcast(chosen), "id").select("text", "toxic"))


def mine(rows: DataFrame, mined: int = MINED, least: int = LEAST_ROWS) -> list[tuple[str, int]]:
    """Terms that labelled rows use unevenly, with the side they vote for; at most ``mined`` for each side."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        n = [0, 0]
        for b in batches:
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                if toxic is None:
                    continue
                side = int(toxic > 0)
                n[side] += 1
                seen[side].update({t for w in terms_of(text) for t in openings(w)})
        terms = ["", *(t for t in seen[0].keys() | seen[1].keys() if t)]
        yield pa.RecordBatch.from_arrays([pa.array(terms), *(pa.array([n[k], *(seen[k][t] for t in terms[1:])]) for k in (0, 1))], ["term", "clean", "toxic"])

    counted = checkpoint(rows.mapInArrow(count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    total = counted.where("term = ''").first()
    if total is None or not total.clean or not total.toxic:
        return []
    odds = F.log((F.col("toxic") + 0.5) / (total.toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (total.clean + 1.0))
    scored = counted.where(f"term <> '' and clean + toxic >= {least}").withColumn("odds", odds)
    # evidence: the log-likelihood ratio of the term's two counts, signed
    p = F.lit(total.toxic / (total.toxic + total.clean))
    n = F.col("toxic") + F.col("clean")
    rate = F.col("toxic") / n
    term = lambda k, r, q: F.when(k > 0, k * F.log(r / q)).otherwise(0.0)
    scored = scored.withColumn("g", term(F.col("toxic"), rate, p) + term(F.col("clean"), 1 - rate, 1 - p))
    out = []
    for side, where in ((1, "odds > 1.0"), (-1, "odds < -1.0")):
        best = scored.where(where).orderBy(F.desc("g"), F.length("term"), "term").limit(mined).select("term").collect()  # bounded by mined
        out += [(r.term, side) for r in best]
    return out


def label_model(votes: np.ndarray, sides: np.ndarray, share: float, rounds: int = 8) -> np.ndarray:
    """Posteriors of the hidden class for rows of 0/1 ``votes``; no label is seen.

    ``sides`` (1 or -1 for each voter) tells which class is which, and ``share`` is
    the toxic class's expected share: the rows with the most votes on its side, for
    their number of votes, start there. Expectation maximisation then estimates how
    often each voter fires in each class and the covariance of voters within classes.
    """
    n, x = len(votes), votes
    # a voter that seldom fires tells more: votes start with the information that they carry
    worth = (sides * -np.log((x.sum(axis=0) + 1) / (n + 2))).astype(np.float32)
    lean = np.concatenate([part @ worth for _, part in blocks(x)])
    edge = np.quantile(lean, 1 - min(max(share, 1 / n), 0.5))
    post = np.where(lean > edge, 0.9, 0.1).astype(np.float32)
    for _ in range(rounds):
        fired = [np.zeros(x.shape[1]), np.zeros(x.shape[1])]
        both = np.zeros((x.shape[1], x.shape[1]))
        for rows, part in blocks(x):
            both += part.T @ part
            for k, p in enumerate((1 - post[rows], post[rows])):
                fired[k] += p @ part
        mass = [(1 - post).sum() + 1.0, post.sum() + 1.0]
        rate = [(f + 0.05) / (m + 0.1) for f, m in zip(fired, mass)]  # accuracies
        cov = (both - sum(m * np.outer(r, r) for m, r in zip(mass, rate))) / (n + 2.0)  # correlations within a class
        spread = np.maximum(np.diag(cov), 1e-5)
        direction = np.linalg.solve(cov + np.diag(0.1 * spread + 1e-3), rate[1] - rate[0]).astype(np.float32)
        middle = float((rate[0] + rate[1]) / 2 @ direction)
        logit = np.concatenate([part @ direction for _, part in blocks(x)]) - middle + np.log(mass[1] / mass[0])
        post = np.clip(1 / (1 + np.exp(-np.clip(logit, -12, 12))), 0.01, 0.99).astype(np.float32)
    return post


def fit_linear(inputs: np.ndarray, target: np.ndarray, decay: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Logistic weights (the last is the constant) on soft targets, by Newton steps."""
    size = inputs.shape[1] + 1
    w, penalty = np.zeros(size), np.full(size, decay)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        curve, slope = np.zeros((size, size)), penalty * w
        for rows, part in blocks(inputs):
            x = np.c_[part, np.ones(len(part), np.float32)]
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            curve += (x * (p * (1 - p) + 1e-6).astype(np.float32)[:, None]).T @ x
            slope += x.T @ (p - target[rows])
        step = np.linalg.solve(curve + np.diag(penalty), slope)
        w -= step
        if np.abs(step).max() < 1e-3:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", free_rows: int = FREE_ROWS) -> tuple[list[str], np.ndarray]:
    """The classifier's terms and weights. Without both labels in the training rows, given insults alone decide."""
    rows = sample(docs, labels, fit_rows, free_rows, id_col, text_col)
    mined = mine(rows)
    if not mined:
        terms = sorted({w for name, words in LEXICONS.items() if name.startswith("insults") for w in words.split()})
        return terms, np.r_[np.full(len(terms), 4.0), -2.0]
    sides = np.array([1] * (len(LEXICONS) + len(PATTERNS)) + [side for _, side in mined])
    voting = [t for t, _ in mined]
    # the classifier's inputs are terms of the text: the voters' own, and the most frequent ones, which no label chose
    words = F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+")))
    common = rows.select(words.alias("t")).where("t <> ''").groupBy("t").count().orderBy(F.desc("count"), "t").limit(COMMON).collect()  # at most COMMON
    given = [w for listed in LEXICONS.values() for w in listed.split()]
    terms = list(dict.fromkeys([*voting, *given, *(r.t for r in common)]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters, known = Voters(voting), Terms(terms)
        for b in batches:
            texts = b.column("text").to_pylist()
            lists = [pa.array([sorted(x(t)) for t in texts], pa.list_(pa.int32())) for x in (voters.fire, known.held)]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), *lists], ["toxic", "fired", "held"])

    got = rows.mapInArrow(read, "toxic int, fired array<int>, held array<int>").toArrow()  # at most fit_rows and free_rows
    gold = [t > 0 for t in got.column("toxic").to_pylist() if t is not None]
    votes = indicators(got.column("fired"), len(sides))
    used = np.flatnonzero(votes.any(axis=0))
    post = label_model(votes[:, used], sides[used], sum(gold) / len(gold))
    return terms, fit_linear(indicators(got.column("held"), len(terms)), post)


def indicators(lists: pa.ChunkedArray, size: int) -> np.ndarray:
    """A row of flags for each list of places."""
    lists = lists.combine_chunks()
    length = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), size), bool)
    out[np.repeat(np.arange(len(lists)), length), lists.flatten().to_numpy(zero_copy_only=False)] = True
    return out


def blocks(x: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Some rows of flags at a time as numbers, so that no copy of all is made."""
    for at in range(0, len(x), 2048):
        yield slice(at, at + 2048), x[at : at + 2048].astype(np.float32)


def score(docs: DataFrame, terms: list[str], weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row of ``docs``, from its whole text."""
    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w = Terms(terms), weights.tolist()
        for b in slices(batches, "text"):
            logits = []
            for text in b.column("text").to_pylist():
                logits.append(w[-1] + sum([w[i] for i in known.held(text)]))
            p = 1 / (1 + np.exp(-np.clip(np.array(logits, float), -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(p)], ["id", "score"])

    return given.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, held_out, score, predicted.

    Null texts are empty and get the classifier's constant. A null id is held out.
    Labels repeated for an id count once, toxic if any is; null labels and ids are
    not used. Other columns, labels included, are never inputs. Very long texts are
    read whole, repeated rows each get a row, an empty table gives an empty result.
    """
    scored = score(docs, *fit(docs, labels, fit_rows, id_col, text_col), id_col, text_col)
    return scored.select(id_col, (fold(F.col(id_col)) == HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores below 0.5; all columns stay.

    The verdict is made where the row is read, so no text is moved or joined.
    """
    terms, weights = fit(docs, labels, fit_rows, id_col, text_col)
    out = docs.withColumn(text_col, F.col(text_col).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w = Terms(terms), weights.tolist()
        for b in slices(batches, text_col):
            keep = []
            for text in b.column(text_col).to_pylist():
                keep.append(w[-1] + sum([w[i] for i in known.held(text or "")]) < 0)
            yield b.filter(pa.array(keep, pa.bool_()))

    return out.mapInArrow(run, out.schema)
