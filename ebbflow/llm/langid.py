"""Language identification by words first, with back-off to character n-grams.

Training counts words, and n-grams of 1 to ``LONGEST`` characters of words marked at both ends, per language. A known
word scores by its log frequency in each language. An unseen word is covered from left to right: at each position the
longest known n-gram scores, shorter ones being tried in turn. All scores are relative to the mean over languages; a
text's evidence is the sum over its words, scaled to that of at most ``EVIDENCE`` words, and the result's score is the
softmax share of the best language.

The model is fitted on a bounded sample of labelled rows: about ``max_docs`` documents of each language (a hash of the
id decides) for the ``max_languages`` most frequent languages. It keeps the ``max_words`` and ``max_grams`` most frequent entries of
each language, so a rare one has as many as any other, and only the languages that an entry occurs in. So it is small enough to
broadcast whatever the size of the corpus. Prediction reads every whole text, words of any length included; language, source and id
play no part in it.

Defined results: a text that is null or has no letter is ``und`` with score 0; so is every text if no labelled row was
given; equal rows stay separate rows; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbflow.llm import support

#: Runs of letters (and of the few number signs that count as word characters but not as digits).
WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
LONGEST = 4
EVIDENCE = 20
#: Words that a worker remembers, and the longest that it does; longer ones are scored anew each time.
CACHE_WORDS, CACHE_LETTERS = 200_000, 64


@dataclass
class Model:
    """Log frequencies; ``words`` and ``grams`` map an entry to its row.

    A row holds only the languages that the entry occurs in (``at`` to ``at + 1`` of ``starts``: language and what is
    added to that language's ``floor``), the rest of its scores being the floors.
    """

    languages: list[str]
    words: dict[str, int] = field(default_factory=dict)
    grams: dict[str, int] = field(default_factory=dict)
    floors: dict[str, np.ndarray] = field(default_factory=dict)
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    which: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int16))
    added: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def scores(self, kind: str, rows: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """For ``n`` words, the sum of the entries ``rows`` (each belonging to word ``of``), relative to the mean over languages."""
        wide = len(self.languages)
        begins = self.starts[rows]
        long = self.starts[rows + 1] - begins
        at = np.arange(long.sum()) + np.repeat(begins - np.cumsum(long) + long, long)
        found = np.bincount(np.repeat(of, long) * wide + self.which[at], self.added[at], n * wide).astype(float).reshape(n, wide)
        found += np.bincount(of, minlength=n)[:, None] * self.floors.get(kind, np.zeros(wide))
        return found - found.mean(axis=1, keepdims=True)


def words_of(text: str | None) -> list[str]:
    """Lower-case words; empty if the text has no letter."""
    found = WORD.findall(text.lower()) if text else []
    return found if any(not w.isnumeric() and any(map(str.isalpha, w)) for w in found) else []


def grams_of(word: str):
    marked = f"^{word}$"
    for i in range(len(marked)):
        for n in range(1, LONGEST + 1):
            if i + n <= len(marked):
                yield marked[i : i + n]


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 1500, max_words: int = 20_000, max_grams: int = 20_000, max_languages: int = 256) -> Model:
    """Fits a model on a sample of about ``max_docs`` rows of each language."""
    rows = labelled.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()
    if not sizes:
        return Model([])
    languages = sorted(r["lang"] for r in sizes)
    grain = 1 << 30
    limit = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], min(grain, grain * max_docs // r["n"]))))
    chosen = rows.withColumn("limit", F.try_element_at(limit, F.col("lang"))).filter(F.pmod(F.xxhash64(F.lit(29), "key"), F.lit(grain)) < F.col("limit"))

    def count(batch: dict[str, list]) -> dict[str, list]:
        words: dict[str, Counter] = {}
        for text, lang in zip(batch["text"], batch["lang"]):
            words.setdefault(lang, Counter()).update(words_of(text))
        tally: Counter = Counter()
        for lang, own in words.items():
            grams: Counter = Counter()
            for word, n in own.items():
                for gram in grams_of(word):
                    grams[gram] += n
            tally.update({(lang, "g", g): n for g, n in grams.items()} | {(lang, "w", w): n for w, n in own.items()})
        return {"lang": [k[0] for k in tally], "kind": [k[1] for k in tally], "entry": [k[2] for k in tally], "n": list(tally.values())}

    counted = support.map_arrow(chosen.select("lang", "text"), count, "lang string, kind string, entry string, n long")
    totals = support.checkpoint(counted.groupBy("kind", "entry", "lang").agg(F.sum("n").alias("n")))
    nth = F.row_number().over(Window.partitionBy("kind", "lang").orderBy(F.desc("n"), "entry"))
    kept = totals.withColumn("nth", nth).filter(F.col("nth") <= F.when(F.col("kind") == "w", max_words).otherwise(max_grams)).select("kind", "entry").distinct()
    model, starts, which, added = Model(languages), [0], [], []
    number = {x: k for k, x in enumerate(languages)}
    found = totals.join(kept, ["kind", "entry"]).select("kind", "entry", "lang", "n").orderBy("kind", "entry", "lang").toArrow()
    for kind, index in (("w", model.words), ("g", model.grams)):
        own = found.filter(pc.equal(found["kind"], kind))
        times = own["n"].to_numpy()
        at = np.array([number[x] for x in own["lang"].to_pylist()], np.int64)
        sums = np.bincount(at, times, len(languages)).astype(float)
        before = None
        for entry, lang, n in zip(own["entry"].to_pylist(), at.tolist(), times.tolist()):
            if entry != before:
                starts.append(len(which))
                index[entry] = len(starts) - 2
                before = entry
            which.append(lang)
            added.append(math.log((n + 0.5) / 0.5))
            starts[-1] = len(which)
        model.floors[kind] = np.log(0.5 / (sums + 0.5 * max(1, len(index))))
    model.starts, model.which, model.added = np.array(starts), np.array(which, np.int16), np.array(added, np.float32)
    return model


class Scorer:
    """A model at work in one Python worker; it remembers the scores of the words it has seen."""

    def __init__(self, model: Model):
        self.model = model
        self.row_of: dict[str, int] = {}
        self.rows = np.zeros((1024, len(model.languages)))

    def words(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word."""
        m = self.model
        known, known_of, hits, hits_of = [], [], [], []
        get = m.grams.get
        for w, word in enumerate(words):
            k = m.words.get(word)
            if k is not None:
                known.append(k)
                known_of.append(w)
                continue
            marked = f"^{word}$"
            before = len(hits)
            for i in range(len(marked)):
                for n in range(min(LONGEST, len(marked) - i), 0, -1):
                    g = get(marked[i : i + n])
                    if g is not None:
                        hits.append(g)
                        break
            hits_of.extend([w] * (len(hits) - before))
        whole = m.scores("w", np.array(known, np.int64), np.array(known_of, np.int64), len(words))
        return whole + m.scores("g", np.array(hits, np.int64), np.array(hits_of, np.int64), len(words)) / LONGEST

    def text(self, text: str | None) -> tuple[str, float]:
        languages = self.model.languages
        tally = Counter(words_of(text))
        if not tally or not languages:
            return UNKNOWN, 0.0
        if len(self.row_of) > CACHE_WORDS:
            self.row_of.clear()
        evidence = np.zeros(len(languages))
        long = [w for w in tally if len(w) > CACHE_LETTERS]
        for word in long:
            evidence += tally[word] * self.words([word])[0]
        short = [w for w in tally if len(w) <= CACHE_LETTERS] if long else list(tally)
        new = [w for w in short if w not in self.row_of]
        if new:
            at = len(self.row_of)
            if at + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((max(len(self.rows), len(new)), len(languages)))])
            self.rows[at : at + len(new)] = self.words(new)
            self.row_of.update(zip(new, range(at, at + len(new))))
        if short:
            evidence += np.fromiter(map(tally.__getitem__, short), float, len(short)) @ self.rows[[self.row_of[w] for w in short]]
        words = sum(tally.values())
        evidence *= min(1.0, EVIDENCE / words)
        share = np.exp(evidence - evidence.max())
        best = int(np.argmax(share))
        return languages[best], round(float(share[best] / share.sum()), 6)


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The ``keep`` columns of every row, and the language and its score under ``names``, which ``keep`` mustn't hold."""
    (read,) = support.free_names(docs, "read")
    lang, score = names
    shared = docs.sparkSession.sparkContext.broadcast(model)
    number = support.fresh()

    def work(batch: dict[str, list]) -> dict[str, list]:
        scorer = support.once(number, lambda: Scorer(shared.value))
        found = [scorer.text(t) for t in batch[read]]
        return {n: batch[n] for n in keep} | {lang: [x for x, _ in found], score: [y for _, y in found]}

    kinds = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in keep)
    return support.map_arrow(docs.select(*keep, F.col(text_col).alias(read)), work, f"{kinds}, `{lang}` string, `{score}` double")


def is_held_out(id_col: str = "doc_id") -> Column:
    return support.unsigned_crc32(F.col(id_col)) % 3 == 1


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; rows whose crc32(doc_id) mod 3 is 1 are held out of the fit."""
    docs = support.table(spark, sf_dir, "documents")
    model = fit(docs.filter(~F.coalesce(is_held_out(), F.lit(False))))
    found = predict(docs, model)
    return found.select("doc_id", F.coalesce(is_held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
