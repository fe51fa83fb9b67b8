"""Toxicity scores from a weighted lexicon, matched by an Aho-Corasick automaton.

Texts are folded first (look-alike letters of other scripts, digits and signs in place of letters), exception
phrases are taken out, and the weights that match are set against the length of the text. The lexicon holds
words and word beginnings whose weights are learned from labelled documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import map_rows, written

# Labelled rows the model is fitted on at most: those whose hash of the id comes first.
TRAINING_ROWS = 20_000

# Letters of other scripts that look like Latin ones, in natural order.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t",
    "у": "y", "х": "x", "ѕ": "s", "і": "i", "ї": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p",
    "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ɑ": "a", "ɡ": "g", "ı": "i", "ʟ": "l", "ո": "n", "ս": "u", "օ": "o",
    "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "­": "",
}
_LOOKALIKE = str.maketrans(LOOKALIKES | {chr(0xFF21 + i): chr(97 + i) for i in range(26)} | {chr(0xFF41 + i): chr(97 + i) for i in range(26)})
_ANY_LOOKALIKE = re.compile(f"[{''.join(LOOKALIKES)}Ａ-Ｚａ-ｚ]")
# Digits and signs that stand for letters, inside a word or (digits) at its start.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
_SUBSTITUTE = re.compile(r"(?<=[^\W\d_])[0134578@$!]+(?=[^\W\d_])|\b[0134578]{1,2}(?=[^\W\d_])")
_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# Harmless phrases with a word that may be in the lexicon; they are taken out before matching.
EXCEPTIONS = (
    "april fool", "april fools", "circus clown", "class clown", "clown fish", "clown loach", "clown nose",
    "clown shoes", "dead end", "dead heat", "die cast", "dumb bell", "dumb terminal", "dumb waiter", "fool proof",
    "fools gold", "garbage can", "garbage collection", "garbage collector", "garbage disposal", "garbage truck",
    "idiot light", "idiot proof", "kill switch", "killer whale", "loser bracket", "pathetic fallacy", "pig iron",
    "pond scum", "rat poison", "rat race", "recycle trash", "rodeo clown", "scum line", "soap scum",
    "sore loser board", "stupid simple", "trash bag", "trash bags", "trash bin", "trash can", "trash chute",
    "trash collection", "trash compactor", "trash day", "ugly duckling", "ugly sweater", "worm drive", "worm farm",
    "worm gear",
)

BEGINNINGS = range(3, 10)


def fold(text: str | None) -> list[str]:
    """Folded lower-case words."""
    if not text:
        return []
    text = text.lower()
    if _ANY_LOOKALIKE.search(text):
        text = text.translate(_LOOKALIKE)
    text = _SUBSTITUTE.sub(lambda m: "".join(SUBSTITUTES[c] for c in m[0]), text)
    return _WORDS.findall(text)


def entries_of(word: str) -> list[str]:
    """Candidates for the lexicon: the word (closed by a space) and its beginnings."""
    return [f"{word} ", *(word[:n] for n in BEGINNINGS if n <= len(word))]


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]  # lexicon entry -> log ratio of its rates; entries of weight 0 shadow shorter ones
    scale: tuple[float, ...]  # of the logistic link over measures()
    exceptions: tuple[str, ...] = EXCEPTIONS


class Matcher:
    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        import ahocorasick

        self.weights = weights
        self.automaton = ahocorasick.Automaton()
        for entry in weights:
            self.automaton.add_word(f" {entry}", (0, entry))
        for phrase in exceptions:  # after the entries: a phrase of one word stands in for the entry it excuses
            self.automaton.add_word(f" {phrase} ", (phrase.count(" ") + 1, None))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def entries(self, words: list[str]) -> list[str]:
        """The longest entry at the start of each word that has one, words of exception phrases left out."""
        if self.empty or not words:
            return []
        text = f" {' '.join(words)} "
        best: dict[int, str] = {}
        excused: list[tuple[int, int]] = []
        for end, (phrase, entry) in self.automaton.iter(text):
            if phrase:
                start = end
                for _ in range(phrase):
                    start = text.rfind(" ", 0, start)
                excused.append((start, end))
            else:
                start = end - len(entry)
                if len(entry) > len(best.get(start, "")):
                    best[start] = entry
        if not excused:
            return list(best.values())
        # Both in order of their place: a hit is excused if some phrase that starts no later reaches beyond it.
        excused.sort()
        left, nth, reach = set(), 0, -1
        for at in sorted(best):
            while nth < len(excused) and excused[nth][0] <= at:
                reach = max(reach, excused[nth][1])
                nth += 1
            if at >= reach:
                left.add(at)
        return [e for at, e in best.items() if at in left]


def measures(hits: list[str], weights: dict[str, float], n_words: int) -> list[float]:
    """What the link sees: strength against length, strength, and number of distinct kinds."""
    strong = [weights[e] for e in hits if weights[e] > 0]
    total = sum(strong)
    return [
        1.0,
        10.0 * total / (n_words + 10.0),
        math.log1p(total),
        total / math.sqrt(n_words + 10.0),
        math.log1p(len({e for e in hits if weights[e] > 0})),
        math.log1p(n_words) / 10.0,
    ]


def link(scale, values) -> float:
    z = sum(a * b for a, b in zip(scale, values, strict=True))
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def choose_entries(counts: dict[str, tuple[int, int]], clean: int, toxic: int, least: float = 1.5) -> dict[str, float]:
    """Entries with enough toxic documents and a high ratio of rates, as few as say the same.

    Of a beginning and a continuation that is found in about as many toxic documents, the longer one stays;
    one that is rarer stays only if it tells more than the shorter.
    """
    support = least_support(toxic)
    chosen = {e: log_ratio(n0, n1, clean, toxic) for e, (n0, n1) in counts.items() if n1 >= support}
    chosen = {e: w for e, w in chosen.items() if w >= least}
    longest: dict[str, int] = {}
    for entry in chosen:
        for n in range(1, len(entry)):
            if entry[:n] in chosen:
                longest[entry[:n]] = max(longest.get(entry[:n], 0), counts[entry][1])
    out: dict[str, float] = {}
    for entry in sorted(chosen, key=len):
        if longest.get(entry, 0) >= 0.9 * counts[entry][1]:
            continue
        below = max((out.get(entry[:n], 0.0) for n in range(1, len(entry))), default=0.0)
        if chosen[entry] > below + 0.3 or not below:
            out[entry] = chosen[entry]
    return out


def least_support(toxic: int) -> int:
    return max(3, round(0.01 * toxic))


def log_ratio(n0: int, n1: int, clean: int, toxic: int) -> float:
    return math.log((n1 + 0.5) / (toxic + 1)) - math.log((n0 + 0.5) / (clean + 1))


def fit_link(values: np.ndarray, labels: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> tuple[float, ...]:
    """Logistic regression by Newton steps."""
    scale = np.zeros(values.shape[1])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(values @ scale, -30, 30)))
        curve = (values * (p * (1 - p))[:, None]).T @ values + ridge * np.eye(len(scale))
        step = np.linalg.solve(curve, values.T @ (labels - p) - ridge * scale)
        scale += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(scale.tolist())


def _counted(df: DataFrame, entries: Callable[[list[str]], set[str]]) -> DataFrame:
    """``(entry, label, n)``: documents of (text, label) that have an entry, counted per batch first."""

    def rows(columns: dict[str, list]):
        found: Counter = Counter()
        for text, label in zip(columns["text"], columns["label"], strict=True):
            found.update((e, label) for e in entries(fold(text)))
        return [(e, label, n) for (e, label), n in found.items()]

    return map_rows(df, "entry string, label int, n long", rows).groupBy("entry", "label").agg(F.sum("n").alias("n"))


def fit_toxicity(
    documents: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "toxic",
    exceptions: tuple[str, ...] = EXCEPTIONS, training_rows: int = TRAINING_ROWS,
) -> ToxicityModel:
    """Learn the lexicon on two thirds of at most ``training_rows`` labelled documents, the link on the rest.

    The rows used are those whose hash of the id is smallest, so the choice does not depend on partitioning, and of
    documents that repeat an id the one whose text has the smallest hash, so their number bounds what is broadcast or
    collected, however often an id occurs. Labels other than 0 and 1, null ids and labels
    without a document are not used; without documents of both labels the model scores everything 0.
    """
    spark = documents.sparkSession
    usable = labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull())
    usable = usable.select(F.col(id).alias("key"), F.col(label).cast("int").alias("label"))
    sample = usable.orderBy(F.xxhash64("key"), "key", "label").limit(training_rows)
    named = documents.select(F.col(id).alias("key"), F.col(text).alias("text"))
    # Copies of an id are reduced before the shuffle, one row a task.
    chosen_text = F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text")
    table = named.join(F.broadcast(sample.distinct()), "key").groupBy("key", "label").agg(chosen_text)
    table = written(table.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "key"), F.lit(3))), "toxicity")
    learn, check = table.where("fold <> 0"), table.where("fold = 0")
    sizes = {r.label: r["count"] for r in learn.groupBy("label").count().collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    nothing = ToxicityModel({}, (-30.0, 0.0, 0.0, 0.0, 0.0, 0.0), exceptions)
    if not clean or not toxic:
        return nothing
    support = least_support(toxic)
    # At most some thousand candidates a document, each in at least one of a hundred toxic ones.
    every = _counted(learn.where("label = 1"), lambda words: {e for w in set(words) for e in entries_of(w)})
    in_toxic = {r.entry: r.n for r in every.where(F.col("n") >= support).collect()}
    known = spark.sparkContext.broadcast(frozenset(in_toxic))
    some = _counted(learn.where("label = 0"), lambda words: {e for w in set(words) for e in entries_of(w) if e in known.value})
    in_clean = {r.entry: r.n for r in some.collect()}
    chosen = choose_entries({e: (in_clean.get(e, 0), n) for e, n in in_toxic.items()}, clean, toxic)
    matching = _Shared(spark, chosen, exceptions)
    hits: Counter = Counter()
    for r in _counted(learn, lambda words: set(matching().entries(words))).collect():
        hits[r.entry, r.label] = r.n
    weights = {e: log_ratio(hits[e, 0], hits[e, 1], clean, toxic) if hits[e, 1] >= 3 else 0.0 for e in chosen}
    weights = {e: w if w >= 1.0 else 0.0 for e, w in weights.items()}
    final = _Shared(spark, weights, exceptions)

    def rows(columns: dict[str, list]):
        for value, own in zip(columns["text"], columns["label"], strict=True):
            words = fold(value)
            yield own, measures(final().entries(words), final().weights, len(words))

    seen = map_rows(check, "label int, measures array<double>", rows).collect()
    if not seen:
        return nothing
    scale = fit_link(np.array([r.measures for r in seen]), np.array([r.label for r in seen], dtype=float))
    return ToxicityModel(weights, scale, exceptions)


class _Shared:
    """A matcher that every Python worker builds once from the broadcast lexicon."""

    def __init__(self, spark, weights: dict[str, float], exceptions: tuple[str, ...]):
        self.parts = spark.sparkContext.broadcast((weights, exceptions))
        self.built = None

    def __getstate__(self):
        return {"parts": self.parts, "built": None}

    def __call__(self) -> Matcher:
        if self.built is None:
            self.built = Matcher(*self.parts.value)
        return self.built


def score_toxicity(documents: DataFrame, model: ToxicityModel, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, score, hits`` (lexicon entries found, with repeats) for every row.

    Row by row; null and empty texts have no hits and get the score of a text without words, texts of any length take
    time in proportion to it, repeated rows get equal results, an empty table stays empty. Other columns are not looked at.
    """
    kind = documents.schema[id].dataType.simpleString()
    matching = _Shared(documents.sparkSession, model.weights, model.exceptions)

    def rows(columns: dict[str, list]):
        for key, value in zip(columns["id"], columns["text"], strict=True):
            words = fold(value)
            hits = matching().entries(words)
            score = link(model.scale, measures(hits, model.weights, len(words)))
            yield key, score, [h for h in hits if model.weights[h] > 0]

    plain = documents.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return map_rows(plain, f"id {kind}, score double, hits array<string>", rows)
