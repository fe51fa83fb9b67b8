"""Quality rules, line first: rules judge every line, failing lines go, and a document that loses too much is rejected.

Built-in functions only, one narrow projection: nothing is shuffled and no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import fresh

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

# Phrases of page furniture in the languages of the tables; a line they make up a good part of fails. They begin
# words: a separator or the start of the line stands before them, so most places of a line are passed at once.
BOILERPLATE = (
    "(?:^|[\\x20\\x09-\\x0D(>|.,;:-])(?:cookie policy|privacy policy|terms of (use|service)|all rights reserved|click here|sign (up|in) (now|today|to)|"
    "subscribe (now|to)|enable javascript|lorem ipsum|share on (facebook|twitter|linkedin)|powered by|back to top|"
    "skip to (main )?content|read more|add to cart|leave a (comment|reply)|"
    "alle rechte vorbehalten|datenschutzerklärung|nutzungsbedingungen|hier klicken|weiterlesen|jetzt (anmelden|abonnieren)|"
    "nach oben|in den warenkorb|zum inhalt springen|kommentar schreiben|"
    "tous droits réservés|politique de confidentialité|conditions d.utilisation|cliquez ici|lire la suite|abonnez-vous|"
    "haut de page|ajouter au panier|aller au contenu|laisser un commentaire|"
    "todos los derechos reservados|política de privacidad|términos de uso|haga clic aquí|leer más|suscríbete|"
    "volver arriba|añadir al carrito|saltar al contenido|deja un comentario)"
)
# A line fails when a fifth of its characters or more are such phrases.
PHRASE_SHARE = 5
# Shorter lines that end in dots are teasers of another page.
TEASER_WORDS = 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often, and in whatever lambda, it is used."""
    return F.transform(F.array(value), body)[0]


def occurrences(line: Column, characters: str) -> Column:
    """How many of a line's characters are among ``characters``."""
    return F.length(line) - F.length(F.translate(line, characters, ""))


def is_navigation(line: Column) -> Column:
    """Menus and breadcrumbs: at least three separators, one for at most ten words."""
    bars = occurrences(line, "|»›•")
    return (bars >= 3) & (bars * 10 >= occurrences(line, " ") + 1)


def is_symbols(line: Column) -> Column:
    """Punctuation: a tenth of the line is symbols, or every fifth word or more shouts."""
    shouts = occurrences(line, "!")
    return (occurrences(line, "#*$%&<>=^~{}") * 10 >= F.length(line)) | (
        (shouts >= 3) & (shouts * 5 >= occurrences(line, " ") + 1)
    )


def is_stutter(line: Column) -> Column:
    """Every second word or more repeats the one before it."""
    return let(
        F.split(line, " "),
        lambda w: (F.size(w) >= 4) & (F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))) * 2 >= F.size(w)),
    )


def is_boilerplate(line: Column) -> Column:
    """Phrases of page furniture hold a fifth of the line's characters; in a long sentence they do not matter."""
    lowered = F.lower(line)
    without = F.length(F.regexp_replace(lowered, BOILERPLATE, ""))
    return lowered.rlike(BOILERPLATE) & ((F.length(lowered) - without) * PHRASE_SHARE >= F.length(lowered))


def is_teaser(line: Column) -> Column:
    """A short line that breaks off in dots."""
    ended = F.rtrim(line)
    return (ended.endswith("...") | ended.endswith("…")) & (occurrences(line, " ") + 1 < TEASER_WORDS)


def fails(line: Column) -> Column:
    return is_navigation(line) | is_symbols(line) | is_boilerplate(line) | is_teaser(line) | is_stutter(line)


def repeated_words(words: Column, width: int) -> Column:
    """Words in windows of ``width`` words that occur twice or more, the first occurrence included."""

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda a, b: F.get(a, b)["h"]
        twice = let(placed, lambda s: F.filter(s, lambda x, k: (same(s, k - 1) == x["h"]) | (same(s, k + 1) == x["h"])))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        steps = let(starts, lambda at: F.transform(at, lambda v, k: F.least(F.lit(width), F.coalesce(F.get(at, k + 1) - v, F.lit(width)))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda n, step: n + step)

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), lambda i: F.xxhash64(F.slice(words, i, width)))
    judged = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(words) >= width, judged).otherwise(F.lit(0).cast("long"))


def apply_quality_rules(
    documents: DataFrame, *, text: str = "text", keep_share: float = 0.5, least_words: int = 20, most_repeated: int = 30, width: int = 8
) -> DataFrame:
    """Add the measures, ``clean_text`` (failing lines left out), ``base_failed`` and ``kept`` to documents.

    ``kept`` is false when the base rules fail (fewer than ``least_words`` words, or over ``most_repeated``
    percent of the words in repeated windows), or when the lines left hold less than ``keep_share`` of the
    characters of the lines that have a word. Null and empty texts have no words and fail; their clean text is
    empty; texts of any length are judged whole, in memory of their row. Rows are judged one by one, so repeated rows get equal results and an empty table stays empty.
    Columns of the documents are kept; those named like a result are replaced.
    """
    results = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "clean_text", "n_failed_lines", "base_failed", "kept")
    documents = documents.drop(*results)
    body, by_words, by_lines = fresh(documents, "body", "by_words", "by_lines")
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(whole, BLANKS), lambda w: w != "")
    of_words = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w, width).alias("n_repeat_words"),
        ),
    )
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    chars = lambda kept: F.aggregate(kept, F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    of_lines = let(
        lines,
        lambda every: let(
            F.filter(every, lambda x: ~fails(x)),
            lambda kept: F.struct(
                (F.size(every) - F.size(F.array_distinct(every))).cast("long").alias("n_dup_lines"),
                (F.size(every) - F.size(kept)).cast("long").alias("n_failed_lines"),
                F.array_join(kept, "\n").alias("clean_text"),
                (chars(kept) >= F.lit(keep_share) * chars(every)).alias("enough"),
            ),
        ),
    )
    symbols = F.length(whole) - F.length(F.regexp_replace(whole, f"[{SYMBOLS}]+", ""))
    judged = documents.select("*", symbols.cast("long").alias(body), of_words.alias(by_words), of_lines.alias(by_lines))
    word, line = (lambda n: F.col(f"{by_words}.{n}")), (lambda n: F.col(f"{by_lines}.{n}"))
    failed = (word("n_words") < least_words) | (100 * word("n_repeat_words") > most_repeated * word("n_words"))
    return judged.select(
        *documents.columns,
        word("n_words"),
        word("word_chars"),
        F.col(body).alias("n_symbols"),
        line("n_dup_lines"),
        word("n_repeat_words"),
        line("clean_text"),
        line("n_failed_lines"),
        failed.alias("base_failed"),
        (~failed & line("enough")).alias("kept"),
    )
