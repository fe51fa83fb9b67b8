"""Language identification by Bayesian fusion of evidence.

The posterior of a language is the product of the text's likelihood, the likelihood of the declared markup
language, that of the address suffix, and a prior of the host. What a declaration or a suffix is worth, and what
a host publishes, is learned from the rows at hand by grouped sums of the text's posteriors. Host priors are
smoothed towards their domain's, and those towards all rows'; a row does not vote for itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import encode, fresh, map_rows, row_hash, sent_if_small, written

# Labelled rows the text model is fitted on at most: those whose hash of the id comes first.
TRAINING_ROWS = 10_000
BUCKETS = 1 << 16
# Trigrams are not independent: a text counts as at most so many, each at a third of its weight.
EFFECTIVE_GRAMS, GRAM_WEIGHT = 120.0, 1.0 / 3.0
# Rows of priors that are broadcast; beyond it they are joined by host.
BROADCAST_HOSTS = 50_000

# Country suffixes and the language they suggest, in natural order.
SUFFIX_LANGUAGE = {
    "ar": "es", "at": "de", "au": "en", "be": "fr", "bo": "es", "br": "pt", "ch": "de", "cl": "es", "cn": "zh",
    "co": "es", "cz": "cs", "de": "de", "dk": "da", "ec": "es", "es": "es", "fi": "fi", "fr": "fr", "gr": "el",
    "hu": "hu", "ie": "en", "it": "it", "jp": "ja", "kr": "ko", "li": "de", "lu": "fr", "mx": "es", "nl": "nl",
    "no": "no", "nz": "en", "pe": "es", "pl": "pl", "pt": "pt", "py": "es", "ro": "ro", "ru": "ru", "se": "sv",
    "tr": "tr", "uk": "en", "us": "en", "uy": "es", "ve": "es",
}

_FOLDED = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype=np.uint32)


def grams(text: str | None) -> np.ndarray:
    """Hashed trigrams of the letters (UTF-8, A-Z folded); runs of other characters count as one space."""
    folded = _FOLDED[np.frombuffer(encode(text), dtype=np.uint8)]
    if len(folded):
        keep = np.ones(len(folded), dtype=bool)
        keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32)
        folded = folded[keep]
    if len(folded) < 3 or (folded == 32).all():
        return np.empty(0, dtype=np.int64)
    mixed = ((folded[:-2] << np.uint32(16)) | (folded[1:-1] << np.uint32(8)) | folded[2:]) * np.uint32(2654435761)
    return (mixed >> np.uint32(16)).astype(np.int64)


@dataclass(frozen=True)
class TextModel:
    languages: tuple[str, ...]
    table: np.ndarray  # log probability of a trigram in a language: BUCKETS x languages

    def evidence(self, text: str | None) -> tuple[np.ndarray, int]:
        """Tempered log likelihoods, and the number of trigrams they rest on."""
        found = grams(text)
        total = np.zeros(len(self.languages))
        for at in range(0, len(found), 1 << 16):
            total += self.table[found[at : at + (1 << 16)]].sum(axis=0, dtype=np.float64)
        share = GRAM_WEIGHT * min(1.0, EFFECTIVE_GRAMS / len(found)) if len(found) else 0.0
        return (total - total.max()) * share, len(found)


def fit_text_model(
    labelled: DataFrame, *, id: str = "doc_id", text: str = "text", language: str = "lang", training_rows: int = TRAINING_ROWS,
    least_share: float = 0.005,
) -> TextModel:
    """Trigram probabilities of the languages that have at least ``least_share`` of the training rows.

    The training rows are the first ``training_rows`` by the hash of the id, then the id and the hash of the text; equal
    ones count once. Rows without an id or a language are not used; without any row the model knows no language.
    """
    usable = labelled.where(F.col(id).isNotNull() & (F.trim(F.coalesce(language, F.lit(""))) != ""))
    named = usable.select(
        F.col(id).alias("key"), F.xxhash64(F.col(text)).alias("own"), F.col(text).alias("text"), primary(F.col(language)).alias("label")
    )
    # Rows, not ids, are chosen, and equal rows are one before the shuffle: a repeated id brings no more of them.
    sample = named.select("key", "own").orderBy(F.xxhash64("key"), "key", "own").limit(training_rows).distinct()
    same = named["key"].eqNullSafe(sample["key"]) & (named["own"] == sample["own"])
    joined = named.join(F.broadcast(sample), same, "left_semi")
    table = written(joined.groupBy("key", "own").agg(F.min("text").alias("text"), F.min("label").alias("label")), "language")

    def rows(columns: dict[str, list]):
        sums: dict[str, np.ndarray] = {}
        for value, label in zip(columns["text"], columns["label"], strict=True):
            counts = sums.setdefault(label, np.zeros(BUCKETS, dtype=np.int64))
            counts += np.bincount(grams(value), minlength=BUCKETS)
        for label, counts in sums.items():
            yield from ((label, int(i), int(counts[i])) for i in np.flatnonzero(counts))

    n_rows = {r.label: r["count"] for r in table.groupBy("label").count().collect()}
    languages = tuple(sorted(k for k, n in n_rows.items() if n >= least_share * sum(n_rows.values())))
    counts = np.full((BUCKETS, len(languages)), 0.1)
    summed = map_rows(table, "label string, gram int, n long", rows).groupBy("label", "gram").agg(F.sum("n").alias("n"))
    for r in summed.where(F.col("label").isin(*languages)).toLocalIterator():
        counts[r.gram, languages.index(r.label)] += r.n
    return TextModel(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32))


def primary(declared: Column) -> Column:
    """Primary subtag of a language tag, lower case."""
    return F.lower(F.regexp_extract(F.trim(declared), r"^([A-Za-z]+)", 1))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def suffix_of(host: Column) -> Column:
    return F.regexp_extract(host, r"\.([a-z]+)$", 1)


def domain_of(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)


def identify(
    rows: DataFrame, model: TextModel, *, smoothing: float = 20.0, least: float = 0.5, accepted: tuple[str, ...] | None = None
) -> DataFrame:
    """``key, lang, confidence, n_grams, kept`` for rows of (key, text, declared, suffix, host, domain).

    ``kept`` is false where the posterior is below ``least``, no text supports it, or the language is not in
    ``accepted``. Null evidence says nothing; a null, empty or letterless text gets the language its other
    evidence gives and is not kept. Repeated rows get equal results up to their own vote; an empty table stays
    empty; a model without languages keeps nothing.
    """
    spark, languages = rows.sparkSession, model.languages
    n = len(languages)
    kind = rows.schema["key"].dataType.simpleString()
    if not n:
        return rows.select("key", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(0).cast("long").alias("n_grams"), F.lit(False).alias("kept"))
    shared = spark.sparkContext.broadcast(model)

    def likelihoods(columns: dict[str, list]):
        names = ("key", "text", "declared", "suffix", "host", "domain")
        for key, text, declared, suffix, host, domain in zip(*(columns[c] for c in names), strict=True):
            evidence, found = shared.value.evidence(text)
            weight = np.exp(evidence - evidence.max())
            yield key, code(declared), code(SUFFIX_LANGUAGE.get(suffix or "")), host or None, domain or None, evidence.tolist(), (weight / weight.sum()).tolist(), found

    def code(language: str | None) -> int:
        """Index of a known language; one more for any other, -1 for none."""
        return -1 if not language else languages.index(language) if language in languages else n

    schema = f"key {kind}, declared int, suffix int, host string, domain string, evidence array<double>, vote array<double>, n_grams long"
    seen = written(map_rows(rows.select("key", "text", "declared", "suffix", "host", "domain"), schema, likelihoods), "language")
    votes = [F.sum(F.when(F.col("n_grams") > 0, F.col("vote")[i]).otherwise(0.0)).alias(f"v{i}") for i in range(n)]
    total = np.array(seen.agg(*votes).first(), dtype=float) if not seen.isEmpty() else np.zeros(n)
    total = np.nan_to_num(total.astype(float))
    overall = (total + 1.0) / (total.sum() + n)

    def emission(field: str) -> np.ndarray:
        """Log probability of each code given the language: at most n + 2 rows are collected."""
        counts = np.full((n + 1, n), 0.5)
        counts[np.arange(n), np.arange(n)] += 2.0
        for r in seen.where(F.col(field) >= 0).groupBy(field).agg(*votes).collect():
            counts[r[field]] += np.array(r[1:], dtype=float)
        return np.log(counts / counts.sum(axis=0))

    said, ends = emission("declared"), emission("suffix")
    hosts = seen.where("host is not null").groupBy("host", "domain").agg(*votes)
    domains = hosts.where("domain is not null").groupBy("domain").agg(*[F.sum(f"v{i}").alias(f"d{i}") for i in range(n)])
    smoothed = hosts.join(domains, "domain", "left").select(
        "host",
        F.col("domain").alias("of_domain"),
        F.array(*[F.col(f"v{i}") for i in range(n)]).alias("host_votes"),
        F.coalesce(F.array(*[F.when(F.col("d0").isNotNull(), F.col(f"d{i}")) for i in range(n)]), F.array()).alias("domain_votes"),
    )
    smoothed = sent_if_small(written(smoothed, "language"), BROADCAST_HOSTS)
    joined = seen.join(smoothed.withColumnRenamed("host", "of_host"), (F.col("host") == F.col("of_host")) & F.col("domain").eqNullSafe(F.col("of_domain")), "left")

    def fused(columns: dict[str, list]):
        names = ("key", "declared", "suffix", "evidence", "vote", "n_grams", "host_votes", "domain_votes")
        for key, declared, suffix, evidence, vote, found, host, domain in zip(*(columns[c] for c in names), strict=True):
            own = np.array(vote) if found else np.zeros(n)
            prior = overall
            for level in (domain, host):
                if level and level[0] is not None:
                    others = np.maximum(np.array(level) - own, 0.0)
                    prior = (others + smoothing * prior) / (others.sum() + smoothing)
            score = np.array(evidence) + np.log(prior)
            score += said[declared] if declared >= 0 else 0.0
            score += ends[suffix] if suffix >= 0 else 0.0
            weight = np.exp(score - score.max())
            best = int(weight.argmax())
            sure = float(weight[best] / weight.sum())
            ok = bool(found and sure >= least and (accepted is None or languages[best] in accepted))
            yield key, languages[best], round(sure, 6), found, ok

    wanted = joined.select("key", "declared", "suffix", "evidence", "vote", "n_grams", "host_votes", "domain_votes")
    return map_rows(wanted, f"key {kind}, lang string, confidence double, n_grams long, kept boolean", fused)


def document_evidence(documents: DataFrame, key: Column) -> DataFrame:
    """Documents declare ``lang``, and their ``source`` is the host; they have no address."""
    none = F.lit(None).cast("string")
    return documents.select(
        key.alias("key"), "text", primary(F.col("lang")).alias("declared"), none.alias("suffix"), F.col("source").cast("string").alias("host"), none.alias("domain")
    )


def page_evidence(pages: DataFrame) -> DataFrame:
    """Pages declare the markup's ``lang`` attribute, and have an address; scripts, styles and tags are no text."""
    bare = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    host = host_of(F.col("url"))
    return pages.select(
        F.col("page_id").alias("key"),
        F.regexp_replace(bare, r"&[#A-Za-z0-9]+;", " ").alias("text"),
        primary(F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)).alias("declared"),
        suffix_of(host).alias("suffix"),
        host.alias("host"),
        domain_of(host).alias("domain"),
    )


def keep_identified(documents: DataFrame, model: TextModel | None = None, *, id: str = "doc_id", **options) -> DataFrame:
    """The documents whose language is identified, with their own columns; the model is fitted on them if not given."""
    model = model or fit_text_model(documents, id=id)
    hash_, keep = fresh(documents, "hash", "keep")
    marked = documents.withColumn(hash_, row_hash(documents))
    key = F.struct(F.col(id).alias("id"), F.col(hash_).alias("row"))
    found = identify(document_evidence(marked, key), model, **options).where("kept").select(F.col("key").alias(keep)).distinct()
    same = (F.col(hash_) == F.col(f"{keep}.row")) & F.col(id).eqNullSafe(F.col(f"{keep}.id"))
    return marked.join(found, same, "left_semi").select(*documents.columns)
