"""Language ID by fusing evidence: text, declared markup language, address suffix, host priors.

Text likelihoods come from character trigrams, in a table of BUCKETS hashed trigrams for each
language, learned from a bounded sample of documents whose language is known. Each text then
yields one log likelihood for each language. The other evidence is counted over all rows by
grouped aggregation of the posteriors from the text alone: how often each language comes with each
declared language, and the share of each language by address suffix, domain and host, each
smoothed towards the one above it. A row's own share is taken out of its host's counts, and the
logarithms are added.
"""

from __future__ import annotations

import html as html_text
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hidden, pick, shown, small_batches, without, written

BUCKETS = 1 << 15
#: Documents of the training sample at most; all their languages are told apart.
MAX_ROWS = 12_000
#: Trigrams beyond about so many add little evidence: they depend on each other.
FULL = 150.0
LEAN = 10.0  # rows that the level above counts for
MIN_POSTERIOR = 0.5
UNKNOWN = "und"

_LETTER = np.array([chr(c).isalpha() for c in range(0x2000)] + [False] * 0x70 + [True] * 0x90)
_OPENING = re.compile("<html", re.I)
_CODE = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)
_ELEMENT = re.compile(r"<(script|style)\b", re.I)
_CLOSING = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style")}


def trigrams(text: str) -> np.ndarray:
    """The bucket of each trigram of lower-case letters; runs of other characters are one space."""
    if not text:
        return np.empty(0, dtype=np.int64)
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = np.where(c < len(_LETTER), _LETTER[np.minimum(c, len(_LETTER) - 1)], True)
    c = np.where(letter, c, 32)
    keep = letter | np.r_[True, letter[:-1]]
    c = np.r_[32, c[keep], 32].astype(np.uint64)
    if len(c) < 4:
        return np.empty(0, dtype=np.int64) if not letter.any() else (c[:1] * np.uint64(0)).astype(np.int64)
    h = (c[:-2] * np.uint64(0x9E3779B1) + c[1:-1] * np.uint64(0x85EBCA77) + c[2:] * np.uint64(0xC2B2AE3D)) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(49)).astype(np.int64)


def declared_language(html: str) -> str:
    """The language code of the first opening html tag that has one, wherever it stands; else empty."""
    at = 0
    while tag := _OPENING.search(html, at):
        end = html.find(">", tag.end())
        at = len(html) if end < 0 else end
        if code := _CODE.search(html, tag.end(), at):
            return code[1].lower()
    return ""


def visible(html: str) -> str:
    """The text of a page: scripts, styles, comments and tags are spaces; what is opened and never closed counts as a tag or as text.

    Each end is looked for from where the last one was, and not again once there is none, so a page takes time by its length.
    """
    out, at, low, never = [], 0, 0, set()

    def end_of(what: str, found: int, size: int) -> int | None:
        if found < 0:
            never.add(what)
            return None
        return found + size

    while (low := html.find("<", low)) >= 0 and len(never) < 4:
        end = None
        if (element := _ELEMENT.match(html, low)) and (name := element[1].lower()) not in never:
            closing = _CLOSING[name].search(html, element.end())
            end = end_of(name, closing.start() if closing else -1, len(closing[0]) if closing else 0)
        if end is None and "--" not in never and html.startswith("<!--", low):
            end = end_of("--", html.find("-->", low + 4), 3)
        if end is None and ">" not in never:
            end = end_of(">", html.find(">", low), 1)
        if end is None:
            low += 1
            continue
        out += [html[at:low], " "]
        at = low = end
    return html_text.unescape("".join([*out, html[at:]]))


def learn(docs: DataFrame, max_rows: int = MAX_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities by language and bucket) from docs (doc_id, text, lang).

    A sample of max_rows documents at most, those with the smallest hashes of their ids; null
    languages and texts are no examples. Without examples there are no languages.
    """
    small_batches(docs.sparkSession)
    rows = pick(docs, doc_id="long", text="string", lang="string").filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    chosen = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    sample = rows.join(F.broadcast(chosen.distinct()), "doc_id").select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                sums.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                sums[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": n[at]})

    counted = sample.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counted.toPandas()  # BUCKETS rows at most for each language of the sample
    languages = sorted(found["lang"].unique())
    table = np.empty((len(languages), BUCKETS), dtype=np.float32)
    if languages:
        # a trigram's prior is its share of all trigrams, so that rare ones say little
        every = np.bincount(found["bucket"], weights=found["n"], minlength=BUCKETS)
        prior = (every + 0.5) / (every.sum() + 0.5 * BUCKETS)
        for i, (_, part) in enumerate(found.groupby("lang")):
            own = np.bincount(part["bucket"], weights=part["n"], minlength=BUCKETS)
            table[i] = np.log((own + 500 * prior) / (own.sum() + 500))
    return languages, table


def _likelihoods(languages: list[str], table: np.ndarray):
    """letters; the log likelihood of each language; and the posteriors from the text alone (none without letters)."""
    by_bucket = np.ascontiguousarray(table.T)

    @F.pandas_udf("letters long, loglik array<double>, soft array<double>")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            at = trigrams(text or "")
            n = len(at)
            sums = np.zeros(len(languages))
            for k in range(0, n, 65_536):
                sums += by_bucket[at[k : k + 65_536]].sum(axis=0, dtype=np.float64)
            sums *= 1 / (1 + n / FULL)
            soft = np.exp(sums - sums.max()) if n and len(sums) else np.zeros(len(languages))
            out.append((n, sums.tolist(), (soft / max(soft.sum(), 1e-300) if n else soft).tolist()))
        return pd.DataFrame(out, columns=["letters", "loglik", "soft"])

    return run


def _fused(languages: list[str]):
    """The best language's number (-1: none) and its posterior, from all the evidence of a row."""
    n = len(languages)

    def counts(column: pd.Series, own: np.ndarray) -> np.ndarray:
        """Sums without the row's own share; zeros where there are none."""
        found = np.stack([np.zeros(n) if x is None else np.asarray(x, dtype=float) for x in column]) if len(column) else np.zeros((0, n))
        return np.maximum(found - own, 0)

    @F.pandas_udf("at int, posterior double")
    def run(letters: pd.Series, loglik: pd.Series, soft: pd.Series, declared: pd.Series, every: pd.Series, suffix: pd.Series, domain: pd.Series, host: pd.Series) -> pd.DataFrame:
        if not n or not len(letters):
            return pd.DataFrame({"at": pd.Series([-1] * len(letters), dtype="int32"), "posterior": pd.Series([0.0] * len(letters))})
        own = np.stack(soft.to_list())
        base = counts(every, own)
        prior = (base + 1) / (base.sum(axis=1, keepdims=True) + n)
        for level in (suffix, domain, host):
            c = counts(level, own)
            prior = (c + LEAN * prior) / (c.sum(axis=1, keepdims=True) + LEAN)
        told = np.array([x is not None for x in declared])[:, None]
        said = np.where(told, np.log((counts(declared, own) + 0.5) / (base + 1)), 0)
        z = np.stack(loglik.to_list()) + said + np.log(prior)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        read = letters.to_numpy() > 0
        return pd.DataFrame({"at": np.where(read, z.argmax(axis=1), -1).astype("int32"), "posterior": np.where(read, z.max(axis=1), 0.0)})

    return run


def fuse(rows: DataFrame, languages: list[str]) -> DataFrame:
    """rows (declared, suffix, domain, host, letters, loglik, soft, any others) with lang, posterior, accepted.

    Empty strings stand for evidence that is missing. A declared language's, host's, domain's or suffix' rows of any number
    are summed map-side; joins with them are by equality.
    """
    rows = written(rows, "language-evidence")
    sums = F.array(*[F.coalesce(F.sum(F.col("soft")[i]), F.lit(0.0)) for i in range(len(languages))]).cast("array<double>")
    levels = rows.join(F.broadcast(rows.agg(sums.alias("every_sums"))))
    for level in ("declared", "suffix", "domain", "host"):
        part = rows.filter(F.col(level) != "").groupBy(F.col(level).alias("_key")).agg(sums.alias(f"{level}_sums"))
        levels = levels.join(part, F.col(level) == F.col("_key"), "left").drop("_key")
    fused = levels.withColumn("_fused", _fused(languages)("letters", "loglik", "soft", "declared_sums", "every_sums", "suffix_sums", "domain_sums", "host_sums"))
    names = F.array(*[F.lit(x) for x in languages or [UNKNOWN]])
    out = fused.withColumns({"posterior": F.col("_fused.posterior"), "accepted": (F.col("_fused.at") >= 0) & (F.col("_fused.posterior") >= MIN_POSTERIOR)})
    return out.withColumn("lang", F.when(F.col("accepted"), F.get(names, F.col("_fused.at"))).otherwise(F.lit(UNKNOWN)))


def _host_parts(url: Column) -> dict[str, Column]:
    host = F.lower(F.coalesce(F.regexp_extract(url, r"://([^/?#:]*)", 1), F.lit("")))
    dots = F.split(host, r"\.")
    return {"host": host, "domain": F.when(F.size(dots) > 1, F.concat_ws(".", F.slice(dots, -2, 2))).otherwise(host), "suffix": F.when(F.size(dots) > 1, F.element_at(dots, -1)).otherwise(F.lit(""))}


def identify_pages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(page_id, lang, posterior, accepted, declared, host) of every row of pages (page_id, url, html).

    Null html and html without a letter of text give und, posterior 0, not accepted; null urls give no host
    evidence. Languages are those of docs (doc_id, text, lang).
    """
    languages, table = learn(docs)

    @F.pandas_udf("declared string, text string")
    def parts(pages_html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(declared_language(x), visible(x)) for x in (h or "" for h in pages_html)], columns=["declared", "text"])

    rows = pick(pages, page_id="long", url="string", html="string").withColumn("_parts", parts("html"))
    rows = rows.withColumns(_host_parts(F.col("url"))).select("page_id", "host", "domain", "suffix", F.col("_parts.declared").alias("declared"), _likelihoods(languages, table)(F.col("_parts.text")).alias("_text"))
    rows = rows.select("page_id", "host", "domain", "suffix", "declared", "_text.letters", "_text.loglik", "_text.soft")
    return fuse(rows, languages).select("page_id", "lang", F.round("posterior", 6).alias("posterior"), "accepted", "declared", "host")


def drop_unknown(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, lang, source) whose language is told, with all their columns.

    lang is what a document declares and source stands for its host; sources have no suffix.
    Documents without a letter go, and those of which no language has a posterior of MIN_POSTERIOR.
    """
    languages, table = learn(docs)
    plain, names, where = hidden(docs)
    text, said, source = (F.col(where[c]).cast("string") for c in ("text", "lang", "source"))
    # equal rows have equal decisions, so a hash of what decides joins them back
    key = F.xxhash64(F.to_json(F.struct(F.col(where["doc_id"]).cast("string").alias("a"), F.xxhash64(text).alias("b"), said.alias("c"), source.alias("d"))))
    rows = plain.select(key.alias("key"), F.coalesce(source, F.lit("")).alias("host"), F.lit("").alias("domain"), F.lit("").alias("suffix"), F.coalesce(said, F.lit("")).alias("declared"), _likelihoods(languages, table)(text).alias("_text"))
    rows = rows.select("key", "host", "domain", "suffix", "declared", "_text.letters", "_text.loglik", "_text.soft")
    gone = fuse(rows, languages).filter("NOT accepted").select(F.col("key").alias("id")).distinct()
    return shown(without(plain.withColumn("_key", key), F.col("_key"), written(gone, "rejected")), names)
