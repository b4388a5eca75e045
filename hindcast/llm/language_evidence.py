"""Language identification by Bayesian evidence fusion (operator 10).

Four kinds of evidence meet in one posterior per row: how likely the text is under each language (hashed
byte trigrams of its letters), the declared markup language (with its reliability counted in the data),
the address suffix and the host. Host and suffix act through priors: counts per host are smoothed by those
of their suffix, these by those of the whole table, all from grouped aggregation. The class ``und``
(no language, all trigrams alike) competes with the languages.

The trigram model is fitted on at most ``SAMPLE_ROWS`` labelled rows per language, those with the smallest
hash of their id, for the ``MOST_LANGUAGES`` most frequent labels. Everything else covers all rows.

A row is kept if its text has letters, its best class is a language and that has a posterior of at least
one half.

Edge cases: null, empty and letterless texts are ``und`` with posterior 0 and not kept; a missing declared
language, host or suffix says nothing; ties go to the first language by name; repeated rows are judged
one by one; an empty table gives an empty result; without a single labelled row every text with letters is
kept as ``und``; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.llm.common import bounded_batches, in_blocks, materialize, table
from hindcast.llm.registry import query

SAMPLE_ROWS = 500
MOST_LANGUAGES = 256
BUCKETS = 1 << 14
#: trigrams overlap, so a text never weighs more than this many independent ones
MOST_EVIDENCE = 60.0
#: pseudo-counts with which a level of the host hierarchy follows its parent
SMOOTHING = 20.0
#: prior weight of "no language", and of a right declaration before any is counted
NO_LANGUAGE = 0.01
DECLARED_RIGHT, DECLARED_WEIGHT = 0.9, 20.0
LEAST_POSTERIOR = 0.5
_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


@dataclass
class Model:
    languages: list[str]
    #: log probabilities, one row per bucket, one column per language and a last one for no language
    table: np.ndarray


def trigrams(text: str):
    """Bucket numbers of the letter trigrams of a text, block by block; words are set off by spaces."""
    for block in in_blocks(text):
        letters = b" ".join(block.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split())
        if letters:
            a = np.frombuffer(b" " + letters + b" ", dtype=np.uint8).astype(np.uint32)
            code = (a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]
            yield (code * np.uint32(0x9E3779B1)) >> np.uint32(18)


def _count_trigrams(batches):
    for batch in batches:
        for lang, group in batch.groupby("lang"):
            counts = np.zeros(BUCKETS, dtype=np.int64)
            for text in group["text"]:
                for numbers in trigrams(text):
                    counts += np.bincount(numbers, minlength=BUCKETS)
            used = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "bucket": used, "n": counts[used]})


def fit(labelled: DataFrame) -> Model:
    """Trigram probabilities from a bounded sample of (doc_id, text, lang) rows."""
    bounded_batches(labelled.sparkSession)
    mark = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    known = labelled.select(F.lower("lang").alias("lang"), "text", mark.alias("mark")).filter("lang <> '' and text is not null")
    # repeated rows count once, so a share of the marks is that share of the rows to choose from
    marks = known.select("lang", "mark").distinct()
    names = marks.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    sizes = {row.lang: row.n for row in names.collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS, 1), dtype=np.float32))
    first = Window.partitionBy("lang").orderBy("mark")
    # three times the rows wanted are expected below the bar, so no task sorts all rows of a language
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 3 * SAMPLE_ROWS / n))])
    ids = (
        marks.filter(F.col("lang").isin(languages))
        .filter(F.col("mark") < share[F.col("lang")] * (1 << 40))
        .withColumn("k", F.row_number().over(first))
        .filter(F.col("k") <= SAMPLE_ROWS)
        .select("lang", "mark")
    )
    # at most MOST_LANGUAGES * SAMPLE_ROWS pairs of a code and a number; one row per pair
    sample = known.join(F.broadcast(ids), ["lang", "mark"], "left_semi").dropDuplicates(["lang", "mark"]).select("lang", "text")
    counts = sample.mapInPandas(_count_trigrams, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    place = {lang: k for k, lang in enumerate(languages)}
    total = np.full((BUCKETS, len(languages) + 1), 0.5)
    for row in counts.toLocalIterator():  # at most BUCKETS rows per language
        total[row.bucket, place[row.lang]] += row.n
    total[:, -1] = 1.0
    return Model(languages, np.log(total / total.sum(axis=0)).astype(np.float32))


def _by_level(rows: DataFrame, level: str, n: int) -> DataFrame:
    """Counts per language at one level of the hierarchy."""
    counts = F.array(*[F.sum(F.when(F.col("best") == k, 1.0).otherwise(0.0)) for k in range(n)])
    return rows.filter(F.col(level).isNotNull()).groupBy(level).agg(counts.alias(f"{level}_counts"))


def _smoothed(counts: Column, parent: Column) -> Column:
    """Counts with the parent's distribution as pseudo-counts; the parent itself without counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return F.when(counts.isNull(), parent).otherwise(F.zip_with(counts, parent, lambda c, p: (c + SMOOTHING * p) / (total + SMOOTHING)))


def identify(rows: DataFrame, model: Model) -> DataFrame:
    """(id, text, declared, host, suffix) to id, lang, posterior, text_lang, declared, kept."""
    spark = rows.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast((model.languages, model.table))
    n = len(model.languages)

    @F.pandas_udf("scores array<double>, best int, n_letters long")
    def likelihoods(texts: pd.Series) -> pd.DataFrame:
        weights = shared.value[1]
        out = []
        for text in texts:
            total, count = np.zeros(weights.shape[1]), 0
            for numbers in trigrams(text):
                total += weights[numbers].sum(axis=0, dtype=np.float64)
                count += len(numbers)
            if count:
                total *= min(count, MOST_EVIDENCE) / count
            out.append((total, int(np.argmax(total[:-1])) if count and n else -1, count))
        return pd.DataFrame(out, columns=["scores", "best", "n_letters"])

    declared = F.lower(F.regexp_extract("declared", "^([A-Za-z]+)", 1))
    scored = materialize(
        rows.select(
            "id",
            F.when(declared != "", declared).alias("declared"),
            F.when(F.col("host") != "", F.col("host")).alias("host"),
            F.when(F.col("suffix") != "", F.col("suffix")).alias("suffix"),
            likelihoods(F.coalesce("text", F.lit(""))).alias("t"),
        ).select("id", "declared", "host", "suffix", "t.*")
    )
    if n == 0:
        return scored.select(
            "id", F.lit("und").alias("lang"), F.lit(0.0).alias("posterior"), F.lit("und").alias("text_lang"), "declared", (F.col("n_letters") > 0).alias("kept")
        )
    evident = scored.filter("best >= 0")
    overall = evident.groupBy("best").agg(F.count("*").alias("n")).collect()  # one row per language
    world = np.full(n, 1.0)
    for row in overall:
        world[row.best] += row.n
    world /= world.sum()

    # how far declarations agree with the texts, per language
    place = {lang: k for k, lang in enumerate(model.languages)}
    codes = F.create_map(*[F.lit(x) for pair in place.items() for x in pair])
    agreed = evident.filter(F.col("declared").isNotNull()).groupBy("best").agg(
        F.count("*").alias("n"), F.sum((codes[F.col("declared")] == F.col("best")).cast("long")).alias("right")
    )
    right = np.full(n, DECLARED_RIGHT)
    for row in agreed.collect():  # one row per language
        right[row.best] = ((row.right or 0) + DECLARED_WEIGHT * DECLARED_RIGHT) / (row.n + DECLARED_WEIGHT)
    right = np.clip(right, 1 / (n + 1), 0.999)

    hosts = _by_level(evident, "host", n)
    suffixes = _by_level(evident, "suffix", n)
    general = F.array(*[F.lit(float(p)) for p in world])
    prior = _smoothed(F.col("host_counts"), _smoothed(F.col("suffix_counts"), general))
    code = F.coalesce(codes[F.col("declared")], F.when(F.col("declared").isNotNull(), F.lit(n)).otherwise(F.lit(-1)))

    @F.pandas_udf("place int, posterior double")
    def fuse(scores: pd.Series, priors: pd.Series, said: pd.Series) -> pd.DataFrame:
        if not len(scores):
            return pd.DataFrame({"place": [], "posterior": []})
        total = np.stack(scores.to_numpy())
        total[:, :n] += np.log(np.stack(priors.to_numpy()) * (1 - NO_LANGUAGE))
        total[:, n] += np.log(NO_LANGUAGE)
        says = said.to_numpy()
        wrong = np.log((1 - right) / n)
        for k in np.flatnonzero(says >= 0):
            total[k, :n] += wrong
            if says[k] < n:
                total[k, says[k]] += np.log(right[says[k]]) - wrong[says[k]]
            total[k, n] -= np.log(n + 1)
        total -= total.max(axis=1, keepdims=True)
        weights = np.exp(total)
        best = np.argmax(weights, axis=1)
        return pd.DataFrame({"place": best, "posterior": weights[np.arange(len(best)), best] / weights.sum(axis=1)})

    names = F.array(*[F.lit(x) for x in [*model.languages, "und"]])
    fused = (
        scored.join(hosts, "host", "left")
        .join(suffixes, "suffix", "left")
        .withColumn("f", fuse("scores", prior, code))
        .withColumn("has_letters", F.col("n_letters") > 0)
        .withColumn("place", F.when(F.col("has_letters"), F.col("f.place")).otherwise(n))
        .withColumn("posterior", F.when(F.col("has_letters"), F.col("f.posterior")).otherwise(0.0))
    )
    return fused.select(
        "id",
        names[F.col("place")].alias("lang"),
        "posterior",
        F.when(F.col("best") >= 0, names[F.col("best")]).otherwise("und").alias("text_lang"),
        "declared",
        ((F.col("place") < n) & (F.col("posterior") >= LEAST_POSTERIOR)).alias("kept"),
    )


def identify_documents(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """Documents: the source stands for the host, the declared language is that of the record."""
    rows = docs.select(
        F.col("doc_id").alias("id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"), F.lit(None).cast("string").alias("suffix")
    )
    return identify(rows, fit(labelled)).withColumnRenamed("id", "doc_id")


def identify_pages(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """Raw pages: visible text, the language of the html tag, host and last part of the host's name."""
    host = F.lower(F.expr("try_parse_url(url, 'HOST')"))
    visible = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", " ")
    rows = pages.select(
        F.col("page_id").alias("id"),
        visible.alias("text"),
        F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1).alias("declared"),
        host.alias("host"),
        F.regexp_extract(host, r"\.([a-z][a-z0-9-]*)$", 1).alias("suffix"),
    )
    return identify(rows, fit(labelled)).withColumnRenamed("id", "page_id")


def keep_identified(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without an identified language go."""
    # everything that the verdict follows from names the rows, because ids may be null or repeated
    mark = F.sha2(F.to_json(F.struct("doc_id", "text", "lang", "source")), 256)
    judged = identify_documents(docs.withColumn("doc_id", mark), docs)
    gone = judged.groupBy("doc_id").agg(F.max("kept").alias("any")).filter("not any").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, mark == gone._gone, "left_anti").select("doc_id", "text", "lang", "source", "n_chars")


@query("op10_language_id")
def op10_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return identify_documents(docs, docs)


@query("page_language_id")
def page_language_id(spark, sf_dir):
    return identify_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
