"""Language-model quality: rules with perplexity bands (`rate`), and a classifier trained on trusted text (`classify`).

Both use the word model of word_model.py, one per language, whose pair counts Spark shards and which grows with the text
it is counted on. A document has two perplexities per word: that of its words in their order (pairs), and that of its words
alone (the model's lower levels), which copies of the document elsewhere cannot lower.

Languages are those of the tags found: a tag with a 128th of all text or more has a model, thresholds and bands of its own;
the rest and nulls, too little to learn from, share those of "other".

Defined results: null texts are empty, without words; a language with no document to learn from rejects nothing; repeated
rows are judged alike; very long texts are one slice; columns of other names pass through where rows are kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, parted, slices, text_buffers, texts_of, tidy
from .word_model import EXACT, FOLD, short, word_scores, words_of

OTHER = "other"
#: Least share of all text for a language's own model; bounds their number.
LANGUAGE_SHARE = 1 / 128
#: Most words of 64 ids of trusted documents that are broadcast; more are joined.
IDS_MOST = 1 << 20
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def languages(docs: DataFrame, text: str, lang: str) -> list[str]:
    """Tags with at least LANGUAGE_SHARE of all bytes of text."""
    sizes = docs.groupBy(F.col(lang).cast("string").alias("lang")).agg(F.coalesce(F.sum(F.octet_length(F.col(text).cast("string"))), F.lit(0)).alias("n"))
    total = sizes.agg(F.sum("n")).head()[0] or 0
    return sorted(r.lang for r in sizes.where(F.col("lang").isNotNull() & (F.col("n") > 0) & (F.col("n") >= total * LANGUAGE_SHARE)).collect())


def prepared(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    """doc_id, lang, text and row, a hash by which equal rows are one."""
    tag = F.col(lang).cast("string")
    language = F.when(tag.isin(languages(docs, text, lang)), tag).otherwise(F.lit(OTHER))
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), language.alias("lang"), F.col(text).cast("string").alias("text"))
    return d.withColumn("row", F.xxhash64("doc_id", "text"))


def word_sums(known: dict, langs: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray, text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text the summed log2 probabilities of its words alone and by spelling; NaN where the language has no model."""
    out, spelled = np.full(len(langs), np.nan), np.full(len(langs), np.nan)
    for lang in np.unique(langs):
        own = langs == lang
        at = np.flatnonzero(own[text]) if len(text) else text
        if lang in known and len(at):
            one, place, inverse = np.unique(short(h[at]), return_index=True, return_inverse=True)
            spelling = known[lang].model.words(raw, start[at[place]], end[at[place]])
            lower = known[lang].lower(one, spelling)[1]
            for into, values in ((out, lower), (spelled, spelling)):
                into[own] = np.bincount(text[at], values[inverse], len(langs))[own]
    return out, spelled


def base_rules(raw: np.ndarray, offsets: np.ndarray, texts: list[bytes], doc: np.ndarray, h: np.ndarray) -> dict[str, np.ndarray]:
    """Word statistics of texts, whose words have the texts doc and the hashes h."""
    rows = len(texts)

    def per_text(flag: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(flag)])
        return c[offsets[1:]] - c[offsets[:-1]]

    n, total = np.bincount(doc, minlength=rows), len(h)
    repeated = np.zeros(total, bool)
    if total >= 5:
        w = np.zeros(total - 4, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(5):
                w = w * np.uint64(0x9E3779B97F4A7C15) + h[k : total - 4 + k]
                w ^= w >> np.uint64(29)
            w += doc[: total - 4].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        inside = doc[: total - 4] == doc[4:]
        s = np.sort(w[inside])
        again = np.unique(s[1:][s[1:] == s[:-1]])
        if len(again):
            hit = inside & (again[np.minimum(np.searchsorted(again, w), len(again) - 1)] == w)
            for k in range(5):
                repeated[k : total - 4 + k] |= hit
    c = np.concatenate([[0], np.cumsum(repeated)])
    ends = np.cumsum(n)
    dup = np.zeros(rows, np.int64)
    for i, t in enumerate(texts):
        if b"\n" in t:
            lines = t.split(b"\n")
            if len(set(lines)) < len(lines):
                seen: set[bytes] = set()
                for line in lines:
                    dup[i] += line in seen and bool(line.split(None, 1))
                    seen.add(line)
    return {
        "n_words": n, "word_chars": per_text(((raw & 0xC0) != 0x80) & ~_SPACE[raw]), "n_symbols": per_text(_SYMBOLS[raw]),
        "n_dup_lines": dup, "n_repeat_words": c[ends] - c[ends - n],
    }


def perplexities(d: DataFrame, rules: bool) -> DataFrame:
    """Per row of d (doc_id, lang, text, row, teaches and what else it has): all but the text, with n_bytes, n_words, and the
    log2 perplexity per word of the words in_order, alone and as spelled; with rules, the base statistics too."""
    words, known = word_scores(d.select("row", "lang", "text", "teaches"))
    own = [c for c in d.columns if c != "text"]
    more = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"] if rules else ["n_words"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            column = b.column(b.schema.get_field_index("text"))
            raw, offsets = text_buffers(column)
            start, end, text, h, *exact = words_of(raw, offsets, folds=(FOLD, EXACT) if rules else (FOLD,))
            stats = base_rules(raw, offsets, texts_of(column), text, exact[0]) if rules else {"n_words": np.bincount(text, minlength=b.num_rows)}
            alone, spelled = word_sums(known.value, np.array(b.column(b.schema.get_field_index("lang")).to_pylist()), raw, start, end, text, h)
            columns = [b.column(b.schema.get_field_index(c)) for c in own] + [pa.array(x) for x in (np.diff(offsets), alone, spelled, *(stats[c] for c in more))]
            yield pa.RecordBatch.from_arrays(columns, names=[*own, "n_bytes", "alone", "spelled", *more])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema if f.name != "text")
    rows = d.mapInArrow(tidy(judge), f"{types}, n_bytes long, alone double, spelled double, " + ", ".join(f"{c} long" for c in more)).join(words, "row", "left")
    per_word = {c: F.when(F.col("n_words") > 0, -F.nanvl(c, F.lit(None).cast("double")) / F.col("n_words")) for c in ("alone", "spelled")}
    return rows.withColumns({"in_order": -F.col("log2p") / F.col("words")} | per_word).drop("log2p", "words")


def centred(rows: DataFrame, measures: list[str], use: Column, shares: list[float]) -> tuple[DataFrame, dict[str, dict]]:
    """(rows with {measure}_off, its distance from the median of its language among the rows used, times the root of the words,
    since the mean of few words scatters more; language -> n and, by measure, the median and the quantiles of that distance)."""
    known = rows.where(use)
    lang = F.col("lang")
    at = lambda of: F.element_at(F.create_map(*[F.lit(x) for k, v in of.items() for x in (k, v)]), lang) if of else F.lit(None).cast("double")
    exact = 10_000
    first = {r.lang: r for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(m, 0.5, exact).alias(m) for m in measures]).collect()}
    off = {f"{m}_off": (F.col(m) - at({k: r[m] for k, r in first.items() if r[m] is not None})) * F.sqrt("n_words") for m in measures}
    rows = rows.withColumns(off)
    second = rows.where(use).groupBy("lang").agg(*[F.percentile_approx(f"{m}_off", shares, exact).alias(m) for m in measures]).collect()
    return rows, {r.lang: {"n": first[r.lang]["n"]} | {m: (first[r.lang][m], r[m]) for m in measures} for r in second}


def limit(of: dict[str, dict], measure: str, end: Callable) -> Column:
    """The bound on a measure per language: median plus end(its quantiles, n) over the root of the words; null without a model."""
    known = {k: v for k, v in of.items() if v[measure][0] is not None and v[measure][1] is not None}
    at = lambda f: F.element_at(F.create_map(*[F.lit(x) for k, v in known.items() for x in (k, float(f(v)))]), F.col("lang")) if known else F.lit(None).cast("double")
    return at(lambda v: v[measure][0]) + at(lambda v: end(v[measure][1], v["n"])) / F.sqrt(F.greatest("n_words", F.lit(1)))


def over(measure: str, bound: Column) -> Column:
    return F.coalesce(F.col(measure) > bound, F.lit(False))


def under(measure: str, bound: Column) -> Column:
    return F.coalesce(F.col(measure) < bound, F.lit(False))


def rate(docs: DataFrame, below: float = 3.0, above: float = 6.0, above_bytes: float = 5.0, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Quality rules. Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lang,
    perplexity with its bound highest, word_perplexity with lowest and highest, byte_perplexity with highest.

    The model counts all documents; a document's own pairs are taken from the counts it is judged by. Bands are so many robust
    deviations (from the quartiles of the corpus, each side by its own) around the language's median, wider for short texts.
    A document is rejected if the perplexity per word of its words alone is under or over its band, or the same
    per byte, or that of its words in order, is over. A low perplexity in order marks copies, which are no fault."""
    d = prepared(docs, doc_id, text, lang).withColumn("teaches", F.lit(True))
    rows = perplexities(d, rules=True).drop("row", "teaches").withColumn("per_byte", F.col("alone") * F.col("n_words") / F.greatest("n_bytes", F.lit(1)))
    rows = rows.withColumn("base_failed", (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20))
    rows, of = centred(materialize(rows, "rated"), ["in_order", "alone", "per_byte"], ~F.col("base_failed"), [0.25, 0.75])
    upper, lower = (lambda k: lambda q, n: k * q[1] / 0.6745), (lambda k: lambda q, n: k * q[0] / 0.6745)
    bounds = {"highest": limit(of, "in_order", upper(above)), "word_lowest": limit(of, "alone", lower(below)), "word_highest": limit(of, "alone", upper(above)), "byte_highest": limit(of, "per_byte", upper(above_bytes))}
    rows = rows.withColumns(bounds)
    rejected = over("in_order", F.col("highest")) | under("alone", F.col("word_lowest")) | over("alone", F.col("word_highest")) | over("per_byte", F.col("byte_highest"))
    power = lambda c, name: F.pow(F.lit(2.0), F.col(c)).alias(name)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"), "lang",
        power("in_order", "perplexity"), power("highest", "highest"), power("alone", "word_perplexity"), power("word_lowest", "word_lowest"), power("word_highest", "word_highest"),
        power("per_byte", "byte_perplexity"), power("byte_highest", "byte_highest"),
    )


def marked(d: DataFrame, ids: DataFrame) -> DataFrame:
    """d with `trusted`: whether doc_id is among ids (_id, distinct). Ids go to a bit map of 64 each, which is broadcast if it has at
    most IDS_MOST words; more are joined after a map of fixed size has thinned d out."""
    words = ids.groupBy(F.shiftright("_id", 6).alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("_id", F.lit(64)).cast("int"))).alias("_bits"))
    words = materialize(words, "trusted-ids")
    if words.count() <= IDS_MOST:
        seen = d.withColumn("_word", F.shiftright("doc_id", 6)).join(F.broadcast(words), "_word", "left")
        bit = F.call_function("shiftright", F.col("_bits"), F.pmod("doc_id", F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1
        return seen.select(*d.columns, F.coalesce(bit, F.lit(False)).alias("trusted"))
    maybe, rest = parted(d, ("doc_id",), ids.select(F.col("_id").alias("doc_id")))
    joined = maybe.join(ids, F.col("doc_id") == F.col("_id"), "left").select(*d.columns, F.col("_id").isNotNull().alias("trusted"))
    return joined.unionByName(rest.withColumn("trusted", F.lit(False)))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.998, lower: float = 0.002, few: float = 6.0, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", keep: bool = False) -> DataFrame:
    """Quality classifier. Per row: doc_id, lang, n_bytes, perplexity, threshold, word_perplexity, word_lowest, word_threshold, kept;
    with keep, the rows of docs that are kept.

    Trusted text: all documents with a label quality = 1, three quarters of them by a hash of the id for the counts, the rest
    for the thresholds. Thresholds are language-specific quantiles of the held-out documents: upper ones for the perplexity of
    words in order and alone, a lower one for words alone (text that repeats itself; a low perplexity in order marks copies,
    which are no fault). They leave room for short texts, and more where few documents are held out; where these are fewer than a
    quantile tells apart, a bound is at least `few` robust deviations from the median."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("_id")).distinct()
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    d = marked(prepared(docs, doc_id, text, lang), good).withColumn("teaches", F.col("trusted") & ~held)
    rows = materialize(perplexities(d, rules=False).drop("teaches"), "scored")
    rows, of = centred(rows, ["in_order", "alone"], held & F.col("trusted"), [lower, 0.25, 0.75, quantile])

    def room(end: int, quarter: int, share: float) -> Callable:
        # The ends of few documents lie well within the quantile asked for (in a normal law by half at 20 documents).
        far = max if end else min
        return lambda q, n: far(q[end] * (1 + 2.5 / n**0.5), few * q[quarter] / 0.6745 if n * share < 1 else q[end])

    top, bottom = room(3, 2, 1 - quantile), room(0, 1, lower)
    rows = rows.withColumns({"threshold": limit(of, "in_order", top), "word_threshold": limit(of, "alone", top), "word_lowest": limit(of, "alone", bottom)})
    judged = rows.withColumn("kept", ~(over("in_order", F.col("threshold")) | over("alone", F.col("word_threshold")) | under("alone", F.col("word_lowest"))))
    if not keep:
        power = lambda c, name: F.pow(F.lit(2.0), F.col(c)).alias(name)
        return judged.select("doc_id", "lang", "n_bytes", power("in_order", "perplexity"), power("threshold", "threshold"), power("alone", "word_perplexity"), power("word_lowest", "word_lowest"), power("word_threshold", "word_threshold"), "kept")
    # Only rows that may be rejected are shuffled to meet their verdict.
    bad = materialize(judged.where(~F.col("kept")).select(F.col("row").alias("_bad")).distinct(), "rejected")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.xxhash64(F.col(doc_id).cast("long"), F.col(text).cast("string")).alias("_bad"))
    maybe, rest = parted(own, ("_bad",), bad)
    return rest.unionByName(maybe.join(bad, "_bad", "left_anti")).select("_row.*")
