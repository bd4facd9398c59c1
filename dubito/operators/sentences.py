"""Sentences by a splitter that learns from the corpus itself.

After Kiss and Strunk, "Unsupervised Multilingual Sentence Boundary Detection" (2006): a full
stop that belongs to its word more than chance allows makes the word an abbreviation; words
that follow sure ends more than chance allows are sentence starters; words also seen in lower
case, and never capitalised within a sentence or behind an abbreviation, show by their capital that a sentence begins. Counts are grouped
sums over all tokens, so a frequent word is summed before it is shuffled; they and the model are written to the shared folder once,
as several sums and joins read them. The model is a table by word, joined, not broadcast by force.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, strip, words
from ..sources.folders import scratch

#: Fixed values of the paper: the least score of an abbreviation, of a starter, and the share of full stops an abbreviation has.
ABBREVIATION, STARTER, STOPPED = 0.3, 30.0, 0.99
_BLANKS = r"[ \t\n\x0B\f\r]+"
_CUT = r"(?<=[.!?]['\")\]”’»]?)" + _BLANKS
_MARK = "\x01"


def _core(token: Column) -> Column:
    """A token without the marks round it, but with its final stops; empty if it has no letter or digit."""
    return F.regexp_replace(token, r"^[^\p{L}\p{N}]++|(?<![^\p{L}\p{N}.!?])[^\p{L}\p{N}.!?]++$", "")


def _word(core: Column) -> Column:
    return F.lower(F.rtrim(core, F.lit(".!?")))


def _likely(k: Column, p: Column) -> Column:
    return k * F.ln(F.greatest(p, F.lit(1e-300)))


def _tokens(docs: DataFrame, text: str) -> DataFrame:
    """(core, before): each token's core and that of the token before it, empty at a text's front."""
    cores = F.transform(F.filter(F.split(text, _BLANKS), lambda t: t != ""), _core)
    pairs = let(cores, lambda c: F.arrays_zip(c.alias("core"), F.concat(F.array(F.lit("")), c).alias("before")))
    return docs.select(F.explode(pairs).alias("t")).select("t.core", "t.before").where("core is not null")


def _written(df: DataFrame, name: str) -> DataFrame:
    path = f"{scratch(df.sparkSession, name)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def learn(docs: DataFrame, text: str = "text", least: int = 3) -> DataFrame:
    """(word, abbreviation, starter, capital) of all words of which one holds, from all texts.

    least: abbreviations stand with a full stop so often at least. Null texts count nothing; an empty table learns nothing.
    """
    core, before = F.col("core"), F.col("before")
    stop = before.rlike(r"[.!?]$")
    shape = [_word(core).alias("word"), core.endswith(".").alias("dot"), core.rlike(r"^\p{Ll}").alias("low"), core.rlike(r"^\p{Lu}").alias("upper")]
    place = F.when(stop, "start").when(before != "", "inside").alias("place")
    tokens = _tokens(docs, text).groupBy(*shape, place, F.when(before.endswith("."), _word(before)).otherwise("").alias("last")).agg(F.count("*").alias("c"))
    tokens = _written(tokens, "tokens")  # the one pass over texts
    some = lambda where: F.coalesce(F.sum(F.when(where, F.col("c"))), F.lit(0))
    seen = tokens.groupBy("word").agg(F.sum("c").alias("n"), some(F.col("dot")).alias("dots"), some(F.col("low")).alias("low"), some(F.col("upper") & (F.col("place") == "inside")).alias("high"), F.max(F.col("word").rlike(r"\p{L}")).alias("lettered"))
    seen = seen.where("lettered")
    total = seen.agg(F.sum("n").cast("double").alias("tokens"), F.sum("dots").cast("double").alias("stops"))  # one row
    rows = seen.crossJoin(F.broadcast(total))
    p, free = F.least(F.col("stops") / F.col("tokens"), F.lit(0.98)), F.col("n") - F.col("dots")
    size = F.length(F.replace("word", F.lit("."), F.lit("")))
    ratio = -2 * (_likely(F.col("dots"), p) + _likely(free, 1 - p) - _likely(F.col("dots"), F.lit(STOPPED)) - _likely(free, F.lit(1 - STOPPED)))
    score = ratio * F.exp(-size.cast("double")) * (F.length("word") - size + 1) * F.pow(size.cast("double"), -free.cast("double"))
    short = F.col("word").rlike(r"^\p{L}[\p{L}.]*$") & (F.col("dots") >= least)
    rows = rows.withColumn("abbreviation", F.coalesce(short & (score >= ABBREVIATION), F.lit(False)))

    start = F.col("place") == "start"
    pairs = tokens.groupBy("last", "word").agg(some(start).alias("c"), some(start & F.col("upper")).alias("high")).where("c > 0")
    pairs = pairs.join(rows.where("abbreviation").select(F.col("word").alias("last"), F.lit(True).alias("short")), "last", "left")
    sure = F.col("short").isNull() & ~F.col("last").rlike(r"^\p{L}$")
    after = pairs.groupBy("word").agg(F.coalesce(F.sum(F.when(sure, F.col("c"))), F.lit(0)).alias("after"), F.coalesce(F.sum(F.when(F.col("short"), F.col("high"))), F.lit(0)).alias("named"))
    ends = after.agg(F.sum("after").cast("double").alias("ends"))  # one row
    k, n, a, every = F.coalesce(F.col("after"), F.lit(0)), F.col("n"), F.col("ends"), F.col("tokens")
    rows = rows.join(after, "word", "left").crossJoin(F.broadcast(ends))
    chance, there, elsewhere = n / every, F.try_divide(k, a), F.try_divide(n - k, every - a)  # null without a sure end: no starters
    gain = _likely(k, there) + _likely(a - k, 1 - there) + _likely(n - k, elsewhere) + _likely(every - a - n + k, 1 - elsewhere) - _likely(n, chance) - _likely(every - n, 1 - chance)
    rows = rows.withColumns({"starter": F.coalesce((2 * gain >= STARTER) & (there > chance), F.lit(False)), "capital": (F.col("low") > 0) & (F.col("high") == 0) & (F.coalesce("named", F.lit(0)) == 0)})
    return _written(rows.where("abbreviation or starter or capital").select("word", "abbreviation", "starter", "capital"), "words")


def _same(text: str) -> list[Column]:
    """Two hashes that tell texts apart: what holds for a text holds for its copies."""
    return [F.xxhash64(text).alias("__a"), F.xxhash64(F.lit(1), F.col(text)).alias("__b")]


def split(docs: DataFrame, model: DataFrame, key: str, text: str = "text", least: int = 2) -> DataFrame:
    """(key, sentences): the sentences of each text, of so many words or more, in order.

    Ends are . ! ? with a closing mark or none before blanks; not where a full stop follows an abbreviation or a
    single letter, unless the next word is a starter with a capital, or, behind an abbreviation, one whose capital tells. Within a sentence the blanks
    at such a place become one. Only places behind a full stop that may not end meet the model, by word, without their text; those that
    don't end go back to the texts by hash. A row is given for each row, repeated keys too; a null or empty text has no sentences; U+0001 counts as a blank.
    """
    clean = F.translate(F.coalesce(text, F.lit("")), _MARK, " ")
    pieces = let(F.split(clean, _CUT), lambda p: F.arrays_zip(p.alias("piece"), F.concat(F.slice(p, F.lit(2), F.size(p)), F.array(F.lit(None).cast("string"))).alias("next")))
    places = docs.select(*_same(text), F.posexplode(pieces).alias("at", "p")).select("__a", "__b", "at", "p.*")
    places = places.withColumns({"last": _core(F.element_at(F.split("piece", _BLANKS), -1)), "then": _core(F.get(F.split("next", _BLANKS), F.lit(0)))})
    places = places.where(F.col("last").endswith("."))  # the others end
    places = places.select("__a", "__b", "at", _word(F.col("last")).alias("last"), _word(F.col("then")).alias("next"), F.col("then").rlike(r"^\p{Lu}").alias("upper"))
    single, yes = F.col("last").rlike(r"^\p{L}$"), lambda c: F.coalesce(c, F.lit(False))
    places = places.join(model.where("abbreviation").select(F.col("word").alias("last"), F.lit(True).alias("short")), "last", "left").where(yes(single) | yes(F.col("short")))
    places = places.join(model.where("starter or capital").select(F.col("word").alias("next"), "starter", "capital"), "next", "left")
    begins = yes(F.col("upper")) & (yes(F.col("starter")) | (yes(F.col("capital")) & ~yes(single)))
    held = places.where(~begins).groupBy("__a", "__b").agg(F.array_sort(F.collect_set("at")).alias("__held"))
    rows = docs.select(F.col(key).alias("__key"), *_same(text), clean.alias("__text")).join(held, ["__a", "__b"], "left")
    before = lambda i: F.coalesce(F.get("__held", i - 1), F.lit(-1))
    blanks = F.flatten(F.transform("__held", lambda at, i: F.concat(F.array_repeat(F.lit(_MARK), at - before(i) - 1), F.array(F.lit(" ")))))
    parts = F.zip_with(F.split("__text", _CUT), F.coalesce(blanks, F.array().cast("array<string>")), lambda p, b: F.concat(p, F.coalesce(b, F.lit(_MARK))))
    found = F.transform(F.split(F.array_join(parts, ""), _MARK), strip)
    return rows.select(F.col("__key").alias(key), F.filter(found, lambda s: F.size(words(s)) >= least).alias("sentences"))
