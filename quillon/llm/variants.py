"""Spelling variants by anagram hashing.

The words of all texts are counted with partial sums. A word's key is the sum of its letters' fifth powers, a number
that all its anagrams share. Two words that differ by one letter have keys that differ by one addition, removal or
exchange value; taking the value of the letter in question away on both sides gives a number both share, so the pairs
are found by an equi-join on that number and not by trying every value of the alphabet. Letter order is part of the
join as well: wherever the one difference lies, the half of the word on its other side is the same in both, so the
hash of that half goes into the key with the word's length. What meets under a key is verified in full. Each pair is
accepted on one side alone (the first half if it is the same), so that no pair is counted twice.

A word has at most one row per different letter in each half and two as a whole, and the near words of one are limited
by alphabet and length, so no key gathers what grows with the square of the vocabulary; words with the same letters
(anagrams) don't pair up, since the letters taken away must differ.

A form's count is at least ``factor`` times its word's, so a chain of forms is never longer than the logarithm of the
largest count: roots are found by a few rounds of pointer doubling over the words that have a form.

Edge cases: a null or empty text has no words; a null id counts as the empty text where slips are drawn; repeated rows
count as often as they occur; runs of any length are whole words; of near words with the same count the first in
code-point order is the form; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import written

WORD = re.compile("[A-Za-zÀ-ÿ]+")
#: Sums of powers are kept below this prime, so that no word is long enough to overflow them.
PRIME = (1 << 61) - 1


def slip(word: str, doc_id: int | None, modulus: int = 199) -> str:
    """The word with one code point deleted, where the hash of id and word says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if h % modulus:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def words_in(text: str, doc_id: int | None, modulus: int = 199) -> Counter:
    """Counts of a text's words: A-Z alone is lower-cased, slips applied."""
    low = text.encode().lower().decode()  # of bytes, lower() knows only A-Z
    counts: Counter = Counter()
    for word, n in Counter(WORD.findall(low)).items():
        counts[slip(word, doc_id, modulus)] += n
    return counts


def count_words(docs: DataFrame, min_length: int = 6, modulus: int = 199, most: int = 100_000) -> DataFrame:
    """word and n over all of ``docs`` (doc_id, text). A task sums up in memory and hands over after ``most`` words."""

    def partial(batches):
        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                for word, n in words_in(text.as_py(), doc_id.as_py(), modulus).items():
                    if len(word) >= min_length:
                        counts[word] += n
                if len(counts) >= most:
                    yield rows()
                    counts.clear()
        yield rows()

    texts = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").filter("text is not null")
    return texts.mapInArrow(partial, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _power(letter: Column) -> Column:
    c = F.ascii(letter).cast("bigint")
    return c * c * c * c * c


def anagram_key(letters: Column) -> Column:
    """Sum of the letters' fifth powers."""
    return F.aggregate(letters, F.lit(0).cast("bigint"), lambda total, c: (total + _power(c)) % F.lit(PRIME))


def join_keys(words: DataFrame) -> DataFrame:
    """One row per (word, half, different letter outside that half) with the key of the word without the letter, and two
    rows per whole word for what a longer word leaves: rest, size, half, side, letter, word, n."""
    w, size = F.col("word"), F.col("size")
    base = words.withColumn("size", F.length("word")).withColumn("letters", F.split("word", "")).withColumn("key", anagram_key(F.col("letters")))
    half = F.floor(size / 2).cast("int")
    cut = base.select("word", "n", "key", "size", half.alias("half"), "letters").select(
        "word", "n", "key", "size",
        F.explode(F.array(
            F.struct(F.lit(0).alias("side"), F.xxhash64(F.substring(w, F.lit(1), F.col("half"))).alias("same"), F.array_distinct(F.slice("letters", F.col("half") + 1, size)).alias("out")),
            F.struct(F.lit(1).alias("side"), F.xxhash64(F.substring(w, F.col("half") + 1, size)).alias("same"), F.array_distinct(F.slice("letters", 1, F.col("half"))).alias("out")),
        )).alias("x"),
    ).select("word", "n", "key", "size", "x.side", "x.same", F.explode("x.out").alias("letter"))
    cut = cut.select(F.pmod(F.col("key") - _power(F.col("letter")), F.lit(PRIME)).alias("rest"), "size", "side", "same", "letter", "word", "n")
    upper = F.floor((size + 1) / 2).cast("int")
    whole = base.select("word", "n", "key", "size", upper.alias("half")).select(
        "key", (size + 1).cast("int").alias("size"),
        F.explode(F.array(
            F.struct(F.lit(0).alias("side"), F.xxhash64(F.substring(w, F.lit(1), F.col("half"))).alias("same")),
            F.struct(F.lit(1).alias("side"), F.xxhash64(F.substring(w, F.col("half"), size)).alias("same")),
        )).alias("x"), "word", "n",
    ).select(F.col("key").alias("rest"), "size", "x.side", "x.same", F.lit("").alias("letter"), "word", "n")
    return cut.unionByName(whole)


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: every two words (word, n) that one inserted, deleted or replaced letter tells apart, once."""
    keys = join_keys(words)
    a, b = (keys.select("rest", "size", "side", "same", *[F.col(c).alias(f"{c}_{x}") for c in ("letter", "word", "n")]) for x in "ab")
    met = a.join(b, ["rest", "size", "side", "same"]).filter("word_a < word_b and letter_a <> letter_b")
    half = F.floor(F.col("size") / 2).cast("int")
    alike = F.substring(F.col("word_a"), F.lit(1), half) == F.substring(F.col("word_b"), F.lit(1), half)
    right = ((F.col("side") == 0) == alike) & (F.levenshtein("word_a", "word_b", 1) == 1)
    return met.filter(right).select(F.col("word_a").alias("word"), F.col("n_a").alias("n"), F.col("word_b").alias("near"), F.col("n_b").alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root of ``forms`` (word, form): the end of the chain, by pointer doubling. Chains have no cycles."""
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        far = at.alias("a").join(at.select(F.col("word").alias("root"), F.col("root").alias("beyond")), "root", "left")
        done = written(far.select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "variants-roots")
        at = done.select("word", "root")
        if done.filter("moved").isEmpty():
            return at


def spelling_variants(docs: DataFrame, min_length: int = 6, min_n: int = 5, factor: int = 5, modulus: int = 199) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of ``docs`` (doc_id, text) with ``min_length`` code points and ``min_n`` occurrences."""
    words = written(count_words(docs, min_length, modulus).filter(F.col("n") >= min_n), "variants-words")
    pairs = near_pairs(words)
    both = F.explode(F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    best = F.min(F.struct(-F.col("near_n"), F.col("near")))  # the largest count, then the first in code-point order
    found = pairs.select(both.alias("p")).select("p.*").groupBy("word").agg(F.first("n").alias("n"), F.count("*").alias("n_near"), best.alias("best"))
    found = found.select("word", "n_near", (-F.col("best.col1")).alias("form_n"), F.col("best.near").alias("form"), (-F.col("best.col1") >= factor * F.col("n")).alias("is_form"))
    linked = written(found.select("word", "n_near", *[F.when(F.col("is_form"), F.col(c)).alias(c) for c in ("form", "form_n")]), "variants-near")
    ends = roots(linked.filter("form is not null"))
    out = words.join(linked, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")
