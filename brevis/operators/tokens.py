"""Vocabulary, id encoding and word normalisation."""

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StringType

from brevis import constants as K
from brevis.functions import blocks, text as T
from brevis.functions.scale import number_rows, values_of
from brevis.functions.snowball import snowball_stem


def build_vocab(df: DataFrame, toks: Column) -> DataFrame:
    """term, freq, and its place in ascending and descending term order (from 0)."""
    counted = values_of(df, [], toks, "term").groupBy("term").agg(F.count("*").alias("freq"))
    placed = number_rows(counted, ["term"], "place")
    size = placed.agg(F.count("*")).scalar()
    return placed.withColumn("place_desc", size - 1 - F.col("place"))


def id_vocab(df: DataFrame, toks: Column) -> DataFrame:
    """term -> word_id from 2 by falling frequency, then term."""
    counted = values_of(df, [], toks, "term").groupBy("term").agg(F.count("*").alias("freq"))
    ranked = number_rows(counted.withColumn("_neg", -F.col("freq")), ["_neg", "term"], "word_id")
    return ranked.select("term", "freq", (F.col("word_id") + K.FIRST_WORD_ID).cast("int").alias("word_id"))


def encode_columns(df: DataFrame, vocab: DataFrame, limits: dict, keep: tuple = ("id",), unknown: int | None = None) -> DataFrame:
    """``keep`` columns and for each text column (column -> limit) its word ids, cut at the limit with the end mark last.

    Rows are put into blocks, and a block is sent the ids of its distinct words once; null and repeated ids keep their rows.
    Unknown words get the id ``unknown``, or are dropped without one.
    """
    none = F.array().cast("array<string>")
    cut = [F.coalesce(F.slice(T.tokens(F.col(c)), 1, limit - 1), none) for c, limit in limits.items()]
    packed = blocks.pack(df.select(F.struct(*keep).alias("id"), F.array(*cut).alias("texts")))
    found = blocks.replaced(packed, vocab.select(F.col("term").alias("word"), F.col("word_id").alias("value")), unknown)
    ended = lambda i: F.concat(F.get("texts", F.lit(i)), F.array(F.lit(K.EOS_ID)))
    return found.select(*[F.col("id")[c].alias(c) for c in keep], *[ended(i).alias(c) for i, c in enumerate(limits)])


def encode_ids(df: DataFrame, vocab: DataFrame, column: str = "document", limit: int = 512, unknown: int | None = None) -> DataFrame:
    """id, ids of one text column (``encode_columns``)."""
    return encode_columns(df, vocab, {column: limit}, unknown=unknown).withColumnRenamed(column, "ids")


def decode_ids(encoded: DataFrame, vocab: DataFrame) -> DataFrame:
    """id, text: ids back to words, special ids skipped. A block of rows is sent the words of its distinct ids, so ids of rows may repeat or be null."""
    held = F.coalesce(F.array_compact("ids"), F.array().cast("array<int>"))
    packed = blocks.pack(encoded.select("id", F.array(held).alias("texts")))
    found = blocks.replaced(packed, vocab.select(F.col("word_id").alias("word"), F.col("term").alias("value")))
    return found.select("id", F.array_join(F.get("texts", F.lit(0)), " ").alias("text"))


def train_head(ids: Column, budget: int) -> Column:
    """Training form of head: the last kept id becomes the end mark."""
    return F.when(F.size(ids) <= budget, ids).otherwise(
        F.concat(F.slice(ids, 1, budget - 1), F.array(F.lit(K.EOS_ID)))
    )


def train_tail(ids: Column, budget: int, prefix_ids: tuple) -> Column:
    """Training form of tail: the first ids of the kept part become the prefix ids."""
    n = len(prefix_ids)
    kept = F.slice(ids, F.size(ids) - (budget - n) + 1, budget - n)
    return F.when(F.size(ids) <= budget, ids).otherwise(F.concat(F.array(*[F.lit(i) for i in prefix_ids]), kept))


def train_headtail(ids: Column, budget: int, tenths: int) -> Column:
    front, back = tenths * budget // 10 + 1, (10 - tenths) * budget // 10
    return F.when(F.size(ids) <= front + back, ids).otherwise(
        F.concat(F.slice(ids, 1, front), F.slice(ids, F.size(ids) - back + 1, back))
    )


def padded(ids: Column, length: int) -> Column:
    return F.concat(F.slice(ids, 1, length), F.array_repeat(F.lit(K.PAD_ID), F.greatest(length - F.size(ids), F.lit(0))))


def pack_features(
    df: DataFrame, source: str = "ids", target: str = "target_ids", length: int = 512, target_length: int = K.TARGET_LIMIT
) -> DataFrame:
    """Padded ids and mask; decoder input y[:-1]; labels y[1:] with padding ignored."""
    y = padded(F.col(target), target_length)
    labels = F.transform(F.slice(y, 2, target_length - 1), lambda t: F.when(t == K.PAD_ID, K.LABEL_IGNORE).otherwise(t))
    return df.select(
        "id",
        padded(F.col(source), length).alias("input_ids"),
        F.transform(padded(F.col(source), length), lambda t: (t != K.PAD_ID).cast("int")).alias("mask"),
        F.slice(y, 1, target_length - 1).alias("decoder_ids"),
        labels.alias("labels"),
    )


def simple_preprocess(text: Column) -> Column:
    """Lower-cased alphabetic tokens of 2..15 letters, no stop words, longer than 3 letters."""
    found = T.matches(F.lower(text), K.ALPHA)
    sized = F.filter(found, lambda w: (F.length(w) > 3) & (F.length(w) <= 15))
    return T.without(sized, K.STOPWORDS)


def clean_text(text: Column) -> Column:
    """Delete ASCII punctuation, drop all-digit and short words, lower-case last."""
    bare = T.tokens(F.regexp_replace(text, r"[!-/:-@\[-`{-~]", ""))
    kept = F.filter(bare, lambda w: (F.length(w) > 3) & ~w.rlike(r"^\p{Nd}+$"))
    return F.lower(F.array_join(kept, " "))


def remove_stopwords(text: Column) -> Column:
    stop = list(K.STOPWORDS)
    return F.array_join(F.filter(F.split(text, " "), lambda w: ~w.isin(stop)), " ")


def num_words(text: Column) -> Column:
    return F.size(T.tokens(text))


_VOWELS = "aeiou"


def _is_vowel(word: str, i: int) -> bool:
    return word[i] in _VOWELS or (word[i] == "y" and i > 0 and not _is_vowel(word, i - 1))


def _measure(stem: str) -> int:
    shape = [_is_vowel(stem, i) for i in range(len(stem))]
    return sum(1 for a, b in zip(shape, shape[1:]) if a and not b)


def _holds_vowel(stem: str) -> bool:
    return any(_is_vowel(stem, i) for i in range(len(stem)))


def _double_end(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and not _is_vowel(word, len(word) - 1)


def _short_end(word: str) -> bool:
    n = len(word)
    return (
        n > 2 and not _is_vowel(word, n - 1) and _is_vowel(word, n - 2) and not _is_vowel(word, n - 3)
        and word[-1] not in "wxy"
    )


# The published suffix tables (ending, replacement); longest ending first.
_STEP_TWO = (
    ("ational", "ate"), ("ization", "ize"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("tional", "tion"), ("biliti", "ble"), ("entli", "ent"), ("ousli", "ous"), ("ation", "ate"),
    ("alism", "al"), ("aliti", "al"), ("iviti", "ive"), ("enci", "ence"), ("anci", "ance"),
    ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("ator", "ate"), ("eli", "e"),
)
_STEP_THREE = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", ""),
)
_STEP_FOUR = (
    "ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive",
    "ize", "al", "er", "ic", "ou",
)


def porter_stem(word: str) -> str:
    """The published five-step suffix stripper; words of up to 3 letters stay as they are."""
    if len(word) <= 3:
        return word
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            word = word[: len(word) - len(end)] + new
            break
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for end in ("ed", "ing"):
            if word.endswith(end):
                if _holds_vowel(word[: -len(end)]):
                    word = word[: -len(end)]
                    if word.endswith(("at", "bl", "iz")) or (_measure(word) == 1 and _short_end(word)):
                        word += "e"
                    elif _double_end(word) and word[-1] not in "lsz":
                        word = word[:-1]
                break
    if word.endswith("y") and _holds_vowel(word[:-1]):
        word = word[:-1] + "i"
    for table in (_STEP_TWO, _STEP_THREE):
        for end, new in table:
            if word.endswith(end):
                if _measure(word[: -len(end)]) > 0:
                    word = word[: -len(end)] + new
                break
    for end in _STEP_FOUR:
        if word.endswith(end):
            stem = word[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short_end(stem)):
            word = stem
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(StringType())
def _stems(words: pd.Series) -> pd.Series:
    return words.map(porter_stem)


def _stem_lists(lists: pd.Series, cut) -> pd.Series:
    """Stem the words of each row's list; a batch stems each distinct word once."""
    known: dict[str, str] = {}

    def stem(word: str) -> str:
        if word not in known:
            known[word] = porter_stem(word)
        return known[word]

    return lists.map(lambda words: None if words is None else [cut(w, stem) for w in words])


@F.pandas_udf(ArrayType(StringType()))
def stems(words: pd.Series) -> pd.Series:
    """An array of words as an array of stems, in place."""
    return _stem_lists(words, lambda word, stem: stem(word))


@F.pandas_udf(ArrayType(StringType()))
def stemmed_lines(lines: pd.Series) -> pd.Series:
    """An array of space-joined words, each word stemmed."""
    return _stem_lists(lines, lambda line, stem: " ".join(stem(w) for w in line.split()))


def stem_vocab(df: DataFrame, toks: Column) -> DataFrame:
    """word, stem for the distinct words of a corpus."""
    return values_of(df, [], toks, "word").distinct().withColumn("stem", _stems("word"))


@F.pandas_udf(StringType())
def _snowball_stems(words: pd.Series) -> pd.Series:
    return words.map(snowball_stem)


def verb_lemmas(spark: SparkSession) -> DataFrame:
    """word, lemma of the irregular verb forms."""
    rows = [(form, verb) for line in K.IRREGULAR_VERBS.split("\n") for verb, *forms in [line.split()] for form in forms]
    return spark.createDataFrame(rows, "word string, lemma string")


def lemma_stem_vocab(df: DataFrame, toks: Column, lemmas: DataFrame | None = None) -> DataFrame:
    """word, lemma, stem for the distinct words of a corpus: the verb's base form if the table has one, then its Porter2 stem.

    ``lemmas`` (word, lemma; one row per word) replaces the table of irregular verbs, as a full dictionary would.
    Regular endings are left to the stemmer. Null words are left out.
    """
    words = values_of(df, [], toks, "word").distinct()
    known = lemmas if lemmas is not None else verb_lemmas(df.sparkSession)
    based = words.join(known, "word", "left").select("word", F.coalesce("lemma", "word").alias("lemma"))
    return based.withColumn("stem", _snowball_stems("lemma"))
