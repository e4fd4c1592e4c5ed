"""Column functions over text: every one is a built-in expression, none needs Python workers."""

from functools import reduce

from pyspark.sql import Column, functions as F

from brevis import constants as K


def let(value: Column, use) -> Column:
    """Evaluate ``value`` once and use it as a variable.

    A column referenced only inside a lambda may be inlined there and run once per element; binding
    it as the lambda variable of a one-entry transform rules that out.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def runs(values: Column) -> Column:
    """Distinct values with their counts, array of (word, n), by sorting: n log n at any length."""

    def of_sorted(s: Column) -> Column:
        first = lambda w, i: F.when((i == 0) | (w != F.get(s, i - 1)), i)
        length = lambda at, k: F.coalesce(F.get(at, k + 1), F.size(s))
        return let(
            F.array_compact(F.transform(s, first)),
            lambda at: F.transform(at, lambda a, k: F.struct(F.get(s, a).alias("word"), (length(at, k) - a).alias("n"))),
        )

    return let(F.sort_array(values), of_sorted)


def overlap(left: Column, right: Column) -> Column:
    """Size of the multiset intersection of two token arrays.

    The k-th copy of a token becomes token#k on both sides, so a hashed set intersection counts
    copies; "#" cannot occur in the tokens.
    """
    def numbered(values: Column) -> Column:
        copies = lambda r: F.transform(
            F.sequence(F.lit(1), r["n"]), lambda c: F.concat(r["word"], F.lit("#"), c.cast("string"))
        )
        return F.flatten(F.transform(runs(values), copies))

    return F.size(F.array_intersect(numbered(left), numbered(right)))


def squash(text: Column) -> Column:
    """Collapse every whitespace run to one space and drop the outer ones."""
    return F.trim(F.regexp_replace(text, K.SPACES, " "))


def tokens(text: Column) -> Column:
    """Whitespace tokens; an empty text has none."""
    return F.array_remove(F.split(text, K.SPACES), "")


def lead(text: Column, limit: int) -> Column:
    """The first ``limit`` tokens joined by spaces, read without scanning the rest of the text."""
    return squash(F.regexp_extract(text, rf"^\s*(?:\S+\s+){{0,{limit - 1}}}\S+", 0))


def token_count(text: Column) -> Column:
    """Tokens including the implicit end-of-sequence token."""
    return F.regexp_count(text, F.lit(r"\S+")) + 1


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def words(text: Column) -> Column:
    """Words and single punctuation marks."""
    return matches(text, K.WORD)


def rank_words(text: Column) -> Column:
    """Lower-cased alphabetic words used by the sentence rankers."""
    return matches(F.lower(text), K.RANK_WORD)


def terms(text: Column) -> Column:
    """Lower-cased terms of two or more word characters."""
    return matches(F.lower(text), K.TERM)


def sentences(text: Column) -> Column:
    return F.array_remove(F.transform(matches(text, K.SENTENCE), lambda s: F.trim(s)), "")


def newline_sentences(text: Column) -> Column:
    return F.regexp_count(text, F.lit("\n")) + 1


def period_sentences(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[.]")) + 1


def rouge_tokens(text: Column) -> Column:
    spaced = F.regexp_replace(F.lower(text), K.NOT_ROUGE, " ")
    return F.array_remove(F.split(spaced, " "), "")


def ngrams(toks: Column, n: int) -> Column:
    if n == 1:
        return toks
    starts = F.when(F.size(toks) >= n, F.sequence(F.lit(1), F.size(toks) - (n - 1))).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda i: F.array_join(F.slice(toks, i, n), " "))


def word_list(entries) -> Column:
    return F.array(*[F.lit(w) for w in entries])


def without(toks: Column, entries) -> Column:
    """Drop tokens whose lower case is in a fixed list (a hashed IN, not an array scan)."""
    keep = list(entries)
    return F.filter(toks, lambda t: ~F.lower(t).isin(keep))


def respace(text: Column) -> Column:
    """Re-attach punctuation to words after tokens were joined by single spaces."""

    def cut_and_join(current: Column, rule) -> Column:
        mark, glue = rule
        # An escaped single character splits without compiling a pattern per row.
        pattern = "\\" + mark if len(mark) == 1 else "\\Q" + mark + "\\E"
        joined = lambda v: F.array_join(F.transform(F.split(v, pattern), lambda p: F.trim(p)), glue)
        return let(current, lambda v: F.when(F.contains(v, F.lit(mark)), joined(v)).otherwise(F.trim(v)))

    spaced = reduce(cut_and_join, K.RESPACE, text)
    return reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), K.RESPACE_TAIL, spaced)


def f1(hits: Column, hyp_size: Column, ref_size: Column) -> Column:
    """F1 on a 0..100 scale; 0 when nothing matches."""
    total = hyp_size + ref_size
    return F.when(hits > 0, F.lit(200.0) * hits / total).otherwise(F.lit(0.0))
