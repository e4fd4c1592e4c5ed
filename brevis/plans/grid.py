"""Whole jobs: every strategy at every budget, and the flagship comparison."""

from pyspark.sql import Column, DataFrame, functions as F

from brevis import constants as K
from brevis.functions import text as T
from brevis.operators import extractive, filters, rouge, shorten
from brevis.sources import corpus

BUDGETS = {q: K.QUANTITY_BUDGET[q] for q in ("25", "35", "45")}


ALL_RANKINGS = ("luhn", "lsa", "textrank")
COMBO_RANKINGS = ("luhn", "textrank")


def shorten_all(pairs: DataFrame, budgets: dict | None = None, rankings=ALL_RANKINGS, combos=COMBO_RANKINGS, keep=()) -> DataFrame:
    """Every strategy and budget from one scan: a projection and one explode, no shuffle.

    ``combos`` are rankings applied after stop-word removal, next to head+tail after it.
    """
    budgets = budgets or BUDGETS
    document = F.col("document")
    made = pairs.select("id", "document", *keep).withColumns({
        "document_len": T.token_count(document).cast("int"),
        "_toks": shorten.spaced(document),
        "_marks": extractive.marks(document, False),
        "_words": T.words(document),
        "_ranks": extractive.rankings_of(document, rankings),
    })
    made = made.withColumns({f"_{m}": extractive.laid_out(document, F.col(f"_ranks.{m}")) for m in rankings})
    made = made.withColumns({
        "_stop": shorten.without_stopwords(F.col("_words")),
        "_neg": shorten.without_stopwords(F.col("_words"), keep_negations=True),
    })
    variants = shorten.token_variants(F.col("_toks"), budgets)
    variants.append(shorten.variant("full", "512", *shorten.head(F.col("_toks"), 512)))
    for method, column, quantity in (("stopwords", "_stop", "all"), ("stopwords_neg", "_neg", "neg")):
        text = F.col(f"{column}.text")
        variants.append(shorten.variant(method, quantity, text, T.token_count(text)))
    first = F.col("_stop.text")
    made = made.withColumns({
        "_first_toks": shorten.spaced(first), "_first_marks": extractive.marks(first, True), "_first_len": T.token_count(first),
        **({"_first_ranks": extractive.rankings_of(first, combos)} if combos else {}),
    })
    made = made.withColumns({f"_first_{m}": extractive.laid_out(first, F.col(f"_first_ranks.{m}")) for m in combos})
    picked = {}
    for q, b in budgets.items():
        if combos:
            variants.append(shorten.variant("stopwords+headtail0.2", q, *shorten.headtail(F.col("_first_toks"), b, 2)))
        for label, name, size, names in (("", "_", "document_len", rankings), ("stopwords+", "_first_", "_first_len", combos)):
            for m in names:
                picked[f"{name}{m}_{q}"] = extractive.chosen(F.col(f"{name}{m}"), F.col(f"{name}marks"), F.col(size), b, "mod")
                variants.append(shorten.variant(label + m, q, F.col(f"{name}{m}_{q}.text"), F.col(f"{name}{m}_{q}.size")))
    return shorten.one_row_each(made.withColumns(picked), ["id", "document_len", *keep], variants)


def token_leads(pairs: DataFrame, budgets: dict | None = None) -> DataFrame:
    """id, document, summary, the distinct baseline summaries of all token strategies, budgets and the whole text (``leads``), and
    for each method and quantity the place of its summary among them (``at``). A null text has an empty summary."""
    toks = F.col("_toks")
    made = shorten.token_variants(toks, budgets or BUDGETS) + [shorten.variant("full", "512", *shorten.head(toks, 512))]
    lead = lambda v: F.coalesce(T.lead(v["shortened_document"], K.TARGET_LIMIT), F.lit(""))
    named = F.array(*[F.struct(v["method"].alias("method"), v["quantity"].alias("quantity"), lead(v).alias("lead")) for v in made])

    def placed(every: Column, leads: Column) -> Column:
        place = lambda v: (F.array_position(leads, v["lead"]) - 1).cast("int").alias("place")
        return F.struct(leads.alias("leads"), F.transform(every, lambda v: F.struct(v["method"], v["quantity"], place(v))).alias("at"))

    distinct = lambda every: F.array_distinct(F.transform(every, lambda v: v["lead"]))
    bound = T.let(named, lambda every: T.let(distinct(every), lambda leads: placed(every, leads)))
    rows = pairs.withColumn("_toks", shorten.spaced(F.col("document"))).withColumn("_leads", bound)
    return rows.select("id", "document", "summary", "_leads.leads", "_leads.at")


def combo_shorten(pairs: DataFrame, method: str, budgets: dict, keep_negations: bool = False) -> DataFrame:
    """Stop words out first, then a ranking strategy on what is left (sentences by full stop)."""
    first = shorten.shorten_stopwords(pairs, keep_negations).select(
        "id", F.col("shortened_document").alias("document"), "removed_words"
    )
    return extractive.shorten_ranked(first, method, budgets, combo=True)


def combo_headtail(pairs: DataFrame, budget: int, tenths: int) -> DataFrame:
    first = shorten.shorten_stopwords(pairs).select("id", F.col("shortened_document").alias("document"), "removed_words")
    return shorten.shorten_headtail(first, budget, tenths)


def flagship(pairs: DataFrame, low: int = 256, high: int = 512) -> DataFrame:
    """Band -> every strategy at three budgets -> 36-token summary -> ROUGE-1/2 means per strategy and budget.

    Everything up to the means is one narrow stage; only partial means are shuffled.
    """
    banded = _with_reference(filters.length_band(corpus.add_lengths(pairs), low, high))
    made = shorten_all(banded, keep=("_ref",)).where(F.col("quantity").isin(*BUDGETS) & F.col("_ref").isNotNull())
    scored = _summaries_scored(made, (1, 2))
    return scored.groupBy("method", "quantity").agg(
        F.count("*").alias("n_rows"), F.round(F.avg("rouge1"), 6).alias("rouge1"), F.round(F.avg("rouge2"), 6).alias("rouge2")
    )


def _with_reference(pairs: DataFrame) -> DataFrame:
    """The summary's tokens, cut once per document and not once per variant of it."""
    return pairs.withColumn("_ref", T.rouge_tokens(F.col("summary")))


def _summaries_scored(shortened: DataFrame, orders: tuple) -> DataFrame:
    """Baseline summary of each shortened text against the document's own summary; null texts have no score."""
    lead = T.lead(F.col("shortened_document"), K.TARGET_LIMIT)
    usable = shortened.where(F.col("shortened_document").isNotNull())
    return rouge.score_tokens(usable, "_ref", lead, orders, ("method", "quantity"))


def grid_scores(pairs: DataFrame) -> DataFrame:
    """method, quantity, score (ROUGE-1 of the baseline summary) for every row of the full grid."""
    made = shorten_all(_with_reference(pairs), keep=("_ref",)).where(F.col("_ref").isNotNull())
    scored = _summaries_scored(made, (1,))
    return scored.select("method", "quantity", F.col("rouge1").alias("score"))
