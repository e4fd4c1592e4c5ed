"""Every operator bound to the given tables. Each entry runs over whole tables and whole texts."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from brevis import constants as K
from brevis.functions import blocks, text as T
from brevis.functions.scale import fresh_dir, lean, values_of
from brevis.operators import (
    coherence, embedding, extractive, filters, headlines, mining, quality, rouge, runlog, shorten, tokens, topics,
)
from brevis.plans import grid
from brevis.sources import corpus, tables, versions
from brevis.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; ``brevis.parts`` deals the rows of files with few row groups out anew (off unless the caller sets it)."""
    lean(spark)
    rows = spark.read.parquet(f"{sf}/{name}.parquet")
    parts = spark.conf.get("brevis.parts", None)
    return rows.repartition(int(parts)) if parts else rows


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.pairs_from_texts(table(spark, sf, "documents"), "doc_id", "text")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("document"))


def chats(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.replies(table(spark, sf, "conversations"))


def log(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.run_log(table(spark, sf, "events"))


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def profile(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.split_assign(corpus.add_lengths(pairs(spark, sf)))


# --- sources, sinks, layout -------------------------------------------------------------------

@query
def load_pairs(spark, sf):
    named = pairs(spark, sf).withColumnsRenamed({"document": "article", "summary": "highlights"})
    return corpus.load_pairs(named, "cnn_dailymail").select("id", "document", "summary")


@query
def split_assign(spark, sf):
    return corpus.split_assign(pairs(spark, sf).select("id"))


@query
def length_profile(spark, sf):
    return longs(tables.length_profile(pairs(spark, sf)), "doc_len", "sum_len")


@query
def length_profile_in_file_order(spark, sf):
    """The profile with each row's place in the files as its index."""
    pairs_of = lambda df, index: corpus.pairs_from_texts(df, "doc_id", "text", (index,))
    return longs(tables.length_profile_of_files(spark, f"{sf}/documents.parquet", pairs_of), "doc_len", "sum_len")


@query
def read_length_profile(spark, sf):
    path = fresh_dir(spark, "profile")
    tables.write_length_profile(tables.length_profile(pairs(spark, sf)), path)
    return longs(tables.read_length_profile(spark, path), "doc_len", "sum_len")


def _write_shortened(spark, sf) -> str:
    rows = corpus.split_assign(pairs(spark, sf)).withColumn("document_len", T.token_count(F.col("document")).cast("int"))
    path = fresh_dir(spark, "shortened")
    made = rows.withColumn("_toks", shorten.spaced(F.col("document")))
    tables.write_shortened(made, path, shorten.token_cuts(F.col("_toks"), grid.BUDGETS))
    return path


@query
def read_shortened(spark, sf):
    found = tables.read_shortened(spark, _write_shortened(spark, sf), method="head", quantity="25", split="train")
    return found.select("id", "document", "shortened_document", "summary")


@query
def write_shortened(spark, sf):
    back = tables.read_shortened(spark, _write_shortened(spark, sf))
    return longs(back.select("id", "method", "quantity", "split", "shortened_document", "shortened_len", "document_len"),
                 "shortened_len", "document_len")


def _predictions(spark, sf) -> DataFrame:
    c = chats(spark, sf)
    return c.select(
        "id", F.col("reference").alias("reference_summary"), F.col("hypothesis").alias("generated_summary"),
        F.size(T.tokens(F.col("reference"))).alias("reference_len"),
        F.size(T.tokens(F.col("hypothesis"))).alias("generated_len"),
        F.lit("replies").alias("run"),
        (F.conv(F.substring(F.md5("id"), 1, 4), 16, 10).cast("int") % 5).alias("epoch"),
    )


@query
def read_predictions(spark, sf):
    path = fresh_dir(spark, "predictions")
    tables.write_predictions(_predictions(spark, sf), path)
    return longs(tables.read_predictions(spark, path, run="replies"), "epoch")


@query
def write_predictions(spark, sf):
    path = fresh_dir(spark, "predictions")
    tables.write_predictions(_predictions(spark, sf), path)
    back = spark.read.parquet(path).select("id", "run", "epoch", "reference_len", "generated_len")
    return longs(back, "epoch", "reference_len", "generated_len")


@query
def prediction_table(spark, sf):
    """All nine columns, written by run and epoch and read back: 373 tokens of the head, summarised by the 36-token baseline."""
    made = shorten.lead_summary(shorten.shorten_head(pairs(spark, sf), 373))
    path = fresh_dir(spark, "predictions")
    tables.write_predictions(tables.predictions(made, F.lit("head"), _epoch_of("id")), path)
    back = spark.read.parquet(path).select(*tables.PREDICTION_COLUMNS, "run", "epoch")
    return longs(back, *[c for c in tables.PREDICTION_COLUMNS if c.endswith("_len")], "epoch")


def _epoch_of(column: str):
    """Five epochs, by the id."""
    return F.conv(F.substring(F.md5(column), 1, 4), 16, 10).cast("long") % 5


ALL_SCORES = ("rouge1", "rouge2", "rougeL", "rougeLsum", "emb_p", "emb_r", "emb_f1")


def _flat_chats(spark, sf) -> DataFrame:
    """One-line texts, on which rougeLsum has an SQL counterpart as well."""
    return chats(spark, sf).select("id", *[F.translate(c, "\n", " ").alias(c) for c in ("reference", "hypothesis")])


def _scored_predictions(spark, sf) -> DataFrame:
    flat = _flat_chats(spark, sf)
    vectors = _chat_vectors(spark, sf, flat)
    made = rounded(rouge.rouge_all(flat).join(vectors, "id"), *ALL_SCORES)
    return made.select("id", F.lit("replies").alias("run"), _epoch_of("id").alias("epoch"), *ALL_SCORES)


@query
def scored_predictions(spark, sf):
    """Every score column of every prediction."""
    return _scored_predictions(spark, sf)


@query
def epoch_score_means(spark, sf):
    """All score columns, averaged per epoch."""
    return rounded(rouge.mean_scores(_scored_predictions(spark, sf), list(ALL_SCORES)), *ALL_SCORES)


def _metric_log(spark, sf) -> DataFrame:
    scored = rouge.rouge_all(_flat_chats(spark, sf), keep=("hypothesis",))
    names = ["rouge1", "rouge2", "rougeL", "rougeLsum"]
    each = rounded(scored, *names).select(
        F.lit("replies").alias("run"), _epoch_of("id").alias("epoch"), *names,
        F.size(T.tokens(F.col("hypothesis"))).cast("double").alias("gen_len"))
    return rounded(tables.epoch_metrics(rouge.mean_scores(each, [*names, "gen_len"]), [*names, "gen_len"]), "value")


@query
def metric_log(spark, sf):
    """The four scores and the mean generated length of every epoch, written as rows and read back."""
    path = fresh_dir(spark, "metrics")
    versions.write_version(_metric_log(spark, sf), path, 1)
    return versions.read_version(spark, path)


@query
def full_run_summary(spark, sf):
    """Best epoch by validation loss, its losses and test scores; clicks stand in for training losses, views for validation losses."""
    kind = F.when(F.col("event_type") == "click", "train").when(F.col("event_type") == "view", "validation")
    losses = table(spark, sf, "events").where("event_type IN ('click', 'view')").groupBy(
        F.lit("replies").alias("run"), (F.dayofmonth("ts").cast("long") % 5).alias("epoch"), kind.alias("split")).agg(F.avg("value").alias("loss"))
    out = tables.full_run_summary(_metric_log(spark, sf), rounded(losses, "loss"))
    return rounded(out, *[c for c in out.columns if c not in ("run", "best_epoch")])


def _scored_chats(spark, sf) -> DataFrame:
    c = chats(spark, sf)
    scored = rouge.rouge_n(c)
    keyed = scored.withColumn("run", F.lit("replies"))
    return keyed.withColumn("epoch", F.conv(F.substring(F.md5("id"), 1, 4), 16, 10).cast("long") % 5)


@query
def write_epoch_metrics(spark, sf):
    means = rouge.mean_scores(_scored_chats(spark, sf), ["rouge1", "rouge2"])
    path = fresh_dir(spark, "metrics")
    tables.epoch_metrics(means, ["rouge1", "rouge2"]).write.parquet(path)
    return rounded(spark.read.parquet(path), "value")


@query
def run_summary(spark, sf):
    return rounded(longs(tables.run_summary(log(spark, sf)), "best_epoch", "epochs"), "best_loss", "last_loss")


@query
def step_number(spark, sf):
    ordered = filters.shuffle_seeded(corpus.split_assign(pairs(spark, sf).select("id")))
    return tables.step_number(ordered)


@query
def steps_per_split(spark, sf):
    return tables.steps_per_split(corpus.split_assign(pairs(spark, sf).select("id")))


@query
def combine_steps(spark, sf):
    path = fresh_dir(spark, "steps")
    rows = corpus.split_assign(pairs(spark, sf)).select("id", "split", "summary")
    tables.write_steps(tables.step_number(filters.shuffle_seeded(rows)).drop("position"), path)
    merged = tables.read_steps(spark, path).select("id", "summary", "split", "step")
    return tables.combine_steps(merged, rows.groupBy("split").agg(F.count("*").alias("n_rows")))


@query
def sentence_tsv(spark, sf):
    return tables.sentence_lines(texts(spark, sf))


@query
def save_id_list(spark, sf):
    path = fresh_dir(spark, "ids")
    tables.save_list(table(spark, sf, "labels").where("quality = 1").select("doc_id"), path)
    return filters.semi_by_ids(texts(spark, sf), spark.read.parquet(path)).select("id")


def _topic_lines(spark, sf) -> DataFrame:
    lines = headlines.clean_headline(headlines.extract_headlines(table(spark, sf, "pages"), "p"))
    return filters.keyword_topics(lines, "headline", PAGE_TOPICS)


# The test pages carry invented prose; these fragments occur in it. Same operator, other patterns.
PAGE_TOPICS = {"stock": "ing|tion", "sales": "the |der ", "performance": "que|eau|q1", "management": "que la|from|ceo"}


@query
def topic_fanout(spark, sf):
    path = fresh_dir(spark, "topics")
    tables.topic_fanout(_topic_lines(spark, sf), path)
    back = spark.read.schema("page_id long, pos int, headline string, topic string").parquet(path)
    return longs(back, "pos")


@query
def incremental_shorten(spark, sf):
    p = pairs(spark, sf)
    done = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"))
    left = shorten.shorten_head(tables.incremental(p, done), 373)
    return longs(left.select("id", "shortened_document", "shortened_len"), "shortened_len")


# --- projections, filters, sampling -----------------------------------------------------------

@query
def ws_normalize(spark, sf):
    return filters.ws_normalize(texts(spark, sf))


@query
def add_prefix(spark, sf):
    return filters.add_prefix(texts(spark, sf))


@query
def strip_prefix(spark, sf):
    return filters.strip_prefix(filters.add_prefix(texts(spark, sf)))


@query
def length_band(spark, sf):
    return longs(filters.length_band(profile(spark, sf)).select("id", "doc_len", "sum_len"), "doc_len", "sum_len")


@query
def length_band_wide(spark, sf):
    return longs(filters.length_band(profile(spark, sf), 256, 512).select("id", "doc_len", "sum_len"), "doc_len", "sum_len")


@query
def band_violations(spark, sf):
    return filters.band_violations(profile(spark, sf))


@query
def validate_params(spark, sf):
    """Every shortened row claims a (quantity, budget); one claim in the grid is wrong on purpose."""
    made = shorten.token_grid(pairs(spark, sf).select("id", "document"))
    claimed = made.select(
        "id", "method", "quantity",
        F.when(F.col("method") == "tail", F.lit(373)).otherwise(
            F.when(F.col("quantity") == "25", 373).when(F.col("quantity") == "35", 323).otherwise(273)
        ).alias("budget"),
    )
    return longs(filters.validate_params(claimed), "budget")


@query
def shuffle_seeded(spark, sf):
    return filters.shuffle_seeded(pairs(spark, sf).select("id"))


@query
def row_cap(spark, sf):
    return filters.first_rows(pairs(spark, sf), 100).select("id", "summary")


@query
def row_fraction(spark, sf):
    return filters.first_fraction(pairs(spark, sf)).select("id", "summary")


@query
def mask_words(spark, sf):
    return filters.mask_words(texts(spark, sf), mining.mask_list(texts(spark, sf)))


@query
def blacklist_filter(spark, sf):
    lines = headlines.extract_headlines(table(spark, sf, "pages"), "li")
    return longs(filters.blacklist_filter(lines, ("The", "the", "Overview")), "pos")


@query
def keyword_topics(spark, sf):
    return longs(_topic_lines(spark, sf).select("page_id", "pos", "topic"), "pos")


@query
def keyword_topics_documents(spark, sf):
    return filters.keyword_topics(texts(spark, sf), "document").select("id", "topic")


@query
def topic_counts(spark, sf):
    return filters.topic_counts(_topic_lines(spark, sf))


@query
def columns_reshape(spark, sf):
    raw = table(spark, sf, "documents").select(
        F.col("text").alias("Document"), F.col("n_chars").alias("Unnamed: 0"), "lang",
        F.col("doc_id").cast("string").alias("Sample ids"),
    )
    return tables.columns_reshape(raw, {"Sample ids": "id", "Document": "document"}, ["id"], ["Unnamed: 0"])


@query
def attach_ids(spark, sf):
    c = chats(spark, sf)
    rows = c.select("hypothesis", F.col("id").alias("row_key"))
    return tables.attach_ids(rows, c.select("id"), ["row_key"], ["id"]).select("id", "row_key", "hypothesis")


# --- tokens, sentences, vocabulary ------------------------------------------------------------

@query
def token_count(spark, sf):
    return texts(spark, sf).select("id", T.token_count(F.col("document")).cast("long").alias("n_tokens"))


@query
def build_vocab(spark, sf):
    return tokens.build_vocab(texts(spark, sf), T.terms(F.col("document")))


def _encoded(spark, sf):
    t = texts(spark, sf)
    vocab = tokens.id_vocab(t, T.tokens(F.col("document")))
    return vocab, tokens.encode_ids(t, vocab)


def csv_of(column: str):
    return F.array_join(F.col(column).cast("array<string>"), " ").alias(column)


@query
def encode_ids(spark, sf):
    _, ids = _encoded(spark, sf)
    return ids.select("id", csv_of("ids"))


@query
def decode_ids(spark, sf):
    vocab, ids = _encoded(spark, sf)
    return tokens.decode_ids(ids, vocab)


@query
def pack_features(spark, sf):
    p = pairs(spark, sf)
    vocab = tokens.id_vocab(texts(spark, sf), T.tokens(F.col("document")))
    both = tokens.encode_columns(p, vocab, {"document": 512, "summary": K.TARGET_LIMIT})
    packed = tokens.pack_features(both.withColumnsRenamed({"document": "ids", "summary": "target_ids"}))
    return packed.select("id", csv_of("input_ids"), csv_of("mask"), csv_of("decoder_ids"), csv_of("labels"))


@query
def train_forms(spark, sf):
    _, ids = _encoded(spark, sf)
    i = F.col("ids")
    made = ids.select(
        "id",
        tokens.train_head(i, 373).alias("head"),
        tokens.train_tail(i, 373, (21603, 10)).alias("tail"),
        tokens.train_headtail(i, 373, 2).alias("headtail"),
    )
    return made.select("id", csv_of("head"), csv_of("tail"), csv_of("headtail"))


@query
def sentence_count(spark, sf):
    d = F.col("document")
    return texts(spark, sf).select(
        "id", T.newline_sentences(d).cast("long").alias("by_newline"), T.period_sentences(d).cast("long").alias("by_period")
    )


@query
def sentences(spark, sf):
    return longs(extractive.sentence_rows(texts(spark, sf)), "pos")


@query
def word_tokens(spark, sf):
    w = T.words(F.col("document"))
    return texts(spark, sf).select("id", F.size(w).cast("long").alias("n_words"), F.array_join(w, " ").alias("words"))


@query
def simple_preprocess(spark, sf):
    w = tokens.simple_preprocess(F.col("document"))
    return texts(spark, sf).select("id", F.array_join(w, " ").alias("words"))


@query
def stem_vocab(spark, sf):
    return tokens.stem_vocab(texts(spark, sf), tokens.simple_preprocess(F.col("document")))


@query
def stem_vocab_lemmas(spark, sf):
    """Base forms of irregular verbs, then Porter2 stems."""
    return tokens.lemma_stem_vocab(texts(spark, sf), tokens.simple_preprocess(F.col("document")))


@query
def clean_text(spark, sf):
    return texts(spark, sf).select("id", tokens.clean_text(F.col("document")).alias("document"))


@query
def remove_stopwords(spark, sf):
    return texts(spark, sf).select("id", tokens.remove_stopwords(F.lower("document")).alias("document"))


@query
def num_words(spark, sf):
    return texts(spark, sf).select("id", tokens.num_words(F.col("document")).cast("long").alias("n_words"))


# --- shortening -------------------------------------------------------------------------------

def _short(df: DataFrame) -> DataFrame:
    kept = ["id", "shortened_document", "shortened_len"]
    kept += [c for c in ("quantity", "removed_words") if c in df.columns]
    return longs(df.select(*kept), *[c for c in ("shortened_len", "removed_words") if c in kept])


@query
def shorten_full(spark, sf):
    return _short(shorten.shorten_full(pairs(spark, sf)))


@query
def shorten_head(spark, sf):
    return _short(shorten.shorten_head(pairs(spark, sf), 373))


@query
def shorten_tail(spark, sf):
    return _short(shorten.shorten_tail(pairs(spark, sf), 323))


@query
def shorten_headtail(spark, sf):
    return _short(shorten.shorten_headtail(pairs(spark, sf), 273, 2))


@query
def shorten_headtail_half(spark, sf):
    return _short(shorten.shorten_headtail(pairs(spark, sf), 512, 5))


@query
def shorten_stopwords(spark, sf):
    return _short(shorten.shorten_stopwords(pairs(spark, sf)))


@query
def removed_words(spark, sf):
    return longs(shorten.shorten_stopwords(pairs(spark, sf)).select("id", "removed_words"), "removed_words")


@query
def shorten_stopwords_neg(spark, sf):
    return _short(shorten.shorten_stopwords(pairs(spark, sf), keep_negations=True))


@query
def punct_respace(spark, sf):
    return shorten.punct_respace(texts(spark, sf))


@query
def target_sentences(spark, sf):
    d = pairs(spark, sf)
    plain = extractive.target_sentences(d, 373).select("id", F.col("n_sentences").cast("long").alias("plain"))
    combo = extractive.target_sentences(d, 373, combo=True).select("id", F.col("n_sentences").cast("long").alias("combo"))
    return plain.join(combo, "id")


@query
def shorten_luhn(spark, sf):
    return _short(extractive.shorten_ranked(pairs(spark, sf), "luhn", grid.BUDGETS))


@query
def shorten_lsa(spark, sf):
    return _short(extractive.shorten_ranked(pairs(spark, sf), "lsa", grid.BUDGETS))


@query
def shorten_lsa_1024(spark, sf):
    """The long class: documents of its length band, cut to 512 tokens."""
    banded = filters.length_band(corpus.add_lengths(pairs(spark, sf)), high=1024).select("id", "document", "summary")
    return _short(extractive.shorten_ranked(banded, "lsa", {"512": 512}))


@query
def shorten_textrank(spark, sf):
    return _short(extractive.shorten_ranked(pairs(spark, sf), "textrank", grid.BUDGETS))


@query
def textrank_scores(spark, sf):
    return longs(extractive.sentence_scores(pairs(spark, sf), extractive.textrank_array), "pos")


@query
def luhn_scores(spark, sf):
    return longs(extractive.sentence_scores(pairs(spark, sf), extractive.luhn_array), "pos")


@query
def lsa_scores(spark, sf):
    return longs(extractive.sentence_scores(pairs(spark, sf), extractive.lsa_array), "pos")


@query
def lsa_reduced(spark, sf):
    return rounded(longs(extractive.sentence_scores(pairs(spark, sf), extractive.lsa_reduced_array()), "pos"), "score")


@query
def shorten_centroid(spark, sf):
    return _short(extractive.shorten_centroid(pairs(spark, sf), 373))


@query
def candidate_pick(spark, sf):
    return _short(extractive.shorten_ranked(pairs(spark, sf), "luhn", {"45": 273}, pick="closest"))


@query
def combo_shorten(spark, sf):
    return _short(grid.combo_shorten(pairs(spark, sf), "luhn", grid.BUDGETS))


@query
def combo_lsa(spark, sf):
    return _short(grid.combo_shorten(pairs(spark, sf), "lsa", grid.BUDGETS))


@query
def combo_textrank(spark, sf):
    return _short(grid.combo_shorten(pairs(spark, sf), "textrank", grid.BUDGETS))


@query
def combo_headtail(spark, sf):
    return _short(grid.combo_headtail(pairs(spark, sf), 373, 2))


@query
def shorten_all(spark, sf):
    return longs(grid.shorten_all(pairs(spark, sf)), "shortened_len", "document_len")


@query
def compression_stats(spark, sf):
    stats = shorten.compression_stats(grid.shorten_all(pairs(spark, sf)))
    return rounded(longs(stats, "min_shortened_len", "max_shortened_len"), "avg_document_len", "avg_shortened_len", "ratio")


@query
def generate_summaries(spark, sf):
    made = shorten.shorten_head(pairs(spark, sf), 373)
    return shorten.lead_summary(made).select("id", "generated_summary")


@query
def generate_summaries_hook(spark, sf):
    """The batch hook with a caller's function; here the same 36-token baseline in Python."""
    made = shorten.shorten_head(pairs(spark, sf), 373).select("id", "shortened_document")

    def load():
        return lambda texts: [" ".join(t.split(" ")[:36]) for t in texts]

    return shorten.generate_summaries(made, load).select("id", "generated_summary")


# --- joins ------------------------------------------------------------------------------------

@query
def lookup_lengths(spark, sf):
    ids = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"))
    return longs(filters.lookup_lengths(ids, profile(spark, sf).select("id", "doc_len")), "length")


@query
def semi_by_ids(spark, sf):
    bad = table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    return filters.semi_by_ids(texts(spark, sf), bad)


@query
def select_by_index(spark, sf):
    rows = tables.length_profile(pairs(spark, sf)).select("index", "id", "doc_len")
    positions = table(spark, sf, "labels").select(F.col("doc_id").alias("index"))
    return longs(filters.select_by_index(rows, positions), "doc_len")


@query
def reference_hypothesis(spark, sf):
    return chats(spark, sf)


@query
def zip_columns(spark, sf):
    return longs(headlines.zip_columns(table(spark, sf, "pages"), "h1", "title"), "pos")


# --- metrics ----------------------------------------------------------------------------------

@query
def rouge1(spark, sf):
    return rounded(rouge.rouge_n(chats(spark, sf), (1,)), "rouge1")


@query
def rouge2(spark, sf):
    return rounded(rouge.rouge_n(chats(spark, sf), (2,)), "rouge2")


@query
def rougeL(spark, sf):
    return rounded(rouge.rouge_l(chats(spark, sf)), "rougeL")


@query
def rougeLsum(spark, sf):
    return rounded(rouge.rouge_lsum(chats(spark, sf)), "rougeLsum")


@query
def rougeLsum_single_line(spark, sf):
    """On one-line texts the union score equals rougeL."""
    one = chats(spark, sf)
    flat = one.select("id", *[F.translate(c, "\n", " ").alias(c) for c in ("reference", "hypothesis")])
    return rounded(rouge.rouge_lsum(flat), "rougeLsum")


@query
def rouge_stemmed(spark, sf):
    return rounded(rouge.rouge_n(chats(spark, sf), (1, 2), stem=True), "rouge1", "rouge2")


@query
def rouge_run_score(spark, sf):
    """Stemmed scores of a run, bootstrap middle, with the mean generated length."""
    return rouge.run_score(chats(spark, sf))


@query
def rouge_stemmed_all(spark, sf):
    return rounded(rouge.rouge_all(chats(spark, sf), stem=True), "rouge1", "rouge2", "rougeL", "rougeLsum")


@query
def rouge_corpus(spark, sf):
    return rouge.rouge_corpus(rouge.rouge_n(chats(spark, sf)), ["rouge1", "rouge2"])


@query
def rouge_bootstrap(spark, sf):
    return rounded(rouge.rouge_bootstrap(rouge.rouge_n(chats(spark, sf), (1,)), "rouge1"), "low", "mid", "high")


@query
def mean_scores(spark, sf):
    return rounded(rouge.mean_scores(_scored_chats(spark, sf), ["rouge1", "rouge2"]), "rouge1", "rouge2")


@query
def scores_from_metrics(spark, sf):
    """Event kinds stand in for metric names; the wanted ones are picked by name."""
    means = log(spark, sf).groupBy("epoch", F.col("run").alias("metric")).agg(F.avg("value").alias("value"))
    rows = means.withColumn("run", F.lit("log"))
    wanted = ("click", "purchase", "view")
    return rounded(longs(tables.scores_from_metrics(rows, wanted), "epoch"), *wanted)


@query
def gen_len(spark, sf):
    return rouge.gen_len(chats(spark, sf))


def _vector_scores(spark, sf, rows: DataFrame) -> DataFrame:
    """id with the vector scores of the hypotheses of each row (id, ref, hyps); tokens are bound to the given vectors."""
    vectors = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    packed = embedding.packed_texts(rows, "ref", "hyps")
    kinds = blocks.word_counts(packed).select("word", vectors.agg(F.count("*")).scalar().alias("_n"))
    bound = kinds.select("word", corpus.vectors_for_tokens(F.col("_n"), F.col("word")))
    return embedding.scores_of_blocks(packed, bound.join(vectors, "vec_id"), baseline=0.1)


def _chat_vectors(spark, sf, c: DataFrame) -> DataFrame:
    """id with the vector scores of reference and hypothesis."""
    sides = c.select("id", T.rouge_tokens(F.col("reference")).alias("ref"), F.array(T.rouge_tokens(F.col("hypothesis"))).alias("hyps"))
    return _vector_scores(spark, sf, sides).select("id", F.col("scores")[0].alias("_s")).select("id", "_s.*")


@query
def embedding_score(spark, sf):
    return rounded(_chat_vectors(spark, sf, chats(spark, sf)), "emb_p", "emb_r", "emb_f1")


@query
def embedding_grid(spark, sf):
    """The comparison of token strategies and budgets by vector score; the whole text is the baseline."""
    made = grid.token_leads(pairs(spark, sf))
    # Texts that open with the same words share a summary, which is scored once.
    rows = made.select(
        F.col("at").alias("id"), T.rouge_tokens(F.col("summary")).alias("ref"), F.transform("leads", T.rouge_tokens).alias("hyps"))
    scored = _vector_scores(spark, sf, rows).select(F.explode_outer("id").alias("v"), "scores").where(F.col("v").isNotNull())
    named = rounded(scored.select("v.method", "v.quantity", F.get("scores", F.col("v.place"))["emb_f1"].alias("score")), "score")
    return rounded(runlog.strategy_grid(named), "score", "full_text", "delta")


@query
def split_counts(spark, sf):
    return quality.split_counts(profile(spark, sf), 256, 512)


@query
def band_profile(spark, sf):
    banded = filters.length_band(profile(spark, sf), 256, 512)
    made = [
        quality.length_hist(banded, c, 10).withColumn("measure", F.lit(c)) for c in ("doc_len", "sum_len")
    ]
    return rounded(longs(made[0].unionByName(made[1]), "bin"), "bin_start")


@query
def length_summary(spark, sf):
    out = quality.length_summary(profile(spark, sf)).withColumn("split", F.coalesce("split", F.lit("all")))
    return rounded(longs(out, "min_len", "max_len"), "mean_len", "share_below")


@query
def union_lengths(spark, sf):
    p = profile(spark, sf)
    return longs(quality.union_lengths(*[p.where(F.col("split") == s) for s in ("train", "validation", "test")]), "doc_len")


@query
def length_hist(spark, sf):
    return rounded(longs(quality.length_hist(profile(spark, sf), "doc_len", 25), "bin"), "bin_start")


@query
def length_hist_ranged(spark, sf):
    return rounded(longs(quality.length_hist(profile(spark, sf), "doc_len", 100, low=0, high=1000), "bin"), "bin_start")


def _chat_scores(spark, sf) -> DataFrame:
    return rouge.rouge_n(chats(spark, sf), (1,)).select("id", F.round("rouge1", 6).alias("score"))


@query
def score_quantiles(spark, sf):
    return rounded(quality.score_quantiles(_chat_scores(spark, sf), "score"), "low", "p10", "p50", "p90", "high")


@query
def score_quantiles_by_run(spark, sf):
    out = quality.score_quantiles(log(spark, sf), "value", "event_id", ("run",))
    return rounded(out, "low", "p10", "p50", "p90", "high")


@query
def quantile_tails(spark, sf):
    return quality.quantile_tails(_chat_scores(spark, sf), "score")


@query
def tail_profile(spark, sf):
    tails = quality.quantile_tails(_chat_scores(spark, sf), "score")
    lengths = chats(spark, sf).select("id", F.size(T.tokens(F.col("hypothesis"))).alias("length"))
    return rounded(longs(quality.tail_profile(tails, lengths), "min_length", "max_length"), "mean_length")


@query
def tail_length_hist(spark, sf):
    tails = quality.quantile_tails(_chat_scores(spark, sf), "score")
    lengths = chats(spark, sf).select("id", F.size(T.tokens(F.col("hypothesis"))).alias("length"))
    return rounded(longs(quality.length_hist(tails.join(lengths, "id"), "length", 10, ("tail",)), "bin"), "bin_start")


# --- run log ----------------------------------------------------------------------------------

def _losses(spark, sf) -> DataFrame:
    return runlog.loss_mean(log(spark, sf)).withColumn("loss", F.round("loss", 6))


@query
def loss_mean(spark, sf):
    return longs(_losses(spark, sf), "epoch")


@query
def best_epoch(spark, sf):
    return longs(runlog.best_epoch(_losses(spark, sf)), "best_epoch")


@query
def last_epoch(spark, sf):
    return longs(runlog.last_epoch(log(spark, sf)), "last_epoch", "resume_epoch")


@query
def improvements(spark, sf):
    return longs(runlog.improvements(_losses(spark, sf)), "epoch")


@query
def strategy_last(spark, sf):
    return runlog.strategy_scores(_losses(spark, sf).withColumnRenamed("loss", "score"), "last")


@query
def strategy_best(spark, sf):
    return runlog.strategy_scores(_losses(spark, sf).withColumnRenamed("loss", "score"), "best")


@query
def strategy_grid(spark, sf):
    out = runlog.strategy_grid(grid.grid_scores(pairs(spark, sf)))
    return rounded(out, "score", "full_text", "delta")


@query
def epoch_curve(spark, sf):
    return rounded(longs(runlog.epoch_curve(log(spark, sf)), "epoch"), "score")


@query
def sample_trajectory(spark, sf):
    t = runlog.sample_trajectory(log(spark, sf))
    shown = F.array_join(F.transform("trajectory", lambda s: s["epoch"].cast("string")), " ")
    first = F.col("trajectory")[0]["score"]
    return t.select(
        "run", "sample", shown.alias("epochs"), F.round(first, 6).alias("first_score"),
        F.round("mean_score", 9).alias("mean_score"), "n_epochs",
    )


@query
def epoch_score_rows(spark, sf):
    return longs(runlog.epoch_score_rows(log(spark, sf)), "epoch")


@query
def score_hist(spark, sf):
    return rounded(longs(quality.length_hist(log(spark, sf), "value", 10, ("run",)), "bin"), "bin_start")


# --- top-k and text mining --------------------------------------------------------------------

def _weights(spark, sf) -> DataFrame:
    t = texts(spark, sf)
    return mining.tfidf_of_texts(mining.term_blocks(t), mining.document_count(t))


@query
def topk_terms(spark, sf):
    t = texts(spark, sf)
    return rounded(longs(mining.topk_terms(mining.tf_norm(t), mining.document_count(t), 500), "rank"), "score")


def _lang_terms(spark, sf) -> DataFrame:
    """Document frequency of each term per language, as a topic-word weight table."""
    lang = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("topic"))
    counts = mining.term_counts(texts(spark, sf))
    return counts.join(lang, "id").groupBy("topic", "term").agg(F.count("*").alias("weight"))


@query
def topk_per_topic(spark, sf):
    return longs(mining.topk_by_group(_lang_terms(spark, sf), "topic", 15), "rank")


@query
def topk_sentences(spark, sf):
    return extractive.topk_sentences(pairs(spark, sf), extractive.lsa_array, 3)


@query
def term_counts(spark, sf):
    return mining.term_counts(texts(spark, sf))


@query
def doc2bow(spark, sf):
    counts = mining.term_counts(texts(spark, sf))
    return mining.doc2bow(counts, mining.dictionary(counts))


@query
def tf_norm(spark, sf):
    return rounded(mining.tf_norm(texts(spark, sf)), "weight")


@query
def tfidf(spark, sf):
    return rounded(_weights(spark, sf), "weight")


@query
def tfidf_max_features(spark, sf):
    t = texts(spark, sf)
    return rounded(mining.tfidf_of_texts(mining.term_blocks(t), mining.document_count(t), 500), "weight")


@query
def mask_list(spark, sf):
    return rounded(longs(mining.mask_list(texts(spark, sf)), "rank"), "score")


@query
def tag_buckets(spark, sf):
    """Tags are derived from the vocabulary itself, as no tagger is part of the engine."""
    vocab = values_of(texts(spark, sf), [], T.terms(F.col("document")), "term").distinct()
    names = F.array(*[F.lit(t) for t in ("NNS", "VBD", "JJ", "RBR", "CD", "XX", "DT")])
    return mining.tag_buckets(vocab.withColumn("tag", F.element_at(names, F.length("term") % 7 + 1)))


@query
def tail_terms(spark, sf):
    tails = quality.quantile_tails(_chat_scores(spark, sf), "score")
    out = mining.tail_terms(tails, chats(spark, sf), "hypothesis")
    return rounded(longs(out, "rank"), "weight")


@query
def topic_coherence(spark, sf):
    top = mining.topk_by_group(_lang_terms(spark, sf), "topic", 10).select("topic", "term")
    t = texts(spark, sf)
    return rounded(topics.topic_coherence(top, mining.term_counts(t), mining.document_count(t)), "coherence")


@query
def topic_coherence_cv(spark, sf):
    """The same topic words by sliding windows of 110 terms."""
    top = mining.topk_by_group(_lang_terms(spark, sf), "topic", 10).select("topic", "term")
    return rounded(coherence.topic_coherence_cv(top, texts(spark, sf)), "coherence")


@query
def lda_fit(spark, sf):
    vectors, found = topics.features(texts(spark, sf))
    model = topics.lda_fit(vectors, 5)
    return topics.lda_topics(model, found, 10)


@query
def lda_topics(spark, sf):
    vectors, found = topics.features(texts(spark, sf))
    return topics.lda_topics(topics.lda_fit(vectors, 2, seed=100), found, 15)


@query
def doc_topic(spark, sf):
    vectors, _ = topics.features(texts(spark, sf))
    return topics.doc_topic(topics.lda_fit(vectors, 5), vectors)


@query
def lda_perplexity(spark, sf):
    vectors, _ = topics.features(texts(spark, sf))
    value = topics.lda_perplexity(topics.lda_fit(vectors, 5), vectors)
    return vectors.agg(F.count("*").alias("n_rows"), F.lit(value).alias("log_perplexity"))


@query
def coherence_sweep(spark, sf):
    return topics.coherence_sweep(texts(spark, sf))


@query
def best_k(spark, sf):
    """The number of topics that the sweep prefers."""
    return topics.best_k(coherence_sweep(spark, sf))


@query
def lda_weighed(spark, sf):
    """Topics on tf-idf weights with a chosen vocabulary limit."""
    vectors, found = topics.features(texts(spark, sf), vocab_size=2000, weighed=True)
    return topics.lda_topics(topics.lda_fit(vectors, 5), found, 10)


@query
def tail_topics(spark, sf):
    tails = quality.quantile_tails(_chat_scores(spark, sf), "score")
    return topics.tail_topics(tails, chats(spark, sf), "hypothesis", k=2)


# --- headline pages ---------------------------------------------------------------------------

@query
def extract_headlines(spark, sf):
    return longs(headlines.extract_headlines(table(spark, sf, "pages"), "h1"), "pos")


@query
def extract_paragraphs(spark, sf):
    return longs(headlines.extract_headlines(table(spark, sf, "pages"), "p"), "pos")


@query
def extract_timestamps(spark, sf):
    """The pages' one classed element stands in for the time stamp element."""
    return longs(headlines.extract_timestamps(table(spark, sf, "pages"), "div", "ad"), "pos")


@query
def clean_headline(spark, sf):
    return longs(headlines.clean_headline(headlines.extract_headlines(table(spark, sf, "pages"), "p")), "pos")


def _stamps(spark, sf) -> DataFrame:
    """Event times written the way the headline pages write them."""
    half = F.when(F.hour("ts") < 12, "a.m.").otherwise("p.m.")
    return table(spark, sf, "events").select(
        "event_id",
        F.concat(F.date_format("ts", "MMM"), F.lit(". "), F.dayofmonth("ts"), F.lit(", "), F.year("ts"), F.lit(" at "),
                 F.date_format("ts", "h:mm"), F.lit(" "), half, F.lit(" ET")).alias("stamp"),
    )


@query
def clean_timestamp(spark, sf):
    return headlines.clean_timestamp(_stamps(spark, sf))


@query
def parse_timestamp(spark, sf):
    out = headlines.parse_timestamp(_stamps(spark, sf))
    return out.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("ts"))


@query
def parse_timestamp_faithful(spark, sf):
    out = headlines.parse_timestamp(_stamps(spark, sf), faithful=True)
    return out.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("ts"))


# --- streams ----------------------------------------------------------------------------------

@query
def stream_shorten(spark, sf):
    source = jobs.once(jobs.table_stream(spark, f"{sf}/documents.parquet"), ("doc_id", "text"))
    path = fresh_dir(spark, "stream")

    def strategy(df: DataFrame) -> DataFrame:
        p = corpus.pairs_from_texts(df, "doc_id", "text")
        return shorten.shorten_headtail(p, 373, 2).select("id", "shortened_document", "shortened_len")

    jobs.stream_shorten(source, strategy, path, path + "-state").awaitTermination()
    return longs(spark.read.parquet(path), "shortened_len")


@query
def stream_ranked(spark, sf):
    source = jobs.table_stream(spark, f"{sf}/documents.parquet")
    path = fresh_dir(spark, "stream")

    def strategy(df: DataFrame) -> DataFrame:
        return extractive.shorten_ranked(corpus.pairs_from_texts(df, "doc_id", "text"), "luhn", {"25": 373})

    jobs.stream_ranked(source, strategy, path, path + "-state").awaitTermination()
    return _short(versions.read_every_version(spark, path)).drop("quantity")


@query
def stream_metrics(spark, sf):
    source = corpus.run_log(jobs.table_stream(spark, f"{sf}/events.parquet"))
    path = fresh_dir(spark, "means")
    jobs.write_running(jobs.running_means(source), path, path + "-state").awaitTermination()
    return rounded(longs(versions.read_version(spark, path), "epoch"), "mean_value")


@query
def stream_windows(spark, sf):
    """Daily means, each appended once its day is closed by the watermark."""
    source = jobs.table_stream(spark, f"{sf}/events.parquet").select(
        F.col("event_type").alias("run"), F.col("ts").cast("timestamp").alias("ts"), "value"
    )
    path = fresh_dir(spark, "windows")
    jobs.write_windows(jobs.windowed_means(source), path, path + "-state").awaitTermination()
    back = spark.read.parquet(path).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))
    return rounded(back, "mean_value")


@query
def stream_windows_all(spark, sf):
    """Daily means over all events; days that the watermark has not closed are there as well, and flagged."""
    source = jobs.table_stream(spark, f"{sf}/events.parquet").select(
        F.col("event_type").alias("run"), F.col("ts").cast("timestamp").alias("ts"), "value"
    )
    path = fresh_dir(spark, "windows")
    jobs.write_every_window(jobs.every_window(source), path, path + "-state").awaitTermination()
    back = jobs.read_every_window(spark, path).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))
    return rounded(back, "mean_value")


@query
def flagship(spark, sf):
    return grid.flagship(pairs(spark, sf))
