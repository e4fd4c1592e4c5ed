"""DuckDB statements that state the expected result of every SQL-expressible query.

They are written independently of the Spark plans (windows and joins where Spark uses arrays, and
the other way round) and share only the patterns and fixed values.
"""

from brevis import constants as K


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def squash(x: str) -> str:
    return f"trim(regexp_replace({x}, {lit(K.SPACES)}, ' ', 'g'))"


def toks(x: str) -> str:
    return f"list_filter(string_split({squash(x)}, ' '), lambda t: t <> '')"


def ntok(x: str) -> str:
    return f"(len(regexp_extract_all({x}, '\\S+')) + 1)"


def found(x: str, pattern: str) -> str:
    return f"regexp_extract_all({x}, {lit(pattern)})"


def joined(x: str) -> str:
    # array_to_string is a macro that repeats its argument; nested, that doubles the work per level.
    return f"coalesce(list_aggregate({x}, 'string_agg', ' '), '')"


def sents(x: str) -> str:
    return f"list_filter(list_transform({found(x, K.SENTENCE)}, lambda s: trim(s)), lambda s: s <> '')"


def rtoks(x: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower({x}), {lit(K.NOT_ROUGE)}, ' ', 'g'), ' '), lambda t: t <> '')"


def among(x: str, entries) -> str:
    return f"({x} IN ({', '.join(lit(e) for e in entries)}))"


def terms(x: str) -> str:
    return f"list_filter({found(f'lower({x})', K.TERM)}, lambda w: NOT {among('lower(w)', K.STOPWORDS)})"


def hex_mod(x: str, digits: int, mod) -> str:
    return f"(('0x' || substr(md5({x}), 1, {digits}))::BIGINT % {mod})"


def respaced(x: str) -> str:
    for mark, glue in K.RESPACE:
        x = f"list_aggregate(list_transform(string_split({x}, {lit(mark)}), lambda p: trim(p)), 'string_agg', {lit(glue)})"
    for old, new in K.RESPACE_TAIL:
        x = f"replace({x}, {lit(old)}, {lit(new)})"
    return x


TEXTS = "texts AS (SELECT doc_id::VARCHAR AS id, text AS document, lang FROM documents)"
PAIRS = f"""firsts AS (SELECT doc_id::VARCHAR AS id, text, regexp_extract(text, {lit(K.SENTENCE)}) AS f FROM documents),
pairs AS (SELECT id, trim(f) AS summary,
  trim(CASE WHEN f = '' THEN text ELSE substr(text, strpos(text, f) + length(f)) END) AS document FROM firsts)"""
SPLIT = f"CASE {hex_mod('id', 4, 10)} WHEN 0 THEN 'validation' WHEN 1 THEN 'test' ELSE 'train' END"
PROFILE = f"""{PAIRS}, profile AS (SELECT id, document, summary, {ntok('document')}::BIGINT AS doc_len,
  {ntok('summary')}::BIGINT AS sum_len, {SPLIT} AS split FROM pairs)"""
CHATS = """chats AS (SELECT a.conv_id || '-' || a.turn AS id, a.text AS reference, b.text AS hypothesis
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
  WHERE a.role = 'user' AND b.role = 'assistant')"""
LOG = """log AS (SELECT event_type AS run, day(ts)::BIGINT AS epoch, user_id::VARCHAR AS sample, value, event_id FROM events)"""
LOSSES = f"{LOG}, losses AS (SELECT run, epoch, round(avg(value), 6) AS loss FROM log GROUP BY run, epoch)"
TOKED = f"{PAIRS}, toked AS (SELECT *, {toks('document')} AS t FROM pairs)"


def head_sql(budget: int) -> tuple[str, str]:
    return joined(f"t[1:{budget}]"), f"least(len(t) + 1, {budget})"


def tail_sql(budget: int) -> tuple[str, str]:
    return (joined(f"CASE WHEN len(t) >= {budget - 1} THEN t[len(t) - {budget - 2}:] ELSE t END"),
            f"least(len(t) + 1, {budget})")


def headtail_sql(budget: int, tenths: int) -> tuple[str, str]:
    front, back = tenths * budget // 10 + 1, (10 - tenths) * budget // 10
    whole = f"len(t) + 1 <= {front + back}"
    return (joined(f"CASE WHEN {whole} THEN t ELSE list_concat(t[1:{front}], t[len(t) - {back - 2}:]) END"),
            f"CASE WHEN {whole} THEN len(t) + 1 ELSE {front + back} END")


DOC = "document"
BUDGETS = {q: K.QUANTITY_BUDGET[q] for q in ("25", "35", "45")}


def grid_sql(columns: str, budgets=None) -> str:
    parts = []
    for q, b in (budgets or BUDGETS).items():
        for m, (text, size) in (
            ("head", head_sql(b)), ("tail", tail_sql(b)),
            ("headtail0.2", headtail_sql(b, 2)), ("headtail0.5", headtail_sql(b, 5)),
        ):
            parts.append(f"SELECT {columns}, '{m}' AS method, '{q}' AS quantity, {text} AS shortened_document, "
                         f"({size})::BIGINT AS shortened_len FROM toked")
    return " UNION ALL ".join(parts)


def short(made: tuple[str, str]) -> str:
    return f"WITH {TOKED} SELECT id, {made[0]} AS shortened_document, ({made[1]})::BIGINT AS shortened_len FROM toked"


def stop_entries(neg: bool) -> list:
    return [w for w in K.STOPWORDS if not (neg and w in K.NEGATIONS)]


def stopped(source: str, neg: bool = False, name: str = "stopped") -> str:
    return f"""{name}_w AS (SELECT id, {found('document', K.WORD)} AS w FROM {source}),
{name}_k AS (SELECT id, w, list_filter(w, lambda x: NOT {among('lower(x)', stop_entries(neg))}) AS k FROM {name}_w),
{name} AS (SELECT id, {respaced(joined('k'))} AS document, (len(w) - len(k))::BIGINT AS removed_words FROM {name}_k)"""


# Ranked sentences: (id, pos, score) CTEs over a relation holding (id, document).
def lines_sql(source: str) -> str:
    return f"""listed AS (SELECT id, {sents('document')} AS s FROM {source}),
lines AS (SELECT id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS pos FROM listed),
wlists AS (SELECT id, pos, {found('lower(sentence)', K.RANK_WORD)} AS w FROM lines),
wrows AS (SELECT id, pos, unnest(w) AS word, generate_subscripts(w, 1) AS wpos FROM wlists)"""


def luhn_sql(source: str) -> str:
    return f"""{lines_sql(source)},
often AS (SELECT id, word FROM wrows GROUP BY id, word HAVING count(*) > 1),
marked AS (SELECT id, pos, wpos FROM wrows JOIN often USING (id, word)),
gaps AS (SELECT *, wpos - lag(wpos) OVER (PARTITION BY id, pos ORDER BY wpos) AS gap FROM marked),
runs AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > {K.LUHN_GAP} THEN 1 ELSE 0 END)
  OVER (PARTITION BY id, pos ORDER BY wpos) AS run FROM gaps),
clusters AS (SELECT id, pos, run, count(*) AS hits, max(wpos) - min(wpos) + 1 AS span FROM runs GROUP BY ALL),
ranks AS (SELECT id, pos, round(max(CASE WHEN hits > 1 THEN hits * hits / span::DOUBLE ELSE 0 END), 9) AS score
  FROM clusters GROUP BY id, pos)"""


def lsa_sql(source: str) -> str:
    return f"""{lines_sql(source)},
freq AS (SELECT id, pos, word, count(*) AS f FROM wrows GROUP BY id, pos, word),
tops AS (SELECT id, pos, max(f) AS top, count(*) AS present FROM freq GROUP BY id, pos),
vocab AS (SELECT id, count(DISTINCT word) AS v FROM wrows GROUP BY id),
filled AS (SELECT id, pos, sum(pow(0.4 + 0.6 * f / top, 2)) AS filled FROM freq JOIN tops USING (id, pos) GROUP BY id, pos),
ranks AS (SELECT l.id, l.pos, round(sqrt(coalesce(filled, 0) + 0.16 * (coalesce(v, 0) - coalesce(present, 0))), 9) AS score
  FROM lines l LEFT JOIN filled USING (id, pos) LEFT JOIN tops USING (id, pos) LEFT JOIN vocab ON vocab.id = l.id)"""


def textrank_sql(source: str) -> str:
    d = K.DAMPING
    out = f"""{lines_sql(source)},
freq AS MATERIALIZED (SELECT id, pos, word, count(*) AS f FROM wrows GROUP BY id, pos, word),
sizes AS MATERIALIZED (SELECT id, pos, len(w) AS size FROM wlists),
shared AS (SELECT a.id, a.pos AS i, b.pos AS j, sum(a.f * b.f) AS common FROM freq a JOIN freq b USING (id, word) GROUP BY ALL),
edges AS (SELECT s.id, i, j, CASE WHEN ln(x.size) + ln(y.size) = 0 THEN common ELSE common / (ln(x.size) + ln(y.size)) END AS w
  FROM shared s JOIN sizes x ON x.id = s.id AND x.pos = i JOIN sizes y ON y.id = s.id AND y.pos = j),
outs AS (SELECT id, i, sum(w) AS total FROM edges GROUP BY id, i),
flow AS MATERIALIZED (SELECT id, i, j, w / total AS w FROM edges JOIN outs USING (id, i)),
r0 AS MATERIALIZED (SELECT id, pos, 1.0::DOUBLE / count(*) OVER (PARTITION BY id) AS r FROM lines)"""
    for n in range(1, K.RANK_ROUNDS + 1):
        out += f""",
f{n} AS MATERIALIZED (SELECT flow.id, j AS pos, sum(r * w) AS inflow FROM flow JOIN r{n-1} p ON p.id = flow.id AND p.pos = flow.i GROUP BY ALL),
r{n} AS MATERIALIZED (SELECT p.id, p.pos, {1 - d} / count(*) OVER (PARTITION BY p.id) * sum(p.r) OVER (PARTITION BY p.id)
  + {d} * coalesce(inflow, 0) AS r FROM r{n-1} p LEFT JOIN f{n} USING (id, pos))"""
    return out + f",\nranks AS (SELECT id, pos, round(r, 9) AS score FROM r{K.RANK_ROUNDS})"


def cut_sql(source: str, budgets: dict, pick: str = "mod", combo: bool = False) -> str:
    mark = "." if combo else "\n"
    count = f"(length(document) - length(replace(document, {lit(mark)}, '')) + 1)"
    budget_rows = ", ".join(f"('{q}', {b})" for q, b in budgets.items())
    miss = "size % budget" if pick == "mod" else "abs(size - budget)"
    return f"""
placed AS (SELECT l.id, l.pos, sentence, len(regexp_extract_all(sentence, '\\S+')) AS n,
  row_number() OVER (PARTITION BY l.id ORDER BY coalesce(score, 0) DESC, l.pos) AS rk, count(*) OVER (PARTITION BY l.id) AS total
  FROM lines l LEFT JOIN ranks USING (id, pos)),
summed AS (SELECT id, rk, total, 1 + sum(n) OVER (PARTITION BY id ORDER BY rk) AS size FROM placed),
wants AS (SELECT id, quantity, budget, (budget * {count}) // {ntok('document')} AS want
  FROM {source}, (VALUES {budget_rows}) v(quantity, budget)),
offers AS (SELECT w.id, quantity, rk AS k, size, {miss} AS miss FROM wants w JOIN summed s ON s.id = w.id
  AND s.rk IN (greatest(least(want - 1, total), 1), greatest(least(want, total), 1), greatest(least(want + 1, total), 1))),
best AS (SELECT id, quantity, arg_min(k, struct_pack(m := miss, k := k)) AS k, arg_min(size, struct_pack(m := miss, k := k)) AS size
  FROM offers GROUP BY id, quantity),
built AS (SELECT b.id, b.quantity, any_value(size)::BIGINT AS shortened_len, string_agg(sentence, ' ' ORDER BY pos) AS shortened_document
  FROM best b JOIN placed p ON p.id = b.id AND p.rk <= b.k GROUP BY b.id, b.quantity),
cut AS (SELECT w.id, w.quantity, coalesce(shortened_document, '') AS shortened_document, coalesce(shortened_len, 1) AS shortened_len
  FROM wants w LEFT JOIN built USING (id, quantity))"""


def ranked(scorer, budgets=None, pick="mod", combo=False, extra="") -> str:
    budgets = budgets or BUDGETS
    if combo:
        return f"WITH {PAIRS}, {stopped('pairs')}, {scorer('stopped')}, {cut_sql('stopped', budgets, pick, True)} {extra or 'SELECT * FROM cut'}"
    return f"WITH {PAIRS}, {scorer('pairs')}, {cut_sql('pairs', budgets, pick)} {extra or 'SELECT * FROM cut'}"


def rouge_cte(name: str, n: int, source: str) -> str:
    """CTEs ending in <name>(id, f) over source(id, r, h) token lists."""
    def grams(c: str) -> str:
        return c if n == 1 else f"list_transform(range(1, len({c})), lambda i: {c}[i] || ' ' || {c}[i + 1])"
    return f"""{name}_g AS (SELECT id, unnest({grams('r')}) AS g, 1 AS a, 0 AS b FROM {source}
  UNION ALL SELECT id, unnest({grams('h')}), 0, 1 FROM {source}),
{name}_c AS (SELECT id, g, sum(a) AS a, sum(b) AS b FROM {name}_g GROUP BY id, g),
{name}_s AS (SELECT id, sum(least(a, b)) AS hits, sum(a) AS a, sum(b) AS b FROM {name}_c GROUP BY id),
{name} AS (SELECT s.id, CASE WHEN hits > 0 THEN 200.0::DOUBLE * hits::DOUBLE / (a + b)::DOUBLE ELSE 0::DOUBLE END AS f
  FROM {source} s LEFT JOIN {name}_s USING (id))"""


CHAT_TOKENS = f"{CHATS}, sides AS (SELECT id, {rtoks('reference')} AS r, {rtoks('hypothesis')} AS h FROM chats)"
CHAT_ROUGE = f"""{CHAT_TOKENS}, {rouge_cte('one', 1, 'sides')}, {rouge_cte('two', 2, 'sides')},
scored AS (SELECT one.id, one.f AS rouge1, two.f AS rouge2, {hex_mod('one.id', 4, 5)} AS epoch FROM one JOIN two USING (id))"""
CHAT_SCORE = f"{CHAT_TOKENS}, {rouge_cte('one', 1, 'sides')}, scores AS (SELECT id, round(f, 6) AS score FROM one)"
TAILS = f"""{CHAT_SCORE}, cuts AS (SELECT quantile_cont(score, 0.1) AS lo, quantile_cont(score, 0.9) AS hi FROM scores),
tails AS (SELECT id, score, 'bad' AS tail FROM scores, cuts WHERE score <= lo
  UNION ALL SELECT id, score, 'good' FROM scores, cuts WHERE score >= hi)"""

# CTEs ending in embedded(id, emb_p, emb_r, emb_f1) over sides(id, r, h).
EMBEDDED = f"""tr AS (SELECT id, 'r' AS side, unnest(r) AS token FROM sides UNION ALL SELECT id, 'h', unnest(h) FROM sides),
      tc AS (SELECT id, side, token, count(*) AS n FROM tr GROUP BY ALL),
      tv AS (SELECT id, side, token, n, embedding::DOUBLE[] AS v FROM tc JOIN embeddings ON vec_id = {hex_mod('token', 8, '(SELECT count(*) FROM embeddings)')}),
      kinds AS MATERIALIZED (SELECT DISTINCT token, v FROM tv),
      sims AS (SELECT a.id, a.token AS x, any_value(a.n) AS nx, b.token AS y, any_value(b.n) AS ny, any_value(list_cosine_similarity(a.v, b.v)) AS s
        FROM tv a JOIN tv b ON a.id = b.id AND a.side = 'r' AND b.side = 'h' GROUP BY ALL),
      br AS (SELECT id, x, any_value(nx) AS n, max(s) AS s FROM sims GROUP BY id, x),
      bh AS (SELECT id, y, any_value(ny) AS n, max(s) AS s FROM sims GROUP BY id, y),
      rr AS (SELECT id, sum(n * s) / sum(n) AS r FROM br GROUP BY id), pp AS (SELECT id, sum(n * s) / sum(n) AS p FROM bh GROUP BY id),
      embedded AS (SELECT id, round((coalesce(pp.p, 0) - 0.1) / 0.9, 6) AS emb_p, round((coalesce(rr.r, 0) - 0.1) / 0.9, 6) AS emb_r,
        round((coalesce(2 * pp.p * rr.r / (pp.p + rr.r), 0) - 0.1) / 0.9, 6) AS emb_f1
      FROM sides LEFT JOIN rr USING (id) LEFT JOIN pp USING (id))"""

LCS = """WITH RECURSIVE {tokens}, cells AS (
  SELECT id, 0 AS i, j, 0 AS v, len(r) AS n, len(h) AS m FROM sides, unnest(range(0, len(h) + 1)) u(j)
  UNION ALL
  SELECT id, i + 1, j, max(c) OVER (PARTITION BY id ORDER BY j), n, m FROM (
    SELECT p.id, p.i, p.j, p.n, p.m, greatest(p.v, CASE WHEN p.j > 0 AND s.r[p.i + 1] = s.h[p.j]
      THEN lag(p.v) OVER (PARTITION BY p.id ORDER BY p.j) + 1 ELSE 0 END) AS c
    FROM cells p JOIN sides s ON s.id = p.id WHERE p.i < p.n) q)
SELECT s.id, round(CASE WHEN coalesce(v, 0) > 0 THEN 200.0::DOUBLE * v / (len(r) + len(h)) ELSE 0 END, 6) AS {name}
FROM sides s LEFT JOIN cells c ON c.id = s.id AND c.i = c.n AND c.j = c.m"""

COUNTS = f"""{TEXTS}, trows AS (SELECT id, lang, unnest({terms('document')}) AS term FROM texts),
counts AS (SELECT id, any_value(lang) AS lang, term, count(*) AS tf FROM trows GROUP BY id, term)"""
N_DOCS = "(SELECT count(*) FROM documents)"


def tfidf_cte(name: str, counts: str, n_docs: str) -> str:
    return f"""{name}_df AS (SELECT term, count(*) AS df FROM {counts} GROUP BY term),
{name}_w AS (SELECT id, term, tf * (ln((1 + {n_docs})::DOUBLE / (1 + df)) + 1) AS w FROM {counts} JOIN {name}_df USING (term)),
{name} AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM {name}_w)"""


def hist(source: str, value: str, bins: int, by: str = "", low: str = "min(x)", high: str = "max(x)") -> str:
    """CTEs ending in hist(by, bin, bin_start, n_rows) over source."""
    b, g = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    match = f"AND v.{by} = l.{by}" if by else ""
    pick = f"l.{by}, " if by else ""
    return f"""vals AS (SELECT {b}{value}::DOUBLE AS x FROM {source}),
lims AS (SELECT {b}{low}::DOUBLE AS lo, {high}::DOUBLE AS hi FROM vals {g}),
hist AS (SELECT {pick}k::BIGINT AS bin, round(lo + k * ((hi - lo) / {bins}), 6) AS bin_start,
  count(x) AS n_rows FROM lims l CROSS JOIN range({bins}) t(k) LEFT JOIN vals v ON x >= lo AND x <= hi {match}
  AND (CASE WHEN hi > lo THEN least(floor((x - lo) / ((hi - lo) / {bins})), {bins - 1}) ELSE 0 END) = k
  GROUP BY {pick}k, lo, hi)"""


def inner_html(tag: str, css: str | None = None) -> str:
    attrs = rf"[^>]*class=[\"']{css}[\"'][^>]*" if css else r"(?:\s[^>]*)?"
    pattern = rf"(?s)<{tag}{attrs}>(.*?)</{tag}>"
    return f"list_transform(regexp_extract_all(html, {lit(pattern)}, 1), lambda x: regexp_replace(x, '<[^>]*>', '', 'g'))"


def elements(tag: str, css: str | None = None, name: str = "headline") -> str:
    return f"""els AS (SELECT page_id, {inner_html(tag, css)} AS e FROM pages),
items AS (SELECT page_id, (generate_subscripts(e, 1) - 1)::BIGINT AS pos, unnest(e) AS {name} FROM els)"""


CLEANED = f"""{elements('p')}, cleaned AS (SELECT page_id, pos, lower(replace(translate(trim(h), '.?:,', ''), '%', 'percent')) AS headline
  FROM (SELECT page_id, pos, replace(headline, chr(10), '') AS h FROM items) WHERE NOT {among('h', K.BOILERPLATE_RAW)})"""


def topic_rows(source: str, column: str, patterns: dict, keep: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {keep}, '{n}' AS topic FROM {source} WHERE regexp_matches(lower({column}), {lit(p)})" for n, p in patterns.items()
    )


STAMPS = """stamps AS (SELECT event_id, ts, strftime(ts, '%b') || '. ' || day(ts) || ', ' || year(ts) || ' at '
  || ((hour(ts) + 11) % 12 + 1) || ':' || strftime(ts, '%M') || ' ' || CASE WHEN hour(ts) < 12 THEN 'a.m.' ELSE 'p.m.' END || ' ET' AS stamp
  FROM events)"""

VOCAB = f"""{TEXTS}, vt AS (SELECT unnest({toks('document')}) AS term FROM texts),
vocab AS (SELECT term, (row_number() OVER (ORDER BY count(*) DESC, term) + 1)::INT AS word_id FROM vt GROUP BY term)"""


def encoded(name: str, source: str, column: str, limit: int) -> str:
    return f"""{name}_t AS (SELECT id, ({toks(column)})[1:{limit - 1}] AS t FROM {source}),
{name}_r AS (SELECT id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM {name}_t),
{name}_i AS (SELECT id, list(word_id ORDER BY pos) AS ids FROM {name}_r JOIN vocab USING (term) GROUP BY id),
{name} AS (SELECT id, list_append(coalesce(ids, []), 1) AS ids FROM {name}_t LEFT JOIN {name}_i USING (id))"""


def pad(x: str, n: int) -> str:
    return f"list_concat({x}[1:{n}], list_transform(range(greatest({n} - len({x}), 0)), lambda z: 0))"


def statements() -> dict[str, str]:
    from brevis.plans.queries import PAGE_TOPICS

    q: dict[str, str] = {}
    q["load_pairs"] = f"WITH {PAIRS} SELECT id, document, summary FROM pairs"
    q["split_assign"] = f"WITH {PAIRS} SELECT id, {SPLIT} AS split FROM pairs"
    q["length_profile"] = f"""WITH {PROFILE} SELECT row_number() OVER (ORDER BY id) - 1 AS "index", id, document AS doc_text,
      summary AS target_text, doc_len, sum_len FROM profile"""
    q["read_length_profile"] = q["length_profile"]
    # The given files hold their rows in doc_id order.
    q["length_profile_in_file_order"] = f"""WITH {PROFILE}, placed AS (SELECT doc_id::VARCHAR AS id, row_number() OVER (ORDER BY doc_id) - 1 AS "index" FROM documents)
      SELECT "index", id, document AS doc_text, summary AS target_text, doc_len, sum_len FROM profile JOIN placed USING (id)"""
    q["read_shortened"] = f"""WITH {TOKED} SELECT id, document, {head_sql(373)[0]} AS shortened_document, summary
      FROM toked WHERE {SPLIT} = 'train'"""
    q["write_shortened"] = f"WITH {TOKED} {grid_sql(f'id, {SPLIT} AS split, {ntok(DOC)}::BIGINT AS document_len')}"
    lead = joined("(" + toks("shortened_document") + ")[1:36]")
    q["prediction_table"] = f"""WITH {TOKED}, made AS (SELECT id, document, summary, {head_sql(373)[0]} AS shortened_document FROM toked),
      led AS (SELECT *, {lead} AS generated_summary FROM made)
      SELECT id, document, shortened_document, summary AS reference_summary, generated_summary, {ntok('document')}::BIGINT AS document_len,
      {ntok('shortened_document')}::BIGINT AS shortened_len, {ntok('summary')}::BIGINT AS reference_len,
      {ntok('generated_summary')}::BIGINT AS generated_len, 'head' AS run, {hex_mod('id', 4, 5)} AS epoch FROM led"""
    q["read_predictions"] = f"""WITH {CHATS} SELECT 'replies' AS run, {hex_mod('id', 4, 5)} AS epoch, id,
      reference AS reference_summary, hypothesis AS generated_summary FROM chats"""
    q["write_predictions"] = f"""WITH {CHATS} SELECT id, 'replies' AS run, {hex_mod('id', 4, 5)} AS epoch,
      len({toks('reference')})::BIGINT AS reference_len, len({toks('hypothesis')})::BIGINT AS generated_len FROM chats"""
    q["write_epoch_metrics"] = f"""WITH {CHAT_ROUGE} SELECT 'replies' AS run, epoch, 'rouge1' AS metric, round(avg(rouge1), 6) AS value
      FROM scored GROUP BY epoch UNION ALL SELECT 'replies', epoch, 'rouge2', round(avg(rouge2), 6) FROM scored GROUP BY epoch"""
    q["run_summary"] = f"""WITH {LOG}, losses AS (SELECT run, epoch, avg(value) AS loss FROM log GROUP BY run, epoch)
      SELECT run, count(*) AS epochs, arg_min(epoch, loss) AS best_epoch, round(min(loss), 6) AS best_loss,
      round(arg_max(loss, epoch), 6) AS last_loss FROM losses GROUP BY run"""
    shuffled = f"""SELECT id, {SPLIT} AS split, row_number() OVER (ORDER BY md5('42' || id), id) - 1 AS position FROM pairs"""
    q["step_number"] = f"WITH {PAIRS} SELECT *, position // 128 AS step FROM ({shuffled})"
    q["steps_per_split"] = f"""WITH {PAIRS} SELECT split, count(*) AS n_rows, ceil(count(*) / 128.0)::BIGINT AS n_steps
      FROM ({shuffled}) GROUP BY split"""
    q["combine_steps"] = f"WITH {PAIRS} SELECT id, split, summary, position // 128 AS step FROM ({shuffled}) JOIN pairs USING (id)"
    q["sentence_tsv"] = f"WITH {TEXTS} SELECT id, coalesce(array_to_string({sents('document')}, chr(9)), '') AS line FROM texts"
    q["save_id_list"] = "SELECT doc_id::VARCHAR AS id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"
    kept = f"{CLEANED}, kept AS (SELECT * FROM cleaned WHERE NOT {among('headline', K.BOILERPLATE_CLEAN)})"
    q["topic_fanout"] = f"WITH {kept} {topic_rows('kept', 'headline', PAGE_TOPICS, 'page_id, pos, headline')}"
    q["incremental_shorten"] = short(head_sql(373)) + " WHERE id NOT IN (SELECT doc_id::VARCHAR FROM labels)"

    q["ws_normalize"] = f"WITH {TEXTS} SELECT id, {squash('document')} AS document FROM texts"
    q["add_prefix"] = f"WITH {TEXTS} SELECT id, {lit(K.PREFIX)} || document AS document FROM texts"
    q["strip_prefix"] = f"WITH {TEXTS} SELECT id, document FROM texts"
    q["length_band"] = f"WITH {PROFILE} SELECT id, doc_len, sum_len FROM profile WHERE doc_len BETWEEN 485 AND 512 AND sum_len <= 36"
    q["length_band_wide"] = q["length_band"].replace("485", "256")
    q["band_violations"] = f"""WITH {PROFILE} SELECT count(*) AS n_rows, count(*) FILTER (WHERE doc_len NOT BETWEEN 485 AND 512) AS bad_source,
      count(*) FILTER (WHERE sum_len > 36) AS bad_target FROM profile"""
    q["validate_params"] = f"""WITH {PAIRS} SELECT id, 'tail' AS method, v.q AS quantity, 373::BIGINT AS budget
      FROM pairs, (VALUES ('35'), ('45')) v(q)"""
    q["shuffle_seeded"] = f"WITH {PAIRS} SELECT id, row_number() OVER (ORDER BY md5('42' || id), id) - 1 AS position FROM pairs"
    q["row_cap"] = f"WITH {PAIRS} SELECT id, summary FROM pairs ORDER BY id LIMIT 100"
    q["row_fraction"] = f"""WITH {PAIRS} SELECT id, summary FROM (SELECT *, row_number() OVER (ORDER BY id) AS rn FROM pairs)
      WHERE rn <= (SELECT count(*) // 6 FROM pairs)"""
    mask = f"""{COUNTS}, {tfidf_cte('wts', 'counts', N_DOCS)},
      means AS (SELECT term, round(sum(weight) / {N_DOCS}, 9) AS score FROM wts GROUP BY term),
      mask AS (SELECT term, score, row_number() OVER (ORDER BY score DESC, term) AS rank FROM means ORDER BY score DESC, term LIMIT 500)"""
    q["mask_words"] = f"""WITH {mask}, mt AS (SELECT id, {toks('document')} AS t FROM texts),
      mr AS (SELECT id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM mt),
      mk AS (SELECT id, string_agg(term, ' ' ORDER BY pos) AS document FROM mr WHERE term NOT IN (SELECT term FROM mask) GROUP BY id)
      SELECT id, coalesce(mk.document, '') AS document FROM mt LEFT JOIN mk USING (id)"""
    q["blacklist_filter"] = f"WITH {elements('li')} SELECT * FROM items WHERE headline NOT IN ('The', 'the', 'Overview')"
    q["keyword_topics"] = f"WITH {kept} {topic_rows('kept', 'headline', PAGE_TOPICS, 'page_id, pos')}"
    q["keyword_topics_documents"] = f"WITH {TEXTS} {topic_rows('texts', 'document', K.TOPIC_PATTERNS, 'id')}"
    q["topic_counts"] = f"WITH {kept} SELECT topic, count(*) AS n_rows FROM ({topic_rows('kept', 'headline', PAGE_TOPICS, 'page_id, pos')}) GROUP BY topic"
    q["columns_reshape"] = f"WITH {TEXTS} SELECT id, document, lang FROM texts"
    q["attach_ids"] = f"WITH {CHATS} SELECT id, id AS row_key, hypothesis FROM chats"

    q["token_count"] = f"WITH {TEXTS} SELECT id, {ntok('document')}::BIGINT AS n_tokens FROM texts"
    q["build_vocab"] = f"""WITH {TEXTS}, vt AS (SELECT unnest({found('lower(document)', K.TERM)}) AS term FROM texts)
      SELECT term, count(*) AS freq, row_number() OVER (ORDER BY term) - 1 AS place, row_number() OVER (ORDER BY term DESC) - 1 AS place_desc
      FROM vt GROUP BY term"""
    q["encode_ids"] = f"WITH {VOCAB}, {encoded('enc', 'texts', 'document', 512)} SELECT id, {joined('ids')} AS ids FROM enc"
    q["decode_ids"] = f"WITH {TEXTS} SELECT id, {joined('(' + toks('document') + ')[1:511]')} AS text FROM texts"
    y = pad("b.ids", 36)
    x = pad("a.ids", 512)
    q["pack_features"] = f"""WITH {VOCAB}, {PAIRS}, {encoded('a', 'pairs', 'document', 512)}, {encoded('b', 'pairs', 'summary', 36)},
      padded AS (SELECT id, {x} AS x, {y} AS y FROM a JOIN b USING (id))
      SELECT id, {joined('x')} AS input_ids, {joined('list_transform(x, lambda v: CASE WHEN v <> 0 THEN 1 ELSE 0 END)')} AS mask,
      {joined('y[1:35]')} AS decoder_ids, {joined('list_transform(y[2:36], lambda v: CASE WHEN v = 0 THEN -100 ELSE v END)')} AS labels FROM padded"""
    q["train_forms"] = f"""WITH {VOCAB}, {encoded('enc', 'texts', 'document', 512)} SELECT id,
      {joined('CASE WHEN len(ids) <= 373 THEN ids ELSE list_append(ids[1:372], 1) END')} AS head,
      {joined('CASE WHEN len(ids) <= 373 THEN ids ELSE list_concat([21603, 10], ids[len(ids) - 370:]) END')} AS tail,
      {joined('CASE WHEN len(ids) <= 373 THEN ids ELSE list_concat(ids[1:75], ids[len(ids) - 297:]) END')} AS headtail FROM enc"""
    q["sentence_count"] = f"""WITH {TEXTS} SELECT id, (length(document) - length(replace(document, chr(10), '')) + 1)::BIGINT AS by_newline,
      (length(document) - length(replace(document, '.', '')) + 1)::BIGINT AS by_period FROM texts"""
    q["sentences"] = f"""WITH {TEXTS}, l AS (SELECT id, {sents('document')} AS s FROM texts)
      SELECT id, (generate_subscripts(s, 1) - 1)::BIGINT AS pos, unnest(s) AS sentence FROM l"""
    q["word_tokens"] = f"""WITH {TEXTS}, w AS (SELECT id, {found('document', K.WORD)} AS w FROM texts)
      SELECT id, len(w)::BIGINT AS n_words, {joined('w')} AS words FROM w"""
    sp = f"list_filter({found('lower(document)', K.ALPHA)}, lambda w: length(w) BETWEEN 4 AND 15 AND NOT {among('w', K.STOPWORDS)})"
    q["simple_preprocess"] = f"WITH {TEXTS} SELECT id, {joined(sp)} AS words FROM texts"
    ct = (f"list_filter({toks('bare')}, lambda w: length(w) > 3 AND NOT regexp_matches(w, '^\\p{{Nd}}+$'))")
    q["clean_text"] = f"""WITH {TEXTS}, b AS (SELECT id, regexp_replace(document, '[!-/:-@\\[-`{{-~]', '', 'g') AS bare FROM texts)
      SELECT id, lower({joined(ct)}) AS document FROM b"""
    rs = f"list_filter(string_split(lower(document), ' '), lambda w: NOT {among('w', K.STOPWORDS)})"
    q["remove_stopwords"] = f"WITH {TEXTS} SELECT id, {joined(rs)} AS document FROM texts"
    q["num_words"] = f"WITH {TEXTS} SELECT id, ({ntok('document')} - 1)::BIGINT AS n_words FROM texts"

    q["shorten_full"] = short(head_sql(512))
    q["shorten_head"] = short(head_sql(373))
    q["shorten_tail"] = short(tail_sql(323))
    q["shorten_headtail"] = short(headtail_sql(273, 2))
    q["shorten_headtail_half"] = short(headtail_sql(512, 5))
    for name, neg in (("shorten_stopwords", False), ("shorten_stopwords_neg", True)):
        q[name] = f"""WITH {PAIRS}, {stopped('pairs', neg)} SELECT id, document AS shortened_document,
          {ntok('document')}::BIGINT AS shortened_len, removed_words FROM stopped"""
    q["removed_words"] = f"WITH {PAIRS}, {stopped('pairs')} SELECT id, removed_words FROM stopped"
    q["punct_respace"] = f"WITH {TEXTS} SELECT id, {respaced(joined(found('document', K.WORD)))} AS document FROM texts"
    marks = {m: f"(length(document) - length(replace(document, {c}, '')) + 1)" for m, c in (("plain", "chr(10)"), ("combo", "'.'"))}
    q["target_sentences"] = f"""WITH {PAIRS} SELECT id, ((373 * {marks['plain']}) // {ntok('document')})::BIGINT AS plain,
      ((373 * {marks['combo']}) // {ntok('document')})::BIGINT AS combo FROM pairs"""
    q["shorten_luhn"] = ranked(luhn_sql)
    q["shorten_lsa"] = ranked(lsa_sql)
    q["shorten_lsa_1024"] = f"""WITH {PROFILE}, banded AS (SELECT id, document, summary FROM profile WHERE doc_len BETWEEN 972 AND 1024
      AND sum_len <= 36), {lsa_sql('banded')}, {cut_sql('banded', {"512": 512})} SELECT * FROM cut"""
    q["shorten_textrank"] = ranked(textrank_sql)
    for name, scorer in (("luhn_scores", luhn_sql), ("lsa_scores", lsa_sql), ("textrank_scores", textrank_sql)):
        q[name] = f"""WITH {PAIRS}, {scorer('pairs')} SELECT id, pos, coalesce(score, 0) AS score
          FROM lines LEFT JOIN ranks USING (id, pos)"""
    q["candidate_pick"] = ranked(luhn_sql, {"45": 273}, "closest")
    q["combo_shorten"] = ranked(luhn_sql, combo=True)
    q["combo_lsa"] = ranked(lsa_sql, combo=True)
    q["combo_textrank"] = ranked(textrank_sql, combo=True)
    for name in ("combo_shorten", "combo_lsa", "combo_textrank"):
        q[name] = q[name].replace("SELECT * FROM cut", "SELECT cut.*, removed_words FROM cut JOIN stopped USING (id)")
    ht = headtail_sql(373, 2)
    q["combo_headtail"] = f"""WITH {PAIRS}, {stopped('pairs')}, toked AS (SELECT *, {toks('document')} AS t FROM stopped)
      SELECT id, {ht[0]} AS shortened_document, ({ht[1]})::BIGINT AS shortened_len, removed_words FROM toked"""

    def all_rows(source: str = "pairs", head: str = TOKED) -> str:
        """WITH clause ending in allrows(id, method, quantity, shortened_document, shortened_len, document_len)."""
        ranked_parts = ""
        unions = [grid_sql("id"), f"""SELECT id, 'full', '512', {head_sql(512)[0]}, ({head_sql(512)[1]})::BIGINT FROM toked"""]
        for name, neg, quantity in (("stopwords", False, "all"), ("stopwords_neg", True, "neg")):
            ranked_parts += f", {stopped(source, neg, name)}"
            unions.append(f"SELECT id, '{name}', '{quantity}', document, {ntok('document')}::BIGINT FROM {name}")
        ranked_parts += f", first_toked AS (SELECT *, {toks('document')} AS t FROM stopwords)"
        for n, b in BUDGETS.items():
            text, size = headtail_sql(b, 2)
            unions.append(f"SELECT id, 'stopwords+headtail0.2', '{n}', {text}, ({size})::BIGINT FROM first_toked")
        scorers = {"luhn": luhn_sql, "lsa": lsa_sql, "textrank": textrank_sql}
        for label, held, names, combo in (("", source, ("luhn", "lsa", "textrank"), False), ("stopwords+", "stopwords", ("luhn", "textrank"), True)):
            for name in names:
                cut = f"{'first_' * combo}{name}_cut"
                ranked_parts += f", {cut} AS (WITH {scorers[name](held)}, {cut_sql(held, BUDGETS, 'mod', combo)} SELECT * FROM cut)"
                unions.append(f"SELECT id, '{label}{name}', quantity, shortened_document, shortened_len FROM {cut}")
        lens = f"lens AS (SELECT id, {ntok('document')}::BIGINT AS document_len FROM {source})"
        return f"""WITH RECURSIVE {head} {ranked_parts}, {lens}, united AS ({' UNION ALL '.join(unions)}),
          allrows AS (SELECT * FROM united JOIN lens USING (id))"""

    q["shorten_all"] = f"{all_rows()} SELECT * FROM allrows"
    q["compression_stats"] = f"""{all_rows()} SELECT method, quantity, count(*) AS n_rows, round(avg(document_len), 6) AS avg_document_len,
      round(avg(shortened_len), 6) AS avg_shortened_len, min(shortened_len) AS min_shortened_len, max(shortened_len) AS max_shortened_len,
      round(sum(shortened_len)::DOUBLE / sum(document_len)::DOUBLE, 6) AS ratio FROM allrows GROUP BY method, quantity"""
    q["generate_summaries"] = f"WITH {TOKED} SELECT id, {joined('t[1:36]')} AS generated_summary FROM toked"
    q["generate_summaries_hook"] = q["generate_summaries"]

    q["lookup_lengths"] = f"WITH {PROFILE} SELECT id, doc_len AS length FROM labels JOIN profile ON id = doc_id::VARCHAR"
    q["semi_by_ids"] = f"WITH {TEXTS} SELECT id, document FROM texts WHERE id::BIGINT IN (SELECT doc_id FROM labels WHERE toxic = 1)"
    q["select_by_index"] = f"""WITH {PROFILE} SELECT * FROM (SELECT row_number() OVER (ORDER BY id) - 1 AS "index", id, doc_len FROM profile)
      WHERE "index" IN (SELECT doc_id FROM labels)"""
    q["reference_hypothesis"] = f"WITH {CHATS} SELECT * FROM chats"
    q["zip_columns"] = f"""WITH a AS (SELECT page_id, {inner_html('h1')} AS x, {inner_html('title')} AS y FROM pages),
      n AS (SELECT page_id, x, y, unnest(range(1, greatest(len(x), len(y)) + 1)) AS p FROM a)
      SELECT page_id, p - 1 AS pos, x[p] AS first, y[p] AS second FROM n"""

    q["rouge1"] = f"WITH {CHAT_ROUGE} SELECT id, round(rouge1, 6) AS rouge1 FROM scored"
    q["rouge2"] = f"WITH {CHAT_ROUGE} SELECT id, round(rouge2, 6) AS rouge2 FROM scored"
    q["rougeL"] = LCS.format(tokens=CHAT_TOKENS, name='"rougeL"')
    q["rougeLsum_single_line"] = LCS.format(tokens=CHAT_TOKENS, name='"rougeLsum"')
    q["rouge_corpus"] = f"WITH {CHAT_ROUGE} SELECT round(avg(rouge1), 4) AS rouge1, round(avg(rouge2), 4) AS rouge2 FROM scored"
    q["mean_scores"] = f"""WITH {CHAT_ROUGE} SELECT 'replies' AS run, epoch, round(avg(rouge1), 6) AS rouge1, round(avg(rouge2), 6) AS rouge2
      FROM scored GROUP BY epoch"""
    q["scores_from_metrics"] = f"""WITH {LOG} SELECT 'log' AS run, epoch, """ + ", ".join(
        f"round(avg(value) FILTER (WHERE run = '{n}'), 6) AS {n}" for n in ("click", "purchase", "view")
    ) + " FROM log GROUP BY epoch"
    q["gen_len"] = f"WITH {CHATS} SELECT round(avg(len({toks('hypothesis')})), 4) AS gen_len FROM chats"
    q["embedding_score"] = f"""WITH {CHAT_TOKENS}, {EMBEDDED} SELECT * FROM embedded"""
    all_scored = f"""{CHAT_ROUGE}, longest AS ({q["rougeL"]}), vectors AS ({q["embedding_score"]}),
      alls AS (SELECT id, 'replies' AS run, epoch, round(rouge1, 6) AS rouge1, round(rouge2, 6) AS rouge2, "rougeL", "rougeL" AS "rougeLsum",
        emb_p, emb_r, emb_f1 FROM scored JOIN longest USING (id) JOIN vectors USING (id))"""
    names = ("rouge1", "rouge2", '"rougeL"', '"rougeLsum"', "emb_p", "emb_r", "emb_f1")
    q["scored_predictions"] = f"WITH {all_scored} SELECT * FROM alls"
    q["epoch_score_means"] = f"""WITH {all_scored} SELECT run, epoch, {', '.join(f'round(avg({n}), 6) AS {n}' for n in names)} FROM alls GROUP BY run, epoch"""
    metric_rows = " UNION ALL ".join(
        f"SELECT run, epoch, {lit(n.strip(chr(34)))} AS metric, round(avg({n}), 6) AS value FROM gens GROUP BY run, epoch" for n in (*names[:4], "gen_len"))
    gens = f"gens AS (SELECT alls.*, len({toks('hypothesis')})::DOUBLE AS gen_len FROM alls JOIN chats USING (id))"
    q["metric_log"] = f"WITH {all_scored}, {gens} {metric_rows}"
    q["full_run_summary"] = f"""WITH {all_scored}, {gens}, metrics AS ({metric_rows}),
      losses AS (SELECT day(ts)::BIGINT % 5 AS epoch, event_type, round(avg(value), 6) AS loss FROM events
        WHERE event_type IN ('click', 'view') GROUP BY ALL),
      best AS (SELECT epoch, loss FROM losses WHERE event_type = 'view' ORDER BY loss, epoch LIMIT 1)
      SELECT 'replies' AS run, best.epoch AS best_epoch, any_value(l.loss) AS best_train_loss, any_value(best.loss) AS best_val_loss,
        {', '.join(f'max(value) FILTER (WHERE metric = {lit(n)}) AS "test_{n}"' for n in ('rouge1', 'rouge2', 'rougeL', 'rougeLsum', 'gen_len'))}
      FROM best JOIN losses l ON l.epoch = best.epoch AND l.event_type = 'click' LEFT JOIN metrics m ON m.epoch = best.epoch GROUP BY best.epoch"""
    grid_rows = grid_sql("id, summary") + f" UNION ALL SELECT id, summary, 'full', '512', {head_sql(512)[0]}, 0 FROM toked"
    q["embedding_grid"] = f"""WITH {TOKED}, allrows AS ({grid_rows}),
      named AS (SELECT method || '/' || quantity || '/' || id AS id, method, quantity, {rtoks('summary')} AS r, {rtoks(lead)} AS h FROM allrows),
      sides AS (SELECT min(id) AS id, r, h FROM named GROUP BY r, h), {EMBEDDED},
      g AS (SELECT method, quantity, emb_f1 AS f FROM named JOIN sides USING (r, h) JOIN embedded ON embedded.id = sides.id),
      base AS (SELECT avg(f) AS full_text FROM g WHERE method = 'full'),
      means AS (SELECT method, quantity, avg(f) AS score FROM g WHERE method <> 'full' GROUP BY method, quantity)
      SELECT method, quantity, round(score, 6) AS score, round(full_text, 6) AS full_text, round(score - full_text, 6) AS delta FROM means, base"""
    q["split_counts"] = f"""WITH {PROFILE} SELECT split, count(*) AS n_rows,
      count(*) FILTER (WHERE doc_len BETWEEN 256 AND 512 AND sum_len <= 36) AS n_kept FROM profile GROUP BY split"""
    band = f"{PROFILE}, band AS (SELECT * FROM profile WHERE doc_len BETWEEN 256 AND 512 AND sum_len <= 36)"
    q["band_profile"] = " UNION ALL ".join(
        f"(WITH {band}, {hist('band', c, 10)} SELECT *, '{c}' AS measure FROM hist)" for c in ("doc_len", "sum_len")
    )
    q["length_summary"] = f"""WITH {PROFILE} SELECT coalesce(split, 'all') AS split, count(*) AS n_rows, round(avg(doc_len), 6) AS mean_len,
      min(doc_len) AS min_len, max(doc_len) AS max_len, round(count(*) FILTER (WHERE doc_len < 512) / count(*)::DOUBLE, 6) AS share_below
      FROM profile GROUP BY ROLLUP (split)"""
    q["union_lengths"] = f"WITH {PROFILE} SELECT id, doc_len FROM profile"
    q["length_hist"] = f"WITH {PROFILE}, {hist('profile', 'doc_len', 25)} SELECT * FROM hist"
    q["length_hist_ranged"] = f"WITH {PROFILE}, {hist('profile', 'doc_len', 100, low='any_value(0)', high='any_value(1000)')} SELECT * FROM hist"
    quant = "round(min({v}), 6) AS low, " + ", ".join(
        f"round(quantile_cont({{v}}, {p}), 6) AS {n}" for n, p in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))
    ) + ", round(max({v}), 6) AS high"
    q["score_quantiles"] = f"WITH {CHAT_SCORE} SELECT {quant.format(v='score')} FROM scores"
    q["score_quantiles_by_run"] = f"WITH {LOG} SELECT run, {quant.format(v='value')} FROM log GROUP BY run"
    q["quantile_tails"] = f"WITH {TAILS} SELECT * FROM tails"
    tl = f"{TAILS}, tl AS (SELECT tail, len({toks('hypothesis')}) AS length FROM tails JOIN chats USING (id))"
    q["tail_profile"] = f"""WITH {tl} SELECT tail, count(*) AS n_rows, round(avg(length), 6) AS mean_length,
      min(length)::BIGINT AS min_length, max(length)::BIGINT AS max_length FROM tl GROUP BY tail"""
    q["tail_length_hist"] = f"WITH {tl}, {hist('tl', 'length', 10, 'tail')} SELECT * FROM hist"

    q["loss_mean"] = f"WITH {LOSSES} SELECT * FROM losses"
    q["best_epoch"] = f"""WITH {LOSSES} SELECT run, epoch AS best_epoch, loss AS best_loss FROM losses
      QUALIFY row_number() OVER (PARTITION BY run ORDER BY loss, epoch) = 1"""
    q["last_epoch"] = f"WITH {LOG} SELECT run, max(epoch) AS last_epoch, max(epoch) + 1 AS resume_epoch FROM log GROUP BY run"
    q["improvements"] = f"""WITH {LOSSES} SELECT * FROM losses a WHERE NOT EXISTS
      (SELECT 1 FROM losses b WHERE b.run = a.run AND b.epoch < a.epoch AND b.loss <= a.loss)"""
    q["strategy_last"] = f"""WITH {LOSSES} SELECT run, loss AS score FROM losses
      QUALIFY row_number() OVER (PARTITION BY run ORDER BY epoch DESC) = 1"""
    q["strategy_best"] = f"WITH {LOSSES} SELECT run, max(loss) AS score FROM losses GROUP BY run"
    q["strategy_grid"] = f"""{all_rows()}, sides AS (SELECT method || '/' || quantity || '/' || a.id AS id, method, quantity,
        {rtoks('p.summary')} AS r, {rtoks(joined('(' + toks('shortened_document') + ')[1:36]'))} AS h FROM allrows a JOIN pairs p USING (id)),
      {rouge_cte('one', 1, 'sides')}, g AS (SELECT method, quantity, f FROM one JOIN sides USING (id)),
      base AS (SELECT avg(f) AS full_text FROM g WHERE method = 'full'),
      means AS (SELECT method, quantity, avg(f) AS score FROM g WHERE method <> 'full' GROUP BY method, quantity)
      SELECT method, quantity, round(score, 6) AS score, round(full_text, 6) AS full_text, round(score - full_text, 6) AS delta FROM means, base"""
    q["epoch_curve"] = f"WITH {LOG} SELECT run, epoch, round(avg(value), 6) AS score, count(*) AS n_rows FROM log GROUP BY run, epoch"
    q["sample_trajectory"] = f"""WITH {LOG}, pe AS (SELECT run, sample, epoch, avg(value) AS score FROM log GROUP BY ALL)
      SELECT run, sample, string_agg(epoch::VARCHAR, ' ' ORDER BY epoch) AS epochs, round(arg_min(score, epoch), 6) AS first_score,
      round(avg(score), 9) AS mean_score, count(*) AS n_epochs FROM pe GROUP BY run, sample"""
    q["epoch_score_rows"] = f"""WITH {LOG} SELECT *, row_number() OVER (PARTITION BY run, epoch ORDER BY sample, event_id) AS place FROM log"""
    q["score_hist"] = f"WITH {LOG}, {hist('log', 'value', 10, 'run')} SELECT * FROM hist"

    norm = f"{COUNTS}, tfn AS (SELECT id, term, tf / sqrt(sum(tf * tf) OVER (PARTITION BY id)) AS weight FROM counts)"
    q["topk_terms"] = f"""WITH {norm}, means AS (SELECT term, round(sum(weight) / {N_DOCS}, 9) AS s FROM tfn GROUP BY term)
      SELECT term, round(s, 6) AS score, row_number() OVER (ORDER BY s DESC, term) AS rank FROM means ORDER BY s DESC, term LIMIT 500"""
    lang_terms = f"{COUNTS}, lt AS (SELECT lang AS topic, term, count(*) AS weight FROM counts GROUP BY ALL)"
    top = "SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS rank FROM lt QUALIFY rank <= {n}"
    q["topk_per_topic"] = f"WITH {lang_terms} {top.format(n=15)}"
    q["topk_sentences"] = f"""WITH {PAIRS}, {lsa_sql('pairs')}, best AS (SELECT * FROM ranks JOIN lines USING (id, pos)
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) <= 3)
      SELECT id, count(*) AS n_kept, string_agg(sentence, ' ' ORDER BY pos) AS shortened_document FROM best GROUP BY id"""
    q["term_counts"] = f"WITH {COUNTS} SELECT id, term, tf FROM counts"
    q["doc2bow"] = f"""WITH {COUNTS}, d AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS word_id FROM counts GROUP BY term)
      SELECT id, word_id, tf FROM counts JOIN d USING (term)"""
    q["tf_norm"] = f"WITH {norm} SELECT id, term, round(weight, 6) AS weight FROM tfn"
    q["tfidf"] = f"WITH {COUNTS}, {tfidf_cte('wts', 'counts', N_DOCS)} SELECT id, term, round(weight, 6) AS weight FROM wts"
    q["tfidf_max_features"] = f"""WITH {COUNTS}, top AS (SELECT term FROM counts GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 500),
      few AS (SELECT id, term, tf FROM counts WHERE term IN (SELECT term FROM top)),
      {tfidf_cte('wts', 'few', N_DOCS)} SELECT id, term, round(weight, 6) AS weight FROM wts"""
    q["mask_list"] = f"WITH {mask} SELECT term, round(score, 6) AS score, rank FROM mask"
    q["tag_buckets"] = f"""WITH {TEXTS}, v AS (SELECT DISTINCT unnest({found('lower(document)', K.TERM)}) AS term FROM texts),
      t AS (SELECT ['NNS', 'VBD', 'JJ', 'RBR', 'CD', 'XX', 'DT'][length(term) % 7 + 1] AS tag FROM v)
      SELECT CASE WHEN contains(tag, 'NN') THEN 'nouns' WHEN contains(tag, 'VB') THEN 'verbs' WHEN contains(tag, 'JJ') THEN 'adjs'
        WHEN contains(tag, 'RB') THEN 'advs' WHEN contains(tag, 'CD') THEN 'cardinals' ELSE 'others' END AS bucket, count(*) AS n_words
      FROM t GROUP BY bucket"""
    q["tail_terms"] = f"""WITH {TAILS}, chosen AS (SELECT DISTINCT id FROM tails),
      trows AS (SELECT id, unnest({terms('hypothesis')}) AS term FROM chats JOIN chosen USING (id)),
      counts AS (SELECT id, term, count(*) AS tf FROM trows GROUP BY id, term), {tfidf_cte('wts', 'counts', '(SELECT count(*) FROM chosen)')},
      sums AS (SELECT tail, term, round(sum(weight) / any_value(n), 9) AS w FROM wts JOIN tails USING (id)
        JOIN (SELECT tail, count(*) AS n FROM tails GROUP BY tail) z USING (tail) GROUP BY tail, term)
      SELECT tail, term, round(w, 6) AS weight, row_number() OVER (PARTITION BY tail ORDER BY w DESC, term) AS rank FROM sums QUALIFY rank <= 20"""
    q["topic_coherence"] = f"""WITH {lang_terms}, tops AS ({top.format(n=10)}),
      couples AS (SELECT a.topic, a.term AS a, b.term AS b FROM tops a JOIN tops b ON a.topic = b.topic AND a.term < b.term),
      single AS (SELECT term, count(*) AS n FROM counts GROUP BY term),
      both_n AS (SELECT c.topic, c.a, c.b, count(*) AS n FROM couples c JOIN counts x ON x.term = c.a JOIN counts y ON y.id = x.id AND y.term = c.b GROUP BY ALL),
      scored AS (SELECT c.topic, CASE WHEN z.n IS NULL THEN -1 WHEN z.n = {N_DOCS} THEN 1
        ELSE ln((z.n / {N_DOCS}::DOUBLE) / ((x.n / {N_DOCS}::DOUBLE) * (y.n / {N_DOCS}::DOUBLE))) / -ln(z.n / {N_DOCS}::DOUBLE) END AS m
        FROM couples c JOIN single x ON x.term = c.a JOIN single y ON y.term = c.b LEFT JOIN both_n z ON z.topic = c.topic AND z.a = c.a AND z.b = c.b)
      SELECT topic, round(avg(m), 6) AS coherence, count(*) AS n_pairs FROM scored GROUP BY topic"""

    q["topic_coherence_cv"] = f"""WITH {lang_terms}, tops AS ({top.format(n=10)}),
      lists AS (SELECT id, {terms('document')} AS ts FROM texts),
      total AS (SELECT sum(greatest(len(ts) - 109, 1)) AS n FROM lists WHERE len(ts) > 0),
      occ AS (SELECT id, len(ts) AS size, unnest(ts) AS term, generate_subscripts(ts, 1) - 1 AS p FROM lists),
      win AS (SELECT DISTINCT id, term, unnest(range(greatest(p - 109, 0), least(p, greatest(size - 110, 0)) + 1)) AS w
        FROM occ WHERE term IN (SELECT term FROM tops)),
      couples AS (SELECT a.topic, a.term, b.term AS other FROM tops a JOIN tops b ON a.topic = b.topic),
      kinds AS (SELECT DISTINCT least(term, other) AS a, greatest(term, other) AS b FROM couples),
      held AS (SELECT a, b, count(*) AS n FROM kinds JOIN win x ON x.term = a JOIN win y ON y.term = b AND y.id = x.id AND y.w = x.w GROUP BY a, b),
      single AS (SELECT a AS term, n FROM held WHERE a = b),
      vec AS (SELECT c.topic, c.term, c.other, CASE WHEN h.n = t.n THEN 1.0 ELSE
        ln((coalesce(h.n, 0)::DOUBLE / t.n + 1e-12) / ((x.n::DOUBLE / t.n) * (y.n::DOUBLE / t.n))) / -ln(coalesce(h.n, 0)::DOUBLE / t.n + 1e-12) END AS v
        FROM couples c CROSS JOIN total t JOIN single x ON x.term = c.term JOIN single y ON y.term = c.other
        LEFT JOIN held h ON h.a = least(c.term, c.other) AND h.b = greatest(c.term, c.other)),
      whole AS (SELECT topic, other, sum(v) AS s FROM vec GROUP BY topic, other),
      cosine AS (SELECT topic, term, sum(v * s) / sqrt(sum(v * v) * sum(s * s)) AS c FROM vec JOIN whole USING (topic, other) GROUP BY topic, term)
      SELECT topic, round(avg(c), 6) AS coherence, count(*) AS n_words FROM cosine GROUP BY topic"""

    q["extract_headlines"] = f"WITH {elements('h1')} SELECT * FROM items"
    q["extract_paragraphs"] = f"WITH {elements('p')} SELECT * FROM items"
    q["extract_timestamps"] = f"WITH {elements('div', 'ad', 'stamp')} SELECT * FROM items"
    q["clean_headline"] = f"WITH {kept} SELECT * FROM kept"
    q["clean_timestamp"] = f"""WITH {STAMPS} SELECT event_id, replace(replace(replace(replace(replace(replace(stamp,
      'ET', ''), 'at', ''), 'p.m.', ''), 'a.m.', ''), ',', ''), '.', '') AS stamp FROM stamps"""
    q["parse_timestamp"] = "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS ts FROM events"
    q["parse_timestamp_faithful"] = """SELECT event_id, strftime(CASE WHEN hour(ts) >= 12 THEN ts - INTERVAL 12 HOUR ELSE ts END,
      '%Y-%m-%d %H:%M') AS ts FROM events"""

    q["stream_shorten"] = short(headtail_sql(373, 2))
    q["stream_ranked"] = ranked(luhn_sql, {"25": 373}, extra="SELECT id, shortened_document, shortened_len FROM cut")
    q["stream_metrics"] = f"WITH {LOG} SELECT run, epoch, round(avg(value), 6) AS mean_value, count(*) AS n_rows FROM log GROUP BY run, epoch"

    q["stream_windows"] = """SELECT event_type AS run, strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start,
      round(avg(value), 6) AS mean_value, count(*) AS n_rows FROM events
      WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY ALL"""

    q["stream_windows_all"] = """SELECT event_type AS run, strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start,
      round(avg(value), 6) AS mean_value, count(*) AS n_rows,
      date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) AS closed FROM events
      GROUP BY event_type, date_trunc('day', ts)"""

    banded = f"{band}, toked AS (SELECT *, {toks('document')} AS t FROM band)"
    q["flagship"] = f"""{all_rows('band', banded)}, sides AS (SELECT method || '/' || quantity || '/' || a.id AS id, method, quantity, {rtoks('p.summary')} AS r,
        {rtoks(joined('(' + toks('shortened_document') + ')[1:36]'))} AS h FROM allrows a JOIN band p USING (id) WHERE quantity IN ({", ".join(f"'{n}'" for n in BUDGETS)})),
      {rouge_cte('one', 1, 'sides')}, {rouge_cte('two', 2, 'sides')}
      SELECT method, quantity, count(*) AS n_rows, round(avg(one.f), 6) AS rouge1, round(avg(two.f), 6) AS rouge2
      FROM sides JOIN one USING (id) JOIN two USING (id) GROUP BY method, quantity"""
    return q
