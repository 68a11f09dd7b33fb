"""The operators applied to the test tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casario.llm import chat, decontaminate, infill, lines, mixing, neardup, phrases, privacy, rules, sharding, substrings, toxicity, urls
from casario.llm.frames import table
from casario.session import configure

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    configure(spark)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    labels = table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("label")).where(~held_out)
    score = F.col("__llm_score")
    return toxicity.score(docs, *toxicity.learn(docs, labels)).select(
        "doc_id", held_out.alias("held_out"), score.alias("score"), (score >= 0.7).cast("int").alias("predicted")
    )


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    configure(spark)
    judged = rules.quality(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels"))
    return judged.select(f"{rules.ROW}.doc_id", *rules.BASE, "base_failed", "kept", "rule")


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    configure(spark)
    cut = substrings.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    length, left = F.octet_length(F.coalesce("text", F.lit(""))).cast("long"), F.octet_length("__llm_kept").cast("long")
    return cut.select(
        "doc_id", length.alias("n_bytes"), (length - left).alias("n_removed"),
        F.size("__llm_spans").cast("long").alias("n_spans"), F.sha2("__llm_kept", 256).alias("kept_sha256"),
        F.col("__llm_shared").alias("n_shared"), (F.col("__llm_shared") > 0).alias("shares_passage"),
    )


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    configure(spark)
    kept = lines.drop_shared_lines(table(spark, folder, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return kept.select(
        "doc_id", F.col("__llm_lines").alias("n_lines"), F.col("__llm_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


OP4_SQL = r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
keyed AS (
  SELECT doc_id, lines, list_transform(lines, lambda x: translate(
    trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS keys FROM split),
lined AS (
  SELECT doc_id, unnest(lines) AS line, unnest(keys) AS key, generate_subscripts(keys, 1) AS pos FROM keyed),
shared AS (SELECT key FROM lined WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(s.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE s.key IS NULL), '')) AS kept_sha256
FROM lined l LEFT JOIN shared s ON l.key = s.key GROUP BY doc_id"""


def op5_private_terms(spark: SparkSession, folder: str) -> DataFrame:
    configure(spark)
    found = privacy.private_spans(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", *(F.col(f"n_{kind}") for kind in privacy.KINDS), "base_sha256",
        privacy.written(F.concat("spans", "term_spans")).alias("spans"),
    )


def op6_temperature_mix(spark: SparkSession, folder: str) -> DataFrame:
    configure(spark)
    mixed = mixing.mix(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "source", "n_tokens", F.round("weight", 6).alias("weight"), "epoch", "block", "place")


OP6_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, coalesce('=' || source, '-') AS s,
         len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n,
         CAST('0x' || substr(md5('doc|' || coalesce(CAST(doc_id AS VARCHAR), '-')), 1, 13) AS BIGINT) AS spot
  FROM documents),
totals AS (SELECT s, sum(n) AS tokens FROM docs GROUP BY s HAVING sum(n) > 0),
sources AS (SELECT s, tokens, tokens / (sum(tokens) OVER ()) AS p, sum(tokens) OVER () AS total, count(*) OVER () AS k FROM totals),
-- one bisection for the entropy, one for the repetition limit
bounds(step, lo, hi, mid) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE, 0.5::DOUBLE
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END, CASE WHEN ok THEN (mid + hi) / 2 ELSE (lo + mid) / 2 END
  FROM (SELECT b.*, (SELECT ln(sum(exp(b.mid * ln(p)))) - sum(exp(b.mid * ln(p)) * b.mid * ln(p)) / sum(exp(b.mid * ln(p)))
                            >= 0.97 * ln(max(k)) - 1e-12 FROM sources) AS ok FROM bounds b WHERE step < 40)),
limits(step, lo, hi, mid) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE, 0.5::DOUBLE
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END, CASE WHEN ok THEN (mid + hi) / 2 ELSE (lo + mid) / 2 END
  FROM (SELECT b.*, (SELECT max(exp(b.mid * ln(p)) / p) / sum(exp(b.mid * ln(p))) > 4 + 1e-12 FROM sources) AS ok FROM limits b WHERE step < 40)),
even AS (SELECT -sum(p * ln(p)) >= 0.97 * ln(max(k)) - 1e-12 AS at_one, max(1 / p) / max(k) > 4 + 1e-12 AS over_at_zero FROM sources),
power AS (
  SELECT round(greatest(CASE WHEN at_one THEN 1 ELSE (SELECT lo FROM bounds WHERE step = 40) END,
                        CASE WHEN over_at_zero THEN (SELECT hi FROM limits WHERE step = 40) ELSE 0 END), 6) AS a FROM even),
weighted AS (
  SELECT s, tokens, total, exp(a * ln(p)) / sum(exp(a * ln(p))) OVER () AS weight, CAST(least(256, ceil(tokens / 20000)) AS BIGINT) AS blocks
  FROM sources, power),
budgets AS (SELECT *, CAST(floor(weight * total) AS BIGINT) AS budget FROM weighted),
placed AS (
  SELECT doc_id, source, n, spot, d.s, weight, blocks, spot % blocks AS block, budget // tokens AS passes, budget % tokens AS rest
  FROM docs d JOIN budgets b ON d.s = b.s),
sized AS (SELECT s, block, any_value(rest) AS rest, sum(n) AS size FROM placed GROUP BY s, block),
permuted AS (
  SELECT s, block, size, row_number() OVER w AS place, rest - coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining
  FROM (SELECT *, md5('block|' || s || '|' || CAST(block AS VARCHAR)) AS h FROM sized)
  WINDOW w AS (PARTITION BY s ORDER BY substr(h, 1, 13), block)),
ordered AS (
  SELECT p.*, place, remaining, size,
         coalesce(sum(n) OVER (PARTITION BY p.s, p.block ORDER BY spot, doc_id, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM placed p JOIN permuted q ON p.s = q.s AND p.block = q.block),
taken AS (SELECT *, passes + CASE WHEN remaining > 0 AND (remaining >= size OR before < remaining) THEN 1 ELSE 0 END AS times FROM ordered)
SELECT doc_id, source, CAST(n AS BIGINT) AS n_tokens, round(weight, 6) AS weight, CAST(unnest(range(1, CAST(times AS BIGINT) + 1)) AS BIGINT) AS epoch,
       CAST(block AS INTEGER) AS block, CAST(place AS INTEGER) AS place
FROM taken WHERE times > 0"""


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    configure(spark)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = F.col("__llm_found")
    return decontaminate.matches(docs, table(spark, folder, "benchmark")).select(
        "doc_id", found["n_words"].alias("n_words"), decontaminate.hit_words(found["spans"]).alias("n_hit"),
        F.size(found["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(found["items"], ","), 256).alias("items_sha256"),
        (F.size(found["spans"]) > 0).alias("contaminated"),
    )


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT *, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM bs),
ds AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM ds),
hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
words AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits),
covered AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""


def op8_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    configure(spark)
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    says = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(
        F.lit(-1).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), says
    )
    return chat.chat_digests(chat.format_chats(turns.union(extra)))


OP8_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
given AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM turns),
sized AS (
  SELECT *, length('<|im_start|>') + length(role) + 1 + length(text) + length('<|im_end|>') + 1 + len(regexp_extract_all(text,
    '<\\*(\|im_start\||\|im_end\||\|endoftext\||s|/s|<SYS>|</SYS>)>|\[\\*(INST|/INST)\]')) AS n FROM given)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""


def list_log(spark: SparkSession, folder: str) -> DataFrame:
    """Dated list entries: each event concerns the page of its user; its type says what happens to which pattern."""
    pages, events = table(spark, folder, "pages"), table(spark, folder, "events")
    kind, host = F.col("event_type"), urls.host_of(F.col("url"))
    section = F.element_at(F.split(urls.path_of(F.col("url")), "/"), 1)
    return events.join(pages.select("page_id", "url"), F.col("user_id") == F.col("page_id")).select(
        F.when(kind.isin("error", "signup"), host).otherwise(F.concat_ws("/", host, section)).alias("pattern"),
        F.when(kind.isin("error", "purchase"), "add").when(kind.isin("signup", "click"), "remove").alias("action"),
        F.col("ts").cast("timestamp").alias("at"),
    )


def op9_url_lists(spark: SparkSession, folder: str) -> DataFrame:
    configure(spark)
    seconds = (F.col("page_id") * 7919) % (30 * 86400)
    captures = table(spark, folder, "pages").select(
        "page_id", "url", F.timestamp_seconds(F.lit(1704067200) + seconds).alias("fetched_at")
    )
    written = "yyyy-MM-dd HH:mm:ss"
    return urls.blocked_captures(captures, list_log(spark, folder)).withColumns({
        "fetched_at": F.date_format("fetched_at", written), "listed_since": F.date_format("listed_since", written)
    })


OP9_SQL = r"""
WITH parsed AS (
  SELECT page_id, url,
         regexp_replace(lower(regexp_extract(url, '(?i)^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.$', '') AS host,
         regexp_replace(regexp_replace(regexp_extract(url, '(?i)^\s*[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+', '/', 'g'), '^/|/$', '', 'g') AS path,
         TIMESTAMP '2024-01-01' + to_seconds(CAST((page_id * 7919) % (30 * 86400) AS BIGINT)) AS fetched_at
  FROM pages),
log AS (
  SELECT CASE WHEN event_type IN ('error', 'signup') THEN host ELSE host || '/' || split_part(path, '/', 1) END AS pattern,
         event_type IN ('error', 'purchase') AS listed, ts AS ts
  FROM events JOIN parsed ON user_id = page_id WHERE event_type IN ('error', 'signup', 'purchase', 'click')),
acts AS (SELECT pattern, ts, bool_or(listed) AS listed FROM log GROUP BY pattern, ts),
starts AS (
  SELECT pattern, listed, ts, lag(listed, 1, false) OVER (PARTITION BY pattern ORDER BY ts) AS before FROM acts),
runs AS (
  SELECT pattern, ts AS valid_from, lead(ts) OVER (PARTITION BY pattern ORDER BY ts) AS valid_to, listed
  FROM starts WHERE listed <> before),
keyed AS (
  SELECT DISTINCT page_id, unnest(list_concat(
    list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
    CASE WHEN path = '' THEN [] ELSE list_transform(range(1, len(string_split(path, '/')) + 1),
      lambda n: host || '/' || array_to_string(string_split(path, '/')[1:n], '/')) END)) AS pattern
  FROM parsed WHERE host <> ''),
hits AS (
  SELECT p.page_id, k.pattern, r.valid_from
  FROM parsed p JOIN keyed k USING (page_id) JOIN runs r ON r.pattern = k.pattern
  WHERE r.listed AND p.fetched_at >= r.valid_from AND (r.valid_to IS NULL OR p.fetched_at < r.valid_to)),
best AS (
  SELECT page_id, count(*) AS n_matches,
         max(struct_pack(l := length(pattern), p := pattern, f := valid_from)) AS b
  FROM hits GROUP BY page_id)
SELECT page_id, url, strftime(fetched_at, '%Y-%m-%d %H:%M:%S') AS fetched_at, n_matches IS NOT NULL AS blocked,
       coalesce(n_matches, 0) AS n_matches, b.p AS pattern, strftime(b.f, '%Y-%m-%d %H:%M:%S') AS listed_since
FROM parsed LEFT JOIN best USING (page_id)"""
def op10_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    configure(spark)
    found = neardup.named_classes(neardup.near_duplicates(table(spark, folder, "documents").select("doc_id", "text")))
    return found.select(
        "doc_id", F.col("class_first.doc_id").alias("class_id"), F.col("copies").alias("n_copies"), F.col("links").alias("n_links")
    )


OP10_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM split WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS same FROM grams GROUP BY doc_id),
copies AS (SELECT doc_id, count(*) OVER (PARTITION BY same) AS n_copies FROM sizes),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 10 * c >= 8 * (a.n + b.n - c)),
counted AS (SELECT x AS doc_id, count(*) AS n_links FROM links GROUP BY x),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
classes AS (SELECT x AS doc_id, min(y) AS least FROM reach GROUP BY x)
SELECT doc_id, least(doc_id, coalesce(classes.least, doc_id)) AS class_id, coalesce(n_copies, 1) AS n_copies, coalesce(n_links, 0) AS n_links
FROM split LEFT JOIN copies USING (doc_id) LEFT JOIN counted USING (doc_id) LEFT JOIN classes USING (doc_id)"""


def op11_sharding(spark: SparkSession, folder: str) -> DataFrame:
    configure(spark)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    sharded = sharding.with_shard(docs, sharding.plan(docs, 16)).select(
        "doc_id", F.col(sharding.SIZE).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), sharding.SHARD
    )
    return sharding.with_slot(sharded).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col(sharding.SHARD).alias("shard"),
        F.col(sharding.SLOT).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op12_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    configure(spark)
    docs = table(spark, folder, "documents").select("lang", "text")
    return phrases.collocations(docs, min_count=100, most_words=5, top=2000)


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
spoken AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM spoken GROUP BY lang),
grams AS (
  SELECT lang, k, w[i:i + k - 1] AS g, CAST(count(*) AS HUGEINT) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM spoken, range(1, 6) sizes(k) WHERE len(w) >= k)
  GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT c.lang, c.g, c.k, c.f AS a, n, j, x.f AS l, y.f AS r, (1000 * c.f * n) // (x.f * y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM grams WHERE k > 1) c JOIN totals USING (lang)
  JOIN grams x ON x.lang = c.lang AND x.g = c.g[1:j] JOIN grams y ON y.lang = c.lang AND y.g = c.g[j + 1:]),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
inner_parts AS (
  SELECT DISTINCT lang, g[i:i + s - 1] AS g, f FROM (
    SELECT lang, g, f, k, s, unnest(range(1, k - s + 2)) AS i FROM grams, range(2, 5) shorter(s) WHERE s < k)),
held AS (SELECT lang, g, max(f) AS longer FROM inner_parts GROUP BY lang, g)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase,
       CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM lowest LEFT JOIN held USING (lang, g) WHERE longer IS NULL OR 100 * longer < 100 * a QUALIFY rank <= 2000"""


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    configure(spark)
    cut = infill.fill_in_middle(table(spark, folder, "documents").select("doc_id", "text"))
    output, form = F.col("__llm_output"), F.col("__llm_form")
    return cut.select(
        "doc_id", F.col("__llm_tokens").alias("n"), form.alias("form"),
        F.col("__llm_prefix").alias("prefix_chars"), F.col("__llm_middle").alias("middle_chars"),
        F.sha2(output, 256).alias("output_sha256"), F.sha2(infill.restored(output, form), 256).alias("restored_sha256"),
    )


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (
  SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS x, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS y,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (
  SELECT doc_id, n, form, t, array_to_string(w[1:x], '') AS a, array_to_string(w[x + 1:y], '') AS m, array_to_string(w[y + 1:], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form <> 'plain' THEN length(a) END AS BIGINT) AS prefix_chars,
       CAST(CASE WHEN form <> 'plain' THEN length(m) END AS BIGINT) AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || a || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p"""


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality_rules": op2_quality_rules,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_private_terms": op5_private_terms,
    "op6_temperature_mix": op6_temperature_mix,
    "op7_decontamination": op7_decontamination,
    "op8_chat_format": op8_chat_format,
    "op9_url_lists": op9_url_lists,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_sharding": op11_sharding,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_fill_in_middle": op13_fill_in_middle,
}
SQL: dict[str, str] = {
    "op4_line_dedup": OP4_SQL, "op6_temperature_mix": OP6_SQL, "op7_decontamination": OP7_SQL, "op8_chat_format": OP8_SQL, "op9_url_lists": OP9_SQL,
    "op10_ngram_jaccard": OP10_SQL, "op12_phrase_collocations": OP12_SQL, "op13_fill_in_middle": OP13_SQL,
}
