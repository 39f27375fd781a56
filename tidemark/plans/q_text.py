"""News text, relevance, sentiment and topics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions.maths import rounded
from tidemark.operators import news as N
from tidemark.operators import sentiment as SE
from tidemark.operators import topics as TP
from tidemark.plans import testbed as T
from tidemark.registry import query, view


def ascii_articles(spark, sf):
    """Articles with letters folded to ASCII, so both engines' word boundaries agree; whole texts."""
    d = T.table(spark, sf, "documents")
    a = T.articles(spark, sf).withColumn("doc_id", F.regexp_extract("url", r"(\d+)$", 1).cast("bigint"))
    text = F.regexp_replace("content", r"[^\x00-\x7F]", "e")
    head = F.concat(F.lit("About S"), F.col("doc_id") % 50, F.lit(". News: "), F.substring_index(text, "\n", 1))
    return a.select("doc_id", "id", head.alias("headline"), "summary", text.alias("content"), "source", "url", "published_at", F.to_date("published_at").alias("date"), "symbols")


view("v_ascii", """
SELECT doc_id, id, url, source, published_at, CAST(published_at AS DATE) AS date, sym_a, sym_b, coalesce(id, url) AS article_id,
       trim(regexp_replace('About S' || (doc_id % 50) || '. News: ' || split_part(t, chr(10), 1), '^\\s+|\\s+$', '', 'g')) AS headline, t AS content
FROM (SELECT *, regexp_replace(content, '[^\\x00-\\x7F]', 'e', 'g') AS t FROM v_articles)""")


def universe(spark, sf):
    days = T.articles(spark, sf).select(F.to_date("published_at").alias("date")).distinct()
    k = days.select("date", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("k"))
    return k.where((F.col("k") + F.dayofmonth("date")) % 3 != 0).select("date", F.concat(F.lit("S"), F.col("k")).alias("ticker"))


def _split(expr):
    return f"list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace({expr}, '\\s+', ' ', 'g')), '([.!?]) ([\"''A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) >= 2)"


view("v_raw_sentences", f"""
SELECT doc_id, 'headline' AS f, unnest(l) AS text, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS o, 0 AS base FROM (SELECT doc_id, {_split('headline')} AS l FROM v_articles)
UNION ALL SELECT doc_id, 'content', unnest(l), CAST(generate_subscripts(l, 1) - 1 AS INTEGER), b FROM (SELECT doc_id, {_split('content')} AS l, len({_split('headline')}) AS b FROM v_articles)""")


@query("t1_sentence_chunks", "SELECT 'https://example.com/' || doc_id AS url, f AS source_text_field, o AS source_text_order, CAST(base + o AS INTEGER) AS chunk_index, text FROM v_raw_sentences")
def t1(spark, sf):
    return N.with_chunks(T.articles(spark, sf)).select("url", "source_text_field", "source_text_order", "chunk_index", "text")


view("v_sentences", f"""
SELECT doc_id, unnest(l) AS text, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS chunk_index FROM (
SELECT doc_id, list_concat({_split('headline')}, {_split('content')}) AS l FROM v_ascii)""")
TOK = "'\\b[A-Z][A-Z0-9.-]{0,6}\\b'"
view("v_allowed", """
SELECT date, 'S' || k AS ticker FROM (SELECT DISTINCT date FROM v_ascii), (SELECT unnest(generate_series(0, 99)) AS k) WHERE (k + day(date)) % 3 <> 0""")
view("v_article_tickers", f"""
SELECT doc_id, list_sort(list(DISTINCT ticker)) AS tickers, list(DISTINCT ticker) FILTER (tok) AS known FROM (
 SELECT doc_id, date, sym_a AS ticker, false AS tok FROM v_ascii UNION ALL SELECT doc_id, date, sym_b, false FROM v_ascii
 UNION ALL SELECT doc_id, date, replace(unnest(regexp_extract_all(headline || ' ' || content, {TOK})), '.', '-'), true FROM v_ascii) JOIN v_allowed USING (date, ticker) GROUP BY doc_id""")
view("v_pre", f"""
SELECT a.doc_id, a.date, a.article_id, a.headline, s.text, s.chunk_index, t.tickers, a.published_at, a.url,
       list_filter(list_transform(regexp_extract_all(s.text, {TOK}), lambda x: replace(x, '.', '-')), lambda x: list_contains(coalesce(t.known, []), x)) AS inline
FROM v_sentences s JOIN v_ascii a USING (doc_id) JOIN v_article_tickers t USING (doc_id)""")
view("v_pre_rows", "SELECT *, unnest(tickers) AS ticker FROM v_pre")


@query("t2_preprocess", """
SELECT date, ticker, article_id, chunk_index, text, array_to_string(list_sort(list_distinct(list_concat([ticker], tickers, inline))), ';') AS ticker_mentions, array_to_string(tickers, ';') AS article_tickers FROM v_pre_rows""")
def t2(spark, sf):
    r = N.preprocess(ascii_articles(spark, sf), universe(spark, sf))
    return r.select("date", "ticker", "article_id", "chunk_index", "text", F.array_join(F.array_sort("ticker_mentions"), ";").alias("ticker_mentions"), F.array_join("provenance.article_tickers", ";").alias("article_tickers"))


@query("t3_ticker_mentions", "SELECT article_id, chunk_index, array_to_string(list_sort(list_distinct(list_concat(tickers, inline))), ';') AS mentions, len(list_distinct(inline))::INTEGER AS inline FROM v_pre")
def t3(spark, sf):
    a = ascii_articles(spark, sf).withColumn("article_id", X.article_identity())
    t = N.article_tickers(a, universe(spark, sf))
    rows = N.with_chunks(a).join(t, "article_id")
    inline = N.ticker_mentions(F.col("text"), F.array().cast("array<string>"), F.col("known_tokens"))
    m = N.ticker_mentions(F.col("text"), F.col("article_tickers"), F.col("known_tokens"))
    return rows.select("article_id", "chunk_index", F.array_join(F.array_sort(m), ";").alias("mentions"), F.size(inline).alias("inline"))


STOPS = ", ".join(f"'{w}'" for w in N.ENTITY_STOP_WORDS)
ALIAS_TEST = [("they are", "They"), ("ofan", "Ofan"), ("the of", "Phrase"), ("than", "Than"), ("erst", "Erst")]


@query("t4_entity_mentions", f"""
SELECT article_id, chunk_index, array_to_string(list_sort(CASE WHEN len(named) > 0 THEN named ELSE list_distinct(list_filter(phrases, lambda p: NOT list_has_all([{STOPS}], string_split(lower(regexp_replace(p, '\\s+', ' ', 'g')), ' ')))) END), ';') AS entities
FROM (SELECT article_id, chunk_index, list_filter([{", ".join(f"CASE WHEN {('contains(low, ' + chr(39) + a + chr(39) + ')') if ' ' in a else ('regexp_matches(low, ' + chr(39) + chr(92) + 'b' + a + chr(92) + 'b' + chr(39) + ')')} THEN '{e}' END" for a, e in ALIAS_TEST)}], lambda x: x IS NOT NULL) AS named,
      regexp_extract_all(c, '\\b(?:[A-Z][a-z0-9&]+(?:\\s+[A-Z][a-z0-9&]+){{0,3}}|[A-Z]{{2,}}(?:\\s+[A-Z]{{2,}})*)\\b') AS phrases
 FROM (SELECT article_id, chunk_index, headline || ' ' || text AS c, lower(headline || ' ' || text) AS low FROM v_pre))""")
def t4(spark, sf):
    r = N.preprocess(ascii_articles(spark, sf), universe(spark, sf), aliases=ALIAS_TEST)
    return r.select("article_id", "chunk_index", F.array_join(F.array_sort("entity_mentions"), ";").alias("entities")).distinct()


@query("t5_normalized_headline", "SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), '\\s+', ' ', 'g')) AS normalized_headline FROM documents")
def t5(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", X.normalize_headline("text").alias("normalized_headline"))


@query("t6_article_identity", """
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'd' || doc_id WHEN 1 THEN 'u' || doc_id ELSE 'news-' || substring(sha256(trim(regexp_replace(source, '^\\s+|\\s+$', '', 'g')) || '|' || '|' || regexp_replace(text, '^\\s+|\\s+$', '', 'g')), 1, 16) END AS article_id FROM documents""")
def t6(spark, sf):
    d = T.table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" d"), F.col("doc_id"))).otherwise(" ").alias("id"), F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("u"), F.col("doc_id"))).alias("url"),
        F.col("source").alias("headline"), F.lit(None).cast("string").alias("summary"), F.col("text").alias("content"))
    return d.select("doc_id", X.article_identity().alias("article_id"))


# ---- relevance gate -----------------------------------------------------------------

NAMES = {"S1": ["than", "that the"], "S2": ["thing"], "S3": ["erst"], "SPY": ["the"]}
FIN = ["of", "and", "in the", "heon", "on"]
BROAD = ["there", "this", "re", "an the"]
VOCABULARY = N.Vocabulary(NAMES, FIN, BROAD)


def _gate_inputs(spark, sf):
    rows = N.preprocess(ascii_articles(spark, sf), universe(spark, sf), aliases=ALIAS_TEST, vocabulary=VOCABULARY)
    a = ascii_articles(spark, sf).withColumn("article_id", X.article_identity())
    keys = N.article_tickers(a, universe(spark, sf)).join(a.select("article_id", "date"), "article_id").select("date", F.explode("article_tickers").alias("ticker"), "article_id")
    h = F.length("article_id") + F.length("ticker") * 3 + F.dayofmonth("date")
    topics = keys.where(h % 5 != 0).select("date", F.lower("ticker").alias("ticker"), "article_id", F.when(h % 5 == 1, -1).when(h % 7 == 2, F.lit(None)).otherwise(h % 5).cast("int").alias("topic_id"),
                                           F.when(h % 11 == 3, F.lit(None)).otherwise((h % 10) / F.lit(10.0)).alias("topic_probability"))
    emb = a.where(F.dayofmonth("date") % 2 == 0).select("date", "article_id", F.lit("k").alias("embedding_cache_key"))
    return rows, topics, emb


def _m(p):
    return f"contains(' ' || txt || ' ', ' {p} ')" if " " in p else f"list_contains(tok, '{p}')"


def _lst(terms):
    return "list_filter([" + ", ".join(f"CASE WHEN {_m(t)} THEN '{t}' END" for t in sorted(terms)) + "], lambda x: x IS NOT NULL)"


view("v_ents", f"""
SELECT *, lower(headline || ' ' || text) AS low0, list_distinct(regexp_extract_all(txt, '\\b[a-z0-9][a-z0-9&.\\-]*\\b')) AS tok
FROM (SELECT *, lower(trim(regexp_replace(headline || ' ' || text, '\\s+', ' ', 'g'))) AS txt FROM v_pre_rows)""")
_ALIAS_LOWER = " OR ".join(["false"])
view("v_gate_scores", f"""
SELECT *, CASE WHEN direct THEN 1.0::DOUBLE WHEN target THEN 1.0::DOUBLE ELSE 0.45::DOUBLE END AS ts,
  greatest(CASE WHEN len(fin) > 0 THEN least(1.0::DOUBLE, 0.45::DOUBLE + 0.15::DOUBLE * least(len(fin), 4)) ELSE 0 END, CASE WHEN len(broad) > 0 THEN least(0.85::DOUBLE, 0.40::DOUBLE + 0.10::DOUBLE * least(len(broad), 4)) ELSE 0 END) AS fs,
  CASE WHEN has_topic AND topic_id >= 0 AND prob IS NOT NULL THEN prob ELSE 0 END AS ps,
  CASE WHEN NOT has_topic THEN 'missing_topic_label' WHEN topic_id IS NULL OR topic_id < 0 THEN 'topic_outlier' WHEN prob IS NULL THEN 'missing_topic_probability' WHEN prob < 0.2::DOUBLE THEN 'low_topic_probability' ELSE 'topic_probability_supported' END AS topic_reason,
  list_sort(list_filter(named, lambda x: x <> ticker AND x <> 'SPY')) AS others
FROM (SELECT *, list_contains(tok, lower(ticker)) OR contains(txt, '$' || lower(ticker)) AS direct, list_contains(named, ticker) OR list_contains(ents, lower(ticker)) AS target, h % 5 <> 0 AS has_topic,
        CASE WHEN h % 5 = 1 THEN -1 WHEN h % 7 = 2 THEN NULL ELSE h % 5 END AS topic_id, CASE WHEN h % 11 = 3 THEN NULL ELSE (h % 10) / 10.0::DOUBLE END AS prob
 FROM (SELECT e.*, length(article_id) + length(ticker) * 3 + day(date) AS h, {_lst(FIN)} AS fin, {_lst(BROAD)} AS broad, ents,
   list_filter([{", ".join("CASE WHEN " + " OR ".join(f"{_m(n)} OR list_contains(ents, '{n}')" for n in ns) + f" THEN '{t}' END" for t, ns in NAMES.items())}], lambda x: x IS NOT NULL) AS named
  FROM v_ents e JOIN v_entity_low el USING (doc_id, chunk_index)))""")
view("v_entity_low", f"""
SELECT doc_id, chunk_index, list_transform(CASE WHEN len(named) > 0 THEN named ELSE list_distinct(list_filter(phrases, lambda p: NOT list_has_all([{STOPS}], string_split(lower(regexp_replace(p, '\\s+', ' ', 'g')), ' ')))) END, lambda x: lower(trim(regexp_replace(x, '\\s+', ' ', 'g')))) AS ents
FROM (SELECT doc_id, chunk_index, list_filter([{", ".join(f"CASE WHEN {('contains(low, ' + chr(39) + a + chr(39) + ')') if ' ' in a else ('regexp_matches(low, ' + chr(39) + chr(92) + 'b' + a + chr(92) + 'b' + chr(39) + ')')} THEN '{e}' END" for a, e in ALIAS_TEST)}], lambda x: x IS NOT NULL) AS named,
      regexp_extract_all(c, '\\b(?:[A-Z][a-z0-9&]+(?:\\s+[A-Z][a-z0-9&]+){{0,3}}|[A-Z]{{2,}}(?:\\s+[A-Z]{{2,}})*)\\b') AS phrases
 FROM (SELECT doc_id, chunk_index, headline || ' ' || text AS c, lower(headline || ' ' || text) AS low FROM v_pre))""")
view("v_gate_out", """
SELECT date, ticker, article_id, chunk_index, CASE WHEN score >= 0.55::DOUBLE AND ts >= 0.75 AND fs >= 0.35::DOUBLE THEN 'accepted' WHEN score >= 0.35::DOUBLE AND fs >= 0.35::DOUBLE AND len(others) = 0 THEN 'borderline' ELSE 'rejected' END AS decision, score, ts, fs, ps, fin, broad, others, topic_reason, direct, target, has_emb
FROM (SELECT *, CASE WHEN len(others) > 0 AND ts < 1 THEN least(raw, 0.30::DOUBLE) ELSE raw END AS score, day(date) % 2 = 0 AS has_emb FROM (SELECT *, least(1.0::DOUBLE, 0.65::DOUBLE * ts + 0.25::DOUBLE * fs + 0.10::DOUBLE * ps) AS raw FROM v_gate_scores))""")


@query("t7_relevance_gate", """
SELECT date, ticker, article_id, chunk_index, decision AS relevance_decision, round(score, 6) AS relevance_score, ts AS ticker_relevance_score, round(fs, 6) AS financial_relevance_score, round(ps, 6) AS topic_relevance_score,
 array_to_string(list_sort(list_filter([CASE WHEN direct THEN 'direct_ticker_mention' WHEN target THEN 'target_entity_mention' ELSE 'source_ticker_tag_only' END,
  CASE WHEN len(fin) > 0 THEN 'financial_terms:' || array_to_string(fin[1:5], ',') END, CASE WHEN len(broad) > 0 THEN 'broad_market_terms:' || array_to_string(broad[1:5], ',') END, topic_reason,
  CASE WHEN NOT has_emb THEN 'missing_embedding' END, CASE WHEN len(others) > 0 AND ts < 1 THEN 'competitor_entity_without_target:' || array_to_string(others, ',') END, CASE WHEN fs < 0.35::DOUBLE THEN 'low_financial_relevance' END,
  CASE decision WHEN 'borderline' THEN 'borderline_ticker_or_topic_evidence' WHEN 'rejected' THEN 'rejected_by_relevance_gate' END], lambda x: x IS NOT NULL)), ';') AS reason_codes
FROM v_gate_out""")
def t7(spark, sf):
    rows, topics, emb = _gate_inputs(spark, sf)
    g = N.relevance_gate(rows, topics, emb, vocabulary=VOCABULARY)
    return rounded(g.select("date", "ticker", "article_id", "chunk_index", "relevance_decision", "relevance_score", "ticker_relevance_score", "financial_relevance_score", "topic_relevance_score",
                            F.array_join("reason_codes", ";").alias("reason_codes")))


# ---- scored rows ------------------------------------------------------------------------

view("v_prep", """
SELECT s.*, t.topic_id, t.topic_probability, t.topic_id IS NULL AS missing_topic, g.relevance_decision, g.reason_codes, g.relevance_decision IS NULL AS missing_relevance,
       CASE WHEN t.topic_id >= 0 AND t.topic_probability IS NOT NULL THEN greatest(t.topic_probability, 0) * ew ELSE 0 END AS tw
FROM (SELECT *, CAST((published_at AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS bucket, sw * CASE WHEN relevance_score IS NULL THEN 1 ELSE greatest(relevance_score, 0) END AS ew
      FROM (SELECT *, CASE lower(trim(regexp_replace(source, '\\s+', ' ', 'g'))) WHEN 'dow jones' THEN 1.2::DOUBLE WHEN 'reuters' THEN 1.25::DOUBLE WHEN 'sec' THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END AS sw FROM v_scored)) s
LEFT JOIN (SELECT * FROM v_topics QUALIFY row_number() OVER (PARTITION BY date, ticker, article_id ORDER BY topic_id, topic_probability) = 1) t ON t.date = s.date AND t.ticker = s.ticker AND t.article_id = s.article_id
LEFT JOIN (SELECT * FROM v_gate QUALIFY row_number() OVER (PARTITION BY date, ticker, article_id, sentence_index, chunk_index ORDER BY seq) = 1) g
  ON g.date = s.date AND g.ticker = s.ticker AND g.article_id = s.article_id AND g.sentence_index IS NOT DISTINCT FROM s.sentence_index AND g.chunk_index IS NOT DISTINCT FROM s.chunk_index""")


def prepared(spark, sf):
    return SE.prepare(T.scored_news(spark, sf), T.topic_labels(spark, sf), T.relevance_gate(spark, sf), gate_order=["seq"])


@query("j11_evidence_join", "SELECT article_id, ticker, sentence_index, date AS artifact_date, bucket AS date, topic_id, missing_topic, relevance_decision, missing_relevance FROM v_prep")
def j11(spark, sf):
    return prepared(spark, sf).select("article_id", "ticker", "sentence_index", "artifact_date", "date", "topic_id", "missing_topic", "relevance_decision", "missing_relevance")


@query("t8_source_weight", "SELECT source, sw AS source_weight, count(*) AS n FROM v_prep GROUP BY 1, 2")
def t8(spark, sf):
    return T.scored_news(spark, sf).groupBy("source", SE.source_weight("source").alias("source_weight")).agg(F.count(F.lit(1)).alias("n"))


@query("t9_weights", "SELECT article_id, ticker, sentence_index, date AS artifact_date, round(ew, 6) AS effective_weight, round(tw, 6) AS topic_weight FROM v_prep")
def t9(spark, sf):
    return rounded(prepared(spark, sf).select("article_id", "ticker", "sentence_index", "artifact_date", "effective_weight", "topic_weight"))


@query("t10_trading_day", "SELECT event_id, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS day FROM events WHERE event_id % 5 <> 0 UNION ALL SELECT event_id, CAST(ts AS DATE) + 1 FROM events WHERE event_id % 5 = 0")
def t10(spark, sf):
    e = T.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("ts").cast("timestamp")).alias("p"), F.date_add(F.to_date("ts"), 1).alias("f"))
    return e.select("event_id", SE.trading_day("p", "f").alias("day"))


class WordScorer:
    """Share of listed words; a stand-in for a model behind the same hook."""

    GOOD, BAD = ("the", "of"), ("and", "in")

    def score(self, texts):
        out = []
        for t in texts:
            words = t.lower().split(" ")
            p, n = sum(w in self.GOOD for w in words), sum(w in self.BAD for w in words)
            out.append((p / (p + n + 1), n / (p + n + 1), 1 / (p + n + 1)))
        return out


@query("t11_scored_sentences", """
SELECT conv_id, turn, p / (p + n + 1) AS positive, n / (p + n + 1) AS negative, (p - n) / (p + n + 1) AS score FROM (
SELECT conv_id, turn, CAST(len(list_filter(w, lambda x: x IN ('the', 'of'))) AS DOUBLE) AS p, CAST(len(list_filter(w, lambda x: x IN ('and', 'in'))) AS DOUBLE) AS n FROM (SELECT conv_id, turn, string_split(lower(text), ' ') AS w FROM conversations))""".replace("p / (p + n + 1) AS positive, n / (p + n + 1) AS negative, (p - n) / (p + n + 1) AS score", "round(p / (p + n + 1), 6) AS positive, round(n / (p + n + 1), 6) AS negative, round((p - n) / (p + n + 1), 6) AS score"))
def t11(spark, sf):
    c = T.table(spark, sf, "conversations").select("conv_id", "turn", "text", F.lit(None).cast("string").alias("headline"))
    return rounded(SE.score_sentences(c, WordScorer).select("conv_id", "turn", "positive", "negative", "score"))


view("v_pre_docs", """
SELECT article_id, string_agg(text, ' ' ORDER BY o, c, text) AS text, count(*) AS article_sentence_count FROM (
 SELECT p.article_id, p.text, min(row(r.o, p.chunk_index)) AS k, arg_min(r.o, row(r.o, p.chunk_index)) AS o, arg_min(p.chunk_index, row(r.o, p.chunk_index)) AS c
 FROM v_pre p JOIN v_orders r USING (doc_id, chunk_index) GROUP BY 1, 2) GROUP BY 1""")
view("v_orders", f"""
SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS chunk_index, unnest(l) AS o FROM (
SELECT doc_id, list_concat(generate_series(0, len({_split('headline')}) - 1), generate_series(0, len({_split('content')}) - 1)) AS l FROM v_ascii)""")


@query("t12_article_documents", "SELECT d.article_id, d.text, d.article_sentence_count, array_to_string(t.tickers, ';') AS tickers FROM v_pre_docs d JOIN (SELECT DISTINCT article_id, tickers FROM v_pre) t USING (article_id)")
def t12(spark, sf):
    d = TP.article_documents(N.preprocess(ascii_articles(spark, sf), universe(spark, sf), aliases=ALIAS_TEST))
    return d.select("article_id", "text", "article_sentence_count", F.array_join("tickers", ";").alias("tickers"))


class HashEmbedder:
    """Bag of hashed words, unit length; a stand-in for a sentence model behind the same hook."""

    DIM = 64

    def encode(self, texts):
        import zlib
        out = np.zeros((len(texts), self.DIM))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                out[i, zlib.crc32(w.encode()) % self.DIM] += 1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1.0)


def _documents(spark, sf):
    a = T.articles(spark, sf)
    return a.select(F.to_date("published_at").alias("date"), X.article_identity().alias("article_id"), X.normalize_headline(F.col("headline")).alias("normalized_headline"),
                    F.col("content").alias("text"), F.col("symbols").alias("tickers"), F.size(X.sentences(F.col("content"))).cast("bigint").alias("article_sentence_count"))


@query("t13_embeddings")
def t13(spark, sf):
    """Vectors for all documents whose key is not cached yet; the cache holds every fourth."""
    docs = _documents(spark, sf)
    cache = docs.withColumn("embedding_cache_key", TP.embedding_cache_key("hash", "1", 64)).where(F.pmod(F.crc32("article_id"), F.lit(4)) == 0)
    return TP.embed_articles(docs, HashEmbedder, model="hash", revision="1", dimension=64, cache=cache).select("date", "article_id", "embedding_cache_key", F.size("embedding").alias("dimension"))


@query("t13_cache_key", "SELECT doc_id, sha256(sha256(d || '|d' || doc_id || '|' || h || '|' || text) || '|m|1|64') AS embedding_cache_key FROM (SELECT doc_id, text, '2000-01-03' AS d, trim(regexp_replace(lower(source), '[^a-z0-9]+', ' ', 'g')) AS h FROM documents)")
def t13b(spark, sf):
    d = T.table(spark, sf, "documents").select("doc_id", F.lit("2000-01-03").cast("date").alias("date"), F.concat(F.lit("d"), F.col("doc_id")).alias("article_id"), X.normalize_headline(F.col("source")).alias("normalized_headline"), "text")
    return d.select("doc_id", TP.embedding_cache_key("m", "1", 64).alias("embedding_cache_key"))


@query("t14_topic_labels")
def t14(spark, sf):
    """k-means topics of the supplied vectors, spread to two tickers each."""
    e = T.table(spark, sf, "embeddings").select(F.col("vec_id"), "embedding")
    docs = e.select(F.lit("2000-01-03").cast("date").alias("date"), F.concat(F.lit("v"), F.col("vec_id")).alias("article_id"), F.lit(3).cast("bigint").alias("article_sentence_count"),
                    F.array(F.concat(F.lit("S"), F.col("vec_id") % 10), F.concat(F.lit("S"), F.col("vec_id") % 7 + 10)).alias("tickers"), "embedding")
    topics = TP.label_topics(docs, k=8, min_probability=0.5)
    return TP.explode_to_tickers(docs, topics)


@query("t14_batch_offsets", """
SELECT vec_id, b AS batch, CASE WHEN label = 0 THEN -1 ELSE label + (SELECT coalesce(sum(m), 0) FROM (SELECT vec_id % 4 AS b2, max(label) + 1 AS m FROM embeddings GROUP BY 1) WHERE b2 < b) END::INTEGER AS topic_id
FROM (SELECT vec_id, vec_id % 4 AS b, label FROM embeddings)""")
def t14b(spark, sf):
    e = T.table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 4).alias("batch"), F.when(F.col("label") == 0, -1).otherwise(F.col("label")).alias("topic_id"))
    return TP.offset_batch_topics(e)


@query("t15_sentence_identity", "SELECT conv_id, turn, sha256('2000-01-03|c' || conv_id || '|' || turn || '|' || text) AS sentence_key FROM conversations")
def t15(spark, sf):
    c = T.table(spark, sf, "conversations").select("conv_id", "turn", "text", F.lit("2000-01-03").cast("date").alias("date"), F.concat(F.lit("c"), F.col("conv_id")).alias("article_id"),
                                                   F.col("turn").alias("sentence_index"), F.lit("").alias("normalized_headline"), F.lit(None).cast("timestamp").alias("published_at"), F.lit("").alias("url"))
    return c.select("conv_id", "turn", TP.sentence_identity().alias("sentence_key"))


@query("t16_evidence_snippets", """
SELECT doc_id, array_to_string(list_transform(list_filter(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_matches(lower(s), '\\bthan\\b') OR contains(lower(s), 'of the')), lambda s: trim(regexp_replace(s, '^ +| +$', '', 'g'))), '|') AS snippets
FROM (SELECT doc_id, regexp_replace(content, '[^\\x00-\\x7F]', 'e', 'g') AS t FROM v_articles)""")
def t16(spark, sf):
    a = ascii_articles(spark, sf)
    return a.select("doc_id", F.array_join(X.evidence_snippets(F.col("content"), ["than", "of the"]), "|").alias("snippets"))


# ---- sentiment aggregates --------------------------------------------------------------------


def _wavg(v, w):
    return f"sum(CASE WHEN {w} > 0 AND {v} IS NOT NULL THEN {v} * {w} END) / nullif(sum(CASE WHEN {w} > 0 AND {v} IS NOT NULL THEN {w} END), 0)"


_ART = "CASE WHEN count(article_id) = 0 THEN count(*) ELSE count(DISTINCT article_id) END"


@query("a1_weighted_average", f"SELECT ticker, round({_wavg('score', 'ew')}, 6) AS score FROM v_prep GROUP BY 1")
def a1(spark, sf):
    return rounded(prepared(spark, sf).groupBy("ticker").agg(SE.weighted_average("score", "effective_weight").alias("score")))


@query("a2_ticker_day_sentiment", f"""
SELECT bucket AS date, ticker, round({_wavg('positive', 'ew')}, 6) AS sentiment_positive, round({_wavg('negative', 'ew')}, 6) AS sentiment_negative, round({_wavg('neutral', 'ew')}, 6) AS sentiment_neutral,
 round({_wavg('score', 'ew')}, 6) AS sentiment_score, round({_wavg('relevance_score', 'sw')}, 10) AS relevance_score FROM v_prep GROUP BY 1, 2""")
def a2(spark, sf):
    return rounded(SE.aggregate_by_ticker_day(prepared(spark, sf)), relevance_score=10)


view("v_topic_summary", f"""
SELECT bucket AS date, ticker, topic_id, count(*) AS sentence_count, {_ART} AS article_count, sum(tw) AS weight, {_wavg('score', 'tw')} AS sentiment_score, {_wavg('topic_probability', 'ew')} AS mean_topic_probability
FROM v_prep WHERE tw > 0 GROUP BY 1, 2, 3""")
view("v_source_summary", f"SELECT bucket AS date, ticker, source, avg(sw) AS source_weight, count(*) AS sentence_count, {_ART} AS article_count FROM v_prep GROUP BY 1, 2, 3")


@query("a5_topic_summary", "SELECT date, ticker, topic_id, sentence_count, article_count, round(weight, 6) AS weight, round(sentiment_score, 6) AS sentiment_score, round(mean_topic_probability, 6) AS mean_topic_probability FROM v_topic_summary")
def a5(spark, sf):
    return rounded(SE.topic_summary(prepared(spark, sf)))


@query("a6_source_summary", "SELECT date, ticker, source, round(source_weight, 6) AS source_weight, sentence_count, article_count FROM v_source_summary")
def a6(spark, sf):
    return rounded(SE.source_summary(prepared(spark, sf)))


view("v_sentiment", f"""
SELECT b.*, coalesce(d.topic_count, 0) AS nlp_sentiment_topic_count, t.topic_id AS nlp_sentiment_dominant_topic_id, round(t.sentiment_score, 6) AS nlp_sentiment_dominant_topic_score, round(t.mean_topic_probability, 6) AS nlp_sentiment_dominant_topic_probability,
 coalesce(c.codes, '') AS reason_codes, coalesce(ts.l, '') AS topic_ids, ss.l AS sources,
 concat_ws(';', CASE WHEN nlp_missing_relevance_evidence_count > 0 THEN 'missing_relevance_evidence' END, CASE WHEN nlp_missing_source_count > 0 THEN 'missing_source_default_weight' END, CASE WHEN nlp_missing_topic_count > 0 THEN 'missing_topic_evidence' END) AS warnings
FROM (SELECT bucket AS date, ticker, round({_wavg('positive', 'ew')}, 6) AS nlp_sentiment_positive, round({_wavg('negative', 'ew')}, 6) AS nlp_sentiment_negative, round({_wavg('neutral', 'ew')}, 6) AS nlp_sentiment_neutral,
  round({_wavg('score', 'ew')}, 6) AS nlp_sentiment_score, round({_wavg('greatest(positive, negative)', 'ew')}, 6) AS nlp_sentiment_strength, round(stddev_pop(score), 6) AS nlp_sentiment_std, {_ART} AS nlp_article_count, count(*) AS nlp_sentence_count,
  round({_wavg('relevance_score', 'sw')}, 10) AS nlp_relevance_score, round(avg(sw), 6) AS nlp_source_weight_mean, round(sum(sw), 6) AS nlp_source_weight_sum, round(sum(ew), 6) AS nlp_effective_weight_sum, count(*) FILTER (source IS NULL) AS nlp_missing_source_count,
  round({_wavg('score', 'tw')}, 6) AS nlp_sentiment_topic_score, count(*) FILTER (relevance_decision = 'accepted') AS nlp_relevance_accepted_count, count(*) FILTER (relevance_decision = 'borderline') AS nlp_relevance_borderline_count,
  count(*) FILTER (missing_topic) AS nlp_missing_topic_count, count(*) FILTER (missing_relevance) AS nlp_missing_relevance_evidence_count FROM v_prep GROUP BY 1, 2) b
LEFT JOIN (SELECT bucket AS date, ticker, count(DISTINCT topic_id) AS topic_count FROM v_prep WHERE topic_id >= 0 GROUP BY 1, 2) d USING (date, ticker)
LEFT JOIN (SELECT * FROM v_topic_summary QUALIFY row_number() OVER (PARTITION BY date, ticker ORDER BY round(weight, 9) DESC, topic_id) = 1) t USING (date, ticker)
LEFT JOIN (SELECT date, ticker, string_agg(DISTINCT c, ';' ORDER BY c) AS codes FROM (SELECT bucket AS date, ticker, unnest(reason_codes) AS c FROM v_prep) GROUP BY 1, 2) c USING (date, ticker)
LEFT JOIN (SELECT date, ticker, string_agg(topic_id || ':' || sentence_count || ':' || article_count, ';' ORDER BY round(weight, 9) DESC, topic_id) AS l FROM v_topic_summary GROUP BY 1, 2) ts USING (date, ticker)
LEFT JOIN (SELECT date, ticker, string_agg(coalesce(source, '?') || ':' || sentence_count || ':' || article_count, ';' ORDER BY source NULLS LAST) AS l FROM v_source_summary GROUP BY 1, 2) ss USING (date, ticker)""")


@query("a3_sentiment", "SELECT * FROM v_sentiment")
def a3(spark, sf):
    f = SE.ticker_day_features(prepared(spark, sf))
    arr = lambda c: F.array_join(F.from_json(c, "array<string>"), ";")
    topic = F.from_json("nlp_topic_sentiment_summary", "array<struct<topic_id:int,sentence_count:int,article_count:int>>")
    src = F.from_json("nlp_source_weight_summary", "array<struct<source:string,sentence_count:int,article_count:int>>")
    text = lambda s, k: F.concat_ws(":", F.coalesce(s[k].cast("string"), F.lit("?")), s["sentence_count"], s["article_count"])
    out = f.withColumn("reason_codes", arr("nlp_relevance_reason_codes")).withColumn("warnings", arr("nlp_semantic_warning_codes"))
    out = out.withColumn("topic_ids", F.array_join(F.transform(topic, lambda s: text(s, "topic_id")), ";")).withColumn("sources", F.array_join(F.transform(src, lambda s: text(s, "source")), ";"))
    return rounded(out.drop("nlp_relevance_reason_codes", "nlp_semantic_warning_codes", "nlp_topic_sentiment_summary", "nlp_source_weight_summary"), nlp_relevance_score=10)


@query("a3_contributing_articles", "SELECT DISTINCT bucket AS date, ticker, article_id FROM v_prep WHERE article_id IS NOT NULL")
def a3b(spark, sf):
    return SE.contributing_articles(prepared(spark, sf))


view("v_vec_topics", "SELECT DATE '2000-01-03' + CAST(vec_id % 20 AS INTEGER) AS date, 'S' || (vec_id % 3) AS ticker, CASE WHEN label = 0 THEN -1 ELSE label END AS topic_id, (vec_id % 10) / 10.0::DOUBLE AS p, vec_id % 6 + 1 AS n FROM embeddings")


view("v_topic_features", """
SELECT date, ticker, count(*) AS nlp_article_count, sum(n)::BIGINT AS nlp_sentence_count, count(DISTINCT CASE WHEN topic_id >= 0 THEN topic_id END) AS nlp_topic_count, max(dom)::INTEGER AS nlp_dominant_topic_id,
 avg(CASE WHEN topic_id = dom THEN p END) AS nlp_dominant_topic_probability, avg(p) AS nlp_mean_topic_probability
FROM v_vec_topics LEFT JOIN (SELECT date, ticker, topic_id AS dom FROM (SELECT date, ticker, topic_id, count(*) AS c FROM v_vec_topics WHERE topic_id >= 0 GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY date, ticker ORDER BY c DESC, topic_id) = 1) USING (date, ticker) GROUP BY 1, 2""")


def vector_topics(spark, sf):
    """Topic label rows from embedding labels."""
    e = T.table(spark, sf, "embeddings")
    return e.select(F.date_add(F.lit("2000-01-03").cast("date"), (F.col("vec_id") % 20).cast("int")).alias("date"), F.concat(F.lit("S"), F.col("vec_id") % 3).alias("ticker"),
                    F.when(F.col("label") == 0, -1).otherwise(F.col("label")).alias("topic_id"), ((F.col("vec_id") % 10) / F.lit(10.0)).alias("topic_probability"), (F.col("vec_id") % 6 + 1).alias("article_sentence_count"))


@query("a7_topic_features", "SELECT * REPLACE (round(nlp_dominant_topic_probability, 6) AS nlp_dominant_topic_probability, round(nlp_mean_topic_probability, 6) AS nlp_mean_topic_probability) FROM v_topic_features")
def a7(spark, sf):
    return rounded(TP.topic_features(vector_topics(spark, sf)))
