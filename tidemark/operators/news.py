"""News: articles -> (ticker x sentence) rows, mentions, relevance gate."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions.maths import first_per_key
from tidemark.operators.contracts import canonical_ticker

# Entity aliases in match order.
ENTITY_ALIASES = [
    ("apple inc", "Apple"),
    ("apple", "Apple"),
    ("berkshire hathaway", "Berkshire Hathaway"),
    ("federal reserve", "Federal Reserve"),
    ("meta platforms", "Meta Platforms"),
    ("meta", "Meta Platforms"),
    ("microsoft corporation", "Microsoft"),
    ("microsoft corp", "Microsoft"),
    ("microsoft", "Microsoft"),
    ("s&p 500", "S&P 500"),
    ("spdr s&p 500 etf trust", "SPY"),
    ("sec", "SEC"),
]
# Capitalised words that are no entities.
ENTITY_STOP_WORDS = ["article", "earnings", "full", "new", "product", "quarterly", "reported", "reports", "results", "shares", "text"]
# Financial vocabulary of the relevance gate.
FINANCIAL_TERMS = [
    "analyst", "analysts", "buyback", "cash flow", "dividend", "earnings", "ebitda", "eps", "forecast", "guidance", "margin", "margins",
    "nasdaq", "outlook", "price target", "profit", "profits", "quarter", "quarterly", "rating", "revenue", "revenues", "results", "sales",
    "shares", "stock", "upgrade", "upgraded", "valuation",
]
# Broad-market vocabulary of the relevance gate.
BROAD_MARKET_TERMS = [
    "bond yields", "dow", "federal reserve", "fed", "inflation", "interest rates", "market", "markets", "nasdaq", "s&p 500", "stocks",
    "treasury", "vix", "wall street",
]
# Names a ticker is known by.
COMPANY_NAMES = {
    "AAPL": ["apple", "apple inc"],
    "MSFT": ["microsoft", "microsoft corp", "microsoft corporation"],
    "GOOGL": ["alphabet", "google"],
    "GOOG": ["alphabet", "google"],
    "AMZN": ["amazon", "amazon.com"],
    "META": ["meta", "meta platforms", "facebook"],
    "NVDA": ["nvidia"],
    "TSLA": ["tesla"],
    "JPM": ["jpmorgan", "jp morgan", "jpmorgan chase"],
    "XOM": ["exxon", "exxon mobil", "exxonmobil"],
    "SPY": ["spy", "s&p 500", "spdr s&p 500 etf trust"],
}

TEXT_FIELDS = ["headline", "summary", "content"]
EVIDENCE = ["_tags", "_direct", "_target", "_known", "_fin", "_broad"]


@dataclass(frozen=True)
class Vocabulary:
    """Words the relevance gate looks for."""

    names: dict[str, list[str]] = field(default_factory=lambda: COMPANY_NAMES)
    financial: list[str] = field(default_factory=lambda: FINANCIAL_TERMS)
    broad: list[str] = field(default_factory=lambda: BROAD_MARKET_TERMS)


def _filled(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def _terms(v: Vocabulary) -> list[str]:
    every = [*[n for ns in v.names.values() for n in ns], *v.financial, *v.broad]
    return list(dict.fromkeys(" ".join(t.lower().split()) for t in every))


def _names(v: Vocabulary) -> list[str]:
    return list(dict.fromkeys(n for ns in v.names.values() for n in ns))


def _entities_named(tickers: Column, entities: str) -> Column:
    return F.filter(tickers, lambda t: F.array_contains(F.col(entities), F.lower(t)))


def _named_in(tickers: Column, tokens: str, text: str) -> Column:
    """The tickers that are a token of the text or stand in it behind a dollar sign."""
    return F.filter(tickers, lambda t: F.array_contains(F.col(tokens), F.lower(t)) | F.contains(F.col(text), F.concat(F.lit("$"), F.lower(t))))


def _entity_keys(mentions: Column) -> Column:
    return F.transform(F.coalesce(mentions, F.array().cast("array<string>")), lambda s: F.lower(X.squeeze(s)))


def headline_evidence(df: DataFrame, v: Vocabulary, tickers: Column) -> DataFrame:
    """What `text_evidence` needs of the headline, for rows before they are repeated per sentence.

    A headline may be as long as a text, so its words stay here: the sentences get the terms and tickers it names.
    """
    terms = _terms(v)
    if "_h_phrases" in df.columns:
        df = df.withColumn("_h_ent", _entity_keys(F.col("_h_phrases")))
        df = df.withColumn("_h_target", _entities_named(tickers, "_h_ent"))
        df = df.withColumn("_h_known", F.array(*[F.array_contains("_h_ent", n) for n in _names(v)]).cast("array<boolean>")).drop("_h_ent")
    df = df.withColumn("_h_text", F.lower(X.squeeze(_filled("headline"))))
    df = df.withColumn("_h_tok", F.array_distinct(F.regexp_extract_all("_h_text", F.lit(X.WORD_TOKEN), 0)))
    padded = F.concat(F.lit(" "), F.col("_h_text"), F.lit(" "))
    has = F.array(*[F.contains(padded, F.lit(f" {t} ")) if " " in t else F.array_contains("_h_tok", t) for t in terms])
    return df.select("*", has.alias("_h_has"), _named_in(tickers, "_h_tok", "_h_text").alias("_h_direct"),
                     F.right(F.concat(F.lit(" "), "_h_text"), F.lit(max(map(len, terms), default=0) + 2)).alias("_h_last")).drop("_h_text", "_h_tok")


def text_evidence(df: DataFrame, v: Vocabulary, tickers: Column | None = None) -> DataFrame:
    """Everything of the gate that depends on a sentence only: which of the tickers it names, known companies, matched terms.

    A term counts in the headline, in the sentence, or across their border. The headline's part is found once per
    article; a sentence adds its own words and the few characters around the border.
    """
    if tickers is None:
        tickers = F.array("ticker") if "ticker" in df.columns else F.array().cast("array<string>")
    if "_h_has" not in df.columns:
        df = headline_evidence(df, v, tickers)
    terms, names = _terms(v), _names(v)
    df = df.withColumn("_text", F.lower(X.squeeze(_filled("text"))))
    df = df.withColumn("_tok", F.array_distinct(F.regexp_extract_all("_text", F.lit(X.WORD_TOKEN), 0)))
    split = "_ent" in df.columns  # the headline's entities stand beside those of the sentence
    if not split:
        df = df.withColumn("_ent", _entity_keys(F.col("entity_mentions")))
    df = df.withColumn("_pad", F.concat(F.lit(" "), F.col("_text"), F.lit(" ")))
    df = df.withColumn("_seam", F.concat("_h_last", F.lit(" "), F.left(F.concat("_text", F.lit(" ")), F.lit(max(map(len, terms), default=0) + 2))))

    def has(phrase: str) -> Column:
        phrase = " ".join(phrase.lower().split())
        spoken = F.lit(f" {phrase} ")
        here = F.contains("_pad", spoken) | F.contains("_seam", spoken) if " " in phrase else F.array_contains("_tok", phrase)
        return F.get("_h_has", F.lit(terms.index(phrase))) | here

    def entity(name: str) -> Column:
        here = F.array_contains("_ent", name)
        return here | (F.col("_ent_head") & F.get("_h_known", F.lit(names.index(name)))) if split else here

    def matched(found: list[str]) -> Column:
        return F.array_compact(F.array(*[F.when(has(t), F.lit(t)) for t in sorted(found)]))

    def any_of(conds: list[Column]) -> Column:
        return reduce(lambda a, b: a | b, conds, F.lit(False))

    known = [F.when(any_of([has(n) | entity(n) for n in ns]), F.lit(t)) for t, ns in v.names.items()]
    df = df.withColumn("_known", F.array_compact(F.array(*known)) if known else F.array().cast("array<string>"))
    df = df.withColumn("_direct", F.array_union("_h_direct", _named_in(tickers, "_tok", "_text")))
    target = _entities_named(tickers, "_ent")
    df = df.withColumn("_target", F.when(F.col("_ent_head"), F.array_union("_h_target", target)).otherwise(target) if split else target)
    df = df.withColumn("_fin", matched(v.financial)).withColumn("_broad", matched(v.broad))
    return df.drop("_text", "_tok", "_ent", "_ent_head", "_pad", "_seam", "_h_has", "_h_direct", "_h_last", "_h_target", "_h_known")


def with_chunks(articles: DataFrame, *, fields: list[str] | None = None, min_chars: int = 2) -> DataFrame:
    """One row per sentence with its field, order in the field and index in the article."""
    cols = articles.columns
    df = articles.select(*cols, F.posexplode(X.article_chunks(fields or TEXT_FIELDS, min_chars)).alias("chunk_index", "_c"))
    return df.select(*cols, "chunk_index", "_c.source_text_field", "_c.source_text_order", "_c.text")


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(X.TICKER_TOKEN), 0))


def article_tickers(articles: DataFrame, universe: DataFrame | None, key: str = "article_id") -> DataFrame:
    """Sorted tickers per article: its tags and its capitalised tokens, kept when in the day's universe.

    Returns (key, article_tickers, known_tokens); known_tokens pairs each raw
    token found in the universe with its ticker. The universe is met by an
    equi-join on (date, ticker), never collected.
    """
    tags = F.transform(F.coalesce("symbols", F.array().cast("array<string>")), lambda s: F.struct(F.lit(None).cast("string").alias("token"), canonical_ticker(s).alias("ticker")))
    if universe is None:
        tickers = F.array_sort(F.array_distinct(F.filter(F.transform(tags, lambda t: t["ticker"]), lambda t: F.coalesce(t != "", F.lit(False)))))
        return articles.select(key, tickers.alias("article_tickers"), F.array().cast("array<struct<token:string,ticker:string>>").alias("known_tokens")).where(F.size("article_tickers") > 0).dropDuplicates([key])
    combined = F.concat_ws(" ", *[X.optional_text(F.col(f)) for f in TEXT_FIELDS])
    found = F.transform(_tokens(combined), lambda t: F.struct(t.alias("token"), canonical_ticker(t).alias("ticker")))
    cand = articles.select(key, "date", F.explode(F.concat(tags, found)).alias("c")).select(key, "date", "c.token", "c.ticker")
    allowed = universe.select("date", canonical_ticker("ticker").alias("ticker")).distinct()
    # no more names than securities; most tokens are none and go before anything moves
    cand = cand.join(allowed.select("ticker").distinct(), "ticker", "left_semi")
    # a universe made from a list of days is measured by that list, so adaptive execution would broadcast it at any size
    kept = cand.join(allowed.hint("merge"), ["date", "ticker"], "left_semi")
    return kept.groupBy(key).agg(
        F.array_sort(F.collect_set("ticker")).alias("article_tickers"),
        F.collect_set(F.when(F.col("token").isNotNull(), F.struct("token", "ticker"))).alias("known_tokens"))


def ticker_mentions(text: Column, article_tickers: Column, known_tokens: Column) -> Column:
    """Article tags first, then tickers of the text in order, without repeats."""
    lookup = F.map_from_entries(known_tokens)
    inline = F.array_compact(F.transform(_tokens(text), lambda t: F.try_element_at(lookup, t)))
    return F.array_distinct(F.concat(article_tickers, inline))


def _phrases(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(X.ENTITY_PHRASE), 0)


def _entities(phrases: Column) -> Column:
    """The trimmed phrases that hold more than stop words."""
    stop = F.array(*[F.lit(w) for w in ENTITY_STOP_WORDS])
    kept = F.filter(phrases, lambda p: F.size(F.array_except(F.split(F.lower(p), r"\s+"), stop)) > 0)
    return F.transform(kept, lambda p: F.trim(p))


def headline_mentions(df: DataFrame, aliases: list[tuple[str, str]] | None = None) -> DataFrame:
    """What `with_entity_mentions` needs of the headline, for rows before they are repeated per sentence.

    No phrase holds a word without a capital letter, so none reaches from before the last such word into the sentence:
    the phrases up to it are found here, the words after it are kept for the sentence.
    """
    rules = aliases or ENTITY_ALIASES
    df = df.withColumn("_h_low", F.lower(_filled("headline")))
    df = df.withColumn("_h_words", F.split(_filled("headline"), r"(?U)(?<=\s)(?=\S)"))
    plain = F.array_position(F.transform(F.reverse("_h_words"), lambda w: w.rlike("[A-Z]")), F.lit(False))
    tail = F.when(plain > 0, plain - 1).otherwise(F.size("_h_words")).cast("int")
    df = df.withColumn("_h_cut", F.size("_h_words") - tail)
    return df.select(
        "*", F.array(*[X.contains_term(F.col("_h_low"), a) for a, _ in rules]).alias("_h_alias"), F.right("_h_low", F.lit(max(len(a) for a, _ in rules))).alias("_h_end"),
        _entities(_phrases(F.array_join(F.slice("_h_words", F.lit(1), F.col("_h_cut")), ""))).alias("_h_phrases"),
        F.array_join(F.slice("_h_words", F.col("_h_cut") + 1, F.size("_h_words")), "").alias("_h_tail")).drop("_h_low", "_h_words", "_h_cut")


def with_entity_mentions(df: DataFrame, aliases: list[tuple[str, str]] | None = None) -> DataFrame:
    """T4: alias matches of headline and text in rule order, else capitalised phrases minus stop words.

    The headline's matches are found once per article (`headline_mentions`), here those of the text and across the border.
    After `headline_evidence`, `_ent` holds those of the sentence as `text_evidence` compares them, and `_ent_head` says whether
    the headline's phrases count beside them.
    """
    rules = aliases or ENTITY_ALIASES
    if "_h_alias" not in df.columns:
        df = headline_mentions(df, rules)
    df = df.withColumn("_low", F.lower(_filled("text")))
    df = df.withColumn("_seam", F.concat("_h_end", F.lit(" "), F.left("_low", F.lit(max(len(a) for a, _ in rules)))))
    here = lambda a: X.contains_term(F.col("_low"), a) | X.contains_term(F.col("_seam"), a) if " " in a else X.contains_term(F.col("_low"), a)
    named = [F.when(F.get("_h_alias", F.lit(i)) | here(a), F.lit(e)) for i, (a, e) in enumerate(rules)]
    df = df.withColumn("_named", F.array_distinct(F.array_compact(F.array(*named))))
    df = df.withColumn("_own", _entities(_phrases(F.concat_ws(" ", "_h_tail", _filled("text")))))
    if "_h_known" in df.columns:
        df = df.select("*", (F.size("_named") == 0).alias("_ent_head"), F.when(F.size("_named") > 0, _entity_keys(F.col("_named"))).otherwise(_entity_keys(F.col("_own"))).alias("_ent"))
    mentions = F.when(F.size("_named") > 0, F.col("_named")).otherwise(F.array_distinct(F.concat("_h_phrases", "_own")))
    return df.withColumn("entity_mentions", mentions).drop("_low", "_seam", "_named", "_own", "_h_alias", "_h_end", "_h_phrases", "_h_tail")


def preprocess(articles: DataFrame, universe: DataFrame | None = None, *, fields: list[str] | None = None, min_chars: int = 2,
               aliases: list[tuple[str, str]] | None = None, vocabulary: Vocabulary | None = None) -> DataFrame:
    """One row per (article, sentence, ticker) with provenance.

    With `vocabulary`, the gate's text evidence is found per sentence here, before
    sentences are repeated per ticker. Articles must be de-duplicated (S7).
    """
    a = articles.withColumn("article_id", X.article_identity())
    if "date" not in a.columns:
        a = a.withColumn("date", F.to_date("published_at"))
    # whole articles move once, before they grow into sentences; the ticker join then needs no further shuffle
    a = a.repartition("article_id")
    tickers = article_tickers(a, universe)
    base = a.select("date", "article_id", X.optional_text(F.col("headline")).alias("headline"), "summary", "content",
                    X.normalize_headline(X.optional_text(F.col("headline"))).alias("normalized_headline"),
                    X.optional_text(F.col("source")).alias("source"), X.optional_text(F.col("url")).alias("url"), "published_at")
    # tickers meet whole articles: joined to sentences, the headline would be sorted once for each of them
    base = headline_mentions(base.join(tickers, "article_id"), aliases)
    named = F.transform("article_tickers", lambda t: F.upper(F.trim(t)))
    if vocabulary is not None:
        base = headline_evidence(base, vocabulary, named)
    rows = with_chunks(base, fields=fields, min_chars=min_chars).drop("summary", "content")
    rows = rows.withColumn("chunk_tickers", ticker_mentions(F.col("text"), F.col("article_tickers"), F.col("known_tokens")))
    rows = with_entity_mentions(rows, aliases)
    if vocabulary is not None:
        rows = text_evidence(rows, vocabulary, named).withColumn("_tags", named)
    rows = rows.select("*", F.explode("article_tickers").alias("ticker"))
    return rows.select(
        "date", "ticker", "article_id", "headline", "normalized_headline", "text", F.col("chunk_index").alias("sentence_index"), "chunk_index", "source", "url",
        "published_at", "source_text_field", "source_text_order",
        F.array_distinct(F.concat(F.array("ticker"), F.col("chunk_tickers"))).alias("ticker_mentions"), "entity_mentions",
        F.struct("article_tickers", "chunk_tickers", "entity_mentions").alias("provenance"), *(EVIDENCE if vocabulary is not None else []))


# ---- relevance gate -------------------------------------------------------------


@dataclass(frozen=True)
class GateLimits:
    accepted: float = 0.55
    borderline: float = 0.35
    min_financial: float = 0.35
    min_topic_probability: float = 0.20


def relevance_gate(rows: DataFrame, topics: DataFrame | None = None, embeddings: DataFrame | None = None, *, limits: GateLimits = GateLimits(),
                   vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """Ticker, financial and topic scores, decision and reason codes per row.

    `topics` holds one row per (date, ticker, article_id), `embeddings` one per
    (date, article_id). Vocabularies are parameters, so matching is expressions on
    the row; the two evidence tables are left equi-joins.
    """
    evident = set(EVIDENCE) <= set(rows.columns)
    df = rows.withColumn("ticker", F.upper(F.trim("ticker")))
    if topics is not None:
        t = topics.select("date", F.upper("ticker").alias("ticker"), "article_id", "topic_id", "topic_probability")
        t = first_per_key(t, ["date", "ticker", "article_id"], [F.col("topic_id"), F.col("topic_probability")]).withColumn("_has_topic", F.lit(True))
        df = df.join(t, ["date", "ticker", "article_id"], "left")
    else:
        df = df.select("*", F.lit(None).cast("int").alias("topic_id"), F.lit(None).cast("double").alias("topic_probability"), F.lit(None).cast("boolean").alias("_has_topic"))
    if embeddings is not None:
        e = first_per_key(embeddings.select("date", "article_id", "embedding_cache_key"), ["date", "article_id"], [F.col("embedding_cache_key")]).withColumn("has_embedding", F.lit(True))
        df = df.join(e, ["date", "article_id"], "left").withColumn("has_embedding", F.coalesce("has_embedding", F.lit(False)))
    else:
        df = df.select("*", F.lit(None).cast("string").alias("embedding_cache_key"), F.lit(False).alias("has_embedding"))

    if not evident:
        df = text_evidence(df, vocabulary).withColumn("_tags", F.transform("provenance.article_tickers", lambda s: F.upper(F.trim(s))))
    direct = F.array_contains("_direct", F.col("ticker"))
    target = F.array_contains("_known", F.col("ticker")) | F.array_contains("_target", F.col("ticker"))
    tagged = F.array_contains("_tags", F.col("ticker"))
    df = df.withColumn("ticker_relevance_score", F.when(direct | target, 1.0).when(tagged, 0.45).otherwise(0.0))
    ticker_reason = F.when(direct, "direct_ticker_mention").when(target, "target_entity_mention").when(tagged, "source_ticker_tag_only")
    nf, nb = F.size("_fin"), F.size("_broad")
    specific = F.when(nf > 0, F.least(F.lit(1.0), 0.45 + 0.15 * F.least(nf, F.lit(4)))).otherwise(0.0)
    wide = F.when(nb > 0, F.least(F.lit(0.85), 0.40 + 0.10 * F.least(nb, F.lit(4)))).otherwise(0.0)
    df = df.withColumn("financial_relevance_score", F.greatest(specific, wide))
    p, tid = F.col("topic_probability"), F.col("topic_id")
    usable = F.col("_has_topic") & (tid >= 0)
    df = df.withColumn("topic_relevance_score", F.when(usable & p.isNotNull(), p).otherwise(0.0))
    topic_reason = (
        F.when(F.col("_has_topic").isNull(), "missing_topic_label").when(tid.isNull() | (tid < 0), "topic_outlier").when(p.isNull(), "missing_topic_probability")
        .when(p < limits.min_topic_probability, "low_topic_probability").otherwise("topic_probability_supported"))
    others = F.array_sort(F.filter("_known", lambda t: (t != F.col("ticker")) & (t != "SPY")))
    ts, fs = F.col("ticker_relevance_score"), F.col("financial_relevance_score")
    total = F.least(F.lit(1.0), 0.65 * ts + 0.25 * fs + 0.10 * F.col("topic_relevance_score"))
    df = df.withColumn("_others", others).withColumn("_raw", total)
    capped = (F.size("_others") > 0) & (ts < 1.0)
    df = df.withColumn("relevance_score", F.when(capped, F.least(F.col("_raw"), F.lit(0.30))).otherwise(F.col("_raw")))
    score = F.col("relevance_score")
    accepted = (score >= limits.accepted) & (ts >= 0.75) & (fs >= limits.min_financial)
    borderline = (score >= limits.borderline) & (ts > 0) & (fs >= limits.min_financial) & (F.size("_others") == 0)
    decision = F.when(accepted, "accepted").when(borderline, "borderline").otherwise("rejected")
    reasons = F.array_compact(F.array(
        ticker_reason,
        F.when(nf > 0, F.concat(F.lit("financial_terms:"), F.array_join(F.slice("_fin", 1, 5), ","))),
        F.when(nb > 0, F.concat(F.lit("broad_market_terms:"), F.array_join(F.slice("_broad", 1, 5), ","))),
        topic_reason,
        F.when(~F.col("has_embedding"), "missing_embedding"),
        F.when(capped, F.concat(F.lit("competitor_entity_without_target:"), F.array_join("_others", ","))),
        F.when(fs < limits.min_financial, "low_financial_relevance"),
        F.when(ts <= 0, "low_ticker_relevance"),
        F.when(~accepted & borderline, "borderline_ticker_or_topic_evidence"),
        F.when(~accepted & ~borderline, "rejected_by_relevance_gate"),
    ))
    keep = [c for c in rows.columns if c not in ("date", "ticker", "article_id", *EVIDENCE)]
    return df.select("date", "ticker", "article_id", *keep, decision.alias("relevance_decision"), "relevance_score", "ticker_relevance_score",
                     "financial_relevance_score", "topic_relevance_score", F.array_sort(F.array_distinct(reasons)).alias("reason_codes"),
                     F.to_json(F.struct(F.col("provenance.chunk_tickers").alias("chunk_tickers"), F.col("provenance.article_tickers").alias("source_tickers"))).alias("ticker_evidence"),
                     F.to_json(F.coalesce("provenance.entity_mentions", F.array().cast("array<string>"))).alias("entity_evidence"),
                     "topic_id", "topic_probability", "embedding_cache_key", "has_embedding")
