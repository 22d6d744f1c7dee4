"""Word lists. Larger lexicons are passed in as (word, weight) tables or read from a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Section sentiment of transcripts.
SECTION_POSITIVE = ["strong", "growth", "improved", "increase", "positive", "excellent", "record", "outstanding", "successful", "exceed", "beat",
                    "optimistic", "momentum", "opportunities", "robust", "solid", "confident"]
SECTION_NEGATIVE = ["weak", "decline", "decrease", "negative", "poor", "challenging", "headwind", "pressure", "concern", "risk", "uncertainty",
                    "difficult", "lower", "miss", "below", "disappointing", "cautious"]

# Financial terms (a token never holds a slash, so "p/e" is left out).
FINANCIAL_TERMS = [
    "stock", "stocks", "share", "shares", "equity", "equities", "bond", "bonds", "treasury", "treasuries", "option", "options", "derivative",
    "derivatives", "futures", "forward", "swap", "swaps", "investor", "investors", "trader", "traders", "analyst", "analysts", "broker", "brokers",
    "price", "prices", "volume", "volatility", "earnings", "revenue", "profit", "loss", "ebitda", "eps", "pe", "dividend", "yield", "margin",
    "margins", "valuation", "buy", "buying", "sell", "selling", "trade", "trading", "invest", "investing", "hedge", "hedging", "short", "shorting",
    "long", "bull", "bullish", "bear", "bearish", "rally", "rallied", "decline", "declined", "growth", "recession", "inflation", "deflation",
    "merger", "acquisition", "buyback", "ipo", "split", "spinoff", "etf", "index", "indices", "fund", "funds", "portfolio", "portfolios", "asset",
    "assets", "technical", "fundamental", "analysis", "indicator", "indicators", "signal", "signals", "trend", "trends", "support", "resistance"]

# Transcript markers and metric patterns.
QA_MARKERS = ["question-and-answer", "q&a session", "questions and answers", "operator: our first question"]
METRIC_PATTERNS = {
    "revenue": r"revenue[s]?\s+(?:of|was|were|at)?\s*\$?([\d,.]+)\s*(million|billion|M|B)?",
    "earnings": r"(?:earnings|EPS|earnings per share)\s+(?:of|was|were|at)?\s*\$?([\d,.]+)",
    "margin": r"(?:gross|operating|net)?\s*margin[s]?\s+(?:\w+\s+)*?(?:of|was|were|at|to)\s+([\d,.]+)%?",
    "growth": r"(?:revenue|sales|earnings)?\s*growth\s+(?:of|was|were|at)?\s*([\d,.]+)%?",
    "guidance": r"guidance\s+(?:of|for)?\s*\$?([\d,.]+)\s*(million|billion|M|B)?",
}
RISK_SECTION = r"(?is)item\s+1a\.?\s+risk\s+factors.*?(?=item\s+1b|item\s+2|\z)"
MANAGEMENT_SECTION = r"(?is)item\s+7\.?\s+management.*?discussion.*?analysis.*?(?=item\s+7a|item\s+8|\z)"

# A short default polarity list; pass a full dictionary for production scoring.
POSITIVE = SECTION_POSITIVE + ["gain", "gains", "improve", "improving", "profit", "profitable", "strength", "success", "bullish", "benefit", "better", "best", "good", "great", "win"]
NEGATIVE = SECTION_NEGATIVE + ["loss", "losses", "bearish", "adverse", "bad", "bankruptcy", "breach", "default", "fail", "failure", "fraud", "lawsuit", "litigation", "recession", "worst"]


def lexicon_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of word, weight (positive or negative) as a lexicon table; unreadable lines are skipped."""
    d = spark.read.csv(path, header=True, schema="word string, weight double", mode="DROPMALFORMED")
    return d.where("word is not null and weight is not null").select(F.lower("word").alias("word"), "weight")
