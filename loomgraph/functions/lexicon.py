"""The domain dictionary: labels, canonical names and aliases, as rows and patterns."""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import automaton

# Closed label and relation registries of the property graph.
NODE_LABELS = [
    "Chunk", "DocPage", "ExampleNotebook", "TestCase", "PythonModule", "PythonClass", "PythonFunction", "Parameter", "PortfolioMethod",
    "RiskMeasure", "ConstraintType", "Estimator", "ReportType", "PlotType", "Solver", "Concept", "AssetClass", "FactorModel", "MarketRegime",
    "BenchmarkIndex", "BacktestScenario", "OptimizationProblem",
]
RELATION_TYPES = [
    "HAS_CHUNK", "MENTIONS", "DESCRIBES", "DEMONSTRATES", "VALIDATES", "IMPLEMENTS", "DECLARES", "HAS_PARAMETER", "USES", "SUPPORTS_RISK_MEASURE",
    "SUPPORTS_CONSTRAINT", "USES_ESTIMATOR", "PRODUCES_REPORT", "RELATED_TO", "IS_SUBTYPE_OF", "ALTERNATIVE_TO", "REQUIRES", "PARAMETERIZED_BY",
    "BENCHMARKED_ON", "CALIBRATED_ON", "PRECEDES", "HAS_CONSTRAINT", "VALIDATED_AGAINST",
]


class Entry(NamedTuple):
    label: str
    canonical: str
    aliases: tuple[str, ...]


# Label, canonical name, aliases.
DOMAIN = [
    Entry("PortfolioMethod", "Hierarchical Risk Parity", ("hierarchical risk parity", "hrp",)),
    Entry("PortfolioMethod", "Hierarchical Equal Risk Contribution", ("hierarchical equal risk contribution", "herc",)),
    Entry("PortfolioMethod", "Nested Clustered Optimization", ("nested clustered optimization", "nco",)),
    Entry("PortfolioMethod", "Risk Parity", ("risk parity", "risk budgeting",)),
    Entry("PortfolioMethod", "Black Litterman", ("black litterman",)),
    Entry("PortfolioMethod", "Mean-Variance Optimization", ("mean variance", "mean-variance",)),
    Entry("PortfolioMethod", "Minimum Variance", ("minimum variance",)),
    Entry("PortfolioMethod", "Maximum Sharpe", ("maximum sharpe",)),
    Entry("PortfolioMethod", "Kelly Criterion", ("kelly criterion",)),
    Entry("RiskMeasure", "CVaR", ("cvar", "conditional value at risk", "conditional var", "expected shortfall", "es", "cvar95", "cvar99",)),
    Entry("RiskMeasure", "VaR", ("value at risk", "var", "value-at-risk", "var95", "var99",)),
    Entry("RiskMeasure", "Semi Deviation", ("semi deviation", "semi standard deviation", "semi-std", "semidev", "downside deviation",)),
    Entry("RiskMeasure", "Semi Variance", ("semi variance", "semivariance",)),
    Entry("RiskMeasure", "MAD", ("mean absolute deviation", "mad",)),
    Entry("RiskMeasure", "Ulcer Index", ("ulcer index",)),
    Entry("RiskMeasure", "EVaR", ("entropic value at risk", "evar",)),
    Entry("RiskMeasure", "EDaR", ("entropic drawdown at risk", "edar",)),
    Entry("RiskMeasure", "RLVaR", ("relativistic value at risk", "rlvar",)),
    Entry("RiskMeasure", "RLDaR", ("relativistic drawdown at risk", "rldar",)),
    Entry("RiskMeasure", "Tail Gini", ("tail gini",)),
    Entry("FactorModel", "Fama-French 3 Factor", ("fama french 3", "fama-french 3", "ff3",)),
    Entry("FactorModel", "Fama-French 5 Factor", ("fama french 5", "fama-french 5", "ff5",)),
    Entry("FactorModel", "Carhart 4 Factor", ("carhart", "carhart 4",)),
    Entry("FactorModel", "Macroeconomic Factor Model", ("macroeconomic factor", "macro factor",)),
    Entry("FactorModel", "Statistical PCA Factor", ("statistical pca", "pca factor model",)),
    Entry("AssetClass", "Equity", ("equity", "equities", "stocks",)),
    Entry("AssetClass", "Fixed Income", ("fixed income", "bonds", "debt",)),
    Entry("AssetClass", "Commodity", ("commodity", "commodities",)),
    Entry("AssetClass", "Alternatives", ("alternatives", "alternative investments", "alts",)),
    Entry("AssetClass", "Cash", ("cash", "money market",)),
    Entry("MarketRegime", "Bull Market", ("bull market", "bull", "uptrend",)),
    Entry("MarketRegime", "Bear Market", ("bear market", "bear", "downtrend",)),
    Entry("MarketRegime", "High Volatility", ("high volatility", "high vol", "volatility regime",)),
    Entry("MarketRegime", "Low Correlation", ("low correlation", "decorrelated", "diversification regime",)),
    Entry("ConstraintType", "Budget Constraint", ("budget constraint",)),
    Entry("ConstraintType", "Turnover Constraint", ("turnover constraint",)),
    Entry("ConstraintType", "Tracking Error Constraint", ("tracking error constraint",)),
    Entry("ConstraintType", "Leverage Constraint", ("leverage constraint",)),
    Entry("ConstraintType", "Long-Only Constraint", ("long only", "long-only",)),
    Entry("ConstraintType", "Short-Selling Constraint", ("short selling", "short-selling",)),
    Entry("ConstraintType", "Cardinality Constraint", ("cardinality constraint",)),
    Entry("ConstraintType", "Risk Contribution Constraint", ("risk contribution constraint",)),
    Entry("ConstraintType", "Factor Exposure Constraint", ("factor exposure", "factor constraint",)),
    Entry("Estimator", "Historical Estimator", ("historical estimates", "historical estimator",)),
    Entry("Estimator", "EWMA", ("ewma",)),
    Entry("Estimator", "Ledoit-Wolf", ("ledoit wolf", "ledoit-wolf",)),
    Entry("Estimator", "OAS", ("oas",)),
    Entry("Estimator", "Shrinkage", ("shrinkage estimator", "shrinkage",)),
    Entry("Estimator", "Stepwise Regression", ("stepwise regression",)),
    Entry("Estimator", "Principal Components", ("principal components", "pcr",)),
    Entry("ReportType", "Performance Report", ("performance report",)),
    Entry("ReportType", "Risk Report", ("risk report",)),
    Entry("ReportType", "Portfolio Report", ("portfolio report",)),
    Entry("ReportType", "Allocation Report", ("allocation report",)),
    Entry("PlotType", "Efficient Frontier Plot", ("efficient frontier",)),
    Entry("PlotType", "Dendrogram Plot", ("dendrogram",)),
    Entry("PlotType", "Network Plot", ("network plot", "asset network",)),
    Entry("PlotType", "Risk Contribution Plot", ("risk contribution plot",)),
    Entry("PlotType", "Pie Chart", ("pie chart",)),
    Entry("PlotType", "Bar Chart", ("bar chart",)),
    Entry("PlotType", "Histogram", ("histogram",)),
    Entry("Solver", "CVXPY", ("cvxpy",)),
    Entry("Solver", "MOSEK", ("mosek",)),
    Entry("Solver", "ECOS", ("ecos",)),
    Entry("Solver", "OSQP", ("osqp",)),
    Entry("Solver", "SCS", ("scs",)),
    Entry("Solver", "Clarabel", ("clarabel",)),
]

# Label, sibling, sibling.
SIBLINGS = [
    ("RiskMeasure", "CVaR", "VaR"),
    ("RiskMeasure", "EVaR", "CVaR"),
    ("RiskMeasure", "EDaR", "RLDaR"),
    ("PortfolioMethod", "Hierarchical Risk Parity", "Hierarchical Equal Risk Contribution"),
    ("PortfolioMethod", "Mean-Variance Optimization", "Minimum Variance"),
    ("PortfolioMethod", "Mean-Variance Optimization", "Maximum Sharpe"),
]

# A small dictionary of frequent words, for corpora of other domains.
COMMON = [
    Entry("Determiner", "The", ("the",)),
    Entry("Determiner", "Demonstrative", ("that", "this",)),
    Entry("Conjunction", "And", ("and",)),
    Entry("Preposition", "For", ("for",)),
    Entry("Preposition", "With", ("with", "from", "with this",)),
    Entry("Copula", "Be", ("was", "are",)),
]


def alias_pattern(aliases: Iterable[str]) -> str:
    """Java pattern of any alias as a whole word; its spaces match runs of space, - and _."""
    parts = ["[\\s\\-_]+".join(re.escape(w) for w in a.lower().split(" ")) for a in aliases]
    return f"(?i)(?<![a-z0-9])(?:{'|'.join(parts)})(?![a-z0-9])"


def mentions(text: Column, lexicon: list[Entry]) -> Column:
    """array<struct<label, canonical>>: which entries a text mentions (by alias_pattern's rules), sorted.

    One automaton finds all aliases in one pass over the text: no join and no shuffle.
    """
    return automaton.mentions(text, tuple((e.label, e.canonical, e.aliases) for e in lexicon))


def taxonomy(spark: SparkSession, lexicon: list[Entry], siblings: list[tuple[str, str, str]]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the dictionary: subtypes, and siblings in both directions."""
    table = spark.createDataFrame([(e.label, e.canonical) for e in lexicon], "label string, canonical string")
    nodes = table.select("label", F.col("label").alias("name")).union(table.select("label", F.col("canonical"))).distinct()
    up = table.select(F.col("label").alias("src_label"), F.col("canonical").alias("src_name"), F.lit("IS_SUBTYPE_OF").alias("rel"), F.col("label").alias("dst_label"), F.col("label").alias("dst_name"))
    if not siblings:
        return nodes, up.distinct()
    pairs = spark.createDataFrame(siblings, "label string, a string, b string")
    both = pairs.union(pairs.select("label", "b", "a"))
    return nodes, up.union(both.select("label", "a", F.lit("ALTERNATIVE_TO"), "label", "b")).distinct()
