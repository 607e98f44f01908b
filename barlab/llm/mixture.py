"""Mixing sources to target weights by hierarchical budgeting.

A tree of domains, languages and sources gets a token budget. From the root down, a node's
budget goes to its children in proportion to their weights; a child whose whole subtree
cannot use its share is filled up and the rest goes to its siblings, so that a shortage
reaches an ancestor's siblings only when all of a node's own children are full. A leaf can
give its tokens ``max_epochs`` times. Whole epochs of a leaf's budget repeat all its
documents, and the rest is a prefix of tokens of one more epoch in its seeded order.

All of it is DataFrame work in whole numbers: allocation is a window over the children of
a node, and a prefix is summed over hash ranges of a leaf first and inside them after, so
that no task holds a leaf.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.llm.common import by_id, staged, table

NONE = "(none)"


@dataclass(frozen=True)
class Tree:
    """The domain of each source, and the weights of domains, languages and sources among
    their siblings; names that are not listed weigh 1, other sources are in ``rest``."""

    domains: dict[str, list[str]]
    rest: str = "reference"
    domain_weights: dict[str, int] = field(default_factory=dict)
    lang_weights: dict[str, int] = field(default_factory=dict)
    source_weights: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        weights = [w for part in (self.domain_weights, self.lang_weights, self.source_weights) for w in part.values()]
        if any(type(w) is not int or w <= 0 for w in weights):
            raise ValueError("weights are whole numbers over 0")
        if len({s for names in self.domains.values() for s in names}) < sum(map(len, self.domains.values())):
            raise ValueError("a source is in one domain")


# Fixed values of the registered query: domains of sources, and weights (others weigh 1).
DOMAINS = {"web": ["src0", "src1", "src2", "src3", "src4"], "books": ["src5", "src6", "src7", "src8", "src9"], "forum": ["src10", "src11", "src12", "src13", "src14"]}
REST = "reference"
DOMAIN_WEIGHTS = {"web": 4, "books": 3, "forum": 2}
LANG_WEIGHTS = {"en": 5, "de": 3, "fr": 2}
SOURCE_WEIGHTS = {"src0": 2, "src5": 3, "src10": 2}
TARGETS = Tree(DOMAINS, REST, DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS)
BINS = 3  # leading hex digits of the order hash that name a range


def tokens_of(text: Column) -> Column:
    """Words apart by ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def chosen(column: str, options: dict, rest) -> Column:
    out = F.lit(rest)
    for name, value in options.items():
        out = F.when(F.col(column) == name, F.lit(value)).otherwise(out)
    return out


def domain_of(tree: Tree, column: str = "source") -> Column:
    return chosen(column, {s: d for d, names in tree.domains.items() for s in names}, tree.rest)


def divide(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Adds ``budget`` to children (parent..., child, weight, cap, parent_budget): each its
    cap or its share of what those that fill up leave. Tokens that the division leaves over
    go to the first of the others, by name, one each; these have room for it."""
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), child)
    whole = Window.partitionBy(*parent)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    c = children.withColumn("_cap", F.coalesce(F.sum("cap").over(before), F.lit(0)))
    c = c.withColumn("_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    c = c.withColumn("_full", F.col("cap") * F.col("_weight") <= (F.col("parent_budget") - F.col("_cap")) * F.col("weight"))
    used = F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(whole), F.lit(0))
    left = F.coalesce(F.sum(F.when(~F.col("_full"), F.col("weight"))).over(whole), F.lit(1))
    c = c.withColumn("_used", used).withColumn("_left", left)
    c = c.withColumn("_share", F.when(~F.col("_full"), F.expr("((parent_budget - _used) * weight) div _left")))
    c = c.withColumn("_over", F.col("parent_budget") - F.col("_used") - F.coalesce(F.sum("_share").over(whole), F.lit(0)))
    c = c.withColumn("_place", F.row_number().over(Window.partitionBy(*parent).orderBy("_full", child)))
    budget = F.when(F.col("_full"), F.col("cap")).otherwise(F.col("_share") + F.when(F.col("_place") <= F.col("_over"), 1).otherwise(0))
    return c.withColumn("budget", budget).drop("_cap", "_weight", "_full", "_used", "_left", "_share", "_over", "_place")


def leaf_budgets(supply: DataFrame, *, share: int, max_epochs: int, tree: Tree = TARGETS) -> DataFrame:
    """(domain, lang, source, tokens, budget) from the leaves' tokens and weights. The root
    has ``share`` hundredths of all tokens, or all that the leaves can give."""
    leaves = supply.withColumn("cap", F.col("tokens") * max_epochs)
    domains = leaves.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens")).withColumn("weight", chosen("domain", tree.domain_weights, 1)).withColumn("_one", F.lit(1))
    root = Window.partitionBy("_one")  # of a row for each domain
    domains = domains.withColumn("_all", F.least(F.sum("tokens").over(root) * share, F.sum("cap").over(root) * 100)).withColumn("parent_budget", F.expr("_all div 100"))
    domains = divide(domains, ["_one"], "domain")
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).withColumn("weight", chosen("lang", tree.lang_weights, 1))
    langs = divide(langs.join(domains.select("domain", F.col("budget").alias("parent_budget")), "domain"), ["domain"], "lang")
    sources = leaves.withColumn("weight", chosen("source", tree.source_weights, 1))
    sources = sources.join(langs.select("domain", "lang", F.col("budget").alias("parent_budget")), ["domain", "lang"])
    return divide(sources, ["domain", "lang"], "source").select("domain", "lang", "source", "tokens", "budget")


def mix(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", seed: int = 7, share: int = 60, max_epochs: int = 2, tree: Tree = TARGETS) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, copies, part_tokens) for each row.

    ``copies`` whole epochs take the document, and ``part_tokens`` tokens from its start
    belong to the last, partial epoch: all of them for documents inside the prefix, fewer
    for the one that it ends in, none behind it. A null language or source is a branch of
    its own, a null text has no tokens, null ids share one place in the order, and rows
    that repeat an id count one by one. Each leaf's budget is met to the token, and the
    leaves' budgets sum to the root's. The leaves' supplies are one row each.
    """
    docs = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col), F.lit(NONE)).alias("lang"), F.coalesce(F.col(source_col), F.lit(NONE)).alias("source"), tokens_of(F.col(text_col)).alias("n_tokens"))
    docs, _ = staged(docs.withColumn("domain", domain_of(tree)), "mixed")
    leaf = ["domain", "lang", "source"]
    budgets = leaf_budgets(docs.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens")), share=share, max_epochs=max_epochs, tree=tree)
    plan = budgets.select(*leaf, F.expr("if(tokens > 0, budget div tokens, 0)").alias("copies"), F.expr("if(tokens > 0, budget % tokens, 0)").alias("rest"))
    plan, _ = staged(plan, "budgets")
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("copies").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(NONE))))
    rows = docs.join(plan, leaf).withColumn("h", order).withColumn("bin", F.substring("h", 1, BINS))
    bins = rows.groupBy(*leaf, "bin").agg(F.sum("n_tokens").alias("b"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(*leaf, "bin", F.coalesce(F.sum("b").over(earlier(Window.partitionBy(*leaf).orderBy("bin"))), F.lit(0)).alias("base"))
    inner = F.sum("n_tokens").over(earlier(Window.partitionBy(*leaf, "bin").orderBy("h", "n_tokens")))
    rows = rows.withColumn("inner", F.coalesce(inner, F.lit(0))).join(bins, [*leaf, "bin"])
    part = F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("rest") - F.col("base") - F.col("inner")))
    return rows.select("doc_id", *leaf, "n_tokens", F.col("copies").cast("bigint").alias("copies"), part.cast("bigint").alias("part_tokens"))


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The rows of ``documents`` that the mixture of one epoch uses, with all their columns;
    a document that the token prefix ends in stays whole. Rows that repeat an id stay if
    one of them does; rows of null ids stay."""
    plan = mix(documents, max_epochs=1, **options)
    gone = plan.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("n_tokens") * F.col("copies") + F.col("part_tokens")).alias("used"), F.max("n_tokens").alias("size"))
    gone, _ = staged(gone.filter("used = 0 and size > 0").select("doc_id"), "unused")
    return by_id(documents, gone, "doc_id", "left_anti").select(documents.columns)


def op2_mixture(spark, sf_dir: str) -> DataFrame:
    """Every document's part in a mixture of 60 hundredths of all tokens."""
    return mix(table(spark, sf_dir, "documents"))


def _case(column: str, options: dict, rest: str) -> str:
    quoted = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {' '.join(f"WHEN {column} = '{k}' THEN {quoted(v)}" for k, v in options.items())} ELSE {rest} END"


def _divide_sql(name: str, children: str, parent: str, child: str) -> str:
    return f"""{name}_a AS (SELECT *, coalesce(sum(cap) OVER o, 0) AS c0, sum(weight) OVER (PARTITION BY {parent}) - coalesce(sum(weight) OVER o, 0) AS w0
    FROM ({children}) WINDOW o AS (PARTITION BY {parent} ORDER BY cap / weight, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_b AS (SELECT *, cap * w0 <= (pb - c0) * weight AS full_up FROM {name}_a),
{name}_c AS (SELECT *, pb - coalesce(sum(cap) FILTER (full_up) OVER (PARTITION BY {parent}), 0) AS free, coalesce(sum(weight) FILTER (NOT full_up) OVER (PARTITION BY {parent}), 1) AS w1 FROM {name}_b),
{name} AS (SELECT *, CASE WHEN full_up THEN cap ELSE (free * weight) // w1 + CASE WHEN row_number() OVER (PARTITION BY {parent} ORDER BY full_up, {child})
    <= free - coalesce(sum((free * weight) // w1) FILTER (NOT full_up) OVER (PARTITION BY {parent}), 0) THEN 1 ELSE 0 END END AS budget FROM {name}_c)"""


OP2_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '{NONE}') AS lang, coalesce(source, '{NONE}') AS source,
           {_case("coalesce(source, '(none)')", {s: d for d, names in DOMAINS.items() for s in names}, f"'{REST}'")} AS domain,
           coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, sum(n_tokens) * 2 AS cap FROM d GROUP BY ALL),
root AS (SELECT least(sum(tokens) * 60, sum(cap) * 100) // 100 AS pb FROM leaf),
{_divide_sql("dom", f"SELECT domain, sum(cap) AS cap, {_case('domain', DOMAIN_WEIGHTS, '1')} AS weight, 1 AS one, (SELECT pb FROM root) AS pb FROM leaf GROUP BY domain", "one", "domain")},
{_divide_sql("lng", f"SELECT l.domain, l.lang, sum(l.cap) AS cap, {_case('l.lang', LANG_WEIGHTS, '1')} AS weight, any_value(dom.budget) AS pb FROM leaf l JOIN dom USING (domain) GROUP BY l.domain, l.lang", "domain", "lang")},
{_divide_sql("src", f"SELECT l.domain, l.lang, l.source, l.tokens, l.cap, {_case('l.source', SOURCE_WEIGHTS, '1')} AS weight, lng.budget AS pb FROM leaf l JOIN lng ON l.domain = lng.domain AND l.lang = lng.lang", "domain, lang", "source")},
r AS (SELECT d.*, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS copies, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest
      FROM d JOIN src USING (domain, lang, source)),
o AS (SELECT *, md5('7:' || copies::BIGINT || ':' || coalesce(doc_id::VARCHAR, '{NONE}')) AS h FROM r),
b AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o)
SELECT doc_id, domain, lang, source, n_tokens, copies::BIGINT AS copies, greatest(0, least(n_tokens, rest - before))::BIGINT AS part_tokens FROM b
"""
