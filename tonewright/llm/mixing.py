"""Mixing sources to target weights by hierarchical budgeting.

Documents form a tree: domain, then language, then source. A budget of tokens flows down it.
At each node it is divided among the children by weight, but no child gets more than its
subtree can give (its tokens times EPOCHS); what a child cannot take goes to its siblings by
weight, and to an ancestor's other children only when a whole subtree is exhausted. A leaf's
budget is met by a prefix of its tokens over seeded epochs: every epoch visits all documents
of the leaf in an order of its own, and the last document is cut.

Whole numbers of tokens are divided; what rounding leaves goes to siblings that can take it, one
token each, in the order of their names' md5, so equal inputs give equal plans everywhere and no
token of the budget is lost. Children of one weight and size are one row where shares are
found, and the order of names is dealt by its first digits, so a node with very many children
(hosts) is no task of its own. The prefix sums over a leaf are taken in two steps, within and over
ranges of the order of BUCKET tokens, so no task sees a whole leaf.

Cases: null and blank texts have no tokens and are never chosen; null lang or source is a
child of its own; weights of zero or below give nothing, and the tokens under them count neither
as what a subtree can give nor in its siblings' way; a very long text is counted whole and may be
cut anywhere; repeated rows and ids are rows of their own, ordered by id and text hash; rows
without id take their place by their text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

EPOCHS, SEED, BUCKET = 3, 17, 250_000
WORD = r"[^\x20\x09-\x0D]+"
#: Default tree: sources by the last digit of their name, with weights of domains and languages.
DOMAINS = (("web", 5), ("books", 3), ("code", 2))
LANGUAGES = (("en", 4), ("de", 2), ("fr", 2), ("es", 1))
SHARE = (1, 2)  # of the documents' tokens, the budget


def n_tokens(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def default_domain(source: Column) -> Column:
    """web: sources ending in 0 to 4, books: 5 to 7, code: the rest."""
    last = F.right(source, F.lit(1))
    return F.when(last.isin(*"01234"), "web").when(last.isin(*"567"), "books").otherwise("code")


def weight_of(value: Column, weights, other: int = 1) -> Column:
    out = F.lit(other)
    for name, weight in reversed(weights):
        out = F.when(value == name, weight).otherwise(out)
    return out.cast("long")


def pour(children: DataFrame, parent: list[str], key: str) -> DataFrame:
    """children(parent columns, key, weight above 0, cap, budget of the parent) -> the same with ``budget``
    now that of the child. Children fill up in the order of cap / weight: those whose share is
    above their cap get it, and the others divide the rest by weight."""
    children = common.settle(children, "children")  # read three times below
    # Children of one cap and weight fill up together.
    kinds = children.groupBy(*parent, "cap", "weight").agg(F.first("budget").alias("budget"), F.count("*").alias("n"))
    before = Window.partitionBy(*parent).orderBy((F.col("cap") / F.col("weight")), "cap").rowsBetween(Window.unboundedPreceding, -1)
    node = Window.partitionBy(*parent)
    w = kinds.withColumns({"_taken": F.coalesce(F.sum(F.expr("n * cap")).over(before), F.lit(0)), "_used": F.coalesce(F.sum(F.expr("n * weight")).over(before), F.lit(0)), "_all": F.sum(F.expr("n * weight")).over(node)})
    # A child is full if an equal share of what is left, were all before it full, covers it; once one
    # isn't, none after it is.
    w = w.withColumn("_full", F.expr("cap * (_all - _used) <= weight * (budget - _taken)"))
    w = w.withColumn("_full", F.min("_full").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    w = w.withColumns({"_rest": F.col("budget") - F.coalesce(F.sum(F.expr("CASE WHEN _full THEN n * cap END")).over(node), F.lit(0)), "_open": F.sum(F.expr("CASE WHEN NOT _full THEN n * weight END")).over(node)})
    w = w.withColumn("share", F.expr("CASE WHEN _full THEN cap ELSE CAST(weight * _rest DIV _open AS BIGINT) END"))
    w = w.withColumn("over", F.col("_rest") - F.coalesce(F.sum(F.expr("CASE WHEN NOT _full THEN n * share END")).over(node), F.lit(0)))
    told = w.select(*[F.col(c).alias("_" + c) for c in parent], F.col("cap").alias("_cap"), F.col("weight").alias("_weight"), "share", "over", "_full")
    same = " AND ".join(f"{c} <=> _{c}" for c in [*parent, "cap", "weight"])
    done = children.join(told, F.expr(same)).withColumns({"_name": F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), "_slot": F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 2)})
    # Rank of the open children by name: within a slot, then over the 256 slots.
    slots = done.where("NOT _full").groupBy(*parent, "_slot").agg(F.count("*").alias("_n"))
    slots = slots.select(*[F.col(c).alias("_p" + c) for c in parent], F.col("_slot").alias("_s"), F.coalesce(F.sum("_n").over(Window.partitionBy(*parent).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(*parent, "_slot", "_full").orderBy("_name", F.col(key).asc_nulls_first()))
    done = done.withColumn("_rank", rank).join(slots, F.expr(" AND ".join([*(f"{c} <=> _p{c}" for c in parent), "_slot = _s", "NOT _full"])), "left")
    return done.withColumn("budget", F.expr("CAST(share + CASE WHEN NOT _full AND _before + _rank <= over THEN 1 ELSE 0 END AS BIGINT)")).select(*children.columns)


def plan(leaves: DataFrame, budget: Column, epochs: int, domains, languages, sources=()) -> DataFrame:
    """leaves(domain, lang, source, tokens) -> the same with ``budget`` of each leaf that may give any."""
    leaves = leaves.where("tokens > 0").withColumns({"wd": weight_of(F.col("domain"), domains), "wl": weight_of(F.col("lang"), languages), "weight": weight_of(F.col("source"), sources)})
    leaves = leaves.withColumn("cap", F.when(F.expr("wd > 0 AND wl > 0 AND weight > 0"), F.col("tokens") * epochs))
    langs = leaves.groupBy("domain", "lang", "wd", "wl").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    tops = langs.groupBy("domain", "wd").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    root = Window.partitionBy(F.lit(1))  # one row a domain
    tops = tops.withColumns({"tokens": F.sum("tokens").over(root), "_cap": F.sum("cap").over(root)}).withColumn("budget", F.least(budget.cast("long"), "_cap")).where("cap > 0")
    tops = pour(tops.select(F.lit(1).alias("root"), "domain", F.col("wd").alias("weight"), "cap", "budget"), ["root"], "domain").select("domain", "budget")
    langs = pour(langs.where("cap > 0").join(tops, "domain").select("domain", "lang", F.col("wl").alias("weight"), "cap", "budget"), ["domain"], "lang")
    langs = langs.select(F.col("domain").alias("_d"), F.col("lang").alias("_l"), "budget")
    found = leaves.where("cap > 0").join(langs, F.expr("domain = _d AND lang <=> _l")).select("domain", "lang", "source", "tokens", "weight", "cap", "budget")
    return pour(found, ["domain", "lang"], "source").select("domain", "lang", "source", "tokens", "budget")


def mix(docs: DataFrame, share: tuple[int, int] = SHARE, epochs: int = EPOCHS, seed: int = SEED, domain=default_domain, domains=DOMAINS, languages=LANGUAGES, sources=()) -> DataFrame:
    """doc_id, epoch, n_tokens, take_tokens, domain, lang, source, row_hash of all that is chosen.
    Domains, languages and sources that have no weight given weigh 1."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), n_tokens(F.col("text").cast("string")).alias("n_tokens"), F.xxhash64("text").alias("row_hash"), F.coalesce(F.col("doc_id").cast("string"), F.md5(F.col("text").cast("string"))).alias("name")).withColumn("domain", domain(F.col("source")))
    rows = common.settle(rows.where("n_tokens > 0"), "lengths")
    leaf = ["domain", "lang", "source"]
    leaves = rows.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens"))
    budgets = common.settle(plan(leaves, F.col("tokens") * share[0] / share[1], epochs, domains, languages, sources), "budgets")

    budgets = budgets.select(F.col("domain").alias("_d"), F.col("lang").alias("_l"), F.col("source").alias("_s"), "tokens", "budget")
    asked = rows.join(budgets, F.expr("domain = _d AND lang <=> _l AND source <=> _s")).drop("_d", "_l", "_s")
    # Epoch e is needed up to budget - e * tokens.
    asked = asked.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("quota", F.col("budget") - F.col("epoch") * F.col("tokens")).where("quota > 0")
    order = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "epoch", "name")), 1, 8), 16, 10).cast("long")
    asked = asked.withColumn("place", order).drop("name").withColumn("bucket", (F.col("place") / 2.0**32 * F.ceil(F.col("tokens") / BUCKET)).cast("long"))
    key = [*leaf, "epoch"]
    sums = asked.groupBy(*key, "bucket").agg(F.sum("n_tokens").alias("n"))
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = Window.partitionBy(*key, "bucket").orderBy("place", "doc_id", "row_hash").rowsBetween(Window.unboundedPreceding, -1)
    a, b = asked.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("a"), sums.alias("b")
    joined = a.join(b, F.expr("a.domain <=> b.domain AND a.lang <=> b.lang AND a.source <=> b.source AND a.epoch = b.epoch AND a.bucket = b.bucket"))
    done = joined.withColumn("take_tokens", F.least("a.n_tokens", F.col("quota") - F.col("before") - F.col("inside"))).where("take_tokens > 0")
    return done.select("doc_id", F.col("a.epoch").alias("epoch"), "n_tokens", "take_tokens", "a.domain", "a.lang", "a.source", "row_hash")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents")).drop("row_hash")


def select_texts(docs: DataFrame, **options) -> DataFrame:
    """The documents chosen in one epoch, texts cut to their token prefix, with all their columns."""
    own = common.unused(docs)
    key, take, whole, flag = (own + c for c in ("key", "take", "n", "flag"))
    chosen = mix(docs, epochs=1, **options).groupBy(F.xxhash64("doc_id", "row_hash").alias(key)).agg(F.max("take_tokens").alias(take), F.max("n_tokens").alias(whole))
    chosen = common.settle(chosen, "chosen")
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text")))
    # Documents that are taken whole pass by; only the others meet what was chosen.
    rest = common.settle(keyed.select(key).join(chosen.where(F.col(take) == F.col(whole)), key, "left_anti"), "rest")
    sifted = common.sift(keyed, key, common.sieve(rest, key), flag)
    found = sifted.where(F.col(flag)).join(chosen, key)
    ends = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1)), F.lit(1), F.col(take).cast("int")), "")
    cut = found.withColumn("text", F.when(F.col(take) < F.col(whole), ends).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return sifted.where(~F.col(flag)).select(*docs.columns).unionByName(cut.select(*docs.columns))


def _cases(value: str, weights, other: int = 1) -> str:
    return "CASE " + " ".join(f"WHEN {value} = '{n}' THEN {w}" for n, w in weights) + f" ELSE {other} END"


def _pour_sql(name: str, source: str, parent: str, key: str, keep: str) -> str:
    """The same division as ``pour``, for DuckDB."""
    part = f"PARTITION BY {parent} ORDER BY CAST(cap AS DOUBLE) / weight, cap, {key} NULLS FIRST"
    return f"""{name}1 AS (SELECT *, coalesce(sum(cap) OVER a, 0) AS taken, coalesce(sum(weight) OVER a, 0) AS used, sum(weight) OVER (PARTITION BY {parent}) AS everything FROM {source} WHERE cap > 0
      WINDOW a AS ({part} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    {name}2 AS (SELECT *, bool_and(cap * (everything - used) <= weight * (budget - taken)) OVER ({part} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM {name}1),
    {name}3 AS (SELECT *, budget - coalesce(sum(CASE WHEN filled THEN cap END) OVER (PARTITION BY {parent}), 0) AS rest, sum(CASE WHEN NOT filled THEN weight END) OVER (PARTITION BY {parent}) AS open_weight FROM {name}2),
    {name}4 AS (SELECT *, CASE WHEN filled THEN cap ELSE weight * rest // open_weight END AS share, row_number() OVER (PARTITION BY {parent}, filled ORDER BY md5(coalesce({key}, '')), {key} NULLS FIRST) AS place FROM {name}3),
    {name} AS (SELECT {keep}, CAST(share + CASE WHEN NOT filled AND place <= rest - sum(CASE WHEN NOT filled THEN share END) OVER (PARTITION BY {parent}) THEN 1 ELSE 0 END AS BIGINT) AS budget FROM {name}4)"""


ORACLE = f"""
WITH d AS (SELECT doc_id, lang, source, text, CASE WHEN right(source, 1) IN ('0','1','2','3','4') THEN 'web' WHEN right(source, 1) IN ('5','6','7') THEN 'books' ELSE 'code' END AS domain,
      CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS n_tokens FROM documents),
r AS (SELECT * FROM d WHERE n_tokens > 0),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS HUGEINT) AS tokens, CAST(sum(n_tokens) * {EPOCHS} AS HUGEINT) AS cap FROM r GROUP BY ALL),
langs AS (SELECT domain, lang, sum(cap) AS cap FROM leaves GROUP BY ALL),
roots AS (SELECT 1 AS root, domain, sum(cap) AS cap, least((SELECT sum(tokens) * {SHARE[0]} // {SHARE[1]} FROM leaves), (SELECT sum(cap) FROM leaves)) AS budget, {_cases('domain', DOMAINS)} AS weight FROM langs GROUP BY domain),
{_pour_sql('dom', 'roots', 'root', 'domain', 'domain')},
langs0 AS (SELECT l.domain, l.lang, l.cap, dom.budget, {_cases('l.lang', LANGUAGES)} AS weight FROM langs l JOIN dom USING (domain)),
{_pour_sql('lan', 'langs0', 'domain', 'lang', 'domain, lang')},
leaves0 AS (SELECT v.*, lan.budget, 1 AS weight FROM leaves v JOIN lan ON v.domain = lan.domain AND v.lang IS NOT DISTINCT FROM lan.lang),
{_pour_sql('lea', 'leaves0', 'domain, lang', 'source', 'domain, lang, source, tokens')},
asked AS (SELECT r.*, e.epoch, lea.budget - e.epoch * lea.tokens AS quota, md5(concat('{SEED}|', e.epoch, '|', coalesce(CAST(r.doc_id AS VARCHAR), md5(r.text))))[1:8] AS place
  FROM r JOIN lea ON r.domain = lea.domain AND r.lang IS NOT DISTINCT FROM lea.lang AND r.source IS NOT DISTINCT FROM lea.source, (SELECT unnest(range({EPOCHS})) AS epoch) e WHERE lea.budget > e.epoch * lea.tokens),
cut AS (SELECT *, least(n_tokens, quota - coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY place, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS take FROM asked)
SELECT doc_id, CAST(epoch AS INT) AS epoch, n_tokens, CAST(take AS BIGINT) AS take_tokens, domain, lang, source FROM cut WHERE take > 0
"""
