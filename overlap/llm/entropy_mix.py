"""Mixing sources to target weights by entropy balancing.

Sources sorted by code point (null last) weigh 3, 1, 2, repeating, and share ``share`` of all
words; a target stops at ``cap`` times its source's words and the excess is shared anew by
weight. Document rates minimise the bounded relative entropy to one copy, subject to one token
constraint for each source. The solution is the exponential tilt
``rate = cap / (1 + exp(-lambda_source * words / mean words))`` (cap 2 keeps the base rate 1 at
lambda 0), whose lambdas are the root of the convex dual's gradient. Newton iterations run as
Spark aggregates over the table of (source, words, documents): gradient and curvature of all
sources come from one pass, and a bracket guards each step.

Rates become copies per (source, words) class: every document gets the whole part, and the
classes' fractional parts are rounded from long to short documents with the error carried on,
so a source's total ends within about its shortest documents of the target. Which documents of
a class get the extra copy follows a hash of the id; classes are ranked in salted parts.

Defined cases: a null text has size 0 and takes 0; repeated rows are documents of their own;
a source without words has target 0; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from overlap.llm.common import WORD, documents_of, staged, text_hash

WEIGHTS = (3, 1, 2)
SALTS = 256
MAX_NEWTON = 60
FIXED = 1e6


def targets(sizes: list[tuple[str | None, int]], share: float = 1.5, cap: float = 2.0
            ) -> dict[str | None, float]:
    """Target words of each source (a short list: one row for each source)."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: float(WEIGHTS[i % len(WEIGHTS)]) for i, (s, _) in enumerate(order)}
    size = dict(order)
    rest, open_, out = share * sum(size.values()), set(size), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if rest * weight[s] / total >= cap * size[s]]
        if not full:
            return out | {s: rest * weight[s] / total for s in open_}
        for s in full:
            out[s] = cap * size[s]
        rest -= sum(out[s] for s in full)
        open_ -= set(full)
    return out


def _fixed_sum(term: Column) -> Column:
    """A sum in fixed point: the same in whatever order the rows come, so reruns agree."""
    return F.sum((term * FIXED).cast("decimal(30,0)")).cast("double") / FIXED


def _solve(classes: DataFrame, sources: list[dict], cap: float) -> None:
    """Sets ``lam`` (None: the cap) of every source by guarded Newton steps on the dual."""
    spark = classes.sparkSession
    for s in sources:
        s.update(lam=0.0, lo=-math.inf, hi=math.inf,
                 done=s["target"] >= cap * s["size"] * (1 - 1e-12))
        if s["done"]:
            s["lam"] = None
    for _ in range(MAX_NEWTON):
        todo = {s["sid"]: s for s in sources if not s["done"]}
        if not todo:
            return
        lam = spark.createDataFrame([(k, s["lam"], s["mean"]) for k, s in todo.items()],
                                    "sid int, lam double, mean double")
        x = F.col("words") / F.col("mean")
        rate = F.lit(cap) / (1 + F.exp(-F.col("lam") * x))
        sums = (classes.join(F.broadcast(lam), "sid")  # a row for each source
                .withColumns({"x": x, "rate": rate})
                .groupBy("sid").agg(
                    _fixed_sum(F.col("n") * F.col("words") * F.col("rate")).alias("got"),
                    _fixed_sum(F.col("n") * F.col("words") * F.col("x") * F.col("rate")
                               * (1 - F.col("rate") / cap)).alias("slope")))
        for r in sums.collect():
            s = todo[r["sid"]]
            gap = r["got"] - s["target"]
            if abs(gap) <= 1e-7 * max(1.0, s["target"]):
                s["done"] = True
                continue
            s["hi" if gap > 0 else "lo"] = s["lam"]
            step = s["lam"] - gap / r["slope"] if r["slope"] > 0 else math.nan
            if not s["lo"] < step < s["hi"]:
                if math.isinf(s["lo"]) or math.isinf(s["hi"]):
                    step = s["lam"] + math.copysign(max(1.0, abs(s["lam"])), -gap)
                else:
                    step = (s["lo"] + s["hi"]) / 2
            s["lam"] = step


def _round_classes(rows: pd.DataFrame) -> pd.DataFrame:
    """Extra copies of each class of one source; a row for each distinct word count."""
    rows = rows.sort_values("words", ascending=False)
    carry, extra = 0.0, []
    for words, n, frac in zip(rows["words"], rows["n"], rows["frac"]):
        due = n * frac
        e = due + (carry / words if words else 0.0)
        e = int(min(n, max(0, math.floor(e + 0.5))))
        carry += (due - e) * words
        extra.append(e)
    return rows.assign(extra=extra)[["sid", "words", "whole", "extra"]]


def entropy_mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the rate and copies behind them."""
    spark = docs.sparkSession
    if cap != int(cap):
        raise ValueError("cap must be a whole number of copies")
    sized = staged(documents_of(docs, "source").select(
        "doc_id", F.col("source").cast("string").alias("source"), text_hash().alias("text_hash"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("words")),
        "mix-sizes")
    totals = [(r["source"], r["size"], r["n"]) for r in sized.groupBy("source").agg(
        F.sum("words").alias("size"), F.count("*").alias("n")).collect()]  # a row a source
    goal = targets([(s, w) for s, w, _ in totals], share, cap)
    sources = [{"sid": i, "source": s, "size": w, "mean": max(1.0, w / n), "target": goal[s]}
               for i, (s, w, n) in enumerate(sorted(totals, key=lambda t: (t[0] is None, t[0] or "")))]
    ids = spark.createDataFrame([(s["source"], s["sid"]) for s in sources], "source string, sid int")
    # salted classes: documents of a source with as many words, by a hash of the row
    salted = (sized.join(F.broadcast(ids.withColumnRenamed("source", "src")),
                         F.col("source").eqNullSafe(F.col("src")))
              .withColumn("u", F.xxhash64(F.lit(11), "doc_id", "text_hash"))
              .select("doc_id", "text_hash", "sid", "words", "u", F.pmod("u", F.lit(SALTS)).cast("int").alias("salt")))
    parts = staged(salted.groupBy("sid", "words", "salt").agg(F.count("*").alias("n")), "mix-parts")
    classes = staged(parts.groupBy("sid", "words").agg(F.sum("n").alias("n")), "mix-classes")
    _solve(classes, sources, cap)
    solved = spark.createDataFrame(
        [(s["sid"], s["size"], s["target"], s["lam"], s["mean"]) for s in sources],
        "sid int, source_size long, target double, lam double, mean double")
    rate = F.when(F.col("lam").isNull(), F.lit(float(cap))).otherwise(
        F.lit(cap) / (1 + F.exp(-F.col("lam") * F.col("words") / F.col("mean"))))
    whole = F.least(F.floor("rate"), F.lit(int(cap))).cast("int")
    # one group holds a row for each distinct word count of a source, not its documents
    copies = (classes.join(F.broadcast(solved.select("sid", "lam", "mean")), "sid")
              .withColumn("rate", rate).withColumn("whole", whole)
              .select("sid", "words", "n", "whole", (F.col("rate") - F.col("whole")).alias("frac"))
              .groupBy("sid").applyInPandas(_round_classes,
                                            "sid int, words long, whole int, extra long"))
    before = Window.partitionBy("sid", "words").orderBy("salt").rowsBetween(
        Window.unboundedPreceding, -1)
    quota = (parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
             .join(copies, ["sid", "words"])
             .select("sid", "words", "salt", "whole", (F.col("extra") - F.col("before")).alias("left")))
    rank = F.row_number().over(Window.partitionBy("sid", "words", "salt").orderBy(
        "u", "doc_id", "text_hash"))
    return (salted.withColumn("rank", rank).join(quota, ["sid", "words", "salt"])
            .withColumn("copies", F.col("whole") + (F.col("rank") <= F.col("left")).cast("int"))
            .join(F.broadcast(solved), "sid")
            .withColumn("rate", rate)
            .select("doc_id", F.col("words").alias("size"), "source_size", "target",
                    (F.col("words") * F.col("copies")).alias("taken"), "copies", "rate",
                    "text_hash"))


def op10_entropy_mix(spark, sf_dir: str) -> DataFrame:
    return entropy_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
