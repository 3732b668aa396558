"""Query focus: the paragraphs of a document that matter for a query.

Term weights are per document: idf = max(0.1, ln((n - df + 0.5) / (df + 0.5) + 1)) over its own paragraphs.  A row holds
all paragraphs of its document, so everything is computed inside the row by higher-order functions: no explode, no
shuffle, no join back.  Scores are rounded to nine digits, so that equal sums of different order tie.

Null texts have no paragraphs and no view; an empty text is one empty paragraph that matches nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the note that ends an unfocused page.
MISS = "<!-- focus matched nothing; unfocused page shown -->"
SCORED = "array<struct<i:int,p:string,score:double>>"


def _counter(term: str):
    """Occurrences of the term in a lower-cased paragraph."""
    return lambda p: ((F.length(p) - F.length(F.replace(p, F.lit(term), F.lit("")))) / F.lit(len(term))).cast("bigint")


def _let(value: Column, body) -> Column:
    """body of a value that is computed once, however often a filter that is pushed down repeats a column."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def weights(paras: Column, terms: list[str]) -> Column:
    """struct of n, and per term tf_k (an array over the paragraphs) and df_k."""

    def counted(ps: Column) -> Column:
        low = F.transform(ps, lambda p: F.lower(p))
        tf = _let(low, lambda lo: F.struct(*(F.transform(lo, _counter(t)).alias(f"tf_{k}") for k, t in enumerate(terms))))
        df = lambda s, k: F.size(F.filter(s[f"tf_{k}"], lambda x: x > 0)).cast("bigint").alias(f"df_{k}")
        n = F.size(ps).cast("bigint").alias("n")
        return _let(tf, lambda s: F.struct(n, *(s[f"tf_{k}"].alias(f"tf_{k}") for k in range(len(terms))), *(df(s, k) for k in range(len(terms)))))

    return _let(paras, counted)


def scored(paras: Column, terms: list[str]) -> Column:
    """The paragraphs with a positive score: tf * idf with the boosts of headings, bold leads and the first three."""
    every = range(len(terms))

    def idf(w: Column, k: int) -> Column:
        n, df = w["n"].cast("double"), w[f"df_{k}"].cast("double")
        return F.greatest(F.lit(0.1), F.ln((n - df + 0.5) / (df + 0.5) + 1)).alias(f"idf_{k}")

    def found(ps: Column, w: Column) -> Column:
        some = F.lit(False)
        for k in every:
            some = some | (w[f"df_{k}"] > 0)

        def score(g: Column) -> Column:
            def one(p: Column, i: Column) -> Column:
                total: Column = F.lit(0.0)
                for k in every:
                    total = total + F.get(w[f"tf_{k}"], i) * g[f"idf_{k}"]
                start = F.ltrim(p)
                boost = F.when(start.startswith("#"), 2.0).when(start.startswith("**"), 1.5).otherwise(1.0) * F.when(i < 3, 1.1).otherwise(1.0)
                return F.struct(i.alias("i"), p.alias("p"), F.round(total * boost, 9).alias("score"))

            return F.filter(F.transform(ps, one), lambda x: x["score"] > 0)

        return F.when(some, _let(F.struct(*(idf(w, k) for k in every)), score)).otherwise(F.array().cast(SCORED))

    return _let(paras, lambda ps: _let(weights(ps, terms), lambda w: found(ps, w)))


def best(scored: Column, keep: int) -> Column:
    """The best paragraphs by score, then position."""
    order = F.array_sort(F.transform(scored, lambda x: F.struct((-x["score"]).alias("s"), x["i"].alias("i"), x["p"].alias("p"))))
    return F.transform(F.slice(order, 1, keep), lambda x: F.struct(x["i"].alias("i"), x["p"].alias("p"), (-x["s"]).alias("score")))


def view(docs: DataFrame, text: str, paras: Column, terms: list[str], keep: int) -> DataFrame:
    """docs with focused (the chosen paragraphs in page order, or the whole text where nothing matched), missed and kept."""

    def chosen(top: Column) -> Column:
        whole = F.struct(F.col(text).alias("t"), F.lit(True).alias("m"), F.lit(0).cast("bigint").alias("k"))
        joined = F.array_join(F.transform(top, lambda x: x["p"]), "\n\n")
        return F.when(F.size(top) == 0, whole).otherwise(F.struct(joined.alias("t"), F.lit(False).alias("m"), F.size(top).cast("bigint").alias("k")))

    d = docs.withColumn("_v", _let(F.array_sort(best(scored(paras, terms), keep)), chosen))
    return d.select(*docs.columns, F.col("_v.t").alias("focused"), F.col("_v.m").alias("missed"), F.col("_v.k").alias("kept"))
