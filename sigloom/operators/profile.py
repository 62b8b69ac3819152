"""Column profiles, personal data and pattern scans, anomaly scores and type inference.

A profile of many columns is one aggregate over one scan; quartiles and distinct
counts are exact, and no task gathers a column's values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.functions import patterns as pt
from sigloom.functions.numbers import col


def long_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value): one row a cell, as text."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("e")).select("e.*")


#: Parts of a column in one of which a sketch places a quantile.
SKETCH = 10_000


def quantiles(df: DataFrame, columns: list[str], at: tuple[float, ...] = (0.25, 0.75)) -> dict[str, list[float | None]]:
    """Exact quantiles by column, interpolated between neighbours; nulls don't count.

    A sketch tells two values that surely lie about each quantile; one more scan
    counts what is below them, and only values between them are told apart.
    """
    v = {c: F.col(c).cast("double") for c in columns}
    margin, names = 2.0 / SKETCH, [f"c{i}" for i in range(len(columns))]
    shares = [min(max(p + d, 0.0), 1.0) for p in at for d in (-margin, margin)]
    sketch = df.agg(*[F.struct(F.percentile_approx(v[c], shares, SKETCH).alias("s"), F.min(v[c]).alias("lo"), F.max(v[c]).alias("hi"), F.count(v[c]).alias("n")).alias(a) for a, c in zip(names, columns)]).first()
    out: dict[str, list[float | None]] = {c: [None] * len(at) for c in columns}
    open_ = []  # column, place among the quantiles, ranks wanted, bounds
    for a, c in zip(names, columns):
        n = sketch[a]["n"]
        for j, p in enumerate(at if n else ()):
            lo, hi = (sketch[a]["lo"] if p <= margin else sketch[a]["s"][2 * j]), (sketch[a]["hi"] if p >= 1 - margin else sketch[a]["s"][2 * j + 1])
            open_.append((c, j, p * (n - 1), lo, hi, sketch[a]["lo"], sketch[a]["hi"]))
    while open_:
        inside = [F.struct(F.lit(i).alias("i"), v[c].alias("v")) for i, (c, _, _, lo, hi, _, _) in enumerate(open_)]
        near = reduce(lambda a, b: a | b, [v[c].between(lo, hi) for c, _, _, lo, hi, _, _ in open_])
        cells = df.filter(near).select(F.explode(F.filter(F.array(*[F.when(v[c].between(lo, hi), s) for s, (c, _, _, lo, hi, _, _) in zip(inside, open_)]), lambda x: x.isNotNull())).alias("x")).select("x.i", "x.v")
        below = df.agg(*[F.count_if(v[c] < lo).alias(f"b{i}") for i, (c, _, _, lo, _, _, _) in enumerate(open_)]).first()
        counts = cells.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy("i").orderBy("v")
        spread = counts.withColumn("end", F.sum("n").over(w))
        # the values at two neighbouring ranks of each
        want = spread.sparkSession.createDataFrame([(i, int(r) - below[f"b{i}"], min(int(r) + (r > int(r)), int(r) + 1) - below[f"b{i}"]) for i, (_, _, r, _, _, _, _) in enumerate(open_)], "i int, p long, q long")
        hit = lambda k: F.max(F.when((F.col(k) >= F.col("end") - F.col("n")) & (F.col(k) < F.col("end")), F.col("v")))
        found = {r["i"]: r for r in spread.join(F.broadcast(want), "i").groupBy("i").agg(hit("p").alias("p"), hit("q").alias("q")).collect()}
        again = []
        for i, (c, j, r, lo, hi, least, most) in enumerate(open_):
            if (x := found.get(i)) and x["p"] is not None and x["q"] is not None:
                out[c][j] = x["p"] + (x["q"] - x["p"]) * (r - int(r))
            elif (lo, hi) != (least, most):
                again.append((c, j, r, least, most, least, most))  # the sketch erred: the whole column
        open_ = again
    return out


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, is_numeric, is_identifier, row_count, null_percent, unique_count, unique_percent, outlier_count, skewness, kurtosis).

    Kurtosis is raw (3 for the normal distribution); outliers lie beyond 1.5
    times the distance of the quartiles.
    """
    types = dict(df.dtypes)
    numeric = [c for c in columns if types[c].split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")]
    quart = quantiles(df, numeric) if numeric else {}
    one = []
    for c in columns:
        num = c in numeric
        v, q = F.col(c).cast("double"), [F.lit(x).cast("double") for x in quart[c]] if num else None
        spread = (q[1] - q[0]) * 1.5 if num else None
        out = F.count_if((v < q[0] - spread) | (v > q[1] + spread)) if num else F.lit(0).cast("long")
        null = F.lit(None).cast("double")
        one.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(num).alias("is_numeric"),
                F.count(F.lit(1)).alias("row_count"),
                (F.count_if(F.col(c).isNull()) / F.count(F.lit(1)) * 100).alias("null_percent"),
                out.alias("outlier_count"),
                (F.skewness(v) if num else null).alias("skewness"),
                ((F.kurtosis(v) + 3) if num else null).alias("kurtosis"),
            )
        )
    base = df.agg(F.array(*one).alias("e")).select(F.explode("e").alias("e")).select("e.*")
    each = [df.select(F.col(c).alias("v")).filter("v is not null").distinct().agg(F.count(F.lit(1)).alias("u")).select(F.lit(c).alias("column"), "u") for c in columns]
    unique = reduce(DataFrame.unionByName, each)
    out = base.join(unique, "column", "left").withColumn("unique_count", F.coalesce("u", F.lit(0)))
    out = out.withColumn("unique_percent", F.when(F.col("row_count") > 0, F.col("unique_count") / F.col("row_count") * 100).otherwise(0.0))
    out = out.withColumn("is_identifier", F.lower("column").rlike("(^|_)(id|key|uuid)$|key$"))
    return out.select("column", "is_numeric", "is_identifier", "row_count", "null_percent", "unique_count", "unique_percent", "outlier_count", "skewness", "kurtosis")


WEIGHTS = {"null_score": 0.20, "outlier_score": 0.25, "distribution_score": 0.20, "cardinality_score": 0.15, "schema_score": 0.20}
LABELS = [(0.1, "excellent"), (0.25, "good"), (0.4, "fair"), (0.6, "poor"), (0.8, "bad")]


def anomaly_scores(profile: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, five component scores, overall, label, recommendations) from a column profile: one aggregate."""
    one = lambda c: F.least(F.lit(1.0), c)
    n = F.count(F.lit(1))
    part = lambda cond: F.count_if(cond) / n
    null = one(F.avg("null_percent") / 100 * 0.3 + F.max("null_percent") / 100 * 0.4 + part(F.col("null_percent") > 20) * 0.3)
    ratio = F.when(F.col("is_numeric") & (F.col("outlier_count") > 0) & (F.col("row_count") > 0), F.col("outlier_count") / F.col("row_count"))
    numeric = F.count_if("is_numeric")
    outlier = F.coalesce(one(one(F.avg(ratio) * 10) * 0.4 + one(F.max(ratio) * 5) * 0.4 + F.count_if(ratio > 0.05) / numeric * 0.2), F.lit(0.0))
    shaped = F.col("is_numeric") & F.col("skewness").isNotNull()
    share = lambda cond: F.count_if(shaped & cond) / F.count_if(shaped)
    skew, kurt = F.abs("skewness"), F.abs("kurtosis")
    distribution = F.when(F.count_if(shaped) > 0, one(share(skew > 2) * 0.3 + share(skew > 5) * 0.4 + share(kurt > 7) * 0.3)).otherwise(0.0)
    cardinality = one(part(F.col("unique_count") <= 1) * 0.5 + part((F.col("unique_percent") > 95) & ~F.col("is_identifier")) * 0.3)
    rows = F.max("row_count")
    schema = one(F.when(n > 100, 0.2).otherwise(0.0) + F.when((rows > 0) & (n / rows > 0.1), 0.3).otherwise(0.0))
    facts = [F.max("null_percent").alias("__nulls"), F.max(ratio).alias("__out"), F.count_if(F.col("unique_count") <= 1).alias("__const"), F.count_if(shaped & (skew > 2)).alias("__skew")]
    parts = {"null_score": null, "outlier_score": outlier, "distribution_score": distribution, "cardinality_score": cardinality, "schema_score": schema}
    out = profile.groupBy(*by).agg(*[c.alias(k) for k, c in parts.items()], *facts)
    total = F.bround(reduce(lambda a, b: a + b, [F.col(k) * w for k, w in WEIGHTS.items()]), 4)
    out = out.withColumn("overall", total)
    label = None
    for limit, name in LABELS:
        label = F.when(F.col("overall") < limit, name) if label is None else label.when(F.col("overall") < limit, name)
    advice = F.array_compact(
        F.array(
            F.when(F.col("overall") >= 0.5, "attend to the quality before modelling"),
            F.when(F.col("__nulls") > 20, "address missing values"),
            F.when(F.col("__out") > 0.1, "look into outliers"),
            F.when(F.col("__const") > 0, "drop constant columns"),
            F.when(F.col("__skew") > 0, "transform skewed columns"),
        )
    )
    out = out.withColumn("label", label.otherwise("critical")).withColumn("advice", F.when(F.size(advice) > 0, advice).otherwise(F.array(F.lit("acceptable"))))
    return out.select(*by, *parts, "overall", "label", "advice")


def pii_scan(cells: DataFrame, least: float = 0.1, sure: float = 0.5) -> DataFrame:
    """(column, type, n, rate, is_pii, risk): types that more than ``least`` of a column's values show; cells (column, value).

    All values count (the reference looks at the first thousand); blank ones don't.
    """
    some = cells.filter(F.trim("value") != "").select("column", pt.pii_type(F.trim("value")).alias("type"))
    per = some.groupBy("column", "type").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("column")
    rated = per.withColumn("rate", F.col("n") / F.sum("n").over(w)).filter("type is not null")
    rated = rated.filter(F.col("rate") > least).withColumn("is_pii", F.max("rate").over(w) > sure)
    return rated.withColumn("risk", pt.risk("type", "rate"))


def text_patterns(cells: DataFrame, least: float = 0.1) -> DataFrame:
    """(column, pattern, n, share): patterns that fit ``least`` of a column's non-empty values; one pass for all nine."""
    some = cells.filter(F.col("value").isNotNull() & (F.col("value") != ""))
    hits = [F.struct(F.lit(k).alias("pattern"), F.count_if(F.col("value").rlike(pt.whole(p))).alias("n")) for k, p in pt.TEXT_PATTERNS.items()]
    per = some.groupBy("column").agg(F.count(F.lit(1)).alias("total"), F.array(*hits).alias("h"))
    rows = per.select("column", "total", F.explode("h").alias("h")).select("column", "h.pattern", "h.n", (F.col("h.n") / F.col("total")).alias("share"))
    return rows.filter(F.col("share") >= least)


def novel_pattern(cells: DataFrame, dominance: float = 0.7, least: int = 10) -> DataFrame:
    """(column, classes, n, share, regex): the format that most values of 2 to 99 characters share."""
    some = cells.filter(F.length("value").between(2, 99)).select("column", pt.char_classes("value").alias("classes"))
    per = some.groupBy("column", "classes").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("column")
    top = per.withColumn("total", F.sum("n").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.col("n").desc(), "classes"))).filter("rn = 1")
    top = top.filter((F.col("total") >= least) & (F.col("n") / F.col("total") >= dominance))
    return top.select("column", "classes", "n", (F.col("n") / F.col("total")).alias("share"), pt.classes_regex("classes").alias("regex"))


def infer_types(cells: DataFrame) -> DataFrame:
    """(column, type): Integer, Double, DateTime or Boolean if every non-empty value is one, else String."""
    v = F.trim("value")
    some = cells.withColumn("v", F.when(v != "", v))
    every = lambda cond: F.coalesce(F.bool_and(F.when(F.col("v").isNotNull(), cond)), F.lit(False))
    kind = (
        F.when(every(F.col("v").rlike(r"^[+-]?\d{1,18}$")), "Integer")
        .when(every(F.col("v").try_cast("double").isNotNull()), "Double")
        .when(every(F.col("v").rlike(r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$")), "DateTime")
        .when(every(F.lower("v").isin("true", "false")), "Boolean")
        .otherwise("String")
    )
    return some.groupBy("column").agg(kind.alias("type"))


def table_cells(boxes: DataFrame, least_rows: int = 2) -> DataFrame:
    """(page, row, col, text): words laid out in a grid; boxes (page, text, left, bottom).

    Rows are words of about equal bottom (to 10 points, halves to even), two at
    least; rows whose size differs from the commonest by more than one go.
    """
    rows = boxes.withColumn("y", F.bround(F.col("bottom") / 10) * 10)
    per = rows.groupBy("page", "y").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    first = per.groupBy("page", "n").agg(F.count(F.lit(1)).alias("c"), F.max("y").alias("top"))
    w = Window.partitionBy("page")
    common = first.withColumn("rn", F.row_number().over(w.orderBy(F.col("c").desc(), F.col("top").desc()))).filter("rn = 1").select("page", F.col("n").alias("usual"))
    kept = per.join(common, "page").filter(F.abs(F.col("n") - F.col("usual")) <= 1)
    kept = kept.withColumn("row", F.row_number().over(w.orderBy(F.col("y").desc())) - 1).withColumn("rows", F.count(F.lit(1)).over(w)).filter(F.col("rows") >= least_rows)
    place = Window.partitionBy("page", "row").orderBy("left", "text")
    return rows.join(kept.select("page", "y", "row"), ["page", "y"]).select("page", "row", (F.row_number().over(place) - 1).alias("col"), "text")


def table_header(cells: DataFrame) -> DataFrame:
    """(page, has_header): the first row has no number and the second has, or its words are clearly shorter."""
    number = F.col("text").try_cast("double").isNotNull()
    part = lambda r, f, c: f(F.when(F.col("row") == r, c))
    n0, n1 = part(0, F.count_if, number), part(1, F.count_if, number)
    l0, l1 = part(0, F.avg, F.length("text")), part(1, F.avg, F.length("text"))
    return cells.groupBy("page").agg(((F.max("row") >= 1) & (((n0 == 0) & (n1 > 0)) | (l0 < l1 * 0.7))).alias("has_header"))


def column_name(text) -> Column:
    """A heading as a column name."""
    x = F.regexp_replace(F.regexp_replace(F.trim(col(text)), "[ _-]", "_"), r"[^\p{L}\p{Nd}_]", "")
    x = F.regexp_replace(x, "^_+|_+$", "")
    return F.when(x == "", "Column").when(x.rlike(r"^\p{Nd}"), F.concat(F.lit("Col_"), x)).otherwise(x)


def to_csv_line(*columns) -> Column:
    """Quoted where a comma, quote or line break asks for it."""
    cell = lambda c: F.when(col(c).cast("string").rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(col(c).cast("string"), F.lit("")))
    return F.concat_ws(",", *[cell(c) for c in columns])
