"""Queries: personal data, patterns, column profiles, anomaly scores and types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.catalog import query
from sigloom.functions import patterns as pt
from sigloom.operators import profile as pf
from sigloom.session import read


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


_TOKENS = r"tok AS (SELECT lang AS \"column\", unnest(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> '')) AS v FROM documents)".replace('\\"', '"')
_TYPE = "CASE " + " ".join(f"WHEN regexp_matches(v, '^(?:{_sql(p)})$') THEN '{n}'" for n, p in pt.PII) + " END"


def _tokens(spark, sf) -> DataFrame:
    """Every blank-separated token of the documents, by language."""
    return read(spark, sf, "documents").select(F.col("lang").alias("column"), F.explode(F.split("text", "[ \\t\\n\\r]+")).alias("value")).filter("value <> ''")


@query("pii_tokens", f"WITH {_TOKENS}, t AS (SELECT \"column\", {_TYPE} AS kind FROM tok) SELECT \"column\", kind, count(*) AS n FROM t WHERE kind IS NOT NULL GROUP BY ALL")
def pii_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _tokens(spark, sf).filter(pt.may_be_pii("value")).select("column", pt.pii_type("value").alias("kind")).filter("kind is not null").groupBy("column", "kind").agg(F.count(F.lit(1)).alias("n"))


def _cells(spark, sf) -> DataFrame:
    """Columns of several sorts: urls, keys as 9 digits, balances, dates."""
    pages = read(spark, sf, "pages").select(F.lit("url").alias("column"), F.col("url").alias("value"))
    keys = read(spark, sf, "customer").select(F.lit("code").alias("column"), F.lpad(F.col("c_custkey").cast("string"), 9, "7").alias("value"))
    days = read(spark, sf, "orders").select(F.lit("day").alias("column"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("value"))
    segment = read(spark, sf, "customer").select(F.lit("segment").alias("column"), F.col("c_mktsegment").alias("value"))
    return pages.unionByName(keys).unionByName(days).unionByName(segment)


_CELLS = """cells AS (SELECT 'url' AS "column", url AS v FROM pages UNION ALL SELECT 'code', lpad(CAST(c_custkey AS VARCHAR), 9, '7') FROM customer
UNION ALL SELECT 'day', strftime(o_orderdate, '%Y-%m-%d') FROM orders UNION ALL SELECT 'segment', c_mktsegment FROM customer)"""
_RISK = "CASE WHEN type IN ('SSN', 'CreditCard', 'BankAccount', 'PassportNumber') THEN CASE WHEN rate > 0.7 THEN 'Critical' ELSE 'High' END WHEN type IN ('Email', 'PhoneNumber', 'DriversLicense', 'DateOfBirth') THEN CASE WHEN rate > 0.7 THEN 'High' ELSE 'Medium' END WHEN rate > 0.7 THEN 'Medium' ELSE 'Low' END"


@query(
    "pii_scan",
    f"""WITH {_CELLS}, t AS (SELECT "column", {_TYPE} AS type FROM cells WHERE trim(v) <> ''), g AS (SELECT "column", type, count(*) AS n FROM t GROUP BY ALL),
r AS (SELECT *, n / sum(n) OVER (PARTITION BY "column") AS rate FROM g), k AS (SELECT * FROM r WHERE type IS NOT NULL AND rate > 0.1)
SELECT "column", type, n, round(rate, 9) AS rate, max(rate) OVER (PARTITION BY "column") > 0.5 AS is_pii, {_RISK} AS risk FROM k""",
)
def pii_scan(spark: SparkSession, sf: str) -> DataFrame:
    return pf.pii_scan(_cells(spark, sf)).select("column", "type", "n", F.round("rate", 9).alias("rate"), "is_pii", "risk")


_REDACT = "CASE WHEN length(v) <= 4 THEN '****' WHEN kind = 'SSN' THEN '***-**-' || right(v, 4) WHEN kind = 'CreditCard' THEN '**** **** **** ' || right(v, 4) WHEN kind = 'Email' THEN left(v, 2) || '***@***' || CASE WHEN contains(v, '@') THEN regexp_extract(v, '(\\.[^.]*)$', 1) ELSE '' END WHEN kind = 'PhoneNumber' THEN '***-***-' || right(v, 4) ELSE left(v, 2) || repeat('*', least(length(v) - 4, 10)) || right(v, 2) END"


@query("redact", f"WITH {_TOKENS}, t AS (SELECT v, {_TYPE} AS kind FROM tok) SELECT DISTINCT kind, {_REDACT} AS masked FROM t WHERE kind IS NOT NULL")
def redact(spark: SparkSession, sf: str) -> DataFrame:
    t = _tokens(spark, sf).filter(pt.may_be_pii("value")).select("value", pt.pii_type("value").alias("kind")).filter("kind is not null")
    return t.select("kind", pt.redact("value", "kind").alias("masked")).distinct()


@query("pii_names", "SELECT * FROM (VALUES ('user_email', 'Email'), ('ssn', 'SSN'), ('ip_address', 'Address'), ('ip', 'IPAddress'), ('credit_number', 'CreditCard'), ('total', NULL)) t(name, kind)")
def pii_names(spark: SparkSession, sf: str) -> DataFrame:
    names = ["user_email", "ssn", "ip_address", "ip", "credit_number", "total"]
    return spark.createDataFrame([(n, pt.pii_from_name(n)) for n in names], "name string, kind string")


_HITS = " UNION ALL ".join(f"SELECT \"column\", '{k}' AS pattern, CAST(count_if(regexp_matches(v, '^(?:{_sql(p)})$')) AS BIGINT) AS n, count(*) AS total FROM cells WHERE v <> '' GROUP BY \"column\"" for k, p in pt.TEXT_PATTERNS.items())


@query("text_patterns", f'WITH {_CELLS}, h AS ({_HITS}) SELECT "column", pattern, n, round(n / total, 9) AS share FROM h WHERE n / total >= 0.1')
def text_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return pf.text_patterns(_cells(spark, sf)).withColumn("share", F.round("share", 9))


@query(
    "novel_pattern",
    f"""WITH {_CELLS}, c AS (SELECT "column", translate(regexp_replace(regexp_replace(regexp_replace(regexp_replace(v, '\\p{{L}}+', chr(1), 'g'), '\\p{{Nd}}+', chr(2), 'g'), '\\s+', chr(3), 'g'), '[^\\x01\\x02\\x03]+', 'S', 'g'), chr(1) || chr(2) || chr(3), 'ANW') AS classes FROM cells WHERE length(v) BETWEEN 2 AND 99),
g AS (SELECT "column", classes, count(*) AS n FROM c GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY "column") AS total, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, classes) AS rn FROM g)
SELECT "column", classes, n, round(n / total, 9) AS share FROM r WHERE rn = 1 AND total >= 10 AND n / total >= 0.7""",
)
def novel_pattern(spark: SparkSession, sf: str) -> DataFrame:
    return pf.novel_pattern(_cells(spark, sf)).select("column", "classes", "n", F.round("share", 9).alias("share"))


_PROFILED = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus"]
_NUM = _PROFILED[:4]


def _profile_sql() -> str:
    parts = []
    for c in _PROFILED:
        num = c in _NUM
        v = f"CAST({c} AS DOUBLE)"
        q = f"(SELECT quantile_cont({v}, [0.25, 0.75]) AS q FROM lineitem)"
        out = f"CAST(count_if({v} < q[1] - 1.5 * (q[2] - q[1]) OR {v} > q[2] + 1.5 * (q[2] - q[1])) AS BIGINT)" if num else "CAST(0 AS BIGINT)"
        m = f"avg({v}) AS m" if num else "0 AS m"
        skew = f"round(avg(power({v} - m, 3)) / power(var_pop({v}), 1.5), 6)" if num else "CAST(NULL AS DOUBLE)"
        kurt = f"round(kurtosis_pop({v}) + 3, 6)" if num else "CAST(NULL AS DOUBLE)"
        src = f"lineitem, {q} qq, (SELECT {m} FROM lineitem) mm" if num else "lineitem"
        parts.append(
            f"SELECT '{c}' AS \"column\", {str(num).lower()} AS is_numeric, {str(c.endswith('key')).lower()} AS is_identifier, count(*) AS row_count, round(count_if({c} IS NULL) / count(*) * 100, 6) AS null_percent, count(DISTINCT {c}) AS unique_count, round(count(DISTINCT {c}) / count(*) * 100, 6) AS unique_percent, {out} AS outlier_count, {skew} AS skewness, {kurt} AS kurtosis FROM {src}"
        )
    return " UNION ALL ".join(parts)


def _profile(spark, sf) -> DataFrame:
    return pf.column_profile(read(spark, sf, "lineitem"), _PROFILED)


@query("column_profile", _profile_sql())
def column_profile(spark: SparkSession, sf: str) -> DataFrame:
    p = _profile(spark, sf)
    return p.select("column", "is_numeric", "is_identifier", "row_count", *[F.round(c, 6).alias(c) for c in ("null_percent", "unique_percent", "skewness", "kurtosis")], "unique_count", "outlier_count")


_P = f"p AS ({_profile_sql()})"
_CLASS = "CASE WHEN abs(skewness) < 0.5 AND abs(kurtosis - 3) < 1 THEN 'Normal' WHEN skewness > 2 AND kurtosis > 10 THEN 'PowerLaw' WHEN skewness > 0.5 AND kurtosis > 6 THEN 'Exponential' WHEN skewness > 1 THEN 'RightSkewed' WHEN skewness < -1 THEN 'LeftSkewed' ELSE 'Unknown' END"


@query("distribution_class", f'WITH {_P} SELECT "column", {_CLASS} AS class FROM p WHERE is_numeric')
def distribution_class(spark: SparkSession, sf: str) -> DataFrame:
    return _profile(spark, sf).filter("is_numeric").select("column", pt.distribution_class("skewness", "kurtosis").alias("class"))


@query(
    "anomaly_score",
    f"""WITH {_P}, c AS (SELECT
 least(1, avg(null_percent) / 100 * 0.3 + max(null_percent) / 100 * 0.4 + count_if(null_percent > 20) / count(*) * 0.3) AS null_score,
 coalesce(least(1, least(1, avg(CASE WHEN is_numeric AND outlier_count > 0 THEN outlier_count / row_count END) * 10) * 0.4 + least(1, max(CASE WHEN is_numeric AND outlier_count > 0 THEN outlier_count / row_count END) * 5) * 0.4 + count_if(is_numeric AND outlier_count / row_count > 0.05) / count_if(is_numeric) * 0.2), 0) AS outlier_score,
 least(1, count_if(abs(skewness) > 2) / count(skewness) * 0.3 + count_if(abs(skewness) > 5) / count(skewness) * 0.4 + count_if(abs(kurtosis) > 7) / count(skewness) * 0.3) AS distribution_score,
 least(1, count_if(unique_count <= 1) / count(*) * 0.5 + count_if(unique_percent > 95 AND NOT is_identifier) / count(*) * 0.3) AS cardinality_score,
 CASE WHEN count(*) > 100 THEN 0.2 ELSE 0 END + CASE WHEN count(*) / max(row_count) > 0.1 THEN 0.3 ELSE 0 END AS schema_score FROM p)
SELECT round(null_score, 6)::DOUBLE AS null_score, round(outlier_score, 6)::DOUBLE AS outlier_score, round(distribution_score, 6)::DOUBLE AS distribution_score, round(cardinality_score, 6)::DOUBLE AS cardinality_score, round(schema_score, 6)::DOUBLE AS schema_score,
 round_even(null_score * 0.2 + outlier_score * 0.25 + distribution_score * 0.2 + cardinality_score * 0.15 + schema_score * 0.2, 4)::DOUBLE AS overall FROM c""",
)
def anomaly_score(spark: SparkSession, sf: str) -> DataFrame:
    return pf.anomaly_scores(_profile(spark, sf)).select(*[F.round(k, 6).alias(k) for k in pf.WEIGHTS], "overall")


@query(
    "type_inference",
    f"""WITH {_CELLS}, x AS (SELECT "column", nullif(trim(v), '') AS v FROM cells)
SELECT "column", CASE WHEN bool_and(regexp_full_match(v, '[+-]?\\d{{1,18}}')) THEN 'Integer' WHEN bool_and(TRY_CAST(v AS DOUBLE) IS NOT NULL) THEN 'Double' WHEN bool_and(regexp_full_match(v, '\\d{{4}}-\\d{{2}}-\\d{{2}}')) THEN 'DateTime' WHEN bool_and(lower(v) IN ('true', 'false')) THEN 'Boolean' ELSE 'String' END AS type FROM x WHERE v IS NOT NULL GROUP BY "column\"""",
)
def type_inference(spark: SparkSession, sf: str) -> DataFrame:
    return pf.infer_types(_cells(spark, sf))


def _boxes(spark, sf) -> DataFrame:
    """Words of parts set in a grid of three columns, a page to each size."""
    p = read(spark, sf, "part").select(F.col("p_size").alias("page"), F.row_number().over(__import__("pyspark").sql.Window.partitionBy("p_size").orderBy("p_partkey")).alias("r"), "p_brand", "p_type", F.col("p_retailprice").cast("string").alias("price"))
    return p.select("page", F.explode(F.array(*[F.struct(F.col(c).alias("text"), F.lit(float(i * 100)).alias("left"), (1000.0 - F.col("r") * 10 + i).alias("bottom")) for i, c in enumerate(("p_brand", "p_type", "price"))])).alias("b")).select("page", "b.*")


@query(
    "table_cells",
    """WITH p AS (SELECT p_size AS page, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS r, p_brand, p_type, CAST(p_retailprice AS VARCHAR) AS price FROM part)
SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY r) - 1 AS INTEGER) AS "row", unnest([0, 1, 2])::INTEGER AS col, unnest([p_brand, p_type, price]) AS text FROM p WHERE (SELECT count(*) FROM p q WHERE q.page = p.page) >= 2""",
)
def table_cells(spark: SparkSession, sf: str) -> DataFrame:
    return pf.table_cells(_boxes(spark, sf))


@query("table_header")
def table_header(spark: SparkSession, sf: str) -> DataFrame:
    return pf.table_header(pf.table_cells(_boxes(spark, sf)))


@query("table_export", "SELECT c_custkey, c_name || ',' || CASE WHEN contains(c_mktsegment, ',') THEN '\"' || c_mktsegment || '\"' ELSE c_mktsegment END AS line FROM customer")
def table_export(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "customer").select("c_custkey", pf.to_csv_line("c_name", "c_mktsegment").alias("line"))


_SCAN_SQL = """WITH p AS (SELECT l_orderkey AS doc_id, CAST(l_quantity AS DOUBLE) - 1 AS words, (CAST(l_quantity AS DOUBLE) - 1) * 5 AS letters, l_linenumber % 3 AS images, CAST(l_discount AS DOUBLE) * 10 AS coverage FROM lineitem),
q AS (SELECT *, (coverage > 0.8 AND words < 20) OR (images > 0 AND words = 0) OR (coverage > 0.5 AND words = 0) OR (images > 0 AND letters / 20000.0 < 0.001 AND words < 50) AS scanned FROM p),
c AS (SELECT *, CASE WHEN scanned THEN least(round(0.5 + CASE WHEN coverage > 0.8 THEN 0.3 ELSE 0 END + CASE WHEN words = 0 THEN 0.2 WHEN words < 10 THEN 0.1 ELSE 0 END + CASE WHEN coverage > 0.9 THEN 0.1 ELSE 0 END, 6), 1.0) END AS conf FROM q),
d AS (SELECT doc_id, count(*) AS pages, CAST(sum(words) AS BIGINT) AS total_words, CAST(sum(images) AS BIGINT) AS total_images, CAST(sum(CASE WHEN scanned THEN 1 ELSE 0 END) AS BIGINT) AS scanned_pages, round(coalesce(avg(conf), 1.0), 6) AS confidence FROM c GROUP BY doc_id)
SELECT *, CASE WHEN scanned_pages / pages > 0.9 THEN 'Scanned' WHEN scanned_pages / pages < 0.1 THEN 'Searchable' ELSE 'Mixed' END AS kind, NOT scanned_pages / pages < 0.1 AS needs_ocr FROM d"""


@query("scanned_documents", _SCAN_SQL)
def scanned_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as documents and their lines as pages, whose facts come from quantity, number and discount; every page's text reads well."""
    from sigloom.operators import scans

    words = F.col("l_quantity").cast("double") - 1
    pages = read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), words.alias("words"), (words * 5).alias("letters"), (F.col("l_linenumber") % 3).alias("images"), F.lit(100).alias("width"), F.lit(200).alias("height"),
        (F.col("l_discount").cast("double") * 10).alias("coverage"), F.lit("some ordinary words of a page that can be read").alias("text"),
    )
    return scans.scanned_documents(pages)
