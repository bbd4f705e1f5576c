"""Formula repair over formulas that are put together from pieces by the order's key."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import latex
from quire.plans import fixtures as fx
from quire.plans.registry import query

#: Pieces of formulas; every key takes eight of them.
PIECES = (r"\left(", r"\right)", "{", "}", r"\frac ", r"\upalpha ", r"\uparrow ", r"\Bar x", r"\a1", r"\{", r"\\", r"\lefteqn ", r"\qquad", r"\left.", r"\right\}", r"\textunderscore ", "x_1 ", r"\emph y", r"\begin{array}", r"\end{array}", r"\begin{cases}", r"\end{align}", "}", "{")
_PLACES = (1, 7, 49, 11, 13, 343, 17, 19)
_QUOTED = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in PIECES) + "]"
FORMULAS_SQL = "formulas AS (SELECT o_orderkey, " + " || ".join(f"{_QUOTED}[1 + ((o_orderkey * {p}) // {i + 3}) % {len(PIECES)}]" for i, p in enumerate(_PLACES)) + " AS f FROM orders)"


def formulas(spark, sf_dir):
    pieces = F.array(*map(F.lit, PIECES))
    part = lambda i, p: F.element_at(pieces, F.expr(f"cast(1 + ((o_orderkey * {p}) div {i + 3}) % {len(PIECES)} as int)"))
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", F.concat(*[part(i, p) for i, p in enumerate(_PLACES)]).alias("f"))


@query(
    rf"""WITH {FORMULAS_SQL}, c AS (SELECT o_orderkey, f, unnest(regexp_extract_all(f, '(?s)\\.|[^\\]|\\')) AS m, generate_subscripts(regexp_extract_all(f, '(?s)\\.|[^\\]|\\'), 1) AS i FROM formulas),
d AS (SELECT *, sum(CASE m WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER (PARTITION BY o_orderkey ORDER BY i) AS p FROM c),
k AS (SELECT *, coalesce(min(p) OVER (PARTITION BY o_orderkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low, min(p) OVER (PARTITION BY o_orderkey ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next FROM d)
SELECT o_orderkey, string_agg(m, '' ORDER BY i) FILTER (NOT (m = '}}' AND p < least(low, 0)) AND NOT (m = '{{' AND next >= p)) AS f FROM k GROUP BY o_orderkey"""
)
def latex_braces(spark, sf_dir):
    return formulas(spark, sf_dir).select("o_orderkey", F.nullif(latex.balanced_braces(F.col("f")), F.lit("")).alias("f"))


_STEPS = r"regexp_replace(f, '\\(?:lefteqn|boldmath|ensuremath|centering|textsubscript|sides|textsl|textcent|emph|protect|null)', '', 'g')"
_UP = rf"regexp_replace(regexp_replace({_STEPS}, '\\up([a-zA-Z]+)', '\\\1', 'g'), '\\arrow([^a-zA-Z]|$)', '\\uparrow\1', 'g')"


@query(rf"WITH {FORMULAS_SQL} SELECT o_orderkey, replace(replace({_UP}, '\Bar', '\hat'), '\textunderscore', '\_') AS f FROM formulas")
def latex_commands(spark, sf_dir):
    f = latex.replaced_commands(latex.plain_greek(latex.without_unsupported(F.col("f"))))
    return formulas(spark, sf_dir).select("o_orderkey", f.alias("f"))


@query(
    rf"""WITH {FORMULAS_SQL}, m AS (SELECT o_orderkey, regexp_extract_all(f, '(?s)\\[^\n]|[^\\]+|\\') AS ms FROM formulas)
SELECT o_orderkey, list_aggregate(list_transform(ms, lambda x, i: CASE WHEN regexp_full_match(x, '\\[0-9]') OR regexp_full_match(x, '\\[a-zA-Z]') AND NOT regexp_matches(coalesce(ms[i + 1], ''), '^[a-zA-Z]') THEN '\ ' || x[2:] ELSE x END), 'string_agg', '') AS f FROM m"""
)
def latex_spaced(spark, sf_dir):
    return formulas(spark, sf_dir).select("o_orderkey", latex.spaced_commands(F.col("f")).alias("f"))


@query(
    rf"""WITH {FORMULAS_SQL}, n AS (SELECT *, len(regexp_extract_all(f, '\\begin\{{array\}}')) - len(regexp_extract_all(f, '\\end\{{array\}}')) AS a, regexp_extract(f, '\\begin\{{array\}}(\{{[^}}]*\}})', 1) AS form FROM formulas),
m AS (SELECT o_orderkey, repeat('\begin{{array}}' || CASE WHEN form = '' THEN '{{c}}' ELSE form END || ' ', greatest(-a, 0)) || f || repeat(' \end{{array}}', greatest(a, 0)) AS f FROM n)
SELECT o_orderkey, repeat('\begin{{align}} ', len(regexp_extract_all(f, '\\end\{{align\}}'))) || f || repeat(' \end{{cases}}', len(regexp_extract_all(f, '\\begin\{{cases\}}'))) AS f FROM m"""
)
def latex_environments(spark, sf_dir):
    return formulas(spark, sf_dir).select("o_orderkey", latex.balance_environments(F.col("f")).alias("f"))


@query()
def latex_delimiters(spark, sf_dir):
    return formulas(spark, sf_dir).select("o_orderkey", latex.matched_delimiters(F.col("f")).alias("f"))


@query()
def latex_repaired(spark, sf_dir):
    return formulas(spark, sf_dir).select("o_orderkey", latex.repaired(F.col("f")).alias("f"))
