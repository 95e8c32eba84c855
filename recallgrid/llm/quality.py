"""Quality rules with risk-controlled thresholds.

Each rule rejects documents on one side of a cutoff of one metric.  In every stratum
(the language) the rules are tightened together, grade by grade: at a grade each
rule's cutoff is the strictest of its grid beyond which no more than the grade's share
of the documents without a label lies, so the grades don't depend on any label.  The
union of the rules is then tested on the labelled good documents from the most
lenient grade to the strictest: a grade holds if the exact binomial tail
P(X <= false rejections | n, limit) is at most the level.  Testing stops at the first
that doesn't hold (fixed sequence), and the level is ``delta`` over the strata
(Bonferroni).  So with probability ``1 - delta`` no stratum loses more than ``limit``
of its good documents by all rules together.

Defined results
---------------
* null or empty text, or one without words: metrics are null, the document is kept;
* a null stratum is a stratum of its own; one without documents that lack a label has
  no grades, one without enough good ones (log(1/level) / limit, 219 for four strata)
  holds none, and nothing is rejected there;
* labels with a null or contradicting quality for one document are left out of the
  holdout, and these documents out of the grades;
* repeated rows are judged one by one and count one by one; ties with the cutoff
  are kept; an empty table gives an empty result;
* only id, text and stratum are read, so extra columns can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, lgamma, log, log1p

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: name -> (cutoffs from lenient to strict, sign: +1 rejects above, -1 rejects below)
RULES = {
    "symbol_ratio": ([round(0.9 - 0.02 * i, 2) for i in range(45)], 1),
    "digit_ratio": ([round(0.9 - 0.02 * i, 2) for i in range(45)], 1),
    "repeated_lines": ([round(0.98 - 0.02 * i, 2) for i in range(49)], 1),
    "mean_word_length": ([round(40 - 0.5 * i, 1) for i in range(70)], 1),
    "words": ([2 * i for i in range(51)], -1),
}
#: The share of the documents that each rule may reject, by grade.
GRADES = [0.001, 0.002, 0.003, 0.005, 0.0075, 0.01, 0.015, 0.02, 0.03, 0.04, 0.05, 0.075, 0.1, 0.15, 0.2, 0.3]
BROADCAST_STRATA = 10_000


@dataclass(frozen=True)
class QualityParams:
    limit: float = 0.02
    delta: float = 0.05


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(id, ``stratum``, the rules' metrics) of whole texts, by built-in expressions; null where there are no words."""
    text = F.col("__text")
    staged = docs.select(F.col(id_col), F.col(stratum_col).cast("string").alias("stratum"), F.col(text_col).alias("__text"))
    staged = staged.withColumn("__one", F.trim(F.regexp_replace(text, r"\s+", " ")))
    staged = staged.withColumns({"__n": F.when(F.length("__one") > 0, F.regexp_count("__one", F.lit(" ")) + 1), "__lines": F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: x != "")})
    staged = staged.withColumn("__solid", F.length("__one") - F.col("__n") + 1)
    share = lambda p: F.round(F.regexp_count(text, F.lit(p)) / F.col("__solid"), 6)
    found: dict[str, Column] = {
        "symbol_ratio": share(r"[^\p{L}\p{N}\s]"),
        "digit_ratio": share(r"\p{N}"),
        "repeated_lines": F.when(F.col("__n") > 0, F.round(1 - F.size(F.array_distinct("__lines")) / F.greatest(F.size("__lines"), F.lit(1)), 6)),
        "mean_word_length": F.round(F.col("__solid") / F.col("__n"), 6),
        "words": F.col("__n").cast("double"),
    }
    return staged.select(id_col, "stratum", *(c.alias(k) for k, c in found.items()))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), summed exactly."""
    if k >= n:
        return 1.0
    c = lgamma(n + 1)
    return min(1.0, sum(exp(c - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p)) for i in range(k + 1)))


def choose_cutoff(rejected: list[int], n: int, limit: float, level: float) -> int | None:
    """The last place of the sequence before the first whose tail exceeds the level; ``rejected`` counts good documents at each."""
    best = None
    for i, k in enumerate(rejected):
        if n == 0 or k > n * limit or binomial_tail(k, n, limit) > level:
            break
        best = i
    return best


def grades(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> dict:
    """stratum -> for each grade the cutoffs of the rules (None: the rule rejects nothing yet)."""
    named = labels.where(F.col(id_col).isNotNull()).select(id_col).distinct()
    beyond = [F.sum((F.col(r) * s > c * s).cast("long")).alias(f"{r}__{i}") for r, (grid, s) in RULES.items() for i, c in enumerate(grid)]
    rows = measured.join(named, id_col, "left_anti").groupBy("stratum").agg(F.count("*").alias("n"), *beyond).collect()  # a row a stratum

    def strictest(row, rule: str, share: float):
        grid = RULES[rule][0]
        held = [i for i in range(len(grid)) if (row[f"{rule}__{i}"] or 0) <= share * row["n"]]
        return float(grid[held[-1]]) if held else None

    return {r["stratum"]: [[strictest(r, rule, q) for rule in RULES] for q in GRADES] for r in rows}


def _hits(cut: str) -> list[Column]:
    """For each rule whether it rejects, by the cutoffs in columns ``cut`` + rule."""
    return [F.coalesce(F.col(rule) * s > F.col(f"{cut}{rule}") * s, F.lit(False)) for rule, (_, s) in RULES.items()]


def _any(cs: list[Column]) -> Column:
    out = cs[0]
    for c in cs[1:]:
        out = out | c
    return out


def _with_cutoffs(rows: DataFrame, cutoffs: list[tuple], more: str = "", how: str = "left") -> DataFrame:
    """``rows`` joined with (stratum, ..., cutoffs) on the stratum, null-safe."""
    spark = rows.sparkSession
    names = ", ".join(f"__c_{r} double" for r in RULES)
    own = spark.createDataFrame(cutoffs, f"__stratum string, {more}{names}")
    own = F.broadcast(own) if len(cutoffs) <= BROADCAST_STRATA * len(GRADES) else own
    return rows.join(own, rows["stratum"].eqNullSafe(own["__stratum"]), how).drop("__stratum")


def cutoffs(measured: DataFrame, labels: DataFrame, params: QualityParams = QualityParams(), id_col: str = "doc_id") -> list[tuple]:
    """(stratum, cutoff of each rule or None) of the strata in which a grade holds."""
    found = grades(measured, labels, id_col)
    good = labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"), F.count("*").alias("all"), F.count("quality").alias("there")).where("lo = 1 and hi = 1 and all = there").select(id_col)
    steps = [(s, g, *c) for s, each in found.items() for g, c in enumerate(each)]
    tried = _with_cutoffs(measured.join(good, id_col), steps, "__grade int, ", "inner").groupBy("stratum", "__grade").agg(F.count("*").alias("n"), F.sum(_any(_hits("__c_")).cast("long")).alias("k")).collect()  # a row a stratum and grade
    rejected = {(r["stratum"], r["__grade"]): (r["n"], r["k"]) for r in tried}
    level = params.delta / max(1, measured.select("stratum").distinct().count())
    out = []
    for s in sorted({s for s, _ in rejected}, key=lambda s: (s is None, str(s))):
        g = choose_cutoff([rejected[s, i][1] for i in range(len(GRADES))], rejected[s, 0][0], params.limit, level)
        if g is not None:
            out.append((s, *found[s][g]))
    return out


def judge(measured: DataFrame, found: list[tuple]) -> DataFrame:
    """(id, ``stratum``, metrics, ``rejected_by``, ``keep``) under the cutoffs found."""
    joined = _with_cutoffs(measured, found)
    hits = [F.when(hit, F.lit(rule)) for rule, hit in zip(RULES, _hits("__c_"))]
    return joined.withColumn("rejected_by", F.array_compact(F.array(*hits))).select(*measured.columns, "rejected_by", (F.size("rejected_by") == 0).alias("keep"))


def apply_rules(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """Every document with its metrics and the verdict; metrics are computed once and written to the shared folder."""
    from recallgrid.llm._common import written

    measured = written(measure(docs), "quality")
    return judge(measured, cutoffs(measured, labels, params))


def sql(params: QualityParams = QualityParams()) -> str:
    """The same rows in DuckDB's SQL; ``rejected_by`` as text."""
    share = lambda p: f"round(len(regexp_extract_all(text, '{p}')) / solid, 6)"
    symbol, digit = r"[^\p{L}\p{N}\s]", r"\p{N}"
    grid = ", ".join(f"('{r}', {i}, {c}, {s})" for r, (cs, s) in RULES.items() for i, c in enumerate(cs))
    rules = ", ".join(f"('{r}')" for r in RULES)
    hit = lambda r: f"coalesce({r} * {RULES[r][1]} > c_{r} * {RULES[r][1]}, false)"
    picked = ", ".join(f"max(c) FILTER (WHERE rule = '{r}') AS c_{r}" for r in RULES)
    tail = "exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({0}) + (n - i) * ln(1 - {0}))".format(f"CAST({params.limit} AS DOUBLE)")
    return rf"""
    WITH one AS (SELECT doc_id, lang AS stratum, text, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS t, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines FROM documents),
    m AS (SELECT *, CASE WHEN length(t) > 0 THEN length(t) - length(replace(t, ' ', '')) + 1 END AS n, CASE WHEN length(t) > 0 THEN length(replace(t, ' ', '')) END AS solid FROM one),
    d AS MATERIALIZED (SELECT doc_id, stratum, {share(symbol)} AS symbol_ratio, {share(digit)} AS digit_ratio, CASE WHEN n > 0 THEN round(1 - len(list_distinct(lines)) / greatest(len(lines), 1), 6) END AS repeated_lines, round(solid / n, 6) AS mean_word_length, CAST(n AS DOUBLE) AS words FROM m),
    grid(rule, i, c, s) AS (VALUES {grid}), grade AS (SELECT unnest({GRADES}) AS q, unnest(range({len(GRADES)})) AS g),
    un AS (SELECT * FROM d WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)), size AS (SELECT stratum, count(*) AS total FROM un GROUP BY stratum),
    long AS (UNPIVOT (SELECT stratum, {', '.join(RULES)} FROM un) ON {', '.join(RULES)} INTO NAME rule VALUE x),
    past AS (SELECT z.stratum, grid.rule, i, c, count(x) FILTER (WHERE x * s > c * s) AS k FROM size z CROSS JOIN grid LEFT JOIN long l ON l.rule = grid.rule AND l.stratum IS NOT DISTINCT FROM z.stratum GROUP BY ALL),
    cut AS (SELECT z.stratum, g, rule, arg_max(c, i) AS c FROM past p JOIN size z ON z.stratum IS NOT DISTINCT FROM p.stratum CROSS JOIN grade WHERE k <= q * total GROUP BY ALL),
    wide AS (SELECT z.stratum, grade.g, {picked} FROM size z CROSS JOIN grade LEFT JOIN cut ON cut.g = grade.g AND cut.stratum IS NOT DISTINCT FROM z.stratum GROUP BY ALL),
    good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1 AND max(quality) = 1 AND count(*) = count(quality)),
    tried AS (SELECT d.stratum, g, count(*) AS n, count(*) FILTER (WHERE {' OR '.join(hit(r) for r in RULES)}) AS k FROM d JOIN good USING (doc_id) JOIN wide w ON w.stratum IS NOT DISTINCT FROM d.stratum GROUP BY ALL),
    tails AS (SELECT stratum, g, n, k, k <= n * {params.limit} AND (SELECT sum({tail}) FROM range(0, k + 1) r(i)) <= {params.delta} / (SELECT count(*) FROM (SELECT DISTINCT stratum FROM d)) AS holds FROM tried),
    best AS (SELECT t.stratum, max(t.g) AS g FROM tails t WHERE t.holds AND NOT EXISTS (SELECT 1 FROM tails u WHERE u.stratum IS NOT DISTINCT FROM t.stratum AND u.g < t.g AND NOT u.holds) GROUP BY t.stratum),
    final AS (SELECT w.* FROM wide w JOIN best b ON b.g = w.g AND b.stratum IS NOT DISTINCT FROM w.stratum),
    out AS (SELECT d.*, list_filter([{', '.join(f"CASE WHEN {hit(r)} THEN '{r}' END" for r in RULES)}], lambda x: x IS NOT NULL) AS hits FROM d LEFT JOIN final f ON f.stratum IS NOT DISTINCT FROM d.stratum)
    SELECT doc_id, stratum, {', '.join(RULES)}, array_to_string(hits, ',') AS rejected_by, len(hits) = 0 AS keep FROM out"""
