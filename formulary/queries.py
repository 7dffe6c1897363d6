"""Registered queries over the star-schema tables, and the same rows in DuckDB's SQL.

Formulas, predictions and manifests are derived from numeric columns by one SQL text that both
engines run, so that every operator meets realistic strings at any scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formulary import phrase_queries
from formulary.functions import latex, spoken
from formulary.operators import datasets, scoring, selection

QUERIES: dict = {**phrase_queries.QUERIES}
ORACLES: dict[str, str] = {**phrase_queries.ORACLES}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- derived tables, as SQL for both engines ----------------------------------------------------

_B = "chr(92)"
#: Formulas and two systems' predictions of them, one row per line item.
PAIRS = f"""
SELECT CAST(l_orderkey * 10000000000 + l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS BIGINT) AS id,
  CASE l_linenumber % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'test' WHEN 2 THEN 'test_ood' ELSE 'test_hard' END AS split,
  CASE l_partkey % 5 WHEN 0 THEN 'algebra' WHEN 1 THEN 'calculus' WHEN 2 THEN 'physics' WHEN 3 THEN 'ml' ELSE 'analysis' END AS domain,
  CASE l_linenumber % 3
    WHEN 0 THEN concat({_B}, 'frac{{', CAST(CAST(l_quantity AS INT) AS VARCHAR(9)), '}}{{', CAST(l_linenumber AS VARCHAR(9)), '}} = ', {_B}, 'alpha_', CAST(l_linenumber AS VARCHAR(9)), '^2')
    WHEN 1 THEN concat({_B}, 'int_0^', {_B}, 'infty f(x)', {_B}, ',dx ', {_B}, 'leq ', CAST(CAST(l_quantity AS INT) AS VARCHAR(9)), ' [a + ', {_B}, 'text{{b}}]')
    ELSE concat('x^', CAST(l_linenumber AS VARCHAR(9)), ' + ', {_B}, 'sqrt 2 - ', {_B}, 'varepsilon_{{i,j}} | ', {_B}, 'mathbb{{R}}^n') END AS target_text,
  CASE CAST(l_suppkey AS INT) % 4
    WHEN 0 THEN concat({_B}, 'dfrac{{', CAST(CAST(l_quantity AS INT) AS VARCHAR(9)), '}}{{', CAST(l_linenumber AS VARCHAR(9)), '}} = ', {_B}, 'alpha_{{', CAST(l_linenumber AS VARCHAR(9)), '}}^{{2}}')
    WHEN 1 THEN concat({_B}, 'int_{{0}}^', {_B}, 'infty f(x)', {_B}, ',dx ', {_B}, 'leq ', CAST(CAST(l_quantity AS INT) AS VARCHAR(9)), ' [a + ', {_B}, 'mathrm{{b}}]')
    WHEN 2 THEN concat('x^{{', CAST(l_linenumber AS VARCHAR(9)), '}} + ', {_B}, 'sqrt{{2}} - ', {_B}, 'epsilon_{{i,j}} ', {_B}, 'mid ', {_B}, 'mathbb R^n')
    ELSE concat('$', CAST(CAST(l_quantity AS INT) AS VARCHAR(9)), ' / ', CAST(l_linenumber AS VARCHAR(9)), ' = ', {_B}, 'beta_', CAST(l_linenumber AS VARCHAR(9)), '$') END AS rules,
  CASE WHEN l_partkey % 7 = 0 THEN NULL WHEN l_partkey % 3 = 0 THEN 'x + y' ELSE concat({_B}, 'frac{{', CAST(CAST(l_quantity AS INT) AS VARCHAR(9)), '}}{{', CAST(l_linenumber AS VARCHAR(9)), '}} = ', {_B}, 'alpha_', CAST(l_linenumber AS VARCHAR(9))) END AS direct
FROM lineitem
"""

#: Spoken formulas of parts.
SPOKEN = """
SELECT p_partkey AS id, p_name AS name, p_size AS size, concat(
  CASE CAST(p_partkey AS INT) % 8 WHEN 0 THEN 'the integral from zero to pie of x squared dx' WHEN 1 THEN 'x^2 + y = 3/4, so' WHEN 2 THEN 'for all x in R n, f of x'
  WHEN 3 THEN 'the pie is on the table.' WHEN 4 THEN 'p-norm of v is -3.5' WHEN 5 THEN 'epsilon-delta: a_i ≤ π' WHEN 6 THEN 'Newton''s law "F equals m a"' ELSE 'twenty one point five' END,
  ' ', CAST(p_size AS VARCHAR(9)), CASE WHEN p_size % 2 = 0 THEN '.' ELSE '' END) AS said FROM part
"""

#: A manifest of clips: four splits, some of them bad or leaking.
CLIPS = f"""
SELECT CAST(l_orderkey * 10000000000 + l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS BIGINT) AS id, CASE WHEN l_orderkey % 10 < 7 THEN 'train' WHEN l_orderkey % 10 < 9 THEN 'test' ELSE 'validation' END AS split,
  concat({_B}, 'frac{{', CAST(CAST(l_quantity AS INT) AS VARCHAR(9)), '}}{{', CAST(l_partkey % 97 AS VARCHAR(9)), '}}', CASE WHEN l_partkey % 31 = 0 THEN '(' WHEN l_partkey % 29 = 0 THEN concat(' + ', {_B}, 'foo') ELSE ' + x' END) AS target_text,
  l_extendedprice / 2500 AS duration, l_linenumber % 5 <> 0 AS synthetic, l_partkey % 41 <> 0 AS audio_ok,
  CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE 'mit' END AS license, CASE WHEN l_partkey % 19 = 0 THEN '' ELSE 'made' END AS source
FROM lineitem
"""


def derived(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    view = f"formulary_{name}"
    table(spark, sf_dir, name).createOrReplaceTempView(view)
    return spark.sql(sql.replace(f"FROM {name}", f"FROM {view}"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, PAIRS, "lineitem")


# -- the canonical form in DuckDB ----------------------------------------------------------------


def norm_sql(x: str) -> str:
    out = f"regexp_replace(coalesce({x}, ''), '\\\\(left|right|,|;|!|:|quad|qquad|displaystyle)([^a-zA-Z]|$)', '\\2', 'g')"
    for old, new in (("\\dfrac", "\\frac"), ("\\tfrac", "\\frac"), ("\\varepsilon", "\\epsilon"), ("\\text", "\\mathrm")):
        out = f"replace({out}, '{old}', '{new}')"
    for pattern, to in (
        (r"\\frac\s*(\d)\s*(\d)", r"\\frac{\1}{\2}"),
        (r"\\frac\s*\{([^{}]*)\}\s*(\d)", r"\\frac{\1}{\2}"),
        (r"\\frac\s*(\d)\s*\{", r"\\frac{\1}{"),
        (r"(^|[^\w}])(\d+)\s*/\s*(\d+)([^\w]|$)", r"\1\\frac{\2}{\3}\4"),
        (r"\\(sqrt|hat|bar|vec|tilde|overline|mathbb|mathbf|mathcal|mathrm)\s*([A-Za-z0-9])", r"\\\1{\2}"),
        (r"([\^_])\s*(\\[a-zA-Z]+|[A-Za-z0-9])", r"\1{\2}"),
        (r"\{\{([^{}]*)\}\}", r"{\1}"),
    ):
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    out = f"replace(replace({out}, '\\operatorname{{', '\\mathrm{{'), '\\mid', '|')"
    return f"trim(regexp_replace({out}, '\\s+', '', 'g'), '$')"


def _found(x: str, pattern: str) -> str:
    return f"regexp_extract_all({x}, '{pattern}')"


_COMMAND = r"\\[a-zA-Z]+"
_GREEK = "alpha|beta|gamma|delta|epsilon|zeta|eta|theta|iota|kappa|lambda|mu|nu|xi|pi|rho|sigma|tau|upsilon|phi|chi|psi|omega|Gamma|Delta|Theta|Lambda|Xi|Pi|Sigma|Phi|Psi|Omega"
_OPS = "int|sum|prod|lim|partial|nabla|leq|geq|neq|approx|pm|times|cdot|in|notin|subset|subseteq|cup|cap|to|sim|forall|exists|infty|frac|sqrt"
_CLASS_SQL = {
    "symbol": lambda x: _found(x, latex.SYMBOL),
    "greek": lambda x: f"list_filter({_found(x, _COMMAND)}, lambda t: regexp_full_match(t, '\\\\(var)?({_GREEK})'))",
    "operator": lambda x: f"list_filter({_found(x, _COMMAND + '|[=+<>-]')}, lambda t: regexp_full_match(t, '\\\\({_OPS})|[=+<>-]'))",
    "script": lambda x: _found(x, latex.SCRIPT),
    "bracket": lambda x: _found(x, latex.BRACKET),
}


def _hits(h: str, r: str) -> str:
    return f"coalesce(list_sum(list_transform(list_distinct({r}), lambda k: least(len(list_filter({h}, lambda x: x = k)), len(list_filter({r}, lambda x: x = k))))), 0)::INT"


def _distance(a: str, b: str) -> str:
    kinds = f"list_distinct(list_concat({a}, {b}))"
    coded = lambda x: f"coalesce(array_to_string(list_transform({x}, lambda t: chr(33 + list_position({kinds}, t)::INT)), ''), '')"
    return f"levenshtein({coded(a)}, {coded(b)})"


_LONG = "SELECT id, split, domain, target_text, 'rules' AS system, rules AS hyp FROM p UNION ALL SELECT id, split, domain, target_text, 'direct', direct FROM p WHERE direct IS NOT NULL"
_EACH = ", ".join(f"{f('h')} AS {c}_h, {f('r')} AS {c}_r" for c, f in _CLASS_SQL.items())


def scored_sql(keep: str) -> str:
    """Common table expressions n, t and s: the rows of l (hyp, target_text and the columns kept) with their scores."""
    return f"""n AS (SELECT *, {norm_sql("hyp")} AS h, {norm_sql("target_text")} AS r FROM l),
t AS (SELECT *, {_found("h", latex.TOKEN)} AS ht, {_found("r", latex.TOKEN)} AS rt, {_EACH} FROM n),
s AS (SELECT {keep}, (h = r)::DOUBLE AS exact, {_distance("ht", "rt")} / greatest(1, len(rt)) AS tok_edit,
{", ".join(f"{_hits(c + '_h', c + '_r')} AS {c}_hit, len({c}_r)::INT AS {c}_total" for c in _CLASS_SQL)} FROM t)"""


SCORED = f"p AS ({PAIRS}), l AS ({_LONG}), {scored_sql('id, split, domain, system')}"


def long_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = pairs(spark, sf_dir).unpivot(["id", "split", "domain", "target_text"], ["rules", "direct"], "system", "hyp")
    return long.where("hyp is not null")


def scored_pairs(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    return scoring.pair_counts(long_pairs(spark, sf_dir), *by)


@query(f"WITH {SCORED} SELECT * FROM s")
def score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One score row for each prediction."""
    return scoring.scored(long_pairs(spark, sf_dir)).drop("hyp", "target_text")


_AGG = ", ".join(f"sum({c}_hit)::DOUBLE / nullif(sum({c}_total), 0) AS {c}_acc, sum({c}_total)::BIGINT AS {c}_support" for c in _CLASS_SQL)


@query(f"WITH {SCORED} SELECT split, system, count(*) AS n, avg(exact) AS exact_match, avg(tok_edit) AS latex_token_edit, {_AGG} FROM s GROUP BY split, system")
def metrics_by_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.aggregated_pairs(scored_pairs(spark, sf_dir, "split", "system"), "split", "system")


@query(f"WITH {SCORED} SELECT domain, avg(exact) FILTER (system = 'rules') AS rules, avg(exact) FILTER (system = 'direct') AS direct, coalesce(nullif(count(*) FILTER (system = 'rules'), 0), count(*)) AS n FROM s GROUP BY domain")
def metrics_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.by_domain(scored_pairs(spark, sf_dir, "domain", "system"), ["rules", "direct"], "n")


@query(f"WITH {SCORED}, m AS (SELECT split, system, avg(exact) AS exact_match, avg(tok_edit) AS latex_token_edit FROM s GROUP BY ALL) SELECT concat_ws('/', split, system, 'exact_match') AS name, exact_match AS value FROM m UNION ALL SELECT concat_ws('/', split, system, 'latex_token_edit'), latex_token_edit FROM m")
def tracker_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics_by_system(spark, sf_dir).select("split", "system", "exact_match", "latex_token_edit")
    return scoring.flattened(m, "split", "system")


_WORDS = lambda x: f"list_filter(string_split(trim(regexp_replace(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: w <> '')"


@query(f"""WITH w AS (SELECT p_brand AS brand, {_WORDS("regexp_replace(p_name, '(\\w+) (\\w+)', '\\2 x-\\1')")} AS h, CASE WHEN len({_WORDS("p_name")}) = 0 THEN ['x'] ELSE {_WORDS("p_name")} END AS r FROM part)
SELECT brand, avg({_distance("h", "r")} / len(r)) AS wer_vs_spoken FROM w GROUP BY brand""")
def word_error_by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), "p_name")
    first = F.concat(F.regexp_replace(F.regexp_extract("p_name", r"^(.*?)(\w+) (\w+)", 0), r"(\w+) (\w+)", "$2 x-$1"), F.regexp_replace("p_name", r"^.*?(\w+) (\w+)", ""))
    return scoring.word_errors(names.withColumn("hyp", first), "brand", ref="p_name")


@query(None)
def word_error_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word errors of every turn, long ones and nulls (which count as empty) too; tests hold it against a plain word edit distance, as DuckDB compares bytes and turns have more distinct words than there are."""
    hyp = F.regexp_replace(F.regexp_replace("text", r"(\w+) (\w+)\.", "$2 $1"), " t", " ")
    return scoring.word_errors(table(spark, sf_dir, "conversations").withColumn("hyp", hyp), "role", ref="text")


# -- splits, caps, merges ------------------------------------------------------------------------

_SHARE = lambda x, of: f"((('0x' || substr(md5({x}), 1, 16))::UBIGINT::HUGEINT % {of}) * {pow(2, 64, of)} + (('0x' || substr(md5({x}), 17, 16))::UBIGINT::HUGEINT % {of})) % {of}"
_KEYED = f"SELECT id, target_text, replace(target_text, ' ', '') AS k FROM ({PAIRS})"


@query(f"""SELECT id, CASE WHEN h < 800 THEN 'test' WHEN h < 1100 THEN 'validation' ELSE 'train' END AS template_split,
CASE WHEN h < 300 THEN 'test_comp' WHEN h < 500 THEN 'validation' ELSE 'train' END AS tree_split,
CASE WHEN {_SHARE("id::VARCHAR", 5)} = 0 THEN 'test' ELSE 'train' END AS clip_split, substr(md5(id::VARCHAR), 1, 12) AS stem
FROM (SELECT id, {_SHARE("k", 10000)} AS h FROM ({_KEYED}))""")
def hash_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("id").cast("string")
    return pairs(spark, sf_dir).select(
        "id",
        datasets.split_of("target_text", datasets.TEMPLATE_SPLITS).alias("template_split"),
        datasets.split_of("target_text", datasets.TREE_SPLITS).alias("tree_split"),
        F.when(latex.md5_share(text, 5) == 0, "test").otherwise("train").alias("clip_split"),
        F.substring(F.md5(text.cast("binary")), 1, 12).alias("stem"),
    )


@query(f"SELECT id, split FROM ({PAIRS}) QUALIFY split = 'train' OR row_number() OVER (PARTITION BY split, replace(target_text, ' ', '') ORDER BY id) <= 2")
def repeat_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs(spark, sf_dir)
    return datasets.capped(rows, ["split", latex.split_key("target_text")], ["id"], 2, F.col("split") == "train").select("id", "split")


@query(f"SELECT id, target_text FROM ({PAIRS}) QUALIFY row_number() OVER (PARTITION BY target_text ORDER BY id) = 1")
def first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.capped(pairs(spark, sf_dir), ["target_text"], ["id"], 1).select("id", "target_text")


@query("SELECT o_orderkey AS ord, concat('e', format('{:06d}', row_number() OVER (ORDER BY o_orderkey) - 1)) AS expr_id FROM orders")
def dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"))
    return datasets.numbered(rows, "ord", "expr_id")


@query(f"WITH p AS ({_KEYED.replace('SELECT id,', 'SELECT id, split,')}) SELECT id, split FROM p WHERE split = 'train' OR k NOT IN (SELECT k FROM p WHERE split = 'train')")
def leak_free_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.leak_free(pairs(spark, sf_dir), "target_text").select("id", "split")


@query(f"WITH p AS (SELECT split, {norm_sql('target_text')} AS k FROM ({PAIRS})) SELECT split, count(*) FILTER (k IN (SELECT k FROM p WHERE split = 'train')) AS train_overlap FROM p WHERE split <> 'train' GROUP BY split")
def leakage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.leakage(pairs(spark, sf_dir))


@query("""WITH b AS (SELECT l_orderkey AS id, l_linenumber AS ord, l_quantity AS duration, 0 AS g FROM lineitem WHERE l_linenumber <= 2
UNION ALL SELECT l_orderkey, l_linenumber, l_quantity, 1 FROM lineitem WHERE l_linenumber > 2)
SELECT id, ord, duration FROM b QUALIFY row_number() OVER (PARTITION BY id ORDER BY g DESC, ord DESC, duration DESC) = 1""")
def keyed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ord"), F.col("l_quantity").alias("duration"))
    return datasets.merged(rows.where("ord <= 2"), rows.where("ord > 2"), "id", "ord")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 4)")
def incremental_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").where("l_linenumber = 4").select(F.col("l_orderkey").alias("id"))
    return datasets.unseen(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), done)


@query("""SELECT concat_ws('_', 'p' || p_partkey, k) AS id, CASE k % 2 WHEN 0 THEN 'ann' ELSE 'bob' END AS voice, [0.9, 1.0, 1.1][k % 3 + 1]::DOUBLE AS speed
FROM (SELECT p_partkey, unnest(range(CASE WHEN p_size % 2 = 0 THEN 6 ELSE 2 END)) AS k FROM part)""")
def voice_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), "p_size")
    return datasets.variants(rows, F.when(F.col("p_size") % 2 == 0, 6).otherwise(2), ["ann", "bob"], [0.9, 1.0, 1.1]).select("id", "voice", "speed")


@query("SELECT event_id, event_type FROM events QUALIFY (row_number() OVER (ORDER BY event_id) - 1) % 4 = 1")
def round_robin_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.shard(table(spark, sf_dir, "events"), "event_id", 4, 1).select("event_id", "event_type")


# -- checks ---------------------------------------------------------------------------------------

_ALLOWED = "[" + ", ".join(f"'{c}'" for c in sorted(set(latex.ALLOWED))) + "]"
_DEPTHS = " AND ".join(
    f"list_min(list_prepend(0, list_transform(range(1, length(target_text) + 1), lambda i: length(regexp_replace(target_text[1:i], '[^{a}]', '', 'g')) - length(regexp_replace(target_text[1:i], '[^{b}]', '', 'g'))))) = 0 AND length(regexp_replace(target_text, '[^{a}]', '', 'g')) = length(regexp_replace(target_text, '[^{b}]', '', 'g'))"
    for a, b in (("(", ")"), ("\\[", "\\]"), ("{", "}"))
)
_VALID = f"(target_text <> '' AND {_DEPTHS} AND len(list_filter(regexp_extract_all(target_text, '\\\\([a-zA-Z]+)', 1), lambda c: NOT list_contains({_ALLOWED}, c))) = 0)"
_REPORT = f"""c AS ({CLIPS}), v AS (SELECT *, {_VALID} AS valid, {norm_sql("target_text")} AS k FROM c),
r AS (SELECT split, count(*) AS n, round_even(sum(duration) / 3600, 2) AS hours, count(*) FILTER (NOT audio_ok) AS bad_audio, count(*) FILTER (NOT (duration > 0.3 AND duration < 30)) AS bad_duration,
count(*) FILTER (synthetic AND NOT valid) AS invalid_latex, count(*) FILTER (coalesce(license, '') = '' OR coalesce(source, '') = '') AS missing_license_or_source,
count(*) FILTER (synthetic) AS synthetic, count(*) FILTER (NOT synthetic) AS real,
CASE WHEN split = 'train' THEN NULL ELSE count(*) FILTER (k IN (SELECT k FROM v WHERE split = 'train')) END AS train_overlap FROM v GROUP BY split)"""


@query(f"WITH {_REPORT} SELECT * FROM r")
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = derived(spark, sf_dir, CLIPS, "lineitem")
    return datasets.quality_report(clips).join(datasets.leakage(clips), "split", "left")


@query(f"WITH {_REPORT} SELECT split, counter, value FROM (UNPIVOT r ON bad_audio, bad_duration, invalid_latex, missing_license_or_source, train_overlap INTO NAME counter VALUE value) WHERE value > 0")
def validation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.violations(validation_report(spark, sf_dir))


@query(f"""WITH c AS (SELECT *, (id % 97)::DOUBLE / 96 AS confidence, id % 11 <> 0 AS is_math, CASE WHEN id % 13 = 0 THEN 2 ELSE 0 END AS unknown, (id % 50)::INT AS tokens FROM ({CLIPS}))
SELECT id, CASE WHEN NOT is_math THEN 'not_math' WHEN confidence < 0.8 THEN 'low_confidence' WHEN NOT {_VALID} THEN 'invalid_latex' WHEN unknown > 0 THEN 'unknown_words'
WHEN NOT regexp_matches(target_text, '\\\\[a-zA-Z]+|[\\^_=]') THEN 'no_math_structure' WHEN tokens > 40 THEN 'too_long' END AS reject_reason FROM c""")
def rejection_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    reason = datasets.reject_reason(i % 11 != 0, (i % 97) / F.lit(96.0), F.col("target_text"), F.when(i % 13 == 0, 2).otherwise(0), i % 50)
    return derived(spark, sf_dir, CLIPS, "lineitem").select("id", reason.alias("reject_reason"))


_KEYS = ["the", "and", "tion", "that", "under", "license", "from"]


@query(f"""WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents)
SELECT doc_id, array_to_string(list_sort(list_intersect(w, {_KEYS})), ' ') AS keywords FROM d WHERE len(list_intersect(w, {_KEYS})) >= 2 OR list_has_any(w, ['license'])""")
def keyword_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return datasets.candidates(docs, keywords=_KEYS, core=["license"]).select("doc_id", F.array_join("keywords", " ").alias("keywords"))


@query("""WITH t AS (SELECT ['modality:audio', 'license:mit', 'task_categories:speech'] AS tags),
h AS (SELECT p_brand AS id, p_partkey AS ord, p_type AS keyword, CASE p_size % 4 WHEN 0 THEN ['license:mit', 'modality:audio'] WHEN 1 THEN ['license:odd', 'task_categories:text-to-speech'] WHEN 2 THEN ['modality:text'] ELSE ['task_categories:audio-classification', 'license:cc0-1.0', 'license:x'] END AS tags,
p_size::BIGINT AS downloads, p_size % 5 = 0 AS gated FROM part),
g AS (SELECT id, array_to_string(list_sort(list_distinct(list(keyword))), ',') AS words, arg_min({'t': tags, 'd': downloads, 'g': gated}, ord) AS f FROM h GROUP BY id),
a AS (SELECT id, words, f.d AS downloads, f.g AS gated, list_filter(f.t, lambda x: starts_with(x, 'license:'))[1][9:] AS license,
 len(list_filter(f.t, lambda x: x = 'modality:audio' OR (starts_with(x, 'task_categories:') AND (contains(x, 'speech') OR contains(x[17:], 'audio'))))) > 0 AS is_audio FROM g)
SELECT id, words, license, downloads, is_audio, coalesce(license IN ('cc-by-4.0', 'cc-by-sa-4.0', 'cc0-1.0', 'cc-by-3.0', 'cc-by-2.0', 'apache-2.0', 'mit', 'odc-by', 'cc-by-sa-3.0'), false) AS permissive,
 is_audio AND NOT gated AND coalesce(license IN ('cc-by-4.0', 'cc-by-sa-4.0', 'cc0-1.0', 'cc-by-3.0', 'cc-by-2.0', 'apache-2.0', 'mit', 'odc-by', 'cc-by-sa-3.0'), false) AS usable FROM a""")
def dataset_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    tags = F.when(size % 4 == 0, F.array(F.lit("license:mit"), F.lit("modality:audio"))).when(size % 4 == 1, F.array(F.lit("license:odd"), F.lit("task_categories:text-to-speech")))
    tags = tags.when(size % 4 == 2, F.array(F.lit("modality:text"))).otherwise(F.array(F.lit("task_categories:audio-classification"), F.lit("license:cc0-1.0"), F.lit("license:x")))
    hits = table(spark, sf_dir, "part").select(F.col("p_brand").alias("id"), F.col("p_partkey").alias("ord"), F.col("p_type").alias("keyword"), tags.alias("tags"), size.cast("long").alias("downloads"), (size % 5 == 0).alias("gated"))
    found = selection.ranked(selection.catalogue(hits))
    return found.select("id", F.array_join("matched_keywords", ",").alias("words"), "license", "downloads", "is_audio", "permissive", "usable")


@query("SELECT c_custkey, c_name FROM customer ORDER BY md5(c_custkey::VARCHAR || ':7'), c_custkey LIMIT 50")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.sampled(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 50, 7)


@query("""SELECT id, split, ok, place FROM (SELECT o_orderkey AS id, o_orderpriority AS split, o_orderstatus = 'F' AS ok, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus = 'F' ORDER BY md5(o_orderkey::VARCHAR || ':3'), o_orderkey)::INT AS place FROM orders)
WHERE place <= CASE WHEN ok THEN 10 ELSE 7 END""")
def report_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("split"), (F.col("o_orderstatus") == "F").alias("ok"))
    return selection.examples(rows, "id", 10, 3)


_PICKS = f"""WITH RECURSIVE p AS ({PAIRS}), q AS (SELECT *, (id % 5)::INT AS difficulty, target_text AS truth, replace(target_text, ' ', '') AS key, coalesce({norm_sql("direct")} = {norm_sql("target_text")}, false) AS ok_rules FROM p
  WHERE {norm_sql("rules")} = {norm_sql("target_text")} AND length(target_text) > 12 AND length(target_text) < 90),
o AS (SELECT *, row_number() OVER (ORDER BY ok_rules, split <> 'test_ood', difficulty DESC, length(truth) DESC, id) AS ord FROM q),
f AS (SELECT *, row_number() OVER (ORDER BY ord) AS place FROM (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY domain, split, key ORDER BY ord) = 1)),
w(place, keys, domains, splits, picked) AS (SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[], []::VARCHAR[], []::BIGINT[] UNION ALL
  SELECT f.place, CASE WHEN fits THEN list_append(keys, f.key) ELSE keys END, CASE WHEN fits THEN list_append(domains, f.domain) ELSE domains END, CASE WHEN fits THEN list_append(splits, f.split) ELSE splits END, CASE WHEN fits THEN list_append(picked, f.id) ELSE picked END
  FROM (SELECT w.*, f.* EXCLUDE (place), f.place AS next, NOT list_contains(keys, f.key) AND len(picked) < 24 AND len(list_filter(domains, lambda x: x = f.domain)) < 3 AND len(list_filter(splits, lambda x: x = f.split)) < 10 AS fits
    FROM w JOIN f ON f.place = w.place + 1) x, LATERAL (SELECT x.next AS place, x.key, x.domain, x.split, x.id) f),
z AS (SELECT unnest(picked) AS id, generate_subscripts(picked, 1) AS pick FROM w WHERE place = (SELECT max(place) FROM f))
SELECT id, split, domain, difficulty, true AS ok_direct, ok_rules, truth, pick FROM z JOIN o USING (id)"""


@query(_PICKS)
def demo_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy pick under caps of the rows that are right, in the order of a demonstration."""
    return selection.demonstration(scored_demo(spark, sf_dir))


def scored_demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = lambda c: F.coalesce(latex.norm_latex(c) == latex.norm_latex("target_text"), F.lit(False))
    rows = pairs(spark, sf_dir).withColumns({"ok_direct": same("rules"), "ok_rules": same("direct"), "difficulty": (F.col("id") % 5).cast("int")})
    return rows.select("id", "split", "domain", "difficulty", "ok_direct", "ok_rules", F.col("target_text").alias("truth"))


@query(f"""WITH p AS ({PAIRS}) SELECT id, domain, difficulty, length(target_text)::INT AS size FROM (SELECT *, (id % 5)::INT AS difficulty FROM p) WHERE {norm_sql("rules")} = {norm_sql("target_text")} AND length(target_text) > 12 AND length(target_text) < 90""")
def demo_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.demonstrable(scored_demo(spark, sf_dir)).select("id", "domain", "difficulty", F.length("truth").alias("size"))


@query("""WITH m AS (SELECT l_orderkey AS id, l_quantity AS duration FROM lineitem WHERE l_returnflag = 'R' QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_quantity DESC) = 1)
SELECT o_orderkey AS id, duration FROM orders JOIN m ON o_orderkey = id""")
def recorded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("duration"), F.col("l_linenumber").alias("ord"))
    return datasets.synthesized(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), made)


@query("""WITH m AS (SELECT l_orderkey AS id, l_quantity AS duration FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_quantity DESC) = 1) SELECT id, duration FROM m WHERE duration <= 20""")
def short_enough(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("duration"), F.col("l_linenumber").alias("ord"))
    return datasets.trainable(datasets.synthesized(made.select("id").distinct(), made))


@query(f"""WITH p AS (SELECT id, split, {norm_sql('target_text')} AS k FROM ({PAIRS})) SELECT id, split FROM p WHERE k NOT IN (SELECT k FROM p WHERE split = 'test_ood')""")
def unbanned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row but those whose normal form one of the unseen split holds."""
    rows = pairs(spark, sf_dir)
    return datasets.unbanned(rows, rows.where("split = 'test_ood'"), "target_text").select("id", "split")


@query("SELECT event_id, value FROM events ORDER BY event_id LIMIT 1234")
def first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truncation to a number of rows in order, which is the operator; no sort of all rows."""
    return datasets.first_rows(table(spark, sf_dir, "events").select("event_id", "value"), "event_id", 1234)


@query("SELECT o_orderpriority AS split, count(*) FILTER (o_orderstatus = 'F') AS accepted, count(*) AS total FROM orders GROUP BY 1")
def acceptance_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("split"), (F.col("o_orderstatus") == "F").alias("accepted"))
    return datasets.acceptance(rows, "split")


@query("SELECT o_orderpriority AS split, sum(l_extendedprice * l_quantity) / greatest(1, sum(l_quantity)) AS mean_loss FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def weighted_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return scoring.mean_loss(rows.select(F.col("o_orderpriority").alias("split"), F.col("l_extendedprice").alias("loss"), F.col("l_quantity").alias("tokens")), "split")


@query("SELECT ((floor((event_id - 1) / 10.0) + 1) * 10)::BIGINT AS upto, avg(value) AS mean_loss FROM events GROUP BY 1")
def running_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.running_loss(table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), F.col("value").alias("loss")))


# -- spoken text -----------------------------------------------------------------------------------


_ONES = "['" + "', '".join(spoken.ONES) + "']"
_TENS = "['" + "', '".join(spoken.TENS) + "']"
_SAID = f"CASE WHEN n < 20 THEN {_ONES}[n + 1] WHEN n < 100 THEN {_TENS}[n // 10 - 1] || CASE WHEN n % 10 = 0 THEN '' ELSE ' ' || {_ONES}[n % 10 + 1] END WHEN n = 100 THEN 'one hundred' ELSE array_to_string(list_transform(string_split(n::VARCHAR, ''), lambda d: {_ONES}[d::INT + 1]), ' ') END"


@query(f"SELECT id, CASE WHEN id % 3 = 0 AND n > 0 THEN 'minus ' || ({_SAID}) ELSE {_SAID} END AS said FROM (SELECT p_partkey AS id, (p_partkey % 150)::INT AS n FROM part)")
def numbers_in_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, n = F.col("p_partkey"), (F.col("p_partkey") % 150).cast("int")
    return table(spark, sf_dir, "part").select(key.alias("id"), spoken.say_integer(F.when(key % 3 == 0, -n).otherwise(n)).alias("said"))

