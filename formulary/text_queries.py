"""Queries over spoken text from its first step to its metrics, and over what is drawn for the rows of a table.

A case is what is said, its tokens, its score as mathematics, the formula, how sure it is, how it came
about, and the formula as text; {k} is a part's size. Views and probes take their formulas from the
groups of the phrase queries, of which every third reference is another one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formulary import phrase_queries
from formulary.functions import spoken
from formulary.operators import datasets, normalize, scoring
from formulary.phrase_queries import SLOTS, _choice
from formulary.plans import evaluation
from formulary.queries import _AGG, _WORDS, _distance, derived, query, scored_sql, table
from formulary.sources import scan
from formulary.sources.folders import shared_folder

CASES = [
    ("the integral from zero to pie of x squared dx {k}.", "the integral from zero to pie of x squared d x {k}", 6.5, r"\int_0^\pi x^2\,dx{k}", 1.0, "rules", "∫₀^π x² dx{k}"),
    ("x^2 + y = 3/4, so {k}", "x squared plus y equals 3 over 4 so {k}", 6.5, r"x^2+y=\frac{{3}}{{4}}{k}", 1.0, "rules", "x² + y = ¾{k}"),
    ("for all x in R n, f of x {k}.", "for all x in R n f of x {k}", 5.0, r"\forall x\in\mathbb{{R}}^nf(x){k}", 1.0, "rules", "∀x ∈ ℝⁿf(x){k}"),
    ("the pie is on the table. {k}", "the pie is on the table {k}", 2.5, r"\pi\text{{on}}\text{{table}}{k}", 0.143, "rules", "πontable{k}"),
    ("p-norm of v is -3.5 {k}.", "p norm of v is minus 3.5 {k}", 4.0, r"\|v\|_p-3.5{k}", 1.0, "rules", "‖v‖ₚ − 3.5{k}"),
    ("epsilon-delta: a_i ≤ π {k}", "epsilon delta a sub i less than or equal to pi {k}", 7.5, r"\epsilon\delta a_i\leq\pi {k}", 1.0, "rules", "ϵδaᵢ ≤ π{k}"),
    ("Newton's law \"F equals m a\" {k}.", "Newton s law F equals m a {k}", 3.0, r"\text{{Newton}}s\text{{law}}F=ma{k}", 0.25, "rules", "NewtonslawF = ma{k}"),
    ("twenty one point five {k}", "twenty one point five {k}", 2.0, "21.5{k}", 1.0, "rules", "21.5{k}"),
    ("We met at noon; it was late...", "We met at noon it was late", 0.0, "We met at noon; it was late...", 0.0, "passthrough", "We met at noon; it was late..."),
    (" I have a dog and {k} cats ", "I have a dog and {k} cats", 0.5, "I have a dog and {k} cats", 0.0, "passthrough", "I have a dog and {k} cats"),
    ("  ", "", 0.0, "", 0.0, "rules", ""),
    ("x^3 × y_2 ÷ {k}", "x cubed times y sub 2 divided by {k}", 6.0, r"x^3y_2\div {k}", 1.0, "rules", "x³y₂ ÷ {k}"),
    (r"\(λ\) ∈ R", "lambda in R", 1.5, r"\lambda\in\mathbb{{R}}", 1.0, "rules", "λ ∈ ℝ"),
    ("$z^k$ − 4 = 2.", "z to the k minus 4 equals 2", 4.0, "z^k-4=2", 1.0, "rules", "zᵏ − 4 = 2"),
]
_K = {"k": "CAST(p_size AS VARCHAR(9))"}


def _case(column: int) -> str:
    if isinstance(CASES[0][column], str):
        return _choice(CASES, column, _K)
    return f"CASE CAST(p_partkey % {len(CASES)} AS INT) " + " ".join(f"WHEN {k} THEN CAST({c[column]} AS DOUBLE)" for k, c in enumerate(CASES)) + " END"


_SAID = f"SELECT p_partkey AS id, {_case(0)} AS said FROM part"


@query(f"SELECT p_partkey AS id, {_case(0)} AS said, {_case(1)} AS tokens, {_case(2)} AS math_score, {_case(2)} >= 1.5 AS is_math FROM part")
def spoken_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and the mathematics gate."""
    rows = derived(spark, sf_dir, _SAID, "part").withColumn("tokens", spoken.tokenize("said"))
    return rows.select("id", "said", F.array_join("tokens", " ").alias("tokens"), spoken.math_score(F.col("tokens")).alias("math_score"), spoken.is_math(F.col("tokens")).alias("is_math"))


@query(f"SELECT p_partkey AS id, {_case(0)} AS said, {_case(3)} AS latex, {_case(4)} AS confidence, {_case(5)} AS method, {_case(2)} >= 1.5 AS is_math, {_case(6)} AS shown FROM part")
def normalized_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spoken formulas to LaTeX, with how sure they are, and to text."""
    rows = normalize.canonicalized(derived(spark, sf_dir, _SAID, "part"), "said")
    return rows.select("id", "said", "result.latex", "result.confidence", "result.method", "result.is_math", normalize.text_of("result.latex").alias("shown"))


# -- views, predictions and probes -----------------------------------------------------------------

_READ = [pair for group in ("fractions", "powers", "sums") for pair in phrase_queries.SPOKEN[group]]
_ASKED, _MEANT, _OTHER = _choice(_READ, 0, SLOTS), _choice(_READ, 1, SLOTS), _choice(_READ[1:] + _READ[:1], 1, SLOTS)
_TARGET = f"CASE WHEN p_partkey % 3 = 0 THEN {_OTHER} ELSE {_MEANT} END"
#: What was heard, and the reference.
HEARD = f"SELECT p_partkey AS id, p_brand AS split, {_ASKED} AS said, {_TARGET} AS target_text FROM part"
_MEANS = f"SELECT p_partkey AS id, {_MEANT} AS meant FROM part"


@query(f"""WITH h AS ({HEARD}), m AS ({_MEANS}), l AS (SELECT id, split, target_text, 'raw' AS view, said AS hyp FROM h UNION ALL SELECT id, split, target_text, 'rules', meant FROM h JOIN m USING (id)),
{scored_sql("id, split, view")} SELECT split, view, count(*) AS n, avg(exact) AS exact_match, avg(tok_edit) AS latex_token_edit, {_AGG} FROM s GROUP BY split, view""")
def metrics_by_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of what was heard as it is, and of the same through the rules."""
    heard = derived(spark, sf_dir, HEARD, "part").select("id", "split", "target_text", F.lit("asr").alias("system"), F.col("said").alias("hyp"))
    rows = normalize.viewed(heard, [("raw", "asr", False), ("rules", "asr", True)])
    return scoring.aggregated_pairs(scoring.pair_counts(rows, "split", "view"), "split", "view")


_PREDICTED = f"SELECT p_partkey + CASE WHEN p_size % 9 = 0 THEN 1000000000 ELSE 0 END AS id, {_MEANT} AS canonical, CASE WHEN p_size % 4 = 0 THEN NULL ELSE {_OTHER} END AS zeroshot FROM part"


@query(f"""WITH h AS ({HEARD}), w AS ({_PREDICTED}), l AS (SELECT id, split, system, hyp, target_text FROM (SELECT id, 'canonical' AS system, canonical AS hyp FROM w UNION ALL SELECT id, 'zeroshot', zeroshot FROM w WHERE zeroshot IS NOT NULL) JOIN h USING (id)),
{scored_sql("id, split, system")} SELECT split, system, count(*) AS n, avg(exact) AS exact_match, avg(tok_edit) AS latex_token_edit, {_AGG} FROM s GROUP BY split, system""")
def predictions_on_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column a system becomes a row each; predictions meet the manifest by id, and what either side lacks is left out."""
    manifest = derived(spark, sf_dir, HEARD, "part").select("id", "split", "target_text")
    rows = scoring.long_predictions(derived(spark, sf_dir, _PREDICTED, "part")).join(manifest, "id")
    return scoring.aggregated_pairs(scoring.pair_counts(rows, "split", "system"), "split", "system")


_LABEL = f"concat('$', chr(92), 'displaystyle ', {_TARGET}, chr(92), ',', chr(92), 'quad$')"
_SLIP = f"regexp_replace({_ASKED}, '^(.[^ ]*) ', 'a ')"
PROBE = f"SELECT p_partkey AS id, {_ASKED} AS heard, {_SLIP} AS transcription, CASE WHEN p_size % 2 = 0 THEN {_TARGET} ELSE {_OTHER} END AS tuned, {_LABEL} AS label, {_TARGET} AS target_text FROM part"


@query(f"""WITH p AS ({PROBE}), m AS ({_MEANS}), l AS (SELECT id, 'zeroshot' AS system, heard AS hyp, target_text FROM p UNION ALL SELECT id, 'rules', meant, target_text FROM p JOIN m USING (id) UNION ALL SELECT id, 'tuned', tuned, target_text FROM p),
{scored_sql("id, system")}, w AS (SELECT {_WORDS("heard")} AS h, {_WORDS("transcription")} AS r FROM p), e AS (SELECT avg({_distance("h", "r")} / len(r)) AS wer FROM w)
SELECT system, count(*) AS n, avg(exact) AS exact_match, avg(tok_edit) AS latex_token_edit, {_AGG}, CASE WHEN system = 'zeroshot' THEN (SELECT wer FROM e) END AS wer_vs_spoken FROM s GROUP BY system""")
def outside_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three systems against labels from elsewhere, which are cleaned first; word errors of what was heard."""
    return evaluation.probed(derived(spark, sf_dir, PROBE, "part").drop("target_text"))


# -- manifests and candidates ------------------------------------------------------------------------

_MADE = """SELECT concat('p', CAST(p_partkey AS VARCHAR(20))) AS id, concat(CASE CAST(p_size AS INT) % 3 WHEN 0 THEN '/data/' WHEN 1 THEN '/other/' ELSE '/datas/' END, p_name, '.flac') AS audio, p_name AS spoken_text, p_type AS latex, p_brand AS domain,
p_brand AS voice, 'made' AS source, 'mit' AS license, CAST(p_size % 5 + 1 AS INT) AS difficulty, 'line' AS template, p_retailprice / 100 AS duration, 1.1 * CAST(1 AS DOUBLE) AS speed, CASE WHEN p_size % 7 = 0 THEN 'test' ELSE 'train' END AS split FROM part"""
_FOUND = """SELECT concat('real_', CAST(c_custkey AS VARCHAR(20))) AS id, concat('/data/', c_name, '.flac') AS audio, c_name AS asr_transcript, c_mktsegment AS canonical, 'real_science' AS domain, CASE WHEN c_nationkey % 2 = 0 THEN c_name END AS speaker_id,
'corpus' AS source, 'cc0-1.0' AS license, c_acctbal / 1000 AS duration, c_acctbal / 10000 AS confidence, 'test' AS split, CASE c_nationkey % 4 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS accepted FROM customer"""
_PATH = "CASE WHEN starts_with(audio, '/data/') THEN audio[7:] ELSE audio END AS audio"


@query(f"""SELECT id, {_PATH}, spoken_text AS spoken_transcript, latex AS target_text, domain, true AS synthetic, voice AS speaker_id, source, license, difficulty, template, duration, 1.0::DOUBLE AS confidence, speed, split FROM ({_MADE})
UNION ALL SELECT id, {_PATH}, asr_transcript, canonical, domain, false, coalesce(speaker_id, 'unknown'), source, license, 3, 'real', duration, confidence, 1.0, split FROM ({_FOUND}) WHERE accepted""")
def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic and accepted real clips under one schema, with paths below the root."""
    return datasets.manifest(derived(spark, sf_dir, _MADE, "part"), derived(spark, sf_dir, _FOUND, "customer"))


_TIMED = ["the", "and", "that", "under", "from"]


@query(f"""WITH d AS (SELECT doc_id, n_chars / 50.0 AS seconds, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents)
SELECT doc_id, seconds::DOUBLE AS seconds, array_to_string(list_sort(list_intersect(w, {_TIMED})), ' ') AS keywords FROM d WHERE (len(list_intersect(w, {_TIMED})) >= 2 OR list_has_any(w, ['license'])) AND seconds BETWEEN 2 AND 30""")
def timed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by their words that last from 2 to 30 seconds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("n_chars") / 50.0).alias("seconds"))
    return datasets.candidates(docs, duration="seconds", keywords=_TIMED, core=["license"]).select("doc_id", "seconds", F.array_join("keywords", " ").alias("keywords"))


_SCANNED, _WANTED = 7_000, 400


@query(f"""WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents)
SELECT doc_id, place FROM d WHERE (len(list_intersect(w, {_TIMED})) >= 2 OR list_has_any(w, ['license'])) AND place < {_SCANNED} ORDER BY place LIMIT {_WANTED}""")
def scanned_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bounded scan of documents, in their order, as a stream of batches into a log: it ends with so many rows read or so many accepted, which is the feature."""
    out = shared_folder(spark, "scan")
    accept = lambda rows: datasets.candidates(rows, keywords=_TIMED, core=["license"]).select("doc_id", scan.PLACE)
    writer, schema = scan.scanning(spark, f"{sf_dir}/documents.parquet", out, accept, _SCANNED, _WANTED, batch_rows=_SCANNED // 7)
    run = writer.start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    return scan.accepted(spark, out, schema, _WANTED)


# -- formulas drawn for rows ---------------------------------------------------------------------------


@query(None)
def formula_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas drawn for every part: its key seeds them, its size says how many, its type from which domain; tests hold them against plain draws."""
    from formulary.sources.formulas import WEIGHTS, drawn_for

    domains = F.array(*map(F.lit, WEIGHTS))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 4).alias("n"), F.element_at(domains, (F.col("p_partkey") % len(WEIGHTS) + 1).cast("int")).alias("only"))
    return drawn_for(part, seed="id", n="n", domain="only", most_repeats=2)


@query(None)
def composed_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random trees for every part, as deep as its size says; tests hold them against plain draws."""
    from formulary.sources.formulas import composed_for

    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 3).alias("n"), (F.col("p_size") % 3 + 1).alias("depth"))
    return composed_for(part, seed="id", n="n", most_depth="depth", most_repeats=1)
