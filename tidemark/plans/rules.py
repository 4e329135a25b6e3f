"""Queries over rules and small operators, each with what it must give written out beside its input."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import names, prose
from tidemark.operators import ingest, members, store
from tidemark.plans.queries import AS_OF, query, table
from tidemark.plans.stores import folder
from tidemark.streaming.changes import matters

col = F.col


def sql(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def cases(key: str, pairs: list, j: int) -> str:
    """One of the j-th parts of pairs by a number, as SQL."""
    return f"CASE {key} % {len(pairs)} " + " ".join(f"WHEN {k} THEN {sql(p[j])}" for k, p in enumerate(pairs)) + " END"


def picked(key: Column, pairs: list, j: int) -> Column:
    return F.element_at(F.array(*[F.lit(p[j]) for p in pairs]), (key % len(pairs) + 1).cast("int"))


#: Titles and the words in them that ask for German.
TITLES = [
    ("Account Manager (German-speaking)", "German-speaking"), ("FLUENT german Consultant", "FLUENT german"), ("Native German Copywriter", "Native German"),
    ("Support, German C1", "German C1"), ("Engineer - German required!", "German required"), ("Deutschsprachiger Berater", "Deutschsprachiger"), ("Berater fließend Deutsch", "fließend Deutsch"),
    ("Germany Sales Lead", None), ("Lead for the German market", None), ("", None), (None, None), ("Nongerman speaker", None),
]


@query("f17_german_title", f"SELECT c_custkey, {cases('c_custkey', TITLES, 1)} AS phrase FROM customer")
def german_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", ingest.first_phrase(picked(col("c_custkey"), TITLES, 0), ingest.GERMAN_TITLES).alias("phrase"))


#: Descriptions and the words in them that ask for a citizenship.
PASSPORTS = [
    ("Applicants must be a German citizen, sorry.", "must be a German citizen"), ("EU work permit is required.", "EU work permit is required"), ("You must hold EU citizenship", "must hold EU citizenship"),
    ("No dual citizenship", "No dual citizenship"), ("deutsche Staatsangehörigkeit", "deutsche Staatsangehörigkeit"), ("German citizenship is a plus", None), ("We sponsor visas", None), (None, None),
]


@query("f19_citizenship", f"SELECT c_custkey, {cases('c_custkey', PASSPORTS, 1)} AS phrase FROM customer")
def citizenships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", ingest.first_phrase(picked(col("c_custkey"), PASSPORTS, 0), ingest.CITIZENSHIP).alias("phrase"))


#: Descriptions and the language that they ask for first, in the order of the list of languages.
TONGUES = [
    ("Fluent in Dutch, Polish B2", "dutch"), ("polish c1 and French required", "french"), ("native-level Japanese", "japanese"), ("a Korean speaker", "korean"), ("Frenchman, polishing", None),
    ("We like Italian food", None), ("C2 level in Hebrew", "hebrew"), ("German fluent, English native", None), (None, None),
]


@query("f20_other_language", f"SELECT c_custkey, {cases('c_custkey', TONGUES, 1)} AS lang FROM customer")
def tongues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", ingest.other_language(picked(col("c_custkey"), TONGUES, 0)).alias("lang"))


@query("f28_outdated", "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1997-10-03'")
def outdated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(store.outdated("o_orderdate", AS_OF)).select("o_orderkey")


#: Operations, touched fields, and whether they matter.
TOUCHED = [
    ("update", "scrapedAt|applyClicks", "false"), ("update", "scrapedAt|Status", "true"), ("update", "SalaryMin.x", "true"), ("insert", "scrapedAt", "true"), ("delete", None, "true"),
    ("update", None, "true"), (None, "scrapedAt", "true"), ("update", "StatusNote", "false"),
]


@query("f37_significant", f"SELECT event_id, {cases('event_id', TOUCHED, 2)} = 'true' AS matters FROM events")
def significant(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = col("event_id")
    return table(spark, sf_dir, "events").select(key, matters(picked(key, TOUCHED, 0), F.split(picked(key, TOUCHED, 1), r"\|")).alias("matters"))


@query("s12_changed_boards", """SELECT source FROM documents GROUP BY 1 HAVING bool_or(doc_id % 41 = 7) OR source IN ('src3', 'src4')""")
def changed_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards that differ from the last run: rows are new, or gone, or the board is."""
    now = table(spark, sf_dir, "documents").select("source", "doc_id")
    old = now.where("doc_id % 41 <> 7 and source <> 'src3'").unionByName(now.where("source = 'src4'").groupBy("source").agg((-F.max("doc_id") - 1).alias("doc_id")))
    none = old.limit(0).select("source", F.lit("").alias("hash"), F.lit(0).cast("long").alias("n"))
    state = store.changed_boards(old, none, "source", "doc_id")
    return store.changed_boards(now, state, "source", "doc_id").select("source")


@query("s21_run_log", """SELECT source, run, n FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1), (SELECT unnest([1, 2]) AS run)""")
def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of two runs, each appended."""
    path, counts = folder(spark, "run-log"), table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    for run in (1, 2):
        store.appended(counts.withColumn("run", F.lit(run)), path)
    return spark.read.parquet(path).select("source", "run", "n")


@query("s23_listed_lines", r"SELECT DISTINCT lower(trim(line)) AS value FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(lower(trim(line)), '^[a-z][a-z .]{3,60}$')")
def listed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "lines")
    table(spark, sf_dir, "documents").where("text is not null").select(F.regexp_replace("text", "\r", "").alias("value")).write.text(path)
    return store.listed(spark, path, "^[a-z][a-z .]{3,60}$")


#: Boilerplate at the end, and what of it stays: it is cut only in the last three tenths of a text.
TAILS = [
    ("aaaaaaaaaa", "\nWe are an equal opportunity employer.", "true"), ("#LI-Remote aaaaaaaaaa", "\n  Equal Employment Opportunity applies", "true"),
    ("aaaaaaaaaa", "\nEmployees are equal here.", "false"), ("aaaaaaaaaa", "\n\n\n\nPursuant to the San Francisco rule", "true"), ("aaaaaaaaaa", "", "false"),
]


@query("x33_without_tail", f"""SELECT doc_id, md5(CASE WHEN {cases('doc_id', TAILS, 2)} = 'true' THEN head WHEN doc_id % {len(TAILS)} = 2 THEN head || chr(10) || 'Employees are equal here.' ELSE head END) AS text
 FROM (SELECT doc_id, repeat('a', 10 * (20 + (doc_id % 50)::INT)) AS head FROM documents)""")  # fmt: skip
def tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with boilerplate behind them, and tracking tags in front."""
    key = col("doc_id")
    body = F.repeat(F.lit("aaaaaaaaaa"), (key % 50 + 19).cast("int"))
    text = F.concat(picked(key, TAILS, 0), body, picked(key, TAILS, 1))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(prose.without_tail(text)).alias("text"))


@query("x35_snippet", r"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN md5(repeat('a', 1000) || chr(10) || chr(10) || '--- REQUIREMENTS SECTION ---' || chr(10) || repeat(substr('klmnopqrst', (doc_id % 10)::INT + 1, 1), 150 + (doc_id % 7)::INT)
 || chr(10) || '--- END REQUIREMENTS ---' || chr(10) || chr(10) || repeat('z', 1000)) WHEN doc_id % 4 = 1 THEN md5(repeat('a', 1500) || chr(10) || '...' || chr(10) || repeat('z', 2500)) ELSE md5('short') END AS text FROM documents""")  # fmt: skip
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long texts with requirements, long ones without, and short ones."""
    key = col("doc_id")
    asked = F.repeat(F.substring(F.lit("klmnopqrst"), (key % 10 + 1).cast("int"), F.lit(1)), (key % 7 + 150).cast("int"))
    a, z = F.repeat(F.lit("a"), 2000), F.repeat(F.lit("z"), 3000)
    long = F.concat(a, F.lit("\n  What you bring:\n"), asked, F.lit("\nBenefits\n"), z)
    text = F.when(key % 2 == 0, long).when(key % 4 == 1, F.concat(a, F.lit("\nWhat you bring\nlittle\nBenefits\n"), z)).otherwise("short")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(prose.snippet(text)).alias("text"))


@query("p20_clean_skills", """SELECT p_partkey, p_name || '/' || CASE WHEN p_partkey % 3 = 0 THEN 'Tool' ELSE 'Other' END || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ',b/Other' END AS skills FROM part""")
def clean_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = col("p_partkey")
    skill = lambda n, c: F.struct(n.alias("name"), c.alias("category"))
    made = F.array(
        skill(F.concat(F.lit(" "), "p_name", F.lit("\t")), F.when(key % 3 == 0, "Tool").when(key % 3 == 1, "tool")), skill(F.lit("  "), F.lit("Tool")),
        skill(F.when(key % 2 == 1, "b"), F.lit("Else")),
    )
    clean = names.clean_skills(made, ["Tool", "Cloud"])
    return table(spark, sf_dir, "part").select(key, F.array_join(F.transform(clean, lambda s: F.concat_ws("/", s["name"], s["category"])), ",").alias("skills"))


@query("f41_articles", """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'slug' WHEN p_brand = 'Brand#2' THEN 'category' ELSE 'all' END AS "by" FROM part WHERE p_partkey % 3 <> 0 AND (p_partkey % 5 <> 0 OR p_partkey = 25)""")
def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published articles, by slug, by category, and all."""
    key = col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        key, F.concat(F.lit("a-"), F.when(key % 5 == 0, key).otherwise(-1).cast("string")).alias("slug"), col("p_brand").alias("category"), F.when(key % 3 == 0, "draft").otherwise("published").alias("status")
    )
    one = store.articles(rows, slug="A-25").select(key, F.lit("slug").alias("by"))
    rest = rows.where("slug = 'a--1'")
    own = store.articles(rest, category="Brand#2").select(key, F.lit("category").alias("by"))
    every = store.articles(rest).join(own, "p_partkey", "left_anti").select(key, F.lit("all").alias("by"))
    return one.unionByName(own).unionByName(every)


@query("f43_to_probe", """SELECT c_custkey, again FROM customer, (SELECT unnest([false, true]) AS again) WHERE c_custkey % 4 = 3 OR (again AND c_custkey % 4 = 1)""")
def to_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are worth a probe, with empty ones tried again or not."""
    key = col("c_custkey")
    seen = table(spark, sf_dir, "customer").where("c_custkey % 4 <> 3").select(key, F.when(key % 4 == 0, "dead").when(key % 4 == 1, "empty").otherwise("hit").alias("status"))
    every = table(spark, sf_dir, "customer").select(key)
    found = [store.to_probe(every, seen, ["c_custkey"], again).withColumn("again", F.lit(again)) for again in (False, True)]
    return found[0].unionByName(found[1])


@query("m11_backfilled", """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'own' WHEN c_custkey % 3 = 0 THEN 'a,b' WHEN c_custkey % 3 = 1 THEN 'c' ELSE '' END AS wanted,
 c_custkey % 4 <> 0 AND c_custkey % 3 <> 2 AS changed, 'c_custkey,desiredCategories,updatedAt' AS "columns" FROM customer""")  # fmt: skip
def backfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = col("c_custkey")
    users = table(spark, sf_dir, "customer").select(
        key, F.when(key % 4 == 0, F.array(F.lit("own"))).when(key % 4 == 1, F.array().cast("array<string>")).alias("desiredCategories"),
        F.when(key % 3 == 0, "Tech").when(key % 3 == 1, "Non-Tech").alias("domain"), F.lit("x").alias("sentJobIds"), F.lit(datetime(2020, 1, 1)).alias("updatedAt"),
    )
    made = members.backfilled(users, {"Tech": ["a", "b"], "Non-Tech": ["c"]}, ("domain", "sentJobIds", "desiredRoles"), AS_OF)
    return made.select(key, F.array_join("desiredCategories", ",").alias("wanted"), (F.year("updatedAt") != 2020).alias("changed"), F.lit(",".join(made.columns)).alias("columns"))
