"""Skill matching: postings ranked by how much of what they ask for a profile has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import js_trim
from tidemark.operators.ranking import cap_per_group

# Names of one skill, the canonical one first; a name in two groups belongs to the later one.
SYNONYMS = [
    ["javascript", "js"], ["typescript", "ts"], ["nodejs", "node"], ["reactjs", "react"], ["vuejs", "vue"],
    ["angularjs", "angular"], ["nextjs", "next"], ["expressjs", "express"], ["nestjs", "nest"],
    ["postgresql", "postgres", "psql"], ["mongodb", "mongo"], ["mysql", "mariadb"], ["kubernetes", "k8s"],
    ["docker", "containers", "containerization"], ["amazonwebservices", "aws"],
    ["googlecloudplatform", "gcp", "googlecloud"], ["microsoftazure", "azure"], ["machinelearning", "ml"],
    ["artificialintelligence", "ai"], ["naturallanguageprocessing", "nlp"], ["deeplearning", "dl"],
    ["largelanguagemodel", "llm", "llms"], ["continuousintegrationcontinuousdelivery", "cicd", "ci", "cd"],
    ["csharp", "c#", "dotnet", "net"], ["cplusplus", "cpp", "c++"], ["golang", "go"], ["python3", "python", "py"],
    ["java", "jvm"], ["rubyonrails", "rails", "ror"], ["springboot", "spring"], ["graphql", "gql"],
    ["restapi", "rest", "restful", "restapis"], ["terraform", "tf"], ["figma", "sketch", "adobexd"],
    ["tailwindcss", "tailwind"], ["sass", "scss"], ["elasticsearch", "elastic", "es"], ["apachekafka", "kafka"],
    ["rabbitmq", "amqp"], ["redis", "rediscache"], ["github", "git"], ["gitlab", "git"], ["bitbucket", "git"],
    ["jira", "atlassian"], ["dataanalysis", "dataanalytics", "analytics"], ["businessintelligence", "bi"],
    ["powerbi", "microsoftbi"], ["tableau", "tableaudesktop"], ["sapfiori", "sap"],
    ["linux", "unix", "ubuntu", "debian", "centos"], ["agile", "scrum", "kanban"],
    ["projectmanagement", "pm", "projectmanager"], ["productmanagement", "productmanager"],
    ["userexperience", "ux", "uxdesign"], ["userinterface", "ui", "uidesign"],
    ["devops", "sre", "siterelibilityengineering", "sitereliabilityengineering"],
    ["dataengineering", "dataengineer", "etl"], ["datascience", "datascientist", "ds"],
    ["microservices", "microservice"], ["objectrelationalmapping", "orm"], ["contentmanagementsystem", "cms"],
    ["searchengineoptimization", "seo"], ["continuousintegration", "jenkins", "circleci", "githubactions"],
    ["monitoring", "observability", "datadog", "grafana", "prometheus"], ["messagequeue", "mq", "pubsub"],
    ["api", "apis", "webservices"], ["html", "html5"], ["css", "css3"], ["swift", "swiftui"],
    ["kotlin", "kotlinmultiplatform"], ["flutter", "dart"], ["reactnative", "rn"],
]
# Ranks of levels.
LEVELS = {
    "entry": 0, "junior": 0, "intern": 0, "mid": 1, "midlevel": 1, "mid-level": 1, "senior": 2, "staff": 3, "principal": 3,
    "lead": 3, "manager": 3, "director": 4, "vp": 5, "head": 4, "c-level": 5, "executive": 5,
}
# What a gap of so many levels leaves of a score.
GAPS = [1.0, 0.85, 0.6, 0.3]
WEIGHTS = {"required": 3, "preferred": 1, "tools": 1}


def canonical_names() -> dict[str, str]:
    return {name: group[0] for group in SYNONYMS for name in group}


def squeezed(name: Column) -> Column:
    """Lower case without dots, dashes, slashes, spaces and parentheses."""
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[.\\-/\\s\u00A0()]+", "")


def canonical_skill(name: Column) -> Column:
    """The canonical name of a skill."""
    own = squeezed(name)
    # one literal map of some 200 names
    table = F.create_map(*[F.lit(x) for pair in canonical_names().items() for x in pair])
    return F.coalesce(F.try_element_at(table, own), own)


def vague(name: Column) -> Column:
    """Names of more than four words, which match nobody."""
    return F.size(F.split(name, "[\\s\u00A0]+")) > 4


def match_scores(postings: DataFrame, key: str, skills: list[str]) -> DataFrame:
    """(key, score, raw, most, matched, asked): postings with a match, by their skill arrays.

    ``postings`` has the arrays of names ``required``, ``preferred`` and ``tools``.  Each
    canonical skill of the profile counts once, in the order of these arrays; repeats and
    skills that are lacking still count in the denominator.  Required skills carry 0.8 of
    the score, the others 0.2; without required skills the others carry all.
    """

    def weighed(column: str, weight: int) -> Column:
        entry = lambda n: F.struct(n.alias("name"), F.lit(weight).alias("weight"), F.lit(column == "required").alias("must"))
        return F.transform(F.coalesce(column, F.array().cast("array<string>")), entry)

    lists = F.concat(*[weighed(c, w) for c, w in WEIGHTS.items()])
    some = F.filter(lists, lambda s: F.coalesce((s["name"] != "") & ~vague(s["name"]), F.lit(False)))
    each = postings.select(key, F.posexplode(some).alias("at", "s")).select(key, "at", "s.*", canonical_skill(F.col("s.name")).alias("skill"))
    mine = [canonical_names().get(n, n) for n in (s.lower().translate(str.maketrans("", "", ".-/ ()\t\n\u00A0")) for s in skills)]
    had = F.col("skill").isin(mine)
    # the first of equal skills of a posting counts
    first = F.min(F.struct("at", "weight", "must", "name")).alias("f")
    by_skill = each.groupBy(key, "skill").agg(
        first, F.sum(F.when(F.col("must"), F.col("weight"))).alias("must_all"), F.sum(F.when(~F.col("must"), F.col("weight"))).alias("may_all"), F.count("*").alias("n")
    )
    won = lambda must: F.coalesce(F.sum(F.when(had & (F.col("f.must") == must), F.col("f.weight"))), F.lit(0))
    sums = by_skill.groupBy(key).agg(
        won(True).alias("must"), won(False).alias("may"), F.coalesce(F.sum("must_all"), F.lit(0)).alias("must_all"), F.coalesce(F.sum("may_all"), F.lit(0)).alias("may_all"),
        F.count_if(had).alias("matched"), F.sum("n").alias("asked"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    score = F.when(F.col("must_all") > 0, share("must", "must_all") * 0.8 + share("may", "may_all") * 0.2).otherwise(share("may", "may_all"))
    return sums.where("must + may > 0").select(
        key, score.alias("score"), (F.col("must") + F.col("may")).alias("raw"), (F.col("must_all") + F.col("may_all")).alias("most"), "matched", "asked"
    )


def level_factor(mine: str | None, level: Column) -> Column:
    """Same level 1, one apart 0.85, two 0.6, more 0.3; unknown levels cost nothing."""
    rank = LEVELS.get((mine or "").lower().strip(), -1)
    own = F.try_element_at(F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair]), F.lower(js_trim(F.coalesce(level, F.lit("")))))
    gap = F.when(own.isNotNull(), F.least(F.abs(own - rank), F.lit(len(GAPS) - 1)))  # least alone would skip a null
    return F.coalesce(F.get(F.array(*[F.lit(g) for g in GAPS]), gap), F.lit(1.0)) if rank >= 0 else F.lit(1.0)


def domain_factor(mine: str | None, domain: Column) -> Column:
    """Same domain 1, technical against non-technical 0.75, others 0.85; unknown ones cost nothing."""
    if not mine:
        return F.lit(1.0)
    other = {"technical": "non-technical", "non-technical": "technical"}.get(mine.lower(), "")
    low = F.lower(F.coalesce(domain, F.lit("")))
    return F.when(low.isin("", mine.lower()), 1.0).when(low == other, 0.75).otherwise(0.85)


def signed32(x: Column) -> Column:
    """A long as the 32-bit number of its low bits."""
    return F.shiftright(F.shiftleft(x, 32), 32)


def daily_tie(key: Column, seed: int) -> Column:
    """A 32-bit hash of an ASCII key and a day's number: h * 31 + c, mixed with the seed."""
    codes = F.transform(F.split(key, ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: signed32(a * 31 + c))
    x = h.bitwiseXOR(F.lit(seed)).bitwiseAND(F.lit(0xFFFFFFFF))
    # 32 times 32 bits in halves, so that no product leaves 64 bits
    low, high = x.bitwiseAND(F.lit(0xFFFF)), F.shiftright(x, 16)
    product = (low * 2654435761 + F.shiftleft((high * 2654435761).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(0xFFFFFFFF))
    return signed32(product.bitwiseXOR(F.shiftright(product, 15)))


def ranked(scored: DataFrame, key: str, company: str, seed: int, limit: int = 10, cap: int = 2) -> DataFrame:
    """The best ``limit`` rows with ``score``: by bands of 0.1, a daily hash, then the score; ``cap`` a company."""
    rows = scored.withColumns({"band": F.floor(F.col("score") * 10 + 0.5), "tie": daily_tie(F.col(key).cast("string"), seed), "_own": F.coalesce(F.nullif(squeezed(F.col(company)), F.lit("")), F.lit("unknown"))})
    order = (F.col("band").desc(), F.col("tie").asc(), F.col("score").desc(), F.col(key).asc())
    return cap_per_group(rows, F.col("_own"), cap, *order).orderBy(*order).limit(limit).drop("_own")
