"""Categories of postings: a cascade of word lists, the first list that fits decides."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Titles that are not technical.
OTHER_TITLES = [
    "account executive", "account manager", "account director", "sales manager", "sales director", "sales rep",
    "sales development", "business development", " bdr", " sdr", "revenue manager",
    "marketing manager", "marketing director", "marketing specialist", "growth manager", "brand manager",
    "content manager", "product marketing", "email marketing", "digital marketing", "field marketing", "social media",
    "customer success", "cs manager", "customer experience", "cx manager", "customer support", "customer service",
    "customer care", "community manager",
    "recruiter", "recruiting", "talent acquisition", "talent partner", "sourcing", "people partner", "people manager",
    "hr manager", "people & culture", "hr business", "human resources",
    "finance manager", "financial controller", "accountant", "accounting", "controller", "auditor", "audit ",
    "tax manager", "treasury", "legal counsel", "attorney", "paralegal", "compliance officer", "compliance",
    "risk manager", "risk controller", "risk analyst",
    "procurement", "purchasing", "category manager", "supply chain", "logistics", "warehouse", "fulfillment",
    "operations manager", "ops manager", "business operations", "strategic operations",
    "office manager", "admin assistant", "executive assistant", "partner manager", "channel partner", "consultant",
    "business consultant", "training manager", "product trainer", "translator", "clinical", "dietitian",
]
# Titles of data work.
DATA_TITLES = [
    "data scientist", "data analyst", "data engineer", "data architect", "data steward", "data lead", "data manager",
    "analytics engineer", "analytics manager", "analytics lead", "growth analytics",
    "machine learning", "ml engineer", "mlops", "ml ops", "ml researcher", "ai engineer", "ai researcher",
    "ai scientist", "ai/ml", "ai/bi", "genai", "gen ai", "llm engineer", "llm developer", "llm pre-training",
    "llm post-training", "llm training", "prompt engineer", "deep learning", "computer vision", "nlp engineer",
    "bi engineer", "bi analyst", "bi developer", "business intelligence", "data platform", "data infrastructure",
    "data ops", "dataops", "algorithm engineer", "algorithms engineer", "research engineer (llm", "research scientist",
]
# Titles of software work.
SOFTWARE_TITLES = [
    "software engineer", "software developer", "software architect", "backend", "back-end", "back end", "frontend",
    "front-end", "front end", "fullstack", "full-stack", "full stack", "devops", "dev ops", "sre", "site reliability",
    "platform engineer", "infrastructure engineer", "cloud engineer", "ios developer", "ios engineer",
    "android developer", "android engineer", "mobile engineer", "web developer", "web engineer", "security engineer",
    "application security", "appsec", "qa engineer", "qa automation", "test engineer", "sdet", "test automation",
    "release engineer", "build engineer", "integration engineer", "developer tools", "staff engineer",
    "principal engineer", "engineering manager", "engineering director", "engineering lead", "head of engineering",
    "director of engineering", "tech lead", "technical lead", "firmware", "embedded", "hardware engineer",
    "robotics engineer", "mechatronic", "systems engineer", "system engineer", "automation engineer", "r&d engineer",
    "salesforce developer", "salesforce engineer", "sap developer", "sap engineer", "sap solution architect",
    "sap consultant", "application engineer", "applications engineer", "application owner", "product engineer",
    "research engineer", "deployed engineer", "forward deployed", "forward deploy", "solutions engineer",
    "solution engineer", "solutions architect", "solution architect", "enterprise architect", "domain architect",
    "customer engineer", "field engineer", " developer ", " developer (", " developer,", "developer (f/",
    "developer (m/", "senior developer", "junior developer", "lead developer", "c++ engineer", "rust engineer",
    "go engineer", "java engineer", "python engineer", "javascript engineer", "typescript engineer", "kotlin engineer",
    "swift engineer", "scala engineer", "browser engineer", "compiler engineer", "kernel engineer", "graphics engineer",
    "rendering engineer", "game engineer", "gameplay engineer", "engine engineer", "it engineer", "it support",
    "it administrator", "it application", "unix", "linux engineer", "data center", "datacenter",
    "production engineer", "electrical engineer", "engineer (m/f", "engineer (f/m", "engineer (all", "engineer m/f",
    "engineer (m/w", "engineer (d/f", "engineer (f/d",
]
# Titles of product work.
PRODUCT_TITLES = [
    "product manager", "product owner", "product lead", "program manager", "program lead", "project manager",
    "project lead", "chief product", "head of product", "vp product", "vp of product", "group product", "lead product",
    "product director", "director of product", "product designer", "product design manager", "product design lead",
    "ux designer", "ui designer",
]
# Words of sub-domains.
DATA_AREAS = [
    "machine learning", "ml ", "ai/bi", "ai/ml", "data platform", "data office", "data infrastructure", "analytics",
    "business intelligence", "jcp core machine learning", "ai group",
]
SOFTWARE_AREAS = [
    "software engineering", "engineering", "platform engineering", "infrastructure", "devops", "sre", "backend",
    "frontend", "mobile", "security", "qa", "deployed engineering", "jcp core", "kotlin", "python ecosystem", "c/c++",
    ".net",
]
PRODUCT_AREAS = ["product management", "product design", "program management"]
TECHNICAL_TAGS = ["engineering", "software", "cloud", "platform", "data", "ai"]
# Parts of department and title that make a posting technical.
TECHNICAL = [
    "engineering", "software", "data", "ai", "machine learning", "devops", "infrastructure", "platform", "backend",
    "frontend", "fullstack", "full-stack", "full stack", "mobile", "ios", "android", "web", "cloud", "security",
    "cybersecurity", "infosec", "it", "sre", "reliability", "qa", "quality assurance", "test", "automation",
    "architect", "systems", "network", "database", "analytics", "bi", "intelligence", "research", "science", "ml",
    "deep learning", "computer vision", "nlp", "robotics", "firmware", "embedded", "hardware", "electronic",
    "technical", "technology", "development", "developer", "programmer", "implementation", "integration",
    "solutions engineer", "technical account", "support engineer", "professional services", "devrel",
    "developer relations", "site reliability", "devsecops", "secops", "mlops", "dataops", "release", "build", "ci/cd",
    "pipeline",
]
CATEGORIES = ["software", "data", "product_tech", "other_tech", "product_nontech", "other_nontech"]


def has_any(text: Column, parts: list[str]) -> Column:
    """Any of the parts in a lower-case text, as one pattern."""
    return text.rlike("|".join(re.escape(p) for p in parts))


def low(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def domain(department: Column, title: Column) -> Column:
    """Technical or Non-Technical, by department and title."""
    return F.when(has_any(F.concat_ws(" ", low(department), low(title)), TECHNICAL), "Technical").otherwise("Non-Technical")


def category(title: Column, department: Column, sub_domain: Column, domain: Column, tags: Column) -> Column:
    """One of ``CATEGORIES``: by title, then sub-domain, then department, then domain; never null."""
    padded = lambda c: F.concat(F.lit(" "), low(c), F.lit(" "))
    t, s, d = padded(title), padded(sub_domain), padded(department)
    hints = has_any(low(sub_domain), SOFTWARE_AREAS + DATA_AREAS) | has_any(F.lower(F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " ")), TECHNICAL_TAGS)
    product = (
        F.when(domain == "Technical", "product_tech").when(domain == "Non-Technical", "product_nontech")
        .when(hints, "product_tech").otherwise("product_nontech")
    )
    return (
        F.when(has_any(t, OTHER_TITLES), "other_nontech").when(has_any(t, DATA_TITLES), "data")
        .when(has_any(t, SOFTWARE_TITLES), "software").when(has_any(t, PRODUCT_TITLES), product)
        .when(has_any(s, DATA_AREAS), "data").when(has_any(s, SOFTWARE_AREAS), "software").when(has_any(s, PRODUCT_AREAS), product)
        .when(has_any(d, SOFTWARE_AREAS), "software").when(has_any(d, DATA_AREAS), "data")
        .when(domain == "Technical", "other_tech").otherwise("other_nontech")
    )
