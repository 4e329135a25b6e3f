"""Feeds, canonical values and the reject chain on small literal inputs."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidemark.functions import canonical
from tidemark.operators import ingest
from tidemark.sources import feeds

RAW = {
    "greenhouse": {"company": "A", "jobs": [{"id": 1, "title": "Dev", "location": {"name": "Berlin"}, "content": "x", "absolute_url": "u", "updated_at": "2026-01-02T03:04:05Z", "departments": [{"name": "D"}], "offices": [{"name": "HQ"}]}]},
    "lever": [{"company": "B", "id": "l1", "text": "Ops", "createdAt": 1767225600000, "categories": {"location": "Munich", "allLocations": ["Munich", "Bonn"], "team": "T"}}],
    "ashby": {"company": "C", "jobs": [{"jobUrl": "https://x/y/77", "title": "QA", "isRemote": True}]},
    "workable": {"jobs": [{"id": "w", "title": "PM", "location": {"city": "Köln", "countryName": "Germany"}, "company": {"title": "W"}}]},
    "recruitee": {"offers": [{"id": 5, "title": "UX", "city": "Ulm", "hybrid": True, "description": "a", "requirements": "b", "published_at": "2026-01-01 10:00:00 UTC"}]},
    "smartrecruiters": {"company": "S", "content": [{"id": "s", "name": "SRE", "location": {"city": "Kiel", "remote": True}}]},
    "teamtailor": {"items": [{"id": "t", "title": "BI", "_jobposting": {"jobLocation": [{"address": {"addressLocality": "Jena", "addressCountry": "DE"}}]}}]},
    "workday": {"company": "Y", "jobPostings": [{"externalPath": "/p/1", "title": "ML", "bulletFields": ["R-1"]}, {"title": "no id"}]},
}
XML = "<workzag-jobs><position><id>9</id><name>Chef</name><office>Hof</office><jobDescriptions><jobDescription><name>N</name><value>V</value></jobDescription></jobDescriptions></position></workzag-jobs>"


def test_feeds(spark, tmp_path):
    paths = {}
    for name, data in RAW.items():
        (tmp_path / name).write_text(json.dumps(data))
        paths[name] = str(tmp_path / name)
    (tmp_path / "personio").write_text(XML)
    paths["personio"] = str(tmp_path / "personio")
    got = {r["sourceSite"]: r for r in feeds.read_all(spark, paths).collect()}
    assert len(got) == 9 and {k: r["JobID"] for k, r in got.items()} == {
        "greenhouse": "1", "lever": "l1", "ashby": "77", "workable": "w", "recruitee": "5", "smartrecruiters": "s", "teamtailor": "t", "workday": "R-1", "personio": "9",
    }
    assert got["lever"]["AllLocations"] == ["Munich", "Bonn"] and str(got["lever"]["PostedDate"])[:10] == "2026-01-01"
    assert got["workable"]["Location"] == "Köln, Germany" and got["recruitee"]["WorkplaceType"] == "hybrid"
    assert got["personio"]["Description"] == "N\nV" and got["teamtailor"]["Location"] == "Jena, DE"
    assert got["greenhouse"]["PostedDate"] is not None and got["recruitee"]["PostedDate"] is not None


def test_canonical_values(spark):
    df = spark.createDataFrame([("not_mentioned", " Fully Remote ", "Berlin"), (None, "x", "Remote - EU"), ("office", "remote", None)], "a string, b string, c string")
    assert [r[0] for r in df.select(canonical.workplace(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["remote", "remote", "onsite"]
    pay = spark.createDataFrame([(5000.0, "eur", "monthly"), (5.0, "EUR", "yearly"), (60000.0, "XXX", "yearly"), (70000.0, "usd", None), (-1.0, "EUR", "yearly")], "a double, c string, i string")
    assert [r[0] for r in pay.select(canonical.yearly_euros(F.col("a"), F.col("c"), F.col("i"))).collect()] == [60000, None, None, 64400, None]
    null = {k: F.lit(None).cast(t) for k, t in (("min", "double"), ("max", "double"), ("currency", "string"), ("interval", "string"))}
    said = {"min": F.lit(50_000.0), "max": F.lit(None).cast("double"), "currency": F.lit("EUR"), "interval": F.lit("yearly")}
    one = spark.range(1).select(canonical.salary(null, said).alias("s"), canonical.salary(null, null).alias("n")).first()
    assert (one["s"]["min"], one["s"]["tier"], one["n"]["tier"]) == (50_000, "jd", None)


def test_reject_chain(spark):
    french = "nous cherchons pour notre service une personne qui aime les machines et dans votre travail vous avez des projets " * 2
    rows = [("Store Manager", "x"), ("Engineer (German-speaking)", "x"), ("Engineer", french), ("Engineer", "must be an EU citizen"), ("Engineer", "fluent in dutch or french required"), (None, "x"), ("Engineer", "être fluent"), ("Engineer", "fine")]
    df = spark.createDataFrame([(k, t, "c", d) for k, (t, d) in enumerate(rows)], "k int, JobTitle string, Company string, Description string")
    got = [r[0] for r in df.orderBy("k").select(ingest.reject_reason()).collect()]
    assert got == ["banned_role", "german_title", "not_english", "citizenship", "other_language", "no_title", None, None]
    assert df.where("k = 4").select(ingest.other_language(F.col("Description"))).first()[0] == "french"
    verdicts = spark.createDataFrame([("none", False, 0.9)], "fingerprint string, german boolean, confidence double")
    one = ingest.judged(df, verdicts)
    own = one.where("k = 7").select("fingerprint", F.lit(False).alias("german"), F.lit(0.9).alias("confidence"))
    status = {r["k"]: r["Status"] for r in ingest.judged(df, own).collect()}
    assert status[7] == "active" and status[6] == "pending_review" and status[0] == "rejected"
