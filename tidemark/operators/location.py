"""Which postings are in Germany, by the words of their location."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import EDGE
from tidemark.operators.store import listed

# Places and words that stand for Germany, looked for as parts of the text.
GERMAN_PLACES = [
    "berlin", "munich", "münchen", "hamburg", "frankfurt", "cologne", "köln", "stuttgart", "düsseldorf", "dusseldorf", "dortmund", "essen",
    "leipzig", "dresden", "hanover", "hannover", "nuremberg", "nürnberg", "duisburg", "bochum", "wuppertal", "bielefeld", "bonn", "münster",
    "munster", "karlsruhe", "mannheim", "augsburg", "wiesbaden", "mönchengladbach", "gelsenkirchen", "braunschweig", "chemnitz", "kiel", "aachen",
    "halle", "magdeburg", "freiburg", "krefeld", "lübeck", "lubeck", "oberhausen", "erfurt", "mainz", "rostock", "kassel", "hagen", "potsdam",
    "saarbrücken", "saarbrucken", "hamm", "ludwigshafen", "leverkusen", "oldenburg", "osnabrück", "osnabruck", "solingen", "heidelberg", "darmstadt",
    "regensburg", "ingolstadt", "würzburg", "wurzburg", "wolfsburg", "göttingen", "gottingen", "recklinghausen", "heilbronn", "ulm", "pforzheim",
    "offenbach", "bottrop", "trier", "jena", "cottbus", "siegen", "hildesheim", "salzgitter", "gütersloh", "gutersloh", "iserlohn", "schwerin",
    "koblenz", "zwickau", "witten", "gera", "hanau", "esslingen", "ludwigsburg", "tubingen", "tübingen", "flensburg", "konstanz", "worms", "marburg",
    "lüneburg", "luneburg", "bayreuth", "bamberg", "plauen", "neubrandenburg", "wilhelmshaven", "dormagen", "bomlitz", "brunsbüttel", "brunsbuttel",
    "meppen", "emden", "cuxhaven", "celle", "paderborn", "reutlingen", "germany", "deutschland", "german",
]
# Names by which a posting counts as German when it is taken in: large and middle cities, the country and its states; further names are passed.
GERMAN_CITIES = [
    "berlin", "hamburg", "munich", "münchen", "cologne", "köln", "frankfurt", "stuttgart", "düsseldorf", "dusseldorf", "leipzig", "dortmund",
    "essen", "bremen", "dresden", "hannover", "hanover", "nuremberg", "nürnberg", "duisburg", "bochum", "wuppertal", "bielefeld", "bonn", "münster",
    "munster", "karlsruhe", "mannheim", "augsburg", "wiesbaden", "mönchengladbach", "gelsenkirchen", "braunschweig", "aachen", "kiel", "chemnitz",
    "halle", "magdeburg", "freiburg", "krefeld", "lübeck", "lubeck", "oberhausen", "erfurt", "mainz", "rostock", "kassel", "hagen", "potsdam",
    "saarbrücken", "saarbrucken", "hamm", "ludwigshafen", "leverkusen", "oldenburg", "osnabrück", "osnabruck", "solingen", "heidelberg", "darmstadt",
    "regensburg", "ingolstadt", "würzburg", "wurzburg", "wolfsburg", "göttingen", "gottingen", "recklinghausen", "heilbronn", "ulm", "pforzheim",
    "offenbach", "bottrop", "trier", "jena", "cottbus", "siegen", "hildesheim", "salzgitter", "gütersloh", "gutersloh", "iserlohn", "schwerin",
    "koblenz", "zwickau", "witten", "gera", "hanau", "esslingen", "ludwigsburg", "tübingen", "tubingen", "flensburg", "konstanz", "worms", "marburg",
    "lüneburg", "luneburg", "bayreuth", "bamberg", "plauen", "neubrandenburg", "wilhelmshaven", "paderborn", "reutlingen", "neuss", "passau",
    "landshut", "rosenheim", "kaiserslautern", "giessen", "gießen", "fulda", "weimar", "dessau", "celle", "detmold", "schwäbisch gmünd",
    "ravensburg", "friedrichshafen", "villingen-schwenningen", "sindelfingen", "böblingen", "leonberg", "norderstedt", "delmenhorst", "neumünster",
    "neustadt", "herford", "minden", "arnsberg", "lüdenscheid", "unna", "bergisch gladbach", "troisdorf", "euskirchen", "dormagen", "grevenbroich",
    "meerbusch", "ratingen", "velbert", "mettmann", "langenfeld", "monheim", "hürth", "kerpen", "brühl", "erftstadt", "frechen", "pulheim",
    "bergheim", "hennef", "sankt augustin", "bad honnef", "königswinter", "bornheim", "meckenheim", "rheinbach",
    "germany", "deutschland", "hessen", "bayern", "bavaria", "sachsen", "saxony", "niedersachsen", "nordrhein-westfalen", "nrw",
    "baden-württemberg", "baden württemberg", "rheinland-pfalz", "schleswig-holstein", "mecklenburg-vorpommern", "thüringen", "thuringia",
    "brandenburg", "saarland", "sachsen-anhalt", "saxony-anhalt",
]
# Words that leave the place open.
OPEN_PLACES = [
    "remote", "home office", "hybrid", "flexible", "various", "multiple", "tbd", "to be determined", "europe", "eu",
    "emea", "dach", "global", "headquarter", "headquarters", "hq", "office",
]


def any_of(words: list[str]) -> str:
    """A pattern for any of the words anywhere in a text."""
    return "|".join(re.escape(w) for w in words)


def tree_of(words: Iterable[str]) -> str:
    """A pattern for any of the words anywhere, that shares beginnings: a place in a text is tried once for all words."""
    tree: dict = {}
    for word in words:
        at = tree
        for c in word:
            at = at.setdefault(c, {})
        at[""] = {}  # a word ends: what follows does not matter for a part of a text

    def pattern(at: dict) -> str:
        if "" in at:
            return ""
        parts = [re.escape(c) + pattern(below) for c, below in at.items()]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return pattern(tree)


def names_of(spark: SparkSession, path: str) -> list[str]:
    """Place names from a text file, one a line: a list for people, of thousands at most."""
    return [r[0] for r in listed(spark, path, r"\S").orderBy("value").collect()]


def still_germany(place: Column, others: Column, names: Iterable[str] = GERMAN_CITIES) -> Column:
    """The country by name, or one of the names, in the place or further places; false for nulls."""
    every = F.lower(F.concat_ws(" ", F.coalesce(place, F.lit("")), F.array_join(F.coalesce(others, F.array().cast("array<string>")), " ")))
    return every.rlike(tree_of(["germany", "deutschland", *names]))


def mentions_germany(place: Column) -> Column:
    """The country, the lone word ``de`` or a German place; false for null."""
    low = F.lower(F.coalesce(place, F.lit("")))
    return low.rlike(f"{any_of(GERMAN_PLACES)}|{EDGE}de{EDGE}")


def surely_german(place: Column) -> Column:
    """A German place and no word that leaves the place open; false for null."""
    low = F.lower(F.coalesce(place, F.lit("")))
    return low.rlike(any_of(GERMAN_PLACES)) & ~low.rlike(any_of(OPEN_PLACES))


def names_germany(place: Column) -> Column:
    """Germany by name or a German place, for a second look at all locations of a posting."""
    return F.lower(F.coalesce(place, F.lit(""))).rlike(any_of(GERMAN_PLACES))


def is_germany(name: Column) -> Column:
    return F.lower(F.coalesce(name, F.lit(""))).isin("germany", "deutschland")


def any_place(values: Column, fits) -> Column:  # noqa: ANN001
    """Whether any element of an array fits; false for null."""
    return F.coalesce(F.exists(values, fits), F.lit(False))


def lever_in_germany(country: Column, place: Column, places: Column, workplace: Column, text: Column) -> Column:
    """A country code decides; else the places; else remote work in Germany by the text."""
    code = F.lower(F.trim(country))
    said = (workplace == "remote") & F.lower(F.coalesce(text, F.lit(""))).rlike("remote in germany|remote - germany|germany remote")
    return F.when(F.coalesce(country, F.lit("")) != "", code.isin("de", "deu")).otherwise(
        mentions_germany(place) | any_place(places, mentions_germany) | F.coalesce(said, F.lit(False))
    )


def recruitee_in_germany(places: Column, code: Column, country: Column, city: Column, place: Column) -> Column:
    """Code, country or city of any structured place, then of the flat fields."""
    own = lambda code, country, city: (F.upper(F.coalesce(code, F.lit(""))) == "DE") | is_germany(country) | names_germany(city)
    return any_place(places, lambda p: own(p["country_code"], p["country"], p["city"])) | own(code, country, city) | names_germany(place)


def ashby_in_germany(place: Column, country: Column, others: Column) -> Column:
    code = F.lower(F.coalesce(country, F.lit(""))).isin("de", "deu")
    return mentions_germany(place) | code | mentions_germany(country) | any_place(others, mentions_germany)


def teamtailor_in_germany(addresses: Column, title: Column) -> Column:
    fits = lambda a: F.lower(F.coalesce(a["country"], F.lit(""))).isin("de", "deu") | mentions_germany(a["country"]) | mentions_germany(a["city"])
    return any_place(addresses, fits) | mentions_germany(title)


def workday_in_germany(place: Column, fields: Column) -> Column:
    return mentions_germany(place) | mentions_germany(F.array_join(F.coalesce(fields, F.array().cast("array<string>")), " "))


def workplace_name(value: Column) -> Column:
    low = F.lower(F.coalesce(value, F.lit("")))
    return F.when(low.contains("remote"), "Remote").when(low.contains("hybrid"), "Hybrid").when(low.rlike("onsite|on-site|on_site|office"), "Onsite").otherwise("Unspecified")


def employment_name(value: Column) -> Column:
    low = F.lower(F.coalesce(value, F.lit("")))
    names = {"full": "FullTime", "part": "PartTime", "intern": "Intern", "temp": "Temporary", "contract|freelance": "Contract"}
    found = F.lit(None).cast("string")
    for part, name in reversed(names.items()):
        found = F.when(low.rlike(part), name).otherwise(found)
    return found


def country_code(value: Column) -> Column:
    clean = F.nullif(F.trim(value), F.lit(""))
    return F.when(is_germany(clean), "DE").when(F.length(clean) == 2, F.upper(clean)).otherwise(clean)


def filled_workplace(value: Column, place: Column, text: Column) -> Column:
    """A known workplace stays; else by the words of place and the text's first 500 characters."""
    own = F.trim(F.coalesce(value, F.lit("")))
    words = F.concat_ws(" ", F.lower(F.coalesce(place, F.lit(""))), F.left(F.lower(F.coalesce(text, F.lit(""))), F.lit(500)))
    found = F.when(words.rlike("remote|work from home"), "Remote").when(words.contains("hybrid"), "Hybrid").otherwise("Unspecified")
    return F.when((own != "") & (F.lower(own) != "unspecified"), own).otherwise(found)


def stored_place(place: Column, others: Column, remote: Column, names: Iterable[str] = GERMAN_CITIES) -> Column:
    """ "City, Germany" from the first place that names a German city; else Remote, Germany, or the place's parts once each."""
    names = list(names)
    cities_of, either_of = tree_of(names), tree_of(["germany", "deutschland", *names])
    text = lambda c: F.coalesce(c, F.lit(""))
    every = F.concat(F.array(text(place)), F.coalesce(others, F.array().cast("array<string>")))
    german = F.filter(every, lambda p: F.lower(p).rlike(either_of))
    clean = F.transform(german, lambda p: F.regexp_replace(p, r"(?i)\s*[-–—]\s*(Office|Hybrid|Remote|On-?site|Onsite)\s*$", ""))
    parts = F.transform(F.flatten(F.transform(clean, lambda p: F.split(p, ","))), lambda p: F.trim(p))
    cities = F.filter(parts, lambda p: (p != "") & ~is_germany(p) & F.lower(p).rlike(cities_of))
    first = F.get(cities, F.lit(0))
    words = F.transform(F.split(first, " "), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 1000))))
    city = F.concat(F.array_join(words, " "), F.lit(", Germany"))
    own = F.filter(F.transform(F.split(text(place), ","), lambda p: F.trim(p)), lambda p: p != "")
    low = F.transform(own, lambda p: F.lower(p))
    once = F.array_join(F.filter(own, lambda p, k: F.array_position(low, F.lower(p)) == k + 1), ", ")
    away = F.exists(german, lambda p: F.lower(p).contains("remote")) | F.coalesce(remote, F.lit(False))
    return F.when(first.isNotNull(), city).when(away, "Remote, Germany").when(F.size(german) > 0, "Germany").when(text(place) != "", once).otherwise("Germany")
