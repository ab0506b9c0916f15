"""Closed vocabularies of the posting record, and lookups over them.

Everything here is a fixed value: results must agree on it, so it is stated plainly.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

EMPLOYMENT = {
    "full time": "FULL_TIME", "fulltime": "FULL_TIME", "regular full time": "FULL_TIME",
    "regular full time salary": "FULL_TIME", "permanent": "FULL_TIME", "part time": "PART_TIME",
    "parttime": "PART_TIME", "regular part time": "PART_TIME", "contract": "CONTRACTOR",
    "contractor": "CONTRACTOR", "contract to hire": "CONTRACTOR", "freelance": "CONTRACTOR",
    "c2c": "CONTRACTOR", "b2b": "CONTRACTOR", "temporary": "TEMPORARY", "temp": "TEMPORARY",
    "seasonal": "TEMPORARY", "fixed term": "TEMPORARY", "internship": "INTERN", "intern": "INTERN",
    "apprenticeship": "INTERN", "trainee": "INTERN", "volunteer": "VOLUNTEER", "per diem": "PER_DIEM",
    "prn": "PER_DIEM",
}
PERIODS = {
    "yr": "year", "year": "year", "yearly": "year", "annual": "year", "annually": "year",
    "annum": "year", "pa": "year", "per year": "year", "mo": "month", "month": "month",
    "monthly": "month", "wk": "week", "week": "week", "weekly": "week", "day": "day", "daily": "day",
    "per diem": "day", "hr": "hour", "hour": "hour", "hourly": "hour", "fixed": "fixed",
    "fixed price": "fixed", "project": "fixed", "per year salary": "year", "per month salary": "month",
    "per week salary": "week", "per day wage": "day", "per hour wage": "hour", "per task": "fixed",
    "one time": "fixed", "1 year": "year", "1 month": "month", "1 week": "week", "1 day": "day",
    "1 hour": "hour", "ph": "hour", "pd": "day", "pw": "week", "pm": "month", "pb": "fixed", "wc": "fixed",
}
ARRANGEMENTS = {
    "remote": "remote", "fully remote": "remote", "remote first": "remote", "telecommute": "remote",
    "work from home": "remote", "wfh": "remote", "anywhere": "remote", "distributed": "remote",
    "hybrid": "hybrid", "flexible": "hybrid", "partially remote": "hybrid", "on site": "onsite",
    "onsite": "onsite", "in office": "onsite", "in person": "onsite", "office": "onsite",
    "no remote": "onsite",
}
COUNTRIES = {
    "united states": "US", "united states of america": "US", "usa": "US", "u.s.": "US",
    "united kingdom": "GB", "uk": "GB", "great britain": "GB", "england": "GB", "canada": "CA",
    "mexico": "MX", "brazil": "BR", "argentina": "AR", "chile": "CL", "colombia": "CO", "peru": "PE",
    "ireland": "IE", "france": "FR", "germany": "DE", "spain": "ES", "portugal": "PT", "italy": "IT",
    "netherlands": "NL", "belgium": "BE", "switzerland": "CH", "austria": "AT", "sweden": "SE",
    "norway": "NO", "denmark": "DK", "finland": "FI", "poland": "PL", "czech republic": "CZ",
    "czechia": "CZ", "romania": "RO", "ukraine": "UA", "greece": "GR", "turkey": "TR", "israel": "IL",
    "united arab emirates": "AE", "saudi arabia": "SA", "south africa": "ZA", "nigeria": "NG",
    "kenya": "KE", "egypt": "EG", "india": "IN", "pakistan": "PK", "china": "CN", "japan": "JP",
    "south korea": "KR", "korea, republic of": "KR", "singapore": "SG", "hong kong": "HK",
    "taiwan": "TW", "malaysia": "MY", "indonesia": "ID", "thailand": "TH", "vietnam": "VN",
    "philippines": "PH", "australia": "AU", "new zealand": "NZ", "kazakhstan": "KZ", "bulgaria": "BG",
    "dominican republic": "DO",
}
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA",
    "colorado": "CO", "connecticut": "CT", "delaware": "DE", "florida": "FL", "georgia": "GA",
    "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS",
    "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD", "massachusetts": "MA",
    "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT",
    "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM",
    "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK",
    "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC",
    "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT",
    "virginia": "VA", "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY",
    "district of columbia": "DC", "puerto rico": "PR", "guam": "GU", "virgin islands": "VI",
    "american samoa": "AS",
}
STATE_CODES = sorted({*STATES.values(), "MP"})
CONTINENTS = ("asia", "africa", "oceania")
REGIONS = (
    "north america", "south america", "latin america", "central america", "latam", *CONTINENTS, "northern america", "emea", "apac",
    "asia-pacific", "asia pacific", "americas", "europe", "european union"
)
NON_US_REGIONS = ("emea", "apac", "asia-pacific", "asia pacific", "latam", *CONTINENTS, "europe", "european", "(eu)", "dubai", "uae")
EXCLUDED_PLACES = (*sorted(k for k, v in COUNTRIES.items() if v != "US"), *NON_US_REGIONS)
US_INCLUSIVE = ("US", "ANY", "AMERICAS", "NORTH AMERICA")
PLACELESS = (
    "remote", "onsite", "on", "site", "hybrid", "wfh", "telecommute", "anywhere", "work from home", "work-from-home", "virtual",
    "distributed", "home based", "home-based"
)
INTENSIFIERS = ("fully", "100%", "completely", "permanently", "partially")
SENIORITY = {
    "jr": "junior", "junior": "junior", "sr": "senior", "senior": "senior", "staff": "staff", "principal": "principal", "lead": "lead",
    "associate": "associate", "head": "head", "chief": "chief", "vp": "vp", "director": "director", "intern": "intern"
}
LEVELS = {"i": "I", "1": "I", "ii": "II", "2": "II", "iii": "III", "3": "III", "iv": "IV", "4": "IV"}
MATCH_LEVELS = {
    "i": "L1", "1": "L1", "ii": "L2", "2": "L2", "iii": "L3", "3": "L3", "iv": "L4", "4": "L4", "jr": "junior", "junior": "junior",
    "sr": "senior", "senior": "senior", "staff": "staff", "principal": "principal", "lead": "lead", "associate": "associate"
}
TITLE_NOISE = ("remote", "onsite", "hybrid", "wfh", "telecommute", "anywhere", "us", "usa")
QUALIFIER_NOISE = ("remote", "onsite", "on", "site", "hybrid", "wfh", "telecommute", "anywhere")
USAJOBS_SCHEDULES = {"1": "FULL_TIME", "2": "PART_TIME", "3": "PART_TIME", "4": "TEMPORARY", "5": "PER_DIEM", "6": "TEMPORARY"}
STICKY = ("applied", "dismissed", "interviewing", "screen", "offer", "rejected")
HIDDEN = ("applied", "dismissed", "rejected")


def lookup(table: dict[str, str], key: Column) -> Column:
    """The table's value for key, else null: a map literal, no join. It is written as one string, which the optimizer
    folds into a map; one expression for each entry would make plans that take longer to analyse than to run."""
    return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in table.items())), F.lit("\x01"), F.lit("\x02"))[key]


def plain_key(raw: Column) -> Column:
    """How closed vocabularies are keyed: lower case, other than a-z, 0-9 a blank, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(raw), "[^a-z0-9 ]+", " "), " +", " "))


def employment_type(raw: Column) -> Column:
    """The closed value; OTHER for one that isn't known, null for none stated."""
    said = F.when(F.trim(raw) != "", F.trim(raw))
    return F.when(said.isNotNull(), F.coalesce(lookup(EMPLOYMENT, plain_key(said)), F.lit("OTHER")))


def salary_period(raw: Column) -> Column:
    return lookup(PERIODS, plain_key(raw))


def remote_type(raw: Column) -> Column:
    return lookup(ARRANGEMENTS, plain_key(raw))


def country_code(raw: Column) -> Column:
    """Names first, then any two letters, upper case."""
    s = F.trim(raw)
    return F.coalesce(lookup(COUNTRIES, F.lower(s)), F.when(s.rlike("^[A-Za-z]{2}$"), F.upper(s)))


def us_state_code(raw: Column) -> Column:
    s = F.trim(raw)
    return F.coalesce(F.when(F.upper(s).isin(*STATE_CODES), F.upper(s)), lookup(STATES, F.lower(s)))


# ISO short names, and forms that people use, which the locale data spells another way.
ISO_FORMS = {
    "antigua and barbuda": "AG", "bolivia, plurinational state of": "BO", "bonaire, sint eustatius and saba": "BQ",
    "bosnia and herzegovina": "BA", "brunei darussalam": "BN", "brunei": "BN", "cabo verde": "CV", "cape verde": "CV",
    "cocos (keeling) islands": "CC", "congo": "CG", "republic of the congo": "CG", "congo, the democratic republic of the": "CD",
    "congo, democratic republic of the": "CD", "the democratic republic of the congo": "CD", "democratic republic of the congo": "CD",
    "côte d'ivoire": "CI", "cote d'ivoire": "CI", "ivory coast": "CI", "curaçao": "CW", "curacao": "CW", "czechia": "CZ",
    "east timor": "TL", "timor-leste": "TL", "eswatini": "SZ", "swaziland": "SZ", "falkland islands (malvinas)": "FK",
    "heard island and mcdonald islands": "HM", "holy see (vatican city state)": "VA", "holy see": "VA", "vatican city": "VA",
    "hong kong": "HK", "iran, islamic republic of": "IR", "islamic republic of iran": "IR", "korea, democratic people's republic of": "KP",
    "democratic people's republic of korea": "KP", "korea, republic of": "KR", "republic of korea": "KR", "kosovo": "XK",
    "lao people's democratic republic": "LA", "macao": "MO", "macau": "MO", "micronesia, federated states of": "FM",
    "federated states of micronesia": "FM", "moldova, republic of": "MD", "republic of moldova": "MD", "myanmar": "MM", "burma": "MM",
    "north macedonia": "MK", "palestine, state of": "PS", "the state of palestine": "PS", "palestine": "PS", "pitcairn": "PN",
    "people's republic of china": "CN", "reunion": "RE", "réunion": "RE", "russian federation": "RU", "russia": "RU",
    "saint barthélemy": "BL", "saint helena, ascension and tristan da cunha": "SH", "saint kitts and nevis": "KN", "saint lucia": "LC",
    "saint martin (french part)": "MF", "saint pierre and miquelon": "PM", "saint vincent and the grenadines": "VC",
    "sao tome and principe": "ST", "scotland": "GB", "wales": "GB", "northern ireland": "GB",
    "united kingdom of great britain and northern ireland": "GB", "sint maarten (dutch part)": "SX",
    "south georgia and the south sandwich islands": "GS", "svalbard and jan mayen": "SJ", "swiss confederation": "CH",
    "syrian arab republic": "SY", "taiwan, province of china": "TW", "tanzania, united republic of": "TZ",
    "united republic of tanzania": "TZ", "trinidad and tobago": "TT", "turks and caicos islands": "TC", "turkey": "TR", "türkiye": "TR",
    "u.s.a.": "US", "united mexican states": "MX", "venezuela, bolivarian republic of": "VE", "bolivarian republic of venezuela": "VE",
    "viet nam": "VN", "virgin islands, british": "VG", "british virgin islands": "VG", "virgin islands, u.s.": "VI",
    "virgin islands of the united states": "VI", "wallis and futuna": "WF", "french republic": "FR", "hellenic republic": "GR",
    "argentine republic": "AR", "portuguese republic": "PT", "italian republic": "IT", "slovak republic": "SK", "gabonese republic": "GA",
    "togolese republic": "TG", "arab republic of egypt": "EG", "kyrgyz republic": "KG", "hashemite kingdom of jordan": "JO",
    "grand duchy of luxembourg": "LU", "principality of monaco": "MC", "principality of andorra": "AD", "principality of liechtenstein": "LI",
    "democratic socialist republic of sri lanka": "LK", "eastern republic of uruguay": "UY", "hong kong special administrative region of china": "HK",
    "macao special administrative region of china": "MO", "lebanese republic": "LB", "rwandese republic": "RW",
    "socialist republic of viet nam": "VN", "united states minor outlying islands": "UM",
}
#: What stands before a country's name in its official form.
OFFICIAL = r"^(?:the )?(?:(?:federal |federative |democratic |islamic |oriental |plurinational |independent |people's )*(?:republic|kingdom|state|commonwealth|sultanate|union|federation) of (?:the )?)"
#: Codes that are also states of the US: alone they say neither.
AMBIGUOUS = ("AR", "CA", "CO", "DE", "ID", "IL", "IN")


def iso_names(spark: SparkSession | None = None) -> dict[str, str]:
    """English country names, lower case, to alpha-2 codes: the JVM's locale data, and the forms above."""
    return _iso_names(spark or SparkSession.getActiveSession())


@lru_cache(maxsize=1)
def _iso_names(spark: SparkSession) -> dict[str, str]:
    jvm = spark._jvm
    found = {}
    for code in jvm.java.util.Locale.getISOCountries():
        name = jvm.java.util.Locale("", code).getDisplayCountry(jvm.java.util.Locale.ENGLISH).lower().replace("’", "'")
        for form in (
            name, name.replace(" & ", " and "), name.replace("st. ", "saint "), name.replace("st. ", "saint ").replace(" & ", " and "),
            name.split(" (")[0], name.removesuffix(" sar china")
        ):
            found[form] = code
    return found | COUNTRIES | ISO_FORMS


def iso_code(name: Column) -> Column:
    """The code of a country's name as a vendor's field has it, official forms too; null rather than a guess."""
    table = iso_names()
    low = F.trim(F.regexp_replace(F.lower(name), r"(?U)\s+", " "))
    return F.coalesce(lookup(table, low), lookup(table, F.regexp_replace(low, OFFICIAL, "")))
