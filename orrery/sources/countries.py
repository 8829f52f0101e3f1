"""The countries dimension: name, iso2, iso3, local_name and an ordered continent.

Rows come from a table of the caller's (`source`), which is validated against the schema,
or by rule: codes from the Java runtime's ISO 3166 tables, names from its English ones, and
local names equal to the names, but for the fixed values below. Rows without a continent
come first, and the others by name, which is the order that the identity column numbers.
Names of the runtime are those of Java 17; where another Java spells one differently, the
caller's table has the last word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.constraints import assert_valid

#: Continents in their order.
CONTINENTS = ("Africa", "Antarctica", "Asia", "Europe", "Oceania", "North America", "South America")

#: ISO codes by continent. Codes of WITHOUT have neither a continent nor a local name; codes in no list are in Asia.
MEMBERS = {
    "Africa": "AO BF BI BJ BW CD CF CG CI CM CV DJ DZ EG EH ER ET GA GH GM GN GQ GW IO KE KM LR LS LY MA MG ML MR MU MW MZ NA NE NG RE RW SC SD SH SL SN SO ST SZ TD TG TN TZ UG YT ZA ZM ZW",
    "Antarctica": "AQ BV GS HM TF",
    "Europe": "AD AL AT BA BE BG BY CH CZ DE DK EE ES FI FO FR GB GI GR HR HU IE IS IT LI LT LU LV MC MD MK MT NL NO PL PT RO RU SE SI SJ SK SM UA VA",
    "Oceania": "AS AU CC CK CX FJ FM GU KI MH MP NC NF NR NU NZ PF PG PN PW SB TK TO TV UM VU WF WS",
    "North America": "AG AI AW BB BM BS BZ CA CR CU DM DO GD GL GP GT HN HT JM KN KY LC MQ MS MX NI PA PM PR SV TC TT US VC VG VI",
    "South America": "AR BO BR CL CO EC FK GF GY PE PY SR UY VE",
}
WITHOUT = "BQ CW GG IM JE AX ME BL MF RS SX SS TL".split()
CONTINENT_OF = {code: continent for continent, codes in MEMBERS.items() for code in codes.split()}

#: Spellings that differ from the runtime's.
SPELLINGS = {"iso2": {"AS": "as"}, "iso3": {"RO": "ROM"}}
# fmt: off
#: Names that differ from the runtime's English ones.
NAMES = {
    "AG": "Antigua and Barbuda", "BA": "Bosnia and Herzegovina", "BL": "Saint Barthélemy", "BN": "Brunei Darussalam",
    "BQ": "Bonaire, Sint Eustatius and Saba", "CD": "Congo, the Democratic Republic of the", "CG": "Congo", "CI": "Cote DIvoire",
    "CZ": "Czech Republic", "FK": "Falkland Islands (Malvinas)", "FM": "Micronesia, Federated States of",
    "GS": "South Georgia and the South Sandwich Islands", "HK": "Hong Kong", "HM": "Heard Island and Mcdonald Islands",
    "IR": "Iran, Islamic Republic of", "KN": "Saint Kitts and Nevis", "KP": "Korea, Democratic People's Republic of", "KR": "Korea, Republic of",
    "LA": "Lao People's Democratic Republic", "LC": "Saint Lucia", "MD": "Moldova, Republic of", "MF": "Saint Martin (French part)",
    "MK": "Macedonia, the Former Yugoslav Republic of", "MM": "Myanmar", "MO": "Macao", "PM": "Saint Pierre and Miquelon", "PN": "Pitcairn",
    "PS": "Palestine, State of", "RE": "Reunion", "RU": "Russian Federation", "SH": "Saint Helena, Ascension and Tristan da Cunha",
    "SJ": "Svalbard and Jan Mayen", "ST": "Sao Tome and Principe", "SX": "Sint Maarten (Dutch part)", "SY": "Syrian Arab Republic", "SZ": "Swaziland",
    "TC": "Turks and Caicos Islands", "TT": "Trinidad and Tobago", "TW": "Taiwan (Province of China)", "TZ": "Tanzania, United Republic of",
    "UM": "United States Minor Outlying Islands", "VA": "Holy See (Vatican City State)", "VC": "Saint Vincent and the Grenadines",
    "VG": "Virgin Islands (British)", "VI": "Virgin Islands (U.S.)", "VN": "Viet Nam", "WF": "Wallis and Futuna",
}
#: Local names that differ from the names.
LOCAL_NAMES = {
    "AE": "Al-Amirat al-Arabiya al-Muttahida", "AF": "Afganistan/Afqanestan", "AL": "Republika e Shqipërisë", "AM": "Hajastan", "AQ": "",
    "AS": "Amerika Samoa", "AT": "Österreich", "BA": "Bosna i Hercegovina", "BE": "Belgium/Belgique", "BG": "Balgarija", "BH": "Al-Bahrayn",
    "BI": "Burundi/Uburundi", "BR": "Brasil", "BS": "The Bahamas", "BT": "Druk-Yul", "CD": "Republique Democratique du Congo", "CF": "Centrafrique",
    "CH": "Schweiz/Suisse/Svizzera/Svizra", "CI": "Côte dIvoire", "CK": "The Cook Islands", "CM": "Cameroun/Cameroon", "CN": "Zhongquo",
    "CV": "Cabo Verde", "CZ": "Czech", "DE": "Deutschland", "DJ": "Djibouti/Jibuti", "DK": "Danmark", "DO": "Republica Dominicana",
    "DZ": "Al-Jazair/Algerie", "EE": "Eesti", "EG": "Misr", "EH": "As-Sahrawiya", "ER": "Ertra", "ES": "España", "ET": "Yeityopiya", "FI": "Suomi",
    "FJ": "Fiji Islands", "FK": "Falkland Islands", "FM": "Micronesia", "GA": "Le Gabon", "GE": "Sakartvelo", "GF": "Guyane francaise",
    "GL": "Kalaallit Nunaat", "GM": "The Gambia", "GQ": "Guinea Ecuatorial", "HK": "Xianggang/Hong Kong", "HM": "Heard and McDonald Islands",
    "HR": "Hrvatska", "HT": "Haiti/Dayti", "IL": "Yisrael", "IN": "Bharat/India", "IQ": "Al-Irāq", "IR": "Iran", "IT": "Italia", "JO": "Al-Urdunn",
    "JP": "Nihon/Nippon", "KM": "Komori/Comores", "KP": "Choson Minjujuui Inmin Konghwaguk (Bukhan)", "KR": "Taehan-minguk (Namhan)",
    "KW": "Al-Kuwayt", "KZ": "Qazaqstan", "LA": "Lao", "LB": "Lubnan", "LK": "Sri Lanka/Ilankai", "LT": "Lietuva", "LV": "Latvija", "LY": "Libiya",
    "MA": "Al-Maghrib", "MD": "Moldova", "MG": "Madagasikara/Madagascar", "MH": "Marshall Islands/Majol", "MK": "Makedonija", "MM": "Myanma Pye",
    "MN": "Mongol Uls", "MO": "Macau/Aomen", "MR": "Muritaniya/Mauritanie", "MV": "Dhivehi Raajje/Maldives", "NC": "Nouvelle-Calédonie",
    "NL": "Nederland", "NO": "Norge", "NR": "Naoero/Nauru", "NZ": "New Zealand/Aotearoa", "PA": "República de Panamá", "PE": "Perú/Piruw",
    "PF": "Polynésie française", "PG": "Papua New Guinea/Papua Niugini", "PH": "Pilipinas", "PL": "Polska", "PM": "Saint-Pierre-et-Miquelon",
    "PS": "Filastin", "PW": "Belau/Palau", "RU": "Rossija", "RW": "Rwanda/Urwanda", "SA": "Al-Mamlaka al-Arabiya as-Saudiya",
    "SC": "Sesel/Seychelles", "SD": "As-Sudan", "SE": "Sverige", "SG": "Singapore/Singapura/Xinjiapo/Singapur", "SH": "Saint Helena",
    "SI": "Slovenija", "SJ": "Svalbard og Jan Mayen", "SK": "Slovensko", "SN": "Sénégal/Sounougal", "SO": "Soomaaliya", "ST": "São Tomé e Príncipe",
    "SY": "Suriya", "SZ": "kaNgwane", "TC": "The Turks and Caicos Islands", "TD": "Tchad/Tshad", "TF": "Terres australes françaises",
    "TH": "Prathet Thai", "TM": "Türkmenistan", "TN": "Tunis/Tunisie", "TR": "Türkiye", "TW": "Tai-wan", "TZ": "Tanzania", "UA": "Ukrajina",
    "UZ": "Uzbekiston", "VA": "Santa Sede/Città del Vaticano", "VG": "British Virgin Islands", "VI": "Virgin Islands of the United States",
    "WF": "Wallis-et-Futuna", "YE": "Al-Yaman",
}
# fmt: on
#: Codes that stand out of the order of names, and what each follows; None is the end.
AFTER = {"AL": "MN", "AF": None, "DZ": None}

#: Views of a session can't carry a comment, so it stands here for those who write the table.
TABLE_COMMENT = "Full list of countries."
COMMENTS = {
    "name": "Full country name.",
    "iso2": "ISO 3166-1 alpha-2 code.",
    "iso3": "ISO 3166-1 alpha-3 code.",
    "local_name": "Local variation of the name.",
}

SCHEMAS = {
    "0.0.1": T.StructType(
        [
            T.StructField("id", T.LongType(), False),
            T.StructField("name", T.StringType(), True, {"comment": COMMENTS["name"]}),
            T.StructField("iso2", T.StringType(), False, {"comment": COMMENTS["iso2"]}),
            T.StructField("iso3", T.StringType(), True, {"comment": COMMENTS["iso3"]}),
            T.StructField("local_name", T.StringType(), True, {"comment": COMMENTS["local_name"]}),
            T.StructField("continent", T.StringType(), True),
        ]
    )
}
SCHEMAS["0.0.2"] = T.StructType([f if f.name != "iso3" else T.StructField("iso3", T.StringType(), False, f.metadata) for f in SCHEMAS["0.0.1"].fields[1:]])


def _quoted(value: str | None) -> str:
    return "cast(null as string)" if value is None else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def rule_rows(spark: SparkSession) -> list[tuple[str, str, str, str | None, str | None]]:
    """(name, iso2, iso3, local_name, continent) by the rule, in its order."""
    locale = spark.sparkContext._jvm.java.util.Locale
    rows = {}
    for code in sorted(str(c) for c in locale.getISOCountries()):
        place = locale("", code)
        name = NAMES.get(code, place.getDisplayCountry(locale.ENGLISH))
        iso2, iso3 = SPELLINGS["iso2"].get(code, code), SPELLINGS["iso3"].get(code, place.getISO3Country())
        rows[code] = (name, iso2, iso3, *((None, None) if code in WITHOUT else (LOCAL_NAMES.get(code, name), CONTINENT_OF.get(code, "Asia"))))
    order = WITHOUT + sorted((c for c in rows if c not in WITHOUT and c not in AFTER), key=lambda c: rows[c][0])
    for code, before in AFTER.items():
        order.insert(order.index(before) + 1 if before else len(order), code)
    return [rows[c] for c in order]


def countries(spark: SparkSession, version: str = "0.0.2", source: DataFrame | None = None) -> DataFrame:
    """The dimension as version 0.0.1 (with an identity column) or 0.0.2 has it.

    Rows by rule are a VALUES list, whose size the planner knows, so joins broadcast it.
    """
    if version not in SCHEMAS:
        raise ValueError(f"countries has no version {version}")
    if source is None:
        rows = rule_rows(spark)
        values = ", ".join(f"({k + 1}L, {', '.join(map(_quoted, r))})" for k, r in enumerate(rows))
        source = spark.sql(f"select * from values {values} as t(id, name, iso2, iso3, local_name, continent)")
    elif version == "0.0.1" and "id" not in source.columns:
        raise ValueError("version 0.0.1 needs the identity column id")
    schema = SCHEMAS[version]
    # a column that may be null in this version is declared so, whatever the rows have
    value = lambda f: F.when(F.col(f.name).isNotNull(), F.col(f.name)) if f.nullable else F.col(f.name)
    return source.select(*[value(f).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in schema.fields])


def upgrade(df: DataFrame) -> DataFrame:
    """0.0.1 to 0.0.2: the identity column goes and iso3 becomes the key, so it must be unique and never null."""
    assert_valid(df, key=["iso3"])
    columns = [F.coalesce("iso3", F.lit("")).alias("iso3", metadata=df.schema["iso3"].metadata) if c == "iso3" else F.col(c) for c in df.columns if c != "id"]
    return df.select(*columns)


def continent_ordinal(continent: str | Column) -> Column:
    """Place of a continent in the declared order, from 1; null for null; an unknown label raises an error."""
    c = F.col(continent) if isinstance(continent, str) else continent
    at = F.array_position(F.array(*[F.lit(x) for x in CONTINENTS]), c)
    return F.when(at > 0, at).when(c.isNull(), F.lit(None)).otherwise(F.raise_error(F.concat(F.lit("invalid continent: "), c)).cast("long"))
