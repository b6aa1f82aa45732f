"""Problem 6: freely typed values mapped to a reference list.

Partition-based pigeonhole join, in SQL expressions only. Values and references are folded (case,
accents, digits for letters, signs). A reference of more than a few letters is cut into k + 1 segments; a
text within edit distance k holds at least one of them unchanged, at a place shifted by at most k, so an
equality join on (text length, place, segment) finds every candidate, and the built-in levenshtein
verifies it. The texts compared are the runs of one to five words of a value, so that shop words, places
and legal forms around a name do no harm. A house name alone counts if no other trade stands beside it.
Unmatched values are reported through an anti-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.session import bounded_broadcast, read_table, stored

#: Letters with accents and their plain forms; digits typed for letters. l and i fold together,
#: as a typed 1 may stand for either.
_FROM = "áàâãäåéèêëíìîïóòôõöúùûüçñ013457l"
_TO = "aaaaaaeeeeiiiiooooouuuucnoieasti"
#: Texts that say that there is no brand.
NO_VALUE = ["", "-", "--", "unknown", "n/a", "na", "n.a.", "none", "no brand", "nobrand", "null", "nil", "no", "not known", "?", "unbranded", "keine", "aucune", "ninguna", "nenhuma"]
#: Words of trades that no reference has.
OTHER_TRADES = [
    "lodge", "motors", "tailors", "traders", "sweets", "stores", "clinic", "book", "depot", "bakery", "hardware", "house", "library",
    "taxi", "hospital", "college", "police", "museum", "park", "parking", "dentist", "guest", "restaurant", "bar", "hostel", "atm",
]
MAX_WORDS = 5


def fold(text: Column) -> Column:
    """Lower-case words of letters and digits, parted by single spaces, accents and look-alikes folded."""
    t = F.regexp_replace(F.lower(text), "[̀-ͯ]", "")
    t = F.regexp_replace(t, r"['’]s\b|['’.®™]", "")
    t = F.regexp_replace(t, "&", " and ")
    t = F.regexp_replace(t, r"[^\p{L}\p{M}\p{N}]+", " ")
    return F.translate(F.trim(t), _FROM, _TO)


def _compact(words: Column) -> Column:
    return F.array_join(words, "")


def edits_allowed(length: Column) -> Column:
    """k by the length of a reference."""
    return F.when(length >= 9, 2).when(length >= 6, 1).otherwise(0)


def reference_forms(reference: DataFrame, id_col: str, name_col: str, aliases_col: str | None, category_col: str | None) -> DataFrame:
    """(ref_id, category, form, kind, k, len, trade): spellings of each entry.

    kind 0: the whole name or an alias, also with its last or first words moved to the other end; kind 1: the
    house name, that is the first word, or three where the second is "and".
    """
    none = F.lit(None)
    aliases = F.coalesce(F.col(aliases_col), F.array().cast("array<string>")) if aliases_col else F.array().cast("array<string>")
    names = reference.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("ref_id"), (F.lower(F.col(category_col)) if category_col else none.cast("string")).alias("category"),
        F.explode(F.concat(F.array(F.col(name_col)), aliases)).alias("name"),
    )
    words = names.select("ref_id", "category", F.split(fold(F.col("name")), " ").alias("w")).where(_compact(F.col("w")) != "")
    n = F.size("w")
    house = F.when((n > 3) & (F.get("w", F.lit(1)) == "and"), 3).otherwise(1)
    forms = words.select("ref_id", "category", "w", n.alias("n"), house.alias("h")).select(
        "ref_id", "category",
        F.explode(F.concat(
            F.array(F.struct(_compact(F.col("w")).alias("form"), F.lit(0).alias("kind"), F.lit("").alias("trade"))),
            F.when(F.col("n") > F.col("h"), F.array(
                F.struct(F.concat(_compact(F.slice("w", F.col("h") + 1, F.col("n"))), _compact(F.slice("w", F.lit(1), F.col("h")))).alias("form"), F.lit(0).alias("kind"), F.lit("").alias("trade")),
                F.struct(_compact(F.slice("w", F.lit(1), F.col("h"))).alias("form"), F.lit(1).alias("kind"), _compact(F.slice("w", F.col("h") + 1, F.col("n"))).alias("trade")),
            )).otherwise(F.array().cast("array<struct<form:string,kind:int,trade:string>>")),
        )).alias("f"),
    )
    length = F.length("f.form")
    k = F.when(F.col("f.kind") == 1, F.least(edits_allowed(length), F.lit(1))).otherwise(edits_allowed(length))
    return forms.select("ref_id", "category", F.col("f.form").alias("form"), F.col("f.kind").alias("kind"), k.alias("k"), length.alias("len")).where(F.col("len") >= 3).distinct()


def _segments(forms: DataFrame) -> DataFrame:
    """(n, at, seg, form, k): where a text of length n must hold which segment of the form."""
    i, k, length = F.col("i"), F.col("k"), F.col("len")
    start = F.floor(i * length / (k + 1)).cast("int")
    end = F.floor((i + 1) * length / (k + 1)).cast("int")
    cut = forms.select("form", "k", "len").distinct().select("*", F.explode(F.sequence(F.lit(0), k)).alias("i")).select("form", "k", start.alias("s"), end.alias("e"), "len")
    moved = cut.select("*", F.explode(F.sequence(F.greatest(F.lit(1), F.col("len") - k), F.col("len") + k)).alias("n"))
    moved = moved.select("*", F.explode(F.sequence(-F.col("k"), F.col("k"))).alias("shift"))
    at = F.col("s") + F.col("shift")
    return moved.where((at >= 0) & (at + F.col("e") - F.col("s") <= F.col("n"))).select("n", (at + 1).alias("at"), (F.col("e") - F.col("s")).alias("size"), F.expr("substring(form, s + 1, e - s)").alias("seg"), "form", "k").distinct()


def value_parts(values: DataFrame) -> DataFrame:
    """(value, part, words): the entries that a value lists, parted by ; or / or |."""
    parts = values.select("value", F.posexplode(F.split("value", r"[;|]|\s/\s|/")).alias("part", "text"))
    return parts.select("value", "part", fold(F.col("text")).alias("folded"), F.trim(F.lower("text")).alias("plain")).where(
        ~F.col("plain").isin(NO_VALUE) & F.col("folded").rlike(r"\S")
    ).select("value", "part", F.split("folded", " ").alias("words"))


def matched_parts(values: DataFrame, reference: DataFrame, id_col: str, name_col: str, aliases_col: str | None = None, category_col: str | None = None) -> DataFrame:
    """(value, part, ref_id, ref_category, kind, distance, length): candidates of each part of the distinct values."""
    forms = stored(reference_forms(reference, id_col, name_col, aliases_col, category_col))
    # the reference list and what is derived from it: a few hundred rows an entry at most, and counted
    segments = bounded_broadcast(_segments(forms), 2_000_000)
    trades = forms.sparkSession.createDataFrame([(t,) for t in OTHER_TRADES], "t string").select(F.translate("t", _FROM, _TO).alias("t"))
    listed = reference.select(F.explode(F.split(fold(F.col(name_col)), " ")).alias("t"), F.lit(1).alias("one"))
    first = reference.select(F.get(F.split(fold(F.col(name_col)), " "), F.lit(0)).alias("t"))
    trade_words = listed.select("t").where(F.col("t") != "and").subtract(first).union(trades).distinct()
    trade_list = trade_words.agg(F.sort_array(F.collect_set("t")).alias("trades"))
    parts = stored(value_parts(values))
    width = F.size("words")
    runs = parts.select(
        "value", "part", "words",
        F.explode(F.flatten(F.transform(F.sequence(F.lit(1), width), lambda i: F.transform(
            F.sequence(F.lit(1), F.least(F.lit(MAX_WORDS), width - i + 1)),
            lambda m: F.struct(i.alias("i"), m.alias("m"), F.array_join(F.slice("words", i, m), "").alias("text")),
        )))).alias("r"),
    ).select("value", "part", F.col("r.i").alias("i"), F.col("r.m").alias("m"), F.col("r.text").alias("text"), F.length("r.text").alias("n")).where(F.col("n") >= 3)
    # the places at which texts of a length are looked at
    places = segments.select("n", F.struct("at", "size").alias("p")).distinct().groupBy("n").agg(F.collect_set("p").alias("ps"))
    looked = runs.select("text", "n").distinct().join(F.broadcast(places), "n").select("text", "n", F.explode("ps").alias("p"))
    looked = looked.select("text", "n", F.col("p.at").alias("at"), F.col("p.size").alias("size"), F.expr("substring(text, p.at, p.size)").alias("seg"))
    near = looked.join(segments, ["n", "at", "size", "seg"]).select("text", "form", "k").distinct()
    near = near.withColumn("distance", F.levenshtein("text", "form")).where(F.col("distance") <= F.col("k")).drop("k")
    hits = near.join(F.broadcast(forms.withColumnRenamed("k", "allowed")), "form").where(F.col("distance") <= F.col("allowed"))
    found = runs.join(hits, "text")
    # a house name needs the absence of any trade word among the other words of the part
    rest = F.filter(F.concat(F.slice("words", F.lit(1), F.col("i") - 1), F.slice("words", F.col("i") + F.col("m"), F.greatest(F.lit(0), F.size("words") - F.col("i") - F.col("m") + 1))), lambda w: F.array_contains("trades", w))
    found = found.join(parts, ["value", "part"]).crossJoin(F.broadcast(trade_list))  # one row
    found = found.where((F.col("kind") == 0) | (F.size(rest) == 0))
    return found.select("value", "part", "ref_id", F.col("category").alias("ref_category"), "kind", "distance", F.col("len").alias("length"))


def mapped_values(rows: DataFrame, reference: DataFrame, id_col: str, name_col: str, aliases_col: str | None = None, category_col: str | None = None) -> DataFrame:
    """(id, ref_id): each entry named in each row's value; -1 for entries that the list lacks.

    ``rows``: id, value, category, strict. A row that is not strict gives no -1. Of several candidates the
    least is taken by: whole name before house name, edit distance, longer form, same category, lower id.
    NULL and empty values name nothing; repeated rows count once; an empty list leaves all unmatched.
    """
    wanted = rows.where(F.col("id").isNotNull() & F.col("value").isNotNull()).select("id", "value", F.lower("category").alias("category"), "strict").distinct()
    values = wanted.select("value").distinct()
    candidates = stored(matched_parts(values, reference, id_col, name_col, aliases_col, category_col))
    groups = wanted.select("value", "category").distinct()
    by = Window.partitionBy("value", "part", "category").orderBy(
        "kind", "distance", F.col("length").desc(), F.when(F.col("ref_category") == F.col("category"), 0).otherwise(1), "ref_id"
    )
    best = groups.join(candidates, "value").withColumn("r", F.row_number().over(by)).where("r = 1").select("value", "part", "category", "ref_id")
    best = stored(best)
    got = wanted.join(best, (wanted.value == best.value) & wanted.category.eqNullSafe(best.category)).select("id", "ref_id")
    parts = value_parts(values).select("value", "part")
    missing = parts.join(best.select("value", "part").distinct(), ["value", "part"], "left_anti").select("value").distinct()
    lacking = wanted.where("strict").join(missing, "value", "left_semi").select("id", F.lit(-1).cast(reference.schema[id_col].dataType).alias("ref_id"))
    return got.union(lacking).distinct()


def poi_brands(poi: DataFrame, brands: DataFrame) -> DataFrame:
    """(id, brand_id) of POIs by brand, or by name where no brand is given."""
    given = F.coalesce(F.trim(F.regexp_replace("brand", " ", " ")), F.lit(""))
    filled = ~F.lower(given).isin(NO_VALUE)
    rows = poi.select("id", F.when(filled, F.col("brand")).otherwise(F.col("name")).alias("value"), "category", filled.alias("strict"))
    return mapped_values(rows, brands, "brand_id", "brand_name", "aliases", "brand_category").select("id", F.col("ref_id").alias("brand_id"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands named by POIs; -1 where the list lacks one."""
    return poi_brands(read_table(spark, sf_dir, "poi"), read_table(spark, sf_dir, "brand_list"))


def p6_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as typed that the list lacks, with the number of their POIs."""
    poi = read_table(spark, sf_dir, "poi")
    lacking = poi_brands(poi, read_table(spark, sf_dir, "brand_list")).where("brand_id = -1").select("id").distinct()
    return poi.select("id", "brand").distinct().join(lacking, "id", "left_semi").groupBy("brand").agg(F.countDistinct("id").alias("pois"))


QUERIES = {"p6_found": p6_found, "p6_unmatched": p6_unmatched}


def _sql_fold(text: str) -> str:
    t = f"regexp_replace(lower({text}), '[\u0300-\u036f]', '', 'g')"
    t = f"regexp_replace({t}, '[''’]s\\b|[''’.®™]', '', 'g')"
    t = f"regexp_replace({t}, '&', ' and ', 'g')"
    t = f"regexp_replace({t}, '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g')"
    return f"translate(trim({t}), '{_FROM}', '{_TO}')"


def _sql_list(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_PLAIN_TRADES = [t.translate(str.maketrans(_FROM, _TO)) for t in OTHER_TRADES]
ORACLE = {
    # every run of words against every form, without segments
    "p6_found": f"""
WITH names AS (
  SELECT brand_id, lower(brand_category) AS category, unnest(list_concat([brand_name], coalesce(aliases, []))) AS name FROM brand_list),
w AS (SELECT brand_id, category, string_split({_sql_fold('name')}, ' ') AS w FROM names),
h AS (SELECT *, CASE WHEN len(w) > 3 AND w[2] = 'and' THEN 3 ELSE 1 END AS h FROM w),
f AS (
  SELECT brand_id, category, array_to_string(w, '') AS form, 0 AS kind FROM h
  UNION SELECT brand_id, category, array_to_string(w[h + 1:], '') || array_to_string(w[1:h], ''), 0 FROM h WHERE len(w) > h
  UNION SELECT brand_id, category, array_to_string(w[1:h], ''), 1 FROM h WHERE len(w) > h),
forms AS (
  SELECT *, length(form) AS n, least(CASE WHEN length(form) >= 9 THEN 2 WHEN length(form) >= 6 THEN 1 ELSE 0 END, CASE WHEN kind = 1 THEN 1 ELSE 2 END) AS k FROM f WHERE length(form) >= 3),
house AS (SELECT DISTINCT string_split({_sql_fold('brand_name')}, ' ')[1] AS t FROM brand_list),
trade AS (
  SELECT t FROM (SELECT DISTINCT unnest(string_split({_sql_fold('brand_name')}, ' ')) AS t FROM brand_list) WHERE t <> 'and' AND t NOT IN (SELECT t FROM house)
  UNION SELECT unnest([{_sql_list(_PLAIN_TRADES)}])),
given AS (SELECT id, brand, name, lower(category) AS category, coalesce(trim(replace(brand, chr(160), ' ')), '') AS g FROM poi WHERE id IS NOT NULL),
rows AS (
  SELECT DISTINCT id, CASE WHEN lower(g) IN ({_sql_list(NO_VALUE)}) THEN name ELSE brand END AS value, category, lower(g) NOT IN ({_sql_list(NO_VALUE)}) AS strict FROM given),
vals AS (SELECT DISTINCT value FROM rows WHERE value IS NOT NULL),
split AS (SELECT value, unnest(ps) AS text, generate_subscripts(ps, 1) AS part FROM (SELECT value, regexp_split_to_array(value, '[;|]|\\s/\\s|/') AS ps FROM vals)),
parts AS (
  SELECT value, part, string_split(folded, ' ') AS words FROM (SELECT value, part, {_sql_fold('text')} AS folded, trim(lower(text)) AS plain FROM split)
  WHERE plain NOT IN ({_sql_list(NO_VALUE)}) AND trim(folded) <> ''),
runs AS (
  SELECT value, part, words, i, m, array_to_string(words[i:i + m - 1], '') AS text
  FROM (SELECT value, part, words, unnest(range(1, len(words) + 1)) AS i FROM parts), range(1, {MAX_WORDS + 1}) r(m) WHERE i + m - 1 <= len(words)),
texts AS (SELECT DISTINCT text, length(text) AS n FROM runs WHERE length(text) >= 3),
near AS (SELECT text, brand_id, category, kind, f.n AS n, levenshtein(text, form) AS d FROM texts t JOIN forms f ON abs(t.n - f.n) <= f.k WHERE levenshtein(text, form) <= f.k),
found AS (
  SELECT value, part, brand_id, near.category AS rc, kind, d, near.n AS n FROM runs JOIN near USING (text), (SELECT list(t) AS ts FROM trade)
  WHERE kind = 0 OR len(list_intersect(list_concat(words[1:i - 1], words[i + m:]), ts)) = 0),
best AS (
  SELECT DISTINCT g.value, part, g.category, first_value(brand_id) OVER (PARTITION BY g.value, part, g.category ORDER BY kind, d, n DESC, CASE WHEN rc = g.category THEN 0 ELSE 1 END, brand_id) AS brand_id
  FROM (SELECT DISTINCT value, category FROM rows) g JOIN found USING (value)),
missing AS (SELECT DISTINCT value FROM parts p WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.value = p.value AND b.part = p.part))
SELECT id, brand_id FROM rows r JOIN best b ON b.value = r.value AND b.category IS NOT DISTINCT FROM r.category
UNION SELECT id, -1 FROM rows JOIN missing USING (value) WHERE strict
""",
}
