"""What the dictionaries make of the source text of ten fields, beside the rules' values; nothing is changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspark.functions import sizes as S
from weftspark.functions.text import audit_text, first_case, let, plain_number
from weftspark.operators.dictionary import FABRIC_ORDER, STATUSES, color_candidates, colors_in, match_fabrics, single_candidate
from weftspark.sources.dictionaries import Dictionaries

FIELDS = ("币种", "物料名称", "规格", "颜色", "面料", "面料-涤棉成分", "款式", "尺寸类型", "行备注", "是否绣花")
# The fields that are validated for a product.
VALIDATED = ("币种", "物料名称", "规格", "颜色")
MAP = "map<string,string>"


def _pairs(entries: dict[str, Column]) -> Column:
    """A map of the entries whose value is not ''."""
    return F.map_filter(F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), F.coalesce(v, F.lit("")))]), lambda _, v: v != "")


def fabric_components(text: Column) -> Column:
    """Category, density, composition, yarn, construction, weave, stripe and colour that a text names, as a map."""
    return let(audit_text(text), _fabric_parts)


def _fabric_parts(low: Column) -> Column:
    """fabric_components of a text in lower case."""
    # The ways in which yarns, constructions and stripes are written.
    yarn = r"\b(?:j?c|t)?\s*(\d{2,3})\s*s(?:\s*/\s*2)?\s*[x*]\s*(?:j?c|t)?\s*(\d{2,3})\s*s(?:\s*/\s*2)?\b"
    woven = r"(?<!(?:duvet|size|[wl])\s{0,3})\b(\d{2,3})\s*[x*]\s*\(?(\d{2,3})(?!\s*(?:cm|mm|inch|in\b|\"))"
    sides = F.arrays_zip(F.regexp_extract_all(low, F.lit(woven), 1).alias("a"), F.regexp_extract_all(low, F.lit(woven), 2).alias("b"))
    fits = F.filter(sides, lambda s: s["a"].cast("int").between(80, 250) & s["b"].cast("int").between(50, 250))
    stripes = (r"(\d+(?:\.\d+)?)\s*(mm|cm).{0,20}?(?:sateen\s+)?stripes?", r"(?:sateen\s+)?stripes?.{0,20}?(\d+(?:\.\d+)?)\s*(mm|cm)", r"(\d+(?:\.\d+)?)\s*(mm|cm)\s*缎条", r"缎条.{0,20}?(\d+(?:\.\d+)?)\s*(mm|cm)")
    width = lambda p: F.concat(plain_number(F.round(F.regexp_extract(low, p, 1).cast("double") / F.when(F.regexp_extract(low, p, 2) == "mm", 10).otherwise(1), 2)), F.lit("cm"))
    return _pairs(
        {
            "category": S.family_in(low), "density": S.density_in(low), "composition": S.composition_in(low),
            "yarn_count": F.when(low.rlike(yarn), F.concat(F.regexp_extract(low, yarn, 1).cast("int"), F.lit("S*"), F.regexp_extract(low, yarn, 2).cast("int"), F.lit("S"))),
            "construction": F.when(F.size(fits) > 0, F.concat(F.get(fits, F.lit(0))["a"].cast("int"), F.lit("*"), F.get(fits, F.lit(0))["b"].cast("int"))),
            "weave": first_case((low.rlike(r"sateen|satin|贡缎|缎纹"), "缎纹"), (low.rlike(r"twill|斜纹"), "斜纹"), (low.rlike(r"percale|plain\s+(?:fabric|woven|weave)|平纹|平布"), "平纹")),
            "stripe_width": first_case(*[(low.rlike(p), width(p)) for p in stripes]),
            "color": F.get(colors_in(low), F.lit(0)),
        }
    )


def fabric_row_components(fabrics: DataFrame) -> DataFrame:
    """source_row, components and projection of the fabric dictionary; its own columns outrank what its names say."""
    named = fabric_components(F.concat_ws(" ", "fabric_family", "fabric_standard"))
    density = F.regexp_extract("density", r"(?i)\bT(\d{2,4})\b", 1)
    own = _pairs({"composition": S.text_composition(F.col("composition_raw")), "density": F.when(density != "", F.concat(F.lit("T"), density.cast("int"))), "color": F.get(color_candidates(F.col("color_standard")), F.lit(0))})
    rest = F.map_filter("_named", lambda k, _: (k != "composition") & ~F.array_contains(F.map_keys("_own"), k))
    out = fabrics.withColumns({"_named": named, "_own": own}).withColumn("components", F.map_concat(rest, "_own")).drop("_named", "_own")
    return out.withColumn("projection", projection(F.col("components")))


def projection(components: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*[F.try_element_at(components, F.lit(k)) for k in ("category", "density", "composition")])), "/")


# The words that show each style feature.
_FLANGE = r"\b(?:flange|falnge)\b|飞边"
_FEATURES = {
    "bag": r"\bbag\b|\bpocket\b|口袋", "hole": r"\bhands?\s+holes?\b|\bhand\s+holds?\b|手洞", "no_hole": r"\b(?:no|without)\s+(?:hands?\s+holes?|hand\s+holds?)\b|无手洞",
    "no_flange": r"\b(?:no|without)\s+(?:flange|falnge)\b|无飞边", "three": r"\b(?:3|three)\s*sides?\s+(?:with\s+)?(?:flange|falnge)\b|\b(?:flange|falnge)\s+(?:at|for|on)\s+(?:3|three)\s+sides?\b",
    "tail": r"\b5\s*cm\s*(?:flange|hem)\b|\binternal\s+fold\b", "no_tie": r"\b(?:no|without)\s+ties?\b|无系带", "tie": r"\bties?\b|系带", "zip": r"\bzip(?:per)?\b|拉链",
    "bottom": r"\bbottom\s+opening\b|\bopen(?:ing)?\s+(?:at|on)\s+(?:the\s+)?bottom\b|底部开口|被尾开口", "envelope": r"\benvelope\b|信封", "piping": r"\bpiping\b|牙条",
}
_NO_FLAP, _FLAP = r"\b(?:no|without)\s+(?:inner\s+)?flap\b|无内叠片|无叠片", r"\b(?:inner\s+)?flap\b|overlap(?:ping)?|内叠片|重叠片|叠边"
CORE = ("form", "flange", "tie", "zipper", "pocket", "welcome", "double_opening")
EXTRAS = {"piping": "牙条", "magic_tape": "魔术贴", "button": "纽扣", "tongue": "压舌", "offset_opening": "距边开口|反面距", "hooked_corner": "勾角", "corner_tie": "四角系带"}


def style_components(text: Column) -> Column:
    """The style that a description shows, as a map; form is missing where it shows no style as a whole."""
    low = audit_text(text)
    has = {k: low.rlike(p) for k, p in _FEATURES.items()}
    refused, flap = low.rlike(_NO_FLAP), F.regexp_replace(low, _NO_FLAP, " ").rlike(_FLAP)
    hole, tie, flange = has["hole"] & ~has["no_hole"], has["tie"] & ~has["no_tie"], low.rlike(_FLANGE) & ~has["no_flange"]
    form = first_case((has["bag"], "bag"), (has["envelope"] | flap, "envelope"), (has["bottom"] & refused, "open_bottom_no_flap"))
    edge = first_case((form == "envelope", "none"), (has["three"], "three"), (has["tail"] | flange, "tail_single"), otherwise="none")
    whole = form != ""
    yes = lambda c: F.when(c, "yes").otherwise("no")
    return _pairs(
        {
            "form": form, "flange": F.when(whole, edge), "tie": F.when(whole, yes(tie)), "zipper": F.when(whole, yes(has["zip"])), "pocket": F.when(whole, yes(has["bag"])), "welcome": F.when(whole, yes(hole)),
            "double_opening": F.when(whole, yes(has["bag"] & edge.isin("tail_single", "three"))), "bottom_opening": F.when(has["bottom"], "yes"), "flap": F.when(flap, "yes").when(refused, "no"),
            "hand_hole": F.when(hole, "yes"), "piping": F.when(has["piping"], "yes"),
        }
    )


def style_row_components(styles: DataFrame) -> DataFrame:
    """source_row, standard_name and components of the style dictionary."""
    text = audit_text(F.concat_ws(" ", "standard_name", "other_structure"))
    c = F.col
    says = lambda word: F.contains(text, F.lit(word))
    bag = says("口袋") | c("has_pocket").isin("是", "有口袋")
    flat = says("信封") | says("平口")
    edge = lambda word: F.contains(c("flange"), F.lit(word)) | says(word)
    flange = first_case((edge("无飞边"), "none"), (edge("四飞边"), "four"), (edge("三飞边"), "three"), (edge("两飞边"), "two"), (says("被头单飞边"), "head_single"), (says("被尾单飞边"), "tail_single"), (says("单飞边"), "single"), (edge("飞边"), "tail_single"))
    entries = {
        "form": F.when(bag, "bag").when(flat, "envelope"), "pocket": F.when(bag, "yes").when(flat | c("has_pocket").isin("否", "无口袋"), "no"), "flange": flange,
        "tie": F.when(F.contains(c("tie"), F.lit("有系带")) | says("加系带"), "yes").when(F.contains(c("tie"), F.lit("无系带")) | says("无系带"), "no"),
        "zipper": F.when(F.contains(c("zipper"), F.lit("有拉链")) | says("拉链"), "yes").when(c("zipper") != "", "no"),
        "welcome": F.when(c("is_welcome_style").isin("是", "迎宾式") | says("迎宾"), "yes").when(c("is_welcome_style") != "", "no"),
        "double_opening": F.when(text.rlike("双层口|双叠边"), "yes").otherwise("no"), "envelope_hybrid": F.when(bag & says("信封"), "yes"),
        **{k: F.when(text.rlike(p), "yes") for k, p in EXTRAS.items()},
    }
    return styles.select("source_row", "standard_name", _pairs(entries).alias("components"))


def match_styles(queries: DataFrame, dictionary: DataFrame, key: str) -> DataFrame:
    """key, source_row and standard_name of the dictionary's styles that a description shows in every core feature, without
    any extra that it doesn't show.  queries: key, components; the form is the join key."""
    get = lambda side, k: F.coalesce(F.try_element_at(F.col(side), F.lit(k)), F.lit(""))
    fits = F.lit(True)
    for k in CORE:
        fits = fits & ((get("_q", k) == "") | (get("_q", k) == get("_d", k)))
    for k in (*EXTRAS, "envelope_hybrid"):
        fits = fits & ((get("_d", k) != "yes") | (get("_q", k) == "yes"))
    for k in ("tie", "zipper", "pocket", "welcome"):
        fits = fits & (get("_d", k) != "")
    q = queries.select(key, F.col("components").alias("_q"), get("components", "form").alias("_form")).filter("_form <> '' and _form <> 'open_bottom_no_flap'")
    d = dictionary.select("source_row", "standard_name", F.col("components").alias("_d"), get("components", "form").alias("_form"))
    return q.join(d, "_form").filter(fits).select(key, "source_row", "standard_name")


def _result(status: Column, candidates: Column, matched: Column | None = None, missing: Column | None = None, conflicting: Column | None = None) -> Column:
    none = F.array().cast("array<string>")
    return F.struct(status.alias("status"), candidates.cast("array<string>").alias("candidates"), *[(c if c is not None else none).cast("array<string>").alias(n) for c, n in ((matched, "matched"), (missing, "missing"), (conflicting, "conflicting"))])


def _words(low: Column, words: dict[str, str]) -> Column:
    return F.array_compact(F.array(*[F.when(low.rlike(p), standard) for standard, p in words.items()]))


def compare_simple(field: Column, source: Column, value: Column) -> Column:
    """Comparison of the fields that need no dictionary rows; null for the others."""
    low = audit_text(source)
    # The words for each standard value.
    currency = _words(low, {"美元": r"\busd\b|\bus\$|\$", "人民币": r"\brmb\b|\bcny\b|人民币|¥", "日元": r"\bjpy\b|\byen\b|円", "欧元": r"\beur\b|€"})
    size_type = _words(low, {"洗涤尺寸": "after wash|washed size|洗涤", "交货尺寸": "before wash|delivery size|finished size"})
    embroidery = F.array_compact(F.array(F.when(low.rlike(r"no\s+embroider|without\s+embroider|无绣|不绣"), "N").when(low.rlike("embroider|绣"), "Y")))
    notes = _words(low, {"含手洞": "hand hole|手洞", "重叠片": "overlap|重叠", "牙条": "piping|牙条", "绣花": "embroidery|绣"})
    cover = F.when(low.rlike(r"duvet\s*cover|quilt\s*cover|被套"), F.array(F.lit("被套"))).otherwise(F.array().cast("array<string>"))
    kept, lost = F.filter(notes, lambda n: F.contains(value, n)), F.filter(notes, lambda n: ~F.contains(value, n))
    note_status = first_case(
        (F.size(notes) == 0, "dictionary_no_match"), ((F.size(lost) > 0) & (F.size(kept) > 0), "partial_match"), (F.size(lost) > 0, "conflict"), (F.array_contains(notes, value), "exact_match"), otherwise="partial_match",
    )
    composition, official = S.text_composition(source), S.text_composition(value)
    parts = F.when(composition == "", F.array().cast("array<string>")).otherwise(F.array(composition))
    part_status = first_case((composition == "", "dictionary_no_match"), (composition == official, "equivalent_match"), otherwise="conflict")
    one = lambda c: _result(single_candidate(c, value), c)
    return (
        F.when(field == "币种", one(currency)).when(field == "尺寸类型", one(size_type)).when(field == "是否绣花", one(embroidery)).when(field == "颜色", one(color_candidates(source)))
        .when(field == "物料名称", F.when((F.size(cover) > 0) & F.contains(value, F.lit("被套")), _result(F.lit("equivalent_match"), cover)).otherwise(one(cover)))
        .when(field == "行备注", _result(note_status, notes, kept, lost, F.when(note_status == "conflict", lost).otherwise(F.array().cast("array<string>"))))
        .when(field == "面料-涤棉成分", _result(part_status, parts))
    )


def compare_sizes(source: Column, value: Column) -> Column:
    """Comparison of a size written width first with the record's, length first; source and value are parsed sizes."""
    near = lambda a, b: F.abs(a - b) < 0.01
    length, width = F.when(source["length"] == source["first"], source["second"]).otherwise(source["length"]), F.when(source["length"] == source["first"], source["first"]).otherwise(source["width"])
    same = near(length, value["length"]) & near(width, value["width"])
    text = F.concat(plain_number(F.round(length, 2)), F.lit("*"), plain_number(F.round(width, 2)), F.when(source["extension"] != 0, F.concat(F.lit("+"), plain_number(F.round(source["extension"], 2)))).otherwise(""), F.lit("cm"))
    status = first_case(
        (source["first"].isNull(), "dictionary_no_match"), (same & near(source["extension"], value["extension"]) & near(source["first"], value["first"]), "exact_match"),
        (same & near(source["extension"], value["extension"]), "equivalent_match"), (same & (value["extension"] > 0), "partial_match"), otherwise="conflict",
    )
    return _result(status, F.when(source["first"].isNull(), F.array().cast("array<string>")).otherwise(F.array(text)))


def compare(evidence: DataFrame, dictionaries: Dictionaries) -> DataFrame:
    """record_id, field, value, value_status, source_text, status, candidates, matched, missing, conflicting.

    evidence: record_id, field, source_text, value, value_status, source_cells for every record and field.
    """
    key = ["record_id", "field"]
    rows = evidence.filter(F.col("field").isin(*FIELDS))
    given = rows.filter(F.trim("source_text") != "")
    simple = given.withColumn("r", compare_simple(F.col("field"), F.col("source_text"), F.col("value"))).filter("r is not null")
    sizes = given.filter("field = '规格'").withColumns({"_s": S.size_of(F.col("source_text")), "_v": S.size_of(F.col("value"))}).withColumn("r", compare_sizes(F.col("_s"), F.col("_v"))).drop("_s", "_v")
    parts = [simple, sizes, _compare_fabrics(given.filter("field = '面料'"), dictionaries.fabrics), _compare_styles(given.filter("field = '款式'"), dictionaries.styles)]
    nothing = rows.filter(F.trim("source_text") == "").withColumn("r", _result(F.lit("source_not_provided"), F.array().cast("array<string>")))
    out = nothing.select(*evidence.columns, "r")
    for part in parts:
        out = out.unionByName(part.select(*evidence.columns, "r"))
    return out.select(*evidence.columns, "r.*").dropDuplicates(key)


def _grouped(matched: DataFrame, value: str) -> DataFrame:
    return matched.groupBy("record_id").agg(F.array_sort(F.collect_set(value)).alias("_candidates"), F.array_sort(F.collect_set("source_row")).alias("_rows"))


def _compare_fabrics(rows: DataFrame, fabrics: DataFrame) -> DataFrame:
    book = fabric_row_components(fabrics)
    rows = rows.withColumns({"components": fabric_components(F.col("source_text")), "_official": fabric_components(F.col("value"))})
    matched = match_fabrics(rows, book, "record_id").join(book.select("source_row", "projection"), "source_row").filter("projection <> ''")
    rows = rows.join(_grouped(matched, "projection"), "record_id", "left").withColumn("_candidates", F.coalesce("_candidates", F.array().cast("array<string>")))
    keys = F.array(*[F.lit(k) for k in FABRIC_ORDER[:3]])
    at = lambda m, k: F.try_element_at(F.col(m), k)
    own = F.filter(keys, lambda k: at("components", k).isNotNull())
    agree = F.filter(own, lambda k: at("components", k) == at("_official", k))
    clash = F.filter(own, lambda k: at("components", k) != at("_official", k))
    open_ = F.filter(own, lambda k: at("_official", k).isNull() | (at("components", k) == at("_official", k)))
    only = F.get(F.col("_candidates"), F.lit(0))
    theirs = F.filter(keys, lambda k: at("_official", k).isNotNull() & ~F.contains(only, at("_official", k)) & at("components", k).isNotNull())
    status = first_case(
        (F.size(F.map_keys("components")) == 0, "dictionary_no_match"), (F.size(clash) > 0, "conflict"), (F.size("_candidates") == 0, "dictionary_no_match"), (F.size("_candidates") > 1, "ambiguous"), (F.size(theirs) > 0, "conflict"),
        ((F.size(own) > 0) & (F.size(open_) == F.size(own)), "equivalent_match"), otherwise="partial_match",
    )
    shown = F.when(F.size("_candidates") > 0, F.col("_candidates")).otherwise(F.array(projection(F.col("components"))))
    return rows.withColumn("r", _result(status, shown, agree, F.array_except(own, agree), clash))


def _compare_styles(rows: DataFrame, styles: DataFrame) -> DataFrame:
    rows = rows.withColumn("components", style_components(F.col("source_text")))
    rows = rows.join(_grouped(match_styles(rows, style_row_components(styles), "record_id"), "standard_name"), "record_id", "left").withColumn("_candidates", F.coalesce("_candidates", F.array().cast("array<string>")))
    form = F.try_element_at(F.col("components"), F.lit("form"))
    keys = F.array_sort(F.map_keys("components"))
    only = F.get(F.col("_candidates"), F.lit(0))
    marks = ("口袋", "信封", "无飞边", "三飞边", "有系带", "拉链", "迎宾", "双层口")
    differ = F.filter(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(only, m) != F.contains(F.col("value"), m))
    status = first_case(
        (F.size(keys) == 0, "source_not_provided"), (F.size("_candidates") > 1, "ambiguous"), ((F.size("_candidates") == 1) & ((only == F.col("value")) | ((F.col("value") != "") & (F.size(differ) == 0))), "equivalent_match"),
        ((F.size("_candidates") == 1) & (F.col("value") == ""), "partial_match"), (F.size("_candidates") == 1, "conflict"), (form.isNull(), "partial_match"), otherwise="dictionary_no_match",
    )
    return rows.withColumn("r", _result(status, F.col("_candidates"), keys, F.when(form.isNull(), F.array(F.lit("style_form"))).otherwise(F.array().cast("array<string>")), F.when(status == "conflict", differ).otherwise(F.array().cast("array<string>"))))


def validated(compared: DataFrame) -> DataFrame:
    """The four fields that are validated for a product, with the action that follows."""
    return compared.filter(F.col("field").isin(*VALIDATED)).withColumn("action", F.when(F.col("status").isin("ambiguous", "conflict", "partial_match"), "manual_review").otherwise("keep"))


def _every_field(fields: tuple[str, ...], df: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """One row per field, in its place, with these counts; zero for a field that does not occur."""
    every = df.sparkSession.createDataFrame([(n, f) for n, f in enumerate(fields)], "place int, field string")
    found = df.groupBy("field").agg(*[c.alias(n) for n, c in counts.items()])
    return every.join(found, "field", "left").na.fill(0, list(counts)).select("place", "field", *counts)


def summary(compared: DataFrame, fields: tuple[str, ...] = FIELDS) -> dict[str, DataFrame]:
    """Of a comparison: `fields`, statuses per field; `totals`, over all fields; `open`, what a person has to look at."""
    counts = {s: F.count_if(F.col("status") == s) for s in STATUSES}
    inside = compared.filter(F.col("field").isin(*fields))
    totals = inside.agg(F.count_distinct("record_id").alias("records"), F.count(F.lit(1)).alias("comparisons"), *[c.alias(n) for n, c in counts.items()])
    return {"fields": _every_field(fields, inside, counts), "totals": totals, "open": inside.filter(F.col("status").isin("conflict", "ambiguous", "more_specific"))}


def validation_summary(checked: DataFrame) -> DataFrame:
    """Of validated fields (status and action): how often each status and each action occurs, per field."""
    counts = {s: F.count_if(F.col("status") == s) for s in STATUSES} | {a: F.count_if(F.col("action") == a) for a in ("keep", "manual_review")}
    return _every_field(VALIDATED, checked, counts)
