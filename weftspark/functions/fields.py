"""Normalisers of order and master fields as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftspark.functions.text import audit_text, clean_text, contains_any, first_case, let, master_text, plain_number, text_of

# Units and the words that carry them.
UNIT = r"(mm|cm|inches|inch|in|\")"
NUMBER = r"(\d+(?:\.\d+)?)"
PACKAGING = "纸箱（三瓦楞七层），内衬防水袋"


def _unit_name(unit: Column, default: Column | str) -> Column:
    low = F.lower(unit)
    default = default if isinstance(default, Column) else F.lit(default)
    return F.when(low.isin("inch", "inches", '"', "in"), "in").when(low == "", default).otherwise(low)


def _centimetres(number: Column, unit: Column) -> Column:
    value = number.cast("double")
    return F.when(unit == "mm", value / 10).when(unit == "in", value * 2.54).otherwise(value)


# ---- fields of an order line

def _default_unit(text: Column) -> Column:
    low = F.lower(text)
    return first_case((F.contains(low, F.lit("mm")), "mm"), (F.contains(low, F.lit("cm")), "cm"), (low.rlike(rf"{NUMBER}\s*(?:inches|inch|in|\")"), "in"), otherwise="cm")


def _extra_size(low: Column) -> Column:
    """extra_size of a text that is clean and in lower case."""
    # The words for the overlapping piece.
    target = r"(?:inner\s+flap|envelope\s+flap|flap|overlap(?:ping)?|tongue|重叠片|内舌)"
    named, numbered = rf"{target}\s*(?:[:：=]|with|of|is)?\s*{NUMBER}\s*{UNIT}", rf"{NUMBER}\s*{UNIT}\s*{target}"
    parts = lambda pattern: F.struct(F.regexp_extract(low, pattern, 1).alias("number"), F.regexp_extract(low, pattern, 2).alias("unit"))
    size = lambda found: F.when(found["number"] != "", F.concat(F.lit("+"), plain_number(_centimetres(found["number"], _unit_name(found["unit"], "cm"))))).otherwise("")
    return let(parts(named), lambda first: F.when(first["number"] != "", size(first)).otherwise(let(parts(numbered), size)))


def extra_size(specification: Column) -> Column:
    """'+n' in centimetres for a flap or overlap that the text gives a size for."""
    return let(F.lower(clean_text(specification)), _extra_size)


def order_size(size: Column, specification: Column) -> Column:
    """length*width in centimetres with the extension, from labelled or bare numbers; the text itself without two numbers.

    Each pattern is applied once: what it finds is bound to a name, and the rest only chooses among what was found.
    """

    def found(cleaned: Column) -> Column:
        fields = [cleaned.alias("text"), _default_unit(cleaned).alias("unit")]
        for letter, word in (("w", "width"), ("l", "length")):
            before = F.lit(rf"(?i)\b(?:{letter}|{word})\s*[:=]?\s*{NUMBER}\s*{UNIT}?")
            behind = F.lit(rf"(?i){NUMBER}\s*{UNIT}?\s*(?:{letter}|{word})\b\s*{UNIT}?")
            for place, pattern, most in (("before", before, 2), ("behind", behind, 3)):
                fields += [F.try_element_at(F.regexp_extract_all(cleaned, pattern, F.lit(k)), F.lit(-1)).alias(f"{letter}_{place}_{k}") for k in range(1, most + 1)]
        bare = F.lit(rf"(?i){NUMBER}\s*{UNIT}?")
        fields += [F.regexp_extract_all(cleaned, bare, F.lit(k)).alias(f"bare_{k}") for k in (1, 2)]
        return F.struct(*fields)

    def labelled(s: Column, letter: str) -> Column:
        number = F.coalesce(s[f"{letter}_before_1"], s[f"{letter}_behind_1"])
        behind = F.when(s[f"{letter}_behind_2"] != "", s[f"{letter}_behind_2"]).otherwise(s[f"{letter}_behind_3"])
        unit = F.when(s[f"{letter}_before_1"].isNotNull(), s[f"{letter}_before_2"]).otherwise(behind)
        return _centimetres(number, _unit_name(F.coalesce(unit, F.lit("")), s["unit"]))

    def bare(s: Column, k: int) -> Column:
        return _centimetres(F.get(s["bare_1"], F.lit(k)), _unit_name(F.coalesce(F.get(s["bare_2"], F.lit(k)), F.lit("")), s["unit"]))

    def chosen(s: Column) -> Column:
        both = labelled(s, "w").isNotNull() & labelled(s, "l").isNotNull()
        sides = F.when(both, F.struct(labelled(s, "l").alias("length"), labelled(s, "w").alias("width"))).otherwise(F.struct(bare(s, 1).alias("length"), bare(s, 0).alias("width")))
        written = lambda z: F.concat(plain_number(z["length"]), F.lit("*"), plain_number(z["width"]), extra_size(specification), F.lit("cm"))
        return let(sides, lambda z: F.when(z["length"].isNotNull(), written(z)).otherwise(s["text"]))

    return let(clean_text(size), lambda cleaned: let(found(cleaned), chosen))


def order_color(text: Column) -> Column:
    """Light grey, grey, or white, which is also the default."""
    low = F.lower(text_of(text))
    return first_case((contains_any(low, ("light grey", "light gray")), "浅灰色"), (contains_any(low, ("grey", "gray")), "灰色"), otherwise="漂白色")


def order_composition(text: Column) -> Column:
    """100C or Cn/Tm, '' if the text has no cotton share."""
    # The ways in which a share is written.
    pure = r"100\s*%\s*cott?on|100\s*%\s*ring\s*spun\s*cott?on|100\s*%c|100%c"
    named = r"(\d{1,3})\s*%\s*cotton\s*[/, ]+\s*(\d{1,3})\s*%\s*poly(?:ester)?"
    slashed = r"(\d{1,3})\s*/\s*(\d{1,3})\s*cotton\s*/\s*poly"

    def written(low: Column) -> Column:
        compact = F.replace(low, F.lit(" "), F.lit(""))
        share = lambda pattern: F.concat(F.lit("C"), F.regexp_extract(low, pattern, 1).cast("int"), F.lit("/T"), F.regexp_extract(low, pattern, 2).cast("int"))
        return first_case(
            (low.rlike(pure), "100C"), (low.rlike(named), share(named)), (low.rlike(slashed), share(slashed)),
            (contains_any(compact, ("80/20cotton/poly", "c80/t20")), "C80/T20"), (contains_any(compact, ("50/50cotton/poly", "c50/t50")), "C50/T50"),
        )

    return let(F.replace(F.lower(clean_text(text)), F.lit("％"), F.lit("%")), written)


def order_fabric(text: Column) -> Column:
    """Family, thread count and composition, joined by a slash as far as they are known."""
    raw = text_of(text)
    low = F.lower(raw)
    family = first_case(
        (contains_any(low, ("stripe", "缎条")), "缎条"), (contains_any(low, ("twill",)), "斜纹"), (contains_any(low, ("plain woven", "plain weave")), "平布"),
        (contains_any(low, ("sateen", "satin", "percale")), "贡缎"),
    )
    patterns = (r"(?i)\bT\s*(\d{3})\b", r"(?i)(\d{3})\s*TC\b", r"(?i)\b(\d{3})\s*thread\s*count\b")
    threads = first_case(*[(raw.rlike(p), F.concat(F.lit("T"), F.regexp_extract(raw, p, 1))) for p in patterns])
    parts = [F.when(p != "", p) for p in (family, threads, order_composition(raw))]
    return F.concat_ws("/", *parts)


HAND_HOLE = r"\bhands?\s+holes?\b|\bhand\s+holds?\b"


def order_style(text: Column) -> Column:
    """The style's standard name from closure, flange, pocket or envelope and hand hole; '' without pocket or envelope."""
    return let(F.lower(clean_text(text)), _style_name)


def _style_name(low: Column) -> Column:
    # The words for each feature and the names they make up.
    bag = low.rlike(r"\bbag\b|\bopen bag\b")
    envelope = F.contains(low, F.lit("envelope")) | (F.contains(low, F.lit("flap")) & ~bag)
    hole = low.rlike(HAND_HOLE) & ~low.rlike(r"\b(?:no|without)\s+(?:hands?\s+holes?|hand\s+holds?)\b")
    flange = low.rlike(r"\b(?:flange|falnge)\b") & ~low.rlike(r"\b(?:no|without)\s+(?:flange|falnge)\b")
    three = low.rlike(r"\b(?:3|three)\s*sides?\s+flange\b|\bflange\s+for\s+(?:3|three)\s+sides?\b")
    tail = low.rlike(r"\b5\s*cm\s*(?:flange|hem)\b|\binternal\s+fold\b")
    tie = low.rlike(r"\bties?\b") & ~low.rlike(r"\b(?:no|without)\s+ties?\b")
    zipped = low.rlike(r"zipper|\bzip\b")
    closing = F.when(zipped, "有拉链").when(tie, "有系带").otherwise("无系带")
    welcome = F.when(hole, "迎宾").otherwise("")
    head = F.when(three, "三飞边双层口叠边口袋").when(tail | (flange & hole), "被尾单飞边双层口叠边口袋").when(flange, "飞边口袋").otherwise("无飞边口袋")
    return F.when(bag, F.concat(head, closing, welcome, F.lit("式"))).when(envelope, F.when(hole, "无飞边平口信封迎宾式").otherwise("无飞边平口信封式")).otherwise("")


def order_size_type(text: Column) -> Column:
    return F.when(contains_any(F.lower(text_of(text)), ("before wash", "delivery size")), "交货尺寸").otherwise("洗涤尺寸")


def order_embroidery(text: Column) -> Column:
    low = F.lower(text_of(text))
    refused = low.rlike(r"\b(?:no|without)\s+embroider(?:y|ed|ing)\b")
    return F.when(~refused & contains_any(low, ("embroidery", "embroidered")), "Y").otherwise("N")


def order_note(text: Column) -> Column:
    """Overlap, hand hole and embroidery, as far as the text has them."""
    extra = extra_size(text)
    return F.concat_ws(
        "，",
        F.when(extra != "", F.concat(F.lit("重叠片"), F.substring(extra, 2, 100))),
        F.when(F.lower(text_of(text)).rlike(HAND_HOLE), "含手洞"),
        F.when(order_embroidery(text) == "Y", "有绣花"),
    )


# ---- fields of the material master

def master_number(value: Column) -> Column:
    """Two places, but a whole number where one is nearer than 0.02."""

    def written(n: Column) -> Column:
        near = F.abs(n["rounded"] - n["whole"]) < 0.02
        return F.when(near, n["whole"].cast("bigint").cast("string")).otherwise(F.regexp_replace(F.format_string("%.2f", n["rounded"]), r"\.?0+$", ""))

    return let(F.bround(value, 2), lambda rounded: let(F.struct(rounded.alias("rounded"), F.bround(rounded, 0).alias("whole")), written))


def master_category(name: Column) -> Column:
    return F.when(audit_text(name).rlike(r"被套|被罩|duvet\s*cover|dubet\s*cover|quilt\s*cover"), "被套").otherwise("")


def master_spec(value: Column) -> Column:
    """a*b in centimetres in the written order, with a structural extension; the text itself where no size is in it."""
    unit = r"(cm|mm|inch|in|\")?"
    size, extension = rf"{NUMBER}{unit}\*{NUMBER}{unit}", rf"\+{NUMBER}{unit}"

    def found(text: Column) -> Column:
        sides = [F.regexp_extract(text, size, k).alias(f"size_{k}") for k in (1, 2, 3, 4)]
        return F.struct(*sides, *[F.regexp_extract(text, extension, k).alias(f"more_{k}") for k in (1, 2)])

    def written(s: Column) -> Column:
        shared = _unit_name(F.when(s["size_2"] != "", s["size_2"]).otherwise(s["size_4"]), "cm")
        number = lambda k: master_number(_centimetres(s[f"size_{k}"], shared))
        more = F.when(s["more_1"] != "", F.concat(F.lit("+"), master_number(_centimetres(s["more_1"], _unit_name(s["more_2"], "cm"))), F.lit("cm"))).otherwise("")
        return F.when(s["size_1"] != "", F.concat(number(1), F.lit("*"), number(3), F.lit("cm"), more))

    plain = F.regexp_replace(F.regexp_replace(audit_text(value), "[×x]", "*"), r"(?U)\s+", "")
    return F.coalesce(let(let(plain, found), written), F.regexp_replace(master_text(value), "[×Xx]", "*"))


def master_color(value: Column) -> Column:
    def named(raw: Column) -> Column:
        low = F.lower(raw)
        # The approved colours and the words for them.
        return first_case(
            (raw.isin("本白", "本白色"), "漂白色"),
            (raw.isin("漂白色", "浅灰色", "深灰色", "灰色", "蓝色", "米色"), raw),
            (low.rlike(r"(?U)\blight\s+gr[ae]y\b|浅灰"), "浅灰色"),
            (low.rlike(r"(?U)\bdark\s+gr[ae]y\b|深灰"), "深灰色"),
            (low.rlike(r"(?U)\bplain\s+white\b|\bwhite\b|漂白"), "漂白色"),
            (low.rlike(r"(?U)\bgr[ae]y\b|灰"), "灰色"),
            (low.rlike(r"(?U)\bbeige\b|米"), "米色"),
            (low.rlike(r"(?U)\bblue\b|蓝"), "蓝色"),
            otherwise=raw,
        )

    return let(master_text(value), named)


def _upper(value: Column) -> Column:
    return F.regexp_replace(F.upper(master_text(value)), "[×X]", "*")


def master_yarn(value: Column) -> Column:
    return F.regexp_replace(_upper(value), r"(?U)\s+", "")


def master_density(value: Column) -> Column:
    """Tn for a thread count; a construction with a star stays."""

    def written(text: Column) -> Column:
        count = F.regexp_extract(text, r"(?:T|TC)?\s*(\d{2,4})", 1)
        return F.when((count != "") & ~F.contains(text, F.lit("*")), F.concat(F.lit("T"), count.cast("int"))).otherwise(F.regexp_replace(text, r"(?U)\s+", ""))

    return let(_upper(value), written)


def master_composition(value: Column) -> Column:
    def written(text: Column) -> Column:
        cotton, poly = r"C(\d{1,3})/?T(\d{1,3})", r"T(\d{1,3})/?C(\d{1,3})"
        share = lambda pattern, c, t: F.concat(F.lit("C"), F.regexp_extract(text, pattern, c).cast("int"), F.lit("/T"), F.regexp_extract(text, pattern, t).cast("int"))
        return first_case((text.isin("C100", "100C", "100%C", "100%棉"), "C100"), (text.rlike(cotton), share(cotton, 1, 2)), (text.rlike(poly), share(poly, 2, 1)), otherwise=text)

    return let(F.replace(F.upper(master_text(value)), F.lit(" "), F.lit("")), written)
