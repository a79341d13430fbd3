"""Problem 3: quantities and prices recorded per different units, brought to the common unit of their kind.

``parse_unit`` reads a unit as written: a spelling of a basic unit, a multiple of one ("100 m"), or a package ("cuộn 200m",
"hộp/50 chiếc", "tấm 1,22x2,44m"). Where the unit field is empty, ``stated_unit`` finds one named in the row's texts.
Rows that name no unit anywhere go to a tree ensemble (random forest) that predicts the unit from the magnitude of quantity
and price, the source, the category (first words of the name) and neighbouring fields; it is fitted on a bounded sample of rows
with a known unit, calibrated by isotonic regression on held-out rows, and only predictions above ``confident`` convert; the
others are routed for review.

Defined cases: a null, blank or unknown unit without a statement is 'model' or 'review'; things that aren't measured (bộ, set,
lô…) give kind 'none' and no factor; a null quantity stays null; equal rows get equal results; an empty table gives an empty
result, and with fewer than ``LEAST_LABELLED`` labelled rows everything unnamed goes to review.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.functions.fold import bare, plain
from bidloom.functions.worker import bounded

#: Labelled rows the classifier is fitted on, at most; taken by hash of the row id.
SAMPLE = 20_000
LEAST_LABELLED = 200
CONFIDENT = 0.9
#: Slots that sources and words of names are hashed into.
SLOTS = 2048
# Spellings of units, without accents unless they matter, and how many millionths of the common unit each holds.
LENGTH = {"m": 10**6, "met": 10**6, "meter": 10**6, "metre": 10**6, "md": 10**6, "m dai": 10**6, "met dai": 10**6, "mdai": 10**6, "lm": 10**6, "rm": 10**6, "dm": 10**5, "cm": 10**4, "mm": 10**3, "km": 10**9, "kilomet": 10**9, "kilometer": 10**9, "kilometre": 10**9, "cay so": 10**9,
          "inch": 25_400, "inches": 25_400, "in": 25_400, "ft": 304_800, "feet": 304_800, "foot": 304_800, "yard": 914_400, "yd": 914_400, "phan": 10**4, "centimet": 10**4, "milimet": 10**3, "decimet": 10**5}
AREA = {"m2": 10**6, "met vuong": 10**6, "m vuong": 10**6, "met2": 10**6, "sqm": 10**6, "dm2": 10**4, "cm2": 100, "mm2": 1, "km2": 10**12, "ha": 10**10, "hecta": 10**10, "hectare": 10**10, "sqft": 92_903, "ft2": 92_903, "are": 10**8}
VOLUME = {"m3": 10**6, "met khoi": 10**6, "m khoi": 10**6, "met3": 10**6, "khoi": 10**6, "cbm": 10**6, "dm3": 1000, "cm3": 1, "cc": 1, "lit": 1000, "liter": 1000, "litre": 1000, "l": 1000, "ml": 1, "hl": 10**5, "mililit": 1}
MASS = {"kg": 10**6, "kilogam": 10**6, "kilogram": 10**6, "ki lo gam": 10**6, "kgs": 10**6, "ky": 10**6, "kilo": 10**6, "g": 1000, "gam": 1000, "gram": 1000, "gr": 1000, "tan": 10**9, "ton": 10**9, "tonne": 10**9, "tons": 10**9, "t": 10**9, "yen": 10**7, "mg": 1, "lb": 453_592}
COUNT = {"cai": 10**6, "chiec": 10**6, "pcs": 10**6, "pc": 10**6, "ea": 10**6, "each": 10**6, "piece": 10**6, "pieces": 10**6, "nos": 10**6, "no": 10**6, "unit": 10**6, "qua": 10**6, "con": 10**6, "cap": 2 * 10**6, "doi": 2 * 10**6, "pair": 2 * 10**6, "pairs": 2 * 10**6, "dozen": 12 * 10**6, "dz": 12 * 10**6, "doz": 12 * 10**6}
#: Spellings whose accents decide.
ACCENTED = {"tá": ("count", 12 * 10**6), "tạ": ("mass", 10**8), "tấn": ("mass", 10**9), "yến": ("mass", 10**7), "cặp": ("count", 2 * 10**6), "đôi": ("count", 2 * 10**6)}
NOT_MEASURED = {"bo", "tu", "he", "lo", "set", "he thong", "ht", "lot", "goi", "tron goi", "bo", "sets", "system", "phan", "muc", "ls", "lump sum", "ca", "cong", "thang", "ngay"}
BASIC = {w: (k, f) for k, words in (("length", LENGTH), ("area", AREA), ("volume", VOLUME), ("mass", MASS), ("count", COUNT)) for w, f in words.items()}
PACKAGE = r"(?:cuon|cay|ong|thanh|tam|hop|phuy|thung|can|xe|bao|me|bo|rulo|drum|roll|box|pack|bag|kien|vi|lo|binh|chai|tui|carton|pallet|set|bich|xo|day|to|mang|ket|bundle|coil|bar|sheet|tank|barrel|bottle|can)"
NUM = r"(\d+(?:[.,]\d+)?)"
UNIT = "|".join(sorted(map(re.escape, BASIC), key=len, reverse=True))
PACKED = re.compile(rf"(?:(?P<pack>{PACKAGE})\b\s*[/(:x-]?\s*)?\(?\s*(?P<n>\d+(?:[.,]\d+)?)\s*(?P<unit>{UNIT})\s*\)?(?:\s*/\s*{PACKAGE})?$")
SHEET = re.compile(rf"(?:{PACKAGE}\b\s*[/(:-]?\s*)?\(?\s*(?P<a>\d+(?:[.,]\d+)?)\s*(?P<ua>mm|cm|dm|m)?\s*[x*×]\s*(?P<b>\d+(?:[.,]\d+)?)\s*(?P<u>mm|cm|dm|m)\s*\)?$")
STATED = re.compile(
    r"(?:đvt|đơn vị tính|đơn vị|dvt|don vi tinh|unit of measure(?:ment)?|uom|unit|tính theo|tính bằng|ghi theo|ghi bằng|chào theo|chào bằng|báo theo|đo bằng|đo theo|tinh theo|tinh bang|ghi theo|chao theo|priced per|measured in|quoted per|per unit of)\s*(?:là\b|:|=)?\s*(?P<rest>[^\]\n;]{1,40})", re.I
)


def _number(text: str) -> float:
    return float(text.replace(",", "."))


@bounded
def parse_unit(text: str | None) -> tuple[str, int, bool] | None:
    """(kind, millionths of the common unit, whether it is a mere spelling of the common unit); kind 'none' for things not measured; None if unknown."""
    if not text or not text.strip(" -."):
        return None
    seen = re.sub(r"\s+", " ", plain(text).lower().replace("²", "2").replace("³", "3").replace("^", "")).strip(" .,:;")
    if seen in ACCENTED:
        return (*ACCENTED[seen], False)
    flat = bare(seen).strip(" .")
    flat = re.sub(r"(?<=[a-z])\s(?=[23]$)", "", flat)
    if flat == "ta":
        return None
    if flat in NOT_MEASURED and seen not in ("bó",):
        return ("none", 0, False)
    if flat in BASIC:
        kind, f = BASIC[flat]
        return kind, f, f == 10**6
    if m := SHEET.match(flat):
        scale = {"mm": 1000, "cm": 10**4, "dm": 10**5, "m": 10**6}
        side = _number(m["a"]) * scale[m["ua"] or m["u"]] * _number(m["b"]) * scale[m["u"]]
        return "area", round(side / 10**6), False
    if m := PACKED.match(flat):
        kind, f = BASIC[m["unit"]]
        last = re.search(r"([^\d\s/(]+)\)?$", seen)
        if last and last[1] in ACCENTED:
            kind, f = ACCENTED[last[1]]
        return kind, round(_number(m["n"]) * f), False
    return None


@bounded
def stated_unit(text: str | None) -> tuple[str, int, bool] | None:
    """The unit that a text names with words such as "ĐVT:" or "unit:"; the longest reading wins."""
    if not text:
        return None
    for m in STATED.finditer(plain(text)):
        words = re.split(r"(?<=\S)\s+(?=\S)", m["rest"].strip())
        for n in range(min(len(words), 5), 0, -1):
            part = " ".join(words[:n])
            for form in (part, part.strip(" .,:/-])"), part.strip(" .,:/-]").rstrip(")") if part.count(")") > part.count("(") else part):
                if got := parse_unit(form.replace("\u0000", "")):
                    return got
    return None


UNIT_TYPE = "struct<kind string, factor_micro long, common boolean>"


def _frame(results: list) -> pd.DataFrame:
    return pd.DataFrame({"kind": [r[0] if r else None for r in results], "factor_micro": pd.array([r[1] if r and r[0] != "none" else None for r in results], "Int64"), "common": pd.array([r[2] if r else None for r in results], "boolean")})


def empty_unit(column: Column) -> Column:
    return column.isNull() | F.trim(column).isin("", "-")


def read_units(df: DataFrame, unit: str, *texts: str) -> DataFrame:
    """Adds ``kind``, ``factor_micro``, ``common`` and ``told_by`` ('unit', 'text' or null) from the unit field or, if it is empty, from the texts in order."""

    @F.pandas_udf(UNIT_TYPE)
    def parsed(s: pd.Series) -> pd.DataFrame:
        return _frame([parse_unit(t) for t in s])

    @F.pandas_udf(UNIT_TYPE)
    def stated(s: pd.Series) -> pd.DataFrame:
        return _frame([stated_unit(t) for t in s])

    empty = empty_unit(F.col(unit))
    line = F.concat_ws("\n", *texts) if texts else F.lit(None).cast("string")
    hint = line.rlike("(?iu)đvt|đơn vị|dvt|don vi|unit|uom|tính theo|tính bằng|ghi theo|ghi bằng|chào theo|chào bằng|báo theo|đo bằng|đo theo|per\\b|measured")
    got = df.withColumn("__u", F.when(~empty, parsed.asNondeterministic()(F.when(~empty, F.col(unit))))).withColumn("__s", F.when(empty & hint, stated.asNondeterministic()(F.when(empty & hint, line))))
    got = got.withColumn("told_by", F.when(~empty & F.col("__u.kind").isNotNull(), "unit").when(empty & F.col("__s.kind").isNotNull(), "text"))
    return got.withColumns({c: F.coalesce(F.col(f"__u.{c}"), F.col(f"__s.{c}")) for c in ("kind", "factor_micro", "common")}).drop("__u", "__s")


def _features(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Numeric features and hashed words for the classifier."""
    log = lambda c: F.coalesce(F.log10(F.when(c > 0, c)), F.lit(-9.0))
    words = F.slice(F.split(F.lower(F.coalesce(cols["name"], F.lit(""))), r"[^\p{L}]+"), 1, 4)
    return df.select("*", log(cols["quantity"]).alias("__q"), log(cols["price"]).alias("__p"), F.coalesce(cols["source"], F.lit("")).alias("__src"), *[F.coalesce(F.get(words, F.lit(i)), F.lit("")).alias(f"__w{i}") for i in range(3)], F.coalesce(cols["name"].rlike(r"\d[\d.,]*\s*[x×*]\s*\d"), F.lit(False)).cast("double").alias("__dims"))


class Predictor:
    """A fitted forest with its calibration, and the held-out rows (label, guess, calibrated confidence) that it was calibrated on."""

    def __init__(self, model, calibrated, held: DataFrame):
        self.model, self.calibrated, self.held = model, calibrated, held

    def guesses(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        return self.calibrated.transform(self.model.transform(rows.withColumn("__label", F.lit("rare|0"))).withColumn("p", F.array_max(vector_to_array(F.col("__prob")))))


def fit_units(rows: DataFrame, key: str) -> Predictor | None:
    """The forest of at most ``SAMPLE`` labelled rows of ``_features``' output, four fifths for the trees and one for the calibration; None for too few."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import FeatureHasher, IndexToString, StringIndexer, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    label = F.when(F.col("kind") == "none", "none|0").otherwise(F.concat_ws("|", "kind", F.col("factor_micro").cast("string")))
    known = rows.filter(F.col("told_by").isNotNull()).withColumn("__label", label)
    hashed = F.xxhash64(F.col(key).cast("string"))
    columns = [c for c in known.columns if c.startswith("__")]
    share = known.select(F.count("*")).first()[0]
    if share < LEAST_LABELLED:
        return None
    cut = min(1.0, SAMPLE / share)
    tmp = known.filter(F.pmod(hashed, F.lit(1_000_000)) < int(cut * 1_000_000)).select(*columns, F.pmod(F.xxhash64(hashed), F.lit(5)).alias("__fold")).toPandas()
    spark = rows.sparkSession
    common = tmp["__label"].value_counts()
    tmp.loc[~tmp["__label"].isin(common[common >= 10].index), "__label"] = "rare|0"
    fit, held = spark.createDataFrame(tmp[tmp["__fold"] > 0]).coalesce(2), spark.createDataFrame(tmp[tmp["__fold"] == 0]).coalesce(2)
    indexer = StringIndexer(inputCol="__label", outputCol="__y", handleInvalid="keep").fit(fit)
    model = Pipeline(stages=[
        FeatureHasher(inputCols=["__src", "__w0", "__w1", "__w2"], outputCol="__h", numFeatures=SLOTS), VectorAssembler(inputCols=["__h", "__q", "__p", "__dims"], outputCol="__x"), indexer,
        RandomForestClassifier(featuresCol="__x", labelCol="__y", numTrees=20, maxDepth=10, seed=7, subsamplingRate=0.8, probabilityCol="__prob", rawPredictionCol="__raw", predictionCol="__pred"),
        IndexToString(inputCol="__pred", outputCol="__guess", labels=[*indexer.labels, "rare|0"]),
    ]).fit(fit)
    scored = model.transform(held).select(F.array_max(vector_to_array(F.col("__prob"))).alias("p"), "__label", "__guess", (F.col("__guess") == F.col("__label")).cast("double").alias("hit"))
    calibrated = IsotonicRegression(featuresCol="p", labelCol="hit", predictionCol="c").fit(scored)
    return Predictor(model, calibrated, scored)


def masked_accuracy(df: DataFrame, key: str, cols: dict[str, Column], confident: float = CONFIDENT) -> dict[str, float]:
    """How the forest does on rows whose known unit is hidden from it and from the calibration: rows, share converted, share of right ones among them.

    Rows are split by hash: the classifier sees ``read_units``' rows of one half, the other half is predicted."""
    rows = _features(df, cols).filter(F.col("told_by").isNotNull())
    half = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("masked")), F.lit(2))
    fitted = fit_units(rows.filter(half == 0), key)
    if fitted is None:
        return {"rows": 0, "converted": 0.0, "right": 0.0}
    told = F.when(F.col("kind") == "none", "none|0").otherwise(F.concat_ws("|", "kind", F.col("factor_micro").cast("string")))
    got = fitted.guesses(rows.filter(half == 1).withColumn("__told", told)).select(((F.col("c") >= confident) & (F.col("__guess") != "rare|0")).alias("sure"), (F.col("__guess") == F.col("__told")).alias("hit"))
    n, sure, right = got.agg(F.count("*"), F.count_if("sure"), F.count_if(F.col("sure") & F.col("hit"))).first()
    return {"rows": n, "converted": sure / max(n, 1), "right": right / max(sure, 1)}


def predict_units(df: DataFrame, key: str, cols: dict[str, Column], confident: float = CONFIDENT) -> DataFrame:
    """Adds ``predicted_kind``, ``predicted_factor``, ``confidence`` and ``route`` ('known', 'convert', 'review') to the output of ``read_units``.

    The forest learns from at most ``SAMPLE`` labelled rows; every row without a told unit is predicted. The input is read several
    times, so it should be cut from its lineage."""
    rows = _features(df, cols)
    plainly = df.withColumns({"predicted_kind": F.lit(None).cast("string"), "predicted_factor": F.lit(None).cast("long"), "confidence": F.lit(None).cast("double"), "route": F.when(F.col("told_by").isNotNull(), "known").otherwise("review")})
    fitted = fit_units(rows, key)
    if fitted is None:
        return plainly
    guessed = fitted.guesses(rows.filter(F.col("told_by").isNull()))
    part = F.split("__guess", r"\|")
    sure = (F.col("c") >= confident) & (part[0] != "rare")
    out = guessed.select(*df.columns, part[0].alias("predicted_kind"), F.when(part[0].isin("none", "rare"), None).otherwise(part[1].cast("long")).alias("predicted_factor"), F.col("c").alias("confidence"), F.when(sure, "convert").otherwise("review").alias("route"))
    return plainly.filter(F.col("told_by").isNotNull()).unionByName(out)
