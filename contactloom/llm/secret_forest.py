"""Secret scan: candidates from text, false positives removed by a random forest. DataFrame functions only.

A candidate is a run of 16 or more characters that keys are made of, a value of 6 or more characters of
any kind behind a secret's name, or the password of an address. Its features are length, make-up
and character transitions, how much of it is dictionary words, whether it stands in a path or address,
and the words before it. The forest learns from labelled findings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.llm.lexical_search import stored
from contactloom.operators.shared import cut

SECRET_NAME = r"(?i:password|passwd|pwd|secret|token|credentials?|api[_-]?key|access[_-]?key)"
#: What stands behind a secret's name, in quotes or up to white space, without a sentence's last sign.
VALUE = (
    rf"""(?<=["'])(?<={SECRET_NAME}["']?\s{{0,4}}[:=]\s{{0,4}}["'])[^\s"']{{6,}}+|"""
    rf"""(?<=[:=\s])(?<={SECRET_NAME}["']?\s{{0,4}}[:=]\s{{0,4}})[^\s"':=][^\s"']{{4,}}[^\s"'.,;:?)\]}}]"""
)
#: The password of ``scheme://user:password@host``.
IN_ADDRESS = r"(?<=:)(?<=://[^\s/:@]{0,64}:)[^\s/]{3,}(?=@)"
#: A run of characters that keys are made of, unless it is the name before a value.
RUN = rf"""(?<![A-Za-z0-9+/_-])(?![A-Za-z_-]*{SECRET_NAME}["']?\s{{0,4}}[:=]\s{{0,4}}["']?[^\s"'=])[A-Za-z0-9+/_-]{{16,}}+={{0,2}}"""
CANDIDATE = f"{IN_ADDRESS}|{VALUE}|{RUN}"
#: Published key formats.
FORMATS = (
    r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,}|"
    r"xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})$"
)
ASSIGNED = r"""(?i)(?:password|passwd|pwd|secret|token|credentials?|api[_-]?key|access[_-]?key)["']?\s*[:=]\s*["']?$"""
NEAR = {
    "near_password": r"(?i)passw(?:or)?d|pwd",
    "near_secret": r"(?i)secret|credential|private",
    "near_key": r"(?i)key|token|auth|bearer",
    "near_digest": r"(?i)sha\d*|hash|commit|checksum|digest|uuid|md5|etag",
    "near_sample": r"(?i)example|sample|dummy|placeholder|test",
    "assigned": r"""[:=]\s*["']?$""",
    "in_address": r"://[^\s/:@]*:$",
    "in_path": r"(?:[/\\@.]|://\S*)$",
}
PARTS = {
    "digits": r"[0-9]", "upper": r"[A-Z]", "lower": r"[a-z]", "hex": r"[0-9a-f]", "vowels": r"[aeiouAEIOU]",
    "signs": r"[+/_=-]",
    "case_or_digit_changes": r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])",
    "vowel_changes": r"(?i)(?<=[aeiou])(?=[b-df-hj-np-tv-z])|(?<=[b-df-hj-np-tv-z])(?=[aeiou])",
}
FEATURES = ["length", *PARTS, "kinds", "slashes", "extension", "covered", *NEAR]
MASK = "[SECRET]"


@dataclass(frozen=True)
class Scan:
    """``rows`` bounds the labelled findings the forest learns from, half of them for each label; ``words`` the dictionary."""

    rows: int = 20_000
    words: int = 5000
    trees: int = 30
    depth: int = 8
    seed: int = 17
    threshold: float = 0.5
    around: int = 40


def _pieces(text: Column) -> tuple[Column, Column]:
    return F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), F.split(text, CANDIDATE)


def dictionary(docs: DataFrame, how: Scan = Scan()) -> DataFrame:
    """The most frequent lower-case words of 3 to 6 letters, counted over all texts."""
    words = F.regexp_extract_all(F.col("text"), F.lit(r"(?<![\p{L}\p{N}])[a-z]{3,6}(?![\p{L}\p{N}])"), F.lit(0))
    counts = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "word").limit(how.words).select("word")


def candidates(docs: DataFrame, how: Scan = Scan()) -> DataFrame:
    """``doc_id, tag, nth, value, before, after``: every candidate of every text, in order."""
    rows = docs.select("doc_id", F.hash("text").alias("tag"), "text")
    values, between = _pieces(F.col("text"))
    found = rows.withColumn("values", values).filter(F.size("values") > 0).withColumn("between", between)
    one = F.posexplode(F.arrays_zip("values", F.slice("between", 1, F.size("values")).alias("left"), F.slice("between", 2, F.size("values")).alias("right")))
    return found.select("doc_id", "tag", one.alias("nth", "c")).select(
        "doc_id", "tag", "nth", F.col("c.values").alias("value"),
        F.right("c.left", F.lit(how.around)).alias("before"), F.left("c.right", F.lit(how.around)).alias("after"),
    )


def with_features(found: DataFrame, words: DataFrame, how: Scan = Scan()) -> DataFrame:
    """Candidates with their features; the dictionary has at most ``how.words`` rows."""
    value, size = F.col("value"), F.length("value")
    runs = F.regexp_extract_all(value, F.lit("[A-Z]?[a-z]+|[A-Z]+"), F.lit(0))
    row = ["doc_id", "tag", "nth"]
    known = (
        found.select(*row, F.explode(runs).alias("run"))
        .select(*row, F.lower("run").alias("word"))
        .join(F.broadcast(words), "word")
        .groupBy(*row)
        .agg(F.sum(F.length("word")).alias("known"))
    )
    same = F.col("f.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("f.tag") == F.col("k.tag")) & (F.col("f.nth") == F.col("k.nth"))
    out = found.alias("f").join(known.alias("k"), same, "left").select("f.*", (F.coalesce("known", F.lit(0)) / size).alias("covered"))
    share = {name: F.regexp_count(value, F.lit(p)) / size for name, p in PARTS.items()}
    near = {name: F.col("before").rlike(p).cast("double") for name, p in NEAR.items()}
    return out.withColumns(
        share
        | near
        | {
            "length": size.cast("double"),
            "kinds": (F.size(F.array_distinct(F.split(value, ""))) / size),
            "slashes": F.regexp_count(value, F.lit("/")).cast("double"),
            "extension": F.col("after").rlike(r"^\.[a-z]{2,4}\b").cast("double"),
        }
    )


def rule_labels(found: DataFrame) -> DataFrame:
    """``label`` where a rule is sure: 1 for published key formats, passwords in addresses and values with a
    digit that are assigned to a secret's name, 0 for letters alone, digits alone, paths and digests; else null."""
    value, before = F.col("value"), F.col("before")
    yes = value.rlike(FORMATS) | (before.rlike(NEAR["in_address"]) & F.col("after").startswith("@")) | (before.rlike(ASSIGNED) & value.rlike("[0-9]"))
    no = value.rlike(r"^[A-Za-z_-]+$|^[0-9/_+-]+$|^/|/.*/.*[.]") | before.rlike(NEAR["near_digest"]) | before.rlike(r"://\S*$|@$")
    return found.withColumn("label", F.when(yes, 1.0).when(no, 0.0))


def _vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(rows)


def train_forest(labelled: DataFrame, how: Scan = Scan()) -> RandomForestClassificationModel | float:
    """Fits the forest to labelled findings with features. Copies count once; of each label at most half
    of ``how.rows`` are taken in order of a hash, and both labels weigh the same.

    With one label only, or none, there is nothing to learn: the smoothed share of label 1 is returned,
    without any label 1 a constant below the threshold.
    """
    rows = labelled.filter("label IS NOT NULL").select("label", *FEATURES, F.xxhash64("value", "before").alias("_order")).distinct()
    some = [rows.filter(F.col("label") == k).orderBy("_order", *FEATURES).limit(how.rows // 2) for k in (0.0, 1.0)]
    sample = cut(some[0].unionByName(some[1]))
    n, ones = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not ones:
        return min(1 / (n + 2), how.threshold / 2)
    if ones == n:
        return (ones + 1) / (n + 2)
    weight = F.when(F.col("label") == 1, n / (2 * ones)).otherwise(n / (2 * (n - ones)))
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", numTrees=how.trees, maxDepth=how.depth, seed=how.seed
    )
    return forest.fit(_vectors(sample.select("label", weight.alias("weight"), *FEATURES)))


def scored(found: DataFrame, model: RandomForestClassificationModel | float) -> DataFrame:
    if isinstance(model, float):
        return found.withColumn("probability", F.lit(model))
    return model.transform(_vectors(found)).withColumn("probability", vector_to_array(F.col("probability"))[1]).drop("features")


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, how: Scan = Scan()) -> DataFrame:
    """``doc_id, tag, nth, value, probability, is_secret``: one row per candidate.

    ``labelled`` are findings with ``value, before, after, label`` and their ids, as
    :func:`candidates` gives them; without it, rules label the documents' own findings. A null or
    empty text has no candidate. Rows with one id are told apart by ``tag``, a hash of the text;
    rows that are there twice give their findings twice. Other columns are ignored.
    """
    words = cut(dictionary(docs, how))
    # Stored first: the features need candidates twice, and finding them is nearly all of the work.
    found = cut(with_features(stored(candidates(docs, how)), words, how))
    teacher = rule_labels(found) if labelled is None else with_features(labelled, words, how)
    out = scored(found, train_forest(teacher, how))
    return out.select("doc_id", "tag", "nth", "value", "probability", (F.col("probability") >= how.threshold).alias("is_secret"))


def redact_secrets(docs: DataFrame, how: Scan = Scan()) -> DataFrame:
    """``docs`` with every secret replaced by a mask; texts without a secret and other columns stay."""
    secrets = scan_secrets(docs, how=how).filter("is_secret")
    places = secrets.groupBy(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).agg(F.collect_set("nth").alias("_places"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.hash("text") == F.col("_tag"))
    values, between = _pieces(F.col("text"))
    kept = F.transform(values, lambda v, i: F.when(F.array_contains("_places", i), F.lit(MASK)).otherwise(v))
    # One piece more than candidates: the last has none behind it.
    woven = F.zip_with(between, kept, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    masked = F.when(F.col("_places").isNotNull(), F.array_join(woven, "")).otherwise(F.col("text"))
    return docs.join(places, same, "left").withColumn("text", masked).drop("_id", "_tag", "_places")
