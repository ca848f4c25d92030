"""Secret scan: candidates by pattern, false positives removed by a random forest.

A candidate is the value after an assignment to a secret's name, of any length and alphabet (in quotes up to the closing one, else up
to white space, a quote or one of , ; < > ( ) { } [ ]), or a run of 16 or more of A-Z a-z 0-9 _ + / - (and closing =) with a digit or with a capital after a small letter in it
(a run of letters in one case is a word and none, unless it is assigned). Each has features from itself and its surroundings: length, changes between character classes, shares of
digits and capitals, distinct characters, the share of its letters that are words of the
corpus dictionary, whether it lies in a path, and what the words beside it say. A random forest (Spark ML)
learns from labelled findings, at most TRAINING of them in hash order, and gives
each finding its probability; findings under THRESHOLD are removed as false positives.

Labelled findings can be passed in (doc_id, place, label). Where there are none they come from evidence rules
over the findings outside the held-out fold: a vendor prefix or an assignment to a secret's name is
label 1 unless the value is a plain word or a placeholder; digits only, a UUID, a checksum's name, a placeholder, a path (two or
more of the parts between its slashes, and half of them, look like words) or a run without digits made of dictionary words is label 0; the rest stays unlabelled
and is left to the forest.

Dictionary: the DICTIONARY most frequent words of 3 to 12 letters of all texts; it is a
fixed-size array. Rows: null and empty texts have no candidates. Whole texts are scanned.
Repeated rows are scanned each; a row without doc_id is in no fold. Extra columns are ignored. Without
findings of both labels every finding gets the share of label 1 (1 without any label) as its probability.
"""

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from .common import LOWER, UPPER, fold, stored

_NAME = r"(?:pass(?:words?|wd|phrase)?(?![a-z])|secret|token|api[_\-]?key|auth(?!or)|credential)"
NAMES = rf"(?i){_NAME}"
# what stands before an assigned value; the cheap test comes first
_AFTER = (r"(?<=[=:>][ \t]{0,4}[\"'`]?)"
          rf"(?<=(?i:{_NAME})[A-Za-z0-9_\-]{{0,24}}[\"'`]?\]?[ \t]{{0,4}}(?::=|=>|={{1,3}}|:)[ \t]{{0,4}}[\"'`]?)")
_VALUE = "(?:" + "|".join([*(rf"(?<={q})[^{q}\r\n]+(?={q})" for q in "\"'`"),
                           r"(?<![\"'`])[^\s\"'`,;<>(){}\[\]=:][^\s\"'`,;<>(){}\[\]]*"]) + ")"
RUN = (r"(?<![A-Za-z0-9_+/\-])(?=[A-Za-z_+/\-]*(?:[0-9]|[a-z][A-Za-z_+/\-]*[A-Z]))"
       r"[A-Za-z0-9_+/\-]{16,}={0,2}")
CANDIDATE = rf"(?<=[=:>\s\"'`]){_AFTER}{_VALUE}|{RUN}"
PLACEHOLDER = r"(?i)^(null|none|nil|true|false|undefined|your[_\- ].*|x+|\*+|\$.*|<.*|%.*|os\.environ.*|process\.env.*)$"
PLAIN = r"^\p{L}?\p{Ll}*[.!?]?$"
PART = r"^\.?(?:[A-Z]?[a-z]{2,}|[A-Z]{2,})(?:[._\-][A-Za-z]+)*$"  # a word or directory between slashes
PREFIX = r"^(AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|xox[abps]-|sk_live_|sk-|AIza)"
OTHER = r"(?i)(sha(1|256|512)?|md5|checksum|commit|uuid|build|version|isbn|id)"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
DICTIONARY, TRAINING, TREES, DEPTH, THRESHOLD = 4096, 50_000, 24, 6, 0.5
REACH = 60  # characters beside a candidate in which its neighbours are looked for
FEATURES = ["length", "changes", "digits", "capitals", "distinct", "covered", "in_path", "assigned", "quoted",
            "named_secret", "named_other", "prefixed", "hexadecimal"]


def dictionary(docs, most=DICTIONARY):
    """The most frequent words of the texts, as one sorted array in one row."""
    word = F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(r"\b[a-z]{3,12}\b"), F.lit(0)))
    top = (docs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
           .orderBy(F.desc("n"), "word").limit(most))
    return top.agg(F.sort_array(F.collect_list("word")).alias("words"))


def findings(docs):
    """Candidates of every text with their features: doc_id, place (number within the text), candidate, before, after."""
    pieces, found = F.split("text", CANDIDATE), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))
    each = F.transform(found, lambda c, k: F.struct(
        (k + 1).alias("place"), c.alias("candidate"),
        F.right(F.get(F.col("pieces"), k), F.lit(REACH)).alias("before"),
        F.left(F.get(F.col("pieces"), k + 1), F.lit(REACH)).alias("after")))
    rows = (docs.where(F.col("text").rlike(CANDIDATE)).select("doc_id", "text", pieces.alias("pieces"))
            .select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.*"))
    c, n = F.col("candidate"), F.length("candidate")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]+", "0"), "[a-z]+", "a"), "[A-Z]+", "B")
    share = lambda chars: F.length(F.regexp_replace(c, f"[^{chars}]", "")) / n
    left = F.regexp_extract("before", r"([^\s=:>\"'`]+)[\s=:>\"'`\]]*$", 1)
    flag = lambda x: x.cast("double")
    return rows.select(
        "doc_id", "place", "candidate", "before", "after",
        n.cast("double").alias("length"), (F.length(kinds) / n).alias("changes"), share("0-9").alias("digits"),
        share("A-Z").alias("capitals"), (F.size(F.array_distinct(F.split(c, ""))) / n).alias("distinct"),
        flag(c.contains("/") | F.col("before").rlike(r"[/.\\]$")).alias("in_path"),
        flag(F.col("before").rlike(r"[=:]>?\s*[\"'`]?$")).alias("assigned"),
        flag(F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")).alias("quoted"),
        flag(left.rlike(NAMES)).alias("named_secret"), flag(left.rlike(f"^{OTHER}$")).alias("named_other"),
        flag(c.rlike(PREFIX)).alias("prefixed"), flag(c.rlike("^[0-9a-fA-F]+$")).alias("hexadecimal"))


def covered(rows, words):
    """Adds the share of a candidate that is made of dictionary words."""
    parts = F.regexp_extract_all(F.translate("candidate", UPPER, LOWER), F.lit("[a-z]{3,}"), F.lit(0))
    size = F.aggregate(F.filter(parts, lambda w: F.array_contains(F.array(*map(F.lit, words)), w)) if words
                       else F.array().cast("array<string>"), F.lit(0), lambda s, w: s + F.length(w))
    return rows.withColumn("covered", size / F.length("candidate"))


def evidence(rows):
    """Label of the evidence rules, null where they say nothing."""
    c = F.col("candidate")
    idle = c.rlike(PLACEHOLDER)
    named = (F.col("named_secret") == 1) & (F.col("assigned") == 1) & ~idle
    secret = (F.col("prefixed") == 1) | (named & ((F.col("quoted") == 1) | ~c.rlike(PLAIN)))
    parts = F.filter(F.split(F.concat(F.regexp_extract("before", r"([A-Za-z0-9._/\-]*/)$", 1), c), "/"), lambda p: p != "")
    words = F.size(F.filter(parts, lambda p: p.rlike(PART)))
    path = (words >= 2) & (2 * words >= F.size(parts))
    prose = ~c.rlike("[0-9]") & (F.col("covered") >= 0.6)
    other = idle | c.rlike(r"^[0-9]+$") | c.rlike(UUID) | (F.col("named_other") == 1) | path | prose
    return F.when(secret, F.lit(1)).when(other, F.lit(0))


def scan(docs, labelled=None, threshold=THRESHOLD):
    """doc_id, place, candidate, held_out, label, probability and secret of every candidate of every row."""
    docs = docs.select("doc_id", "text")
    words = dictionary(docs).first()["words"]
    rows = covered(findings(docs), words)
    if labelled is None:
        rows = rows.withColumn("label", evidence(rows))
    else:
        rows = rows.join(labelled.select("doc_id", "place", F.col("label").cast("int").alias("label")),
                         ["doc_id", "place"], "left")
    rows = stored(rows.withColumn("held_out", fold("doc_id", 5) == 2), "secret-findings")
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features")
    mark = F.xxhash64("doc_id", "place", "candidate")
    training = rows.where("label IS NOT NULL AND NOT held_out").orderBy(mark, "doc_id", "place").limit(TRAINING)
    training = stored(training, "secret-training")
    seen = {r["label"]: r["n"] for r in training.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(seen) < 2:
        scored = rows.withColumn("probability", F.lit(float(seen.get(1, 0) > 0 or not seen)))
    else:
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=17, featureSubsetStrategy="onethird")
        model = forest.fit(vectors.transform(training).select(F.col("label").cast("double").alias("label"), "features"))
        scored = model.transform(vectors.transform(rows)).withColumn(
            "score_of_forest", vector_to_array("probability")).withColumn("probability", F.col("score_of_forest")[1])
    return scored.select("doc_id", "place", "candidate", "held_out", "label", "probability",
                         (F.col("probability") >= threshold).alias("secret"))
