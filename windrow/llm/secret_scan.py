"""Secret scans: candidates by pattern, false positives removed by a random forest. DataFrame functions and Spark ML only.

A candidate is a run of 16 or more characters of a key alphabet, a web token of three or more parts, or whatever is
assigned to the name of a secret: up to the closing quote, else to the next blank or the next such name. The same
characters under two forms are one candidate; a value and a run inside it are two. The forest sees its length, how its
characters follow one another, how much of it common words cover, the path of the document, and the words next to it.
Its transitions are the likelihood of each character after the one before it, as in the words of the corpus; its dictionary
is the common words, looked for anywhere (the first ``COMMON_WORDS``) and as whole words (``VOCABULARY``). The name
of a secret before a finding, and that it is assigned, by which the rule below labels secrets, are no features; an "@" beside it,
the path of a test and the share of digits, which the rule looks at too, still are.

It is trained on labelled findings, at most ``MAX_FINDINGS`` of each class. Where a table brings none, findings
that a rule can tell are the labelled ones: key formats and assignments to a secret's name are secrets; bare numbers and
parts of addresses are not. All candidates get a score, labelled or not.

Null texts have no candidates. Findings of rows that repeat come once for each row. Without labelled findings of both
classes nothing is removed: every candidate scores 1. The common words are counted over all texts. Time grows in
proportion to the candidates of a text, but for a power of 4/3 of a short step per candidate.
"""

import math

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.llm.common import text_of
from windrow.storage import materialize

#: Fixed: what a candidate, a known key and the name of a secret look like.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?:eyJ[A-Za-z0-9_-]*(?:\.[A-Za-z0-9_-]*){1,3}\.[A-Za-z0-9_-]+|[A-Za-z0-9+/_-]{16,}={0,2})"
KNOWN_KEY = r"^(AKIA[0-9A-Z]{16}|ghp_[0-9A-Za-z]{36}|xox[abpr]-[0-9A-Za-z-]{10,}|sk_live_[0-9A-Za-z]{16,})$"
SECRET_NAME = r"(?i)(password|passwd|secret|token|api[_-]?key|auth|credential)s?[\"']?\s*[=:]\s*[\"']?$"
_LEAD = r"(?i:password|passwd|secret|token|api[_-]?key|auth|credential)[sS]?[\"']?\s*(?:==+|:=|=>|[=:])\s*"
#: A name and what assigns to it. The value (group 1, 2 or 3) is only looked at, so that names inside it count too.
ASSIGNED = (
    _LEAD
    + r"""(?:"(?=((?:[^"\\\r\n]++|\\[^\r\n])++)")|'(?=((?:[^'\\\r\n]++|\\[^\r\n])++)')"""
    + rf"""|(?:"{{3}}|'{{3}}|["']?+)(?!["'])(?=((?:(?!{_LEAD})\S)++)))"""
)
#: Whole words of a text in lower case, and the words that capitals and marks make inside a finding.
LETTERS = r"(?<![\p{L}\p{N}_])\p{L}{4,12}(?![\p{L}\p{N}_])"
PARTS = r"\p{Lu}?\p{Ll}+|\p{Lu}+"
TEST_PATH = r"(?i)(test|example|sample|mock|fixture)"

BEFORE, AFTER = 48, 24
COMMON_WORDS, VOCABULARY = 200, 2000
MAX_FINDINGS = 10_000
TREES, DEPTH = 24, 6


def _spans(name: str, lead: Column) -> Column:
    """Structs of the matches ``name`` from the columns that ``candidates`` makes; ``lead`` stands before what was found."""

    def span(x: Column) -> Column:
        here, secret = F.concat(x["between"], lead(x)), x["secret"]
        after = F.substring(x["following"], F.length(secret) + 1, F.lit(AFTER)) if name == "value" else F.substring(x["following"], 1, AFTER)
        return F.struct(
            (x["offset"] + F.length(here)).alias("start"),
            secret.alias("secret"),
            F.lit(name).alias("form"),
            F.substring(here, -BEFORE, BEFORE).alias("before"),
            after.alias("after"),
        )

    return F.transform(name, span)


def _lengths(matches: str, between: str) -> Column:
    """Characters of each match with what stands before it, after the match before that."""
    pairs = F.zip_with(F.slice(between, 1, F.size(matches)), matches, lambda b, m: F.length(b) + F.length(m).cast("long"))
    return F.coalesce(pairs, F.array().cast("array<bigint>"))


def _running(values: Column, first: Column) -> Column:
    """``first`` and all running sums from there. Copies as much as the square of the length."""
    return F.aggregate(values, F.array(first), lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x)))


def _offsets(lengths: str) -> Column:
    """Sum of the lengths before each; in blocks of the cube root of their number, so that little is copied.

    ``lengths`` must be a column and no expression, as it is looked at for every block.
    """
    n = F.size(lengths)
    step = F.greatest(F.ceil(F.cbrt(n)).cast("int"), F.lit(1))
    zero = F.lit(0).cast("bigint")
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)), step)
    sums = F.transform(starts, lambda at: F.aggregate(F.slice(lengths, at, step), zero, lambda total, x: total + x))
    blocks = F.arrays_zip(starts.alias("at"), F.slice(_running(sums, zero), 1, F.size(starts)).alias("base"))
    within = F.transform(blocks, lambda b: _running(F.slice(lengths, b["at"], step), b["base"]))
    return F.slice(F.flatten(F.transform(within, lambda sums: F.slice(sums, 1, F.size(sums) - 1))), 1, n)


def _zipped(matches: Column, secrets: Column, between: Column, lengths: str) -> Column:
    """One struct for each match: the match, its secret, what stands before and after it, the characters before that."""
    n = F.size(matches)
    parts = {"match": matches, "secret": secrets, "between": F.slice(between, 1, n), "following": F.slice(between, 2, n), "offset": _offsets(lengths)}
    return F.arrays_zip(*[c.alias(k) for k, c in parts.items()])


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """One row per candidate: doc_id, path, ordinal in the document, start, secret, before, after."""
    rows = docs.select("doc_id", F.col(path).alias("path"), text_of().alias("text"))
    rows = rows.filter(F.col("text").rlike(CANDIDATE) | F.col("text").rlike(ASSIGNED))
    every = lambda pattern, group: F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    # what stands around the matches: one piece more than matches
    matched = rows.select(
        "doc_id",
        "path",
        every(CANDIDATE, 0).alias("runs"),
        F.split("text", CANDIDATE, -1).alias("between_runs"),
        every(ASSIGNED, 0).alias("leads"),
        *[every(ASSIGNED, g).alias(f"value_{g}") for g in (1, 2, 3)],
        F.split("text", ASSIGNED, -1).alias("between_leads"),
    )
    matched = matched.withColumns({"run_lengths": _lengths("runs", "between_runs"), "lead_lengths": _lengths("leads", "between_leads")})
    joined = lambda a, b: F.concat(a, b)
    values = F.zip_with(F.zip_with("value_1", "value_2", joined), F.col("value_3"), joined)
    zipped = matched.select(
        "doc_id",
        "path",
        _zipped(F.col("runs"), F.col("runs"), F.col("between_runs"), "run_lengths").alias("run"),
        _zipped(F.col("leads"), values, F.col("between_leads"), "lead_lengths").alias("value"),
    )
    spans = F.concat(_spans("run", lambda x: F.lit("")), _spans("value", lambda x: x["match"]))
    sorted_ = zipped.select("doc_id", "path", F.array_sort(spans).alias("spans"))

    # a run that is a whole value is one candidate, and the name of the secret stands before it
    def merged(x: Column, i: Column) -> Column:
        same = lambda y: F.coalesce((y["start"] == x["start"]) & (y["secret"] == x["secret"]), F.lit(False))
        previous, following = F.get("spans", i - 1), F.get("spans", i + 1)
        before = F.when(same(following), following["before"]).otherwise(x["before"])
        return F.struct(x["start"], x["secret"], before.alias("before"), x["after"], same(previous).alias("repeats"))

    once = F.filter(F.transform("spans", merged), lambda x: ~x["repeats"])
    each = sorted_.select("doc_id", "path", F.posexplode(once).alias("ordinal", "found"))
    columns = [F.col(f"found.{n}").alias(n) for n in ("start", "secret", "before", "after")]
    return each.select("doc_id", "path", F.col("ordinal").cast("long").alias("ordinal"), *columns)


def vocabulary(docs: DataFrame) -> list[tuple[str, int]]:
    """The most frequent words of 4 to 12 letters in all texts, and their counts."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(LETTERS), F.lit(0))).alias("word"))
    top = words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(VOCABULARY)
    return sorted(((r.word, r["count"]) for r in top.collect()), key=lambda r: (-r[1], r[0]))


def common_words(docs: DataFrame) -> list[str]:
    """The first of them, longest first, for the dictionary."""
    return sorted((w for w, _ in vocabulary(docs)[:COMMON_WORDS]), key=lambda w: (-len(w), w))


def _classes(text: str) -> list[int]:
    return [ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0 for c in text]


def transition_table(words: list[tuple[str, int]]) -> list[float]:
    """Log likelihood of a character of class b after one of class a, at place 28 a + b.

    Classes are the letters a to z, 27 for other letters, and 0 for all else, as before and after a word.
    """
    counts = [[1.0] * 28 for _ in range(28)]
    for word, n in words:
        found = [0, *_classes(word), 0]
        for a, b in zip(found, found[1:]):
            counts[a][b] += n
    return [math.log(n / sum(row)) for row in counts for n in row]


def _share(pattern: str, of: str = "secret") -> Column:
    return F.regexp_count(of, F.lit(pattern)) / F.length(of)


def _transitions(table: list[float]) -> Column:
    """Mean log likelihood of the characters of ``_chars``, each after the one before it."""
    place = lambda c: F.when(c.between("a", "z") & (F.length(c) == 1), F.ascii(c) - 96).when(c.rlike(r"^\p{L}$"), 27).otherwise(0)
    n = F.size("_chars") - 1
    pairs = F.zip_with(F.slice("_chars", 1, n), F.slice("_chars", 2, n), lambda a, b: F.get(F.lit(table), place(a) * 28 + place(b)))
    return F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x) / F.greatest(n, F.lit(1))


def features(found: DataFrame, dictionary: list[str], words: list[tuple[str, int]] | None = None) -> DataFrame:
    """``found`` with the numbers the forest looks at; ``words`` with counts are the dictionary itself if not given."""
    words = words or [(w, 1) for w in dictionary]
    found = found.withColumn("_chars", F.split(F.lower("secret"), ""))
    known_words = F.filter(F.regexp_extract_all("secret", F.lit(PARTS), F.lit(0)), lambda w: F.lower(w).isin([w for w, _ in words]))
    known = "|".join(dictionary) or "$^"
    rest = F.regexp_replace(F.lower("secret"), known, "")
    path = F.coalesce("path", F.lit(""))
    columns = {
        "f_length": F.length("secret").cast("double"),
        "f_digits": _share("[0-9]"),
        "f_upper": _share("[A-Z]"),
        "f_marks": _share("[^A-Za-z0-9]"),
        "f_hex": F.col("secret").rlike("^[0-9a-fA-F]+$").cast("double"),
        "f_letter_digit": _share("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"),
        "f_case_turns": _share("[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
        "f_vowel_turns": _share("(?i)[aeiou](?=[b-df-hj-np-tv-z])|[b-df-hj-np-tv-z](?=[aeiou])"),
        "f_transitions": _transitions(transition_table(words)),
        "f_words": F.aggregate(known_words, F.lit(0), lambda total, w: total + F.length(w)) / F.length("secret"),
        "f_repeats": _share(r"(.)(?=\1)"),
        "f_distinct": F.size(F.array_distinct(F.split("secret", ""))) / F.length("secret"),
        "f_dictionary": 1 - F.length(rest) / F.length("secret"),
        "f_path_length": F.length(path).cast("double"),
        "f_path_test": path.rlike(TEST_PATH).cast("double"),
        "f_path_depth": F.regexp_count(path, F.lit("[/\\\\]")).cast("double"),
        "f_quoted": (F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")).cast("double"),
        "f_at": (F.col("before").rlike("@\\S*$") | F.col("after").rlike("^\\S*@")).cast("double"),
        "f_number_near": (F.col("before").rlike("[0-9]\\W*$") | F.col("after").rlike("^\\W*[0-9]")).cast("double"),
        "f_words_near": F.regexp_count(F.concat("before", "after"), F.lit(known)).cast("double"),
    }
    return found.withColumns(columns).drop("_chars")


def rule_label() -> Column:
    """1 or 0 where a rule can tell, else null."""
    secret = F.col("secret")
    is_secret = secret.rlike(KNOWN_KEY) | (F.col("before").rlike(SECRET_NAME) & ~F.col("path").rlike(TEST_PATH))
    is_none = secret.rlike("^[0-9]+$") | F.col("before").rlike("@\\S*$") | F.col("after").rlike("^\\S*@")
    return F.when(F.coalesce(is_secret, F.lit(False)), 1).when(is_none, 0)


def train_forest(labelled: DataFrame):
    """A fitted forest from findings with features and ``label``, or None without both classes."""
    known = labelled.filter("label IN (0, 1)")
    order = [F.xxhash64("secret", "doc_id", "ordinal"), F.col("secret")]
    parts = [known.filter(F.col("label") == c).orderBy(*order).limit(MAX_FINDINGS) for c in (0, 1)]
    sample = materialize(parts[0].unionByName(parts[1]), "secret-sample")
    if sample.select("label").distinct().count() < 2:
        return None
    names = sorted(c for c in labelled.columns if c.startswith("f_"))
    assemble = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=1, featuresCol="features", labelCol="label")
    return Pipeline(stages=[assemble, forest]).fit(sample)


def secret_findings(docs: DataFrame, path: str = "source") -> DataFrame:
    """All candidates: doc_id, ordinal, start, secret, label (null if no rule tells), score, is_secret.

    Runs jobs when called; its tables are removed by the surrounding ``intermediates`` block.
    """
    found = materialize(candidates(docs, path), "secret-candidates")
    words = vocabulary(docs)
    dictionary = sorted((w for w, _ in words[:COMMON_WORDS]), key=lambda w: (-len(w), w))
    described = features(found, dictionary, words).withColumn("label", rule_label())
    model = train_forest(described)
    if model is None:
        scored = described.withColumn("score", F.lit(1.0))
    else:
        scored = model.transform(described).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "ordinal", "start", "secret", "label", "score", (F.col("score") >= 0.5).alias("is_secret"))
