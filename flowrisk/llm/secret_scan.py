"""Operator 6: secret scans whose false positives a random forest removes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowrisk.llm.common import WORD
from flowrisk.session import materialize

# Two forms: the value assigned to a secret-like name, of four characters or more, and any long run of key characters.
# A look-behind has a fixed width, hence one for every width of a name and way to assign: up to four blanks on either side.
NAMES = ("pwd", "pass|auth", "token", "passwd|secret|apikey|bearer", "api[_-]key", "password|passcode", "accesskey|secretkey",
         "passphrase|privatekey|credential|access[_-]key|secret[_-]key", "credentials|private[_-]key")
ENDS = ("", r"[\"']", *(r"[\x20\t]" * n for n in range(1, 5)))
STARTS = [r"[\x20\t]" * n + quote for n in range(5) for quote in ("", r"[\"']")]
AFTER_NAME = r"(?<=[:=\x20\t\"'])(?![:=\x20\t\"'])(?:" + "|".join(
    rf"(?<=[:=]{start})(?:" + "|".join(rf"(?<=(?i:{name}){end}[:=]{start})" for end in ENDS for name in NAMES) + ")" for start in STARTS) + ")"
VALUE = r"[^\x00-\x20\x7F\"';]{3,}[^\x00-\x20\x7F\"';,.)\]}>]"
UNJOINED = r"(?<![A-Za-z0-9+/_-])"
RUN = r"[A-Za-z0-9+/_-]{14,}={0,2}"
CANDIDATE = f"(?:{AFTER_NAME}{VALUE}|{UNJOINED}{RUN})"
# Texts without it have candidates of the second form only, which are found faster.
ASSIGNMENT = rf"[:=](?<=(?i:{'|'.join(NAMES)})[\"']?[\x20\t]{{0,4}}[:=])"
BEFORE, AFTER = 32, 8          # characters of context
BLOCK = 256
SAMPLE_TEXTS = 6_000
DICTIONARY_WORDS = 150
TREES, DEPTH, CUT = 15, 6, 0.5
MASK = "[SECRET]"

ISSUER = r"^(AKIA|ASIA|AIza|ghp_|gho_|github_pat_|sk_live_|sk-|xox[abp]-|eyJ)"
KEYWORD = r"(?i)(passw(or)?d|pwd|secret|token|api[_-]?key|access[_-]?key|credentials?|bearer|auth)[\"']?\s*[:=]?\s*[\"']?$"
ASSIGNED = r"[:=]\s*[\"']?$"
DIGEST = r"(?i)(commit|sha-?\d*|md5|checksum|digest|hash|uuid|guid|revision|etag)[\"']?\s*[:=]?\s*[\"']?$"
SAMPLE_PATH = r"(?i)(test|example|sample|fixture|mock|docs?/)"


def found(text: Column) -> Column:
    each = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(ASSIGNMENT), each(CANDIDATE)).otherwise(each(UNJOINED + RUN))


def pieces_of(text: Column) -> Column:
    """The text around the candidates."""
    return F.when(text.rlike(ASSIGNMENT), F.split(text, CANDIDATE, -1)).otherwise(F.split(text, UNJOINED + RUN, -1))


def candidates(text: Column) -> Column:
    """Candidates of a text in order: value, start (characters before it), and the text before and after, other candidates included."""
    def each(pieces: Column) -> Column:
        def one(values: Column) -> Column:
            return F.transform(F.array(_ends(values, pieces)), lambda ends: F.transform(values, lambda value, i: F.struct(
                value.alias("value"), (F.get(ends, i) + F.char_length(F.get(pieces, i))).alias("start"), _before(values, pieces, i).alias("before"),
                _after(values, pieces, i).alias("after"))))[0]
        return F.transform(F.array(found(text)), one)[0]
    return F.transform(F.array(pieces_of(text)), each)[0]


def _ends(values: Column, pieces: Column) -> Column:
    """Characters up to the end of the candidate before each one.

    A running sum in blocks of BLOCK: an array that grows by one is copied each time, so none grows longer than a block, or than there are blocks.
    """
    none = F.expr("cast(array() as array<int>)")

    def running(steps: Column, start: Column) -> Column:
        return F.aggregate(steps, F.struct(start.alias("at"), none.alias("seen")), lambda acc, n: F.struct(
            (acc["at"] + n).alias("at"), F.concat(acc["seen"], F.array(acc["at"])).alias("seen")))["seen"]

    def of(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda acc, n: acc + n))
        return F.transform(F.array(running(sums, F.lit(0))), lambda starts: F.flatten(F.transform(blocks, lambda block, b: running(block, F.get(starts, b)))))[0]

    def cut(steps: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")), lambda b: F.slice(steps, b * BLOCK + 1, BLOCK))
        return F.transform(F.array(blocks), of)[0]

    lengths = F.transform(values, lambda value, i: F.char_length(F.get(pieces, i)) + F.char_length(value))
    return F.when(F.size(values) > 0, F.transform(F.array(lengths), cut)[0]).otherwise(none)


def _before(values: Column, pieces: Column, i: Column) -> Column:
    """A value has four characters or more, so some few fill BEFORE, if the text between does not."""
    piece = F.get(pieces, i)
    parts = [x for k in range(-(-BEFORE // 4), 0, -1) for x in (F.get(pieces, i - k), F.get(values, i - k))]
    near = F.concat_ws("", *(F.right(x, F.lit(BEFORE)) for x in parts), F.right(piece, F.lit(BEFORE)))
    return F.right(F.when(F.char_length(piece) >= BEFORE, piece).otherwise(near), F.lit(BEFORE))


def _after(values: Column, pieces: Column, i: Column) -> Column:
    """A value has four characters or more, so two of them fill AFTER."""
    next_ = (F.left(F.get(x, i + k), F.lit(AFTER)) for k in (1, 2) for x in (pieces, values))
    return F.left(F.concat_ws("", *next_), F.lit(AFTER))


def share(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)) / F.char_length(value)


def feature_columns(c: Column, path: Column, dictionary: list[str]) -> dict[str, Column]:
    """Length, character make-up and transitions, dictionary coverage, path and neighbouring words of a candidate."""
    value, flag = c["value"], lambda x: F.coalesce(x, F.lit(False)).cast("double")
    n, lower = F.char_length(value), F.lower(value)
    known = "|".join(sorted(dictionary, key=lambda w: (-len(w), w)))
    coverage = (n - F.char_length(F.regexp_replace(lower, known, ""))) / n if known else F.lit(0.0)
    return {
        "length": n.cast("double"),
        "digits": share(value, "[0-9]"),
        "upper": share(value, "[A-Z]"),
        "lower": share(value, "[a-z]"),
        "letter_digit": share(value, "(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"),
        "case_change": share(value, "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        "consonants": share(lower, "[bcdfghjklmnpqrstvwxz]{4}"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / n,
        "hex": flag(value.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "coverage": coverage.cast("double"),
        "slashes": share(value, "/"),
        "dashes": share(value, "[-_]"),
        "issuer": flag(value.rlike(ISSUER)),
        "keyword": flag(c["before"].rlike(KEYWORD)),
        "assigned": flag(c["before"].rlike(ASSIGNED)),
        "digest": flag(c["before"].rlike(DIGEST)),
        "quoted": flag(c["after"].rlike("^[\"']")),
        "sample_path": flag(path.rlike(SAMPLE_PATH)),
    }


def weak_label(c: Column) -> Column:
    """Label of a finding where its form leaves no doubt, else null (not learned from)."""
    value = c["value"]
    random = value.rlike("[0-9].*[0-9].*[0-9]") & value.rlike("[A-Za-z]")
    issued = value.rlike("^(AKIA|ASIA)[0-9A-Z]{16}$") | (value.rlike(ISSUER) & (F.char_length(value) >= 24) & random)
    # Of the short form: letters with digits or other marks than those of words.
    mixed = value.rlike("[A-Za-z]") & value.rlike("[0-9!@#$%^&*+~?]") & ~value.rlike("[(){}<>]|://")
    return (F.when(issued, 1.0).when(c["before"].rlike(DIGEST), 0.0).when(c["before"].rlike(KEYWORD) & c["before"].rlike(ASSIGNED) & (random | mixed), 1.0)
            .when(~value.rlike("[0-9]") | ~value.rlike("[A-Za-z]"), 0.0))


def seed_findings(spark) -> DataFrame:
    """Labelled findings of each kind, so that a corpus without secrets, or without look-alikes, teaches both."""
    base = spark.range(40).select(F.sha1(F.col("id").cast("string").cast("binary")).alias("h"), "id")
    h, up = F.col("h"), F.upper(F.translate("h", "0123456789abcdef", "QK2ZTR7MWXV4LPJ9"))
    mixed = F.base64(F.unhex("h"))
    kinds = [(F.concat(F.lit("AKIA"), F.left(up, F.lit(16))), "with key ", " in", 1.0), (h, "token = \"", "\"", 1.0), (F.left(h, F.lit(18)), "password=", " ", 1.0),
             (F.concat(F.translate(F.left(h, F.lit(5)), "0123456789", "ghijkmnpqr"), F.lit("-"), F.right(up, F.lit(4))), "password=", " ", 1.0),
             (F.concat(F.initcap(F.translate(F.left(h, F.lit(6)), "3456789", "rstuvwx")), F.lit("&"), F.right(h, F.lit(1))), "pwd: ", "\n", 1.0),
             (F.translate(F.left(h, F.lit(7)), "0123456789", "ghijkmnpqr"), "password: ", " ", 0.0), (F.lit("required"), "token: ", ",", 0.0), (F.lit("None"), "secret=", ")", 0.0),
             (mixed, "api_key: '", "'", 1.0), (F.concat(F.lit("ghp_"), F.translate(mixed, "+/=", "abc")), "export ", "\n", 1.0),
             (h, "fixed in commit ", " and", 0.0), (F.left(h, F.lit(32)), "md5: ", "\n", 0.0), (F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12}).*$", "$1-$2-$3-$4-$5"), "uuid=", " ", 0.0),
             (F.translate("h", "abcdef", "123456"), "order ", ", ", 0.0), (F.concat(F.lit("usr/local/lib/node"), F.left(h, F.lit(2)), F.lit("/share")), "see /", " for", 0.0),
             (F.concat(F.lit("internationalisation-"), F.lit("of-the-things")), "the ", " was", 0.0)]
    each = [F.struct(F.struct(v.alias("value"), F.lit(0).alias("start"), F.lit(b).alias("before"), F.lit(a).alias("after")).alias("c"), F.lit(y).alias("label")) for v, b, a, y in kinds]
    return base.select(F.explode(F.array(*each)).alias("k")).select("k.c", F.lit(None).cast("string").alias("path"), "k.label")


@dataclass
class Forest:
    """Trees as nested tuples: (feature, threshold, left, right), or the probability of a secret."""

    names: list[str]
    trees: list
    dictionary: list[str]

    def probability(self, features: Column) -> Column:
        def column(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            at, threshold, left, right = node
            return F.when(features[self.names[at]] <= threshold, column(left)).otherwise(column(right))
        return sum((column(t) for t in self.trees), F.lit(0.0)) / len(self.trees)


def _tree(node):
    if node.getClass().getSimpleName() == "LeafNode":
        stats = list(node.impurityStats().stats())
        return float(stats[1] / sum(stats)) if len(stats) > 1 else 0.0
    split = node.split()
    return split.featureIndex(), float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild())


def train(findings: DataFrame, dictionary: list[str], trees: int = TREES, depth: int = DEPTH) -> Forest:
    """A forest from labelled findings (c, path, label). Both labels have to occur."""
    columns = feature_columns(F.col("c"), F.col("path"), dictionary)
    rows = findings.where("label is not null").select("label", *(x.alias(n) for n, x in columns.items()))
    rows = VectorAssembler(inputCols=list(columns), outputCol="features").transform(rows).select("label", "features")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=6, featureSubsetStrategy="6").fit(rows)
    return Forest(list(columns), [_tree(t._call_java("rootNode")) for t in model.trees], dictionary)


def fit(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> Forest:
    """A forest from about ``sample_texts`` texts, drawn by a hash, whose findings label themselves, and the seed findings.

    The dictionary is the sample's most frequent words of two to eight letters.
    """
    total = docs.count()
    chance = min(1.0, sample_texts / max(total, 1))
    draw = F.shiftrightunsigned(F.xxhash64(id_col, text_col), 11) / float(1 << 53)
    some = docs.where(draw < chance).select(F.col(text_col).alias("text"), F.col(path_col).cast("string").alias("path"))
    some = materialize(some, "secret-sample")
    words = some.select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("w")).where(F.col("w").rlike("^[a-z]{2,8}$"))
    common = [r["w"] for r in words.groupBy("w").count().orderBy(F.col("count").desc(), "w").limit(DICTIONARY_WORDS).collect()]
    found = some.select(F.explode(candidates(F.col("text"))).alias("c"), "path").withColumn("label", weak_label(F.col("c")))
    return train(found.unionByName(seed_findings(docs.sparkSession)), common)


def scan(docs: DataFrame, forest: Forest, text_col: str = "text", path_col: str = "source", cut: float = CUT) -> DataFrame:
    """Add __findings: the candidates of every whole text with their probability, those below ``cut`` included.

    A map over rows: the forest is an expression, and nothing is shuffled, joined or broadcast.
    """
    step = docs.withColumn("__candidates", F.coalesce(candidates(F.col(text_col)), F.expr(
        "cast(array() as array<struct<value:string,start:int,before:string,after:string>>)")))
    path = F.col(path_col).cast("string")
    step = step.withColumn("__features", F.transform("__candidates", lambda c: F.struct(
        *(x.alias(n) for n, x in feature_columns(c, path, forest.dictionary).items()))))
    step = step.withColumn("__p", F.transform("__features", forest.probability))
    return step.withColumn("__findings", F.zip_with("__candidates", "__p", lambda c, p: F.struct(
        c["value"].alias("value"), c["start"].alias("start"), p.alias("p"), (p >= cut).alias("secret")))).drop("__candidates", "__features", "__p")


def redacted(text: Column, findings: Column) -> Column:
    """The text with MASK in place of each secret; all else as it was."""
    def rebuilt(pieces: Column) -> Column:
        return F.array_join(F.transform(pieces, lambda piece, i: F.concat(piece, F.coalesce(
            F.when(F.get(findings, i)["secret"], F.lit(MASK)).otherwise(F.get(findings, i)["value"]), F.lit("")))), "")
    return F.when(F.exists(findings, lambda f: f["secret"]), F.transform(F.array(pieces_of(text)), rebuilt)[0]).otherwise(text)


def redact(docs: DataFrame, forest: Forest, text_col: str = "text", path_col: str = "source") -> DataFrame:
    """``docs`` with every secret of the text masked. No row is dropped; null texts stay null."""
    return scan(docs, forest, text_col, path_col).withColumn(text_col, redacted(F.col(text_col), F.col("__findings"))).drop("__findings")


def secrets(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """Secrets of every document: one row per input row.

    Columns: id, n_candidates, n_secrets, spans (``start:length`` of each secret in characters, comma-separated),
    redacted_crc32 (of the masked text as UTF-8; null for a null text). Null and empty texts have none.
    Repeated rows give repeated results; other columns are ignored.
    """
    forest = fit(docs, sample_texts, id_col, text_col, path_col)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.col(path_col).alias("__path"))
    out = scan(rows, forest, "__text", "__path").withColumn("__secrets", F.filter("__findings", lambda f: f["secret"]))
    spans = F.array_join(F.transform("__secrets", lambda f: F.concat_ws(":", f["start"], F.char_length(f["value"]))), ",")
    return out.select(F.col("__id").alias(id_col), F.size("__findings").cast("long").alias("n_candidates"), F.size("__secrets").cast("long").alias("n_secrets"),
                      spans.alias("spans"), F.crc32(F.encode(redacted(F.col("__text"), F.col("__findings")), "UTF-8")).alias("redacted_crc32"))
