"""Secret scan: candidate strings and a random forest that tells secrets from false positives, all in DataFrame operations."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.llm.common import stored, words

#: What a candidate may look like, and words that speak for or against a secret beside it.
NAMES = "token|secret|passw|pwd|api.?key|access.?key|auth|credential|private|bearer"
NAMED = f"(?i)({NAMES})"
#: A run of key characters, which padding may end.
RUN = "[A-Za-z0-9_+/~.-]{16,}={0,2}"
#: A value in quotes up to the closing one, or without quotes up to a mark that ends it.
VALUE = r"""(?:\\?["'`])?((?<=["'`])[^"'`\\\s]+|[^\s"'`\\,;&(){}\[\]<>]+)"""
#: A whole name that holds a name for a secret. Matches begin only where a name does and never go back, so that long names cost one pass.
NAME = r"((?<![\w.-])(?=[\w.-]*?(?:" + NAMES + r"))[\w.-]++(?:(?<=api|access)[^\w\s.-](?=key)[\w.-]++)?+)"
#: What closes a name and assigns it.
ASSIGNS = r"""\\?["'`]?\]?{blanks}(?:=>|:=|==|=|:(?!//))"""
#: Inside a word: a name for a secret, its value; ://user:password@ of an address.
PAIR = "(?i)" + NAME + ASSIGNS.replace("{blanks}", "") + VALUE
URL = r"://[^\s/:@]*+:([^\s/]+)@"
#: Stands for the blanks inside a quoted value; no character of any text.
JOINT = "\ufdd0"
#: A word that the words before it assign.
WHOLE = r"^[(\[{<]*" + VALUE
PEM = "-----BEGIN$"
DUMMY = "(?i)(example|sample|dummy|test|placeholder|changeme|xxxx|your|fake)"
DOCS_PATH = "(?i)(test|example|sample|fixture|mock|doc|readme)"


def joined_phrases(text: Column) -> Column:
    """``text`` with ``JOINT`` for each blank inside a quoted value that a line assigns to a name for a secret and closes, which makes the value one word."""
    out = text
    for quote in "\"'`":
        opens = f"{NAME}{ASSIGNS.replace('{blanks}', '[ 	]*+')}[ \t]*+\\\\?{quote}(?=[^{quote}\n]*+{quote})"
        out = F.regexp_replace(out, f"(?i)((?:{opens}|\\G(?!^))[^{quote}\\s]*+)[ \t]", "$1" + JOINT)
    return F.when(text.rlike(NAMED + "[^\\n]*[\"'`]"), out).otherwise(text)


FEATURES = [
    "f_length", "f_digits", "f_upper", "f_hex", "f_distinct", "f_transitions", "f_vowel_pairs", "f_dictionary",
    "f_path", "f_named", "f_dummy", "f_assigned", "f_quoted", "f_dotted", "f_marks",
]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """One row for each candidate: doc_id, word_at (its place among the words, a quoted phrase with a name being one), candidate, its name in the same word, whether it is assigned and quoted, the two words before, the one after, path.

    Candidates are: values of any length, quoted ones to their closing quote, that the same word or the words before assign to a name for a secret; passwords in addresses; what follows
    ``Bearer`` (8 characters or more); private key blocks from the last line that begins one to the next that ends one, whose words are no candidates of their own; and, apart from these, runs of 16 or more key characters.
    Null and empty texts have none; repeated rows and candidates each count. Words that cannot hold candidates never leave the scan.
    """
    path = F.col(f"`{path_col}`").cast("string") if path_col and path_col in docs.columns else F.lit(None).cast("string")
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), words(joined_phrases(F.col(f"`{text_col}`"))).alias("w"), path.alias("path"))
    near = lambda i, k: F.coalesce(F.get("w", i + k), F.lit(""))
    one = lambda value, name, assigned, quoted: F.struct(value.alias("candidate"), name.alias("name"), assigned.alias("assigned"), quoted.alias("quoted"))
    no, yes, empty = F.lit(False), F.lit(True), F.lit("")
    cut = lambda v: F.regexp_replace(v, "[.,:;?]+$", "")

    def inside(x: Column, i: Column) -> Column:
        """The candidates of a word that is not part of a key block."""
        after_name = (near(i, -1).rlike("[=:]>?$") & (near(i, -1).rlike(NAMED) | (near(i, -1).rlike("^[=:]+>?$") & near(i, -2).rlike(NAMED))))
        bearer = near(i, -1).rlike("(?i)bearer$") & (F.length(x) >= 8)
        urls = F.transform(F.regexp_extract_all(x, F.lit(URL), 1), lambda v: one(v, F.lit("password"), yes, no))
        rest = F.regexp_replace(x, URL, " ")
        pairs = F.transform(F.arrays_zip(F.regexp_extract_all(rest, F.lit(PAIR), 1).alias("n"), F.regexp_extract_all(rest, F.lit(PAIR), 2).alias("v")),
                            lambda p: one(cut(p["v"]), p["n"], yes, rest.rlike("[=:]>?\\\\?[\"'`]")))
        rest = F.regexp_replace(rest, PAIR, " ")
        quoted = x.rlike("^[(\\[{<]*[\"'`]")
        whole = F.array(one(F.when(quoted, F.regexp_extract(x, WHOLE, 1)).otherwise(cut(F.regexp_extract(x, WHOLE, 1))), empty, yes, quoted))
        runs = F.transform(F.regexp_extract_all(rest, F.lit(RUN), 0), lambda v: one(F.regexp_replace(v, "[.]+$", ""), empty, no, quoted))
        runs = F.filter(runs, lambda c: F.length(c["candidate"]) >= 16)
        named = F.filter(F.concat(urls, pairs), lambda c: c["candidate"] != "")
        return (F.when((after_name | bearer) & (F.size(named) == 0), F.filter(whole, lambda c: c["candidate"] != ""))
                .when((F.length(x) >= 16) | x.rlike("[=:]"), F.concat(named, runs)))

    begins = lambda x, i: x.rlike(PEM) & F.exists(F.slice("w", i + 2, 5), lambda y: y.rlike("KEY-----"))
    edge = lambda x, i: F.when(begins(x, i), F.struct(i.alias("i"), yes.alias("begins"))).when(x.contains("-----END"), F.struct(i.alias("i"), no.alias("begins")))
    base = base.withColumn("edges", F.array_compact(F.transform("w", edge)))
    pair = lambda e, k: F.when(e["begins"] & ~F.get("edges", k + 1)["begins"], F.struct(e["i"].alias("a"), F.get("edges", k + 1)["i"].alias("z")))
    base = base.withColumn("blocks", F.array_compact(F.transform("edges", pair)))
    may = lambda x, i: (F.length(x) >= 16) | x.rlike("[=:]") | near(i, -1).rlike("(?i)[=:]>?$|bearer$")
    in_blocks = F.flatten(F.transform("blocks", lambda p: F.sequence(p["a"], p["z"])))
    places = F.array_except(F.array_compact(F.transform("w", lambda x, i: F.when(may(x, i), i))), in_blocks)
    keys = F.transform("blocks", lambda p: F.struct(
        p["a"].alias("i"), F.array(one(F.array_join(F.slice("w", p["a"] + 1, p["z"] - p["a"] + 1), "\n"), F.lit("private key"), yes, no)).alias("c")))
    found = F.concat(F.transform(places, lambda i: F.struct(i.alias("i"), inside(F.get("w", i), i).alias("c"))), keys)
    found = F.filter(found, lambda f: F.size(f["c"]) > 0)
    found = F.transform(found, lambda f: F.struct(
        f["i"].cast("long").alias("word_at"), f["c"].alias("c"), F.get("w", f["i"]).alias("raw"),
        near(f["i"], -1).alias("before"), near(f["i"], -2).alias("before2"), near(f["i"], 1).alias("after")))
    rows = base.select("doc_id", "path", F.explode(found).alias("f")).select("doc_id", "path", "f.*")
    rows = rows.withColumn("c", F.explode("c")).select("doc_id", "path", "word_at", "raw", "before", "before2", "after", "c.*")
    return rows.withColumns({c: F.translate(c, JOINT, " ") for c in ("raw", "before", "before2", "after", "candidate")})


def dictionary(docs: DataFrame, size: int = 3000, text_col: str = "text") -> list[str]:
    """The three-letter runs of the ``size`` words that most often occur in all of ``docs`` (words of 4 to 12 letters); at most 10 ``size`` strings."""
    word = docs.select(F.explode(words(F.lower(F.col(f"`{text_col}`")))).alias("w")).filter(F.col("w").rlike("^\\p{L}{4,12}$"))
    top = word.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(size)
    runs = top.select(F.explode(_runs(F.col("w"))).alias("run")).distinct()
    return sorted(r["run"] for r in runs.collect())


def _runs(text: Column) -> Column:
    return F.when(F.length(text) >= 3, F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3))))


def with_features(found: DataFrame, known_runs: list[str]) -> DataFrame:
    """``found`` with one column for each of ``FEATURES``."""
    x = F.col("candidate")
    n = F.length(x)
    share = lambda pattern: F.regexp_count(x, F.lit(pattern)) / n
    for name, value in (("name", F.lit("")), ("assigned", F.lit(False)), ("quoted", F.col("raw").rlike("^[\"'`]"))):
        if name not in found.columns:  # findings from elsewhere
            found = found.withColumn(name, value)
    near = F.concat_ws(" ", "before2", "before", "name")
    runs = _runs(F.lower(x))
    known = F.array_distinct(F.filter(runs, lambda r: r.isin(known_runs)))
    columns = {
        "f_length": n.cast("double"),
        "f_digits": share("[0-9]"),
        "f_upper": share("[A-Z]"),
        "f_hex": share("[0-9a-f]"),
        "f_distinct": F.size(F.array_distinct(F.split(x, ""))) / n,
        "f_transitions": share("(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])"),
        "f_vowel_pairs": share("(?i)(?<=[b-df-hj-np-tv-z])(?=[aeiou])"),
        "f_dictionary": F.size(known) / F.greatest(F.size(F.array_distinct(runs)), F.lit(1)),
        "f_path": F.coalesce(F.col("path"), F.lit("")).rlike(DOCS_PATH).cast("double"),
        "f_named": near.rlike(NAMED).cast("double"),
        "f_dummy": (near.rlike(DUMMY) | F.col("after").rlike(DUMMY) | x.rlike(DUMMY)).cast("double"),
        "f_assigned": (F.col("assigned") | F.col("before").rlike("[=:]$")).cast("double"),
        "f_quoted": F.col("quoted").cast("double"),
        "f_dotted": F.col("candidate").contains(".").cast("double"),
        "f_marks": share("[^A-Za-z0-9_+/=~.\\s-]"),
    }
    return found.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in columns.items()})


def _assembled(found: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="f_all").transform(found)


def train(findings: DataFrame, trees: int = 20, depth: int = 6, seed: int = 11) -> RandomForestClassificationModel | None:
    """A forest from labelled findings (``FEATURES`` and ``label`` 0 or 1); None if they lack one of the classes."""
    seen = {r["label"] for r in findings.select("label").distinct().limit(3).collect()}
    if not {0, 1} <= seen:
        return None
    forest = RandomForestClassifier(featuresCol="f_all", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)
    return forest.fit(_assembled(findings.withColumn("label", F.col("label").cast("double"))))


def labelled(found: DataFrame, sample_rows: int) -> DataFrame:
    """Labelled findings for tables without any: at most ``sample_rows`` candidates, half of each label, chosen by hash.

    A secret is a candidate of hexadecimal, mixed letters and digits, or with other marks that is assigned to a name for a secret, with nothing that speaks of a
    dummy; a false positive is one of letters only, or a number, or one without such a name before it.
    """
    random = (((F.col("f_digits") > 0.1) & (F.col("f_digits") < 0.95) & (F.col("f_dotted") == 0)) | (F.col("f_marks") > 0) | F.col("candidate").startswith("-----BEGIN"))
    secret = random & (F.col("f_named") > 0) & (F.col("f_assigned") > 0) & (F.col("f_dummy") == 0)
    marked = found.withColumn("label", secret.cast("int")).withColumn("h", F.xxhash64("doc_id", "word_at", "candidate"))
    some = [marked.filter(F.col("label") == v).orderBy("h", "doc_id", "word_at", "candidate").limit(sample_rows // 2) for v in (0, 1)]
    return some[0].unionByName(some[1]).select(*FEATURES, "label")


def scan(docs: DataFrame, findings: DataFrame | None = None, sample_rows: int = 10_000, id_col: str = "doc_id", text_col: str = "text",
         path_col: str | None = "source") -> DataFrame:
    """Per candidate of ``docs``: doc_id, word_at, length, candidate_sha256, score and ``secret`` (score above 0.5).

    ``findings`` are labelled candidates: columns of ``candidates`` and ``label``. Without them ``labelled`` makes at most ``sample_rows``. If only one
    class is there, every candidate's score is that class. An empty table gives an empty table. Secrets themselves are not put
    out, only their hash, but candidates with their features are written once to the shared folder, so that neither labelling nor a pass of the training
    reads the texts again. Nulls: a null path has no path feature, null labels are left out.
    """
    known = dictionary(docs, text_col=text_col)
    spark = docs.sparkSession
    found = stored(spark, with_features(candidates(docs, id_col, text_col, path_col), known), "candidates")
    marked = with_features(findings.filter("label IS NOT NULL"), known).select(*FEATURES, "label") if findings is not None else labelled(found, sample_rows)
    marked = stored(spark, marked, "findings")
    model = train(marked)
    if model is None:
        only = marked.agg(F.max("label").alias("m")).first()["m"]
        scored = found.withColumn("score", F.lit(float(only or 0)))
    else:
        scored = model.transform(_assembled(found)).withColumn("score", vector_to_array("probability")[1])
    return scored.select(
        "doc_id", "word_at", F.length("candidate").cast("long").alias("length"), F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_sha256"),
        "score", (F.col("score") > 0.5).alias("secret"),
    )
